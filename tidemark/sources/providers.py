"""External services behind small interfaces, each with a deterministic offline form."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.rules import score_of_total
from ..functions.text import non_blank, trim_all
from .storage import Settings

#: Rows a page, pages a keyword, texts a batch, characters a text, vector length.
PAGE_ROWS, PAGES, BATCH, MAX_CHARS, DIM = 100, 10, 128, 2000, 1024
BLANK = "blank document"


class Search(Protocol):
    def page(self, query: str, rows: int, start: int) -> dict | None: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, prompt: str, max_tokens: int) -> str | None: ...


def _number(*key) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest()[:6], "big")


class OfflineSearch:
    """Invents the same results for the same query each time."""

    def page(self, query: str, rows: int, start: int) -> dict | None:
        if not query.strip():
            return None
        total = _number(query) % 400
        made = [
            {"title": f"<b>{query}</b> {i}", "description": f"note {_number(query, i) % 97} on {query} &amp; more", "link": f"https://example.org/{_number(query, i // 2)}", "cafename": f"club {_number(query, i) % 7}", "postdate": f"2024{1 + i % 12:02d}{1 + i % 28:02d}"}
            for i in range(start - 1, min(total, start - 1 + rows))
        ]
        return {"total": total, "items": made}


class OfflineEmbedder:
    """Sums of hashed word vectors, scaled to length 1; a zero vector for no words."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                n = _number(w)
                out[i, n % self.dim] += 1 if n >> 20 & 1 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out.tolist()


class OfflineCompleter:
    """Answers from a table of prompts, or with an empty array."""

    def __init__(self, answers: dict[str, str] | None = None) -> None:
        self.answers = answers or {}

    def complete(self, prompt: str, max_tokens: int = 2000) -> str | None:
        return next((a for k, a in self.answers.items() if k in prompt), "[]")


def _fetch(url: str, headers: str, body: dict | None = None, timeout: float = 10) -> dict:
    """A JSON answer; anything but status 200 raises."""
    data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"} | json.loads(headers))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if answer.status != 200:
            raise OSError(f"status {answer.status}")
        return json.loads(answer.read())


class HttpSearch:
    """A paged search service: query, display, start and sort as parameters, total and items in the answer."""

    def __init__(self, url: str, headers: str = "{}") -> None:
        self.url, self.headers = url, headers

    def page(self, query: str, rows: int, start: int) -> dict | None:
        """None after a failure, which an answer with errorMessage is too."""
        asked = urllib.parse.urlencode({"query": query, "display": rows, "start": start, "sort": "date"})
        try:
            found = _fetch(f"{self.url}?{asked}", self.headers)
        except (OSError, ValueError):
            return None
        return None if "errorMessage" in found else found


class HttpEmbedder:
    """An embedding service: {"input": texts, "model": ...} to {"data": [{"embedding": [...]}]}."""

    def __init__(self, url: str, headers: str = "{}", model: str = "", dim: int = DIM) -> None:
        self.url, self.headers, self.model, self.dim = url, headers, model, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [x["embedding"] for x in _fetch(self.url, self.headers, {"input": texts, "model": self.model}, 60)["data"]]


class HttpCompleter:
    """A language-model service: one user message to {"content": [{"text": ...}]}."""

    def __init__(self, url: str, headers: str = "{}", model: str = "", timeout: float = 60) -> None:
        self.url, self.headers, self.model, self.timeout = url, headers, model, timeout

    def complete(self, prompt: str, max_tokens: int = 2000) -> str | None:
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        return _fetch(self.url, self.headers, body, self.timeout)["content"][0]["text"]


def search_of(settings: Settings) -> Search:
    return OfflineSearch() if settings.search == "offline" else HttpSearch(settings.search, settings.search_headers)


def embedder_of(settings: Settings) -> Embedder:
    return OfflineEmbedder() if settings.embedder == "offline" else HttpEmbedder(settings.embedder, settings.embedder_headers, settings.embedder_model)


def completer_of(settings: Settings) -> Completer:
    return OfflineCompleter() if settings.llm == "offline" else HttpCompleter(settings.llm, settings.llm_headers, settings.llm_model)


class Pages(InputPartition):
    """Pages of the search: (keyword, its place, first page, end), asked in turn."""

    def __init__(self, ranges: list[tuple[str, int, int, int]], pause: float) -> None:
        self.ranges, self.pause = ranges, pause


ITEM = "kw string, kw_pos int, page int, item_pos int, title string, description string, link string, cafename string, postdate string"


class SearchPages:
    """What the batch and the stream form share: the options, and the reading of pages."""

    def __init__(self, options: dict) -> None:
        self.brand = options.get("brand", "")
        self.keywords = json.loads(options.get("keywords", "[]"))
        self.pages, self.pause = int(options.get("pages", PAGES)), float(options.get("pause", 0))
        self.settings = Settings(search=options.get("provider", "offline"), search_headers=options.get("headers", "{}"))
        #: Items older than this end a keyword, since pages come by date, the newest first.
        self.since = options.get("since", "")

    def read(self, part: Pages) -> Iterator[tuple]:
        service = search_of(self.settings)
        for keyword, place, first, end in part.ranges:
            for page in range(first, end):
                found = service.page(f"{self.brand} {keyword}", PAGE_ROWS, 1 + page * PAGE_ROWS)
                time.sleep(part.pause)
                if not found or not found.get("items"):
                    break
                for i, x in enumerate(found["items"]):
                    yield (keyword, place, page, i, *(x.get(f, "") for f in ("title", "description", "link", "cafename", "postdate")))
                last = found["items"][-1].get("postdate") or ""
                if self.since and last.isdigit() and len(last) == 8 and last < self.since:
                    break


class SearchReader(SearchPages, DataSourceReader):
    """One partition for each keyword, whose pages are asked in turn until one fails or is empty, with a pause after each."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.wanted, self.end = None, self.pages

    def partitions(self) -> list[Pages]:
        return [Pages([(k, i, 0, self.end)], self.pause) for i, k in enumerate(self.keywords) if self.wanted is None or k in self.wanted]


class FilteredSearchReader(SearchReader):
    """Also takes filters: those on kw leave keywords out, those on page pages; a lower bound of postdate ends a keyword at the first page that ends before it.

    Spark applies all filters to the rows again. A session that reads with it has to set
    spark.sql.python.filterPushdown.enabled.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if column == "kw" and isinstance(f, EqualTo | In):
                self.wanted = {value} if isinstance(f, EqualTo) else set(value)
            elif column == "page" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.end = min(self.end, value + (not isinstance(f, LessThan)))
            elif column == "postdate" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.since = max(self.since, value)
            yield f


class SearchStreamReader(SearchPages, DataSourceStreamReader):
    """Pages in the order of their numbers, over all keywords, some for each batch.

    The offset counts pages: number n is page n / keywords of keyword n % keywords. A
    batch plans `pages_a_batch` more than were planned before, which `progress`, a file
    in a shared folder, remembers over restarts; a batch that was planned and not
    finished is planned again by Spark with the same ends. The `lanes` tasks of a batch
    share the budget of `a_second` pages.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.step, self.lanes, self.rate = int(options.get("pages_a_batch", 10)), int(options.get("lanes", 4)), float(options.get("a_second", 0))
        self.fs, self.progress = pafs.FileSystem.from_uri(options["progress"].replace("s3a://", "s3://", 1))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _planned(self) -> int:
        if self.fs.get_file_info(self.progress).type == pafs.FileType.NotFound:
            return 0
        with self.fs.open_input_stream(self.progress) as file:
            return int(file.read())

    def latestOffset(self) -> dict:
        return {"page": min(self.pages * len(self.keywords), self._planned() + self.step)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        numbers = range(start["page"], end["page"])
        if end["page"] > self._planned():
            with self.fs.open_output_stream(self.progress) as file:
                file.write(str(end["page"]).encode())
        ranges = [(self.keywords[n % len(self.keywords)], n % len(self.keywords), n // len(self.keywords), n // len(self.keywords) + 1) for n in numbers]
        lanes = max(1, min(self.lanes, len(ranges)))
        return [Pages(ranges[i::lanes], lanes / self.rate if self.rate else self.pause) for i in range(lanes) if ranges[i::lanes]]

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that ended."""


class SearchSource(DataSource):
    """spark.read or readStream .format("search") with options brand, keywords (a JSON array), pages, pause, since (a date that ends a keyword), push (take filters), and provider and headers of a service; streams also take progress, pages_a_batch, lanes and a_second."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return FilteredSearchReader(self.options) if self.options.get("push", "false") == "true" else SearchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SearchStreamReader(self.options)


def score_keywords(df: DataFrame, brand: str | None, provider: Search | None = None, every: int = 5, pause: float = 0.0) -> DataFrame:
    """The rows with `total` (0 after a failure) and `score` (50 after a failure); without a brand each row's own, `bk`, counts."""
    service = provider or OfflineSearch()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            totals = []
            for i, (kw, bk) in enumerate(zip(pdf["kw"], pdf["bk"] if brand is None else [brand] * len(pdf), strict=True)):
                found = service.page(f"{bk} {kw}", 1, 1)
                totals.append(None if found is None else int(found["total"]))
                if pause and i % every == every - 1:
                    time.sleep(pause)
            yield pdf.assign(found=pd.Series(totals, dtype="Int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    got = df.mapInPandas(run, f"{fields}, found bigint")
    return got.withColumns({"score": score_of_total("found"), "total": F.coalesce("found", F.lit(0))}).drop("found")


def embed(df: DataFrame, text: Column, provider: Embedder | None = None, batch: int = BATCH) -> DataFrame:
    """The rows with `embedding`; texts are cut, blank ones replaced, and sent in batches; a failed batch has zero vectors.

    A task holds the vectors of one batch. What filters and sorts by the vectors takes them
    as they are: a service is not asked twice for one row.
    """
    service = provider or OfflineEmbedder()

    @F.arrow_udf("array<float>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            for at in range(0, len(column), batch):
                part = column.slice(at, batch).to_pylist()
                try:
                    out = service.embed(part)
                except Exception:  # noqa: BLE001  whatever the service raises, its batch gets zero vectors, which no index takes
                    out = [[0.0] * service.dim] * len(part)
                yield pa.array(out, pa.list_(pa.float32()))

    once = vectors.asNondeterministic()
    return df.withColumn("embedding", once(non_blank(F.substring(F.coalesce(text, F.lit("")), 1, MAX_CHARS), BLANK)))


def complete(df: DataFrame, provider: Completer | None = None, max_tokens: int = 2000) -> DataFrame:
    """The rows of prompts with `answer`, null where the service fails."""
    service = provider or OfflineCompleter()

    def answer(p: str) -> str | None:
        try:
            return service.complete(p, max_tokens)
        except Exception:  # noqa: BLE001  a failed answer is a null one, whatever failed
            return None

    @F.pandas_udf("string")
    def answers(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in prompts:
            yield s.map(answer)

    return df.withColumn("answer", answers("prompt"))


def polled(check: Callable[[], dict], until: tuple[str, ...] = ("done", "error"), pause: float = 3.0, most: int = 1000) -> dict:
    """Ask for a job's state until it ends."""
    state: dict = {}
    for _ in range(most):
        state = check()
        if state.get("status") in until:
            break
        time.sleep(pause)
    return state


__all__ = ["BLANK", "HttpCompleter", "HttpEmbedder", "HttpSearch", "OfflineCompleter", "OfflineEmbedder", "OfflineSearch", "SearchSource", "complete", "completer_of", "embed", "embedder_of", "polled", "score_keywords", "search_of", "trim_all"]
