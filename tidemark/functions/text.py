"""Column expressions on post text: cleaning, matching, cutting, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dflt(c: Column | str, value) -> Column:
    """The column, or a default where it is null."""
    return F.coalesce(_c(c), F.lit(value))


def trim_all(c: Column | str) -> Column:
    """Strip every Unicode white space, not just U+0020."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """Strip tags, decode &amp; then &lt; then &gt; (so &amp;lt; becomes <), trim; null is ''."""
    bare = F.regexp_replace(dflt(c, ""), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return trim_all(bare)


def post_text(title: Column | str = "title", desc: Column | str = "desc") -> Column:
    return F.concat(dflt(title, ""), F.lit(" "), dflt(desc, ""))


def head(c: Column | str, n: int) -> Column:
    """The first n code points; null is ''."""
    return F.substring(dflt(c, ""), 1, n)


def non_blank(c: Column | str, fallback: str) -> Column:
    return F.when(trim_all(dflt(c, "")) == "", F.lit(fallback)).otherwise(_c(c))


def parse_terms(value: str | list[str] | None) -> list[str]:
    """A comma list as its trimmed non-empty terms; a list passes through."""
    if isinstance(value, str):
        return [t.strip() for t in value.split(",") if t.strip()]
    return list(value or [])


def split_terms(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(dflt(c, ""), ","), trim_all), lambda t: t != "")


def contains_any(hay: Column | str, needles: list[str]) -> Column:
    """Case-insensitive: some needle occurs. An empty needle is in every text, no needle in none."""
    if not needles:
        return F.lit(False)
    lowered = F.lower(dflt(hay, ""))
    return F.exists(F.array(*(F.lit(n.lower()) for n in needles)), lambda n: F.contains(lowered, n))


def in_date_window(date: Column | str, lo: str | None, hi: str | None) -> Column:
    """A yyyyMMdd string within [lo, hi] (yyyy-MM-dd); kept without a date, a parsable date or bounds.

    A bound that cannot be parsed is no bound.
    """
    d = F.try_to_date(_c(date), "yyyyMMdd")
    keep = F.lit(True)
    for bound, test in ((lo, lambda b: d >= b), (hi, lambda b: d <= b)):
        if bound:
            b = F.try_to_date(F.lit(bound), "yyyy-MM-dd")
            keep = keep & (b.isNull() | test(b))
    return d.isNull() | keep


def valid_json(c: Column | str) -> Column:
    """Whether a string is one JSON value with nothing behind it, which the parser alone would let pass."""
    wrapped = F.concat(F.lit("["), _c(c), F.lit("]"))
    return F.try_parse_json(wrapped).isNotNull() & (F.coalesce(F.json_array_length(F.when(F.try_parse_json(wrapped).isNotNull(), wrapped)), F.lit(0)) == 1)


def parse_array(answer: Column | str, element: str) -> Column:
    """The outermost JSON array of an answer as array<element>; null without one or if malformed."""
    found = array_span(answer)
    return F.when((found != "") & valid_json(found), F.from_json(found, f"array<{element}>"))


def array_span(answer: Column | str) -> Column:
    return F.regexp_extract(dflt(answer, ""), r"\[[\s\S]*\]", 0)


def answer_state(answer: Column | str) -> Column:
    """'ok' for a parsable array, 'empty' without an array, 'error' for a malformed one."""
    found = array_span(answer)
    return F.when(found == "", "empty").when(~valid_json(found), "error").otherwise("ok")


def parse_binary_preds(answer: Column | str, n: Column) -> Column:
    """The digits 0 and 1 of an answer, cut or padded with 0 to n."""
    digits = F.transform(F.regexp_extract_all(dflt(answer, ""), F.lit("([01])"), 1), lambda x: x.cast("int"))
    return F.slice(F.concat(digits, F.array_repeat(F.lit(0), n.cast("int"))), F.lit(1), n.cast("int"))


ADDED = r"ADDED_KEYWORDS:\s*(.+)"
MODIFIED = r"```MODIFIED_DATA\s*\n([\s\S]*?)\n```"


def parse_added_keywords(answer: Column | str) -> Column:
    return split_terms(F.regexp_extract(dflt(answer, ""), ADDED, 1))


def modified_json(answer: Column | str) -> Column:
    """The JSON of a MODIFIED_DATA block if it is a non-empty array, else null."""
    found = F.regexp_extract(dflt(answer, ""), MODIFIED, 1)
    size = F.json_array_length(F.when(valid_json(found), found))
    return F.when(F.coalesce(size, F.lit(0)) > 0, found)


def strip_directives(answer: Column | str) -> Column:
    bare = F.regexp_replace(dflt(answer, ""), r"```MODIFIED_DATA\s*\n[\s\S]*?\n```", "")
    return trim_all(F.regexp_replace(bare, r"ADDED_KEYWORDS:\s*.+", ""))
