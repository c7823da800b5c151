"""Collecting and preprocessing posts: filters, ordered limits, dedup in order, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, contains_any, dflt, in_date_window, post_text
from ..sources.storage import stored

#: Terms of club names that are always left out when collecting (fixed values).
DEFAULT_EXCLUDED = [
    "중고나라", "번개장터", "당근", "세컨웨어", "헬로마켓", "중고", "장터",
    "부동산", "판매", "팝니다", "삽니다", "택배", "무료배송", "할인코드",
    "쿠폰", "홍보", "광고", "업체", "시공", "인테리어업체", "이사", "용달",
    "대출", "보험설계사", "설계사모집", "모집",
]
MIN_TITLE, MIN_DESC = 5, 10
NO_CAFE = "unknown"


def from_search(items: DataFrame) -> DataFrame:
    """Search rows as posts: cleaned title and description, renamed fields, other columns kept."""
    renamed = {"desc": clean_text("description"), "cafe": clean_text("cafename"), "title": clean_text("title"), "date": dflt("postdate", ""), "link": dflt("link", "")}
    return items.withColumns(renamed).drop("description", "cafename", "postdate")


def crawl_filters(posts: DataFrame, brand: str = "", ad_terms: list[str] = (), exclude: list[str] = (), include: list[str] = (), date_from: str = "", date_to: str = "") -> DataFrame:
    """Date window, ad terms, left-out and wanted club names, and the brand's name in the text."""
    text = post_text()
    keep = in_date_window("date", date_from, date_to) & ~contains_any(text, list(ad_terms)) & ~contains_any("cafe", [*dict.fromkeys([*DEFAULT_EXCLUDED, *exclude])])
    if include:
        keep = keep & contains_any("cafe", list(include))
    return posts.filter(keep & F.contains(F.lower(text), F.lit(brand.lower())))


def take_target(posts: DataFrame, order: list[Column | str], target: int) -> DataFrame:
    """The first `target` rows in order: each task keeps its first ones only."""
    return posts.orderBy(*order).limit(target)


def preprocess(posts: DataFrame, ad_terms: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Filtered posts, the first of each link, with `idx`, without those short in both title and text.

    A first post that is then dropped as short still blocks its copies; one that the
    filters drop does not. A link in very many rows is no hot key: each task first
    keeps its own first row, through the minimum's partial aggregation.
    """
    kept = posts.filter(~contains_any(post_text(), list(ad_terms)) & ~contains_any("cafe", list(exclude)))
    first = kept.groupBy(dflt("link", "").alias("_link")).agg(F.min("pos").alias("_first"))
    firsts = kept.withColumn("_link", dflt("link", "")).join(first, "_link").filter(F.col("pos") == F.col("_first")).drop("_link", "_first")
    short = (F.length(dflt("title", "")) < MIN_TITLE) & (F.length(dflt("desc", "")) < MIN_DESC)
    return firsts.filter(~short).withColumn("idx", F.col("pos"))


def counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """original, filtered: rows before and after."""
    one = before.agg(F.count("*").alias("original"))
    return one.join(after.agg(F.count("*").alias("filtered")))


def cafe_stats(posts: DataFrame, unknown: str = NO_CAFE, order: str = "pos") -> DataFrame:
    """cafe, count; the largest first, and of equal ones the one seen first."""
    counted = posts.groupBy(dflt("cafe", unknown).alias("cafe")).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    return counted.orderBy(F.desc("count"), "_first").drop("_first")


def with_total(posts: DataFrame, name: str = "crawl") -> tuple[DataFrame, DataFrame]:
    """(the posts, written once to a shared folder; their total, counted over what was written)."""
    rows = stored(posts, name)
    return rows, rows.agg(F.count("*").alias("total"))


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """The rows; none raise."""
    if rows.isEmpty():
        raise ValueError(f"{what}: there are no rows")
    return rows


def given(value: str | list[str] | None, what: str) -> None:
    """A text that is null or blank, or a list without one that is not, raises."""
    each = value if isinstance(value, list | tuple) else [value]
    if not any((x or "").strip() for x in each):
        raise ValueError(f"{what}: nothing is given")


def with_batch(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The batch number of each row when rows in order are handled n at a time.

    Places come from ranges and their sizes, so no task sorts all rows.
    """
    return numbered(df, order, "_rn").withColumn("batch", F.floor(F.col("_rn") / n)).drop("_rn")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """A 0-based place by a numeric column: ranks within ranges, plus the sizes of the ranges before.

    The ranges lie between fixed quantiles, so every pass puts a row into the same one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts)))
    part = sum(((F.col(order) > b).cast("int") for b in bounds), F.lit(0))
    ranged = df.withColumn("_part", part)
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def label_sample(posts: DataFrame, percent: float = 2, cap: int = 20, least: int = 10, seed: str = "") -> DataFrame:
    """Up to `cap` rows of a sample of max(least, percent of the rows), by a hash of the place."""
    total = posts.agg(F.greatest(F.lit(least), F.floor(F.count("*") * percent / 100)).cast("int").alias("n"))
    top = posts.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("pos").cast("string")))).orderBy("_h", "pos").limit(cap)
    placed = top.withColumn("_rn", F.row_number().over(Window.orderBy("_h", "pos")))
    return placed.join(F.broadcast(total), F.col("_rn") <= F.col("n")).drop("_h", "_rn", "n")
