"""Keyword rounds: generation, validity, dedup, ranking, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dflt, parse_array, trim_all
from ..sources.providers import Completer, Search, complete, score_keywords
from .posts import given, not_empty, numbered

FEW, MANY = 2, 10


def valid_keywords(words: DataFrame) -> DataFrame:
    return words.filter(F.length(dflt("kw", "")) >= FEW)


def new_keywords(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid generated keywords that are not there yet, whatever their case; copies within a batch stay."""
    old = existing.select(F.lower("kw").alias("_old")).distinct()
    return valid_keywords(generated).join(old, F.lower(F.col("kw")) == F.col("_old"), "left_anti")


def numbered_ranked(scored: DataFrame, order: str = "pos") -> DataFrame:
    """Ids 1..n in order, then the best score first."""
    rows = numbered(scored, order, "_id").withColumn("id", (F.col("_id") + 1).cast("int")).drop("_id")
    return rows.orderBy(F.desc("score"), "id")


def category_totals(keywords: DataFrame) -> DataFrame:
    """cat, n, total: keywords of each category, the most first, beside the number of all."""
    total = keywords.agg(F.count("*").alias("total"))
    return keywords.groupBy("cat").agg(F.count("*").alias("n")).join(F.broadcast(total)).orderBy(F.desc("n"), "cat")


def category_rollup(keywords: DataFrame) -> DataFrame:
    """cat with counts of existing, new, approved and rejected; `state` and `rejected` per row."""
    new = F.col("state") == "new"
    return keywords.groupBy("cat").agg(
        F.count_if(~new).alias("existing"), F.count_if(new).alias("new"), F.count_if(new & ~F.col("rejected")).alias("approved"), F.count_if(new & F.col("rejected")).alias("rejected")
    )


def many_categories(keywords: DataFrame) -> DataFrame:
    return keywords.agg((F.countDistinct("cat") >= MANY).alias("collapse"))


def manual_add_verdict(words: DataFrame, existing: DataFrame, category: str) -> DataFrame:
    """word, verdict (insert, reject or move), matched_cat, up to the first word to be moved."""
    known = existing.groupBy(F.lower("kw").alias("_kw")).agg(F.min_by("cat", "pos").alias("matched_cat"))
    joined = words.join(known, F.lower("word") == F.col("_kw"), "left").drop("_kw")
    verdict = F.when(F.col("matched_cat").isNull(), "insert").when(F.col("matched_cat") == category, "reject").otherwise("move")
    judged = joined.withColumn("verdict", verdict)
    stop = judged.agg(F.min(F.when(F.col("verdict") == "move", F.col("pos"))).alias("_stop"))
    return judged.join(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col("pos") <= F.col("_stop"))).select("word", "verdict", "matched_cat")


def category_exists(existing: DataFrame, name: str) -> DataFrame:
    return existing.agg(F.coalesce(F.bool_or(F.lower(trim_all("cat")) == name.strip().lower()), F.lit(False)).alias("taken"))


def apply_review(keywords: DataFrame, rejected: DataFrame) -> DataFrame:
    """Keywords without the rejected ones, by round and id, since ids begin anew in each round."""
    return keywords.join(rejected.select("round", "id"), ["round", "id"], "left_anti")


def add_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def manual_keywords(words: DataFrame, brand: str, category: str, search: Search | None = None) -> DataFrame:
    """Words typed in by hand as keywords: id m_ and the place, scored. A blank category raises."""
    given(category, "category")
    rows = words.select("pos", F.concat(F.lit("m_"), "pos").alias("id"), F.col("word").alias("kw"), F.lit(category).alias("cat"), F.lit(True).alias("manual"))
    return score_keywords(rows, brand, search)


def suggested_keywords(words: DataFrame, category: str) -> DataFrame:
    """Suggested words as keywords: id s_ and the place, without a score. A blank category raises."""
    given(category, "category")
    none = F.lit(None)
    return words.select("pos", F.concat(F.lit("s_"), "pos").alias("id"), F.col("word").alias("kw"), F.lit(category).alias("cat"), F.lit(True).alias("manual"), none.cast("int").alias("score"), none.cast("long").alias("total"))


def move_keyword(keywords: DataFrame, round_: int, id_: int, category: str) -> DataFrame:
    here = (F.col("round") == round_) & (F.col("id") == id_)
    return keywords.withColumn("cat", F.when(here, F.lit(category)).otherwise(F.col("cat")))


def word_types(words: DataFrame, added: DataFrame, kind: str) -> DataFrame:
    """Suggested words of a type that were not added yet."""
    return words.filter(F.col("type") == kind).join(added.select("word"), "word", "left_anti")


GENERATE = "Product: {bk}\nProblem: {problem}\nAudience: {target}\nList search keywords by category as a JSON array of objects with kw and cat."
EXPAND = "Product: {bk}\nProblem: {problem}\nKnown keywords: {known}\nList further keywords, none of the known ones, as a JSON array of objects with kw and cat."
SUGGEST = "Product: {bk}\nCategory: {cat}\nList related adjectives and verbs as a JSON array of objects with word and type."


def prompt(template: str, **columns) -> F.Column:
    """A template whose {names} are filled with columns."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def generate(requests: DataFrame, existing: DataFrame, provider: Completer | None = None, search: Search | None = None) -> DataFrame:
    """Requests with `prompt` and `bk` to scored, new, numbered keywords, each scored with its own brand.

    Numbers go by brand, then by place in its answer.
    """
    asked = not_empty(requests.filter(F.coalesce("bk", F.lit("")) != ""), "brand")
    asked = asked.withColumn("_r", F.dense_rank().over(Window.orderBy("bk", "prompt")))  # a row for each brand that is asked about
    found = complete(asked, provider).select("bk", "_r", F.posexplode(parse_array("answer", "struct<kw:string,cat:string>")).alias("_i", "k"))
    rows = found.select("bk", (F.col("_r") * F.lit(1 << 32) + F.col("_i")).alias("pos"), "k.*")
    return numbered_ranked(score_keywords(new_keywords(rows, existing), None, search))


def suggested(answers: DataFrame, *keep: str) -> DataFrame:
    """word, type of the arrays in answers, with the columns `keep`; an answer without one gives no row."""
    return answers.select(*keep, F.explode(parse_array("answer", "struct<word:string,type:string>")).alias("w")).select(*keep, "w.*")
