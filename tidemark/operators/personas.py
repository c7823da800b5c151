"""Personas, their graph, insights and chat context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import node_size
from ..functions.text import answer_state, dflt, modified_json, parse_added_keywords, parse_array, strip_directives
from ..schemas import PERSONA_CLUSTER
from ..sources.providers import Embedder, embed
from .clusters import diversity, sizes, summary_text
from .vectors import search_per_group

CENTER, CENTER_SIZE, PERSONA_SIZE = "center", 40, 12
LATEST_EXAMPLES = 10
PROMPT = "Product: {bk}\nFor each cluster below write personas with name, situation, pain_point and insight, as a JSON array of objects with cluster_id, cluster_name and personas.\n{examples}{clusters}"


def cluster_context(df: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """cluster, text: the part of the persona prompt about each cluster, numbered from 1.

    The lines are the cluster's first posts, or its search hits (cluster, rank, title,
    desc) where there are some.
    """
    lines = summary_text(df)
    if hits is not None:
        line = F.concat(F.lit("- "), dflt("title", ""), F.lit(" | "), F.substring(dflt("desc", ""), 1, 100))
        found = hits.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("found"))
        lines = lines.join(found, "cluster", "left").select("cluster", F.coalesce("found", "summary").alias("summary"))
    joined = sizes(df).join(diversity(df), "cluster").join(lines, "cluster")
    title = F.format_string("\n### Cluster %d (%d posts, %d keywords)\n", (F.col("cluster") + 1).cast("long"), "size", "n_keywords")
    return joined.select("cluster", F.concat(title, "summary", F.lit("\n")).alias("text"))


def retrieval_queries(df: DataFrame, n: int = 5) -> DataFrame:
    """cluster, text: what a cluster is searched by, the keywords of its first n posts."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))
    first = df.select("cluster", "pos", dflt("kw", "").alias("kw")).withColumn("rank", rank).filter(F.col("rank") <= n)
    return first.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kw"))), lambda x: x["kw"]), " ").alias("text"))


def retrieved(df: DataFrame, vectors: DataFrame, provider: Embedder | None = None, k: int = 10) -> DataFrame:
    """cluster, rank, title, desc: the k records nearest to each cluster's query."""
    asked = embed(retrieval_queries(df), F.col("text"), provider).select(F.col("cluster").alias("query_id"), F.col("embedding").alias("query"))
    found = search_per_group(vectors, asked, k)
    return found.join(vectors.select("id", "metadata.title", "metadata.desc"), "id").select(F.col("query_id").alias("cluster"), "rank", "title", "desc")


def persona_prompt(df: DataFrame, bk: str, examples: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """One row with the prompt over all clusters."""
    parts = cluster_context(df, hits).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "text"))), lambda x: x["text"]), "").alias("clusters"))
    shown = F.lit("")
    if examples is not None:
        parts = parts.join(naming_examples(examples))
        shown = F.col("examples")
    text = F.replace(F.replace(F.replace(F.lit(PROMPT), F.lit("{bk}"), F.lit(bk)), F.lit("{examples}"), shown), F.lit("{clusters}"), F.col("clusters"))
    return parts.select(F.lit(bk).alias("bk"), text.alias("prompt"))


def naming_examples(examples: DataFrame, last: int = LATEST_EXAMPLES) -> DataFrame:
    """One row with lines on the last examples (pos, industry, cluster, personas), oldest first."""
    top = examples.orderBy(F.desc("pos")).limit(last)
    line = F.concat(F.lit("- "), dflt("industry", ""), F.lit(", "), dflt("cluster", ""), F.lit(": "), F.array_join("personas", ", "), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return top.agg(F.array_join(lines, "").alias("examples"))


def parse_personas(answers: DataFrame) -> DataFrame:
    """answers with state (ok, empty, error) and personas; an answer without an array is no new version."""
    return answers.withColumns({"state": answer_state("answer"), "personas": parse_array("answer", "struct<" + ",".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in PERSONA_CLUSTER.split(", ", 2))) + ">")})


def explode_personas(df: DataFrame) -> DataFrame:
    """cluster_id, cluster_name, persona_idx and the persona's fields, of rows (cluster_id, cluster_name, personas)."""
    return df.select("cluster_id", "cluster_name", F.posexplode("personas").alias("persona_idx", "p")).select("cluster_id", "cluster_name", "persona_idx", "p.*")


def build_graph(personas: DataFrame, clustered: DataFrame, bk: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the product, its clusters and their personas. cluster_id counts from 1, cluster from 0."""
    spark = personas.sparkSession
    counts = sizes(clustered).select((F.col("cluster") + 1).alias("cluster_id"), "size")
    known = personas.join(counts, "cluster_id", "left").withColumn("n", F.coalesce("size", F.lit(0)))
    cluster = F.concat(F.lit("cluster_"), F.col("cluster_id"))
    each = explode_personas(personas)
    persona = F.concat(F.lit("persona_"), F.col("cluster_id"), F.lit("_"), F.col("persona_idx"))
    none = F.lit(None).cast("string")
    nodes = (
        spark.range(1).select(F.lit(CENTER).alias("id"), F.lit(bk).alias("name"), F.lit("product").alias("type"), F.lit(CENTER_SIZE).cast("long").alias("size"), none.alias("pain_point"), none.alias("insight"))
        .union(known.select(cluster, "cluster_name", F.lit("cluster"), node_size("n"), none, none))
        .union(each.select(persona, dflt("name", ""), F.lit("persona"), F.lit(PERSONA_SIZE).cast("long"), dflt("pain_point", ""), dflt("insight", "")))
    )
    links = known.select(F.lit(CENTER).alias("source"), cluster.alias("target"), F.col("n").alias("value")).union(each.select(cluster, persona, F.lit(1).cast("long")))
    return nodes, links


def insights(personas: DataFrame, info: DataFrame) -> DataFrame:
    """Each persona cluster with its cluster's size, by cluster_id - 1."""
    return personas.join(info.withColumn("cluster_id", F.col("cluster") + 1), "cluster_id", "left")


def chat_clusters(df: DataFrame) -> DataFrame:
    """cluster, line: number of posts and the first three titles, for a chat prompt."""
    from .clusters import samples

    titles = samples(df, 3).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.substring(x["title"], 1, 30)), ", ").alias("titles"))
    line = F.format_string("Cluster %d (%d posts): %s", (F.col("cluster") + 1).cast("long"), "size", "titles")
    return sizes(df).join(titles, "cluster").select("cluster", line.alias("line"))


def parse_chat(answers: DataFrame) -> DataFrame:
    """answers with added_keywords, modified (JSON of new personas or null) and clean_answer."""
    added = parse_added_keywords("answer")
    return answers.withColumns({"added_keywords": added, "modified": modified_json("answer"), "clean_answer": strip_directives("answer")})


CHAT = "Pipeline state:\n{state}\n\nPersonas:\n{personas}\n\nClusters:\n{clusters}\n\nRelated posts:\n{posts}\n\nQuestion: {question}\nTo add keywords, end with a line ADDED_KEYWORDS: a, b."
NOTHING = "none"


def post_lines(hits: DataFrame, desc_len: int = 200) -> DataFrame:
    """One row with a line '- title | desc' for each search hit, best first."""
    line = F.concat(F.lit("- "), dflt("title", ""), F.lit(" | "), F.substring(dflt("desc", ""), 1, desc_len), F.lit("\n"))
    ranked = hits.select((-F.col("score")).alias("s"), "id", line.alias("line"))
    return ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "id", "line"))), lambda x: x["line"]), "").alias("posts"))


def chat_prompt(question: str, clustered: DataFrame, hits: DataFrame, state: str = "", persona_json: str = "") -> DataFrame:
    """One row with the chat prompt; parts that are missing read as none."""
    lines = chat_clusters(clustered).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "line"))), lambda x: x["line"]), "\n").alias("clusters"))
    filled = lines.join(post_lines(hits))
    text = F.lit(CHAT)
    parts = {"state": F.lit(state), "personas": F.lit(persona_json), "clusters": F.col("clusters"), "posts": F.col("posts"), "question": F.lit(question)}
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.when(part == "", NOTHING).otherwise(part))
    return filled.select(text.alias("prompt"))


def written_back(answers: DataFrame, run: str) -> DataFrame:
    """New persona versions from answers that hold a non-empty block of modified data; others make none."""
    element = PERSONA_CLUSTER.replace("personas array", "personas: array", 1).replace("cluster_id int", "cluster_id: int").replace("cluster_name string", "cluster_name: string")
    made = answers.withColumn("_m", modified_json("answer")).filter("_m IS NOT NULL")
    return made.select("bk", F.from_json("_m", f"array<struct<{element}>>").alias("personas"), F.lit(run).alias("timestamp"))
