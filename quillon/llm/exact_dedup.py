"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Each text is cut where its own content says so, each chunk gets a digest, and a text becomes its
ordered list of chunk digests: its recipe.  Digests count as identifiers only once verified: all
chunks with one digest are compared byte for byte, each distinct chunk moving once and copies being
folded before the shuffle.  A digest that holds different chunks is no identifier; recipes that use
one carry the chunk itself in its place.  Texts are equal exactly if their recipes are, so whole
documents never move.

Defined cases: null text equals the empty text (an empty recipe); a null id is kept as a row, its
group's ``keep_id`` is the largest id that is not null; of rows that repeat an id and a text one is
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable
from quillon.sources.shared import forget

#: Repeated rows that are made from one row at a time.
TOGETHER = 4096
#: A chunk ends after a sentence end, a line end or "e " once it has 512 characters, and at 4096 in any case.
CHUNKS = r"(?s).{512,4096}?(?:[.!?] |\n|e )|.{1,4096}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, chunks: one row per document with its chunks in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0)).alias("chunks"),
    )


def digest(chunk):
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def ambiguous(cut: DataFrame, id_of=digest) -> DataFrame:
    """Digests under which two different chunks were seen (in practice none)."""
    chunk = cut.select(F.explode("chunks").alias("chunk")).select(id_of(F.col("chunk")).alias("digest"), "chunk")
    seen = chunk.groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return seen.where(F.col("low") != F.col("high")).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_of=digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``id_of`` makes a chunk's digest; tests pass a weak one to reach the path for collisions.
    """
    cut = recipes(docs, id_col, text_col)
    rows = durable(cut.withColumn("recipe", F.transform("chunks", id_of)).drop("chunks"), "recipes")
    bad = durable(ambiguous(cut, id_of), "ambiguous")
    if not bad.isEmpty():
        forget(rows)
        rows = durable(_with_bytes(cut, bad, id_of), "recipes")
    forget(bad)
    # Copies of one id and text become one row with a count, so that a group's winner is one row.
    each = rows.groupBy("recipe", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    # Written, so that both sides of the join are plain exchanges and Spark can split a hot recipe.
    groups = durable(each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        each.join(groups, "recipe")
        # In blocks of TOGETHER, so that no row carries an array of all its copies.
        .select("doc_id", "keep_id", "group_size", "text_sha256", "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / TOGETHER))).alias("block"))
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.col("block") * TOGETHER + 1, F.least((F.col("block") + 1) * TOGETHER, "copies"))).alias("nth"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def _with_bytes(cut: DataFrame, bad: DataFrame, id_of) -> DataFrame:
    """Recipes in which documents that use an ambiguous digest carry each chunk's bytes behind its digest."""
    used = cut.select("doc_id", "text_sha256", F.explode(F.array_distinct(F.transform("chunks", id_of))).alias("digest"))
    mixed = used.join(bad, "digest", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    full = F.transform("chunks", lambda c: F.concat(id_of(c), c.cast("binary")))
    recipe = F.when(F.col("_sha").isNotNull(), full).otherwise(F.transform("chunks", id_of))
    return cut.join(mixed, same, "left").select("doc_id", "text_sha256", recipe.alias("recipe"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_text_sha", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    found = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_sha") == F.col("_sha")), "left_semi")
    return found.dropDuplicates([id_col, "_text_sha"]).select(*docs.columns)
