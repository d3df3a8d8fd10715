"""Importance resampling: documents drawn by how much more likely a target makes their word runs than their own corpus.

Features are runs of one to ``order`` consecutive words, hashed into buckets; a bucket's gain is the logarithm of
its share of the target's features over its share of the corpus's.  A document's weight is the mean gain of its
features, and Gumbel noise from the document's id turns the highest scores into a draw without replacement.

Long texts are skewed work: a text of more than ``LONG`` characters is cut at word boundaries into chunks of up to
``CHUNK`` words, and each chunk carries the first ``order - 1`` words behind it.  A chunk owns the runs that start in
it, carried words only complete them, so that every run is counted once.  Chunks are dealt over all tasks and
written once; their counts and gains are summed by document.  Shorter texts are one chunk, counted where they are read.
Between the passes as many numbers as buckets are kept.

Defined cases: null and empty texts have no words, weight 0 and are never drawn; ids are whole numbers, may be null or
repeat, and each row counts and is returned (a null id has the noise of the text ``null``); equal scores go to
the smaller id, null ids last; an empty table gives no rows; against a target without words gains follow from the
corpus alone; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, passing, whole, width
from quillon.sources.labelled import counted, placed

#: Characters of a text that is one chunk.
LONG = 8192
#: Words of a chunk of a longer text.
CHUNK = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are in no word; all others beyond letters and digits are.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def _words(text: Column) -> Column:
    """Words in lower case (A to Z alone), by one pass over characters and a split at blanks, without a pattern."""
    spaced = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def _kept(value: Column, name: str) -> Column:
    """A column behind a generator, so that no lambda that uses it computes it for each element anew."""
    return F.explode(F.array(value)).alias(name)


def short_pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, own, longer: texts of one chunk; nothing is carried."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).where(F.length("text") <= LONG)
    return rows.select("doc_id", _kept(_words(F.col("text")), "own")).withColumn("longer", F.col("own"))


def long_chunks(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """part, doc_id, digest, nth, own, carry: chunks of longer texts, dealt over all tasks.

    A document is known by the partition it was read in, its id and its digest; rows that agree in all three are
    counted as copies.
    """
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).where(F.length("text") > LONG)
    held = rows.select("part", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), _kept(_words(F.col("text")), "words"))
    # A text without words still is a document: it has one empty chunk.
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))
    cut = F.transform(starts, lambda i: F.struct(F.slice("words", i + 1, CHUNK).alias("own"), F.slice("words", i + 1 + CHUNK, max(0, order - 1)).alias("carry")))
    each = held.select("part", "doc_id", "digest", F.posexplode(cut).alias("nth", "chunk")).select("part", "doc_id", "digest", "nth", "chunk.*")
    return each.repartition(width(docs.sparkSession), "digest", "nth")


def long_pieces(chunks: DataFrame) -> DataFrame:
    return chunks.select("part", "doc_id", "digest", "nth", "own", _kept(F.concat("own", "carry"), "longer"))


def buckets_of(order: int, n_buckets: int) -> Column:
    """Buckets of the runs that start in a piece's own words; null where a text ends before a run does."""
    runs, found = F.col("own"), []
    for k in range(1, order + 1):
        if k > 1:
            runs = F.zip_with(runs, F.slice("longer", k, F.size("own")), lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(F.transform(runs, lambda x: (F.crc32(x.cast("binary")) % n_buckets).cast("int")))
    return F.array_compact(F.concat(*found))


def _counts(pieces: list[DataFrame], order: int, n_buckets: int) -> list[int]:
    """Features in each bucket."""
    each = [p.select(F.explode(buckets_of(order, n_buckets)).alias("bucket")) for p in pieces]
    both = each[0].unionByName(each[1])
    found = [0] * n_buckets
    for r in both.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the natural logarithm of each bucket's share of the target over that of the corpus, one added to each count."""
    n = float(len(corpus))
    ours, theirs = sum(corpus) + n, sum(target) + n
    return [math.floor(1000 * math.log((t + 1.0) * ours / ((s + 1.0) * theirs))) for s, t in zip(corpus, target)]


def _weighed(pieces: DataFrame, keys: list, table: list[int], order: int) -> DataFrame:
    """The keys, n_words, n_features and total (of gains) of each piece."""
    # A constant that Spark folds into one array.
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    found = pieces.select(*keys, F.size("own").cast("long").alias("n_words"), _kept(buckets_of(order, len(table)), "buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(gain, b))
    return found.select(*keys, "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))


def _summed(weighed: DataFrame) -> DataFrame:
    """Chunks of longer texts summed by document, a row for each copy."""
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]
    each = weighed.groupBy("part", "doc_id", "digest").agg(F.count(F.when(F.col("nth") == 0, 1)).alias("copies"), *sums)
    own = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "total")]
    return each.select("doc_id", *own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, order: int, n_buckets: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document, written."""
    spark = docs.sparkSession
    with passing(spark) as keep:
        sides = []
        for rows, name, text in ((docs, id_col, text_col), (target.select(F.lit(0).alias("none"), target_col), "none", target_col)):
            sides.append((short_pieces(rows, name, text), long_pieces(durable(long_chunks(rows, name, text, order), "chunks"))))
        table = gains(*[_counts(list(side), order, n_buckets) for side in sides])
        short, long = sides[0]
        each = _weighed(short, ["doc_id"], table, order).unionByName(_summed(_weighed(long, ["part", "doc_id", "digest", "nth"], table, order)))
        # Whole numbers only: the remainder is taken off first, so the division leaves none.
        weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
        key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        found = each.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
        return keep(durable(found, "weights"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = 2, n_buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document, those drawn with their rank from 1 on.

    Of the documents with ``min_words`` words or more ``percent`` in a hundred are drawn, rounded down.
    """
    found = scored(docs, target, id_col, text_col, target_col, order, n_buckets, seed)
    enough = found.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    # Sorted by ranges, then numbered by the sizes of the parts: no task sees all.
    ordered = enough.sort(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    ranked = counted(placed(ordered), "rank", first=1).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = found.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
