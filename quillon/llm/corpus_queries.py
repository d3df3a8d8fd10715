"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm import bpe, chroma, exact_dedup, idfile, importance, language, license_scan, maintext, packing, simhash, urls, vector_codes, warc
from quillon.llm.common import durable, passing, table
from quillon.llm.labelled_urls import made_urls

#: Rules that decide about URLs before any method does.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def settled(made, name: str):
    """A result that is written, so that the far larger tables and files it was made from can go."""
    with passing(made.sparkSession) as keep:
        return keep(durable(made, name))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out())
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return maintext.main_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return settled(exact_dedup.exact_groups(table(spark, sf_dir, "documents")), "groups")


def op5_chroma(spark, sf_dir):
    """No table has recordings: those of ``embeddings`` are its vectors, sounded as notes.

    Of each query (ids divisible by 20) there also is an excerpt with noise, a row of its own with the id -1 - vec_id, so that there are links to find.
    """
    vectors = table(spark, sf_dir, "embeddings")
    again = vectors.where("vec_id % 20 = 0 AND vec_id >= 0").select((-1 - F.col("vec_id")).alias("id"), "embedding")
    recordings = chroma.sounded(vectors, "vec_id", "embedding").unionByName(chroma.excerpts(again, "id", "embedding"))
    return chroma.search(recordings, lambda i: (i % 20 == 0) & (i >= 0), "id", "media").withColumnRenamed("id", "vec_id")


def op6_token_index(spark, sf_dir):
    return settled(idfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), "ids")


def op7_warc(spark, sf_dir):
    return settled(warc.round_trip(table(spark, sf_dir, "pages")), "records")


def op8_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark, sf_dir):
    """No table has labelled URLs: the method learns from URLs made by rule."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, urls.train(made_urls(spark)))


def queries() -> dict:
    found = (op1_language_id, op2_license_scan, op3_main_text, op4_exact_dedup, op5_chroma, op6_token_index, op7_warc, op8_bpe, op9_packing, op10_simhash, op11_vector_codes, op12_importance, op13_url_filter)
    return {f.__name__: f for f in found}
