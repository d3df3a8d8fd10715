"""Recordings in all widths of samples, excerpts that the query plants, and candidates dealt by work."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chroma, corpus_queries


def wav(data, kind, bits, extensible=False):
    if kind == 3:
        body = data.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (np.round(data * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = (np.round(data * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    else:
        body = np.round(data * (2.0 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    size = bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, 1, chroma.RATE, chroma.RATE * size, size, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 4) + struct.pack("<H", kind) + bytes(14)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\x00"
    parts = b"WAVE" + odd + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


@pytest.mark.parametrize("kind, bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
@pytest.mark.parametrize("extensible", [False, True])
def test_widths(kind, bits, extensible):
    data = 0.8 * np.sin(np.arange(20_000) / 17)
    found = chroma.samples(wav(data, kind, bits, extensible))
    assert len(found) == len(data) and np.abs(found - data).max() < (0.02 if bits == 8 else 1e-4)


def test_unreadable():
    good = wav(np.zeros(100), 1, 16)
    for bad in (b"", b"RIFF", good[:30], good.replace(b"WAVE", b"AVI "), wav(np.zeros(10), 1, 16).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 7, 1), 1), None):
        assert len(chroma.samples(bad)) == 0
    assert len(chroma.samples(good[:-31])) == 84  # cut off: what is whole of it


def test_planted_excerpts_are_found(spark):
    found = corpus_queries.op5_chroma(spark, "/root/testdata/sf0.001")
    asked = {r["vec_id"]: [] for r in found.where("is_query").select("vec_id").distinct().collect()}
    for r in found.where("link_class IS NOT NULL").collect():
        asked[r["vec_id"]].append(r["link_class"])
    assert len(asked) == 25 and all(i % 20 == 0 for i in asked)
    assert sum(-1 - i in links for i, links in asked.items()) >= 0.95 * len(asked)
    assert sum(len(links) for links in asked.values()) <= 1.1 * len(asked)


def test_candidates_are_dealt_by_work(spark, monkeypatch):
    """A query that everything matches is judged in many parts, none with more frames than JUDGED but for one recording."""
    monkeypatch.setattr(chroma, "JUDGED", 500)
    r = np.random.default_rng(2)
    song = chroma.samples(chroma.melody(r.normal(size=64).tolist()))
    rows = [(0, chroma.written(song))] + [(i, chroma.written(song + 0.02 * r.standard_normal(len(song)))) for i in range(1, 60)]
    seen = spark.sparkContext.accumulator(0)
    judged = chroma._judged

    def counted(batches):
        n = 0

        def passed():
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield b

        yield from judged(passed())
        seen.add(n if n > 30 else 0)

    monkeypatch.setattr(chroma, "_judged", counted)
    monkeypatch.setattr(chroma, "width", lambda spark: 64)
    found = chroma.search(spark.createDataFrame(rows, "id long, media binary"), lambda i: i == 0, "id", "media")
    linked, classes = found.where(F.col("link_class").isNotNull()).count(), found.select("class_id").distinct().count()
    assert classes > 30 and linked == classes - 1 and seen.value == 0
