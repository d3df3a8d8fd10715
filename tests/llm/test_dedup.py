"""Exact and near duplicates against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, simhash
from quillon.llm.graph import components


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, chunks int")


def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[t or ""]
        out.append((i, max((x for x in own if x is not None), default=None), len(own)))
    return sorted(out, key=repr)


LONG = " ".join(f"word{i} lies here." for i in range(5000))
ROWS = [
    (1, "a text", "x", 1), (2, "a text", None, 2), (3, None, None, None), (4, "", "y", 0), (5, LONG, None, 1), (6, LONG, None, 1), (7, LONG[:-1], None, 1),
    (8, LONG[: len(LONG) // 2] + "!" + LONG[len(LONG) // 2 :], None, 1), (9, "ünïcödé \U0001f642 text", None, 1), (9, "ünïcödé \U0001f642 text", None, 1), (None, "a text", None, 1), (11, "a text ", None, 1), (12, "A text", None, 1),
]


@pytest.mark.parametrize("id_of", [exact_dedup.digest, lambda c: F.substring(c.cast("binary"), 1, 2)])
def test_exact_groups(spark, id_of):
    found = exact_dedup.exact_groups(docs_of(spark, ROWS), id_of=id_of).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == exact_brute(ROWS)
    kept = [r["keep_id"] for r in found if r["kept"]]
    assert sorted(kept) == sorted({k for _, k, _ in exact_brute(ROWS)})  # one row for each group


@pytest.mark.parametrize("together", [1, 7, 100, 4096])
def test_rows_that_repeat_often(spark, monkeypatch, together):
    """Each repeated row is in the result, however many are made from one row at a time."""
    monkeypatch.setattr(exact_dedup, "TOGETHER", together)
    rows = [(1, "same", None, 1)] * 700 + [(2, "same", None, 1)] * 7 + [(3, "other", None, 1)] * 100
    found = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == exact_brute(rows)
    assert sorted(r["doc_id"] for r in found if r["kept"]) == [2, 3]


def test_chunks_make_up_the_text(spark):
    for row in exact_dedup.recipes(docs_of(spark, ROWS)).collect():
        want = next(t for i, t, *_ in ROWS if i == row["doc_id"])
        if row["doc_id"] is not None:
            assert "".join(row["chunks"]) == (want or "")


def test_drop_copies_and_empty(spark):
    kept = exact_dedup.drop_copies(docs_of(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "keep_id", "chunks"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9, 11, 12]
    empty = docs_of(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def fingerprint_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_brute(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def varied(r, n):
    words = [f"w{i}" for i in range(200)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(n // 3)]
    rows = [None, "", "  \t", "One", "one two", "Ümlaut ÄÖÜ \x1c x", "a\x85b c d"]
    for own in base:
        rows.append(" ".join(own))
        near = list(own)
        near[r.randrange(len(near))] = r.choice(words)
        rows += [" ".join(near), "\n".join(own).upper()]
    return rows


def test_fingerprints():
    for text in varied(random.Random(1), 60):
        assert simhash.fingerprint(text) % (1 << 64) == fingerprint_brute(text)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_near_groups(spark, hot):
    texts = varied(random.Random(2), 120)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_groups(docs_of(spark, rows), hot=hot).collect()}
    fps = [fingerprint_brute(t) for t in texts]
    assert found == {i: (f, root) for i, (f, root) in enumerate(zip(fps, roots_brute(fps)))}


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_links_of_dense_fingerprints(spark, hot):
    """Fingerprints crowded in few bits: every level of the dealing is reached, no link is lost."""
    r = random.Random(3)
    crowd = {sum(1 << b for b in r.sample(range(10), r.randint(0, 4))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    for x in list(crowd)[:40]:
        crowd.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(crowd)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(frame, hot)).collect()}
    groups, want = {}, {}
    for x in fps:
        groups.setdefault(found.get(x, x), set()).add(x)
    for x, root in zip(fps, roots_brute(fps)):
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_no_run_outgrows_the_bits_left(spark):
    """A crowd of fingerprints that differ in nine bits and stays together over two levels: the last has at most 256 in a run."""
    low = [x | 0xABCD << 16 for x in range(0, 1 << 9)]
    spread = [sum((x >> i & 1) << (7 * i) for i in range(9)) for x in range(1 << 9)]
    fps = sorted(set(low + spread))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    levels = list(simhash.runs(frame, hot=8))
    sizes = [r.groupBy("path", "free").count().agg(F.max("count")).first()[0] for r in levels]
    assert len(levels) == 3 and sizes[0] <= 8 and sizes[1] <= 8 and 8 < sizes[2] <= 256
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, hot=8)).collect()}
    assert len(set(found.values())) == len({r for r in roots_brute(fps)}) and len(found) == len(fps)


def test_keep_one_and_empty(spark):
    same = [(None, "some words that stand here twice", "x", 1), (None, "Some words that stand here twice", None, 1)]
    assert simhash.keep_one(docs_of(spark, same)).count() == 1
    assert [r["doc_id"] for r in simhash.keep_one(docs_of(spark, [*same, (4, same[0][1].upper(), None, 1)])).collect()] == [4]
    rows = [(5, "the same few words here", "x", 1), (3, "The same few words here", None, 2), (9, "all other words stand there alone", None, 1), (9, "all other words stand there alone", None, 1), (None, "quite another text of words", None, 1)]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "chunks"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, 9, None]
    assert simhash.near_groups(docs_of(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.where("u < 0")).count() == 0
