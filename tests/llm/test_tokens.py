"""Encoding, id files and packing against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from quillon.llm import bpe, idfile, packing, tokens
from quillon.llm.corpus_queries import vocabulary

SIGNS = [*"abcdeéßIİΣ  \n\t\r'sST12.,!?<|>_- 　\x1c\x85\xa0中文🙂́", "<|endoftext|>", " <|endoftext|> ", "'ll", "  ", "\n\n", " the", "ing", "tion.", " word,\nNext"]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", None, " ", "a" * 3000, " " * 2000, "ab" * 1500 + " x", "word " * 4000]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_segment_tree_bpe():
    codec, own = bpe.bpe(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rows = texts(1, 2000)
    for again in range(2):  # the second time from memory
        for text, ids in zip(rows, codec.encode_batch(rows)):
            want = own.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want, repr(text)
            assert codec.decode(ids) == own.decode(want, skip_special_tokens=False)


def test_one_and_many_agree():
    codec, r = bpe.bpe(vocabulary("byte_bpe_50k.json")), random.Random(5)
    words = [bytes(r.choice(b"abcdet \xc3\xa9") for _ in range(r.randint(1, 64))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge_many(words)] == [codec.merge_one(w) for w in words]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_encoder(name):
    codec, own = tokens.LibraryEncoder(vocabulary(name), memory=50), library(name)
    for text in texts(2, 6000):
        assert codec.ids(text).tolist() == own.encode(text or "", add_special_tokens=False).ids, repr(text)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int, piece string")


ROWS = [(5, "some words here", 1, "x"), (2, None, 1, None), (9, "", None, None), (7, "word " * 5000, 1, None), (7, "word " * 5000, 1, None), (-4, "<|endoftext|> a\n\nb", 0, None), (None, "no key", 1, None), (3, "unë é", 1, None)]


def test_digests(spark):
    own = library("byte_bpe_50k.json")
    found = {r["doc_id"]: r for r in bpe.digests(docs(spark, ROWS), vocabulary("byte_bpe_50k.json")).collect()}
    for i, text, *_ in ROWS:
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(-(2**62), 2**62, n)).view("<u8")
    slots = idfile.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_id_files(spark):
    own = library("byte_bpe_50k.json")
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, text, *_ in order:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), tokens.crc(np.array(ids))))
        at += len(ids)
    found = idfile.round_trip(docs(spark, ROWS), vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert idfile.round_trip(docs(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_keyed_access(spark):
    from quillon.llm.common import shared_path
    from quillon.llm.files import reading

    manifest = idfile.write(docs(spark, ROWS), vocabulary("byte_bpe_50k.json"), shared_path(spark, "ids"), shards=1).first()
    shard, own = idfile.Shard(manifest["path"]), library("byte_bpe_50k.json")
    first, rows = shard.find(np.array([5, 7, 123456, -1]))
    assert rows.tolist() == [1, 2, 0, 0]
    with reading(manifest["path"] + ".ids") as source:
        assert shard.ids(source, int(first[0]), 2).tolist() == [*own.encode("some words here", add_special_tokens=False).ids, 0]


def test_ids_that_need_four_bytes(spark, tmp_path):
    """A vocabulary with ids above 65,535: four bytes are chosen, and two are refused."""
    import json

    spec = json.loads(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    spec["added_tokens"].append({"id": 70000, "content": "<|far|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    spec["model"]["vocab"]["<|far|>"] = 70000
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec))
    own = __import__("tokenizers").Tokenizer.from_file(str(path))
    ids = own.encode("a <|far|> b", add_special_tokens=False).ids
    assert max(ids) >= 1 << 16 and idfile.id_width(str(path)) == 4 and idfile.id_width(vocabulary("byte_bpe_50k.json")) == 2
    rows = docs(spark, [(1, "a <|far|> b", 1, None)])
    assert [(r["n_tokens"], r["ids_crc32"]) for r in idfile.round_trip(rows, str(path)).collect()] == [(len(ids) + 1, tokens.crc(np.array([*ids, 0])))]
    with pytest.raises(Exception, match="does not fit"):
        idfile.round_trip(rows, str(path), 2).collect()


def test_a_key_over_many_shards(spark, monkeypatch):
    from quillon.llm.common import shared_path

    monkeypatch.setattr(idfile, "READ", 64)
    own = library("byte_bpe_50k.json")
    rows = [(7, f"text number {i}", 1, None) for i in range(300)] + [(None, f"no key {i}", 1, None) for i in range(50)] + [(i, "other", 1, None) for i in range(20, 60)]
    manifest = idfile.write(docs(spark, rows), vocabulary("byte_bpe_50k.json"), shared_path(spark, "ids"), shards=8)
    listed = manifest.collect()
    assert sum(m["low"] is not None and m["low"] <= 7 <= m["high"] for m in listed) > 1
    want = sorted([*own.encode(t, add_special_tokens=False).ids, 0] for i, t, *_ in rows if i == 7)
    assert sorted(x.tolist() for x in idfile.lookup(listed, 7)) == want and idfile.lookup(listed, 8) == []
    found = idfile.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 50 + [7] * 300 + list(range(20, 60))
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


def test_lookup_reads_little(spark, monkeypatch):
    """Of an index of 40,000 keys a lookup reads its head, a word a level, a slot and two starts, none of it for keys out of range."""
    import contextlib

    from quillon.llm.common import shared_path

    rows = [(3 * i, f"t {i % 50}", 1, None) for i in range(40_000)]
    listed = idfile.write(docs(spark, rows), vocabulary("byte_bpe_50k.json"), shared_path(spark, "ids"), shards=1).collect()
    spent, opened = [], idfile.reading

    class Counted:
        def __init__(self, source):
            self.source = source

        def read_at(self, n, at):
            spent.append(n)
            return self.source.read_at(n, at)

    @contextlib.contextmanager
    def counting(path):
        with opened(path) as source:
            yield Counted(source)

    monkeypatch.setattr(idfile, "reading", counting)
    own = library("byte_bpe_50k.json")
    for key in (0, 3, 59_997, 119_997):
        spent.clear()
        assert [x.tolist() for x in idfile.lookup(listed, key)] == [[*own.encode(f"t {key // 3 % 50}", add_special_tokens=False).ids, 0]]
        assert sum(spent) < 1500 and len(spent) < 16
    spent.clear()
    assert idfile.lookup(listed, -1) == [] and idfile.lookup(listed, 120_000) == [] and not spent
    assert all(idfile.lookup(listed, key) == [] for key in range(1, 900, 3))


def test_probe_agrees_with_the_whole_index(spark):
    from quillon.llm.common import shared_path
    from quillon.llm.files import reading

    r = random.Random(8)
    rows = [(r.randint(-(2**62), 2**62), "a", 1, None) for _ in range(500)] + [(5, f"b {i}", 1, None) for i in range(5000)]
    m = idfile.write(docs(spark, rows), vocabulary("byte_bpe_50k.json"), shared_path(spark, "ids"), shards=1).first()
    shard, keys = idfile.Shard(m["path"]), [i for i, *_ in rows[:501]] + [r.randint(-(2**62), 2**62) for _ in range(500)]
    first, n = shard.find(np.array(keys))
    with reading(m["path"] + ".idx") as index:
        head = idfile.Head(index.read_at(idfile.HEAD + 8 * idfile.LEVELS, 0), m["path"])
        for key, f, c in zip(keys, first.tolist(), n.tolist()):
            found = idfile.probe(index, head, key)
            assert found[1] == c and (not c or found[0] == f)
    assert len(idfile.lookup([m], 5)) == 5000


def test_shards_by_size(spark, monkeypatch):
    """As many shards as the bytes and rows ask for, however many shuffle partitions there are."""
    rows = docs(spark, [(i, "x" * 100, 1, None) for i in range(1000)])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert idfile.shards_for(rows) == idfile.shards_for(docs(spark, [])) == least
    monkeypatch.setattr(idfile, "SHARD_ROWS", 20)
    assert idfile.shards_for(rows) == 50
    monkeypatch.setattr(idfile, "SHARD_BYTES", 1000)
    assert idfile.shards_for(rows) == 100


def check_packed(rows, found, capacity, own):
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, text, *_ in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0])
        want.setdefault(i, []).extend((n, a, len(ids[a : a + capacity]), tokens.crc(ids[a : a + capacity])) for n, a in enumerate(range(0, len(ids), capacity)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own_pieces in sequences.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    own, r = library("word_bpe_49k.json"), random.Random(6)
    rows = ROWS + [(100 + i, " ".join(r.choice(["red", "green", "unusualword"]) for _ in range(r.randint(0, 150))), 1, None) for i in range(400)]
    found = packing.pack(docs(spark, rows).repartition(21), vocabulary("word_bpe_49k.json"), capacity=256, fan=3).collect()
    n = check_packed(rows, found, 256, own)
    total = sum(x["length"] for x in found)
    assert n <= 1.05 * -(-total // 256) + 2
    assert packing.pack(docs(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_best_fit():
    r = random.Random(7)
    for _ in range(50):
        sizes = np.array([r.randint(1, 100) for _ in range(r.randint(1, 300))])
        where, at, fill = packing.best_fit(sizes, 100)
        assert (np.bincount(where, weights=sizes) == fill).all() and fill.max() <= 100
        assert (fill <= 50).sum() <= 1  # two half-empty bins would have been one
        for b in range(len(fill)):
            own = sorted(zip(at[where == b], sizes[where == b]))
            assert [a for a, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1]]
