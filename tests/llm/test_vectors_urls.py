"""Vector codes, importance resampling and URL judgements against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.errors import DataError
from quillon.llm import importance, urls, vector_codes
from quillon.llm.boosting import Fork
from quillon.llm.corpus_queries import URL_RULES
from quillon.llm.labelled_urls import made_urls

# --- vector codes --------------------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds, scale=1024):
    """(vec_id, code, error, label_error, digest) of plain rounds in whole numbers."""
    kept = [(i, y, [math.floor(scale * v) for v in x]) for i, x, y in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    values = np.array([q for _, _, q in kept], object).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[list(values[k, p]) for k in first] for p in range(parts)]

    def nearest():
        found = np.zeros((len(kept), parts, 2), object)
        for p in range(parts):
            for k in range(len(kept)):
                found[k, p] = min((sum((a - b) ** 2 for a, b in zip(values[k, p], c)), e) for e, c in enumerate(books[p]))
        return found

    for _ in range(rounds):
        near = nearest()
        for p in range(parts):
            for e in range(len(first)):
                own = [values[k, p] for k in range(len(kept)) if near[k, p, 1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    near = nearest()
    errors = [int(sum(near[k, :, 0])) for k in range(len(kept))]
    by_label = {}
    for (_, y, _), error in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + error
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in near[k, :, 1]), errors[k], by_label[y], digest) for k, (i, y, _) in enumerate(kept)), key=repr)


def some_vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(n)]
    bad = [(1000, None, "a"), (1001, [None] + [0.0] * (width - 1), "a"), (1002, [math.nan] + [0.0] * (width - 1), "b"), (1003, [0.0] * (width - 1) + [-math.inf], None)]
    # Repeated rows, a null id, an id that comes twice, ties of entries, exact halves.
    return rows + bad + rows[:5] + [(None, [0.5] * width, None), (3, [-0.0004882812] * width, "c"), (-7, [0.25] * width, "c"), (-6, [0.25] * width, "c")]


@pytest.mark.parametrize("entries, block", [(8, 16), (200, 4096), (1, 7)])
def test_codes_are_those_of_plain_rounds(spark, entries, block):
    rows = some_vectors(90, 8, entries)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, code string, q int").repartition(3)
    found = vector_codes.codes(table, entries=entries, block=block)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == lloyd(rows, 4, entries, 4)


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    for bad in ([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], [(1, [0.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(DataError):
            vector_codes.codes(spark.createDataFrame(bad, schema))


def test_heaps_leave_parts_alone_and_lose_none():
    """Only parts whose bounds broke are compared again, and entries are those of comparing all."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (16, 8))
    values = (centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    now = vector_codes.Round(values[:16].reshape(1, 16, 8).copy(), np.zeros((1, 16)))
    entry, keys, rows, change = now.settle(values, np.zeros((1, 3000), np.uint8), None, None)
    totals, looked_at = np.zeros((1, 16, 9), np.int64), []
    for _ in range(8):
        for slot, x in change:
            totals.ravel()[slot] += x
        now = now.moved(totals)
        popped = vector_codes.Heaps(entry[0], keys[0], rows[0], 16).pop(now.drift[0])
        looked_at.append(len(popped))
        entry, keys, rows, change = now.settle(values, entry, keys, rows)
        assert (entry[0] == vector_codes.scan(values.astype(float), now.books[0].astype(float))[0]).all()
        assert sorted(rows[0].tolist()) == list(range(3000))
    assert looked_at[-1] < 0.2 * len(values) and sum(looked_at) < 0.7 * 8 * len(values)


def test_hot_labels(spark):
    found = spark.range(30_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id")).cast("int").alias("label"), F.lit("00").alias("code"), F.lit(2).cast("long").alias("error"))
    got = vector_codes._with_label_errors(found).groupBy(F.col("label").isNull().alias("none")).agg(F.count("*").alias("n"), F.min("label_error").alias("low"), F.max("label_error").alias("high"))
    assert sorted(map(tuple, got.collect())) == [(False, 20_000, 2, 2), (True, 10_000, 20_000, 20_000)]


# --- importance resampling -----------------------------------------------------------------------


def runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampled(docs, target, n_buckets=10_000):
    made = [(i, *runs(t)) for i, t in docs]

    def bucket(run):
        return zlib.crc32(run.encode()) % n_buckets

    s, t = [0] * n_buckets, [0] * n_buckets
    for side, texts in ((s, [f for _, _, f in made]), (t, [runs(x)[1] for x in target])):
        for found in texts:
            for run in found:
                side[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + n_buckets) / ((a + 1.0) * (sum(t) + n_buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, words, found in made:
        weight = sum(gain[bucket(r)] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(enough[: len(enough) * 25 // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def some_docs():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "日本語", "x1", "42", "Ünder", "zeta", "\U0001f642", "o"]
    docs = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(60)]
    long = " ".join(rng.choices(vocabulary, k=6000))
    docs += [(100, long), (100, long), (101, long), (None, long), (102, long + "."), (103, "w" * 30_000 + " end"), (104, "." * 9000), (105, " ".join(["same"] * 5000)), (106, "ab " * 3000 + "tail")]
    return docs + [(200, None), (201, ""), (202, " \t"), (203, "one"), (3, docs[3][1]), (None, docs[4][1]), (204, "İstanbul ǅ K " * 30)]


@pytest.mark.parametrize("parts", [1, 5])
def test_resample(spark, parts):
    docs, target = some_docs(), ["beta beta alpha", None, "", "été " * 5000, "42 x1"]
    table = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, own string, nth int, rank string").repartition(parts)
    found = importance.resample(table, spark.createDataFrame([(x, 1) for x in target], "text string, none int"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == resampled(docs, target)


def test_chunks_own_their_runs(spark):
    """Chunks with what they carry give each run of up to three words once, wherever a text is cut."""
    text = " ".join(f"w{i}" for i in range(4 * importance.CHUNK + 1)) + " " * importance.LONG
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = importance.long_pieces(importance.long_chunks(table, "doc_id", "text", 3))
    found = sorted(x for r in pieces.select(importance.buckets_of(3, 1 << 30).alias("b")).collect() for x in r["b"])
    w = text.split()
    want = w + [" ".join(p) for p in zip(w, w[1:])] + [" ".join(p) for p in zip(w, w[1:], w[2:])]
    assert found == sorted(zlib.crc32(x.encode()) % (1 << 30) for x in want) and pieces.count() == 5


def test_resample_empty(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).count() == 0
    few = [(i, "word " * (15 + i)) for i in range(12)]
    found = importance.resample(spark.createDataFrame(few, "doc_id long, text string"), target)
    assert sorted(map(tuple, found.collect()), key=repr) == resampled(few, [])


# --- URLs ----------------------------------------------------------------------------------------


def parsed(url):
    _, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules):
    fits = []
    for verdict, rule in rules:
        own, slash, below = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + below):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def bits(text):
    n = max(len(text), 1)
    return sum(-text.count(c) / n * math.log2(text.count(c) / n) for c in set(text))


def lexical(url, suffixes):
    text, (host, path) = url or "", parsed(url)
    query = re.match(r"[^?#]*\?([^#]*)", text)
    known = {s: (r, n) for s, r, n in suffixes.known}
    tails = [".".join(host.split(".")[-2:]), host.split(".")[-1]]
    rate, share = next((known[t] for t in tails if t in known), (suffixes.rate, 0))
    digits = sum(c in "0123456789" for c in text)
    values = [len(text), len(host), path.count("/"), 1000 * digits // max(len(text), 1), sum(c in "0123456789" for c in host), host.count("-"), None, None, 1 + query[1].count("&") if query and query[1] else 0, rate, share]
    return dict(zip(urls.FEATURES, values)), 100 * bits(text), 100 * bits(host)


def walked(tree, row):
    while isinstance(tree, Fork):
        tree = tree.low if row[tree.feature] <= tree.bound else tree.high
    return tree.value


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(made_urls(spark, 3000), trees=8)


URLS = [
    "https://shop.example.net/en/1", "https://example.net/en/", "https://EXAMPLE.NET/EN/", "https://notexample.net/en/x", "http://example.com/de/x?u=http://a.net/", "http://m.example.com/de", "http://a.org/fr/1", "http://a.org/frank",
    "http://net/", "http://x.net?q", "http://x.net#f/", "ftp://user@Host.ORG:21/fr/a#b?c", "http:///fr/", "no scheme/net/", "", None, "://", "a://b://c.net/d", "https://cheap-pills.example.org/en/728?a=1&b=2&c#d?e&f", "https://x.net/" + "é/" * 20_000, "http://ä.example.com/de/ü",
    "https://news.example.org/en/12", "https://win-cash.example.com/fr/9", "https://1.2.3.4/x", "http://f3a9c1d07b5e48.info/q8s7d6f5?sid=a8f7&aff=9d8s&cid=77", "http://x.net\n/en",
]


def test_judge(spark, model):
    rows = [(i, u, "h", "s") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[1], None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, score string")
    found = urls.judge(table, URL_RULES, model)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "score"] and found.count() == len(rows)
    for r in found.where("page_id > 0").collect():
        host, path = parsed(URLS[r["page_id"]])
        rule, verdict = ruled(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.judge(table.limit(0), URL_RULES, model).count() == 0


def test_features_and_scores(spark, model):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i long, url string")
    scores = {r["page_id"]: r["score"] for r in urls.judge(table, [], model, "i").collect()}
    for r in urls.with_features(table, "url", model.suffixes, "i").collect():
        want, whole, host = lexical(URLS[r["i"]], model.suffixes)
        assert {k: r[k] for k in want if want[k] is not None} == {k: v for k, v in want.items() if v is not None}
        assert abs(r["entropy"] - whole) <= 0.501 and abs(r["host_entropy"] - host) <= 0.501
        margin = model.trees.base + sum(walked(t, r) for t in model.trees.trees)
        assert scores[r["i"]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_rules(spark):
    rules = [("block", "a.b"), ("allow", "x.a.b"), ("allow", "b/x"), ("block", "a.b/long"), ("allow", "a.b/long/er")]
    cases = [("a.b", "/"), ("x.a.b", "/q"), ("b", "/x"), ("a.b", "/longest"), ("a.b", "/long/er/x"), ("ba.b", "/"), ("z", "/x"), ("x.a.b", "")]
    table = spark.createDataFrame(cases, "host string, path string")
    found = table.select("host", "path", urls.fitting(F.col("host"), F.col("path"), rules).alias("r")).collect()
    assert [(r["r"]["rule"], r["r"]["verdict"]) if r["r"] else (None, None) for r in found] == [ruled(h, p, rules) for h, p in cases]


def test_model_does_not_depend_on_how_rows_are_dealt(spark):
    made = made_urls(spark, 600)
    assert urls.train(made.repartition(7), trees=2) == urls.train(made.coalesce(1), trees=2)


def test_held_out_urls(spark, model):
    held = made_urls(spark, 2000, first=10**6).withColumnRenamed("id", "page_id")
    found = urls.judge(held, [], model).join(held, "page_id")
    right = found.where((F.col("verdict") == "block") == (F.col("blocked") == 1)).count()
    assert right >= 0.95 * 2000
    by_hand = {
        "https://www.dailyherald.com/sports/2021/04/12": "allow", "https://en.wikipedia.org/wiki/Entropy": "allow", "http://blog.someone.net/en/4": "allow", "https://docs.python.org/3/": "allow", "https://m.therin.example.org/es/33?page=2&ref=x": "allow",
        "http://super-casino-bonus.info/win": "block", "https://www.cheap-viagra24.com/en/1": "block", "http://203.14.7.201/login": "block", "http://a8f7d6e5c4b3.com/x9d8f7s6d5f4/q": "block",
    }
    table = spark.createDataFrame([(i, u) for i, u in enumerate(by_hand)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(table, [], model).collect()} == dict(enumerate(by_hand.values()))


def test_one_kind_of_label(spark):
    made = made_urls(spark, 40)
    for y, verdict in ((0, "allow"), (1, "block")):
        found = urls.judge(made.withColumnRenamed("id", "page_id"), [], urls.train(made.where(F.col("blocked") == y)))
        assert {r["verdict"] for r in found.collect()} == {verdict}
    assert urls.judge(made.withColumnRenamed("id", "page_id"), [], urls.train(made.limit(0))).count() == 40
