"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text is lower-cased, each character but letters and marks becomes a space, and its character bigrams and
trigrams (but those whose last two characters are spaces) are hashed into ``DIMS`` counters.  Weights are log counts times inverse document frequency,
scaled to length one.  Each language has several centroids from spherical k-means; the nearest by
cosine gives the language, its cosine the score.  A text is rejected if its distance from that centroid is
beyond what the centroid's own training texts show, with slack for short texts.

Fitting uses at most ``SAMPLE`` labelled texts of each label, chosen by hashed id and text; over ``LANGUAGES`` labels are an error; predicting reads whole texts only.  Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected; ties go to the language first in order; without any labelled text all is ``und``; an empty
table gives no rows; repeated rows are predicted alike.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts per language that a fit may use.
SAMPLE = 400
#: All languages together: the sample per language shrinks beyond ten languages.
SAMPLE_ALL = 4000
#: Labels that a fit can learn: all of them, so that the sample has a text of each.  More are an error, as the model goes to every task.
LANGUAGES = SAMPLE_ALL
DIMS = 4096
CENTROIDS = 4
#: Part of the low end of the training texts' cosines that a text has to reach.
REACH = 0.4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: itself if it is a letter or mark, else a space; and whether it is a letter."""
    table, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    kind = {c: unicodedata.category(chr(c))[0] for c in range(0x110000) if not 0xD800 <= c < 0xE000}
    keep = [c for c, k in kind.items() if k in "LM"]
    table[keep] = keep
    letter[[c for c in keep if kind[c] == "L"]] = True
    return table, letter


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts of the whole text and its number of letters."""
    total = np.zeros(DIMS, np.int64)
    letters = 0
    if not text:
        return total, 0
    low = text.lower()
    for at in range(0, len(low), 1 << 16):
        # Two characters of the block before make its last n-grams whole.
        block = low[max(0, at - 2) : at + (1 << 16)]
        table, letter = _letters()
        codes = table[np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")]
        letters += int(letter[codes[2:] if at else codes].sum())
        if not at:
            codes = np.concatenate((np.array([32, 32], np.uint32), codes))
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        two = (b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        three = (two ^ a * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        spaced = (b == 32) & (c == 32)
        shift = np.uint32(32 - (DIMS.bit_length() - 1))
        total += np.bincount((two >> shift)[~spaced], minlength=DIMS)
        total += np.bincount((three >> shift)[~spaced], minlength=DIMS)
    return total, letters


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def predict(self, tf: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each row of counts."""
        n = len(letters)
        if not len(self.languages):
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        cosines = _unit(np.log1p(tf).astype(np.float32) * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(n), best].astype(float), 0.0, 1.0)
        # Few letters make few n-grams: the distance that is still accepted grows as texts get shorter.
        slack = np.minimum(1.0, letters / 400.0)
        distance = 1.0 - score
        rejected = (letters == 0) | (distance > 1.0 - slack * (1.0 - self.reach[best]))
        languages = [UNKNOWN if k == 0 else self.languages[self.owner[b]] for b, k in zip(best, letters)]
        return languages, np.where(letters == 0, 0.0, score), rejected


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; first centres: the mean's nearest, then always the farthest from those chosen."""
    k = min(k, len(x))
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < k:
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(k)]))
    return centres, (x @ centres.T).argmax(axis=1)


def fit(rows: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS, dims: int = DIMS) -> Model:
    """A model from (language, counts) of labelled texts."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros(0, int), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(0))
    tf = np.stack([x for _, x in rows]).astype(np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(tf) * idf)
    names = np.array([languages.index(lang) for lang, _ in rows])
    owner, centres, reach = [], [], []
    for i in range(len(languages)):
        own = x[names == i]
        found, _ = _clusters(own, centroids)
        cosine = (own @ found.T).max(axis=1)
        for j in range(len(found)):
            owner.append(i)
            centres.append(found[j])
            # A cosine of less than two fifths of what nearly all of the language's own texts reach is too far away.
            reach.append(1 - REACH * float(np.quantile(cosine, 0.02)))
    return Model(languages, np.array(owner), np.stack(centres).astype(np.float32), idf, np.array(reach))


def _vectors(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(1)]
            tf = [x.astype("<u4").tobytes() for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tf, pa.binary()), pa.array([n for _, n in found], pa.int64())], ["lang", "mark", "tf", "letters"])

    return rows.select("lang", "text", "mark").mapInArrow(run, "lang string, mark long, tf binary, letters long")


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> Model:
    """Fit on at most ``sample`` labelled texts per language (``sample_all`` in all) of the rows for which ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # Labels are counted over all rows; only so many are then read that about the sample comes back.
    counted = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn: join or leave out labels first")
    if not sizes:
        return fit([])
    sample = max(1, min(sample, sample_all // len(sizes)))
    # One row a label that is learned: a table of bounded size.
    bounds = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 1.1 * sample / n) * (1 << 30))) for lang, n in sorted(sizes.items())], "lang string, bound long")
    # Marks are of id and text, so that rows of one id are drawn each for itself.
    text = F.col(text_col).cast("string")
    drawn = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("mark"))
    some = drawn.join(F.broadcast(bounds), "lang").where(F.pmod("mark", F.lit(1 << 30)) < F.col("bound"))
    # Those with the least marks stay, in each task first: what comes back is bounded and the same however rows are dealt.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    taken = _vectors(some).where("letters > 0").withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "nth", "tf").collect()
    return fit([(r["lang"], np.frombuffer(r["tf"], "<u4")) for r in sorted(taken, key=lambda r: (r["lang"], r["nth"]))])


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with lang_pred, score and rejected added, under a prefix if given; columns of these names are replaced."""
    added = [prefix + c for c in ("lang_pred", "score", "rejected")]
    carried = [c for c in docs.columns if c not in added]
    at = carried.index(text_col)
    schema = docs.select(*carried).schema
    out = schema.add(added[0], "string").add(added[1], "double").add(added[2], "boolean")

    def run(batches):
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(at)]
            letters = np.array([n for _, n in found], np.int64)
            names, score, rejected = model.predict(np.stack([x for x, _ in found]) if found else np.zeros((0, DIMS)), letters)
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *added])

    return docs.select(*carried).mapInArrow(run, out)
