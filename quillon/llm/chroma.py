"""Audio fingerprints from pitch classes, and their alignment.

A recording's short-time spectra are folded into twelve pitch classes.  Sums over rectangles of that
picture, taken from its integral image, make 16 filter values per frame; each is quantised to two bits
of Gray code, and a frame's 32 bits are packed into one integer.

A copy seldom starts where a frame of the original does, so queries are fingerprinted from ``PHASES``
starts within one hop.  Two frames ``GAP`` apart, far enough for their bits to differ by chance, are a landmark.  Queries look up each of their landmarks,
and those that come of it by turning over any of its ``WEAK`` weakest bits, the ones whose filter values lie nearest
to a quantisation bound.  Landmarks in common vote for offsets, and each offset that
has a vote is judged by the share of bits that differ over the whole overlap.

A link is an offset, from one of the query's starts, at which both share a landmark, overlap by ``OVERLAP`` frames
and differ in at most ``ERRORS`` of the bits; of a pair's the one with least bit error is given.  Unrelated
recordings differ in over a quarter of the bits at any such offset.  Landmarks with silence count for nothing; those
that many recordings have are dealt out in parts.  Equal fingerprints are one class, searched once.

Defined cases: null, empty and unreadable media, and those shorter than a filter, have no
frames, form no class with others and link to none; repeated rows are one class; an empty table gives no rows.
Ids are whole numbers.
"""

from __future__ import annotations

import io
import struct
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, passing, width

RATE = 4000
FRAME, HOP = 1024, 256
#: Frequencies that fold into pitch classes.
LOW, HIGH = 60.0, 1900.0
#: Filters: kind, first pitch class, pitch classes, frames. Kinds 0: all; 1: lower and upper half; 2: first and second half of the time; 3: both, crossed.
WIDE = 16
FILTERS = [(kind, first, bands, frames) for kind, bands, frames in ((1, 4, 8), (2, 4, 16), (3, 6, 12), (0, 3, 6)) for first in (0, 2, 4, 6)]
STEP = 0.25
PHASES = 4
WEAK = 3
#: Frames between the two of a landmark.
GAP = 4
ERRORS = 0.1
#: Least frames that an overlap must have.
OVERLAP = 40
#: Classes with one landmark that are joined in one part.
PART = 4096
#: Frames of a query's candidates that are judged in one part.
JUDGED = 8192


def _pcm(media: bytes) -> tuple[np.ndarray, int, int] | None:
    """Samples from -1 to 1, channels and rate of WAV data: whole numbers of 8 to 32 bits, or floating ones of 32 or 64."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE and len(body) >= 26:  # the extensible form names the kind further on
                form = (int.from_bytes(body[24:26], "little"), *form[1:])
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            body = body[: len(body) // max(1, bits // 8) * max(1, bits // 8)]
            if kind == 3 and bits in (32, 64):
                data = np.nan_to_num(np.frombuffer(body, f"<f{bits // 8}").astype(np.float32))
            elif kind == 1 and bits == 8:
                data = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif kind == 1 and bits in (16, 32):
                data = (np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
            elif kind == 1 and bits == 24:
                parts = np.frombuffer(body, np.uint8).reshape(-1, 3)
                whole = np.zeros((len(parts), 4), np.uint8)
                whole[:, 1:] = parts  # the upper three bytes of four
                data = (whole.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
            else:
                return None
            return (data, channels, rate) if channels and rate else None
        at += 8 + size + size % 2
    return None


def samples(media: bytes | None, rate: int = RATE) -> np.ndarray:
    """Mono samples of WAV data at the rate wanted; none if it can't be read."""
    found = _pcm(media) if media else None
    if not found:
        return np.zeros(0, np.float32)
    data, channels, own = found
    data = data[: len(data) // channels * channels].reshape(-1, channels).mean(axis=1)
    if own != rate and len(data):
        data = np.interp(np.arange(0, len(data), own / rate), np.arange(len(data)), data).astype(np.float32)
    return data


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Spectrum bin -> pitch class."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), 12), np.float32)
    inside = (hz >= LOW) & (hz <= HIGH)
    fold[inside, np.round(12 * np.log2(hz[inside] / 440)).astype(int) % 12] = 1
    return fold


def chroma(data: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, scaled to length one."""
    if len(data) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(data, FRAME)[::HOP]
    found = []
    for at in range(0, len(frames), 1024):  # long recordings in bounded blocks
        power = np.abs(np.fft.rfft(frames[at : at + 1024] * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
        found.append(power @ _fold())
    energy = np.concatenate(found)
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


def codes(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One packed 32-bit integer per frame for which all filters lie inside, and how far each bit is from turning over."""
    n = len(picture) - WIDE + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros((0, 32))
    integral = np.zeros((len(picture) + 1, 13))
    integral[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, b0, b1):
        return integral[t + t1, b1] - integral[t + t0, b1] - integral[t + t1, b0] + integral[t + t0, b0]

    packed, firm = np.zeros(n, np.uint32), np.zeros((n, 32))
    for k, (kind, first, bands, frames) in enumerate(FILTERS):
        mid, half, end = first + bands // 2, frames // 2, first + bands
        if kind == 0:
            a, b = area(0, frames, first, end), area(0, frames, 0, 12) - area(0, frames, first, end)
        elif kind == 1:
            a, b = area(0, frames, mid, end), area(0, frames, first, mid)
        elif kind == 2:
            a, b = area(half, frames, first, end), area(0, half, first, end)
        else:
            a = area(0, half, mid, end) + area(half, frames, first, mid)
            b = area(0, half, first, mid) + area(half, frames, mid, end)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        packed |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)
        firm[:, 2 * k], firm[:, 2 * k + 1] = np.abs(np.abs(value) - STEP), np.abs(value)
    return packed, firm


@lru_cache(maxsize=1)
def _silence() -> int:
    """The code of frames without sound."""
    return int(codes(np.zeros((WIDE, 12)))[0][0])


def fingerprint(media: bytes | None) -> np.ndarray:
    return codes(chroma(samples(media)))[0]


def starts(media: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes from each of the starts within a hop, and the weak bits of each landmark as a mask."""
    data, found = samples(media), []
    for phase in range(PHASES):
        own, firm = codes(chroma(data[phase * HOP // PHASES :]))
        # A landmark's first code stands in its upper half.
        both = np.concatenate([firm[GAP:], firm[:-GAP]], axis=1)
        weakest = np.argsort(both, axis=1, kind="stable")[:, :WEAK].astype(np.uint64)
        found.append((own, (np.uint64(1) << weakest).sum(axis=1, dtype=np.uint64)))
    return found


def landmarks(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each two frames ``GAP`` apart, neither of them silent, and where they stand."""
    keys = own[:-GAP].astype(np.uint64) << np.uint64(32) | own[GAP:]
    sound = own != _silence()
    at = np.flatnonzero(sound[:-GAP] & sound[GAP:])
    return keys[at], at


def probes(own: np.ndarray, weak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to look up, each landmark's with every choice of its weak bits turned over, and where they stand."""
    keys, at = landmarks(own)
    rest, bits = weak[at].copy(), []
    for _ in range(WEAK):
        bits.append(rest & (~rest + np.uint64(1)))
        rest ^= bits[-1]
    turned = [keys]
    for bit in bits:
        turned += [k ^ bit for k in turned]
    return np.concatenate(turned), np.tile(at, len(turned))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits, and frames, where b starts ``offset`` frames before a's start."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi - lo < 1:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).mean()) / 32, hi - lo


CODES, MASKS = pa.list_(pa.int32()), pa.list_(pa.int64())


def fingerprints(recordings: DataFrame, id_col: str, media_col: str, queries) -> DataFrame:
    """id, is_query, codes (signed integers) of every row; for queries also the codes (starts) and weak bits of all starts."""

    def run(batches):
        for batch in batches:
            own, more, weak = [], [], []
            for media, asked in zip(batch.column(1), batch.column(2).to_pylist()):
                found = starts(media.as_py()) if asked else [(fingerprint(media.as_py()), None)]
                own.append(found[0][0].view("<i4"))
                more.append([x.view("<i4") for x, _ in found] if asked else None)
                weak.append([x.view("<i8") for _, x in found] if asked else None)
            columns = [batch.column(0), batch.column(2), pa.array(own, CODES), pa.array(more, pa.list_(CODES)), pa.array(weak, pa.list_(MASKS))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "is_query", "codes", "starts", "weak"])

    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    rows = rows.withColumn("is_query", F.coalesce(queries(F.col("id")), F.lit(False)))
    return rows.mapInArrow(run, "id long, is_query boolean, codes array<int>, starts array<array<int>>, weak array<array<long>>")


def _arrays(scalar, kind: str) -> list[np.ndarray]:
    return [x.values.to_numpy().view(kind) for x in scalar]


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """``name`` and key: distinct landmarks of each class, or of each query those to look up."""

    def run(batches):
        for batch in batches:
            owner, found = batch.column(0).to_numpy(), []
            for i in range(batch.num_rows):
                if batch.num_columns == 2:
                    found.append(np.unique(landmarks(batch.column(1)[i].values.to_numpy().view("<u4"))[0]))
                else:
                    each = zip(_arrays(batch.column(1)[i], "<u4"), _arrays(batch.column(2)[i], "<u8"))
                    found.append(np.unique(np.concatenate([probes(own, weak)[0] for own, weak in each])))
            owners = np.repeat(owner, [len(x) for x in found])
            keys = np.concatenate(found).astype("<u8").view("<i8") if found else np.zeros(0, np.int64)
            for at in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(owners[at : at + 65536]), pa.array(keys[at : at + 65536])], [name, "key"])

    return rows.mapInArrow(run, f"{name} long, key long")


def shared_offsets(own: np.ndarray, weak: np.ndarray, other: np.ndarray) -> np.ndarray:
    """All offsets, ascending, at which a landmark stands in both."""
    if min(len(own), len(other)) <= GAP:
        return np.zeros(0, np.int64)
    (keys, at), (known, where) = probes(own, weak), landmarks(other)
    order = np.argsort(known, kind="stable")
    lo, hi = (np.searchsorted(known[order], keys, side) for side in ("left", "right"))
    hit = np.zeros(len(own) + len(other), bool)
    for i in np.flatnonzero(hi > lo).tolist():
        hit[where[order[lo[i] : hi[i]]] - at[i] + len(own)] = True
    return np.flatnonzero(hit) - len(own)


def alignment(query: list[tuple[np.ndarray, np.ndarray]], other: np.ndarray) -> tuple[float, int, int, int] | None:
    """Least (bit error, start, offset, frames) of all offsets at which a landmark stands in both; none if no offset makes a link."""
    tries = ((error, n, int(o), frames) for n, (own, weak) in enumerate(query) for o in shared_offsets(own, weak, other) for error, frames in [bit_error(own, other, o)])
    return min((x for x in tries if x[0] <= ERRORS and x[3] >= OVERLAP), default=None)


LINK = "query_class long, link_class long, start int, offset int, bit_error double, frames int"


def _judged(batches):
    """Rows sorted by query: first the query itself (its starts and weak bits), then each candidate's codes."""
    asked, query = None, []
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            owner, other, own, weak, codes_ = (batch.column(k)[i] for k in range(5))
            if not other.is_valid:
                asked, query = owner.as_py(), list(zip(_arrays(own, "<u4"), _arrays(weak, "<u8")))
                continue
            if owner.as_py() != asked:
                raise ValueError("candidates without their query")
            found = alignment(query, codes_.values.to_numpy().view("<u4"))
            if found:
                rows.append((asked, other.as_py(), found[1], found[2], found[0], found[3]))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_class", "link_class", "start", "offset", "bit_error", "frames"])


def links(classes: DataFrame) -> DataFrame:
    """One row per link of a class with starts to another class: ``LINK``; input has class_id, codes, starts, weak."""
    asked = classes.where(F.col("starts").isNotNull())
    marks = _keys(classes.select("class_id", "codes"), "class_id")
    sought = _keys(asked.select("class_id", "starts", "weak"), "query_class")
    # Landmarks that many classes have are dealt out in parts, each of which meets all queries with them.
    hot = durable(marks.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > PART).select("key", F.ceil(F.col("often") / PART).alias("parts")), "hot")
    on = ["key"]
    if not hot.isEmpty():
        on = ["key", "part"]
        sought = sought.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long"))))).drop("parts")
        marks = marks.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("class_id"), "parts"), F.lit(0).cast("long"))).drop("parts")
    found = durable(sought.join(marks, on).where("query_class <> class_id").select("query_class", "class_id").distinct(), "candidates")
    # A query's candidates follow it through a task, those of one with very many in parts; only their codes move.
    # Parts are of equal work, not of equal numbers: long recordings take longer.
    frames = found.join(classes.select("class_id", F.size("codes").alias("n")), "class_id")
    dealt = frames.groupBy("query_class").agg(F.ceil(F.sum("n") / JUDGED).alias("parts"))
    query = asked.select(F.col("class_id").alias("query_class"), "starts", "weak").join(dealt, "query_class").select("query_class", F.lit(None).cast("long").alias("class_id"), "starts", "weak", F.lit(None).cast("array<int>").alias("codes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    nothing = [F.lit(None).cast(query.schema[c].dataType).alias(c) for c in ("starts", "weak")]
    others = found.join(dealt, "query_class").join(classes.select("class_id", "codes"), "class_id").select("query_class", "class_id", *nothing, "codes", F.pmod(F.xxhash64("class_id"), "parts").alias("part"))
    ordered = query.unionByName(others).repartition(width(classes.sparkSession), "query_class", "part").sortWithinPartitions("query_class", "part", F.col("class_id").asc_nulls_first())
    return ordered.drop("part").mapInArrow(_judged, LINK)


def search(recordings: DataFrame, queries, id_col: str, media_col: str) -> DataFrame:
    """Every recording with its class, and every link of the classes that were searched for.

    id, n_frames, class_id (least id with its fingerprint), class_size, is_query, and n_links for queries.
    ``queries`` says which rows are searched for, against all rows.  A class's links stand at the row of its least id,
    one row each (link_class, start, offset, bit_error, frames); other rows have nulls there.
    """
    spark = recordings.sparkSession
    with passing(spark) as keep:
        rows = keep(durable(fingerprints(recordings, id_col, media_col, queries), "codes"))
        sound = rows.where(F.size("codes") > 0)
        first = F.min_by(F.struct("starts", "weak"), F.when(F.col("is_query"), F.col("id")))
        classes = durable(sound.groupBy("codes").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), first.alias("q")).select("codes", "class_id", "class_size", "q.starts", "q.weak"), "classes")
        linked = keep(durable(links(classes), "links"))
        n_links = linked.groupBy(F.col("query_class").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))
        known = keep(durable(classes.select("codes", "class_id", "class_size").join(n_links, "class_id", "left"), "known"))
    own = rows.select("id", "is_query", "codes").join(known, "codes", "left").select(
        "id",
        F.size("codes").alias("n_frames"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "is_query",
        F.when(F.col("is_query"), F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
    at = F.when(F.col("id") == F.col("class_id"), F.col("class_id"))
    return own.withColumn("query_class", at).join(linked, "query_class", "left").drop("query_class")


def sounded(vectors: DataFrame, id_col: str, vector_col: str, note: float = 0.125) -> DataFrame:
    """Recordings for tables that have none: each coordinate of a vector becomes a note, as 16-bit WAV data."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([melody(v.as_py(), note) for v in batch.column(1)], pa.binary())], ["id", "media"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, media binary")


def excerpts(vectors: DataFrame, id_col: str, vector_col: str, start: float = 1.37, noise: float = 0.02) -> DataFrame:
    """The same recordings from ``start`` seconds on, off the frame grid and with noise: what a search is to find again."""

    def run(batches):
        for batch in batches:
            made = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = samples(melody(v.as_py()))[int(start * RATE) :]
                random = np.random.default_rng(abs(i or 0))
                made.append(written(data + noise * random.standard_normal(len(data))) if len(data) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "media"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, media binary")


def written(data: np.ndarray) -> bytes:
    """Samples from -1 to 1 as 16-bit WAV data."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(data, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def melody(vector: list[float] | None, note: float = 0.125) -> bytes | None:
    """WAV data whose notes' pitches follow the vector's coordinates relative to its own spread."""
    if not vector:
        return None
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector]))
    steps = np.clip(np.round(12 + 8 * (x - x.mean()) / (x.std() + 1e-12)), 0, 36)
    hz = np.repeat(110 * 2 ** (steps / 12), int(RATE * note))
    wave_form = np.sin(2 * np.pi * np.cumsum(hz) / RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((wave_form * 20000).astype("<i2").tobytes())
    return out.getvalue()
