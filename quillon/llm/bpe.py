"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are leaves of a segment tree; leaf i holds the rank of the pair that starts at
symbol i together with i, so the root is the leftmost of the lowest ranks.  A merge changes three
leaves, each renewed in logarithmic time, until the root says that no pair can be merged.

``merge_one`` does this for one pre-token of any length.  ``merge_many`` does the same for many short
pre-tokens at once: the trees are rows of one array and each round makes every row's next merge.
Ids of a space-separated piece are remembered, within a bound, as pieces repeat in texts.

Defined cases: null text is the empty text, without ids; the vocabulary's special tokens are found in
texts as the tokenizers library finds them; ids outside the vocabulary decode to nothing; documents' ids are whole
numbers (text ids are cast, one that is no number is an error) and may be null; repeated rows give repeated rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from quillon.llm.tokens import GENERATION, SPACED, Memory, byte_letters

#: Rank of a pair that cannot be merged.
NEVER = np.int32(2**31 - 1)
#: Longest pre-token, in bytes, that is merged together with others.
TOGETHER = 64


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        if int(self.base) ** 2 >= 2**32 or len(pairs) * TOGETHER >= 2**31:
            raise ValueError("a vocabulary of this size needs wider keys")
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self.pair_rank = dict(zip(key.tolist(), range(len(key))))
        self.split = regex.compile(SPACED).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else (lambda s: [s])
        self.pieces = Memory(size=GENERATION)
        self.marks = {c: np.array([self.byte_id[ord(c)]], "<u4").tobytes() for c in ".,!?;:"}

    # --- merging -----------------------------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NEVER where there is none (a symbol of -1 is none)."""
        key = a.astype(np.uint32) * np.uint32(self.base) + b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NEVER)

    def merge_one(self, data: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        sym = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(sym)
        if n < 2:
            return sym
        never, base, rank_of = 1 << 62, self.base, self.pair_rank
        width = 1 << (n - 1).bit_length()
        tree = [never] * (2 * width)
        for i in range(n - 1):
            r = rank_of.get(sym[i] * base + sym[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def renew(i):
            j = after[i]
            r = rank_of.get(sym[i] * base + sym[j]) if j < n else None
            put(i, never if r is None else r * width + i)

        def put(i, value):
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while (top := tree[1]) < never:
            rank, i = divmod(top, width)
            j = after[i]
            sym[i], sym[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, never)
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return [s for s in sym if s >= 0]

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as little-endian 32-bit integers, in the order given."""
        found: list = [None] * len(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            found[i] = np.array(self.merge_one(tokens[i]), "<u4").tobytes()
        width = 2
        while width <= TOGETHER:
            rows = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else -1)))
            for at in range(0, len(rows), 16384):
                own = rows[at : at + 16384]
                for i, ids in zip(own.tolist(), self._rows([tokens[i] for i in own.tolist()], sizes[own], width)):
                    found[i] = ids
            width *= 2
        return found

    def _rows(self, tokens: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n = len(tokens)
        flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(n, width)
        # One more column on either side, of no symbol, for neighbours beyond the ends.
        sym = np.full((n, width + 2), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        sym[:, 1:-1][inside] = self.byte_id[flat[inside]]
        after = np.tile(np.minimum(np.arange(width + 2) + 1, width + 1).astype(np.int32), (n, 1))
        before = np.tile(np.maximum(np.arange(width + 2) - 1, 0).astype(np.int32), (n, 1))
        rank = self.ranks(sym[:, 1:-1], sym[:, 2:])
        tree = np.full((n, 2 * width), NEVER, np.int32)
        tree[:, width:] = np.where(rank < NEVER, rank * np.int32(width) + np.arange(width, dtype=np.int32), NEVER)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            i = at + 1
            j = after[live, i]
            sym[live, i] = self.made[rank]
            sym[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            before[live, k] = i
            b = before[live, i]
            left = np.where(b > 0, b, i)  # without a left neighbour its own leaf is renewed twice
            for where, value in (
                (j, NEVER),
                (i, self._leaf(sym[live, i], sym[live, k], i, width)),
                (left, self._leaf(sym[live, left], sym[live, after[live, left]], left, width)),
            ):
                node = where - 1 + width
                tree[live, node] = value
                while width > 1 and node[0] > 1:
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] < NEVER]
        ids = sym[:, 1:-1]
        kept = ids >= 0
        data, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _leaf(self, a, b, at, width):
        rank = self.ranks(a, b)
        return np.where(rank < NEVER, rank * np.int32(width) + at - 1, NEVER)

    # --- texts -------------------------------------------------------------------------------

    def _tokens(self, text: str) -> list:
        """Pre-tokens of a text as bytes; special tokens as their ids."""
        found = []
        for part in self.parts(text):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found.extend(t.encode() for t in self.split(part))
        return found

    def _resolve(self, texts: dict) -> dict:
        """Ids, as bytes, of each text given with the key that it is wanted under."""
        # A word, with or without the space before it, is one pre-token.
        cut = {key: [text.encode()] if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else self._tokens(text) for key, text in texts.items()}
        distinct = list({t for ts in cut.values() for t in ts if isinstance(t, bytes)})
        ids = dict(zip(distinct, self.merge_many(distinct)))
        one = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        return {key: b"".join(ids[t] if isinstance(t, bytes) else one[t] for t in ts) for key, ts in cut.items()}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [(t or "").split(" ") for t in texts]
        pieces = set().union(*(parts[1:] for parts in cut))
        # A word with one mark behind it is the word and the mark.
        marked = {p: p[:-1] for p in pieces if p[-1:] in self.marks and p[:-1].isalpha()}
        found = {p: self.pieces[p] for p in (pieces - marked.keys()).union(marked.values())}
        # A piece stands alone unless it is empty or has white space at an end; the first has no space before it.
        wanted = {p: " " + p for p, ids in found.items() if ids is None and p and not p[0].isspace() and not p[-1].isspace()}
        tied = {p for p, ids in found.items() if ids is None and p not in wanted}
        alone = []
        for n, parts in enumerate(cut):
            alone.append(not parts[0][-1:].isspace() and (len(parts) == 1 or parts[0] != "") and (not tied or tied.isdisjoint(parts[1:])))
            wanted[n] = parts[0] if alone[n] else texts[n]
        new = self._resolve(wanted)
        for p, ids in new.items():
            if isinstance(p, str):
                found[p] = ids
                if "\n" not in p:
                    self.pieces.put(p, ids)
        for p, word in marked.items():
            found[p] = found[word] + self.marks[p[-1]]
        return [np.frombuffer(new[n] + (b"".join(map(found.__getitem__, parts[1:])) if alone[n] else b""), "<u4") for n, parts in enumerate(cut)]

    def decode(self, ids) -> str:
        """Text of ids, special tokens included."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.asarray(ids).tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One per worker process and vocabulary."""
    return Bpe(path)


def digests(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text encoded and decoded again."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        codec = bpe(path)
        number = [str(i).encode() for i in range(codec.base + len(codec.special))]
        for batch in batches:
            found = codec.encode_batch(batch.column(1).to_pylist())
            sha = lambda data: hashlib.sha256(data).hexdigest()
            columns = [
                batch.column(0),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([sha(b",".join([number[i] for i in x.tolist()])) for x in found], pa.string()),
                pa.array([sha(codec.decode(x).encode()) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
