"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves.
Tier two: other pre-tokens are merged by rank, with a heap of candidate pairs over linked bytes.
The vocabulary (a rank file of bounded size, read once by the driver) travels in the task closure.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import KEPT, chunks, lean

#: Pre-tokens longer than this are not memoised; the older half of the memo goes when the newer half has this many entries.
MEMO_LENGTH, MEMO_ENTRIES = 64, 300_000


class PerfectHash:
    """Minimal perfect hash of byte strings, in levels of bit arrays.

    At each level the keys that have a slot to themselves take it; the others go on to the next. A
    key's index is the number of taken slots before its own. Strings outside the set get an
    arbitrary index or none, so callers compare the key stored there.
    """

    def __init__(self, keys: list[bytes], load: float = 2.0):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        left = np.array([self.digest(k) for k in keys], np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("repeated keys")
        base, seed = 0, 0
        while len(left):
            seed += 1
            size = max(8, int(len(left) * load))
            slot = self._slots(left, seed, size)
            count = np.bincount(slot, minlength=size)
            index = np.where(count == 1, base + np.cumsum(count == 1) - 1, -1)
            self.levels.append((seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, size, index.astype(np.int32).tolist()))
            base += int((count == 1).sum())
            left = left[count[slot] != 1]
        self.size = base

    @staticmethod
    def digest(key: bytes) -> int:
        """The process's own 64-bit hash: a table is made and used in one process."""
        return hash(key) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def _slots(h: np.ndarray, seed: int, size: int) -> np.ndarray:
        x = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def index(self, key: bytes) -> int:
        h = self.digest(key)
        for seed, size, index in self.levels:
            if (at := index[((h ^ seed) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % size]) >= 0:
                return at
        return -1


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for token, rank in ranks.items():
            at = self.hash.index(token)
            self.keys[at], self.ids[at] = token, rank
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([-1 if x is None else len(x) for x in self.bytes_of], np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.maximum(self.sizes, 0))])
        self.data = np.frombuffer(b"".join(x or b"" for x in self.bytes_of), np.uint8)
        self.said = [str(i) for i in range(top)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: bytes) -> int | None:
        at = self.hash.index(piece)
        return self.ids[at] if at >= 0 and self.keys[at] == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token: the pair of lowest rank, leftmost first, until none is left."""
        n, rank_of, pop, push = len(piece), self.ranks.get, heapq.heappop, heapq.heappush
        ends = list(range(1, n + 1))  # the part that starts at i is piece[i:ends[i]]; 0 once it is gone
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = pop(heap)
            mid = ends[i]
            if not mid or mid >= n or mid >= end or ends[mid] != end:
                continue  # one of its parts has changed
            ends[i], ends[mid] = end, 0
            if end < n:
                before[end] = i
                if (r := rank_of(piece[i : ends[end]])) is not None:
                    push(heap, (r, i, ends[end]))
            if (j := before[i]) >= 0 and (r := rank_of(piece[j:end])) is not None:
                push(heap, (r, j, end))
        ranks = self.ranks
        return tuple([ranks[piece[i:end]] for i, end in enumerate(ends) if end])

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            raw = text.encode()
            one = self.whole(raw)
            ids = (one,) if one is not None else self.merge(raw)
        if len(text) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older = dict(self.memo)
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, fresh = self.memo.get, self.piece
        return list(chain.from_iterable([known(p) or fresh(p) for p in self.split(text)]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts end to end and their n+1 offsets -> bytes end to end and their offsets."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or self.sizes[ids].min() < 0):
            raise ValueError("an id that is not in the vocabulary")
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.data[at], ends[offsets]


_MADE: dict[tuple[str, str], ByteBpe] = {}
KEPT.append(_MADE)


def tokenizer(content: bytes, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file's content, made once in each Python worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteBpe(parse_ranks(content), pattern)
    return _MADE[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(t: ByteBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, their ends from 0)."""
    flat, ends = [], [0]
    for text in texts.to_pylist():
        flat += t.encode(text) if text else []
        ends.append(len(flat))
    return np.array(flat, np.int32), np.array(ends, np.int32)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every whole text by the ranks, each match of the pattern separately, no special tokens.

    A null or empty text has no ids. Repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches):
        t = tokenizer(ranks, pattern)
        for batch in chunks(batches, "text", 1 << 20):
            ids, ends = _encoded(t, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` and decoded binary. Null or empty ids give no bytes; an unknown id is an error."""
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + ", decoded binary"

    def run(batches):
        t = tokenizer(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(part.num_columns - 1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                data, ends = t.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], raw], names=[*keep, "decoded"])

    return encoded.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256, and the ids where they are asked for.

    Texts are encoded, and the ids decoded again, in one pass of a worker, which sends digests.
    """

    def run(batches):
        t = tokenizer(ranks, pattern)
        for batch in chunks(batches, "text", 1 << 20):
            flat, ends, said = [], [0], []
            for text in batch.column(1).to_pylist():
                ids = t.encode(text) if text else []
                flat += ids
                ends.append(len(flat))
                said.append(hashlib.sha256(" ".join(map(t.said.__getitem__, ids)).encode()).hexdigest())
            ids, ends = np.array(flat, np.int32), np.array(ends, np.int32)
            data, at = t.decode(ids.astype(np.int64), ends.astype(np.int64))
            back = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            out = [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(said, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}"
    return lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
