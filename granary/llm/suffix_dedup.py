"""Removal of byte strings that occur more than once, found with suffix arrays.

A string of `length` bytes can only recur where an anchor recurs: the least of the hashes of its
substrings of `length // ANCHOR` bytes, a choice that depends on the string alone. Texts that share an
anchor meet in one shard, each with the context that the anchor answers for; equal contexts are one.
Each shard's suffix array is induced, and permuted common prefixes of at least `length` mark the
repeats. Shards of many contexts are split by the bytes that all their windows share, so that none
grows with a common passage.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BASE, bounded_join, chunks, drop, flat, give_back, kept, keyed_join, lean, mix, prefix_hash, spread
from granary.llm.ngram_join import _groups
from granary.llm.sais import pack, permuted_common_prefixes, suffix_arrays
from granary.session import cut, freed, shared_dir

LENGTH = 400
#: An anchor is this part of a string: 2 (half) cost the least on the check tables; shorter ones recur more often by themselves.
ANCHOR = 2
#: Contexts in a shard at most; larger shards are split by windows that start within 16 bytes of each other, then within 1.
SHARD = 48
SPLITS = (16, 1)
#: Symbols of the lanes whose suffix arrays are induced at once.
CELLS = 800_000
#: Stretches of distances to the anchor by which contexts are told that can't share a window.
STRETCHES = 8
_POSITION = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(hash, context hash, text, first, last, place) of the runs of windows with one anchor.

    Windows start at first..last of the text; place is the anchor's start. All in bytes from the text's start.
    """
    k = max(1, length // ANCHOR)
    w = length - k + 1
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    p, inv = prefix_hash(data)
    h = mix((p[k:] - p[:-k]) * inv[: len(data) - k + 1])
    starts = len(h) - w + 1
    found = np.empty(starts, np.int64)
    step = 1 << 22  # positions fit into the low bits
    for a in range(0, starts, step):
        part = h[a : a + step + w - 1]
        key = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        fill = np.full(-len(key) % w, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks = np.concatenate([key, fill]).reshape(-1, w)
        up = np.minimum.accumulate(blocks, axis=1).ravel()
        down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = min(step, starts - a)
        found[a : a + m] = (np.minimum(down[:m], up[w - 1 : w - 1 + m]) & _POSITION).astype(np.int64) + a
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:starts]
    valid = np.arange(starts) + length <= offsets[1:][text]
    new = np.ones(starts, bool)
    new[1:] = (found[1:] != found[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    place, text = found[first], text[first]
    context = mix((p[last + length] - p[first]) * inv[first]) ^ mix((place - first).astype(np.uint64) + np.uint64(1))
    base = offsets[:-1][text]
    return h[place], context, text, first - base, last - base, place - base


def _anchored(length):
    """Rows of (k, text) -> the anchors of each different text of the task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in chunks(batches, "text"):
            new = []
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if not new:
                continue
            batch = batch.take(pa.array(new))
            h, c, text, first, last, place = anchors(*flat(batch.column(1)), length)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array((place - first).astype(np.int32))], names=["shard", "context", "k", "first", "last", "lead"])

    return run


def _contexts(length):
    """(text, [(shard, context, first, last, lead)]) -> rows with the bytes of each context."""

    def run(batches):
        for batch in chunks(batches, "text"):
            out = [[], [], [], []]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for x in wanted:
                    for col, v in zip(out, (x["shard"], x["context"], x["lead"], raw[x["first"] : x["last"] + length]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["shard", "context", "lead", "bytes"])

    return run


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _split(length, grain):
    """Contexts -> smaller contexts, one for each stretch of `grain` windows by their distance to the anchor; its shard also names the bytes that all of these share."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for shard, context, lead, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                top = len(raw) - length  # the last window's start; its distance to the anchor is lead - top
                for j in range((lead - top) // grain, lead // grain + 1):
                    a, b = max(0, lead - (j + 1) * grain + 1), min(top, lead - j * grain)
                    if a > b:
                        continue
                    core = raw[lead - j * grain : lead - (j + 1) * grain + 1 + length]
                    part, name = raw[a : b + length], j.to_bytes(8, "little", signed=True)
                    for col, v in zip(out, (_number(shard.to_bytes(8, "little", signed=True), name, core), _number((lead - a).to_bytes(8, "little", signed=True), part), lead - a, part, shard, context), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["shard", "context", "lead", "bytes", "from_shard", "from_context"])

    return run


def repeated_starts(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each group of contexts, for each context, the starts of `length` bytes that also start elsewhere in the group."""
    lanes, owner = [], []
    used = np.zeros(256, bool)
    for group in groups:
        used[np.frombuffer(b"".join(group), np.uint8)] = True
    rank = np.cumsum(used).astype(np.int32)
    for group in groups:
        # 0 stands between contexts; bytes are numbered from 1 in their order. A common prefix stops at a 0.
        lane = np.concatenate([np.append(rank[np.frombuffer(x, np.uint8)], np.int32(0)) for x in group])
        owner.append(np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])]))
        lanes.append(lane)
    t = pack(lanes)
    pad = len(t) - 1 - np.array([len(x) for x in lanes])
    stops = t <= pad + 1  # the end, the fillers and what stands between contexts
    sa = suffix_arrays(t)
    plcp, phi = permuted_common_prefixes(t, sa, stops)
    hit = plcp >= length
    at, lane = np.nonzero(hit)
    hit[phi[at, lane], lane] = True
    return [[np.flatnonzero(hit[a : b - 1, g]) for a, b in zip(edge[:-1], edge[1:], strict=True)] for g, edge in enumerate(owner)]


_RANGES = "shard long, context long, ranges array<struct<low:int,high:int>>"


def _ranges(starts: np.ndarray, lead: int) -> list[dict]:
    """Starts -> stretches of distances to the anchor."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    low, high = starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]
    return [{"low": int(lead - b), "high": int(lead - a)} for a, b in zip(low, high, strict=True)]


def suspects(raw: list[bytes], lead: np.ndarray, shard: np.ndarray, length: int) -> np.ndarray:
    """True for each context that shares a long stretch around its anchor with another one of its shard.

    Equal windows lie alike to their anchors. All windows whose distance to the anchor is in one of
    STRETCHES stretches hold the same bytes around it, so a context that shares none of these byte
    strings (by their hashes) has no window in common with another and needs no suffix array.
    """
    k = max(1, length // ANCHOR)
    span = length - k
    step = max(1, -(-span // STRETCHES))
    size = np.array([len(x) for x in raw], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    p, inv = prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
    keys, owner = [], []
    for j, left in enumerate(range(0, span + 1, step)):
        a, b = lead - left, lead + k + span - left - step + 1
        on = np.flatnonzero((a >= 0) & (b <= size) & (a < b))
        start = base[on] + a[on]
        name = mix(shard[on].astype(np.int64).view(np.uint64) + np.uint64((j + 1) * BASE % (1 << 64)))
        keys.append(mix((p[base[on] + b[on]] - p[start]) * inv[start]) ^ name)
        owner.append(on)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.zeros(len(raw), bool)
    out[owner[times[at] > 1]] = True
    return out


def _suffix_arrays(length):
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def solve(jobs):
        """jobs of like size: (shard, contexts, leads, bytes)."""
        got = repeated_starts([j[3] for j in jobs], length)
        out = [(j[0], c, _ranges(s, lead)) for j, starts in zip(jobs, got, strict=True) for c, lead, s in zip(j[1], j[2], starts, strict=True) if len(s)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=["shard", "context", "ranges"])

    def batched(jobs, last):
        """Jobs sorted by size, as many at once as CELLS allow; what is left over waits unless it is the last."""
        jobs.sort(key=lambda j: j[4])
        while jobs:
            widest = jobs[-1][4] + 1
            n = max(1, CELLS // widest)
            if n > len(jobs) and not last:
                return
            take, jobs[-n:] = jobs[-n:], []
            # those much shorter than the widest go with others
            short = [j for j in take if j[4] * 2 < widest] if not last or len(take) > 64 else []
            jobs[:0] = short
            yield [j for j in take if j not in short] if short else take
            jobs.sort(key=lambda j: j[4])

    def run(batches):
        waiting, size = [], 0
        for table, starts in _groups(batches, ("shard",)):
            shard, context, lead, raw = (table.column(c).to_pylist() for c in ("shard", "context", "lead", "bytes"))
            shared = suspects(raw, np.array(lead, np.int64), np.array(shard, np.int64), length)
            for s, e in zip(starts, [*starts[1:], len(shard)], strict=True):
                left = s + np.flatnonzero(shared[s:e])
                if len(left) < 2:
                    continue
                own = [raw[i] for i in left]
                total = sum(map(len, own)) + len(own)
                waiting.append((shard[s], [context[i] for i in left], [lead[i] for i in left], own, total))
                size += total
            if size > 10 * CELLS:
                for jobs in batched(waiting, False):
                    yield solve(jobs)
                size = sum(j[4] for j in waiting)
        for jobs in batched(waiting, True):
            yield solve(jobs)

    return run


def _resolve(ctx: DataFrame, rows: DataFrame, length: int, splits, parts: int) -> DataFrame:
    """shard, context, ranges of the windows that recur: ctx has each distinct context of shards with several (bytes), rows (shard, context, n, m, lead, size) each distinct context."""
    whole = F.array(F.struct((F.col("lead") - F.col("size") + length).cast("int").alias("low"), F.col("lead").cast("int").alias("high")))
    out = rows.filter("n > 1").select("shard", "context", whole.alias("ranges"))
    shards = ctx.filter((F.col("m") > 1) & (F.col("m") <= SHARD)).select("shard", "context", "lead", "bytes")
    out = out.unionByName(shards.repartition(parts, "shard").sortWithinPartitions("shard", "context").mapInArrow(give_back(_suffix_arrays(length)), _RANGES))
    large = ctx.filter(F.col("m") > SHARD).select("shard", "context", "lead", "bytes")
    if not splits or large.isEmpty():
        return out
    small = cut(large.mapInArrow(give_back(_split(length, splits[0])), "shard long, context long, lead int, bytes binary, from_shard long, from_context long"))
    each = small.groupBy("shard", "context").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    sizes = small.select("shard", "context").distinct().groupBy("shard").agg(F.count("*").alias("m"))
    each = cut(each.join(spread(sizes), "shard").filter("n > 1 or m > 1"))
    found = _resolve(each, each.withColumn("size", F.length("bytes")), length, splits[1:], parts)
    back = small.select("shard", "context", "from_shard", "from_context").join(found, ["shard", "context"])
    return out.unionByName(back.select(F.col("from_shard").alias("shard"), F.col("from_context").alias("context"), "ranges"))


def repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """k (hash of a text), starts (array of first and last start of windows that recur): one row for each text with one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_dir(spark).rstrip('/')}/repeats-{uuid.uuid4().hex}"
    texts = lean(docs).filter(F.octet_length(text_col) >= length).select(F.unhex(F.md5(text_col)).alias("k"), F.col(text_col).alias("text"))
    with freed(spark):
        # All of a text with a copy recurs; of the copies in one task the anchors of one do.
        copied = texts.groupBy("k").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("size")).filter("n > 1")
        copied = kept(copied.select("k", F.array(F.struct(F.lit(0).alias("first"), (F.col("size") - length).alias("last"))).alias("s")), f"{folder}/copied")
        every = kept(texts.mapInArrow(give_back(_anchored(length)), "shard long, context long, k binary, first int, last int, lead int"), f"{folder}/anchors")
        twice = every.groupBy("shard").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("shard").alias("_shard"))
        met = kept(every.join(spread(twice), F.col("shard") == F.col("_shard")).drop("_shard"), f"{folder}/met")
        drop(spark, f"{folder}/anchors")
        rows = met.groupBy("shard", "context").agg(F.count("*").alias("n"), F.min(F.struct("k", "first", "last", "lead")).alias("one"))
        sizes = met.select("shard", "context").distinct().groupBy("shard").agg(F.count("*").alias("m"))
        rows = cut(rows.join(spread(sizes), "shard").select("shard", "context", "n", "m", "one.*").withColumn("size", F.col("last") - F.col("first") + length))
        wanted = rows.filter("m > 1").groupBy("k").agg(F.collect_list(F.struct("shard", "context", "first", "last", "lead")).alias("wanted"))
        sources = keyed_join(texts.withColumnRenamed("k", "_k"), cut(wanted), "_k", "k")
        ctx = sources.select("text", "wanted").mapInArrow(give_back(_contexts(length)), "shard long, context long, lead int, bytes binary")
        # Copies of a text send the same contexts.
        ctx = cut(ctx.dropDuplicates(["shard", "context"]).join(spread(rows.filter("m > 1").select("shard", "m").distinct()), "shard"))
        found = cut(_resolve(ctx, rows, length, SPLITS, parts))
        ranges = spread(found.groupBy("shard", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
        place = F.col("first") + F.col("lead")
        spans = F.transform("ranges", lambda r: F.struct((place - r["high"]).alias("first"), (place - r["low"]).alias("last")))
        hits = met.join(ranges, ["shard", "context"]).select("k", "first", spans.alias("s")).groupBy("k", "first").agg(F.first("s").alias("s")).select("k", "s")
        out = cut(hits.unionByName(copied).groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("starts")))
    drop(spark, folder)
    return out


def _removed(length):
    def run(batches):
        for batch in chunks(batches, "text"):
            out = [[], [], [], []]
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, spans = (text or "").encode(), []
                for x in starts or []:
                    a, b = x["first"], x["last"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for col, v in zip(out, (len(raw), sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], b"".join(kept)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, stop in bytes), kept (the bytes left): a row for each row of docs.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    text or another; all strings are judged on the input. Null texts are empty. Rows repeated with one
    id and text are copies of each other. Contexts are told apart by two 64-bit hashes, one of the
    anchor and one of the whole; repeats inside a shard are compared byte by byte.
    """
    found = repeats(docs, length, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_k"))
    hit = keyed_join(rows, found, "_k", "k").select("doc_id", "text", "starts")
    rest = bounded_join(rows, found.select("k"), F.col("_k") == F.col("k"), "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("starts"))
    return hit.unionByName(rest).mapInArrow(give_back(_removed(length)), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
