"""An interpolated modified Kneser-Ney model of word pairs, of whole texts, kept in shards from end to end.

In back-off form a text's log probability is a plain sum of one value for each of its words and word
pairs that trusted text has: the value of a word is what it adds to an unknown one and its back-off
weight as a context, that of a pair is what it adds to these. So the n-grams of a block of texts are
dealt to the shards of the model, each shard adds up what it holds for every text of the block, and
the sums are added by text.

What is shuffled is several times the texts, so both halves of the work go slice by slice: counts by
the hash of the first word, texts by a hash of the row. A slice's shuffle files are freed when its
table is written, and the disk in use at once is that of one slice.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import _WORD, chunks, drop, flat, give_back, kept, mix, prefix_hash, spread
from granary.session import cut, freed, shared_dir

#: Classes of bytes: blanks part tokens, and a token is a run of one other class (of words or of signs).
_CLASS = np.where(_WORD, 1, 2).astype(np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
START, END = np.uint64(0x51A7B3C90D2E4F61), np.uint64(0x2F8D6E1B7C5A4093)
#: Tokens and texts of a block at most: it is counted at once (a longer text stands alone).
BLOCK_TOKENS, BLOCK_TEXTS = 250_000, 30_000
#: Slices in which pairs are counted, and in which texts are scored.
COUNT_SLICES, TEXT_SLICES = 4, 8
#: n-grams that a message of the model holds at most.
PACK_ROWS = 500_000
DEALT = "shard int, kind int, part long, keys binary, vals binary, rows binary"
SUMS = "part long, kind int, vals binary, rows binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens in order, number of tokens before each text)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & (kind > 0))
    ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    p, inv = prefix_hash(data)
    return mix((p[ends] - p[starts]) * inv[starts]), np.searchsorted(starts, offsets, side="left")


def padded(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with a start and an end around each text, and the text of each."""
    n = np.diff(docs)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(at[-1], START, np.uint64)
    out[np.repeat(at[:-1] + 1 - docs[:-1], n) + np.arange(len(hashes))] = hashes
    out[at[1:] - 1] = END
    return out, np.repeat(np.arange(len(n)), n + 2)


def pair(a, b):
    """The key of a word pair: not that of any word, nor of the pair turned round."""
    return mix(a ^ ((b << np.uint64(17)) | (b >> np.uint64(47))))


def _blocks(batches):
    """(hashes, docs, batch slices) of so many texts at once."""
    held, total, texts = [], 0, 0
    for batch in chunks(batches, "_text"):
        hashes, docs = tokens(*flat(batch.column(0)))
        if held and (total + len(hashes) > BLOCK_TOKENS or texts + batch.num_rows > BLOCK_TEXTS):
            yield _joined(held)
            held, total, texts = [], 0, 0
        held.append((hashes, docs, batch.slice(0).drop_columns(["_text"])))
        total, texts = total + len(hashes), texts + batch.num_rows
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.concatenate([np.diff(d) for _, d, _ in held])
    return np.concatenate([h for h, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), [b for _, _, b in held]


def _count(slices: int, own: int):
    """Pairs whose first word is of slice `own`, counted block by block."""

    def run(batches):
        for hashes, docs, _ in _blocks(batches):
            w, owner = padded(hashes, docs)
            on = np.flatnonzero((owner[1:] == owner[:-1]) & ((w[:-1] >> np.uint64(20)) % np.uint64(slices) == own))
            a, b = w[:-1][on], w[1:][on]
            key = pair(a, b)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            for s in range(0, len(first), 1 << 16):
                f = first[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x[f].view(np.int64)) for x in (a, b)] + [pa.array(n[s : s + (1 << 16)])], names=["a", "b", "n"])

    return run


class Model(NamedTuple):
    """The log probability of an unknown word, the number of shards, and the folder of the tables (packed: what each n-gram adds, by shard)."""

    unknown: float
    shards: int
    folder: str


def _off(d):
    n = F.col("n")
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def model(texts: DataFrame, discounts, shard_rows: int) -> Model:
    """The model of column _text; discounts gives the three of a table with counts c.

    Each shuffle partition has a shard, or several where that would be more than shard_rows n-grams.
    """
    spark = texts.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/words-{uuid.uuid4().hex}"
    with freed(spark):
        slices = []
        for s in range(COUNT_SLICES):
            rows = texts.mapInArrow(give_back(_count(COUNT_SLICES, s)), "a long, b long, n long")
            slices.append(kept(rows.groupBy("a", "b").agg(F.sum("n").alias("n")), f"{folder}/pairs/{s}"))
        every = slices[0]
        for x in slices[1:]:
            every = every.unionByName(x)
        t1 = kept(every.groupBy("b").agg(F.count("*").alias("n")).withColumnRenamed("b", "w"), f"{folder}/words")
        total, m1, m2, m3, size = t1.agg(F.sum("n"), *(F.count_if(F.expr(x)) for x in ("n = 1", "n = 2", "n >= 3")), F.count("*")).first()
        if not size:
            return Model(0.0, 1, folder)
        d = discounts(t1.select(F.col("n").alias("c")))
        base = (d[0] * m1 + d[1] * m2 + d[2] * m3) / total / (size + 1)
        n = F.col("n")
        p1 = t1.select("w", (F.greatest(n - _off(d), F.lit(0.0)) / total + base).alias("p1"))
        d = discounts(every.select(F.col("n").alias("c")))
        # total is the number of different pairs
        shards = max(_width(spark), math.ceil((total + 2 * size) / shard_rows))
        pack = lambda df, name: df.select("x", "y", F.col("v").cast("float").alias("v")).mapInArrow(give_back(_pack(shards)), DEALT).write.option("compression", "zstd").parquet(f"{folder}/packed/{name}")
        no = F.lit(None).cast("long")
        pack(p1.select(F.col("w").alias("x"), no.alias("y"), (F.log("p1") - math.log(base)).alias("v")), "words")
        for s, part in enumerate(slices):
            context = part.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("total"), F.sum(_off(d)).alias("off"))
            context = kept(context.select("w", "total", (F.col("off") / F.col("total")).alias("bow")), f"{folder}/contexts/{s}")
            pack(context.select(F.col("w").alias("x"), no.alias("y"), F.log("bow").alias("v")), f"contexts-{s}")
            shares = part.join(spread(context.withColumnRenamed("w", "a")), "a").select("a", "b", (F.greatest(n - _off(d), F.lit(0.0)) / F.col("total")).alias("own"), "bow")
            pairs = shares.join(p1.withColumnRenamed("w", "b"), "b")
            v = F.log(F.col("own") + F.col("bow") * F.col("p1")) - F.log("bow") - F.log("p1")
            pack(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), v.alias("v")), f"pairs-{s}")
            drop(spark, f"{folder}/pairs/{s}")
    return Model(math.log(base), shards, folder)


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)).astype(np.int64) * n) >> 32


def _dealt(shards, kind, part, keys, vals, rows):
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([kind] * len(shards), pa.int32()), pa.array([part] * len(shards), pa.int64()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary()), pa.array(rows, pa.binary())], names=["shard", "kind", "part", "keys", "vals", "rows"])


def _pack(n: int):
    """Rows (x, y or null, v) -> messages of kind 0: the keys of words (no y) or pairs, and their values."""

    def run(batches):
        held, rows = [], 0

        def out():
            keys, vals = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            order = np.argsort(keys)
            keys, vals = keys[order], vals[order]
            s, at = np.unique(_shard(keys, n), return_index=True)
            ends = np.append(at[1:], len(keys))
            return _dealt(s, 0, 0, [keys[i:j].tobytes() for i, j in zip(at, ends)], [vals[i:j].tobytes() for i, j in zip(at, ends)], [None] * len(s))

        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i) for i in (0, 1))
                keys = x.to_numpy().view(np.uint64)
                if not y.null_count:
                    keys = pair(keys, y.to_numpy().view(np.uint64))
                held.append((keys, batch.column(2).to_numpy()))
                rows += batch.num_rows
            if rows > PACK_ROWS:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return run


def _deal(n: int):
    """The n-grams of each block, sorted, with the texts that have them, to the shards."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for hashes, docs, info in _blocks(batches):
            w, owner = padded(hashes, docs)
            inside = owner[1:] == owner[:-1]
            key = np.concatenate([w, pair(w[:-1], w[1:])[inside]])
            row = np.concatenate([owner, owner[1:][inside]]).astype(np.uint16)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(first, len(key))).astype(np.uint32)
            s, at = np.unique(_shard(key[first], n), return_index=True)
            ends = np.append(at[1:], len(first))
            edge = np.append(first, len(key))
            yield _dealt(s, 1, part, [key[first[x:y]].tobytes() for x, y in zip(at, ends)], [times[x:y].tobytes() for x, y in zip(at, ends)], [row[edge[x] : edge[y]].tobytes() for x, y in zip(at, ends)])
            # what the texts are goes along with them, once
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(info).append_column("_tokens", pa.array(np.diff(docs)))
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield _dealt([int((part >> 32) % n)], 2, part, [None], [None], [sink.getvalue().to_pybytes()])
            part += 1

    return run


def _sum(batches):
    """Whole shards, the model's messages first -> what each adds to the texts of each block, and the texts' own columns as kind 0."""
    shard, held, keys, vals = None, [], None, None
    for batch in batches:
        out = [[], [], [], []]
        for r in batch.to_pylist():
            if r["shard"] != shard:
                shard, held, keys, vals = r["shard"], [], np.zeros(0, np.uint64), np.zeros(0)
            if r["kind"] == 0:
                held.append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["vals"], np.float32)))
                continue
            if held:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                vals, held = np.bincount(at, np.concatenate([v for _, v in held]).astype(np.float64), len(keys)), []
            if r["kind"] == 2:
                add = (r["part"], 0, None, r["rows"])
            elif len(keys):
                asked, times, rows = (np.frombuffer(r[x], t) for x, t in (("keys", np.uint64), ("vals", np.uint32), ("rows", np.uint16)))
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                value = np.repeat(np.where(keys[at] == asked, vals[at], 0.0), times)
                sums = np.bincount(rows, value)
                found = np.flatnonzero(sums)
                add = (r["part"], 1, sums[found].tobytes(), found.astype(np.uint16).tobytes())
            else:
                continue
            for col, v in zip(out, add, strict=True):
                col.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["part", "kind", "vals", "rows"])


def _add(unknown: float):
    """Whole blocks, their texts' columns first -> a row for each text."""

    def run(batches):
        table, lp = None, None

        def out():
            tokens_ = table.column("_tokens").to_numpy()
            yield from table.append_column("_lp", pa.array(lp + (tokens_ + 1) * unknown)).combine_chunks().to_batches()

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if table is not None:
                        yield from out()
                    table = pa.ipc.open_stream(r["rows"]).read_all()
                    lp = np.zeros(table.num_rows)
                else:
                    lp[np.frombuffer(r["rows"], np.uint16)] += np.frombuffer(r["vals"], np.float64)
        if table is not None:
            yield from out()

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but _text (its first), with _tokens, the number of tokens, and _lp, the log probability.

    docs is read once a slice, and rows are told by their place in a task: it should be a table, or cut.
    """
    spark = docs.sparkSession
    fields = [f for f in docs.schema.fields if f.name != "_text"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    width = _width(spark)
    own = F.pmod(F.xxhash64(*(f.name for f in fields)), F.lit(TEXT_SLICES))
    out = []
    with freed(spark):
        for s in range(TEXT_SLICES):
            dealt = docs.filter(own == s).mapInArrow(give_back(_deal(model.shards)), DEALT)
            if model.unknown:
                dealt = dealt.unionByName(spark.read.schema(DEALT).parquet(f"{model.folder}/packed/*"))
            sums = dealt.repartitionById(model.shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(give_back(_sum), SUMS)
            rows = sums.repartition(width, "part").sortWithinPartitions("part", "kind").mapInArrow(give_back(_add(model.unknown)), f"{columns}, _tokens long, _lp double")
            out.append(kept(rows, f"{model.folder}/scored/{s}"))
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        every = cut(every)
    drop(spark, model.folder)
    return every
