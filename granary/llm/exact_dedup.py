"""Exact deduplication by a Golomb-coded fingerprint exchange.

Partitions send the sorted 64-bit fingerprints of their texts, each once and Golomb-coded, to the
owners of fingerprint ranges, with a bitmap of those that several of their own texts have; owners
answer each with a bitmap of the fingerprints that occur more than once anywhere; only the rows so
marked ship their text, and equality is decided on the bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import bounded_join, chunks, fresh, give_back, lean, spread
from granary.session import cut

#: Characters that the comparison ignores: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Fingerprints that one owner holds at most on average, and that a message part holds at most.
OWNER_ROWS, PART_ROWS = 4_000_000, 200_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending uint64 values -> (parameter k, code): gaps as unary quotients by 2^k, then k-bit remainders."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = min(63, max(0, int(math.log2(max(1.0, float(values[-1]) / n * math.log(2))))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = np.empty((n, k), np.uint8)
    for b in range(k):
        rest[:, b] = (gaps >> np.uint64(k - 1 - b)) & np.uint64(1)
    head = np.packbits(unary).tobytes()
    return k, len(head).to_bytes(8, "big") + head + np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    size = int.from_bytes(code[:8], "big")
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, 8))
    stops = np.flatnonzero(unary == 0)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, -1, 8 + size))[: n * k].reshape(n, k)
        low = np.zeros(n, np.uint64)
        for b in range(k):
            low = (low << np.uint64(1)) | rest[:, b].astype(np.uint64)
        gaps |= low
    return np.cumsum(gaps, dtype=np.uint64)


_SENT = pa.schema([("n_chars", pa.int64()), ("digest", pa.binary()), ("part", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary()), ("again", pa.binary())])
_SENT_DDL = "n_chars long, digest binary, part long, owner long, n int, k int, code binary, again binary"


def _sender(bits: int, kind: pa.DataType):
    """kind: the type of ids. Emits one row per text (n: its fingerprint's place in its message; no k) and, for each owner, a message.

    A message has each fingerprint of the part once, and a bitmap of those that several of its texts have.
    """

    schema = pa.schema([pa.field("doc_id", kind), *_SENT])

    def part_of(held, part):
        ids, sizes, digests = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        raw = np.frombuffer(digests.buffers()[1], np.uint8)[: 32 * len(digests)].reshape(-1, 32)
        every = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64)
        fp, row, times = np.unique(every, return_inverse=True, return_counts=True)
        owner = (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(fp)) - cuts[np.searchsorted(cuts, np.arange(len(fp)), side="right") - 1]
        n = len(ids)
        yield pa.RecordBatch.from_arrays([ids, sizes, digests.cast(pa.binary()), pa.array(np.full(n, part)), pa.array(owner[row]), pa.array(place[row].astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
        out = {c: [] for c in schema.names}
        for a, b in zip(cuts, [*cuts[1:], len(fp)], strict=True):
            base = np.uint64(owner[a]) << np.uint64(64 - bits) if bits else np.uint64(0)
            k, code = golomb_encode(fp[a:b] - base)
            for c, v in zip(schema.names, (None, None, None, part, int(owner[a]), b - a, k, code, np.packbits(times[a:b] > 1).tobytes()), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    def send(batches):
        held, rows, part = [], 0, TaskContext.get().partitionId() << 20
        for batch in chunks(batches, "text"):
            texts = batch.column(1).to_pylist()
            digests = [hashlib.sha256((text or "").encode().translate(None, BLANKS.encode())).digest() for text in texts]
            held.append((batch.column(0), pa.array([len(text or "") for text in texts], pa.int64()), pa.array(digests, pa.binary(32))))
            rows += len(texts)
            if rows >= PART_ROWS:
                yield from part_of(held, part)
                held, rows, part = [], 0, part + 1
        if held:
            yield from part_of(held, part)

    return send


_ANSWER_DDL = "part long, owner long, bitmap binary"


def _answer(pdf):
    """One owner's messages -> for each the bitmap of fingerprints that occur more than once among them all."""
    import pandas as pd

    got = [golomb_decode(n, k, code) for n, k, code in zip(pdf["n"], pdf["k"], pdf["code"], strict=True)]
    again = [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for n, x in zip(pdf["n"], pdf["again"], strict=True)]
    values, counts = np.unique(np.concatenate(got), return_counts=True)
    more = values[counts > 1]
    marks = [np.packbits(np.isin(x, more) | y).tobytes() for x, y in zip(got, again, strict=True)]
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bitmap": marks})


def _marked(batches):
    """Bitmaps -> the places of their ones."""
    for batch in batches:
        for part, owner, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(np.full(len(at), owner)), pa.array(at.astype(np.int32))], names=["part", "owner", "n"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), n_chars.

    Texts are equal when identical after deleting BLANKS. Of equal texts the row with the most code
    points stays, then the smallest id (of any type that has an order); null ids come last. A null text counts as empty, and empty
    texts equal each other. Of rows repeated with the same id and length exactly one is kept. Other
    columns are ignored, so their names can't clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.count()
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows / OWNER_ROWS)
    bits = max(0, math.ceil(math.log2(lanes))) if rows else 0
    narrow = lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    sent = cut(narrow.mapInArrow(give_back(_sender(bits, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, {_SENT_DDL}"))
    each = sent.filter("k is null").select("doc_id", "n_chars", F.lower(F.hex("digest")).alias("text_sha256"), "part", "owner", F.col("n").alias("place"), F.monotonically_increasing_id().alias("row"))
    answers = sent.filter("k is not null").select("part", "owner", "n", "k", "code", "again").groupBy("owner").applyInPandas(_answer, _ANSWER_DDL)
    marked = answers.mapInArrow(give_back(_marked), "part long, owner long, place int")
    suspects = cut(each.join(marked, ["part", "owner", "place"], "left_semi").select("doc_id").distinct())

    # The marked rows' texts, compared byte for byte.
    ids = suspects.select(F.col("doc_id").alias("_id"))
    texts = bounded_join(narrow, ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    norm = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.translate(F.coalesce("text", F.lit("")), BLANKS, "").alias("norm"))
    groups = (
        norm.groupBy("norm")
        .agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"))
        .filter("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"))
    )
    res = each.join(groups, "text_sha256", "left").withColumn("alone", F.col("group_size").isNull())
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    res = cut(res.withColumn("mine", F.when(~F.col("alone") & best, F.col("row"))))
    chosen = spread(res.filter("mine is not null").groupBy("text_sha256").agg(F.min("mine").alias("chosen")))
    return res.join(chosen, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("alone") | F.coalesce(F.col("mine") == F.col("chosen"), F.lit(False))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay.

    Where an id stands in several rows, the kept row is told from the others by its text's hash and
    length, and of rows alike in all columns one stays.
    """
    key, sha, size, its_sha, its_size = fresh(docs, "_id", "_sha", "_n", "_s", "_c")
    kept = cut(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "text_sha256", "n_chars"))
    shared = kept.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n"), F.max(F.when(F.col("kept"), 1).otherwise(0)).alias("any"))
    same = F.col(id_col).eqNullSafe(F.col(key))
    out = bounded_join(docs, shared.filter("n = 1 and any = 1").select(key), same, "left_semi")
    several = shared.filter("n > 1 and any = 1").select(key)
    if several.isEmpty():
        return out
    body = F.coalesce(F.col(text_col), F.lit(""))
    rest = bounded_join(docs, several, same, "left_semi")
    rest = rest.withColumns({sha: F.sha2(F.translate(body, BLANKS, ""), 256), size: F.length(body).cast("long")})
    keep = kept.filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(its_sha), F.col("n_chars").alias(its_size))
    rest = rest.join(keep, same & (F.col(sha) == F.col(its_sha)) & (F.col(size) == F.col(its_size)), "left_semi")
    return out.unionByName(rest.dropDuplicates([id_col, sha, size]).drop(sha, size))
