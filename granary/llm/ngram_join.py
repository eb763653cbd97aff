"""Similarity join on word shingles with Bayesian candidate pruning.

Texts with one set of shingles are one class. Classes that agree on a band of MinHash values are
candidates, and each pair is judged in the first band it agrees on: the MinHash values are compared
a few at a time, and a pair is dropped once the posterior probability that it reaches the threshold
falls below the tolerance. What is left is verified on the whole sets. Large bands are cut into
blocks, each two of which meet in one task, so no task sees an unbounded group; pairs stay inside the
tasks, which return for each class its number of links and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_join, chunks, flat, fresh, give_back, lean, shingles, words
from granary.llm.url_filter import components
from granary.session import cut

WORDS, THRESHOLD = 5, 0.8
#: 28 bands of 4 values: a pair at 0.8 misses all of them once in 2.6 million times; more similar pairs less often.
BANDS, ROWS = 28, 4
VALUES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Classes of one band that meet in a task at most, twice (a block against another).
BLOCK = 512


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of each set, uint32; all ones for an empty set."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes > 0)
    out = np.full((len(sizes), VALUES), 0xFFFFFFFF, np.uint32)
    if len(full):
        starts = offsets[:-1][full]
        for j, a in enumerate(_multipliers()):
            out[full, j] = np.minimum.reduceat((hashes * a) >> np.uint64(32), starts)
    return out


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Matches among `seen` values below which P(J >= threshold | matches) < tolerance, from a uniform prior."""
    for k in range(seen + 1):
        # J given k matches is Beta(k + 1, seen - k + 1); its tail is a binomial sum.
        tail = sum(math.comb(seen + 1, i) * threshold**i * (1 - threshold) ** (seen + 1 - i) for i in range(k + 1))
        if tail >= tolerance:
            return k
    return seen


def _sets(batches, k):
    """(batch, sorted distinct shingles of each row end to end, offsets) for bounded batches of (id, text)."""
    for batch in chunks(batches, "text"):
        h, at = shingles(*words(*flat(batch.column(1))), k)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield batch, h, np.searchsorted(owner, np.arange(batch.num_rows + 1))


def _class(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sign(k):
    def run(batches):
        for batch, h, at in _sets(batches, k):
            sig, n = signatures(h, at), np.diff(at)
            keys = [_class(h[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([s.tobytes() if m else None for s, m in zip(sig, n, strict=True)], pa.binary())], names=["doc_id", "n", "class", "sig"])

    return run


def _set_of(k):
    def run(batches):
        for _, h, at in _sets(batches, k):
            rows = [(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([_class(h[a:b]) for a, b in rows], pa.binary()), pa.array([h[a:b].tobytes() for a, b in rows], pa.binary())], names=["class", "set"])

    return run


def _bands(batches):
    for batch in batches:
        n = batch.num_rows
        raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
        for j in range(ROWS):
            key = (key ^ raw[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        flatkeys = pa.array(key.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), flatkeys)], names=["class", "keys"])


def _groups(batches, cols):
    """Arrow batches sorted by task -> lists of columns that hold whole tasks, several at once, and the tasks' starts."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ids = [table.column(c).to_numpy() for c in cols]
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for x in ids:
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0])


def _pairs_within(starts: np.ndarray, ends: np.ndarray, block: np.ndarray, most: int):
    """Chunks of (a, b) row pairs of all tasks; rows of a task are sorted by block, and where there are two only pairs across."""
    out_a, out_b, count = [], [], 0
    for s, e in zip(starts, ends, strict=True):
        m = e - s
        if m < 2:
            continue
        if block[s] != block[e - 1]:
            c = s + int(np.searchsorted(block[s:e], block[s], side="right"))
            a, b = np.repeat(np.arange(s, c), e - c), np.tile(np.arange(c, e), c - s)
        elif m == 2:
            a, b = np.array([s]), np.array([s + 1])
        else:
            i, j = np.triu_indices(m, 1)
            a, b = i + s, j + s
        out_a.append(a)
        out_b.append(b)
        count += len(a)
        if count >= most:
            yield np.concatenate(out_a), np.concatenate(out_b)
            out_a, out_b, count = [], [], 0
    if out_a:
        yield np.concatenate(out_a), np.concatenate(out_b)


_MEET = "key long, bi int, bj int, class binary, size long, n long, partners binary"


def _prune(threshold, tolerance):
    """Rows (key, bi, bj, blk, band, class, size, n, sig) of whole tasks -> the members of surviving pairs, each with its partners."""
    least = {m: least_matches(m, threshold, tolerance) for m in range(STEP, VALUES + 1, STEP)}

    def run(batches):
        for table, starts in _groups(batches, ("key", "bi", "bj")):
            n = table.num_rows
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(n, VALUES)
            size, block, band = (table.column(c).to_numpy() for c in ("n", "blk", "band"))
            classes = table.column("class").to_pylist()
            partners: dict[int, list[bytes]] = {}
            for a, b in _pairs_within(starts, np.append(starts[1:], n), block, 200_000):
                # sets whose sizes differ by more than the threshold allows can't reach it
                keep = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[keep], b[keep]
                hits = np.zeros(len(a), np.int32)
                for m in range(STEP, VALUES + 1, STEP):
                    hits = hits + (sig[a, m - STEP : m] == sig[b, m - STEP : m]).sum(axis=1)
                    keep = hits >= least[m]
                    a, b, hits = a[keep], b[keep], hits[keep]
                if len(a):  # judged here only if no earlier band agrees
                    same = (sig[a] == sig[b]).reshape(len(a), BANDS, ROWS).all(axis=2)
                    mine = same.argmax(axis=1) == band[a]
                    for x, y in zip(a[mine].tolist(), b[mine].tolist(), strict=True):
                        partners.setdefault(x, []).append(classes[y])
                        partners.setdefault(y, [])
            rows = np.array(sorted(partners), np.int64)
            if len(rows):
                part = table.select(["key", "bi", "bj", "class", "size", "n"]).take(pa.array(rows)).combine_chunks()
                lists = pa.array([b"".join(partners[r]) for r in rows.tolist()], pa.binary())
                yield from part.append_column("partners", lists).to_batches()

    return run


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a[i]] and sets[b[i]]."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    values, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = count[col] > 1
    row, col = row[keep], (np.cumsum(count > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[i:j], col[i:j] - c] = 1
        both += x @ x.T
    return both[a, b].astype(np.int64)


_LINKS = "class binary, links long, linked_classes long, parent binary"


def _verify(threshold):
    """Whole tasks of (key, bi, bj, class, size, n, partners, set) -> class, links (rows), linked_classes, parent."""

    def run(batches):
        for table, starts in _groups(batches, ("key", "bi", "bj")):
            classes, blobs = table.column("class").to_pylist(), table.column("partners").to_pylist()
            size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
            raw = table.column("set").to_pylist()
            links, count, parent = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64), {}
            for s, e in zip(starts, np.append(starts[1:], len(classes)), strict=True):
                place = {c: i for i, c in enumerate(classes[s:e])}
                sets = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
                pairs = [(i, place[blob[p : p + 16]]) for i, blob in enumerate(blobs[s:e]) for p in range(0, len(blob), 16)]
                a, b = np.array(pairs, np.int64).reshape(-1, 2).T
                both = _intersections(sets, a, b)
                union = n[s:e][a] + n[s:e][b] - both
                real = both >= threshold * union - 1e-9
                a, b = a[real], b[real]
                np.add.at(links, a + s, size[b + s])
                np.add.at(links, b + s, size[a + s])
                np.add.at(count, a + s, 1)
                np.add.at(count, b + s, 1)
                root = list(range(e - s))

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = find(x), find(y)
                    if p != q:  # the root that goes is linked to the root that stays: the same components
                        root[q] = p
                        parent[q + s] = classes[p + s]
            rows = np.flatnonzero((count > 0) | np.isin(np.arange(len(classes)), list(parent)))
            yield pa.RecordBatch.from_arrays([pa.array([classes[i] for i in rows], pa.binary()), pa.array(links[rows]), pa.array(count[rows]), pa.array([parent.get(i) for i in rows.tolist()], pa.binary())], names=["class", "links", "linked_classes", "parent"])

    return run


def similarity_join(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies: a row for each row of docs.

    Ids may be of any type that has an order. class_id is the smallest id among the texts that links join, directly or not; n_links is the
    number of other rows whose sets of k-word shingles have a Jaccard similarity of at least
    `threshold` with this row's, n_copies of which have the same set. Words are runs of 0-9, A-Z (in
    either case) and non-ASCII characters; a text of 1 to k-1 words is one shingle. A text without
    words, null included, has no links and is its own class. Repeated rows count as rows; other
    columns are ignored.
    """
    narrow = lean(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    signed = cut(narrow.mapInArrow(give_back(_sign(k)), f"doc_id {kind}, n long, class binary, sig binary"))
    classes = cut(signed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    banded = classes.select("class", "sig").mapInArrow(give_back(_bands), "class binary, keys array<long>").select("class", F.posexplode("keys").alias("band", "key"))
    full = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("key").alias("_key"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    meet = banded.join(full, F.col("key") == F.col("_key")).drop("_key")
    # A class goes to every task of its block: with itself and with each other block of its band.
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    meet = meet.withColumn("blk", own).select("class", "band", "key", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("class", "band", "key", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = meet.join(classes.select("class", "size", "n", "sig"), "class").repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "blk")
    left = cut(tasks.select("key", "bi", "bj", "blk", "band", "class", "size", "n", "sig").mapInArrow(give_back(_prune(threshold, tolerance)), _MEET))

    reps = classes.join(left.select("class").distinct(), "class", "left_semi").select(F.col("rep").alias("_rep"))
    texts = bounded_join(narrow, cut(reps.distinct()), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = texts.mapInArrow(give_back(_set_of(k)), "class binary, set binary").dropDuplicates(["class"])
    ready = left.join(sets, "class").repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    linked = cut(ready.select("key", "bi", "bj", "class", "size", "n", "partners", "set").mapInArrow(give_back(_verify(threshold)), _LINKS))

    counts = linked.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(linked.filter("parent is not null"), "class", "parent")
    grouped = classes.select("class", "rep", "size").join(roots.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    ids = grouped.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("rep").alias("class_id")).withColumnRenamed("root", "_root")
    known = cut(grouped.join(ids, F.coalesce("root", "class") == F.col("_root")).select(F.col("class").alias("_class"), "class_id", "size", F.coalesce("links", F.lit(0)).alias("links")))
    out = bounded_join(signed.select("doc_id", "class"), known, F.col("class") == F.col("_class"), "left")
    return out.select(
        "doc_id",
        F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one document of each class: that of the smallest id. All columns stay.

    Rows that share an id stay or go together, but of rows alike in id and text one stays.
    """
    (key,) = fresh(docs, "_id")
    rows = cut(similarity_join(docs, id_col=id_col, text_col=text_col, **kw).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")))
    on = F.col(id_col).eqNullSafe(F.col(key))
    once = bounded_join(docs, rows.filter("n = 1").select(key), on, "left_semi")
    more = rows.filter("n > 1").select(key)
    if more.isEmpty():
        return once
    return once.unionByName(bounded_join(docs, more, on, "left_semi").dropDuplicates([id_col, text_col]))
