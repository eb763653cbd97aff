"""Benchmark decontamination with DataFrame functions only.

The windows of the test items are a hash set, broadcast where a count proves it small; the windows of
every training text are hashed in place and probe it; hits are verified word by word, and the spans
or the documents that hold them removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_join, fresh, keyed_join, spread
from granary.session import cut

#: What stands between words: every ASCII character but 0-9 and a-z (A-Z are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an optimised plan repeats an expression inside a lambda for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP), "")


def _of_words(w: Column) -> Column:
    """The hash of each word: a window is hashed by those of its words, so that each word is read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _hashes(each: Column, n: Column, size: int) -> Column:
    """The hash of each run of `size` words (each: the hashes of the words), in order."""
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(each, i, F.lit(size))))


def grams(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, size, gram, items, set: each distinct window of the items' words, the items it stands in, and a key of their set.

    An item of fewer words than a window, but not none, is one window. Null texts have no words; a
    null item_id is in no list of items, though its windows count.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    size = F.least("n", F.lit(window))
    starts = w.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("i"))
    cells = starts.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("gram"))
    out = cells.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return out.select(F.xxhash64(_of_words(F.col("gram"))).alias("h"), "size", F.array_join("gram", " ").alias("gram"), "items", F.md5(F.to_json("items")).alias("set"))


def _key(text: Column) -> Column:
    """The result depends on the text alone, so its hash is the key of partial results."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def verified_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """One row per distinct text with a hit: k, spans (array of start, size; starts from 1, sorted), items.

    Only hashes and sizes of windows, of fixed width, may be broadcast. What the windows say, and whose
    they are, is fetched for the hits alone; windows with the same items share one list.
    """
    tests = cut(grams(items, window))
    sizes = sorted((r[0] for r in tests.select("size").distinct().collect()), reverse=True)  # at most `window` values
    if not sizes:
        return docs.select(_key(F.col(text_col)).alias("k"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"), F.array().cast("array<string>").alias("items")).limit(0)
    hashed = let(_of_words(words(F.col(text_col))), lambda each: F.struct(F.size(each).alias("n"), F.concat(*[_hashes(each, F.size(each), s) for s in sizes]).alias("hs")))
    base = docs.select(_key(F.col(text_col)).alias("k"), hashed.alias("x"))
    probes = base.select("k", F.col("x.n").alias("n"), F.posexplode("x.hs").alias("at", "h"))
    hits = bounded_join(probes, cut(tests.select("h", "size").distinct()), "h", "inner")
    # The place in the joined array -> start among the windows of its size.
    before, start = F.lit(0), F.lit(None).cast("int")
    for s in sizes:
        start = F.when(F.col("size") == s, F.col("at") - before + 1).otherwise(start)
        before = before + F.greatest(F.col("n") - (s - 1), F.lit(0))
    one = F.struct(start.cast("int").alias("start"), F.col("size").cast("int").alias("size"), "h")
    # A hash shared by windows of two sizes can give a start outside its size's range; verification drops it.
    found = cut(hits.groupBy("k").agg(F.collect_set(one).alias("found")))
    texts = docs.select(_key(F.col(text_col)).alias("_k"), F.col(text_col).alias("_text"))
    # Copies of one text agree, so any of them may stand for all.
    pairs = keyed_join(texts, found, "_k", "k").dropDuplicates(["k"])

    def said(w):
        at = F.filter("found", lambda x: x["start"] >= 1)
        return F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), x["h"].alias("h"), F.array_join(F.slice(w, x["start"], x["size"]), " ").alias("gram")))

    claims = pairs.select("k", F.explode(let(words(F.col("_text")), said)).alias("x")).select("k", "x.*")
    real = claims.join(tests.select("h", "size", "gram", "set"), ["h", "size", "gram"])
    spans = F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans")
    real = cut(real.groupBy("k").agg(spans, F.collect_set("set").alias("sets")))
    lists = tests.select("set", "items").dropDuplicates(["set"])
    whose = real.select("k", F.explode("sets").alias("set")).join(lists, "set").select("k", F.explode("items").alias("item"))
    whose = whose.groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = real.join(whose, F.col("k") == F.col("_k"), "left")
    return cut(out.select("k", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def covered(spans: Column) -> Column:
    """Number of words that sorted spans cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, x):
        end = F.greatest(acc["end"], x["start"] + x["size"] - 1)
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["start"] - 1)).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"]).cast("long")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans (start and size in words, from 1), contaminated: a row for each of docs.

    Null texts have no words. Repeated rows give repeated rows; an empty benchmark hits nothing.
    """
    hits = verified_hits(docs, items, window, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(text_col)).alias("_k"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(spread(hits), F.col("_k") == F.col("k"), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"), F.col("spans").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words, and what follows each up to the next word, taken out of their texts.

    All columns stay, whatever their names.
    """
    key, spans, own = fresh(docs, "_k", "_spans", "_own")
    hits = verified_hits(docs, items, window, text_col).withColumnsRenamed({"k": key, "spans": spans}).drop("items")
    if remove == "documents":
        return bounded_join(docs, hits.select(key), _key(F.col(text_col)) == F.col(key), "left_anti")
    if remove != "spans":
        raise ValueError(remove)
    joined = docs.withColumn(own, _key(F.col(text_col))).join(spread(hits), F.col(own) == F.col(key), "left")
    text, gap = F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)^{gap}+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{gap}*"), 0)

    def clean(lead):
        return F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i - lead + 1 >= s["start"]) & (i - lead + 1 < s["start"] + s["size"])))

    left = let(F.when(text.rlike(rf"^{gap}"), 1).otherwise(0), clean)
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), F.array_join(left, "")).otherwise(text)).drop(key, spans, own)
