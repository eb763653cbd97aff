"""Quality by an interpolated modified Kneser-Ney model trained on trusted text.

The unit is the word: granary.llm.word_model has the pairs of whole texts, counted in the trusted fit
fold and joined by shard to the n-grams of all documents. A text's perplexity is held against the
quantile of its language among trusted documents that the model has not seen.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import word_model
from granary.llm.common import bounded_join, fresh, lean
from granary.session import cut

#: The share of unseen trusted documents of a language that the threshold keeps.
QUANTILE = 0.99
#: So many trusted documents weigh as much in a language's threshold as the spread that all languages share.
PRIOR = 100
#: n-grams in one shard of the model at most on average.
SHARD_ROWS = 4_000_000


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, kept between 0 and the count where counts of counts are missing."""
    got = dict(table.filter("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (got.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say quality 1, and their fold: fit trains, the other calibrates. Null ids are not trusted."""
    ids = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1")
    return ids.select("_id", (F.crc32(F.col("_id").cast("string").cast("binary")) % 2 == 0).alias("_fit"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a token), threshold, kept: a row for each of docs.

    Null and empty texts have no perplexity and are not kept. The threshold is the language's own (a
    null lang is one too). Without unseen trusted text of a language there is none, and its texts that
    aren't empty are kept. Repeated rows give repeated rows.
    """
    good = cut(trusted(labels))
    narrow = lean(docs).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    fit = bounded_join(narrow.select("doc_id", "_text"), good.filter("_fit"), F.col("doc_id") == F.col("_id"), "left_semi").select("_text")
    model = word_model.model(fit, _discounts, SHARD_ROWS)
    size = F.octet_length(F.coalesce("_text", F.lit(""))).cast("long")
    lps = word_model.scores(narrow.select("_text", "doc_id", "lang", size.alias("n_bytes")), model)
    scored = lps.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("_lp") / (F.col("_tokens") + 1))).alias("perplexity"))

    unseen = bounded_join(scored.filter("n_bytes > 0"), good.filter("not _fit"), F.col("doc_id") == F.col("_id"), "left_semi")
    per = cut(_thresholds(unseen, quantile))
    out = bounded_join(scored, per, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", ((F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))


def _thresholds(unseen: DataFrame, quantile: float) -> DataFrame:
    """_lang, threshold: the quantile of the language's log perplexities, smoothed towards that of a normal distribution around the language's mean.

    Its deviation is that within all languages, so that one trusted document is enough for a threshold,
    and perplexities of different languages are never compared.
    """
    x, n = F.log("perplexity"), F.col("_n")
    per = cut(unseen.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx(x, F.lit(quantile), F.lit(10_000)).alias("_q"), F.avg(x).alias("_mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("_var"), F.count("*").alias("_n")))
    within = per.agg(F.sum(F.col("_var") * (n - 1)) / F.greatest(F.sum(n - 1), F.lit(1))).first()[0] or 0.0
    normal = F.col("_mean") + NormalDist().inv_cdf(quantile) * math.sqrt(within) * F.sqrt(1 + 1 / n)
    return per.select("_lang", F.exp((n * F.col("_q") + PRIOR * normal) / (n + PRIOR)).alias("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """docs without the rows that score() rejects; all columns stay.

    A row is looked up by its id and its length in bytes: rows that share an id but not a text may
    differ in length and are judged apart; of the same length they are kept if one of them is.
    """
    text = kw.get("text_col", "text")
    key, size = fresh(docs, "_id", "_n")
    good = cut(score(docs, labels, id_col, **kw).filter("kept").select(F.col("doc_id").alias(key), F.col("n_bytes").alias(size)).distinct())
    return bounded_join(docs, good, F.col(id_col).eqNullSafe(F.col(key)) & (F.octet_length(F.col(text)).cast("long") == F.col(size)), "left_semi")
