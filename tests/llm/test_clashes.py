"""Operators that return their input's columns, on tables whose other columns bear the names that joins use inside."""

import random

import pytest

from granary.llm.decontam import decontaminate
from granary.llm.exact_dedup import _answer, _sender, drop_exact, exact_dedup
from granary.llm.ngram_join import drop_near, similarity_join
from granary.llm.quality import keep_good

NAMES = ["_id", "_ID2", "_n", "_k", "_spans", "_own", "_sha", "_s", "_c", "n", "any", "class", "k", "spans", "_text", "_rep", "count"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = "north river stone water light green house under over land".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en") for i in range(60)]
    rows += [(100, rows[0][1] + " "), (101, rows[1][1] + " more"), (5, rows[5][1]), (102, None), (103, "")]
    return spark.createDataFrame([(*r[:2], "en") for r in rows], "doc_id long, text string, lang string")


FILTERS = {
    "exact": drop_exact,
    "near": drop_near,
    "good": lambda d: keep_good(d, d.sparkSession.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")),
    "clean": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "river stone")], "item_id long, text string")),
    "spans": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "river stone")], "item_id long, text string"), "spans"),
}


@pytest.mark.parametrize("name", FILTERS)
def test_columns_of_any_name_stay(docs, name):
    extra = docs.selectExpr("*", *(f"concat('x', doc_id) AS `{c}`" for c in NAMES))
    got, plain = FILTERS[name](extra), FILTERS[name](docs)
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted((r.doc_id, str(r.text)) for r in rows) == sorted((r.doc_id, str(r.text)) for r in plain.collect())
    assert all(r[c] == f"x{r.doc_id}" for r in rows for c in NAMES)


def test_ids_that_are_strings(spark):
    texts = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "other words than these are here"), ("c", "One two  three four five six")]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()} == {("b", "a", False), ("a", "a", True), (None, None, True), ("c", "c", True)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in similarity_join(df).collect()} == {("b", "a", 2), ("a", "a", 2), ("c", "a", 2), (None, None, 0)}


def test_an_owner_decodes_a_repeated_text_once_a_message(monkeypatch):
    """Half of 100,000 rows have one text; each message holds its fingerprint once and says that it repeats."""
    import pandas as pd
    import pyarrow as pa

    from granary.llm import exact_dedup as module

    monkeypatch.setattr(module.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    monkeypatch.setattr(module, "PART_ROWS", 30_000)
    texts = ["same" if i % 2 else f"text {i}" for i in range(100_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), pa.array(texts[i : i + 500])], names=["doc_id", "text"]) for i in range(0, 100_000, 500)]
    out = pa.Table.from_batches(list(_sender(0, pa.int64())(iter(batches)))).to_pandas()
    mail = out[out["k"].notna()].astype({"n": int, "k": int})
    assert len(mail) == 4 and mail["n"].sum() == 50_000 + 4  # each different text once a message
    marks = _answer(pd.DataFrame(mail))
    assert sum(bin(int.from_bytes(m, "big")).count("1") for m in marks["bitmap"]) == 4
