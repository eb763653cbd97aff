import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.exact_dedup import drop_exact, exact_dedup, golomb_decode, golomb_encode

SCHEMA = "doc_id long, text string, owner string, part int, n_chars long"


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=80, deadline=None)
def test_golomb_round_trip(xs):
    v = np.sort(np.array(xs, np.uint64))
    k, code = golomb_encode(v)
    assert golomb_decode(len(v), k, code).tolist() == v.tolist()


def rows_of(texts):
    return [(i, t, "x", 1, 0) for i, t in texts]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = {}
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0]))
        for i, _ in g:
            out[i] = (keep[0], len(g), i == keep[0], hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    base = [f"Wörter und  mehr {i % 7}" for i in range(60)]
    rows = [(i, t + " " * (i % 3)) for i, t in enumerate(base)] + [(100, None), (101, ""), (102, " \t\n"), (103, "a b" * 50_000), (104, "ab" * 50_000), (105, " ")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in drop_exact(df).collect()}
    assert kept == {i for i, x in brute(rows).items() if x[2]}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a "), (None, "c"), (None, "c"), (3, "c")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = exact_dedup(df).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert {(r.doc_id, r.keep_id) for r in got if r.group_size == 3} == {(1, 2), (2, 2), (None, 3), (3, 3)}
    left = sorted((r.doc_id, r.text) for r in drop_exact(df).collect())
    assert left == [(1, "b"), (2, "a "), (3, "c")]
    assert exact_dedup(df.limit(0)).count() == 0 and drop_exact(df.limit(0)).count() == 0
    assert drop_exact(df).columns == df.columns
