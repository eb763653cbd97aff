import random

import numpy as np
import pytest

from granary.llm import suffix_dedup
from granary.llm.sais import pack, permuted_common_prefixes, suffix_arrays
from granary.llm.suffix_dedup import anchors, remove_repeats

SCHEMA = "doc_id long, text string, shard long, context string, k int"


def brute(rows, length):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for s in range(len(raw) - length + 1):
            seen[raw[s : s + length]] = seen.get(raw[s : s + length], 0) + 1
    out = []
    for (i, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=str)


def result(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeats(df, length).collect()), key=str)


@pytest.mark.parametrize("shard", [48, 2])
def test_matches_brute_force(spark, monkeypatch, shard):
    """With shards of 2 contexts both ways of splitting run."""
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(shard)
    vocab = ["ab", "cde", "é", "fgh ", "x"]
    text = lambda n: "".join(rng.choice(vocab) for _ in range(n))
    common = text(60)
    rows = [(i, text(rng.randrange(0, 30)) + common[: rng.randrange(20, 120)] + text(rng.randrange(0, 30))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, common * 3), (104, rows[0][1]), (105, text(8)), (106, "ab" * 200)]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    assert result(df, 40) == brute(rows, 40)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "q" * 30), (1, "q" * 30), (2, "short"), (None, "".join(map(chr, range(300, 340))))]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)
    assert result(df, 20) == brute(rows, 20)
    assert remove_repeats(df.limit(0), 20).count() == 0


def test_windows_of_equal_content_choose_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 100, 90).astype(np.uint8)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (50, 70)]
    found = []
    for p in parts:
        data = np.concatenate([p, passage, p])
        h, _, _, first, last, place = anchors(data, np.array([0, len(data)]), 60)
        assert sorted(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])) == list(range(len(data) - 59))
        at = len(p)
        i = np.flatnonzero((first <= at) & (last >= at))[0]
        found.append((h[i], place[i] - at))
    assert found[0] == found[1]


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(2)
    for trial in range(30):
        lanes = [rng.integers(0, 1 + trial % 4 + 1, int(rng.integers(0, 40))).astype(np.int32) for _ in range(5)]
        t = pack(lanes)
        sa = suffix_arrays(t)
        stops = t == 0
        plcp, phi = permuted_common_prefixes(t, sa, stops)
        for b in range(len(lanes)):
            s = t[:, b].tolist()
            assert sa[:, b].tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:])
            for r in range(1, len(s)):
                i, j, n = sa[r, b], sa[r - 1, b], 0
                while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n] and s[i + n]:
                    n += 1
                assert (plcp[i, b], phi[i, b]) == (n, j)
