import collections
import random
import re

import numpy as np

from granary.llm import ngram_join
from granary.llm.common import prefix_hash, shingles, words
from granary.llm.ngram_join import drop_near, least_matches, similarity_join

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, class string, n int, rep string"


def sets_of(rows, k=5):
    out = []
    for _, t in rows:
        w = W.findall((t or "").translate(UP))
        out.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(rows, threshold=0.8):
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "r") for r in rows], SCHEMA)


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = near_copies(rng, base, 80) + [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += ["one two", "ONE, two!", "one", None, "", "?!", "x " * 3000, texts[0], texts[0]]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity_join(frame(spark, rows).repartition(3)).collect())
    assert got == brute(rows)
    kept = {r.doc_id for r in drop_near(frame(spark, rows)).collect()}
    assert kept == {d for d, c, _ in got if d == c}


def test_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "q r s"), (None, "q r s")]
    out = similarity_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in out) == [(0, 0, 1, 1), (0, 0, 1, 1), (1, 1, 2, 2), (1, 1, 2, 2), (2, 1, 2, 2)]
    assert sorted((r.doc_id or 0) for r in drop_near(frame(spark, rows)).collect()) == [0, 1]
    assert similarity_join(frame(spark, rows).limit(0)).count() == 0


def test_posterior_bounds_rise():
    bounds = [least_matches(m) for m in range(16, 113, 16)]
    assert bounds == sorted(bounds) and all(0 <= b < 0.8 * m for b, m in zip(bounds, range(16, 113, 16), strict=True))
    assert least_matches(16, tolerance=0.5) > least_matches(16)


def test_hashes_are_those_of_the_words():
    texts = ["Foo bar", "", "foo", "bär  BAR\nfoo bar"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, at = words(data, offsets)
    assert at.tolist() == [0, 2, 2, 3, 7]
    assert h[0] == h[2] == h[5] and h[1] == h[4] == h[6] and h[3] not in h[[0, 1]]
    s, o = shingles(h, at, 2)
    assert np.diff(o).tolist() == [1, 0, 1, 3] and s[0] == s[4]
    p, inv = prefix_hash(np.frombuffer(b"abcabc", np.uint8))
    at = np.array([0, 3])
    one, two = (p[at + 3] - p[at]) * inv[at]
    assert one == two
