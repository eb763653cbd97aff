import random
import re

from granary.llm.decontam import decontaminate, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, k string, items int, h long", "item_id long, text string, gram string"


def words(t):
    return WORD.findall((t or "").translate(UP))


def brute(docs, items, size=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    got |= {str(x) for x in grams[tuple(w[a : a + n])] if x is not None}
        out[i] = (len(w), len(hit), sorted(got))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "k", 1, 2) for d in docs], DOCS), spark.createDataFrame([(*i, "g") for i in items], ITEMS)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = ["Ärger", "b2", "Çok", "ÉTÉ", "foo", "BAR", "x", "y9", "z", "w"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(25)), (2, text(10)), (10, text(4)), (11, "only two"), (12, None), (13, "!!!"), (14, text(25)), (None, text(12))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100 + i, text(5) + " . " + items[i % 4][1].upper().replace("É", "É") + "; " + text(3)) for i in range(8)] + [(200, None), (201, ""), (202, "Only, TWO"), (203, text(20_000))]
    d, b = tables(spark, docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in scan(d, b).collect()}
    assert got == brute(docs, items)
    clean = {r.doc_id for r in decontaminate(d, b).collect()}
    assert clean == {i for i, x in brute(docs, items).items() if not x[1]}


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"- Before, {item.upper()}! After."), (2, "nothing here"), (3, item), (4, None)]
    d, b = tables(spark, docs, [(1, item)])
    got = {r.doc_id: r.text for r in decontaminate(d, b, "spans").collect()}
    assert got == {1: "- Before, After.", 2: "nothing here", 3: "", 4: None}
    assert decontaminate(d, b).columns == d.columns


def test_repeats_and_empty_tables(spark):
    d, b = tables(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "b")], [(5, "A b"), (5, "A b"), (6, "a B")])
    rows = scan(d, b).collect()
    assert len(rows) == 4 and {(r.doc_id, r.n_hit, tuple(r["items"])) for r in rows} == {(1, 2, ("5", "6")), (2, 2, ("5", "6")), (None, 0, ())}
    assert scan(d.limit(0), b).count() == 0
    assert {r.contaminated for r in scan(d, b.limit(0)).collect()} == {False}
