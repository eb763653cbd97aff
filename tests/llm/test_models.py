import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import langid, quality, secret_scan, word_model
from granary.llm.langid import family, predict, train
from granary.llm.quality import keep_good, score

DOCS = "doc_id long, text string, lang string, gram string, n int"


def kneser_ney(counts, order, symbols):
    """Plain interpolated modified Kneser-Ney over tuples, from raw counts of n-grams."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discounts = {}
    for k, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        discounts[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / symbols
        ctx = [(h, c) for h, c in tables[k].items() if h[:-1] == g[:-1]]
        low = p(g[1:])
        if not ctx:
            return low
        off = lambda c: discounts[k][min(c, 3) - 1]
        total = sum(c for _, c in ctx)
        own = tables[k].get(g, 0)
        return (max(own - off(own), 0) / total if own else 0) + sum(off(c) for _, c in ctx) / total * low

    return p


def grams_of(text):
    toks = ["<s>", *re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s]+", text or ""), "</s>"]
    return list(zip(toks, toks[1:], strict=False))


@pytest.mark.parametrize("rows", [50, 10**6])
def test_language_model_matches_a_plain_one(spark, monkeypatch, rows):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    fit = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))) for _ in range(30)] + ["w1 w2, w3!", "Été w1", "w1 w2, w3!"]
    asked = fit[:5] + ["", None, "w3 new w4 w4 w1", "  ,, w1", "w1 w2, w3!", "w3 w2, w1!"]
    counts = Counter(g for t in fit for g in grams_of(t))
    p = kneser_ney(counts, 2, len({g[-1] for g in counts}) + 1)
    want = [sum(math.log(p(g)) for g in grams_of(t)) for t in asked]
    monkeypatch.setattr(word_model, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(word_model, "PACK_ROWS", 30)
    model = word_model.model(spark.createDataFrame([(t,) for t in fit], "_text string").repartition(3), quality._discounts, rows)
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(asked)], "_text string, doc_id long").repartition(2)
    got = {r.doc_id: r for r in word_model.scores(docs, model).collect()}
    assert [got[i]._lp for i in range(len(asked))] == pytest.approx(want, abs=1e-4)
    assert [got[i]._tokens for i in range(len(asked))] == [len(grams_of(t)) - 1 for t in asked]


def corpus(n=400):
    rng = random.Random(4)
    words = ["north", "river", "stone", "water", "light", "green", "house", "under"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        text = " ".join("#$%!"[rng.randrange(4)] * 3 + str(rng.randrange(999)) if bad else rng.choice(words) for _ in range(30))
        rows.append((i, text, "en" if i % 3 else None, "g", 1))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality_keeps_clean_and_drops_junk(spark, monkeypatch):
    rows, labels = corpus()
    rows += [(900, None, "en", "g", 1), (901, "", None, "g", 1), (902, "north river " * 10_000, "xx", "g", 1), (1, rows[1][1], "en", "g", 1), (None, "north river", "en", "g", 1)]
    df = spark.createDataFrame(rows, DOCS)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score(df, lb).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    clean = [kept[i] for i in range(400) if i % 8]
    assert sum(clean) >= 0.96 * len(clean) and not any(kept[i] for i in range(0, 400, 8))
    assert not kept[900] and not kept[901] and kept[902]
    assert next(r for r in got if r.doc_id == 900).perplexity is None
    monkeypatch.setattr(quality, "SHARD_ROWS", 20)
    monkeypatch.setattr(word_model, "COUNT_SLICES", 3)
    monkeypatch.setattr(word_model, "TEXT_SLICES", 5)
    again = {r.doc_id: r.perplexity for r in score(df, lb).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.perplexity, rel=1e-5) for r in got if r.perplexity)
    left = keep_good(df, lb)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got)
    assert score(df.limit(0), lb).count() == 0
    assert all(r.kept == bool(r.n_bytes) for r in score(df, lb.limit(0)).collect())


def test_thresholds_never_compare_languages(spark):
    rng = random.Random(5)
    sets = {"en": ["north", "river", "stone", "water", "light", "green"], "de": ["straße", "über", "wälder", "mühle", "höhe", "grün"], None: ["maison", "rivière", "été", "forêt", "pierre", "lumière"], "es": ["casa", "río", "piedra", "año", "montaña", "verde"]}
    rows, labels = [], []
    for i in range(800):
        lang = list(sets)[i % 4]
        rows.append((i, " ".join(rng.choice(sets[lang]) for _ in range(30)), lang, "g", 1))
        # es has no trusted text, the unlabelled ones few
        if lang == "en" or lang == "de" and i < 100 or lang is None and i < 120:
            labels.append((i, 1, 0))
    got = score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for lang in sets:
        mine = [r for r in got if r.lang == lang]
        assert sum(r.kept for r in mine) >= 0.8 * len(mine), lang
    assert all(r.threshold is None for r in got if r.lang == "es")
    assert len({r.threshold for r in got}) == 4


SAMPLES = {
    "en": "the and of to in that with this from house water people",
    "de": "der die und das nicht mit ein auch haus wasser für über",
    "nl": "het een van niet dat zijn huis water voor naar ook maar",
    "fr": "le la les des est pour dans que maison eau très être",
    "es": "el los las una que por para casa agua más está año",
}


def test_language_identification_held_out(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        lang = list(SAMPLES)[i % 5]
        rows.append((i, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(25)), lang, "g", 1))
    extra = [(900, None, "en", "g", 1), (901, "", None, "g", 1), (902, "123 !?", "fr", "g", 1), (903, "the water " * 50_000, None, "g", 1), (904, "x", None, "g", 1)]
    df = spark.createDataFrame(rows + extra, DOCS)
    model = train(df.filter("doc_id % 4 <> 2 or doc_id >= 900"), per_lang=60)
    assert model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    got = {r.doc_id: r for r in predict(df, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en" and got[904].lang_pred in SAMPLES
    assert train(df.limit(0)) is None and {r.lang_pred for r in predict(df, None).collect()} == {"und"}
    assert predict(df.limit(0), model).count() == 0
    one = train(df.filter("lang = 'fr'"))
    assert {r.lang_pred for r in predict(df.filter("doc_id < 5"), one).collect()} == {"fr"}
    assert family("pt-BR") == "romance" and family("zz") == "other"


def test_machines_reach_the_least_loss_and_are_trained_on_the_plans_rows(spark):
    """Against plain gradient descent on the same features, and train() against fits made here."""
    rng = np.random.default_rng(1)
    x = langid.features(*_flat([" ".join(rng.choice(SAMPLES[v].split(), 12)) for v in ("en", "de") * 30]))
    y = np.tile([1, -1], 30)

    def loss(w, b):
        hinge = np.maximum(0, 1 - y * (x @ w + b)) ** 2
        return w @ w / 2 + 500 * (hinge[y > 0].mean() + hinge[y < 0].mean())

    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * 500 / 30
        w, b = w - 2e-4 * (w - 2 * slack @ x), b + 2e-4 * 2 * slack.sum()
    assert loss(*langid.linear_svm(x, y)) <= 1.02 * loss(w, b)

    rows = [(i, " ".join(rng.choice(SAMPLES[v].split(), 12)), v) for i, v in enumerate(["en", "de", "fr"] * 10)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100)
    f = langid.features(*_flat([t for _, t, _ in rows])).astype(np.float16).astype(np.float32)
    side = np.array([1 if v != "fr" else -1 for *_, v in rows])
    want, _ = langid.linear_svm(f, side)
    assert model.families == ["germanic", "romance"]
    assert model.family_w[0][:, 0] == pytest.approx(want, abs=1e-3)
    two = np.array([v != "fr" for *_, v in rows])
    want, _ = langid.linear_svm(f[two], np.array([1 if v == "de" else -1 for *_, v in rows])[two])
    assert model.pairs["germanic"][0] == [("de", "en")] and model.pairs["germanic"][1][:, 0] == pytest.approx(want, abs=1e-3)
    assert langid.Plan(["de", "en", "nl", "fr"]).rows(100)[:4] == [("de", 0, 1, 100), ("en", 0, 1, 100), ("fr", 0, -1, 100), ("nl", 0, 1, 100)]


def _flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


@pytest.fixture(scope="module")
def book():
    return secret_scan.Dictionary("water stone river light house under example changeme class import".split())


def test_secret_features_and_spans(book):
    assert book.coverage("waterStone99") == pytest.approx(10 / 12)
    f = dict(zip(secret_scan.FEATURES, secret_scan.features("deadbeefdeadbeef00", 'my token = "', '" end', "tests/keys/a.py", book), strict=True))
    assert f["hex"] == f["assigned"] == f["quoted"] == f["secret_words"] == f["sample_path"] == 1 and f["path_depth"] == 2 and f["length"] == 18
    data = np.frombuffer(b"a" * 20 + b"b" * 20 + b" short", np.uint8)
    s, e = secret_scan._spans(data, np.array([0, 20, 40, 46]), 16)
    assert s.tolist() == [0, 20] and e.tolist() == [20, 40]


def plain_candidates(text):
    """The rules of candidates(), character by character and with none of its expressions."""
    raw = (text or "").encode()
    visible, closing = set(range(0x21, 0x7F)), b".,;:)]}>"
    low, values, at = raw.lower(), [], 0

    def value_after(i):
        """The value that follows a secret word ending at i, or None."""
        while i < len(raw) and (chr(low[i]).isalnum() and raw[i] < 128 or raw[i] in b"_-"):
            i += 1
        if i < len(raw) and raw[i] in b"\"'`":
            i += 1
        if i < len(raw) and raw[i] == ord("]"):
            i += 1
        j = i
        while j < len(raw) and raw[j] in b" \t" and j - i < 8:
            j += 1
        signs = [k for k in (b"=>", b":=", b"==", b"=", b":") if raw.startswith(k, j)]
        if signs:
            k = j + len(signs[0])
        elif j > i:
            k = j
        else:
            return None
        start = k
        while k < len(raw) and raw[k] in b" \t" and k - start < 8:
            k += 1
        for quote in b"\"'":
            if k < len(raw) and raw[k] == quote:
                e = k + 1
                while e < len(raw) and raw[e] in visible and raw[e] != quote:
                    e += 1
                return (k + 1, e) if e - k - 1 >= 6 else None
        k += raw[k : k + 1] == b"`"
        e = k
        while e < len(raw) and raw[e] in visible and raw[e] not in b"\"'`":
            e += 1
        if e - k < 6:
            return None
        return k, e

    while at < len(raw):
        here = [(m, at + len(w)) for w in secret_scan.SECRET_WORDS if low.startswith(w.encode(), at) for m in [value_after(at + len(w))] if m]
        if not here:
            at += 1
            continue
        (a, b), _ = here[0]
        quoted = raw[a - 1 : a] in (b'"', b"'")
        stop = b
        while not quoted and stop > a and raw[stop - 1] in closing:
            stop -= 1
        if stop - a >= 6:
            values.append((a, stop))
        at = max(stop, at + 1)
    token = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    i, out = 0, list(values)
    while i < len(raw):
        if raw[i] not in token:
            i += 1
            continue
        j = i
        while j < len(raw) and raw[j] in token:
            j += 1
        a, b = i, j
        if j - i >= 16:
            while a < b and raw[a] == 45:
                a += 1
            while b > a and raw[b - 1] == 45:
                b -= 1
            part = raw[a:b].decode()
            mixed = any(c.isdigit() for c in part) or any(c.islower() for c in part) and any(c.isupper() for c in part)
            if b - a >= 16 and mixed and not any(x < b and a < y for x, y in values):
                out.append((a, b))
        i = j
    return sorted(out)


def test_secret_candidates_match_plain_rules(spark, book):
    rng = random.Random(13)
    bits = ["password", "api_key", "Token", "the", "=", ":", " ", "  ", '"', "'", "`", "Tr0ub4dor3", "hunter2!", "a.b.c", "été", "\n", "=>", ":=", "-", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "AbcDefGhiJklMnoPq", "x" * 20, "1234567", ";", "]", "secret", "bearer", "ab"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += [None, "", "w " * 3000 + 'password = "Tr0ub4dor3"', 'token: "eyJhbGciOi.eyJzdWIi.SflKxw"', "password hunter22", "Authorization: Bearer abcdef123456"]
    df = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    got = {}
    for r in secret_scan.candidates(df, book).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.candidate
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_candidates(t), t


def test_findings_are_bounded_by_hash_and_split(spark, book):
    found = secret_scan.sample_findings(1000)
    rows = sorted(found, key=lambda f: f[4])
    few = secret_scan.bounded(rows, 100)
    assert sum(f[4] for f in few) == 50 and sorted(few) == sorted(secret_scan.bounded(found, 100))
    assert len(secret_scan.bounded(rows[:520], 100)) == 100 and len(secret_scan.bounded(rows, 5000)) == 1000
    fit, held = secret_scan.split(found + found[:10])
    assert 150 < len(held) < 350 and not {f[:4] for f in fit} & {f[:4] for f in held}
    assert min(secret_scan.evaluate(spark, secret_scan.sample_findings(3000), book).values()) > 0.85


def test_planted_tokens_of_the_given_documents_are_found(spark, sf):
    """Every 40-digit value of a token in the smallest generated table is a candidate, and is flagged."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = secret_scan.dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    planted = {(r.doc_id, t) for r in docs.collect() for t in re.findall(r'token = "([0-9a-f]{40})"', r.text or "")}
    out = secret_scan.scan(docs, secret_scan.train(spark, secret_scan.sample_findings(), words), words)
    assert planted <= {(r.doc_id, r.candidate) for r in out.filter("secret").collect()}


def test_secret_forest_held_out(spark, book):
    found = secret_scan.sample_findings(3000)
    model = secret_scan.train(spark, found[:2000], book)
    docs = [(i, f"{b}{t}{a}", p, 1) for i, (t, b, a, p, _) in enumerate(found[2000:])]
    docs += [(5000, None, None, 1), (5001, "", "x", 1), (5002, "é" * 40 + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" ', None, 1), (5002, "no secret here", None, 1), (None, "w " * 100_000 + "password: Zk93LsPq81TtYw20BnVx77Hd", "a/b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, start int")
    out = secret_scan.scan(df, model, book).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    right = n = 0
    for i, (t, _, _, _, y) in enumerate(found[2000:]):
        for r in by.get(i, []):
            if t.strip("-") == r.candidate:
                n += 1
                right += r.secret == bool(y)
    assert n > 700
    assert right >= 0.93 * n, (right, n)
    hit = by[5002][0]
    assert hit.secret and docs[-3][1].encode()[hit.start : hit.end].decode() == hit.candidate
    assert any(r.secret for r in by[None]) and 5000 not in by and 5001 not in by
    assert secret_scan.scan(df.limit(0), model, book).count() == 0
    with pytest.raises(ValueError):
        secret_scan.train(spark, found[:1], book)
    assert langid.has_letter("1é") and not langid.has_letter(None)
