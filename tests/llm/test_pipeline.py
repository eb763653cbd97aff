import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from granary.llm.bpe import parse_ranks  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose with junk, copies, near copies and a leaked passage, and the tables beside it."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("north", "river", "stone", "water", "light") for b in ("land", "side", "fall", "wood", "house", "town")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(n)) + rng.choice([".", ".  ", " extra"])
    leak = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, prose(60)) for i in range(300)]
    # 1003 has the passage without the full stops that all other texts have, 1004 with them
    said = "".join(w + (". " if i % 3 == 2 else " ") for i, w in enumerate(leak.split()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1] + "  "), (1002, rows[1][1] + " extra"), (1003, rows[2][1] + " " + leak), (1004, rows[3][1] + " " + said)]
    rows += [(2000 + i, " ".join(rng.choice("#$%&") * 4 for _ in range(40))) for i in range(20)] + [(3000, None), (3001, "")]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(2000, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_and_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left, frames = docs, []
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, folder)
        frames.append({r.doc_id for r in left.select("doc_id").collect()})
        if name != "byte_bpe":
            assert left.columns == docs.columns
    good, exact, near, clean, coded = frames
    assert not good & ({3000, 3001} | set(range(2000, 2020))) and len(good & set(range(300))) >= 290
    # copies: the longest stays; near copies: the smallest id
    assert {0, 1, 2, 3, 1001, 1002, 1004} <= good  # by pairs of words, 1003 may be too unlike the rest
    assert exact == good - {0, 1000}
    assert near == exact - {1002}
    assert 1004 in near and clean == near - {1003, 1004}
    assert coded == clean
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == clean
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_last_stage_returns_the_ids(spark, folder):
    texts = {1: "north river, stone.", 2: "", 3: None, 4: "été #$%"}
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.byte_bpe(spark, docs, folder).collect()}
    ranks, pattern = corpus_pipeline._ranks()
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})
    for i, t in texts.items():
        assert got[i].ids == plain.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, got[i].ids)).encode()).hexdigest()
