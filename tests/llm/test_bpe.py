import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from granary.llm.bpe import ByteBpe, PerfectHash, decode, encode, parse_ranks, read_ranks, round_trip  # noqa: E402

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both():
    ranks = parse_ranks(RANKS)
    return ByteBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(map(h.index, keys)) == list(range(5000)) and h.size == 5000
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_equals_the_library(both):
    mine, other = both
    rng = random.Random(3)
    texts = ["", " ", "a", "it's we'LL 123 456789!!\n\n  \t x", "<|endoftext|>", "ß" * 300, "a" * 5000, "日本語のテキスト🙂👩‍👩‍👧", "\x1c\x1d\x85  　x", "x" + " " * 50 + "y"]
    for _ in range(150):
        texts.append("".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in (rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x110000), 32]) for _ in range(60))))
    for t in texts:
        assert mine.encode(t) == other.encode_ordinary(t), repr(t)


def test_all_characters_split_alike(both):
    mine, other = both
    for a in range(0, 0x30000, 64):
        t = "".join(f"{chr(c)}b " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
        assert mine.encode(t) == other.encode_ordinary(t), hex(a)


def test_frames(spark, both):
    rows = [(1, "hello there", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, "läng " * 20_000, 5), (None, "id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(df, RANKS, P.PATTERN).collect()}
    want = set()
    for i, t, _ in rows:
        ids = both[1].encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert encode(df, RANKS, P.PATTERN).count() == 6 and encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in decode(empty, RANKS, P.PATTERN, ["doc_id"]).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), RANKS, P.PATTERN, ["doc_id"]).collect()
