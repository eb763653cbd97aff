"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are long runs of token characters, and values of any characters that are assigned to a
name with a secret word in it or follow such a word. The forest sees their length, character
transitions, dictionary coverage, the path they come from and the words beside them, and is trained
on labelled findings. Training takes a bounded table of findings; scanning covers every whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import chunks, flat, lean

#: Shortest candidate in bytes, shortest value after a secret word, and the bytes before and after that count as the neighbourhood.
LEAST, SHORT, NEAR = 16, 6, 48
#: Findings that are learned from at most.
MOST_FINDINGS = 20_000
TREES, DEPTH, SEED, CUTOFF = 40, 8, 11, 0.5

#: Words that stand beside secrets, words that stand beside harmless long tokens, and
#: parts of paths where tokens are samples.
SECRET_WORDS = "api apikey auth authorization aws bearer client credential key passphrase passwd password private pwd secret session token".split()
HARMLESS_WORDS = "card checksum commit digest example hash id isbn md5 order phone revision serial sha sha1 sha256 uuid version".split()
SAMPLE_PATHS = "doc docs demo example examples fixture fixtures mock mocks sample samples spec test testdata tests vendor".split()

FEATURES = ["length", "entropy", "digits", "uppers", "symbols", "hex", "class_changes", "case_changes", "longest_letters", "longest_digits", "distinct", "bigram", "coverage", "uuid", "secret_words", "harmless_words", "assigned", "quoted", "path_depth", "sample_path"]

_TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _TOKEN[_c] = True
_KIND = np.zeros(128, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
#: A secret word in a name, what assigns (or a blank), and the value: up to its quote, or to a blank, a quote or the end.
_VALUE = re.compile(
    (
        rf"(?i)(?:{'|'.join(SECRET_WORDS)})[a-z0-9_-]*+[\"'`]?+\]?+[ \t]{{0,8}}+(?>=>|:=|==|=|:|(?<=[ \t]))[ \t]{{0,8}}+"
        rf"(?:\"([\x21\x23-\x7e]{{{SHORT},}}+)|'([\x21-\x26\x28-\x7e]{{{SHORT},}}+)|`?+([\x21\x23-\x26\x28-\x5f\x61-\x7e]{{{SHORT},}}+))"
    ).encode()
)
_ENDS = b".,;:)]}>"
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_WORD = re.compile(r"[a-z0-9]+")


class Dictionary:
    """Known words of four letters or more, and how common letter pairs are in them. Bounded: made from a tokenizer's vocabulary."""

    def __init__(self, words):
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower())
        self.longest = max(map(len, self.words), default=0)
        pairs = np.ones((26, 26))
        for w in self.words:
            a = np.frombuffer(w.encode(), np.uint8) - 97
            np.add.at(pairs, (a[:-1], a[1:]), 1)
        self.pairs = np.log2(pairs / pairs.sum(axis=1, keepdims=True))

    def coverage(self, text: str) -> float:
        """The share of characters inside known words, taken greedily from the left, longest first."""
        at, hit, low = 0, 0, text.lower()
        while at < len(low):
            for n in range(min(self.longest, len(low) - at), 3, -1):
                if low[at : at + n] in self.words:
                    hit += n
                    at += n
                    break
            else:
                at += 1
        return hit / max(1, len(low))


def dictionary(path: str) -> Dictionary:
    """The words that are whole tokens, with a space before them, of a byte-level rank file."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return Dictionary(t[1:].decode() for t in tokens if t[:1] == b" " and t[1:].isalpha())


def _run(mask: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def features(token: str, before: str, after: str, path: str | None, words: Dictionary) -> list[float]:
    raw = np.frombuffer(token.encode("ascii", "replace"), np.uint8)
    kind, n = _KIND[np.minimum(raw, 127)], max(1, len(raw))
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    change = kind[1:] != kind[:-1]
    letters = kind >= 2
    low = np.where(kind == 2, raw + 32, raw).astype(int) - 97
    both = letters[1:] & letters[:-1]
    pair = words.pairs[low[:-1][both], low[1:][both]].mean() if both.any() else -8.0
    left, parts = _WORD.findall(before.lower())[-4:], _WORD.findall((path or "").lower())
    beside = left + _WORD.findall(after.lower())[:2]
    return [
        float(n),
        float(-(p * np.log2(p)).sum()),
        float((kind == 1).mean()),
        float((kind == 2).mean()),
        float((kind == 0).mean()),
        float(all(c in "0123456789abcdefABCDEF" for c in token)),
        float(change.mean()) if n > 1 else 0.0,
        float((change & both).mean()) if n > 1 else 0.0,
        _run(letters) / n,
        _run(kind == 1) / n,
        float((counts > 0).sum() / min(n, 64)),
        float(pair),
        words.coverage(token),
        float(bool(_UUID.match(token))),
        float(sum(w in SECRET_WORDS for w in left)),
        float(sum(w in HARMLESS_WORDS for w in beside)),
        float(bool(re.search(r"[=:>]\s*[\"'`]?$", before))),
        float(before[-1:] in tuple("\"'`") and before != ""),
        float((path or "").count("/")),
        float(any(x in SAMPLE_PATHS for x in parts)),
    ]


def _spans(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs of at least `least` token characters; runs never join texts."""
    inside = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    keep = (e - s >= least) & inside[s] if len(data) else np.zeros(0, bool)
    return s[keep], e[keep]


def _values(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the values after secret words in one text; an unquoted value ends before closing punctuation."""
    out, at = [], 0
    while m := _VALUE.search(raw, at):
        group = m.lastindex
        a, b = m.span(group)
        if group == 3:
            b = a + len(raw[a:b].rstrip(_ENDS))
        if b - a >= SHORT:
            out.append((a, b))
        at = max(b, m.start() + 1)
    return out


def _found(raw: bytes, runs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Candidates of a text, by place: values after secret words, and runs with a digit or both cases that overlap none of them."""
    values = _values(raw)
    out, i = list(values), 0
    for a, b in runs:
        token = raw[a:b]
        a += len(token) - len(token.lstrip(b"-"))
        token = token.strip(b"-")
        b = a + len(token)
        while i < len(values) and values[i][1] <= a:
            i += 1
        if len(token) < least or i < len(values) and values[i][0] < b:
            continue
        if any(48 <= c < 58 for c in token) or not (token.islower() or token.isupper()):
            out.append((a, b))
    return sorted(out)


def candidates(docs: DataFrame, words: Dictionary, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: int = LEAST) -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), candidate, features: one row for each candidate.

    A candidate is a run of at least `least` of A-Z, a-z, 0-9, +, /, _ and - (not at its ends) with a
    digit or both cases, or a value of at least SHORT visible ASCII characters that is assigned to a
    name with a secret word in it, or follows one after a blank. Anything else parts a run: a dotted
    token without such a name is judged part by part. A null text has none; a null path counts as an
    empty one. Texts without secret words give runs alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")

    def run(batches):
        book = shared.value
        for batch in chunks(batches, "text"):
            data, offsets = flat(batch.column(2))
            starts, ends = _spans(data, offsets, least)
            first = np.searchsorted(starts, offsets)
            paths, rows, out = batch.column(1).to_pylist(), [], [[], [], [], []]
            for row in range(batch.num_rows):
                base = int(offsets[row])
                raw = data[base : offsets[row + 1]].tobytes()
                runs = [(int(a) - base, int(b) - base) for a, b in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]], strict=True)]
                for a, b in _found(raw, runs, least):
                    token = raw[a:b].decode()
                    before, after = (raw[x:y].decode("utf-8", "ignore") for x, y in ((max(0, a - NEAR), a), (b, b + NEAR)))
                    rows.append(row)
                    for col, v in zip(out, (a, b, token, features(token, before, after, paths[row], book)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.float64()))], names=["doc_id", "start", "end", "candidate", "features"])

    source = lean(docs).select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, start long, end long, candidate string, features array<double>")


#: Names that the made findings are assigned to. Their words are those of settings files, not those that are counted.
SETTING_NAMES = "DB_PASSWORD STRIPE_KEY github_token adminPasswd smtp_pass aws_secret_access_key apiKey refreshToken signing_secret root_pw oauth.client.secret JWT_SECRET mailgun_api_key sshPassphrase WEBHOOK_TOKEN x-api-key".split()
PLAIN_NAMES = "build_id etag request_id trace file_hash image_digest cache_key sort_key primary_key foreign_key token_type session_name revision order_no serial".split()


def sample_findings(n: int = 6000, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (token, before, after, path, label) made from public token formats, half of them false positives.

    They stand in where no findings labelled by people are at hand.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "an ber con de en for ing ist ment on or pro re sion ter the ti ver wor".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    leet = lambda: "".join(pick([c, c.upper(), str(int(rng.integers(10))), pick("!@$#%&*")]) for c in (word() + word() + "xyz")[: int(rng.integers(7, 14))])
    assign = lambda name: pick([f'{name} = "', f"{name}: ", f"{name}='", f"{name}=", f'"{name}": "'])
    keys = [lambda: draw(hexa, pick([32, 40, 64])), lambda: draw(hexa.upper(), pick([32, 40])), lambda: draw(alnum, int(rng.integers(20, 65))), lambda: draw(alnum + "+/", pick([40, 44, 86])), lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: ".".join(draw(alnum, k) for k in (20, 60, 43))]
    plain = [
        lambda: (draw("0123456789", int(rng.integers(16, 20))), ""),
        lambda: ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), pick(["id: ", assign(pick(PLAIN_NAMES))])),
        lambda: (draw(hexa, pick([32, 40, 64])), pick(["sha256 ", "md5: ", "commit ", "checksum=", "digest: ", assign(pick(PLAIN_NAMES))])),
        lambda: ("".join(word().capitalize() for _ in range(int(rng.integers(4, 8)))), pick(["class ", "import ", ""])),
        lambda: ("_".join(word() for _ in range(5)) + str(int(rng.integers(100))), pick(["key = ", "def ", ""])),
        lambda: ("/".join(word() for _ in range(5)) + draw("0123456789", 3), pick(["see ", "token path: "])),
        lambda: (pick(["EXAMPLE", "your_", "xxxx", "changeme"]) * 4 + "0", assign(pick(SETTING_NAMES))),
        lambda: (pick(["0", "a1", "x9"]) * 16, assign(pick(SETTING_NAMES))),
        lambda: (draw(alnum, 40), assign(pick(SETTING_NAMES))),
        lambda: (pick(["${DB_PASSWORD}", "string", "required", "<password>", "changeme", "None,", "os.environ[X]", "process.env.KEY", "********", "********", word() + "ing", "getPassword()", "self.token"]).ljust(SHORT, "."), assign(pick(SETTING_NAMES))),
        lambda: ((word() + word() + "able")[:12], pick(["private ", "a session ", "the password ", "key ", "token of "])),
    ]
    out = []
    for i in range(n):
        if i % 2:
            short = rng.random() < 0.3
            before = prose() + ("Authorization: Bearer " if rng.random() < 0.1 and not short else assign(pick(SETTING_NAMES)))
            out.append((leet() if short else pick(keys)(), before, pick(['"', " ", "\n", "'"]) + prose(), pick(["src/app/config.py", "settings.env", "deploy/prod.yml", "", "src3"]), 1))
        else:
            token, name = pick(plain)()
            path = pick(["tests/fixtures/keys.py", "docs/example.md", "examples/demo.yml"]) if len(token) == 40 and len(set(token)) > 17 and name[:1].isupper() | ("=" in name) else pick(["src/app/main.py", "", "src5", "notes.txt"])
            out.append((token, prose() + name, pick(['"', " ", ". "]) + prose(), path, 0))
    return out


def _order(finding) -> bytes:
    return hashlib.blake2b(repr(tuple(finding[:4])).encode(), digest_size=8).digest()


def bounded(findings, most: int = MOST_FINDINGS) -> list:
    """At most `most` findings, those of the smallest hashes, half of them of either label as far as there are so many."""
    sides = [sorted((f for f in findings if f[4] == y), key=_order) for y in (0, 1)]
    few = min(len(sides[0]), len(sides[1]))
    take = [max(most // 2, most - few) if len(s) > few else most // 2 for s in sides]
    return [f for s, n in zip(sides, take, strict=True) for f in s[:n]]


def split(findings, held: int = 4) -> tuple[list, list]:
    """(fit, held out): one in `held` findings, by hash, is held out; equal findings are on one side."""
    out = [], []
    for f in findings:
        out[_order(f)[-1] % held == 0].append(f)
    return out


def evaluate(spark: SparkSession, findings, words: Dictionary, cutoff: float = CUTOFF) -> dict[str, float]:
    """Precision and recall on the findings held out from training."""
    fit, held = split(findings)
    rows = [([*features(t or "", b or "", a or "", p, words)], int(y)) for t, b, a, p, y in held]
    df = spark.createDataFrame(rows, "features array<double>, y int").select(array_to_vector("features").alias("x"), "y")
    said = train(spark, fit, words).transform(df).select("y", (F.round(vector_to_array("probability")[1], 6) >= cutoff).alias("secret"))
    n, hit, right = said.agg(F.count_if("secret"), F.count_if(F.col("y") == 1), F.count_if(F.col("secret") & (F.col("y") == 1))).first()
    return {"precision": right / max(1, n), "recall": right / max(1, hit)}


def train(spark: SparkSession, findings, words: Dictionary, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings (token, before, after, path, label), of which bounded() takes at most MOST_FINDINGS.

    Null texts count as empty. Needs findings of both labels.
    """
    rows = [([*features(t or "", b or "", a or "", p, words)], float(y)) for t, b, a, p, y in bounded(findings)]
    if {y for _, y in rows} != {0.0, 1.0}:
        raise ValueError("findings of both labels are needed")
    df = spark.createDataFrame(rows, "features array<double>, label double").coalesce(1)
    df = df.select(array_to_vector("features").alias("x"), "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(df)


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: Dictionary, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """doc_id, start, end, candidate, probability, secret: every candidate of every whole text, judged.

    Texts without candidates, null and empty ones give no rows; repeated rows give repeated rows.
    """
    found = candidates(docs, words, **columns).withColumn("x", array_to_vector("features"))
    p = F.round(vector_to_array("probability")[1], 6)
    return model.transform(found).select("doc_id", "start", "end", "candidate", p.alias("probability"), (p >= cutoff).alias("secret"))

