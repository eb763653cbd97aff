"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed counts of byte pairs and triples of the whole text, scaled to unit length.
Training takes at most `per_lang` labelled documents of each language, those with the smallest hash
of their id, and every machine is trained in a task of its own; only weights come to the driver.
Prediction sees the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import chunks, flat, lean
from granary.session import cut

DIM = 4096
PER_LANG = 1200
#: Documents of all languages that train the machine of a family at most (but 50 of each language).
FAMILY_ROWS = 6000

#: Families of languages by ISO 639-1 code. A language that isn't listed is of family "other".
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "hellenic": "el",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv mg ms tl",
    "tai": "lo th",
    "austroasiatic": "km vi",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30


def features(data: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of unit length for each text: the square roots of its hashed counts (zeros for a text of one byte or none)."""
    n, low = len(offsets) - 1, _FOLD[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64) * dim, np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out, at = np.zeros(n * dim), np.arange(len(low))
    bits, key = 32 - int(np.log2(dim)), low
    for k in (2, 3):
        if len(low) < k:
            break
        key = (key[: len(low) - k + 1] << np.uint32(8)) | low[k - 1 :]
        inside = at[: len(key)] + k <= ends[: len(key)]
        h = ((key + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(bits)
        out += np.bincount((owner[: len(key)] + h)[inside], minlength=n * dim)
    x = np.sqrt(out.reshape(n, dim), dtype=np.float32, casting="unsafe")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """(w, b) of least |w|^2/2 + c*50*(mean squared hinge loss of either side), by accelerated gradients; y in {-1, 1}."""
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 100).astype(np.float32)
    y = y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb, t = w, b, 1.0
    rate = np.float32(1.0 / (1.0 + 2 * float(weight.sum()) * 2))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        nw = vw - rate * (vw - 2 * (slack @ x))
        nb = vb + rate * 2 * slack.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        go = np.float32((t - 1) / nt)
        vw, vb = nw + go * (nw - w), nb + go * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


class Plan:
    """The machines to be trained: one of each family against the others, and one of each two languages of a family."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.families = sorted({family(v) for v in self.names})
        self.members = {f: [v for v in self.names if family(v) == f] for f in self.families}
        self.jobs = [(f,) for f in self.families] if len(self.families) > 1 else []
        self.jobs += [(f, a, b) for f, m in self.members.items() for i, a in enumerate(m) for b in m[i + 1 :]]

    def rows(self, per_lang: int) -> list[tuple[str, int, int, int]]:
        """(language, job, side, documents of it at most) for each language of each job."""
        shared = min(per_lang, max(50, FAMILY_ROWS // max(1, len(self.names))))
        out = []
        for j, (f, *two) in enumerate(self.jobs):
            langs = two or self.names
            out += [(v, j, 1 if v == two[0] else -1, per_lang) if two else (v, j, 1 if family(v) == f else -1, shared) for v in langs]
        return out


class Model:
    def __init__(self, plan: Plan, fits: list[tuple[np.ndarray, float]]):
        """fits: weights and bias of each of the plan's jobs."""
        self.families, self.members = plan.families, plan.members
        stack = lambda js: (np.stack([fits[j][0] for j in js], axis=1), np.array([fits[j][1] for j in js], np.float32))
        of = {f: [j for j, job in enumerate(plan.jobs) if len(job) == 3 and job[0] == f] for f in self.families}
        self.family_w = stack(range(len(self.families))) if len(self.families) > 1 else None
        self.pairs = {f: ([plan.jobs[j][1:] for j in js], *stack(js)) if js else None for f, js in of.items()}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores in 0..1: the weakest of the logistic margins that led there."""
        score = np.ones(len(x))
        if self.family_w is None:
            fam = np.zeros(len(x), int)
        else:
            f = x @ self.family_w[0] + self.family_w[1]
            fam = f.argmax(axis=1)
            score = 1 / (1 + np.exp(-2.0 * f[np.arange(len(x)), fam]))
        out = np.empty(len(x), object)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(fam == i)
            members = self.members[name]
            if self.pairs[name] is None or not len(rows):
                out[rows] = members[0]
                continue
            pairs, w, b = self.pairs[name]
            margin = x[rows] @ w + b
            votes, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for j, (p, q) in enumerate(pairs):
                s = 1 / (1 + np.exp(-2.0 * margin[:, j]))
                p, q = members.index(p), members.index(q)
                votes[:, p] += s > 0.5
                votes[:, q] += s <= 0.5
                total[:, p] += s
                total[:, q] += 1 - s
            best = (votes + total / (len(members) + 1)).argmax(axis=1)
            out[rows] = np.array(members, object)[best]
            score[rows] = np.minimum(score[rows], total[np.arange(len(rows)), best] / (len(members) - 1))
        return out.tolist(), score


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of at most `per_lang` documents of each non-null lang (bounded sample: smallest hash of the id), None without any."""
    rows = lean(labelled).filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.xxhash64(id_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    # First by a share of the hash range, so that the ranking sees few rows of each language.
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int((1 << 20) * per_lang * 1.5 / n) + 1))).otherwise(share)
    rows = rows.filter(F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < share)

    def run(batches):
        for batch in chunks(batches, "text", 1 << 20):
            x = features(*flat(batch.column(2)))
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].astype(np.float16).tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], names=["h", "lang", "at", "value"])

    sparse = rows.mapInArrow(run, "h long, lang string, at binary, value binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "at", "value"))
    sample = sparse.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("lang", "rank", "at", "value")

    plan = Plan(list(counts))
    if not plan.jobs:
        return Model(plan, [])

    def fit(pdf):
        import pandas as pd

        x = np.zeros((len(pdf), DIM), np.float32)
        for i, (at, value) in enumerate(zip(pdf["at"], pdf["value"], strict=True)):
            x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float16)
        w, b = linear_svm(x, pdf["side"].to_numpy())
        return pd.DataFrame({"job": pdf["job"][:1], "w": [w.tobytes()], "b": [b]})

    jobs = labelled.sparkSession.createDataFrame(plan.rows(per_lang), "lang string, job int, side int, most int")  # as many as the plan has
    work = cut(sample).join(F.broadcast(jobs), "lang").filter("rank <= most")
    got = {r["job"]: (np.frombuffer(r["w"], np.float32), r["b"]) for r in work.groupBy("job").applyInPandas(fit, "job int, w binary, b double").collect()}
    return Model(plan, [got[j] for j in range(len(plan.jobs))])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, lang_pred, score for each row of docs.

    lang_pred is 'und' with score 0 if the text is null or has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = lean(docs).select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", lang_pred string, score double"

    def run(batches):
        m = shared.value
        for batch in chunks(batches, "text", 1 << 20):
            texts = batch.column(batch.num_columns - 1)
            letters = [has_letter(t) for t in texts.to_pylist()]
            langs, score = m.predict(features(*flat(texts))) if m else (["und"] * len(letters), np.zeros(len(letters)))
            langs = [v if ok else "und" for v, ok in zip(langs, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(run, schema)
