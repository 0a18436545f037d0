"""Language ID by hierarchical discrimination.

Texts become hashed counts of byte trigrams. A linear support vector machine
(one against the rest) picks the language family; within it, one-versus-one
machines separate the languages by votes. Models are trained in numpy on a
bounded, balanced sample; scoring covers whole texts inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm._shared import bounded_sample, held_out, tidy

#: The bounded sample of training: rows of each language at most, rows and bytes of text in all.
PER_LANGUAGE, ROWS, SAMPLE_BYTES = 800, 6_400, 64 << 20
#: Languages that are learnt: those with most labelled rows (ties by code point); other
#: values of a label column, such as junk, are not.
LANGUAGES = 400
FEATURES = 1 << 12
#: Bytes turned into features at a time.
CHUNK = 4 << 20

#: Families of ISO 639-1 codes (fixed values); other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(texts: list[str]) -> np.ndarray:
    """Square roots of hashed trigram counts, scaled to length 1; one row a text.
    Digits, ASCII marks and white space all count as one space."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(f" {t.lower()} ".encode("utf-8", "replace"), np.uint8)
        for lo in range(0, len(data), CHUNK):
            b = _CLASS[data[lo : lo + CHUNK + 2]].astype(np.uint32)
            if len(b) < 3:
                continue
            h = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(40503 * 65536 + 1) + b[2:] * np.uint32(2246822519)) >> np.uint32(20)
            keep = (b[:-2] != 32) | (b[1:-1] != 32)
            out[i] += np.bincount(h[keep], minlength=FEATURES)[:FEATURES]
    np.sqrt(out, out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear machines with squared hinge loss (y in -1, 1; a machine a column), by
    accelerated gradient steps; classes weigh equally. The last weight is the bias."""
    y = y.reshape(len(x), -1)
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    cost = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(0)), 0.5 / np.maximum(1, (y < 0).sum(0))).astype(np.float32)
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    step = np.float32(1 / (4 + reg))
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (np.float32(reg) * v - 2 * (x.T @ (cost * y * slack)))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    family_w: np.ndarray  # a family a column
    languages: list[list[str]]
    pairs: list[list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        x1 = np.column_stack([x, np.ones(len(x), np.float32)])
        margins = x1 @ self.family_w
        best = margins.argmax(1)
        sure = 1 / (1 + np.exp(-4 * margins[np.arange(len(x)), best]))
        lang = np.empty(len(x), object)
        for f, names in enumerate(self.languages):
            rows = np.flatnonzero(best == f)
            votes = np.zeros((len(rows), len(names)))
            low = np.ones((len(rows), len(names)))
            for a, b, w in self.pairs[f]:
                p = 1 / (1 + np.exp(-4 * (x1[rows] @ w)))
                votes[:, a] += (p >= 0.5) + 1e-3 * p
                votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
                low[:, a], low[:, b] = np.minimum(low[:, a], p), np.minimum(low[:, b], 1 - p)
            k = votes.argmax(1) if len(names) > 1 else np.zeros(len(rows), int)
            lang[rows] = np.array(names, object)[k]
            sure[rows] *= low[np.arange(len(rows)), k]
        return lang.tolist(), np.clip(sure, 0, 1)


def train(texts: list[str], langs: list[str]) -> Model:
    x, langs_ = features(texts), np.array(langs, object)
    names = sorted(set(langs))
    fams = sorted({family(n) for n in names})
    of = np.array([family(n) for n in langs_], object)
    if len(fams) < 2:
        w = np.zeros((FEATURES + 1, max(1, len(fams))), np.float32)
        w[-1] = 1
    elif len(fams) == 2:
        one = svm(x, np.where(of == fams[0], 1, -1).astype(np.float32))
        w = np.column_stack([one, -one])
    else:
        w = svm(x, np.where(of[:, None] == np.array(fams, object), 1, -1).astype(np.float32))
    languages = [[n for n in names if family(n) == f] for f in fams]
    pairs = []
    for group in languages:
        own = []
        for a, b in combinations(range(len(group)), 2):
            rows = (langs_ == group[a]) | (langs_ == group[b])
            own.append((a, b, svm(x[rows], np.where(langs_[rows] == group[a], 1, -1).astype(np.float32))[:, 0]))
        pairs.append(own)
    return Model(fams, w.astype(np.float32), languages, pairs)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on rows outside the held-out third, those whose id hashes lowest: at most
    ``per_language`` of each language, ``ROWS`` and ``SAMPLE_BYTES`` of text in all, shared
    evenly; a text that does not fit is passed over. None without such rows."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    if not counts:
        return None
    per = min(per_language, max(1, ROWS // len(counts)))
    # A bar on the hash leaves some more rows than are wanted before they are ranked.
    enough = per + 6 * per**0.5 + 50
    bars = spark.createDataFrame([(r.l, int(min(1.0, enough / r["count"]) * (1 << 64)) - (1 << 63) - 1) for r in counts], "l string, bar long")
    few = rows.select("i", "l", F.octet_length("t").alias("bytes"), F.xxhash64("i").alias("h")).join(F.broadcast(bars), "l").where("h <= bar").drop("bar")
    few = few.groupBy("i", "l", "h").agg(F.sum("bytes").cast("long").alias("bytes"))  # rows that share an id come together
    few = few.withColumn("x", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("x") <= per)
    ids = bounded_sample(few.select("x", "i", "l", "bytes"), ROWS, SAMPLE_BYTES)
    got = rows.join(F.broadcast(ids), ["i", "l"]).select("i", "l", "t").orderBy("i", "l", "t").limit(2 * ROWS).collect()
    return train([r.t for r in got], [r.l for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score``; ``und`` and 0 for texts that are
    null or have no letter, and for all texts without a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    fields = ", ".join([f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            n = b.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            for lo in range(0, n, 512):
                texts = [t.as_py() or "" for t in b.column("t")[lo : lo + 512]]
                rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if m else []
                if rows:
                    got, sure = m.predict(features([texts[i] for i in rows]))
                    for i, g, s in zip(rows, got, sure, strict=True):
                        lang[lo + i], score[lo + i] = g, s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return src.mapInArrow(lambda it: tidy(run(it)), fields).toDF(*keep, "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row; repeated rows repeat."""
    out = predict(docs, fit(docs, id_col, text_col, lang_col), [id_col], text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
