"""Quality classifier by hierarchical empirical Bayes.

A logistic document classifier over text statistics gives each document's
evidence. Grouped aggregation gives every host and every path under it a mean
of what is known of its other documents, their label where training may see it
and else their evidence; sparse sites shrink: a path towards its host, a host
towards the corpus, by weights estimated from the spread between sites. The score
is the posterior odds: the document's likelihood ratio times the odds of its path.
A document is left out of the means of its own sites, so that its evidence counts
once and its label never.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm._shared import bounded_sample, held_out, scratch, tidy, written, written_texts

#: Labelled rows and bytes of their texts that training reads at most.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Site tables of more rows are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
SALTS = 32
MICRO = 1_000_000
_MARK = re.compile(r"[#$%&*|^~<>{}=\\@_]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[,.;:]")
NAMES = ("words", "word_length", "marks", "digits", "stops", "capitals", "distinct", "lines", "repeated_lines", "top_word", "line_length", "doubled")


def statistics(text: str | None) -> list[float]:
    """The document's features; all 0 for a null or empty text."""
    t = text or ""
    words = t.split()
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in t.split("\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(n), chars / n, len(_MARK.findall(t)) / chars, len(_DIGIT.findall(t)) / chars, len(_STOP.findall(t)) / n,
        sum(w[0].isupper() for w in words) / n, len(counts) / n**0.8, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        counts.most_common(1)[0][1] / n, np.log1p(chars / len(lines)), sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and scales; Newton steps on standardised features and their squares."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = expand((x - mean) / scale)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + reg * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + reg * np.eye(z.shape[1])
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w, mean, scale


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -5, 5)
    return np.column_stack([z, z * z, np.ones(len(z))])


def evidence(docs: DataFrame, fitted: tuple, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` plus ``p``: the classifier's probability, whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    src = docs.select(*keep, F.col(text_col).alias("__t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", p double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, scale = sent.value
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("__t")]).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(expand((x - mean) / scale) @ w, -12, 12)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], [*b.schema.names[:-1], "p"])

    return src.mapInArrow(lambda it: tidy(run(it)), fields)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(sites: DataFrame, mean: Column, spread_of: str) -> float:
    """Pseudo-counts of the prior, by moments: the less sites differ beyond what
    their documents' spread explains, the stronger the pull."""
    row = sites.where("n >= 2").agg(F.avg((F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.avg(F.col(spread_of) / F.col("n")).alias("within"), F.avg(spread_of).alias("spread")).first()
    if row.between is None or row.spread is None:
        return 10.0
    true = max(row.between - row.within, 1e-4)
    return float(min(1e4, max(1.0, row.spread / true)))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``id, held_out, evidence, host_posterior, path_posterior, score, keep`` of every row.

    Null hosts and paths are sites of their own. An id with several labels counts
    with its largest; labels of the held-out third are not read. Training takes the
    labelled documents whose id hashes lowest, within its bounds. Without labels of both
    kinds the classifier is flat and scores follow the sites. Sums are taken in whole
    millionths, so that reruns agree.
    """
    with scratch(docs.sparkSession) as result:
        return result(_quality(docs, labels, host, path, id_col, text_col, label_col, sample), "quality-scores")


def _quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(F.max(label_col).alias("y")).where(~held_out("l"))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sized = text.select("id", F.octet_length("t").alias("bytes")).join(known, F.col("id") == F.col("l"))
    sized = sized.groupBy("id", "y").agg(F.sum("bytes").cast("long").alias("bytes")).select(F.xxhash64("id").alias("x"), "id", "y", "bytes")
    drawn = bounded_sample(sized, sample, SAMPLE_BYTES)
    got = text.join(F.broadcast(drawn), "id").select("id", "t", "y").orderBy("id", "t").limit(2 * sample).collect()
    x = np.array([statistics(r["t"]) for r in got]).reshape(-1, len(NAMES))
    y = np.array([r["y"] for r in got], np.float64)
    k = 2 * len(NAMES) + 1
    fitted = logistic(x, y) if 0 < y.sum() < len(y) else (np.zeros(k), np.zeros(len(NAMES)), np.ones(len(NAMES)))
    base = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5

    site = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    ev = written_texts(evidence(docs, fitted, [F.col(id_col).alias("id"), site(host).alias("host"), site(path).alias("path")], text_col), "quality-evidence")
    # what the sites know of a document, in millionths: its label, else its evidence
    whole = lambda c: F.round(c * MICRO).cast("long")
    ev = ev.join(known, F.col("id") == F.col("l"), "left").select("id", "host", "path", "p", F.coalesce(F.col("y").cast("long") * MICRO, whole(F.col("p"))).alias("m"))
    ev = written(ev, "quality-known")
    paths = written(ev.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(0.99, max(0.01, total.s / MICRO / total.n)) if total.n else 0.5
    spread = F.lit(mean * (1 - mean))
    kh = strength(hosts.select(F.col("hn").alias("n"), (F.col("hs") / MICRO).alias("s"), spread.alias("spread")), F.lit(mean), "spread")
    sites = paths.join(hosts, "host")
    prior = (F.col("hs") / MICRO + kh * mean) / (F.col("hn") + kh)
    kp = strength(sites.select("n", (F.col("s") / MICRO).alias("s"), prior.alias("prior"), spread.alias("spread")), F.col("prior"), "spread")
    if paths.count() <= BROADCAST_ROWS:
        out = ev.join(F.broadcast(sites), ["host", "path"])
    else:  # a site may hold a third of all rows: its rows are salted, the sites repeated
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = ev.withColumn("salt", F.pmod(F.xxhash64("id", "m"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    others = lambda s, n, prior, k: ((F.col(s) - F.col("m")) / MICRO + k * prior) / (F.col(n) - 1 + k)
    out = out.withColumn("host_posterior", others("hs", "hn", F.lit(mean), kh))
    out = out.withColumn("path_posterior", others("s", "n", F.col("host_posterior"), kp))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = logit(clip(F.col("p"))) - F.lit(float(np.log(base / (1 - base)))) + logit(clip(F.col("path_posterior")))
    score = 1 / (1 + F.exp(-odds))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("p").alias("evidence"), "host_posterior", "path_posterior", score.alias("score"), (score >= 0.5).alias("keep"))
