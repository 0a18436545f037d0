"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings, each the sum of those of the word, its beginnings
and its end; filters of several widths slide over the whole text; each filter's
maximum over all positions feeds a logistic output. Scores
are calibrated by language, where the language is guessed from the text's own
function words: each group's threshold is moved to the common 0.7.

Training reads a bounded sample of labelled rows on the driver; scoring covers
every row and whole texts inside tasks.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm._shared import bounded_sample, held_out, kept, tidy

#: The bounded sample of training: labelled rows at most, bytes of their texts in all and of one text.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 6_000, 48 << 20, 1 << 20
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
THRESHOLD = 0.7
#: Texts that a word must be in to have an embedding; pseudo-texts that shrink its odds; share of words dropped in training.
RARE, SHRINK, DROP = 4, 3.0, 0.2
#: Documents of a training step, and words laid side by side at most (one text at least).
BATCH, WORDS_AT_ONCE = 64, 1 << 17
#: Words scored at a time, and distinct words a worker remembers.
CHUNK, CACHE = 1 << 17, 200_000
STRIP = ".,;:!?\"'()[]{}<>|*#$%&…«»“”„’-"

#: Function words that tell the calibration group of a text (fixed values).
GROUPS = {
    "en": "the of and to in is that for it was",
    "fr": "le la les de des et un une est dans que pour",
    "de": "der die das und ist ein eine mit zu von den nicht",
    "es": "el los las y en que por una con para del al",
}
_VOTES: dict[str, list[int]] = {}
for _i, _ws in enumerate(GROUPS.values()):
    for _w in _ws.split():
        _VOTES.setdefault(_w, []).append(_i)
#: Places of the filters' parts side by side: (width, offset) in order.
PARTS = [(w, j) for w in WIDTHS for j in range(w)]
CHANNELS = 4


def hashed(word: str) -> tuple[int, ...]:
    """Hashes of a word's channels; none for a word that is only marks."""
    w = word.strip(STRIP).lower()
    if not w:
        return ()
    crc = lambda kind, part: zlib.crc32(part.encode(), kind)
    return (crc(1, w), crc(2, w[:4]), crc(3, w[:5]), crc(4, w[-4:])) if len(w) > 4 else (crc(1, w),)


def votes(word: str) -> list[int]:
    out = [0] * len(GROUPS)
    for g in _VOTES.get(word.strip(STRIP).lower(), ()):
        out[g] = 1
    return out


@dataclass
class Cnn:
    rows: dict[int, int]  # hash to row of emb; row 0 is no word
    emb: np.ndarray
    filters: list[np.ndarray]  # a width w: w x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray | None = None  # by group, the logit that means THRESHOLD

    def encode(self, words: list[str]) -> np.ndarray:
        """Rows of each word's channels, 0 for unknown ones."""
        out = np.zeros((len(words), CHANNELS), np.int32)
        for i, w in enumerate(words):
            for c, h in enumerate(hashed(w)):
                out[i, c] = self.rows.get(h, 0)
        return out

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each offset, side by side."""
        wide = np.concatenate([self.filters[WIDTHS.index(w)][j] for w, j in PARTS], axis=1)
        return (self.emb[rows].sum(1) @ wide).astype(np.float32)

    def logit(self, parts: np.ndarray) -> float:
        top, _ = pooled(parts, np.arange(1, len(parts)))
        return float(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)


def pooled(parts: np.ndarray, ids: np.ndarray, places: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima of all filters over a text (rows ``ids`` of ``parts``), and where they
    are. Row 0 is no word; texts are padded with it so that every width has a place.
    ``places`` limits where filters begin, for a piece that others follow."""
    tops, at = [], []
    padded = np.concatenate([ids, np.zeros(max(WIDTHS), ids.dtype)])
    for w in WIDTHS:
        n, best, where = places or len(ids) + 1, None, None
        for lo in range(0, n, CHUNK):
            hi, s = min(n, lo + CHUNK), None
            for j in range(w):
                p = PARTS.index((w, j)) * FILTERS
                x = parts[padded[lo + j : hi + j], p : p + FILTERS]
                s = x if s is None else s + x
            k = s.argmax(0)
            m = s[k, np.arange(FILTERS)]
            if best is None:
                best, where = m, k + lo
            else:
                better = m > best
                best, where = np.where(better, m, best), np.where(better, k + lo, where)
        tops.append(best), at.append(where)
    return np.concatenate(tops), at


def lay(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of several texts side by side, each followed by no words; where each
    begins; and the places where a filter may begin, as in :func:`pooled`."""
    gap = np.zeros((max(WIDTHS), CHANNELS), np.int32)
    rows = np.concatenate([x for d in docs for x in (d, gap)])
    length = np.array([len(d) for d in docs])
    starts = np.r_[0, np.cumsum(length + len(gap))[:-1]]
    ok = np.ones(len(rows), bool)
    ok[(starts[:, None] + length[:, None] + np.arange(1, len(gap))).ravel()] = False
    return rows, starts, ok


def tops(model: Cnn, rows: np.ndarray, starts: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Maxima of all filters over each text, the places of the first ones, the words' sums."""
    x = sum(model.emb[rows[:, c]] for c in range(CHANNELS))
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    found, at, place = [], [], np.arange(len(rows))[:, None]
    for k, w in enumerate(WIDTHS):
        s = x @ model.filters[k][0]
        for j in range(1, w):
            s[:-j] += x[j:] @ model.filters[k][j]
        s[~ok] = -np.inf
        top = np.maximum.reduceat(s, starts)
        at.append(np.minimum.reduceat(np.where(s == top[of], place, len(rows)), starts))
        found.append(top)
    return np.concatenate(found, axis=1), at, x


def pieces(docs: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of texts that are laid out together."""
    out, words = [], 0
    for i, d in enumerate(docs):
        if out and words + len(d) > WORDS_AT_ONCE:
            yield out
            out, words = [], 0
        out.append(i)
        words += len(d)
    if out:
        yield out


def logits(model: Cnn, docs: list[np.ndarray]) -> np.ndarray:
    out = [np.maximum(tops(model, *lay([docs[i] for i in part]))[0] + model.bias, 0) @ model.out + model.out_bias for part in pieces(docs)]
    return np.concatenate([np.zeros(0), *out])


def gradients(model: Cnn, docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean logistic loss: by output weights and bias, filter biases, filters, and
    the embeddings of the rows that filters picked (numbers, then gradients)."""
    d_o, d_ob, d_b, d_f = np.zeros_like(model.out), 0.0, np.zeros_like(model.bias), [np.zeros_like(f) for f in model.filters]
    picked, moves = [np.zeros(0, np.int64)], [np.zeros((0, DIM))]
    for part in pieces(docs):
        rows, starts, ok = lay([docs[i] for i in part])
        top, at, x = tops(model, rows, starts, ok)
        z = top + model.bias
        h = np.maximum(z, 0)
        err = (1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30))) - y[part]) / len(docs)
        d_o += err @ h
        d_ob += float(err.sum())
        back = err[:, None] * model.out * (z > 0)
        d_b += back.sum(0)
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                place = at[k] + j
                d_f[k][j] += np.einsum("bfd,bf->df", x[place], g)
                own = rows[place]  # texts x filters x channels
                picked.append(own.ravel())
                moves.append(np.repeat((g[:, :, None] * model.filters[k][j].T).reshape(-1, DIM), CHANNELS, axis=0))
    picked, moves = np.concatenate(picked), np.concatenate(moves)
    some = (picked > 0) & moves.any(1)
    number, of = np.unique(picked[some], return_inverse=True)
    d_e = np.stack([np.bincount(of, moves[some, d], len(number)) for d in range(DIM)], axis=1) if len(number) else np.zeros((0, DIM))
    return d_o, d_ob, d_b, d_f, number, d_e


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 8, seed: int = 1, rate: float = 0.03) -> Cnn:
    """Adagrad on the logistic loss, with word dropout; the epoch with the least loss
    on a left-out fifth stays.

    One filter starts from the words' shrunk log odds, so that training begins near
    a word-list classifier. Words of fewer than ``RARE`` texts have no embedding:
    names are not learnt by heart. :func:`fit` leaves copies out.
    """
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float64)
    hold = np.arange(len(texts)) % 5 == 4
    fit, held = np.flatnonzero(~hold), np.flatnonzero(hold)
    number: dict[str, int] = {}
    words = [np.fromiter((number.setdefault(w, len(number)) for w in (t or "").split()), np.int64) for t in texts]
    # distinct hashes of all words' channels, and the channels of each word among them
    all_hashes = np.full((len(number), CHANNELS), -1, np.int64)
    for w, i in number.items():
        h = hashed(w)
        all_hashes[i, : len(h)] = h
    hashes, own = np.unique(np.append(all_hashes, -1), return_inverse=True)  # the first is no word
    own = own[:-1].reshape(-1, CHANNELS)
    counts = np.zeros((len(hashes), 2))
    for i in fit:
        seen = np.unique(own[np.unique(words[i])])
        counts[seen] += (1, y[i])
    counts[0] = 0
    rows = np.flatnonzero(counts[:, 0] >= RARE)
    n = np.concatenate([np.zeros((1, 2)), counts[rows]])
    row_of = np.zeros(len(hashes), np.int32)
    row_of[rows] = np.arange(1, len(rows) + 1)
    known = hashes[rows].tolist()
    base = float((y[fit].sum() + 1) / (len(fit) + 2))
    prior = float(np.log(base / (1 - base)))
    share = (n[:, 1] + SHRINK * base) / (n[:, 0] + SHRINK)
    emb = rng.normal(0, 0.05, (len(n), DIM))
    emb[:, 0] = np.log(share / (1 - share)) - prior
    emb[0] = 0
    model = Cnn({h: i + 1 for i, h in enumerate(known)}, emb, [rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.05, len(WIDTHS) * FILTERS), prior - 2)
    model.filters[0][0, :, 0] = np.eye(DIM)[0]
    model.out[0] = 1.0
    docs = [row_of[own[w]] for w in words]
    g_e, g_f, g_b, g_o, g_ob = np.full_like(emb, 1e-2), [np.full_like(f, 1e-2) for f in model.filters], np.full_like(model.bias, 1e-2), np.full_like(model.out, 1e-2), 1e-2
    best, least = None, np.inf
    left_out = [docs[i] for i in held]
    for epoch in range(epochs + 1):
        z = logits(model, left_out)
        loss = float(np.logaddexp(0, np.where(y[held] == 1, -z, z)).mean()) if len(z) else -float(epoch)
        if loss < least:
            best, least = copy.deepcopy(model), loss
        if epoch == epochs:
            break
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            if not len(batch):
                continue
            d_o, d_ob, d_b, d_f, rows, d_e = gradients(model, [docs[i][rng.random(len(docs[i])) >= DROP] for i in batch], y[batch])
            step = lambda x, d, g: x - rate * d / np.sqrt(g)
            g_o += d_o**2
            g_ob += d_ob**2
            g_b += d_b**2
            model.out, model.out_bias, model.bias = step(model.out, d_o, g_o), float(step(model.out_bias, d_ob, g_ob)), step(model.bias, d_b, g_b)
            for k in range(len(WIDTHS)):
                g_f[k] += d_f[k] ** 2
                model.filters[k] = step(model.filters[k], d_f[k], g_f[k])
            g_e[rows] += d_e**2
            model.emb[rows] = step(model.emb[rows], d_e, g_e[rows])
    model = best or model
    calibrate(model, logits(model, left_out), np.array([group_of((texts[i] or "").split()) for i in held], int), y[held])
    return model


def group_of(words: list[str]) -> int:
    """The group with most votes (ties: the first); len(GROUPS) without any."""
    return vote(np.array([votes(w) for w in words]).reshape(-1, len(GROUPS)).sum(0))


def vote(v: np.ndarray) -> int:
    return int(v.argmax()) if v.max() > 0 else len(GROUPS)


def calibrate(model: Cnn, z: np.ndarray, groups: np.ndarray, y: np.ndarray) -> None:
    """Per group the cut with the best F1 on rows that training left out; groups
    of fewer than 10 toxic rows use the cut of all rows."""

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z)
        tp = np.cumsum(y[order])
        f1 = 2 * tp / (np.arange(1, len(z) + 1) + y.sum())
        k = int(f1.argmax())
        after = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 2
        return float((z[order[k]] + after) / 2)

    common = cut(z, y) if y.sum() else 0.0
    model.shift = np.array([cut(z[groups == g], y[groups == g]) if y[groups == g].sum() >= 10 else common for g in range(len(GROUPS) + 1)])


class Words:
    """The distinct words that a worker has met: row, filter parts and votes of each;
    forgets all when full."""

    def __init__(self, model: Cnn):
        self.model, self.at = model, {}
        self.parts = np.zeros((CACHE + 1, len(PARTS) * FILTERS), np.float32)
        self.votes = np.zeros((CACHE + 1, len(GROUPS)), np.int32)

    def __call__(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = list(dict.fromkeys(words))
        if len(new) > CACHE:
            raise ValueError(f"more than {CACHE} distinct words at once")
        if new:
            lo = len(self.at) + 1
            self.at.update(zip(new, range(lo, lo + len(new))))
            self.parts[lo : lo + len(new)] = self.model.parts(self.model.encode(new))
            self.votes[lo : lo + len(new)] = [votes(w) for w in new]
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def score_text(words: Words, text: str | None) -> tuple[float, int]:
    """Logit and group of a whole text, a bounded number of words at a time. Pieces
    overlap by the widest filter, so that no place is lost between them."""
    m, all_words = words.model, (text or "").split()
    top, v = None, np.zeros(len(GROUPS), np.int64)
    for lo in range(0, max(1, len(all_words)), CHUNK):
        ids = words(all_words[lo : lo + CHUNK + max(WIDTHS) - 1])
        t, _ = pooled(words.parts, ids, CHUNK if lo + CHUNK < len(all_words) else None)
        top = t if top is None else np.maximum(top, t)
        v += words.votes[ids[:CHUNK]].sum(0)
    return float(np.maximum(top + m.bias, 0) @ m.out + m.out_bias), vote(v)


def score_texts(docs: DataFrame, model: Cnn, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus ``score``. Null and empty texts score as texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    fields = ", ".join([f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["score double"])
    lift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(key, lambda: Words(sent.value))
        for b in batches:
            got = [score_text(words, t.as_py()) for t in b.column("t")]
            z = np.array([x - words.model.shift[g] + lift for x, g in got])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], [*b.schema.names[:-1], "score"])

    return src.mapInArrow(lambda it: tidy(run(it)), fields).toDF(*keep, "score")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Cnn:
    """Train on at most ``sample`` labelled rows outside the held-out third, within the
    bounds in bytes; longer texts are passed over. Labels that are null or of an unknown
    id are left out; an id with several labels counts with its largest. Copies, texts equal
    but for case and white space and of one label, count once. Without both classes every
    score is the base rate's."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y")).where(~held_out("i"))
    text = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.col("i").isNotNull() & ~held_out("i"))
    digest = F.md5(F.trim(F.lower(F.regexp_replace("t", r"\s+", " "))).cast("binary")).alias("h")
    sized = text.select("i", F.octet_length("t").cast("long").alias("bytes"), digest).where(F.col("bytes") <= TEXT_BYTES)
    once = sized.join(known, "i").groupBy("h", "y").agg(F.min(F.struct(F.xxhash64("i").alias("x"), "i", "bytes")).alias("r"))
    drawn = bounded_sample(once.select("r.x", "r.i", "h", "y", "r.bytes"), sample, SAMPLE_BYTES)
    got = text.join(F.broadcast(drawn.select("i").distinct()), "i").withColumn("h", digest).join(F.broadcast(drawn), ["i", "h"])
    got = got.groupBy("i", "h", "y").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "h", "y").collect()
    return train([r["t"] for r in got], np.array([r["y"] for r in got], np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row; repeated rows repeat."""
    scored = score_texts(docs, fit(docs, labels, id_col, text_col), [id_col], text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
