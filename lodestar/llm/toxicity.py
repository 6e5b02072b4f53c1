"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks (operator 8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 4000, 8000
LANDMARKS, MIN_GAIN, TOP = 96, 12.0, 3
SPAN, DECAY, FLOOR = 5, 0.55, 0.34
CACHE = 400_000
NOT_LETTERS = re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W_]{1,3}[^\W\d_](?![^\W\d_])){2,}")
SENTENCE = re.compile(r"[.!?\n]+(?:\s|\Z)|\n")


def words_of(sentence: str) -> list[str]:
    """The lower-case words of a sentence, letters only; spelled-out words (s p e l l e d, s-p-e-l-l-e-d) are joined."""
    low = sentence.lower()
    if SPACED.search(low):
        low = SPACED.sub(lambda m: NOT_LETTERS.sub("", m[0]), low)
    return [w for w in (NOT_LETTERS.sub("", x) for x in low.split()) if w]


@dataclass
class Kernel:
    """Gap-weighted subsequences of three letters, normalised by the landmark.

    k(w, l) sums, over letter triples that occur in order in both, DECAY to the power of both
    spans; triples spread over more than SPAN letters don't count, so up to two inserted or
    dropped letters are bridged inside a triple. The value over k(l, l), cut to [0, 1] and
    dropped below FLOOR, says how much of the landmark the word holds, whatever surrounds it.
    """

    landmarks: list[str]

    def __post_init__(self) -> None:
        ids: dict[tuple, dict[int, float]] = {}
        for j, l in enumerate(self.landmarks):
            for t, x in self.triples(l).items():
                ids.setdefault(t, {})[j] = x
        self.table = ids
        self.norm = np.array([sum(x * x for x in self.triples(l).values()) for l in self.landmarks])
        self.pairs = {t[:2] for t in ids}

    @staticmethod
    def triples(w: str) -> dict[tuple, float]:
        out: dict[tuple, float] = {}
        for i in range(len(w) - 2):
            for k in range(i + 2, min(i + SPAN, len(w))):
                x = DECAY ** (k - i - 2)
                for j in range(i + 1, k):
                    t = (w[i], w[j], w[k])
                    out[t] = out.get(t, 0.0) + x
        return out

    def raw(self, w: str) -> dict[int, float]:
        """k(w, l) of the landmarks that share a triple with ``w``."""
        table, pairs, out = self.table, self.pairs, {}
        n = len(w)
        for i in range(n - 2):
            a = w[i]
            for j in range(i + 1, min(i + SPAN - 1, n - 1)):
                if (a, w[j]) in pairs:
                    for k in range(j + 1, min(i + SPAN, n)):
                        hit = table.get((a, w[j], w[k]))
                        if hit:
                            x = DECAY ** (k - i - 2)
                            for m, y in hit.items():
                                out[m] = out.get(m, 0.0) + x * y
        return out

    def values(self, w: str) -> dict[int, float]:
        return {m: v for m, x in self.raw(w).items() if (v := min(1.0, x / self.norm[m])) >= FLOOR}

    def matrix(self) -> np.ndarray:
        """The landmarks' kernel among themselves, scaled to ones on the diagonal."""
        k = np.zeros((len(self.landmarks),) * 2)
        for i, l in enumerate(self.landmarks):
            for j, x in self.raw(l).items():
                k[i, j] = x / math.sqrt(self.norm[i] * self.norm[j])
        return k


@dataclass
class ToxicityModel:
    """score(text) = logistic(slopes . the TOP largest sentence margins + shift); margin = weights . z + bias."""

    landmarks: list[str]
    weights: np.ndarray  # the machine's weights folded back through the Nystrom map
    bias: float
    slopes: np.ndarray
    shift: float


class Scorer:
    """Sentence margins with the kernel values of words remembered in a bounded table."""

    def __init__(self, kernel: Kernel) -> None:
        self.kernel, self.seen = kernel, {}

    def word(self, token: str) -> tuple[tuple[int, float], ...]:
        found = self.seen.get(token)
        if found is None:
            letters = token if token.isalpha() else NOT_LETTERS.sub("", token)
            found = tuple(self.kernel.values(letters).items()) if letters == token else self.word(letters) if letters else ()
            if len(self.seen) >= CACHE:
                self.seen.clear()
            if len(token) <= 40:
                self.seen[token] = found
        return found

    def sentences(self, text: str | None) -> Iterator[dict[int, float]]:
        """Landmark values of each sentence that has any: per landmark, its best word's."""
        low = (text or "").lower()
        if SPACED.search(low):
            low = SPACED.sub(lambda m: NOT_LETTERS.sub("", m[0]), low)
        word = self.word
        if not any(map(word, set(low.split()))):
            return
        for sentence in SENTENCE.split(low):
            z: dict[int, float] = {}
            for token in sentence.split():
                for m, v in word(token):
                    if v > z.get(m, 0.0):
                        z[m] = v
            if z:
                yield z


def top_margins(scorer: Scorer, text: str | None, weights: np.ndarray, bias: float) -> list[float]:
    """The TOP largest margins of a text's sentences; a sentence that resembles no landmark has the margin ``bias``."""
    found = sorted((bias + sum(weights[m] * v for m, v in z.items()) for z in scorer.sentences(text)), reverse=True)[:TOP]
    return sorted([*found, *[bias] * TOP], reverse=True)[:TOP]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample of labelled documents that the model learns from.

    Rows with crc32(doc_id) mod 4 = 2 are held out. Of the others up to MAX_TOXIC toxic and
    MAX_CLEAN clean documents of up to MAX_CHARS characters are taken by hash of doc_id.
    """
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where("doc_id is not null and text is not null").where(F.length("text") <= MAX_CHARS).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known = short.join(own, F.col("id") == F.col("doc_id")).select("id", "toxic").distinct()
    ids = [r for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    chosen = F.broadcast(spark.createDataFrame([(r["id"], int(r["toxic"])) for r in ids], "doc_id long, toxic int"))  # at most MAX_TOXIC + MAX_CLEAN rows
    return short.join(chosen, F.col("id") == F.col("doc_id")).select("doc_id", "text", "toxic")


def landmark_candidates(rows: DataFrame, limit: int = 1500) -> list[tuple[str, int, int]]:
    """(letters, toxic documents, clean documents): the pieces of words that toxic documents have most in excess."""
    words = rows.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[\p{Punct}\d]+", " "), r"\s+"))).alias("w")).where("length(w) between 4 and 24")
    pieces = F.flatten(F.transform(F.sequence(F.lit(4), F.least(F.length("w"), F.lit(9))), lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, n))))
    counts = words.select("doc_id", "toxic", F.explode(F.array_distinct(pieces)).alias("g")).distinct().groupBy("g").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    total = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    tox, clean = float(total[0] or 0), float(total[1] or 0)
    if not tox or not clean:
        return []
    expected = (F.col("p") + F.col("n")) * (tox / (tox + clean))
    gain = F.when(F.col("p") > expected, 2 * F.col("p") * F.log(F.col("p") / expected) + 2 * F.col("n") * F.log(F.greatest(F.col("n"), F.lit(0.5)) / (F.col("p") + F.col("n") - expected)))
    best = counts.where("p >= 3").withColumn("gain", gain).where(F.col("gain") > MIN_GAIN).orderBy(F.col("gain").desc(), F.length("g").desc(), "g").limit(limit)
    return [(r["g"], r["p"], r["n"]) for r in best.collect()]


def choose_landmarks(found: list[tuple[str, int, int]], m: int = LANDMARKS) -> list[str]:
    """The best candidates that aren't part of, or largely the same as, one already chosen."""
    chosen: list[str] = []
    spent: dict[str, tuple[int, int]] = {}
    for g, p, n in found:
        if len(chosen) >= m:
            break
        rival = next((c for c in chosen if g in c or c in g), None)
        if rival and (rival in g or spent[rival][0] >= 0.5 * p):
            continue
        if any(v > 0.8 for v in Kernel(chosen[-24:]).values(g).values()) if chosen else False:
            continue
        chosen.append(g)
        spent[g] = (p, n)
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 60) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent; y is -1 or 1."""
    rng = np.random.default_rng(5)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    square = (x**2).sum(1) + 1e-12
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(docs: DataFrame, labels: DataFrame, max_sentences: int = 6000) -> ToxicityModel:
    """Learn landmarks, machine and calibration from ``labels(doc_id, toxic)``.

    Sentences carry their document's label; in a toxic document only the sentence with the
    largest margin does, chosen anew after each fit, for most of its sentences are clean.
    Without both labels, or with nothing that tells them apart, every score is the share of
    toxic labels (0 without labels).
    """
    rows = training_rows(docs, labels)
    counts = {r["toxic"]: r["count"] for r in labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    flat = ToxicityModel([], np.zeros(0), 0.0, np.zeros(TOP), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    landmarks = choose_landmarks(landmark_candidates(rows))
    if not landmarks:
        return flat
    kernel = Kernel(landmarks)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kernel)
        for batch in batches:
            ids, label, ms, vs = [], [], [], []
            for doc_id, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for z in list(scorer.sentences(text)) or [{}]:
                    ids.append(doc_id)
                    label.append(y)
                    ms.append(list(z))
                    vs.append(list(z.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(ms, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float64()))], names=["doc_id", "toxic", "m", "v"])

    got = rows.mapInArrow(features, "doc_id long, toxic int, m array<int>, v array<double>").orderBy("doc_id", "m", "v").collect()
    z = np.zeros((len(got), len(landmarks)))
    for i, r in enumerate(got):
        z[i, r["m"]] = r["v"]
    doc, y = np.array([r["doc_id"] for r in got]), np.array([r["toxic"] for r in got])
    values, vectors = np.linalg.eigh(kernel.matrix())
    keep = values > 1e-3
    to_phi = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.column_stack([z @ to_phi, np.ones(len(z))])
    prior_margin = z.sum(1)
    hidden = np.flatnonzero(y == 0)
    hidden = hidden[np.argsort(-prior_margin[hidden], kind="stable")][:max_sentences]
    margin, w = prior_margin, np.zeros(phi.shape[1])
    for _ in range(3):
        order = np.lexsort((-margin, doc))
        first = order[np.append(True, doc[order[1:]] != doc[order[:-1]])]
        shown = first[(y[first] == 1) & (prior_margin[first] > 0)]
        if not len(shown) or not len(hidden):
            return flat
        rows_used = np.concatenate([shown, hidden])
        target = np.where(y[rows_used] == 1, 1.0, -1.0)
        w = fit_svm(phi[rows_used], target, np.where(target > 0, 10.0, 10.0))
        margin = phi @ w
    weights, bias = to_phi @ w[:-1], float(w[-1])
    order = np.lexsort((-margin, doc))
    starts = np.flatnonzero(np.append(True, doc[order[1:]] != doc[order[:-1]]))
    top = np.full((len(starts), TOP), bias)
    for k in range(TOP):
        at = starts + k
        own = at < np.append(starts[1:], len(order))
        top[own, k] = np.maximum(margin[order[at[own]]], bias)
    label = y[order[starts]]
    share = label.mean()
    case = np.where(label == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    slopes, shift = calibrate(top, label, case)
    return ToxicityModel(landmarks, weights, bias, slopes, shift)


def calibrate(x: np.ndarray, y: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic fit of labels on margins (Newton steps, lightly regularised); slopes aren't negative."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.append(np.full(x.shape[1], 0.5), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (case * (y - p)) - ridge * w
        h = (a * (case * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        new = w + np.clip(np.linalg.solve(h, g), -2, 2)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def score_of(text: Column, model: ToxicityModel) -> Column:
    """The toxicity of a text, 0 to 1, as a column; no shuffle.

    A score reads the text alone. Null and empty texts score like a text that resembles no
    landmark. Rows are independent, so repeated rows agree, and an empty table gives none.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _scores(model, batches)

    return F.pandas_udf(run, T.DoubleType())(text.cast("string"))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs(doc_id, text)``; predicted is 1 from ``threshold`` on."""
    scored = docs.select("doc_id", score_of(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)))


_SCORERS: dict[tuple[str, ...], Scorer] = {}


def _scores(model: ToxicityModel, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    key = tuple(model.landmarks)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(Kernel(model.landmarks))
    for texts in batches:
        top = np.array([top_margins(_SCORERS[key], t if isinstance(t, str) else None, model.weights, model.bias) for t in texts], np.float64).reshape(-1, TOP)
        yield pd.Series(1 / (1 + np.exp(-np.clip(top @ model.slopes + model.shift, -30, 30))))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays under the threshold; same columns."""
    return docs.where(score_of(F.col("text"), fit(docs, labels)) < threshold)
