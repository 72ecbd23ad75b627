"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; all other documents of the training folds, whatever
their label, are the unlabelled U, of which a part pi is toxic.  The classifier minimises
    pi E_P[l(+)] + max(0, E_U[l(-)] - pi E_P[l(-)])
with the logistic loss l; where a batch drives the second term below zero, the step goes the other way
(Kiryo et al. 2017).  pi follows from the counts of the whole table: of labelled documents the toxic
part, times the unlabelled documents, over all of U.

Features are the distinct words of the whole text, lower-cased, and of each word its first 4, 5 and 6
letters, hashed to `FEATURES` places; only those that positives have far more often than U take part; a
document's logit is the sum of its words' weights.  The model is fitted with numpy on at most
`POSITIVES` and `UNLABELLED` documents, chosen by a hash of their ids among all, however long they are.
Their features are found and counted in Spark; of each document only the features that take part reach
the driver, `FEATURES` bytes of counts and 4 bytes a feature of a fitted document at most.  Documents
that agree in the `SIGNATURE` smallest features in a scattered order, copies and near copies, share the
weight of one.  A shift of the logits puts the best cut between P and U at a score of `THRESHOLD`; it is
found from the scores of all rows of the training folds, counted in steps of 1/`STEPS` of a logit, so it
does not depend on the sizes of the sample.  Scoring covers every document and shuffles nothing.

Held out: rows whose crc32 of the id as text leaves 1 on division by 3; they are never fitted on.
Defined cases: a null text is empty, and an empty text gets the score of the bias; a null id counts as
an empty text in the hash; a document with several labels is toxic if one of them says so; without
positives or without others in the training folds every score is 0; of rows with the same id the smallest text is
fitted on, and each is scored for itself; other columns are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import cut, texts_in_small_batches, without, written

FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
POSITIVES, UNLABELLED = 2_500, 8_000
THRESHOLD = 0.7
EPOCHS, BATCHES, RATE, DECAY = 20, 30, 0.05, 1e-5
SEED = 11
SIGNATURE = 4
LEAST, MOST = 3.0, 12.0
#: The weight of a document without copies, shared evenly by copies; whole numbers sum alike in any order.
WHOLE = 1 << 20
#: Logits are counted in this many steps a unit, up to FARTHEST either way.
STEPS, FARTHEST = 1024, 60
#: Words whose weights a Python worker remembers for one task.
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    parts = [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


# ---- fitting

@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum())


def _logits(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of documents (arrays of features), with the features joined and each one's document."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.bincount(owner, weights=weights[flat], minlength=len(rows)) + bias, flat, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def evidence(positive: np.ndarray, unlabelled: np.ndarray, n_positive: float, n_unlabelled: float) -> np.ndarray:
    """Each feature's scale: how many standard deviations more positives have it than U lets expect, from `LEAST` (below it 0) to `MOST`, over `MOST`.

    Given are how many of P and U have each feature, and how many there are."""
    expected = unlabelled * (n_positive / n_unlabelled)
    z = (positive - expected) / np.sqrt(expected + 1)
    return np.where(z >= LEAST, np.minimum(z, MOST) / MOST, 0.0)


def slopes(p: np.ndarray, u: np.ndarray, of_p: np.ndarray, of_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the logits of P and U and their weights, each summing to 1: the estimate of the risk of negatives, and what to follow downhill, by each logit.

    That is the slope of the whole risk where the estimate is not negative, else of the estimate, turned round."""
    negative = float(of_u @ np.logaddexp(0, u) - prior * (of_p @ np.logaddexp(0, p)))
    # d l(+)/dz = -sigmoid(-z), d l(-)/dz = sigmoid(z)
    if negative >= 0:
        return negative, prior * of_p * (-_sigmoid(-p) - _sigmoid(p)), of_u * _sigmoid(u)
    return negative, prior * of_p * _sigmoid(p), -of_u * _sigmoid(u)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, scale: np.ndarray, of_p: np.ndarray | None = None, of_u: np.ndarray | None = None) -> Model:
    """nnPU with Adam over rows of features with a scale, and their weights (none: alike); each batch has its share of both."""
    if not positive or not unlabelled:
        return Model(np.zeros(FEATURES), -1e9)
    of_p, of_u = (np.ones(len(rows)) if w is None else w for rows, w in ((positive, of_p), (unlabelled, of_u)))
    rng = np.random.default_rng(SEED)
    weights = np.zeros(FEATURES + 1)
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    batches = max(1, min(BATCHES, len(positive), len(unlabelled)))
    step = 0
    for _ in range(EPOCHS * BATCHES // batches):
        for own, other in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True):
            scaled = np.append(weights[:-1] * scale, 0)
            p, p_flat, p_owner = _logits([positive[k] for k in own], scaled, weights[-1])
            u, u_flat, u_owner = _logits([unlabelled[k] for k in other], scaled, weights[-1])
            _, dp, du = slopes(p, u, of_p[own] / of_p[own].sum(), of_u[other] / of_u[other].sum(), prior)
            gradient = np.bincount(p_flat, weights=dp[p_owner], minlength=FEATURES + 1) + np.bincount(u_flat, weights=du[u_owner], minlength=FEATURES + 1)
            gradient[:-1] = gradient[:-1] * scale + DECAY * weights[:-1]
            gradient[-1] = dp.sum() + du.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(weights[:-1] * scale, 0.0)


def placed(cut_: float) -> float:
    """The bias that gives this logit a score of THRESHOLD."""
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut_)


def cut_off(at: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, width: float = 0.0) -> float:
    """The logit that scores THRESHOLD: with the largest recall squared over the part of all documents found (Lee and Liu 2003), halfway down to the next lower one.

    at: ascending logits, or lower ends of steps so wide, with how many P and U each has."""
    recall = np.cumsum(positive[::-1])[::-1] / positive.sum()
    found = np.cumsum((positive + unlabelled)[::-1])[::-1] / (positive.sum() + unlabelled.sum())
    best = int(np.argmax(np.where(positive > 0, recall**2 / found, 0)))
    return float((at[best] + at[best - 1] + width) / 2 if best else at[best] - 1)


def signature(features: np.ndarray) -> bytes:
    """The `SIGNATURE` smallest features in a scattered order."""
    scattered = (features.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.sort(scattered)[:SIGNATURE].astype("<u8").tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(sorted({f for w in words_of(text.as_py() or "") for f in word_features(w)}), np.int32) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([signature(f) for f in found], pa.binary()), pa.array(found, pa.list_(pa.int32()))], names=["positive", "signature", "features"])


def _taking_part(batches: Iterator[pa.RecordBatch], takes_part: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(x.as_py(), np.int32) for x in batch.column("features")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("weight"), pa.array([x[takes_part[x]] for x in rows], pa.list_(pa.int32()))], names=["positive", "weight", "features"])


def fitted(rows: DataFrame, prior: float) -> Model:
    """A model from rows (positive, text)."""
    rows = cut(rows.mapInArrow(_features, "positive boolean, signature binary, features array<int>"))
    alike = rows.groupBy("positive", "signature").agg(F.count("*").alias("copies"))
    rows = cut(rows.join(alike, ["positive", "signature"]).select("positive", F.floor(F.lit(WHOLE) / F.col("copies")).alias("weight"), "features"))
    positive = F.when(F.col("positive"), F.col("weight")).otherwise(0)
    sums = [F.sum(positive).alias("p"), F.sum(F.col("weight") - positive).alias("u")]
    p, u = rows.agg(*sums).first()
    if not p or not u:
        return fit([], [], prior, np.zeros(FEATURES))
    counts = rows.select("positive", "weight", F.explode("features").alias("feature")).groupBy("feature").agg(*sums).toArrow()  # FEATURES rows at most
    of_p, of_u = np.zeros(FEATURES), np.zeros(FEATURES)
    at = counts.column("feature").to_numpy()
    of_p[at], of_u[at] = counts.column("p").to_numpy() / WHOLE, counts.column("u").to_numpy() / WHOLE
    scale = evidence(of_p, of_u, p / WHOLE, u / WHOLE)
    table = rows.mapInArrow(partial(_taking_part, takes_part=scale > 0), "positive boolean, weight long, features array<int>").toArrow()
    held = sorted(zip(table.column("positive").to_pylist(), table.column("features").to_pylist(), table.column("weight").to_pylist(), strict=True))
    side = {flag: [(np.array(x, np.int32), w) for is_p, x, w in held if is_p == flag] for flag in (True, False)}
    return fit(*([x for x, _ in side[k]] for k in (True, False)), prior, scale, *(np.array([w for _, w in side[k]], float) for k in (True, False)))


def untuned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame | None]:
    """A model from docs and labels (doc_id, toxic), without the held-out rows and without its cut; and of the training folds (id, positive), one row per id (none: nothing to learn from)."""
    texts_in_small_batches(docs)
    ids = docs.select(docs[id_col].alias("id")).where(~held_out(F.col("id"))).distinct()
    known = labels.select(labels["doc_id"].alias("label_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic is not null")
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    ids = cut(ids.join(known, F.col("id") == F.col("label_id"), "left").select("id", "toxic"))
    counts = ids.agg(F.count("*"), F.count("toxic"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    total, labelled, toxic = counts
    if not toxic or total == toxic:
        return fit([], [], 0, np.zeros(FEATURES)), None
    prior = toxic / labelled * (total - labelled) / (total - toxic)
    positive = F.coalesce(F.col("toxic") == 1, F.lit(False))
    order = F.xxhash64("id", F.lit(SEED))
    chosen = ids.where(positive).orderBy(order, "id").limit(POSITIVES).unionByName(ids.where(~positive).orderBy(order, "id").limit(UNLABELLED))
    chosen = F.broadcast(chosen.select(F.col("id").alias("chosen"), positive.alias("positive")))  # POSITIVES + UNLABELLED rows at most
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(chosen, F.col("id").eqNullSafe(F.col("chosen")))
    texts = texts.groupBy("id", "positive").agg(F.min("text").alias("text"))  # one row per chosen id
    return fitted(texts.select("positive", "text"), prior), ids.select("id", positive.alias("positive"))


def _logit_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    words = _Words(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("id"), pa.array(words.logits(batch.column("text")), pa.float64())], names=["nth", "id", "logit"])


def logits(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(nth, id, logit) of all rows, written down; nth is the row's monotonically_increasing_id().  Texts go to Python once and don't come back."""
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    return written(rows.mapInArrow(partial(_logit_rows, model=model), f"nth long, id {rows.schema['id'].dataType.simpleString()}, logit double"))


def tuned(model: Model, found: DataFrame, ids: DataFrame | None) -> Model:
    """The model with its cut, from the logits (id, logit) of all rows of the training folds, in steps."""
    if ids is None:
        return model
    step = F.floor(F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), F.col("logit"))) * STEPS).alias("step")
    steps = found.where(~held_out(F.col("id"))).groupBy("id", step).agg(F.count("*").alias("n"))
    known = ids.select(F.col("id").alias("own"), "positive")
    both = steps.join(known, F.col("id").eqNullSafe(F.col("own"))).groupBy("step").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
    counts = both.toArrow().sort_by("step")  # 2 * FARTHEST * STEPS + 1 rows at most
    at, p, n = (counts.column(c).to_numpy() for c in ("step", "p", "n"))
    return replace(model, bias=placed(cut_off(at / STEPS, p, n - p, 1 / STEPS))) if p.any() else model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(nth, id, score) of all rows of docs by a model trained on them: each text is read by Python once for its score."""
    model, ids = untuned(docs, labels, id_col, text_col)
    found = logits(docs, model, id_col, text_col)
    bias = tuned(model, found, ids).bias
    logit = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("logit") + F.lit(float(bias) if ids is not None else -60.0)))
    return found.select("nth", "id", F.when(F.lit(ids is None), 0.0).otherwise(1 / (1 + F.exp(-logit))).alias("score"))


# ---- scoring

class _Words(dict):
    """Words' weights; half of what is remembered goes at a time, and words in use come over from it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.earlier: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED // 2:
            self.earlier = dict(self)
            self.clear()
        value = self.earlier.get(word)
        self[word] = value = self.model.word(word) if value is None else value
        return value

    def logits(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.model.bias + sum(map(self.__getitem__, sorted(words_of(t.as_py() or "")))) for t in texts])


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with a score under THRESHOLD, with all their columns."""
    found = scored(docs, labels, id_col, text_col).where(F.col("score") >= THRESHOLD).select("nth")
    return without(docs, cut(found))
