"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives, texts whatever their label are the unlabelled set. With class prior p and logistic
losses the risk is p E_pos[l(+)] + max(0, E_unl[l(-)] - p E_pos[l(-)]); the second term estimates the risk on clean texts
and is kept from falling below zero, where a classifier would only memorise. Features are words and word beginnings that
positives hold clearly more often than the clean texts do, whose rates are corrected by the same prior; in how many texts a
feature occurs is counted over all texts and all positives that are not held out. Several linear classifiers are fitted in
numpy from different seeds, on bounded samples; a score is the mean of their probabilities.

Defined results: a null text is the empty text and gets the score of no evidence; texts of any length are read whole; rows
are scored one by one, so repeated rows and null ids keep their row, and equal texts have equal scores; in training a
text that a doc_id repeats counts as often as it stands there, and is drawn once; with no confirmed toxic text, or an empty
table, every score is 0 and an empty table gives an empty result; score() keeps all other columns.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import broadcast_below, materialise, modest_batches, rows_of, text_or_empty

#: The bound on what is fitted on: about so many confirmed toxic and so many unlabelled texts, drawn by a hash of row and text.
#: Only chosen features of these texts reach the driver: 4 bytes each, at most MAX_FEATURES a text.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 9_000
#: The size of a classifier: the chosen features of the highest z-scores.
MAX_FEATURES = 20_000
BEGINNINGS = (4, 5)
#: A feature is kept if its rate among positives is so many times its corrected rate among clean texts, with such a z-score.
MIN_RATIO, MIN_Z = 6.0, 4.0
MIN_TEXTS = 5
HELD_OUT = 5
#: Ids of confirmed toxic documents (8 bytes each) that may be broadcast.
POSITIVE_IDS = 1_000_000
#: Features that a task counts before it hands its counts on.
COUNTED = 100_000
#: No word alone may be stronger evidence than this.
MAX_WEIGHT = 12.0
_WORD = re.compile(r"[^\W\d_]+")
#: Words remembered by each Python worker; beyond, a word's weight is computed anew.
REMEMBERED = 200_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model sees: crc32 of the id as text, modulo 5, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def _hashed(kind: str, part: str) -> int:
    return zlib.crc32(f"{kind} {part}".encode()) - (1 << 31)


def word_buckets(word: str) -> list[int]:
    """The hashed features of a word, as signed 32-bit numbers: itself and its beginnings."""
    return [_hashed("w", word), *(_hashed(str(n), word[:n]) for n in BEGINNINGS)]


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and in how many positives, this task has seen each feature."""
    kinds = ["w", *map(str, BEGINNINGS)]
    every: list[Counter] = [Counter() for _ in kinds]
    marked: list[Counter] = [Counter() for _ in kinds]

    def out() -> Iterator[pa.RecordBatch]:
        for kind, seen, toxic in zip(kinds, every, marked, strict=True):
            names = np.fromiter((_hashed(kind, x) for x in seen), np.int32, len(seen))
            counts = (np.fromiter((c[x] for x in seen), np.int64, len(seen)) for c in (toxic, seen))
            yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, counts)], ["feature", "p", "n"])
            seen.clear()
            toxic.clear()

    for batch in rows_of(batches):
        for text, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), strict=True):
            words = text_words(text)
            found = [words, *({w[:n] for w in words} for n in BEGINNINGS)]
            for k, parts in enumerate(found):
                every[k].update(parts)
                if positive:
                    marked[k].update(parts)
        if len(every[0]) > COUNTED:
            yield from out()
    yield from out()


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, p and n: in how many positives and in how many of all rows (text, positive) each feature occurs."""
    return rows.mapInArrow(_count, "feature int, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def choose_features(counts: DataFrame, positives: int, rows: int, prior: float, most: int = MAX_FEATURES) -> np.ndarray:
    """Sorted features that speak for toxicity. The rate among clean texts is (rate in all - prior * rate in positives) / (1 - prior)."""
    rate_p, rate_u = F.col("p") / F.lit(float(positives)), F.col("n") / F.lit(float(rows))
    clean = F.greatest((rate_u - prior * rate_p) / (1 - prior), F.lit(0.5 / rows))
    z = (rate_p - clean) / F.sqrt(rate_p * (1 - rate_p) / positives + rate_u * (1 - rate_u) / rows / (1 - prior) ** 2 + F.lit(1e-12))
    rated = counts.where(F.col("p") >= MIN_TEXTS).select("feature", rate_p.alias("rate"), clean.alias("clean"), z.alias("z"))
    chosen = rated.where((F.col("rate") >= MIN_RATIO * F.col("clean")) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "feature").limit(most)
    return np.sort(np.asarray([r["feature"] for r in chosen.select("feature").collect()], dtype=np.int64))


def _chosen_of(names: np.ndarray):
    """The chosen features of each text, as often as its distinct words have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, of = set(names.tolist()), {}
        for batch in rows_of(batches):
            found = []
            for text in batch.column("text").to_pylist():
                words = text_words(text)
                for w in words:
                    if w not in of:
                        of[w] = [b for b in word_buckets(w) if b in chosen]
                found.append([b for w in sorted(words) for b in of[w]])
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], ["positive", "buckets"])
            if len(of) > REMEMBERED:
                of.clear()

    return run


class Rows:
    """Texts as flat lists of places in the vocabulary."""

    def __init__(self, rows: list[np.ndarray], names: np.ndarray) -> None:
        self.n, self.width = len(rows), len(names)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(self.n), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(names, flat), max(0, self.width - 1))
        known = names[at] == flat if self.width else np.zeros(len(flat), dtype=bool)
        self.flat, self.owner = at[known], owner[known]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.owner], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def risk(positive: Rows, unlabelled: Rows, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk on positives, the estimated risk on clean texts, and the gradient of what a step goes down: their sum, or, where
    the latter is negative, its reverse (weights by feature, then the bias)."""
    fp, fu = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    if clean >= 0:
        gp, gu = np.full(positive.n, -prior / positive.n), _sigmoid(fu) / unlabelled.n
    else:  # step back from the overfit side of the risk
        gp, gu = prior * _sigmoid(fp) / positive.n, -_sigmoid(fu) / unlabelled.n
    return prior * np.logaddexp(0, -fp).mean(), clean, np.append(positive.back(gp) + unlabelled.back(gu), gp.sum() + gu.sum())


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: np.ndarray, prior: float, seed: int = 0, rounds: int = 150, rate: float = 0.05, shrink: float = 5e-4, batches: int = 4) -> tuple[np.ndarray, float]:
    """Weights by feature and a bias that minimise the non-negative risk, by Adam on shuffled batches.

    Each step shrinks weights a little towards 0, and they stay non-negative: a word may speak for toxicity or say nothing,
    so that a long text's many plain words never outweigh what it says.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    parts = [(Rows([positive[i] for i in p_order[k::batches]], names), Rows([unlabelled[i] for i in u_order[k::batches]], names)) for k in range(batches)]
    parts = [(p, u) for p, u in parts if p.n and u.n]
    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            _, _, g = risk(*parts[k], w, prior)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:-1] = np.clip(w[:-1] - shrink, 0.0, MAX_WEIGHT)
    return w[:-1], float(w[-1])


class Model:
    """Fitted classifiers: names are feature hashes, weights has a row for each classifier."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, biases: np.ndarray) -> None:
        self.names, self.weights, self.biases = names, weights, biases
        self.of = {int(h): weights[:, k] for k, h in enumerate(names) if weights[:, k].any()}
        self.words: dict[str, np.ndarray | None] = {}

    def _word(self, word: str) -> np.ndarray | None:
        """The word's weight in each classifier; None if it has none."""
        found = [self.of[h] for h in word_buckets(word) if h in self.of]
        return np.sum(found, axis=0) if found else None

    def scores(self, texts: list[str]) -> list[float]:
        out, seen = [], self.words
        for text in texts:
            if len(seen) >= REMEMBERED:
                seen.clear()
            words = text_words(text)
            for word in words:
                if word not in seen:
                    seen[word] = self._word(word)
            total = self.biases.copy()
            for word in sorted(w for w in words if seen[w] is not None):
                total += seen[word]
            out.append(float(_sigmoid(total).mean()))
        return out


def train(docs: DataFrame, labels: DataFrame, seeds: int = 3, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fits on docs (doc_id, text) whose ids are not held out; labels (doc_id, toxic) name the confirmed toxic ones.

    The prior is the toxic share of the labelled ids that are not held out. None if no such row is toxic.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty().alias("text")).where(~held_out())
    known = labels.select(F.col("doc_id").alias("k_id"), "toxic").where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = materialise(known.groupBy("k_id").agg(F.max("toxic").alias("toxic")), "labelled")
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    if not counts["toxic"]:
        return None
    prior = min(0.5, max(0.005, counts["toxic"] / counts["n"]))
    # Each id stands in this side once, so no row is multiplied.
    toxic = broadcast_below(known.where("toxic = 1").select("k_id"), POSITIVE_IDS)
    rows = docs.join(toxic, F.col("doc_id") == F.col("k_id"), "left").select("doc_id", "text", F.col("k_id").isNotNull().alias("positive"))
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("positive").cast("long")), F.lit(0)).alias("p")).first()
    if not sizes["p"]:
        return None
    names = choose_features(feature_counts(rows.select("text", "positive")), sizes["p"], sizes["n"], prior)
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1_000_003))
    below = lambda most, of: F.lit(int(1_000_003 * min(1.0, most / of)))

    def drawn(pool: DataFrame, salt: int, most: int, of: int, positive: bool) -> DataFrame:
        some = pool.where(place(salt) <= below(most, of)).select("doc_id", "text", place(salt).alias("place"))
        return some.dropDuplicates(["doc_id", "text"]).orderBy("place", "doc_id", "text").limit(2 * most).select("text", F.lit(positive).alias("positive"))

    sample = drawn(rows.where("positive"), 1, max_positive, sizes["p"], True).unionByName(drawn(rows, 2, max_unlabelled, sizes["n"], False))
    found = sample.mapInArrow(_chosen_of(names), "positive boolean, buckets array<int>").toArrow()
    flags = np.asarray(found.column("positive").to_pylist(), dtype=bool)
    every = [np.asarray(x, dtype=np.int32) for x in found.column("buckets").to_pylist()]
    order = sorted(range(len(every)), key=lambda i: (len(every[i]), every[i].tobytes()))  # whatever order the rows came in
    positive, unlabelled = [every[i] for i in order if flags[i]], [every[i] for i in order if not flags[i]]
    if not positive or not unlabelled:
        return None
    fitted = [fit_nnpu(positive, unlabelled, names, prior, seed) for seed in range(seeds)]
    return Model(names, np.stack([w for w, _ in fitted]), np.asarray([b for _, b in fitted]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs with a column toxicity between 0 and 1 (in the place of any such column); all others are kept."""
    docs = docs.drop("toxicity")
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    modest_batches(docs.sparkSession)
    at = docs.columns.index("text")
    parts = (model.names, model.weights, model.biases)  # chosen from the bounded sample, whatever the corpus
    kept = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*parts)
        for batch in rows_of(batches):
            scores = fitted.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, "toxicity"])

    schema = docs.select("*").schema.add("toxicity", "double")
    return docs.mapInArrow(run, schema)
