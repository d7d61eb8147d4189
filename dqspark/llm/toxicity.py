"""Toxicity of documents: a recurrent network over all overlapping windows, trained from labels."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.llm import gru
from dqspark.llm.common import unboxed

WINDOW, STRIDE = 32, 24        # words of a window, and words between the starts of two
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500   # labelled rows a model is fitted on at most
SAMPLE_CHARS = 30_000          # longer texts are not among them (they are scored like others)
CLEAN_WINDOWS = 8              # windows of a clean text used in one epoch
BATCH, RATE = 256, 0.01
ROUNDS, STEPS = 3, 300           # at least so many rounds over the windows, and updates of the network
WINDOWS_AT_ONCE = 4096
VOCABULARY = 150_000           # words a task remembers between batches


def held_out(key: Column) -> Column:
    """True for the fifth of the keys that no model is fitted on; false for a null key."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``text`` and ``toxic`` of a bounded, reproducible sample of the labelled rows that are not held out.

    Of rows with several labels the larger counts. Rows of either class are taken in the order of a hash.
    """
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("k")).agg(F.max(labels[label]).alias("toxic"))
    own = docs.select(docs[key].alias("k"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("digest")).where(
        ~held_out(F.col("k")) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # texts are fetched for the chosen keys alone, which are few whatever the size of the tables
    rows = own.select("k", "digest").distinct().join(known, "k").withColumn("h", F.xxhash64(F.lit(7), "k"))
    chosen = [rows.where(F.col("toxic") == c).orderBy("h", "k", "digest").limit(n).select("k", "digest", "toxic")
              for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    return own.join(F.broadcast(chosen[0].union(chosen[1])), ["k", "digest"]).dropDuplicates(["k", "digest"]).select("text", "toxic")


def windows_of(places: Sequence[int]) -> np.ndarray:
    """All windows of a text as rows of word places; a text without words has one empty window."""
    n = len(places)
    count = 1 if n <= WINDOW else -(-(n - WINDOW) // STRIDE) + 1
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
    padded[:n] = places
    return padded[np.arange(count)[:, None] * STRIDE + np.arange(WINDOW)]


def summary(odds: np.ndarray) -> np.ndarray:
    """What the verdict on a text is made of: how high and how many of its windows are."""
    hit = gru.sigmoid(odds - 2.0)
    return np.array([1.0, odds.max() / 4, odds.mean() / 4, np.log1p(hit.sum()), np.log(hit.mean() + 0.01),
                     np.log(len(odds)), np.log1p(hit.sum()) * np.log(len(odds)) / 4], np.float64)


class Model:
    """The network's parameters and the weights of the text's summary; picklable."""

    def __init__(self, p: dict | None, weights: np.ndarray | None, rate: float):
        self.p, self.weights, self.rate = p, weights, rate

    def scores(self, texts: Sequence[str | None], words: gru.Vocabulary, gates: np.ndarray | None) -> tuple[list[float], np.ndarray | None]:
        """A score for each text; ``words`` and ``gates`` carry over what is known of words from call to call."""
        if self.p is None:
            return [self.rate] * len(texts), None
        parts = [windows_of(words.places((t or "").split())) for t in texts]
        known = 0 if gates is None else len(gates)
        if known < len(words.words):
            new = gru.new_gates(self.p, words, known)
            gates = new if gates is None else np.concatenate([gates, new])
        windows = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.int32)
        odds = np.concatenate([gru.forward(self.p, gates, windows[i:i + WINDOWS_AT_ONCE])
                               for i in range(0, len(windows), WINDOWS_AT_ONCE)] or [np.zeros(0)])
        ends = np.cumsum([len(x) for x in parts])
        return [self.verdict(o) for o in np.split(odds, ends[:-1])], gates

    def verdict(self, odds: np.ndarray) -> float:
        return float(gru.sigmoid(np.clip(summary(odds.astype(np.float64)) @ self.weights, -30, 30)))


def fit(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> Model:
    """A model from a sample that fits in memory.

    Windows take their text's label for the first third; later, of a toxic text only those count that
    score high among its own. The weights of the summary are fitted by Newton's method last. With labels of one
    kind or none, every score is the share of toxic ones.
    """
    y = np.array(labels, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return Model(None, None, float(y.mean()) if len(y) else 0.0)
    words = gru.Vocabulary()
    parts = [windows_of(words.places(t.split())) for t in texts]
    p, r = gru.start(seed), np.random.default_rng(seed)
    optimizer = gru.Adam(p, RATE)
    known, odds = words.features(), None
    first = sum(len(w) if t else min(len(w), CLEAN_WINDOWS) for w, t in zip(parts, y))
    rounds = max(ROUNDS, -(-STEPS // -(-first // BATCH)))
    for done in range(1, rounds + 1):
        chosen, target = [], []
        for i, w in enumerate(parts):
            if y[i]:
                own = w if odds is None else w[odds[i] >= min(odds[i].max(), max(2.0, np.quantile(odds[i], 0.75)))]
            else:
                own = w if len(w) <= CLEAN_WINDOWS else w[r.choice(len(w), CLEAN_WINDOWS, replace=False)]
            chosen.append(own)
            target.append(np.full(len(own), y[i]))
        chosen, target = np.concatenate(chosen), np.concatenate(target)
        weight = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
        order = r.permutation(len(chosen))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            here, batch = np.unique(chosen[some], return_inverse=True)
            if here[0] != 0:  # padding keeps place 0
                here, batch = np.r_[0, here], batch + 1
            batch = batch.reshape(len(some), WINDOW)
            own = known.some(here)
            x = gru.inputs(p, own)
            gates = gru.project(p, x)
            logit, traced = gru.forward(p, gates, batch, trace=True)
            d = ((gru.sigmoid(logit) - target[some]) * weight[some] / len(some)).astype(np.float32)
            grad, dgates = gru.backward(p, gates, batch, traced, d)
            optimizer.step(grad | gru.word_gradients(p, x, own, dgates))
        if 3 * done < rounds:
            continue
        gates = gru.new_gates(p, words, 0)
        whole = np.concatenate(parts)
        odds = np.concatenate([gru.forward(p, gates, whole[i:i + WINDOWS_AT_ONCE]) for i in range(0, len(whole), WINDOWS_AT_ONCE)])
        odds = np.split(odds, np.cumsum([len(w) for w in parts])[:-1])
    s = np.array([summary(o.astype(np.float64)) for o in odds])
    beta, ridge = np.zeros(s.shape[1]), np.diag([1e-3] + [0.3] * (s.shape[1] - 1))
    for _ in range(25):
        q = gru.sigmoid(np.clip(s @ beta, -30, 30))
        hess = (s * (q * (1 - q))[:, None]).T @ s + ridge
        beta -= np.linalg.solve(hess, s.T @ (q - y) + ridge @ beta)
    return Model(p, beta, float(y.mean()))


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model of the labelled rows, fitted in one task on the bounded sample; only its parameters reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()))
        made = fit([t for t, _ in rows], [int(y > 0) for _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((made.p, made.weights, made.rate))], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, text, key, label).repartition(1)
    made = sample.mapInArrow(run, "model binary").collect()
    return Model(*pickle.loads(made[0]["model"])) if made else Model(None, None, 0.0)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows with ``score`` (0 to 1) and ``predicted`` (1 from a score of one half).

    Every overlapping window of the whole text is scored, whatever its length. Null, empty and blank
    texts have one empty window and the score of such. The score depends on the text alone. Columns
    with the names of new ones are replaced.
    """
    names = df.columns
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gates = gru.Vocabulary(), None
        for batch in batches:
            row, out = batch.column(0), []
            texts = row.field(names.index(text)).to_pylist()
            for i in range(0, len(texts), 1000):
                if len(words.words) > VOCABULARY:
                    words, gates = gru.Vocabulary(), None
                found, gates = model.scores(texts[i:i + 1000], words, gates)
                out += found
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.float64())], ["row", "score"])

    got = df.select(F.struct(*[df[c] for c in names]).alias("row")).mapInArrow(score, schema)
    return unboxed(got.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), names, ["score", "predicted"])
