"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

train(): at most `most` labels (those with the smallest hash of doc_id: the bound is a parameter, the same at every
size of the input) choose texts, which go to one task as sparse features; FTRL-proximal takes them one by one with a
learning rate for each coordinate, and L1 leaves few weights, which the driver gets and broadcasts: their size is bounded by
the sample, not by the corpus. The cut's place on the 0-to-1 scale is calibrated by five folds, on rows held back from learning, so that few
clean ones lie above; then all rows of the sample are learned from, at every size of it.
score(): every whole text, by the same features, in Arrow batches; nothing is shuffled.

A feature counts once for each document, however often it stands there. Null and empty texts: no features, so the bias alone.
Null doc_id: scored. Very long texts: scored whole, in one task. Other columns are ignored by train() and by score() without keep. Rows with a null label or doc_id aren't learned from; repeated ones count each. Without labels,
or with labels of one kind only, all scores equal that kind's share (0 without any). Empty table: no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, mix, texts
from .words import word_hashes

BITS = 20


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct feature numbers of each text: words, pairs of neighbours, and pairs with one word between."""
    ends, words = word_hashes(_bare(column))
    n = len(ends) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(ends))
    found = [(doc, words)]
    for gap in (1, 2):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append((doc[gap:][same], mix(words[:-gap][same] * np.uint64(2 * gap + 1) + words[gap:][same])))
    docs, hashes = (np.concatenate(x) for x in zip(*found))
    both = (docs << np.uint64(bits)) | (hashes & np.uint64((1 << bits) - 1))
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    docs = (both >> np.uint64(bits)).astype(np.int64)
    return np.searchsorted(docs, np.arange(n + 1)), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bare(column: pa.Array) -> pa.Array:
    """Punctuation as spaces, so that a word counts the same at the end of a sentence."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(pc.fill_null(column, ""), r"[!-/:-@\[-`{-~]+", " ")


class Ftrl:
    """FTRL-proximal with a learning rate for each coordinate (McMahan et al., 2013) for features of value 1, and a bias."""

    def __init__(self, size: int, alpha: float = 1.5, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def learned(ends: np.ndarray, numbers: np.ndarray, labels: np.ndarray, rows: np.ndarray, bits: int, passes: int) -> np.ndarray:
    """Weights (the last is the bias) after some passes over the rows, in an order that a fixed seed gives."""
    model = Ftrl(1 << bits)
    heavy = min(4.0, float((labels == 0).sum() / (labels == 1).sum()))  # so that the rarer label isn't drowned
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(rows):
            model.learn(numbers[ends[i] : ends[i + 1]], int(labels[i]), heavy if labels[i] else 1.0)
    return model.weights()


def best_cut(logits: np.ndarray, truth: np.ndarray, spare: float = 0.02) -> float:
    """The cut with the best F1 among those that leave at most a share `spare` of the clean rows above; above all if none hits."""
    order = np.argsort(-logits, kind="stable")
    truth, values = truth[order], logits[order]
    hits = np.cumsum(truth)
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + truth.sum())
    f1[np.cumsum(1 - truth) > spare * (1 - truth).sum()] = 0
    f1[:-1][values[:-1] == values[1:]] = 0
    best = int(np.argmax(f1))
    if not f1[best]:
        return float(values[0]) + 1
    return float(values[best] + (values[best + 1] if best + 1 < len(values) else values[best] - 1)) / 2


def fit(ends: np.ndarray, numbers: np.ndarray, labels: np.ndarray, bits: int = BITS, passes: int = 8, threshold: float = 0.3) -> dict:
    """Sparse weights (at, weight), learned from all rows, and the bias, which puts the best cut at `threshold`. The cut is found over all rows,
    each scored by weights learned from the other four fifths."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        share = float(labels.mean()) if n else 0.0
        return {"at": np.zeros(0, np.int64), "weight": np.zeros(0), "share": share}
    fold, logits = np.arange(n) % 5, np.full(n, np.nan)
    for f in range(5):
        if labels[fold != f].min() != labels[fold != f].max():
            w = learned(ends, numbers, labels, np.flatnonzero(fold != f), bits, passes)
            logits[fold == f] = [w[numbers[ends[i] : ends[i + 1]]].sum() + w[-1] for i in np.flatnonzero(fold == f)]
    w = learned(ends, numbers, labels, np.arange(n), bits, passes)
    known = ~np.isnan(logits)
    cut = best_cut(logits[known], labels[known]) if known.any() else 0.0
    at = np.flatnonzero(w[:-1])
    return {"at": at, "weight": w[at], "bias": float(w[-1] - cut + np.log(threshold / (1 - threshold))), "share": None}


def train(docs: DataFrame, labels: DataFrame, label: str, most: int = 12_000, bits: int = BITS) -> dict:
    """The model of the texts of docs whose doc_id stands in labels, from at most `most` labels, fitted in one task."""
    arrow(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = texts(docs).join(F.broadcast(sample), "doc_id")  # at most `most` rows of 12 bytes

    def described(batches):
        for batch in batches:
            ends, numbers = features(batch["text"], bits)
            raw = [numbers[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(raw, pa.binary())], names=["doc_id", "label", "at"])

    def fitted(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary())]))
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("at", "ascending")])
        lists = [np.frombuffer(x, "<i4") for x in table["at"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        model = fit(ends, np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), table["label"].to_numpy().astype(np.int64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([model["at"]], pa.list_(pa.int64())), pa.array([model["weight"]], pa.list_(pa.float64())), pa.array([model.get("bias")], pa.float64()), pa.array([model["share"]], pa.float64())], names=["at", "weight", "bias", "share"])

    row = rows.mapInArrow(described, "doc_id long, label int, at binary").repartition(1).mapInArrow(fitted, "at array<long>, weight array<double>, bias double, share double").first()
    return {"at": np.array(row["at"], np.int64), "weight": np.array(row["weight"]), "bias": row["bias"], "share": row["share"]}


def _scorer(spark: SparkSession, model: dict, bits: int):
    """Scores of a column of texts, in a worker; the sparse weights are broadcast."""
    sent = spark.sparkContext.broadcast((np.asarray(model["at"], np.int32), np.asarray(model["weight"], np.float32), model["bias"], model["share"]))

    def scores_of(column: pa.Array, table: list) -> np.ndarray:
        at, weight, bias, share = sent.value
        if not table:  # once for each task
            table.append(np.zeros((1 << bits) + 1, np.float64))
            table[0][at] = weight
        ends, numbers = features(column, bits)
        sums = np.concatenate([[0.0], np.cumsum(table[0][numbers])])
        logits = sums[ends[1:]] - sums[ends[:-1]]
        return np.full(len(logits), share) if share is not None else 1 / (1 + np.exp(-np.clip(np.round(logits, 9) + bias, -35, 35)))

    return scores_of


def score(docs: DataFrame, model: dict, bits: int = BITS, keep: str = "") -> DataFrame:
    """doc_id and score of every text; with keep, all columns of docs and one of that name, which none of them may have."""
    if keep.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {keep} of its own")
    arrow(docs.sparkSession)
    scores_of = _scorer(docs.sparkSession, model, bits)

    def run(batches):
        table: list = []
        for batch in batches:
            scores = pa.array(scores_of(batch["text"], table), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep else [batch["doc_id"]]), scores], names=[*(batch.schema.names if keep else ["doc_id"]), keep or "score"])

    if keep:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(keep, T.DoubleType())]))
    return texts(docs).mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: dict, threshold: float, bits: int = BITS) -> DataFrame:
    """The rows of docs that score less than threshold, with all their columns, whatever their names."""
    arrow(docs.sparkSession)
    scores_of = _scorer(docs.sparkSession, model, bits)

    def run(batches):
        table: list = []
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch["text"], table) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
