"""Multinomial gradient boosting: in each round one regression tree a class, on shared scores.

Scores of all classes go through one softmax, so a round's trees are fitted to residuals that add up to zero
over the classes, and probabilities need no rescaling. Trees grow level by level for all classes at once:

* Features are cut into bins once, at quantiles of a bounded sample, and stored as one byte a cell.
* A pass adds up, in each task, the residuals of every (class, node, feature, bin). Those sums are shuffled
  by class, and the best split of every node is found where they meet. Only splits reach the driver.
* The last level's sums also give the values of the leaves: a Newton step on the multinomial loss.
* Scores are kept beside the rows, and brought up to date in a newly written table every ``REFRESH`` rounds;
  in between, tasks apply the trees of the rounds since.

A round costs as many scans as trees have levels, whatever the number of classes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.storage import remove, staged

#: Rows from which the bins of features are taken, chosen at random; all other steps use all rows.
BIN_SAMPLE = 20_000
#: Rows of a stored chunk, and rounds between two writings of the scores.
CHUNK, REFRESH = 16_384, 10
_GROUP = "class int, node int, feature int, bin int, gain double, left double, right double"


@dataclass
class Trees:
    """The trees of one round: splits by (class, node) in level order and leaves by (class, leaf)."""

    feature: np.ndarray
    bin: np.ndarray  # rows with a bin up to this one go left
    leaf: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        shape = (classes, 2**depth - 1)
        return cls(np.zeros(shape, np.int32), np.full(shape, 255, np.int32), np.zeros((classes, 2**depth)))

    def place(self, codes: np.ndarray, one: int, levels: int) -> np.ndarray:
        """The node, counted within its level, that each column of ``codes`` reaches in the tree of a class."""
        node, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        for level in range(levels):
            at = 2**level - 1 + node
            node = 2 * node + (codes[self.feature[one][at], rows] > self.bin[one][at])
        return node

    def add_to(self, scores: np.ndarray, codes: np.ndarray, rate: float) -> None:
        depth = int(np.log2(self.leaf.shape[1]))
        for one in range(len(self.leaf)):
            scores[:, one] += rate * self.leaf[one][self.place(codes, one, depth)]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostedClasses:
    """A fitted model. ``edges`` hold the upper ends of each feature's bins but the last."""

    edges: list[np.ndarray]
    start: np.ndarray
    rate: float
    depth: int
    rounds: list[Trees] = field(default_factory=list)
    gains: np.ndarray | None = None

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  as estimators of the library name it
        total = self.gains.sum()
        return DenseVector(self.gains / total if total > 0 else self.gains)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins by (feature, row)."""
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, codes = np.tile(self.start, (len(x), 1)), self.codes(x)
        for trees in self.rounds:
            trees.add_to(out, codes, self.rate)
        return out

    def probabilities(self, vector: str) -> Column:
        """Class probabilities of a column of vectors, as an array."""
        model = self

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                found = _softmax(model.scores(np.stack(x.to_list()))) if len(x) else np.zeros((0, len(model.start)))
                yield pd.Series(list(found))

        return run(vector_to_array(vector))

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        rounds = [{"feature": t.feature.tolist(), "bin": t.bin.tolist(), "leaf": t.leaf.tolist()} for t in self.rounds]
        return json.dumps(
            {"edges": [e.tolist() for e in self.edges], "start": self.start.tolist(), "rate": self.rate, "depth": self.depth,
             "gains": self.gains.tolist(), "rounds": rounds}
        )

    def save(self, spark: SparkSession, path: str, *, overwrite: bool = False) -> None:
        frame = spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1)
        frame.write.mode("overwrite" if overwrite else "errorifexists").text(path)

    @classmethod
    def load(cls, path: str) -> BoostedClasses:
        data = json.loads(SparkSession.active().read.text(path, wholetext=True).first()["value"])
        rounds = [Trees(np.array(t["feature"], np.int32), np.array(t["bin"], np.int32), np.array(t["leaf"])) for t in data["rounds"]]
        edges = [np.array(e, float) for e in data["edges"]]
        return cls(edges, np.array(data["start"]), data["rate"], data["depth"], rounds, np.array(data["gains"]))


def bin_edges(matrix: DataFrame, rows: int, bins: int, seed: int) -> list[np.ndarray]:
    """Ends of at most ``bins`` bins a feature, from a sample of about ``BIN_SAMPLE`` rows.

    A value above all of the sample falls into the last bin.
    """
    share = min(1.0, BIN_SAMPLE / max(rows, 1))
    drawn = matrix.sample(share, seed) if share < 1 else matrix
    x = np.array([r[0] for r in drawn.select(vector_to_array("_features")).limit(2 * BIN_SAMPLE).collect()])
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="inverted_cdf"))
        else:
            values = (values[:-1] + values[1:]) / 2
        out.append(values.astype(float))
    return out


def _binned(matrix: DataFrame, model: BoostedClasses) -> DataFrame:
    """Chunks of rows: bins by feature, labels and scores. Stored."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                x = part.column(1).flatten().to_numpy().reshape(len(part), -1)
                label = part.column(0).to_numpy().astype(np.int32)
                scores = np.tile(model.start, (len(part), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label.tobytes()], pa.binary()), pa.array([model.codes(x).tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary())],
                    names=["label", "codes", "scores"],
                )

    rows = matrix.select("_label", vector_to_array("_features").alias("x"))
    return staged(rows.mapInArrow(run, "label binary, codes binary, scores binary"), "boosting")


def _chunks(batches, features: int, classes: int, since: list[Trees], rate: float):
    for batch in batches:
        for label, codes, scores in zip(*(batch.column(c).to_pylist() for c in range(3))):
            label = np.frombuffer(label, np.int32)
            codes = np.frombuffer(codes, np.uint8).reshape(features, -1)
            scores = np.frombuffer(scores).reshape(-1, classes).copy()
            for trees in since:
                trees.add_to(scores, codes, rate)
            yield label, codes, scores


def _split(sums: np.ndarray, least: int, candidates: np.ndarray, classes: int) -> tuple:
    """The best split of a node from its (feature, bin, [rows, residuals, curvature]) sums, and both leaves' values."""
    value = lambda g, h: (classes - 1) / classes * g / h if h > 1e-12 else 0.0
    left = np.cumsum(sums, axis=1)
    whole = left[0, -1]
    right = whole - left
    n, m = left[..., 0], right[..., 0]
    allowed = (n >= max(least, 1)) & (m >= max(least, 1))
    allowed[np.setdiff1d(np.arange(len(sums)), candidates)] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left[..., 1] ** 2 / n + right[..., 1] ** 2 / m, -np.inf)
        gain = gain - (whole[1] ** 2 / whole[0] if whole[0] else 0.0)
    best = int(gain.argmax())
    feature, bin_ = divmod(best, gain.shape[1])
    if not gain[feature, bin_] > 1e-12:
        return 0, 255, 0.0, value(whole[1], whole[2]), 0.0
    a, b = left[feature, bin_], right[feature, bin_]
    return feature, bin_, float(gain[feature, bin_]), value(a[1], a[2]), value(b[1], b[2])


def fit(matrix: DataFrame, classes: int, rows: int, params: dict, seed: int) -> BoostedClasses:
    """Boost over rows of ``_label`` (class number) and ``_features``."""
    spark = matrix.sparkSession
    depth, rate = params.get("max_depth") or 3, params["learning_rate"]
    least, share = params.get("min_samples_leaf", 1), params["subsample"]
    counts = dict(matrix.groupBy("_label").count().collect())
    prior = np.array([max(counts.get(float(i), 0), 1e-3) for i in range(classes)], float)
    bins = min(params.get("max_bins", 32), 255)
    edges = bin_edges(matrix, rows, bins, seed)
    model = BoostedClasses(edges, np.log(prior / prior.sum()), rate, depth, gains=np.zeros(len(edges)))
    features, width = len(edges), max(len(e) for e in edges) + 1
    tried = _tried(params.get("max_features"), features)
    table = _binned(matrix, model)
    tasks = 4 * spark.sparkContext.defaultParallelism
    since: list[Trees] = []

    def pass_over(round_: int, trees: Trees, level: int) -> list:
        nodes, done = 2**level, list(since)

        def sums(batches):
            out = np.zeros((classes, nodes, features, width, 3))
            for i, (label, codes, scores) in enumerate(_chunks(batches, features, classes, done, rate)):
                p = _softmax(scores)
                taken = np.random.default_rng([seed, round_, len(label), i]).random(len(label)) < share if share < 1 else None
                for one in range(classes):
                    g = (label == one) - p[:, one]
                    h, cells = np.abs(g) * (1 - np.abs(g)), trees.place(codes, one, level) * width
                    weights = [np.ones(len(g)), g, h] if taken is None else [taken.astype(float), g * taken, h * taken]
                    for j in range(features):
                        at = cells + codes[j]
                        for w, weight in enumerate(weights):
                            out[one, :, j, :, w] += np.bincount(at, weight, nodes * width).reshape(nodes, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(classes), pa.int32()), pa.array([out[one].tobytes() for one in range(classes)], pa.binary())], names=["class", "sums"]
            )

        def best(found: pa.Table) -> pa.Table:
            one = found["class"][0].as_py()
            total = np.zeros((nodes, features, width, 3))
            for raw in found["sums"]:
                total += np.frombuffer(raw.as_py()).reshape(total.shape)
            rows_ = []
            for node in range(nodes):
                pick = np.random.default_rng([seed, round_, one, level, node]).permutation(features)[:tried]
                rows_.append((one, node, *_split(total[node], least, pick, classes)))
            return pa.Table.from_arrays([pa.array(c) for c in zip(*rows_)], names=["class", "node", "feature", "bin", "gain", "left", "right"]).cast(
                pa.schema([("class", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("left", pa.float64()), ("right", pa.float64())])
            )

        # So many tasks that all cores work, each giving one row a class.
        summed = table.coalesce(tasks).mapInArrow(sums, "class int, sums binary")
        return summed.groupBy("class").applyInArrow(best, _GROUP).collect()

    for round_ in range(params["n_estimators"]):
        trees = Trees.empty(classes, depth)
        for level in range(depth):
            for r in pass_over(round_, trees, level):
                at = 2**level - 1 + r.node
                trees.feature[r["class"], at], trees.bin[r["class"], at] = r.feature, r.bin
                model.gains[r.feature] += r.gain
                if level == depth - 1:
                    trees.leaf[r["class"], 2 * r.node], trees.leaf[r["class"], 2 * r.node + 1] = r.left, r.right
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == REFRESH and round_ + 1 < params["n_estimators"]:
            older, done = table, list(since)

            def renewed(batches):
                for label, codes, scores in _chunks(batches, features, classes, done, rate):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.tobytes()], pa.binary()) for x in (label, codes, scores)], names=["label", "codes", "scores"]
                    )

            table = staged(older.mapInArrow(renewed, "label binary, codes binary, scores binary"), "boosting")
            remove(older)
            since.clear()
    remove(table)
    return model


def _tried(wanted, features: int) -> int:
    """How many features a split may choose from."""
    if wanted in (None, "all", "auto"):
        return features
    if wanted == "sqrt":
        return max(1, int(features**0.5))
    if wanted == "log2":
        return max(1, int(np.log2(features)))
    return max(1, min(features, int(wanted * features) if isinstance(wanted, float) else int(wanted)))
