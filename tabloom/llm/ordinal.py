"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The probability of at least grade k is ``sigmoid(w . x - t_k)``: one weight vector shared by all ordered
thresholds ``t_1 < t_2 < ...``. Scores are the expected grade, the sum of those probabilities. ``x`` has
log(1 + count) of a document's words and word beginnings that tell grades apart. A word of more than
``LONGEST`` characters counts by its beginnings and by numbers of its five-character pieces, each once a word.

Fitting reads labelled rows only: all of them, or a share chosen by hash so that about ``max_rows`` are
expected. Word and beginning counts of that sample are gathered by a shuffle, at most ``max_features``
of them are selected, and the sample's few selected counts are fitted on the driver, whose memory is
bounded by these two parameters. Scoring reads every whole text, without a shuffle.

Defined results: a missing or empty text has no features and gets the base rates. Rows without a key or
without a grade are not used for fitting; a key with several grades counts as the highest. Without
labels, or with one grade alone, every document gets that grade (or 0). Repeated rows get equal scores,
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import remove, staged
from tabloom.llm.batches import add_columns, by_bytes, map_rows

#: Labelled rows to fit on, as expected by the share taken; more labels do not make the model larger.
MAX_ROWS = 20_000
#: Selected words and word beginnings.
MAX_FEATURES = 4096
#: Documents of the sample that a feature must occur in.
LEAST_ROWS = 4
#: Standard deviations that a feature's log odds differ from 0.
LEAST_Z = 2.0
#: Probability of at least grade 1 from which a document is rejected.
REJECT_AT = 0.3
#: Letters of the word beginnings.
BEGINNINGS = (4, 5, 6)
#: Characters of the longest word that is a feature itself.
LONGEST = 40
#: Characters of the pieces of longer words, and how many numbers pieces have.
PIECE, PIECES = 5, 1 << 14
_WORDS = re.compile(r"\w+")
_MEMORY = 200_000


def features(part: str) -> list[str]:
    """Words of a part of a text, and their beginnings, which carry their length in front; pieces of long words."""
    out = []
    for word in _WORDS.findall(part.lower()):
        if len(word) <= LONGEST:
            out.append(word)
        out += [f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n]
        if len(word) > LONGEST:
            numbers = {zlib.crc32(word[i : i + PIECE].encode()) % PIECES for i in range(len(word) - PIECE + 1)}
            out += [f"#{n}" for n in sorted(numbers)]
    return out


@dataclass
class OrdinalModel:
    """Weights by feature and the ordered thresholds, one for each grade above 0."""

    weights: dict[str, float]
    thresholds: list[float]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """For each score the probabilities of at least grade 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -60, 60)))


def parts_and_features(column: pa.Array, chosen: dict[str, int], memory: dict[str, tuple[int, ...]]):
    """(text, feature, count) of the chosen features in each text of a slice."""
    parts = pc.split_pattern(column, " ")
    coded = pc.list_flatten(parts).dictionary_encode()
    words, found, places = coded.dictionary.to_pylist(), [], []
    for i, word in enumerate(words):
        known = memory.get(word)
        if known is None:
            known = tuple(chosen[f] for f in features(word) if f in chosen)
            if len(word) <= LONGEST:
                memory[word] = known
        if known:
            found.append(known)
            places.append(i)
    if len(memory) > _MEMORY:
        memory.clear()
    none = np.empty(0, np.int64)
    if not places:
        return none, none, none
    number = np.full(len(words), -1)
    number[places] = np.arange(len(places))
    which = number[coded.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    hit = which >= 0
    which, text = which[hit], text[hit]
    lengths = np.array([len(f) for f in found])
    flat, begin = np.concatenate(found), np.cumsum(lengths) - lengths
    times = lengths[which]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pairs = np.repeat(text, times) * len(chosen) + flat[np.repeat(begin[which], times) + within]
    pairs, counts = np.unique(pairs, return_counts=True)
    return pairs // len(chosen), pairs % len(chosen), counts


def graded_sample(docs: DataFrame, grades: DataFrame, key: str, text: str, max_rows: int) -> DataFrame:
    """(text, grade) of a bounded share of the labelled documents. The share of labels is broadcast."""
    one = grades.where(F.col("grade").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.max("grade").alias("grade"))
    have = one.count()
    if have > max_rows:
        one = one.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * max_rows / have))
    side = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return side.join(F.broadcast(one), "key").select("text", F.col("grade").cast("int"))


def _gather(sample: DataFrame) -> DataFrame:
    """(feature, rows, rows of a grade above 0), summed over the sample."""

    def run(batches):
        for rows, column, _ in by_bytes(batches, "text"):
            seen, high = Counter(), Counter()
            for value, grade in zip(column.to_pylist(), rows.column(1).to_pylist()):
                own = set(features(value))
                seen.update(own)
                if grade > 0:
                    high.update(own)
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[n] for n in names]), pa.array([high[n] for n in names])],
                names=["feature", "n", "high"],
            )

    counted = sample.mapInArrow(run, "feature string, n long, high long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))


def _selected(sample: DataFrame, n_high: int, n_low: int, most: int) -> list[str]:
    """The features whose log odds differ most from 0, in standard deviations."""
    a, b = F.col("high") + 0.5, F.col("n") - F.col("high") + 0.5
    odds = F.log(a / (n_high - F.col("high") + 0.5)) - F.log(b / (n_low - F.col("n") + F.col("high") + 0.5))
    ranked = _gather(sample).where(F.col("n") >= LEAST_ROWS).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    top = ranked.where(F.abs("z") > LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(most)
    return [r["feature"] for r in top.select("feature").collect()]


def fit(
    docs: DataFrame,
    grades: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    penalty: float = 0.5,
) -> OrdinalModel:
    """Fit on documents that ``grades`` (key, grade from 0 up) names."""
    sample = staged(graded_sample(docs, grades, key, text, max_rows), "graded")
    counts = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    top = max(counts, default=0)
    if len(counts) < 2:
        remove(sample)
        return OrdinalModel({}, [-60.0] * top or [60.0])
    names = _selected(sample, sum(n for g, n in counts.items() if g > 0), counts.get(0, 0), max_features)
    chosen = {n: i for i, n in enumerate(names)}

    def run(batches):
        memory: dict = {}
        for rows, column, _ in by_bytes(batches, "text"):
            text_, feature, count = parts_and_features(column, chosen, memory) if chosen else (np.empty(0, np.int64),) * 3
            ends = np.searchsorted(text_, np.arange(len(column) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(1),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.log1p(count).astype(float))),
                ],
                names=["grade", "feature", "value"],
            )

    rows = sample.mapInArrow(run, "grade int, feature array<int>, value array<double>").toArrow()
    remove(sample)
    grade = rows["grade"].to_numpy().astype(int)
    row = np.repeat(np.arange(len(grade)), pc.list_value_length(rows["feature"]).to_numpy())
    feature, value = (pc.list_flatten(rows[c]).to_numpy() for c in ("feature", "value"))
    weights, thresholds = _optimise(grade, row, feature, value, len(chosen), top, penalty)
    return OrdinalModel({n: float(w) for n, w in zip(names, weights)}, [float(t) for t in thresholds])


def _optimise(grade, row, feature, value, width: int, top: int, penalty: float, steps: int = 400):
    """Penalised maximum likelihood by full gradient steps of adaptive size."""
    shares = np.clip([(grade >= k).mean() for k in range(1, top + 1)], 1e-4, 1 - 1e-4)
    first = -np.log(shares / (1 - shares))
    # Thresholds as a first one and logs of the gaps, which keeps them in order.
    params = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    slope, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:width], np.exp(params[width + 1 :])
        cuts = np.concatenate([[-np.inf], params[width] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, w[feature] * value, len(grade))
        upper, lower = (1 / (1 + np.exp(np.clip(cuts[grade + i] - score, -60, 60))) for i in (0, 1))
        upper[grade == 0], lower[grade == top] = 1.0, 0.0
        share = np.maximum(upper - lower, 1e-12)
        by_score = 1 - upper - lower
        by_weight = np.bincount(feature, by_score[row] * value, width) - penalty * w
        by_cut = np.bincount(grade, -upper * (1 - upper) / share, top + 2)[1 : top + 1]
        by_cut += np.bincount(grade + 1, lower * (1 - lower) / share, top + 2)[1 : top + 1]
        after = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([by_weight, after[:1], after[1:] * gaps])
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        params = params + 0.1 * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    gaps = np.exp(params[width + 1 :])
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(gaps)])


def _judge(model: OrdinalModel):
    """A function of texts to the probabilities of at least each grade above 0."""
    names = list(model.weights)
    chosen, weights = {n: i for i, n in enumerate(names)}, np.array([model.weights[n] for n in names])
    memory: dict = {}

    def run(column: pa.Array) -> np.ndarray:
        score = np.zeros(len(column))
        if chosen:
            text, feature, count = parts_and_features(column, chosen, memory)
            score = np.bincount(text, weights[feature] * np.log1p(count), len(column)).astype(float)
        return model.at_least(score)

    return run


def without_rejected(docs: DataFrame, model: OrdinalModel, *, text: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""

    def run(batches):
        judge = _judge(model)
        for rows, column, _ in by_bytes(batches, place):
            yield rows.filter(pa.array(judge(column)[:, 0] < reject_at))

    place = f"c{docs.columns.index(text)}"
    return map_rows(docs, run)


def score_texts(
    docs: DataFrame, model: OrdinalModel, *, keys: Sequence[str] = ("doc_id",), text: str = "text", reject_at: float = REJECT_AT
) -> DataFrame:
    """The keys with severity (expected grade), grade (most probable), p_toxic (at least grade 1) and rejected."""

    def make():
        judge = _judge(model)

        def run(column: pa.Array, _):
            over = judge(column)
            each = -np.diff(np.concatenate([np.ones((len(column), 1)), over, np.zeros((len(column), 1))], axis=1), axis=1)
            return [over.sum(axis=1), each.argmax(axis=1), over[:, 0], over[:, 0] >= reject_at]

        return run

    return add_columns(docs, keys, text, "severity double, grade int, p_toxic double, rejected boolean", make)
