import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import documents
from pyspark.sql import functions as F

from tabloom.llm import brown, catalog


def words(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", small), None]


def check(rows, texts, held_out):
    """Counts and base scores against a direct count."""
    counts = Counter(w for i, t in texts for w in words(t) if not held_out(i))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)))
        for _, t in texts
    )
    got = sorted((r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)
    assert {r.train_tokens for r in rows} == {n}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


@pytest.fixture(autouse=True)
def little(monkeypatch):
    """A short list of frequent words, so that small texts have words outside it too."""
    monkeypatch.setattr(brown, "frequent", lambda vocabulary, most=3, own=brown.frequent: own(vocabulary, most))


def test_edges(spark):
    docs = documents(spark)
    rows = brown.score_texts(docs, F.col("doc_id") == 4, rounds=1).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], lambda i: i == 4)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    nothing = brown.score_texts(documents(spark, ["a b", None]), F.lit(True), rounds=1).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}
    assert brown.score_texts(documents(spark, empty=True), F.lit(False), rounds=1).count() == 0


def test_held_out_texts_score_better_than_unigrams(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["op1_brown_scoring"](spark, d).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    check(rows, texts, held)
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i, _ in texts if held(i)}
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_gain_is_the_change_of_likelihood():
    random = np.random.default_rng(1)
    items = random.integers(0, 6, 4000)
    classes = np.array([0, 1, 2, 0, 1, 2])
    likelihood = lambda c: _likelihood(c, items)
    moving = 3
    places = np.flatnonzero(items[1:] == moving) + 1
    # The item never stands beside itself here, for which the change is exact.
    keep = np.ones(len(items), bool)
    keep[places[np.diff(places, prepend=-9) == 1]] = False
    items = items[keep]
    while (items[1:] == items[:-1]).any():
        items = items[np.concatenate([[True], items[1:] != items[:-1]])]
    table = np.zeros((3, 3))
    np.add.at(table, (classes[items[:-1]], classes[items[1:]]), 1)
    before = np.bincount(classes[items[:-1]][items[1:] == moving], minlength=3).astype(float)
    after = np.bincount(classes[items[1:]][items[:-1] == moving], minlength=3).astype(float)
    found = brown.gains(before, after, 0, table)
    for to in range(3):
        new = classes.copy()
        new[moving] = to
        assert found[to] == pytest.approx(_likelihood(new, items) - _likelihood(classes, items), abs=1e-6) or to == 0
    assert likelihood(classes) < 0


def _likelihood(classes, items):
    table = np.zeros((3, 3))
    np.add.at(table, (classes[items[:-1]], classes[items[1:]]), 1)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(table.ravel()) - f(table.sum(0)) - f(table.sum(1))


def test_probabilities_add_up():
    random = np.random.default_rng(2)
    classes = random.integers(0, brown.CLASSES, brown.ITEMS)
    table = random.integers(0, 50, (brown.CLASSES, brown.CLASSES)).astype(float)
    counts = random.integers(0, 9, brown.ITEMS).astype(float)
    model = brown.ClassModel.of(classes, table, counts)
    assert (10**model.after).sum(axis=1) == pytest.approx(1)
    assert np.bincount(classes, 10**model.item) == pytest.approx(1)


def test_tokens_split_at_ascii_space_only():
    texts = ["A B\x0bc  \x1cD\n", "", "ÀB"]
    flat, n = brown.tokens(pa.array(texts, pa.large_string()))
    assert flat.to_pylist() == [w for t in texts for w in words(t)[:-1]] and n.tolist() == [3, 0, 1]
