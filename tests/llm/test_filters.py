import random

import numpy as np
import pytest
from edge import documents
from pyspark.sql import functions as F

from tabloom.llm import ordinal, raking

SF = "/root/testdata/sf0.01"


def graded(spark, n=600):
    """Texts in which the number of marked words grows with the grade."""
    random.seed(5)
    rows = []
    for i in range(n):
        grade = i % 3
        words = random.choices([f"w{k}" for k in range(60)], k=40) + ["vile", "viler"][:grade] * 2
        random.shuffle(words)
        rows.append((i, " ".join(words), grade))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_grades_of_unseen_texts(spark):
    rows = graded(spark)
    model = ordinal.fit(rows, rows.where("doc_id < 400").select(F.col("doc_id").alias("key"), "grade"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    found = ordinal.score_texts(rows, model).withColumnRenamed("grade", "found")
    scored = found.join(rows, "doc_id").where("doc_id >= 400").toPandas()
    assert (scored.found == scored.grade).mean() > 0.95
    assert (scored.rejected == (scored.grade > 0)).mean() > 0.97
    assert np.corrcoef(scored.severity, scored.grade)[0, 1] > 0.9


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    grade = labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("grade"))
    model = ordinal.fit(docs, grade.where("key % 3 <> 0"))
    found = ordinal.score_texts(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (found.rejected == (found.toxic == 1)).mean() > 0.93
    assert found[found.toxic == 0].rejected.mean() < 0.03


def test_ordinal_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 0), (4, 1), (6, 0), (None, 1), (7, None)], "key long, grade int")
    for grades in (labels, labels.where("grade = 0"), labels.where("grade > 5"), labels.where("grade = 1 and key = 4")):
        model = ordinal.fit(docs, grades)
        rows = ordinal.score_texts(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.p_toxic <= 1 and r.severity >= 0 for r in rows)
        assert len({r.severity for r in rows if r.doc_id == 4}) == 1
        kept = ordinal.without_rejected(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in rows)
    assert ordinal.fit(docs, labels.where("grade > 5")).thresholds == [60.0]
    assert ordinal.score_texts(documents(spark, empty=True), ordinal.fit(documents(spark, empty=True), labels)).count() == 0


def test_features_are_those_of_a_plain_count():
    import pyarrow as pa
    from collections import Counter

    said = ["Ab abc abcd abcde ABCDEFGH", "", "é" * 50 + " tail", "x1" * 30 + "," + "x1" * 30, "a_b-c  d"]
    chosen = {f: i for i, f in enumerate(sorted({f for t in said for f in ordinal.features(t)}))}
    rows, feature, count = ordinal.parts_and_features(pa.array(said), chosen, {})
    found = {(int(r), int(f)): int(n) for r, f, n in zip(rows, feature, count)}
    assert found == {(i, chosen[f]): n for i, t in enumerate(said) for f, n in Counter(ordinal.features(t)).items()}
    word = "Vile" + "e" * 60
    own = ordinal.features(word)
    assert own[:3] == ["4:vile", "5:vilee", "6:vileee"] and "vile" not in own
    assert 1 < len(own) - 3 == len(set(own[3:])) <= 6 and set(own[3:]) & set(ordinal.features("e" * 41)[3:])


def test_the_fit_is_the_optimum():
    """The penalised likelihood of 50 texts, against slow ascent on numerical gradients."""
    rng = np.random.default_rng(7)
    x = rng.poisson(0.7, (50, 4)).astype(float)
    score = x @ [1.5, -1.0, 0.5, 0.0] + rng.logistic(size=50)
    grade = (score > 0.3).astype(int) + (score > 1.8)

    def likelihood(p):
        at = lambda k: 1 / (1 + np.exp(p[4 + k] - x @ p[:4]))
        share = np.choose(grade, [1 - at(0), at(0) - at(1), at(1)])
        return np.log(np.maximum(share, 1e-12)).sum() - 0.25 * (p[:4] ** 2).sum()

    slow, size = np.array([0.0] * 4 + [0.0, 1.0]), 0.1
    for _ in range(3000):
        slope = np.array([(likelihood(slow + d) - likelihood(slow - d)) / 2e-6 for d in np.eye(6) * 1e-6])
        while size > 1e-9 and likelihood(slow + size * slope) < likelihood(slow):
            size /= 2
        slow, size = slow + size * slope, size * 1.5
    row, feature = np.nonzero(x)
    weights, thresholds = ordinal._optimise(grade, row, feature, x[row, feature], 4, 2, 0.5)
    found = np.concatenate([weights, thresholds])
    assert likelihood(found) == pytest.approx(likelihood(slow), abs=1e-2) and found == pytest.approx(slow, abs=0.1)


def test_sample_bound(spark):
    rows = graded(spark)
    grades = rows.select(F.col("doc_id").alias("key"), "grade")
    assert 60 < ordinal.graded_sample(rows, grades, "doc_id", "text", 100).count() < 140


def shares(rows, dim, weight):
    sums = rows.groupby(dim)[weight].sum()
    return sums / sums.sum()


def test_raked_marginals_hold(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 < 5, "x").otherwise("y").alias("b"),
        (F.col("id") % 11 + 1).alias("n"),
    )
    targets = {
        "a": spark.createDataFrame([("0", 0.6), ("1", 0.3), ("2", 0.1)], "level string, share double"),
        "b": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "level string, share double"),
    }
    mixed = raking.mix(rows, ["a", "b"], tokens="n", targets=targets).toPandas()
    mixed["w"] = mixed.n * mixed.mix_weight
    assert shares(mixed, "a", "w").values == pytest.approx([0.6, 0.3, 0.1], abs=1e-9)
    assert shares(mixed, "b", "w").values == pytest.approx([0.5, 0.5], abs=1e-9)
    assert mixed.mix_probability.max() == pytest.approx(1) and mixed.mix_probability.min() > 0
    kept = mixed[mixed.mix_kept]
    assert shares(kept, "a", "n").values == pytest.approx([0.6, 0.3, 0.1], abs=0.05)
    assert shares(kept, "b", "n").values == pytest.approx([0.5, 0.5], abs=0.05)


def test_sweeps_go_on_until_targets_hold(spark):
    """A table whose sweeps settle slowly, and one whose targets contradict each other."""
    rows = spark.createDataFrame([(1, "p", "x", 20), (2, "p", "y", 1), (3, "q", "x", 1), (4, "q", "y", 20)], "doc_id long, a string, b string, n long")
    wanted = lambda dim, first, share: spark.createDataFrame([(first, share), (dim, 1 - share)], "level string, share double")
    mixed = raking.mix(rows, ["a", "b"], tokens="n", targets={"a": wanted("q", "p", 0.7), "b": wanted("y", "x", 0.4)}).toPandas()
    mixed["w"] = mixed.n * mixed.mix_weight
    assert shares(mixed, "a", "w").values == pytest.approx([0.7, 0.3], abs=1e-9) and mixed.mix_departure.max() <= raking.TOLERANCE
    assert shares(mixed, "b", "w").values == pytest.approx([0.4, 0.6], abs=1e-9)
    with pytest.raises(ValueError, match="no weights meet"):
        raking.mix(rows.where("doc_id in (1, 4)"), ["a", "b"], tokens="n", targets={"a": wanted("q", "p", 0.7), "b": wanted("y", "x", 0.4)})


def test_mix_edges(spark):
    docs = documents(spark).withColumn("mix_tokens", raking.words()).withColumn("mix_topic", raking.form())
    mixed = raking.mix(docs, ["source", "lang", "mix_topic"], tokens="mix_tokens")
    rows = mixed.collect()
    assert len(rows) == docs.count() and mixed.columns[: len(docs.columns)] == docs.columns
    assert all(r.mix_weight > 0 and 0 < r.mix_probability <= 1 for r in rows)
    assert len({r.mix_kept for r in rows if r.doc_id == 4}) == 1
    nothing = docs.where("false")
    assert raking.mix(nothing, ["source"], tokens="mix_tokens").count() == 0
    assert raking.mix(docs.where("mix_tokens = 0"), ["lang"], tokens="mix_tokens").count() == 2


def test_the_plan_of_mixing_is_native(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("a"), F.lit(2).alias("n"))
    plan = raking.mix(rows, ["a"], tokens="n")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
