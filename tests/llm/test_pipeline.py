import hashlib
from collections import Counter

import corpus_pipeline as cp
from edge import documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabloom.llm import catalog, ngram_join, ordinal, raking, secret_scan

SF = "/root/testdata/sf0.001"


def test_run_against_the_operators_one_by_one(spark):
    """What run() returns, from each operator's report on the rows that the stages before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    frame = lambda: spark.createDataFrame(docs.reset_index())
    model = ordinal.fit(frame(), catalog.severity_grades(spark.read.parquet(f"{SF}/labels.parquet")))
    rejected = ordinal.score_texts(frame(), model).where("rejected").toPandas().doc_id
    assert 0 < len(rejected) < 0.25 * len(docs)
    docs = docs.drop(rejected)
    kept = ngram_join.join(frame()).where("kept").toPandas().doc_id
    assert len(kept) < len(docs)
    docs = docs.loc[kept]
    for i, text in docs.text.items():
        docs.loc[i, "text"] = secret_scan.masked(text, secret_scan.scan(text)[1], "[secret]")
        docs.loc[i, "n_chars"] = len(docs.loc[i, "text"])
    measured = frame().withColumn("mix_tokens", raking.words()).withColumn("mix_topic", raking.form())
    mixed = raking.mix(measured, ("source", "lang", "mix_topic"), tokens="mix_tokens", power=cp.MIX_POWER)
    docs = docs.loc[mixed.where("mix_kept").toPandas().doc_id]
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.text.items()}


def test_stages_keep_columns_and_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert (out.columns == docs.columns) == (name != "encoding"), name
        assert out.count() <= docs.count()
        if name != "encoding":
            extra = [F.col(f"`{c}`") for c in docs.columns if c not in cp.OWN]
            assert len(extra) == 12 and out.select(*extra).exceptAll(docs.select(*extra)).count() == 0, name
    assert Counter(r.doc_id for r in cp.secrets(spark, docs, SF).collect()) == Counter(r.doc_id for r in docs.collect())
    empty = documents(spark, empty=True)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= names | {f"op{n}_" for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in names)}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixture", "encoding"]


def test_mixing_stays_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = cp.mixture(spark, docs, SF).where(F.lit(True))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_stage_keeps_what_the_query_keeps(spark):
    """The pipeline mixes to the same tempered targets as op9_mix_sources, not to the corpus as it is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    staged = {r.doc_id for r in cp.mixture(spark, docs, SF).select("doc_id").collect()}
    queried = {r.doc_id for r in entry.queries()["op9_mix_sources"](spark, SF).where("kept").select("doc_id").collect()}
    assert staged == queried and len(staged) < 0.8 * docs.count()
