import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import documents
from pyspark.sql import functions as F

from tabloom.llm import groups, ngram_join, polytope, posting

SF = "/root/testdata/sf0.001"


def closure(nodes, links):
    root = {}
    for n in sorted(nodes):
        stack = [n] if n not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = n
                stack += links[x]
    return root


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_links(texts):
    """Linked places of texts by comparing all pairs."""
    sets, links = [brute_shingles(t) for t in texts], defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    return links


def near_copies():
    """Families of texts at many similarities, exact copies, a large family, and texts that share a passage."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = random.choices(vocabulary, k=55)
    texts = []
    for family in range(12):
        base = random.choices(vocabulary, k=random.choice([6, 40, 120, 300]))
        for _ in range(60 if family == 0 else 5):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [" ".join(random.choices(vocabulary, k=60) + passage) for _ in range(40)]
    texts += texts[:8] + ["Three short words", "three  short\nwords", None, "", " "]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [7, 512])
def test_join_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    links = brute_links(texts)
    roots = closure(range(len(texts)), links)
    rows = ngram_join.join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (roots[i], len(links[i])) for i in range(len(texts))}
    assert {r.doc_id for r in rows if r.kept} == set(roots.values())


def test_join_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    local = sorted(docs.collect())
    links = brute_links([r.text for r in local])
    roots = closure(range(len(local)), links)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    assert found == {r.doc_id: (local[roots[i]].doc_id, len(links[i])) for i, r in enumerate(local)}


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    docs = documents(spark)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    counts = Counter(r.doc_id for r in kept.collect())
    # 4, its repetition and 5 are copies; missing and blank texts stay.
    assert counts == Counter([0, 1, 2, 3, 4, 6, 7, None])
    assert ngram_join.deduplicate(documents(spark, empty=True)).count() == 0


def test_pruning_follows_the_posterior():
    from math import comb

    for n in (16, 64, 192):
        m = ngram_join.least_matches(n)
        tail = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= ngram_join.TOLERANCE and (m == 0 or tail(m - 1) < ngram_join.TOLERANCE)
    one = np.arange(192, dtype=np.uint16)
    others = np.stack([one, one + 500, np.where(one % 2 == 0, one, one + 500)])
    assert ngram_join.plausible(one, others).tolist() == [0]


def test_minhash_estimates_similarity():
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(80, 480))
    hashes, counts = ngram_join.shingles(pa.array([a, b, "", "x y"], pa.large_string()))
    assert counts.tolist() == [396, 396, 0, 1]
    values = ngram_join.signatures(hashes, counts)
    assert abs((values[0] == values[1]).mean() - 316 / 476) < 0.12 and not values[2].any()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", limit)
    random.seed(2)
    pairs = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(559, 40)]
    pairs += [(random.randint(1000, 1100), random.randint(1000, 1100)) for _ in range(60)]
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    want = closure([n for p in pairs if p[0] != p[1] for n in p], links)
    found = groups.components(spark.createDataFrame(pairs, "a long, b long"))
    assert dict(tuple(r) for r in found.collect()) == want
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark):
    random = np.random.default_rng(4)
    base = random.normal(size=(60, 24))
    near = [b + random.normal(size=24) * s for b in base[:12] for s in (0.05, 0.2, 0.3, 0.35)]
    crowd = [base[0] + random.normal(size=24) * 0.2 for _ in range(50)]
    values = [v.astype(np.float32).tolist() for v in [*base, *near, *crowd]]
    values += [values[3], values[3], [2 * x for x in values[4]]]
    odd = [None, [], [0.0] * 24, [None, *values[0][1:]], [float("nan")] * 24, [float("inf"), *values[0][1:]], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    ids = [*range(len(values) + len(odd)), None]
    rows = [(i, v, "x", 1) for i, v in zip(ids, values + odd + [values[5]])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string, row int").repartition(4)


def sound(v):
    return v and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize("block", [9, 1024])
def test_vector_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(polytope, "BLOCK", block)
    rows, df = vectors(spark)
    links = defaultdict(set)
    for i, (_, a, *_) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if sound(a) and sound(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    roots = closure(range(len(rows)), links)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in polytope.link(df).collect()}
    for i, (key, *_) in enumerate(rows):
        root = rows[roots[i]][0]
        assert found[key] == (len(links[i]), root, key is None and root is None or key == root), key
    assert polytope.link(df.where("false")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = polytope.hadamard(x)
    assert np.linalg.norm(y, axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert polytope.hadamard(y) == pytest.approx(x)


def ranked(rows, i, k=20):
    a = np.array(rows[i][1], float)
    scored = []
    for j, (key, v, *_) in enumerate(rows):
        if j != i and sound(v) and len(v) == len(a):
            scored.append((-float((a * np.array(v, float)).sum()), key is None, key))
    return [(key, -s) for s, _, key in sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:k]]


def test_search_against_all(spark, monkeypatch):
    monkeypatch.setattr(posting, "LIST_PART", 20)
    monkeypatch.setattr(posting, "QUERY_PART", 5)
    rows, df = vectors(spark)
    found = defaultdict(dict)
    for r in posting.search(df, F.col("id") % 10 == 0).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    asked = [i for i, (key, v, *_) in enumerate(rows) if key is not None and key % 10 == 0 and sound(v) and len(v) == 24]
    assert set(found) == {rows[i][0] for i in asked}
    for i in asked:
        want = ranked(rows, i)
        got = [found[rows[i][0]][n] for n in range(1, 21)]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    few = posting.search(df.where("vec_id < 5"), F.col("id") == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in few) == [(n + 1, w[0]) for n, w in enumerate(ranked(rows[:5], 0))]
    assert posting.search(df.where("false"), F.col("id") == 0).count() == 0
    assert posting.search(df.where("embedding is null"), F.col("id") == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = posting.search(df, F.col("id") % 20 == 0).toPandas().groupby("query_id").vec_id.agg(set)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(found)


def test_graph_search_finds_the_nearest():
    random = np.random.default_rng(6)
    graph = posting.CentroidGraph.of(random.normal(size=(900, 16)))
    x = random.normal(size=(50, 16))
    found, apart = graph.search(x)
    exact = np.sqrt(((x[:, None] - graph.centroids[None]) ** 2).sum(axis=2))
    assert apart == pytest.approx(np.take_along_axis(exact, found, 1))
    best = np.argsort(exact, axis=1)[:, :32]
    assert np.mean([len(set(a) & set(b[:64])) / 32 for a, b in zip(best.tolist(), found.tolist())]) > 0.97
    parts = posting.halved(random.normal(size=(1000, 4)), 16)
    assert parts.shape == (16, 4)


def test_equal_neighbours_go_by_ids_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(posting, "LIST_PART", 10)
    first = 1 << 60
    rows = [(first + i, [1.0, 0.5]) for i in range(200)] + [(20, [2.0, 1.0]), (None, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = posting.search(df, F.col("id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [first + i for i in range(20)]
    few = posting.search(df.where(F.col("vec_id").isNull() | (F.col("vec_id") < first + 5)), F.col("id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [*(first + i for i in range(5)), None]
