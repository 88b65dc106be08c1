import hashlib
import math

import numpy as np
import pytest

from tabloom.llm import subvectors

SCHEMA = "vec_id long, embedding array<float>, id string, cluster int, words binary"


def brute(rows, k=8, rounds=10, dim=64):
    """The rounds in plain Python numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, c in last if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, last))


def found(spark, rows, parts=3):
    table = spark.createDataFrame([(i, v, "x", 9, b"w") for i, v in rows], SCHEMA).repartition(parts)
    out = subvectors.cluster(table)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_against_plain_rounds_with_odd_rows(spark):
    random = np.random.default_rng(5)
    some = [(i, (random.normal(size=64) + 3 * (i % 5)).round(1).tolist()) for i in range(150)]
    same = [(200 + i, [0.5] * 64) for i in range(40)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [math.nan] * 64), (305, [math.inf] * 64), (None, [-7.25] * 64), (306, [0.0] * 64)]
    rows = some + same + odd + some[:3] + [some[0]]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i % 2)] * 64) for i in range(n)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("levels", [2, 50, 100_000])
def test_chunks_lose_nothing(levels):
    x = np.random.default_rng(1).integers(-levels, levels, size=(700, 13))
    chunk = subvectors.Chunk.unpacked(*subvectors.Chunk.of(x).packed())
    assert (np.concatenate([w[c] for w, c in zip(chunk.words, chunk.codes)], axis=1) == x).all()
    c = x[:4]
    assert (chunk.distances(c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()
    cluster = np.arange(700) % 4
    assert (chunk.sums(cluster, 4) == np.array([x[cluster == i].sum(axis=0) for i in range(4)])).all()
    if levels == 2:
        assert max(w.shape[1] for w in chunk.words) > 1


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        subvectors.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()
