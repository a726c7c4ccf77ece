import numpy as np
from pyspark.sql import functions as F

from marlgraph.llm import similar

SCHEMA = "node_id long, domain string, vector array<float>, distance string"


def data(seed=0, n=1500, dim=16, groups=200):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / dim**0.5
    for g in range(groups):  # near ones
        a, b = rng.integers(0, n, 2)
        x[b] = x[a] + rng.standard_normal(dim) * rng.choice([0.0, 0.01, 0.05]) / dim**0.5
    return x.astype(np.float32)


def brute(x, k, limit):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in order[i] if d[i, j] <= limit}


def frame(spark, x, domain="d"):
    return spark.createDataFrame([(i, domain, [float(v) for v in row], "") for i, row in enumerate(x)], SCHEMA)


def pairs(df):
    return set(map(tuple, df.collect()))


def test_factor_one_is_exact_over_shards(spark):
    x = data()
    assert pairs(similar.near_pairs(frame(spark, x), 5, 0.3, 16, factor=1.0, capacity=200)) == brute(x, 5, 0.3)


def test_recall_of_the_relaxed_search(spark):
    x = data(3, 3000)
    want, got = brute(x, 5, 0.3), pairs(similar.near_pairs(frame(spark, x), 5, 0.3, 16, capacity=256))
    assert len(got & want) >= 0.95 * len(want) and got <= want | brute(x, 40, 0.3)


def test_shard_search_is_exact_at_factor_one():
    x = data(5, 2500)
    d, who = similar.Shard(x).search(x, np.arange(len(x)), 4, np.full(len(x), 10.0), 1.0)
    full = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    assert np.allclose(np.sort(full, 1)[:, :4], d, atol=1e-6)


def test_copies_ties_and_unusable_rows(spark):
    v = [1.0, 0.0]
    rows = [(i, " D ", v, "") for i in range(1, 41)] + [(i, "d", [1.0, 0.1], "") for i in (50, 51)] + [(60, "d", [1.0, 0.1], "")]
    rows += [(70, None, v, ""), (71, "d", None, ""), (72, "d", [1.0], ""), (73, "d", [0.0, 0.0], ""), (74, "d", [float("nan"), 1.0], ""), (75, "d", [None, 1.0], ""), (76, "d", [float("inf"), 1.0], ""), (None, "d", v, ""), (80, "e", v, "")]
    rows += rows[:10]
    got = pairs(similar.near_pairs(spark.createDataFrame(rows, SCHEMA), 5, 0.4, 2))
    want = set()
    for a in range(1, 41):  # the five smallest other ids
        want |= {(min(a, b), max(a, b)) for b in [i for i in range(1, 8) if i != a][:5]}
    for a in (50, 51, 60):  # their two copies, then three of the others
        want |= {(min(a, b), max(a, b)) for b in (50, 51, 60) if b != a} | {(b, a) for b in (1, 2, 3)}
    assert got == want


def test_empty_and_single(spark):
    assert similar.near_pairs(spark.createDataFrame([], SCHEMA), dim=2).count() == 0
    assert similar.near_pairs(spark.createDataFrame([(1, "d", [1.0, 0.0], "")], SCHEMA), dim=2).count() == 0


def test_ranks(spark):
    x = data(1, 300)
    rows = similar.nearest(frame(spark, x), 3, 10.0, 16, factor=1.0)
    assert rows.count() == 900 and rows.agg(F.max("rank"), F.min("rank")).first() == (3, 1)


def test_large_shards_are_divided_and_crowded_ones_get_visitors_in_parts(spark, monkeypatch):
    """A sample too small for the domain: the first trees leave shards of hundreds, their own trees bring all below twice the capacity, and factor one stays exact."""
    monkeypatch.setattr(similar, "COUNTED", 2)
    x, capacity, dim = data(7, 3000), 100, 16
    units = frame(spark, x).select("domain", F.col("node_id").alias("unit"), "vector")
    first = {d: similar.Routing(t, {}) for d, t in similar.fit_routing(units, dim, capacity, sample=100).items()}
    assert first["d"].shards <= 8
    whole = similar.divided(units, first, dim, capacity)
    sizes = [r["count"] for r in similar.placed(units, spark.sparkContext.broadcast(whole), dim).groupBy("leaf").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2 * capacity and whole["d"].shards >= len(sizes) > 20
    fit = similar.fit_routing
    monkeypatch.setattr(similar, "fit_routing", lambda u, d, c: fit(u, d, c, sample=100))
    assert pairs(similar.near_pairs(frame(spark, x), 5, 0.3, dim, factor=1.0, capacity=capacity)) == brute(x, 5, 0.3)
