import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from devicehealth.operators import cluster, components as cc, density, evaluate, explain, geometry, models, ordering, quantiles as qt


def skewed(n, seed=3):
    """Values of which a third are one value, with a long tail and ties."""
    rng = np.random.default_rng(seed)
    v = np.round(np.exp(rng.normal(size=n) * 3), 2)
    v[rng.random(n) < 0.34] = 7.0
    return v


@pytest.mark.parametrize("small, large", [(0, 10**9), (10**9, 10**9), (0, 0)])
def test_quantiles_are_exact(spark, monkeypatch, small, large):
    monkeypatch.setattr(qt, "SMALL_GROUP", small)
    monkeypatch.setattr(qt, "LARGE_GROUP", large)
    v, w = skewed(20_000), skewed(20_000, 4)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = {(r["metric"], r["prob"]): r["value"] for r in qt.quantiles(df, ["v", "w"], probs, accuracy=500).collect()}
    for name, values in (("v", v), ("w", w)):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("large", [0, 10**9])
def test_quantiles_per_group_with_a_hot_group(spark, monkeypatch, large):
    monkeypatch.setattr(qt, "SMALL_GROUP", 500)
    monkeypatch.setattr(qt, "LARGE_GROUP", large)
    v = skewed(9_000)
    g = np.where(np.arange(9_000) % 3 == 0, 0, np.arange(9_000) % 40)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    got = {r["g"]: r["value"] for r in qt.quantiles(df, ["v"], [0.9], by=["g"], accuracy=500).collect()}
    for key in np.unique(g):
        assert got[key] == pytest.approx(np.quantile(v[g == key], 0.9), rel=1e-12)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert [(r["metric"], r["value"]) for r in qt.quantiles(df, ["a", "b"], [0.5]).collect()] == [("a", 2.0)]


def test_prefix_sums_and_positions(spark):
    v = skewed(3_000)
    pdf = pd.DataFrame({"id": np.arange(3_000), "g": np.arange(3_000) % 2, "v": v, "one": 1})
    df = spark.createDataFrame(pdf)
    got = ordering.ordered_position(df, "v", ["g"], ["id"], ranges=16).toPandas().set_index("id")["position"]
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got.sort_index() == want.sort_index()).all()
    pdf["name"] = [f"host-{i:05d}" for i in range(3_000)]
    named = ordering.ordered_position(spark.createDataFrame(pdf), "v", ["g"], ["name"], ranges=16).toPandas().set_index("id")["position"]
    assert (named.sort_index() == want.sort_index()).all()
    split = ordering.value_ranges(df, "v", ["id"], 16).where("v = 7").select("_range", "_part").distinct().collect()
    assert len({r["_range"] for r in split}) == 1 and len(split) > 8
    same = spark.createDataFrame([(i, 1.0, 2) for i in range(10)], "id int, v double, n int")
    sums = ordering.prefix_sums(same, "v", ["n"], tie=["id"]).orderBy("id").collect()
    assert [r["before_n"] for r in sums] == [2 * i for i in range(10)]


def test_roc_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 2_000), np.round(rng.random(2_000), 1)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_crosses_periods(spark, inclusive):
    left = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-05 00:00:00"), (3, "b", "2024-01-01 00:00:00"), (4, "a", "2024-01-01 09:00:00")],
                                 "id int, u string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([(9, "a", "2024-01-01 09:00:00", 5.0), (8, "a", "2024-01-02 09:00:00", 6.0)], "id int, u string, t string, v double").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    got = {r["id"]: r["v"] for r in ordering.as_of(left, right, "u", "t", ["v"], "id", inclusive=inclusive).collect()}
    assert got == {1: 5.0, 2: 6.0, 3: None, 4: 5.0 if inclusive else None}


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_spreads_a_key_of_one_day(spark, inclusive):
    rng = np.random.default_rng(11)
    rows = pd.DataFrame({"id": np.arange(6_000), "u": np.where(rng.random(6_000) < 0.9, "hot", "u" + pd.Series(rng.integers(0, 40, 6_000)).astype(str)),
                         "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4_000, 6_000), unit="s"), "v": np.arange(6_000) * 1.0})
    sides = rng.random(6_000) < 0.5
    left, right = rows[sides].drop(columns="v"), rows[~sides]
    blank = pd.DataFrame({"id": [-1, -2], "u": [None, "hot"], "t": [pd.Timestamp("2024-01-02"), pd.NaT]})
    left = pd.concat([left, blank], ignore_index=True)
    extra = pd.DataFrame({"id": [-3, -4], "u": [None, "hot"], "t": [pd.Timestamp("2024-01-01"), pd.NaT], "v": [-3.0, -4.0]})
    frames = [spark.createDataFrame(x).withColumn("t", F.col("t").cast("timestamp_ntz")) for x in (left, pd.concat([right, extra], ignore_index=True))]
    got = ordering.as_of(*frames, "u", "t", ["v"], "id", inclusive=inclusive, pieces=16).toPandas().set_index("id")["v"].sort_index()
    known = left.dropna().sort_values("t", kind="stable")
    want = pd.merge_asof(known, right.sort_values(["t", "id"]).drop(columns="id"), on="t", by="u", allow_exact_matches=inclusive).set_index("id")["v"]
    want = want.reindex(got.index)
    assert len(got) == len(left) and np.array_equal(got.to_numpy(float), want.to_numpy(float), equal_nan=True)
    sizes = ordering.order_pieces(frames[1].where("u = 'hot'"), ["u", "t", "id"], 16).groupBy("_piece").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 3 * sizes.mean()


def test_ties_with_a_common_prefix_fall_into_many_pieces(spark):
    names = [f"a-very-long-common-prefix-{i:05d}" for i in range(3_000)]
    df = spark.createDataFrame([(1.0, n, i) for i, n in enumerate(names)] + [(None, "a", -1), (0.5, None, -2)], "v double, name string, i int")
    got = ordering.ordered_position(df, "v", tie=["name"], ranges=16).toPandas().set_index("i")["position"]
    assert got[-1] == 1 and got[-2] == 2 and (got.sort_index().to_numpy()[2:] == np.arange(3, 3_003)).all()
    sizes = ordering.order_pieces(df, ["v", "name"], 16).groupBy("_piece").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 3 * sizes.mean()
    # A text as the ordered column itself.
    by_name = ordering.ordered_position(df, "name", ranges=16).where("i >= 0").toPandas().set_index("i")["position"].sort_index()
    assert (by_name.to_numpy() == np.arange(3, 3_003)).all()


def blobs(n=260, seed=5):
    """Three dense groups, a third of the rows in one spot, and some noise."""
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.3, (n // 3, 3)), rng.normal(4, 0.5, (n // 3, 3)), rng.uniform(-3, 9, (n - 2 * (n // 3), 3))])
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(n))


def brute_dbscan(pdf, eps, k):
    x = pdf[["a", "b", "c"]].to_numpy()
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= k
    label = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                p = stack.pop()
                if label[p] < 0:
                    label[p] = n
                    stack += [q for q in np.flatnonzero(near[p] & core) if label[q] < 0]
            n += 1
    for i in np.flatnonzero(~core):
        hits = label[np.flatnonzero(near[i] & core)]
        if len(hits):
            label[i] = hits.min()
    return label, core


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_dbscan_equals_brute_force(spark, block_rows):
    pdf = blobs()
    want, core = brute_dbscan(pdf, 0.8, 6)
    got = density.dbscan(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 0.8, 6, block_rows).toPandas().sort_values("id")
    assert (got["cluster"].to_numpy() == want).all() and (got["is_core"].to_numpy() == core).all()
    assert want.max() >= 1 and (want == -1).any()


def test_dbscan_full_cells_ties_and_no_rows(spark):
    rng = np.random.default_rng(4)
    # A third of all rows at one place, a chain of single cells beside it, points at just the distance, noise.
    x = np.concatenate([np.zeros((120, 3)), np.outer(np.arange(1, 90), [0.5, 0, 0]), rng.normal(8, 0.6, (100, 3)), rng.uniform(-9, -3, (40, 3))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=rng.permutation(len(x))).sort_values("id").reset_index(drop=True)
    for eps, k, block_rows in ((0.5, 3, 16), (1.5, 10, 2048)):
        want, core = brute_dbscan(pdf, eps, k)
        got = density.dbscan(spark.createDataFrame(pdf), "id", ["a", "b", "c"], eps, k, block_rows).toPandas().sort_values("id")
        assert (got["cluster"].to_numpy() == want).all() and (got["is_core"].to_numpy() == core).all()
    assert density.dbscan(spark.createDataFrame(pdf.head(1)).where("false"), "id", ["a", "b", "c"]).count() == 0


def test_grid_copies_a_row_to_the_root_of_the_tasks():
    # The same number of copies at any number of rows that fits the blocks, so shuffled rows grow in proportion.
    assert [geometry.grid_side(n, 200) for n in (10_000, 100_000, 1_000_000)] == [15, 15, 15]
    assert geometry.grid_side(10_000_000, 200) == 100 and geometry.grid_side(0, 8) == 1 and geometry.grid_side(2, 8) == 2
    assert [geometry.grid_side(10_000, t) for t in (1, 4, 5, 9, 10)] == [1, 2, 3, 3, 4]


def test_tiles_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(15, 3))
    got = np.zeros((20, 15))
    for here, there, gaps in geometry.tiles(a, b):
        got[here, there] += gaps
    assert np.allclose(got, geometry.distances(a, b))


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_silhouette_equals_brute_force(spark, block_rows):
    pdf = blobs(90)
    pdf["g"] = pdf["id"] % 3
    pdf.loc[0, "g"] = 7
    x = pdf[["a", "b", "c"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, g in enumerate(pdf["g"]):
        own = (pdf["g"] == g).to_numpy() & (pdf["id"] != i).to_numpy()
        if not own.any():
            want.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, (pdf["g"] == o).to_numpy()].mean() for o in pdf["g"].unique() if o != g)
        want.append((b - a) / max(a, b))
    got = geometry.silhouette_samples(spark.createDataFrame(pdf), "id", ["a", "b", "c"], "g", block_rows).toPandas().sort_values("id")
    assert np.allclose(got["silhouette"], want)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1300)]
    edges = spark.createDataFrame(chain + hub, "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1300), 5000]], "node bigint")
    got = {r["node"]: r["component"] for r in cc.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[5000] == 5000


def test_division_separates_blobs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10, 15)])
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(80), truth=np.repeat(range(4), 20))
    df = spark.createDataFrame(pdf)
    got = cluster.divisive(df, ["a", "b"], 4).toPandas()
    assert got.groupby("truth")["cluster"].nunique().eq(1).all() and got["cluster"].nunique() == 4
    gap = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(Exception, match="null"):
        cluster.divisive(gap, ["a", "b"], 4).count()


def test_spikes_with_ties(spark):
    flat = [("f", i, float(i), 0.0 if i < 25 else 10.0) for i in range(50)]
    curve = spark.createDataFrame(flat, "feature string, i int, x double, prediction double")
    got = explain.nth_spike(explain.spikes(explain.gradient(curve)), {"f": 4}).first()
    assert (got["threshold"], got["spike_used"], got["complete"]) == (25.0, 1, False)


def test_root_causes_of_given_device(spark):
    metrics = ["avg_processor_time", "max_cpu_usage", "avg_cpu_temp"]
    fleet = spark.createDataFrame([(float(v), float(v), float(v)) for v in range(101)], ", ".join(f"{m} double" for m in metrics))
    device = spark.createDataFrame([("d", 30.0, 92.0, 100.0)], "id string, " + ", ".join(f"{m} double" for m in metrics))
    got = explain.root_causes(device, ["id"], metrics, {"avg_processor_time": 0.5, "max_cpu_usage": 0.25, "avg_cpu_temp": 0.25}, reference=fleet).collect()
    assert [(r["metric"], round(r["confidence"], 4)) for r in got] == [("avg_cpu_temp", 83.3333), ("max_cpu_usage", 16.6667)]
    calm = spark.createDataFrame([("d", 1.0, 1.0, 1.0)], device.schema)
    assert explain.root_causes(calm, ["id"], metrics, {m: 1.0 for m in metrics}, reference=fleet).count() == 0


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in models.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_models_keep_their_invariants(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.random(400), "b": rng.random(400)})
    pdf["y"] = pdf["a"] * 10
    pdf["k"] = (pdf["a"] > 0.9).astype(int)
    df = spark.createDataFrame(pdf)
    model = models.forest_regression(df, ["a", "b"], "y", models.Size(5, 4))
    weights = models.importance_map(model, ["a", "b"])
    assert sum(weights.values()) == pytest.approx(1.0) and weights["a"] > weights["b"]
    again = models.forest_regression(df, ["a", "b"], "y", models.Size(5, 4))
    first, second = model.transform(df).orderBy("id").toPandas(), again.transform(df).orderBy("id").toPandas()
    assert np.allclose(first["prediction"], second["prediction"])
    scored = models.forest_classification(df, ["a", "b"], "k", models.Size(5, 4)).transform(df)
    probs = scored.select(models.vector_to_array("probability").alias("p")).toPandas()["p"]
    assert len(probs) == 400 and all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p in probs)
    ranked = models.class_probabilities(scored, ["id"], ["no", "yes"], 2)
    assert ranked.count() == 800 and ranked.where("rank = 1 and probability < 0.5").count() == 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "k int")
    got = {r["k"]: r["weight"] for r in models.balanced_weights(df, "k").collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
