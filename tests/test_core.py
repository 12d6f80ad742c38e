"""Core operators on small tables, and the query catalogue against its SQL."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import image_properties as ip
from lumenframe.functions import special, text
from lumenframe.functions import vectors as V
from lumenframe.operators import batch, cluster, contract, correlation, distance, explain, graph, joins, predicates, reduce, stats
from lumenframe.sources import discovery, images


@pytest.fixture(scope="module")
def cat(spark):
    rows = [(0, "a/x.tif", "A", 1, 1.0), (1, "a/y.tif", "a", 1, None), (2, "b/x.tif", None, 2, float("nan")), (3, "b/z.png", "", 2, 4.0)]
    return spark.createDataFrame(rows, "image_index bigint, image_path string, Drug string, plate int, area double")


def ids(df):
    return sorted(r["image_index"] for r in df.collect())


def test_metadata_filter_modes(cat):
    assert ids(predicates.metadata_filter(cat, {"drug": "A"})) == [0]
    assert ids(predicates.metadata_filter(cat, {"drug": ["A", None]})) == [0, 2]
    assert ids(predicates.metadata_filter(cat, {"drug": None})) == [0, 1, 2, 3]
    assert ids(predicates.metadata_filter(cat, {"plate": "1"})) == []
    assert ids(predicates.metadata_filter(cat, {"plate": 1.0}, {"drug": "a"})) == [0]
    with pytest.warns(UserWarning):
        assert ids(predicates.metadata_filter(cat, {"nope": 1})) == []
    with pytest.warns(UserWarning):
        assert ids(predicates.metadata_filter(cat, None, {"nope": 1})) == [0, 1, 2, 3]
    assert ids(predicates.file_table_filter(cat, {"nope": 1, "plate": 2})) == [2, 3]
    assert ids(predicates.file_table_filter(cat, {"drug": None})) == []


def test_ranges_and_finite(cat):
    assert ids(cat.where(predicates.numeric_range(F.col("area"), 1, 4))) == [0, 3]
    assert ids(predicates.finite_rows(cat, ["area"], min_rows=1)) == [0, 3]
    assert ids(predicates.finite_rows(cat, ["area"])) == []
    assert predicates.informative_properties(cat, ["area", "plate"], 2) == ["area", "plate"]


def test_contract(cat):
    assert contract.tier_a(cat, image_name=True).columns == ["image_index", "image_path", "image_name", "Drug", "plate", "area"]
    assert contract.match_names(["AREA", "plate", "area"], ["plate", "area"]) == ["area", "plate"]
    with pytest.raises(ValueError):
        contract.match_names(["a"], ["a", "A"])
    assert contract.image_info(cat, 2).first()["area"] is None
    prof = {r["column"]: r for r in contract.column_profile(cat, ["Drug", "plate", "area"]).collect()}
    assert prof["plate"]["kind"] == "discrete"


def test_group_stats(cat):
    g = {r["plate"]: r for r in stats.property_stats_by_group(cat, ["area"], ["plate"]).collect()}
    assert g[1]["N"] == 2 and g[1]["area_mean"] == 1.0 and g[1]["area_std"] is None
    assert stats.property_stats_by_group(cat, ["area"], ["Drug"]).count() == 3
    d = {r["value"]: (r["n"], r["percent"]) for r in stats.value_distribution(cat, "Drug", top=1).collect()}
    assert d == {"A": (1, 50.0), "Other": (1, 50.0), "Missing": (2, None)}
    assert stats.property_stats_by_group(cat.limit(0), ["area"], ["plate"]).count() == 0


def test_special_functions():
    assert abs(float(special.t_two_sided(np.array([2.0]), np.array([10.0]))[0]) - 0.07338803) < 1e-6
    assert abs(special.t_quantile(0.975, 5) - 2.570582) < 1e-4
    assert abs(float(special.digamma(np.array([1.0]))[0]) + 0.5772156649) < 1e-9


def test_enrichment_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, g = rng.normal(5, 2, 60), np.array(["a", "b", "c"])[rng.integers(0, 3, 60)]
    x[g == "a"] += 3
    df = spark.createDataFrame([(str(a), float(b), 1.0) for a, b in zip(g, x)] + [("d", 1.0, 1.0), (None, 9.0, 1.0)], "g string, x double, flat double")
    r = {(v["group"], v["property"]): v for v in stats.group_enrichment(df, "g", ["x", "flat"]).collect()}
    assert set(r) == {(k, "x") for k in "abc"}
    full = np.append(x, 1.0)
    lab = np.append(g, "d")
    a, b = full[lab == "a"], full[lab != "a"]
    assert abs(r["a", "x"]["score"] - (a.mean() - b.mean()) / b.std(ddof=1)) < 1e-9
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    assert abs(r["a", "x"]["t"] - t) < 1e-9 and r["a", "x"]["significant"]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.l2_normalize(F.col("a")).alias("n"), V.l2_normalize(F.col("b")).alias("z"), V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert np.allclose(r[0]["n"], [0.6, 0.8]) and r[0]["z"] == [0.0, 0.0] and r[0]["c"] == 1.0 and r[0]["e"] == 5.0 and r[1]["n"] is None


def test_distances_and_outliers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal([5, 0, 0], 0.1, (30, 3)), [[0, 5, 0]]])
    f = spark.createDataFrame([(i, "g" if i % 2 else None, [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, g string, features array<double>")
    images_ = f.select("image_index", "g").unionByName(spark.createDataFrame([(99, "g")], "image_index bigint, g string"))
    for kind in ("euclidean", "cosine"):
        for mode in ("centroid", "all_to_all"):
            r = {v["image_index"]: v for v in distance.reference_distances(images_, f.select("image_index", "features"), F.col("g") == "g", 3, mode=mode, kind=kind).collect()}
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            ref = u[1::2]
            c = ref.mean(0)
            if mode == "centroid":
                want = np.linalg.norm(u - c, axis=1) if kind == "euclidean" else 1 - u @ c / np.linalg.norm(c)
            else:
                want = np.linalg.norm(u[:, None] - ref, axis=2).min(1) if kind == "euclidean" else (1 - u @ ref.T).min(1)
            assert np.allclose([r[i]["distance"] for i in range(31)], want, atol=1e-9) and r[99]["distance"] is None
    with pytest.raises(ValueError):
        distance.reference_distances(images_, f, F.col("g") == "zzz", 3)
    assert [r["image_index"] for r in distance.outliers(f, None, 3).collect()] == [30]
    assert {r["group"] for r in distance.outliers(f, "g", 3, threshold=2).collect()} == {"N/A"}
    p = distance.prototypes(f, "g", 3, n=2).collect()
    assert {r["g"] for r in p} == {"g", None} and max(r["rank_in_group"] for r in p) == 2


def bounded(monkeypatch, spark, mb):
    """Python functions over batches of rows fail, if what they hold at once grows by more than this."""
    kind = type(spark.range(1))
    real = kind.mapInArrow

    def watched(self, f, schema, *more, **options):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            yield from f(batches)
            most = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            if most > mb << 20:
                raise MemoryError(f"{most >> 20} MB")

        return real(self, run, schema, *more, **options)

    monkeypatch.setattr(kind, "mapInArrow", watched)


@pytest.mark.parametrize("held", [None, 60_000])
def test_nearest_of_many_references_in_little_memory(spark, monkeypatch, held):
    if held:
        monkeypatch.setattr(distance.cells, "HELD", held)
    bounded(monkeypatch, spark, 100)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (4000, 3)) for c in ([3, 0, 0], [0, 3, 0])])
    x[5] = 0
    f = spark.createDataFrame([(i, i >= 2000, [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, ref boolean, features array<double>").coalesce(1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    for kind in ("euclidean", "cosine"):
        got = {r["image_index"]: r["distance"] for r in distance.nearest_reference_distances(f, F.col("ref"), 3, kind).collect()}
        for i in range(40):
            d = np.sqrt(((u[i] - u[2000:]) ** 2).sum(1)) if kind == "euclidean" else 1 - u[2000:] @ u[i]
            assert abs(got[i] - (1.0 if i == 5 else d.min())) < 1e-12
        assert {got[i] for i in range(2000, 8000)} == {0.0}


@pytest.mark.parametrize("held, flags", [(None, None), (400_000, 0)])
def test_dense_clusters_in_little_memory(spark, monkeypatch, held, flags):
    if held:
        monkeypatch.setattr(cluster.cells, "HELD", held)
        monkeypatch.setattr(cluster, "FLAGS", flags)
    bounded(monkeypatch, spark, 100)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.01, (2500, 64)), np.eye(64)[1] * 5 + np.arange(40)[:, None] * np.eye(64)[0] * 0.4, rng.normal(0, 30, (60, 64))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, features array<double>").coalesce(1)
    got = {r["image_index"]: r["cluster"] for r in cluster.dbscan(df, 64, 0.5, 3).collect()}
    near = [np.flatnonzero(np.sqrt(((x - r) ** 2).sum(1)) <= 0.5) for r in x]
    core = np.array([len(n) >= 3 for n in near])
    lab = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        todo = [i] if lab[i] < 0 else []
        lab[todo] = i
        while todo:
            new = [b for b in near[todo.pop()] if core[b] and lab[b] < 0]
            lab[new] = i
            todo += new
    names = {c: k for k, c in enumerate(np.unique(lab[core]))}
    for i, n in enumerate(near):
        at = i if core[i] else min(n[core[n]], default=None)
        assert got[i] == (None if at is None else names[lab[at]])


def test_mutual_information_of_long_columns(spark):
    import tracemalloc

    def plain(x, y, k=3):
        x, y = ((v - v.mean()) / v.std() for v in (x, y))
        dx, dy = (np.abs(v[:, None] - v) for v in (x, y))
        d = np.maximum(dx, dy)
        np.fill_diagonal(d, np.inf)
        r = np.nextafter(np.sort(d, 1)[:, k - 1], 0)[:, None]
        n = len(x)
        counts = special.digamma(np.maximum((dx <= r).sum(1), 1)) + special.digamma(np.maximum((dy <= r).sum(1), 1))
        mi = special.digamma(np.array([n]))[0] + special.digamma(np.array([k]))[0] - counts.mean()
        return np.sqrt(max(0.0, 1 - np.exp(-2 * max(mi, 0))))

    rng = np.random.default_rng(8)
    a = rng.normal(size=1500)
    cases = [(a, a + rng.normal(size=1500)), (a**5, np.abs(a) ** 0.2), (np.repeat(a[:300], 5), np.repeat(a[300:600], 5)), (a, np.append(np.zeros(1499), 3.0)), (np.append(a[1:], 1e6), a)]
    for x, y in cases:
        assert abs(correlation.mutual_information_correlation(x, y) - plain(x, y)) < 1e-9
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(*cases[2])], "p double, t double")
    assert abs(correlation.property_correlations(df, "t", ["p"], "mutual_info").first()["r"] - plain(*cases[2])) < 1e-9
    x = rng.normal(size=20_000)
    y = x + rng.normal(size=20_000)
    tracemalloc.start()
    assert abs(correlation.mutual_information_correlation(x, y) - np.sqrt(0.5)) < 0.02
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20


def test_correlations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=40)
    y[3] = np.nan
    df = spark.createDataFrame([([float(v) for v in r], float(b), 7.0) for r, b in zip(x, y)], "e array<double>, p double, flat double")
    r = {(v["property"], v["dim"]): v["r"] for v in correlation.embedding_property_correlations(df, "e", ["p", "flat"], 4).collect()}
    ok = np.isfinite(y)
    for d in range(4):
        assert abs(r["p", d] - np.corrcoef(x[ok, d], y[ok])[0, 1]) < 1e-9 and r["flat", d] is None
    s = correlation.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 9.0)], "x double, y double"), "x", "y").first()
    assert abs(s["rho"] - 0.9486832980505138) < 1e-9
    a = rng.normal(size=300)
    assert correlation.distance_correlation(a, a) == pytest.approx(1) and correlation.distance_correlation(a, rng.normal(size=300)) < 0.3
    assert correlation.mutual_information_correlation(a, a**2) > 0.7
    assert math.isnan(correlation.distance_correlation(a[:3], a[:3])) and math.isnan(correlation.distance_correlation(a, np.ones(300)))
    for u, v in ((a, a**2 + rng.normal(size=300)), (np.round(a), np.round(rng.normal(size=300))), (a * 1e6 + 1e9, a[::-1])):
        g, h = (np.abs(z[:, None] - z) for z in (u, v))
        g, h = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (g, h))
        assert correlation.distance_correlation(u, v) == pytest.approx(np.sqrt((g * h).sum() / np.sqrt((g * g).sum() * (h * h).sum())), rel=1e-6)


def test_batches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) @ np.diag([1, 2, 3]) + 5
    df = spark.createDataFrame([(i, float(i % 2 + 3), [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, b double, e array<double>")
    z, st = batch.correct_batches(df, "b", "e", 3, method="zscore")
    m = np.stack([r["corrected"] for r in z.where("b = 3").collect()])
    assert np.allclose(m.mean(0), 0, atol=1e-9) and np.allclose(m.std(0, ddof=1), 1)
    assert {r["batch_id"] for r in st.collect()} == {"3", "4"}
    w, _ = batch.correct_batches(df, "b", "e", 3)
    c = np.cov(np.stack([r["corrected"] for r in w.where("b = 4").collect()]).T)
    assert np.allclose(c, np.eye(3), atol=0.02)
    with pytest.raises(ValueError):
        batch.batch_stats(df, "b", "e", 3, F.col("image_index") < 2)
    with pytest.raises(ValueError):
        batch.batch_stats(df.withColumn("b", F.when(F.col("image_index") > 3, F.col("b"))), "b", "e", 3)


def test_pca_and_maps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1] + 2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, f array<double>")
    m = reduce.pca(df, "f", 5, 2)
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(m.ratio, w[:2] / w.sum())
    y = m.transform(df, "image_index", "f").orderBy("image_index").toPandas()[["component_1", "component_2"]].to_numpy()
    assert np.allclose(y.var(0, ddof=1), w[:2]) and np.allclose(y.mean(0), 0, atol=1e-9)
    g = np.concatenate([rng.normal(0, 0.1, (25, 4)), rng.normal(5, 0.1, (25, 4))])
    for f in (lambda: reduce.tsne(g, perplexity=10), lambda: reduce.umap(g, neighbours=8)):
        z = f()
        gap = np.linalg.norm(z[:25].mean(0) - z[25:].mean(0))
        assert gap > 2 * max(z[:25].std(0).max(), z[25:].std(0).max())
    with pytest.raises(ValueError):
        reduce.tsne(g, perplexity=60)


def test_maps_place_every_row(spark, monkeypatch):
    monkeypatch.setattr(reduce, "SAMPLE", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (60, 4)), rng.normal(5, 0.1, (60, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "image_index bigint, f array<double>")
    for method, options in (("tsne", {"perplexity": 10}), ("umap", {"neighbours": 8})):
        y = reduce.reduce_dimensions(df, "image_index", "f", 4, method, **options).toPandas().sort_values("image_index")
        assert y["image_index"].tolist() == list(range(120))
        z = y[["component_1", "component_2"]].to_numpy()
        assert np.linalg.norm(z[:60].mean(0) - z[60:].mean(0)) > 2 * max(z[:60].std(0).max(), z[60:].std(0).max())
        assert reduce.reduce_dimensions(df, "image_index", "f", 4, method, sample=30, **options).count() == 30


def test_clusterings(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ([0, 0], [5, 0], [0, 5])] + [[[20, 20]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_index bigint, features array<double>")
    near = df.where("image_index < 120")
    for lab in (cluster.kmeans(near, 3), cluster.diagonal_gmm(near, 3, 2, seed=1)):
        got = {r["image_index"]: r["cluster"] for r in lab.collect()}
        assert len({got[i] for i in range(40)}) == 1 or len(set(got.values())) <= 3
    d = {r["image_index"]: r["cluster"] for r in cluster.dbscan(df, 2, 0.5, 4).collect()}
    assert d[120] is None and {d[i] for i in range(40)} == {0} and {d[i] for i in range(40, 80)} == {1} and {d[i] for i in range(80, 120)} == {2}
    lab = spark.createDataFrame([(i, v) for i, v in d.items()], "image_index bigint, cluster int")
    assert cluster.silhouette(df, lab, 2) > 0.9
    assert cluster.silhouette(df, lab.where("cluster = 0"), 2) is None
    assert cluster.dbscan(df.limit(0), 2).count() == 0


def test_silhouette_of_all_rows(spark):
    """22,001 rows in few places, so that the score is known."""
    sizes = {0: 12_000, 1: 8_000, 2: 2_001}
    at = {0: 0.0, 1: 3.0, 2: 5.0}
    rows = spark.range(sum(sizes.values())).withColumn("cluster", F.when(F.col("id") < 12_000, 0).when(F.col("id") < 20_000, 1).otherwise(2))
    x = F.when(F.col("id") % 1000 == 0, 4.0).otherwise(F.when(F.col("cluster") == 0, at[0]).when(F.col("cluster") == 1, at[1]).otherwise(at[2]))
    df = rows.select(F.col("id").alias("image_index"), F.array(x, F.lit(1.0)).alias("features"))
    lab = rows.select(F.col("id").alias("image_index"), "cluster")
    got = cluster.silhouette(df, lab, 2)
    c = np.repeat([0, 1, 2], list(sizes.values()))
    pos = np.where(np.arange(len(c)) % 1000 == 0, 4.0, np.array([at[v] for v in (0, 1, 2)])[c])
    want = 0.0
    for own in sizes:
        for p in np.unique(pos[c == own]):
            mean = {o: np.abs(pos[c == o] - p).sum() / (sizes[o] - (o == own)) for o in sizes}
            near, far = mean.pop(own), min(mean.values())
            want += ((c == own) & (pos == p)).sum() * (far - near) / max(near, far)
    assert abs(got - want / len(c)) < 1e-9


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(e, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1080), 1000)}
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_explain(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4))
    y = 3 * x[:, 1] - x[:, 2] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(i, *[float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "image_index bigint, a double, b double, c double, d double, y double")
    w, r2 = explain.lasso_axis(df, list("abcd"), "y")
    rows = w.collect()
    assert [r["feature"] for r in rows][:2] == ["b", "c"] and rows[0]["weight"] > 0 > rows[1]["weight"] and r2 > 0.95
    assert explain.lasso_axis(df.limit(3), list("abcd"), "y")[1] is None


def test_paths_and_ids(spark):
    p = spark.createDataFrame([("/data/project/DrugA/24h/crop_01.tif",), ("x/s.ome.tif",), ("f.nii.gz",), ("my.image",), ("a\\b c\\d:e.png",), ("",)], "p string")
    t = discovery.template_metadata(p, ".../(drug)/(time)/(crop_name).tif", "p", "keep").first()
    assert (t["drug"], t["time"], t["crop_name"]) == ("DrugA", "24h", "crop_01")
    assert [r[0] for r in p.select(text.strip_known_extension(text.basename(F.col("p")))).collect()] == ["crop_01", "s.ome", "f.nii", "my.image", "d:e", ""]
    assert [r[0] for r in p.select(text.path_to_id(F.col("p"))).collect()][3:] == ["my.image", "a_b_c_d_e", None]
    m = spark.createDataFrame([("01",), ("1e5",), ("24h",), ("7",)], "x string").select(text.restore_meta_type(F.col("x")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in m] == [(None, 1.0, None), (None, 100000.0, None), (None, None, "24h"), (7, None, None)]
    b = spark.createDataFrame([(3.0,), (3.5,), (None,)], "x double").select(text.stable_batch_id(F.col("x"), "double")).collect()
    assert [r[0] for r in b] == ["3", "3.5", "__missing__"]
    assert text.group_key(["drug", "channel_index"]) == "drug"


def test_lookup_channels_masks(spark):
    f = spark.createDataFrame([("d/a.tif",), ("e/b.tif",), ("e/c.tif",)], "file_path string")
    lut = spark.createDataFrame([("a", "x"), ("e/b.tif", "y")], "filename string, cond string")
    assert {(r["file_path"], r["cond"]) for r in discovery.lookup_metadata(f, lut, "filename", on_missing="keep").collect()} == {("d/a.tif", "x"), ("e/b.tif", "y"), ("e/c.tif", None)}
    with pytest.raises(ValueError):
        discovery.lookup_metadata(f, lut.union(lut), "filename")
    ch = spark.createDataFrame([("w", 1, "w1"), ("w", 0, "w0"), ("v", 0, "v0"), ("v", 2, "v2")], "well string, channel_index int, file_path string")
    assert discovery.merge_channels(ch.where("well = 'w'"), ["well"]).first()["channel_paths"] == ["w0", "w1"]
    with pytest.raises(Exception, match="channels"):
        discovery.merge_channels(ch, ["well"]).collect()
    img = spark.createDataFrame([("i/a.tif", None), ("i/b.tif", "given.png"), ("i/c.tif", None)], "image_path string, mask_path string")
    masks = spark.createDataFrame([("m/a.png",), ("m/x/c.png",), ("m/y/c.png",)], "file_path string")
    assert {r["image_path"]: r["mask_path"] for r in discovery.resolve_masks(img, masks, root="i", mask_root="m").collect()} == {"i/a.tif": "m/a.png", "i/b.tif": "given.png", "i/c.tif": None}


@pytest.mark.parametrize("parts", [2, 4, 8, 200])
def test_index_by_path(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(i), f"r{rng.integers(3)}/{rng.integers(400)}.png" if i % 3 else "hot.png") for i in rng.permutation(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        want = [i for _, i in sorted((p, i) for i, p in rows)]
        for _ in range(2):
            t = spark.createDataFrame(rows, "was bigint, image_path string").repartition(7)
            got = discovery.index_by_path(t).orderBy("image_index").collect()
            assert [r["image_index"] for r in got] == list(range(1500)) and [r["was"] for r in got] == want
        assert discovery.index_by_path(t.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_alignment(spark, cat):
    with pytest.raises(ValueError):
        discovery.require_unique_ids(cat.withColumn("id", F.lit("x")))
    other = spark.createDataFrame([(10, "/mnt/a/x.tif"), (11, "/mnt/q/z.png"), (12, "x.tif")], "o bigint, path string")
    got = {(r["image_index"], r["o"]) for r in joins.portable_path_join(cat, other, "image_path", "path", "image_index", "o").collect()}
    assert got == {(0, 10), (3, 11)}
    new = spark.createDataFrame([(0, float("nan"), 5.0), (9, 1.0, None)], "image_index bigint, area double, p double")
    m = {r["image_index"]: (r["area"], r["p"]) for r in joins.merge_properties(cat.select("image_index", "area"), new).collect()}
    assert m[0] == (1.0, 5.0) and m[9] == (1.0, None) and m[3] == (4.0, None)
    with pytest.raises(KeyError):
        joins.align_by_index(cat, new)
    with pytest.raises(ValueError):
        joins.not_done(cat, new.where("image_index = 9"), "image_index", require_overlap=True)
    both, added = joins.append_new(cat, spark.createDataFrame([(7, "n.tif"), (8, "n.tif"), (9, "a/x.tif")], "image_index bigint, image_path string"))
    assert ids(added) == [7] and both.count() == 5
    assert ids(joins.enrich_metadata(cat, spark.createDataFrame([(0, None)], "image_index bigint, Drug string"), "image_index").where("Drug IS NULL")) == [0, 2]


# --- images ---------------------------------------------------------------------------------------------------------


def png(x):
    h, w = x.shape[:2]
    c = {1: 0, 2: 4, 3: 2, 4: 6}[x.shape[2] if x.ndim == 3 else 1]
    raw = b"".join(b"\0" + r.astype(x.dtype.newbyteorder(">")).tobytes() for r in x)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, x.itemsize * 8, c, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def tiff(x):
    data, h, w = x.tobytes(), *x.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, x.itemsize * 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data)), (339, 3, 3 if x.dtype.kind == "f" else 1)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + body


def test_decoders():
    import io

    for dt in (np.uint8, np.uint16):
        x = np.arange(60, dtype=dt).reshape(5, 4, 3) * 7
        assert (images.decode(png(x), "x.png") == x).all()
    y = np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000
    assert (images.decode(tiff(y), "x.tif")[..., 0] == y).all()
    b = io.BytesIO()
    np.save(b, np.arange(24, dtype=np.uint16).reshape(2, 4, 3))
    assert images.decode(b.getvalue(), "x.npy").shape == (2, 4, 3)
    assert images.ensure_hwc(np.zeros((3, 40, 50))).shape == (40, 50, 3)
    with pytest.raises(ValueError):
        images.decode(b"junk", "x.dat.png2")


def test_image_properties():
    yy, xx = np.mgrid[:40, :40]
    m = ((yy - 20) ** 2 + (xx - 20) ** 2 <= 100).astype(float)
    s = ip.shape(None, m)
    assert abs(s["area"] - math.pi * 100) < 8 and s["eccentricity"] < 0.1 and s["solidity"] > 0.9 and s["euler_number"] == 1 and 0.8 < s["circularity"] < 1.2
    hole = m.copy()
    hole[18:22, 18:22] = 0
    assert ip.shape(None, hole)["euler_number"] == 0
    assert math.isnan(ip.shape(None, np.zeros((4, 4)))["area"])
    img = yy.astype(float)
    assert ip.intensity("mean")(img, None) == {"intensity_mean": 19.5}
    assert ip.masked_intensity("std")(img, np.zeros((40, 40)))["intensity_std_masked"] != 0
    assert ip.entropy(np.array([[0, 1], [0, 1]]), None)["intensity_entropy"] == 1
    r = ip.rings(2)(np.where(m > 0, ip.edge_distance(m > 0.5), 0), m)
    assert r["ring_1_mean"] < r["ring_2_mean"]
    assert math.isnan(ip.texture(img, None)["texture_energy"])
    flat = ip.texture(np.full((8, 8), 9.0), np.ones((8, 8)))
    assert flat["texture_contrast"] == 0 and flat["texture_energy"] == 1
    sharp = np.zeros((40, 40))
    sharp[:, ::2] = 1
    assert ip.sharpness(sharp, None)["sharpness_metric"] < ip.sharpness(ip._gauss(np.random.default_rng(0).random((40, 40)), 4), None)["sharpness_metric"]
    dots = np.zeros((50, 50))
    dots[12, 12] = dots[35, 30] = 1
    found = ip.blobs(ip._gauss(dots, 2) * 20, None)
    assert found["blob_count"] == 2 and found["blob_area_std"] == 0
    assert ip.to_rgb(np.ones((2, 2, 2))).shape == (2, 2, 3) and ip.resize(np.ones((5, 7, 2)), 4).shape == (4, 4, 2)
    with pytest.raises(ValueError):
        ip.preset("BASIC")


def test_files_end_to_end(spark, tmp_path):
    from lumenframe.plans.report import ReportConfig, generate_report
    from lumenframe.plans.session import ImageFailures, Session
    from lumenframe.sources.store import ResultStore

    for drug in ("A", "B"):
        for i in range(3):
            d = tmp_path / "in" / drug / "24h"
            d.mkdir(parents=True, exist_ok=True)
            x = np.full((16, 16, 3), 20 * (i + 1) + (100 if drug == "B" else 0), np.uint8)
            x[4:8, 4:8] = 5
            (d / f"crop_{i}.png").write_bytes(png(x))
    (tmp_path / "in" / "A" / "24h" / "bad.png").write_bytes(b"not an image")
    s = Session.find_files(spark, str(tmp_path / "in"), template=".../(drug)/(time)/(name).*")
    assert s.catalog.count() == 7 and [r["image_index"] for r in s.catalog.orderBy("image_path").collect()] == list(range(7))
    seen = images.inspect(s.catalog).collect()
    assert sum(r["error"] is not None for r in seen) == 1 and {r["channels"] for r in seen if r["error"] is None} == {3}

    def model():
        return lambda b: np.stack([np.append(b.mean((2, 3)), 1.0)[: 4] if False else np.r_[b[i].mean((1, 2)), 1.0] for i in range(len(b))])

    # stored: the good ones are kept, then the failure is told; in memory failed images leave with a warning
    keep = ResultStore(spark, str(tmp_path / "kept"))
    with pytest.raises(ImageFailures) as e:
        s.process_images(str(tmp_path / "in"), model, size=32, st=keep)
    assert e.value.n == 1 and keep.read("embeddings").count() == 6 and keep.params() == {"size": 32}
    with pytest.raises(ImageFailures):  # only the failed one is tried again
        s.process_images(str(tmp_path / "in"), model, size=32, st=keep)
    assert keep.read("embeddings").count() == 6
    with pytest.raises(ValueError):
        s.process_images(str(tmp_path / "in"), model, size=64, st=keep)
    with pytest.warns(UserWarning, match="1 images"):
        s = s.process_images(str(tmp_path / "in"), model, size=32, batch_size=2)
    assert s.dim == 4 and s.embeddings.count() == 6 and s.catalog.count() == 6
    assert s.process_images(str(tmp_path / "in"), model, {"drug": "A"}, size=32, force=True).embeddings.count() == 6
    s = s.compute_properties(str(tmp_path / "in"), "basic", channels=["r", "g", "b"])
    names = s.property_names()
    assert "intensity_mean_r" in names and "area" in names
    st = ResultStore(spark, str(tmp_path / "out"))
    s.save(st)
    t = Session.load(st)
    d = t.reference_distances({"drug": "A"}, mode="all_to_all")
    assert d.where("distance IS NOT NULL").count() == 6
    assert t.export(str(tmp_path / "t.csv"), d) == "csv"
    st.set_params({"size": 32})
    with pytest.raises(ValueError):
        st.validate_params({"size": 64})
    files = t.export(str(tmp_path / "s.parquet"), include_embeddings="separate") and sorted((tmp_path / "s_embeddings").glob("*.npy"))
    keys = np.concatenate([np.load(f) for f in files if f.name.endswith(".keys.npy")])
    assert len(keys) == 6 and sum(len(np.load(f)) for f in files if not f.name.endswith(".keys.npy")) == 6
    c, st2 = t.correct_batches("drug", method="zscore", source="properties", props=["intensity_mean_r"])
    assert abs(c.properties.agg(F.avg("intensity_mean_r")).first()[0]) < 1e-9 and st2.count() == 2
    page = open(generate_report(t, str(tmp_path / "r.html"), ReportConfig(group_by=["drug"], reference={"drug": "A"}))).read()
    for part in ("Values of drug", "Map of 6 images by drug", "Typical images by drug", "Properties that follow a component", "Properties that explain component 1", "Distances by group"):
        assert part in page
    one = {r["drug"]: r for r in t.property_stats_by_group(["drug"], ["intensity_mean_r"]).collect()}
    assert one["B"]["intensity_mean_r_mean"] > one["A"]["intensity_mean_r_mean"]


def test_store_has_one_writer(spark, tmp_path):
    from lumenframe.sources.store import ConcurrentWriteError, ResultStore

    path = str(tmp_path / "st")
    a, b = ResultStore(spark, path), ResultStore(spark, path)
    a.append("t", spark.range(3))
    stale = b._manifest()
    a.append("t", spark.range(3, 5))
    with pytest.raises(ConcurrentWriteError):
        b._commit(stale | {"tables": {}})
    assert b.read("t").count() == 5
    # a writer that dies before its manifest is in place leaves the former state, and its claim can be broken
    claim = tmp_path / "st" / "manifests" / f"{a._manifest()['number'] + 1:012d}.claim"
    claim.write_text("")
    with pytest.raises(ConcurrentWriteError):
        a.append("t", spark.range(9))
    assert a.read("t").count() == 5
    a.break_claim()
    a.append("t", spark.range(9))
    assert ResultStore(spark, path).read("t").count() == 14 and a.table_lengths() == {"t": 14}


def test_png_filters_and_interlace():
    rng = np.random.default_rng(3)

    def pack(x, lace):
        h, w, c = x.shape

        def plane(p):
            flat = p.reshape(len(p), -1).astype(np.int64)
            out, prev = b"", np.zeros(flat.shape[1], np.int64)
            for y, row in enumerate(flat):
                left, up, corner = np.r_[[0] * c, row[:-c]], prev, np.r_[[0] * c, prev[:-c]]
                est = left + up - corner
                pa, pb, pc = abs(est - left), abs(est - up), abs(est - corner)
                paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
                k = y % 5
                out += bytes([k]) + ((row - [0, left, up, (left + up) // 2, paeth][k]) % 256).astype(np.uint8).tobytes()
                prev = row
            return out

        raw = b"".join(plane(x[y0::ys, x0::xs]) for y0, ys, x0, xs in images.PASSES if x[y0::ys, x0::xs].size) if lace else plane(x)
        part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, lace)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    for h, w, c in ((13, 9, 3), (5, 21, 1), (1, 1, 3), (16, 16, 3)):
        x = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        for lace in (0, 1):
            assert (images.decode(pack(x, lace), "x.png") == x).all()


def test_metadata_by_function_and_roots(spark, tmp_path):
    f = spark.createDataFrame([("/d/a/1.tif",), ("/d/b/2.tif",), ("/d/b/bad.tif",)], "file_path string")

    def meta(p):
        n = int(p.rsplit("/", 1)[1].split(".")[0])  # a ValueError where there is no number
        return {"n": n, "dir": p.split("/")[2]}

    assert {tuple(r) for r in discovery.callable_metadata(f, meta, ["n", "dir"]).collect()} == {("/d/a/1.tif", "1", "a"), ("/d/b/2.tif", "2", "b")}
    assert discovery.callable_metadata(f, meta, ["n"], on_missing="keep").where("n IS NULL").count() == 1
    with pytest.raises(Exception, match="ZeroDivision"):
        discovery.callable_metadata(f, lambda p: {"n": 1 / 0}, ["n"]).collect()
    assert discovery.common_root(f, "file_path") == "/d"
    assert {r[0] for r in discovery.rebase(f, None, None, ["file_path"]).collect()} == {"a/1.tif", "b/2.tif", "b/bad.tif"}
    assert {r[0] for r in discovery.rebase(f, None, "/n$1", ["file_path"]).collect()} == {"/n$1/a/1.tif", "/n$1/b/2.tif", "/n$1/b/bad.tif"}
    was = spark.createDataFrame([(0, "/old/a/1.tif"), (1, "/old/q/9.tif")], "image_index bigint, image_path string")
    now = spark.createDataFrame([(5, "/new/a/1.tif")], "image_index bigint, image_path string")
    assert {tuple(r) for r in discovery.rebase_to_current(was, now).select("image_index", "image_path").collect()} == {(0, "/new/a/1.tif"), (1, "/old/q/9.tif")}
    assert joins.rows_align(was, was) and not joins.rows_align(was, now)
    assert not joins.rows_align(was, was.union(was)) and joins.rows_align(was, was.withColumn("image_path", F.concat(F.lit("/x"), "image_path")))
    seen = spark.createDataFrame([(1, 2, "u1", None, None), (3, 2, "u1", "bad", "x")], "height int, width int, dtype string, error string, drug string")
    assert {r["level"] for r in discovery.findings(discovery.preflight(seen, ["drug"])).collect()} == {"error", "warning"}


def test_ranks_and_top_lists(spark):
    rng = np.random.default_rng(9)
    rows = [(None if g == 0 else f"g{g}", float(x), float(y)) for g, x, y in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), rng.normal(size=400))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r["g"], r["x"]): r["rank"] for r in correlation.ranks(df, ["g"], "x").collect()}
    for g in (None, "g1", "g2"):
        v = np.array([x for k, x, _ in rows if k == g])
        for x in np.unique(v):
            assert got[g, x] == (v < x).sum() + ((v == x).sum() + 1) / 2
    x, y = (np.array([r[i] for r in rows]) for i in (1, 2))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(correlation.spearman(df, "x", "y").first()["rho"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    c = spark.createDataFrame([("a", 0.1, -0.9), ("b", -0.5, None), ("c", 0.3, 0.2)], "property string, component_1 double, component_2 double")
    top = {(r["component"], r["rank"]): r["property"] for r in correlation.top_correlations(c, ["component_1", "component_2"], 2).collect()}
    assert top == {("component_1", 1): "b", ("component_1", 2): "c", ("component_2", 1): "a", ("component_2", 2): "c"}
    t = contract.compact_types(spark.createDataFrame([(1.0, 0.5), (None, 2.0)], "a double, b double"), ["a", "b"])
    assert dict(t.dtypes) == {"a": "bigint", "b": "float"}


def test_folds_follow_labels(spark):
    from lumenframe.operators.explain import _prepared

    df = spark.createDataFrame([(i, float(i), float(i), "a" if i < 60 else "b" if i < 80 else None) for i in range(90)], "image_index bigint, x double, y double, lab string")
    n = _prepared(df, ["x"], "y", "image_index", 5, "lab").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in n) == [18] * 5
    with pytest.warns(UserWarning):
        assert _prepared(df.where("image_index < 82"), ["x"], "y", "image_index", 5, "lab").count() == 82


def test_stream_appends_once(spark, tmp_path):
    from lumenframe.sources.store import ResultStore
    from lumenframe.streaming.ingest import append_stream

    src = str(tmp_path / "src")
    st = ResultStore(spark, str(tmp_path / "store"))
    spark.range(5).write.parquet(src)
    for k in range(2):
        if k:
            spark.range(3, 8).write.mode("append").parquet(src)
        append_stream(spark.readStream.schema("id bigint").parquet(src), st, "rows", "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in st.read("rows").collect()) == list(range(8))


def test_clear_deletes_written_tables(spark):
    from lumenframe import runtime

    df = runtime.materialize(spark.range(3))
    assert df.count() == 3 and runtime.clear(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.collect()


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:1] == ["image_index"]
