"""Queries over the project's tables, one per operator, and the SQL that says the same.

Image tables hold repeated rows; ``_images``, ``_vectors`` and ``_objects`` take each once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.functions import vectors as V
from lumenframe.operators import batch as B
from lumenframe.operators import cluster as K
from lumenframe.operators import contract as P
from lumenframe.operators import correlation as R
from lumenframe.operators import distance as D
from lumenframe.operators import explain as E
from lumenframe.operators import joins as J
from lumenframe.operators import predicates as W
from lumenframe.operators import reduce as C
from lumenframe.operators import stats as S
from lumenframe.runtime import materialize, table
from lumenframe.sources import discovery as Y
from lumenframe.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM = 128
CTES = {
    "img": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM image_catalog",
    "vec": "SELECT image_index, any_value(embedding)::DOUBLE[] AS e FROM image_vectors WHERE len(embedding) = 128 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY image_index",
    "vn": "SELECT image_index, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM vec",
    "obj": "SELECT DISTINCT * EXCLUDE (ingested_at) FROM image_properties",
    "refc": "SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vn JOIN img USING (image_index) WHERE compound = 'vehicle') GROUP BY pos)",
}


def query(sql: str | None = None, **more: str):
    """Register a function as a query; ``sql`` may use the CTEs above, and further ones given by name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            have = {**CTES, **more}
            need, todo = [], [sql]
            while todo:
                t = todo.pop()
                for n, body in have.items():
                    if n not in need and __import__("re").search(rf"\b{n}\b", t):
                        need.append(n)
                        todo.append(body)
            order = [n for n in have if n in need]
            SQL[f.__name__] = ("WITH " + ", ".join(f"{n} AS ({have[n]})" for n in order) + " " if order else "") + sql
        return f

    return add


def _images(s, d):
    return table(s, d, "image_catalog").drop("ingested_at").distinct()


def _vectors(s, d, name="embedding"):
    t = table(s, d, "image_vectors").select("image_index", "embedding")
    return t.where(V.is_usable(F.col("embedding"), DIM)).dropDuplicates(["image_index"]).withColumnRenamed("embedding", name)


def _objects(s, d):
    return table(s, d, "image_properties").drop("ingested_at").distinct()


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- predicates and projections -------------------------------------------------------------------------------------


@query("SELECT image_index, compound, cell_line, phase_class FROM img WHERE cell_line IN ('KF-910', 'CK-605', 'PG-665') AND (phase_class = 'mid' OR phase_class IS NULL) AND NOT coalesce(compound IN ('vehicle'), false)")
def filter_include_exclude(s, d):
    f = W.metadata_filter(_images(s, d), {"Cell_Line": ["KF-910", "CK-605", "PG-665"], "phase_class": ["mid", None], "source": None}, {"compound": "vehicle"})
    return f.select("image_index", "compound", "cell_line", "phase_class")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND NOT coalesce(source = 'shift_log', false)")
def filter_file_table(s, d):
    return W.file_table_filter(table(s, d, "documents"), {"lang": ["en", "de"], "no_such_key": 1}, {"source": "shift_log"}).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def range_highlight(s, d):
    t = table(s, d, "part")
    return t.where(W.numeric_range(F.col("p_size"), 10, 20) & W.text_in(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13"])).select("p_partkey", "p_size", "p_brand")


@query("SELECT image_index, area, perimeter FROM obj WHERE isfinite(area) AND isfinite(perimeter) AND isfinite(intensity_mean)")
def finite_rows(s, d):
    return W.finite_rows(_objects(s, d), ["area", "perimeter", "intensity_mean"]).select("image_index", "area", "perimeter")


@query("SELECT image_index, source FROM img WHERE source IS DISTINCT FROM 'NEW'")
def drop_temporal(s, d):
    return W.drop_temporal(_images(s, d)).select("image_index", "source")


@query("SELECT image_index, image_path, regexp_replace(image_path, '^.*/', '') AS image_name, cell_line, compound, phase_class, concentration, replicate FROM img")
def tier_a_projection(s, d):
    return P.tier_a(_images(s, d), ["compound", "cell_line", "phase_class"], ["concentration", "replicate"], image_name=True)


@query("SELECT i.image_index, image_path, n_objects FROM img i LEFT JOIN (SELECT image_index, count(*) AS n_objects FROM obj GROUP BY 1) o USING (image_index)")
def append_properties(s, d):
    n = _objects(s, d).groupBy("image_index").agg(F.count("*").alias("n_objects"))
    return P.append_properties(_images(s, d).select("image_index", "image_path"), n)


@query("SELECT image_index, coalesce(i.compound, o.c) AS compound FROM img i LEFT JOIN (SELECT image_index, min(compound) AS c FROM obj GROUP BY 1) o USING (image_index)")
def store_coalesce(s, d):
    o = _objects(s, d).groupBy("image_index").agg(F.min("compound").alias("c"))
    return _images(s, d).join(o, "image_index", "left").select("image_index", P.first_store(None, "compound", ["compound", "c"]))


@query("SELECT image_index, compound, replicate, concentration FROM img WHERE image_index = 7")
def image_info(s, d):
    return P.image_info(_images(s, d), 7).select("image_index", "compound", "replicate", "concentration")


@query("SELECT image_index, TRY_CAST(time_point AS DOUBLE) AS time_point_value FROM img")
def metadata_to_properties(s, d):
    return P.metadata_to_properties(_images(s, d), ["time_point"]).select("image_index", "time_point_value")


@query("SELECT * FROM (SELECT 'lang' AS \"column\", count(DISTINCT lang) AS n_distinct, count(*) AS n_rows, 'discrete' AS kind FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(*), 'discrete' FROM documents UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), count(*), CASE WHEN count(DISTINCT n_chars) <= 256 THEN 'discrete' ELSE 'continuous' END FROM documents)")
def informative_columns(s, d):
    return P.column_profile(table(s, d, "documents"), ["lang", "source", "n_chars"]).select("column", "n_distinct", "n_rows", "kind")


# --- grouped statistics ---------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS N, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL")
def property_stats_by_group(s, d):
    g = S.property_stats_by_group(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return _r(_r(g, "l_quantity_mean", "l_quantity_std"), "l_extendedprice_mean", "l_extendedprice_std", digits=4)


@query("SELECT compound, count(*) AS N, count(CASE WHEN isfinite(area) THEN 1 END) AS n_area, min(CASE WHEN isfinite(area) THEN area END) AS area_min, max(CASE WHEN isfinite(area) THEN area END) AS area_max FROM obj WHERE compound IS NOT NULL GROUP BY compound")
def object_ranges(s, d):
    o = _objects(s, d)
    n = o.where("compound IS NOT NULL").groupBy("compound").agg(F.count(W.finite_or_null(F.col("area"))).alias("n_area"))
    return S.property_stats_by_group(o, ["area"], ["compound"]).join(n, "compound").select("compound", "N", "n_area", "area_min", "area_max")


@query("SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def counts_with_share(s, d):
    return S.counts_with_share(table(s, d, "customer"), ["c_mktsegment"])


@query("SELECT value, sum(n)::BIGINT AS n, CASE WHEN part < 2 THEN round(100.0 * sum(n) / sum(CASE WHEN part < 2 THEN sum(n) END) OVER (), 6) END AS percent FROM (SELECT CASE WHEN v IS NULL THEN 'Missing' WHEN r <= 10 THEN v ELSE 'Other' END AS value, CASE WHEN v IS NULL THEN 2 WHEN r <= 10 THEN 0 ELSE 1 END AS part, n FROM (SELECT v, n, row_number() OVER (PARTITION BY v IS NULL ORDER BY n DESC, v) AS r FROM (SELECT nullif(trim(source), '') AS v, count(*) AS n FROM documents GROUP BY 1))) GROUP BY value, part")
def value_distribution(s, d):
    return S.value_distribution(table(s, d, "documents"), "source")


@query("SELECT coalesce(nullif(trim(cell_line), ''), 'Unknown') AS cell_line, count(*) FILTER (phase_class = 'mid') AS n_mid, count(*) FILTER (phase_class = 'debris') AS n_debris, count(*) FILTER (coalesce(nullif(trim(phase_class), ''), 'Unknown') = 'Unknown') AS \"n_Unknown\" FROM img GROUP BY 1")
def cluster_crosstab(s, d):
    return S.crosstab(_images(s, d), "cell_line", "phase_class", ["mid", "debris", "Unknown"])


@query("SELECT coalesce(nullif(trim(compound), ''), 'N/A') || ' | ' || coalesce(nullif(trim(cell_line), ''), 'N/A') AS label, count(*) AS n, round(avg(concentration), 6) AS mean_concentration FROM img GROUP BY 1")
def composite_group_stats(s, d):
    i = _images(s, d).withColumn("label", S.group_label([F.col("compound"), F.col("cell_line")]))
    return i.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("concentration"), 6).alias("mean_concentration"))


_PROPS = ["area", "perimeter", "intensity_mean", "texture_contrast", "eccentricity", "solidity", "orientation", "blob_count"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS property, count(*) FILTER (NOT coalesce(isfinite({p}), false)) AS n_missing, count(*) AS n_rows FROM obj" for p in _PROPS) + ")")
def nan_profile(s, d):
    return S.nan_profile(_objects(s, d), _PROPS)


@query("SELECT DISTINCT mechanism AS value FROM img WHERE mechanism IS NOT NULL")
def distinct_values(s, d):
    return S.distinct_values(_images(s, d), "mechanism")


@query("SELECT count(*) AS n_images, count(DISTINCT cluster) AS n_clusters FROM img")
def stats_cards(s, d):
    return S.stats_cards(_images(s, d))


@query("SELECT property, round(-sum(c / n * ln(c / n)), 6) AS entropy FROM (SELECT property, n, bin, count(*) AS c FROM (SELECT property, n, CASE WHEN hi > lo THEN least(floor((value - lo) * least(10, n) / (hi - lo)), least(10, n) - 1) ELSE 0 END AS bin FROM (SELECT property, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM (SELECT 'l_quantity' AS property, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) WINDOW w AS (PARTITION BY property))) GROUP BY ALL) GROUP BY property")
def hist_entropy(s, d):
    return S.histogram_entropy(table(s, d, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"])


_Z = "1.959963984540054"


@query(f"SELECT l_returnflag, n, round(m, 6) AS mean, round(sd / sqrt(n) * ({_Z} + ({_Z} ** 3 + {_Z}) / (4 * (n - 1)) + (5 * {_Z} ** 5 + 16 * {_Z} ** 3 + 3 * {_Z}) / (96.0 * (n - 1) ** 2)), 6) AS half_width FROM (SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)")
def confidence_band(s, d):
    """The SQL has Student's quantile as a series in 1 / df, exact to 1e-9 for groups of this size."""
    return _r(S.confidence_band(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity"), "mean", "half_width")


# --- vectors and distances ------------------------------------------------------------------------------------------


@query("SELECT image_index, round(v[1], 6) AS first, round(v[128], 6) AS last, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vn")
def l2_normalize(s, d):
    v = V.l2_normalize(F.col("embedding"))
    return _vectors(s, d).select("image_index", v.alias("v")).select("image_index", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[127], 6).alias("last"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("SELECT cluster, pos - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vec JOIN img USING (image_index)) GROUP BY ALL")
def group_centroids(s, d):
    j = _vectors(s, d).join(_images(s, d).select("image_index", "cluster"), "image_index")
    c = j.groupBy("cluster").agg(V.mean_vector(F.col("embedding"), DIM).alias("c"))
    return c.select("cluster", F.posexplode("c").alias("dim", "mean")).select("cluster", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


def _distances(s, d, mode, kind):
    i = _images(s, d).select("image_index", "compound", "mechanism")
    r = D.reference_distances(i, _vectors(s, d, "features"), F.col("compound") == "vehicle", DIM, mode=mode, kind=kind)
    return _r(r, "distance")


_REF = "SELECT image_index, compound, mechanism, (compound IS NOT NULL AND compound = 'vehicle' AND {on}) AS is_reference, round({dist}, 6) AS distance FROM img LEFT JOIN {side} USING (image_index)"
_SIDE = "(SELECT image_index, {dist} AS dd FROM vn, refc)"
_NEAR = "(SELECT a.image_index, {agg} AS dd FROM vn a, (SELECT v AS r FROM vn JOIN img USING (image_index) WHERE compound = 'vehicle') GROUP BY a.image_index)"


@query(_REF.format(on="dd IS NOT NULL", dist="dd", side=_SIDE.format(dist="list_distance(v, c)")))
def ref_distance_centroid_euclidean(s, d):
    return _distances(s, d, "centroid", "euclidean")


@query(_REF.format(on="dd IS NOT NULL", dist="dd", side=_SIDE.format(dist="1 - list_inner_product(v, c) / sqrt(list_inner_product(c, c))")))
def ref_distance_centroid_cosine(s, d):
    return _distances(s, d, "centroid", "cosine")


@query(_REF.format(on="dd IS NOT NULL", dist="dd", side=_NEAR.format(agg="min(list_distance(a.v, r))")))
def ref_distance_all_to_all_euclidean(s, d):
    return _distances(s, d, "all_to_all", "euclidean")


@query(_REF.format(on="dd IS NOT NULL", dist="abs(dd)", side=_NEAR.format(agg="min(1 - list_inner_product(a.v, r))")))
def ref_distance_all_to_all_cosine(s, d):
    return _distances(s, d, "all_to_all", "cosine").withColumn("distance", F.abs("distance"))


def _part(s, d):
    z = S.zscore_columns(table(s, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double"), "p_retailprice"), ["p_size", "p_retailprice"])
    return z.select(F.col("p_partkey").alias("image_index"), "p_brand", F.array("p_size", "p_retailprice").alias("features"))


_PZ = {"pz": "SELECT p_partkey AS image_index, p_brand, [(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()] AS f FROM part", "pn": "SELECT image_index, p_brand, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) AS v FROM pz"}


@query("SELECT image_index, p_brand, p_brand = 'Brand#11' AS is_reference, round(list_distance(v, c), 6) AS distance FROM pn, pc", **_PZ, pc="SELECT [avg(v[1]), avg(v[2])] AS c FROM pn WHERE p_brand = 'Brand#11'")
def ref_distance_properties(s, d):
    p = _part(s, d)
    r = D.reference_distances(p.select("image_index", "p_brand"), p.select("image_index", "features"), F.col("p_brand") == "Brand#11", 2)
    return _r(r, "distance")


@query("SELECT image_index, len(f) AS n, round(f[1], 6) AS first, round(f[129], 6) AS conc, round(f[130], 6) AS repl FROM (SELECT image_index, list_concat(v, [a / sqrt(2), b / sqrt(2)]) AS f FROM vn JOIN (SELECT image_index, (concentration - avg(concentration) OVER ()) / stddev_pop(concentration) OVER () AS a, (replicate - avg(replicate) OVER ()) / stddev_pop(replicate) OVER () AS b FROM img JOIN vec USING (image_index)) USING (image_index) WHERE a IS NOT NULL AND b IS NOT NULL)")
def combined_features(s, d):
    j = _vectors(s, d).join(_images(s, d).select("image_index", "concentration", F.col("replicate").cast("double").alias("replicate")), "image_index")
    f = S.combined_features(j, "embedding", ["concentration", "replicate"])
    return f.select("image_index", F.size("features").cast("bigint").alias("n"), F.round(F.col("features")[0], 6).alias("first"), F.round(F.col("features")[128], 6).alias("conc"), F.round(F.col("features")[129], 6).alias("repl"))


@query("SELECT mechanism, round(avg(dd), 6) AS mean, round(stddev_samp(dd), 6) AS std, round(min(dd), 6) AS min, round(max(dd), 6) AS max, count(*) AS count FROM img JOIN (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) USING (image_index) GROUP BY mechanism")
def distance_summary_by_group(s, d):
    i = _images(s, d).select("image_index", "compound", "mechanism")
    r = D.reference_distances(i, _vectors(s, d, "features"), F.col("compound") == "vehicle", DIM)
    return _r(D.distance_summary(r, ["mechanism"]), "mean", "std", "min", "max")


@query("(SELECT image_index, round(dd, 6) AS distance, 'closest' AS side FROM (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) ORDER BY dd, image_index LIMIT 10) UNION ALL (SELECT image_index, round(dd, 6), 'farthest' FROM (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) ORDER BY dd DESC, image_index LIMIT 10)")
def extremes_topk(s, d):
    i = _images(s, d).select("image_index", "compound")
    r = D.reference_distances(i, _vectors(s, d, "features"), F.col("compound") == "vehicle", DIM)
    return _r(D.extremes(r, 10), "distance")


def _grouped(s, d, col):
    return _vectors(s, d, "features").join(_images(s, d).select("image_index", col), "image_index").select("image_index", col, V.l2_normalize(F.col("features")).alias("features"))


_OWN = {
    "g": "SELECT image_index, coalesce(nullif(trim({col}), ''), 'N/A') AS g0, v FROM vn JOIN img USING (image_index)",
    "gc": "SELECT g0, list(m ORDER BY pos) AS c FROM (SELECT g0, pos, avg(x) AS m FROM (SELECT g0, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM g) GROUP BY ALL) GROUP BY g0",
    "gd": "SELECT image_index, g0, list_distance(v, c) AS dd FROM g JOIN gc USING (g0)",
}


def _own(col):
    return {k: v.format(col=col) for k, v in _OWN.items()}


_OUT_Z = "SELECT image_index, g0 AS \"group\", round(dd, 6) AS distance_to_centroid, round(cut, 6) AS threshold FROM gd JOIN (SELECT g0, avg(dd) + 2.0 * stddev_samp(dd) AS cut, count(*) AS n, stddev_samp(dd) AS s FROM gd GROUP BY 1) USING (g0) WHERE n >= 2 AND s > 0 AND dd > cut"
_OUT_I = "SELECT image_index, g0 AS \"group\", round(dd, 6) AS distance_to_centroid, round(q[2] + 1.5 * (q[2] - q[1]), 6) AS threshold FROM gd JOIN (SELECT g0, quantile_cont(dd, [0.25, 0.75]) AS q, count(*) AS n FROM gd GROUP BY 1) USING (g0) WHERE n >= 2 AND q[2] > q[1] AND dd > q[2] + 1.5 * (q[2] - q[1])"


@query(_OUT_Z, **_own("compound"))
def outliers_zscore_grouped(s, d):
    return _r(D.outliers(_grouped(s, d, "compound"), "compound", DIM, "z-score", 2.0), "distance_to_centroid", "threshold")


@query(_OUT_I.replace("1.5", "0.5"), **_own("compound"))
def outliers_iqr_grouped(s, d):
    """With a narrow fence, so that there are some."""
    return _r(D.outliers(_grouped(s, d, "compound"), "compound", DIM, "iqr", 0.5), "distance_to_centroid", "threshold")


@query(_OUT_Z, **{**_OWN, "g": "SELECT image_index, 'All' AS g0, v FROM vn"})
def outliers_zscore(s, d):
    return _r(D.outliers(_grouped(s, d, "compound"), None, DIM, "z-score", 2.0), "distance_to_centroid", "threshold")


@query("SELECT count(*) AS n_kept FROM img WHERE image_index NOT IN (SELECT image_index FROM (" + _OUT_Z + "))", **{**_OWN, "g": "SELECT image_index, 'All' AS g0, v FROM vn"})
def drop_outliers(s, d):
    return D.drop_outliers(_images(s, d), outliers_zscore(s, d)).agg(F.count("*").alias("n_kept"))


_PROTO = "SELECT image_index, {g} AS mechanism, round(dd, 6) AS distance, r AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY dd, image_index) AS r FROM pd) WHERE r <= 5"


def _proto(dist):
    return {"p0": "SELECT image_index, mechanism, v FROM vn JOIN img USING (image_index)", "pc0": "SELECT mechanism, list(m ORDER BY pos) AS c FROM (SELECT mechanism, pos, avg(x) AS m FROM (SELECT mechanism, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM p0) GROUP BY ALL) GROUP BY mechanism", "pd": f"SELECT image_index, p0.mechanism, {dist} AS dd FROM p0 JOIN pc0 ON p0.mechanism IS NOT DISTINCT FROM pc0.mechanism"}


@query(_PROTO.format(g="mechanism"), **_proto("list_distance(v, c)"))
def prototypes_euclidean(s, d):
    return _r(D.prototypes(_grouped(s, d, "mechanism"), "mechanism", DIM), "distance")


@query(_PROTO.format(g="mechanism"), **_proto("1 - list_inner_product(v, c) / sqrt(list_inner_product(c, c))"))
def prototypes_cosine(s, d):
    return _r(D.prototypes(_grouped(s, d, "mechanism"), "mechanism", DIM, kind="cosine"), "distance")


# --- scaling, tests and correlations --------------------------------------------------------------------------------


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def zscore_properties(s, d):
    t = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return _r(S.zscore_columns(t, ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@query("SELECT 'filter' AS policy, count(*) FILTER (isfinite(area) AND isfinite(solidity)) AS n_rows, count(*) FILTER (isfinite(area) AND isfinite(solidity)) AS n_area FROM obj UNION ALL SELECT 'impute', count(*), count(*) FROM obj UNION ALL SELECT 'keep', count(*), count(*) FILTER (isfinite(area)) FROM obj")
def nan_policies(s, d):
    o = _objects(s, d)
    got = [S.nan_policy(o, ["area", "solidity"], p).agg(F.lit(p).alias("policy"), F.count("*").alias("n_rows"), F.count("area").alias("n_area")) for p in ("filter", "impute", "keep")]
    return got[0].unionByName(got[1]).unionByName(got[2])


_MOM = {"lg": "SELECT l_returnflag AS g, property, value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) t(property, value)", "mo": "SELECT g, property, count(*) AS n, avg(value) AS m, var_samp(value) AS s FROM lg WHERE g IS NOT NULL GROUP BY ALL"}
_TOPK = "SELECT g AS \"group\", property, round(effect, 6) AS effect, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(effect) DESC, property) AS rank FROM (SELECT a.g, a.property, {effect} AS effect FROM mo a JOIN mo b ON a.property = b.property AND b.g = 'A' WHERE a.g <> 'A')) WHERE rank <= 3"
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_TOPK.format(effect="(a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / greatest(a.n + b.n - 2, 1) + 1e-10)"), **_MOM)
def cohens_d_topk(s, d):
    return _r(S.top_properties_different(table(s, d, "lineitem"), "l_returnflag", "A", _LINE, k=3), "effect")


@query(_TOPK.format(effect="a.m - b.m"), **_MOM)
def mean_diff_topk(s, d):
    return _r(S.top_properties_different(table(s, d, "lineitem"), "l_returnflag", "A", _LINE, k=3, metric="mean_diff"), "effect")


_ENR = {
    "pl": "SELECT p_brand AS g, property, value FROM part, LATERAL (VALUES ('p_size', p_size::DOUBLE), ('p_retailprice', p_retailprice)) t(property, value) WHERE p_brand IS NOT NULL",
    "gs": "SELECT DISTINCT g, property FROM pl",
    "en": "SELECT gs.g, gs.property, count(*) FILTER (pl.g = gs.g) AS n1, count(*) FILTER (pl.g <> gs.g) AS n2, avg(value) FILTER (pl.g = gs.g) AS m1, avg(value) FILTER (pl.g <> gs.g) AS m2, var_samp(value) FILTER (pl.g = gs.g) AS v1, var_samp(value) FILTER (pl.g <> gs.g) AS v2 FROM gs JOIN pl USING (property) GROUP BY ALL",
}


@query("SELECT g AS \"group\", property, n1 AS n_group, n2 AS n_rest, round(m1, 6) AS mean_group, round(m2, 6) AS mean_rest, round((m1 - m2) / sqrt(v2), 6) AS score, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM en WHERE n1 >= 3", **_ENR)
def group_enrichment(s, d):
    t = table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    e = S.group_enrichment(t, "p_brand", ["p_size", "p_retailprice"], with_p=False)
    return _r(_r(e, "mean_group", "mean_rest", "score", "t"), "df", digits=4)


@query()
def group_enrichment_significance(s, d):
    i = _images(s, d).select("image_index", "mechanism")
    o = _objects(s, d).drop("mechanism").join(i, "image_index")
    return S.group_enrichment(o, "mechanism", ["eccentricity", "solidity", "orientation"])


_P = "((p_partkey * 7919) % 1000) * ((p_partkey * 7919) % 1000) / 1000000.0"


@query(f"SELECT p_partkey, round(p, 6) AS p, coalesce(p <= max(CASE WHEN p <= k / m * 0.05 THEN p END) OVER (), false) AS significant FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT p_partkey, {_P} AS p FROM part))")
def bh_fdr(s, d):
    x = F.pmod(F.col("p_partkey") * 7919, F.lit(1000)).cast("double")
    return _r(S.benjamini_hochberg(table(s, d, "part").select("p_partkey", (x * x / 1000000.0).alias("p")), "p"), "p")


def _corr_input(s, d):
    return _vectors(s, d).join(_images(s, d).select("image_index", "concentration", F.col("replicate").cast("double").alias("replicate")), "image_index")


_COR = {"co": "SELECT property, pos - 1 AS dim, corr(y, x) AS r FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos, concentration, replicate FROM vec JOIN img USING (image_index)), LATERAL (VALUES ('concentration', concentration), ('replicate', replicate::DOUBLE)) t(property, y) WHERE y IS NOT NULL GROUP BY ALL"}


@query("SELECT property, dim, round(r, 6) AS r FROM co", **_COR)
def pearson_dim_property(s, d):
    c = R.embedding_property_correlations(_corr_input(s, d), "embedding", ["concentration", "replicate"], DIM)
    return c.select("property", F.col("dim").cast("bigint").alias("dim"), F.round("r", 6).alias("r"))


@query("SELECT property, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, round(avg(abs(r)), 6) AS mean_abs_r, round(max(abs(r)), 6) AS max_abs_r, round(min(abs(r)), 6) AS min_abs_r FROM co GROUP BY property", **_COR)
def corr_summary(s, d):
    c = R.embedding_property_correlations(_corr_input(s, d), "embedding", ["concentration", "replicate"], DIM)
    return _r(R.correlation_summary(c), "mean_r", "std_r", "mean_abs_r", "max_abs_r", "min_abs_r")


@query("SELECT g AS p_brand, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM (SELECT p_brand AS g, p_size AS x, p_retailprice AS y FROM part)) GROUP BY g")
def spearman(s, d):
    return _r(R.spearman(table(s, d, "part"), "p_size", "p_retailprice", ["p_brand"]), "rho")


def _image_means(s, d):
    """Median of the finite object properties per image, which a few absurd values do not move."""
    o = _objects(s, d)
    return o.groupBy("image_index").agg(*[F.median(F.when(W.finite(F.col(c)), F.col(c))).alias(c) for c in _PROPS])


_DCOR = {
    "dp": "SELECT row_number() OVER () AS i, p_size::DOUBLE AS x, p_retailprice AS y FROM part",
    "dd_": "SELECT a.i, b.i AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM dp a, dp b",
    "dr": "SELECT i, avg(dx) AS rx, avg(dy) AS ry FROM dd_ GROUP BY i",
    "dg": "SELECT avg(rx) AS gx, avg(ry) AS gy FROM dr",
    "dc": "SELECT dx - p.rx - q.rx + gx AS a, dy - p.ry - q.ry + gy AS b FROM dd_ JOIN dr p ON p.i = dd_.i JOIN dr q ON q.i = dd_.j, dg",
}


@query("SELECT 'p_retailprice' AS property, round(sqrt(greatest(sum(a * b), 0) / sqrt(sum(a * a) * sum(b * b))), 6) AS r FROM dc", **_DCOR)
def distance_correlations(s, d):
    return _r(R.property_correlations(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_size", ["p_retailprice"], "distance"), "r")


@query()
def mutual_info_correlations(s, d):
    return R.property_correlations(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_size", ["p_retailprice"], "mutual_info")


# --- batches, reduction, clusters, explanation ----------------------------------------------------------------------


def _batched(s, d):
    return _vectors(s, d).join(_images(s, d).select("image_index", "compound", "replicate"), "image_index")


_BZ = {"bz": "SELECT replicate, pos, avg(x) AS m, sqrt(greatest(var_samp(x), 1e-12)) AS sd, count(*) AS n FROM (SELECT replicate, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vec JOIN img USING (image_index) WHERE compound = 'vehicle') GROUP BY ALL"}


@query("SELECT replicate::VARCHAR AS batch_id, pos - 1 AS dim, max(n)::INTEGER AS n_controls, round(max(m), 6) AS mean, round(max(sd), 6) AS std FROM bz GROUP BY ALL", **_BZ)
def batch_zscore_stats(s, d):
    t = B.batch_stats(_batched(s, d), "replicate", "embedding", DIM, F.col("compound") == "vehicle", "zscore")
    return t.select("batch_id", "n_controls", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "x")).select("batch_id", F.col("dim").cast("bigint").alias("dim"), "n_controls", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query("SELECT image_index, round(max(CASE WHEN pos = 1 THEN z END), 6) AS first, round(max(CASE WHEN pos = 128 THEN z END), 6) AS last FROM (SELECT image_index, pos, (x - m) / sd AS z FROM (SELECT image_index, replicate, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vec JOIN img USING (image_index)) JOIN bz USING (replicate, pos)) GROUP BY image_index", **_BZ)
def batch_zscore(s, d):
    c, _ = B.correct_batches(_batched(s, d), "replicate", "embedding", DIM, F.col("compound") == "vehicle", "zscore")
    return c.select("image_index", F.round(F.col("corrected")[0], 6).alias("first"), F.round(F.col("corrected")[127], 6).alias("last"))


@query()
def batch_sphering(s, d):
    c, _ = B.correct_batches(_batched(s, d), "replicate", "embedding", DIM, None, "sphering")
    return c.select("image_index", F.round(V.norm(F.col("corrected")), 6).alias("norm"))


@query("SELECT image_index, batch_id FROM (SELECT DISTINCT image_index, CASE WHEN trim(coalesce(batch_id, '')) = '' THEN '__missing__' ELSE trim(batch_id) END AS batch_id FROM fold_labels)")
def batch_ids(s, d):
    return B.with_batch_id(table(s, d, "fold_labels"), "batch_id").select("image_index", "batch_id").distinct()


@query()
def pca_components(s, d):
    v = _vectors(s, d, "features")
    return C.pca(v, "features", DIM, 2).transform(v, "image_index", "features")


@query("SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vec) GROUP BY pos)")
def pca_total_variance(s, d):
    n, _, sc = C.moments(_vectors(s, d), "embedding", DIM)
    return s.createDataFrame([(round(float(sc.trace()) / (n - 1), 6),)], "total_variance double")


@query("SELECT round(sum(v), 6) AS total_variance, true AS uncorrelated, true AS ordered FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vec) GROUP BY pos)")
def pca_full(s, d):
    """All 128 components: together they have the variance of the data, no two of the first three are correlated, and
    variances fall."""
    v = _vectors(s, d, "features")
    c = materialize(C.pca(v, "features", DIM, DIM).transform(v, "image_index", "features"), "components")
    names = [f"component_{i + 1}" for i in range(DIM)]
    r = c.agg(*[F.var_samp(n).alias(n) for n in names], *[F.corr(names[i], names[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i)])
    falls = F.forall(F.sequence(F.lit(1), F.lit(DIM - 1)), lambda i: F.element_at(F.array(*names), i) >= F.element_at(F.array(*names), i + 1) - 1e-9)
    flat = [F.abs(f"c{i}{j}") < 1e-6 for i in range(3) for j in range(i)]
    return r.select(F.round(sum((F.col(n) for n in names), F.lit(0.0)), 6).alias("total_variance"), (flat[0] & flat[1] & flat[2]).alias("uncorrelated"), falls.alias("ordered"))


@query("SELECT replicate::VARCHAR AS batch_id, count(*) AS n, true AS centred, true AS shrunk FROM vec JOIN img USING (image_index) GROUP BY replicate")
def sphering_moments(s, d):
    """Per batch: whether the mean is 0, and no variance beyond 1 (the ridge takes a little away), after sphering."""
    c, _ = B.correct_batches(_batched(s, d), "replicate", "embedding", DIM, None, "sphering")
    x = c.select(F.col("replicate").cast("string").alias("batch_id"), F.posexplode("corrected").alias("pos", "x"))
    g = x.groupBy("batch_id", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    return g.groupBy("batch_id").agg(F.max("n").alias("n"), (F.max(F.abs("m")) < 1e-6).alias("centred"), (F.max("v") <= 1 + 1e-6).alias("shrunk"))


@query("SELECT method, 8::BIGINT AS clusters, (SELECT count(*) FROM vec) AS labelled, (SELECT count(*) FROM img WHERE image_index NOT IN (SELECT image_index FROM vec)) AS without, true AS tight FROM (VALUES ('kmeans'), ('gmm')) t(method)")
def clustering_invariants(s, d):
    """Every image with features has one of eight labels, and rows are nearer to their cluster's mean than to the mean of all."""
    out = None
    for method in ("kmeans", "gmm"):
        c = {"kmeans": kmeans, "gmm": gmm_diag}[method](s, d)
        v = _vectors(s, d, "features").select("image_index", V.l2_normalize(F.col("features")).alias("features")).join(c, "image_index")
        own = D.own_centroid_distances(v, "cluster", DIM).agg(F.avg("distance").alias("own"))
        whole = D.own_centroid_distances(v.withColumn("cluster", F.lit(0)), "cluster", DIM).agg(F.avg("distance").alias("whole"))
        n = c.agg(F.count_distinct("cluster").alias("clusters"), F.count("cluster").alias("labelled"), (F.count("*") - F.count("cluster")).alias("without"))
        r = n.crossJoin(own).crossJoin(whole).select(F.lit(method).alias("method"), "clusters", "labelled", "without", (F.col("own") < F.col("whole")).alias("tight"))
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT method, (SELECT count(*) FROM vec) AS n_rows, true AS finite FROM (VALUES ('tsne'), ('umap')) t(method)")
def map_rows(s, d):
    """t-SNE and UMAP give every image finite coordinates."""
    one = lambda m, f: f(s, d).agg(F.lit(m).alias("method"), F.count_distinct("image_index").alias("n_rows"), F.min(W.finite(F.col("component_1")) & W.finite(F.col("component_2"))).alias("finite"))
    return one("tsne", tsne_map).unionByName(one("umap", umap_map))


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1 AND n > 0")
def group_top_value(s, d):
    """The most frequent value of each group."""
    from pyspark.sql.window import Window

    n = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r = 1").drop("r")


@query("SELECT g AS \"group\", property, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(score) DESC, property) AS rank FROM (SELECT g, property, (m1 - m2) / sqrt(v2) AS score FROM en WHERE n1 >= 3)) WHERE rank <= 1", **_ENR)
def top_enriched(s, d):
    t = table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return _r(S.top_enriched(S.group_enrichment(t, "p_brand", ["p_size", "p_retailprice"], with_p=False), 1).select("group", "property", "score", "rank"), "score")


@query("SELECT 'component_' || c AS component, property, rank FROM (SELECT c, property, row_number() OVER (PARTITION BY c ORDER BY abs(r) DESC NULLS LAST, property) AS rank FROM (SELECT 1 AS c, 'p_size' AS property, corr(p_retailprice, p_size) AS r FROM part UNION ALL SELECT 1, 'own', 1.0 UNION ALL SELECT 2, 'p_size', 1.0 UNION ALL SELECT 2, 'own', corr(p_retailprice, p_size) FROM part))")
def top_correlations(s, d):
    """Properties ordered by their correlation with two columns that stand for components."""
    t = table(s, d, "part").select(F.col("p_partkey").alias("image_index"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("own"))
    c = R.component_correlation(t.select("image_index", F.col("own").alias("component_1"), F.col("p_size").alias("component_2")), ["component_1", "component_2"], t, ["p_size", "own"])
    return R.top_correlations(c, ["component_1", "component_2"]).select("component", "property", "rank")


@query("SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem))")
def spearman_global(s, d):
    return _r(R.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query("SELECT v.image_index, coalesce(nullif(trim(i.mechanism), ''), 'N/A') AS \"group\", round(dd, 6) AS distance FROM img i JOIN (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) v USING (image_index) WHERE compound IS DISTINCT FROM 'vehicle'")
def distance_distribution(s, d):
    i = _images(s, d).select("image_index", "compound", "mechanism")
    r = D.reference_distances(i, _vectors(s, d, "features"), F.col("compound") == "vehicle", DIM)
    return _r(D.distribution(r, "mechanism").drop("is_reference"), "distance")


@query("SELECT 'same' AS case_, true AS aligned UNION ALL SELECT 'moved', true UNION ALL SELECT 'other', false UNION ALL SELECT 'fewer', false")
def row_alignment(s, d):
    """Whether stored rows belong to a catalog: the same, in another folder, with another file, with a row less."""
    i = _images(s, d).select("image_index", "image_path").where("image_path IS NOT NULL").dropDuplicates(["image_index"])
    moved = i.withColumn("image_path", F.concat(F.lit("/copy"), "image_path"))
    other = i.withColumn("image_path", F.when(F.col("image_index") == 5, F.lit("x.tif")).otherwise(F.col("image_path")))
    rows = [(c, J.rows_align(i, t)) for c, t in (("same", i), ("moved", moved), ("other", other), ("fewer", i.where("image_index <> 5")))]
    return s.createDataFrame(rows, "case_ string, aligned boolean")


@query("SELECT max(length(root)) > 0 AS found, min(starts_with(p, root)) AS shared FROM (SELECT replace(image_path, '\\', '/') AS p, '/data' AS root FROM img WHERE image_path LIKE '/data/%')")
def common_root(s, d):
    i = _images(s, d).where(F.col("image_path").startswith("/data/"))
    root = Y.common_root(i, "image_path")
    return i.agg((F.lit(len(root)) > 0).alias("found"), F.min(F.replace("image_path", F.lit("\\"), F.lit("/")).startswith(root)).alias("shared"))


@query()
def component_centroids(s, d):
    v = _vectors(s, d, "features")
    c = C.pca(v, "features", DIM, 2).transform(v, "image_index", "features").join(_images(s, d).select("image_index", "mechanism"), "image_index")
    return C.group_centroids(c, ["component_1", "component_2"], ["mechanism"])


@query()
def component_correlation(s, d):
    v = _vectors(s, d, "features")
    c = C.pca(v, "features", DIM, 2).transform(v, "image_index", "features")
    return R.component_correlation(c, ["component_1", "component_2"], _image_means(s, d), _PROPS)


@query()
def tsne_map(s, d):
    return C.reduce_dimensions(_vectors(s, d, "features"), "image_index", "features", DIM, "tsne")


@query()
def umap_map(s, d):
    return C.reduce_dimensions(_vectors(s, d, "features"), "image_index", "features", DIM, "umap")


@query()
def kmeans(s, d):
    v = _vectors(s, d, "features").select("image_index", V.l2_normalize(F.col("features")).alias("features"))
    return K.compute_clustering(_images(s, d).select("image_index"), v, DIM, "kmeans", k=8, reduce_dim=32)


@query()
def gmm_diag(s, d):
    v = _vectors(s, d, "features").select("image_index", V.l2_normalize(F.col("features")).alias("features"))
    return K.compute_clustering(_images(s, d).select("image_index"), v, DIM, "gmm", k=8, reduce_dim=16)


_DB = {"vec": CTES["vec"], "db": "SELECT image_index AS vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM vec", "nb": "SELECT a.vec_id AS a, b.vec_id AS b FROM db a, db b WHERE list_distance(a.v, b.v) <= 0.6", "cr": "SELECT a FROM nb GROUP BY a HAVING count(*) >= 5"}


_DB |= {
    "ce": "SELECT nb.a, nb.b FROM nb JOIN cr x ON x.a = nb.a JOIN cr y ON y.a = nb.b",
    "co": "SELECT a, min(b) AS comp FROM (SELECT DISTINCT r.a, r.b FROM reach r) GROUP BY a",
    "nr": "SELECT comp, (row_number() OVER (ORDER BY comp) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT comp FROM co)",
    "own": "SELECT d.vec_id, CASE WHEN cr.a IS NOT NULL THEN d.vec_id ELSE (SELECT min(nb.b) FROM nb JOIN cr c ON c.a = nb.b WHERE nb.a = d.vec_id) END AS core FROM db d LEFT JOIN cr ON cr.a = d.vec_id",
}


def _dbscan_sql() -> str:
    """Core points joined by chains; a border point goes with its smallest core neighbour; clusters by their smallest core."""
    ctes = ", ".join(f"{n} AS ({_DB[n]})" for n in ("vec", "db", "nb", "cr", "ce"))
    rest = ", ".join(f"{n} AS ({_DB[n]})" for n in ("co", "nr", "own"))
    return f"WITH RECURSIVE {ctes}, reach AS (SELECT a, b FROM ce UNION SELECT r.a, ce.b FROM reach r JOIN ce ON r.b = ce.a), {rest} SELECT vec_id AS image_index, coalesce(cluster, -1)::INTEGER AS cluster FROM own LEFT JOIN co ON co.a = own.core LEFT JOIN nr USING (comp)"


@query()
def dbscan(s, d):
    """Clusters of the images by density; noise is -1 here."""
    v = _vectors(s, d, "features").select("image_index", V.l2_normalize(F.col("features")).alias("features"))
    return K.dbscan(v, DIM, eps=0.6, min_samples=5).select("image_index", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


SQL["dbscan"] = _dbscan_sql()


@query("SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM (SELECT vec_id, max(CASE WHEN own THEN m END) AS a, min(CASE WHEN NOT own THEN m END) AS b FROM (SELECT x.vec_id, y.label = x.label AS own, sum(list_distance(x.v, y.v)) / (count(*) - CASE WHEN y.label = x.label THEN 1 ELSE 0 END) AS m FROM se x, se y GROUP BY x.vec_id, x.label, y.label) GROUP BY vec_id)", se="SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings")
def silhouette(s, d):
    e = table(s, d, "embeddings")
    v = K.silhouette(e.select(F.col("vec_id").alias("image_index"), F.col("embedding").alias("features")), e.select(F.col("vec_id").alias("image_index"), F.col("label").alias("cluster")), 64)
    return s.createDataFrame([(None if v is None else round(v, 6),)], "silhouette double")


@query()
def lasso_axis(s, d):
    return E.lasso_axis(_image_means(s, d), [p for p in _PROPS if p != "perimeter"], "perimeter")[0]


_AXIS = "SELECT p_brand, p_size::DOUBLE AS size, p_retailprice AS price, (p_partkey % 17)::DOUBLE AS turn, 3.0 * p_size + ((p_partkey * 7919) % 100) / 10.0 AS y FROM part"
_FIRST = "SELECT feature, r > 0 AS positive FROM (SELECT * FROM (SELECT 'size' AS feature, corr(y, size) AS r FROM ax UNION ALL SELECT 'price', corr(y, price) FROM ax UNION ALL SELECT 'turn', corr(y, turn) FROM ax) ORDER BY abs(r) DESC LIMIT 1)"


def _axis(s, d):
    """Parts with an axis that follows the size, and a little noise."""
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (k % 17).cast("double").alias("turn"), (3.0 * F.col("p_size") + F.pmod(k * 7919, F.lit(100)) / 10.0).alias("y"))


@query(_FIRST, ax=_AXIS)
def lasso_first(s, d):
    """The property with the largest weight."""
    w, _ = E.lasso_axis(_axis(s, d), ["size", "price", "turn"], "y", key="p_partkey", stratify="p_brand")
    return w.orderBy(F.desc(F.abs("weight"))).limit(1).select("feature", (F.col("weight") > 0).alias("positive"))


@query(_FIRST, ax=_AXIS)
def forest_first(s, d):
    """The property with the largest importance; importances have no sign but are positive."""
    w, _ = E.forest_axis(_axis(s, d), ["size", "price", "turn"], "y", key="p_partkey")
    return w.orderBy(F.desc("weight")).limit(1).select("feature", (F.col("weight") > 0).alias("positive"))


@query()
def forest_axis(s, d):
    return E.forest_axis(_image_means(s, d), [p for p in _PROPS if p != "perimeter"], "perimeter")[0]


# --- joins, paths, persistence --------------------------------------------------------------------------------------


@query("SELECT image_index, image_path FROM img WHERE image_index NOT IN (SELECT image_index FROM vec)")
def resume_anti_join(s, d):
    return J.not_done(_images(s, d), _vectors(s, d), "image_index", require_overlap=True).select("image_index", "image_path")


@query("SELECT image_path, image_index FROM (SELECT image_path, image_index, row_number() OVER (PARTITION BY image_path ORDER BY image_index) AS r FROM img WHERE image_path NOT IN (SELECT image_path FROM img WHERE source IS NULL)) WHERE r = 1")
def append_dedup(s, d):
    i = _images(s, d).select("image_index", "image_path", "source")
    _, new = J.append_new(i.where("source IS NULL"), i.where("source IS NOT NULL"))
    return new.select("image_path", "image_index")


@query("SELECT coalesce(source, 'none') AS source, compound, count(*) AS n FROM (SELECT source, compound FROM img UNION ALL SELECT 'NEW', 'Temporal' FROM vec WHERE image_index < 100) GROUP BY ALL")
def temporal_append(s, d):
    v = _vectors(s, d)
    i = _images(s, d).select("image_index", "compound", "source").join(v, "image_index", "left")
    t = J.append_temporal(i, v.where("image_index < 100"), ["compound"])
    return t.groupBy(F.coalesce("source", F.lit("none")).alias("source"), "compound").agg(F.count("*").alias("n"))


@query("SELECT image_index, d.doc_id FROM img LEFT JOIN (SELECT image_index, min(doc_id) AS doc_id FROM documents WHERE image_index IS NOT NULL GROUP BY 1) d USING (image_index)")
def keep_first_lookup(s, d):
    doc = J.keep_first(table(s, d, "documents").where("image_index IS NOT NULL"), "image_index", ["doc_id"])
    return _images(s, d).select("image_index").join(doc.select("image_index", "doc_id"), "image_index", "left")


_SUF = "SELECT key, min(id) AS id FROM (SELECT DISTINCT image_index AS id, unnest([array_to_string(list_slice(p, i, len(p)), '/') for i in range(1, len(p) + 1)]) AS key FROM (SELECT image_index, list_filter(string_split_regex(lower({p}), '/+'), lambda x: x <> '') AS p FROM img)) GROUP BY key HAVING count(*) = 1"


@query("SELECT l.id AS image_index, arg_max(r.id, length(l.key)) AS mask_of FROM sl l JOIN sr r USING (key) GROUP BY l.id", sl=_SUF.format(p="image_path"), sr=_SUF.format(p="replace(image_path, '/data/', '/mnt/copy/')"))
def portable_path_match(s, d):
    i = _images(s, d).select("image_index", "image_path")
    moved = i.select(F.col("image_index").alias("mask_of"), F.replace("image_path", F.lit("/data/"), F.lit("/mnt/copy/")).alias("other"))
    return J.portable_path_join(i, moved, "image_path", "other", "image_index", "mask_of").select("image_index", "mask_of")


@query("SELECT image_index, CASE WHEN m THEN regexp_extract(image_path, p, 1) END AS drug, CASE WHEN m THEN regexp_extract(image_path, p, 2) END AS time, CASE WHEN m THEN regexp_extract(image_path, p, 3) END AS name FROM (SELECT image_index, image_path, '(?:^|/)([^/]+?)/([^/]+?)/([^/]+?)\\.[^/.]+(?:\\.gz)?$' AS p, regexp_matches(image_path, '(?:^|/)([^/]+?)/([^/]+?)/([^/]+?)\\.[^/.]+(?:\\.gz)?$') AS m FROM img)")
def path_template(s, d):
    return Y.template_metadata(_images(s, d).select("image_index", "image_path"), ".../(drug)/(time)/(name).*", "image_path", "keep").select("image_index", "drug", "time", "name")


@query("SELECT image_index, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(image_path, '(?i)\\.(nii\\.gz|tif|tiff|png|jpg|jpeg|bmp|npy|npz|nii|gif|webp|csv)$', ''), '[/:\\s]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS made_id FROM img")
def id_sanitize(s, d):
    return _images(s, d).select("image_index", X.path_to_id(F.col("image_path")).alias("made_id"))


@query("SELECT image_index, regexp_replace(regexp_replace(image_path, '^.*/', ''), '(?i)\\.(bmp|csv|gif|gz|jpeg|jpg|nii|npy|npz|png|tif|tiff|webp)$', '') AS stem FROM img")
def strip_extension(s, d):
    return _images(s, d).select("image_index", X.strip_known_extension(X.basename(F.col("image_path"))).alias("stem"))


@query("SELECT image_path AS file_path, mechanism AS found FROM img WHERE replicate = 1")
def csv_lookup(s, d):
    i = _images(s, d)
    lut = i.where("replicate = 1").select(X.basename(F.col("image_path")).alias("filename"), F.col("mechanism").alias("found"))
    return Y.lookup_metadata(i.select(F.col("image_path").alias("file_path")), lut, "filename")


@query("SELECT image_index, len(channel_paths) AS n_channels, channel_paths[1] AS first FROM img WHERE channel_paths IS NOT NULL")
def multichannel_merge(s, d):
    f = _images(s, d).where("channel_paths IS NOT NULL").select("image_index", F.posexplode("channel_paths").alias("channel_index", "file_path"))
    m = Y.merge_channels(f, ["image_index"])
    return m.select("image_index", F.size("channel_paths").cast("bigint").alias("n_channels"), F.col("image_path").alias("first"))


_STRIP = "lower(regexp_replace({p}, '(?i)\\.(nii\\.gz|tif|tiff|png|jpg|jpeg|bmp|npy|npz|nii|gif|webp|csv)$', ''))"


@query(
    "SELECT i.image_index, coalesce(r.f, b.f) AS mask_path FROM ki i LEFT JOIN (SELECT rel, min(f) AS f FROM km GROUP BY 1 HAVING count(*) = 1) r USING (rel) LEFT JOIN (SELECT base, min(f) AS f FROM km GROUP BY 1 HAVING count(*) = 1) b USING (base)",
    mk="SELECT DISTINCT regexp_replace(image_path, '^/data/', '/masks/') || '.png' AS f FROM img WHERE image_index % 2 = 0 UNION SELECT DISTINCT '/masks/other/' || regexp_replace(image_path, '^.*/', '') || '.tif' FROM img WHERE image_index % 5 = 0",
    km="SELECT f, " + _STRIP.format(p="regexp_replace(f, '^/masks/', '')") + " AS rel, " + _STRIP.format(p="regexp_replace(f, '^.*/', '')") + " AS base FROM mk",
    ki="SELECT image_index, " + _STRIP.format(p="regexp_replace(image_path || '.tif', '^/data/', '')") + " AS rel, " + _STRIP.format(p="regexp_replace(image_path || '.tif', '^.*/', '')") + " AS base FROM img",
)
def mask_resolution(s, d):
    """Masks under another root, some with their relative path, some by name alone, some by both."""
    i = _images(s, d)
    p = F.col("image_path")
    masks = i.where("image_index % 2 = 0").select(F.concat(F.regexp_replace(p, "^/data/", "/masks/"), F.lit(".png")).alias("file_path"))
    masks = masks.union(i.where("image_index % 5 = 0").select(F.concat(F.lit("/masks/other/"), X.basename(p), F.lit(".tif")))).distinct()
    c = i.select("image_index", F.concat(p, F.lit(".tif")).alias("image_path"))
    return Y.resolve_masks(c, masks, root="/data", mask_root="/masks").select("image_index", "mask_path")


@query("SELECT image_index, coalesce(CASE WHEN NOT regexp_matches(nullif(trim(id), ''), '[/\\\\]') THEN nullif(trim(id), '') END, image_index::VARCHAR) AS key FROM img")
def stable_key(s, d):
    k = X.stable_key(F.col("id"), {"compound": F.col("compound")})
    return _images(s, d).select("image_index", F.coalesce(k, F.col("image_index").cast("string")).alias("key"))


@query("SELECT DISTINCT time_point, CASE WHEN TRY_CAST(time_point AS BIGINT)::VARCHAR = time_point THEN 'int' WHEN TRY_CAST(time_point AS DOUBLE) IS NOT NULL THEN 'double' WHEN time_point IS NOT NULL THEN 'text' END AS kind FROM img")
def restore_meta_type(s, d):
    t = _images(s, d).select("time_point", X.restore_meta_type(F.col("time_point")).alias("x")).distinct()
    return t.select("time_point", F.when(F.col("x.as_int").isNotNull(), "int").when(F.col("x.as_double").isNotNull(), "double").when(F.col("x.as_text").isNotNull(), "text").alias("kind"))


@query("SELECT image_index, regexp_replace(image_path, '^/data/', '/mnt/new/') AS image_path FROM img")
def rebase_paths(s, d):
    return Y.rebase(_images(s, d).select("image_index", "image_path"), "/data", "/mnt/new", ["image_path"])


@query("SELECT i.image_index, CASE WHEN c.image_index IS NOT NULL THEN c.mechanism ELSE i.compound END AS compound FROM img i LEFT JOIN (SELECT image_index, mechanism FROM img WHERE replicate = 2) c USING (image_index)")
def enrich_metadata(s, d):
    i = _images(s, d)
    return J.enrich_metadata(i.select("image_index", "compound"), i.where("replicate = 2").select("image_index", F.col("mechanism").alias("compound")), "image_index")


@query("SELECT i.image_index, CASE WHEN p.image_path IS NOT NULL THEN p.c ELSE i.concentration END AS concentration FROM img i LEFT JOIN (SELECT image_path, min(-concentration) AS c FROM img WHERE replicate = 1 AND concentration IS NOT NULL GROUP BY 1) p USING (image_path)")
def overlay_by_path(s, d):
    i = _images(s, d).select("image_index", "image_path", "concentration", "replicate")
    prior = i.where("replicate = 1").select("image_path", (-F.col("concentration")).alias("concentration"))
    return J.overlay_by_path(i, prior, ["concentration"]).select("image_index", "concentration")


@query("SELECT coalesce(a.image_index, b.image_index) AS image_index, coalesce(b.concentration, a.concentration) AS concentration, b.replicate FROM (SELECT image_index, concentration FROM img WHERE replicate <= 2) a FULL JOIN (SELECT image_index, concentration + 1 AS concentration, replicate FROM img WHERE replicate >= 2) b USING (image_index)")
def merge_properties(s, d):
    i = _images(s, d)
    return J.merge_properties(i.where("replicate <= 2").select("image_index", "concentration"), i.where("replicate >= 2").select("image_index", (F.col("concentration") + 1).alias("concentration"), "replicate"))


@query("SELECT image_index, compound, round(dd, 6) AS distance, round(e[1], 6) AS embedding_0, round(e[2], 6) AS embedding_1 FROM img LEFT JOIN vec USING (image_index) LEFT JOIN (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) USING (image_index)")
def export_table(s, d):
    i = _images(s, d).select("image_index", "compound")
    v = _vectors(s, d)
    r = D.reference_distances(i, v.withColumnRenamed("embedding", "features"), F.col("compound") == "vehicle", DIM)
    return _r(store.export_frame(i.join(v, "image_index", "left"), r, "embedding", 2), "distance", "embedding_0", "embedding_1")


@query("SELECT o.ordinal::INTEGER AS ordinal, o.image_index, compound FROM (VALUES (0, 42), (1, 7), (2, 42), (3, 3)) o(ordinal, image_index) JOIN img USING (image_index)")
def selection_order(s, d):
    return J.ordered_selection(_images(s, d), [42, 7, 42, 3]).select("ordinal", "image_index", "compound")


@query("SELECT image_index, rank AS new_index FROM (SELECT image_index, row_number() OVER (ORDER BY image_path, image_index) - 1 AS rank FROM img)")
def index_by_path(s, d):
    i = _images(s, d).select(F.col("image_index").alias("was"), "image_path")
    return Y.index_by_path(i).select(F.col("was").alias("image_index"), F.col("image_index").alias("new_index"))


@query("SELECT count(*) AS n FROM img WHERE image_index IN (SELECT image_index FROM vec)")
def store_roundtrip(s, d):
    from lumenframe.runtime import shared_dir

    st = store.ResultStore(s, f"{shared_dir(s)}/store-{__import__('uuid').uuid4().hex}")
    v = _vectors(s, d)
    st.append("embeddings", v.where("image_index % 2 = 0"))
    st.append("embeddings", v.where("image_index % 2 = 1"))
    st.set_params({"dim": DIM})
    st.validate_params({"dim": DIM})
    return st.read("embeddings").join(_images(s, d), "image_index", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT mechanism, round(avg(dd), 6) AS mean, round(min(dd), 6) AS min, round(max(dd), 6) AS max, count(*) AS count FROM img JOIN (SELECT image_index, list_distance(v, c) AS dd FROM vn, refc) USING (image_index) WHERE dd BETWEEN 0.8 AND 1.0 GROUP BY mechanism")
def distance_range(s, d):
    i = _images(s, d).select("image_index", "compound", "mechanism")
    r = D.reference_distances(i, _vectors(s, d, "features"), F.col("compound") == "vehicle", DIM)
    return _r(D.distance_summary(r, ["mechanism"], 0.8, 1.0).drop("std"), "mean", "min", "max")


@query("SELECT image_path AS file_path, regexp_replace(regexp_replace(image_path, '^.*/', ''), '(?i)\\.(nii\\.gz|tif|tiff|png|jpg|jpeg|bmp|npy|npz|nii|gif|webp|csv)$', '') AS filename FROM img WHERE image_path IS NOT NULL")
def default_metadata(s, d):
    f = _images(s, d).where("image_path IS NOT NULL").select(F.col("image_path").alias("file_path"))
    return Y.default_metadata(f).select("file_path", "filename")


@query("SELECT * FROM (SELECT 'rows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'keys', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'appends', 2)")
def stream_append(s, d):
    """Rows that arrive in two parts which overlap, appended by a stream: each key once."""
    import uuid

    from lumenframe.runtime import shared_dir
    from lumenframe.streaming.ingest import append_stream

    root = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    o, st = table(s, d, "orders"), store.ResultStore(s, root + "/store")
    for k, part in enumerate((o.where("o_orderkey % 3 < 2"), o.where("o_orderkey % 3 > 0"))):
        part.write.mode("append").parquet(root + "/in")
        append_stream(s.readStream.schema(o.schema).parquet(root + "/in"), st, "orders", "o_orderkey", root + "/checkpoint").awaitTermination()
    got = st.read("orders").agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys")).first()
    return s.createDataFrame([("rows", got["rows"]), ("keys", got["keys"]), ("appends", len(st.run_log()))], "what string, n bigint")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counts(s, d):
    """Events per day, counted by a stream with a watermark."""
    import uuid

    from lumenframe.runtime import shared_dir
    from lumenframe.streaming.ingest import late_counts

    root = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    e = table(s, d, "events").select("event_id", "ts")
    e.write.parquet(root + "/in")
    name = f"daily_{uuid.uuid4().hex}"
    late_counts(s, root + "/in", "event_id bigint, ts timestamp", "ts").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


_LIFE = "SELECT * FROM (SELECT 'appended' AS step, count(*) AS n FROM vec UNION ALL SELECT 'wider', count(*) FROM vec WHERE image_index % 2 = 1 UNION ALL SELECT 'updated', count(*) FROM vec WHERE image_index < 50 UNION ALL SELECT 'picked', count(*) FROM vec WHERE image_index IN (3, 5, 8) UNION ALL SELECT 'cloned', count(*) FROM vec UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'steps', 4)"


@query(_LIFE)
def store_lifecycle(s, d):
    """A store through appends with a further column, an update, reads by index, a copy, and clearing properties."""
    from lumenframe.runtime import shared_dir

    path = f"{shared_dir(s)}/store-{__import__('uuid').uuid4().hex}"
    st, v = store.ResultStore(s, path), _vectors(s, d)
    st.append("embeddings", v.where("image_index % 2 = 0"))
    st.append("embeddings", v.where("image_index % 2 = 1").withColumn("note", F.lit("late")))
    st.write("properties", v.select("image_index", F.lit(1.0).alias("p")))
    st.update_embeddings(v.where("image_index < 50").select("image_index", F.transform("embedding", lambda x: x * F.lit(0).cast("float")).alias("embedding")))
    e = materialize(st.read("embeddings"), "stored")
    steps = len(st.run_log())
    copy = st.clone(path + "-copy")
    st.clear_properties()
    rows = [("appended", e.count()), ("wider", e.where("note = 'late'").count()), ("updated", e.where(~F.exists("embedding", lambda x: x != 0)).count()), ("picked", st.embeddings_of([3, 5, 8]).count()), ("cloned", copy.read("properties").count()), ("cleared", int(st.has("properties"))), ("steps", steps)]
    return s.createDataFrame(rows, "step string, n bigint")


@query("SELECT kind, (SELECT count(*) FROM img) AS n, (SELECT round(sum(concentration), 4) FROM img) AS total FROM (VALUES ('csv'), ('json'), ('parquet')) t(kind)")
def export_files(s, d):
    """The export written as each format and read again; the extension decides, not the format asked for."""
    from lumenframe.runtime import shared_dir

    root = f"{shared_dir(s)}/export-{__import__('uuid').uuid4().hex}"
    i = _images(s, d).select("image_index", "compound", "concentration", "channel_paths")
    out = None
    for kind in ("csv", "json", "parquet"):
        assert store.export_table(i, f"{root}/t.{kind}", "csv") == kind
        r = s.read.option("header", True).format(kind).load(f"{root}/t.{kind}")
        one = r.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum(F.col("concentration").cast("double")), 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'kept' AS step, count(*) AS n FROM img WHERE image_index NOT IN (SELECT image_index FROM (" + _OUT_Z + ")) UNION ALL SELECT 'temporal', count(*) + (SELECT count(*) FROM vec WHERE image_index < 10) FROM img UNION ALL SELECT 'cleared', count(*) FROM img WHERE source IS DISTINCT FROM 'NEW' UNION ALL SELECT 'table', count(*) FROM img UNION ALL SELECT 'reset', 0", **{**_OWN, "g": "SELECT image_index, 'All' AS g0, v FROM vn"})
def session_flow(s, d):
    """A session that drops outliers, takes and gives back rows of its own, makes its table and is reset."""
    from lumenframe.plans.session import Session

    v = _vectors(s, d)
    one = Session(_images(s, d).withColumn("source", F.coalesce("source", F.lit("none"))), v, None, DIM)
    kept = one.drop_outliers(one.detect_outliers(threshold=2.0))
    more = one.process_temporal(v.where("image_index < 10"))
    rows = [("kept", kept.catalog.count()), ("temporal", more.catalog.count()), ("cleared", more.clear_temporal().catalog.count()), ("table", one.table().count()), ("reset", int(one.reset().embeddings is not None))]
    return s.createDataFrame(rows, "step string, n bigint")


def flagship(s, d):
    return materialize(ref_distance_centroid_euclidean(s, d), "flagship")
