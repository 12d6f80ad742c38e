"""The pN queries over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import clusters, group_splits, leaks, mixing, neighbours, quantiles, sentences, subset
from lumenframe.runtime import materialize, table

EVERY = {"probes": 160, "beam": 23, "margin": 0.25}  # of p5_every: loners look far around, rows in a crowd but in a few cells
PROPERTIES = ["area", "perimeter", "intensity_mean", "texture_contrast", "eccentricity", "solidity", "orientation", "blob_count"]


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    """A varied tenth of the images."""
    t = table(spark, d, "image_vectors")
    return subset.varied_subset(t, "image_index", "embedding", size=max(1, t.count() // 10))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Size and repeats of the subset; clusters of at least 8 images without a chosen one; whether every cluster with a
    twentieth of the images or more makes up at most half that share of the subset."""
    chosen = materialize(p1_subset(spark, d).select("image_index"), "chosen")
    c = materialize(p4_found(spark, d), "clusters")
    usable = subset.bucket_keys(table(spark, d, "image_vectors"), "image_index", "embedding", tables=1).count()
    took = chosen.count()
    n = c.groupBy("cluster_head").agg(F.count("*").alias("n")).join(c.join(chosen, "image_index").groupBy("cluster_head").agg(F.count("*").alias("m")), "cluster_head", "left").fillna(0)
    big = F.col("n") >= usable / 20
    k = n.agg(F.count(F.when(F.col("m") == 0, 1)).alias("kinds_missed"), F.coalesce(F.min(F.when(big, F.col("m") / took <= F.col("n") / usable / 2)), F.lit(True)).alias("crowds_cut"))
    return chosen.agg(F.count("*").alias("chosen"), (F.count("*") - F.count_distinct("image_index")).alias("repeated")).crossJoin(k)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.linked_clusters(table(spark, d, "image_vectors"), "image_index", "embedding", least_size=8)
    return c.select(F.col("id").alias("image_index"), F.col("head").alias("cluster_head"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and three most typical images of each cluster of at least 8 images."""
    t = table(spark, d, "image_vectors")
    c = materialize(clusters.linked_clusters(t, "image_index", "embedding", least_size=8), "clusters")
    return clusters.describe(t, c, "image_index", "embedding").withColumnRenamed("id", "image_index")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "image_vectors"), "image_index", "embedding", k=5, least=0.97)


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every image whose id is divisible by 50, among all images."""
    t = table(spark, d, "image_vectors")
    return neighbours.search_queries(t, t.where(F.col("image_index") % 50 == 0), "image_index", "embedding", k=10)


def p5_every(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every image."""
    return neighbours.nearest_neighbours(table(spark, d, "image_vectors"), "image_index", "embedding", k=10, **EVERY)


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether :func:`p5_every` finds nine of ten of what an exact scan finds for the images whose id is divisible by 50."""
    t = table(spark, d, "image_vectors")
    true = materialize(neighbours.search_queries(t, t.where(F.col("image_index") % 50 == 0), "image_index", "embedding", k=10, exact_scan=True).select("query", "neighbour"), "true")
    got = p5_every(spark, d).where(F.col("query") % 50 == 0).select("query", "neighbour")
    hit = true.join(got, ["query", "neighbour"], "left_semi").agg(F.count("*").alias("hit"))
    return true.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("all")).crossJoin(hit).select("queries", (F.col("hit") >= 0.9 * F.col("all")).alias("enough"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.tied_batches(table(spark, d, "fold_labels"))


def _split_targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r[0], r[1]) for r in table(spark, d, "split_targets").select("split_name", "row_share").orderBy(F.desc("row_share"), "split_name").collect()]


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits by row shares and by the mean target value of the groups."""
    t = table(spark, d, "fold_labels")
    value = t.where(F.col("image_index").isNotNull()).groupBy("image_index").agg(F.min(F.when(~F.isnan("target_value"), F.col("target_value"))).alias("target_value"))
    groups = materialize(group_splits.batch_groups(t).select("image_index", "group").join(value, "image_index", "left"), "groups")
    return group_splits.assign_splits(groups, _split_targets(spark, d), F.col("target_value")).select("image_index", "group", "split_name")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    s = p2_splits(spark, d)
    return s.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_distinct("group").alias("n_groups"))


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each split has whole groups alone, and its share of the rows to within the largest group."""
    s = materialize(p2_splits(spark, d), "splits")
    g = s.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("split_name").alias("splits"), F.first("split_name").alias("split_name"))
    whole = g.agg(F.sum("n").alias("all"), F.max("n").alias("largest"), F.max("splits").alias("most"))
    t = table(spark, d, "split_targets").join(g.groupBy("split_name").agg(F.sum("n").alias("n")), "split_name", "left").crossJoin(whole)
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("row_share") * F.col("all")) <= F.greatest("largest", F.lit(1))
    return t.select("split_name", (F.col("most") == 1).alias("whole"), near.alias("near"))


def _objects(spark: SparkSession, d: str, props: list[str], keys: list[str]) -> DataFrame:
    """Objects without their repeats, which agree in all but the time of arrival; rows meet by their whole content, so a
    compound with many rows is spread like any other."""
    t = table(spark, d, "image_properties").where(F.col("compound").isNotNull())
    return t.select("compound", "image_index", "object_no", *[k for k in keys if k != "compound"], *props).distinct()


def daily_sketches(spark: SparkSession, d: str, props: list[str], k: int = quantiles.K, b: int = quantiles.B) -> DataFrame:
    keys = ["compound", "run_day"]
    return quantiles.sketch_by_group(_objects(spark, d, props, keys).select(*keys, *props), keys, props, k, b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    props, pcts = PROPERTIES[:4], [25, 50, 75]
    found = materialize(quantiles.outlying_days(daily_sketches(spark, d, props), "compound", "run_day", pcts), "days")
    ids = ["compound", "property", "run_day", "pct"]
    sure, unsure = found.where("sure").select(*ids), found.where("NOT sure").drop("sure")
    if unsure.isEmpty():
        return sure
    return sure.unionByName(quantiles.decide_exactly(_objects(spark, d, props, ["run_day"]), unsure, "compound", "run_day", props))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All eight properties per compound, from the daily sketches combined over all days."""
    all_days = quantiles.merge_sketches(daily_sketches(spark, d, PROPERTIES).drop("run_day"), ["compound"])
    return quantiles.percentiles(all_days, ["compound"], [5, 25, 50, 75, 95])


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Small buffers, so that groups collapse even in small tables: whether each answer keeps the error it states."""
    k, b, props = 16, 4, PROPERTIES[:4]
    s = quantiles.merge_sketches(daily_sketches(spark, d, props, k, b).drop("run_day"), ["compound"], k, b)
    q = materialize(quantiles.percentiles(s, ["compound"], [25, 50, 75], k, b), "percentiles")
    o = _objects(spark, d, props, ["run_day"])
    v = o.select("compound", F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("v")) for p in props])).alias("x")).select("compound", "x.property", "x.v")
    v = v.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).join(q, ["compound", "property"])
    ids = ["compound", "property", "pct", "n", "value", "rank_error"]
    r = v.groupBy(*ids).agg(F.count(F.when(F.col("v") < F.col("value"), 1)).alias("under"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("n") / 100))
    held = F.greatest(F.col("under") + 1 - rank, rank - F.col("upto"), F.lit(0)) <= F.col("rank_error")
    return r.select("compound", "property", "pct", "n", held.alias("held"), ((F.col("rank_error") > 0) | (F.col("n") < 2 * k * b)).alias("collapsed"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each test item leaked into, and its longest stretch."""
    found = leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("stretch").alias("longest"))


def p6_planted(spark: SparkSession, d: str) -> DataFrame:
    """Every test item put into documents as it is, in capitals with other spacing, and with each eighth word changed."""
    i = table(spark, d, "benchmark_items")
    swap = F.array_join(F.transform(F.split("text", " "), lambda w, k: F.when(k % 9 == 8, F.lit("zzz")).otherwise(w)), " ")
    forms = F.array(F.concat(F.lit("Intro. "), "text", F.lit(" End.")), F.regexp_replace(F.upper("text"), " ", " \n"), swap)
    t = i.select("item_id", F.posexplode(forms).alias("form", "text")).select((F.col("item_id") * 10 + F.col("form")).alias("doc_id"), "text")
    return leaks.leaked(t, i).select("doc_id", "item_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by the whole method; the cases are those of the sources' own documents."""
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), soft=True)
    return report.where("alone_short").select("source", F.col("alone_passes").alias("passes"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached, when documents without a source are drawn by their posteriors as well and no source runs out."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), soft=True, total="reachable")[1].drop("alone_passes", "alone_short")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether no document is used too often, and each source is drawn to within one document of what it needs."""
    t = table(spark, d, "mix_targets")
    plan, report = mixing.mix(table(spark, d, "documents"), t, total="reachable")
    over = plan.join(F.broadcast(t), "source").groupBy("source").agg(F.max(F.col("copies") <= F.col("max_repeats")).alias("kept"), F.max("tokens").alias("largest"))
    return report.join(over, "source").select("source", "kept", (F.abs(F.col("drawn") - F.col("need")) <= F.col("largest")).alias("met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


# known units of a few texts, by document; blanks between them are the third value
PLANTED = [
    (1, ["Heading of a note", "The plate was read at 3.5 h.", "Nobody moved the rack."], ["\n\n", " "]),
    (2, ["The signal rose to 0.66 in well B04.", "Is the compound stable?", "Stop the pump!"], [" ", " "]),
    (3, ["The report says that the plate (see p. 4) was dry.", "The focus was lost twice."], ["\n"]),
    (4, ["快停泵！", "细胞系放置了九分钟。", "它会分解吗？"], ["", ""]),
    (5, ["La placa estaba seca.", "¿Quién movió la rejilla?"], [" "]),
]


def p8_planted(spark: SparkSession, d: str) -> DataFrame:
    """Units of texts put together from known ones, by the model of the corpus."""
    rows = [(i, "".join(u + g for u, g in zip(us, [*gaps, ""]))) for i, us, gaps in PLANTED]
    t = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sentences.split_sentences(t, train_on=table(spark, d, "documents"))


def _planted_rows() -> list[tuple[int, int, int]]:
    out = []
    for i, us, gaps in PLANTED:
        at = 0
        for u, g in zip(us, [*gaps, ""]):
            out.append((i, at, at + len(u)))
            at += len(u) + len(g)
    return out


QUERIES = {f.__name__: f for f in (p1_subset, p1_cover, p2_found, p2_splits, p2_shares, p2_kept, p3_found, p3_percentiles, p3_bounds, p4_found, p4_clusters, p5_found, p5_neighbours, p5_every, p5_recall, p6_found, p6_items, p6_planted, p7_found, p7_mix, p7_plan, p7_limits, p8_found, p8_planted)}

_VEC = """vec AS (SELECT image_index, any_value(embedding)::DOUBLE[] AS e FROM image_vectors WHERE len(embedding) = 128
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1),
unit AS (SELECT image_index AS i, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM vec),
pair AS (SELECT a.i AS a, b.i AS b, list_inner_product(a.v, b.v) AS s FROM unit a JOIN unit b ON a.i <> b.i)"""

_OBJECTS = """obj AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM image_properties WHERE compound IS NOT NULL),
val AS (SELECT compound, run_day, property, v FROM obj, LATERAL (VALUES {props}) t(property, v) WHERE isfinite(v))"""


def _values(props: list[str]) -> str:
    return _OBJECTS.format(props=", ".join(f"('{p}', {p})" for p in props))


SQL: dict[str, str] = {
    "p2_found": """WITH RECURSIVE n AS (SELECT image_index, CASE WHEN isfinite(d) AND abs(d) < 1e15 AND d = floor(d) THEN d::BIGINT END AS b,
  CASE WHEN l NOT IN ('', 'nan', 'n/a', 'na', 'none', 'null', 'unknown', 'missing', 'nil', '-', '--', '?', '<na>') THEN l END AS l
  FROM (SELECT image_index, TRY_CAST(trim(batch_id) AS DOUBLE) AS d, lower(regexp_replace(labels, '\\s', '', 'g')) AS l FROM fold_labels)),
ed AS (SELECT DISTINCT x.b AS a, y.b AS b FROM n x JOIN n y USING (l) WHERE x.b IS NOT NULL AND y.b IS NOT NULL UNION SELECT DISTINCT b, b FROM n WHERE b IS NOT NULL),
reach AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b = ed.a),
head AS (SELECT a AS b, min(b) AS group_batch, count(*) AS c FROM reach GROUP BY 1),
lab AS (SELECT l, min(b) AS b FROM n WHERE b IS NOT NULL AND l IS NOT NULL GROUP BY 1)
SELECT DISTINCT image_index, group_batch FROM (SELECT image_index, coalesce(n.b, lab.b) AS b FROM n LEFT JOIN lab USING (l)) JOIN head USING (b) WHERE c >= 2""",
    "p3_found": f"WITH {_values(PROPERTIES[:4])}, days AS (SELECT DISTINCT compound, property, run_day FROM val), "
    "q AS (SELECT d.compound, d.property, d.run_day, quantile_cont(v, [0.25, 0.5, 0.75]) FILTER (val.run_day = d.run_day) AS q, quantile_cont(v, [0.25, 0.5, 0.75]) FILTER (val.run_day <> d.run_day) AS o, "
    "count(*) FILTER (val.run_day = d.run_day) AS n, count(*) FILTER (val.run_day <> d.run_day) AS m FROM days d JOIN val USING (compound, property) GROUP BY ALL) "
    "SELECT compound, property, run_day, pct::INTEGER AS pct FROM (SELECT compound, property, run_day, n, m, unnest([25, 50, 75]) AS pct, unnest(q) AS q, unnest(o) AS o FROM q) WHERE n >= 30 AND m >= 30 AND (q > 3 * o OR q < o / 3)",
    "p3_percentiles": f"WITH {_values(PROPERTIES)}, r AS (SELECT compound, property, v, row_number() OVER w AS k, count(*) OVER (PARTITION BY compound, property) AS n FROM val WINDOW w AS (PARTITION BY compound, property ORDER BY v)) "
    "SELECT compound, property, pct::INTEGER AS pct, n, v AS value, 0.0::DOUBLE AS rank_error FROM r, (VALUES (5), (25), (50), (75), (95)) p(pct) WHERE k = greatest(1, (pct * n + 99) // 100)",
    "p4_found": f"WITH RECURSIVE {_VEC}, ed AS (SELECT a, b FROM pair WHERE s >= 0.75), reach AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b = ed.a) "
    "SELECT a AS image_index, least(a, min(b)) AS cluster_head FROM reach GROUP BY a HAVING count(*) >= 8",
    "p6_planted": "SELECT item_id * 10 + form AS doc_id, item_id FROM benchmark_items, (VALUES (0), (1), (2)) f(form)",
    "p5_recall": f"WITH {_VEC} SELECT count(*) AS queries, true AS enough FROM unit WHERE i % 50 = 0",
    "p2_kept": "SELECT split_name, true AS whole, true AS near FROM split_targets",
    "p1_cover": f"WITH {_VEC} SELECT greatest(1, (SELECT count(*) FROM image_vectors) // 10)::BIGINT AS chosen, 0::BIGINT AS repeated, 0::BIGINT AS kinds_missed, true AS crowds_cut",
    "p3_bounds": f"WITH {_values(PROPERTIES[:4])}, g AS (SELECT compound, property, count(*) AS n FROM val GROUP BY ALL) SELECT compound, property, pct::INTEGER AS pct, n, true AS held, true AS collapsed FROM g, (VALUES (25), (50), (75)) p(pct)",
    "p8_planted": "SELECT doc_id::BIGINT AS doc_id, start_char, end_char FROM (VALUES " + ", ".join(map(str, _planted_rows())) + ") t(doc_id, start_char, end_char)",
    "p5_neighbours": f"WITH {_VEC} SELECT a AS query, b AS neighbour, s AS similarity, r::INTEGER AS rank FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pair WHERE a % 50 = 0) WHERE r <= 10",
    # any measure of length gives the same cases, so bytes stand for tokens
    "p7_found": "WITH n AS (SELECT trim(source) AS source, sum(octet_length(encode(text)))::DOUBLE AS t FROM documents WHERE trim(source) <> '' GROUP BY 1) "
    "SELECT source, least(max_repeats, ceil(token_share * (SELECT sum(t) FROM n) / t))::INTEGER AS passes FROM mix_targets JOIN n USING (source) WHERE token_share * (SELECT sum(t) FROM n) > t",
    "p7_limits": "SELECT source, true AS kept, true AS met FROM mix_targets",
    "p4_clusters": f"WITH RECURSIVE {_VEC}, ed AS (SELECT a, b FROM pair WHERE s >= 0.75), reach AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b = ed.a), "
    "cl AS (SELECT a AS i, least(a, min(b)) AS head, count(*) AS size FROM reach GROUP BY a HAVING count(*) >= 8), m AS (SELECT head, size, i, v FROM cl JOIN unit USING (i)), "
    "c AS (SELECT head, list(x ORDER BY pos) AS c FROM (SELECT head, pos, sum(x) AS x FROM (SELECT head, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM m) GROUP BY ALL) GROUP BY head) "
    "SELECT head, size, image_index, similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY similarity DESC, image_index) AS rank FROM (SELECT head, size, i AS image_index, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) AS similarity FROM m JOIN c USING (head))) WHERE rank <= 3",
    "p5_found": f"WITH {_VEC} SELECT DISTINCT least(a, b) AS image_a, greatest(a, b) AS image_b FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pair) WHERE r <= 5 AND s >= 0.97",
}
