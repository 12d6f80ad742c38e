"""Grouped statistics, counts, distributions and tests between groups."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.special import t_pvalue, t_quantile
from lumenframe.operators.predicates import finite_or_null


def long_properties(df: DataFrame, ids: list[str], props: list[str]) -> DataFrame:
    """``(*ids, property, value)``, non-finite values as null: one pass over the rows, no join."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), finite_or_null(F.col(p)).alias("value")) for p in props]))
    return df.select(*ids, pairs.alias("_x")).select(*ids, "_x.property", "_x.value")


def property_stats_by_group(df: DataFrame, props: list[str], group_by: list[str] | None = None) -> DataFrame:
    """``N`` and ``{p}_mean/_std/_min/_max`` per group; std is the sample's; null group keys are dropped; N counts all rows."""
    group_by = group_by or []
    if group_by:
        df = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group_by]))
    aggs = [F.count("*").alias("N")]
    for p in props:
        x = finite_or_null(F.col(p))
        aggs += [F.avg(x).alias(f"{p}_mean"), F.stddev_samp(x).alias(f"{p}_std"), F.min(x).alias(f"{p}_min"), F.max(x).alias(f"{p}_max")]
    return df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)


def counts_with_share(df: DataFrame, group_by: list[str]) -> DataFrame:
    """Rows per group and their percent of the total; null keys are dropped."""
    df = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group_by]))
    n = df.groupBy(*group_by).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("_all"))  # one row
    return n.crossJoin(F.broadcast(whole)).select(*group_by, "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("percent"))


def group_label(cols: list[Column], missing: str = "N/A") -> Column:
    """Composite label ``a | b``."""
    return F.concat_ws(" | ", *[F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(missing)) for c in cols])


def value_distribution(df: DataFrame, col: str, top: int = 10) -> DataFrame:
    """The ``top`` values, the rest as Other, nulls and blanks as Missing; percent of the non-missing.

    The top is a top-k of the counts and the rest a difference of sums, so values are never sorted as a whole.
    """
    v = F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))
    n = df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    best = n.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(top)
    sums = df.agg(F.count(v).alias("known"), (F.count("*") - F.count(v)).alias("lost")).crossJoin(best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inside")))
    rest = sums.select(F.explode(F.array(F.struct(F.lit("Other").alias("value"), (F.col("known") - F.col("inside")).alias("n"), F.lit(True).alias("on")), F.struct(F.lit("Missing").alias("value"), F.col("lost").alias("n"), F.lit(False).alias("on")))).alias("x")).select("x.*").where("n > 0")
    every = best.withColumn("on", F.lit(True)).unionByName(rest)
    return every.crossJoin(F.broadcast(sums.select("known"))).select("value", "n", F.when(F.col("on"), F.round(100.0 * F.col("n") / F.col("known"), 6)).alias("percent"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by ``col`` as columns ``n_<value>``; missing values of both are Unknown."""
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown"))
    return df.groupBy(known(row).alias(row)).agg(*[F.count(F.when(known(col) == v, 1)).alias(f"n_{v}") for v in values])


def nan_profile(df: DataFrame, props: list[str]) -> DataFrame:
    """``(property, n_missing, n_rows)``; one row of counts is turned, the data is not."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(finite_or_null(F.col(p))).alias(f"_c{i}") for i, p in enumerate(props)])
    cells = [F.struct(F.lit(p).alias("property"), (F.col("_n") - F.col(f"_c{i}")).alias("n_missing"), F.col("_n").alias("n_rows")) for i, p in enumerate(props)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).distinct()


def stats_cards(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.agg(F.count("*").alias("n_images"), F.count_distinct(cluster).alias("n_clusters"))


def histogram_entropy(df: DataFrame, props: list[str], bins: int = 10) -> DataFrame:
    """``(property, entropy)``: entropy in nats of min(bins, n) equal-width bins; 0 for a constant property."""
    long = long_properties(df, [], props).where("value IS NOT NULL")
    r = long.groupBy("property").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    k = F.least(F.lit(bins), F.col("n"))
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) * k / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), k - 1)
    c = long.join(F.broadcast(r), "property").withColumn("bin", F.coalesce(bin_, F.lit(0))).groupBy("property", "bin", "n").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return c.groupBy("property").agg(F.round(-F.sum(p * F.log(p)), 6).alias("entropy"))


def confidence_band(df: DataFrame, group_by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and half width of its confidence interval per group; half width 0 for a single value.

    The t quantiles are looked up for the degrees of freedom that occur, by an Arrow function on the grouped rows.
    """
    x = finite_or_null(F.col(value))
    n = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group_by])).groupBy(*group_by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))

    @F.pandas_udf("double")
    def quantile(df_: pd.Series) -> pd.Series:
        known = {d: t_quantile(0.5 + level / 2, d) if d > 0 else 0.0 for d in df_.unique()}
        return df_.map(known)

    half = F.when(F.col("n") > 1, quantile((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return n.select(*group_by, "n", "mean", half.alias("half_width"))


def moments_by_group(df: DataFrame, group: str, props: list[str]) -> DataFrame:
    """``(group, property, n, mean, m2)`` with m2 the sum of squared deviations; missing groups are dropped."""
    x = {i: finite_or_null(F.col(p)) for i, p in enumerate(props)}
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[a for i, c in x.items() for a in (F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_m{i}"), F.var_pop(c).alias(f"_v{i}"))])
    cells = [F.struct(F.lit(p).alias("property"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"), (F.col(f"_v{i}") * F.col(f"_n{i}")).alias("m2")) for i, p in enumerate(props)]
    return g.select(group, F.explode(F.array(*cells)).alias("x")).select(group, "x.*").where("n > 0")


def group_enrichment(df: DataFrame, group: str, props: list[str], alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Each group against all other rows: ``(group, property, n_group, n_rest, mean_group, mean_rest, score, t, df, p_value,
    significant)``.

    score = (mean_group - mean_rest) / sample std of the rest; dropped where that is under 1e-10; groups under 3 values are
    skipped. Welch's t; Benjamini-Hochberg over all rows of the result. The rest is total minus group on centred moments
    (parallel variance update), so the data is aggregated once.
    """
    m = moments_by_group(df, group, props)
    w = Window.partitionBy("property")
    tot_n, tot_mean = F.sum("n").over(w), F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)
    m = m.withColumn("all_n", tot_n).withColumn("all_mean", tot_mean)
    m = m.withColumn("all_m2", F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2).over(w))
    nr = F.col("all_n") - F.col("n")
    m = m.withColumn("n_rest", nr).where("n >= 3 AND n_rest >= 2")
    m = m.withColumn("mean_rest", (F.col("all_n") * F.col("all_mean") - F.col("n") * F.col("mean")) / F.col("n_rest"))
    delta = F.col("mean") - F.col("mean_rest")
    m = m.withColumn("m2_rest", F.greatest(F.lit(0.0), F.col("all_m2") - F.col("m2") - delta**2 * F.col("n") * F.col("n_rest") / F.col("all_n")))
    m = m.withColumn("v1", F.col("m2") / (F.col("n") - 1)).withColumn("v2", F.col("m2_rest") / (F.col("n_rest") - 1)).where("sqrt(v2) >= 1e-10")
    se2 = F.col("v1") / F.col("n") + F.col("v2") / F.col("n_rest")
    deg = se2**2 / ((F.col("v1") / F.col("n")) ** 2 / (F.col("n") - 1) + (F.col("v2") / F.col("n_rest")) ** 2 / (F.col("n_rest") - 1))
    out = m.select(F.col(group).alias("group"), "property", F.col("n").alias("n_group"), "n_rest", F.col("mean").alias("mean_group"), "mean_rest", (delta / F.sqrt("v2")).alias("score"), (delta / F.sqrt(se2)).alias("t"), deg.alias("df"))
    if not with_p:
        return out
    return benjamini_hochberg(out.withColumn("p_value", t_pvalue(F.col("t"), F.col("df"))), "p_value", alpha)


def sorted_enrichment(e: DataFrame) -> DataFrame:
    """By group, then by the size of the score."""
    return e.orderBy("group", F.desc(F.abs("score")), "property")


def top_enriched(e: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` properties of each group with the largest scores by size: adds ``rank``."""
    w = Window.partitionBy("group").orderBy(F.desc(F.abs("score")), "property")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds ``significant``: p at most the largest p(k) with p(k) <= k/m alpha. Rows without p are not significant.

    The ranks need one ordering of the tests (groups x properties, not data rows).
    """
    w = Window.partitionBy(F.col(p).isNull())
    m = F.count("*").over(w)
    k = F.count("*").over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    ranked = df.withColumn("_ok", F.when(F.col(p).isNotNull() & (F.col(p) <= k / m * alpha), F.col(p)))
    cut = F.max("_ok").over(w)
    return ranked.withColumn("significant", F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_ok")


def top_properties_different(df: DataFrame, group: str, reference: str, props: list[str], k: int = 5, metric: str = "cohens_d") -> DataFrame:
    """The k properties of each group that differ most from the reference group: ``(group, property, effect, rank)``.

    cohens_d pools the sample variances; mean_diff ranks by the absolute difference and reports the signed one.
    """
    if metric not in ("cohens_d", "mean_diff"):
        raise ValueError(f"unknown metric {metric!r}")
    m = moments_by_group(df, group, props)
    ref = m.where(F.col(group) == reference).select("property", F.col("n").alias("n2"), F.col("mean").alias("mean2"), F.col("m2").alias("m22"))
    j = m.where(F.col(group) != reference).join(F.broadcast(ref), "property")
    diff = F.col("mean") - F.col("mean2")
    pooled = F.sqrt((F.col("m2") + F.col("m22")) / F.greatest(F.col("n") + F.col("n2") - 2, F.lit(1)) + 1e-10)
    j = j.withColumn("effect", diff / pooled if metric == "cohens_d" else diff)
    w = Window.partitionBy(group).orderBy(F.desc(F.abs("effect")), "property")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col(group).alias("group"), "property", "effect", "rank")


def zscore_columns(df: DataFrame, props: list[str], over: DataFrame | None = None) -> DataFrame:
    """Columns scaled by mean and population std of ``over`` (all images, even if ``df`` is a filtered set); a std under
    1e-12 scales by 1; non-finite cells are null. The scaler is one row."""
    src = over if over is not None else df
    aggs = [f(finite_or_null(F.col(p))).alias(f"_{n}{i}") for i, p in enumerate(props) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    s = src.agg(*aggs)
    scaled = {p: (finite_or_null(F.col(p)) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") < 1e-12, 1.0).otherwise(F.col(f"_s{i}")) for i, p in enumerate(props)}
    return df.crossJoin(F.broadcast(s)).withColumns(scaled).select(*df.columns)


def nan_policy(df: DataFrame, props: list[str], policy: str = "filter") -> DataFrame:
    """filter: rows without nulls; drop_columns: columns without nulls; impute: 0; warn and keep: as they are."""
    df = df.withColumns({p: finite_or_null(F.col(p)) for p in props})
    if policy == "filter":
        return df.na.drop(subset=props)
    if policy == "impute":
        return df.na.fill(0.0, subset=props)
    if policy == "drop_columns":
        r = df.agg(*[F.count(F.when(F.col(p).isNull(), 1)).alias(p) for p in props]).first()
        return df.drop(*[p for p in props if r[p]])
    if policy in ("warn", "keep"):
        return df
    raise ValueError(f"unknown policy {policy!r}")


def combined_features(images: DataFrame, vec: str, props: list[str], key: str = "image_index") -> DataFrame:
    """``(key, features)``: unit embedding, then z-scored properties over sqrt(p); rows with a missing property drop out."""
    from lumenframe.functions.vectors import l2_normalize

    z = zscore_columns(images, props).na.drop(subset=props)
    tail = F.array(*[F.col(p) / (len(props) ** 0.5) for p in props])
    return z.select(key, F.concat(l2_normalize(F.col(vec)), tail).alias("features"))
