"""The lowest rows of a table up to a wanted weight, per group, without sorting the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1_024
RANKED = 20_000  # rows of a group that are ranked in one task at the end


def lowest(t: DataFrame, want: dict, by: str, ties: str, weight: str | None = None, group: str | None = None, nearest: bool = False) -> DataFrame:
    """The rows of each group that come first by ``(by, ties)`` until their weights add up to ``want[group]``.

    A row that would go beyond is left out (with ``nearest`` it is taken where that comes closer). ``by`` is a finite
    double; groups without an entry of ``want`` give no row, and a null ``weight`` counts 0. The value at which a group is
    cut is narrowed down by counting: each pass counts BINS ranges of the range found last, until that holds at most
    RANKED rows, whatever the size of the table; only those are ranked. ``t`` is read once a pass: hand in a written table.
    """
    g = F.col(group) if group else F.lit(0)
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("double")
    spark = t.sparkSession
    ends = {r[0]: (float(r[1]), float(r[2])) for r in t.groupBy(g.alias("g")).agg(F.min(by), F.max(by)).collect() if r[0] in want and r[1] is not None}
    state = {k: [lo, hi + max(abs(hi), 1.0) * 1e-12, 0.0, None] for k, (lo, hi) in ends.items()}  # from, below, weight before, rows
    todo = set(state)
    kind = "bigint" if not group else t.schema[group].dataType.simpleString()

    def marked(keys) -> DataFrame:
        rows = spark.createDataFrame([(k, *map(float, state[k][:3])) for k in keys], f"_g {kind}, _lo double, _hi double, _base double")
        return t.withColumn("_g", g).join(F.broadcast(rows), "_g")

    while todo:
        x = marked(todo).where((F.col(by) >= F.col("_lo")) & (F.col(by) < F.col("_hi")))
        b = F.least(F.lit(BINS - 1), F.floor((F.col(by) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).cast("int")
        got: dict = {}
        for r in x.groupBy(F.col("_g").alias("g"), b.alias("b")).agg(F.sum(w).alias("w"), F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect():
            got.setdefault(r["g"], []).append(r)
        for k in list(todo):
            base, last = state[k][2], None
            for r in sorted(got.get(k, []), key=lambda r: r["b"]):
                last = (r["lo"], r["hi"], base, r["n"])
                if base + r["w"] > want[k]:
                    break
                base += r["w"]
            else:
                last = None
            if last is None:  # everything is wanted
                state[k] = [float("inf"), float("inf"), base, 0]
                todo.discard(k)
                continue
            lo, hi, before, n = last
            state[k] = [lo, hi + max(abs(hi), 1e-300) * 1e-15, before, n]
            if n <= RANKED or hi <= lo:
                todo.discard(k)
    m = marked(list(state))
    under = m.where(F.col(by) < F.col("_lo"))
    run = F.sum(w).over(Window.partitionBy("_g").orderBy(by, ties).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_base")
    goal = spark.createDataFrame([(k, float(want[k])) for k in state], f"_g {kind}, _want double")
    edge = m.where((F.col(by) >= F.col("_lo")) & (F.col(by) <= F.col("_hi"))).withColumn("_run", run).join(F.broadcast(goal), "_g")
    edge = edge.where(F.col("_run") - (w / 2 if nearest else F.lit(0.0)) <= F.col("_want"))
    return under.select(*t.columns).unionByName(edge.select(*t.columns))
