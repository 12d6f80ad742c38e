"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.runtime import materialize, release


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars (node, smallest node) of the edges seen in one partition; memory follows its distinct nodes."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pd.DataFrame({"src": nodes, "dst": [root(x) for x in nodes]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; component is its smallest node.

    Null ends and self loops are ignored (a node with no other edge has no row), repeated edges count once, an empty
    table gives no rows. Any orderable node type serves. Each partition is first reduced to spanning stars; then large-
    and small-star rounds run until nothing changes, every round written to the shared folder. A hub's neighbours are
    only ever met through a pre-aggregated minimum and a join that adaptive execution may split.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    kind = e.schema["src"].dataType
    schema = f"src {kind.simpleString()}, dst {kind.simpleString()}"
    now = materialize(e.mapInPandas(local_forest, schema).distinct(), "forest")

    def stamp(t: DataFrame):
        r = t.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40)))).first()
        return r[0], r[1]

    mark = stamp(now)
    for _ in range(max_rounds):
        both = now.select("src", "dst").union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        # every edge now runs from the larger to the smaller end
        low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (
            large.join(low2, "src")
            .select(F.explode(F.array(F.struct(F.col("dst").alias("a"), F.col("m").alias("b")), F.struct(F.col("src").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select(F.col("x.a").alias("src"), F.col("x.b").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        nxt = materialize(small, "star")
        new = stamp(nxt)
        release(now)
        now = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
