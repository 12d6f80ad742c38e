"""Percentiles from mergeable buffers.

A sketch keeps at most ``b`` sorted buffers of ``k`` values. When there are more, all buffers of the lowest level collapse
into one of their joint weight, by taking evenly spaced positions of the weighted merge. The worst rank error a collapse
can add is half its output weight; the sum is kept with the sketch, so every answer has a proven bound. Nothing is random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.runtime import partitions

K, B = 512, 8
FAN_IN = 64  # partitions whose sketches of a group are merged at a time


class Sketch:
    __slots__ = ("b", "bufs", "err", "k", "n", "raw", "raw_n")

    def __init__(self, k: int = K, b: int = B):
        self.k, self.b, self.n, self.err, self.bufs, self.raw, self.raw_n = k, b, 0, 0.0, [], [], 0  # bufs: (level, weight, values)

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.raw.append(x)
        self.raw_n += len(x)
        if self.raw_n > self.k * self.b:
            self._settle()

    def _settle(self) -> None:
        """Full raw buffers become level 0; the rest, under k values, stays raw at weight 1."""
        x = np.sort(np.concatenate(self.raw)) if self.raw else np.empty(0)
        full = len(x) // self.k
        if full:
            # a strided deal keeps each level-0 buffer an even picture of the batch
            keep = x[: full * self.k]
            for i in range(full):
                self.bufs.append((0, 1, keep[i::full]))
                self._fit()
        self.raw, self.raw_n = [x[full * self.k :]], len(x) - full * self.k

    def _fit(self) -> None:
        while len(self.bufs) > self.b:
            self.bufs.sort(key=lambda t: t[0])
            low = self.bufs[0][0]
            m = sum(1 for t in self.bufs if t[0] == low)
            if m < 2:
                m = 1 + sum(1 for t in self.bufs if t[0] == self.bufs[1][0])
            take, self.bufs = self.bufs[:m], self.bufs[m:]
            self.bufs.append(self._collapse(take))

    def _collapse(self, take: list) -> tuple:
        values = np.concatenate([v for _, _, v in take])
        weights = np.concatenate([np.full(len(v), w, np.int64) for _, w, v in take])
        order = np.argsort(values, kind="stable")
        total = np.cumsum(weights[order])
        w_out = sum(w for _, w, _ in take)
        at = np.arange(len(take[0][2])) * w_out + (w_out + 1) // 2
        self.err += w_out / 2
        return (1 + max(t[0] for t in take), w_out, values[order][np.searchsorted(total, at)])

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.err += other.err
        self.bufs += other.bufs
        self._fit()
        self.raw += other.raw
        self.raw_n += other.raw_n
        if self.raw_n > self.k * self.b:
            self._settle()

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and their weights."""
        lists = [np.concatenate(self.raw) if self.raw else np.empty(0), *(v for _, _, v in self.bufs)]
        return np.concatenate(lists), np.concatenate([np.ones(len(lists[0]), np.int64), *(np.full(len(v), w, np.int64) for _, w, v in self.bufs)])

    def bound(self) -> float:
        """Proven rank error of any answer; 0 where nothing was collapsed."""
        return self.err + max(t[1] for t in self.bufs) / 2 if self.err else 0.0

    def row(self) -> tuple:
        raw = np.concatenate(self.raw) if self.raw else np.empty(0)
        return self.n, float(self.err), [0] + [t[0] for t in self.bufs], [0] + [int(t[1]) for t in self.bufs], [len(raw)] + [len(t[2]) for t in self.bufs], np.concatenate([raw, *(t[2] for t in self.bufs)])

    @staticmethod
    def load(n, err, levels, weights, lens, values, k: int = K, b: int = B) -> Sketch:
        s = Sketch(k, b)
        s.n, s.err, values, at = int(n), float(err), np.asarray(values, float), 0
        for level, w, m in zip(levels, weights, lens):
            v, at = values[at : at + m], at + m
            if w:
                s.bufs.append((int(level), int(w), v))
            else:
                s.raw, s.raw_n = [v], len(v)
        return s


FIELDS = [("n", "bigint"), ("err", "double"), ("levels", "array<int>"), ("weights", "array<bigint>"), ("lens", "array<int>"), ("values", "array<double>")]


def _schema(df: DataFrame, group_cols: list[str]) -> T.StructType:
    s = T.StructType([T.StructField(c, df.schema[c].dataType) for c in group_cols]).add("property", T.StringType())
    for n, t in FIELDS:
        s.add(n, T._parse_datatype_string(t))
    return s


def buffer_size(error: float, rows: int, b: int = B) -> int:
    """Buffer length (a power of 2) with which the bound of ``rows`` values stays under ``error`` times their number.

    A level holds rows / (b^level k) buffers' worth of weight once, so its collapses add at most rows / 2k; levels are as
    many as rows / k has digits to base b, and two to spare for sketches that are merged while they are not full.
    """
    k = 16
    while k < rows and (np.log(max(rows / k, 1)) / np.log(b) + 3) / (2 * k) > error:
        k *= 2
    return k


def sketch_by_group(df: DataFrame, group_cols: list[str], value_cols: list[str], k: int = K, b: int = B) -> DataFrame:
    """One sketch row per group and property: ``(*group_cols, property, n, err, levels, weights, lens, values)``.

    Nulls, NaN and infinities are not counted; groups with no finite value have no row; a null group value is a group.
    Rows are sketched where they are, and only sketches are shuffled, so a group with a third of all rows is no hot task.
    Sketches of any partitions or days combine with :func:`merge_sketches`. ``k`` for a wanted error: :func:`buffer_size`.
    """
    return merge_sketches(sketch_partitions(df.select(*group_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]), group_cols, value_cols, k, b), group_cols, k, b)


def sketch_partitions(df: DataFrame, group_cols: list[str], value_cols: list[str], k: int = K, b: int = B, chunk: int = 200_000) -> DataFrame:
    """Sketches of each group within each partition; memory is one chunk of rows and the sketches."""
    schema = _schema(df, group_cols)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Sketch] = {}
        keys_of: dict[tuple, tuple] = {}

        def eat(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return
            codes = np.zeros(t.num_rows, np.int64)
            firsts = []
            for c in group_cols:
                d = t.column(c).combine_chunks().dictionary_encode("encode")
                codes = codes * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary)))
                _, codes = np.unique(codes, return_inverse=True)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-1)) if len(order) else np.empty(0, int)
            ends = np.append(cuts[1:], len(order))
            firsts = t.select(group_cols).take(pa.array(order[cuts])).to_pylist()
            cols = [np.asarray(t.column(c).to_numpy(), float)[order] for c in value_cols]
            good = [np.isfinite(x) for x in cols]
            for first, lo, hi in zip(firsts, cuts, ends):
                key = tuple(first[c] for c in group_cols)
                for p, x, g in zip(value_cols, cols, good):
                    v = x[lo:hi][g[lo:hi]]
                    if len(v):
                        s = found.get((*key, p))
                        if s is None:
                            s = found[(*key, p)] = Sketch(k, b)
                            keys_of[(*key, p)] = key
                        s.add(v)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                eat(held)
                held, rows = [], 0
        if held:
            eat(held)
        out: list[tuple] = []
        for key, s in found.items():
            out.append((*key, *s.row()))
            if len(out) >= 2000:
                yield _batch(out, names, arrow)
                out = []
        if out:
            yield _batch(out, names, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(n).type) for i, n in enumerate(names)], schema=arrow)


def merge_sketches(sketches: DataFrame, group_cols: list[str], k: int = K, b: int = B) -> DataFrame:
    """Combine sketches that share ``group_cols`` and property: partitions of one table, or any set of days.

    By a tree: FAN_IN partitions' sketches of a group at a time, then what these leave, so that no task reads a group's
    sketches from all partitions of a large table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(sketches, group_cols)
    names = [f.name for f in schema]
    arrow = to_arrow_schema(schema)
    keys = [*group_cols, "property"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketches arrive sorted by group, so one merged sketch is held at a time."""
        now, total, out = None, None, []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in [*keys, "n", "err", "levels", "weights", "lens"]}
            values = batch.column("values")
            flat, off = np.asarray(values.flatten()), np.asarray(values.offsets)
            off = off - off[0]
            for i in range(batch.num_rows):
                key = tuple(cols[c][i] for c in keys)
                s = Sketch.load(cols["n"][i], cols["err"][i], cols["levels"][i], cols["weights"][i], cols["lens"][i], flat[off[i] : off[i + 1]], k, b)
                if key == now:
                    total.merge(s)
                else:
                    if total is not None:
                        out.append((*now, *total.row()))
                    now, total = key, s
            if len(out) >= 2000:
                yield _batch(out, names, arrow)
                out = []
        if total is not None:
            out.append((*now, *total.row()))
        if out:
            yield _batch(out, names, arrow)

    parts = partitions(sketches.sparkSession)
    s = sketches.select(*names)
    while (salts := -(-parts // FAN_IN)) > 1:
        near = s.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition(partitions(s.sparkSession), *keys, "_salt")
        s = near.sortWithinPartitions(*keys, "_salt", "n", "err").drop("_salt").mapInArrow(run, schema)
        parts = salts
    return s.repartition(partitions(s.sparkSession), *keys).sortWithinPartitions(*keys, "n", "err").mapInArrow(run, schema)


def percentiles(sketches: DataFrame, group_cols: list[str], pcts: list[int], k: int = K, b: int = B) -> DataFrame:
    """``(*group_cols, property, pct, n, value, rank_error)``: the smallest value of rank ``ceil(pct/100 n)`` or more.

    ``rank_error`` bounds the distance in ranks to the exact answer; 0 where nothing was collapsed.
    """
    kinds = {c: sketches.schema[c].dataType for c in group_cols}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in group_cols]).add("property", T.StringType()).add("pct", T.IntegerType()).add("n", T.LongType()).add("value", T.DoubleType()).add("rank_error", T.DoubleType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = Sketch.load(r.n, r.err, r.levels, r.weights, r.lens, r.values, k, b)
                v, w = s.parts()
                o = np.argsort(v, kind="stable")
                cum = np.cumsum(w[o])
                key = tuple(getattr(r, c) for c in group_cols)
                for p in pcts:
                    rank = max(1, -(-p * s.n // 100))
                    out.append((*key, r.property, p, s.n, float(v[o][min(np.searchsorted(cum, rank), len(v) - 1)]), s.bound()))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return sketches.mapInPandas(run, schema)


def _bounds(v: np.ndarray, cum: np.ndarray, n: int, p: float, err: float) -> tuple[float, float, float]:
    """The interpolated percentile of a weighted sorted list of n values, and values surely below and above it."""
    h = (n - 1) * p
    at = lambda rank: float(v[np.searchsorted(cum, min(max(rank, 1), n))])  # noqa: E731  rank counts from 1
    lo, hi = int(np.floor(h)) + 1, int(np.ceil(h)) + 1
    mid = at(lo) + (at(hi) - at(lo)) * (h - np.floor(h)) if lo != hi else at(lo)
    e = int(np.ceil(err))
    return mid, (mid if not e else -np.inf if lo - e < 1 else at(lo - e)), (mid if not e else np.inf if hi + e > n else at(hi + e))


def outlying_days(sketches: DataFrame, key: str, day: str, pcts: list[int], factor: float = 3.0, least: int = 30) -> DataFrame:
    """Days whose percentile differs from the same percentile over all other days of the key by more than ``factor``.

    ``sketches`` has one row per (key, day, property). Returns ``(key, property, day, pct, sure, d_lo, d_hi, o_lo, o_hi,
    n_day, n_rest)``: ``sure`` is true where the bounds decide it; undecided ones are for :func:`decide_exactly`.
    """
    schema = T.StructType([T.StructField(key, sketches.schema[key].dataType), T.StructField("property", T.StringType()), T.StructField(day, sketches.schema[day].dataType)])
    for n, t in (("pct", "int"), ("sure", "boolean"), ("d_lo", "double"), ("d_hi", "double"), ("o_lo", "double"), ("o_hi", "double"), ("n_day", "bigint"), ("n_rest", "bigint")):
        schema.add(n, T._parse_datatype_string(t))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Sketch.load(r.n, r.err, r.levels, r.weights, r.lens, r.values) for r in pdf.itertuples(index=False)]
        vw = [s.parts() for s in parts]
        v = np.concatenate([x for x, _ in vw])
        w = np.concatenate([x for _, x in vw])
        who = np.repeat(np.arange(len(parts)), [len(x) for x, _ in vw])
        o = np.argsort(v, kind="stable")
        v, w, who = v[o], w[o], who[o]
        n_all, err_all, out = sum(s.n for s in parts), sum(s.bound() for s in parts), []
        for i, (s, d) in enumerate(zip(parts, pdf[day])):
            own = who == i
            n_rest, cum, cum_rest = n_all - s.n, np.cumsum(w[own]), None
            if s.n < least or n_rest < least:
                continue
            rest = v[~own]
            cum_rest = np.cumsum(w[~own])
            for p in pcts:
                m, lo, hi = _bounds(v[own], cum, s.n, p / 100, s.bound())
                mo, lo_o, hi_o = _bounds(rest, cum_rest, n_rest, p / 100, err_all - s.bound())
                can = hi > factor * lo_o or lo < hi_o / factor
                must = lo > factor * hi_o or hi < lo_o / factor
                if must or can:
                    out.append((*k, d, p, bool(must), lo, hi, lo_o, hi_o, s.n, n_rest))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return sketches.groupBy(key, "property").applyInPandas(run, schema)


def decide_exactly(rows: DataFrame, open_cases: DataFrame, key: str, day: str, value_cols: list[str], factor: float = 3.0) -> DataFrame:
    """The open cases of :func:`outlying_days` that hold, by counting values below each bound and ranking those between.

    Equal values are counted together before they meet; a task ranks the distinct values between the bounds of a case,
    which are a share of its rows as small as the error of the sketches, and sorts them on disk where they are many.
    """
    long = rows.select(F.col(key), F.col(day).alias("_day"), F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("v")) for c in value_cols])).alias("x"))
    long = long.select(key, "_day", "x.property", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    j = long.join(F.broadcast(open_cases) if open_cases.count() <= 20_000 else open_cases, [key, "property"])

    def side(own: bool, lo: str, hi: str, n: str) -> DataFrame:
        """The interpolated percentile: the values of two ranks, from running counts over the values between the bounds."""
        s = j.where((F.col("_day") == F.col(day)) if own else (F.col("_day") != F.col(day)))
        ids = [key, "property", day, "pct"]
        # one pass: what is below the bounds is counted under no value, what lies between under its own
        v = F.when((F.col("v") >= F.col(lo)) & (F.col("v") <= F.col(hi)), F.col("v"))
        c = s.where(F.col("v") <= F.col(hi)).groupBy(*ids, n, v.alias("v")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*ids).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
        h = (F.col(n) - 1) * F.col("pct") / 100.0
        c = c.withColumn("upto", upto).where("v IS NOT NULL")
        at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
        c = c.groupBy(*ids, n).agg(at(F.floor(h) + 1).alias("a"), at(F.ceil(h) + 1).alias("c"))
        return c.select(*ids, (F.col("a") + (F.col("c") - F.col("a")) * (h - F.floor(h))).alias("d" if own else "o"))

    ids = [key, "property", day, "pct"]
    both = side(True, "d_lo", "d_hi", "n_day").join(side(False, "o_lo", "o_hi", "n_rest"), ids)
    return both.where((F.col("d") > factor * F.col("o")) | (F.col("d") < F.col("o") / factor)).select(*ids)
