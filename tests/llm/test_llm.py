"""The training-data operators against brute force on small tables, with the hard cases: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import clusters, cuts, group_splits, leaks, mixing, neighbours, quantiles, sentences, subset
from lumenframe.llm import vectors as V

DIM = 16
VEC = "image_index bigint, embedding array<float>, id string, head string"


def vec_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows], VEC)


@pytest.fixture(scope="module")
def cloud():
    """Two crowds, a small group, near copies, exact copies, and loners."""
    rng = np.random.default_rng(4)

    def around(c, n, s):
        return c + rng.normal(0, s, (n, DIM))

    a, b, c = rng.normal(size=(3, DIM))
    a, b, c = (v / np.linalg.norm(v) for v in (a, b, c))
    x = np.concatenate([around(a, 150, 0.08), around(b, 90, 0.08), around(c, 9, 0.05), rng.normal(size=(60, DIM))])
    x = np.concatenate([x, x[:6] + rng.normal(0, 1e-3, (6, DIM)), x[[5, 5, 5]]]).astype(np.float32)
    return np.arange(len(x)) * 3, x


def rows_of(cloud):
    ids, x = cloud
    rows = [(int(i), v) for i, v in zip(ids, x)]
    rows += rows[:20]  # repeats
    rows += [(90001, None), (90002, [1.0] * (DIM - 1)), (90003, [0.0] * DIM), (90004, [float("nan")] * DIM), (90005, [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]
    return rows


def sims(x):
    u = V.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s


def test_pack_is_lossless():
    x = np.array([[1.5, 0.25], [1 / 3, 2.0]], np.float32)
    import pyarrow as pa

    assert (V.unpack(pa.array(V.pack(x), pa.binary()), 2) == x).all()
    assert [len(b) for b in V.pack(x)] == [4, 8]


def test_close_pairs_match_brute_force(spark, cloud):
    ids, x = cloud
    s = sims(x)
    want = set()
    for i in range(len(x)):
        order = np.lexsort((ids, -s[i]))[:5]
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= 0.97}
    got = {(r[0], r[1]) for r in neighbours.close_pairs(vec_table(spark, rows_of(cloud)), "image_index", "embedding", dim=DIM, least=0.97, probes=8, slack=9).collect()}
    # exact copies tie: only pairs of equal similarity may differ
    assert len(want ^ got) <= 2


def test_a_third_of_exact_copies(spark, cloud):
    ids, x = cloud
    copied = np.concatenate([x, np.repeat(x[:1], 150, 0), np.zeros((20, DIM), np.float32)])
    every = np.concatenate([ids, 10_000 + np.arange(170)])
    t = vec_table(spark, [(int(i), v) for i, v in zip(every, copied)] + [(10_003, copied[len(ids)])])
    got = collections.defaultdict(dict)
    for r in neighbours.nearest_neighbours(t, "image_index", "embedding", k=5, dim=DIM, probes=30).collect():
        got[r["query"]][r["neighbour"]] = r["similarity"]
    s = sims(copied[:-20])
    ok = every[:-20]
    for i in (0, len(ids), len(ids) + 100, 40, 200):
        want = np.sort(s[i])[::-1][:5]
        assert np.allclose(sorted(got[int(ok[i])].values(), reverse=True), want, atol=1e-9)
    assert all(set(v) <= {0, *range(10_000, 10_006)} for q, v in got.items() if 10_006 <= q < 10_150)
    assert not any(10_150 <= q for q in got) and len(got) == len(ok)


def test_neighbour_recall(spark, cloud):
    ids, x = cloud
    t = vec_table(spark, rows_of(cloud))
    s = sims(x)
    got = collections.defaultdict(set)
    for r in neighbours.search_queries(t, t.where("image_index % 2 = 0"), "image_index", "embedding", k=5, dim=DIM).collect():
        got[r["query"]].add(r["neighbour"])
    hit = [len(got[int(ids[i])] & {int(ids[j]) for j in np.lexsort((ids, -s[i]))[:5]}) / 5 for i in range(len(x)) if ids[i] % 2 == 0]
    assert np.mean(hit) >= 0.95
    every = collections.defaultdict(set)
    for r in neighbours.nearest_neighbours(t, "image_index", "embedding", k=5, dim=DIM, probes=30).collect():
        every[r["query"]].add(r["neighbour"])
    assert np.mean([len(every[int(ids[i])] & {int(ids[j]) for j in np.lexsort((ids, -s[i]))[:5]}) / 5 for i in range(len(x))]) >= 0.95


def components(x, ids, link):
    s, p = sims(x), list(range(len(x)))

    def root(a):
        while p[a] != a:
            a = p[a]
        return a

    for i, j in zip(*np.nonzero(s >= link)):
        a, b = root(i), root(j)
        if a != b:
            p[max(a, b)] = min(a, b)
    g = collections.defaultdict(list)
    for i in range(len(x)):
        g[root(i)].append(int(ids[i]))
    return {i: min(m) for m in g.values() for i in m}, {min(m): len(m) for m in g.values()}


def test_clusters_match_chains(spark, cloud):
    ids, x = cloud
    heads, sizes = components(x, ids, 0.75)
    got = clusters.linked_clusters(vec_table(spark, rows_of(cloud)), "image_index", "embedding", dim=DIM, link=0.75, probes=12).collect()
    assert {r["id"]: r["head"] for r in got} == heads
    assert {r["head"]: r["size"] for r in got} == sizes


@pytest.mark.parametrize("block", [4_096, 1])
def test_clusters_joined_by_tied_rows_only(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block, raising=False)
    rng = np.random.default_rng(8)
    x = []
    for gap in (105, 117):  # the second chain breaks at its middle step of 47 degrees
        p, q = np.linalg.qr(rng.normal(size=(DIM, 2)))[0].T
        at = np.radians([*[0] * 20, *[gap] * 15, 35, gap - 35])
        x.append(np.cos(at)[:, None] * p + np.sin(at)[:, None] * q + rng.normal(0, 1e-3, (len(at), DIM)))
    x = np.concatenate(x).astype(np.float32)
    ids = np.arange(len(x))
    heads, sizes = components(x, ids, 0.75)
    assert sorted(sizes.values()) == [16, 21, 37]
    t = vec_table(spark, [(int(i), v) for i, v in zip(ids, x)])
    got = clusters.linked_clusters(t, "image_index", "embedding", dim=DIM, link=0.75).collect()
    assert {r["id"]: r["head"] for r in got} == heads


def test_describe(spark, cloud):
    t = vec_table(spark, rows_of(cloud))
    c = clusters.linked_clusters(t, "image_index", "embedding", dim=DIM, probes=12, least_size=8)
    d = clusters.describe(t, c, "image_index", "embedding", dim=DIM).collect()
    assert {r["rank"] for r in d} == {1, 2, 3}
    assert all(r["similarity"] > 0.7 for r in d)


def test_ward_joins_near_leaves():
    c = np.array([[1, 0], [0.99, 0.14], [0, 1]], float)
    lab = clusters.ward(np.array([5, 3, 4]), c, 0.75)
    assert lab[0] == lab[1] != lab[2]


def test_subset_is_varied_and_exact_in_size(spark, cloud):
    t = vec_table(spark, rows_of(cloud))
    got = [r["image_index"] for r in subset.varied_subset(t, "image_index", "embedding", 40, dim=DIM).collect()]
    assert len(got) == len(set(got)) == 40
    assert got.__len__() and sorted(got) == sorted(r["image_index"] for r in subset.varied_subset(t, "image_index", "embedding", 40, dim=DIM).collect())
    crowd = set((np.arange(150) * 3).tolist())
    assert len(crowd & set(got)) < 0.35 * 40  # half of the rows
    assert subset.varied_subset(t, "image_index", "embedding", 10_000, dim=DIM).count() == len(cloud[0])
    dens = {r["id"]: r["density"] for r in subset.densities(t, "image_index", "embedding", dim=DIM).collect()}
    assert np.mean([dens[i] for i in crowd]) > 3 * np.mean([dens[int(i)] for i in cloud[0][260:300]])


def test_empty_vectors(spark):
    t = vec_table(spark, [])
    assert neighbours.close_pairs(t, "image_index", "embedding", dim=DIM).count() == 0
    assert neighbours.search_queries(t, t, "image_index", "embedding", dim=DIM).count() == 0
    assert clusters.linked_clusters(t, "image_index", "embedding", dim=DIM).count() == 0
    assert subset.varied_subset(t, "image_index", "embedding", 5, dim=DIM).count() == 0


# --- splits ---------------------------------------------------------------------------------------------------------

LABELS = [(1, "A | x", "1"), (1, "A | x", "1"), (2, "a|X", " 01 "), (3, "b", "1.0"), (4, "b", "2"), (5, "c", "nan"), (6, "C", None), (7, "unknown", "N/A"), (8, "", "9.999999e+99"), (9, "d", "1e1"), (10, "e", "10"), (None, "e", "2"), (11, None, "x7")]


def test_whole_numbers(spark):
    t = spark.createDataFrame([("1",), (" +1",), ("001",), ("1.0",), ("1.000000e+00",), ("1e1",), ("1.5",), ("nan",), ("",), (None,), ("9.999999e+99",), ("-0",)], "x string")
    got = [r[0] for r in t.select(group_splits.whole_number(F.col("x"))).collect()]
    assert got == ["1", "1", "1", "1", "1", "10", None, None, None, None, None, "0"]


def test_tied_batches(spark):
    t = spark.createDataFrame(LABELS, "image_index bigint, labels string, batch_id string").withColumn("key", F.lit(1)).withColumn("group", F.lit(2))
    got = {r["image_index"]: r["group_batch"] for r in group_splits.tied_batches(t).collect()}
    # batches 1 and 2 meet by label b; a row without an id is no record and ties nothing
    assert got == dict.fromkeys((1, 2, 3, 4), 1)


def test_splits_keep_groups_and_meet_shares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"l{int(g)}", None) for i, g in enumerate(np.minimum(rng.zipf(1.6, 3000), 400))]
    t = spark.createDataFrame(rows, "image_index bigint, labels string, batch_id string")
    g = group_splits.batch_groups(t)
    s = group_splits.assign_splits(g, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    assert len(s) == 3000
    of = collections.defaultdict(set)
    for r in s:
        of[r["group"]].add(r["split_name"])
    assert all(len(v) == 1 for v in of.values())
    n = collections.Counter(r["split_name"] for r in s)
    biggest = max(collections.Counter(r["group"] for r in s).values())
    assert abs(n["test"] - 300) <= max(3, biggest - 2400) and abs(n["train"] - 2400) <= max(5, biggest - 2400)
    empty = group_splits.assign_splits(group_splits.batch_groups(t.limit(0)), [("train", 1.0)])
    assert empty.count() == 0


def test_quotas_meet_shares_and_profiles():
    import pandas as pd

    rng = np.random.default_rng(7)
    share = [0.8, 0.1, 0.1]
    for trial in range(12):
        b = pd.DataFrame({"size": rng.zipf(1.5, 300).clip(1, 900), "profile": rng.integers(-3, 4, 300)}).groupby(["size", "profile"]).size().reset_index(name="n")
        if trial % 3 == 0:  # one group of a third of all rows
            b.loc[len(b)] = [int((b["size"] * b["n"]).sum() // 2), 0, 1]
        q = group_splits.split_quotas(b, share)
        assert (q.sum(1) == b["n"]).all() and (q >= 0).all()
        rows = q * b["size"].to_numpy()[:, None]
        all_ = rows.sum()
        assert np.abs(rows.sum(0) - all_ * np.array(share)).max() <= 0.01 * all_
        # profiles follow the shares as far as their own group sizes allow
        for p in np.unique(b["profile"]):
            mine = (b["profile"] == p).to_numpy()
            if b["size"][mine].max() < 0.05 * rows[mine].sum():
                assert np.abs(rows[mine].sum(0) / rows[mine].sum() - share).max() < 0.06
    # without profiles the answer is another one: they take part
    q2 = group_splits.split_quotas(b.assign(profile=0), share)
    assert (q2 != q).any()


def test_flow_costs_least():
    f = group_splits._Flow(4)
    a, b = f.edge(0, 1, 5, 1.0), f.edge(0, 2, 5, 3.0)
    f.edge(1, 3, 3, 0.0), f.edge(1, 2, 5, 1.0), f.edge(2, 3, 4, 0.0)
    f.run(0, 3)
    assert f.cap[a ^ 1] == 5 and f.cap[b ^ 1] == 2


# --- percentiles ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 4096, 50_000])
def test_sketch_error_is_bounded(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(0, 2, n), 2)
    parts = np.array_split(x, 7)
    total = quantiles.Sketch()
    for p in parts:
        s = quantiles.Sketch()
        for c in np.array_split(p, 3):
            s.add(c)
        row = s.row()
        total.merge(quantiles.Sketch.load(*row))
    v, w = total.parts()
    assert total.n == n and w.sum() == n
    o = np.argsort(v)
    cum, y = np.cumsum(w[o]), np.sort(x)
    for p in (1, 25, 50, 75, 99):
        r = max(1, math.ceil(p / 100 * n))
        got = v[o][np.searchsorted(cum, r)]
        lo, hi = np.searchsorted(y, got, "left") + 1, np.searchsorted(y, got, "right")
        assert max(lo - r, r - hi, 0) <= total.bound()
    assert total.bound() <= 0.03 * n
    assert n > 4096 or total.bound() == 0


def test_buffer_size_keeps_the_error_asked_for():
    rng = np.random.default_rng(8)
    for n, error in ((20_000, 0.02), (200_000, 0.01), (200_000, 0.002)):
        k = quantiles.buffer_size(error, n)
        total = quantiles.Sketch(k)
        for part in np.array_split(rng.normal(size=n), 37):
            s = quantiles.Sketch(k)
            s.add(part)
            total.merge(quantiles.Sketch.load(*s.row(), k))
        assert total.n == n and total.bound() <= error * n


@pytest.mark.parametrize("fan_in", [64, 2])
def test_sketches_of_a_hot_group_merge_by_a_tree(spark, monkeypatch, fan_in):
    monkeypatch.setattr(quantiles, "FAN_IN", fan_in)
    t = spark.range(30_000, numPartitions=9).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("x"))
    r = {x["g"]: x for x in quantiles.percentiles(quantiles.sketch_by_group(t, ["g"], ["x"], 64, 4), ["g"], [50], 64, 4).collect()}
    x = np.sort([v["x"] for v in t.where("g = 'hot'").collect()])
    assert r["hot"]["n"] == 20_000 and abs(np.searchsorted(x, r["hot"]["value"]) - 10_000) <= r["hot"]["rank_error"] + 1


def test_percentiles_by_group(spark):
    rows = [("a", 1, float(i % 97), None) for i in range(500)] + [("a", 2, float("nan"), 1.0), ("b", 1, float("inf"), 2.0), (None, 1, 3.0, 1e300)]
    t = spark.createDataFrame(rows, "compound string, run_day int, area double, perimeter double").withColumn("n", F.lit(1)).withColumn("err", F.lit(2))
    sk = quantiles.sketch_by_group(t, ["compound", "run_day"], ["area", "perimeter"])
    day = {(r["compound"], r["run_day"], r["property"]): r["n"] for r in sk.collect()}
    assert day == {("a", 1, "area"): 500, ("a", 2, "perimeter"): 1, ("b", 1, "perimeter"): 1, (None, 1, "area"): 1, (None, 1, "perimeter"): 1}
    q = quantiles.percentiles(quantiles.merge_sketches(sk.drop("run_day"), ["compound"]), ["compound"], [50])
    got = {(r["compound"], r["property"]): r["value"] for r in q.collect()}
    assert got["a", "area"] == sorted(i % 97 for i in range(500))[249] and got[None, "perimeter"] == 1e300
    assert quantiles.sketch_by_group(t.limit(0), ["compound"], ["area"]).count() == 0


def test_outlying_days_exact_check_agrees(spark):
    rng = np.random.default_rng(2)
    rows = [(c, d, float(v) * (4 if (c, d) == ("a", 3) else 1)) for c in "ab" for d in range(6) for v in rng.lognormal(0, 0.3, 60)]
    t = spark.createDataFrame(rows, "compound string, run_day int, area double")
    full = quantiles.outlying_days(quantiles.sketch_by_group(t, ["compound", "run_day"], ["area"]), "compound", "run_day", [25, 50, 75])
    want = {tuple(r) for r in full.where("sure").select("compound", "property", "run_day", "pct").collect()}
    assert want == {("a", "area", 3, p) for p in (25, 50, 75)}
    small = quantiles.outlying_days(quantiles.sketch_by_group(t, ["compound", "run_day"], ["area"], k=8, b=2), "compound", "run_day", [25, 50, 75])
    open_ = small.where("NOT sure").drop("sure")
    assert open_.count()
    exact = quantiles.decide_exactly(t, open_, "compound", "run_day", ["area"])
    got = {tuple(r) for r in small.where("sure").select("compound", "property", "run_day", "pct").collect()} | {tuple(r) for r in exact.collect()}
    assert got == want


# --- leaks ----------------------------------------------------------------------------------------------------------

ITEM = "Explain why plate nineteen with dukrios shows bright foci in many of these fields although moneleth alone shows only a few of them at dawn"
ZH = "设某药为七百九十三纳摩尔时使核缩小八百九十六成而另一药把信号抬到七百八十三点再将七百张切图分入八百组"


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (1, "Intro. " + ITEM.upper().replace(" ", "\n", 3)), (2, "x " + " ".join(w[2:18]) + " y"), (3, " ".join(w[2:15])), (4, " ".join(w[:8] + ["zzz"] + w[9:20])),
        (5, " ".join(w[i] if i % 4 else "no" for i in range(24))), (6, None), (7, ""), (8, "<b>" + " ".join(f"**{x}**" for x in w[:16]) + "</b>"), (9, "alt­hough " + " ".join(w[:9]) + " dukri-\nos " + " ".join(w[9:18])),
        (10, ("filler words here " * 5000) + ITEM + (" more filler" * 5000)), (11, "前文" + ZH[3:36] + "后文"), (12, ZH[3:29]), (None, ITEM), (1, ITEM), (13, "１" + " ".join(w[:16]).replace("foci", "ｆｏｃｉ")),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    items = spark.createDataFrame([(1, ITEM), (2, ZH), (3, None), (4, "short"), (1, ITEM)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, items).collect()}
    assert got == {(i, 1) for i in (1, 2, 4, 8, 9, 10, 13)} | {(11, 2)}
    assert leaks.leaked(d.limit(0), items).count() == 0 and leaks.leaked(d, items.limit(0)).count() == 0


def test_leaks_spread_edits_in_characters(spark):
    least = {n: min(m - n + 1 - m // leaks.EDIT * n for m in range(low, 20 * low)) for n, low in ((leaks.SEED_WORDS, leaks.WORDS), (leaks.SEED_CHARS, leaks.CHARS))}
    assert least == {leaks.SEED_WORDS: 2, leaks.SEED_CHARS: 3}
    zh = "".join(chr(0x4E00 + 7 * i) for i in range(32))
    edited = ["".join("亂" if i in at else c for i, c in enumerate(zh)) for at in ((5, 11, 17, 23), (5, 11, 17, 23, 29))]
    d = spark.createDataFrame(list(enumerate(edited)), "doc_id bigint, text string")
    got = leaks.leaked(d, spark.createDataFrame([(1, zh)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["stretch"], r["edits"]) for r in got] == [(0, 32, 4)]


def brute_leak(item, doc, least):
    """Whether some stretch of the item lies within an eighth of its length in edits of some part of the document."""
    for i in range(len(item)):
        row = np.zeros(len(doc) + 1, int)
        for n, w in enumerate(item[i:], 1):
            new = np.full_like(row, n)
            for j in range(1, len(doc) + 1):
                new[j] = min(row[j - 1] + (doc[j - 1] != w), row[j] + 1, new[j - 1] + 1)
            row = new
            if n >= least and row.min() * 8 <= n:
                return True
    return False


@pytest.mark.parametrize("piece", [400, 20])
def test_leaks_against_brute_force(spark, monkeypatch, piece):
    """Seeds, parts, join and alignment together, with edits, repeated phrases, copies of a whole item many times over, and
    items that share words."""
    monkeypatch.setattr(leaks, "PIECE", piece)
    rng = np.random.default_rng(12)
    pool = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(40)]
    han = [chr(0x4E00 + 11 * i) for i in range(60)]
    items, docs = [], []
    for k in range(8):
        v, least = (han, 30) if k % 4 == 3 else (pool, 16)
        t = [v[i] for i in rng.integers(0, len(v), least + 14)]
        items.append((k, least, t + t[:8] if k % 3 == 0 else t))
    for d in range(70):
        _, least, t = items[rng.integers(len(items))]
        v = han if least == 30 else pool
        a = rng.integers(0, 12)
        s = t[a : a + rng.integers(least - 4, least + 6)]
        for _ in range(rng.integers(0, 6)):
            i = rng.integers(0, len(s))
            s[i : i + 1] = [["zz"] if v is pool else ["乱"], [], [s[i], v[0]]][rng.integers(3)]
        docs.append((d, [v[i] for i in rng.integers(0, len(v), 50)] + s + [v[i] for i in rng.integers(0, len(v), 30)]))
    docs.append((99, items[1][2] * 30))
    say = lambda t: ("" if ord(t[0][0]) > 0x4000 else " ").join(t)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(spark.createDataFrame([(d, say(t)) for d, t in docs], "doc_id bigint, text string"), spark.createDataFrame([(k, say(t)) for k, _, t in items], "item_id bigint, text string")).collect()}
    want = {(d, k) for d, t in docs if d != 99 for k, least, it in items if (ord(t[0][0]) > 0x4000) == (least == 30) and brute_leak(it, t, least)}
    assert {x for x in got if x[0] != 99} == want and (99, 1) in got and len(want) > 20


def test_seed_filter_passes_every_seed(spark):
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    f = leaks.seed_filter(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "seed bigint"))
    assert f(h).all() and f(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.01
    assert not leaks.seed_filter(spark.createDataFrame([], "seed bigint"))(h).any()


def test_alignment_against_edit_distance():
    rng = np.random.default_rng(0)

    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(16, 36))
        a = rng.integers(0, len(item) - 12)
        s = list(item[a : a + rng.integers(12, 30)])
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(s))
            s[k : k + 1] = [[99], [], [s[k], 98]][rng.integers(3)]
        doc = np.array([77, *s, 78])
        assert (leaks.align(item, doc, 16)[0] > 0) == brute_leak(item, doc, 16)


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    docs = [(i, "alpha beta gamma " * (1 + i % 3), "big") for i in range(300)] + [(1000 + i, "delta words", "small") for i in range(40)] + [(2000 + i, t, None) for i, t in enumerate(["delta words", "...", "", " \n ", "😀😀", None])] + [(3000, None, "big"), (3001, "", "small"), (3002, "x", "  "), (3003, "other text", "unlisted")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("rate", F.lit(1)).withColumn("tokens", F.lit("t"))
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.5, 1)], "source string, token_share double, max_repeats int")
    plan, report = mixing.mix(d, t)
    r = {x["source"]: x for x in report.collect()}
    total = d.where("trim(source) <> ''").select("doc_id", "text").collect()
    n = sum(mixing.n_tokens([x["text"] for x in total], mixing.TOKENIZER))
    assert abs(r["big"]["need"] - 0.6 * n) < 1e-6
    assert r["none"]["passes"] == 2 and r["none"]["tokens"] == 0 and r["none"]["short"]
    assert r["small"]["passes"] == min(4, math.ceil(0.3 * n / r["small"]["tokens"])) and r["big"]["passes"] == 1 and not r["big"]["short"]
    p = plan.collect()
    assert max(x["copies"] for x in p if x["source"] == "big") == 1 and max(x["copies"] for x in p if x["source"] == "small") <= 4
    assert abs(r["big"]["drawn"] - r["big"]["need"]) <= 13 and {x["source"] for x in p} == {"big", "small"}
    soft = mixing.mix(d, t, soft=True)[1].collect()
    assert len(soft) == 3 and abs(sum(x["actual_share"] for x in soft) - 1) < 1e-5
    assert mixing.mix(d.limit(0), t)[1].where("tokens > 0").count() == 0
    assert mixing.mix(d, t.limit(0))[0].count() == 0
    # repeated and null ids: every row is drawn by itself, none twice
    again = d.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 50))
    q = {x["source"]: x for x in mixing.mix(again, t)[1].collect()}
    assert all(abs(q[s]["drawn"] - r[s]["drawn"]) <= 13 for s in ("big", "small"))
    best = {x["source"]: x for x in mixing.mix(d, t, total="reachable")[1].collect()}
    assert abs(best["small"]["drawn"] - 4 * best["small"]["tokens"]) <= 8 and abs(best["big"]["actual_share"] - 2 / 3) < 0.02


def test_soft_mixing_draws_each_document_once(spark):
    big, small = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = [(i, big, "big") for i in range(300)] + [(1000 + i, small, "small") for i in range(60)] + [(2000 + i, small, None) for i in range(20)] + [(3000 + i, big, "  ") for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 25)], "source string, token_share double, max_repeats int")
    m = {r["doc_id"]: max(r["member"]) for r in mixing.members(d, ["big", "small"]).collect()}
    assert min(m.values()) >= 0.975
    plan, report = mixing.mix(d, t, soft=True)
    p = plan.collect()
    assert len({r["doc_id"] for r in p}) == len(p)
    kind = {i: "big" if text == big else "small" for i, text, _ in docs}
    assert max(r["copies"] for r in p if kind[r["doc_id"]] == "big") <= 1 and max(r["copies"] for r in p if kind[r["doc_id"]] == "small") <= 25
    rep = {r["source"]: r for r in report.collect()}
    for s, r in rep.items():
        assert abs(sum(x["tokens"] * x["copies"] for x in p if kind[x["doc_id"]] == s) / r["need"] - 1) < 0.03
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-5


def test_cases_of_own_documents_come_from_the_whole_method(spark, tmp_path, monkeypatch):
    """Documents without a source are classified and drawn; the cases are still those of the sources' own documents."""
    from lumenframe.llm import queries

    big, small = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = [(i, big, "big") for i in range(300)] + [(1000 + i, small, "small") for i in range(60)] + [(2000 + i, small, None) for i in range(100)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 25)], "source string, token_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    fitted, reports = [], []
    fit, mix = mixing.fit_domains, mixing.mix
    monkeypatch.setattr(mixing, "fit_domains", lambda *a, **k: fitted.append(1) or fit(*a, **k))
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: reports.append(mix(*a, **k)) or reports[-1])
    assert [tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()] == [("small", 3)] and fitted
    plan, report = reports[0]
    r = {x["source"]: x for x in report.collect()}["small"]
    assert not r["short"] and r["passes"] == 1 and r["alone_short"] and r["alone_passes"] == 3
    assert plan.where("source IS NULL").count() > 0


def test_gradient_reaches_targets(spark):
    c = spark.createDataFrame([([1.0, 0.0], 100), ([0.0, 1.0], 50), ([0.3, 0.7], 80)], "member array<double>, tokens bigint")
    need, cap, have = np.array([60.0, 90.0]), np.array([1.0, 2.0]), np.array([124.0, 106.0])
    steps, total = mixing.fit_rates(c, need, have, cap)
    assert np.allclose(total, need, atol=0.5)
    r = mixing.rates(np.array([[1, 0], [0, 1], [0.3, 0.7]]), cap, steps)
    assert (r >= 0).all() and (r <= [1, 2, 2]).all()
    # what cannot be met is met as far as the cap allows
    assert np.allclose(mixing.fit_rates(c.where("tokens = 50"), need, np.array([1e-9, 50]), cap)[1], [0, 90])


@pytest.mark.parametrize("ranked", [20_000, 3])
def test_lowest_rows_by_weight(spark, monkeypatch, ranked):
    monkeypatch.setattr(cuts, "RANKED", ranked)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), float(v), int(w)) for i, (v, w) in enumerate(zip(rng.exponential(size=900) ** 4, rng.integers(0, 9, 900)))] + [(1000 + i, 5, 1.0, 2) for i in range(50)]
    t = spark.createDataFrame(rows, "id bigint, g int, x double, w bigint")
    got = collections.defaultdict(set)
    for r in cuts.lowest(t, {0: 100.0, 1: 1e9, 2: 0.0, 5: 21.0}, "x", "id", "w", "g").collect():
        got[r["g"]].add(r["id"])
    for g, want in ((0, 100), (1, 1e9), (5, 21)):
        mine, run, take = sorted((x, i, w) for i, k, x, w in rows if k == g), 0, set()
        for _, i, w in mine:
            run += w
            if run > want:
                break
            take.add(i)
        assert got[g] == take
    n = cuts.lowest(t.where("g < 5"), {0: 37}, "x", "id")
    assert {r["id"] for r in n.collect()} == {i for _, i in sorted((x, i) for i, g, x, _ in rows if g < 5)[:37]}


# --- sentences ------------------------------------------------------------------------------------------------------

PARTS = {
    "en": ["The plate was read at 3.5 h.", "Fig. 12 shows halos, e.g. in B04.", 'The card says: "Spin it. Wait!"', "Dr. Lee left (see p. 4).", "Is it stable?", "Stop the pump!", "We saw approx. 30 foci.", "Nobody moved the rack.", "Wells were empty, i.e. blank."],
    "zh": ["细胞系放置了九分钟。", "快停泵！", "“他在哪里？”早班的人问道。", "面积降到了三点。", "它会分解吗？"],
    "th": ["กล้องเสียโฟกัสสองครั้ง", "โปรดถ่ายภาพซ้ำในคืนนี้", "อุณหภูมิอยู่ที่ 33.1 องศา", "หลุม B10 ว่างเปล่า", "สารสลายตัวหรือไม่"],
}


@pytest.fixture(scope="module")
def notes():
    """Texts joined from known units by blanks, line breaks and blank lines."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(900):
        lang = ("en", "en", "zh", "th")[i % 4]
        text, spans = "", []
        for k in range(rng.integers(1, 9)):
            u = PARTS[lang][rng.integers(len(PARTS[lang]))]
            if k:
                text += rng.choice([" ", "\n", "\n\n"], p=[0.7, 0.15, 0.15]) if lang != "zh" else rng.choice(["", "\n", "\n\n"], p=[0.7, 0.15, 0.15])
            spans.append((len(text), len(text) + len(u)))
            text += u
        out.append((i, text, spans))
    return out


def test_sentences(spark, notes):
    t = spark.createDataFrame([(i, x) for i, x, _ in notes] + [(5000, None), (5001, ""), (5002, " \n\n "), (5003, "A heading\n\nno mark " + "word " * 40_000)], "doc_id bigint, text string").withColumn("start_char", F.lit(1))
    got = collections.defaultdict(set)
    for r in sentences.split_sentences(t).collect():
        got[r[0]].add((r[1], r[2]))
    want = {(i, *s) for i, _, sp in notes for s in sp}
    have = {(i, *s) for i, sp in got.items() if i < 5000 for s in sp}
    assert len(want & have) / len(want) > 0.97 and len(want & have) / len(have) > 0.97
    assert not {5000, 5001, 5002} & set(got)
    assert (0, 9) in got[5003] and len(got[5003]) == 2
    assert sentences.split_sentences(t.limit(0)).count() == 0


def test_sentences_without_blank_after_the_mark():
    def weights(z):
        w = np.zeros(sentences.WIDTH)
        w[[zlib.crc32(f"{c}1".encode()) % sentences.WIDTH for c in sentences.SCRIPTS]] = z
        return w

    sure, doubtful = weights(6), weights(4)  # on either side of JOINED
    for left, right in (("It held 2.55 mg/mL.", "The vial grew."), ("It was 0.66 µM.", "Plates grew."), ("It has 12 of 40.", "Cells grew."), ("Near the lamp (C4).", "Cells grew."), ("نمت الخلايا قرب المصباح.", "استراحت في الوعاء.")):
        cut = [(0, len(left)), (len(left), len(left + right))]
        assert sentences.units(left + right, sure) == cut
        assert sentences.units(left + right, doubtful) == [(0, len(left + right))]
        assert len(sentences.units(left + " " + right, doubtful)) == 2
    assert len(sentences.units("It held 2.55 of 13.62 there.", sure)) == 1


def test_sentences_of_one_long_paragraph():
    """Memory follows the length: no copies of what stands to the left and right of a mark."""
    import tracemalloc

    w = np.zeros(sentences.WIDTH)
    p = 'Wort eins. Noch 3.5 eins? "Zitat. Ja!" Ende (so. hier) da, '
    tracemalloc.start()
    got = sentences.units(p * 20_000, w)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and len(got) > 20_000 and got[-1][1] == len((p * 20_000).rstrip())


def test_sentences_learn_from_whole_texts(spark):
    t = spark.createDataFrame([(1, "word " * 45_000 + "end.\n\nNext one.\n\n" * 50)], "doc_id bigint, text string")
    assert sentences.train(t).any()
