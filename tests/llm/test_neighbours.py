"""Nearest neighbours against all pairs; recall and work by the pruning factor."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartomill.llm import neighbours
from cartomill.llm.neighbours import Tree, nearest, search, summed, units

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every=50, k=5):
    good = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, dtype=np.float32).astype(np.float64)))
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        near = [(-float(summed(v * w) / np.sqrt(summed(v * v) * summed(w * w))), j is None, j) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v)]
        near.sort(key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(near[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n=600, dim=8, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    points = centres[rng.integers(0, groups, n)] + 0.1 * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in p.astype(np.float32)]) for i, p in enumerate(points)]


@pytest.fixture(params=["one shard", "many shards"])
def sizes(request, monkeypatch):
    if request.param == "many shards":
        monkeypatch.setattr(neighbours, "SHARD_BYTES", 4096)
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)


def test_exact_with_odd_rows(spark, sizes):
    rows = vectors(1)
    rows += [(i, rows[0][1]) for i in range(1000, 1300)]  # a common vector, also of queries
    rows += [(2000, [2 * x for x in rows[3][1]]), (2001, rows[3][1]), (2050, [-x for x in rows[3][1]])]  # ties, opposites
    rows += rows[50:52] + [rows[50]] + [(50, rows[7][1]), (None, rows[9][1]), (None, rows[50][1])]  # repeated rows and ids, no id
    rows += [(3000, None), (3050, []), (3100, [0.0] * 8), (3150, [None, *rows[4][1][1:]]), (3200, [math.nan] * 8), (3250, [math.inf, *rows[4][1][1:]]), (3300, [1.0, 2.0]), (3301, [2.0, 1.0]), (3350, [1.0, -2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("key", "vec", "dim", "n", "place", "near", "leaf", "home", "score", "members")})
    assert sorted(map(tuple, nearest(df, F.col("vec_id") % 50 == 0).collect()), key=repr) == plain(rows)


def test_empty_and_few(spark):
    every = F.col("vec_id") % 50 == 0
    assert nearest(spark.createDataFrame([], SCHEMA), every).collect() == []
    assert nearest(spark.createDataFrame([(50, [1.0, 2.0])], SCHEMA), every).collect() == []
    assert [tuple(r)[:3] for r in nearest(spark.createDataFrame([(50, [1.0, 2.0]), (7, [1.0, 0.0])], SCHEMA), every).collect()] == [(50, 1, 7)]


def test_large_doubles(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], round(r["score"], 12)) for r in got] == [(1, 1.0), (2, 0.0)]


def test_what_grows_with_the_queries_is_not_broadcast(spark, monkeypatch):
    plans, write = [], neighbours.written
    kept = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(neighbours, "written", lambda df, *a, **b: write(kept(df), *a, **b))
    kept(nearest(spark.createDataFrame(vectors(2), SCHEMA), F.col("vec_id") % 50 == 0))
    joins = [re.sub(r"#\d+L?", "", x) for plan in plans for x in re.findall(r"\w+Join \[.*", plan)]
    assert all(re.match(r"BroadcastHashJoin \[dim, leaf\], \[dim, leaf\], Inner, BuildRight|SortMergeJoin", x) for x in joins), joins
    assert sum(x.startswith("SortMergeJoin [dim, leaf], [dim, leaf]") for x in joins) == 2  # blocks of queries, and trees


def test_queries_share_blocks_and_tables_go(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 4096)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    tables, write = {}, neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name, **b: tables.setdefault(name, write(df, name, **b)))
    got = nearest(spark.createDataFrame(vectors(3), SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(n for n, df in tables.items() if not os.path.exists(df.written_at.removeprefix("file://"))) == ["classes", "placed", "vectors"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(vectors(3), every=10)
    trees = neighbours.upper_levels(tables["asked"].select("key", "dim", "vec"))
    lists = neighbours.blocks(tables["asked"].coalesce(1).withColumn("near", F.lit(0.3)), trees, 1.0).collect()
    assert all(1 <= len(r["asked"]) == len(r["vecs"]) == len(r["nears"]) == len(r["homes"]) <= 5 for r in lists)
    assert sorted(key for r in lists for key, home in zip(r["asked"], r["homes"]) if home) == sorted(r["key"] for r in tables["asked"].collect())


def test_factor_trades_recall_for_work(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.3 * rng.normal(size=(4000, 16))
    tree, order = Tree.built(units(points), 64)
    points, queries = points[order], points[::40].copy()
    work = {}
    found = {}
    for factor in (1.0, 1.5, 4.0):
        reached = tree.reached(units(queries), np.full(len(queries), 0.5), factor)
        work[factor] = len(reached[0])
        found[factor] = search(tree, points, np.arange(len(points)), queries, np.full(len(queries), np.inf), factor, 6)[1]
    unit = units(points)
    best = np.argsort(-(units(queries) @ unit.T), axis=1, kind="stable")[:, :6]
    recall = {f: np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, best)]) for f, got in found.items()}
    assert recall[1.0] == 1.0
    assert recall[1.5] >= 0.9 and work[1.5] < work[1.0]
    assert recall[4.0] <= recall[1.5] and work[4.0] < work[1.5]
