"""Nearest neighbours by cosine: vantage-point trees, one for each shard, with pruning relaxed by a factor.

The angle between vectors is a metric, so a node of a tree (a vantage point, and the range of its points' angles to it on
either side of their median) rules a side out if the query's angle to the vantage point is outside that range by more than
the query's k-th best angle so far. With a factor over one, by more than that angle divided by the factor: fewer points
are seen and some neighbours missed. Factor one is exact.

Equal vectors are one class, with its least ids, before anything else, so a common vector is one point. The upper levels of
one more vantage-point tree, fitted on a bounded sample, deal the classes to at most LEAVES leaves; a leaf is split by hash
into shards of about SHARD_BYTES, and each shard's tree is built in a task and written. Queries go in blocks: first to one
shard of their own leaf, which bounds their k-th angle, then to all others that the upper levels do not rule out. A task
holds a shard and a block of queries. The scores returned are computed on the vectors themselves, in order, in double
precision; equal scores are ranked by id.

On the driver: the sample (SAMPLE_BYTES at most) and the upper levels, which also go to the tasks, and a count for each
leaf. Spark cannot know that a query comes out of a task once for each leaf it goes to, so the joins of what grows with the queries
say that they are by sorting: by its estimates Spark would take all queries of all leaves through the driver.

Edge cases: vectors that are null, zero or empty, or hold null or non-finite components, take no part, nor do queries that
hold such; vectors of different lengths are never near each other; repeated rows are candidates each, a query's own row
once not, and a repeated query row has its answer as often; a null vec_id is no query and comes last among ties; a query
with fewer candidates has them all; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forgotten, map_arrow, shuffles_collected, written

K = 5
#: Of the query's k-th best angle; one searches exactly.
FACTOR = 1.0
QUERIES_EVERY = 50
LEAVES = 256
SHARD_BYTES = 2 << 20
SAMPLE_BYTES = 8 << 20
QUERY_BLOCK = 512
#: Queries that a task deals to leaves, in blocks for each.
TASK_QUERIES = 4 * QUERY_BLOCK
#: Points at the end of a tree's branch.
BUCKET = 64
#: Beyond the rounding of angles.
SLACK = 1e-6
LAST = (1 << 63) - 1
_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added in order, so that a pair's score is the same wherever it is computed."""
    return np.cumsum(products, axis=-1)[..., -1]


def units(points: np.ndarray) -> np.ndarray:
    return points / np.sqrt((points**2).sum(axis=1, keepdims=True))


def vectors(rows: DataFrame) -> DataFrame:
    """key (128 bits of the vector's BLAKE2b), vec_id, dim, vec (its doubles, scaled by a power of two), of rows that take part."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            column = batch["embedding"]
            flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls are nan
            ends = np.cumsum(np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64))
            for i, (vec_id, b) in enumerate(zip(batch["vec_id"].to_pylist(), ends.tolist())):
                v = flat[ends[i - 1] if i else 0 : b] + 0.0  # no negative zeros
                if len(v) and np.isfinite(v).all() and v.any():
                    key = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                    out.append((key, vec_id, len(v), np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "vec_id", "dim", "vec"])

    return map_arrow(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), f, "key binary, vec_id long, dim int, vec binary")


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of a few points the one whose angles to the others differ most, and all angles to it."""
    some = points[rng.integers(0, len(points), 100)]
    tried = points[rng.integers(0, len(points), 4)]
    best = tried[angles(some @ tried.T).var(axis=0).argmax()]
    return best, angles(points @ best)


class Tree:
    """A balanced vantage-point tree in arrays: node i has children 2 i + 1 and 2 i + 2, of ranges[i] = (least and greatest
    angle left, then right); after the inner nodes come the buckets, points[starts[j] : starts[j + 1]]."""

    def __init__(self, vantage: np.ndarray, medians: np.ndarray, ranges: np.ndarray, starts: np.ndarray):
        self.vantage, self.medians, self.ranges, self.starts = vantage, medians, ranges, starts
        self.depth = len(starts).bit_length() - 1 if len(starts) > 1 else 0

    @classmethod
    def built(cls, unit: np.ndarray, buckets: int) -> tuple[Tree, np.ndarray]:
        """The tree of so many buckets (a power of two), and the points' order in it."""
        rng = np.random.default_rng(len(unit))
        inner, dim = buckets - 1, unit.shape[1]
        vantage, medians, ranges = np.zeros((inner, dim)), np.zeros(inner), np.zeros((inner, 4))
        members = {0: np.arange(len(unit))}
        for i in range(inner):
            rows = members.pop(i)
            vantage[i], far = split(unit[rows], rng)
            order = np.argsort(far, kind="stable")
            half = (len(rows) + 1) // 2
            left, right = order[:half], order[half:]
            medians[i] = far[left[-1]]
            ranges[i] = far[left[0]], far[left[-1]], far[right[0]], far[right[-1]]
            members[2 * i + 1], members[2 * i + 2] = rows[left], rows[right]
        parts = [members[inner + j] for j in range(buckets)]
        return cls(vantage, medians, ranges, np.cumsum([0, *map(len, parts)])), np.concatenate(parts)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each query, by the medians alone."""
        node = np.zeros(len(unit), dtype=np.int64)
        while len(self.medians) and node[0] < len(self.medians):
            far = angles((unit * self.vantage[node]).sum(axis=1))
            node = 2 * node + 1 + (far > self.medians[node])
        return node - len(self.medians)

    def reached(self, unit: np.ndarray, near: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, bucket and the bound of angles between them, for each pair that is not ruled out by near."""
        query, node, bound = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        while len(node) and node[0] < len(self.medians):
            far = angles((unit[query] * self.vantage[node]).sum(axis=1))
            r = self.ranges[node]
            sides = [np.maximum(bound, np.maximum(r[:, a] - far, far - r[:, a + 1])) for a in (0, 2)]
            query, node, bound = np.tile(query, 2), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate(sides)
            stays = factor * bound <= near[query] + SLACK
            query, node, bound = query[stays], node[stays], bound[stays]
        return query, node - len(self.medians), bound


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, near: np.ndarray, factor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best scores, and their points' places (-1: none), among points in the tree's order; equal scores by ids."""
    unit, asked = units(points), units(queries)
    norms, lengths = summed(points**2), summed(queries**2)
    scores, places = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    near = near.copy()

    def seen(bucket: int, rows: np.ndarray) -> None:
        a, b = tree.starts[bucket], tree.starts[bucket + 1]
        close = asked[rows] @ unit[a:b].T >= np.maximum(np.cos(np.minimum(near[rows], np.pi)), scores[rows, -1])[:, None] - SLACK
        hit = close.any(axis=1)
        rows, close = rows[hit], close[hit]
        if not len(rows):
            return
        i, j = np.nonzero(close)
        new = np.full(close.shape, -np.inf)
        new[i, j] = summed(queries[rows[i]] * points[a + j]) / np.sqrt(lengths[rows[i]] * norms[a + j])
        both = np.concatenate([scores[rows], new], axis=1)
        at = np.concatenate([places[rows], np.where(close, np.arange(a, b), -1)], axis=1)
        order = np.lexsort((np.where(at < 0, LAST, ids[at]), -both), axis=-1)[:, :k]
        scores[rows], places[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)
        near[rows] = np.minimum(near[rows], np.where(np.isfinite(scores[rows, -1]), angles(scores[rows, -1]), np.inf))

    def each(query: np.ndarray, bucket: np.ndarray, bound: np.ndarray | None = None) -> None:
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                rows = query[part]
                seen(int(bucket[part[0]]), rows if bound is None else rows[factor * bound[part] <= near[rows] + SLACK])

    homes = tree.homes(asked)
    each(np.arange(len(queries)), homes)
    query, bucket, bound = tree.reached(asked, near, factor)
    rest = bucket != homes[query]
    each(query[rest], bucket[rest], bound[rest])
    return scores, places


def doubles(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def upper_levels(classes: DataFrame) -> dict[int, Tree]:
    """For each length of vectors that the sample holds enough of, the tree that deals them to leaves."""
    widest, n = classes.agg(F.max("dim"), F.count("*")).first()
    if not n:
        return {}
    most = max(64, SAMPLE_BYTES // (8 * widest))
    # keys are hashes, so those under a bound are a sample, of about nine tenths of what is allowed
    share = 1.0 if n <= most else 0.9 * most / n
    by_dim: dict[int, list[bytes]] = {}
    for r in classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40))).select("dim", "vec").toLocalIterator():
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    trees = {}
    for dim, found in by_dim.items():
        expected = len(found) / share * 8 * dim / SHARD_BYTES
        leaves = 1 << max(0, min(LEAVES, len(found) // 32, int(expected)).bit_length() - 1)
        if leaves > 1:
            tree, _ = Tree.built(units(np.frombuffer(b"".join(found), dtype=np.float64).reshape(-1, dim)), leaves)
            # what the sample's ranges leave out is in one of the sides, too
            tree.ranges[:] = np.column_stack([np.zeros(leaves - 1), tree.medians, tree.medians, np.full(leaves - 1, np.pi)])
            trees[dim] = tree
    return trees


def leaves(tree: Tree | None, part: pa.RecordBatch, dim: int, factor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of part (vec, and near unless factor is None), a leaf of each: of factor None the own one, else each that near
    does not rule out; and whether it is the own one."""
    n = part.num_rows
    if not tree:
        return np.arange(n), np.zeros(n, dtype=np.int32), np.ones(n, dtype=bool)
    unit = units(doubles(part["vec"], dim))
    own = tree.homes(unit).astype(np.int32)
    if factor is None:
        return np.arange(n), own, np.ones(n, dtype=bool)
    row, leaf, _ = tree.reached(unit, part["near"].to_numpy(zero_copy_only=False), factor)
    return row, leaf.astype(np.int32), leaf == own[row]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def housed(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """rows (dim, vec and others) with their own leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves(shared.value.get(dim), part, dim, None)[1])], names=[*part.schema.names, "leaf"])

    return map_arrow(rows, f, ", ".join([*(f"{c} {kind}" for c, kind in rows.dtypes), "leaf int"]))


def blocks(asked: DataFrame, trees: dict[int, Tree], factor: float | None) -> DataFrame:
    """dim, leaf, asked, vecs, nears, homes: a task's queries (key, dim, vec, near) in lists of at most QUERY_BLOCK for each of
    their leaves, as leaves() has them."""
    shared = asked.sparkSession.sparkContext.broadcast(trees)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                row, leaf, home = leaves(shared.value.get(dim), part, dim, factor)
                order = np.argsort(leaf, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                    for i in range(0, len(group), QUERY_BLOCK):
                        some = group[i : i + QUERY_BLOCK]
                        taken, ends = part.take(pa.array(row[some])), pa.array([0, len(some)], pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, x) for x in (taken["key"], taken["vec"], taken["near"], pa.array(home[some]))]
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array(leaf[some[:1]]), *lists], names=["dim", "leaf", "asked", "vecs", "nears", "homes"])

    return map_arrow(asked.select("key", "dim", "vec", "near"), f, "dim int, leaf int, asked array<binary>, vecs array<binary>, nears array<double>, homes array<boolean>")


def index(classes: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """dim, leaf, shard, keys, members, points (in the tree's order), vantage, medians, ranges, starts: one tree a row, written."""
    placed = written(housed(classes, trees), "placed")
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") * F.lit(8) * F.first("dim") / SHARD_BYTES).alias("shards"))
    shards = placed.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    grouped = shards.groupBy("dim", "leaf", "shard").agg(F.collect_list(F.struct("key", "vec", F.col("members").alias("member"))).alias("rows")).select("dim", "leaf", "shard", *(F.col(f"rows.{c}").alias(f"{c}s") for c in ("key", "vec", "member")))
    members = "array<array<struct<vec_id:bigint,n:bigint>>>"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = doubles(batch["vecs"][i].values, batch["dim"][i].as_py())
                tree, order = Tree.built(units(points), 1 << max(0, len(points) // BUCKET).bit_length() - 1 if len(points) >= 2 * BUCKET else 1)
                listed = [batch[c][i].values.take(pa.array(order)) for c in ("keys", "members")]
                arrays = [pa.array([x.tobytes()], pa.binary()) for x in (points[order], tree.vantage, tree.medians, tree.ranges, tree.starts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, 1) for c in ("dim", "leaf", "shard")), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in listed), *arrays], names=["dim", "leaf", "shard", "keys", "members", "points", "vantage", "medians", "ranges", "starts"])

    built = written(map_arrow(grouped, f, f"dim int, leaf int, shard int, keys array<binary>, members {members}, points binary, vantage binary, medians binary, ranges binary, starts binary"), "trees", **_LARGE_ROWS)
    forgotten(placed)
    return built


def answered(asked: DataFrame, trees: DataFrame, first: bool, factor: float, k: int) -> DataFrame:
    """key, score, found, members: what the shards of blocks() of queries hold nearest, k of each query. first: only shard 0 of
    the own leaf; else all but that."""
    both = asked.hint("merge").join(trees.where("shard = 0") if first else trees, ["dim", "leaf"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, shard = batch["dim"][i].as_py(), batch["shard"][i].as_py()
                array = lambda c, t=np.float64: np.frombuffer(batch[c][i].as_buffer(), dtype=t)
                tree = Tree(array("vantage").reshape(-1, dim), array("medians"), array("ranges").reshape(-1, 4), array("starts", np.int64))
                members = batch["members"][i].values
                ids = pc.struct_field(pc.list_element(members, 0), "vec_id").fill_null(LAST).to_numpy()
                due = np.arange(len(batch["asked"][i]))
                if not first and shard == 0:
                    due = np.flatnonzero(~batch["homes"][i].values.to_numpy(zero_copy_only=False))
                if not len(due):
                    continue
                due = pa.array(due)
                scores, places = search(tree, array("points").reshape(-1, dim), ids, doubles(batch["vecs"][i].values.take(due), dim), batch["nears"][i].values.take(due).to_numpy(), factor, k)
                row, col = np.nonzero(places >= 0)
                yield pa.RecordBatch.from_arrays([batch["asked"][i].values.take(due).take(pa.array(row)), pa.array(scores[row, col]), *(x.take(pa.array(places[row, col])) for x in (batch["keys"][i].values, members))], names=["key", "score", "found", "members"])

    return map_arrow(both, f, "key binary, score double, found binary, members array<struct<vec_id:bigint,n:bigint>>")


def nearest(rows: DataFrame, queries: Column, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: for each of rows (vec_id, embedding) that `queries`, a condition on vec_id, picks."""
    found = written(vectors(rows), "vectors")
    by_id = W.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"))
    # of a class, k + 1 ids are enough: the own one and k others
    least = found.groupBy("key", "vec_id").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    members = F.transform(F.sort_array(F.collect_list(F.struct("place", "vec_id", "n"))), lambda m: F.struct(m["vec_id"].alias("vec_id"), m["n"].alias("n")))
    one = (F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = written(found.groupBy("key").agg(*one).hint("merge").join(least.groupBy("key").agg(members.alias("members")), "key"), "classes")
    rows = written(found.where(queries).groupBy("key", "vec_id").agg(F.count("*").alias("n")), "queries")
    asked = written(found.where(queries).groupBy("key").agg(*one), "asked")
    forgotten(found)
    trees = upper_levels(classes)
    shards = index(classes, trees)
    forgotten(classes)
    shuffles_collected(found.sparkSession)
    own = blocks(housed(asked, trees).repartition("dim", "leaf").withColumn("near", F.lit(10.0)), trees, None)
    begun = written(answered(own, shards, True, factor, k + 1), "begun")
    bound = begun.groupBy("key").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") > k).select("key", F.acos(F.least(F.greatest("s", F.lit(-1.0)), F.lit(1.0))).alias("near"))
    known = asked.hint("merge").join(bound, "key", "left").withColumn("near", F.coalesce("near", F.lit(10.0)))
    wide = blocks(known.repartition(-(-asked.count() // TASK_QUERIES) or 1, "key"), trees, factor)
    both = begun.unionByName(answered(wide, shards, False, factor, k + 1))
    best = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last(F.col("members")[0]["vec_id"]))
    top = both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("key", "score", "found", F.explode("members").alias("m")).select("key", "score", "found", "m.vec_id", "m.n")
    near = top.groupBy("key").agg(F.collect_list(F.struct("score", "found", "vec_id", "n")).alias("near"))
    return ranked(rows.select("key", F.col("vec_id").alias("query_id"), F.col("n").alias("copies")).hint("merge").join(near, "key"), k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query_id's near (score, found, vec_id, n: so many rows), its own row once left out; for each
    of the query's copies."""

    def listed(x: Column) -> Column:
        own = (x["found"] == F.col("key")) & (x["vec_id"] == F.col("query_id"))
        n = F.least(x["n"], F.lit(k + 1)) - F.when(own, 1).otherwise(0)
        return F.array_repeat(F.struct((-x["score"]).alias("far"), x["vec_id"].isNull().alias("last"), x["vec_id"].alias("vec_id"), x["score"].alias("score")), n.cast("int"))

    first = F.slice(F.sort_array(F.flatten(F.transform("near", listed))), 1, k)
    copies = F.explode(F.expr("sequence(1L, copies)"))
    return rows.select("query_id", first.alias("first"), copies.alias("copy")).select("query_id", F.posexplode("first").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


#: All pairs, which a small table allows.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v AS q JOIN v AS c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0))
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERIES_EVERY == 0)
