"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 4-word shingles. Two fingerprints that differ in
at most TAU bits must, for any split of the 64 bits into m parts with thresholds t_i that sum to TAU - m + 1, differ in
at most t_i bits in some part i (t_i = -1: the part is not searched). Bits that agree or differ together go into one
part, so that the others stay selective. A dynamic program spreads the thresholds so that probes and expected
candidates cost least; it also takes the best m. Candidate counts are estimated from pairs of a bounded sample of
fingerprints, and no choice changes the result, only its cost.

Copies share a fingerprint and are one class from the start; only distinct fingerprints are indexed, probed with every
value within t_i of their own part, and verified inside the join. A large group of near copies does not become all its
pairs: first, the fingerprints of each part's value are compared with the least of them only, which joins most of the
group; then a probe goes only where it meets another group, and gives a pair only between two groups. Components are
found by alternating star contraction over the links between different fingerprints, each round written to the shared
folder; a round's least neighbours are a table of their own, so a join can split a node with many links.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; fewer than four words are one
shingle; very long texts count whole; a bit set in exactly half the shingles is 0; rows that repeat are returned each; a null doc_id never is a component's id unless all its doc_ids are null;
rows of one doc_id with different texts are rows of their own, and one_of_each() drops one only for another row of its
component, with or without a doc_id; no documents give no rows; other columns are ignored by near_duplicates() and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, map_arrow, text_bytes, text_digest, written

SHINGLE = 4
SEED = 42
TAU = 4
#: Fingerprints of which the bits' correlations and candidate counts are estimated.
SAMPLE = 3_000
#: Cost of a probe row against that of comparing one candidate.
PROBE_COST = 20.0


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[:-SHINGLE].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, **more: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns named in more, with their types."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b) for b in text_bytes(batch["text"])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps), *(batch[c] for c in more)], names=["doc_id", "fp", *more])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more), f, ", ".join(["doc_id long", "fp long", *(f"{c} {t}" for c, t in more.items())]))


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of nearly equal size; a part grows by the bit most correlated with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    corr = np.abs(bits.T @ bits) / np.outer(norm, norm)
    left, parts = set(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, parts))) // (m - i)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum() - 1, -b))]
        while len(part) < size:
            rest = [b for b in rest if b not in part]
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def ball(bits: int, radius: int) -> int:
    """Values within `radius` of a value of so many bits."""
    total, choose = 0, 1
    for r in range(radius + 1):
        total += choose
        choose = choose * (bits - r) // (r + 1)
    return total


def allocated(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost, each -1 or more, that sum to `total`. costs[i][t + 1] is that of t in part i."""
    m, most = costs.shape[0], costs.shape[1] - 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of t + 1
    for i in range(m):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(most + 1):
                to = used + t
                if to <= total + m and (to not in new or cost + costs[i][t] < new[to][0]):
                    new[to] = (cost + costs[i][t], [*chosen, t - 1])
        best = new
    return best[total + m]


def search_plan(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The parts to search, with their thresholds, for n distinct fingerprints."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(1, tau + 2):
        parts = grouped_bits(sample, m)
        costs = np.zeros((m, tau + 2))
        for i, part in enumerate(parts):
            mask = np.uint64(sum(1 << b for b in part))
            near = np.zeros(tau + 1)
            for a in range(0, len(sample), 500):
                d = np.bitwise_count((sample[a : a + 500, None] ^ sample[None, :]) & mask)
                near += [(d <= t).sum() for t in range(tau + 1)]
            pairs = max(1, len(sample) ** 2 - len(sample))
            for t in range(tau + 1):
                # at least what evenly spread bits would give: a sample this small has no pairs as rare as those
                share = max((near[t] - len(sample)) / pairs, ball(len(part), t) / 2.0 ** len(part))
                costs[i][t + 1] = PROBE_COST * n * ball(len(part), t) + share * n * n
        cost, thresholds = allocated(costs, tau - m + 1)
        if cost < best[0]:
            best = (cost, list(zip(parts, thresholds)))
    return [(part, t) for part, t in best[1] if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """a, b, a < b: pairs of different fingerprints that differ in at most tau bits; enough of them that they connect what
    all such pairs would, and none twice."""
    n = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = search_plan(sample, n, tau)
    def variants(i: int, own: Column, flips: list[int]) -> Column:
        return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("key")))

    index_keys, probe_keys = [], []
    for i, (part, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in part))))
        flips = [signed(sum(1 << b for b in c)) for r in range(t + 1) for c in combinations(part, r)]
        index_keys.append(F.struct(F.lit(i).alias("part"), own.alias("key")))
        probe_keys.append(variants(i, own, flips))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    values = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*index_keys)).alias("k")).select("b", "k.part", "k.key")
    least = written(values.groupBy("part", "key").agg(F.min("b").alias("a"), F.max("b").alias("most")).where("a < most").select("part", "key", "a"), "values")
    near = written(values.join(least, ["part", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct(), "near")
    groups = components(near)
    own = written(distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("group")), "groups")
    forgotten(least)
    index = own.select(F.col("fp").alias("b"), F.col("group").alias("other"), F.explode(F.array(*index_keys)).alias("k")).select("b", "other", "k.part", "k.key")
    probe = own.select(F.col("fp").alias("a"), "group", F.explode(F.concat(*probe_keys)).alias("k")).select("a", "group", "k.part", "k.key")
    held = written(index.groupBy("part", "key").agg(F.min("other").alias("lo"), F.max("other").alias("hi")), "values")
    probe = probe.join(held, ["part", "key"]).where("lo <> group OR hi <> group").drop("lo", "hi")
    # a pair that several parts find is kept by the first of them only, so no shuffle is needed to make pairs distinct
    masks = [(F.lit(signed(sum(1 << b for b in part))), t) for part, t in plan]
    earlier = F.lit(False)
    first = F.lit(False)
    for i, (mask, t) in enumerate(masks):
        first = first | ((F.col("p.part") == i) & ~earlier)
        earlier = earlier | (F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask)) <= t)
    between = probe.alias("p").join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("a") < F.col("b")) & (F.col("group") != F.col("other")) & close & first)
    out = written(near.unionByName(between.select("a", "b")), "links")
    forgotten(near, own, held)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that each node with a link reaches. edges is a written table.

    Large-star and small-star rounds: each replaces links by links to a least neighbour, so none makes more links than
    it was given; the number of rounds grows with the logarithm of a component's size.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        out = written(out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        forgotten(least)
        return out

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, first = None, edges
    while (now := state(edges)) != before and now[0]:
        before = now
        half = star(edges, large=True)
        if edges is not first:
            forgotten(edges)
        edges = star(half, large=False)
        forgotten(half)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def classified(fps: DataFrame, least: Column, tau: int) -> DataFrame:
    """fp, first (the least `least` of its rows), comp, for each different fingerprint."""
    classes = written(fps.groupBy("fp").agg(F.min(least).alias("first")), "classes")
    comp = components(links(classes.select("fp"), tau))
    return classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach), for each row."""
    fps = written(fingerprints(docs), "fingerprints")
    joined = classified(fps, F.col("doc_id"), tau)
    least = joined.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_fp = joined.join(least, "comp").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs, of each component only its least row by doc_id (nulls last) and 128 bits of the text's SHA-256; of rows that
    have both in common one, by their other columns.

    The row travels in a struct, so no name of it can clash.
    """
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    key = {"none": "boolean", "id": "long", "digest": "binary"}
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(*rest).alias("tie")
    ).withColumn("digest", F.coalesce(text_digest(), text_digest(F.lit(""))))
    fps = written(fingerprints(rows, **key), "fingerprints")
    keep = classified(fps, F.struct(*key), tau).groupBy("comp").agg(F.min("first").alias("first")).select("first.*")
    kept = rows.select("row", "tie", *key).join(keep, list(key), "left_semi")
    return kept.groupBy(*key).agg(F.min_by("row", "tie").alias("row")).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
