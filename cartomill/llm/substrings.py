"""Removal of word windows that an earlier document has, with a log-structured index of fingerprints.

A window is WINDOW consecutive words. Each window hangs on its anchor, the run of GRAM words in it with the least hash;
equal windows have equal anchors at equal places. The windows that hang on one occurrence of an anchor are consecutive,
and their common stretch of words has one signature. The index therefore needs one row for some twenty words: anchor
hash, signature, the least doc_id with that stretch, and where it has it.

The index is a folder in the shared file system: immutable runs, each bucketed by fingerprint and sorted in its buckets,
the texts of each batch, bucketed by document, and manifests, of which the latest names the runs that count. A later
session opens it again. A batch of documents is turned into a run and merge-joined, bucket by bucket, with each run of
history; only the batch is shuffled:

* a stretch that an earlier document has (equal signature) is removed whole;
* where an anchor has several different stretches, single windows may still be equal. Their owners' texts are read
  again, all windows of those stretches are digested, and each is compared with the least owner of the same window.

Anchors only find candidates. What decides is a signature of the words themselves, 128 bits of their BLAKE2b, for which
different words with equal signatures cannot be built.

Before a batch would make more than MOST_RUNS runs, runs of like size are compacted: the smallest two become one, which
keeps the least owner of each stretch. A common passage has few different stretches, so it is one row for many documents.

Edge cases: null and blank texts have no words; texts under WINDOW words lose nothing; very long texts are hashed in
blocks of words, so that memory follows the text by a small factor; rows with equal doc_ids do not remove each other's
words; rows that repeat are one in the index and are returned each; rows with a null doc_id lose nothing and remove
nothing; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, PrefixHash, chunks, deleted, digests, documents, forgotten, map_arrow, shared_dir, text_bytes, text_digest, window_minima, written

WINDOW = 50
GRAM = 8
MOST_RUNS = 4
BATCHES = 3
#: Words that are hashed at once.
BLOCK_WORDS = 200_000

PLACE = ["doc_id", "t", "first", "n"]


class Words:
    """The words of some texts, one after another, with single spaces between them."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = ASCII_SPACE[data]
        begins = ~space & np.concatenate([[True], space[:-1]])
        ends = ~space & np.concatenate([space[1:], [True]])
        at = np.flatnonzero(begins)
        keep = ~space | np.concatenate([[False], ends[:-1]])
        place = np.cumsum(keep) - 1
        self.data = np.where(space[keep], np.uint8(0x20), data[keep])
        self.starts, self.ends = place[at], place[np.flatnonzero(ends)] + 1
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.bounds = np.searchsorted(at, edges)  # of each text's words

    def hashes(self) -> PrefixHash:
        return PrefixHash(self.data)


def spaced(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text with single spaces, and where each begins and ends."""
    words = text.split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, hash, s1, s2, first, n of each stretch: n windows of a text from word `first` on that hang on one anchor."""
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    words = Words(texts)
    h, total = words.hashes(), len(words.starts)
    if total < WINDOW:
        return none
    grams = h.between(words.starts[: total - GRAM + 1], words.ends[GRAM - 1 :])
    anchor = window_minima(grams, WINDOW - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    window = np.arange(len(anchor))
    inside = owner[window] == owner[window + WINDOW - 1]
    window, anchor = window[inside], anchor[inside]
    if not len(window):
        return none
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    first = window[new]
    n = np.diff(np.append(np.flatnonzero(new), len(window)))
    sig = digests(words.data, words.starts[first], words.ends[first + n + WINDOW - 2])
    return owner[first], grams[anchor[new]].view(np.int64), sig[:, 0], sig[:, 1], first - words.bounds[owner[first]], n


def long_stretches(text: bytes, block: int = BLOCK_WORDS) -> Iterator[tuple[np.ndarray, ...]]:
    """stretches() of one text, a block of windows at a time; a stretch over an edge is two."""
    data, starts, ends = spaced(text)
    for a in range(0, max(1, len(starts) - WINDOW + 1), block):
        b = min(len(starts), a + block + WINDOW - 1)
        if b - a >= WINDOW:
            who, h, s1, s2, first, n = stretches([data[starts[a] : ends[b - 1]]])
            yield who, h, s1, s2, first + a, n


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, t. Equal doc_ids with different texts are told apart by t."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", text_digest())


def stretch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, t, hash, s1, s2, first, n."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys = text_bytes(batch["text"]), batch["doc_id"], batch["t"]
            for a, b in chunks(list(map(len, texts))):
                parts = long_stretches(texts[a]) if b == a + 1 else [stretches(texts[a:b])]
                for who, h, s1, s2, first, n in parts:
                    own = pa.array(who + a)
                    yield pa.RecordBatch.from_arrays([ids.take(own), keys.take(own), pa.array(h), pa.array(s1), pa.array(s2), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "t", "hash", "s1", "s2", "first", "n"])

    return map_arrow(docs.select("doc_id", "t", "text"), f, "doc_id long, t binary, hash long, s1 long, s2 long, first int, n int")


def owners(rows: DataFrame) -> DataFrame:
    """Of each stretch the least doc_id with it, one place where it has it, and how many rows there are (`c`)."""
    return rows.groupBy("hash", "s1", "s2").agg(F.min(F.struct(*PLACE)).alias("o"), F.sum("c").alias("c")).select("hash", "s1", "s2", "o.*", "c")


def window_digests(texts: DataFrame, places: DataFrame) -> DataFrame:
    """s1, s2, doc_id, k, w1, w2: the digest of the k-th window of each stretch wanted, from the texts of its owner.

    texts: doc_id, t, text; places: d, u, places (s1, s2, first, n).
    """
    joined = texts.join(places, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u"))).select("doc_id", "text", "places")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, places in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["places"]):
                data, starts, ends = spaced(text)
                own = {c: places.values.field(c).to_numpy() for c in ("s1", "s2", "first", "n")}
                for a in range(0, len(own["n"]), 1000):
                    n, first = own["n"][a : a + 1000], own["first"][a : a + 1000].astype(np.int64)
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(first, n) + k
                    w = digests(data, starts[at], ends[at + WINDOW - 1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own["s1"][a : a + 1000], n)), pa.array(np.repeat(own["s2"][a : a + 1000], n)), pa.array(np.full(len(k), doc_id)), pa.array(k.astype(np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["s1", "s2", "doc_id", "k", "w1", "w2"])

    return map_arrow(joined, f, "s1 long, s2 long, doc_id long, k int, w1 long, w2 long")


class FingerprintIndex:
    """The log of runs, in a folder. insert() finds what of a batch history has, then adds the batch."""

    COLUMNS = {"run": "hash long, s1 long, s2 long, doc_id long, t binary, first int, n int, c long", "texts": "doc_id long, t binary, text string, copies long"}
    BUCKETED = {"run": ["hash"], "texts": ["doc_id", "t"]}

    def __init__(self, spark: SparkSession, path: str, most_runs: int = MOST_RUNS, buckets: int | None = None):
        """Opens the index at path, or begins one with so many buckets (the session's shuffle partitions, if none are given)."""
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.tables = 0, [], {}
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.fs.exists(place):
            names = [s.getPath().getName() for s in self.fs.listStatus(place)]
            self.version = max((int(x[9:-5]) for x in names if x.startswith("manifest-")), default=0)
        if self.version:
            lines = spark.read.text(self._manifest(self.version), wholetext=True).first().value
            found = json.loads(lines)
            self.buckets, self.runs = found["buckets"], found["runs"]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version}.json"

    def _commit(self, runs: list[dict]) -> None:
        """The new list of runs counts from here on; a manifest of that number must not exist."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._manifest(self.version + 1))
        out = self.fs.create(place, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        self.version, self.runs = self.version + 1, runs

    def _table(self, kind: str, name: str) -> DataFrame:
        """A run's table; Spark knows its buckets, so a join on them moves nothing."""
        if name not in self.tables:
            by = ", ".join(self.BUCKETED[kind])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.COLUMNS[kind]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = kind
        return self.spark.table(name)

    def _write(self, kind: str, df: DataFrame) -> str:
        name, by = f"{kind}_{uuid.uuid4().hex}", self.BUCKETED[kind]
        df.write.option("compression", "zstd").bucketBy(self.buckets, *by).sortBy(*by).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        self.tables[name] = kind
        return name

    def _dropped(self, run: dict) -> None:
        for kind in self.COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS {run[kind]}")
            self.tables.pop(run[kind], None)
            deleted(self.spark, f"{self.path}/{run[kind]}")

    def history(self, kind: str) -> list[DataFrame]:
        return [self._table(kind, r[kind]) for r in self.runs]

    def compact(self) -> None:
        """The two smallest runs become one."""
        few = sorted(self.runs, key=lambda r: r["rows"])[:2]
        a, b = (self._table("run", r["run"]) for r in few)
        merged = self._write("run", owners(a.unionByName(b)).repartition(self.buckets, "hash"))
        x, y = (self._table("texts", r["texts"]) for r in few)
        one = x.unionByName(y).groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
        run = {"run": merged, "texts": self._write("texts", one), "rows": sum(r["rows"] for r in few)}
        self._commit([r for r in self.runs if r not in few] + [run])
        for r in few:
            self._dropped(r)

    def insert(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The batch as a table (doc_id, t, text, copies), and doc_id, t, spans (first word and end of what goes).

        batch: doc_id (not null), t, text.
        """
        while len(self.runs) >= max(2, self.most_runs):
            self.compact()
        runs, texts = self.history("run"), self.history("texts")
        mine = self._write("texts", batch.groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
        docs = self._table("texts", mine)
        rows = written(stretch_rows(docs), "stretches")
        name = self._write("run", owners(rows.withColumn("c", F.lit(1))).repartition(self.buckets, "hash"))
        run = self._table("run", name)
        # anchors that occur twice or more, in the batch or with history: a merge of the buckets, which moves nothing
        near = run.join(run.groupBy("hash").agg(F.sum("c").alias("__c")), "hash")
        again = F.col("__c") > 1
        for i, r in enumerate(runs):
            near = near.join(r.groupBy("hash").agg(F.lit(True).alias(f"__r{i}")), "hash", "left")
            again = again | F.col(f"__r{i}").isNotNull()
        near = near.where(again).select(run.columns)
        for r in runs:
            near = near.unionByName(r.join(run.select("hash").distinct(), "hash", "left_semi"))
        near = written(owners(near).drop("c"), "near")
        differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
        several = written(near.groupBy("hash").agg(differ.alias("several")).where("several").select("hash"), "several")
        wanted = near.join(several, "hash").select("doc_id", "t", "s1", "s2", "first", "n")
        places = written(wanted.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_list(F.struct("s1", "s2", "first", "n")).alias("places")), "places")
        every = window_digests(docs, places)
        for x in texts:
            every = every.unionByName(window_digests(x, places))
        every = written(every, "windows")
        least = every.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
        least = written(least, "least")
        later = every.join(least, ["w1", "w2"]).where("least < doc_id").groupBy("s1", "s2").agg(F.collect_set("k").alias("ks"))
        known = written(near.select("s1", "s2", F.col("doc_id").alias("owner")).join(later, ["s1", "s2"], "left"), "known")
        joined = rows.join(known, ["s1", "s2"])
        whole = F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") + WINDOW - 1).alias("b")))
        some = F.transform("ks", lambda k: F.struct((F.col("first") + k).alias("a"), (F.col("first") + k + WINDOW).alias("b")))
        found = joined.where("owner < doc_id OR ks IS NOT NULL").select("doc_id", "t", F.when(F.col("owner") < F.col("doc_id"), whole).otherwise(some).alias("s"))
        spans = written(found.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
        forgotten(rows, near, several, places, every, least, known)
        self._commit([*self.runs, {"run": name, "texts": mine, "rows": run.count()}])
        return docs, spans

    def delete(self) -> None:
        for r in self.runs:
            self._dropped(r)
        deleted(self.spark, self.path)


def batches_of(docs: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """docs in n batches of ascending doc_id."""
    cuts = sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.02))) if n > 1 else []
    edges = [None, *map(int, cuts), None]
    parts = []
    for a, b in zip(edges, edges[1:]):
        part = docs.where("doc_id IS NOT NULL")
        if a is not None:
            part = part.where(F.col("doc_id") > a)
        if b is not None:
            part = part.where(F.col("doc_id") <= b)
        parts.append(part)
    return parts


def without(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs (doc_id, text, copies, spans); with_text adds the words that stay."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, copies, spans in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["copies"].to_pylist(), batch["spans"].to_pylist()):
                words = text.split()
                n = len(words)
                if spans:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(gone, [s["a"] for s in spans], 1)
                    np.add.at(gone, [s["b"] for s in spans], -1)
                    stays = np.cumsum(gone)[:n] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                rest = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(rest).hexdigest(), copies) + ((rest.decode(),) if with_text else ()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()][: 5 + with_text]
            columns = [pa.array(c, type=t) for c, t in zip(list(zip(*out)) or [()] * len(types), types)]
            copies = columns.pop(4).to_numpy(zero_copy_only=False)
            ends = np.cumsum(copies)
            for a in range(0, int(copies.sum()), 100_000):  # row by row as often as it is there
                own = pa.array(np.searchsorted(ends, np.arange(a, min(a + 100_000, int(ends[-1]))), side="right"))
                yield pa.RecordBatch.from_arrays([c.take(own) for c in columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return map_arrow(docs.select("doc_id", "text", "copies", "spans"), f, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def kept(docs: DataFrame, batches: int = BATCHES, with_text: bool = False, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, by an index of its own; with_text adds the words that stay."""
    spark, docs = docs.sparkSession, keyed(docs)
    nothing = F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans")
    out = without(docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(1).cast("long").alias("copies"), nothing), with_text)
    index = FingerprintIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", most_runs)
    for part in batches_of(docs, batches):
        mine, spans = index.insert(part)
        joined = mine.join(spans.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "spans"), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")), "left")
        out = out.unionByName(written(without(joined, with_text), "kept"))
        forgotten(spans)
    index.delete()
    return out


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(documents(spark, sf_dir))
