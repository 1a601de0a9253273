"""Removal of bytes that lie in a string of WINDOW bytes that also starts elsewhere, by suffix sorting.

A suffix array of the whole corpus would need many times its size on disk, so the corpus is cut into shards first, so
that equal strings meet in one shard. Each window hangs on its anchor, the GRAM bytes in it with the least hash; equal
windows have equal anchors at equal places. The windows that hang on one occurrence of an anchor are consecutive; that
stretch of text and its signature represent them all.

* An anchor that occurs once has no repeated window; its text is never moved.
* In a text with a period, a stretch recurs at even distances; these are one row with a step and a number of times.
* A stretch that occurs twice or more is repeated whole. Anchors only find candidates; equal is what has equal
  signatures, 128 bits of the BLAKE2b of a stretch's bytes, for which different bytes cannot be built.
* The different stretches of one anchor may still share windows. One text of each goes to a shard by the anchor's hash;
  the shard's suffixes are sorted by external induced sorting (suffix_sort.py), and windows that agree with a neighbour
  in WINDOW bytes are repeated. Agreement is exact: the suffixes' bytes are compared.
* An anchor with more than HOT_BYTES of different stretches is not held in memory: its bytes go to a file, its windows'
  hashes to buckets of bounded size on disk, and each bucket is sorted by itself; windows with equal hashes are compared
  in the file. Memory holds one bucket, and two numbers for each stretch.

A common passage has few different stretches, so it is sorted once, however many documents hold it.

Edge cases: a null text is empty; texts under WINDOW bytes lose nothing; rows that repeat are occurrences of their own,
so they lose all their bytes from WINDOW on; a null doc_id is as any other, and rows of one doc_id are told apart by 128
bits of their text's SHA-256; very long texts are cut into blocks of windows; a text's removed ranges are one
row, some 30 bytes for each 70 of a text that is repeated without a period, and a few numbers for one that has one;
no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, PrefixHash, chunks, digests, documents, forgotten, map_arrow, runs, text_bytes, text_digest, window_minima, written
from .suffix_sort import sort_suffixes

WINDOW = 200
GRAM = 64
#: Bytes of stretches that a shard's sort takes at once, and suffixes that its queues hold in memory.
SHARD_BYTES = 2 << 20
QUEUE_MEMORY = 1 << 21
#: An anchor with more bytes of different stretches than this is not sorted in memory but in buckets on disk, of so many
#: windows each.
HOT_BYTES = 8 << 20
BUCKET_WINDOWS = 2 << 20


def periodic(data: np.ndarray, who: np.ndarray, gram: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches to keep, and how many each stands for: stretches in a row with one anchor hash and n, each n bytes
    after the other, are one if their text has period n; a text of one letter has a stretch for each byte."""
    alike = (who[1:] == who[:-1]) & (gram[1:] == gram[:-1]) & (n[1:] == n[:-1]) & (first[1:] - first[:-1] == n[1:])
    keep, times = np.ones(len(first), dtype=bool), np.ones(len(first), dtype=np.int64)
    for a, b in zip(*runs(alike)):
        begin, end, step = first[a], first[b] + n[b] + WINDOW - 1, n[a]
        if np.array_equal(data[begin : end - step], data[begin + step : end]):
            keep[a + 1 : b + 1] = False
            times[a] = b - a + 1
    return keep, times


def progressions(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """text, hash, s1, s2, first, n, step, times: rows alike in all but `first`, whose places are step apart, are one."""
    rows = tuple(c[np.lexsort((rows[4], rows[7], rows[6], rows[5], *rows[:4]))] for c in rows)
    who, gram, s1, s2, first, n, step, times = rows
    same = np.append(False, (who[1:] == who[:-1]) & (gram[1:] == gram[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1]) & (n[1:] == n[:-1]) & (times[1:] == 1) & (times[:-1] == 1))
    gap = np.append(0, np.diff(first))
    even = same & np.append(False, same[:-1] & (gap[1:] == gap[:-1]))  # the third and later of a row of places
    head = ~(even | (same & np.append(even[1:], False)))
    size = np.diff(np.append(np.flatnonzero(head), len(head)))
    second = np.minimum(np.flatnonzero(head) + 1, len(head) - 1)
    return who[head], gram[head], s1[head], s2[head], first[head], n[head], np.where(size > 1, gap[second], step[head]), np.where(size > 1, size, times[head])


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, hash, s1, s2, first, n, step, times of each stretch: n windows of a text from byte `first` on that hang on one
    anchor, and so often again, each time `step` bytes on."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(8))
    if len(data) < WINDOW:
        return none
    h, at = PrefixHash(data), np.arange(len(data) - GRAM + 1)
    grams = h.between(at, at + GRAM)
    anchor = window_minima(grams, WINDOW - GRAM + 1)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= ends[owner])
    if not len(window):
        return none
    anchor = anchor[window]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    first, n = window[new], np.diff(np.append(np.flatnonzero(new), len(window)))
    who, gram = owner[first], grams[anchor[new]].view(np.int64)
    keep, times = periodic(data, who, gram, first, n)
    who, gram, first, n, times = who[keep], gram[keep], first[keep], n[keep], times[keep]
    sig = digests(data, first, first + n + WINDOW - 1)
    return progressions((who, gram, sig[:, 0], sig[:, 1], first - (ends - lengths)[who], n, n, times))


def long_stretches(text: bytes, block: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """stretches() of one text, a block of windows at a time; a stretch over an edge is two."""
    for a in range(0, len(text) - WINDOW + 1, block):
        who, h, s1, s2, first, *rest = stretches([text[a : a + block + WINDOW - 1]])
        yield who, h, s1, s2, first + a, *rest


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, d, t: equal rows share d and t, and so what they lose; other rows don't: a hot doc_id has many texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumns({"d": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "t": text_digest()})


def stretch_rows(docs: DataFrame) -> DataFrame:
    """d, t, hash, s1, s2, first, n, step, times."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = text_bytes(batch["text"]), (batch["d"], batch["t"])
            for a, b in chunks(list(map(len, texts))):
                for who, gram, s1, s2, *places in long_stretches(texts[a]) if b == a + 1 else [stretches(texts[a:b])]:
                    own = pa.array(who + a)
                    yield pa.RecordBatch.from_arrays([*(k.take(own) for k in keys), pa.array(gram), pa.array(s1), pa.array(s2), *(pa.array(c.astype(np.int32)) for c in places)], names=["d", "t", "hash", "s1", "s2", "first", "n", "step", "times"])

    return map_arrow(docs.select("d", "t", "text"), f, "d long, t binary, hash long, s1 long, s2 long, first int, n int, step int, times int")


def stretch_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, sig (s1 and s2), body: the bytes of each wanted stretch (d, t, hash, s1, s2, first, n)."""
    places = wanted.groupBy(F.col("d").alias("kd"), F.col("t").alias("kt")).agg(F.collect_list(F.struct("hash", "s1", "s2", "first", "n")).alias("places"))
    joined = docs.join(places, (F.col("d") == F.col("kd")) & (F.col("t") == F.col("kt"))).select("d", "t", "text", "places").dropDuplicates(["d", "t"]).select("text", "places")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(text_bytes(batch["text"]), batch["places"]):
                own = [places.values.field(c) for c in ("hash", "s1", "s2", "first", "n")]
                for a in range(0, len(own[0]), 20_000):
                    part = [c.slice(a, 20_000) for c in own]
                    bodies = [text[i : i + n + WINDOW - 1] for i, n in zip(part[3].to_pylist(), part[4].to_pylist())]
                    yield pa.RecordBatch.from_arrays([*part[:3], pa.array(bodies, type=pa.binary())], names=["hash", "s1", "s2", "body"])

    return map_arrow(joined, f, "hash long, s1 long, s2 long, body binary")


def repeated_windows(bodies: list[bytes], memory: int = QUEUE_MEMORY) -> list[np.ndarray]:
    """For each text, where windows start that also start elsewhere in the texts."""
    data = np.frombuffer(b"".join(b + b"\0" for b in bodies), dtype=np.uint8)
    lengths = np.array([len(b) for b in bodies], dtype=np.int64)
    ends = np.cumsum(lengths + 1)  # past each text's end mark
    text = np.append(data.astype(np.int32) + 2, 0)
    text[ends - 1] = 1
    order = sort_suffixes(text, memory, WINDOW)
    room = np.repeat(ends - 1, lengths + 1) - np.arange(len(data))
    full = np.append(room >= WINDOW, False)
    order = order[full[order]]  # of these, equal ones are still neighbours
    h = PrefixHash(data)
    marks = h.between(order, order + WINDOW)
    same = np.flatnonzero(marks[1:] == marks[:-1])
    # equal marks are verified byte by byte
    ok = np.ones(len(same), dtype=bool)
    for a in range(0, len(same), 20_000):
        i = same[a : a + 20_000]
        ok[a : a + 20_000] = (data[order[i][:, None] + np.arange(WINDOW)] == data[order[i + 1][:, None] + np.arange(WINDOW)]).all(axis=1)
    hit = np.zeros(len(text), dtype=bool)
    hit[order[same[ok]]] = hit[order[same[ok] + 1]] = True
    return [np.flatnonzero(hit[e - n - 1 : e - 1]) for e, n in zip(ends, lengths)]


class HotAnchor:
    """The different stretches of one anchor, on disk; which of their windows are repeated, at the memory of one bucket."""

    def __init__(self, anchor: int, bucket: int = BUCKET_WINDOWS):
        self.anchor, self.bucket = anchor, bucket
        self.folder = tempfile.TemporaryDirectory()
        self.file = open(os.path.join(self.folder.name, "bytes"), "wb")
        self.sigs, self.lengths = array("q"), array("q")

    def add(self, sig: tuple[int, int], body: bytes) -> None:
        self.sigs.extend(sig)
        self.lengths.append(len(body))
        self.file.write(body)

    def repeated(self) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """sig and where repeated windows start, of each stretch that has such."""
        self.file.close()
        with self.folder as folder:
            total = sum(self.lengths)
            data = np.memmap(os.path.join(folder, "bytes"), dtype=np.uint8, mode="r", shape=total)
            hit = np.memmap(os.path.join(folder, "hits"), dtype=bool, mode="w+", shape=total)
            n = max(1, -(-total // self.bucket))
            paths = [os.path.join(folder, f"bucket-{i}") for i in range(n)]
            at = 0
            for a, b in chunks(self.lengths):
                lengths = np.array(self.lengths[a:b])
                ends = np.cumsum(lengths)
                places = np.flatnonzero(np.repeat(ends, lengths) - np.arange(ends[-1]) >= WINDOW)
                marks = PrefixHash(np.asarray(data[at : at + ends[-1]])).between(places, places + WINDOW)
                own = marks % np.uint64(n)
                order = np.argsort(own, kind="stable")
                rows = np.stack([marks, (places + at).astype(np.uint64)], axis=1)[order]
                cuts = np.searchsorted(own[order], np.arange(n + 1, dtype=np.uint64))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    with open(paths[i], "ab") as f:
                        rows[cuts[i] : cuts[i + 1]].tofile(f)
                at += int(ends[-1])
            for path in filter(os.path.exists, paths):
                self._bucket(np.fromfile(path, dtype=np.uint64).reshape(-1, 2), data, hit)
                os.remove(path)
            at = 0
            for sig, length in zip(zip(self.sigs[::2], self.sigs[1::2]), self.lengths):
                starts = np.flatnonzero(hit[at : at + length])
                if len(starts):
                    yield sig, starts
                at += length

    @staticmethod
    def _bucket(rows: np.ndarray, data: np.ndarray, hit: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        marks, places = rows[:, 0], rows[:, 1].astype(np.int64)
        same = np.flatnonzero(marks[1:] == marks[:-1])
        for a in range(0, len(same), 20_000):
            x, y = places[same[a : a + 20_000]], places[same[a : a + 20_000] + 1]
            ok = (data[x[:, None] + np.arange(WINDOW)] == data[y[:, None] + np.arange(WINDOW)]).all(axis=1)
            hit[x[ok]] = hit[y[ok]] = True
            for m in set(marks[same[a : a + 20_000][~ok]].tolist()):  # different windows with one hash: told apart by their bytes
                first: dict[bytes, int] = {}
                for p in places[np.searchsorted(marks, np.uint64(m)) : np.searchsorted(marks, np.uint64(m), "right")].tolist():
                    if (q := first.setdefault(data[p : p + WINDOW].tobytes(), p)) != p:
                        hit[p] = hit[q] = True


def shard_spans(batches: Iterator[pa.RecordBatch], memory: int = QUEUE_MEMORY, hot: int = HOT_BYTES) -> Iterator[pa.RecordBatch]:
    """The work of a task of sorted_shards(): batches of hash, s1, s2 and body, ordered by hash."""

    def out(found: list[tuple[int, tuple[int, int], np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for h, s, starts in found:
            mask = np.zeros(int(starts[-1]) + 1, dtype=bool)
            mask[starts] = True
            rows.append((h, *s, [{"a": int(a), "b": int(b)} for a, b in zip(*runs(mask))]))
        columns = list(zip(*rows)) or [()] * 4
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.int64()) for c in columns[:3]), pa.array(columns[3], type=kind)], names=["hash", "s1", "s2", "spans"])

    def flush(rows: list[tuple[int, tuple[int, int], bytes]]) -> pa.RecordBatch:
        return out([(h, s, starts) for (h, s, _), starts in zip(rows, repeated_windows([b for _, _, b in rows], memory)) if len(starts)])

    def flush_hot(anchor: HotAnchor) -> Iterator[pa.RecordBatch]:
        part = []
        for sig, starts in anchor.repeated():
            part.append((anchor.anchor, sig, starts))
            if len(part) == 10_000:
                yield out(part)
                part = []
        yield out(part)

    held: list[tuple[int, tuple[int, int], bytes]] = []
    size = begin = own = 0  # bytes held, where the last anchor begins among them, and its bytes
    large: HotAnchor | None = None
    for batch in batches:
        for row in zip(batch["hash"].to_pylist(), zip(batch["s1"].to_pylist(), batch["s2"].to_pylist()), batch["body"].to_pylist()):
            if large and row[0] != large.anchor:
                yield from flush_hot(large)
                large = None
            if large:
                large.add(row[1], row[2])
                continue
            if held and row[0] != held[-1][0]:
                if size > SHARD_BYTES:
                    yield flush(held)
                    held, size = [], 0
                begin, own = len(held), 0
            held.append(row)
            size += len(row[2])
            own += len(row[2])
            if own > hot:
                large = HotAnchor(row[0])
                for _, s, body in held[begin:]:
                    large.add(s, body)
                del held[begin:]
                size, own = size - own, 0
    if large:
        yield from flush_hot(large)
    if held:
        yield flush(held)


def sorted_shards(bodies: DataFrame, memory: int = QUEUE_MEMORY, hot: int = HOT_BYTES) -> DataFrame:
    """hash, s1, s2, spans: the runs (a, b) of windows, from the stretch's start, that other stretches of the anchor have.

    A task has all stretches of its anchors, ordered by hash, and sorts the suffixes of some megabytes of them at once; an
    anchor's stretches are never parted, but beyond `hot` bytes they are compared on disk.
    """
    return map_arrow(bodies.repartition("hash").sortWithinPartitions("hash", "s1", "s2"), lambda batches: shard_spans(batches, memory, hot), "hash long, s1 long, s2 long, spans array<struct<a:int,b:int>>")


def removed_spans(docs: DataFrame) -> DataFrame:
    """kd, kt (a row's d and t), spans: the byte ranges that it loses, each (a, b) and so often again, step bytes on."""
    rows = written(stretch_rows(docs), "stretches")
    differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    shared = written(rows.groupBy("hash").agg(F.sum("times").alias("c"), differ.alias("several")).where("c > 1").select("hash", "several"), "anchors")
    cand = written(rows.join(shared, "hash"), "shared")
    forgotten(rows)
    one = F.min(F.struct("d", "t", "first", "n")).alias("o")
    sigs = written(cand.groupBy("hash", "s1", "s2").agg(F.sum("times").alias("c"), F.first("several").alias("several"), one).select("hash", "s1", "s2", "c", "several", "o.*"), "signatures")
    found = written(sorted_shards(stretch_texts(docs, sigs.where("several").select("d", "t", "hash", "s1", "s2", "first", "n"))), "repeated")
    whole = sigs.where("c > 1").select("s1", "s2", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    some = found.select("s1", "s2", "spans").join(whole.select("s1", "s2"), ["s1", "s2"], "left_anti")
    lost = written(whole.unionByName(some), "lost")
    joined = cand.select("d", "t", "s1", "s2", "first", "n", "step", "times").join(lost, ["s1", "s2"])
    own = F.transform(F.coalesce("spans", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))), lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"] + WINDOW - 1).alias("b"), F.col("step").alias("step"), F.col("times").alias("times")))
    per = joined.select(F.col("d").alias("kd"), F.col("t").alias("kt"), own.alias("s")).groupBy("kd", "kt").agg(F.flatten(F.collect_list("s")).alias("spans"))
    out = written(per, "spans")
    forgotten(shared, cand, sigs, found, lost)
    return out


def merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte ranges that spans (a, b, step, times) cover."""
    a, b, step, times = (spans.field(c).to_numpy().astype(np.int64) for c in ("a", "b", "step", "times"))
    joint = step <= b - a
    b = np.where(joint, b + (times - 1) * step, b)
    times = np.where(joint, 1, times)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    a, b = (np.repeat(x, times) + k * np.repeat(step, times) for x in (a, b))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(new[1:], True)]


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with_text adds the bytes that stay."""
    docs = with_row_key(docs)
    joined = docs.join(removed_spans(docs), (F.col("d") == F.col("kd")) & (F.col("t") == F.col("kt")), "left").select("doc_id", "text", "spans")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, own in zip(text_bytes(batch["text"]), batch["spans"]):
                rest, n_spans = text, 0
                if own.is_valid and len(own.values):
                    starts, ends = merged(own.values)
                    n_spans = len(starts)
                    rest = b"".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])])
                out.append((len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest()) + ((rest,) if with_text else ()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, type=t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return map_arrow(joined, f, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))
