"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. Document words stream through it, and the state and the length of
the longest run that ends at a word show which windows end there: WINDOW words of an item, or the whole of a shorter
item. Items are taken in blocks of at most BLOCK_WORDS words (a longer item is a block of its own). A block's automaton is
flat arrays, about 60 bytes a word, is broadcast for one pass over the documents, and freed before the next one; so a
worker holds one block, however large the benchmark. Of all but the last pass only the hits are kept, by text.

contamination() reports; decontaminated() drops documents over the coverage limit and cuts matched spans over the length
limit (LONG_SPAN words) out of the others.

Edge cases: null, empty and wordless texts have no words and no hits; wordless items are ignored; item_ids that repeat
count once; items without an item_id hit like any other but are not among the items counted and named; very long texts
are streamed whole; a document exactly at the coverage limit is over it; rows that repeat are returned each; no items or
no documents give no hits or no rows; other columns are ignored by contamination() and kept, whatever their names, by
decontaminated().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, runs, text_bytes, text_digest, written

WINDOW = 13
#: A document is contaminated where 1 of so many of its words is hit.
COVERAGE = 20
#: Matched words in a row that a document under that limit loses.
LONG_SPAN = 50
BLOCK_WORDS = 500_000

_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton; symbols are the numbers of the items' words.

    A state's items are a range: states are numbered along the tree of suffix links, so what a run's state and all longer
    runs that end in it hold is one slice of the places where items' prefixes end.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.number, self.names = window, {}, []
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends: list[tuple[int, int]] = []  # state and item of each prefix of window words or more
        whole: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        for name, words in items:
            if not words:
                continue
            item, last = len(self.names), 0
            self.names.append(name)
            for n, w in enumerate(words, 1):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                if n >= window:
                    ends.append((last, item))
            if len(words) < window:
                whole.setdefault(last, []).append((len(words), item))
                self.least = min(self.least, len(words))
        self._flatten(ends, whole)

    def _flatten(self, ends: list[tuple[int, int]], whole: dict[int, list[tuple[int, int]]]) -> None:
        n = len(self._next)
        self.length, self.link = np.array(self._length, dtype=np.int32), np.array(self._link, dtype=np.int32)
        froms = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in self._next])
        symbols = np.fromiter((c for x in self._next for c in x), dtype=np.int64, count=len(froms))
        self.keys = froms << 32 | symbols
        self.targets = np.fromiter((t for x in self._next for t in x.values()), dtype=np.int32, count=len(froms))
        by_length = np.argsort(self.length, kind="stable")
        # of each state the state of the shortest run of window words or more that ends it, and the whole short items
        self.top, short = np.full(n, -1, dtype=np.int32), {}
        for s in by_length[1:].tolist():
            up = self._link[s]
            if self._length[s] >= self.window:
                self.top[s] = self.top[up] if self.top[up] >= 0 else s
            if own := tuple(short.get(up, ())) + tuple(whole.get(s, ())):
                short[s] = own
        self.short = short
        sizes = np.ones(n, dtype=np.int64)
        for s in by_length[:0:-1].tolist():
            sizes[self._link[s]] += sizes[s]
        place, free = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
        for s in by_length[1:].tolist():  # a state's subtree is one range of places
            up = self._link[s]
            place[s] = place[up] + free[up]
            free[up] += sizes[s]
        self.begin, self.end = place, place + sizes
        at = place[[s for s, _ in ends]] if ends else np.empty(0, dtype=np.int64)
        order = np.argsort(at, kind="stable")
        self.ends_at, self.ends_of = at[order], np.array([i for _, i in ends], dtype=np.int32)[order]
        del self._next, self._link, self._length

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "step"}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self._next, self._link, self._length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self._next, self._link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        self._length.append(self._length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The places (start, end) of the windows that occur, and their items."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(words) < self.least:
            return spans, items
        get = self.number.get
        symbols = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        states: set[int] = set()
        for a, b in zip(*runs(symbols >= 0)):  # no window goes over a word that no item has
            if b - a >= self.least:
                self._track(symbols[a:b].tolist(), int(a), spans, items, states)
        for s in states:
            a, b = np.searchsorted(self.ends_at, (self.begin[s], self.end[s]))
            items.update(self.ends_of[a:b].tolist())
        return spans, items

    def _track(self, symbols: list[int], at: int, spans: list[tuple[int, int]], items: set[int], states: set[int]) -> None:
        if not hasattr(self, "step"):
            self.step = dict(zip(self.keys.tolist(), self.targets.tolist()))
        step, link, length, window, short = self.step.get, self.link, self.length, self.window, self.short
        state = matched = 0
        for i, c in enumerate(symbols, at + 1):
            to = step(state << 32 | c)
            while to is None and state:
                state = int(link[state])
                matched = int(length[state])
                to = step(state << 32 | c)
            if to is not None:
                state = to
                matched += 1
            if matched >= window:
                spans.append((i - window, i))
                states.add(int(self.top[state]))
            for n, item in short.get(state, ()):
                if n <= matched:
                    spans.append((i - n, i))
                    items.add(item)


def automata(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of the items (columns item_id and text), in blocks of bounded size."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator():
        words = words_of(r.t.encode())
        if held and size + len(words) > block:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((r.i, words))
        size += len(words)
    if held:
        yield Automaton(held, window)


HITS = "spans array<struct<start:long,end:long>>, names array<string>"


def found_by(automaton: Automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the names of the items."""
    spans, items = automaton.hits(words)
    hit = np.zeros(len(words), dtype=bool)
    for a, b in spans:
        hit[a:b] = True
    return hit, {automaton.names[i] for i in items} - {None}


def each_block(docs: DataFrame, benchmark: DataFrame, window: int, block: int) -> tuple[DataFrame, Automaton | None]:
    """docs (with a column text) and the hits of all blocks but the last (earlier), by text; and the last automaton."""
    sc, earlier, last = docs.sparkSession.sparkContext, None, None
    for automaton in automata(benchmark, window, block):
        if last is not None:
            shared = sc.broadcast(last)

            def track(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows, hits = [], []
                    for i, text in enumerate(text_bytes(batch["text"])):
                        hit, names = found_by(shared.value, words_of(text))
                        if hit.any():
                            rows.append(i)
                            hits.append({"spans": [{"start": int(a), "end": int(b)} for a, b in zip(*runs(hit))], "names": sorted(names)})
                    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("names", pa.list_(pa.string()))])
                    own = pa.array(hits, type=kind)
                    yield pa.RecordBatch.from_arrays([batch["t"].take(pa.array(rows, type=pa.int64())), own.field("spans"), own.field("names")], names=["t", "spans", "names"])

            found = written(map_arrow(docs.select(text_digest().alias("t"), "text"), track, "t binary, " + HITS).dropDuplicates(["t"]), "hits")
            earlier = found if earlier is None else earlier.unionByName(found)
            shared.destroy()
        last = automaton
    if earlier is None:
        return docs.withColumn("earlier", F.lit(None).cast(f"struct<spans:array<struct<start:long,end:long>>,names:array<string>>")), last
    per = earlier.groupBy("t").agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names")).alias("earlier"))
    return docs.withColumn("u", text_digest()).join(per, F.col("u") == F.col("t"), "left").drop("u", "t"), last


def all_hits(text: bytes, earlier: dict | None, last: Automaton | None) -> tuple[np.ndarray, set[str]]:
    words = words_of(text)
    hit, names = found_by(last, words) if last else (np.zeros(len(words), dtype=bool), set())
    for s in earlier["spans"] if earlier else ():
        hit[s["start"] : s["end"]] = True
    return hit, names | set(earlier["names"] if earlier else ())


def over_limit(hit: np.ndarray) -> bool:
    n = int(hit.sum())
    return n > 0 and COVERAGE * n >= len(hit)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word places of the hit runs)."""
    docs, last = each_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, block)
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def track(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, earlier in zip(text_bytes(batch["text"]), batch["earlier"].to_pylist()):
                hit, names = all_hits(text, earlier, shared.value)
                digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                out.append((len(hit), int(hit.sum()), len(names), digest, over_limit(hit), [{"start": int(x), "end": int(y)} for x, y in zip(*runs(hit))]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, type=t) for c, t in zip(columns, types))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return map_arrow(docs, track, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>")


def without_spans(text: bytes, hit: np.ndarray, longest: int) -> bytes:
    """The text without its matched spans of `longest` words or more; white space and marks around them stay."""
    long = [(a, b) for a, b in zip(*runs(hit)) if b - a >= longest]
    if not long:
        return text
    inside = np.frombuffer(text.translate(_NORMAL), dtype=np.uint8) != 0x20
    begins, ends = runs(inside)
    out, at = [], 0
    for a, b in long:
        out.append(text[at : begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS, longest: int = LONG_SPAN) -> DataFrame:
    """docs without those whose hit words reach the coverage limit; the others lose matched spans of `longest` words or
    more, and n_chars, where there is one, follows. Clean documents pass unchanged; with one block, rows never leave their
    task."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    rows, last = each_block(rows, benchmark, window, block)
    shared = docs.sparkSession.sparkContext.broadcast(last)
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            for raw, earlier in zip(text_bytes(batch["text"]), batch["earlier"].to_pylist()):
                hit, _ = all_hits(raw, earlier, shared.value)
                kept.append(not over_limit(hit))
                texts.append(without_spans(raw, hit, longest) if kept[-1] and hit.any() else raw)
            columns = batch["row"].flatten()
            columns[at] = pa.array([x.decode() if v else None for x, v in zip(texts, batch["text"].is_valid().to_pylist())], type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept, type=pa.bool_()))

    out = map_arrow(rows, keep, docs.schema)
    if "n_chars" not in names:
        return out
    chars: Column = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
