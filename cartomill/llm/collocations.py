"""Collocations: the phrases of two to four words that hold together most, for each language, by hierarchical naming.

A text is lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`. Each task packs
what it reads into bundles, one row for about BUNDLE_WORDS words: the bundle's different words of each language, and the
sequence of their places in that list (-1 between pieces). Then, level by level, what is frequent gets a name:

1. a word that occurs MIN_COUNT times or more in its language gets an id;
2. the sequence's words are replaced by ids, rare ones by -1, and each bundle lists its different adjacent pairs of ids
   with their counts; pairs that are frequent over all bundles get ids of their own (level 2);
3. adjacent pair ids, which overlap in a word, make the names of three words, and those the names of four.

A phrase is frequent only if its parts are, so nothing is lost. A name's row points to its two parents, the phrases
without the last and without the first word; joins along these pointers give the counts of both sides of each cut, and
carry the count of a longer phrase down to all that it contains.

What is shuffled: for each level, the different pairs of each bundle (which combines before), as one row for each left half
with its right halves and counts packed, and the frequent ones of these, back to their bundle, which stays in its bucket.
A word or pair is at most once in a bundle, and a frequent left half is parted by its right halves, so no key is hot.
Nothing is broadcast, and a task holds one bundle, or the pairs of one part of a left half. Counts are whole numbers, products are decimals of 38 digits.

Edge cases: a null or blank text has no words; a null lang is `und`, like the text `und`; a piece of any length counts
whole (long sequences are cut with three words of overlap); repeated rows count as often as they are there; phrases of
equal score and count are ranked by their bytes; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, documents, forgotten, map_arrow, shuffles_collected, text_bytes, written

MIN_COUNT = 30
LONGEST = 4
#: A phrase goes if a longer one that contains it has this many hundredths of its count.
SUBSUMED = 80
SCALE = 2_000_000
TOP = 2_000
BUNDLE_WORDS = 3 << 19
#: A left half of so many pairs, as a power of two, is parted once more.
PART_BITS = 20
#: Places of one bundle; a name is a bundle's number and a place in it.
PLACE_BITS = 24

# a separator becomes a full stop, which can be no word; the rest of what bytes.split() splits at is space and tab
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words, and b"." between pieces and at the end."""
    return [*text.lower().translate(_SEPARATORS).replace(b".", b" . ").split(), b"."]


class Places(dict):
    """The places of one language's words in a bundle; a new word gets the next. The mark between pieces has none."""

    def __init__(self, next_place: Iterator[int]):
        super().__init__({b".": -1})
        self.next_place = next_place

    def __missing__(self, word: bytes) -> int:
        self[word] = place = next(self.next_place)
        return place


def bundled(docs: DataFrame, size: int) -> DataFrame:
    """bundle, own (phrases that start at a later place are another bundle's), seq (stored()), words, langs, counts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 12
        held: dict[str, Places] = {}
        next_place, seq = count(), array("i")

        def row(seq: np.ndarray, own: int, words: pa.Array, langs: pa.Array) -> pa.RecordBatch:
            nonlocal number
            number += 1
            first = seq[:own]
            counts = np.bincount(first[first >= 0], minlength=len(words))
            arrays = [stored(seq.astype(np.int64)), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, langs, pa.array(counts, pa.int64())))]
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([own]), *arrays], names=["bundle", "own", "seq", "words", "langs", "counts"])

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal next_place, seq
            tongues = list(held)
            words, langs = [b""] * sum(len(d) - 1 for d in held.values()), np.zeros(sum(len(d) - 1 for d in held.values()), dtype=np.int32)
            for i, places in enumerate(held.values()):
                for word, place in places.items():
                    if place >= 0:
                        words[place], langs[place] = word, i
            words, langs = pa.array(words, pa.binary()).cast(pa.string()), pa.array(tongues, pa.string()).take(pa.array(langs))
            whole = np.frombuffer(seq, dtype=np.int32)
            if len(whole) <= 2 * size:
                yield row(whole, len(whole), words, langs)
            else:  # a very long text
                for a in range(0, len(whole), size):
                    used, part = np.unique(whole[a : a + size + LONGEST - 1], return_inverse=True)
                    marks = int(used[0] < 0)
                    yield row((part - marks).astype(np.int32), min(size, len(whole) - a), *(x.take(pa.array(used[marks:])) for x in (words, langs)))
            held.clear()
            next_place, seq = count(), array("i")

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), text_bytes(batch["text"])):
                lang = "und" if lang is None else lang
                if lang not in held:
                    held[lang] = Places(next_place)
                seq.extend(map(held[lang].__getitem__, tokens(text)))
                if len(seq) >= size:
                    yield from flushed()
        if seq:
            yield from flushed()

    return map_arrow(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), f, "bundle long, own long, seq binary, words array<string>, langs array<string>, counts array<long>")


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in as few bytes as they need, seven bits each, and how many these are."""
    x = x.astype(np.uint64)
    n = np.ones(len(x), dtype=np.int64)
    for k in range(7, 64, 7):
        n += x >= np.uint64(1 << k)
    at, out = np.cumsum(n) - n, np.empty(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = (x[has] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(n[has] > k + 1, 128, 0).astype(np.uint8)
    return out, n


def numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What varints() has written, and where each number ends."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    length, out = ends - starts + 1, np.zeros(len(ends), dtype=np.uint64)
    for k in range(int(length.max(initial=0))):
        has = np.flatnonzero(length > k)
        out[has] |= (data[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64), ends


def packed(x: np.ndarray, heads: np.ndarray) -> pa.Array:
    """A binary value for each part of x, of those that begin at heads."""
    data, n = varints(x)
    ends = np.append(0, np.cumsum(n))
    offsets = ends[np.append(heads, len(x))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of packed(), and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, dtype=np.uint8)
    found, ends = numbers(data)
    return found, np.diff(np.searchsorted(ends, offsets - offsets[0]))


def stored(seq: np.ndarray) -> pa.Array:
    """A sequence of places, in which -1 is a mark, as one binary value; frequent words have small places, and so few bytes."""
    return pa.array([varints(seq + 1)[0].tobytes()], pa.binary())


def read_again(value: pa.Scalar) -> np.ndarray:
    return numbers(np.frombuffer(value.as_buffer(), dtype=np.uint8))[0] - 1


def joined_up(pairs: DataFrame) -> DataFrame:
    """The next level's bundles, of rows bundle, own, seq, and the frequent entries' places, ids and parts: seq, the places
    of adjacent pairs, and lists of their different pairs, one element for each left half (id) and part: the place of its
    first pair, the right halves (ids, ascending, as differences) and the counts. A left half has as many parts as its
    count says, so what meets of one left half over all bundles stays bounded."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch["own"][i].as_py()
                seq = read_again(batch["seq"][i])
                places, ids, parts = (batch[c][i].values.to_numpy() for c in ("places", "ids", "parts"))
                order = np.argsort(ids)
                places, ids, parts = places[order], ids[order], parts[order]
                m = len(ids)
                compact = np.full(max(int(seq.max(initial=0)), int(places.max(initial=0))) + 2, -1, dtype=np.int64)
                compact[places] = np.arange(m)
                now = compact[seq]  # -1 finds the last entry, which is -1
                at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
                keys, which = np.unique(now[at] * m + now[at + 1], return_inverse=True)
                left, right = keys // m, keys % m
                part = ids[right] % parts[left]
                if part.any():
                    order = np.lexsort((right, part, left))
                    left, right, part = left[order], right[order], part[order]
                    rank = np.empty(len(order), dtype=np.int64)
                    rank[order] = np.arange(len(order))
                    which = rank[which]
                out = np.full(max(len(seq) - 1, 0), -1, dtype=np.int32)
                out[at] = which
                counts = np.bincount(which[at < own], minlength=len(keys))
                heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (part[1:] != part[:-1]))[: len(left)])
                gaps = np.diff(ids[right], prepend=0)
                gaps[heads] = ids[right[heads]]
                lists = [pa.array(ids[left[heads]]), pa.array(part[heads].astype(np.int32)), pa.array(heads.astype(np.int32)), packed(gaps, heads), packed(counts, heads)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([batch["bundle"].slice(i, 1), batch["own"].slice(i, 1), stored(out), *lists], names=["bundle", "own", "seq", "left", "part", "first", "rights", "counts"])

    return map_arrow(pairs.select("bundle", "own", "seq", "places", "ids", "parts"), f, "bundle long, own long, seq binary, left array<long>, part array<int>, first array<int>, rights array<binary>, counts array<binary>")


def parts_of(f: Column) -> Column:
    return (F.shiftright(f, PART_BITS) + 1).cast("int")


def named_words(bundles: DataFrame, least: int) -> DataFrame:
    """Each bundle's words that are frequent over all bundles: own (bundle and place), id (the name, which is the least
    own), parts, and, where own is the id, the language, word and count f; written."""
    own = F.shiftleft("bundle", PLACE_BITS) + F.col("place")
    entries = bundles.select("bundle", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "e")).select(own.alias("own"), F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    over = W.partitionBy("lang", "word")
    found = entries.withColumns({"f": F.sum("n").over(over), "id": F.min("own").over(over)}).where(F.col("f") >= least)
    return written(found.select("own", "id", parts_of(F.col("f")).alias("parts"), *(F.when(F.col("id") == F.col("own"), F.col(c)).alias(c) for c in ("lang", "word", "f"))), "frequent")


def named_pairs(bundles: DataFrame, least: int) -> DataFrame:
    """Like named_words(), of pairs: bundle, and lists of places, ids, parts, and of left, right and f, which are 0 but where
    the entry is the one that the name is of; written. A bundle has some rows of each task."""
    lists = F.inline(F.arrays_zip("left", "part", "first", "rights", "counts"))
    entries = bundles.select("bundle", lists).select((F.shiftleft("bundle", PLACE_BITS) + F.col("first")).alias("own"), "left", "part", "rights", "counts")
    together = entries.repartition("left", "part").sortWithinPartitions("left", "part", "own")

    def counted(left: np.ndarray, part: np.ndarray, own: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """own, id, left, right, f of the entries of frequent pairs."""
        order = np.lexsort((own, right, part, left))
        left, part, own, right, n = (x[order] for x in (left, part, own, right, n))
        heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        size = np.diff(np.append(heads, len(left)))
        f, name = np.repeat(np.add.reduceat(n, heads), size), np.repeat(own[heads], size)
        keep = f >= least
        return np.stack([own, name, left, right, f])[:, keep]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, size = np.empty((5, 0), dtype=np.int64), [], 0

        def listed() -> Iterator[pa.RecordBatch]:
            own, name, left, right, f = np.concatenate(found, axis=1)
            order = np.argsort(own)
            own, name, left, right, f = (x[order] for x in (own, name, left, right, f))
            bundle = own >> PLACE_BITS
            heads = np.flatnonzero(np.append(True, bundle[1:] != bundle[:-1])[: len(bundle)])
            first = own == name
            columns = [(own & ((1 << PLACE_BITS) - 1)).astype(np.int32), name, ((f >> PART_BITS) + 1).astype(np.int32), left * first, right * first, f * first]
            offsets = pa.array(np.append(heads, len(own)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bundle[heads]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)], names=["bundle", "places", "ids", "parts", "left", "right", "f"])

        for batch in batches:
            gaps, length = unpacked(batch["rights"])
            sums, heads = np.cumsum(gaps), np.cumsum(length) - length
            right = sums - np.repeat(sums[heads] - gaps[heads], length)
            k = np.arange(len(gaps)) - np.repeat(heads, length)
            new = np.stack([*(np.repeat(batch[c].to_numpy().astype(np.int64), length) for c in ("left", "part")), np.repeat(batch["own"].to_numpy(), length) + k, right, unpacked(batch["counts"])[0]])
            rest = np.concatenate([rest, new], axis=1)
            if rest.shape[1]:
                whole = np.flatnonzero((rest[0] != rest[0, -1]) | (rest[1] != rest[1, -1]))  # the last group may go on
                if len(whole):
                    found.append(counted(*rest[:, whole]))
                    size, rest = size + found[-1].shape[1], rest[:, len(whole) :]
            if size > 1 << 20:
                yield from listed()
                found, size = [], 0
        if rest.shape[1]:
            found.append(counted(*rest))
        if found:
            yield from listed()

    return written(map_arrow(together, f, "bundle long, places array<int>, ids array<long>, parts array<int>, left array<long>, right array<long>, f array<long>"), "frequent")


def replaced(bundles: DataFrame, frequent: DataFrame) -> DataFrame:
    """The bundles with the places, names and parts of their frequent entries; those without any are at their end."""
    own = F.shiftright("own", PLACE_BITS).alias("bundle")
    if "own" in frequent.columns:
        lists = frequent.groupBy(own).agg(F.collect_list(F.struct(F.col("own").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int").alias("places"), F.col("id").alias("ids"), "parts")).alias("e"))
        columns = [F.col(f"e.{c}").alias(c) for c in ("places", "ids", "parts")]
    else:
        lists = frequent.groupBy("bundle").agg(F.collect_list(F.struct("places", "ids", "parts")).alias("e"))
        columns = [F.flatten(F.col(f"e.{c}")).alias(c) for c in ("places", "ids", "parts")]
    return bundles.select("bundle", "own", "seq").join(lists, "bundle").select("bundle", "own", "seq", *columns)


def names(frequent: DataFrame) -> DataFrame:
    """One row for each name of pairs."""
    own = F.filter(F.arrays_zip("ids", "left", "right", "f"), lambda x: x["f"] > 0)
    return frequent.select(F.inline(own)).withColumnRenamed("ids", "id")


def grown(level: DataFrame, parents: DataFrame) -> DataFrame:
    """The names of a level with their phrase, its last word, and the counts of its first and last word (first_f, last_f),
    of its parents (left_f, right_f) and of the parents' outer parents (outer_l, outer_r)."""

    def side(name: str) -> DataFrame:
        return parents.select(*(F.col(c).alias(f"{name}_{c}") for c in parents.columns))

    both = level.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
    return both.select(
        "id", F.col("l_lang").alias("lang"), "left", "right", "f", F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), F.col("l_first_f").alias("first_f"), F.col("r_last_f").alias("last_f"),
        F.col("l_f").alias("left_f"), F.col("r_f").alias("right_f"), F.col("l_left_f").alias("outer_l"), F.col("r_right_f").alias("outer_r"),
    )


def scored(level: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """lang, phrase, a, l, r, score, by the cut of least score; of equal ones the first."""

    def cut(k: int, l: str, r: str) -> Column:
        value = F.expr(f"(CAST({SCALE} AS DECIMAL(8, 0)) * CAST(f AS DECIMAL(19, 0))) DIV (CAST({l} AS DECIMAL(19, 0)) + CAST({r} AS DECIMAL(19, 0)))")
        return F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    found = [cut(k, l, r) for k, (l, r) in enumerate(cuts)]
    return level.withColumn("cut", F.least(*found) if len(found) > 1 else found[0]).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def standing(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """The names without those that a longer one has nearly always around them. It is enough to look one word further:
    what contains a phrase at a distance is no more frequent than what contains it directly."""
    if longer is None:
        return level
    most = longer.select("f", F.explode(F.array("left", "right")).alias("id")).groupBy("id").agg(F.max("f").alias("around"))
    return level.join(most, "id", "left").where(F.col("around").isNull() | (100 * F.col("around") < SUBSUMED * F.col("f")))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, size: int = BUNDLE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    bundles = bucketed(bundled(docs, size), "bundles", "bundle")
    total = written(bundles.select(F.explode(F.arrays_zip("langs", "counts")).alias("e")).groupBy(F.col("e.langs").alias("lang")).agg(F.sum("e.counts").alias("n")), "totals")
    frequent = named_words(bundles, least)
    word, times, none = F.col("word"), F.col("f"), F.lit(None).cast("long")
    level = frequent.where("id = own").select("id", "lang", "f", word.alias("phrase"), word.alias("last"), times.alias("first_f"), times.alias("last_f"), none.alias("left_f"), none.alias("right_f"))
    level, levels = written(level, "names"), []
    shuffles_collected(docs.sparkSession)
    for k in range(2, LONGEST + 1):
        bundles, used = bucketed(joined_up(replaced(bundles, frequent)), "bundles", "bundle"), [bundles, frequent]
        forgotten(*used)
        shuffles_collected(docs.sparkSession)
        frequent = named_pairs(bundles, least)
        level = written(grown(names(frequent), level), "names")
        levels.append(level)
    forgotten(bundles, frequent)
    cuts = [[("first_f", "last_f")], [("first_f", "right_f"), ("left_f", "last_f")], [("first_f", "right_f"), ("outer_l", "outer_r"), ("left_f", "last_f")]]
    found = [scored(standing(level, longer), c) for level, longer, c in zip(levels, [*levels[1:], None], cuts)]
    both = found[0].unionByName(found[1]).unionByName(found[2])
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: All phrases of one to four words are counted outright, and all cuts and all longer phrases looked at.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
grams AS (
  SELECT lang, w[i : i + k - 1] AS p, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) AS ks)
  GROUP BY lang, w[i : i + k - 1], k),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS c
  JOIN grams AS x ON x.lang = c.lang AND x.p = c.p[1 : cut] JOIN grams AS y ON y.lang = c.lang AND y.p = c.p[cut + 1 : c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, p[i : i + m - 1] AS p, max(f) AS around
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
  GROUP BY lang, p[i : i + m - 1]),
standing AS (
  SELECT b.* FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.p = b.p WHERE i.around IS NULL OR 100 * i.around < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM standing)
JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, ("text", "lang")))
