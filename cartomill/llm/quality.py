"""Quality rules: counts of a text's words, symbols and repetitions, and its perplexity under a model of its language.

The model is a modified Kneser-Ney model over characters, of order ORDER, one for each language. Its alphabet is open:
characters are code points, folded only in case, digits and control characters; runs of one mark count as one. What it
gathers grows with the corpus:

* Texts are taken in units of one language, of bounded size but for a single long text. A unit's different n-grams are
  sorted codes with their counts, dealt by their hash to partitions, and there summed over all units.
* From the n-grams, Spark computes continuation counts, discounts and interpolated probabilities, level by level, with
  groupings and joins on the n-grams' prefixes and suffixes.
* A partition of the model is an array of sorted n-gram hashes (64 bits) with their probabilities. Each unit's codes are
  looked up in it, and the probabilities go back to the unit, which scores its texts. No task holds more of the model
  than one partition or one unit needs, and nothing is broadcast.

Probabilities are kept in steps of 1 / 1024 of the logarithm, so a text's sum is exact, whatever the order.

A document's perplexity must lie in the band of its language, (median - BAND * (median - 10 %), median + BAND * (90 % -
median)) in the logarithm, but at least LEAST_HALF to either side. Short texts vary more than long ones, so a language has
a band for each doubling of the length, or one for all lengths where fewer than FEW documents have a length. Quantiles
are exact, of scores in steps of 1 / STEPS, over all documents that pass the base rules.

Edge cases: null and blank texts have no words, fail the base rules and are not kept; a null language is a language of
its own, and any number of languages costs the same; very long texts are units of their own, in memory that follows the
text; scores at a band's edge are inside; rows that repeat are counted and returned each; no documents give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import bucketed, documents, forgotten, map_arrow, mixed, text_bytes, written

ORDER = 5
BAND = 2.5
#: Half the least width of a band, in the logarithm.
LEAST_HALF = 0.08
FEW = 50
STEPS = 1000
MIN_WORDS = 50
MOST_REPEATED = 50
#: Characters of a unit.
UNIT = 2_000_000
#: Steps of a logarithmic probability.
FINE = 1024
#: Stands ORDER - 1 times before each text.
PAD = 2

_folded: tuple[np.ndarray, np.ndarray] | None = None


def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it counts as, and whether repeats of that are kept (those of letters, digits and PAD)."""
    global _folded
    if _folded is None:
        to = np.arange(0x110000, dtype=np.uint32)
        kept = np.zeros(0x110000, dtype=bool)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                kept[ord(c)] = True
                if len(low := c.lower()) == 1:
                    to[ord(c)] = ord(low)
            elif c.isdecimal():
                kept[ord(c)], to[ord(c)] = True, ord("0")
        to[:32], to[10], to[127] = 32, 10, 32
        to[PAD], kept[PAD] = PAD, True
        _folded = to, kept
    return _folded


def points_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, each after ORDER - 1 times PAD; and how many of its own each text has."""
    to, keeps = folding()
    space = bytes([PAD])
    clean = [t.replace(space, b" ") if space in t else t for t in texts]
    pad = space * (ORDER - 1)
    points = to[np.frombuffer((pad + pad.join(clean)).decode().encode("utf-32-le"), dtype=np.uint32)]
    stays = np.ones(len(points), dtype=bool)
    stays[1:] = (points[1:] != points[:-1]) | keeps[points[1:]]
    points = points[stays]
    pads = np.flatnonzero(points == PAD)[ORDER - 2 :: ORDER - 1]
    return points, np.diff(np.append(pads, len(points) + ORDER - 2)) - (ORDER - 1)


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each character; the different codes, ascending, with their counts and their
    n-grams (code points)."""
    alphabet = np.unique(points)
    number = np.zeros(int(alphabet[-1]) + 1, dtype=np.int32)
    number[alphabet] = np.arange(len(alphabet))
    symbols, n = number[points], len(points) - ORDER + 1
    bits = max(1, (len(alphabet) - 1).bit_length())
    ends = points[ORDER - 1 :] != PAD
    if bits * ORDER <= 63:
        codes = np.zeros(n, dtype=np.int64)
        for k in range(ORDER):
            codes <<= bits
            codes |= symbols[k : k + n]
        codes = codes[ends]
        parts = [np.unique(codes[a : a + (1 << 22)], return_counts=True) for a in range(0, len(codes), 1 << 22)]
        different, counts = parts[0] if parts else (codes, codes)
        if len(parts) > 1:
            different, where = np.unique(np.concatenate([u for u, _ in parts]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        grams = alphabet[np.stack([different >> bits * (ORDER - 1 - k) & (1 << bits) - 1 for k in range(ORDER)], axis=1)]
    else:  # many characters: codes are ranks, a symbol longer in each step
        codes = symbols[:n].astype(np.int64)
        for k in range(1, ORDER):
            codes = np.unique(codes * len(alphabet) + symbols[k : k + n], return_inverse=True)[1]
        codes, at = codes[ends], np.flatnonzero(ends)
        different, first, counts = np.unique(codes, return_index=True, return_counts=True)
        grams = points[at[first][:, None] + np.arange(ORDER)]
    return codes, different, counts, grams


def gram_hashes(lang: str, grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), xxhash.xxh64_intdigest(lang.encode()), dtype=np.uint64)
    for k in range(ORDER):
        h = mixed(h ^ grams[:, k].astype(np.uint64))
    return h


def dealt(h: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each hash, by its upper bits."""
    return ((h >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


#: Compressors of a worker, made once: a context takes megabytes.
_SMALL, _LARGE, _OPEN = zstandard.ZstdCompressor(level=5), zstandard.ZstdCompressor(level=7), zstandard.ZstdDecompressor()


def pressed(data: bytes, large: bool = False) -> bytes:
    return (_LARGE if large else _SMALL).compress(data)


def unpressed(data: bytes) -> bytes:
    return _OPEN.decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Numbers by their bytes of one rank each, which compresses well; the highest ranks, where all are 0, left out."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    width = int(np.flatnonzero(raw.any(axis=1)).max(initial=0)) + 1
    return bytes([width]) + raw[:width].tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    raw = np.zeros((8, n), dtype=np.uint8)
    raw[: data[0]] = np.frombuffer(data, dtype=np.uint8, offset=1, count=data[0] * n).reshape(-1, n)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def squeezed(grams: np.ndarray) -> bytes:
    """N-grams, in order: their alphabet, and the differences of their codes in it."""
    alphabet, number = np.unique(grams, return_inverse=True)
    number, bits = number.reshape(-1, ORDER).astype(np.uint64), max(1, (len(alphabet) - 1).bit_length())
    parts = [ORDER] if bits * ORDER <= 64 else [3, ORDER - 3]  # 3 code points fit whatever the alphabet
    out, first = [np.array([len(alphabet)], dtype="<u4").tobytes(), alphabet.astype("<u4").tobytes()], 0
    for k in parts:
        code = np.zeros(len(grams), dtype=np.uint64)
        for j in range(first, first + k):
            code = code << np.uint64(bits) | number[:, j]
        out.append(planes(np.diff(code, prepend=np.uint64(0))))
        first += k
    return pressed(b"".join(out))


def opened(data: bytes, n: int) -> np.ndarray:
    raw = unpressed(data)
    size = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    alphabet, at = np.frombuffer(raw, dtype="<u4", count=size, offset=4), 4 + 4 * size
    bits = max(1, (size - 1).bit_length())
    columns: list[np.ndarray] = []
    for k in [ORDER] if bits * ORDER <= 64 else [3, ORDER - 3]:
        code = np.cumsum(from_planes(raw[at:], n), dtype=np.uint64)
        at += 1 + raw[at] * n
        columns += [alphabet[(code >> np.uint64(bits * (k - 1 - j)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for j in range(k)]
    return np.stack(columns, axis=1)


UNITS = "unit long, part int, lang string, size long, grams binary, counts binary"


def units(docs: DataFrame, partitions: int) -> DataFrame:
    """Of each unit a row with its documents (part -1, in `grams`), and one for each partition with its n-grams and counts."""

    def rows(unit: int, lang: str, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        own = pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(texts, type=pa.binary())], names=["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as stream:
            stream.write_batch(own)
        out = [(unit, -1, lang, own.num_rows, pressed(sink.getvalue(), large=True), None)]
        _, different, counts, grams = ngrams(points_of(texts)[0])
        part = dealt(gram_hashes(lang, grams), partitions)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(partitions + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[p] : cuts[p + 1]]
            out.append((unit, p, lang, len(at), squeezed(grams[at]), pressed(planes(counts[at]))))
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["unit", "part", "lang", "size", "grams", "counts"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 33
        held: dict[str, tuple[list, list[bytes]]] = {}
        size: Counter[str] = Counter()
        for batch in batches:
            for doc_id, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), text_bytes(batch["text"])):
                lang = "-" if lang is None else f"+{lang}"
                if size[lang] and size[lang] + len(text) > UNIT or sum(size.values()) > 2 * UNIT:
                    full = lang if size[lang] + len(text) > UNIT and size[lang] else max(size, key=size.get)
                    yield rows(unit, full, *held.pop(full))
                    unit += 1
                    del size[full]
                own = held.setdefault(lang, ([], []))
                own[0].append(doc_id)
                own[1].append(text)
                size[lang] += len(text)
        for lang, own in held.items():
            yield rows(unit, lang, *own)
            unit += 1

    return map_arrow(docs, f, UNITS)


def gram_counts(found: DataFrame, partitions: int) -> DataFrame:
    """part, lang, h, gram, n: each n-gram of the corpus, summed over the units."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        now, size = None, 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.zeros(len(h), dtype=np.int64)
            np.add.at(n, where, np.concatenate([p[2] for p in parts]))
            return h, np.concatenate([p[1] for p in parts])[first], n

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, grams, n = merged(parts)
                for a in range(0, len(h), 50_000):
                    text = np.ascontiguousarray(grams[a : a + 50_000].astype("<u4")).view(f"<U{ORDER}").ravel().tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), now, dtype=np.int32)), pa.array([lang] * len(text), type=pa.string()), pa.array(h[a : a + 50_000].view(np.int64)), pa.array(text, type=pa.string()), pa.array(n[a : a + 50_000])], names=["part", "lang", "h", "gram", "n"])
            held.clear()

        for batch in batches:
            for part, lang, n, grams, counts in zip(*(batch[c].to_pylist() for c in ("part", "lang", "size", "grams", "counts"))):
                if part != now:
                    yield from out()
                    now, size = part, 0
                points = opened(grams, n)
                held[lang].append((gram_hashes(lang, points), points, from_planes(unpressed(counts), n).astype(np.int64)))
                size += n
                if size > 4 << 20:
                    for key in list(held):
                        held[key] = [merged(held[key])]
                    size = sum(len(x[0]) for parts in held.values() for x in parts) // 2  # merges stay rare as the table grows
        yield from out()

    own = found.where("part >= 0").select("part", "lang", "size", "grams", "counts")
    return map_arrow(own.repartitionByRange(partitions, "part").sortWithinPartitions("part"), f, "part int, lang string, h long, gram string, n long")


def probabilities(counts: DataFrame) -> DataFrame:
    """part, h, logp: the natural logarithm of each n-gram's last character after its context, negative, in steps."""
    levels, tables = {ORDER: counts.select("lang", "gram", F.col("n").alias("c"))}, []
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters come before
        levels[k] = written(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "level")
        tables.append(levels[k])
    lower = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    for k in range(1, ORDER + 1):
        of = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        rest = levels[k].groupBy("lang").agg(*of).withColumn("y", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))
        d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.01), F.coalesce(F.when(F.col(f"n{i}") > 0, i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}")), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
        own = levels[k].join(rest.select("lang", *d), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        own = own.select("lang", "gram", "c", "d", F.substring("gram", 1, k - 1).alias("context"))
        totals = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        p = ((F.col("c") - F.col("d")) + F.col("left") * F.col("p")) / F.col("total")
        found = own.join(totals, ["lang", "context"]).withColumn("end", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("end"), "p"), ["lang", "end"])
        lower = written(found.select("lang", "gram", p.alias("p")), "probabilities")
        tables.append(lower)
    out = counts.select("part", "lang", "gram", "h").join(lower, ["lang", "gram"]).select("part", "h", F.round(-F.log("p") * FINE).cast("int").alias("logp"))
    out = written(out, "model")
    forgotten(*tables)
    return out


def answers(found: DataFrame, model: DataFrame, partitions: int) -> DataFrame:
    """unit, answers (part, logp): the probabilities of each unit's n-grams, in the order of its codes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], (np.empty(0, np.uint64), np.empty(0, np.int32))
        for batch in batches:
            out: list[tuple] = []
            part, asks = batch["part"].to_numpy(), batch["unit"].is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if part[a] != now:
                    now, parts, table = part[a], [], (np.empty(0, np.uint64), np.empty(0, np.int32))
                if not asks[a]:
                    parts.append((batch["h"].slice(a, b - a).to_numpy().view(np.uint64), batch["logp"].slice(a, b - a).to_numpy()))
                    continue
                if parts:
                    h, logp = (np.concatenate(x) for x in zip(*parts, *([table] if len(table[0]) else [])))
                    order = np.argsort(h)
                    parts, table = [], (h[order], logp[order])
                own = batch.slice(a, b - a)
                for unit, lang, n, grams in zip(*(own[c].to_pylist() for c in ("unit", "lang", "size", "grams"))):
                    at = np.searchsorted(table[0], gram_hashes(lang, opened(grams, n)))
                    out.append((unit, int(now), pressed(planes(table[1][at])), n))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["unit", "part", "logp", "size"])

    null = lambda kind: F.lit(None).cast(kind)
    asked = found.where("part >= 0").select("part", "unit", "lang", "size", "grams", null("long").alias("h"), null("int").alias("logp"))
    known = model.select("part", null("long").alias("unit"), null("string").alias("lang"), null("long").alias("size"), null("binary").alias("grams"), "h", "logp")
    both = known.unionByName(asked).repartitionByRange(partitions, "part").sortWithinPartitions("part", F.col("unit").asc_nulls_first())
    return written(map_arrow(both, f, "unit long, part int, logp binary, size long"), "answers")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    starts = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= starts
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    return len(words), chars, len(text.translate(None, _NOT_SYMBOLS)), duplicate_lines(text), repeated_words(words)


def scored(found: DataFrame, replies: DataFrame, partitions: int) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, length (doublings) and log_perplexity (null for an empty text)."""
    per = replies.groupBy(F.col("unit").alias("asked")).agg(F.collect_list(F.struct("part", "logp", "size")).alias("replies"))
    joined = found.where("part = -1").select("unit", "lang", "grams").join(per, F.col("unit") == F.col("asked"), "left").select("lang", "grams", "replies")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, packed, replies in zip(*(batch[c].to_pylist() for c in ("lang", "grams", "replies"))):
                own = pa.ipc.open_stream(unpressed(packed)).read_next_batch()
                texts = text_bytes(own["text"])
                points, lengths = points_of(texts)
                ppl = np.full(len(texts), np.nan)
                if replies and lengths.any():
                    codes, different, _, grams = ngrams(points)
                    order = np.argsort(dealt(gram_hashes(lang, grams), partitions), kind="stable")
                    logp = np.empty(len(different), dtype=np.int64)
                    logp[order] = np.concatenate([from_planes(unpressed(r["logp"]), r["size"]).astype(np.int64) for r in sorted(replies, key=lambda r: r["part"])])
                    some, starts = lengths > 0, np.cumsum(lengths) - lengths
                    for a in range(0, len(codes), 1 << 19):  # in place: codes become probabilities
                        codes[a : a + (1 << 19)] = logp[np.searchsorted(different, codes[a : a + (1 << 19)])]
                    ppl[some] = np.add.reduceat(codes, starts[some]) / lengths[some] / FINE
                base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(BASE))
                doublings = np.frexp(lengths.astype(float))[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], pa.array([None if lang == "-" else lang[1:]] * len(texts), type=pa.string()), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(doublings), pa.array(ppl, mask=np.isnan(ppl))],
                    names=["doc_id", "lang", *BASE, "length", "log_perplexity"],
                )

    out = map_arrow(joined, f, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in BASE) + ", length int, log_perplexity double")
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def band(scores: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, docs, lowest, highest: from exact quantiles of the scores' steps, which are few whatever the corpus."""
    steps = scores.where("NOT base_failed AND log_perplexity IS NOT NULL").groupBy(*by, F.round(F.col("log_perplexity") * STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("step"))
    every = F.sum("n").over(Window.partitionBy(*by))
    q = [F.min(F.when(F.col("upto") >= share * F.col("every"), F.col("step") / STEPS)).alias(f"q{i}") for i, share in enumerate((0.1, 0.5, 0.9))]
    found = steps.select(*by, "step", upto.alias("upto"), every.alias("every")).groupBy(*by).agg(*q, F.max("every").alias("docs"))
    return found.select(*by, "docs", F.expr(f"q1 - greatest({LEAST_HALF}D, {width}D * (q1 - q0))").alias("lowest"), F.expr(f"q1 + greatest({LEAST_HALF}D, {width}D * (q2 - q1))").alias("highest"))


def bands(scores: DataFrame, width: float = BAND) -> DataFrame:
    """band_lang, band_length, lowest, highest."""
    own = band(scores, ["lang", "length"], width).select(F.col("lang").alias("band_lang"), F.col("length").alias("band_length"), "docs", F.col("lowest").alias("a"), F.col("highest").alias("b"))
    whole = band(scores, ["lang"], width).drop("docs")
    both = own.join(whole, F.col("band_lang").eqNullSafe(F.col("lang")))
    many = F.col("docs") >= FEW
    return both.select("band_lang", "band_length", F.when(many, F.col("a")).otherwise(F.col("lowest")).alias("lowest"), F.when(many, F.col("b")).otherwise(F.col("highest")).alias("highest"))


def quality(docs: DataFrame, width: float = BAND) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_perplexity, lowest and highest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = bucketed(units(docs, partitions), "units", "unit")
    counts = written(gram_counts(found, partitions), "ngrams")
    replies = answers(found, probabilities(counts), partitions)
    scores = written(scored(found, replies, partitions), "quality")
    forgotten(found, counts, replies)
    edges = written(bands(scores, width), "bands")
    rows = scores.join(edges, F.col("lang").eqNullSafe(F.col("band_lang")) & (F.col("length") == F.col("band_length")), "left")
    inside = F.coalesce(F.expr(f"round(log_perplexity * {STEPS}) / {STEPS} BETWEEN lowest AND highest"), F.lit(False))
    return rows.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "lowest", "highest")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir, ("doc_id", "text", "lang")))
