"""Language identification as inference on a mixture of languages.

Each language has a multinomial over character trigrams of words (hashed to BUCKETS classes), counted by Spark. Within a
document, words come from its languages in unknown proportions; expectation-maximisation estimates these from the words'
trigram likelihoods. The language set is chosen by penalised likelihood: from all languages, the least is dropped as
long as the document's log-likelihood less PENALTY / 2 * log(words) for each language does not fall.

Bound: the model is fitted on a sample of about TRAIN_ROWS labelled rows, chosen by a hash of doc_id; the model holds
BUCKETS numbers for each language, and so is small enough to broadcast. Words are runs of letters, in lower case.

Edge cases: null texts and texts without a letter (such as "²", "①" or "½") are `und` with score 0; without labelled rows
all are; very long texts are scored whole, in memory that follows the text; ties go to the language that sorts first;
rows that repeat are returned each; other columns are ignored by languages() and kept by
identified().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, chunks, crc_mod, documents, map_arrow, mixed

BUCKETS = 1 << 16
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
ROUNDS = 8
PENALTY = 2.0
SMOOTHING = 0.05
UNKNOWN = "und"

_letters: np.ndarray | None = None
POINTS = 0x110000


def letters() -> np.ndarray:
    """Which code points are letters (as Unicode has them: no digits, fractions, superscripts, signs or emoji)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(POINTS)), dtype=bool, count=POINTS)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams; the place of each word's first trigram; and the text of each word.

    A word of n letters has n trigrams: each letter with its neighbours, which are blanks at the word's ends.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.concatenate([np.zeros(1, dtype=np.uint32), points, np.zeros(1, dtype=np.uint32)])
    is_letter = letters()[points]
    points = np.where(is_letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    first = ~is_letter[at - 1]
    h = (points[at - 1] * np.uint64(0x100000001B3) + points[at]) * np.uint64(0x9E3779B97F4A7C15) + points[at + 1]
    owners = np.searchsorted(np.cumsum(lengths + 1), at[first] - 1, side="right")
    return (mixed(h) >> np.uint64(48)).astype(np.int64), np.flatnonzero(first), owners


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the whole texts of docs (columns lang and text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text.lower())
            for lang, texts in by.items():
                for a, b in chunks([len(t) for t in texts]):
                    found = np.bincount(trigrams(texts[a:b])[0], minlength=BUCKETS)
                    sums[lang] = sums.get(lang, 0) + found
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return map_arrow(docs.select("lang", "text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About `rows` of the labelled rows outside the held-out fold, by a hash of doc_id."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(False)))
    n = docs.where("lang IS NOT NULL").count()
    share = min(1.0, rows / max(1, n))
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))


def model(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and BUCKETS x languages log probabilities."""
    counts = trigram_counts(training_rows(docs, rows)).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    table[counts["bucket"], np.searchsorted(np.array(langs, dtype=object), counts["lang"].to_numpy(dtype=object)) if langs else []] = counts["n"]
    table += SMOOTHING
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def proportions(logs: np.ndarray, owners: np.ndarray, n: int, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of the languages in each of n documents; logs: words x languages, owners: the documents, ascending."""
    langs = logs.shape[1]
    out = np.zeros((n, langs))
    if not len(owners) or not langs:
        return out
    present, starts = np.unique(owners, return_index=True)
    words = np.diff(np.append(starts, len(owners)))
    row = np.repeat(np.arange(len(present)), words)
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs - top, -60.0)).astype(np.float64)

    def fitted(active: np.ndarray, rounds: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = np.where(active, begin + 1e-3, 0.0)
        pi /= pi.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            share = like * pi[row]
            share /= share.sum(axis=1, keepdims=True) + 1e-300
            pi = np.add.reduceat(share, starts, axis=0)
            pi /= pi.sum(axis=1, keepdims=True) + 1e-300
        fit = np.log((like * pi[row]).sum(axis=1) + 1e-300)
        return pi, np.add.reduceat(fit, starts)

    active = np.ones((len(present), langs), dtype=bool)
    pi, fit = fitted(active, ROUNDS, np.full((len(present), langs), 1.0 / langs))
    open_ = active.sum(axis=1) > 1
    cost = penalty / 2 * np.log(words)
    while open_.any():
        least = np.where(active, pi, np.inf)
        drop = langs - 1 - np.argmin(least[:, ::-1], axis=1)  # among equals the last
        trial = active.copy()
        trial[np.arange(len(present)), drop] = ~open_ & active[np.arange(len(present)), drop]
        new_pi, new_fit = fitted(trial, ROUNDS // 2, pi)
        better = open_ & (new_fit + cost >= fit)
        active[better], pi[better], fit[better] = trial[better], new_pi[better], new_fit[better]
        open_ = better & (active.sum(axis=1) > 1)
    out[present] = pi
    return out


def predicted(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    lowered = [(t or "").lower() for t in texts]
    for a, b in chunks([len(t) for t in lowered], CHUNK_BYTES // 2):
        if not langs:
            break
        codes, starts, owners = trigrams(lowered[a:b])
        if not len(starts):
            continue
        logs = np.add.reduceat(table[codes], starts, axis=0)
        pi = proportions(logs, owners, b - a)
        best = pi.argmax(axis=1)
        for i in np.unique(owners):
            names[a + i], scores[a + i] = langs[best[i]], min(1.0, pi[i, best[i]])
    return names, scores


def languages(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, rows))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            names, scores = predicted(batch["text"].to_pylist(), langs, table)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, type=pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    found = map_arrow(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without those that have no language. Rows never leave their task."""
    shared = docs.sparkSession.sparkContext.broadcast(model(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            names, _ = predicted(batch[at].cast(pa.string()).to_pylist(), langs, table)
            yield batch.filter(pa.array([n != UNKNOWN for n in names], type=pa.bool_()))

    # by place: a column's name may hold a dot
    at, plain = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(plain, docs.schema)])
    return map_arrow(docs.toDF(*plain), keep, schema).toDF(*docs.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir, ("doc_id", "text", "lang")))
