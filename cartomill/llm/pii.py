"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each value found is a protected entity c.
A term t near it gives it away as far as their co-occurrence says: with pointwise mutual information I(c; t) = log(N *
n(c, t) / (n(c) * n(t))) and c's own information -log(n(c) / N), the disclosure is their ratio, at most 1. All four count
different texts, so copies change nothing: n(c, t) those with t within CONTEXT words of c, n(c) and n(t) those that hold
c or t anywhere, N all. A term that discloses more than REMOVE is removed from the documents that hold c, one above
GENERALISE is replaced by its general class.

Evidence is needed too: of m different contexts of c (the words around it; a passage that several texts share is one), k
with t must be two or more and unlikely by chance. The chance that k of m hold t is at most (m / k * e * n(t) / N) ** k,
which is exp(-k * (log(k * N / (m * n(t))) - 1)); it must be under CHANCE. So two contexts are enough for a rare term,
and a frequent one needs more.

Each text's different terms are shuffled, so that those of copies are counted once; besides, only co-occurrence rows are,
summed in each task first. Texts are read again only for the documents that hold a disclosing term.

Edge cases: a null text is empty; empty texts have no spans; rows that repeat are returned each, and count once; very
long texts are searched whole; of terms that tie, each counts; no documents give no rows; other columns are ignored by
personal_data() and kept, whatever their names, by sanitised().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, map_arrow, text_digest, written

CONTEXT = 8
MIN_CONTEXTS, CHANCE = 2, 0.001
GENERALISE, REMOVE = 0.7, 0.85
KINDS = ("email", "ip", "card", "phone")

# A fixed format for each kind. Possessive repeats: what they take could match no other way.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is the longest run of local characters before an @, and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; ordered."""
    found = [(a, 0, b) for a, b in emails(text)]
    if text.count(".") > 2:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found)


def written_out(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def entity(kind: int, value: str) -> int:
    """A 64-bit name of a protected value; separators don't count in numbers."""
    value = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}".encode()) - (1 << 63)


def is_term(word: str) -> bool:
    return len(word) >= 3 and not word.isdigit()


def words_before(text: str, end: int, n: int) -> list[str]:
    """The last n words before a place, whole however long they are."""
    size = 24 * n
    while True:
        begin = max(0, end - size)
        found = [m.group() for m in _TERM.finditer(text, begin, end)]
        if begin and found and _TERM.match(text[begin - 1]) and _TERM.match(text[begin]):
            found = found[1:]  # it begins before
        if len(found) >= n or not begin:
            return found[-n:]
        size *= 2


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str]]]:
    """Of each span: its entity, a hash of its context, and the terms in it."""
    out = []
    for a, kind, b in spans:
        left = [w.lower() for w in words_before(text, a, CONTEXT)]
        right = [m.group().lower() for m in islice(_TERM.finditer(text, b), CONTEXT)]
        seen = xxhash.xxh64_intdigest(" ".join([*left, "\0", *right]).encode()) - (1 << 63)
        out.append((entity(kind, text[a:b]), seen, sorted({w for w in left + right if is_term(w)})))
    return out


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and t, 128 bits of the text's SHA-256: rows of one text have the same spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), text).withColumn("t", text_digest())


FOUND = "t binary, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, contexts array<struct<c:long,seen:long,terms:array<string>>>"


def found_base(docs: DataFrame) -> DataFrame:
    """t, doc_id, a count of each kind, the base spans and their contexts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("c", pa.int64()), ("seen", pa.int64()), ("terms", pa.list_(pa.string()))]))
        for batch in batches:
            counts, bases, near = [], [], []
            for text in batch["text"].to_pylist():
                spans = base_spans(text or "")
                n = Counter(k for _, k, _ in spans)
                counts.append([n[k] for k in range(len(KINDS))])
                bases.append(written_out([(a, KINDS[k], b) for a, k, b in spans]))
                near.append([{"c": c, "seen": s, "terms": t} for c, s, t in contexts(text or "", spans)])
            table = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch["t"], batch["doc_id"], *(pa.array(table[:, k]) for k in range(len(KINDS))), pa.array(bases, type=pa.string()), pa.array(near, type=kind)],
                names=["t", "doc_id", *(f"n_{k}" for k in KINDS), "base", "contexts"],
            )

    return map_arrow(docs.select("t", "doc_id", "text"), f, FOUND)


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n: in how many different texts each term is, over whole texts."""

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [" ".join(sorted(filter(is_term, set(_TERM.findall((text or "").lower()))))) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["t"], pa.array(terms, type=pa.string())], names=["t", "terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), type=pa.string()), pa.array(list(n.values()), type=pa.int64())], names=["term", "n"])

        for batch in batches:
            for terms in batch["terms"].to_pylist():
                n.update(terms.split())
            if len(n) > 200_000:
                yield out()
                n.clear()
        yield out()

    once = map_arrow(docs.select("t", "text"), different, "t binary, terms string").dropDuplicates(["t"])
    return map_arrow(once.select("terms"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """c, term, remove: the terms that give an entity away, and whether they must go (or be generalised)."""
    total = float(max(found.select("t").distinct().count(), 2))
    seen = found.select("t", F.explode("contexts").alias("x")).select("t", "x.*").dropDuplicates(["t", "c", "seen"])
    of_entity = seen.groupBy("c").agg(F.count_distinct("t").alias("n_c"), F.count_distinct("seen").alias("m"))
    near = seen.select("t", "c", "seen", F.explode("terms").alias("term"))
    pairs = near.groupBy("c", "term").agg(F.count_distinct("t").alias("n_ct"), F.count_distinct("seen").alias("k")).where(F.col("k") >= MIN_CONTEXTS)
    joined = pairs.join(of_entity, "c").join(term_counts(docs), "term").withColumn("n", F.greatest("n", "n_ct"))
    ratio: Column = F.log(F.lit(total) * F.col("n_ct") / (F.col("n_c") * F.col("n"))) / F.log(F.lit(total + 1) / F.col("n_c"))
    evidence = F.col("k") * (F.log(F.lit(total) * F.col("k") / (F.col("m") * F.col("n"))) - 1)
    found = joined.where(evidence > -math.log(CHANCE)).select("c", "term", ratio.alias("disclosure"))
    return found.where(F.col("disclosure") > GENERALISE).select("c", "term", (F.col("disclosure") > REMOVE).alias("remove"))


def document_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """kt, terms: for the texts that hold an entity, the terms that give it away."""
    telling = written(disclosing(docs, found), "disclosing")  # a table of its own: the join can split an entity that most texts hold
    holds = found.select(F.col("t").alias("kt"), F.explode(F.array_distinct(F.col("contexts.c"))).alias("c"))
    per = holds.join(telling, "c").groupBy("kt", "term").agg(F.max("remove").alias("remove"))
    out = written(per.groupBy("kt").agg(F.collect_list(F.struct("term", "remove")).alias("terms")), "terms")
    forgotten(telling)
    return out


def term_spans(text: str, terms: dict[str, bool], base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """Where the terms are, outside the base spans; kind: term (general class instead) or removed."""
    inside = np.zeros(len(text) + 1, dtype=bool)
    for a, _, b in base:
        inside[a:b] = True
    return [(m.start(), "removed" if terms[m.group().lower()] else "term", m.end()) for m in _TERM.finditer(text) if m.group().lower() in terms and not inside[m.start() : m.end()].any()]


def all_spans(text: str, terms: dict[str, bool]) -> list[tuple[int, str, int]]:
    base = base_spans(text)
    order = {k: i for i, k in enumerate([*KINDS, "removed", "term"])}
    return sorted([(a, KINDS[k], b) for a, k, b in base] + (term_spans(text, terms, base) if terms else []), key=lambda s: (s[0], order[s[1]]))


def general(word: str) -> str:
    return "[number]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[term]"


def clean(text: str, terms: dict[str, bool]) -> str:
    """The text with base spans named by kind, disclosing terms generalised or left out. Overlapping spans are one."""
    out, at = [], 0
    for a, kind, b in all_spans(text, terms):
        if a >= at:
            out.append(text[at:a])
            out.append("" if kind == "removed" else general(text[a:b]) if kind == "term" else f"[{kind}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each kind, base_sha256, spans."""
    docs = with_key(docs)
    found = written(found_base(docs), "personal")
    # texts are read again only for those that have such terms
    again = docs.join(document_terms(docs, found), F.col("t") == F.col("kt")).select("t", "text", "terms").dropDuplicates(["t"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [written_out(all_spans(text, {t["term"]: t["remove"] for t in terms})) for text, terms in zip(batch["text"].to_pylist(), batch["terms"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["t"], pa.array(spans, type=pa.string())], names=["kt", "spans"])

    more = written(map_arrow(again, f, "kt binary, spans string"), "spans")
    return found.join(more, F.col("t") == F.col("kt"), "left").select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.coalesce("spans", "base").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data and what gives it away taken out of text; n_chars follows, where there is one. Other columns,
    whatever their names, stay as they are."""
    keyed = with_key(docs)
    found = written(found_base(keyed), "personal")
    terms = document_terms(keyed, found)
    forgotten(found)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("t", F.when(F.col("text").isNotNull(), text_digest()))
    joined = rows.join(terms, F.col("t") == F.col("kt"), "left").select("row", "text", "terms")
    names, at = docs.columns, docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if text is None else clean(text, {t["term"]: t["remove"] for t in terms or ()}) for text, terms in zip(batch["text"].to_pylist(), batch["terms"].to_pylist())]
            columns = batch["row"].flatten()
            columns[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = map_arrow(joined, f, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
