"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel counts the subsequences of N characters that two strings share, gaps discounted by DECAY for each character
they span, SPAN at most, so that an insult with inserted or separating characters stays near to the plain one. Strings are the units of a sentence: words reduced to letters and digits, single characters in a
row joined (`i d i o t`), long words in overlapping pieces, with a mark where a word begins. LANDMARKS strings from the training sentences span the feature
space (Nystroem: K_zz**-1/2 k_z(x)), in which a linear machine is trained; the landmarks' own vectors are scaled to length
one, which changes the basis of that space and not the kernel.

Labels belong to documents, so the machine is trained as a multiple-instance one: a toxic document is a bag with at
least one toxic unit, its witness, chosen anew in each round; units of other documents are negative. Labels may be wrong:
a toxic document whose best unit is on the clean side has no witness. Units that are far more frequent in toxic documents
are positives too, as those beside a witness would never be one. Copies of the witnesses with inserted characters join
the positives. A text scores by the norm of its units' decision values on the toxic side, or by its most toxic unit where
there are none, through a logistic curve whose middle lets about one clean training document in a hundred pass it.

Bounds: the machine is fitted on about TRAIN_ROWS labelled rows of each class, chosen by a hash of doc_id, one text for a
doc_id and none of over TRAIN_CHARS characters, and on at most TRAIN_UNITS different units of each class and round, of
at most POOL clean ones. All texts are scored, whole.

Edge cases: null, empty and unit-less texts get the score of no evidence; without labels of both classes all get 0;
labels given twice count as toxic if any is; of several texts of a labelled doc_id the one of least hash is used; strings
that tie are taken in their order; very long texts are scored unit by unit; rows that repeat are returned each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, map_arrow

N = 3
DECAY = 0.5
SPAN = 6
LANDMARKS = 80
TRAIN_ROWS = 2_000
TRAIN_CHARS = 20_000
TRAIN_UNITS = 4_000
POOL = 20_000
#: The most telling units, whose pieces may become landmarks.
STEMS = 800
#: How much more often than in other documents a witness must be in toxic ones.
RATE = 5
#: Standard deviations by which a unit must be more frequent in toxic documents to be a positive without being a witness.
SURE = 5.0
PIECE = 24
#: What a false alarm among clean documents costs against a missed toxic one.
ALARM = 8
#: The hinge loss against the squared length of the weight vector.
COST = 1000.0
BEGIN = "\x02"
FOLDS, HELD_OUT = 5, 0
REMEMBERED = 400_000

_NOT_UNIT = re.compile(r"[\W_]+")
_LONE = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){2,}(?=\s|$)")


def units(text: str) -> set[str]:
    """The different strings of a text that the kernel sees."""
    text = text.lower()
    found: set[str] = set()
    words = set(text.split())
    words.update("".join(m.split()) for m in _LONE.findall(text))
    for w in words:
        if not w.isalnum():
            w = _NOT_UNIT.sub("", w)
        if len(w) <= PIECE:
            found.add(w)
        else:
            found.update(w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2))
    return {BEGIN + w for w in found if len(w) >= N}


#: Of a table of this size, the places that a landmark's combinations fall on are marked.
SIEVE_BITS = 18


class Landmarks:
    """The kernel of strings with some fixed strings, by the subsequences that these have.

    A subsequence of N characters weighs DECAY to the number of characters it spans. `weights` has, for each
    combination of N characters of the landmarks' alphabet, its weight in each landmark; a string's own combinations
    look theirs up, all strings of a length at once.
    """

    def __init__(self, strings: list[str]):
        self.number = {c: i for i, c in enumerate(sorted(set("".join(strings))), 1)}
        self.base = len(self.number) + 1
        found: dict[int, dict[int, float]] = {}
        for k, z in enumerate(strings):
            codes, weights = self._combinations([z])
            for c, w in zip(codes[0].tolist(), weights.tolist()):
                own = found.setdefault(c, {})
                own[k] = own.get(k, 0.0) + w
        self.weights = np.zeros((len(found) + 1, len(strings)), dtype=np.float32)
        for r, (_, own) in enumerate(sorted(found.items()), 1):
            self.weights[r, list(own)] = list(own.values())
        self.codes = np.array(sorted(found), dtype=np.int64)
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self._sieved(self.codes)] = True

    @staticmethod
    def _sieved(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of weights of each code; 0 for those of no landmark, most of which the sieve keeps from the search."""
        out = np.zeros(codes.size, dtype=np.int32)
        at = np.flatnonzero(self.sieve[self._sieved(codes.ravel())])
        asked = codes.ravel()[at]
        place = np.minimum(np.searchsorted(self.codes, asked), max(0, len(self.codes) - 1))
        ok = self.codes[place] == asked if len(self.codes) else np.zeros(len(at), dtype=bool)
        out[at[ok]] = place[ok] + 1
        return out.reshape(codes.shape)

    def _combinations(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of strings of one length: the codes of their combinations (0: with a foreign character), and the weights."""
        n = len(strings[0])
        get = self.number.get
        symbols = np.array([[get(c, 0) for c in s] for s in strings], dtype=np.int64).reshape(len(strings), n)
        places = _places(n)
        codes = np.zeros((len(strings), len(places)), dtype=np.int64)
        foreign = np.zeros(codes.shape, dtype=bool)
        for k in range(N):
            own = symbols[:, places[:, k]]
            foreign |= own == 0
            codes = codes * self.base + own
        codes[foreign] = 0
        return codes, DECAY ** (places[:, -1] - places[:, 0] + 1.0)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with each landmark, not normalised."""
        out = np.zeros((len(strings), self.weights.shape[1]), dtype=np.float32)
        for part in by_length(strings):
            codes, weights = self._combinations([strings[i] for i in part])
            hits = self.rows(codes)
            who, where = np.nonzero(hits)
            if len(who):
                starts = np.flatnonzero(np.diff(who, prepend=-1))
                sums = np.add.reduceat(self.weights[hits[who, where]] * weights[where, None].astype(np.float32), starts, axis=0)
                out[np.array(part)[who[starts]]] = sums
        return out


def by_length(strings: list[str]) -> Iterator[list[int]]:
    """The places of strings of one length, N or more, some at a time."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(len(s), []).append(i)
    for n, rows in by.items():
        if n >= N:
            step = max(1, 400_000 // len(_places(n)))
            for a in range(0, len(rows), step):
                yield rows[a : a + step]


def own_kernel(strings: list[str]) -> np.ndarray:
    """k(x, x) of each string: over its different subsequences, the sum of their squared weights. 0 for shorter ones."""
    out = np.zeros(len(strings))
    for part in by_length(strings):
        n = len(strings[part[0]])
        places = _places(n)
        weights = DECAY ** (places[:, -1] - places[:, 0] + 1.0)
        points = np.frombuffer("".join([strings[i] for i in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n).astype(np.int64)
        codes = points[:, places[:, 0]]
        for k in range(1, N):
            codes = codes << 21 | points[:, places[:, k]]
        order = np.argsort(codes, axis=1)
        codes = np.take_along_axis(codes, order, axis=1)
        new = np.ones(codes.shape, dtype=bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        starts = np.flatnonzero(new.ravel())
        sums = np.add.reduceat(weights[order].ravel(), starts) ** 2
        out[part] = np.add.reduceat(sums, np.searchsorted(starts, np.arange(len(part)) * len(places)))
    return out


@lru_cache
def _places(n: int) -> np.ndarray:
    return np.array([c for c in combinations(range(n), N) if c[-1] - c[0] < SPAN], dtype=np.int64).reshape(-1, N)


def kernel(strings: list[str], others: list[str]) -> np.ndarray:
    return Landmarks(others).kernel(strings)


class Machine:
    """f(unit) = w . K_zz**-1/2 k_z(unit) + b, folded into one weight for each landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = Landmarks(landmarks)
        self.scale = 1 / np.sqrt(own_kernel(landmarks))
        k = self.similarities(landmarks).astype(np.float64) * self.scale[:, None]
        values, vectors = np.linalg.eigh((k + k.T) / 2 + 1e-3 * np.eye(len(landmarks)))
        self.whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        self.weights, self.bias, self.slope, self.middle = np.zeros(len(landmarks)), 0.0, 1.0, 0.0
        self.tag = uuid.uuid4().hex

    def similarities(self, strings: list[str]) -> np.ndarray:
        """The kernel with each landmark, whose vector has length one."""
        return self.landmarks.kernel(strings) * self.scale.astype(np.float32)

    def fit(self, similar: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> None:
        """Squared hinge loss, weighted and with balanced classes, by Newton steps over the rows inside the margin."""
        x = np.hstack([similar.astype(np.float64) @ self.whiten, np.ones((len(y), 1))])
        weight = COST * weight * np.where(y > 0, len(y) / weight[y > 0].sum(), len(y) / weight[y < 0].sum()) / 2
        w, before = np.zeros(x.shape[1]), None
        for _ in range(rounds):
            inside = y * (x @ w) < 1
            if before is not None and (inside == before).all():
                break
            own = x[inside] * weight[inside, None]
            w, before = np.linalg.solve(np.eye(len(w)) + own.T @ x[inside], own.T @ y[inside]), inside
        self.weights, self.bias = self.whiten @ w[:-1], float(w[-1])

    def decided(self, similar: np.ndarray) -> np.ndarray:
        return similar @ self.weights + self.bias

    def decisions(self, strings: list[str]) -> np.ndarray:
        return self.decided(self.similarities(strings)) if strings else np.zeros(0)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -30, 30))))


def pieces(unit: str) -> set[str]:
    return {unit[i : i + n] for n in (5, 6, 7) for i in range(len(unit) - n + 1)}


def inserted(unit: str, rng: np.random.Generator) -> str:
    """The unit with one to three further characters inside."""
    for _ in range(rng.integers(1, 4)):
        i = int(rng.integers(1, len(unit)))
        unit = unit[:i] + chr(int(rng.integers(0x61, 0x7B))) + unit[i:]
    return unit[:PIECE]


def trained(bags: list[tuple[set[str], bool]]) -> Machine | None:
    """A machine from the units of labelled documents; None without both classes."""
    toxic = [b for b, y in bags if y and b]
    clean = [b for b, y in bags if not y and b]
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(0)
    n_toxic, n_clean = Counter(u for b in toxic for u in b), Counter(u for b in clean for u in b)

    def excess(t: dict[str, int], c: dict[str, int]) -> dict[str, float]:
        """How much more often each string is in toxic documents than in others, in standard deviations."""
        p = {u: (n / len(toxic), c.get(u, 0) / len(clean)) for u, n in t.items()}
        return {u: (x - y) / np.sqrt((x + y + 1 / len(toxic)) / 2 * (1 / len(toxic) + 1 / len(clean))) for u, (x, y) in p.items()}

    first = excess(n_toxic, n_clean)
    telling = sorted((u for u in first if first[u] > 0), key=lambda u: (-first[u], u))[:STEMS]
    # insults are inflected: the telling units' pieces are counted too, and both compete to be landmarks
    finder = ahocorasick.Automaton()
    for p in sorted({p for u in telling for p in pieces(u)} | set(telling)):
        finder.add_word(p, p)
    finder.make_automaton()
    held = {u: own for u in set(n_toxic) | set(n_clean) if (own := frozenset(p for _, p in finder.iter(u)))}
    in_bag = [[{p for u in b for p in held.get(u, ())} for b in side] for side in (toxic, clean)]
    stems = excess(*(Counter(p for b in side for p in b) for side in in_bag))
    chosen: list[str] = []
    covered = np.zeros(len(toxic), dtype=bool)
    ranked = sorted((u for u in stems if stems[u] > 3), key=lambda u: (-stems[u], u))[: 6 * LANDMARKS]
    holds = {p: np.array([p in b for b in in_bag[0]]) for p in ranked}
    while ranked and len(chosen) < LANDMARKS * 3 // 4:  # next, what is in most documents not yet covered
        best = max(ranked, key=lambda u: (stems[u] * ((holds[u] & ~covered).sum() + 0.2 * holds[u].sum()), u))
        chosen.append(best)
        covered |= holds[best]
        ranked = [u for u in ranked if u != best and u not in best and best not in u]
    others = sorted(n_clean)
    rest = sorted(u for u in n_clean if u not in chosen)
    fill = [rest[i] for i in rng.permutation(len(rest))[: LANDMARKS - len(chosen)]]
    frequent = set(sorted(others, key=lambda u: (-n_clean[u], u))[: POOL // 3])
    others = sorted(frequent | {u for u in others if u in chosen} | {others[i] for i in rng.permutation(len(others))[: POOL * 2 // 3]})
    machine = Machine(chosen + fill)
    often = np.sqrt([n_clean[u] for u in others])  # a unit of many clean documents weighs more
    seen = sorted(n_toxic)
    similar, clean_similar = machine.similarities(seen), machine.similarities(others)
    # at first the witnesses are the units that hold a chosen stem; a document without one has none
    margin = {u: max((stems[p] for p in held.get(u, ()) if p in chosen), default=-1.0) for u in seen}
    sample = rng.permutation(len(others))[:TRAIN_UNITS]
    sure = {u: n_toxic[u] for u in telling if first[u] > SURE}
    for _ in range(3):
        witness = Counter(sure) | Counter(u for u in (max(b, key=lambda u: (margin[u], u)) for b in toxic) if margin[u] > 0)
        kept = [u for u, _ in witness.most_common(TRAIN_UNITS) if n_toxic[u] * len(clean) > RATE * n_clean[u] * len(toxic)] or [u for u, _ in n_toxic.most_common(10)]
        more = [inserted(u, rng) for u in kept for _ in range(2)]
        place = {u: i for i, u in enumerate(seen)}
        x = np.vstack([similar[[place[u] for u in kept]], machine.similarities(more), clean_similar[sample]])
        many = np.sqrt([witness[u] or 1 for u in kept])
        machine.fit(x, np.array([1.0] * (len(kept) + len(more)) + [-1.0] * len(sample)), np.concatenate([many, np.repeat(many, 2), often[sample]]))
        margin = dict(zip(seen, machine.decided(similar).tolist()))
        worst = np.argsort(-machine.decided(clean_similar), kind="stable")[: TRAIN_UNITS // 2]
        sample = np.array(sorted({*worst.tolist(), *sample[: TRAIN_UNITS // 2].tolist()}))
    margin |= {u: m for u, m in zip(others, machine.decided(clean_similar).tolist()) if u not in margin}
    rest = sorted({u for b in clean for u in b if u not in margin})
    margin |= dict(zip(rest, machine.decisions(rest).tolist()))
    high, low = (np.array([norm([margin[u] for u in b]) for b in side]) for side in (toxic, clean))
    cuts = np.unique(np.concatenate([high, low]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    wrong = [(high < c).mean() + ALARM * (low >= c).mean() for c in cuts]
    machine.middle = float(cuts[int(np.argmin(wrong))])
    machine.slope = 4.0 / max(0.1, float(np.median(high) - np.median(low)))
    return machine


def norm(margins: list[float]) -> float | None:
    """A text's decision value from its units'; None without units."""
    if not margins:
        return None
    toxic = [m for m in margins if m > 0]
    return math.sqrt(sum(m * m for m in toxic)) if toxic else max(margins)


def training_bags(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[set[str], bool]]:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.t: r.n for r in own.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, rows / max(1, n.get(t, 0))) for t in (True, False)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = own.where(place < F.when(F.col("toxic") > 0, int(share[True] * (1 << 20)) + 1).otherwise(int(share[False] * (1 << 20)) + 1))
    # picked is a sample of bounded size; one row for a doc_id, however many have it
    found = docs.where(F.char_length("text") <= TRAIN_CHARS).join(F.broadcast(picked), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"), F.max("toxic").alias("toxic"))
    joined = one.select(F.col("x.text").alias("text"), (F.col("toxic") > 0).alias("toxic"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sorted(units(t or "")) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bags, type=pa.list_(pa.string())), batch["toxic"]], names=["units", "toxic"])

    return sorted(((set(r.units), r.toxic) for r in map_arrow(joined, split, "units array<string>, toxic boolean").collect()), key=lambda x: (x[1], sorted(x[0])))


_known: dict[str, dict[str, float]] = {}


def margins(texts: list[str | None], machine: Machine) -> list[float | None]:
    """The norm of each text's units' decision values; None without units."""
    if machine.tag not in _known:
        _known.clear()
        _known[machine.tag] = {}
    known = _known[machine.tag]
    if len(known) > REMEMBERED:
        known.clear()
    bags = [units(t or "") for t in texts]
    for a in range(0, len(bags), 64):
        new = list({u for b in bags[a : a + 64] for u in b if u not in known})
        known.update(zip(new, machine.decisions(new).tolist()))
    # a text's units may have been forgotten and learnt again; all are there now
    return [norm(list(map(known.__getitem__, b))) for b in bags]


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(trained(training_bags(docs, labels, rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            if machine is None:
                scores = [0.0] * batch.num_rows
            else:
                none = machine.score(machine.bias - 1.0)
                scores = [none if m is None else machine.score(m) for m in margins(batch["text"].to_pylist(), machine)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    found = map_arrow(docs, score, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
