"""Choosing and packing what fits a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ship import ship
from .graph import distances
from .predicates import like
from .relational import SYMBOL_ORDER, of_repo

# Words that say nothing about a task, and endings of names.
STOP_WORDS = (
    "the and for this that with from test task implement add fix bug issue update delete remove create make get set run code file project class"
    " function method interface type import export require include exclude"
).split()
SUFFIXES = "controller service repository manager handler helper provider model".split()
#: Fixed values of the score: by distance, and for each match.
DISTANCE_SCORE, FAR_SCORE, PATH_HIT, SYMBOL_HIT, RANK_FACTOR, CLUSTER_BONUS = (1000, 100, 10), 1, 200, 50, 20, 150
#: Fixed values of a file's cost: with up to three symbols, and for each further one.
BASE_COST, SYMBOL_COST, FREE_SYMBOLS = 150, 20, 3


def keywords(text: Column | str) -> Column:
    """Words of three characters or more, camel case split, stop words left out; and those without a common ending."""
    split = F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    # different words first: what follows is interpreted, word by word
    words = F.filter(F.array_except(split, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.length(w) >= 3)
    stem = lambda w: F.regexp_extract(w, f"^(.+)(?:{'|'.join(SUFFIXES)})$", 1)  # noqa: E731  no ending is the end of another
    return F.array_distinct(F.filter(F.flatten(F.transform(words, lambda w: F.array(w, stem(w)))), lambda w: w != ""))


def keyword_list(text: str) -> list[str]:
    """keywords() of one text, on the driver."""
    import re

    out: list[str] = []
    for w in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text).lower()):
        if len(w) >= 3 and w not in STOP_WORDS:
            out += [w, *(w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) > len(s))]
    return list(dict.fromkeys(out))


def context_seeds(files: DataFrame, symbols: DataFrame, words: list[str], explicit: list[str] = (), repo: str | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """path of the files to start from: named ones, those of up to ten symbols for each word, those with a word in the
    path; if there are none, the five of highest rank (ranked: path, pagerank)."""
    from .relational import symbol_by_name

    own, parts = of_repo(files, repo).select("path"), []
    for seed in explicit:
        parts.append(own.where(F.col("path") == seed) if "." in seed or "/" in seed else symbol_by_name(symbols, seed, repo).select(F.col("file_path").alias("path")))
    for w in words:
        hit = of_repo(symbols, repo).where(like("name", f"%{w}%") | like("file_path", f"%{w}%"))
        parts.append(hit.orderBy(*SYMBOL_ORDER).limit(10).select(F.col("file_path").alias("path")))
        parts.append(own.where(F.lower("path").contains(w)))
    found = own.where("false")
    for p in parts:
        found = found.union(p)
    found = found.distinct()
    if ranked is not None and found.isEmpty():
        return ranked.orderBy(F.desc("pagerank"), "path").limit(5).select("path")
    return found


def context_score(candidates: DataFrame, symbols: DataFrame, words: list[str], ranks: DataFrame, membership: DataFrame) -> DataFrame:
    """candidates (path, depth) with score: by distance, word hits in the path and in symbols, rank, and a seed's cluster."""
    base = F.lit(float(FAR_SCORE))
    for depth, points in reversed(list(enumerate(DISTANCE_SCORE))):
        base = F.when(F.col("depth") == depth, float(points)).otherwise(base)
    hits = lambda c: sum((F.lower(c).contains(w).cast("int") for w in words), F.lit(0))
    by_symbol = symbols.groupBy(F.col("file_path").alias("path")).agg(F.sum(hits("name")).alias("__s"))
    own = membership.where("is_primary").select(F.col("file_path").alias("path"), F.col("cluster_name").alias("__c"))
    seeds = candidates.where("depth = 0").join(own, "path").select("__c", F.lit(True).alias("__seed")).distinct()
    joined = candidates.join(by_symbol, "path", "left").join(ranks.select("path", F.col("pagerank").alias("__r")), "path", "left").join(own, "path", "left").join(seeds, "__c", "left")
    score = base + PATH_HIT * hits("path") + SYMBOL_HIT * F.coalesce("__s", F.lit(0)) + RANK_FACTOR * F.coalesce("__r", F.lit(0.0)) + F.when(F.col("__seed"), CLUSTER_BONUS).otherwise(0)
    return joined.select("path", "depth", score.alias("score"))


def context_pack(scored: DataFrame, symbols: DataFrame, budget: int) -> DataFrame:
    """path, score, cost, included: in order of score, what still fits is taken and what does not is passed over.

    Each choice depends on those before it, so it is a fold over ordered candidates. But of the files of one cost only the
    first budget / cost can be taken, so the fold sees the first few of each cost: their number depends on the budget, not
    on the files.
    """
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    cost = (F.lit(BASE_COST) + SYMBOL_COST * F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - FREE_SYMBOLS)).cast("int")
    rows = cut(scored.join(n, "path", "left").select("path", "score", cost.alias("cost")))
    place = F.row_number().over(Window.partitionBy("cost").orderBy(F.desc("score"), "path"))
    first = rows.where(F.col("cost") <= budget).withColumn("__i", place).where(F.col("__i") <= budget // BASE_COST).where(F.col("__i") * F.col("cost") <= budget)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "path", "cost")))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["out"], x["path"])).otherwise(acc["out"]).alias("out"))

    taken = first.agg(ordered.alias("o")).select(F.explode(F.aggregate("o", start, step)["out"]).alias("path"))
    return rows.join(taken.withColumn("__in", F.lit(True)), "path", "left").select("path", "score", "cost", F.coalesce("__in", F.lit(False)).alias("included"))


def build_context(files: DataFrame, symbols: DataFrame, edges: DataFrame, task: str, ranks: DataFrame, membership: DataFrame, budget: int = 8192, depth: int = 2, seeds: list[str] = ()) -> DataFrame:
    """path, score, cost, included for a task in words. ranks: path, pagerank."""
    words = keyword_list(task)
    near = distances(edges, context_seeds(files, symbols, words, seeds, ranked=ranks), depth)
    known = near.join(files.select("path"), "path", "left_semi")
    return context_pack(context_score(known, symbols, words, ranks, membership), symbols, budget)


def token_estimate(text: Column | str) -> Column:
    """Four characters a token."""
    return F.ceil(F.length(text) / 4)


def code_token_estimate(text: Column | str) -> Column:
    """3.5 characters a token where more than 30 % are neither letters nor white space, else four."""
    odd = F.length(F.regexp_replace(text, r"[a-zA-Z\s]", ""))
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.ceil(n / F.when(odd / n > 0.3, 3.5).otherwise(4.0))).cast("long")


def truncated(text: Column | str, budget: int) -> Column:
    """Text over the budget, cut at its last line break within it, with a note."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.substring(text, 1, 4 * budget)
    return F.when(F.length(text) <= 4 * budget, text).otherwise(F.concat(F.regexp_extract(head, r"(?s)^(.*)\n", 1), F.lit("\n\n[... truncated to fit token budget]\n")))


def fuzzy_levenshtein(names: DataFrame, term: str, most: int | None = None, k: int = 5) -> DataFrame:
    """name, distance: the k names nearest to a term by edits, without case."""
    most = max(2, len(term) * 2 // 5) if most is None else most
    near = names.select("name").distinct().select("name", F.levenshtein(F.lower("name"), F.lit(term.lower()), most).alias("distance"))
    return near.where("distance >= 0").orderBy("distance", "name").limit(k)


def fuzzy_score(name: str, term: str, distance: int = 100) -> float:
    """How far a name is from holding a term: the least, over places, of the edits to what begins there for each of the
    term's characters, and the place's share of `distance`. 0 for the term itself. Both in lower case."""
    if name == term:
        return 0.0
    # edits between the term's ends and what the name has from each place on, the end of that free
    row = list(range(len(term), -1, -1))
    best = row[0] / len(term) + len(name) / distance
    after = row
    for i in range(len(name) - 1, -1, -1):
        now = [0] * (len(term) + 1)
        for j in range(len(term) - 1, -1, -1):
            now[j] = min(after[j + 1] + (name[i] != term[j]), after[j] + 1, now[j + 1] + 1)
        best = min(best, now[0] / len(term) + i / distance)
        after = now
    return best


def fuzzy_suggest(names: DataFrame, term: str, k: int = 5, threshold: float = 0.4) -> DataFrame:
    """name, score: the k names that hold a term best, with a score of at most `threshold`; of equals the first by name."""
    ship(names.sparkSession)
    wanted = term.lower()

    @F.pandas_udf("double")
    def score(name: pd.Series) -> pd.Series:
        from cartomill.operators.context import fuzzy_score as f

        return name.map(lambda n: f(n, wanted))

    if not wanted:
        return names.select("name").where("false").withColumn("score", F.lit(0.0))
    found = names.select("name").where("name IS NOT NULL").distinct().withColumn("score", score(F.lower("name")))
    return found.where(F.col("score") <= threshold).orderBy("score", "name").limit(k)
