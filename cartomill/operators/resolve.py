"""Resolution of references to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import group_of
from ..functions.lineage import cut
from .predicates import folded


def piece_count(text: Column | str) -> Column:
    return F.size(pieces(text, (3,)))


def pieces(text: Column | str, sizes: tuple[int, ...]) -> Column:
    """The different runs of so many characters in a text; a text shorter than the longest of one size is itself a piece."""
    text = F.col(text) if isinstance(text, str) else text
    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def resolve_symbol(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """refs (source_file, symbol) with `target`: the file that defines it, in a compatible language.

    First an exact name, by an equi-join; for qualified names their last part; for a method named with its class, the class's
    (how: member); only what is left looks for names that
    contain the symbol, over distinct pairs. All symbols are known before any is resolved.
    """
    lang = files.select(F.col("path").alias("__p"), group_of("language").alias("__g"))
    order = F.struct("kind", "name", "__f", "start_line")
    own = symbols.select("name", F.col("file_path").alias("__f"), "kind", "start_line").join(lang, F.col("__f") == F.col("__p"))
    # a name's first definition in each language group, and in any: references never meet single definitions
    first = own.groupBy("name", F.col("__g")).agg(F.min(order).alias("o"))
    first = cut(first.unionByName(first.groupBy("name").agg(F.min("o").alias("o")).withColumn("__g", F.lit(""))))
    want = refs.select("source_file", "symbol").where("symbol <> ''").distinct().join(lang.select(F.col("__p").alias("source_file"), F.col("__g").alias("__sg")), "source_file", "left")
    want = cut(want.na.fill("", ["__sg"]).withColumn("__short", F.element_at(F.split("symbol", r"\\"), -1)))

    def best(left: DataFrame, name: str) -> DataFrame:
        joined = left.join(first, (F.col(name) == F.col("name")) & (F.col("__sg") == F.col("__g")))
        return joined.groupBy("source_file", "symbol").agg(F.min("o").alias("o")).select("source_file", "symbol", F.col("o.__f").alias("target"))

    exact = best(want, "symbol")
    rest = want.join(exact, ["source_file", "symbol"], "left_anti")
    by_short = best(rest.where(F.col("symbol").contains("\\")), "__short")
    rest = rest.join(by_short, ["source_file", "symbol"], "left_anti")
    # a method named with its class: where that class has it, else where the class is
    scoped = symbols if "scope" in symbols.columns else symbols.withColumn("scope", F.lit(None).cast("string"))
    members = scoped.where("scope IS NOT NULL").select(F.concat("scope", F.lit("::"), "name").alias("name"), F.col("file_path").alias("__f"), "kind", "start_line").join(lang, F.col("__f") == F.col("__p"))
    member = members.groupBy("name", F.col("__g")).agg(F.min(order).alias("o"))
    asked = rest.where(F.col("__short").contains("::"))
    typed = asked.join(member, (F.col("__short") == F.col("name")) & (F.col("__sg") == F.col("__g"))).groupBy("source_file", "symbol").agg(F.min("o").alias("o")).select("source_file", "symbol", F.col("o.__f").alias("target"))
    classes = best(asked.join(typed, ["source_file", "symbol"], "left_anti").withColumn("__class", F.substring_index("__short", "::", -2)).withColumn("__class", F.substring_index("__class", "::", 1)), "__class")
    typed = typed.unionByName(classes)
    rest = rest.join(typed, ["source_file", "symbol"], "left_anti")
    # names that contain the text: each different text is compared with the names that share its rarest piece
    texts = rest.select(F.lower("__short").alias("__t")).distinct()
    names = first.select(F.col("name").alias("__n")).distinct()
    index = cut(names.select("__n", F.explode(pieces(folded("__n"), (1, 2, 3))).alias("__g")))
    asked = texts.where("__t <> ''").select("__t", F.explode(pieces(F.col("__t"), (3,))).alias("__g"))
    rarest = asked.join(index.groupBy("__g").agg(F.count("*").alias("__c")), "__g").groupBy("__t").agg(F.min_by("__g", F.struct("__c", "__g")).alias("__g"), F.count("*").alias("__found"), F.first(piece_count("__t")).alias("__want"))
    pairs = rarest.where("__found = __want").join(index, "__g").where(F.contains(folded("__n"), F.col("__t"))).select("__t", "__n")
    loose = best(rest.withColumn("__t", F.lower("__short")).join(pairs, "__t"), "__n")
    every = first.groupBy("__g").agg(F.min("o").alias("o"))  # an empty last part is in all names
    empty = rest.where("__short = ''").join(every, F.col("__sg") == F.col("__g")).select("source_file", "symbol", F.col("o.__f").alias("target"))
    loose = loose.unionByName(empty)
    found = exact.withColumn("how", F.lit("exact")).unionByName(by_short.withColumn("how", F.lit("short"))).unionByName(typed.withColumn("how", F.lit("member"))).unionByName(loose.withColumn("how", F.lit("contains")))
    return refs.join(found, ["source_file", "symbol"], "left")
