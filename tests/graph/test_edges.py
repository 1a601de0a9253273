"""After any changes, the maintained edges are those of a full scan, and few references are resolved again."""

import random

import pytest
from pyspark.sql import functions as F

from cartomill.functions.extract import extract, references_of, symbols_of
from cartomill.streaming.edges import REFERENCE, SYMBOL, changed_edges, follow, resolved
from cartomill.streaming.incremental import TableSet

NAMES = "Order User Cart Item orderTotal total userName load find save Base".split()


def text(rng):
    a, b, c, d = (rng.choice(NAMES) for _ in range(4))
    return f"class {a} extends {b} {{\n  {c}() {{ {d}(); new {rng.choice(NAMES)}(); {rng.choice(NAMES).lower()[:3]}(); }}\n}}\n"


def frame(spark, files):
    return spark.createDataFrame([(p, "r", "typescript", t) for p, t in files.items()], "path string, repo string, language string, text string")


def read(files):
    rows = extract(files.select("path", F.lit("r").alias("repo"), "language", "text"))
    return symbols_of(rows).select(*SYMBOL), references_of(rows).select(*REFERENCE)


def full(spark, files):
    df = frame(spark, files)
    symbols, references = read(df)
    return {"files": df.select("path", "language"), "symbols": symbols, "edges": resolved(references, symbols, df)}


def content(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_full_scan_after_random_edits(spark, seed):
    rng = random.Random(seed)
    files = {f"src/f{i}.ts": text(rng) for i in range(40)}
    state = full(spark, files)
    for _ in range(2):
        changed = rng.sample(sorted(files), 3) + [f"src/n{rng.randrange(9)}.ts"]
        after = dict(files)
        del after[changed[0]]
        for p in changed[1:]:
            after[p] = text(rng)
        now = frame(spark, {p: after[p] for p in changed[1:]})
        symbols, references = read(now)
        got = changed_edges(state, spark.createDataFrame([(p,) for p in changed], "path string"), now, symbols, references)
        want = full(spark, after)
        for name in ("files", "symbols", "edges"):
            assert content(got[name].select(*want[name].columns)) == content(want[name])
        files, state = after, want


def test_work_is_in_proportion_to_the_change(spark):
    files = {f"src/f{i}.ts": f"class C{i:03d}Thing {{ run{i:03d}() {{ go{(i * 7) % 200:03d}x(); }} }}\nfunction go{i:03d}x() {{}}\n" for i in range(200)}
    state = full(spark, files)
    now = frame(spark, {"src/f5.ts": "class Other { run005() {} }\n"})
    symbols, references = read(now)
    got = changed_edges(state, now, now, symbols, references)
    assert got["redone"].count() <= 3  # the one that called go005x, and what the file now holds
    assert [r.target for r in got["edges"].where("symbol = 'go005x'").collect()] == [None]


def test_as_a_stream(spark, tmp_path):
    files = {f"src/f{i}.ts": text(random.Random(i)) for i in range(12)}
    tables = TableSet(spark, f"file://{tmp_path}/t")
    with tables.transaction() as t:
        for name, df in full(spark, files).items():
            t.write(name, df)
    changes = [("src/f1.ts", "typescript", None, 1), ("src/f2.ts", "typescript", "class Order {}\n", 1), ("src/f2.ts", "typescript", "class User { load() { save(); } }\n", 2), ("src/z.ts", "typescript", text(random.Random(99)), 1)]
    schema = "path string, language string, text string, at int"
    spark.createDataFrame(changes, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = stream.writeStream.foreachBatch(follow(tables, read)).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    del files["src/f1.ts"]
    files |= {"src/f2.ts": changes[2][2], "src/z.ts": changes[3][2]}
    want = full(spark, files)
    for name in ("files", "symbols", "edges"):
        assert content(tables.read(name).select(*want[name].columns)) == content(want[name])
