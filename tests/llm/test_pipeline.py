import random

import corpus_pipeline
from cartomill.llm.decontaminate import contamination

from .cases import crowded, frame, rows, text
from .test_decontaminate import brute as brute_hits
from .test_pii import slow
from .test_simhash import brute as brute_groups
from .test_tokens import crc, plain


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    benchmark = [(0, "a benchmark item of many words that one document below repeats in full with nothing else near it")]
    data = [r for r in rows() if r[0] is not None] + [(7000, benchmark[0][1], "en", "s", None), (7001, "mail to kim@home.example now please", "en", "s", 35)]
    path = f"file://{tmp_path}"
    frame(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        seen[name] = {r.doc_id for r in out.collect()}
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
    assert 7000 in seen["near_dedup"] and 7000 not in seen["decontamination"]
    assert seen["personal_data"] == seen["decontamination"] == seen["packing"]
    texts = {r.doc_id: r for r in docs.collect()}
    assert texts[7001].text == "mail to [email] now please" and texts[7001].n_chars == len(texts[7001].text)
    assert len(texts) == docs.count()
    final = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in final.collect()} == seen["packing"]
    assert contamination(crowded(spark, data), spark.read.parquet(f"{path}/benchmark.parquet")).where("doc_id = 7000 AND contaminated").count() == 1


def test_run_by_brute_force(spark, tmp_path):
    """The rows of run(), each stage done by plain Python over the rows that the one before it keeps."""
    rng = random.Random(12)
    items = [(0, "a benchmark item of many words that some documents below repeat in full between others"), (1, "short item")]
    data = [r for r in rows(3, 50) if r[0] is not None]
    for i in range(20):
        words = text(rng, 60)
        data.append((5000 + i, f"{words} person{i}@home.example, {words[:20]} +1 (202) 555-01{i:02d} or 10.0.0.{i}", "en", "s", 7))
        data.append((6000 + i, f"{text(rng, rng.choice([5, 300, 900]))} {items[i % 2][1]} {text(rng, 4)}", "de", "s", 7))
    data.append((7000, text(rng, 6000), "en", "s", 7))  # several sequences long
    path = f"file://{tmp_path}"
    frame(spark, data).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    left = [r for r in data if any(map(str.isalpha, r[1] or ""))]
    component = {d: c for d, _, c in brute_groups(left)}
    left = {r[0]: r for r in left if component[r[0]] == r[0]}.values()  # rows that repeat are one
    left = [r for r in left if not brute_hits(r[1], items)[4]]
    want = {}
    for d, t, *_ in left:
        out, at = [], 0
        for a, _, b, kind in slow(t):
            if a >= at:
                out += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        want[d] = plain("word", "".join(out) + t[at:]) + [1]

    pieces = {}
    found = corpus_pipeline.run(spark, path).collect()
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want) and len(want) < len(data)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[d])) and r.ids_crc32 == crc(want[d][at : at + r.length])
            at += r.length
        assert at == len(want[d])
    places = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
    assert all(r.offset + r.length <= 2048 for r in found) and len(pieces[7000]) > 2
