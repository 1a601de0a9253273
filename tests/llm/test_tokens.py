import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartomill.llm.packing import pack
from cartomill.llm.token_output import read_tokens, token_digests, write_tokens
from cartomill.llm.tokens import encoder

from .cases import SCHEMA, crowded, frame, rows

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ALPHABET = st.sampled_from([*"aB'st  \n\n\t\r\x0b\x1c\xa0\u2003é日\u0301.,!7<|>½ıİ", "<|endoftext|>", "The end.", "re", "(a)"])


def plain(kind, text):
    return Tokenizer.from_file(public_tokenizers.path(FILES[kind])).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_equals_library(kind):
    enc = encoder(public_tokenizers.path(FILES[kind]), kind)
    whole = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(ALPHABET, max_size=14).map("".join))
    def check(text):
        assert np.frombuffer(enc.packed([text.encode()])[0], dtype=enc.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids

    check()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pack_round_trip(spark):
    got = pack(crowded(spark), public_tokenizers.path(FILES["word"]), sequence=64, with_ids=True).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in places:
        assert s * 64 + o == at and n >= 1 and o + n <= 64
        at += n
    docs = {}
    for r in got:
        assert r.ids_crc32 == crc(np.frombuffer(r.ids, dtype="<u2"))
        docs.setdefault((r.doc_id, r.sequence_id * 64 + r.offset - r.start), []).append(r)
    want = sorted((d, (plain("word", t or "") + [1])) for d, t, *_ in rows())
    found = []
    for (doc_id, _), parts in docs.items():
        parts.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, dtype="<u2") for r in parts]).tolist()
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert all(r.doc_tokens == len(ids) for r in parts)
        found.append((doc_id, ids))
    assert sorted(found) == want


def test_token_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_tokens(crowded(spark), public_tokenizers.path(FILES["byte"]), path)
    tokens = read_tokens(spark, path)
    want = sorted(((d, plain("byte", t or "") + [2]) for d, t, *_ in rows()), key=lambda x: x[0])
    assert sorted((r.doc_id, list(r.ids)) for r in tokens.collect()) == sorted(want)
    got = sorted(token_digests(tokens).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, len(i), crc(i)) for d, i in want)


def test_token_files_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    write_tokens(frame(spark), public_tokenizers.path(FILES["byte"]), f"file://{tmp_path}/t")
    file = pq.ParquetFile(next(p for p in sorted(tmp_path.glob("t/*.parquet")) if pq.ParquetFile(p).metadata.num_rows))
    columns = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)]
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    ids = next(c for c in columns if c.path_in_schema.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings or "DELTA_BINARY_PACKED" in ids.encodings


def test_single_documents_and_metadata_are_read_alone(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from cartomill.llm import token_output

    monkeypatch.setattr(token_output, "ROW_GROUP", 16 << 10)
    monkeypatch.setattr(token_output, "PAGE_ROWS", 20)
    data = [(i, " ".join(f"word{(i * 7 + k) % 997}" for k in range(120)), None, None, None) for i in range(600)]
    data += [(300, data[5][1], None, None, None)] * 900  # a hot doc_id, of equal rows
    path = f"file://{tmp_path}/t"
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows make one file
    spark.conf.set(key, "false")
    try:
        write_tokens(frame(spark, data).repartition(3), public_tokenizers.path(FILES["byte"]), path)
    finally:
        spark.conf.unset(key)
    files = [pq.ParquetFile(p) for p in sorted(tmp_path.glob("t/*.parquet"))]
    groups = [(f, g) for f in files for g in range(f.metadata.num_row_groups)]
    ranges = [f.metadata.row_group(g).column(0).statistics for f, g in groups]
    holding = [r for r in ranges if r.min <= 77 <= r.max]
    assert len(groups) >= 5 and 1 <= len(holding) <= 2  # one document: one row group, or two at an edge
    assert max(sum(f.metadata.row_group(g).num_rows for g in range(f.metadata.num_row_groups)) for f in files) < 1200  # the hot doc_id is spread
    sizes = [sum(f.metadata.row_group(g).column(c).total_compressed_size for f, g in groups) for c in range(5)]
    assert sum(sizes[:4]) < sizes[4] / 5  # metadata without the ids
    one = read_tokens(spark, path).where("doc_id = 77")
    plan = one.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan and "ids" not in plan
    assert list(one.first().ids) == plain("byte", data[77][1]) + [2]


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty, public_tokenizers.path(FILES["word"])).count() == 0
    write_tokens(empty, public_tokenizers.path(FILES["byte"]), f"file://{tmp_path}/e")
    assert token_digests(read_tokens(spark, f"file://{tmp_path}/e")).count() == 0
