"""Token tables against the library on whole texts, and the layout of their files."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.llm import token_tables as T

ODD = ["", None, " ", "a  b", "x\n\ny z", "it's <|endoftext|> foo<|endoftext|>.bar", " a　 b", "é à", "a\x1c b", "\n", "a\n", " \n x.\n", "foo.'s bar!?", "日本 語 です", "a b", "x  y  z", "a.b,c;d 'tis.", "word " * 20000, "ä" * 50000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def want(tokenizer, rows):
    """doc_id, start, n_tokens and ids of rows in ascending order (null ids first), as the library has them."""
    out, start = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ'st.,!? \n\t\x1c\xa0　 é8я日<|>")), max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    enc = T.encoder(T.default_tokenizer())
    assert enc.by_piece
    flat, n = enc.encode(pa.array(texts, pa.string()))
    each = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in each] and flat.tolist() == sum(each, [])


def test_other_tokenizers_and_a_full_memory():
    import public_tokenizers

    other = T.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not other.by_piece
    texts = pa.array(["Hello  World", "", "a.b c"])
    flat, n = other.encode(texts)
    assert flat.tolist() == sum((other.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts), []) and n[1] == 0
    small = T.Encoder(T.default_tokenizer(), known=3)
    for text in ("one two three four", "five two, six", "one five"):
        flat, _ = small.encode(pa.array([text]))
        assert flat.tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file_bytes", [1 << 26, 4000])
def test_order_layout_and_selective_reads(spark, tmp_path, tokenizer, file_bytes):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice(["ab", "Ünd", "x1,", "--", "the"]) for _ in range(r.randrange(60))) for _ in range(300)]
    rows = list(enumerate(texts, -5))
    mixed = rows[:]
    r.shuffle(mixed)
    df = spark.createDataFrame(mixed, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "part": F.lit(1), "a.b": F.lit(0)})
    folder = str(tmp_path / "tokens")
    T.write_tokens(df, folder, file_bytes=file_bytes, page_rows=32)
    expect = want(tokenizer, rows)
    assert [tuple(x) for x in T.read_tokens(spark, folder).orderBy("doc_id").collect()] == expect
    index = T.token_index(spark, folder).orderBy("part").collect()
    assert (len(index) > 3) == (file_bytes == 4000) and sum(x.n_docs for x in index) == len(rows)
    assert all(a.last_id < b.first_id and a.base + a.n_tokens == b.base for a, b in zip(index, index[1:]))
    flat = sum((x[3] for x in expect), [])
    for begin, end in ((0, 10), (len(flat) - 5, len(flat) + 9), (123, 123), (50, 4000), (len(flat), len(flat) + 1)):
        got = T.read_positions(spark, folder, begin, end).orderBy("start").collect()
        assert sum((x.ids for x in got), []) == flat[begin:end] and (not got or got[0].start == begin)
    for f in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["offset"].encodings
            assert columns["ids.list.element"].has_dictionary_page


def test_metadata_reads_leave_the_ids(spark, tmp_path):
    folder = str(tmp_path / "t")
    T.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folder)
    plan = T.token_index(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = T.read_tokens(spark, folder).where("doc_id = 1").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1)" in plan


def test_ties_nulls_and_nothing(spark, tmp_path, tokenizer):
    rows = [(None, "n"), (1, "a"), (1, "a"), (1, "bb cc"), (2, None)]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"))
    got = T.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, 1, 1, 1, 2] and got[-1].ids == [2]
    assert [x.start for x in got] == np.cumsum([0] + [x.n_tokens for x in got[:-1]]).tolist()
    assert sorted(tuple(x.ids) for x in got[1:4]) == sorted(tuple(tokenizer.encode(t, add_special_tokens=False).ids + [2]) for t in ("a", "a", "bb cc"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert T.op11_token_tables(spark, str(tmp_path / "none")).count() == 0


def test_op11_query(spark, tokenizer):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    expect = [(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want(tokenizer, map(tuple, rows))]
    assert sorted(map(tuple, T.op11_token_tables(spark, "/root/testdata/sf0.001").collect())) == expect
