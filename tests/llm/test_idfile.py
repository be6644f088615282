import zlib

import numpy as np
import pytest
from brute import DOCS, told
from conftest import SMALL
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayline.llm import catalog, idfile, tokens
from quayline.session import scratch_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_round_trip(values):
    array = np.array(values, np.uint64)
    assert (idfile.decoded(*idfile.encoded(array), len(array)) == array).all()


@pytest.mark.parametrize("top", [0, 1, 2, 1 << 12, (1 << 60) - 1, 1 << 60])
def test_block_edges(top):
    for n in (1, 1023, 1024, 1025, 5000):
        array = np.full(n, top, np.uint64)
        array[::3] = 0
        words, blocks, escapes = idfile.encoded(array)
        assert len(blocks) == -(-n // 1024) and (idfile.decoded(words, blocks, escapes, n) == array).all()
    assert len(idfile.encoded(np.zeros(1024, np.uint64))[0]) == -(-1024 // 60)


def expected(rows):
    tokenizer = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = told(catalog.QUERIES["op6_id_files"](spark, SMALL), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(expected(rows))


def test_edge_rows(spark):
    rows = [(3, "three"), (1, None), (2, ""), (None, "no id"), (9, "word " * 30_000), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "start": F.lit("y")})
    path = scratch_path(spark, "ids")
    idfile.write_ids(df, path, tokens.vocabulary("byte_bpe_50k.json"))
    got = told(idfile.read_ids(spark, path).withColumn("crc", F.crc32("ids")), "doc_id", "start", "n_tokens", "crc")
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def test_empty(spark):
    path = scratch_path(spark, "ids")
    idfile.write_ids(spark.createDataFrame([], DOCS), path, tokens.vocabulary("byte_bpe_50k.json"))
    assert told(idfile.read_ids(spark, path)) == []


def test_a_word_is_looked_up_once_in_a_batch():
    class Memo(dict):
        reads = 0

        def __getitem__(self, key):
            self.reads += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.reads += 1
            return super().get(key, default)

    encoder = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True)
    encoder.words = Memo()
    texts = ["one two\nthree " * 2000, "two one, " * 2000 + "é", "", "one"]
    want = [np.array(encoder.ids(t), "<u4").tobytes() for t in texts]
    assert encoder.many(t.encode() for t in texts) == want
    assert encoder.words.reads < 50
