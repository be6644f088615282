import zlib

import numpy as np
import pytest
from brute import DOCS, told
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayline.llm import catalog, packing, tokens


@pytest.mark.parametrize("counts", [
    {}, {5: 3}, {4096: 7}, {1: 10_000}, {2049: 10, 2047: 9, 1: 3}, {n: n % 7 for n in range(1, 4097)},
    {1000: 50_000, 3000: 20_000, 96: 15_000, 4095: 3},
])
def test_solver_holds_each_piece_once_and_wastes_little(counts):
    found = packing.solve(counts)
    held = {}
    for config, n in found:
        assert n > 0 and sum(x * k for x, k in config) <= 4096
        for x, k in config:
            held[x] = held.get(x, 0) + n * k
    assert held == {x: n for x, n in counts.items() if n}
    used, tokens_ = sum(n for _, n in found), sum(x * n for x, n in counts.items())
    best_fit = sum(n for _, n in packing.best_fit(dict(counts), 4096))
    assert used >= -(-tokens_ // 4096) and used <= best_fit + max(2, best_fit // 1000)


def check(rows, want):
    assert sorted((r.doc_id is not None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def pieces(rows):
    tokenizer = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            out.append((key is not None, key, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = pieces(rows)
    used = check(catalog.QUERIES["op5_best_fit_packing"](spark, SMALL).collect(), want)
    assert used <= -(-sum(w[4] for w in want) // 4096) + 2


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 9000), (4, "y" * 20_000), (5, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("a"), "ids": F.lit(1)})
    check(packing.packed(df).collect(), pieces(rows))
    assert told(packing.packed(spark.createDataFrame([], DOCS))) == []
    with_ids = packing.packed(df, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)


ODD = ["a  b", "\n\n x", "  lead", "tr  ", "a   b", " ́x", "It's  don't\t\tx", "x\x1c\x1d y", "\x85\x85 a", "<|endoftext|> hi", "",
       "ΑΣ  ς\r\n b", "a \n \n b", "​   b", "１２３ ４５", "a　　b c", "It's, don't. a,b c.d", "\nx", "x\n", " x", "x ", "\n", " ",
       "İstanbul, İ", "é, é. é", "x², ½. _a_ a_b,", "word's.", "ßẞ, ŉ.", "ﬁne. ﬁ", "Ångström, Å.", "a.\nb c", "ＡＢ, ＣＤ.", "ª, º.", "\0 a\0",
       "l'eau, d'un mot", "!!!,, ..a", "x" * 300 + ", " + "é" * 90 + "."]


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_memo_gives_the_tokenizers_ids(spark, name, blanks):
    encoder = tokens.Encoder(tokens.vocabulary(name), blanks, memo=500)  # starts anew many times
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for at in range(0, len(texts), 7):
        some = texts[at:at + 7]
        want = [np.array(encoder.ids(t), "<u4").tobytes() for t in some]
        assert encoder.many(t.encode() for t in some) == want
