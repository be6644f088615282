"""Token counts against the library's own on whole texts."""

from __future__ import annotations

import pytest
from conftest import SMALL

from quayline.llm import catalog, lengths
from quayline.llm.tokens import vocabulary

NASTY = [
    None, "", " ", "\t\n ", "word", "Two words", "it's <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "été ́x", "ΣΣ Σ",
    "a b c　d e\u0085f", "x1y22z333 1̈ 4̸", "漢字かな交じり文 " * 40, "a" * 3000, "ﬁ Å 각",
    "word 12 " * 30_000, "ab" * 90_000 + "7" + "cd" * 50_000, "\0 \x1c \x1d\x1e", "  two   blanks \n\n lines \r\n",
    "the cat sat on  the mat, " * 8000, "<unk> <s> </s> ▁▁a b▁c",
]


def own(path: str, text: str) -> int:
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return len(SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_lengths_are_those_of_the_library(spark, name):
    path = vocabulary(name)
    rows = [(i, text, f"x{i}") for i, text in enumerate(NASTY)] + [(None, "no key", ""), (3, "word", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = lengths.counted(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(
        (str(i), len((t or "").encode()), n, n > 2048) for i, t, _ in rows for n in [own(path, t or "")]
    )


def test_long_texts_come_in_parts():
    words = lengths.lengths(vocabulary("word_bpe_49k.json"))
    assert len(list(words.parts(b"ab" * 90_000 + b"7" + b"cd" * 90_000))) == 2
    pieces = lengths.lengths(vocabulary("byte_bpe_50k.json"))
    assert len(list(pieces.parts(b"the cat sat " * 20_000))) > 2


def test_query_counts_whole_table(spark):
    rows = catalog.read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    expected = sorted(
        (r.doc_id, len(text.encode()), n, n > 2048)
        for r in rows for text in [r.text or ""] for n in [len(tokenizer.encode(text, add_special_tokens=False).ids)]
    )
    found = catalog.op11_token_counts(spark, SMALL)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect())) == expected
    assert lengths.counted(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
