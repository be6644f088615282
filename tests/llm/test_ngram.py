from collections import Counter
from math import floor, log2, log10

import numpy as np
import pytest
from brute import DOCS, fold, lower, told, words
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import ngram
from quayline.llm.common import read_table


def expected(rows):
    """Scores by counters and a plain expectation-maximisation."""
    texts = [(key, [*words(lower(text)), "<end>"]) for key, text in rows]
    learned = [(key, own) for key, own in texts if key is not None and fold(key, 5) != 1]
    held = [own for key, own in learned if fold(key, 25) == 0]
    base = [own for key, own in learned if fold(key, 25) != 0]

    def counts(parts):
        single = Counter(w for own in parts for w in own)
        pair = Counter(p for own in parts for p in zip(["<start>", *own[:-1]], own))
        context = Counter(single)
        context["<start>"] = len(parts)
        return single, pair, context

    def plain(single, w):
        return (single[w] + 0.5) / (sum(single.values()) + 0.5 * (len(single) + 1))

    bucket = lambda c: floor(log2(c)) + 1
    single, pair, context = counts(base)
    ratios = {}
    for own in held:
        for before, w in zip(["<start>", *own[:-1]], own):
            if context[before]:
                ratio = pair[before, w] / context[before] / plain(single, w)
                step = 2 ** (round(ngram.RATIO_STEPS * log2(ratio)) / ngram.RATIO_STEPS) if ratio else 0.0
                ratios.setdefault(bucket(context[before]), []).append(step)
    weight = {}
    for b, found in ratios.items():
        x = 0.5
        for _ in range(ngram.ROUNDS):
            x = min(max(sum(x * r / (x * r + 1 - x) for r in found) / len(found), 1e-6), 1 - 1e-6)
        weight[b] = x
    single, pair, context = counts([own for _, own in learned])
    total, out = sum(single.values()), []
    norm = total + 0.5 * (len(single) + 1)
    for key, own in texts:
        one = [(single[w] + 0.5) / norm for w in own]
        both = []
        for p, before, w in zip(one, ["<start>", *own[:-1]], own):
            x = weight.get(bucket(context[before]), 0.0) if context[before] else 0.0
            both.append(x * pair[before, w] / max(context[before], 1) + (1 - x) * p)
        out.append((key, key is not None and fold(key, 5) == 1, len(own), sum(single[w] > 0 for w in own), total,
                    sum(map(log10, one)), sum(map(log10, both))))
    return out


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_documents(spark, monkeypatch):
    docs = read_table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = ngram.scored(docs).collect()
    same(got, expected(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_many_shards_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 700)
    docs = read_table(spark, SMALL, "documents").limit(60).repartition(7)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(ngram.scored(docs).collect(), expected(rows))


def test_edge_rows(spark):
    rows = [(n, f"some words {n % 4} here") for n in range(60)]
    rows += [(100, None), (101, ""), (101, ""), (None, "some words"), (102, " \t"), (103, "z" * 30_000), (104, "SOME words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "chunk": F.lit("y")})
    same(ngram.scored(df).collect(), expected(rows))


def test_nothing_learned_and_empty(spark):
    held = next(n for n in range(100) if fold(n, 5) == 1)
    df = spark.createDataFrame([(held, "only held out")], "doc_id long, text string")
    row = ngram.scored(df).first()
    assert (row.n_known, row.train_tokens, row.n_tokens) == (0, 0, 4) and row.score == pytest.approx(row.base_score)
    assert told(ngram.scored(spark.createDataFrame([], DOCS))) == []


def test_packing_of_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (ngram.undeltas(ngram.deltas(keys), len(keys)) == keys).all()
    values = rng.integers(0, 1 << 31, 50).astype(np.uint32)
    assert (ngram.unsqueezed(ngram.squeezed(values), "<u4", 50) == values).all()
