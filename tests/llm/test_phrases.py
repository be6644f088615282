"""Phrase mining against plain counters."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import lower

from quayline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(rows, depth, least, most):
    """Rows of (lang, text) by counters of all n-grams."""
    total, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            own = re.findall("[^ \t]+", piece)
            total[lang] += len(own)
            for k in range(1, depth + 1):
                counts[lang].update(tuple(own[i:i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {g for g, c in f.items() if len(g) > 1 and c >= least}
        gone = set()
        for longer in found:
            for k in range(2, len(longer)):
                gone |= {g for i in range(len(longer) - k + 1) if (g := longer[i:i + k]) in found and 100 * f[longer] >= 100 * f[g]}
        scored = []
        for g in found - gone:
            cuts = [(1000 * f[g] * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def told(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def prose(seed, n, words):
    dice = random.Random(seed)
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n"]
    return "".join(dice.choice(words) + dice.choice(marks) for _ in range(n))


ROWS = [
    ("en", prose(1, 400, ["the", "Cat", "sat", "on", "mat", "thé"])), ("en", None), ("en", ""), ("en", " .\n,"),
    ("fr", prose(2, 300, ["le", "chat", "noir"])), (None, prose(3, 90, ["a", "b"])), ("und", "a b a b a b."),
    ("en", "one two three four five six " * 9), ("en", "one two three four five six " * 9), ("xx", "never again"),
    ("en", "nul\0word \x1cx  y z nul\0word " * 4),
]


@pytest.mark.parametrize("size", [40, 300, phrases.SHARD_BYTES])
def test_phrases_are_those_of_plain_counters(spark, size):
    rows = ROWS + [("en", "long run without any mark at all " * 30)]
    docs = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    found = told(phrases.mined(docs.repartition(3), least=3, most=25, size=size, bucket_bytes=700))
    assert found == mined(rows, 5, 3, 25)
    assert {r[0] for r in found} == {"en", "fr", "und"}


def test_other_depths_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert told(phrases.mined(docs, depth=3, least=5, most=4)) == mined(ROWS, 3, 5, 4)
    assert told(phrases.mined(docs, depth=2, least=2)) == mined(ROWS, 2, 2, 2000)
    assert told(phrases.mined(docs.where("false"))) == []
    assert told(phrases.mined(docs, least=10**6)) == []


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 3_000_000_007, 9_007_199_254_740_993, 3_000_000_019, 5_000_000_029
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.selectExpr(phrases.SCORE + " AS x").first().x == 1000 * a * n // (left * right)


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_phrases_and_their_extensions(seed):
    dice = random.Random(seed)
    text = [dice.choice([0, 1, 1, 2, 3, 4, 5][: dice.randint(3, 7)]) for _ in range(dice.choice([1, 2, 30, 400]))]
    pieces = [list(map(int, p.split())) for p in " ".join(map(str, text)).split("0")]
    grams = Counter(tuple(p[i:i + k]) for p in pieces for k in range(1, 6) for i in range(len(p) - k + 1))
    text = np.array(text)
    known = {g: i for i, g in enumerate(sorted({g for g in grams if len(g) == 1}), 1)}
    for depth in range(2, 6):
        # Every third phrase is forgotten on the way: only what has both its parts comes out.
        start = [known.get(tuple(map(int, text[i:i + depth - 1])), 0) for i in range(len(text))]
        start = [i if at + depth - 1 <= len(text) else 0 for at, i in enumerate(start)]
        names = {i: g for g, i in known.items()}
        index = phrases.Index(text, depth)
        found, lows = {}, []
        if any(start):
            ids, word, count, lows = index.longer(np.array(start))
            found = {(*names[int(i)], int(w)): int(n) for i, w, n in zip(ids, word, count)}
            of, place = index.places(lows, count)
            for i, at in zip(of.tolist(), place.tolist()):
                assert tuple(map(int, text[at:at + depth])) == (*names[int(ids[i])], int(word[i]))
        assert found == {g: n for g, n in grams.items() if len(g) == depth and g[:-1] in known and g[1:] in known}
        known = {g: i for i, g in enumerate(sorted(found), 1) if i % 3}


@pytest.mark.parametrize("text", [b"a b c d e f g h i j", b"a.b c d. e f g h i j k l", b"x" * 50 + b" y z", b"", b"  a  ", b"a b c d e f g h i j k l m n o p q r s t"])
@pytest.mark.parametrize("most", [1, 4, 9, 100])
def test_parts_of_a_text_hold_its_phrases(text, most):
    def grams(raw):
        words = [p.split() for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", raw)]
        return Counter(tuple(w[i:i + k]) for w in words for k in range(1, 6) for i in range(len(w) - k + 1))

    added = Counter()
    for sign, part in phrases.parts(text, most):
        for gram, n in grams(part).items():
            added[gram] += sign * n
    assert {g: n for g, n in added.items() if n} == dict(grams(text))
