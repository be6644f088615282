import numpy as np
import pyarrow as pa
from brute import DOCS, fold, told
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import langid
from quayline.llm.common import read_table

TEXTS = {"aa": "banana cabana habana manana", "bb": "rhythm myrrh syzygy lynx crypt"}


def rows():
    out = [(n, f"{t} {n % 3}", lang, None, None) for n, (lang, t) in enumerate(list(TEXTS.items()) * 20)]
    return out + [(1000, None, "aa", None, None), (1001, "", "bb", None, None), (1002, "12 %$ 3", "aa", None, None),
                  (None, "banana", "aa", None, None), (1003, "MYRRH, SYZYGY!", None, None, None),
                  (1003, "MYRRH, SYZYGY!", None, None, None), (1004, "жж", "aa", None, None), (1005, "cabana " * 30_000, None, None, None)]


def test_edge_rows(spark):
    df = spark.createDataFrame(rows(), DOCS).withColumn("score", F.lit("x"))
    found = langid.identified(df).collect()
    assert len(found) == len(rows())
    by = {r.doc_id: r for r in found}
    assert all(by[n].lang_pred == "und" and by[n].score == 0 for n in (1000, 1001, 1002))
    assert by[1003].lang_pred == "bb" and by[1005].lang_pred == "aa" and by[None].lang_pred == "aa"
    assert by[None].held_out is False and all(by[n].held_out == (fold(n, 4) == 2) for n in range(40))
    assert all(by[n].lang_pred == lang for n, _, lang, *_ in rows()[:40])
    assert all(0 <= r.score <= 1 for r in found) and by[1004].phrase_length == 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert told(langid.identified(df), "lang_pred", "score") == [("und", 0.0)]
    assert told(langid.identified(spark.createDataFrame([], DOCS))) == []


def test_phrases_against_substring_search():
    """Greedy phrases by plain search in the sample, with pieces parsed apart."""
    texts = {"x": ["abcabcabd abx"], "y": ["xyzzy abd"]}
    models = langid.fitted(texts)
    sample = {k: v[0] for k, v in texts.items()}
    import pyarrow as pa

    probes = ["abcabd", "xyz abx abd", "qqq", "zzz", "", None, "ABC-abc", "abd" * 700]
    letters, count = langid.parsed(models, pa.array(probes, pa.string()))
    for probe, n, got in zip(probes, letters.tolist(), count.tolist()):
        seq = "".join(c if c.isalpha() else " " for c in (probe or "").lower())
        seq = " ".join(seq.split())
        assert n == sum(c.isalpha() for c in probe or "")
        for language, phrases in zip(models.languages, got):
            want = 0
            for at in range(0, len(seq), langid.PIECE):
                piece, i = seq[at:at + langid.PIECE], 0
                while i < len(piece):
                    k = 1
                    while i + k < len(piece) and piece[i:i + k + 1] in sample[language]:
                        k += 1
                    want, i = want + 1, i + k
            assert phrases == want, (probe, language)


def test_held_out_accuracy(spark):
    docs = read_table(spark, SMALL, "documents")
    known = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = known.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n >= 0.97


def test_languages_with_thousands_of_letters():
    """Every letter of the sample has a symbol: phrases by plain search, and two such languages told apart."""
    import random

    import pyarrow as pa

    draw = random.Random(7)
    words = [["".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(2)) for _ in range(1500)] for _ in range(2)]
    own = {k: [" ".join(draw.choices(w, k=1200)) + "abc" for _ in range(2)] for k, w in zip(("ja", "zh"), words)}
    models = langid.fitted(own)
    assert models.first.shape[1] > 2000
    probes = [" ".join(draw.choices(w, k=100)) for w in words for _ in range(5)] + [own["zh"][0][:200] + "жabж丁"]
    names, _, length, unknown = langid.judged(models, pa.array(probes))
    assert names.tolist() == ["ja"] * 5 + ["zh"] * 6
    assert all(n >= 1.2 for n in length[:10]) and all(u < 0.3 for u in unknown[:10])
    letters, count = langid.parsed(models, pa.array(probes))
    for probe, got in zip(probes, count.tolist()):
        seq = " ".join("".join(c if c.isalpha() else " " for c in probe).split())
        assert len(seq) < langid.PIECE
        for language, phrases in zip(models.languages, got):
            sample, want, i = own[language], 0, 0
            while i < len(seq):
                k = 1
                while i + k < len(seq) and any(seq[i:i + k + 1] in s for s in sample):
                    k += 1
                want, i = want + 1, i + k
            assert phrases == want, language


def test_sample_takes_passages_from_anywhere(spark):
    long = "".join(chr(0x4E00 + n % 5000) for n in range(100_000))
    rows = [(1, long, "zh")] + [(n, "the same words again and again " * 40, "en") for n in range(2, 900)]
    rows += [(1000, "other words of this language", "en"), (1001, "", "xx"), (1002, "\n\U0001F600", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = langid.sample(df)
    assert sorted(found) == ["en", "yy", "zh"] and found["yy"] == ["\n\U0001F600"]
    places = [long.index(p[:200]) for p in found["zh"]]
    assert len(found["zh"]) == len(set(found["zh"])) <= langid.PASSAGES and all(p in long for p in found["zh"]) and max(places) > 2500
    assert "other words of this language" in found["en"] and len(found["en"]) == len(set(found["en"]))
    assert found == langid.sample(df.repartition(3))


def test_each_language_has_its_own_share():
    """Sixty-four languages: one's model doesn't shrink for the others."""
    rng = np.random.default_rng(11)
    words = {f"l{n:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(60)] for n in range(64)}
    texts = {k: [" ".join(rng.choice(w, 40)) for _ in range(8)] for k, w in words.items()}
    models = langid.fitted(texts)
    sizes = [sum(len(langid.sequence(models.symbols[langid.code_points(t)])) for t in own) for own in texts.values()]
    assert np.allclose(models.bits, np.log2(np.array(sizes) + 2))
    probes = [" ".join(rng.choice(w, 12)) for w in words.values()]
    assert langid.judged(models, pa.array(probes))[0].tolist() == list(words)
