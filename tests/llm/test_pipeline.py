import hashlib
import zlib
from math import exp, lgamma, log

import corpus_pipeline
import pyarrow as pa
from brute import DOCS, chains, deduplicated, fold, near_bits, ordered, simhash, told
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import langid, mixing, packing, tokens
from quayline.llm.common import read_table, stored

NAMES = ["language", "near_duplicates", "repeated_passages", "mix", "pack"]


def stages(spark, docs):
    """The result of every stage, each written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def plain(spark, rows):
    """The rows of every stage but the last by brute force; the language models are the operator's."""
    learned = spark.createDataFrame([r for r in rows if r[0] is not None and fold(r[0], 4) != 2 and r[1] is not None and r[2] is not None], DOCS)
    models = langid.fitted(langid.sample(learned))
    names, _, length = langid.predicted(models, pa.array([r[1] for r in rows], pa.string()))
    first = [r for r, name, n in zip(rows, names, length) if name != "und" and n >= corpus_pipeline.LEAST_PHRASE]
    named = sorted((r for r in first if r[0] is not None), key=lambda r: r[0])
    prints = [simhash(r[1]) for r in named]
    second = list(dict.fromkeys(r for r, (i, c) in zip(named, enumerate(chains(prints, near_bits))) if named[c][0] == r[0]))
    second += [r for r in first if r[0] is None]
    kept = deduplicated([r[:2] for r in second])
    third = [(r[0], text, r[2], r[3], len(text)) for r, (_, text, n, gone) in zip(second, kept) if text or not gone]
    size = {}
    for r in third:
        size[r[3]] = size.get(r[3], 0) + len(r[1]) + 1
    weights = mixing.WEIGHTS
    rest = (1 - sum(w for s, w in weights.items() if s in size)) / max(sum(s not in weights for s in size), 1)
    fourth = []
    for r in third:
        rate = weights.get(r[3], rest) * sum(size.values()) / size[r[3]]
        u = int(hashlib.md5(f"{mixing.SEED}|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:mixing.DIGITS], 16) / 16**mixing.DIGITS
        below, n = 0.0, 0
        while (below := below + exp(n * log(rate) - rate - lgamma(n + 1))) <= u:
            n += 1
        fourth += [r] * n
    return [first, second, third, fourth]


def check(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = stages(spark, docs)
    for name, got, want in zip(NAMES, found, plain(spark, rows)):
        assert told(got, "doc_id", "text", "lang", "source", "n_chars") == ordered(want), name
    mixed, packed = found[-2], found[-1].collect()
    encoder = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    want, sequences = [], {}
    for r in mixed.collect():
        ids = encoder.many([r.text.encode()])[0] + (1).to_bytes(4, "little")
        want += [(r.doc_id, k // 16384, min(4096, (len(ids) - k) // 4), zlib.crc32(ids[k:k + 16384])) for k in range(0, len(ids), 16384)]
    assert ordered((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == ordered(want)
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    return found


def test_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    found = check(spark, read_table(spark, SMALL, "documents"))
    assert [f.columns for f in found[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    same = corpus_pipeline.run(spark, SMALL)
    assert told(same, "doc_id", "piece", "ids_crc32") == told(found[-1], "doc_id", "piece", "ids_crc32")


def test_edge_rows(spark):
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").limit(60).collect()]
    text = docs[0][1]
    extra = [(5001, None, "en", "s", 0), (5002, "", None, None, 0), (5003, "123 %%", "en", "s", 6), (None, text, "en", None, 1), (5004, text, None, None, None),
             (5004, text, None, None, None), (5005, "жжж ыыы " * 30, None, "s", 3), (5006, "word " * 20_000, None, "s", 3)]
    df = spark.createDataFrame(docs + extra, DOCS).withColumn("more", F.lit("kept"))
    found = check(spark, df)
    assert all("more" in f.columns for f in found[:-1])


def test_rows_of_one_doc_id_with_other_texts_stay(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "uno dos tres cuatro cinco seis siete"
    rows = [(1, a, "en", "s", 1), (1, b, "es", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "es", "s", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL)
    assert told(kept, "doc_id", "text") == [(1, a), (1, b)]


def test_empty(spark):
    assert all(told(f) == [] for f in stages(spark, spark.createDataFrame([], DOCS)))


def test_one_letter(spark):
    """Texts of a single known letter stay; without a letter or in unknown letters they go."""
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").where("lang = 'en'").limit(60).collect()]
    extra = [(6001, "A.", "en", "s", 2), (6002, "a", None, "s", 1), (6003, "1 e 2", "en", "s", 5), (6004, "I a. 7", "en", "s", 6),
             (6005, "ж", "en", "s", 1), (6006, "7.", "en", "s", 2), (6007, "жжж the", "en", "s", 7), (6008, "жжжжжжж the", "en", "s", 11)]
    # The letters outside the script are in no row that is learned from.
    extra = [(r[0], r[1], None if "ж" in r[1] else r[2], *r[3:]) for r in extra]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(docs + extra, DOCS), SMALL)
    assert {r.doc_id for r in kept.collect() if r.doc_id > 6000} == {6001, 6002, 6003, 6004, 6007}
