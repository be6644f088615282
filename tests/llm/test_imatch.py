import hashlib

import numpy as np
from brute import DOCS, told
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import catalog, imatch
from quayline.llm.common import read_table


def expected(rows):
    """(doc_id, n_chars, sha256 of the edited text) for rows whose ids differ."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: -r[0])
    out = []
    for (key, own), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(own) // 2
        text = own[:len(own) - half] + after[:half]
        out.append((key, len(own), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_documents(spark):
    docs = read_table(spark, SMALL, "documents")
    found = catalog.QUERIES["op9_imatch"](spark, SMALL).cache()
    assert told(found, "doc_id", "n_chars", "edited_sha256") == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    near = found.agg(F.avg("near_edited"), F.avg("near_next"), F.min("near_next"), F.max("near_edited")).first()
    assert near[0] > near[1] + 0.15 and near[2] >= 0 and near[3] <= 1
    joined = found.join(docs.select("doc_id", "text"), "doc_id")
    per_text = joined.groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert per_text.where("n > 1").count() == 0
    assert joined.select("fingerprint").distinct().count() > 0.95 * joined.select("text").distinct().count()


def test_edge_rows(spark):
    rows = [(5, "the next one"), (4, None), (3, ""), (2, "x"), (1, "é" * 9), (0, "long words here " * 4000), (-1, "!!!"), (-2, "!?!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"range": F.lit("r"), "first": F.lit(1), "fingerprint": F.lit(1)})
    found = imatch.compared(df.repartition(3))
    got = sorted((r.doc_id, r.n_chars, bytes(r.edited_sha256).hex()) for r in found.collect())
    assert got == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found.collect())
    assert imatch.fingerprinted(df).columns == ["doc_id", "text", "range", "first", "fingerprint"]


def test_ties_nulls_single_and_empty(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "no id"), (None, None)], "doc_id long, text string")
    found = {(r.doc_id, r.n_chars): r for r in imatch.compared(df).collect()}
    assert len(found) == 3 and imatch.compared(df).count() == 4
    one = imatch.compared(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and bytes(one.edited_sha256).hex() == hashlib.sha256(b"abab").hexdigest()
    assert told(imatch.compared(spark.createDataFrame([], DOCS))) == []


def test_lexicon_is_exact(spark):
    """The bounded first pass finds all terms of the band, however the rows are dealt."""
    rows = [(n, " ".join(["all", f"rare{n}", f"mod{n % 40}", f"third{n % 3}", "few" if n < 5 else ""])) for n in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    wanted = [f"mod{n}" for n in range(40)] + ["few"]
    want = np.sort(imatch.terms(np.frombuffer(" ".join(wanted).encode(), np.uint8), np.array([0, len(" ".join(wanted))]))[1])
    for parts in (1, 9):
        assert (imatch.lexicon(df.repartition(parts), 0.005, 0.1) == want).all()


def test_likeness_follows_the_share_of_terms():
    def prints(*texts):
        raw = [t.encode() for t in texts]
        return imatch.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(0, np.uint64))

    rng = np.random.default_rng(3)
    means = {}
    for share in (0.0, 0.5, 0.9, 1.0):
        found = []
        for _ in range(40):
            same = [f"w{x}" for x in rng.integers(0, 10**9, int(200 * share))]
            a, b = ([f"w{x}" for x in rng.integers(0, 10**9, 200 - len(same))] for _ in "ab")
            found.append(imatch.likeness(prints(" ".join(same + a)), prints(" ".join(b + same)))[0])
        means[share] = np.mean(found)
    assert means[1.0] == 1 and 0.7 < means[0.9] < 0.95 and 0.2 < means[0.5] < 0.5 and means[0.0] < 0.2  # an estimate that can only err upwards
