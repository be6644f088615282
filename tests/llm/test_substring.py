import hashlib

import pytest
from brute import DOCS, deduplicated as plain, ordered, told
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import catalog, substring
from quayline.llm.common import read_table

BASE = " ".join(f"w{i}" for i in range(120))


def rows():
    out = [(1, "x " * 300), (2, "x " * 200 + BASE), (3, f"{BASE} q {BASE}"), (4, None), (5, ""), (None, BASE),
           (6, "a b " * 150), (7, "pre " + BASE[50:] + " a b" * 80), (7, BASE), (8, BASE), (8, BASE), (9, "\t \n"),
           (10, "y" * 50_000 + " " + BASE), (11, "É é   " + BASE)]
    for i in range(30):  # one passage between words that no other document has
        around = [" ".join(f"{c}{i}_{k}" for k in range(i + 1)) for c in "uvz"]
        out.append((100 + i, f"{around[0]} {BASE} {around[1]} {BASE} {around[2]}"))
    return out


@pytest.mark.parametrize("passages", [16, 1, 10_000])
def test_against_brute_force(spark, passages):
    """The same whether anchors with many passages are filed by window or not."""
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5).withColumn("row", F.lit(1)).withColumn("kept", F.lit(1))
    got = told(substring.deduplicated(df, passages=passages), "doc_id", "kept", "n_words", "n_removed")
    assert got == ordered(plain(rows()))


def test_documents(spark):
    docs = read_table(spark, SMALL, "documents")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = told(catalog.QUERIES["op1_substring_dedup"](spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, kept, n, gone in want)
    assert sum(gone for *_, gone in want) > 0


def test_carried_columns_and_empty(spark):
    df = spark.createDataFrame([(1, BASE, "s", "t"), (2, BASE + " tail", None, "u")], "doc_id long, text string, source string, row string")
    got = told(substring.deduplicated(df, carry=["source", "row"]), "doc_id", "kept", "source", "row")
    assert got == [(1, BASE, "s", "t"), (2, "tail", None, "u")]
    assert told(substring.deduplicated(spark.createDataFrame([], DOCS))) == []


def test_automaton_knows_smallest_owners():
    automaton = substring.SuffixAutomaton()
    texts = [(7, "abcbc"), (3, "bcbd"), (9, "abcbc"), (5, "zzzz")]
    for owner, text in texts:
        automaton.add(list(text), owner)
    automaton.settle()
    for probe in ("abcbcbd", "zzbc", "q", "bcbcb"):
        for width in (1, 2, 3, 4):
            want = [min([o for o, t in texts if probe[i:i + width] in t], default=1 << 63) for i in range(len(probe) - width + 1)]
            assert automaton.least_owners(list(probe), width) == want
