from brute import DOCS, chains, near_bits, ordered, simhash as plain, told
from conftest import SMALL
from pyspark.sql import functions as F

import numpy as np
from quayline.llm import components, simhash
from quayline.llm.common import read_table


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain(text) for _, text in rows]
    return ordered((key, f"{p:016x}", rows[c][0]) for (key, _), p, c in zip(rows, prints, chains(prints, near_bits)))


def found(df, **more):
    return told(simhash.components(df, **more).select(
        "doc_id", simhash.hex_digits(F.col("simhash")).alias("fingerprint"), "component_id"))


def test_against_brute_force_with_and_without_split_groups(spark):
    docs = read_table(spark, SMALL, "documents")
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert found(docs) == want
    assert found(docs, group=2) == want
    assert any(c != d for d, _, c in want)


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (2, "One"), (2, "One"), (1, "ONE"), (None, "one"), (7, "a b"),
            (8, "x" * 100_000), (None, "alone again and again"), (4, "É é"), (6, "a b c a b c a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"simhash": F.lit("x"), "component_id": F.lit(0)})
    assert found(df) == expected(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], DOCS)) == []


def test_chain_of_links(spark):
    """Each fingerprint differs from the next in three bits: one component over many rounds."""
    codes = [0]
    for n in range(60):
        codes.append(codes[-1] ^ (0b111 << (3 * (n % 20))) ^ (n & 1))
    codes = list(dict.fromkeys(codes))
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "simhash long")
    for group in (4096, 2):
        links = simhash.links(df, group)
        parent = {r.node: r.component for r in components.connected_components(links).collect()}
        want = chains(codes, near_bits)
        got = [parent.get(int(np.uint64(c).astype(np.int64)), c) for c in codes]
        groups = {}
        for w, g in zip(want, got):
            groups.setdefault(w, set()).add(g)
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_gray_index_finds_all_neighbours():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(7 << 9)]))
    group = np.sort(rng.integers(0, 3, len(codes)))
    index = simhash.GrayIndex(group, codes)
    place = group[index.order]
    got = {(a, b) for x, y in index.neighbours(place) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes))
            if place[a] == place[b] and near_bits(int(index.codes[a]), int(index.codes[b]))}
    assert got == want


def test_components_of_a_star_and_a_path(spark):
    links = [(0, n) for n in range(1, 300)] + [(1000 + n, 1001 + n) for n in range(70)] + [(5, 5), (None, 3), (2, 0)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, components.connected_components(df).collect()))
    assert got == {n: 0 for n in range(300)} | {1000 + n: 1000 for n in range(71)}
