"""Phrases whose words keep together: counts of all n-grams from indexes over shards, scored by their weakest cut.

A shard is a few megabytes of one language's text. Its bidirectional FM-index is over word ids; extending
intervals to the right counts phrases, extending them to the left and right tells by which words they go on.
Counts are summed over shards. A phrase can't occur oftener than its parts, so a shard goes on length by length:
it asks which of its phrases reach the threshold in the whole corpus, and extends only those, to either end, in
its index; no phrase that reaches it is lost. Shards ask and are answered by buckets of hashed words or keys.

A null text counts as empty, a null language as `und`. Repeated rows count each time. An empty table, or one
without a phrase that is frequent enough, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, mixed, stored, text_buffer, word_hashes
from quayline.llm.ngram import LOWER, deltas, squeezed, undeltas, unsqueezed
from quayline.session import scratch_path
from quayline.sources.tables import drop_folder

#: Words of the longest phrase, the least count of a phrase, and how many of each language are reported.
DEPTH, LEAST, MOST = 5, 100, 2000
NO_LANGUAGE = "und"
#: Text of a shard, and of all shards that a task fills at a time.
SHARD_BYTES, TASK_BYTES = 6 << 20, 18 << 20
#: Text of the corpus for each bucket in which words, and phrases of one length, are counted.
BUCKET_BYTES = 12 << 20
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
BREAK, GAP = re.compile(rb"[.,;:!?\n\x0b\x0c\r]"), re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
#: Exact up to 10**17 words: products pass 64 bits, a score never does, for `l` and `r` are at least `a`.
SCORE = "(1000BD * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))"
SHARDS = "shard long, sign int, lang string, bucket int, n int, keys binary, counts binary, places binary, tokens binary"


def parts(raw: bytes, most: int = SHARD_BYTES) -> Iterator[tuple[int, bytes]]:
    """(sign, text) of a text cut into parts whose n-grams, added with their signs, are those of the text.

    A cut falls on a break between pieces. In a piece that is too long for that it falls on a blank: the
    words after it that phrases may reach over come along and are taken off once.
    """
    at = 0
    while len(raw) - at > most:
        found = BREAK.search(raw, at + (most + 1) // 2, at + most + 1)
        if found:
            yield 1, raw[at:found.start()]
        else:
            found = GAP.search(raw, at + most)
            if not found:
                break
            over = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (DEPTH - 1)).match(raw, found.start())
            yield 1, raw[at:over.end()]
            yield -1, over[0]
        at = found.start()
    yield 1, raw[at:]


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words by descending count, their counts, and the words' places from 1 with 0 for each break."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = KIND[data]
    word = kind == 0
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    own = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[word]))]
    ).dictionary_encode()
    codes = own.indices.to_numpy()
    counts = np.bincount(codes)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
    broken = np.flatnonzero(np.diff(np.cumsum(kind == 2)[starts]))
    return own.dictionary.take(pa.array(order)).to_pylist(), counts[order], np.insert(place[codes], broken + 1, 0)


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return (word_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The stretches of ascending buckets that hold something."""
    bounds = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return [(b, slice(x, y)) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]


def packed(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpacked(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


def shards(docs: DataFrame, buckets: int, size: int = SHARD_BYTES) -> DataFrame:
    """Rows of many texts of one language: the text, as places in a list of its words, comes with bucket -1.

    The words a shard asks for come by the bucket of their hash, with their counts; `places` of the text's row
    tells for each of them, in that order, its place in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[str, int], list[bytes]] = {}
        sizes: dict[tuple[str, int], int] = {}

        def filled(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            words, counts, tokens = coded(held.pop(key))
            del sizes[key]
            if not words:
                return
            bucket = word_buckets(words, buckets)
            order = np.argsort(bucket, kind="stable")
            own = {"shard": number, "lang": key[0], "sign": key[1]}
            rows = [own | {"bucket": -1, "n": len(tokens), "tokens": squeezed(tokens), "places": squeezed(order.astype(np.uint32))}]
            for b, part in by_bucket(bucket[order], buckets):
                some = order[part]
                rows.append(own | {
                    "bucket": b, "n": len(some), "keys": packed([words[i] for i in some.tolist()]),
                    "counts": squeezed(counts[some].astype(np.uint32)),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)
            number += 1

        for batch in batches:
            data, bounds = text_buffer(batch["text"])
            whole = data.tobytes()
            for lang, a, b in zip(batch["lang"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                for sign, part in parts(whole[a:b], size) if b > a else ():
                    key = (lang, sign)
                    held.setdefault(key, []).append(part)
                    sizes[key] = sizes.get(key, 0) + len(part) + 1
                    if sizes[key] >= size:
                        yield from filled(key)
                    elif sum(sizes.values()) >= TASK_BYTES:
                        yield from filled(max(sizes, key=sizes.get))
        for key in list(held):
            yield from filled(key)

    schema = pa.schema([
        ("shard", pa.int64()), ("sign", pa.int32()), ("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()),
        *((c, pa.binary()) for c in ("keys", "counts", "places", "tokens")),
    ])
    read = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").where("text IS NOT NULL")
    return in_batches(read).mapInArrow(run, SHARDS)


class Half:
    """One direction of the index: what stands before each place, in the order of what follows it up to a depth.

    Intervals of phrases are exact up to that depth; text further on doesn't take part in the order.
    """

    def __init__(self, text: np.ndarray, depth: int):
        # Ranks of the runs of 1, 2, 4 ... words from each place; the last step overlaps.
        rank, width = text.astype(np.int64), 1
        while width < depth:
            step = min(width, depth - width)
            later = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank, width = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1], width + step
        #: The places in that order.
        self.places = np.argsort(rank, kind="stable")
        self.bwt = text[self.places - 1].astype(np.int64)
        #: Above all rows and all words.
        self.base = max(len(text), int(text.max())) + 1
        #: For each word, the ascending rows it stands before.
        self.occurrences = np.sort(self.bwt * self.base + np.arange(len(text)))

    def intervals(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, low, size) of the phrases whose id stands at each of their places; 0 is none."""
        ids = grams[self.places]
        low = np.flatnonzero((ids > 0) & (np.concatenate([[0], ids[:-1]]) != ids))
        order = low[np.argsort(ids[low])]
        return ids[order], order, np.bincount(np.searchsorted(ids[order], ids[ids > 0]), minlength=len(order))

    def extended(self, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        """All extensions of the intervals by one word: (interval, word, low, low in the other half, size)."""
        of = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
        keys, count = np.unique(of * self.base + self.bwt[rows], return_counts=True)
        of, word = keys // self.base, keys % self.base
        smaller = np.cumsum(count) - count
        first = np.searchsorted(of, of)
        # Rows of the extended phrase: those of the word, from as many on as the word stands before earlier rows.
        found = np.searchsorted(self.occurrences, word * self.base + low[of])
        kept = word > 0
        return of[kept], word[kept], found[kept], (other[of] + smaller - smaller[first])[kept], count[kept]


class Index:
    """A bidirectional FM-index over word ids, for phrases of up to `depth` words; 0 parts pieces, no phrase holds it."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = np.concatenate([text, [0]]), depth
        self.before, self.after = Half(self.text, depth), Half(self.text[::-1], depth)

    def longer(self, grams: np.ndarray):
        """(ids, words that follow, counts, low): the phrases of `depth` words both of whose shorter parts are known.

        `grams` holds, at each place, the id of the known phrase of depth - 1 words that starts there, or 0.
        Known phrases are extended to both ends: what comes out at both has a known start and a known rest.
        """
        grams = np.concatenate([grams, [0]])
        ids, low, size = self.before.intervals(grams)
        # The same phrases read backwards start where they end.
        place = np.flatnonzero(grams)
        backwards = np.zeros_like(grams)
        backwards[len(grams) - place - (self.depth - 1)] = grams[place]
        _, other, _ = self.after.intervals(backwards)
        _, _, left, _, _ = self.before.extended(low, other, size)
        of, word, _, right, count = self.after.extended(other, low, size)
        both = np.isin(right, left)
        return ids[of[both]], word[both], count[both], right[both]

    def places(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, place) of all occurrences."""
        of = np.repeat(np.arange(len(size)), size)
        return of, self.before.places[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]]


def first_grams(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of words, text, ids of the phrases of one word) of a shard, from the answers to the words it asked."""
    tokens = unsqueezed(batch["tokens"][i].as_py(), "<u4", batch["n"][i].as_py())
    values = answers_of(batch, i)
    ids = np.zeros(len(values), np.int64)
    ids[unsqueezed(batch["places"][i].as_py(), "<u4", len(values))] = values
    own = np.zeros(len(ids) + 1, np.int64)
    own[1:] = np.where(ids > 0, np.cumsum(ids > 0), 0)
    text = own[tokens]
    text = text[(text > 0) | (np.concatenate([[1], text[:-1]]) > 0)]
    ids = ids[ids > 0]
    return ids, text, np.concatenate([[0], ids])[text]


def next_grams(batch: pa.RecordBatch, i: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of words, text, ids of phrases of `depth` words) of a shard, from the answers to what it asked."""
    n, n_ids = batch["n"][i].as_py(), batch["n_ids"][i].as_py()
    ids = unsqueezed(batch["ids"][i].as_py(), "<u4", n_ids).astype(np.int64)
    text = unsqueezed(batch["tokens"][i].as_py(), "<u4", n).astype(np.int64)
    at = pair_places(ids, text, batch["buckets"][i].as_py()) if depth == 2 else unsqueezed(batch["at"][i].as_py(), "<u4", n)
    grams = np.concatenate([[0], answers_of(batch, i)]).astype(np.int64)[at]
    return ids, *cut(text, grams, depth)


def answers_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.concatenate([unsqueezed(x["values"], "<u4", x["n"]) for x in batch["answers"][i].as_py()])


def pair_places(ids: np.ndarray, text: np.ndarray, buckets: int) -> np.ndarray:
    """Which of a shard's asked pairs, from 1, starts at each place: all pairs of known words, so nothing need be kept."""
    place = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
    keys = gram_keys(ids[text[place] - 1], ids[text[place + 1] - 1])
    found, own = np.unique(keys, return_inverse=True)
    order = np.lexsort((found, key_buckets(found, buckets)))
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(1, len(found) + 1)
    at = np.zeros(len(text), np.int64)
    at[place] = rank[own]
    return at


def gram_keys(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A phrase by the id of its words but the last, and the last word's id."""
    return (start.astype(np.uint64) << np.uint64(32)) | last.astype(np.uint64)


def key_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def cut(text: np.ndarray, grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and phrases with a break between words that no phrase has side by side, without the words left alone."""
    place = np.flatnonzero(grams)
    edges = np.zeros(len(text) + depth, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + depth - 1, -1)
    linked = np.cumsum(edges)[:len(text)] > 0  # to the next word
    text = np.where(linked | np.concatenate([[False], linked[:-1]]), text, 0)
    breaks = np.flatnonzero(~linked) + 1
    text, grams = np.insert(text, breaks, 0), np.insert(grams, breaks, 0)
    kept = (text > 0) | (np.concatenate([[0], text[:-1]]) > 0)
    return text[kept], grams[kept]


def level(held: DataFrame, depth: int, buckets: int, last: bool) -> DataFrame:
    """Shards with the phrases of `depth` words they ask for; a shard's text comes with bucket -1.

    `at` holds for each place which of the asked phrases, from 1, starts there; keys come by bucket, ascending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, text, grams = first_grams(batch, i) if depth == 2 else next_grams(batch, i, depth - 1)
                if grams.any():
                    yield from shard(batch["shard"][i].as_py(), batch["sign"][i].as_py(), ids, text, grams)

    def shard(number: int, sign: int, ids: np.ndarray, text: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = Index(text, depth)
        start, word, count, low = index.longer(grams)
        keys = gram_keys(start, ids[word - 1])
        bucket = key_buckets(keys, buckets)
        order = np.lexsort((keys, bucket))
        if not len(order):
            return
        own = {"shard": number, "sign": sign}
        rows = [own | {
            "bucket": -1, "n": len(text), "n_ids": len(ids), "buckets": buckets, "ids": squeezed(ids.astype(np.uint32)),
            "tokens": squeezed(text.astype(np.uint32)), "at": None,
        }]
        if last:
            rows = []  # nothing goes on from here
        elif depth > 2:
            of, place = index.places(low[order], count[order])
            at = np.zeros(len(text) + 1, np.uint32)
            at[place] = of + 1
            rows[0]["at"] = squeezed(at[:-1])
        keys, count = keys[order], count[order].astype(np.uint32)
        for b, part in by_bucket(bucket[order], buckets):
            rows.append(own | {"bucket": b, "n": part.stop - part.start, "keys": deltas(keys[part]), "counts": squeezed(count[part])})
        yield pa.RecordBatch.from_pylist(rows, schema)

    columns = "shard long, sign int, bucket int, n int, n_ids int, buckets int, ids binary, tokens binary, at binary, keys binary, counts binary"
    schema = pa.schema([
        ("shard", pa.int64()), *((c, pa.int32()) for c in ("sign", "bucket", "n", "n_ids", "buckets")),
        *((c, pa.binary()) for c in ("ids", "tokens", "at", "keys", "counts")),
    ])
    return held.mapInArrow(run, columns)


def in_buckets(asks: DataFrame, summed, columns: str, schema: pa.Schema) -> DataFrame:
    """`summed` over all asks of each bucket; buckets are hashed, each once for a shard, so they are alike in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield pa.RecordBatch.from_pylist(summed(held), schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(summed(held), schema)

    return asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, columns)


def frequent_ids(total: np.ndarray, least: int, bucket: int, buckets: int, taken: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which totals are frequent, and an id for each of all, 0 for the others: nearly dense, rank in the bucket by buckets."""
    often = np.flatnonzero(total >= least)
    values = np.zeros(len(total), np.int64)
    values[often] = 1 + bucket + (taken + np.arange(len(often))) * buckets
    if len(often) and values[often[-1]] >= 1 << 32:
        raise ValueError("more frequent phrases of one length than 32-bit ids")
    return often, values


def answered_words(asks: DataFrame, buckets: int, least: int) -> DataFrame:
    """(shard, bucket, n, values) with each shard's answers: a frequent word's id, or 0.

    A bucket's frequent words come with shard -1, a row for each language, beside the count of all its words.
    """

    def summed(held: list[dict]) -> list[dict]:
        bucket, taken, rows = held[0]["bucket"], 0, []
        for lang in sorted({row["lang"] for row in held}):
            own = [row for row in held if row["lang"] == lang]
            words = pa.array([w for row in own for w in unpacked(row["keys"])], pa.large_binary()).dictionary_encode()
            counts = np.concatenate([unsqueezed(r["counts"], "<u4", r["n"]).astype(np.int64) * r["sign"] for r in own])
            total = np.zeros(len(words.dictionary), np.int64)
            at = words.indices.to_numpy()
            np.add.at(total, at, counts)
            often, values = frequent_ids(total, least, bucket, buckets, taken)
            taken += len(often)
            spelt = [w.decode() for w in words.dictionary.take(pa.array(often)).to_pylist()]
            rows.append({
                "shard": -1, "bucket": bucket, "n": len(often), "lang": lang, "total": int(total.sum()), "word": spelt,
                "f": total[often], "id": values[often],
            })
            ends = np.cumsum([r["n"] for r in own]).tolist()
            rows += [
                {"shard": r["shard"], "bucket": bucket, "n": r["n"], "values": squeezed(values[at[e - r["n"]:e]].astype(np.uint32))}
                for r, e in zip(own, ends)
            ]
        return rows

    schema = pa.schema([
        ("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("values", pa.binary()), ("lang", pa.string()),
        ("total", pa.int64()), ("word", pa.list_(pa.string())), ("f", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())),
    ])
    columns = "shard long, bucket int, n int, values binary, lang string, total long, word array<string>, f array<long>, id array<long>"
    return in_buckets(asks, summed, columns, schema)


def answered(asks: DataFrame, buckets: int, least: int, last: bool) -> DataFrame:
    """(shard, bucket, n, values) with each shard's answers: a frequent phrase's id, or 0.

    A bucket's frequent phrases come with shard -1: their starts, last words, counts and ids.
    """

    def summed(held: list[dict]) -> list[dict]:
        bucket = held[0]["bucket"]
        keys, at = np.unique(np.concatenate([undeltas(r["keys"], r["n"]) for r in held]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([unsqueezed(r["counts"], "<u4", r["n"]).astype(np.int64) * r["sign"] for r in held]))
        often, values = frequent_ids(total, least, bucket, buckets)
        rows = [{
            "shard": -1, "bucket": bucket, "n": len(often), "start": (keys[often] >> np.uint64(32)).astype(np.int64),
            "last": (keys[often] & np.uint64(0xFFFFFFFF)).astype(np.int64), "f": total[often], "id": values[often],
        }]
        if last:
            return rows  # no shard asks further
        ends = np.cumsum([r["n"] for r in held]).tolist()
        return rows + [
            {"shard": r["shard"], "bucket": bucket, "n": r["n"], "values": squeezed(values[at[e - r["n"]:e]].astype(np.uint32))}
            for r, e in zip(held, ends)
        ]

    lists = ("start", "last", "f", "id")
    schema = pa.schema([
        ("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("values", pa.binary()), *((c, pa.list_(pa.int64())) for c in lists),
    ])
    return in_buckets(asks, summed, "shard long, bucket int, n int, values binary, " + ", ".join(f"{c} array<long>" for c in lists), schema)


def with_answers(texts: DataFrame, answers: DataFrame) -> DataFrame:
    own = answers.where("shard >= 0").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "values"))).alias("answers"))
    return texts.where("bucket = -1").join(own, "shard")


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A table as `stored` leaves it, and its folder: what the next length has been written from is removed."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def frequent(held: DataFrame, folder: str, words: DataFrame, depth: int, least: int, buckets: int) -> DataFrame:
    """(gram, f): all phrases of 2 to `depth` words, as ids of words, that are frequent in the corpus."""
    state = with_answers(held.select("shard", "sign", "bucket", "n", "places", "tokens"), words)
    grams = shorter = None
    for k in range(2, depth + 1):
        step, own = kept(level(state, k, buckets, k == depth), f"phrases-{k}")
        drop_folder(held.sparkSession, folder)
        folder = own
        answers = stored(answered(step.where("bucket >= 0").select("bucket", "shard", "sign", "n", "keys", "counts"), buckets, least, k == depth), f"phrase-answers-{k}")
        found = answers.where("shard = -1").select(F.inline(F.arrays_zip("start", "last", "f", "id")))
        if shorter is None:
            found = found.select("id", F.array("start", "last").alias("gram"), "f")
        else:
            starts = shorter.select(F.col("id").alias("start"), F.col("gram").alias("words"))
            found = found.join(starts, "start").select("id", F.concat("words", F.array("last")).alias("gram"), "f")
        shorter = stored(found, f"phrase-counts-{k}")
        grams = shorter.select("gram", "f") if grams is None else grams.unionByName(shorter.select("gram", "f"))
        state = with_answers(step.drop("keys", "counts"), answers)
    drop_folder(held.sparkSession, folder)
    return grams


def mined(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, most: int = MOST, size: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `depth` words.

    `a` is a phrase's count, `l` and `r` those of the two parts at its weakest cut, `n` the words of its
    language; score is floor(1000 * a * n / (l * r)). A phrase goes if one that is a word longer is as frequent.
    """
    docs = docs.select("lang", "text")
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    held, folder = kept(shards(docs, buckets, size), "phrase-shards")
    asks = held.where("bucket >= 0").select("bucket", "shard", "sign", "lang", "n", "keys", "counts")
    words = stored(answered_words(asks, buckets, least), "phrase-words")
    own = words.where("shard = -1")
    totals = own.groupBy("lang").agg(F.sum("total").alias("n"))
    known = own.select("lang", F.inline(F.arrays_zip("word", "f", "id")))
    grams = frequent(held, folder, words, depth, least, buckets)
    everything = grams.unionByName(known.select(F.array("id").alias("gram"), "f"))
    # A phrase whose extension by a word, at either end, is as frequent goes.
    inner = grams.where("size(gram) > 2").select(
        F.explode(F.expr("array(slice(gram, 1, size(gram) - 1), slice(gram, 2, size(gram) - 1))")).alias("gram"), F.col("f").alias("longer")
    ).groupBy("gram").agg(F.max("longer").alias("longer"))
    open_ended = grams.join(inner, "gram", "left").where("longer IS NULL OR longer < f").select("gram", F.col("f").alias("a"))
    cuts = open_ended.select("gram", "a", F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    for side, part in (("l", "slice(gram, 1, k)"), ("r", "slice(gram, k + 1, size(gram) - k)")):
        cuts = cuts.withColumn("part", F.expr(part)).join(
            everything.select(F.col("gram").alias("part"), F.col("f").alias(side)), "part"
        ).drop("part")
    totals = known.select("id", "lang").join(totals, "lang")
    cuts = cuts.withColumn("id", F.col("gram")[0]).join(totals, "id").withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = best.select("lang", "gram", "a", "n", "cut.*", F.posexplode("gram").alias("at", "id")).join(known.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "gram", "a", "l", "r", "n", "score").agg(
        F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt")
    ).withColumn("phrase", F.array_join(F.col("spelt.word"), " "))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelt.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def check_sql(depth: int = DEPTH, least: int = LEAST, most: int = MOST) -> str:
    """The same rows by SQL that lists every n-gram."""
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, unnest([words[i:i + {k - 1}] for i in range(1, len(words) - {k} + 2)]) AS gram FROM pieces WHERE len(words) >= {k}"
        for k in range(1, depth + 1)
    )
    return rf"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, [w for w in regexp_split_to_array(piece, '[\x20\x09]+') if w <> ''] AS words FROM split
), grams AS (
  {grams}
), counts AS (
  SELECT lang, gram, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), longer AS (
  SELECT lang, inner_gram, max(f) AS f FROM (
    SELECT lang, f, unnest([gram[1:len(gram) - 1], gram[2:len(gram)]]) AS inner_gram FROM counts WHERE len(gram) > 2
  ) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.gram, c.f AS a, unnest(range(1, len(c.gram))) AS k
  FROM counts c LEFT JOIN longer x ON c.lang = x.lang AND c.gram = x.inner_gram
  WHERE len(c.gram) > 1 AND (x.f IS NULL OR x.f < c.f)
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON c.lang = l.lang AND l.gram = c.gram[1:c.k]
    JOIN counts r ON c.lang = r.lang AND r.gram = c.gram[c.k + 1:len(c.gram)] JOIN totals t ON c.lang = t.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS place FROM scored
), ranked AS (
  SELECT *, array_to_string(gram, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank
  FROM best WHERE place = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {most}
"""
