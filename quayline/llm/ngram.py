"""Language-model scores: n-gram estimates of two orders, mixed by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import M1, M2, fold, in_batches, mixed, slices, stored, text_buffer, word_bounds, word_hashes

#: Text of a chunk: documents whose n-grams are asked for together, once for each distinct one.
CHUNK_BYTES = 12 << 20
#: Tokens for each shard of the counts; the number of shards follows the corpus.
SHARD_TOKENS = 3_000_000
#: Steps of log2(ratio) in the held-out counts that expectation-maximisation sees.
RATIO_STEPS = 8
ROUNDS = 50
#: The tokens that no word can be: the end of a text, and what stands before its first token.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CHUNKS = (
    "chunk long, asks int, doc_ids array<long>, held_out array<boolean>, part array<int>, counts array<int>, "
    "words binary, tokens binary"
)


def squeezed(values: np.ndarray) -> bytes:
    """Compressed bytes of integers, each byte's place apart from the others."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unsqueezed(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).reshape(-1).view(kind)


def deltas(keys: np.ndarray) -> bytes:
    """Compressed ascending keys."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def undeltas(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(raw, "<u8", n), dtype=np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of many documents: their tokens as places in the chunk's own list of word hashes.

    `part` is 0 for a document that isn't learned from, 1 for one that is, 2 for one that is learned
    from and held out while the mixture weights are. The latter come once more, in chunks with `asks`
    1 that only ask for counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK_BYTES):
            part = batch["part"].to_numpy(zero_copy_only=False)
            held = np.flatnonzero(part == 2)
            for asks, rows in ((0, batch), (1, batch.take(pa.array(held)))):
                if rows.num_rows:
                    yield row(number, asks, rows)
                    number += 1

    def row(number: int, asks: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = text_buffer(batch["text"])
        data = LOWER[data]
        starts, ends, before = word_bounds(data, bounds)
        counts = np.diff(before) + 1
        last = np.cumsum(counts) - 1
        hashes = np.empty(last[-1] + 1, np.uint64)
        is_word = np.ones(len(hashes), bool)
        is_word[last] = False
        hashes[last] = END
        hashes[is_word] = word_hashes(data, starts, ends)
        words, tokens = np.unique(hashes, return_inverse=True)
        # Frequent words get small places, which compress well.
        order = np.argsort(-np.bincount(tokens), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return pa.RecordBatch.from_pylist([{
            "chunk": number, "asks": asks, "doc_ids": batch["doc_id"].to_pylist(),
            "held_out": batch["held_out"].to_pylist(), "part": batch["part"].to_pylist(), "counts": counts.tolist(),
            "words": squeezed(words[order]), "tokens": squeezed(place[tokens]),
        }], pa.schema([
            ("chunk", pa.int64()), ("asks", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
            ("part", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary()),
        ]))

    return docs.mapInArrow(run, CHUNKS)


class Chunk:
    """A row of `chunks`, with the keys of its words and of its pairs of tokens. Keys of words are odd."""

    def __init__(self, row: dict):
        self.counts = row["counts"].values.to_numpy()
        self.part = np.repeat(row["part"].values.to_numpy(), self.counts)
        n = int(self.counts.sum())
        self.tokens = unsqueezed(row["tokens"].as_py(), "<u4", n)
        raw = row["words"].as_py()
        self.words = unsqueezed(raw, "<u8", int(self.tokens.max()) + 1)
        self.first = np.cumsum(self.counts) - self.counts
        now = self.words[self.tokens]
        before = np.concatenate([[START], now[:-1]])
        before[self.first] = START
        pairs, self.pair = np.unique(mixed(before * M1 + mixed(now + M2)) & ~np.uint64(1), return_inverse=True)
        keys = np.concatenate([mixed(self.words) | np.uint64(1), pairs])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def own(self, part: int) -> np.ndarray:
        """How often each key occurs in documents of a part, in the order of the keys."""
        mine = self.part == part
        n = len(self.words)
        found = np.concatenate([
            np.bincount(self.tokens[mine], minlength=n), np.bincount(self.pair[mine], minlength=len(self.keys) - n)
        ])
        return found[self.order].astype(np.uint32)

    def looked_up(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token: the word's value and the pair's, from values in the order of the keys."""
        back = np.empty_like(values)
        back[self.order] = values
        return back[self.tokens], back[len(self.words):][self.pair]

    def contexts(self, word: np.ndarray, texts: int) -> np.ndarray:
        """How often what stands before each token occurs; `texts` is that of the start."""
        out = np.concatenate([[texts], word[:-1]])
        out[self.first] = texts
        return out


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch[name][i] for name in batch.schema.names}


def asked(held: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, n, keys, base, deleted): each chunk's keys by shard, with its own counts of parts 1 and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk(row)
                base, deleted = chunk.own(1), chunk.own(2)
                if row["asks"].as_py():
                    base, deleted = np.zeros_like(base), np.zeros_like(base)
                # Shards are ranges of the keys, and a shard's keys stay in order.
                edge = np.searchsorted(chunk.keys, shard_edges(shards)).tolist()
                pieces = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edge, [*edge[1:], len(chunk.keys)])) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in pieces], pa.int32()), pa.array([row["chunk"].as_py()] * len(pieces), pa.int64()),
                    pa.array([p.stop - p.start for _, p in pieces], pa.int32()),
                    pa.array([deltas(chunk.keys[p]) for _, p in pieces], pa.binary()),
                    *(pa.array([squeezed(x[p]) for _, p in pieces], pa.binary()) for x in (base, deleted)),
                ], ["shard", "chunk", "n", "keys", "base", "deleted"])

    return held.mapInArrow(run, "shard int, chunk long, n int, keys binary, base binary, deleted binary")


def shard_edges(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(shards)], np.uint64)


def answered(asks: DataFrame) -> DataFrame:
    """(chunk, shard, n, base, deleted, sums): the corpus counts of each chunk's keys; a shard's sums come with chunk -1.

    A shard is a range of the hashed keys: about as many keys in each, and each key once for a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in rows_of(batch):
                if held and row["shard"] != held[0]["shard"]:
                    yield from shard(held)
                    held = []
                held.append(row)
        if held:
            yield from shard(held)

    def shard(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sizes = [r["n"].as_py() for r in rows]
        keys, at = np.unique(
            np.concatenate([undeltas(r["keys"].as_py(), n) for r, n in zip(rows, sizes)]), return_inverse=True
        )
        base, deleted = (
            np.bincount(at, np.concatenate([unsqueezed(r[c].as_py(), "<u4", n) for r, n in zip(rows, sizes)]), len(keys)).astype(np.uint32)
            for c in ("base", "deleted")
        )
        word = keys & np.uint64(1) == 1
        sums = [int(x) for x in (
            base[word].sum(), (base[word] > 0).sum(), (base + deleted)[word].sum(), ((base + deleted)[word] > 0).sum()
        )]
        ends = np.cumsum(sizes)
        own = [at[e - n:e] for e, n in zip(ends.tolist(), sizes)]
        yield pa.RecordBatch.from_arrays([
            pa.array([-1, *(r["chunk"].as_py() for r in rows)], pa.int64()),
            pa.array([r["shard"].as_py() for r in (rows[0], *rows)], pa.int32()), pa.array([0, *sizes], pa.int32()),
            *(pa.array([b"", *(squeezed(x[o]) for o in own)], pa.binary()) for x in (base, deleted)),
            pa.array([sums, *([None] * len(rows))], pa.list_(pa.int64())),
        ], ["chunk", "shard", "n", "base", "deleted", "sums"])

    dealt = asks.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "chunk long, shard int, n int, base binary, deleted binary, sums array<long>")


def bucket(context: np.ndarray) -> np.ndarray:
    """By how often the context occurs: one bucket for each power of two."""
    return np.frexp(context.astype(np.float64))[1]


def joined(held: DataFrame, answers: DataFrame) -> DataFrame:
    own = answers.where("chunk >= 0").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("shard", "n", "base", "deleted"))).alias("answers")
    )
    return held.join(own, "chunk")


def counted(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """A chunk, and the corpus counts of its keys in parts 1 and 2."""
    chunk = Chunk(row)
    found = []
    for name in ("base", "deleted"):
        parts = [unsqueezed(a[name].as_py(), "<u4", a["n"].as_py()) for a in row["answers"]]
        found.append(np.concatenate(parts).astype(np.int64))
    return chunk, *found


def held_out_counts(rows: DataFrame, tokens: int, words: int, texts: int) -> DataFrame:
    """(bucket, ratio, n): held-out tokens by the context's bucket and the ratio of the two estimates from part 1.

    `ratio` is in steps of the logarithm; null where the pair isn't in part 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                chunk, base, _ = counted(row)
                word, pair = chunk.looked_up(base)
                context = chunk.contexts(word, texts)
                single = (word + 0.5) / (tokens + 0.5 * (words + 1))
                seen = pair > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.round(RATIO_STEPS * np.log2(pair / context / single))
                table = np.stack([bucket(context)[context > 0], np.where(seen, ratio, -(1 << 30))[context > 0].astype(np.int64)])
                kinds, n = np.unique(table, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds[0].astype(np.int32)), pa.array(kinds[1].astype(np.int32)), pa.array(n)], ["bucket", "ratio", "n"]
                )

    found = rows.mapInArrow(run, "bucket int, ratio int, n long")
    return found.groupBy("bucket", F.when(F.col("ratio") > -(1 << 30), F.col("ratio")).alias("ratio")).agg(F.sum("n").alias("n"))


def mixture(counts: list[tuple[int, int | None, int]]) -> np.ndarray:
    """The weight of the pair's estimate for each bucket, by expectation-maximisation; 0 for a bucket without counts."""
    weight = np.zeros(65)
    for b in {b for b, _, _ in counts}:
        ratio = np.array([0.0 if r is None else 2.0 ** (r / RATIO_STEPS) for k, r, _ in counts if k == b])
        n = np.array([n for k, _, n in counts if k == b], float)
        w = 0.5
        for _ in range(ROUNDS):
            w = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weight[b] = w
    return weight


def scored(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 5, held_out: int = 1, deleted: int = 25,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words between ASCII blanks with A-Z lower-cased, and one end. Learns from documents
    whose crc32 of the doc_id as text is not `held_out` modulo `parts`. `base_score` is the log10
    probability under add-one-half word frequencies, with one more word than there are. `score` mixes
    that probability p(w) with the frequency of w after the token h before it (or the start of text):
    L c(h, w) / c(h) + (1 - L) p(w). The weight L goes by the bucket of c(h), a power of two, and is 0
    where c(h) is; it is learned by expectation-maximisation on the counts of the training documents
    whose crc32 is 0 modulo `deleted`, with estimates from the other training documents. Afterwards
    all of them count.

    Null and empty texts are the end alone. A null doc_id is not held out and not learned from.
    Repeated rows count as often as they come and stay; other columns are ignored; an empty table
    gives an empty one. Texts are read whole, and no count is dropped.

    Documents are handled in chunks. A chunk sends each distinct n-gram's hash once, with its own
    counts, to the shard of that hash; the shard adds up and answers with the corpus counts in the
    same order. The number of shards follows the corpus, and the driver sees sums and a table of
    buckets by ratios.
    """
    number = fold(F.col("doc_id"), parts * deleted)
    split = (
        F.when(F.col("doc_id").isNull() | (number % parts == held_out), 0).when(number % deleted == 0, 2).otherwise(1)
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(number % parts == held_out, F.lit(False)).alias("held_out"), split.alias("part"))
    held = stored(chunks(in_batches(rows)), "chunks")
    total, base_texts, texts = held.where("asks = 0").select(
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
        F.size(F.filter("part", lambda p: p == 1)).alias("base"), F.size(F.filter("part", lambda p: p > 0)).alias("all"),
    ).agg(F.sum("n"), F.sum("base"), F.sum("all")).first()
    answers = stored(answered(asked(held, -(-(total or 0) // SHARD_TOKENS) or 1)), "answers")
    sums = answers.where("chunk = -1").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(4))).first()
    found = held_out_counts(joined(held.where("asks = 1"), answers), sums[0], sums[1], base_texts or 0)
    weight = mixture([tuple(r) for r in found.collect()])
    train_tokens, train_words, texts = sums[2], sums[3], texts or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                chunk, base, extra = counted(row)
                word, pair = chunk.looked_up(base + extra)
                context = chunk.contexts(word, texts)
                single = (word + 0.5) / (train_tokens + 0.5 * (train_words + 1))
                share = np.where(context > 0, weight[bucket(context)], 0.0)
                both = share * pair / np.maximum(context, 1) + (1 - share) * single
                at = chunk.first
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, row["held_out"].values, pa.array(chunk.counts.astype(np.int64)),
                    pa.array(np.add.reduceat((word > 0).astype(np.int64), at)), pa.array(np.full(n, train_tokens, np.int64)),
                    pa.array(np.add.reduceat(np.log10(single), at)), pa.array(np.add.reduceat(np.log10(both), at)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined(held.where("asks = 0"), answers).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
