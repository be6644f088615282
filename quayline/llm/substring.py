"""Substring dedup: suffix automata of repeated passages, and matching statistics of the documents on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import gram_hashes, in_batches, mixed, slices, stored, text_buffer, word_bounds, word_hashes

#: A word goes if it lies in a run of this many words that starts in a document with a smaller id.
WINDOW = 50
#: Words of an anchor. Every window holds WINDOW - ANCHOR + 1 of them and is filed under the least.
ANCHOR = 20
#: Distinct passages below one anchor; beyond it the anchor's windows are filed one by one.
PASSAGES = 16
#: Words in one automaton; a shard's task builds one after the other.
SHARD_WORDS = 100_000


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
    passages: int = PASSAGES, carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) and the columns `carry` of `docs`; `kept` are the words that stay, joined by one space.

    A window is `window` consecutive words (`[^\\x20\\x09-\\x0D]+`) of one document. Every word
    covered by a window whose word sequence also starts in a document with a smaller doc_id is
    removed; windows are judged on the input. Null and empty texts have no words. Rows with a null
    doc_id neither lose words nor cost others theirs. Repeated rows are one document and stay
    repeated; rows that share a doc_id alone don't remove each other's words. Other columns are
    ignored. An empty table gives an empty one.

    Steps: file each window under its least `anchor`-word hash, so that equal windows meet wherever
    they occur; drop the anchors of one document only; cut each distinct passage below the others
    once, from the first document that has it; deal the passages by anchor into shards, build suffix
    automata of each shard whose states know the smallest doc_id, and stream the shard's passages
    over them; bring the windows' smallest doc_ids back to all documents with that passage.
    """
    others = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = in_batches(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), others.alias("others")
    ).withColumn("row", F.xxhash64("doc_id", "text"))
    whole = rows.select("doc_id", "text", "row")
    filed = stored(filing(whole.where("doc_id IS NOT NULL"), window, anchor, single=False), "passages")
    shared = repeated(filed)
    shared = stored(shared, "shared")
    # A passage is what one document has below one anchor; copies have the same one.
    per_anchor = shared.select("anchor", "passage").distinct().groupBy("anchor").count()
    crowded = per_anchor.where(F.col("count") > passages).select("anchor")
    alone = shared.join(crowded, "anchor", "left_semi")
    if alone.take(1):
        # Windows of an anchor with very many surroundings: each is its own anchor, so equal ones still meet.
        wanted = alone.select("row", "starts", "windows")
        # Written in between: two Python steps in one task would keep twice as many Python workers.
        pieces = stored(cut(whole, wanted), "pieces")
        singles = repeated(filing(pieces, window, window, single=True))
        shared = stored(shared.join(crowded, "anchor", "left_anti").unionByName(singles), "shared")
    first = (
        shared.groupBy("anchor", "passage")
        .agg(F.min(F.struct("doc_id", "row", "starts", "windows")).alias("at"))
        .select("anchor", "passage", "at.*")
    )
    spans = matched(cut(whole, first), window)
    of_row = (
        shared.join(spans, ["anchor", "passage"])
        .select("row", "starts", F.expr(
            "transform(filter(spans, s -> s.least < doc_id), s -> struct(s.at AS at, s.n AS n))"
        ).alias("spans"))
        .where(F.size("spans") > 0)
        .groupBy("row").agg(F.collect_list(F.struct("starts", "spans")).alias("parts"))
    )
    kept = removed(rows.join(of_row, "row", "left"), window)
    return kept.select("doc_id", "kept", "n_words", "n_removed", *([F.col("others")[c].alias(c) for c in carry]))


def repeated(filed: DataFrame) -> DataFrame:
    """The passages whose anchor occurs in two documents at least."""
    several = (
        filed.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most").select("anchor")
    )
    # Written first: a plain shuffle on both sides lets adaptive execution split an anchor with very many rows.
    return filed.join(stored(several, "several").hint("merge"), "anchor", "left_semi")


def filing(docs: DataFrame, window: int, anchor: int, single: bool) -> DataFrame:
    """(anchor, passage, doc_id, row, starts, windows): runs of windows with the same least anchor.

    `starts` are the words at which the first of the run's `windows` begins: a passage that a document
    repeats is one row. `passage` is a hash of all its words. With `single`, rows of `docs` are pieces
    that begin at the words `starts` of a document.
    """
    fields = "anchor long, passage long, doc_id long, row long, starts array<int>, windows int"
    reach = window - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = text_buffer(batch["text"])
            starts, ends, before = word_bounds(data, bounds)
            if len(starts) < window:
                continue
            owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
            hashes = word_hashes(data, starts, ends)
            least = sliding_least(gram_hashes(hashes, anchor), reach)
            whole = gram_hashes(hashes, window)
            at = np.flatnonzero(owner[:len(whole)] == owner[window - 1:])
            if not len(at):
                continue
            value, where = least[at], owner[at]
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (where[1:] != where[:-1])])
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            # At most `reach` windows in a run: its first and last window cover all of its words.
            head = np.flatnonzero((np.arange(len(at)) - begun) % reach == 0)
            n = np.diff(np.append(head, len(at)))
            a, b = at[head], at[head] + n - 1
            passage, value, pick = mixed(whole[a] ^ mixed(whole[b] + n.astype(np.uint64))), value[head], where[head]
            start = a - before[pick]
            if single:
                size = batch["starts"].value_lengths().to_numpy()
                first, own = np.cumsum(size) - size, batch["starts"].flatten().to_numpy()
                times = size[pick]
                again = np.repeat(np.arange(len(pick)), times)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                start = start[again] + own[first[pick[again]] + nth]
                value, passage, n, pick = value[again], passage[again], n[again], pick[again]
            row = batch["row"].to_numpy(zero_copy_only=False)[pick]
            order = np.lexsort((start, passage, value, row))
            value, passage, n, pick, row, start = (x[order] for x in (value, passage, n, pick, row, start))
            fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (passage[1:] != passage[:-1])])
            head = np.flatnonzero(fresh)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(start)).astype(np.int32)), pa.array(start.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([
                pa.array(value[head].view(np.int64)), pa.array(passage[head].view(np.int64)),
                batch["doc_id"].take(pa.array(pick[head])), pa.array(row[head]), lists, pa.array(n[head].astype(np.int32)),
            ], ["anchor", "passage", "doc_id", "row", "starts", "windows"])

    return docs.mapInArrow(run, fields)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    block, done = values, 1
    while done * 2 <= width:
        block, done = np.minimum(block[:-done], block[done:]), done * 2
    rest = width - done
    return np.minimum(block[:len(block) - rest], block[rest:]) if rest else block


def cut(whole: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """`wanted` (row, starts, windows and others) with `doc_id` and `text`, the words of each run of windows."""
    others = [c for c in wanted.columns if c not in ("doc_id", "row", "starts", "windows")]
    wanted = wanted.groupBy("row").agg(F.collect_set(F.struct("starts", "windows", *others)).alias("parts"))
    kinds = "".join(f", {c} long" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = text_buffer(batch["text"])
            raw = data.tobytes()
            starts, ends, before = word_bounds(data, bounds)
            owner = np.repeat(np.arange(batch.num_rows), batch["parts"].value_lengths().to_numpy())
            parts = batch["parts"].flatten()
            lists = parts.field("starts")
            first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
            a = before[owner] + first
            b = a + parts.field("windows").to_numpy() + window - 2
            pieces = [raw[x:y] for x, y in zip(starts[a].tolist(), ends[b].tolist())]
            for at in range(0, len(pieces), 20_000):
                to = slice(at, at + 20_000)
                pick = pa.array(owner[to])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pick), batch["row"].take(pick), lists[to],
                     pa.array(pieces[to], pa.binary()).cast(pa.string()), *(parts.field(c)[to] for c in others)],
                    ["doc_id", "row", "starts", "text", *others],
                )

    return whole.join(wanted, "row").mapInArrow(run, f"doc_id long, row long, starts array<int>, text string{kinds}")


class SuffixAutomaton:
    """All substrings of the sequences added; each state knows the smallest owner of its substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 63]

    def add(self, items: list, owner: int) -> None:
        step, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for item in items:
            old = step[last].get(item)
            if old is not None and length[old] == length[last] + 1:
                last = old
            else:
                if old is not None:
                    last = self._copy(last, old, item)
                else:
                    new, at = len(length), last
                    step.append({})
                    length.append(length[last] + 1)
                    owners.append(owner)
                    link.append(0)
                    while at >= 0 and item not in step[at]:
                        step[at][item] = new
                        at = link[at]
                    if at >= 0:
                        old = step[at][item]
                        link[new] = old if length[old] == length[at] + 1 else self._copy(at, old, item)
                    last = new
            if owner < owners[last]:
                owners[last] = owner

    def _copy(self, at: int, old: int, item) -> int:
        step, link, length = self.next, self.link, self.length
        new = len(length)
        step.append(step[old].copy())
        length.append(length[at] + 1)
        link.append(link[old])
        self.owner.append(self.owner[old])
        link[old] = new
        while at >= 0 and step[at].get(item) == old:
            step[at][item] = new
            at = link[at]
        return new

    def settle(self) -> None:
        """Give each state the smallest owner of the longer substrings that end in it; once, after the last add."""
        owners, link = self.owner, self.link
        for state in sorted(range(1, len(owners)), key=self.length.__getitem__, reverse=True):
            if owners[state] < owners[link[state]]:
                owners[link[state]] = owners[state]

    def least_owners(self, items: list, width: int) -> list[int]:
        """For each run of `width` items: the smallest owner of a sequence that holds it, or the owner of none."""
        step, link, length, owners = self.next, self.link, self.length, self.owner
        state = matched = 0
        out = []
        for place, item in enumerate(items, 1):
            while state and item not in step[state]:
                state = link[state]
                matched = length[state]
            if item in step[state]:
                state = step[state][item]
                matched += 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if place >= width:
                out.append(owners[state] if matched >= width else 1 << 63)
        return out


def matched(passages: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(anchor, passage, spans): for runs of the passage's windows, the smallest doc_id that has them.

    Passages of an anchor come to one shard. The shard's automata take whole anchors until they hold
    `shard_words` words; an anchor has a bounded number of passages of bounded length.
    """
    fields = "anchor long, passage long, spans array<struct<at int, n int, least long>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("least", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, previous = [], 0, None
        for batch in batches:
            for anchor, passage, doc, raw in zip(*(batch[c].to_pylist() for c in ("anchor", "passage", "doc_id", "text"))):
                if words >= shard_words and anchor != previous:
                    yield spans(held)
                    held, words = [], 0
                items = raw.encode().split()
                held.append((anchor, passage, doc, items))
                words, previous = words + len(items), anchor
        if held:
            yield spans(held)

    def spans(held: list[tuple]) -> pa.RecordBatch:
        shard = SuffixAutomaton()
        for _, _, doc, items in held:
            shard.add(items, doc)
        shard.settle()
        found = []
        for _, _, _, items in held:
            least = np.array(shard.least_owners(items, window), np.int64)
            at = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
            n = np.diff(np.append(at, len(least)))
            found.append([{"at": x, "n": y, "least": z} for x, y, z in zip(at.tolist(), n.tolist(), least[at].tolist())])
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(found, kind)],
            ["anchor", "passage", "spans"],
        )

    dealt = passages.select("anchor", "passage", "doc_id", "text").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, fields)


def removed(docs: DataFrame, window: int) -> DataFrame:
    """Take the words covered by each row's `parts` out of `text`: runs of windows from every start of a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = text_buffer(batch["text"])
            raw = data.tobytes()
            sizes = batch["parts"].value_lengths().fill_null(0).to_numpy()
            parts = batch["parts"].flatten()
            starts, spans = parts.field("starts"), parts.field("spans")
            many, each = starts.value_lengths().to_numpy().astype(np.int64), spans.value_lengths().to_numpy().astype(np.int64)
            # Each start of a part with each of its spans.
            part = np.repeat(np.arange(len(many)), many * each)
            nth = np.arange(len(part)) - np.repeat(np.cumsum(many * each) - many * each, many * each)
            start = starts.flatten().to_numpy()[(np.cumsum(many) - many)[part] + nth // each[part]]
            span = (np.cumsum(each) - each)[part] + nth % each[part]
            at, n = (spans.flatten().field(c).to_numpy()[span] for c in ("at", "n"))
            at = at + start
            pairs = np.concatenate([[0], np.cumsum(many * each)])
            upto = pairs[np.concatenate([[0], np.cumsum(sizes)])]
            kept, words, gone = [], [], []
            for i in range(batch.num_rows):
                own = raw[bounds[i]:bounds[i + 1]].split()
                words.append(len(own))
                if upto[i] < upto[i + 1]:
                    change = np.zeros(len(own) + 1, np.int64)
                    mine = slice(upto[i], upto[i + 1])
                    np.add.at(change, at[mine], 1)
                    np.add.at(change, at[mine] + n[mine] + window - 1, -1)
                    own = [w for w, c in zip(own, np.cumsum(change).tolist()) if not c]
                gone.append(words[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()),
                 pa.array(gone, pa.int64()), batch["others"]], ["doc_id", "kept", "n_words", "n_removed", "others"],
            )

    kind = docs.schema["others"].dataType.simpleString()
    return docs.select("doc_id", "text", "parts", "others").mapInArrow(
        run, f"doc_id long, kept string, n_words long, n_removed long, others {kind}"
    )


def kept_digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `deduplicated`."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


