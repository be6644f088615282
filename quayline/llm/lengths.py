"""Token counts of whole texts: batches of about equal bytes go to the tokenizer, and only lengths come back.

A null text counts as empty; an empty text has no bytes and no tokens. Every row gives a row, repeated rows
and null keys too; an empty table gives an empty result. Other columns than the key and the text are not
read, so their names can't clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import BLANK, in_batches, slices, text_buffer, word_bounds

#: Bytes of text that one call of the tokenizer gets: its results take many times as much.
CALL_BYTES = 256 << 10
#: A longer text is cut where a cut can't change its tokens, so that a call's share is bounded too.
LONG_BYTES = 64 << 10
#: Between two words of ASCII letters that a single blank parts, no token and no normal form reaches across.
SAFE = re.compile(rb"[A-Za-z] [A-Za-z]")
#: A digit is a word of its own to tokenizers that drop white space, whatever stands before it.
SAFE_INSIDE = re.compile(rb"[0-9]")
LIMIT = 2048


class Lengths:
    """Lengths of texts by one public tokenizer: a `.json` file of tokenizers or a `.model` file of sentencepiece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.by_words = False
        #: What a text after a cut starts with. A sentence piece puts its own blank before a text.
        self.after_cut = 0
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            self.cuts = not any("▁" in piece.lstrip("▁") for piece in pieces)
            self.after_cut = 1
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: model.encode_batch_fast(texts, add_special_tokens=False)
            self.cuts = True
            self.by_words = not model.encode(" \t\n", add_special_tokens=False).ids

    def counts(self, batch: pa.Array) -> np.ndarray:
        """The number of tokens of each text of a batch."""
        data, bounds = text_buffer(batch)
        if self.by_words:
            return self.word_counts(data, bounds)
        whole = data.tobytes()
        return np.array(self.balanced([whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]), np.int64)

    def word_counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """White space parts words for good, so each distinct word of the batch is encoded once."""
        starts, ends, before = word_bounds(data, bounds)
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        packed = np.ascontiguousarray(data[~BLANK[data]])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(packed)]
        ).dictionary_encode()
        found = np.array(self.balanced(words.dictionary.to_pylist()), np.int64)
        tokens = np.concatenate([[0], np.cumsum(found[words.indices.to_numpy()])]) if len(starts) else np.zeros(1, np.int64)
        return np.diff(tokens[before])

    def balanced(self, raws: list[bytes]) -> list[int]:
        """Lengths of texts; calls get about CALL_BYTES each, and a long text comes in parts."""
        out = [0] * len(raws)
        some: list[str] = []
        rows: list[int] = []
        held = 0
        for row, raw in enumerate(raws):
            for part in self.parts(raw):
                some.append(part.decode())
                rows.append(row)
                held += len(part)
                if held >= CALL_BYTES:
                    add(out, rows, self.encode(some))
                    some, rows, held = [], [], 0
        if some:
            add(out, rows, self.encode(some))
        return out

    def parts(self, raw: bytes) -> Iterator[bytes]:
        """The text, cut about every LONG_BYTES where that is safe; what offers no such place stays whole."""
        at = 0
        while self.cuts and len(raw) - at > LONG_BYTES:
            found = (SAFE_INSIDE if self.by_words else SAFE).search(raw, at + LONG_BYTES)
            if not found:
                break
            cut = found.start() + (0 if self.by_words else 1)
            yield raw[at:cut]
            at = cut + self.after_cut
        yield raw[at:]


def add(out: list[int], rows: Iterable[int], encoded: Iterable) -> None:
    for row, ids in zip(rows, encoded):
        out[row] += len(ids)


@cache
def lengths(path: str) -> Lengths:
    """One for each Python worker, kept from task to task."""
    return Lengths(path)


def counted(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row: a map over the table, nothing is shuffled and no text is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        for batch in slices(batches, "text"):
            size = np.diff(text_buffer(batch["text"])[1])
            n = own.counts(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    return in_batches(read).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
