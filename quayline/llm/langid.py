"""Language identification by cross-parsing: the language whose text explains a document in fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import fold, in_batches, slices, text_buffer
from quayline.llm.substring import SuffixAutomaton

UNKNOWN = "und"
#: A language's model is fitted on a sample of its labelled rows' text: at most so many different passages
#: from anywhere in them, each of so many code points. More of a language's text adds none, other languages
#: take none away.
PASSAGES, PASSAGE_CHARS = 64, 250
#: Symbols with a column in the table of steps: the commonest letters. Steps by rarer letters, of which
#: Chinese has thousands, are in a sorted list.
COLUMNS = 64
#: A text is parsed in pieces of so many symbols; no phrase crosses from one piece to the next.
PIECE = 1000


@dataclass
class Models:
    """One table of all languages' automata: `steps[state + symbol]` is twice the next state, plus one where a phrase ends."""

    languages: list[str]
    symbols: np.ndarray  # by code point: 0 for what is no letter, 1 for a letter that the sample doesn't have
    steps: np.ndarray
    starts: np.ndarray  # by language: the state between phrases
    bits: np.ndarray  # of a phrase, by language
    knows: np.ndarray  # by language and symbol: whether the language's sample has the letter
    width: int  # symbols from here on are in the following three, not in `steps`
    rare: np.ndarray  # state times the number of symbols, plus symbol, in order
    rare_steps: np.ndarray  # for each of them, as in `steps`
    first: np.ndarray  # by language and symbol: the step where `rare` has none, which starts a phrase


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_table(letters: list[str]) -> np.ndarray:
    """The symbol of every code point; upper case counts as lower case."""
    table = np.zeros(0x110000, np.min_scalar_type(len(letters) + 2))
    own = {letter: 2 + i for i, letter in enumerate(letters)}
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            table[point] = own.get(letter.lower(), 1)
    return table


def sequence(symbols: np.ndarray) -> np.ndarray:
    """Symbols with each run of non-letters as one; none at the start."""
    letter = symbols > 0
    return symbols[letter | np.concatenate([[False], letter])[:-1]]


def sample(labelled: DataFrame, most: int = PASSAGES, chars: int = PASSAGE_CHARS) -> dict[str, list[str]]:
    """Passages of each language: of all that its whole texts are made of, those with the `most` smallest hashes.

    A language's number of passages says below which hash about four times as many lie as are wanted, so
    few are gathered. Should they be copies for the most part, the bound is raised for that language.
    """
    totals = labelled.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / chars)).alias("passages")).collect()
    shares = {r.lang: min(1.0, 4 * most / r.passages) for r in totals if r.passages}
    passages = labelled.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))).alias("text"))
    drawn = passages.withColumn("draw", F.xxhash64("text") / F.lit(2.0**64) + 0.5)
    texts: dict[str, list[str]] = {}
    while shares:
        limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
        found = drawn.where(F.col("draw") <= limit).distinct().collect()
        for language, share in list(shares.items()):
            own = sorted((r.draw, r.text) for r in found if r.lang == language)
            if len(own) >= most or share >= 1:
                texts[language] = [text for _, text in own[:most]]
                del shares[language]
            else:
                shares[language] = min(1.0, share * 8)
    return texts


def fitted(texts: dict[str, list[str]]) -> Models:
    """A suffix automaton for each language, of all of its texts."""
    languages = sorted(texts)
    counts: dict[str, int] = {}
    for part in texts.values():
        for text in part:
            for letter in text.lower():
                if letter.isalpha():
                    counts[letter] = counts.get(letter, 0) + 1
    letters = sorted(sorted(counts), key=counts.get, reverse=True)
    table, total = symbol_table(letters), len(letters) + 2
    width = min(total, COLUMNS)
    parts, roots, bits, base = [], [], [], 0
    knows = np.zeros((len(languages), total), bool)
    first, rare = np.zeros((len(languages), total), np.int64), {}
    for place, language in enumerate(languages):
        automaton, size = SuffixAutomaton(), 0
        for text in texts[language]:
            row = sequence(table[code_points(text)])
            automaton.add(row.tolist(), 0)
            size += len(row)
        # Behind the automaton's states stands one for "between phrases": at the start of a piece, and
        # after a letter that the language doesn't have, which is a phrase of its own.
        between = base + len(automaton.next) * width
        steps = np.full((len(automaton.next) + 1, width), between * 2 + 1, np.int64)
        knows[place, list(automaton.next[0])] = True
        first[place] = between * 2 + 1
        for symbol, state in automaton.next[0].items():
            first[place, symbol] = (base + state * width) * 2 + 1
        steps[:] = first[place, :width]
        for state, arrows in enumerate(automaton.next):
            for symbol, to in arrows.items():
                if symbol < width:
                    steps[state, symbol] = (base + to * width) * 2
                else:
                    rare[(base + state * width) * total + symbol] = (base + to * width) * 2
        parts.append(steps.ravel())
        roots.append(between)
        bits.append(np.log2(size + 2))
        base += steps.size
    steps = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys = np.array(sorted(rare), np.int64)
    return Models(
        languages, table, steps.astype(np.int32), np.array(roots, np.int64), np.array(bits), knows,
        width, keys, np.array([rare[k] for k in keys.tolist()], np.int64), first,
    )


def stepped(models: Models, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The steps of the states (language by text) on the texts' next symbols."""
    far = np.flatnonzero(symbol >= models.width) if models.first.shape[1] > models.width else ()
    if not len(far):
        return models.steps[state + symbol]
    now = models.steps[state + np.where(symbol < models.width, symbol, 1)].astype(np.int64)
    rarely = symbol[far].astype(np.int64)
    key = state[:, far] * models.first.shape[1] + rarely
    at = np.minimum(np.searchsorted(models.rare, key), max(len(models.rare) - 1, 0))
    hit = models.rare[at] == key if len(models.rare) else np.zeros(key.shape, bool)
    now[:, far] = np.where(hit, models.rare_steps[at] if len(models.rare) else 0, models.first[:, rarely])
    return now


def phrases(models: Models, seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each piece (rows) in each language (columns): all pieces advance together, a symbol at a time."""
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    n, m = len(starts), len(models.languages)
    state = np.repeat((models.starts * 2).astype(np.int64), n).reshape(m, n)
    count = np.zeros((m, n), np.int32)
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if n else 0) + 1), "right")
    for t, k in enumerate(live.tolist()):
        now = stepped(models, state[:, :k] >> 1, seq[starts[:k] + t])
        count[:, :k] += now & 1
        state[:, :k] = now
    out = np.empty((n, m), np.int32)
    out[order] = count.T
    return out


def read(models: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts end to end, and where each text begins and the last ends."""
    data, bounds = text_buffer(column)
    points = code_points(data.tobytes().decode())
    return models.symbols[points], np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]


def parsed(models: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its letters, and its phrases in each language."""
    return counted(models, *read(models, column))


def counted(models: Models, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and phrases of the texts of `read`."""
    letter = symbols > 0
    letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[at])
    before = np.concatenate([[False], letter])[:-1]
    before[at[:-1][at[:-1] < len(before)]] = False
    keep = letter | before
    place = np.concatenate([[0], np.cumsum(keep)])[at]
    sizes = np.diff(place)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    count = phrases(models, symbols[keep], place[owner] + nth * PIECE, np.minimum(PIECE, sizes[owner] - nth * PIECE))
    total = np.zeros((len(sizes), len(models.languages)), np.int64)
    np.add.at(total, owner, count)
    return letters, total


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """All columns of `docs`, held_out, lang_pred, score, phrase_length and unknown_letters (columns of these names are replaced).

    Learns from rows with a text and a lang whose crc32 of the doc_id as text is not `held` modulo
    `parts`. A text is lower-cased, its letters kept and each run of other characters taken as one
    blank; it is cut greedily into the longest phrases that occur in a language's sample. A phrase
    costs the logarithm of the sample's length; the language with the least cost wins, of equal ones
    the first by name. `score` is the lead over the second best, as a share of the latter's cost (one
    if only one language is known). `phrase_length` is the letters of a phrase in the winner's parse, `unknown_letters` the share of
    a text's letters that the winner's sample doesn't have.

    A null or empty text or one without a letter is `und` with score 0, as is every text if there is
    nothing to learn from. A null doc_id is never learned from and not held out. Repeated rows stay;
    an empty table gives an empty one. Texts are parsed whole; lang isn't read in a prediction.
    """
    added = ("held_out", "lang_pred", "score", "phrase_length", "unknown_letters")
    names = [c for c in docs.columns if c not in added]
    held_out = F.coalesce(fold(F.col(doc_id), parts) == held, F.lit(False))
    learned = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    models = docs.sparkSession.sparkContext.broadcast(fitted(sample(learned)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in slices(batches, text):
            name, score, length, unknown = judged(known, batch[text])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(length), pa.array(unknown)],
                [*batch.schema.names, *added[1:]],
            )

    rows = docs.select(*names, held_out.alias("held_out"))
    kind = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "phrase_length": F.lit(0.0), "unknown_letters": F.lit(0.0)}).schema
    return in_batches(rows).mapInArrow(run, kind)


def predicted(known: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and phrase length of each text."""
    return judged(known, column)[:3]


def judged(known: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, phrase length and share of unknown letters of each text."""
    symbols, at = read(known, column)
    letters, count = counted(known, symbols, at)
    if not known.languages:
        zero = np.zeros(len(letters))
        return np.full(len(letters), UNKNOWN, object), zero, zero, zero
    cost = count * known.bits
    rows, best = np.arange(len(letters)), cost.argmin(1)
    rest = cost.copy()
    rest[rows, best] = np.inf
    second = rest.min(1)
    none = letters == 0
    score = np.where(none | np.isinf(second), 1.0, 1 - cost[rows, best] / np.where(none, 1.0, second))
    name = np.array(known.languages, object)[best]
    name[none] = UNKNOWN
    strange = (symbols > 0) & ~known.knows[np.repeat(best, np.diff(at)), symbols]
    unknown = np.diff(np.concatenate([[0], np.cumsum(strange)])[at]) / np.maximum(letters, 1)
    return name, np.where(none, 0.0, score), np.where(none, 0.0, letters / np.maximum(count[rows, best], 1)), unknown


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrase_length) of `labelled`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return labelled(rows).select("doc_id", "held_out", "lang_pred", "score", "phrase_length")
