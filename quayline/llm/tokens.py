"""Token ids of whole texts by a public tokenizer, with a memo of words."""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Iterable
from functools import cache

import numpy as np
import pyarrow as pa

#: Unicode's white space: no word of either tokenizer's text pattern goes on beyond it, but for a
#: single blank before a word of the byte tokenizer.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte tokenizer's words, with any white space between them.
WORDS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts in which blanks and line ends stand alone, and no other white space occurs, need no pattern.
UNEVEN = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\x0b", b"\x0c", b"\r", b"\0")
UNEVEN_BEYOND = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
UNEVEN_MARKS = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: Letters of Latin-1, with marks after them. Neither composition nor lower case changes their number.
LATIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?*%#$&|()\"/<>=+\-]*)")
#: Any word as letters and marks: tokens never reach from the one part into the other.
PARTS = re.compile(r"(\n?)( ?[^\W\d_]+)([.,;:!?*%#$&|()\"/<>=+\-]*)")
LONG, JOINED = 64, 400
#: Words whose ids are dealt out at a time.
DEALT = 1 << 18
#: Words of one of the memo's generations: about 200 bytes each, in every Python worker.
MEMO = 150_000


class Encoder:
    """Little-endian 32-bit ids of texts: each text is cut into words whose ids don't depend on their neighbours.

    Words seen before come from a memo. Others are cut into letters and marks; letters are encoded
    many at a time and told apart by the tokens that start or end a word.
    """

    def __init__(self, path: str, blanks: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.blanks, self.memo = blanks, memo
        #: Words since the memo was last full, and those before.
        self.words: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.line = self.ids("\n") if blanks else []
        names = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for name, i in names.items() if (name[0] == "Ġ" if blanks else name.endswith("</w>"))]] = True

    def many(self, raws: Iterable[bytes]) -> list[bytes]:
        """The ids of each text's UTF-8 bytes."""
        raws = list(raws)
        if not self.blanks:
            return self.listed([self.cut(raw) for raw in raws])
        # Texts whose words stand between single blanks take one pass over all their words.
        plain = [at for at, raw in enumerate(raws) if raw and not uneven(raw)]
        out = [b""] * len(raws)
        for at, ids in zip(plain, self.between_blanks([raws[at] for at in plain])):
            out[at] = ids
        rest = [at for at, raw in enumerate(raws) if raw and not out[at]]
        for at, ids in zip(rest, self.listed([self.cut(raws[at]) for at in rest])):
            out[at] = ids
        return out

    def listed(self, cut: list[list[bytes]]) -> list[bytes]:
        """The ids of texts that are lists of words."""
        keys = list(set().union(*cut))
        found = dict(zip(keys, self.known(keys)))
        return [b"".join(map(found.__getitem__, words)) for words in cut]

    def between_blanks(self, raws: list[bytes]) -> list[bytes]:
        """The ids of texts in which single blanks and line ends alone part words.

        Arrow numbers the distinct words, so that each is looked up once, and their ids are dealt out by number.
        """
        if not raws:
            return []
        # A word stands for itself with a blank before it, unless a line or the text starts with it.
        marked = [b"\r" + raw.replace(b"\n", b" \n") + b" " for raw in raws]
        text = b"".join(marked)
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1
        edges = np.concatenate([[0], ends]).astype("<i8")
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(text)]
        ).dictionary_encode()
        distinct = words.dictionary
        raw, at = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], "<i8")[:len(distinct) + 1].tolist()
        found = pa.array(self.known([raw[a:b - 1] for a, b in zip(at, at[1:])]), pa.large_binary())
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4")
        size = np.diff(np.frombuffer(found.buffers()[1], "<i8")[:len(found) + 1]) // 4
        first, number = np.cumsum(size) - size, words.indices.to_numpy()
        parts = []
        for at in range(0, len(number), DEALT):
            some = number[at:at + DEALT]
            n = size[some]
            upto = np.cumsum(n)
            parts.append(ids[np.repeat(first[some] - upto + n, n) + np.arange(upto[-1])].tobytes())
        whole = b"".join(parts)
        # A text ends with the word whose blank is its last byte.
        last = np.searchsorted(ends, np.cumsum([len(raw) for raw in marked]))
        upto = (4 * np.cumsum(size[number]))[last].tolist()
        return [whole[a:b] for a, b in zip([0, *upto], upto)]

    def known(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct words, which are added to the memo."""
        if len(self.words) > self.memo:
            self.words, self.earlier = {}, self.words
        words, earlier = self.words, self.earlier
        out = list(map(words.get, keys))
        fresh = [at for at, ids in enumerate(out) if ids is None]
        wanted = [keys[at] for at in fresh]
        if earlier:
            words.update((key, earlier[key]) for key in wanted if key in earlier)
            wanted = [key for key in wanted if key not in earlier]
        self.resolve(wanted)
        for at in fresh:
            key = keys[at]
            out[at] = words[key]
            if len(key) > LONG:  # very long words don't stay
                del words[key]
        return out

    def cut(self, raw: bytes) -> list[bytes]:
        if not self.blanks:
            return raw.lower().split()  # A-Z only, as the tokenizer does to all letters anyway
        if not raw:
            return []
        if uneven(raw):
            return [b"\r" + word.encode() for word in WORDS.findall(raw.decode())]
        # A word stands for itself with a blank before it, unless a line or the text starts with it.
        keys = raw.replace(b"\n", b" \n").split(b" ")
        keys[0] = b"\r" + keys[0]
        return keys

    def text(self, key: bytes) -> str:
        if not self.blanks or key[:1] == b"\n":
            return key.decode()
        return key[1:].decode() if key[:1] == b"\r" else " " + key.decode()

    def resolve(self, keys: list[bytes]) -> None:
        """Add the ids of words that are not in the memo."""
        if len(self.parts) > self.memo:
            self.parts = {}
        words, known, latin = self.words, self.parts, LATIN.fullmatch
        # Most words are Latin letters, perhaps with marks.
        bare = [key for key in keys if key.isalpha()]
        cut, others = [], []
        for key in keys:
            if not key.isalpha():
                if match := latin(key):
                    cut.append((key, *match.groups()))
                else:
                    others.append(key)
        fresh = {word for _, word, _ in cut}.union(bare).difference(known)
        self.joined(list(fresh), known, " " if self.blanks else "")
        marks = {mark: known.get(b" " + mark) or self.alone(mark.decode()) for mark in {mark for _, _, mark in cut} if mark}
        known.update((b" " + mark, ids) for mark, ids in marks.items())
        marks[b""] = b""
        words.update(zip(bare, map(known.__getitem__, bare)))
        for key, word, mark in cut:
            words[key] = known[word] + marks[mark]
        split = {key: self.split(self.text(key)) for key in others}
        wanted = {part for parts in split.values() for part in parts}
        found: dict[bytes, bytes] = {}
        starts = [raw for part in wanted if part.isalpha() and latin(raw := part.encode())]
        self.joined(starts, found, "")
        ids = {part: found.get(part.encode()) or self.alone(part) for part in wanted}
        words.update((key, b"".join([ids[part] for part in parts])) for key, parts in split.items())

    def split(self, word: str) -> list[str]:
        match = PARTS.fullmatch(word)
        return [part for part in match.groups() if part] if match else [word]

    def alone(self, part: str) -> bytes:
        return np.array(self.ids(part), "<u4").tobytes()

    def joined(self, words: list[bytes], found: dict[bytes, bytes], lead: str) -> None:
        """Add the ids of words of Latin letters to `found`, each as if `lead` stood before it."""
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            if not self.told_apart(some, lead, found):
                for word in some:
                    found[word] = self.alone(lead + word.decode())

    def told_apart(self, some: list[bytes], lead: str, found: dict[bytes, bytes]) -> bool:
        """Encode words together: between them stands a token of their own, or a mark on their first or last.

        False, and nothing added, if the tokens don't tell all words apart.
        """
        between = lead or ("\n" if self.blanks else " ")
        ids = np.array(self.ids(lead + between.encode().join(some).decode()), "<u4")
        if between == "\n":
            edges = np.flatnonzero(ids == self.line[0])
            starts, ends = np.append(0, edges + 1), np.append(edges, len(ids))
        elif lead:
            starts = np.flatnonzero(self.edge[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            ends = np.flatnonzero(self.edge[ids]) + 1
            starts = np.append(0, ends[:-1])
        if len(starts) != len(some):
            return False
        raw = ids.tobytes()
        found.update(zip(some, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))
        return True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def uneven(raw: bytes) -> bool:
    """Whether white space other than single blanks and line ends may occur."""
    if any(blank in raw for blank in UNEVEN):
        return True
    if raw.isascii():
        return False
    return any(blank in raw for blank in UNEVEN_BEYOND) or b"\xe2\x80" in raw and bool(UNEVEN_MARKS.search(raw))


@cache
def encoder(path: str, blanks: bool, memo: int = MEMO) -> Encoder:
    """One for each Python worker, kept from task to task. `blanks`: white space is text to the tokenizer."""
    return Encoder(path, blanks, memo)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
