"""Plain forms of the operators, over lists in memory, that the tests compare with."""

import re
import zlib

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def simhash(text):
    own = words(lower(text))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def chains(keys, near):
    """For each place, the first place reachable over pairs that are near."""
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def near_bits(a, b):
    return (a ^ b).bit_count() <= 3


def deduplicated(rows, window=50):
    """(doc_id, kept, n_words, n_removed) of (doc_id, text) rows."""
    first = {}
    for key, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1 if key is not None else 0):
            run = tuple(own[i:i + window])
            first[run] = min(first.get(run, key), key)
    out = []
    for key, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1 if key is not None else 0):
            if first[tuple(own[i:i + window])] < key:
                gone[i:i + window] = [True] * window
        out.append((key, " ".join(w for w, g in zip(own, gone) if not g), len(own), sum(gone)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, x) for x in row))


def told(df, *columns):
    return ordered(tuple(r) for r in (df.select(*columns) if columns else df).collect())
