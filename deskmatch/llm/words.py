"""Splits texts into the words that BPE merges never cross, for whole chunks of texts at once.

Two public splitting rules are known: "byte" (an optional blank before letters, digits or other
signs; white space runs leave their last character to what follows) and "word" (letters, single
digits or other signs; white space is dropped). Both first take the English contractions.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd

#: The lowest n bytes of a word of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The characters with the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes and the byte position of each; None if all are ASCII."""
    if not data.size or data.max() < 0x80:
        return data, None
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)


def contractions(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, attached: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where contractions start, and their lengths. attached: a blank before the apostrophe belongs to it, so that none starts there."""
    at = np.flatnonzero(cp == 39)
    at = at[at + 1 < len(cp)]
    if not at.size:
        return at, at
    before = np.maximum(at - 1, 0)
    free = (kind[before] != OTHER) & ~((cp[before] == 32) & attached)
    at = at[first[at] | free]
    padded = np.concatenate([cp.astype(np.uint32), [0, 0, 0]])
    starts = np.concatenate([first, [True, True, True]])
    one, two = np.where(starts[at + 1], 0, padded[at + 1]), np.where(starts[at + 1] | starts[at + 2], 0, padded[at + 2])
    letter = {c: ord(c) for c in "stmdrvel"}
    short = np.isin(one, [letter[c] for c in "stmd"])
    long = ((two == letter["e"]) & ((one == letter["r"]) | (one == letter["v"]))) | ((one == letter["l"]) & (two == letter["l"]))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def split(data: np.ndarray, offsets: np.ndarray, rule: str, marks: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a chunk, and the number of the first word of each text (one more at the end).

    data: UTF-8 bytes of the texts, one after the other; offsets: where each begins, and the end.
    marks: byte spans that are words of their own, whatever they hold.
    """
    cp, places = code_points(data)
    n = len(cp)
    index = offsets if places is None else np.searchsorted(places, offsets)
    first = np.zeros(n + 1, bool)
    first[index] = True
    if marks:
        spans = np.asarray(marks)
        spans = spans if places is None else np.searchsorted(places, spans)
        first[spans.ravel()] = True
    first = first[:n]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[cp]
    space = kind == SPACE
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    at, size = contractions(cp, kind, first, rule == "byte")
    if rule == "byte":
        start[1:] &= space[1:] | (cp[:-1] != 32)
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    else:
        start |= kind == NUMBER
    start |= first
    start[at] = True
    start[at + 1] = False
    after = at + size
    start[after[after < n]] = True
    if marks:
        for a, b in spans:
            start[a + 1 : b] = False
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    if rule != "byte":
        keep = ~space[begins]
        begins, ends = begins[keep], ends[keep]
    of = np.searchsorted(begins, index)
    if places is not None:
        places = np.append(places, len(data))
        begins, ends = places[begins], places[ends]
    return begins.astype(np.int64), ends.astype(np.int64), of


def specials(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> list[tuple[int, int]]:
    """Where special strings stand, leftmost first, none across two texts."""
    raw, found = data.tobytes(), []
    for word in whole:
        at = raw.find(word)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(word) <= offsets[text + 1]:
                found.append((at, at + len(word)))
                at = raw.find(word, at + len(word))
            else:
                at = raw.find(word, at + 1)
    found.sort()
    kept, end = [], 0
    for a, b in found:
        if a >= end:
            kept.append((a, b))
            end = b
    return kept


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word in the list of distinct words, and that list.

    Words of up to 15 bytes are compared as two integers that hold bytes and length; a hash of the two only
    finds the candidates, and each is compared with the one it was taken for.
    """
    number, sizes = np.empty(len(begins), np.int64), ends - begins
    raw = data.tobytes()
    padded = np.frombuffer(raw + bytes(16), np.uint8)
    eight = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))
    short = sizes <= 15
    at, size = (begins, sizes) if short.all() else (begins[short], sizes[short])
    low, high = eight[at] & MASKS[np.minimum(size, 8)], (eight[np.minimum(at + 8, len(raw))] & MASKS[np.maximum(size - 8, 0)]) | size.astype(np.uint64) << np.uint64(56)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    codes, found = pd.factorize(mixed)
    one = np.empty(len(found), np.int64)
    one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if not (np.array_equal(low, low[one][codes]) and np.array_equal(high, high[one][codes])):
        codes, found = pd.factorize(np.array([raw[a : a + n] for a, n in zip(at.tolist(), size.tolist())], object))
        one = np.empty(len(found), np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    words = [raw[a:b] for a, b in zip(at[one].tolist(), (at[one] + size[one]).tolist())]
    number[short] = codes
    if len(at) < len(begins):
        far = {}
        number[~short] = [far.setdefault(raw[a:b], len(words) + len(far)) for a, b in zip(begins[~short].tolist(), ends[~short].tolist())]
        words += far
    return number, words
