"""Numpy views of texts as arrays of code points."""

from __future__ import annotations

import numpy as np

SPACE = 32
#: Texts are worked on in pieces of so many code points, which bounds memory.
PIECE = 1 << 19


#: Planes 0 and 1; of the rest, 2 and 3 hold letters without case.
TABLE = 0x20000
ALPHA, OTHER_ALNUM, DECIMAL, UPPER, LOWER = 1, 2, 4, 8, 16
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Flags and lower case of the characters of both planes, made once in a task."""
    if not _TABLES:
        every = np.arange(TABLE, dtype=np.uint32).view("<U1")
        alpha, decimal = np.char.isalpha(every), np.char.isdecimal(every)
        flags = alpha * np.uint8(ALPHA) | (np.char.isalnum(every) & ~alpha & ~decimal) * np.uint8(OTHER_ALNUM) | decimal * np.uint8(DECIMAL)
        flags |= np.char.isupper(every) * np.uint8(UPPER) | np.char.islower(every) * np.uint8(LOWER)
        _TABLES.extend((flags, np.char.lower(every).astype("<U1").view(np.uint32)))
    return _TABLES


def flags(codes: np.ndarray) -> np.ndarray:
    """What kind of character each code point is, as a sum of the flags above."""
    table = _tables()[0]
    if len(codes) and codes.max() >= TABLE:
        far = codes >= TABLE
        return np.where(far, (codes < 0x40000) * np.uint8(ALPHA), table[np.where(far, 0, codes)])
    return table[codes]


def lowered(codes: np.ndarray) -> np.ndarray:
    if len(codes) and codes.max() >= TABLE:
        return np.where(codes >= TABLE, codes, _tables()[1][np.where(codes >= TABLE, 0, codes)])
    return _tables()[1][codes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str, overlap: int):
    """Pieces of a long text; each begins with the last code points of the one
    before, so that no n-gram is lost at a cut."""
    for start in range(0, max(len(text), 1), PIECE):
        yield text[max(0, start - overlap) : start + PIECE]


def letters_only(text: str, within: str = "") -> np.ndarray:
    """Code points of the lower-cased text between two spaces, with one space for
    each run of anything but letters. Characters of ``within`` stay where they have a
    letter on each side, whatever number of them in a row."""
    codes = np.concatenate(([SPACE], code_points(text.lower()), [SPACE])).astype(np.uint64)
    letter = flags(codes) & ALPHA > 0
    if within:
        other = np.isin(codes, [ord(c) for c in within])
        kept = np.where(other, 0, np.arange(len(codes)))
        left = np.maximum.accumulate(kept)
        right = np.minimum.accumulate(np.where(other, len(codes) - 1, np.arange(len(codes)))[::-1])[::-1]
        letter = letter | (other & letter[left] & letter[right])
    codes[~letter] = SPACE
    return codes[np.concatenate(([True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)))]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n code points."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for i in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= codes[i : i + count]
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))
