"""Word and shingle hashes of many texts at once, with numpy over their UTF-8 bytes.

Words are the runs between separator bytes. A word's hash is a sum over its bytes modulo 2^64, each
byte's random number times that of its place, with a mixing step; a shingle's hash combines those of its
words in order. No powers of one base are used: words exist that all of those confuse. Two different
shingles of a corpus of 10^9 have one chance in about 40 to share a hash anywhere; a set is then off by one element.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SALT = _U(0xD6E8FEB86659FD93)


def _table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: ASCII white space as in [\x20\x09-\x0D].
WHITE = _table(b" \t\n\v\f\r")
#: Everything in ASCII but letters and digits.
NOT_ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A number for each byte, the same for A-Z as for a-z; one for each place, as many as the longest word so far needs.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTES[65:91] = _BYTES[97:123]
_places = np.zeros(0, np.uint64)


def _place_numbers(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mix(np.arange(2 * max(n, 128), dtype=np.uint64) * _SALT + _BASE)
    return _places


def words(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte in its text, end byte, index of its text) of each word, A-Z taken as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    held = np.flatnonzero(~separators[data])
    if not len(held):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = np.flatnonzero(np.diff(held, prepend=-2) > 1)
    size = np.diff(first, append=len(held))
    place = np.arange(len(held)) - np.repeat(first, size)
    h = mix(np.add.reduceat(_BYTES[data[held]] * _place_numbers(int(size.max()))[place], first))
    start = held[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, "right")
    offset = (ends - np.array([len(t) + 1 for t in texts]))[doc]
    return h, start - offset, start - offset + size, doc


def shingles(h: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each run of w words within a text; a text with fewer words gives all of them as one."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.zeros(0, np.int64)
    out = np.zeros(0, np.uint64)
    if n >= w:
        full = np.flatnonzero(doc[: n - w + 1] == doc[w - 1 :])
        out = np.zeros(len(full), np.uint64)
        for k in range(w):
            out = mix(out * _BASE + h[full + k] + _SALT)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(first, append=n)
    for k in np.unique(size[size < w]):
        short = first[size == k]
        own = np.full(len(short), _U(k))
        for j in range(k):
            own = mix(own * _BASE + h[short + j] + _SALT)
        out, full = np.concatenate([out, own]), np.concatenate([full, short])
    order = np.argsort(full, kind="stable")
    return out[order], full[order]


def sets(texts: list[bytes], separators: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the distinct shingle hashes of text i, sorted as signed longs, are values[offsets[i]:offsets[i + 1]]."""
    h, _, _, doc = words(texts, separators)
    s, at = shingles(h, doc, w)
    own, value = doc[at], s.view(np.int64)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    if len(own):
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
        own, value = own[new], value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]).astype(np.int64)
