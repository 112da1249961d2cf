"""Word shingles of whole texts as 64-bit hashes, a block of documents at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text worked on at once; a longer text is cut between words.
BLOCK = 1 << 18
#: Bytes from which a word is held by a digest, so that no word fills memory.
LONG_WORD = 1 << 16
SEPARATOR = 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []
_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % LONG_WORD)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 2 * BLOCK)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[:] = both
    return _powers[0], _powers[1]


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's shingles in order (repeats kept); with fewer words, the whole sequence."""
    texts = [_LONG.sub(lambda m: b"\x00" + hashlib.blake2b(m[0].lower()).hexdigest().encode(), t) if len(t) >= LONG_WORD else t for t in texts]
    out: list[np.ndarray] = []
    for a, z in blocks(texts):
        if z == a + 1 and len(texts[a]) > BLOCK:
            out.append(np.concatenate([_block([piece], width)[0] for piece in _pieces(texts[a], width)]))
        else:
            out.extend(_block(texts[a:z], width))
    return out


def _pieces(text: bytes, width: int) -> Iterator[bytes]:
    """The text cut between words about every BLOCK bytes, each piece after the
    first with the last width - 1 words of the one before, so that every shingle lies in one piece."""
    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        stop = gap.start() if gap else len(text)
        held += text[at:stop].split()
        at = stop
        if len(held) >= width:
            yield b" ".join(held)
            held, some = held[1 - width :], True
    if not some:
        yield b" ".join(held)


def _block(texts: list[bytes], width: int) -> list[np.ndarray]:
    raw = _LOWER[np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first blank after a word stays, as the separator
    placed = np.cumsum(keep)
    data = raw[keep]
    data[space[keep]] = SEPARATOR
    stop = placed[ends - 1]  # each text's end in data
    breaks = np.flatnonzero(data == SEPARATOR)  # one after each word
    begins = np.empty_like(breaks)
    begins[:1] = 0
    begins[1:] = breaks[:-1] + 1
    last = np.searchsorted(breaks, stop)  # words up to each text's end
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[: len(data)], out=total[1:])
    out = []
    first = 0
    n_words = len(breaks)
    if n_words >= width:
        s, e = begins[: n_words - width + 1], breaks[width - 1 :]
        every = mixed((total[e] - total[s]) * inverse[s])
    for w in last.tolist():
        n = w - first
        if n >= width:
            out.append(every[first : w - width + 1])
        elif n:
            s, e = begins[first], breaks[w - 1]
            out.append(mixed((total[e : e + 1] - total[s : s + 1]) * inverse[s : s + 1]))
        else:
            out.append(np.empty(0, np.uint64))
        first = w
    return out


def set_id(sorted_set: np.ndarray) -> bytes:
    """A 128-bit name of a set of hashes."""
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()
