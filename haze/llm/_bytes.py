"""Vectorised hashing of the words of many texts at once.

A hash of a byte string is its polynomial modulo two 31-bit primes, one base for each, drawn at random per run
(``draw_key``) and unknown to whoever wrote the texts.  Two unlike strings of L bytes agree
with probability at most (L / 2**31)**2, whatever they look like; with a fixed or an even modulus,
strings could be built that always agree.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 19  # bytes hashed at a time; a longer text is cut at white space
PRIMES = (2**31 - 1, 2**31 - 19)
Key = tuple[int, int]
FIXED: Key = (1_234_567_891, 1_987_654_321)  # for callers that compare hashes of trusted texts only
_SEGMENT = 1 << 20  # so many terms below 2**39 add up without overflow
_tables: dict[tuple[int, int], np.ndarray] = {}


def draw_key() -> Key:
    """Random bases.  Hashes are comparable only under one key: draw it on the driver and ship it with the tasks."""
    return tuple(secrets.randbelow(p - 1000) + 500 for p in PRIMES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo ``prime``, four bytes each."""
    have = _tables.get((base, prime))
    if have is None or len(have) < n:
        size = -(-max(n, BLOCK + 1) // (1 << 16)) << 16
        have = np.ones(size, np.uint32)
        k, step = 1, base % prime
        while k < size:
            m = min(2 * k, size)
            have[k:m] = have[:m - k] * np.uint64(step) % np.uint64(prime)
            k, step = m, step * step % prime
        if n <= 8 * BLOCK:
            if len(_tables) > 16:
                _tables.clear()
            _tables[base, prime] = have
    return have[:n]


def prefix(raw: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Sums of (byte + 1) * base**place over everything before each place, modulo ``prime``."""
    total = np.zeros(len(raw) + 1, np.uint64)
    place = powers(len(raw), base, prime)
    for a in range(0, len(raw), _SEGMENT):
        b = min(a + _SEGMENT, len(raw))
        np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * place[a:b], out=total[a + 1:b + 1])
        total[a + 1:b + 1] += total[a]
        total[a + 1:b + 1] %= np.uint64(prime)
    return total


class Hashes:
    """Hashes of any spans of ``raw`` under a key, wherever the spans stand."""

    def __init__(self, raw: np.ndarray, key: Key):
        self.parts = [(prefix(raw, b, p), powers(len(raw) + 1, pow(b, -1, p), p), np.uint64(p)) for b, p in zip(key, PRIMES)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = ((total[ends] + p - total[starts]) * back[starts] % p for total, back, p in self.parts)
        return mix((one << np.uint64(31) | two) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sliding(self, length: int) -> np.ndarray:
        """Hashes of all strings of ``length`` bytes, in order; equal to ``of`` on them."""
        one, two = ((total[length:] + p - total[:-length]) * back[:len(total) - length] % p for total, back, p in self.parts)
        return mix((one << np.uint64(31) | two) + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def row_blocks(sizes: list[int], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def joined_blocks(texts: list[bytes], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts joined by line feeds: bytes, begin of each piece and the text it belongs to."""
    most = most or BLOCK
    pieces = [(i, p) for i, t in enumerate(texts) for p in (_cut(t) if len(t) > BLOCK else (t,))]
    for a, b in row_blocks([len(p) + 1 for _, p in pieces], most + 1):
        part = pieces[a:b]
        raw = np.frombuffer(b"\n".join(p for _, p in part), np.uint8)
        yield raw, np.cumsum([0] + [len(p) + 1 for _, p in part[:-1]]), np.asarray([i for i, _ in part])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between ASCII white space."""
    edge = np.diff(np.concatenate([[0], (~SPACE[raw]).view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: Key = FIXED) -> np.ndarray:
    """64-bit hash of each span of ``raw``, wherever it stands."""
    return Hashes(raw, key).of(starts, ends)


def word_hashes(texts: list[bytes], key: Key = FIXED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased, split at ASCII white space) and its text's index."""
    hashes, owners = [], []
    for raw, begin, who in joined_blocks(texts):
        low = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
        starts, ends = word_spans(low)
        hashes.append(span_hashes(low, starts, ends, key))
        owners.append(who[np.searchsorted(begin, starts, "right") - 1])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[bytes], width: int, key: Key = FIXED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles (sorted 64-bit hashes) of all texts, and the bounds of each text's run.

    A text of fewer words, but not none, has its whole word sequence as its one shingle.
    """
    h, owner = word_hashes(texts, key)
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    where = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1] - where[:-1], count) + np.arange(where[-1])
    length = np.repeat(np.minimum(n, width), count)
    s = mix(length.astype(np.uint64))
    for k in range(width):
        use = length > k
        nxt = mix(s[use] * np.uint64(0x9FB21C651E98DF25) + h[start[use] + k])
        s[use] = nxt
    keep = np.ones(len(s), bool)
    for a, b in zip(where[:-1], where[1:]):
        if b - a > 1:
            s[a:b].sort()
    keep[1:] = s[1:] != s[:-1]
    keep[where[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[where]
