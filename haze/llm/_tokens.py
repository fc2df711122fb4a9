"""Token ids of whole texts by a public tokenizer file, with a bounded cache of white-space chunks.

A tokenizer that drops white space and never looks across it (``word_bpe_49k``) gives a text the ids of
its chunks, one after another.  Chunks are found and looked up for a block of texts at once: a
table of 128-bit chunk hashes in arrays leads to the ids of every chunk seen before, and one gather puts
the ids of the block together.  Only unseen chunks reach the tokenizer.  Such a chunk is
first reduced to its core, Latin letters in lower case without the marks at the end; unknown cores of
letters only are encoded many to a call and told apart by the token that ends a word.

The result equals ``encode`` on the whole text.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from haze.llm._bytes import Hashes, draw_key, joined_blocks, word_spans

CACHE_CHUNKS = 1 << 20  # chunks, and as many cores, kept per Python worker; a full cache starts afresh
_LATIN = re.compile("[\x21-įı-ɏ]+\\Z")  # lower() of these equals the tokenizer's, letter by letter
_MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"  # ASCII marks but for those of special tokens
_JOINED = 400
BLOCK = 2 << 20  # bytes looked up at a time: unseen chunks reach the tokenizer in larger calls


class _Table:
    """Open addressing from pairs of 64-bit hashes to runs of ids."""

    def __init__(self, limit: int):
        self.limit, self.mask = limit, (1 << max(4, (2 * limit).bit_length())) - 1
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.entry = np.zeros(self.mask + 1, np.int32)
        self.n = self.used = 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it is unknown."""
        out = np.full(len(a), -1, np.int64)
        open_, slot = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            here = self.first[slot]
            hit = (here == a[open_]) & (self.second[slot] == b[open_])
            out[open_[hit]] = self.entry[slot[hit]]
            go = ~hit & (here != 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray, runs: list[bytes]) -> None:
        """New distinct keys and their ids."""
        ids = np.frombuffer(b"".join(runs), "<u4")
        counts = np.fromiter((len(r) // 4 for r in runs), np.int64, len(runs))
        while self.n + len(runs) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        new = np.arange(self.n, self.n + len(runs))
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.pool[self.used:self.used + len(ids)] = ids
        self.n, self.used = self.n + len(runs), self.used + len(ids)
        open_, slot = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(self.first[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.first[slot[put]], self.second[slot[put]] = a[open_[put]], b[open_[put]]
            self.entry[slot[put]] = new[open_[put]]
            rest = np.ones(len(open_), bool)
            rest[put] = False
            open_, slot = open_[rest], (slot[rest] + 1) & self.mask


class Encoder:
    def __init__(self, path: str, cache: int = CACHE_CHUNKS, specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not specials
        self.limit, self.cores, self.keys = cache, {}, (draw_key(), draw_key())
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = bool(suffix) and "Lowercase" in json.dumps(spec["normalizer"]) and "Removed" in json.dumps(spec["pre_tokenizer"])
        if self.words:
            self.known = _Table(cache)
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: many words to a call, cut after each token that ends a word."""
        out: list[bytes] = []
        for a in range(0, len(words), _JOINED):
            part = words[a:a + _JOINED]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[4 * x:4 * y] for x, y in zip([0, *cuts], cuts)]
            else:
                out += self._ids(part)
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space, by way of their cores."""
        reduced = []
        for w in chunks:
            if w.isalpha() and w.isascii():
                reduced.append((w.lower(), ""))
            elif _LATIN.match(w):
                k = w.lower()
                core = k.rstrip(_MARKS)
                reduced.append((core, k[len(core):]) if core and core[-1].isalnum() else (k, ""))
            else:
                reduced.append((w, ""))
        parts = {p for pair in reduced for p in pair if p}
        if len(self.cores) + len(parts) > self.limit:
            self.cores = {}
        need = parts - self.cores.keys()
        letters = [p for p in need if p.isalpha() and _LATIN.match(p)]
        self.cores.update(zip(letters, self._letters(letters)))
        other = list(need.difference(letters))
        self.cores.update(zip(other, self._ids(other)))
        cores = self.cores
        return [cores[k] + cores[mark] if mark else cores[k] for k, mark in reduced]

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (Hashes(raw, key).of(starts, ends) for key in self.keys)
        a[a == 0] = 1
        at = self.known.find(a, b)
        while len(missing := np.flatnonzero(at < 0)):
            _, one = np.unique(a[missing], return_index=True)
            new = missing[one]
            if self.known.n + len(new) > self.limit and self.known.n:
                self.known.clear()
                at = np.full(len(a), -1, np.int64)
                continue
            body = raw.tobytes()
            chunks = [body[x:y].decode("utf-8", "replace") for x, y in zip(starts[new].tolist(), ends[new].tolist())]
            if self.known.n + len(new) > self.known.limit:
                self.known = _Table(len(new))
            self.known.add(a[new], b[new], self._encoded(chunks))
            at[missing] = self.known.find(a[missing], b[missing])
        return at

    def encode(self, texts: list[str] | list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.words:
            return self._ids([t if isinstance(t, str) else t.decode("utf-8", "replace") for t in texts])
        out: list[list[bytes]] = [[] for _ in texts]
        for raw, begin, who in joined_blocks([t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts], BLOCK):
            starts, ends = word_spans(raw)
            at = self._entries(raw, starts, ends)
            count = self.known.count[at]
            upto = np.concatenate([[0], np.cumsum(count)])
            ids = self.known.pool[np.repeat(self.known.start[at] - upto[:-1], count) + np.arange(upto[-1])].astype("<u4").tobytes()
            cuts = (4 * upto[np.searchsorted(starts, begin)]).tolist() + [len(ids)]
            for i, x, y in zip(who.tolist(), cuts, cuts[1:]):
                out[i].append(ids[x:y])
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder per worker process and file, so that its caches outlive a task.

    Without ``specials`` the strings of special tokens in a text are ordinary text.
    """
    return Encoder(path, specials=specials)
