"""A minimal perfect hash over distinct 64-bit keys, and its sharded index of values."""

from __future__ import annotations

import io

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # splitmix64's constants
_FULL = (1 << 64) - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of each key, other for each seed."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((_ODD[0] * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_ODD[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_ODD[2])
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key that is alone at its place on a level is held there, the others go one level
    on; the rank of its bit is its number. What 24 levels don't part (practically none) is kept sorted. Numbers
    run gapless from 0. A key that was not built in gets any number or -1: callers compare a fingerprint."""

    GAMMA, LEVELS = 2.0, 24

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        self.size = len(keys)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, rest = 0, keys
        for level in range(self.LEVELS):
            if not len(rest):
                break
            places = max(64, -(-int(self.GAMMA * len(rest)) // 64) * 64)
            at = (mix(rest, level) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places)[at] == 1
            bits = np.zeros(places, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
            self.levels.append((places, words, ranks))
            base += int(alone.sum())
            rest = rest[~alone]
        self.base, self.rest = base, np.sort(rest)

    def place(self, key: int) -> int:
        """lookup() of one key, without arrays."""
        for level, (places, words, ranks) in enumerate(self.levels):
            z = (key + _ODD[0] * (level + 1)) & _FULL
            z = ((z ^ (z >> 30)) * _ODD[1]) & _FULL
            z = ((z ^ (z >> 27)) * _ODD[2]) & _FULL
            at = (z ^ (z >> 31)) % places
            held = int(words[at >> 6])
            if held >> (at & 63) & 1:
                return int(ranks[at >> 6]) + (held & ((1 << (at & 63)) - 1)).bit_count()
        if len(self.rest):
            at = int(np.searchsorted(self.rest, np.uint64(key)))
            if at < len(self.rest) and int(self.rest[at]) == key:
                return self.base + at
        return -1

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (places, words, ranks) in enumerate(self.levels):
            if not len(todo):
                return out
            at = mix(keys[todo], level) % np.uint64(places)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.base + at[same]
        return out


class HashIndex:
    """For one shard: perfect hash, a 64-bit fingerprint and values by number. Keys are (hi, lo) of a 128-bit
    hash: hi is hashed, lo is the fingerprint; equal hi with other lo go to a small sorted side table."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, first: np.ndarray, count: np.ndarray):
        hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
        order = np.lexsort((lo, hi))
        hi, lo, first, count = hi[order], lo[order], first[order], count[order]
        lead = np.ones(len(hi), bool)
        lead[1:] = hi[1:] != hi[:-1]
        self.hash = PerfectHash(hi[lead])
        at = self.hash.lookup(hi[lead])
        self.fingerprint = np.zeros(len(at), np.uint64)
        self.first = np.zeros(len(at), np.int64)
        self.count = np.zeros(len(at), np.int64)
        self.fingerprint[at], self.first[at], self.count[at] = lo[lead], first[lead], count[lead]
        self.side = {(int(h), int(x)): (int(f), int(c)) for h, x, f, c in zip(hi[~lead], lo[~lead], first[~lead], count[~lead])}

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, first)"""
        if not self.hash.size:
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        at = self.hash.lookup(hi)
        found = (at >= 0) & (self.fingerprint[at] == lo)
        first = np.where(found, self.first[at], 0)
        if self.side:
            for i in np.flatnonzero(~found):
                if hit := self.side.get((int(hi[i]), int(lo[i]))):
                    found[i], first[i] = True, hit[0]
        return found, first

    def dump(self) -> bytes:
        out = io.BytesIO()
        side = [(*k, *v) for k, v in self.side.items()]
        arrays = {"size": np.array([self.hash.size, self.hash.base, len(self.hash.levels)]), "rest": self.hash.rest, "fp": self.fingerprint, "first": self.first, "count": self.count}
        arrays["side_k"] = np.array([x[:2] for x in side], np.uint64).reshape(-1, 2)
        arrays["side_v"] = np.array([x[2:] for x in side], np.int64).reshape(-1, 2)
        for i, (places, words, ranks) in enumerate(self.hash.levels):
            arrays |= {f"w{i}": words, f"r{i}": ranks}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> HashIndex:
        self, z = cls.__new__(cls), np.load(io.BytesIO(blob))
        self.hash = PerfectHash.__new__(PerfectHash)
        self.hash.size, self.hash.base, n = (int(x) for x in z["size"])
        self.hash.rest = z["rest"]
        self.hash.levels = [(len(z[f"w{i}"]) * 64, z[f"w{i}"], z[f"r{i}"]) for i in range(n)]
        self.fingerprint, self.first, self.count = z["fp"], z["first"], z["count"]
        self.side = {(int(h), int(x)): (int(f), int(c)) for (h, x), (f, c) in zip(z["side_k"], z["side_v"])}
        return self
