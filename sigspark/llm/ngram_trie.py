"""A trie of n-grams up to three words in compact levels that are memory-mapped and searched as they are.

An n-gram (u, v, w), w being the predicted word, hangs at v -> w -> u: all that follows v is one range of level 2, and all
that stood before (v, w) is one range of level 3.  Words are ids above 0.  A level holds its ids as one Elias-Fano
sequence, each range lifted above the one before, the pointers to ranges as another, and for each node the code of its
frequency.  In level 3 an id is context-relative: the rank of u among the words seen before v.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

import numpy as np

from sigspark.llm import storage
from sigspark.llm.elias_fano import EliasFano


class Codebook:
    """Counts as codes: exact up to ``exact``, then in geometric steps, ``steps`` of them doubling a count."""

    def __init__(self, exact: int, steps: int, dtype: type):
        self.exact, self.steps, self.dtype = exact, steps, dtype
        codes = np.arange(np.iinfo(dtype).max + 1, dtype=np.float64)
        self.counts = np.where(codes <= exact, codes, np.exp2(np.maximum(codes - exact, 0) / steps) * exact)

    def encode(self, counts: np.ndarray) -> np.ndarray:
        more = self.exact + np.rint(np.log2(np.maximum(counts, self.exact) / self.exact) * self.steps)
        return np.minimum(np.where(counts <= self.exact, counts, more), len(self.counts) - 1).astype(self.dtype)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.counts[codes]


PAIRS = Codebook(2048, 1024, np.uint16)  # totals of contexts: within 0.04 %
TRIPLES = Codebook(100, 4, np.uint8)  # within 9 % beyond 100

_SEQUENCES = ("words", "first2", "ids2", "first_before", "before", "first3", "ids3")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    return np.unique(keys, return_inverse=True)


def _joined(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Pairs of numbers as single ones in the same order, and the bits of the second."""
    bits = int(two.max()).bit_length() if len(two) else 0
    if len(one) and int(one.max()).bit_length() + bits > 64:
        raise OverflowError("a shard of this trie has too many words; use smaller shards")
    return one.astype(np.uint64) << np.uint64(bits) | two.astype(np.uint64), np.uint64(bits)


def _split(keys: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> bits).astype(np.int64), keys & np.uint64((1 << int(bits)) - 1)


def _lifted(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each range of ascending ids above the last value of the range before."""
    size = np.diff(first)
    some = size > 0
    step = np.zeros(len(size), np.uint64)
    step[some] = ids[first[1:][some] - 1] + np.uint64(1)
    return ids + np.repeat(np.cumsum(step) - step, size)


class NgramTrie:
    """The levels of one shard."""

    def __init__(self, sequences: Mapping[str, EliasFano], codes2: np.ndarray, codes3: np.ndarray):
        self.sequences, self.codes2, self.codes3 = dict(sequences), codes2, codes3
        self._plain: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, v: np.ndarray, w: np.ndarray, u: np.ndarray, counts: np.ndarray) -> NgramTrie:
        """From n-grams in any order, repeated ones added up; u = 0 stands for none, and such a row counts for (v, w) only."""
        words, at_v = _distinct(v.astype(np.uint64))
        keys, bits = _joined(at_v, w)
        keys, at_pair = _distinct(keys)
        pair_v, pair_w = _split(keys, bits)
        totals = np.bincount(at_pair, counts, len(keys))
        keys, bits = _joined(at_pair, u)
        keys, at = _distinct(keys)
        sums = np.bincount(at, counts, len(keys))
        triple_pair, triple_u = _split(keys, bits)
        real = triple_u > 0
        triple_pair, triple_u, sums = triple_pair[real], triple_u[real], sums[real]
        keys, bits = _joined(pair_v[triple_pair], triple_u)
        keys, at = _distinct(keys)
        before_v, before_u = _split(keys, bits)
        first = lambda node, n: np.searchsorted(node, np.arange(n + 1))
        first2, first_before, first3 = first(pair_v, len(words)), first(before_v, len(words)), first(triple_pair, len(pair_v))
        rank = (at - first_before[pair_v[triple_pair]]).astype(np.uint64)
        order = np.lexsort((rank, triple_pair))  # ascending already, as ranks follow ids
        found = {"words": words, "first2": first2, "ids2": _lifted(pair_w, first2), "first_before": first_before, "before": _lifted(before_u, first_before), "first3": first3, "ids3": _lifted(rank[order], first3)}
        return cls({k: EliasFano.of(x) for k, x in found.items()}, PAIRS.encode(totals), TRIPLES.encode(sums[order]))

    def write(self, uri: str) -> None:
        """One file: a line of JSON, padded to 8 bytes, and the arrays as they lie in memory."""
        arrays = {f"{k}.{part}": getattr(s, part) for k, s in self.sequences.items() for part in ("low", "high")} | {"codes2": self.codes2, "codes3": self.codes3}
        at, places = 0, {}
        for k, x in arrays.items():
            places[k] = (at, len(x), x.dtype.str)
            at += -(-x.nbytes // 8) * 8
        head = json.dumps({"arrays": places, "sequences": {k: (s.n, s.width) for k, s in self.sequences.items()}}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        with storage.committed(uri) as out:
            out.write(head)
            for x in arrays.values():
                out.write(x.tobytes() + bytes(-x.nbytes % 8))

    @classmethod
    def open(cls, uri: str) -> NgramTrie:
        """The levels of a file, mapped where it is local and else read."""
        files, path = storage.open_fs(uri)
        if files.type_name == "local":
            data = np.memmap(os.fspath(path), np.uint8, "r")
        else:
            with files.open_input_file(path) as file:
                data = np.frombuffer(file.read(), np.uint8)
        size = int(np.flatnonzero(data[: 1 << 16] == 10)[0]) + 1
        head = json.loads(bytes(data[:size]))
        arrays = {k: data[size + at : size + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, n, kind) in head["arrays"].items()}
        return cls({k: EliasFano(n, width, arrays[f"{k}.low"], arrays[f"{k}.high"]) for k, (n, width) in head["sequences"].items()}, arrays["codes2"], arrays["codes3"])

    def _get(self, name: str, at: np.ndarray, many: bool) -> np.ndarray:
        if not many:
            return self.sequences[name].access(at)
        if name not in self._plain:
            self._plain[name] = self.sequences[name].decode()
        return self._plain[name][at]

    def _successor(self, ids: str, pointers: str, node: np.ndarray, x: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In each node's range the place of x, whether it is there, and where the range starts."""
        if not self.sequences[ids].n or not len(node):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool), np.zeros(len(node), np.int64)
        lo, hi = (self._get(pointers, node + k, many).astype(np.int64) for k in (0, 1))
        base = np.where(lo > 0, self._get(ids, np.maximum(lo - 1, 0), many) + np.uint64(1), np.uint64(0))
        want = base + x.astype(np.uint64)
        at = np.searchsorted(self._plain[ids], want) if many else self.sequences[ids].locate(want)
        there = (at < hi) & (lo < hi)
        there[there] = self._get(ids, at[there], many) == want[there]
        return at, there, lo

    def find(self, v: np.ndarray, w: np.ndarray, pair: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs (v, w), and of the triples that u (0: none) makes with the pair of the given place; 0: not there."""
        many = 16 * len(u) > len(self.codes3)  # then the levels are unpacked once
        words = self.sequences["words"]
        out2, out3 = np.zeros(len(v), PAIRS.dtype), np.zeros(len(u), TRIPLES.dtype)
        if not words.n:
            return out2, out3
        if many and "words" not in self._plain:
            self._plain["words"] = words.decode()
        at = np.searchsorted(self._plain["words"], v.astype(np.uint64)) if many else words.locate(v)
        known = np.flatnonzero(at < words.n)
        known = known[self._get("words", at[known], many) == v[known].astype(np.uint64)]
        place, there, _ = self._successor("ids2", "first2", at[known], w[known], many)
        known, node2 = known[there], np.full(len(v), -1)
        node2[known] = place[there]
        out2[known] = self.codes2[node2[known]]
        asked = np.flatnonzero((node2[pair] >= 0) & (u > 0))
        place, there, start = self._successor("before", "first_before", at[pair[asked]], u[asked], many)
        asked, rank = asked[there], (place - start)[there]
        place, there, _ = self._successor("ids3", "first3", node2[pair[asked]], rank, many)
        out3[asked[there]] = self.codes3[place[there]]
        return out2, out3
