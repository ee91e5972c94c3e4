"""FM-index over word ids: suffix array by prefix doubling, wavelet matrix, sampled positions.

Everything works on whole arrays of patterns or rows at once, so a search costs a few gathers per
pattern and level of the wavelet matrix.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an array of non-negative ints in order; a shorter one comes first."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1  # 0: past the end
    k, width = 1, int(rank.max()) + 1
    order = np.argsort(rank, kind="stable")

    def groups(key: np.ndarray) -> np.ndarray:
        """For sorted keys, 1-based position of each key's first equal."""
        first = np.append(True, key[1:] != key[:-1])
        return np.maximum.accumulate(np.where(first, np.arange(1, len(key) + 1), 0))

    rank[order] = groups(rank[order])
    active = np.arange(n)  # slots of the order whose suffixes aren't told apart yet
    while True:
        r = rank[order[active]]
        tied = np.append(r[1:] == r[:-1], False)
        tied[1:] |= tied[:-1]
        active = active[tied]
        if not len(active):
            return order
        who = order[active]
        nxt = np.where(who + k < n, rank[np.minimum(who + k, n - 1)], 0)
        key = rank[who] * (n + 2) + nxt
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[active] = who
        # the new rank: the slot of the first suffix with the same key
        first = np.append(True, key[1:] != key[:-1])
        rank[who] = active[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] + 1
        k *= 2


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray | None = None, words: np.ndarray | None = None) -> None:
        if words is None:
            pad = np.zeros(-len(bits) % 64 + 64, bool)
            words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix of an int array: ranks and values level by level, highest bit first."""

    def __init__(self, n: int, levels: list[Bits], zeros: list[int]) -> None:
        self.n, self.levels, self.zeros = n, levels, zeros

    @classmethod
    def build(cls, values: np.ndarray, depth: int) -> Wavelet:
        levels, zeros, v = [], [], values
        for d in range(depth - 1, -1, -1):
            bit = ((v >> d) & 1).astype(bool)
            levels.append(Bits(bit))
            zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])
        return cls(len(values), levels, zeros)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs among the first i values."""
        start, depth = np.zeros_like(i), len(self.levels)
        for d, (bits, z) in enumerate(zip(self.levels, self.zeros)):
            one = ((c >> (depth - 1 - d)) & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i, start = np.where(one, z + ri, i - ri), np.where(one, z + rs, start - rs)
        return i - start

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bits, z in zip(self.levels, self.zeros):
            one, r = bits.get(i), bits.rank(i)
            out = (out << 1) | one
            i = np.where(one, z + r, i - r)
        return out


class FMIndex:
    """Index of the word lists of several documents, with the words themselves as numbers (text) and a
    digest of each document's words."""

    def __init__(self, vocabulary: list[str], first: np.ndarray, smaller: np.ndarray, bwt: Wavelet, marked: Bits, kept: np.ndarray, text: np.ndarray, digests: np.ndarray) -> None:
        self.text, self.digests = text, digests
        self.vocabulary = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.names, self.first, self.smaller, self.bwt, self.marked, self.kept = vocabulary, first, smaller, bwt, marked, kept

    @classmethod
    def build(cls, documents: list[list[str]]) -> FMIndex:
        ids: dict[str, int] = {}
        flat: list[int] = []
        first = np.zeros(len(documents) + 1, np.int64)
        for k, words in enumerate(documents):
            flat.extend([ids.setdefault(w, len(ids) + 2) for w in words])
            flat.append(1)  # end of a document; no pattern holds it
            first[k + 1] = len(flat)
        flat.append(0)  # end of the text, once: else the steps back from a suffix go astray
        text = np.array(flat, np.int64)
        sa = suffix_array(text)
        depth = (len(ids) + 1).bit_length()
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(ids) + 2))]).astype(np.int64)
        last = text[sa - 1] if len(sa) else text
        mark = sa % SAMPLE == 0
        digests = np.array([int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for w in documents], np.int64)
        return cls(list(ids), first, smaller, Wavelet.build(last, depth), Bits(mark), sa[mark].astype(np.int32), text.astype(np.int32), digests)

    def words(self, first: int, end: int) -> str:
        """The words at positions [first, end) of the text."""
        return " ".join(self.names[i - 2] for i in self.text[first:end].tolist() if i > 1)

    def ids(self, phrases: list[tuple[str, ...]]) -> np.ndarray:
        """Phrases of one length as rows of word ids; -1 for a word that doesn't occur."""
        look = self.vocabulary
        return np.array([[look.get(w, -1) for w in p] for p in phrases], np.int64).reshape(len(phrases), -1)

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each row of ids the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.bwt.n, np.int64)
        lo[(rows < 0).any(axis=1)] = hi[(rows < 0).any(axis=1)] = 0
        for k in range(rows.shape[1] - 1, -1, -1):
            alive = np.flatnonzero(lo < hi)
            if not len(alive):
                break
            c = rows[alive, k]
            base = self.smaller[c]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = base + both[: len(alive)], base + both[len(alive) :]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, text position) of every occurrence: from each suffix back to a sampled one."""
        count = hi - lo
        row = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        position, steps = np.full(len(row), -1, np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            i = at[todo]
            hit = self.marked.get(i)
            position[todo[hit]] = self.kept[self.marked.rank(i[hit])] + steps
            todo, i = todo[~hit], i[~hit]
            c = self.bwt.get(i)
            at[todo] = self.smaller[c] + self.bwt.rank(c, i)
            steps += 1
        return row, position

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {"first": self.first, "smaller": self.smaller, "zeros": np.array(self.bwt.zeros, np.int64), "n": np.array([self.bwt.n]), "marked": self.marked.words, "kept": self.kept, "text": self.text, "digests": self.digests}
        arrays |= {f"level{k}": b.words for k, b in enumerate(self.bwt.levels)}
        arrays["names"] = np.frombuffer("\n".join(self.names).encode(), np.uint8)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        a = np.load(io.BytesIO(data), allow_pickle=False)
        zeros = a["zeros"].tolist()
        names = a["names"].tobytes().decode()
        levels = [Bits(words=a[f"level{k}"]) for k in range(len(zeros))]
        return cls(names.split("\n") if names else [], a["first"], a["smaller"], Wavelet(int(a["n"][0]), levels, zeros), Bits(words=a["marked"]), a["kept"], a["text"], a["digests"])
