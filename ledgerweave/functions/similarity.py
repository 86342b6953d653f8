"""Similarity of texts by their words, for whole blocks of texts at once.

The ratios are the usual ones: Indel similarity (twice the longest common
subsequence by the sum of the lengths, in percent) of the sorted words, and
the best such ratio among the common words and each text's rest.

A subsequence takes one step for each character place of a block: the texts'
characters at that place choose a mask of the query's places, and bits of
64-bit words move on as in an addition. An index holds texts in blocks of like
length; what a block can reach at most, by its character counts and lengths,
says in which order blocks are scored and where that may end.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

U = np.uint64
ROWS = 256


def set_text(text: str) -> str:
    return " ".join(sorted(set(text.split())))


def sort_text(text: str) -> str:
    return " ".join(sorted(text.split()))


class Matrix:
    """Texts as rows of character numbers, 0 behind their ends."""

    def __init__(self, texts: list[str]):
        self.length = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.letters, numbers = np.unique(points, return_inverse=True)
        self.codes = np.zeros((len(texts), int(self.length.max(initial=0))), np.int32)
        self.codes[np.arange(self.codes.shape[1]) < self.length[:, None]] = numbers + 1

    def number(self, text: str) -> np.ndarray:
        """Numbers of a text's characters; those that no row has are 0."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)

    @cached_property
    def bags(self) -> np.ndarray:
        """How often each row has each character."""
        size = len(self.letters) + 1
        flat = self.codes + np.arange(len(self.codes))[:, None] * size
        out = np.bincount(flat.ravel(), minlength=size * len(self.codes)).reshape(-1, size)
        out[:, 0] = 0
        return out

    def bag(self, text: str) -> np.ndarray:
        out = np.bincount(self.number(text), minlength=len(self.letters) + 1)
        out[0] = 0
        return out

    def common(self, text: str, rows: np.ndarray | slice = slice(None), keep: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common subsequence of the text with each row (with its kept characters)."""
        codes = self.codes[rows] if keep is None else np.where(keep, self.codes[rows], 0)
        words = -(-len(text) // 64) or 1
        masks = np.zeros((words, len(self.letters) + 1), U)
        for i, c in enumerate(self.number(text).tolist()):
            if c:
                masks[i // 64, c] |= U(1 << (i % 64))
        state = np.full((words, len(codes)), ~U(0))
        for column in codes.T:
            carry = None
            for w in range(words):
                old = state[w]
                hit = old & masks[w][column]
                moved = old + hit
                over = moved < old
                if carry is not None:
                    moved = moved + carry
                    over |= moved < carry
                carry = over.astype(U) if w + 1 < words else None
                state[w] = moved | (old & ~hit)
        last = len(text) - 64 * (words - 1)
        state[-1] |= ~U(0) << U(last) if last < 64 else U(0)
        return (64 * words - np.bitwise_count(state).astype(np.int64).sum(axis=0)) if len(text) else np.zeros(len(codes), np.int64)


def ratio(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    total = np.asarray(a + b)
    return np.where(total > 0, 100.0 * 2 * common / np.maximum(total, 1), 100.0)


class Block:
    """Texts that are scored together."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.words = [t.split() for t in texts]
        self.sorted = Matrix([" ".join(sorted(w)) for w in self.words])
        sets = [sorted(set(w)) for w in self.words]
        self.sets = Matrix([" ".join(s) for s in sets])
        self.full = np.array([len(s) > 0 for s in sets])
        self.where: dict[str, list[tuple[int, int]]] = {}  # row and place among its words
        for row, own in enumerate(sets):
            for place, w in enumerate(own):
                self.where.setdefault(w, []).append((row, place))

    @cached_property
    def place(self) -> np.ndarray:
        """The word that a character belongs to; a blank belongs to the word behind it."""
        if not len(self.sets.letters) or self.sets.letters[0] != 32:
            return np.zeros(self.sets.codes.shape, np.int64)
        return np.cumsum(self.sets.codes == 1, axis=1)

    def sort_ratios(self, query: str, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        text = sort_text(query)
        return ratio(self.sorted.common(text, rows), len(text), self.sorted.length[rows])

    def sharing(self, query: str) -> dict[frozenset, np.ndarray]:
        """Rows by the words that they share with the query, those that share none left out."""
        shared: dict[int, list[str]] = {}
        for w in sorted(set(query.split())):
            for row, _ in self.where.get(w, ()):
                shared.setdefault(row, []).append(w)
        groups: dict[frozenset, list[int]] = {}
        for row, found in shared.items():
            groups.setdefault(frozenset(found), []).append(row)
        return {k: np.array(sorted(v)) for k, v in groups.items()}

    def shared_ratios(self, query: str, words: frozenset, rows: np.ndarray) -> np.ndarray:
        """Set ratios of rows whose common words with the query are these."""
        both = sum(map(len, words)) + len(words) - 1
        left = " ".join(sorted(set(query.split()) - words))
        if not left:
            return np.full(len(rows), 100.0)
        gone = np.zeros((len(rows), int(self.place[rows].max(initial=0)) + 1), bool)
        of = {row: i for i, row in enumerate(rows.tolist())}
        for w in words:
            for row, place in self.where[w]:
                if row in of:
                    gone[of[row], place] = True
        place, full = self.place[rows], self.sets.codes[rows] > 0
        first = np.argmin(gone, axis=1)  # of the words that stay; its blank goes
        keep = full & ~np.take_along_axis(gone, place, axis=1) & ~((place == first[:, None]) & (self.sets.codes[rows] == 1) & (place > 0))
        right = keep.sum(axis=1)
        common = self.sets.common(left, rows, keep)
        one, two = both + 1 + len(left), both + 1 + right
        best = np.maximum(ratio(both + 1 + common, one, two), np.maximum(ratio(np.full(len(rows), both), both, one), ratio(np.full(len(rows), both), both, two)))
        return np.where(right > 0, best, 100.0)

    def set_ratios(self, query: str) -> np.ndarray:
        text = set_text(query)
        out = np.where(self.full, ratio(self.sets.common(text), len(text), self.sets.length), 0.0) if text else np.zeros(len(self.texts))
        for words, rows in self.sharing(query).items():
            out[rows] = self.shared_ratios(query, words, rows)
        return out


class Index:
    """Texts in blocks of like length, for the k most similar ones of a query."""

    def __init__(self, texts: list[str], by: str, rows: int = ROWS):
        self.by = by
        order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i]))
        self.blocks = [Block([texts[i] for i in order[a : a + rows]]) for a in range(0, len(order), rows)]
        self.letters = np.unique(np.concatenate([m.letters for m in map(self.matrix, self.blocks)] or [np.zeros(0, np.uint32)]))
        self.most = np.zeros((len(self.blocks), len(self.letters)), np.int64)  # of a character in a row of the block
        for i, m in enumerate(map(self.matrix, self.blocks)):
            self.most[i, np.searchsorted(self.letters, m.letters)] = m.bags[:, 1:].max(axis=0, initial=0)
        self.shortest = np.array([self.matrix(b).length.min() for b in self.blocks], np.int64)
        self.longest = np.array([self.matrix(b).length.max() for b in self.blocks], np.int64)
        self.scored = self.asked = 0

    def matrix(self, block: Block) -> Matrix:
        return block.sets if self.by == "set_ratio" else block.sorted

    def best(self, query: str, k: int) -> list[tuple[str, float]]:
        """The k most similar texts, ties by text: exact, as blocks and rows are left out only where they cannot be among them."""
        text = set_text(query) if self.by == "set_ratio" else sort_text(query)
        self.asked += sum(len(b.texts) for b in self.blocks)
        if not text and self.by == "set_ratio":
            return [(t, 0.0) for t in sorted(t for b in self.blocks for t in b.texts)[:k]]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        have = np.array([np.count_nonzero(points == c) for c in self.letters], np.int64)
        reach = np.minimum(have, self.most).sum(axis=1)
        # The common characters are at most those, and at most the length of either; a longer text only lowers the ratio.
        size = np.clip(reach, self.shortest, self.longest)
        bound = np.where(len(points) + size > 0, 200.0 * np.minimum(reach, size) / np.maximum(len(points) + size, 1), 100.0)
        groups: list[dict] = [{}] * len(self.blocks)
        if self.by == "set_ratio":
            groups = [b.sharing(query) for b in self.blocks]
            bound = np.where([len(g) > 0 for g in groups], 100.0, bound)
        found: list[tuple[float, str]] = []
        for i in np.argsort(-bound, kind="stable"):
            least = -found[k - 1][0] if len(found) >= k else -1.0
            if bound[i] + 1e-9 < least:
                break
            block, m = self.blocks[i], self.matrix(self.blocks[i])
            rows = np.ones(len(block.texts), bool)
            for words, own in groups[i].items():
                rows[own] = False
                self.scored += len(own)
                found += zip((-block.shared_ratios(query, words, own)).tolist(), [block.texts[r] for r in own.tolist()], strict=True)
            most = ratio(np.minimum(m.bag(text), m.bags).sum(axis=1), len(points), m.length)
            rows = np.flatnonzero(rows & (most + 1e-9 >= least))
            if len(rows):
                self.scored += len(rows)
                score = ratio(m.common(text, rows), len(points), m.length[rows])
                if self.by == "set_ratio":
                    score = np.where(block.full[rows], score, 0.0)
                found += zip((-score).tolist(), [block.texts[r] for r in rows.tolist()], strict=True)
            found = sorted(found)[:k]
        return [(t, -s) for s, t in found]


def pair_ratios(a: list[str], b: list[str], by: str) -> np.ndarray:
    """The ratio of each pair, scored in blocks of the pairs with one left side."""
    out = np.zeros(len(a))
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    for x, at in places.items():
        for s in range(0, len(at), ROWS):
            own = at[s : s + ROWS]
            block = Block([b[i] for i in own])
            out[own] = block.set_ratios(x) if by == "set_ratio" else block.sort_ratios(x)
    return out
