"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are kept as one ragged numpy array of symbols. In each
step every sequence finds its own lowest-ranked adjacent pair and applies it
everywhere at once; sequences without a mergeable pair leave the array, and
what is left of them is their token count. Distinct pre-tokens are counted
once a batch.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import slices

#: White space as the tokenizer's pattern has it, and that pattern.
WHITE = "\t-\r \x85\xa0  -     　"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40


class PairTable:
    """Ranks of the merges, by pair of symbol ids, and the ids they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        # Printable bytes stand for themselves, the others for code points from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = iter(range(256, 512))
        self.byte = np.array([vocab[chr(b if b in plain else next(odd))] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


def merged_counts(pieces: list[bytes], table: PairTable) -> np.ndarray:
    """Symbols that survive all merges, for each byte string."""
    out = np.array([len(p) for p in pieces], np.int64)
    symbol = table.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    seq = np.repeat(np.arange(len(pieces)), out)
    while len(symbol) > 1:
        same = seq[1:] == seq[:-1]
        rank = np.full(len(symbol), NONE)
        rank[:-1][same] = table.ranks(symbol[:-1][same], symbol[1:][same])
        first = np.flatnonzero(np.r_[True, ~same])
        lowest = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.r_[first, len(symbol)])
        low = np.repeat(lowest, lengths)
        hit = (rank == low) & (low < NONE)
        if not hit.any():
            break
        # Of overlapping hits (as in "aaa") every second counts, from the left.
        where = np.flatnonzero(hit)
        run = np.r_[True, np.diff(where) > 1]
        nth = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        where = where[nth % 2 == 0]
        symbol[where] = table.made[rank[where]]
        np.subtract.at(out, seq[where], 1)
        keep = low < NONE
        keep[where + 1] = False
        symbol, seq = symbol[keep], seq[keep]
    return out


def pieces_of(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A very long text in parts, cut only where white space follows a word."""
    cut = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])")
    while len(text) > limit:
        m = cut.search(text, limit)
        if not m:
            break
        yield text[: m.start()]
        text = text[m.start() :]
    yield text


@functools.lru_cache(1)
def pair_table(path: str) -> PairTable:
    """The table of a file, read once by each Python worker."""
    return PairTable(path)


class Counter:
    """Counts the tokens of texts; keeps the counts of chunks it has seen."""

    def __init__(self, path: str, kept: int = 500_000):
        import regex

        self.table, self.kept, self.seen = pair_table(path), kept, {}
        self.pretoken = regex.compile(PRETOKEN)
        # White space and the word after it: no pre-token crosses the end of such a chunk.
        self.chunk = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.special = re.compile("|".join(map(re.escape, self.table.special)) or r"(?!)")

    def learn(self, chunks: list[str]) -> None:
        parts = [self.pretoken.findall(c) for c in chunks]
        flat = [p for x in parts for p in x]
        known = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        counts = merged_counts([p.encode("utf-8", "surrogatepass") for p in known], self.table)
        self.seen.update((c, int(sum(counts[known[p]] for p in x))) for c, x in zip(chunks, parts, strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        flat, owner = [], []
        for i, text in enumerate(texts):
            parts = self.special.split(text)
            total[i] = len(parts) - 1
            for part in parts:
                for piece in pieces_of(part):
                    found = self.chunk.findall(piece)
                    flat += found
                    owner.append((i, len(found)))
        if not flat:
            return total
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.seen) > self.kept:
            self.seen.clear()
        self.learn([c for c in names if c not in self.seen])
        counts = np.array([self.seen[c] for c in names], np.int64)[coded.indices.to_numpy()]
        at = np.repeat([o for o, _ in owner], [n for _, n in owner])
        total += np.bincount(at, counts, len(texts)).astype(np.int64)
        return total


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """A row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, without begin or end tokens; a special token's string inside
    a text is that token. A null text counts as empty (0 bytes, 0 tokens); a
    null id stays null; repeated rows each get a row; an empty table gives no
    rows; other columns are not read, so their names don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy()
            for a, b in slices(sizes, 2 << 20):
                n = counter.count(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b].astype(np.int64)), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
