"""Packing by minimum bin slack.

Documents become runs of token ids and are cut into pieces of at most one
window. Pieces are dealt at random to groups of a few thousand; in a group,
each window starts with the longest piece left, and a subset-sum dynamic
program over bitsets finds the multiset of other lengths that fills the window
closest to capacity; the counts are read back from the stored bitsets.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch, slices

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of texts for a tokenizer whose tokens never cross ASCII white space; each distinct word is encoded once."""

    def __init__(self, path: str, kept: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        length = np.array([len(x) for x in ids], np.int64)
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.flat = np.r_[self.flat, np.array([i for x in ids for i in x], np.uint32)]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin; one more entry than texts."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.number) > self.kept:
            self.forget()
        if new := [w for w in names if w not in self.number]:
            self.learn(new)
        word = np.fromiter((self.number[w] for w in names), np.int64, len(names))[coded.indices.to_numpy()]
        length = self.length[word]
        ends = np.r_[0, np.cumsum(length)]
        shift = np.repeat(self.start[word] - ends[:-1], length)
        return self.flat[shift + np.arange(ends[-1])], ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


@functools.cache
def coder(path: str) -> WordIds:
    """The worker process's own, so that tasks after the first know most words."""
    return WordIds(path)


def cuts(n: int, window: int, powers: bool) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows and the rest, or for powers the rest by its binary digits."""
    at = 0
    while n - at >= window:
        yield at, window
        at += window
    while n > at:
        length = 1 << ((n - at).bit_length() - 1) if powers else n - at
        yield at, length
        at += length


def fill(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Of the multiset counts, lengths whose sum comes closest to room from below.

    reach[i] has bit t set if some multiset of the first i lengths sums to t;
    stops as soon as room itself is reached.
    """
    mask, now, reach = (1 << (room + 1)) - 1, 1, []
    used = []
    for x in lengths:
        if x > room or not counts[x]:
            continue
        reach.append(now)
        used.append(x)
        left, step = min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            now |= (now << (x * step)) & mask
            left -= step
            step *= 2
        if now >> room & 1:
            break
    total, out = now.bit_length() - 1, []
    for x, before in zip(reversed(used), reversed(reach), strict=True):
        while not before >> total & 1:
            out.append(x)
            total -= x
    return out


def pack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length. Powers of two that cannot fill a window make a smaller power of two."""
    window_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    where: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable").tolist():
        where[int(lengths[i])].append(i)
    counts = {x: len(v) for x, v in where.items()}
    # Powers of two come last: they fill what the others leave, and need no padding when alone.
    main = sorted((x for x in counts if x & (x - 1)), reverse=True)
    order = main + sorted((x for x in counts if not x & (x - 1)), reverse=True)
    n = 0

    def place(xs: list[int]) -> None:
        nonlocal n
        at = 0
        for x in xs:
            i = where[x].pop()
            window_of[i], offset[i] = n, at
            at += x
            counts[x] -= 1
        n += 1

    while order:
        x = order[0]
        if not counts[x]:
            order = [y for y in order if counts[y]]
            continue
        counts[x] -= 1
        rest = fill(order, counts, window - x) if x < window else []
        total = x + sum(rest)
        if not x & (x - 1) and total < window:  # only powers of two are left, too few for a window: make the largest one
            rest = fill(order, counts, (1 << (total.bit_length() - 1)) - x)
        counts[x] += 1
        place([x, *rest])
    return window_of, offset


def pack_tokens(docs: DataFrame, path: str, end: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", group: int = 4096) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end; a null text counts as empty,
    so its only id is end. One document in 32, chosen by its ids, is cut into
    powers of two, which fill what others leave. Null ids stay null, repeated
    rows are documents of their own, an empty table gives no rows; other
    columns are not read. The pieces are saved in the shared folder before
    they are packed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    mark = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            for a, b in slices(sizes, 4 << 20):
                ids, at = known.encode(batch.column(1).slice(a, b - a))
                data, row, out = memoryview(ids.astype("<u4").tobytes()), [], []
                for i in range(b - a):
                    n = int(at[i + 1] - at[i]) + 1
                    whole = zlib.crc32(mark, zlib.crc32(data[4 * at[i] : 4 * at[i + 1]]))
                    for start, length in cuts(n, window, whole % 32 == 0):
                        crc = zlib.crc32(data[4 * (at[i] + start) : 4 * (at[i] + min(start + length, n - 1))])
                        row.append(i)
                        out.append((start, length, zlib.crc32(mark, crc) if start + length == n else crc, n))
                columns = np.array(out, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row, pa.int64())), *map(pa.array, columns)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    pieces = Scratch(docs.sparkSession, "packing").save(rows.mapInArrow(cut, f"`{id_col}` {kind}, {PIECES}").withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups))).drop("__row")

    def packed(t: pa.Table) -> pa.Table:
        sequence, offset = pack(t["length"].to_numpy(), window)
        first = t["__group"][0].as_py() << 32
        return t.drop_columns("__group").append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return dealt.groupBy("__group").applyInArrow(packed, f"`{id_col}` {kind}, {PIECES}, sequence_id long, offset long")
