"""Removal of long passages that an earlier document has, by recompression.

Words are symbols. In each round every run of one symbol gets a name, then
pairs do: a bit of a symbol's name says whether it may be the left or the
right half of a pair, and a left one with a right one after it become one
symbol. A name is a function of what it stands for, so it is the same in every
document, task and round, without an exchange.

A window of words has symbols that its own words determine. At either end, a
round costs it the run that the end may cut, and one symbol whose partner may
lie outside; all symbols between are the same wherever the window occurs. Of
these, neighbours that together span REACH words make a high-level symbol, and
the one with the least name stands for the window. Spark groups the documents
by these symbols: shared ones reveal where documents may repeat each other.
The windows that have a shared symbol are named by all of theirs, those of the
last round in the middle and those of earlier rounds towards the ends, and
Spark finds the smallest document of each such name. Windows in which the
rounds leave no such symbol (those in long runs, or of short periods) are
their own symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch, slices
from ledgerweave.llm.words import U, mix, word_hashes

#: Rounds, and how many words a high-level symbol spans at least.
ROUNDS, REACH = 3, 8
BASE = 0x9E3779B97F4A7C15
RUN = U(0xD1B54A32D192ED03)
#: The id that stands for null: larger than any other.
LAST = (1 << 63) - 1


@dataclass
class Round:
    """How one round goes on from the symbols before it: what each becomes."""

    run: np.ndarray  #: number of the run that a symbol before is in
    right: np.ndarray  #: whether a run may be a right half only
    symbol: np.ndarray  #: number of the symbol that a run is in
    names: np.ndarray  #: names of the symbols
    start: np.ndarray  #: their first words


def next_round(names: np.ndarray, start: np.ndarray, doc: np.ndarray, r: int) -> tuple[Round, np.ndarray]:
    """The round after symbols of these names and first words, in documents of these numbers; and the documents of its symbols."""
    edge = np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])][: len(names)]
    first = np.flatnonzero(edge)
    length = np.diff(np.r_[first, len(names)])
    with np.errstate(over="ignore"):
        runs = np.where(length > 1, mix((names[first] ^ RUN) * U(BASE) + length.astype(U)), names[first])
    right = (mix(runs ^ U(r)) & U(1)).astype(bool)
    doc = doc[first]
    paired = np.flatnonzero(~right[:-1] & right[1:] & (doc[:-1] == doc[1:]))
    with np.errstate(over="ignore"):
        runs[paired] = mix(runs[paired] * U(BASE) + runs[paired + 1])
    keep = np.ones(len(runs), bool)
    keep[paired + 1] = False
    return Round(np.cumsum(edge) - 1, right, np.cumsum(keep) - 1, runs[keep], start[first][keep]), doc[keep]


def rounds(words: np.ndarray, at: np.ndarray) -> tuple[list[Round], np.ndarray]:
    """All rounds, and the documents of the symbols of the last."""
    names, start, doc, out = mix(words), np.arange(len(words)), np.repeat(np.arange(len(at) - 1), np.diff(at)), []
    for r in range(1, ROUNDS + 1):
        step, doc = next_round(names, start, doc, r)
        names, start = step.names, step.start
        out.append(step)
    return out, doc


def high_symbols(step: Round, doc: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the name of it and its next neighbours that span REACH words, and where these end (excluded); past the end of the document where there are too few."""
    n = len(step.names)
    ends = np.r_[step.start[1:], words]  # first word after each symbol
    stop = np.searchsorted(doc, doc, "right")  # first symbol of the next document
    name, last, todo = step.names.copy(), np.arange(n), np.arange(n)
    while True:
        todo = todo[ends[last[todo]] - step.start[todo] < REACH]
        if not len(todo):
            break
        last[todo] += 1
        over = last[todo] >= stop[todo]
        last[todo[over]] = stop[todo[over]]
        todo = todo[~over]
        with np.errstate(over="ignore"):
            name[todo] = mix(name[todo] * U(BASE) + step.names[last[todo]])
    return name, last + 1


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low : high] for each pair, of which none is empty."""
    out, power = np.zeros(len(low), values.dtype), np.log2(high - low).astype(np.int64)
    table = values
    for k in range(int(power.max(initial=-1)) + 1):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def inward(step: Round, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What windows with the symbols low to high (excluded, and at least one) before a round have after it; low >= high where nothing is left."""
    a, b = step.run[low] + 1, step.run[high - 1]
    a = a + (step.right[np.minimum(a, len(step.right) - 1)] & (a < b))
    b = b - (~step.right[b - 1] & (a < b))
    live = a < b
    return np.where(live, step.symbol[np.minimum(a, len(step.symbol) - 1)], 0), np.where(live, step.symbol[b - 1] + 1, 0)


def window_starts(at: np.ndarray, window: int) -> np.ndarray:
    """Flat positions of the words that begin a window inside their document."""
    n = np.diff(at)
    full = np.maximum(n - window + 1, 0)
    before = np.cumsum(full) - full
    return np.arange(full.sum()) + np.repeat(at[:-1] - before, full)


class Fold:
    """Names of stretches of a sequence of names, by sums of them times powers of a base."""

    def __init__(self, names: np.ndarray, salt: int):
        with np.errstate(over="ignore"):
            power, self.inverse = np.full(len(names) + 1, U(BASE)), np.full(len(names) + 1, U(pow(BASE, -1, 1 << 64)))
            power[0] = self.inverse[0] = 1
            power, self.inverse = np.cumprod(power), np.cumprod(self.inverse)
            self.total = np.r_[U(0), np.cumsum(mix(names + U(salt)) * power[:-1])]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[high] - self.total[low]) * self.inverse[low] + (high - low).astype(U))


def window_symbols(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[Round]]:
    """Flat starts of all windows, their symbols, and the rounds."""
    starts, (steps, doc) = window_starts(at, window), rounds(words, at)
    symbol = np.zeros(len(starts), U)
    which, low, high = np.arange(len(starts)), starts, starts + window
    for step in steps:
        low, high = inward(step, low, high)
        live = low < high
        which, low, high = which[live], low[live], high[live]
    names, ends = high_symbols(steps[-1], doc, len(words))
    most = np.searchsorted(ends, high, "right")  # symbols from here on end outside
    fits = most > low
    which, low, most = which[fits], low[fits], most[fits]
    symbol[which] = least_in(names, low, most)
    alone = np.setdiff1d(np.arange(len(starts)), which, assume_unique=True)
    if len(alone):
        symbol[alone] = Fold(words, 5)(starts[alone], starts[alone] + window)
    return starts, symbol, steps


def window_names(words: np.ndarray, steps: list[Round], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the windows at starts, made from their symbols of all rounds."""
    out = []
    for salt in (1, 2):
        name, which, low, high = np.zeros(len(starts), U), np.arange(len(starts)), starts, starts + window
        before = mix(words)
        for step in [*steps, None]:
            fold = Fold(before, salt)
            a, b = inward(step, low, high) if step else (np.zeros(len(low), np.int64), np.zeros(len(low), np.int64))
            live = a < b
            with np.errstate(over="ignore"):
                # Where the window goes on to the next round, only what that leaves out is folded in; elsewhere, all that is left.
                name[which[~live]] = mix(name[which[~live]] * U(BASE) + fold(low[~live], high[~live]))
                if step is not None and live.any():
                    first = np.searchsorted(step.symbol, a[live])
                    last = np.searchsorted(step.symbol, b[live] - 1, "right")
                    inner = np.searchsorted(step.run, first), np.searchsorted(step.run, last - 1, "right")
                    name[which[live]] = mix(mix(name[which[live]] * U(BASE) + fold(low[live], inner[0])) * U(BASE) + fold(inner[1], high[live]))
            which, low, high = which[live], a[live], b[live]
            before = step.names if step else before
            if not len(which):
                break
        out.append(name.astype(np.int64))
    return out[0], out[1] & 0x7FFFFFFF


def sequence_name(words: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        i = np.arange(len(words), dtype=U)
        return tuple(int(mix(mix(words ^ U(salt)) + i * U(BASE)).sum(dtype=U).astype(np.int64)) for salt in (3, 4))


def kept_hash(text: bytes, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the words (those to keep) joined by one space."""
    words = text.split()
    return hashlib.sha256(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep)])).hexdigest()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e in slices(pc.binary_length(batch.column(column)).to_numpy(), limit):
            yield batch.slice(s, e - s)


def repeats(docs: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For docs (id long, q long, text): all documents, those with a shared symbol, and the starts of repeated windows.

    all: id, q, n, q1, q2, sha, first (smallest id with the same words; null below window words)
    some: id, q, hits, text, of documents whose words no smaller id has
    starts: id, q, starts: word numbers at which a window begins that also begins in a smaller id
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 2):
            words, at = word_hashes(part.column(2))
            starts, symbol, _ = window_symbols(words, at, window)
            cut = np.searchsorted(starts, at)
            symbols = [np.unique(symbol[a:b]).astype(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
            names = np.array([sequence_name(words[s:e]) for s, e in zip(at, at[1:], strict=False)], np.int64).reshape(-1, 2)
            sha = [kept_hash(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in symbols])], pa.int32()), pa.array(np.concatenate([*symbols, np.zeros(0, np.int64)])))
            columns = [np.diff(at), names[:, 0], names[:, 1], pa.array(sha, pa.string()), flat]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=["id", "q", "n", "q1", "q2", "sha", "names"])

    base = scratch.save(docs.mapInArrow(survey, "id long, q long, n long, q1 long, q2 long, sha string, names array<long>"), "survey")
    same = ["n", "q1", "q2"]
    firsts = base.filter(F.col("n") >= window).groupBy(*same).agg(F.min("id").alias("first"))
    everything = scratch.save(base.join(firsts.hint("merge"), same, "left").withColumn("names", F.when(F.col("id") == F.col("first"), F.col("names"))), "all")
    scratch.drop("survey")

    found = everything.filter("names is not null").select("id", "q", F.explode("names").alias("name"))
    shared = found.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("name")
    hits = found.join(shared.hint("merge"), "name").groupBy("id", "q").agg(F.collect_set("name").alias("hits"))
    some = scratch.save(docs.join(hits.hint("merge"), ["id", "q"]).select("id", "q", "hits", "text"), "some")

    def near_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 3, 2 << 20):
            words, at = word_hashes(part.column(3))
            starts, symbol, steps = window_symbols(words, at, window)
            cut = np.searchsorted(starts, at)
            hit = [np.isin(symbol[a:b], part.column(2)[i].values.to_numpy().astype(U)) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
            starts = starts[np.concatenate([*hit, np.zeros(0, bool)])]
            w1, w2 = window_names(words, steps, starts, window)
            doc = np.searchsorted(at, starts, "right") - 1
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(starts - at[doc]).cast(pa.int32()), pa.array(w1), pa.array(w2).cast(pa.int32())], names=["id", "q", "start", "w1", "w2"])

    windows = scratch.save(some.mapInArrow(near_hits, "id long, q long, start int, w1 long, w2 int"), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("high")
    starts = windows.join(earliest.hint("merge"), ["w1", "w2"]).filter("id > low").groupBy("id", "q").agg(F.collect_set("start").alias("starts"))
    starts = scratch.save(starts, "starts")
    scratch.drop("windows")
    return everything.drop("names"), some, starts


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256.

    Every word goes that is covered by a window of so many consecutive words
    that also begins in a document with a smaller id; windows are judged on
    the input. A null text has no words; a null id counts as larger than all
    others; documents with the same id don't take words from each other, and
    repeated rows each get a row. Very long texts are read whole; an empty
    table gives no rows; other columns are not read.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("q"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    everything, some, starts = repeats(docs, window, scratch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 3):
            _, at = word_hashes(part.column(3))
            removed, sha = [], []
            for i, (text, begins) in enumerate(zip(part.column(3).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)):
                edge = np.zeros(at[i + 1] - at[i] + 1, np.int64)
                edge[begins] += 1
                np.subtract.at(edge, np.array(begins) + window, 1)
                keep = np.cumsum(edge[:-1]) <= 0
                removed.append(int((~keep).sum()))
                sha.append(kept_hash(text, keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "q", "removed", "kept"])

    after = some.select("id", "q", "text").join(starts.hint("merge"), ["id", "q"]).select("id", "q", "starts", "text").mapInArrow(cut, "id long, q long, removed long, kept string")
    after = scratch.save(after.dropDuplicates(["id", "q"]), "after")
    scratch.drop("some", "starts")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    joined = everything.join(after.hint("merge"), ["id", "q"], "left")
    return joined.select(
        F.when(F.col("id") != LAST, F.col("id")).cast(docs.schema["id"].dataType).alias(id_col), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
