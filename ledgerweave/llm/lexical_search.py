"""Ranked lexical search without an index of the documents: their texts run through an automaton of all terms asked for.

A term is a maximal run of bytes that a term may have, so a text in which
every other byte is a space holds a term exactly where it holds the term
between two spaces. The automaton (Aho-Corasick) knows each term with these
two guards, and its outputs lead to the items that ask for the term.

1. Scan: every text once; kept are its number of terms and the counts of the
   terms asked for.
2. The scanned counts give the number of documents that hold a term.
3. Score: each task adds up its documents' scores and keeps the best of each
   item; a window merges the tasks' lists.

The items' terms are sent to the tasks in slices of bounded size; more items
make more slices, each of which scans the documents.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch, slices

#: A term has digits, letters and all that is beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What a byte of a text is to the automaton: a term's byte with A-Z in lower case, or a space.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: Bytes of terms that one slice of the items holds, about.
SLICE_BYTES = 4 << 20
#: Cells of one matrix of documents and items.
CELLS = 4 << 20


@functools.lru_cache(2)
def automaton(terms: tuple[bytes, ...]):
    """Of all terms, each with its guards; the output of a term is its number. Made once by each Python worker."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", i)
    if terms:
        found.make_automaton()
    return found


def scan(texts: list[bytes], terms: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, term, count) of the terms asked for, by text."""
    data = np.frombuffer(b"".join([b" ", *chain.from_iterable((t, b" ") for t in texts)]), np.uint8)
    plain = BYTES[data]
    ends = np.cumsum([len(t) + 1 for t in texts])  # where the space behind each text stands
    full = plain != 32
    sizes = np.bincount(np.searchsorted(ends, np.flatnonzero(full[1:] & ~full[:-1]) + 1), minlength=len(texts))
    hits = np.zeros((0, 2), np.int64)
    if terms:
        hits = np.fromiter(chain.from_iterable(automaton(terms).iter(plain.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
    key, count = np.unique(np.searchsorted(ends, hits[:, 0]) * len(terms) + hits[:, 1], return_counts=True)
    return sizes, key // max(len(terms), 1), key % max(len(terms), 1), count


class Best:
    """The k best documents of each item so far: by score, then by smaller id, ids that are null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Take in a matrix of scores, a row per document."""
        doc, item = np.nonzero(scores >= self.least)
        new = item, scores[doc, item], ids[doc], null[doc]
        item, score, at, null = (np.concatenate(x) for x in zip(self.held, new, strict=True))
        order = np.lexsort((at, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.held = [item[place < self.k], score[keep], at[keep], null[keep]]
        last = np.flatnonzero(place == self.k - 1)
        self.least[item[last]] = score[order[last]]


def term_lists(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, terms: an item's terms with repeats; rows alike count once, several texts of one id are one item."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_col).alias("item"), lower.alias("text")).distinct()
    return rows.groupBy("item").agg(F.flatten(F.sort_array(F.collect_list(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))))).alias("terms"))


def search(docs: DataFrame, items: list, scratch: Scratch, name: str, k: int, item_kind: str) -> DataFrame:
    """item, id, score of each task's best documents; items: (id, terms) of one slice; docs: id long, text."""
    terms = tuple(dict.fromkeys(t.encode() for _, found in items for t in found))
    number = {t: i for i, t in enumerate(terms)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_numpy(), 2 << 20):
                part = batch.slice(a, b - a)
                size, doc, term, count = scan(part.column(1).cast(pa.binary()).to_pylist(), terms)
                at = pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    scanned = scratch.save(docs.mapInArrow(read, "id long, n long, terms array<int>, counts array<long>"), name)
    n_docs, n_terms = scanned.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(terms), np.int64)
    for term, df in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the slice at most
        held[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)

    asked: list[dict[int, int]] = [{} for _ in terms]
    for i, (_, found) in enumerate(items):
        for t in found:
            of = asked[number[t.encode()]]
            of[i] = of.get(i, 0) + 1
    who = [(np.array([*x], np.int64), np.array([*x.values()], np.int64)) for x in asked]
    ids, n_items, arrow_kind = [i for i, _ in items], len(items), pa.string() if item_kind == "string" else pa.int64()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(n_items, k), max(1, CELLS // max(n_items, 1))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                n, lists, counts = part.column(1).to_numpy(), part.column(2), part.column(3)
                doc = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy())
                term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
                m = 75 + 25 * n * n_docs // max(n_terms, 1)
                worth = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                order = np.argsort(term, kind="stable")
                doc, term, worth = doc[order], term[order], worth[order]
                total = np.zeros((len(n), n_items), np.int64)
                edges = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else [], len(term)].astype(int)
                for s, e in zip(edges, edges[1:], strict=False):
                    item, times = who[term[s]]
                    total[np.ix_(doc[s:e], item)] += worth[s:e, None] * times  # a document has a term once
                null = part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.add(total, part.column(0).fill_null(0).to_numpy(), null)
        item, points, at, null = best.held
        names = pa.array([ids[i] for i in item.tolist()], arrow_kind)
        yield pa.RecordBatch.from_arrays([names, pa.array(at, mask=null.astype(bool)), pa.array(points)], names=["item", "id", "score"])

    return scanned.mapInArrow(score, f"item {item_kind}, id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, equal ones by smaller id.

    The item's id is a string or an integer (then a long in the result), the
    document's an integer. A null text has no terms; a null id of a document
    comes last among equal scores; documents with the same id are ranked each
    on its own. Items alike in id and text are one, several texts of one id
    too; a null item id is an id like others. Very long texts are scanned
    whole; an empty table on either side gives no rows; other columns are not
    read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical-search")
    kind = "string" if items.schema[item_col].dataType.simpleString() == "string" else "long"
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = scratch.save(term_lists(items.withColumn(item_col, F.col(item_col).cast(kind)), item_col, item_text), "items")
    size = lists.agg(F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / slice_bytes))
    found = None
    for i in range(parts):
        own = lists.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).orderBy("item").collect()  # about slice_bytes
        one = search(docs, [tuple(x) for x in own], scratch, f"scanned-{i}", k, kind)
        found = one if found is None else found.union(one)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
    return ranked.filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
