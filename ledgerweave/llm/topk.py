"""Exact top-k search by block-at-a-time pruning.

Vectors become integers and are laid out in blocks of similar ones, each with
the largest and smallest value of every term (dimension) and a forward index
(its matrix). A query's bound for a block is the sum over terms of the most
that the block can add. First only these summaries meet the queries: each
query's block with the highest bound is scored, which gives it a threshold
that holds for all data. Then the summaries tell which blocks can still reach
some query's threshold; those alone are sent, taken in the order of bounds,
and scored until no bound can reach the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch

BLOCK = "block long, dim int, wide boolean, ids binary, matrix binary, high binary, low binary"
#: No score that fits 64 bits has larger components than this.
LIMIT = float(1 << 62)
NONE = np.iinfo(np.int64).min


def blocks_of(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of (id, vector) in blocks of up to size, in the order of the partitions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                dim = int(lengths.max(initial=0))
                matrix = np.zeros((part.num_rows, dim))
                matrix[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
                matrix = np.clip(np.floor(256 * matrix), -LIMIT, LIMIT)
                wide = bool(np.abs(matrix).max(initial=0) >= 1 << 31)
                matrix = matrix.astype("<i8" if wide else "<i4")
                columns = {"block": [number], "dim": pa.array([dim], pa.int32()), "wide": [wide], "ids": [part.column(0).to_numpy().astype("<i8").tobytes()], "matrix": [matrix.tobytes()]}
                yield pa.RecordBatch.from_pydict(columns | {"high": [matrix.max(0).astype("<i8").tobytes()], "low": [matrix.min(0).astype("<i8").tobytes()]})
                number += 1

    return vectors.mapInArrow(build, BLOCK)


def unpack(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix (at least dim wide) of a block."""
    ids = np.frombuffer(row["ids"], "<i8")
    matrix = np.frombuffer(row["matrix"], "<i8" if row["wide"] else "<i4").reshape(len(ids), row["dim"])
    return ids, np.pad(matrix, ((0, 0), (0, max(0, dim - row["dim"]))))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact where they fit 64 bits; in doubles where these are exact."""
    most = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**52 else a.astype(np.int64) @ b.astype(np.int64).T


def bounds(query: np.ndarray, rows: list[dict]) -> np.ndarray:
    """For each query and block (with dim, high, low), no less than its highest score in the block; queries are as wide as the widest."""
    sides = [np.zeros((len(rows), query.shape[1])) for _ in range(2)]
    for i, r in enumerate(rows):
        for side, name in zip(sides, ("high", "low"), strict=True):
            side[i, : r["dim"]] = np.frombuffer(r[name], "<i8")
    q = query.astype(float)
    out = np.maximum(q, 0) @ sides[0].T + np.minimum(q, 0) @ sides[1].T
    return out + 1e-12 * (np.abs(q) @ np.maximum(np.abs(sides[0]), np.abs(sides[1])).T)  # what doubles may have lost


def search(query: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, rows: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best of at least worst among the blocks, leaving out its own id."""
    dim = max([query.shape[1], *[r["dim"] for r in rows]])
    query = np.pad(query, ((0, 0), (0, dim - query.shape[1])))
    bound = bounds(query, rows)
    order, worst = np.argsort(-bound, axis=1, kind="stable"), worst.copy()
    blocks: dict[int, tuple] = {}
    kept = [np.zeros(0, np.int64)] * 3
    for step in range(len(rows)):
        at = order[:, step]
        open_ = np.flatnonzero(bound[np.arange(len(query)), at] >= worst)
        if not len(open_):
            break  # bounds fall from step to step, so no later block can help either
        found = [kept]
        for b in np.unique(at[open_]):
            if b not in blocks:
                blocks[b] = unpack(rows[b], dim)
            ids, matrix = blocks[b]
            mine = open_[at[open_] == b]
            score = product(query[mine], matrix)
            r, c = np.nonzero((score >= worst[mine, None]) & (ids[None, :] != query_ids[mine, None]))
            found.append([mine[r], ids[c], score[r, c]])
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
        sort = np.lexsort((i, -s, q))
        q, i, s = q[sort], i[sort], s[sort]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = nth < k
        worst[q[nth == k - 1]] = s[nth == k - 1]
        kept = [q[keep], i[keep], s[keep]]
    return tuple(kept)


def queries_of(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, matrix and thresholds of a block of queries."""
    ids, matrix = unpack(row, dim)
    return ids, matrix, np.frombuffer(row["worst"], "<i8") if row.get("worst") else np.full(len(ids), NONE)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 512, shard: int = 64, slice_: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for each row of queries among vectors.

    Components are floor(256 * x); scores are exact where they fit 64 bits.
    Ties go to the smaller id; rows with the query's own id are left out. Rows
    with a null id or vector, or null or non-finite components, take no part;
    missing components at the end count as 0. Repeated rows of vectors each
    count, repeated rows of queries each get a result. Empty tables give no
    rows; other columns are not read. A task gets one slice of queries, and
    the summaries of 16 shards of blocks or the blocks of one.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    fine = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(fine)
    # Similar vectors lie together: those with the same largest term, by id, so that a common vector spreads over many blocks.
    ordered = lambda df: usable(df).withColumn("cell", F.coalesce(F.array_position("v", F.array_max("v")), F.lit(0))).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").select("id", "v")
    data = scratch.save(blocks_of(ordered(vectors), block), "blocks")
    asked = scratch.save(blocks_of(ordered(queries), slice_).withColumnRenamed("block", "slice").drop("high", "low"), "queries")
    n = data.count()
    groups, shards = max(1, math.ceil(n / (16 * shard))), max(1, math.ceil(n / shard))
    number = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts))
    spread = lambda df, name, parts: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # Slices are dealt to as many numbers by hash, so that the summaries know where to go.
    slices = max(1, asked.count())
    summaries = spread(data.select("block", "dim", "high", "low", number("block", groups).alias("group")), "part", slices)

    def meet(asked: DataFrame, how, schema: str) -> DataFrame:
        sent = spread(asked.withColumn("part", number("slice", slices)), "group", groups)
        return sent.groupBy("part", "group").cogroup(summaries.groupBy("part", "group")).applyInArrow(how, schema)

    def widest(rows: list[dict]) -> int:
        return max([r["dim"] for r in rows], default=0)

    def best_blocks(q: pa.Table, d: pa.Table) -> pa.Table:
        out, rows = {"slice": [], "row": [], "block": [], "bound": []}, d.to_pylist()
        for s in q.to_pylist() if rows else ():
            _, query, _ = queries_of(s, widest([s, *rows]))
            bound = bounds(query, rows)
            at = bound.argmax(1)
            for name, x in zip(out, (np.full(len(at), s["slice"]), np.arange(len(at)), np.array([r["block"] for r in rows])[at], bound[np.arange(len(at)), at]), strict=True):
                out[name].append(x)
        return pa.table({name: pa.array(np.concatenate(x) if x else [], pa.float64() if name == "bound" else pa.int64()) for name, x in out.items()})

    best = meet(asked, best_blocks, "slice long, row long, block long, bound double").groupBy("slice", "row").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    firsts = scratch.save(best.groupBy("slice", "block").agg(F.collect_list("row").alias("rows")), "firsts")

    def score(q: pa.Table, d: pa.Table) -> pa.Table:
        """The best of one slice in the blocks of one shard; where blocks come with rows, only these of the slice."""
        out, rows = {"slice": [], "row": [], "query_id": [], "vec_id": [], "score": []}, d.to_pylist()
        for s in q.to_pylist() if rows else ():
            ids, query, worst = queries_of(s, 0)
            for some, these in ([(r["rows"], [r]) for r in rows] if "rows" in rows[0] else [(slice(None), rows)]):
                own, found, points = search(query[some], ids[some], worst[some], these, k)
                real = np.arange(len(ids))[some]
                for name, x in zip(out, (np.full(len(own), s["slice"]), real[own], ids[some][own], found, points), strict=True):
                    out[name].append(x)
        return pa.table({name: pa.array(np.concatenate(x) if x else [], pa.int64()) for name, x in out.items()})

    def scored(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Queries against blocks by pairs of (slice, block): blocks go where they are wanted only."""
        pairs = pairs.withColumn("shard", number("block", shards))
        sent = asked.join(pairs.select("slice", F.col("shard").alias("piece")).distinct().hint("merge"), "slice")
        blocks = data.join(pairs.hint("merge"), "block")
        return sent.groupBy("slice", "piece").cogroup(blocks.groupBy("slice", "shard")).applyInArrow(score, "slice long, row long, query_id long, vec_id long, score long")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("slice", "row").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
    kth = scored(asked, firsts).groupBy("slice", "row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    worst = kth.groupBy("slice").agg(F.collect_list(F.struct("row", "score")).alias("known"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
                worst = np.full(len(ids) // 8, NONE, "<i8")
                for x in known or ():
                    worst[x["row"]] = x["score"]
                out.append(worst.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "worst"])

    known = scratch.save(asked.join(worst.hint("merge"), "slice", "left").mapInArrow(thresholds, "slice long, dim int, wide boolean, ids binary, matrix binary, worst binary"), "known")

    def needed(q: pa.Table, d: pa.Table) -> pa.Table:
        out, rows = {"slice": [], "block": []}, d.to_pylist()
        for s in q.to_pylist() if rows else ():
            _, query, worst = queries_of(s, widest([s, *rows]))
            at = np.flatnonzero((bounds(query, rows) >= worst[:, None]).any(0))
            out["slice"].append(np.full(len(at), s["slice"]))
            out["block"].append(np.array([r["block"] for r in rows])[at])
        return pa.table({name: pa.array(np.concatenate(x) if x else [], pa.int64()) for name, x in out.items()})

    pairs = scratch.save(meet(known, needed, "slice long, block long"), "pairs")
    found = ranked(scored(known, pairs))
    return found.select("query_id", "rank", "vec_id", "score")
