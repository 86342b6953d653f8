"""Phrase collocation mining by a multikey three-way quicksort of suffix pointers.

1. Texts are cut into words, coded by a dictionary of their block. Blocks are
   written once; all that follows works on codes.
2. Words are counted over all blocks; the frequent ones get numbers, which the
   blocks take over for their own codes.
3. Each place at which two frequent words follow each other is a suffix of up
   to `longest` words. Suffixes go to routes by their two leading words, those
   of very frequent pairs by all their words (equal ones as one, with a count).
4. Each route sorts its suffixes. Partitions of equal words are the phrases,
   their sizes the counts; a partition that is too small is abandoned at once.
5. Parts, scores and phrases within longer ones are joins of the phrases found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch, slices
from ledgerweave.llm.words import U, mix

BLANK, BREAK = 32, 10
#: What a byte of a text is: A-Z in lower case, a blank between words, a break between pieces, or itself.
BYTES = np.array([b + 32 if 65 <= b <= 90 else BLANK if b in b" \t" else BREAK if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)], np.uint8)
#: Bytes of text in a block, about; suffixes in a route, about.
BLOCK, ROUTE = 4 << 20, 1 << 20
#: Pairs that may be called very frequent, at most.
HOT = 1 << 18


def coded(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a text, the code of each word, and whether it is the last of its piece."""
    plain = BYTES[np.frombuffer(data + b"\n", np.uint8)]
    full = (plain != BLANK) & (plain != BREAK)
    edge = np.diff(np.r_[False, full].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(plain[full])]).dictionary_encode()
    piece = np.cumsum(plain == BREAK)[start]
    return words.dictionary, words.indices.to_numpy(), np.diff(piece, append=-1) != 0


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as blocks; the last word of a piece has its code negated (~code)."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(1)).to_numpy(), BLOCK):
            part = batch.slice(a, b - a)
            langs = part.column(0).dictionary_encode()
            which, texts = langs.indices.to_numpy(), part.column(1).cast(pa.binary())
            order = np.argsort(which, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
                words, codes, last = coded(b"\n".join(texts.take(pa.array(own)).to_pylist()))
                counts = np.bincount(codes, minlength=len(words)).astype(np.int64)
                at = pa.array([0, len(words)], pa.int32())
                columns = [pa.array([task << 33 | n]), langs.dictionary.take(pa.array([which[own[0]]])), pa.array([len(codes)]), pa.ListArray.from_arrays(at, words.cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts)), pa.array([np.where(last, ~codes, codes).astype(np.int32).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "n", "words", "counts", "codes"])
                n += 1


def numbered(block: pa.Table, own: pa.Table) -> pa.Table:
    """A block, and the numbers of its frequent words by code: -1 for the other words."""
    if not block.num_rows:
        return pa.table({"codes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    codes = block["codes"][0].as_py()
    ids = np.full(block["size"][0].as_py(), -1, np.int64)
    ids[own["code"].to_numpy()] = own["id"].to_numpy()
    return pa.table({"codes": pa.array([codes], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary())})


def suffixes(codes: bytes, ids: bytes, longest: int) -> np.ndarray:
    """A row for each place where two frequent words follow each other: the words up to longest, -1 from where the piece or the frequent words end."""
    code = np.frombuffer(codes, np.int32)
    last = code < 0
    word = np.frombuffer(ids, np.int64)[np.where(last, ~code, code)]
    going = ~last[:-1] & (word[:-1] >= 0) & (word[1:] >= 0)
    start = np.flatnonzero(going)
    out = np.full((len(start), longest), -1, np.int64)
    out[:, 0] = word[start]
    alive = np.arange(len(start))
    for k in range(1, longest):
        out[alive, k] = word[start[alive] + k]
        at = start[alive] + k
        alive = alive[(at < len(going)) & going[np.minimum(at, len(going) - 1)]]
    return out


def pair_key(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(rows[:, 0].astype(U)) ^ (rows[:, 1].astype(U) * U(0x9E3779B97F4A7C15)))


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array."""
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys if len(of) else np.zeros(len(keys), bool)


def counted(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.flatnonzero(np.r_[[True] * (len(rows) > 0), (rows[1:] != rows[:-1]).any(axis=1)].astype(bool))
    return rows[new], np.add.reduceat(np.ones(len(rows), np.int64) if counts is None else counts[order], new) if len(new) else np.zeros(0, np.int64)


def multikey_sort(keys: np.ndarray, weight: np.ndarray, least: int, report: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and their counts, by a multikey three-way quicksort of pointers to the rows of keys; -1 ends a row.

    All partitions of a round are split at once, each by a pivot of its own
    into smaller, equal and larger. An equal partition is a phrase one word
    longer, reported where its count reaches report[its length]; partitions
    whose count is below `least` are abandoned.
    """
    depth_end, found, sizes_found = keys.shape[1], [], []
    order, sizes, depth = np.arange(len(keys)), np.array([len(keys)]), np.zeros(1, np.int64)
    state = np.random.default_rng(len(keys))
    while len(order):
        first = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        key = keys[order, depth[part]]
        pivot = key[first + (state.random(len(sizes)) * sizes).astype(np.int64)]
        side = (key >= pivot[part]).astype(np.int64) + (key > pivot[part])
        new = part * 3 + side
        count = np.bincount(new, minlength=3 * len(sizes))
        total = np.bincount(new, weight[order], 3 * len(sizes)).astype(np.int64)
        begin = np.cumsum(count) - count
        place = np.empty(len(order), np.int64)
        for s in range(3):
            of = np.flatnonzero(side == s)
            before = np.searchsorted(of, first)  # those of this side in earlier partitions
            place[of] = begin[new[of]] + np.arange(len(of)) - before[part[of]]
        moved = np.empty_like(order)
        moved[place] = order
        deeper = np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth))
        equal = np.tile([False, True, False], len(depth)) & (np.repeat(pivot, 3) >= 0)
        hit = np.flatnonzero(equal & (total >= report[deeper]))
        for d in np.unique(deeper[hit]):
            own = hit[deeper[hit] == d]
            rows = keys[moved[begin[own]]]
            rows[:, d:] = -1
            found.append(rows)
            sizes_found.append(total[own])
        unequal = np.tile([True, False, True], len(depth))
        live = (count > 0) & (total >= least) & (unequal | equal) & (deeper < depth_end)
        order = moved[np.repeat(live, count)]
        sizes, depth = count[live], deeper[live]
    return np.concatenate([*found, np.zeros((0, depth_end), np.int64)]), np.concatenate([*sizes_found, np.zeros(0, np.int64)])


def phrase_counts(docs: DataFrame, least: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For docs (lang, text): vocabulary (lang, word, id, f), sizes (lang, n), phrases (p: word ids, a).

    The vocabulary has the words that occur `least` times in a language, the
    phrases are those of 2 to longest words that do.
    """
    spark = docs.sparkSession
    blocks = scratch.save(docs.select("lang", "text").mapInArrow(encode, "block long, lang string, n long, words array<string>, counts array<long>, codes binary"), "blocks")
    entries = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", "e.words", "e.counts")
    vocabulary = entries.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    vocabulary = scratch.save(vocabulary.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    sizes = scratch.save(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")

    own = blocks.select("block", "lang", F.posexplode("words").alias("code", "word")).join(vocabulary.select("lang", "word", "id").hint("merge"), ["lang", "word"]).select("block", "code", "id")
    plain = blocks.select(F.col("block").alias("at"), F.size("words").alias("size"), "codes")
    ready = scratch.save(plain.groupBy("at").cogroup(own.groupBy("block")).applyInArrow(numbered, "codes binary, ids binary"), "ready")
    scratch.drop("blocks")

    # A route has some ROUTE suffixes, or fewer where that makes too few routes for the tasks. No pair of words has more
    # than `limit` in a route; a number is at least limit times below n, so both lists are bounded by HOT.
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    routes = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROUTE))
    limit = max(n // (4 * routes), n // HOT, 1)
    common = np.sort(np.array([r[0] for r in vocabulary.filter(F.col("f") >= limit).select("id").collect()], np.int64))

    def common_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, ids in zip(batch.column(0), batch.column(1), strict=True):
                rows = suffixes(codes.as_py(), ids.as_py(), 2)
                pairs, count = counted(rows[member(rows[:, 0], common) & member(rows[:, 1], common)])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(count)], names=["a", "b", "c"])

    pairs = ready.mapInArrow(common_pairs, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).filter(F.col("c") >= limit)
    hot = np.unique(pair_key(np.array([(r.a, r.b) for r in pairs.collect()], np.int64).reshape(-1, 2)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, ids in zip(batch.column(0), batch.column(1), strict=True):
                rows = suffixes(codes.as_py(), ids.as_py(), longest)
                key = pair_key(rows)
                special = member(key, hot)
                whole, count = counted(rows[special])
                far = pair_key(whole)
                for k in range(2, longest):
                    far = mix(far ^ whole[:, k].astype(U)) + U(k)
                key, rows = np.r_[key[~special], far], np.concatenate([rows[~special], whole])
                count = np.r_[np.ones(len(rows) - len(whole), np.int64), count]
                to = (key % U(routes)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                out: list[tuple] = []
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                    names, code = np.unique(rows[part], return_inverse=True)
                    width = np.uint16 if len(names) < 1 << 16 else np.int32
                    ones = count[part].max() == 1
                    out.append((int(to[part[0]]), names.tobytes(), code.astype(width).tobytes(), b"" if ones else count[part].tobytes()))
                columns = [*zip(*out, strict=True)] if out else [[]] * 4
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["route", "names", "codes", "counts"])

    def count(rows: pa.Table) -> pa.Table:
        keys, weights = [], []
        for names, codes, counts in zip(*(rows[c].to_pylist() for c in ("names", "codes", "counts")), strict=True):
            words = np.frombuffer(names, np.int64)
            own = words[np.frombuffer(codes, np.uint16 if len(words) < 1 << 16 else np.int32)].reshape(-1, longest)
            keys.append(own)
            weights.append(np.frombuffer(counts, np.int64) if counts else np.ones(len(own), np.int64))
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        special = member(pair_key(keys), hot)
        never = np.iinfo(np.int64).max
        lengths = np.arange(longest + 1)
        some = [multikey_sort(keys[~special], weights[~special], least, np.where(lengths < 2, never, least))]
        # What begins with a very frequent pair is in several routes: only whole suffixes can be judged here.
        some.append(multikey_sort(keys[special], weights[special], 1, np.where(lengths < 2, never, np.where(lengths < longest, 1, least))))
        phrase, total = (np.concatenate(x) for x in zip(*some, strict=True))
        return pa.table({**{f"w{k}": phrase[:, k] for k in range(longest)}, "a": total})

    columns = [f"w{k}" for k in range(longest)]
    routed = ready.mapInArrow(route, "route long, names binary, codes binary, counts binary")
    found = routed.groupBy("route").applyInArrow(count, ", ".join(f"{c} long" for c in [*columns, "a"]))
    found = found.groupBy(*columns).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    found = scratch.save(found.select(F.filter(F.array(*columns), lambda x: x >= 0).alias("p"), "a"), "phrases")
    scratch.drop("ready")
    return vocabulary, sizes, found


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases of 2 to longest words that occur `least` times.

    A phrase's score is 2000000 * a / (l + r), rounded down, for the cut into
    two parts that makes it lowest (the first such cut); l and r are how often
    the parts occur, a the phrase, n all words of the language. Phrases within
    a longer one that occurs in covered percent of the cases are left out.

    Words are parted by blanks and tabs, pieces by line breaks and .,;:!? and
    no phrase crosses a piece; A-Z count as a-z. A null language is `und`; a
    null text has no words; repeated rows count each; equal scores go by a,
    then by the phrase's bytes. Very long texts are read whole; an empty table
    gives no rows; other columns are not read.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    scratch = Scratch(docs.sparkSession, "collocations")
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary, sizes, found = phrase_counts(docs, least, longest, scratch)

    known = found.union(vocabulary.select(F.array("id"), "f"))
    cuts = found.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("p", 1, F.col("k"))).withColumn("right", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))
    cuts = cuts.join(known.toDF("left", "l"), "left").join(known.toDF("right", "r"), "right")
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.groupBy("p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))")
    longer = found.filter(F.size("p") > 2).select(F.explode(inner).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer"))
    best = best.join(longer, "p", "left").filter(F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * longer < CAST({covered} AS DECIMAL(3, 0)) * a"))

    spelt = best.select("p", F.posexplode("p").alias("i", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("p").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
    phrases = best.join(spelt.select("p", "lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase")), "p")
    order = F.desc("score"), F.desc("a"), "phrase"
    phrases = phrases.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    some = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
