"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets form a class. A class has the minima of its
set under many hash functions: bands of full minima give candidate pairs. The
low bits of the minima of another hash, one for each of BINS ranges of it, are
packed in bit planes; bit counts estimate each candidate's similarity from
them, corrected for chance agreement. What is left is confirmed on the full
sets.

Buckets of many classes are not paired up. Near copies of one text hardly
differ from it, and two of them that are not both linked to it are linked only
if they share about half of these differences, so candidates are looked up by
their rarest differences (see by_differences).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import WORD, Scratch, slices
from ledgerweave.llm.components import components
from ledgerweave.llm.words import U, mix, shingle_hashes, word_hashes

#: 32 bands of 5 minima find a pair of similarity 0.8 but for 3 in a million.
BANDS, ROWS = 32, 5
#: Minima that take part in the estimate, one for each range of the hash, and bits kept of each.
BINS, BITS = 512, 4
#: Buckets of more classes are searched by differences, not pair by pair.
DIRECT = 64
#: Grades of difference from a leader: so many for those that are linked to it, and as most in all.
GRADES, MOST_GRADES = 4, 16
#: An estimate may lie so many standard deviations below the threshold.
DEVIATIONS = 6

SIGNED = "n_shingles long, h1 long, h2 long, planes array<long>, bands array<long>"


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only."""
    with np.errstate(over="ignore"):
        return tuple(mix(shingles ^ U(salt)).sum(dtype=U).astype(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def minima(shingles: np.ndarray, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """For each run of shingles (none is empty) the minima under BANDS * ROWS hash functions."""
    k = BANDS * ROWS
    a = (mix(np.arange(1, k + 1, dtype=U)) | U(1)).astype(np.uint32)
    b = mix(np.arange(1001, k + 1001, dtype=U)).astype(np.uint32)
    low = (shingles >> U(32)).astype(np.uint32)
    out = np.full((len(at) - 1, k), np.uint32(0xFFFFFFFF))
    # Long runs are taken in parts, so that no array grows with the longest text.
    for s in range(0, len(low), step):
        e = min(s + step, len(low))
        first, last = np.searchsorted(at, s, "right") - 1, np.searchsorted(at, e, "left")
        starts = np.maximum(at[first:last], s) - s
        for i in range(k):
            out[first:last, i] = np.minimum(out[first:last, i], np.minimum.reduceat(low[s:e] * a[i] + b[i], starts))
    return out


def bit_planes(sets: list[np.ndarray]) -> np.ndarray:
    """For each sorted set: low bits of the least hash in each range, a plane per bit, then a plane of the ranges that have one."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = (flat >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])][: len(flat)]
    bits = np.zeros((len(sets), BITS + 1, BINS), np.uint8)
    for k in range(BITS):
        bits[row[first], k, place[first]] = flat[first] >> U(k) & U(1)
    bits[row[first], BITS, place[first]] = 1
    return np.packbits(bits, axis=2).view(">u8").astype(np.int64).reshape(len(sets), -1)


def band_keys(m: np.ndarray) -> np.ndarray:
    h = np.tile(np.arange(BANDS, dtype=U), (len(m), 1))
    for j in range(ROWS):
        h = mix(h ^ m[:, j::ROWS].astype(U)) + U(j)
    return h.astype(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, q, n_shingles, name of the set (h1, h2), planes and bands of each document (id, q, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    width = (BITS + 1) * BINS // 64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in slices(pc.binary_length(batch.column(2)).to_numpy(), 4 << 20):
                part = batch.slice(s, e - s)
                words, at = word_hashes(part.column(2), lower=True)
                sets = [np.unique(shingle_hashes(words[i:j], size)) for i, j in zip(at, at[1:], strict=False)]
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                names = np.array([set_name(x) if len(x) else (0, 0) for x in sets], np.int64).reshape(-1, 2)
                planes, bands = np.zeros((len(n), width), np.int64), np.zeros((len(n), BANDS), np.int64)
                if len(full):
                    planes[full], bands[full] = bit_planes([sets[i] for i in full]), band_keys(minima(np.concatenate(sets), np.r_[0, np.cumsum(n[full])]))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (planes, bands)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]), *lists], names=["id", "q", "n_shingles", "h1", "h2", "planes", "bands"])

    return docs.mapInArrow(sign, f"id {kind}, q long, {SIGNED}")


def flat(classes: DataFrame, side: str, *others: str) -> DataFrame:
    """classes as one side of a join of pairs: class as side, size as n side, and planes as columns, which are quicker than arrays."""
    words = (BITS + 1) * BINS // 64
    return classes.select(F.col("class").alias(side), F.col("n_shingles").alias(f"n{side}"), *[F.col(c).alias(f"{c}_{side}") for c in others], *[F.coalesce(F.get("planes", F.lit(i)), F.lit(0).cast("long")).alias(f"{side}{i}") for i in range(words)])


def alike(percent: int):
    """Whether flat sides a and b can have percent of their union in common: by size, and by the estimate from their low bits.

    Its variance has a part for each hash that shares a range with another,
    and one for bits that agree by chance, which is subtracted on average.
    """
    each, known, chance, p = BINS // 64, BITS * BINS // 64, 2.0**-BITS, percent / 100
    filled = " + ".join(f"bit_count(a{known + i} | b{known + i})" for i in range(each))
    differ = " + ".join("bit_count(" + " | ".join(f"(a{k * each + i} ^ b{k * each + i})" for k in range(BITS + 1)) + ")" for i in range(each))
    chance_part = (1 - p) * chance / (1 - chance)
    margin = f"{DEVIATIONS} * sqrt(({p * (1 - p)} * least(1.0D, greatest(na, nb) / {BINS}.0D) + {chance_part}) / ({filled}))"
    estimate = f"1 - ({differ}) / CAST(({filled}) AS DOUBLE) / {1 - chance}"
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {estimate} >= {p} - {margin}")


def with_texts(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """a, b, ta, tb: saved pairs of classes and a text of each, fetched by document id and hash of the text."""
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct().join(classes.select("class", F.col("id").alias("id_"), F.col("q").alias("q_")).hint("merge"), "class")
    fetched = docs.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("q") == F.col("q_"))).groupBy("class").agg(F.first("text").alias("text"))
    texts = scratch.save(fetched, f"{label}-texts")
    left, right = (texts.select(F.col("class").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")


def pairs_of_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Parts of batches of a, b, ta, tb, and for each of their rows the two sorted sets."""
    sets: dict[int, np.ndarray] = {}  # of the classes met lately: the first of a group meets many
    for batch in batches:
        for s, e in slices(pc.binary_length(batch.column(2)).to_numpy() + pc.binary_length(batch.column(3)).to_numpy(), 2 << 20):
            part = batch.slice(s, e - s)
            if sum(map(len, sets.values())) > 1 << 20:
                sets.clear()
            number = [part.column(i).to_pylist() for i in (0, 1)]
            for ids, column in zip(number, (2, 3), strict=True):
                new = {c: i for i, c in enumerate(ids) if c not in sets}
                if new:
                    words, at = word_hashes(part.column(column).take(pa.array(list(new.values()))), lower=True)
                    sets |= {c: np.unique(shingle_hashes(words[i:j], size)) for c, i, j in zip(new, at, at[1:], strict=False)}
            yield part, [(sets[a], sets[b]) for a, b in zip(*number, strict=True)]


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have at least percent in common."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in pairs_of_sets(batches, size):
            keep = []
            for a, b in sets:
                n = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * n >= percent * (len(a) + len(b) - n))
            yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = with_texts(scratch.save(pairs, f"{label}-pairs"), classes, docs, scratch, label)
    return scratch.save(joined.mapInArrow(common, "a long, b long"), f"{label}-links")


def by_differences(pool: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of a leader's classes that can be linked; pool is saved and has leader a, class b, root of b.

    Let r and s be how many shingles of the leader's n two classes lack, x and
    y their own sizes, and o the differences from the leader (lacking and
    added ones) that both have. They have n - r - s + o shingles in common,
    so they are linked if and only if
    (100 + percent) * (n + o) >= v + w, where v = percent * x + (100 + percent) * r
    and w is likewise of the other. A class is linked to the leader if v is
    at most 100 * n. Pairs of which both are need no test, as they have one
    root; in all others the differences in common must be more than 4 in 9
    (at 80 percent) of those of any class that is linked to the leader.
    Differences are ordered, the rarest first; two classes with enough in
    common share one early enough in both orders. How many must be shared is
    bounded by the grade (range of v) of the partner.
    """
    whole = 100 + percent

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in pairs_of_sets(batches, size):
            lacking = pa.array([len(np.setdiff1d(a, b, assume_unique=True)) for a, b in sets], pa.int64())
            sizes = [pa.array([len(x) for x in side], pa.int64()) for side in zip(*sets, strict=True)]
            different = pa.array([np.setxor1d(a, b, assume_unique=True).view(np.int64) for a, b in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sizes, lacking, different], names=["a", "b", "n", "x", "r", "d"])

    found = with_texts(pool.select("a", "b"), classes, docs, scratch, "pool").mapInArrow(differ, "a long, b long, n long, x long, r long, d array<long>")
    found = found.withColumn("v", F.expr(f"{percent} * x + {whole} * r")).withColumn("far", F.expr("v > 100 * n"))
    grade = F.expr(f"CAST(least({MOST_GRADES - 1}, {GRADES} * (v - {percent} * n) DIV ({100 - percent} * n + 1)) AS INT)")
    found = scratch.save(found.join(pool.hint("merge"), ["a", "b"]).select("a", "b", "root", "n", "v", "far", grade.alias("grade"), "d"), "differences")

    # Only differences that a far class has, and a class of another root, can be shared by a pair.
    each = scratch.save(found.select("a", "b", "root", "far", F.explode("d").alias("e")), "each")
    known = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("far").alias("far")).filter("far AND low < high").select("a", "e", "f")
    ordered = each.select("a", "b", "e").join(known.hint("merge"), ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("d"))
    ordered = found.drop("d").join(ordered.hint("merge"), ["a", "b"]).withColumn("u", F.size("d"))

    partners = found.groupBy("a", F.col("grade").alias("other")).agg(F.min("v").alias("w"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("far").alias("some_far"))
    met = ordered.join(partners.hint("merge"), "a").filter("(far OR some_far) AND (root <> low OR root <> high)")
    met = met.withColumn("early", F.expr(f"CAST(u - greatest(1, ceil((v + w - {whole} * n) / {whole})) + 1 AS INT)")).filter("early > 0")
    token = met.select("a", "b", "root", "n", "v", "u", F.least("grade", "other").alias("g"), F.greatest("grade", "other").alias("h"), (F.col("grade") <= F.col("other")).alias("first"), (F.col("grade") >= F.col("other")).alias("second"), F.posexplode(F.slice("d", F.lit(1), F.col("early"))).alias("at", "token"))
    token = scratch.save(token.select("a", "b", "root", "n", "v", "g", "h", "first", "second", F.col("token.e").alias("e"), (F.col("u") - F.col("at")).alias("left")), "tokens")
    key = ["a", "g", "h", "e"]
    x = token.filter("first").select(*key, "n", F.col("b").alias("x"), F.col("root").alias("rx"), F.col("v").alias("vx"), F.col("left").alias("lx"))
    y = token.filter("second").select(*[F.col(c).alias(f"{c}_") for c in key], F.col("b").alias("y"), F.col("root").alias("ry"), F.col("v").alias("vy"), F.col("left").alias("ly"))
    same = [F.col(c) == F.col(f"{c}_") for c in key]
    enough = F.expr(f"rx <> ry AND (g < h OR x < y) AND (vx > 100 * n OR vy > 100 * n) AND {whole} * (n + least(lx, ly)) >= vx + vy")
    pairs = x.join(y.hint("merge"), same[0] & same[1] & same[2] & same[3] & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, q (hash of the text), n_shingles, root (number of the group; null for an empty set), component_id."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("q"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = scratch.save(signatures(docs, size), "signed")
    name = ["n_shingles", "h1", "h2"]
    classes = signed.filter("n_shingles > 0").groupBy(*name, "planes", "bands").agg(F.min("id").alias("id"), F.coalesce(F.min_by("q", "id"), F.min("q")).alias("q"))
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    # Every member of a bucket is held against its leader: the one that meets most others in all its buckets, then the first.
    banded = classes.select("class", F.explode("bands").alias("key"))
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.save(banded.join(counts.hint("merge"), "key"), "met")
    central = met.join(met.groupBy("class").agg(F.sum("n").alias("meets")).hint("merge"), "class")
    leaders = central.groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("meets"), "class")).alias("leader")).select("key", F.col("leader.class").alias("a"))
    shared = scratch.save(met.join(leaders.hint("merge"), "key"), "buckets")
    scratch.drop("met")
    stars = scratch.save(shared.filter("class <> a").select("a", F.col("class").alias("b")).distinct(), "stars")
    likely = stars.join(flat(classes, "a").hint("merge"), "a").join(flat(classes, "b").hint("merge"), "b").filter(alike(percent)).select("a", "b")
    links = confirmed(likely, classes, docs, size, percent, scratch, "stars")
    parts = scratch.save(components(links, scratch, "first"), "parts")

    # Members that the leader does not tie together are held against each other, in the first bucket that they share;
    # within a component no pair is needed.
    placed = shared.filter(F.col("n") <= DIRECT).select("key", "class").join(parts.hint("merge"), F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rest = placed.join(open_.hint("merge"), "key").join(classes.select("class", "n_shingles", "planes", "bands").hint("merge"), "class")
    a, b = (flat(rest, x, "key", "root", "bands") for x in "ab")
    once = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == F.col("key_a")
    cross = a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & alike(percent) & once).select("a", "b")

    # In buckets of many members all that have the same leader are searched at once, by their differences from it. Two that
    # have the same home, the leader of their largest bucket, meet there; so a leader all of whose others have one other home is left out.
    large = shared.filter(F.col("n") > DIRECT)
    home = large.groupBy("class").agg(F.max(F.struct("n", "a")).alias("home")).select("class", F.col("home.a").alias("home"))
    pool = large.filter(F.col("class") != F.col("a")).select("a", "class").distinct().join(home.hint("merge"), "class").join(parts.hint("merge"), F.col("class") == F.col("node"), "left")
    pool = pool.select("a", F.col("class").alias("b"), F.coalesce("root", "class").alias("root"), "home")
    several = pool.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("home").alias("first"), F.max("home").alias("last"))
    several = several.filter("low < high AND (first < last OR last = a)").select("a")
    pool = scratch.save(pool.drop("home").join(several.hint("merge"), "a"), "pool")
    if not pool.isEmpty():
        cross = cross.unionByName(by_differences(pool, classes, docs, size, percent, scratch)).distinct()
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = confirmed(cross.join(tested.hint("merge"), ["a", "b"], "left_anti"), classes, docs, size, percent, scratch, "cross")
    scratch.drop("buckets", "stars", "stars-texts", "stars-pairs", "cross-texts", "cross-pairs", "pool", "pool-texts", "differences", "each", "tokens")
    if not more.isEmpty():
        parts = scratch.save(components(links.unionByName(more), scratch, "second"), "all-parts")

    rooted = classes.select(*name, "id", "class").join(parts.hint("merge"), F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select(*name, "root", "component_id")
    found = signed.filter("n_shingles > 0").select("id", "q", *name).join(named.hint("merge"), name)
    empty = signed.filter("n_shingles = 0").select("id", "q", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return found.select(*empty.columns).unionByName(empty)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept.

    A set holds the distinct runs of size words, with A-Z in lower case; of a
    shorter text, the whole sequence. Links join sets that have at least
    percent of their union in common. component_id is the smallest id that
    can be reached by links, a document's own included; null ids count only
    where a group has no other. Null and wordless texts have an empty set and
    stay alone. Very long texts are read whole. Repeated rows each get a row,
    and all with the smallest id are kept; an empty table gives no rows;
    other columns are not read.
    """
    out = grouped(docs, size, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id (a null one only if there is no other), then hash of the text.

    Of rows with this id and text, the least in its other columns stays.
    Rows without a word are in no group, and all stay. An empty table gives
    no rows; all columns are kept.
    """
    out = grouped(docs.select(id_col, text_col), size, percent, id_col, text_col)
    chosen = out.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "q")).alias("least")).select(F.col("least.id").alias("__id"), F.col("least.q").alias("__q"))
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = docs.filter(worded).withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__row", F.col(id_col).alias("__own"), F.xxhash64(text_col).alias("__key"))
    kept = rows.join(chosen.distinct().hint("merge"), F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__q")))
    return kept.groupBy("__own", "__key").agg(F.min("__row").alias("r")).select("r.*").unionByName(docs.filter(~worded))
