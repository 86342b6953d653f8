"""Near-duplicate lines by a segment-partition edit join.

A line within edit distance t of another holds one of the other's t + 1
segments unchanged, and close to its place. Each distinct line is indexed
under its segments, and probes, for each length that a shorter partner may
have, the substrings that such a partner's segments can be. An edit flips at
most two of the parities in which a line has each character, and four of those
of its pairs of characters; pairs of lines whose parities are further apart
never come out of the join. What is left is verified by banded bit-parallel
edit distance: a bit for each diagonal of the band, and a word for each number
of edits. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch
from ledgerweave.llm.components import components

#: Line numbers (16 bytes each) are broadcast up to this many; beyond, the join is by sort-merge.
BROADCAST_ROWS = 250_000


def probes(t: int) -> Iterator[tuple[int, int, int]]:
    """(how much shorter the partner is, segment, shift of its place) that have to be looked up."""
    for d in range(t + 1):
        for i in range(1, t + 2):
            for shift in range(max(1 - i, d - (t + 1 - i)), min(i - 1, d + t + 1 - i) + 1):
                yield d, i, shift


def keys(lines: DataFrame, t: int, probe: bool) -> DataFrame:
    """lid, key, own for each key under which a line is looked up, or indexed; own marks those under which it is indexed.

    Of t + 1 segments the last are longer by one where needed. The line is put
    into UTF-32, where a substring is found at once. The keys' places are
    rows of a generator rather than an array of expressions, so that the code
    for one key is small, and compiled.
    """
    places = [(d, i, shift) for d, i, shift in probes(t) if probe or d == shift == 0]
    rows = F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in places]))
    df = lines.select("lid", "length", F.encode("line", "UTF-32").alias("u")).select("lid", "length", "u", rows)
    df = df.withColumn("size", F.expr(f"CAST((length - d) DIV {t + 1} AS INT)")).withColumn("longer", F.expr(f"length - d - size * {t + 1}"))
    begin, size = f"(size * (i - 1) + greatest(0, i - {t + 2} + longer) + shift)", f"(size + CAST(longer >= {t + 2} - i AS INT))"
    return df.select("lid", F.expr(f"xxhash64(i, length - d, substring(u, 4 * {begin} + 1, 4 * {size}))").alias("key"), F.expr("d = 0 AND shift = 0").alias("own"))


def parities(lines: DataFrame) -> DataFrame:
    """lid, ones, twos: whether characters, and pairs of neighbours, that hash to each of 64 bits are odd in number."""
    places = lines.select("lid", F.encode("line", "UTF-32").alias("u")).select("lid", "u", F.explode(F.sequence(F.lit(0), F.expr("octet_length(u) DIV 4").cast("int"))).alias("i"))
    bit = lambda n: F.bit_xor(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(substring(u, 4 * i + 1, {4 * n})), 64) AS INT))"))
    return places.groupBy("lid").agg(bit(1).alias("ones"), bit(2).alias("twos"))


def can_be_near(a: str, b: str, t: int) -> Column:
    """Whether the parities of sides a and b allow for t edits."""
    return F.expr(f"bit_count(ones_{a} ^ ones_{b}) <= {2 * t} AND bit_count(twos_{a} ^ twos_{b}) <= {4 * t}")


def edit_distance(a: str, b: str, t: int, block: int = 32) -> Column:
    """Edit distance of two arrays of characters if it is at most t, else null.

    Word k of the state has bit d + t set when the first j + d characters of
    a and the first j of b are within k edits. Characters are taken in
    blocks; once no bit is left, later blocks are passed over.
    """
    mask = (1 << (2 * t + 1)) - 1
    start = ", ".join(f"{sum(1 << (d + t) for d in range(min(k, t) + 1))} AS r{k}" for k in range(t + 1))
    new = ["(x.s.r0 & x.m)"]
    for k in range(1, t + 1):
        new.append(f"(((x.s.r{k} & x.m) | x.s.r{k - 1} | shiftright(x.s.r{k - 1}, 1) | shiftleft({new[k - 1]}, 1)) & {mask})")
    fields = ", ".join(f"'r{k}', {e}" for k, e in enumerate(new))
    match = " | ".join(f"if(get({a}, j + {d - 1}) = get({b}, j - 1), {1 << (d + t)}, 0)" for d in range(-t, t + 1))
    advance = f"transform(array(named_struct('m', {match}, 's', s)), x -> named_struct({fields}))[0]"
    inside = f"aggregate(sequence({block} * i + 1, least(size({b}), {block} * i + {block})), o, (s, j) -> {advance})"
    blocks = f"if(size({b}) = 0, array(), sequence(0, CAST((size({b}) - 1) DIV {block} AS INT)))"
    state = f"aggregate({blocks}, struct({start}), (o, i) -> CASE WHEN o.r{t} = 0 THEN o ELSE {inside} END)"
    end = f"shiftleft(1, size({a}) - size({b}) + {t})"
    cases = " ".join(f"WHEN (z.r{k} & {end}) <> 0 THEN {k}" for k in range(t + 1))
    return F.expr(f"CASE WHEN abs(size({a}) - size({b})) <= {t} THEN transform(array({state}), z -> CASE {cases} END)[0] END")


def verified(pairs: DataFrame, texts: DataFrame, t: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) of lines that are within t edits, with their distance."""
    left, right = (texts.select(F.col("lid").alias(x), F.split("line", "").alias(f"c{x}")) for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return scratch.save(both.withColumn("distance", edit_distance("ca", "cb", t)).filter("distance is not null").select("a", "b", "distance"), f"{label}-links")


def similar_lines(lines: DataFrame, t: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the components of lines (lid, line, length) within t edits, and links (a, b, distance) that span them.

    Who looks up a key is first held against the first line indexed there.
    Only where that leaves several components under a key are their members
    held against each other, so a large group of similar lines is not paired
    up, and no link between components is lost.
    """
    index, probe = keys(lines, t, False), keys(lines, t, True).withColumnRenamed("lid", "other")
    first = index.groupBy("key").agg(F.min("lid").alias("lead"), F.max("lid").alias("last"))
    # A line looks up the keys that it is indexed under, too, so these rows have all members of a key but for a lone one, its lead.
    shared = scratch.save(probe.join(first.hint("merge"), "key").filter("other <> lead or other <> last").select("key", "other", "lead", "own"), "shared")
    wanted = scratch.save(shared.select(F.col("other").alias("lid")).unionByName(shared.select(F.col("lead").alias("lid"))).distinct(), "wanted")
    texts = scratch.save(lines.select("lid", "line").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge"), "lid"), "texts")
    marks = scratch.save(parities(texts), "marks")
    side = lambda x: marks.select(F.col("lid").alias(x), F.col("ones").alias(f"ones_{x}"), F.col("twos").alias(f"twos_{x}")).hint("merge")

    pair = [F.least("other", "lead").alias("a"), F.greatest("other", "lead").alias("b")]
    stars = scratch.save(shared.filter("other <> lead").select(*pair).distinct().join(side("a"), "a").join(side("b"), "b").filter(can_be_near("a", "b", t)).select("a", "b"), "stars")
    links = verified(stars, texts, t, scratch, "stars")
    parts = scratch.save(components(links, scratch, "first"), "first")

    members = shared.filter("own").select("key", F.col("other").alias("lead")).unionByName(shared.select("key", "lead")).distinct()
    rooted = lambda df, c: df.join(side(c), c).join(parts.hint("merge"), F.col(c) == F.col("node"), "left").select("key", c, f"ones_{c}", f"twos_{c}", F.coalesce("root", c).alias(f"root_{c}"))
    looked, members = scratch.save(rooted(shared.select("key", "other"), "other"), "looked"), scratch.save(rooted(members, "lead"), "members")
    roots = looked.select("key", F.col("root_other").alias("r")).unionByName(members.select("key", F.col("root_lead").alias("r")))
    open_ = roots.groupBy("key").agg(F.min("r").alias("low"), F.max("r").alias("high")).filter("low < high").select("key")
    cross = looked.join(open_.hint("merge"), "key").join(members.hint("merge"), "key").filter("root_other <> root_lead").filter(can_be_near("other", "lead", t)).select(*pair).distinct()
    more = verified(cross.join(stars.hint("merge"), ["a", "b"], "left_anti"), texts, t, scratch, "cross")
    links = links.unionByName(more)
    if not more.isEmpty():
        parts = scratch.save(components(links, scratch, "second"), "second")
    scratch.drop("shared", "wanted", "texts", "marks", "looked", "members")
    return parts, links


def line_dedup(docs: DataFrame, threshold: int = 2, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with two more columns: __removed, the numbers (from 0) of the lines to remove, and __near, how many of them have no exact twin before them.

    Lines part at newlines. Lines of at least least characters within
    threshold edits are linked (with least 0, all), shorter ones only when
    equal; of all lines that links join, directly or over others, the first
    stays, by id and line number. Blank lines stay. Null ids come last; rows
    with the same id and text are one document; null and empty texts have no
    lines to remove. Whole texts and lines of any length are read; an empty
    table gives no rows; other columns are kept, but none may be named
    __removed, __near, __id or __q.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("q"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    rows = rows.filter(r"line rlike '[^\\x20\\x09-\\x0D]'")
    name = [F.xxhash64("line").alias("h"), F.hash("line").alias("g")]
    # A place is one number, so that a hash aggregate can find the first.
    place = F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("no")
    lines = rows.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    lines = scratch.save(lines.select(F.monotonically_increasing_id().alias("lid"), "line", F.char_length("line").alias("length"), *name, "first", "n"), "lines")
    parts, _ = similar_lines(lines.filter(F.col("length") >= least), threshold, scratch)
    placed = lines.select("lid", "h", "g", "first", "n").join(parts.hint("merge"), F.col("lid") == F.col("node"), "left")
    placed = placed.filter("node is not null or n > 1").withColumn("root", F.coalesce("root", "lid"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("earliest"))
    known = scratch.save(placed.join(firsts.hint("merge"), "root").select("h", "g", "earliest", (F.col("first") == F.col("earliest")).alias("twin")), "known")
    gone = rows.select("id", "q", "no", *name).join(known.hint("merge"), ["h", "g"]).filter(place != F.col("earliest"))
    gone = scratch.save(gone.groupBy("id", "q").agg(F.collect_set("no").alias("__removed"), F.count_distinct(F.when(~F.col("twin"), F.col("no"))).alias("__near")), "gone")
    scratch.drop("lines", "known")
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), last), "__q": F.coalesce(F.xxhash64(text_col), F.lit(0))})
    joined = keyed.join(gone.withColumnsRenamed({"id": "__id", "q": "__q"}).hint("merge"), ["__id", "__q"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__removed", F.array().cast("array<int>")).alias("__removed"), F.coalesce("__near", F.lit(0)).cast("long").alias("__near"))


def kept_text(text_col: str) -> Column:
    """The text without the lines in __removed."""
    return F.when(F.size("__removed") == 0, F.col(text_col)).otherwise(F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> NOT array_contains(__removed, i)), '\\n')"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """A row per document: id, n_lines, n_removed, n_near (removed without an exact twin before), kept_sha256."""
    found = line_dedup(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **how)
    lines = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0))
    return found.select(id_col, F.when(F.col(text_col).isNull(), 0).otherwise(lines).cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.col("__near").alias("n_near"), F.sha2(F.coalesce(kept_text(text_col), F.lit("")), 256).alias("kept_sha256"))
