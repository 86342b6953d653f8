"""Which column is what, from the content of a cell table (file_id, sheet, row_no, col_no, value)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.functions.numbers import parse_amount
from ledgerweave.sources.stage import saved

TABLE = ["file_id", "sheet"]


def column_stats(cells: DataFrame) -> DataFrame:
    """TABLE, col_no and shares: filled, codes (dotted), deep (three segments), flat, amounts, words; distinct values."""
    v = F.trim("value")
    full = F.coalesce(v, F.lit("")) != ""
    share = lambda c: F.coalesce(F.avg(F.when(full, c.cast("int"))), F.lit(0.0))
    deep = v.rlike(r"^\d+(\.\d+){2,}$")
    letters = F.char_length(F.regexp_replace(v, r"\P{L}", "")) >= 2
    return cells.groupBy(*TABLE, "col_no").agg(
        F.avg(full.cast("int")).alias("filled"), share(codes.is_hierarchical(v)).alias("codes"), share(deep).alias("deep"), share(codes.is_flat_code(v)).alias("flat"),
        share(parse_amount(v).isNotNull() & ~v.rlike(r"\p{L}{2,}")).alias("amounts"), share(letters & ~codes.is_hierarchical(v)).alias("words"), F.count_distinct(F.when(full, v)).alias("distinct"), F.count_if(full).alias("n"),
    )


def roles(cells: DataFrame) -> DataFrame:
    """TABLE, code_col, description_col, balance_col: codes by share of deep or flat codes, descriptions by share of words, the last informative column of amounts."""
    s = column_stats(cells)
    informative = (F.col("filled") >= 0.2) & ((F.col("distinct") > 1) | (F.col("n") < 10))
    code = F.greatest("deep", "flat", F.col("codes") * 0.5)
    is_code = code >= 0.1
    best = lambda score, ok: F.max_by("col_no", F.when(ok, F.struct(score, -F.col("col_no"))))
    out = s.groupBy(*TABLE).agg(best(code, is_code & (F.col("words") < 0.5)).alias("code_col"), best(F.col("words"), (F.col("words") >= 0.5) & informative).alias("description_col"))
    balance = s.join(out, TABLE).filter(informative & (F.col("amounts") >= 0.7) & (F.col("deep") <= 0.3) & ~F.col("col_no").eqNullSafe(F.col("code_col"))).groupBy(*TABLE).agg(F.max("col_no").alias("balance_col"))
    return out.join(balance, TABLE, "left")


def looks_like_ledger(cells: DataFrame) -> DataFrame:
    """TABLE, ledger: some column has 30 % codes and some 50 % amounts."""
    return column_stats(cells).groupBy(*TABLE).agg((F.max(F.col("codes") >= 0.3) & F.max((F.col("amounts") >= 0.5) & (F.col("deep") <= 0.3))).alias("ledger"))


def unique_labels(header: DataFrame) -> DataFrame:
    """header (TABLE, col_no, label) with repeated labels numbered."""
    nth = F.row_number().over(Window.partitionBy(*TABLE, "label").orderBy("col_no")) - 1
    return header.withColumn("label", F.when(nth == 0, F.col("label")).otherwise(F.concat_ws(".", "label", nth)))


def compacted(cells: DataFrame) -> DataFrame:
    """Without blank cells, the others moved to the left."""
    full = cells.filter(F.trim("value") != "")
    return full.withColumn("col_no", (F.row_number().over(Window.partitionBy(*TABLE, "row_no").orderBy("col_no")) - 1).cast("int"))


def filled_down(cells: DataFrame) -> DataFrame:
    """Blank cells take the value above."""
    above = F.last(F.when(F.trim("value") != "", F.col("value")), ignorenulls=True).over(Window.partitionBy(*TABLE, "col_no").orderBy("row_no"))
    return cells.withColumn("value", above)


def records(cells: DataFrame) -> DataFrame:
    """TABLE, row_no, codigo, descricao, saldo: rows put together from the columns with these roles; a description is required."""
    r = cells.join(roles(cells), TABLE)
    pick = lambda c: F.max(F.when(F.col("col_no") == F.col(c), F.trim("value")))
    rows = r.groupBy(*TABLE, "row_no").agg(pick("code_col").alias("c"), pick("description_col").alias("d"), pick("balance_col").alias("s"))
    split = r"^(\d+(?:\.\d+)*)\s{2,}(.*)$"
    glued = F.col("d").rlike(split)
    code = F.coalesce(F.nullif("c", F.lit("")), F.when(glued, F.regexp_extract("d", split, 1)))
    return rows.filter(F.coalesce("d", F.lit("")) != "").select(*TABLE, "row_no", code.alias("codigo"), F.when(glued, F.regexp_extract("d", split, 2)).otherwise(F.col("d")).alias("descricao"), parse_amount(F.col("s")).alias("saldo"))


def flat_levels(rows: DataFrame, key: list[str], least_codes: int = 10, least_levels: int = 3, share: float = 0.9, least_each: int = 2) -> DataFrame:
    """key, levels: cumulative lengths of flat codes where 90 % of the longer ones find their beginning among the shorter, and the codes are no counter.

    A length that only one row has is no level.
    """
    flat = saved(rows.filter(F.col("codigo").rlike(r"^\d+$")).groupBy(*key, "codigo").agg(F.count(F.lit(1)).alias("times")).withColumn("len", F.char_length("codigo")), "flat")
    number = F.col("codigo").cast("decimal(38,0)")
    lengths = flat.groupBy(*key, "len").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min(number).alias("low"), F.max(number).alias("high"))
    spread = lengths.groupBy(*key).agg(F.sum("n").alias("n"), (F.sum("kinds") / (F.max("high") - F.min("low") + 1).cast("double")).alias("density"), F.array_sort(F.collect_list(F.when(F.col("n") >= least_each, F.col("len")))).alias("lengths"))
    spread = spread.filter((F.col("n") >= least_codes) & (F.size("lengths") >= least_levels) & ~(F.col("density") > 0.5))
    spread = saved(spread, "spread")  # a row a ledger
    child = flat.join(spread.select(*key, "lengths"), key).filter(F.array_contains("lengths", F.col("len"))).withColumn("shorter", F.explode(F.filter("lengths", lambda x: x < F.col("len"))))
    parent = flat.select(*key, F.col("codigo").alias("begin"), F.col("len").alias("shorter")).withColumn("have", F.lit(1))
    met = child.withColumn("begin", F.col("codigo").substr(F.lit(1), F.col("shorter"))).join(parent, [*key, "begin", "shorter"], "left")
    good = met.groupBy(*key, "len", "shorter").agg((F.sum(F.coalesce("have", F.lit(0)) * F.col("times")) / F.sum("times")).alias("s")).filter(F.col("s") >= share)
    nearest = good.groupBy(*key, "len").agg(F.max("shorter").alias("up"))
    # From the longest length upwards, in as many steps as there are lengths; the table has a row per length.
    chain = nearest.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("len", "up"))).alias("up")).join(spread.select(*key, "lengths"), key)
    further = lambda acc: F.try_element_at("up", F.element_at(acc, 1))
    walked = F.aggregate("lengths", F.slice("lengths", -1, 1), lambda acc, _: F.when(further(acc).isNotNull(), F.concat(F.array(further(acc)), acc)).otherwise(acc))
    return chain.select(*key, walked.alias("levels")).filter(F.size("levels") >= least_levels)


def pointed(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with flat codes dotted by their ledger's levels; a ledger in which two codes would become one keeps its own."""
    rows = saved(rows, "coded")  # read for the levels, for what the new codes would be, and for the result
    levels = saved(flat_levels(rows, key), "levels")  # a row a ledger
    dotted = F.when(F.col("codigo").rlike(r"^\d+$"), codes.dotted(F.col("codigo"), F.col("levels"))).otherwise(F.col("codigo"))
    kinds = rows.select(*key, "codigo").filter("codigo is not null").distinct().join(levels, key).groupBy(*key, dotted.alias("dotted")).agg(F.count(F.lit(1)).alias("n"))
    safe = saved(kinds.groupBy(*key).agg(F.max("n").alias("n")).filter("n = 1").select(*key).join(levels, key), "levels")
    new = F.when(F.col("levels").isNotNull(), dotted).otherwise(F.col("codigo"))
    return rows.join(safe, key, "left").withColumn("codigo_original", F.col("codigo")).withColumn("codigo", new).drop("levels")


def indented(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows whose flat, indented codes hang under the last dotted code before them."""
    dotted = F.trim("codigo").rlike(r"^\d+(\.\d+)+$")
    before = F.last(F.when(dotted, F.trim("codigo")), ignorenulls=True).over(Window.partitionBy(*key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1))
    hangs = F.col("codigo").rlike(r"^\s+\d+\s*$") & before.isNotNull()
    return rows.withColumn("codigo", F.when(hangs, F.concat_ws(".", before, F.trim("codigo"))).otherwise(F.trim("codigo")))


def numbered(depths: list[int], state: list[int]) -> tuple[list[str], list[int]]:
    """Outline numbers of rows of these depths after rows that left this stack of counts, and the stack that they leave."""
    out, stack = [], list(state)
    for d in depths:
        if len(stack) > d:
            del stack[d + 1 :]
            stack[d] += 1
        else:
            stack += [1] * (d + 1 - len(stack))  # a level that is left out counts as 1
        out.append(".".join(map(str, stack)))
    return out, stack


def after(state: list[int], part: dict) -> list[int]:
    """The stack that a part of a ledger leaves: it keeps what is above the part's least depth and adds up at it."""
    least, count, first, below = part["least"], part["count"], part["first"], part["below"]
    at = state[least] if len(state) > least else int(first > least)
    return state[:least] + [1] * (least - len(state)) + [at + count] + below


def outline(rows: DataFrame, key: list[str], part_rows: int = 100_000) -> DataFrame:
    """rows (with depth from 0) and codigo, their outline number: segment k counts rows of depth k since the last shallower one.

    A level that is left out counts as 1 below the row before. Parts of
    part_rows row numbers are summed up first: what a part does to the stack of
    counts is its least depth, the rows of that depth and the counts below the
    last of them, and these combine in order. So a ledger may span tasks, and
    the depth makes no difference to the plan.
    """
    cut = rows.withColumn("__part", F.floor(F.col("row_no") / part_rows))
    small = cut.select(*key, "__part", "row_no", "depth")

    def survey(part: pa.Table) -> pa.Table:
        depths = part.sort_by("row_no")["depth"].to_pylist()
        least = min(depths)
        last = len(depths) - 1 - depths[::-1].index(least)
        below = numbered([d - least - 1 for d in depths[last + 1 :]], [])[1]
        told = {"least": [least], "count": [depths.count(least)], "first": [depths[0]], "below": [below]}
        return pa.table({**{k: part[k].slice(0, 1) for k in (*key, "__part")}, **{k: pa.array(v, pa.list_(pa.int32()) if k == "below" else pa.int32()) for k, v in told.items()}})

    def states(parts: pa.Table) -> pa.Table:
        state: list[int] = []
        parts, before = parts.sort_by("__part"), []
        for part in parts.select(["least", "count", "first", "below"]).to_pylist():
            before.append(state)
            state = after(state, part)
        return parts.select([*key, "__part"]).append_column("__state", pa.array(before, pa.list_(pa.int32())))

    def number(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_no")
        return part.drop_columns(["__part", "__state"]).append_column("codigo", pa.array(numbered(part["depth"].to_pylist(), part["__state"][0].as_py())[0], pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema if f.name in (*key, "__part"))
    surveyed = small.groupBy(*key, "__part").applyInArrow(survey, f"{kinds}, least int, count int, first int, below array<int>")
    before = surveyed.groupBy(*key).applyInArrow(states, f"{kinds}, __state array<int>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut.join(before, [*key, "__part"]).select(*rows.columns, "__part", "__state").groupBy(*key, "__part").applyInArrow(number, f"{schema}, codigo string")


def find_column(header: DataFrame, patterns: list[str]) -> DataFrame:
    """TABLE, col_no of the header cell (TABLE, col_no, label) that fits: equal before part of, earlier patterns first."""
    tried = header.withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(patterns)])))
    label = F.lower(F.trim("label"))
    kind = F.when(label == F.col("p.x"), 0).when(F.contains(label, F.col("p.x")), 1)
    return tried.withColumn("kind", kind).filter("kind is not null").groupBy(*TABLE).agg(F.min_by("col_no", F.struct("kind", "p.i", "col_no")).alias("col_no"))


def without_rules(cells: DataFrame) -> DataFrame:
    """Rows that hold nothing but rules of _ or = go."""
    kept = cells.groupBy(*TABLE, "row_no").agg(F.max(~F.trim(F.coalesce("value", F.lit(""))).rlike("^[_=]*$")).alias("keep")).filter("keep")
    return cells.join(kept.drop("keep"), [*TABLE, "row_no"], "left_semi")


def header_candidates(cells: DataFrame, words: list[str], least: int = 2, first: int = 30) -> DataFrame:
    """TABLE, header: of the first rows the one with most header words, the earliest of equals."""
    low = F.lower(F.concat_ws(" ", F.collect_list("value")))
    rows = cells.filter(F.col("row_no") < first).groupBy(*TABLE, "row_no").agg(low.alias("text"))
    hits = rows.withColumn("hits", F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("text", w)))).filter(F.col("hits") >= least)
    return hits.groupBy(*TABLE).agg(F.max_by("row_no", F.struct("hits", -F.col("row_no"))).alias("header"))


def densest_rows(cells: DataFrame, first: int = 30) -> DataFrame:
    """TABLE, header: of the first rows the one with most cells that are not blank."""
    full = cells.filter((F.col("row_no") < first) & (F.trim("value") != "")).groupBy(*TABLE, "row_no").agg(F.count(F.lit(1)).alias("n"))
    return full.groupBy(*TABLE).agg(F.max_by("row_no", F.struct("n", -F.col("row_no"))).alias("header"))


def table_catalogue(rows: DataFrame, name: str | None = None) -> DataFrame:
    """TABLE, rows, has_tree, kind, chosen of records: the table of that name first, then one named balancete, one with a tree, and the longest."""
    named = F.when(F.lower("sheet") == (name or "").lower(), 2).when(F.lower("sheet").contains("balancete"), 1).otherwise(0)
    tree = F.max(F.col("codigo").rlike(r"^\d+(\.\d+)+$"))
    out = rows.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(tree, F.lit(False)).alias("has_tree"))
    kind = F.when(F.col("has_tree"), "ledger").when(F.lower("sheet").rlike("dre|balan[cç]o|demonstra"), "statement").otherwise("other")
    best = Window.partitionBy("file_id").orderBy(named.desc(), F.col("has_tree").desc(), F.col("rows").desc(), "sheet")
    return out.withColumn("kind", kind).withColumn("chosen", F.row_number().over(best) == 1)


def contract(rows: DataFrame) -> DataFrame:
    """rows with one set of names: creditos and debitos become credito and debito, classificacao a missing codigo, saldo_atual a missing saldo; nivel is filled and the code kept."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    out = rows.withColumns({"credito": first("credito", "creditos"), "debito": first("debito", "debitos"), "codigo_original": first("codigo"), "codigo": first("codigo", "classificacao"), "saldo": first("saldo_atual", "saldo", "saldo_anterior")})
    return out.withColumn("nivel", F.coalesce(first("nivel"), codes.level(F.col("codigo")))).drop("creditos", "debitos", "classificacao")


def ledger_type(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, type by the columns that a ledger fills: parent, subsidiary, movement (debits or credits), else single."""
    some = lambda *names: reduce(Column.__or__, [F.max(F.col(c).isNotNull()) for c in names if c in rows.columns], F.lit(False))
    kind = F.when(some("saldo_anterior_ctrl", "saldo_atual_ctrl"), "parent").when(some("saldo_anterior_controlada", "saldo_atual_controlada"), "subsidiary").when(some("credito", "debito"), "movement").otherwise("single")
    return rows.groupBy(*key).agg(kind.alias("type"))


def series(sources: DataFrame) -> DataFrame:
    """file_id, is_series of sources (file_id, period): all periods are known and distinct."""
    return sources.groupBy("file_id").agg(((F.count("period") == F.count(F.lit(1))) & (F.count_distinct("period") == F.count(F.lit(1)))).alias("is_series"))


def source_problems(sources: DataFrame, most: int = 5) -> DataFrame:
    """file_id, problem: repeated or missing periods, or too many of them."""
    n = sources.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("period").alias("known"), F.count_distinct("period").alias("kinds"))
    found = F.array_compact(F.array(F.when(F.col("kinds") < F.col("known"), "repeated period"), F.when(F.col("known") < F.col("n"), "missing period"), F.when(F.col("kinds") > most, "too many periods")))
    return n.select("file_id", F.explode(found).alias("problem"))


def fixed_widths(rows: DataFrame, key: list[str], least: float = 0.15, codes_: int = 10, segments: int = 5) -> DataFrame:
    """key, width: segments of a plan of fixed width with zero padding; null where there are few codes, few inner zeros or few segments."""
    c = F.col("codigo")
    found = rows.filter(codes.is_hierarchical(c)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(codes.has_inner_zero(c).cast("int")).alias("share"), F.max(codes.level(c)).alias("width"))
    return found.select(*key, F.when((F.col("n") >= codes_) & (F.col("share") >= least) & (F.col("width") >= segments), F.col("width")).alias("width"))


def canonical(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with codigo as the canonical key of their ledger's plan, and the code as it was in codigo_original."""
    joined = rows.join(fixed_widths(rows, key), key, "left")
    return joined.withColumn("codigo_original", F.col("codigo")).withColumn("codigo", codes.fixed_width_key(F.col("codigo"), F.col("width"))).drop("width")


def header_slices(cells: DataFrame, last: int = 15) -> DataFrame:
    """TABLE, header, row_no, col_no, value, label: for each of the first rows as header, the cells below it under its labels.

    Rows are numbered from 0; a header has at least two rows below it.
    """
    height = cells.groupBy(*TABLE).agg((F.max("row_no") + 1).alias("rows"))
    heads = cells.filter(F.col("row_no") <= last).select(*TABLE, F.col("row_no").alias("header"), "col_no", F.trim("value").alias("label"))
    return cells.join(heads.join(height, TABLE).filter("header < rows - 1").drop("rows"), [*TABLE, "col_no"]).filter("row_no > header")


#: Words of the labels of description and balance columns.
DESCRIPTION_WORDS = ["descri", "nome", "conta", "histor"]
BALANCE_WORDS = ["saldo atual", "saldo final", "saldo", "valor"]


def named_roles(cells: DataFrame, header: DataFrame) -> DataFrame:
    """TABLE, description_col, balance_col: those that the header (TABLE, col_no, label) names, if their content agrees; else by content alone.

    A named description column must not be codes for the most part, a named
    balance column has to read as amounts and not as codes.
    """
    label = F.lower(F.trim("label"))
    first = lambda words: F.coalesce(*[F.when(label.contains(w), i) for i, w in enumerate(words)])
    s = column_stats(cells).join(header.select(*TABLE, "col_no", first(DESCRIPTION_WORDS).alias("d"), first(BALANCE_WORDS).alias("b")), [*TABLE, "col_no"], "left")
    told = s.groupBy(*TABLE).agg(
        F.min_by("col_no", F.when(F.col("d").isNotNull() & (F.col("codes") <= 0.5), F.struct("d", "col_no"))).alias("named_description"),
        F.min_by("col_no", F.when(F.col("b").isNotNull() & (F.col("amounts") >= 0.5) & (F.col("codes") <= 0.5) & (F.col("deep") <= 0.3), F.struct("b", "col_no"))).alias("named_balance"),
    )
    return roles(cells).join(told, TABLE, "left").select(*TABLE, F.coalesce("named_description", "description_col").alias("description_col"), F.coalesce("named_balance", "balance_col").alias("balance_col"))


def trimmed(rows: DataFrame, key: list[str], least: int = 5, share: float = 0.8) -> DataFrame:
    """rows without zero segments at the end of their codes, in ledgers of which most codes have one number of segments and no two codes become one."""
    c = F.col("codigo")
    widths = rows.filter(codes.is_hierarchical(c)).select(*key, "codigo").distinct().groupBy(*key, codes.level(c).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    padded = widths.groupBy(*key).agg(F.sum("n").alias("all"), F.max("n").alias("most")).filter((F.col("all") >= least) & (F.col("most") >= share * F.col("all"))).select(*key)
    new = rows.join(padded.withColumn("__padded", F.lit(True)), key, "left").withColumn("__new", F.when(F.col("__padded"), codes.unpadded(c)).otherwise(c))
    safe = new.groupBy(*key).agg((F.count_distinct("codigo") == F.count_distinct("__new")).alias("__safe"))
    return new.join(safe, key).withColumn("codigo", F.when(F.col("__safe"), F.col("__new")).otherwise(c)).drop("__padded", "__new", "__safe")
