"""Statements in page text: lines, noise, sections, classes, numbers. Pages are (doc_id, page_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import parse_statement_number, parse_token
from ledgerweave.functions.text import is_total_line

PAGE = ["doc_id", "page_no"]


def lines(pages: DataFrame) -> DataFrame:
    """PAGE, line_no (from 0, of all lines), line; blank lines go."""
    return pages.select(*PAGE, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")


def page_classes(pages: DataFrame, strong: dict[str, list[str]], normal: dict[str, list[str]], noise: list[str]) -> DataFrame:
    """PAGE, type, score: (3 strong + normal) / 20 patterns found, at most 1; noise over half is other, under 0.2 unknown."""
    low = F.lower("text")
    hits = lambda ps: F.size(F.filter(F.array(*map(F.lit, ps)), lambda p: F.regexp_like(low, p))) if ps else F.lit(0)
    scores = F.array(*[F.struct(F.least((3 * hits(strong[k]) + hits(normal.get(k, []))) / 20, F.lit(1.0)).alias("s"), F.lit(k).alias("k")) for k in sorted(strong)])
    best = F.array_max(scores)
    kind = F.when(F.least(hits(noise) / 5, F.lit(1.0)) > 0.5, "other").when(best["s"] < 0.2, "unknown").otherwise(best["k"])
    return pages.select(*PAGE, kind.alias("type"), best["s"].alias("score"))


def pages_of_type(classes: DataFrame, least: float = 0.2) -> DataFrame:
    return classes.filter((F.col("score") >= least) & ~F.col("type").isin("other", "unknown")).groupBy("doc_id", "type").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def unwrapped(table: DataFrame) -> DataFrame:
    """Lines joined to the next while neither has a digit and the first does not end in a colon."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    before = F.lag("line").over(w)
    starts = before.isNull() | F.col("line").rlike(r"\d") | before.rlike(r"\d") | before.endswith(":")
    grouped = table.withColumn("g", F.sum(starts.cast("int")).over(w))
    return grouped.groupBy(*PAGE, "g").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line")).drop("g")


def cleaned(table: DataFrame, noise: str, shortest: int = 3) -> DataFrame:
    """table with reason: short, noise (pattern) or duplicate in the page; NULL stays."""
    again = F.row_number().over(Window.partitionBy(*PAGE, F.lower("line")).orderBy("line_no")) > 1
    return table.withColumn("reason", F.when(F.char_length("line") < shortest, "short").when(F.lower("line").rlike(noise), "noise").when(again, "duplicate"))


def noise_score(table: DataFrame, noise: str) -> DataFrame:
    return cleaned(table, noise).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("lines"), F.count("reason").alias("removed"), F.round(F.avg(F.col("reason").isNotNull().cast("int")), 6).alias("score"))


def before_signature(table: DataFrame, signature: str) -> DataFrame:
    """Lines of a page before the first that matches signature."""
    seen = F.max(F.lower("line").rlike(signature).cast("int")).over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return table.withColumn("seen", seen).filter("seen = 0").drop("seen")


def repeated_lines(table: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, line, pages: lines on at least so many pages of a document."""
    return table.groupBy("doc_id", "line").agg(F.count_distinct("page_no").alias("pages")).filter(F.col("pages") >= least)


def without_repeated(table: DataFrame, least: int = 2) -> DataFrame:
    return table.join(repeated_lines(table, least).select("doc_id", "line"), ["doc_id", "line"], "left_anti").filter(~F.col("line").rlike(r"^(p[áa]g(ina)?\.?\s*)?\d{1,4}(\s*(/|de)\s*\d{1,4})?$"))


def sections(table: DataFrame, start: str, end: str) -> DataFrame:
    """Lines from one that matches start up to the next that matches end (without it)."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    low = F.lower("line")
    state = F.last(F.when(low.rlike(start), 1).when(low.rlike(end), 0), ignorenulls=True).over(w)
    return table.withColumn("open", state).filter("open = 1").drop("open")


def trailing_numbers(line: Column) -> Column:
    """The number texts at the end of a line, fragments joined."""
    joined = F.regexp_replace(line, r"(\d) (?=[.,]\d)", "$1")
    tail = F.regexp_extract(joined, r"((?:\s+\(?-?[\d.,]*\d\)?|\s+-)+)\s*$", 1)
    return F.filter(F.split(F.trim(tail), r"\s+"), lambda x: x != "")


def structured(table: DataFrame, unit: int = 1) -> DataFrame:
    """PAGE, line_no, description, current, previous: description and last two numbers of a line."""
    numbers = trailing_numbers(F.col("line"))
    description = F.trim(F.regexp_replace("line", r"((?:\s+\(?-?[\d.,]*\d\)?|\s+-)+)\s*$", ""))
    out = table.withColumn("numbers", numbers).filter(F.size("numbers") > 0)
    first = F.when(F.size("numbers") > 1, F.element_at("numbers", -2)).otherwise(F.element_at("numbers", -1))
    return out.select(*PAGE, "line_no", description.alias("description"), parse_statement_number(first, unit).alias("current"), F.when(F.size("numbers") > 1, parse_statement_number(F.element_at("numbers", -1), unit)).alias("previous"))


def block_totals(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """PAGE, block, parts, total, ok: rows between total lines against the total that ends them."""
    total = is_total_line(F.col("description"))
    block = F.coalesce(F.sum(total.cast("int")).over(Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("block", block).withColumn("is_total", total)
    out = marked.groupBy(*PAGE, "block").agg(F.sum(F.when(~F.col("is_total"), F.col("current"))).alias("parts"), F.max(F.when(F.col("is_total"), F.col("current"))).alias("total"))
    return out.withColumn("ok", F.abs(F.col("parts") - F.col("total")) <= tolerance)


def mentions(pages: DataFrame) -> DataFrame:
    """doc_id, years, tax_ids, currency: what the pages of a document name."""
    years = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d\d)\b"), 1)
    ids = F.regexp_extract_all("text", F.lit(r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"), 1)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    money = F.when(F.col("text").rlike(r"R\$"), "BRL").when(F.col("text").rlike(r"US\$"), "USD").when(F.col("text").contains("€"), "EUR")
    return pages.groupBy("doc_id").agg(merged(years).alias("years"), merged(ids).alias("tax_ids"), F.max(money).alias("currency"))


def text_share(pages: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, share of pages with text, kind: native, hybrid or scanned."""
    share = F.avg((F.char_length(F.trim(F.coalesce("text", F.lit("")))) > least).cast("int"))
    return pages.groupBy("doc_id").agg(share.alias("share")).withColumn("kind", F.when(F.col("share") >= 0.8, "native").when(F.col("share") > 0.1, "hybrid").otherwise("scanned"))


def balance_sections(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """rows with section: the last label (pattern to name) at or above."""
    hit = F.lit(None).cast("string")
    for pattern, name in reversed(labels.items()):
        hit = F.when(F.lower("description").rlike(pattern), name).otherwise(hit)
    return rows.withColumn("section", F.last(hit, ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("line_no")))


def account_lines(table: DataFrame) -> DataFrame:
    """PAGE, line_no, description, value: words up to the first real number (two decimals or thousands); note references before it go."""
    number = r"\(?-?(?:\d{1,3}(?:[.,]\d{3})+|\d+)[.,]\d{2}\)?|\(?-?\d{1,3}(?:\.\d{3})+\)?"
    value = F.regexp_extract("line", rf"(?:^|\s)({number})(?:\s|$)", 1)
    description = F.regexp_extract("line", rf"^(.*?)\s*(?:{number})(?:\s|$)", 1)
    return table.filter(value != "").select(*PAGE, "line_no", F.trim(F.regexp_replace(description, r"\s+\d{1,2}(\.\d)?$", "")).alias("description"), parse_token(value).alias("value")).filter("description <> ''")


def page_lines(words: DataFrame) -> DataFrame:
    """PAGE, line_no, side, line, two_columns of words (PAGE, text, x0, top, width): words of one height, in the order of x0.

    A page has two columns where three heights have words both left of 45 and
    right of 55 percent of its width; then each half of it (side 0 and 1) has
    lines of its own.
    """
    at = words.withColumn("line_no", F.bround(F.col("top") / 3).cast("int"))
    spread = at.groupBy(*PAGE, "line_no").agg((F.max(F.col("x0") < F.col("width") * 0.45) & F.max(F.col("x0") > F.col("width") * 0.55)).alias("both"))
    pages = spread.groupBy(*PAGE).agg((F.count_if("both") >= 3).alias("two_columns"))
    side = F.when(F.col("two_columns") & (F.col("x0") >= F.col("width") / 2), 1).otherwise(0)
    told = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return at.join(pages, PAGE).groupBy(*PAGE, "two_columns", "line_no", side.alias("side")).agg(F.array_join(F.transform(told, lambda x: x["text"]), " ").alias("line"))


def word_columns(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """PAGE, column_no (from 0), low, high: a page's columns, parted where no word is for more than gap points.

    words: PAGE, text, x0, x1, top. A sweep over the words by their left edges:
    a column begins where the word's edge lies beyond all right edges so far.
    """
    sweep = Window.partitionBy(*PAGE).orderBy("x0", "x1")
    reached = F.max("x1").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    new = (reached.isNull() | (F.col("x0") > reached + gap)).cast("int")
    marked = words.select(*PAGE, "x0", "x1", new.alias("new"))
    placed = marked.withColumn("column_no", F.sum("new").over(sweep.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return placed.groupBy(*PAGE, F.col("column_no").cast("int").alias("column_no")).agg(F.min("x0").alias("low"), F.max("x1").alias("high"))


def word_cells(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """PAGE, line_no, column_no, value: the words of each height in each of the page's columns, joined by blanks."""
    at = words.withColumn("line_no", F.bround(F.col("top") / 3).cast("int")).join(word_columns(words, gap), PAGE).filter((F.col("x0") >= F.col("low")) & (F.col("x1") <= F.col("high")))
    told = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return at.groupBy(*PAGE, "line_no", "column_no").agg(F.array_join(F.transform(told, lambda x: x["text"]), " ").alias("value"))


#: A number at the end of a line, and up to three more behind it.
NUMBERS = r"^(.*?)(-?\(?[0-9.,]+\)?(?:\s+-?\(?[0-9.,]+\)?){0,3})\s*$"


def row_tokens(line: Column) -> Column:
    """The cells of a line: parted by tabs or blanks in a row; where there is one only, its description and the numbers at its end.

    Blanks before a decimal or thousands mark go; of the numbers, those with a
    mark or two digits stay, if there are any.
    """
    text = F.trim(line)
    parts = F.filter(F.split(text, r"\s{2,}|\t+"), lambda x: x != "")
    tail = F.regexp_replace(F.regexp_extract(text, NUMBERS, 2), r"\s+(?=[.,])", "")
    tokens = F.filter(F.split(F.trim(tail), r"\s+"), lambda x: x.rlike("[0-9]"))
    clear = F.filter(tokens, lambda x: x.rlike("[.,]") | (F.char_length(F.regexp_replace(x, "[^0-9]", "")) >= 2))
    chosen = F.when(F.size(clear) > 0, clear).otherwise(tokens)
    description = F.trim(F.regexp_extract(text, NUMBERS, 1))
    cut = F.when(F.size(chosen) > 0, F.concat(F.when(description != "", F.array(description)).otherwise(F.array().cast("array<string>")), chosen)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 1, parts).otherwise(cut)


#: Words of the categories of an income statement, in the order in which they are tried.
INCOME = {"receita": ["receita", "revenue", "vendas", "faturamento"], "custo": ["custo", "cost", "cpv", "cmv"], "despesa": ["despesa", "expense"], "resultado": ["lucro", "prejuízo", "resultado", "profit", "loss"]}


def income_category(description: Column) -> Column:
    """receita, custo, despesa or resultado by the first category of which the description holds a word; else null."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), name) for name, words in INCOME.items() for w in words])


#: What a line with a company's name looks like, where a period is told, what tells a currency, and beginnings of words that tell a scale; each in the order in which they are tried.
COMPANY = [r"(?im)^([A-ZÀÂÃÁÉÊÍÓÔÕÚÇ\s\.]+(?:LTDA|S\.?A\.?|S/A)\.?)$", r"(?im)^([\p{L}\p{N}_\s\.]+(?:LTDA|S\.?A\.?|S/A))"]
PERIODS = [r"(?i)em\s+(\d{2}/\d{2}/\d{4})", r"(\d{2}/\d{2}/\d{4})", r"(?i)em\s+(\d{2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4})", r"(?i)exerc[íi]cio\s+de\s+(\d{4})", r"(?i)per[íi]odo\s+de\s+(\d{2}/\d{2}/\d{4})"]
CURRENCIES = {"BRL": r"(?i)\br\$|reais?\b", "USD": r"(?i)\busd|\$|d[óo]lar", "EUR": r"(?i)\beur|euro"}
SCALES = {"thousands": ["mil", "milhares"], "millions": ["milhões", "milhao"]}
UNITS = {"thousands": 1000, "millions": 1000000}


def first_that(tests: dict[str, Column]) -> Column:
    """The name of the first test that holds, else null."""
    return F.coalesce(*[F.when(test, name) for name, test in tests.items()])


def page_metadata(pages: DataFrame, lines: int = 10) -> DataFrame:
    """PAGE, company, period, currency, scale, unit: of the first lines the first one with a company's name; the first period by pattern; what the numbers are counted in."""
    text = F.coalesce("text", F.lit(""))
    told = lambda c, p: F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    names = F.array_compact(F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.coalesce(*[told(F.trim(x), p) for p in COMPANY])))
    scale = first_that({k: text.rlike(r"(?i)\b(" + "|".join(words) + ")") for k, words in SCALES.items()})
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), scale)
    currency = first_that({k: text.rlike(p) for k, p in CURRENCIES.items()})
    return pages.select(*PAGE, F.get(names, F.lit(0)).alias("company"), F.coalesce(*[told(text, p) for p in PERIODS]).alias("period"), currency.alias("currency"), scale.alias("scale"), unit.alias("unit"))


def document_report(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, pages by type, rows and totals found."""
    c = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("type").isin("other", "unknown")).alias("statement_pages"))
    r = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_total_line(F.col("description"))).alias("totals"))
    return c.join(r, "doc_id", "left").fillna(0, ["rows", "totals"])


def distinct_lines(rows: DataFrame) -> DataFrame:
    """rows (PAGE, line_no, description, value) of which each description, in lower case, and value stays once in a document: the first."""
    first = F.min(F.struct("page_no", "line_no", "description")).alias("f")
    return rows.groupBy("doc_id", F.lower("description").alias("__d"), "value").agg(first).select("doc_id", "f.page_no", "f.line_no", "f.description", "value")
