"""Statements in extracted tables and page text: entities, periods, columns, quality. Tables are cells (file_id, sheet, row_no, col_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import parse_amount
from ledgerweave.sources.layout import TABLE

DATE = r"\b(\d{2}/\d{2}/\d{4})\b"
#: Words of header rows, and labels of columns, in the order in which they are tried.
HEADER_WORDS = ["controladora", "consolidado", "consolidadas", "período", "periodo", "meses", "findos"]
LABELS = {
    "codigo": ["codigo", "código", "conta", "cod", "code"],
    "descricao": ["descricao", "descrição", "description", "nome", "name", "titulo"],
    "saldo": ["saldo", "valor", "value", "montante", "total"],
    "natureza": ["natureza", "tipo", "d/c", "dc"],
}
#: What tells a column of the current and of the previous period.
CURRENT = r"atual|corrente|current"
PREVIOUS = r"anterior|previous"


def some(low: Column, *words: str) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def windows(low: Column) -> Column:
    """9M and 3M, where a text in lower case names them."""
    return F.array_compact(F.array(F.when(some(low, "nove meses", "9 meses"), "9M"), F.when(some(low, "três meses", "tres meses", "3 meses"), "3M")))


def entities(low: Column) -> Column:
    return F.array_compact(F.array(F.when(some(low, "controladora"), "controladora"), F.when(some(low, "consolidad"), "consolidado")))


def gathered(c: str) -> Column:
    """All that the rows of a group name, each once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)


def table_headers(cells: DataFrame, first: int = 5) -> DataFrame:
    """TABLE, entities, periods, windows from header rows among the first rows."""
    pieces = F.array_sort(F.collect_list(F.struct("col_no", "value")))
    rows = cells.filter(F.col("row_no") < first).groupBy(*TABLE, "row_no").agg(F.lower(F.array_join(F.transform(pieces, lambda x: F.coalesce(x["value"], F.lit(""))), " ")).alias("low"))
    heads = rows.filter(some(F.col("low"), *HEADER_WORDS) | F.col("low").rlike(DATE))
    found = heads.select(*TABLE, entities(F.col("low")).alias("entities"), F.regexp_extract_all("low", F.lit(DATE), F.lit(1)).alias("periods"), windows(F.col("low")).alias("windows"))
    return found.groupBy(*TABLE).agg(*[gathered(c) for c in ("entities", "periods", "windows")])


def page_headers(pages: DataFrame, classes: DataFrame, balance: list[str], income: list[str]) -> DataFrame:
    """doc_id, entities (of statement pages), periods (of all pages) and windows (of income pages), for pages (doc_id, page_no, text) and their classes (doc_id, page_no, type)."""
    joined = pages.select("doc_id", "page_no", "text").join(classes.select("doc_id", "page_no", "type"), ["doc_id", "page_no"], "left").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    of = lambda kinds: F.coalesce(F.col("type").isin(kinds), F.lit(False))
    none = F.array().cast("array<string>")
    found = joined.select("doc_id", F.when(of(balance + income), entities(F.col("low"))).otherwise(none).alias("entities"), F.regexp_extract_all("low", F.lit(DATE), F.lit(1)).alias("periods"), F.when(of(income), windows(F.col("low"))).otherwise(none).alias("windows"))
    return found.groupBy("doc_id").agg(*[gathered(c) for c in ("entities", "periods", "windows")])


def header_kind(label: Column) -> Column:
    """codigo, descricao, saldo or natureza, by the first kind of which the label holds a word."""
    low, kind = F.lower(F.trim(label)), F.lit(None).cast("string")
    for name, words in LABELS.items():
        kind = F.coalesce(kind, F.when(some(low, *words), name))
    return kind


def columns_by_header(header: DataFrame) -> DataFrame:
    """TABLE, kind, col_no of header cells (TABLE, col_no, label): each kind's first column."""
    kinds = header.withColumn("kind", F.explode(F.array(*[F.when(some(F.lower(F.trim("label")), *words), name) for name, words in LABELS.items()]))).filter("kind is not null")
    return kinds.groupBy(*TABLE, "kind").agg(F.min("col_no").alias("col_no"))


def header_accounts(cells: DataFrame) -> DataFrame:
    """TABLE, row_no, codigo, descricao, saldo of rows below a header in row 0, by its labels; a row needs a code or a description."""
    places = columns_by_header(cells.filter("row_no = 0").withColumnRenamed("value", "label"))
    rows = cells.filter("row_no > 0").join(places, [*TABLE, "col_no"]).groupBy(*TABLE, "row_no").agg(*[F.max(F.when(F.col("kind") == k, F.nullif(F.trim("value"), F.lit("")))).alias(k) for k in ("codigo", "descricao", "saldo")])
    return rows.filter("codigo is not null or descricao is not null").withColumn("saldo", parse_amount(F.col("saldo")))


def value_columns(header: DataFrame) -> DataFrame:
    """TABLE, current_col, previous_col of header cells: dated columns by date, latest first; then those that say current or previous."""
    low = F.lower("label")
    date = F.to_date(F.nullif(F.regexp_extract("label", DATE, 1), F.lit("")), "dd/MM/yyyy")
    marked = header.select(*TABLE, "col_no", date.alias("date"), low.rlike(CURRENT).alias("now"), low.rlike(PREVIOUS).alias("before"))
    dated = F.array_sort(F.collect_list(F.when(F.col("date").isNotNull(), F.struct((-F.unix_date("date")).alias("d"), "col_no"))))
    found = marked.groupBy(*TABLE).agg(dated.alias("dated"), F.min(F.when(F.col("now"), F.col("col_no"))).alias("now"), F.min(F.when(F.col("before"), F.col("col_no"))).alias("before"))
    return found.select(*TABLE, F.coalesce(F.get("dated", F.lit(0))["col_no"], "now").alias("current_col"), F.coalesce(F.get("dated", F.lit(1))["col_no"], "before").alias("previous_col"))


def quality(rows: DataFrame) -> DataFrame:
    """doc_id, statement, accounts, valued of extracted rows (doc_id, statement, current, previous): how many, and how many with a value."""
    return rows.groupBy("doc_id", "statement").agg(F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("current").isNotNull() | F.col("previous").isNotNull()).alias("valued"))
