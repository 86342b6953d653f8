"""Ledgers printed as text: separators by vote, rows after a header marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import parse_amount

#: Separators in the order in which equals are preferred; what the last parts is two spaces or more.
SEPARATORS = ["tab", "pipe", "semicolon", "spaces"]
PATTERNS = {"tab": r"\t", "pipe": r"\|", "semicolon": ";", "spaces": r"\s{2,}"}


def separators(lines: DataFrame, first: int = 50) -> DataFrame:
    """file_id, separator: which of the first lines (file_id, row_no, line) have most of; of two spaces or more, lines are counted."""
    some = lines.filter(F.col("row_no") < first).filter(F.trim("line") != "")
    count = {"tab": F.sum(F.regexp_count("line", F.lit(r"\t"))), "pipe": F.sum(F.regexp_count("line", F.lit(r"\|"))), "semicolon": F.sum(F.regexp_count("line", F.lit(";"))), "spaces": F.count_if(F.contains("line", F.lit("  ")))}
    votes = F.array_max(F.array(*[F.struct(count[k].alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(SEPARATORS)]))["k"]
    found = some.groupBy("file_id").agg(votes.alias("separator"))
    return lines.select("file_id").distinct().join(found, "file_id", "left").withColumn("separator", F.coalesce("separator", F.lit("spaces")))


def fields(lines: DataFrame) -> DataFrame:
    """lines with separator and fields, trimmed; blank ones go."""
    joined = lines.join(separators(lines), "file_id")
    cut = F.lit(None).cast("array<string>")
    for k in SEPARATORS:
        cut = F.coalesce(cut, F.when(F.col("separator") == k, F.split("line", PATTERNS[k])))
    return joined.withColumn("fields", F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != ""))


def text_rows(lines: DataFrame, least: int = 3) -> DataFrame:
    """file_id, row_no, classificacao, tipo, codigo, descricao, saldo_anterior, debitos, creditos, saldo_atual.

    Rows count from the one after a line that says classif...; rules of - and
    = and lines of fewer than least fields go. The fields are class, type (A
    or T), code and name, and four amounts.
    """
    header = F.lower(F.array_join("fields", " ")).contains("classif")
    after = F.max(header.cast("int")).over(Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1))
    body = fields(lines).withColumn("after", after).filter((F.col("after") == 1) & ~F.trim("line").rlike(r"^[-=\s]*$") & (F.size("fields") >= least))
    # As a function of one name, the code of an amount stays small enough to be compiled.
    body = body.withColumn("amounts", F.transform(F.slice("fields", 4, 4), lambda c: parse_amount(c)))
    at = lambda i: F.try_element_at("fields", F.lit(i + 1))
    both = r"^(\S+)\s+(.*)$"
    paired = at(2).rlike(both)
    code = F.when(paired, F.regexp_extract(at(2), both, 1)).when(at(2).rlike(r"^\d+$"), at(2))
    name = F.when(paired, F.regexp_extract(at(2), both, 2)).otherwise(at(2))
    amount = lambda i: F.try_element_at("amounts", F.lit(i - 2))
    return body.select(
        "file_id", "row_no", F.when(F.contains(at(0), F.lit(".")) | at(0).rlike(r"^\d+$"), at(0)).alias("classificacao"), F.when(at(1).isin("A", "T"), at(1)).alias("tipo"),
        code.alias("codigo"), name.alias("descricao"), amount(3).alias("saldo_anterior"), amount(4).alias("debitos"), amount(5).alias("creditos"), amount(6).alias("saldo_atual"),
    )


def titled(column: Column, wanted: list[str]) -> Column:
    """Whether the words of a header line are all there."""
    return F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(F.transform(column, lambda x: F.lower(x)), w))


def simple_rows(lines: DataFrame) -> DataFrame:
    """file_id, row_no, codigo, descricao, saldo, natureza of files whose first line has codigo and descricao among its labels."""
    cut = fields(lines)
    heads = cut.filter((F.col("row_no") == 0) & titled(F.col("fields"), ["codigo", "descricao"])).select("file_id")
    at = lambda i: F.try_element_at("fields", F.lit(i + 1))
    return cut.join(heads, "file_id").filter((F.col("row_no") > 0) & (F.size("fields") >= 2)).select("file_id", "row_no", at(0).alias("codigo"), at(1).alias("descricao"), parse_amount(at(2)).alias("saldo"), at(3).alias("natureza"))
