"""The chart of accounts: building, reading, counting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import codes


#: Names of a chart's columns, without accents, first one first.
ALIASES = {
    "codigo": ["codigo", "cod", "conta", "code", "account_code"], "descricao": ["descricao", "descr", "desc", "description", "account_desc"], "tipo": ["tipo", "type", "account_type"], "natureza": ["natureza", "nature", "natu"],
    "nivel": ["nivel", "level"], "parent_id": ["parent", "parent_id", "conta_superior", "superior", "pai"], "formula": ["formula", "form"], "formato": ["formato", "format"],
    "tipo_do_lancamento": ["tipo lanc", "tipo de lancamento", "tipo_lanc"], "relacao": ["relacionamento", "relac"],
}


def column_map(columns: list[str]) -> dict[str, str]:
    """Field to column; where neither code nor description is named, the first two columns are these."""
    plain = {" ".join("".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).split()): c for c in columns}
    out = {field: plain[next(n for n in names if n in plain)] for field, names in ALIASES.items() if any(n in plain for n in names)}
    return out if "codigo" in out or "descricao" in out else out | dict(zip(("codigo", "descricao"), columns, strict=False))


def parent_of(code: Column) -> Column:
    """The code without its last part; without dots, less one digit of two or two of more."""
    size = F.char_length(code)
    return F.when(F.contains(code, F.lit(".")), F.regexp_replace(code, r"\.[^.]*$", "")).when(code.rlike(r"^\d{2,}$"), F.substring(code, F.lit(1), F.when(size == 2, 1).otherwise(size - 2)))


def from_tables(sheets: dict[str, DataFrame]) -> DataFrame:
    """One chart of the tables of a workbook, by the name of the sheet (S16); rows without a code are left out."""
    out = None
    for i, (sheet, rows) in enumerate(sheets.items()):
        at = column_map(rows.columns)
        cell = lambda f, at=at, rows=rows: F.nullif(F.trim(rows[f"`{at[f]}`"].cast("string")), F.lit("")) if f in at else F.lit(None).cast("string")
        one = rows.select(*[cell(f).alias(f) for f in ALIASES], F.array(F.lit(sheet)).alias("forms"), (F.lit(i << 56) + F.monotonically_increasing_id()).alias("row_no")).filter("codigo is not null")
        out = one if out is None else out.unionByName(one)
    out = out.withColumns({"descricao": F.coalesce("descricao", F.lit("")), "nivel": F.col("nivel").try_cast("int").cast("string"), "parent_id": F.coalesce("parent_id", parent_of(F.col("codigo")))})
    return merged(out, [f for f in ALIASES if f not in ("codigo", "descricao")]).withColumn("nivel", F.col("nivel").cast("int"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """The accounts of a chart in JSON, its contas_flat (S17)."""
    texts = ", ".join(f"{f} string" for f in ALIASES if f != "nivel")
    flat = spark.read.json(path, multiLine=True, schema=f"contas_flat array<struct<{texts.replace(' string', ': string')}, nivel: int, forms: array<string>>>")
    return flat.select(F.explode("contas_flat").alias("c")).select("c.*")


def merged(accounts: DataFrame, fields: list[str]) -> DataFrame:
    """A row per codigo: its longest descricao, the first non-empty of each field by row_no, the union of forms."""
    one = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("row_no")))
    return accounts.groupBy("codigo").agg(F.max_by("descricao", F.struct(F.char_length("descricao"), -F.col("row_no"))).alias("descricao"), *[one(c).alias(c) for c in fields], F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms"))


def with_parents(chart: DataFrame, selected: DataFrame) -> DataFrame:
    """codigo of the selected accounts and all their ancestors by parent_id."""
    return chart.sparkSession.sql(
        """WITH RECURSIVE up(codigo) AS (SELECT codigo FROM {selected} UNION ALL SELECT c.parent_id FROM up JOIN {chart} c ON up.codigo = c.codigo WHERE c.parent_id IS NOT NULL)
        SELECT DISTINCT codigo FROM up""", selected=selected.select("codigo").distinct(), chart=chart.select("codigo", "parent_id"),
    )


def with_extras(chart: DataFrame, extras: DataFrame) -> DataFrame:
    """The chart and those extra accounts whose code is not taken."""
    return chart.unionByName(extras.join(chart.select("codigo"), "codigo", "left_anti"), allowMissingColumns=True)


def statistics(chart: DataFrame) -> DataFrame:
    """field, value, n for levels, roots and types."""
    rows = chart.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in (("nivel", codes.level(F.col("codigo"))), ("raiz", F.substring("codigo", 1, 1)), ("tipo", F.col("tipo")))])).alias("x"))
    return rows.select("x.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def of_form(chart: DataFrame, form: str) -> DataFrame:
    return chart.filter(F.array_contains("forms", form))


def of_forms(chart: DataFrame, forms: list[str]) -> DataFrame:
    return chart.filter(F.arrays_overlap("forms", F.array(*map(F.lit, forms))))


def forms(chart: DataFrame) -> DataFrame:
    return chart.select(F.explode("forms").alias("form")).distinct()


def by_form(chart: DataFrame) -> DataFrame:
    return chart.select(F.explode("forms").alias("form"), "codigo").groupBy("form").agg(F.array_sort(F.collect_set("codigo")).alias("codigos"))


def new_terms(pairs: DataFrame, least: int = 4) -> DataFrame:
    """term, mapped: words of source that target lacks, with target's own words that source lacks."""
    words = lambda c: F.split(c, " ")
    long = lambda a: F.filter(a, lambda w: F.char_length(w) >= least)
    both = pairs.select(long(F.array_except(words("source"), words("target"))).alias("s"), long(F.array_except(words("target"), words("source"))).alias("t"))
    return both.select(F.explode("s").alias("term"), "t").select("term", F.explode("t").alias("m")).groupBy("term").agg(F.array_sort(F.collect_set("m")).alias("mapped"))
