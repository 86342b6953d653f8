"""Files as tables: lines, encodings, delimiters, headers, provenance, rejected rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerweave.functions.numbers import parse_amount
from ledgerweave.sources import text_scan
from ledgerweave.sources.stage import saved

#: Words of a ledger's header row; delimiters that are tried.
HEADER_WORDS = ["codigo", "conta", "descricao", "classificacao", "nome", "saldo", "debito", "credito", "anterior", "atual", "natureza", "movimento"]
DELIMITERS = [";", ",", "\t", "|"]
EXTENSIONS = ["csv", "txt", "json", "parquet"]


@F.arrow_udf(StringType())
def digest(path: pa.Array) -> pa.Array:
    """SHA-256 of the files, lowercase hex, read by pieces: a file may be larger than a value of a table."""
    out = []
    for p in path.to_pylist():
        whole = hashlib.sha256()
        with text_scan.opened(p) as file:
            while piece := file.read(8 << 20):
                whole.update(piece)
        out.append(whole.hexdigest())
    return pa.array(out, pa.string())


def catalogue(spark: SparkSession, path: str, accepted: list[str] | None = None) -> DataFrame:
    """file_id, name, extension, accepted, length, modified, sha256 of every file below path, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return files.select(F.col("path").alias("file_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), extension.alias("extension"), extension.isin(accepted or EXTENSIONS).alias("accepted"), "length", F.col("modificationTime").alias("modified"), digest("path").alias("sha256")).dropDuplicates(["file_id"])


def lines(spark: SparkSession, path: str | list[str], range_bytes: int = text_scan.RANGE_BYTES) -> DataFrame:
    """file_id, row_no, line of text files in any of the known charsets, without blank lines; large files are read by many tasks."""
    return text_scan.numbered_lines(spark, path, range_bytes).filter("line <> ''")


def delimiter(table: DataFrame, first: int = 50) -> DataFrame:
    """file_id, delimiter by vote over the first lines: +100 for a constant count, else 50 less five for each distinct one, plus occurrences."""
    tried = table.filter(F.col("row_no") < first).withColumn("delimiter", F.explode(F.array(*map(F.lit, DELIMITERS))))
    counted = tried.withColumn("n", F.size(F.split("line", F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E")))) - 1).groupBy("file_id", "delimiter").agg(F.count_distinct("n").alias("kinds"), F.sum("n").alias("total"), F.max("n").alias("most"))
    score = F.when(F.col("most") == 0, -1).otherwise(F.when(F.col("kinds") == 1, 100).otherwise(F.greatest(F.lit(0), 50 - 5 * F.col("kinds"))) + F.col("total"))
    return counted.groupBy("file_id").agg(F.max_by("delimiter", F.struct(score, F.col("delimiter"))).alias("delimiter"))


def keyword_hits(line: Column, words: list[str] | None = None) -> Column:
    low = F.translate(F.lower(line), "áàâãéêíóôõúç", "aaaaeeiooouc")
    return F.size(F.filter(F.array(*map(F.lit, words or HEADER_WORDS)), lambda w: F.contains(low, w)))


def header_rows(table: DataFrame, least: int = 3, first: int = 30) -> DataFrame:
    """file_id, header: the first of the first lines with enough header words."""
    return table.filter(F.col("row_no") < first).filter(keyword_hits(F.col("line")) >= least).groupBy("file_id").agg(F.min("row_no").alias("header"))


def cells(table: DataFrame, by: DataFrame) -> DataFrame:
    """file_id, row_no, col_no, value of lines cut at their file's delimiter."""
    parts = F.split("line", F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E")))
    return table.join(by, "file_id").select("file_id", "row_no", F.posexplode(parts).alias("col_no", "value")).withColumn("value", F.trim(F.col("value")))


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of lines that have this schema: rows with file_id and its columns, rejected with file_id, line (from 1), reason, data."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    raw = lines(spark, path).select("file_id", "row_no", "line", F.from_csv("line", F.lit(f"{schema}, _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", **options}).alias("r"))
    rejected = raw.filter("r._bad is not null").select("file_id", (F.col("row_no") + 1).alias("line"), F.lit("not of the schema").alias("reason"), F.col("line").alias("data"))
    return raw.filter("r._bad is null").select("file_id", *[f"r.{n}" for n in names]), rejected


#: Labels of the columns that a ledger is made of, those to prefer first.
COLUMNS = {"codigo": ["codigo", "código", "conta", "classificacao", "classificação"], "descricao": ["descricao", "descrição", "nome", "conta contábil", "conta"], "saldo": ["saldo", "valor", "saldo atual"]}


def fields(line: Column, by: Column) -> Column:
    """The trimmed cells of a line; a delimiter between quotes parts nothing, and a cell's quotes go."""
    mark = F.concat(F.lit(r"\Q"), by, F.lit(r"\E"))
    quoted = F.split(line, F.concat(mark, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    bare = F.transform(quoted, lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.transform(F.split(line, mark), lambda c: F.trim(c)))


def place_of(labels: Column, patterns: list[str]) -> Column:
    """Place from 1 of the label that is one of the patterns, the first pattern first; else of one that holds one; else null."""
    low = F.transform(labels, lambda c: F.lower(c))
    equal = [F.nullif(F.array_position(low, F.lit(p)), F.lit(0)) for p in patterns]
    part = [F.nullif(F.array_position(F.transform(low, lambda c, p=p: F.contains(c, F.lit(p))), F.lit(True)), F.lit(0)) for p in patterns]
    return F.coalesce(*equal, *part).cast("int")


def densest_header(table: DataFrame, first: int = 50) -> DataFrame:
    """file_id, header, delimiter: of the first rows and the delimiters, the row and the delimiter that give most cells that aren't blank; the earlier delimiter, then the earlier row of equals."""
    tried = table.filter(F.col("row_no") < first).select("file_id", "row_no", "line", F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("place", "delimiter"))
    full = F.size(F.filter(F.split("line", F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E"))), lambda c: F.trim(c) != ""))
    best = F.min_by(F.struct(F.col("row_no").alias("header"), "delimiter"), F.struct(-F.col("full"), "place", "row_no"))
    return tried.withColumn("full", full).groupBy("file_id").agg(best.alias("b")).select("file_id", "b.header", "b.delimiter")


def parsed(table: DataFrame, by: DataFrame, headers: DataFrame, columns: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of lines (file_id, row_no, line), their files' delimiters and header rows.

    rows: file_id, row_no, codigo, descricao (the code where there is none),
    saldo; lines without code and description are left out. rejected: file_id,
    line (from 1), reason, data: lines with more cells than the header, and
    amounts that can't be read. The files' heads are a row each, written once,
    so that lines are joined to them where they are. The table is read twice
    for these and once for each result: one that is costly to make is to be
    saved before.
    """
    wanted = columns or COLUMNS
    known = saved(by.join(headers, "file_id"), "heads")
    heads = table.withColumnRenamed("row_no", "header").join(known, ["file_id", "header"]).withColumn("labels", fields(F.col("line"), F.col("delimiter")))
    heads = saved(heads.select("file_id", "header", "delimiter", F.size("labels").alias("width"), *(place_of(F.col("labels"), p).alias(f"at_{c}") for c, p in wanted.items())), "heads")
    body = table.join(heads, "file_id").filter(F.col("row_no") > F.col("header")).withColumn("cells", fields(F.col("line"), F.col("delimiter")))
    cell = lambda c: F.nullif(F.get("cells", F.col(f"at_{c}") - 1), F.lit(""))
    body = body.withColumns({**{c: cell(c) for c in wanted}, "amount": F.get(F.transform(F.array(cell("saldo")), lambda c: parse_amount(c)), F.lit(0))})  # as a function of one name, its code stays small
    many = F.size("cells") > F.col("width")
    reason = F.when(many, F.format_string("too many fields: %d for %d", F.size("cells"), F.col("width"))).when(F.col("saldo").isNotNull() & F.col("amount").isNull(), F.concat(F.lit("unreadable amount: "), "saldo"))
    judged = body.withColumn("reason", reason)
    rows = judged.filter("reason is null").filter(F.coalesce("codigo", "descricao").isNotNull())
    rejected = judged.filter("reason is not null").select("file_id", (F.col("row_no") + 1).alias("line"), "reason", F.col("line").alias("data"))
    return rows.select("file_id", "row_no", "codigo", F.coalesce("descricao", "codigo").alias("descricao"), F.col("amount").alias("saldo")), rejected


def first_rejected(rejected: DataFrame, n: int = 10) -> DataFrame:
    """The first n rejected lines of each file, by their place in it, and nth from 1."""
    return rejected.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("line"))).filter(F.col("nth") <= n)


def stream_csv(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16, **options: str) -> DataFrame:
    return spark.readStream.options(maxFilesPerTrigger=str(files_per_batch), **options).schema(schema).csv(path)


def has_columns(header: Column, required: list[str]) -> Column:
    """Every required name equals or is part of a header cell."""
    return F.forall(F.array(*map(F.lit, required)), lambda c: F.exists(header, lambda h: (h == c) | F.contains(h, c)))


def verbatim(table: DataFrame, most: int | None = None) -> DataFrame:
    """table with truncated; all rows, or with most only the first of each file, marked where more follow."""
    if most is None:
        return table.withColumn("truncated", F.lit(False))
    longest = F.max("row_no").over(Window.partitionBy("file_id"))
    return table.withColumn("truncated", longest >= most).filter(F.col("row_no") < most)
