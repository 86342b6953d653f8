"""Years, months and customers that the names of files and sheets declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import text

#: Months, the least year, and words that name the document and not the customer.
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
FIRST_YEAR = 1990
DOCUMENT_WORDS = (
    "balancete balancetes balanco balancos balan bp dre df dfs demonstracao demonstracoes financeiras contabil razao consolidado consolidada controladora parecer auditado "
    "excel planilha arquivo copia final ultimo ultima novo nova revisado ajustado em de do da e - balanc patrimonial patrimoniais resultado exercicio gt"
).split()

YEAR = r"(?:19|20)\d{2}"
MONTH_YEAR = rf"(?i)\b(?:{'|'.join(MONTHS)})[a-z]*[\s._-]?(\d{{2}})\b"
QUARTER = r"(?i)\b[1-4]T(\d{2})\b"


def stem(name: Column) -> Column:
    """Without folders and the extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def year_of(name: Column, last: int) -> Column:
    """The year that occurs most, the first of equals; else that of a month with a year of two digits, or of a quarter."""
    plain = text.unaccented(stem(name))
    years = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(f"({YEAR})"), F.lit(1)), lambda y: y.cast("int")), lambda y: (y >= FIRST_YEAR) & (y <= last))
    votes = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-F.array_position(years, y)).alias("place"), y.alias("year")))
    short = lambda p: F.when(plain.rlike(p), 2000 + F.regexp_extract(plain, p, 1).try_cast("int"))
    inside = lambda y: F.when(y.between(FIRST_YEAR, last), y)
    return F.coalesce(F.array_max(votes)["year"], inside(short(MONTH_YEAR)), inside(short(QUARTER)))


def month_of(name: Column) -> Column:
    """The first month of the year whose name occurs as the beginning of a word."""
    plain = text.unaccented(name)
    return F.coalesce(*[F.when(plain.rlike(rf"\b{m}"), n) for n, m in enumerate(MONTHS, 1)])


def customer_of(name: Column) -> Column:
    """What is left of a name without dates, numbers, document words and fragments; empty if nothing."""
    words = F.filter(F.split(stem(name), r"[\s_\-.,;()\[\]]+"), lambda w: w != "")
    dated = lambda w: w.rlike(rf"^(?:\d+|{YEAR}|{MONTH_YEAR}|{QUARTER})$")
    noise = F.array(*[F.lit(w) for w in [*DOCUMENT_WORDS, *MONTHS]])
    kept = F.filter(words, lambda w: ~dated(w) & ~F.array_contains(noise, text.unaccented(w)) & ((F.char_length(w) > 2) | ((w == F.upper(w)) & (w != F.lower(w)))))
    return F.array_join(kept, " ")


def customers(names: DataFrame, key: list[str]) -> DataFrame:
    """key, customer: the guess that occurs most among names (key, position, name), the first of equals; empty without one."""
    guessed = names.withColumn("customer", customer_of(F.col("name"))).filter("customer <> ''").groupBy(*key, "customer").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    best = guessed.groupBy(*key).agg(F.max_by("customer", F.struct("n", -F.col("first"))).alias("customer"))
    return names.select(*key).distinct().join(best, key, "left").withColumn("customer", F.coalesce("customer", F.lit("")))


def output_name(customer: Column, first: Column, last: Column) -> Column:
    """customer_year or customer_first-last, without what file systems refuse; Cliente where no name is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(customer, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " "))
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.concat(F.when(clean == "", "Cliente").otherwise(clean), F.lit("_"), F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string"))))
