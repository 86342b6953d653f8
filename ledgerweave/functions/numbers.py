"""Printed amounts as exact decimals. Unreadable text is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"


def _money(digits: Column, negative: Column) -> Column:
    value = digits.try_cast("decimal(38,10)").cast(MONEY)
    return F.when(negative, -value).otherwise(value)


def _last(text: Column, mark: str) -> Column:
    """Place of the last mark, 0 if there is none."""
    return F.when(F.instr(text, mark) == 0, 0).otherwise(F.char_length(text) - F.instr(F.reverse(text), mark) + 1)


def _decimal_mark(digits: Column) -> Column:
    """Of point and comma the last is the decimal mark; a lone comma is; lone points are not if they part thousands."""
    comma, point = _last(digits, ","), _last(digits, ".")
    bare = lambda mark: F.regexp_replace(digits, mark, "")
    return (
        F.when((comma > 0) & (comma > point), F.translate(bare("[.]"), ",", "."))
        .when((comma > 0) & (point > 0), bare(","))
        .when(digits.rlike(r"^-?\d{1,3}([.]\d{3})+$"), bare("[.]"))
        .otherwise(digits)
    )


def parse_amount(text: Column) -> Column:
    """Balance text: minus or full brackets are negative, a final D or C and all other signs are dropped."""
    text = F.trim(text)
    negative = text.startswith("-") | (text.startswith("(") & text.endswith(")"))
    digits = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*[dc]\s*$", ""), r"[^\d.,]", "")
    return F.when(digits.rlike(r"\d"), _money(_decimal_mark(digits), negative))


def finite_amount(number: Column) -> Column:
    """A number as it is; NaN and infinities are NULL."""
    number = number.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number.cast(MONEY))


def parse_amount_or(text: Column, default: float = 0) -> Column:
    return F.coalesce(parse_amount(text), F.lit(default).cast(MONEY))


def parse_statement_number(text: Column, unit: int = 1) -> Column:
    """Number of a printed statement: text with letters is NULL; one or two digits after the last comma are decimals, three are thousands."""
    text = F.trim(text)
    bracketed = text.startswith("(") & text.endswith(")")
    inner = F.regexp_replace(F.when(bracketed, F.trim(text.substr(F.lit(2), F.greatest(F.char_length(text) - 2, F.lit(0))))).otherwise(text), r"[Rr]\$|[$€£ ]", "")
    comma = inner.rlike(r",\d{1,2}$")
    no_comma = F.when(comma, F.regexp_replace(F.regexp_replace(inner, r",(\d{1,2})$", "~$1"), "[.]", "")).otherwise(F.regexp_replace(inner, ",", ""))
    no_comma = F.translate(no_comma, "~", ".")
    pointed = F.when(~comma & no_comma.rlike(r"^-*\d+[.]\d{3}$"), F.regexp_replace(no_comma, "[.]", "")).otherwise(no_comma)
    digits = F.regexp_replace(pointed, r"[^0-9.\-]", "")
    value = F.when(~inner.rlike("[A-Za-z]") & digits.rlike(r"\d"), _money(digits, bracketed))
    return (value * unit).cast(MONEY)


def parse_simple_number(text: Column) -> Column:
    """Column value: a comma is the decimal mark and points before it thousands; without a comma, a point is the decimal mark."""
    clean = F.regexp_replace(text, r"(?i)[R$€\s]", "")
    clean = F.when(clean.contains(",") & clean.contains("."), F.translate(F.regexp_replace(clean, "[.]", ""), ",", ".")).otherwise(F.translate(clean, ",", "."))
    bracketed = clean.startswith("(") & clean.endswith(")")
    return _money(F.regexp_replace(clean, r"^\((.*)\)$", "$1"), bracketed)


def parse_token(text: Column) -> Column:
    """A number among words of a page: an opening bracket or minus is negative."""
    text = F.trim(text)
    digits = F.regexp_replace(text, r"[^\d.,]", "")
    return F.when(digits != "", _money(_decimal_mark(digits), text.startswith("(") | text.startswith("-")))


def primary_amount(*fields: Column) -> Column:
    """The first readable of several fields."""
    return F.coalesce(*fields)


def unreadable(raw: list[Column], parsed: list[Column]) -> Column:
    """Some field is there and none can be read."""
    return F.coalesce(*raw).isNotNull() & F.coalesce(*parsed).isNull()


def scaled(value: Column, scale: int = 1000) -> Column:
    return F.coalesce((value / scale).cast(MONEY), F.lit(0).cast(MONEY))
