"""Account codes: dotted, flat and padded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIERARCHICAL = r"^\d+(\.\d+)*$"
#: Class of the root digit; role of a bank plan's root digit.
CLASSES = {"1": "ATIVO", "2": "PASSIVO", **dict.fromkeys("3456789", "RESULTADO")}
BANK_ROLES = {"1": "ATIVO", "2": "ATIVO", "3": "COMPENSACAO", "4": "PASSIVO", "5": "PASSIVO", "6": "PASSIVO", "7": "RECEITA", "8": "DESPESA", "9": "COMPENSACAO"}
#: Term by prefix of a reference code.
TERMS = {"1.01": "CIRCULANTE", "1.02": "NAO_CIRCULANTE", "2.01": "CIRCULANTE", "2.02": "NAO_CIRCULANTE"}


def _by_root(code: Column, table: dict[str, str]) -> Column:
    root = F.substring(F.trim(F.regexp_replace(code, r"^[()\- ]+", "")), 1, 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), root)


def account_class(code: Column) -> Column:
    return _by_root(code, CLASSES)


def bank_role(code: Column) -> Column:
    return _by_root(code, BANK_ROLES)


def is_off_balance(code: Column) -> Column:
    return F.coalesce(bank_role(code) == "COMPENSACAO", F.lit(False))


def term_of_code(code: Column) -> Column:
    code, out = F.trim(code), None
    for prefix, name in TERMS.items():
        hit = (code == prefix) | code.startswith(prefix + ".")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def level(code: Column) -> Column:
    return F.size(F.split(code, "[.]"))


def is_hierarchical(code: Column) -> Column:
    return F.coalesce(code.rlike(HIERARCHICAL), F.lit(False))


def is_flat_code(code: Column) -> Column:
    return F.coalesce(F.trim(code).rlike(r"^\d{4,}$"), F.lit(False))


def is_padding(part: Column) -> Column:
    return F.coalesce(F.trim(part).rlike("^0+$"), F.lit(False))


def is_class_root(code: Column) -> Column:
    return ~code.contains(".")


def prefixes(code: Column, itself: bool = True) -> Column:
    """Dotted prefixes, shortest first."""
    parts = F.split(code, "[.]")
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def string_prefixes(code: Column) -> Column:
    """All prefixes of the characters, shortest first."""
    return F.when(F.char_length(code) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(code), F.lit(1))), lambda n: code.substr(F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def sort_key(code: Column) -> Column:
    """Orders by segments: numbers by value, before text."""
    return F.transform(F.split(code, "[.]"), lambda s: F.struct(s.try_cast("int").isNull().alias("text"), s.try_cast("int").alias("n"), s.alias("s")))


def unpadded(code: Column) -> Column:
    """Without zero segments at the end, for numeric codes of three or more segments."""
    return F.when(code.rlike(r"^\d+(\.\d+){2,}$"), F.regexp_replace(code, r"(\.0+)+$", "")).otherwise(code)


def has_inner_zero(code: Column) -> Column:
    """A zero segment with a non-zero one after it."""
    return F.coalesce(code.rlike(r"\.0+(\.\d+)*\.0*[1-9]\d*$"), F.lit(False))


def fixed_width_key(code: Column, width: Column) -> Column:
    """Canonical code in a plan of width segments (NULL: code as it is).

    A full code with a zero level is a node: its last segment, a row number,
    goes, and zero levels at the end with it. Other full codes are leaves.
    """
    full = level(code) >= width
    levels = F.regexp_replace(code, r"\.[^.]*$", "")
    node = full & levels.rlike(r"(^|\.)0+(\.|$)")
    cut = lambda c: F.regexp_replace(c, r"(\.0+)+$", "")
    return F.when(width.isNull(), code).when(node, cut(levels)).when(full, code).otherwise(cut(code))


def dotted(code: Column, lengths: Column) -> Column:
    """A flat code cut at the cumulative lengths that fit into it."""
    own = F.filter(lengths, lambda n: n <= F.char_length(code))
    ends = F.when(F.array_contains(own, F.char_length(code)), own).otherwise(F.array_append(own, F.char_length(code)))
    cut = lambda ends: F.array_join(F.transform(ends, lambda n, i: code.substr(F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, n - F.coalesce(F.get(ends, i - 1), F.lit(0)))), ".")
    return F.get(F.transform(F.array(ends), cut), F.lit(0))  # as an argument the ends are found once, not for each of them
