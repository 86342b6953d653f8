"""Descriptions: normal form, what they declare, what they are not."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> dict[str, str]:
    """Lower-case letters of the Latin blocks that come apart into ASCII letters and marks, and these letters."""
    out = {}
    for c in map(chr, [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and base != c and base.isascii():
            out[c] = base
    return out


BASES = _bases()
ACCENTED = "".join(c for c, b in BASES.items() if len(b) == 1)
PLAIN = "".join(BASES[c] for c in ACCENTED)
LIGATURES = {c: b for c, b in BASES.items() if len(b) > 1}
#: Words that declare a result account's nature; those of expense win.
EXPENSE_WORDS = ["custo", "despesa", "deducao", "abatimento", "perda", "provisao para perda"]
REVENUE_WORDS = ["receita", "faturamento", "venda", "rendimento", "ganho"]
#: Fixed value: a description that is a statement's grand total.
GRAND_TOTAL = r"^total\s+(d[oae]s?\s+)?(ativo|passivo(\s*[e+]\s*patrimonio\s+liquido)?|geral|exercicio|balanco|patrimonio\s+liquido)\s*$"
#: What declares the term of an account.
NON_CURRENT = r"(?i)n[ãa]o[\s-]*circulante|longo\s*prazo|permanente|imobilizado|intang[íi]vel"
CURRENT = r"(?i)circulante|curto\s*prazo"

#: Terms of companies, and of accounts, in descriptions.
COMPANY_TERMS = ["SOLUCA", "SOLUÇÃO", "SOLUÇÕES", "SOFTWARE", "SISTEMA", "SISTEMAS", "TECNOLOGIA", "SERVICOS", "SERVIÇOS", "DIGITAL", "PLATFORM", "PLATAFORMA"]
ACCOUNT_TERMS = ["CAIXA", "BANCOS", "BANCO", "IMPOSTO", "IMPOSTOS", "RECEITA", "RECEITAS", "DESPESA", "DESPESAS", "ATIVO", "PASSIVO", "CLIENTES", "FORNECEDORES", "PATRIMONIO", "PATRIMÔNIO", "ESTOQUES", "SALARIOS", "SALÁRIOS"]
#: Patterns of analytical detail: tax ids, company forms, branch, current account, bank number.
DETAIL = [r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", r"LTDA\.?|S/A|S\.A\.|EIRELI|ME\b|EPP\b", r"AG[ÊE]NCIA\s*\d+", r"C/C\s*\d+|CONTA\s*CORRENTE\s*\d+", r"CPF\s*\d{3}\.\d{3}\.\d{3}-\d{2}", r"BANCO\s+\d{3}"]


def unaccented(text: Column) -> Column:
    """Lower case without accents and outer space; letters that stand for several are spelt out where there are any."""
    plain = F.translate(F.lower(F.trim(text)), ACCENTED, PLAIN)
    spelt = F.expr("map(" + ", ".join(f"'{c}', '{letters}'" for c, letters in LIGATURES.items()) + ")")
    each = lambda p: F.array_join(F.transform(F.split(p, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")
    plain = F.get(F.transform(F.array(plain), lambda p: F.when(p.rlike(f"[{''.join(LIGATURES)}]"), each(p)).otherwise(p)), F.lit(0))
    return F.regexp_replace(plain, r"\p{Mn}", "")


def normalized(text: Column) -> Column:
    """Lower case, without accents, single spaces."""
    return F.trim(F.regexp_replace(unaccented(text), r"\s+", " "))


def is_garbage(text: Column) -> Column:
    """Missing, numeric or with fewer than two letters. The class of characters is a fixed value."""
    text = F.coalesce(F.trim(text), F.lit(""))
    return text.rlike(r"^[\s\d.,\-()rR$%/]*$") | (F.char_length(F.regexp_replace(text, r"\P{L}", "")) < 2)


def is_grand_total(text: Column) -> Column:
    return F.coalesce(unaccented(text).rlike(GRAND_TOTAL), F.lit(False))


def is_total_line(text: Column) -> Column:
    return F.coalesce(unaccented(text).rlike(r"^\s*(sub)?tota(l|is)\b"), F.lit(False))


def result_nature(text: Column) -> Column:
    """RECEITA or DESPESA where the text declares one: a (-) or (+) in front, then words of expense, then of revenue."""
    plain = unaccented(text)
    has = lambda words: reduce(Column.__or__, [plain.contains(w) for w in words])
    return F.when(text.rlike(r"^\s*\(\s*-\s*\)"), "DESPESA").when(text.rlike(r"^\s*\(\s*\+\s*\)"), "RECEITA").when(has(EXPENSE_WORDS), "DESPESA").when(has(REVENUE_WORDS), "RECEITA")


def term(text: Column) -> Column:
    """CIRCULANTE or NAO_CIRCULANTE where the text declares one."""
    return F.when(text.rlike(NON_CURRENT), "NAO_CIRCULANTE").when(text.rlike(CURRENT), "CIRCULANTE")


def expanded(text: Column, abbreviations: Column, phrases: Column, tokens: Column) -> Column:
    """Normal text in the dictionary's vocabulary.

    abbreviations and tokens map words; phrases is an array of (key, value),
    longest key first.
    """
    s = normalized(text)
    for mark, word in (("c", "com"), ("s", "sobre"), ("p", "para")):
        s = F.regexp_replace(s, rf"\b{mark}/", f"{word} ")
    s = F.regexp_replace(s, r"[./,;:()\\]", " ")
    by_word = lambda s, m: F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")
    s = by_word(s, abbreviations)
    s = F.aggregate(phrases, s, lambda acc, p: F.replace(acc, p["key"], p["value"]))
    return by_word(s, tokens)


def is_noise(text: Column) -> Column:
    """Looks like a company rather than an account: a company term, no account term, and three words in capitals or more than 18 characters."""
    plain = F.trim(text)
    company = plain.rlike("(?i)" + "|".join(COMPANY_TERMS))
    account = F.upper(plain).rlike("|".join(ACCOUNT_TERMS))
    capitals = F.size(F.filter(F.split(plain, r"\s+"), lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return F.coalesce(company & ~account & ((capitals >= 3) | (F.char_length(plain) > 18)), F.lit(False))


def is_analytical_detail(text: Column) -> Column:
    """A tax id, company form, branch or bank account in the description."""
    return F.coalesce(F.upper(text).rlike("|".join(DETAIL)), F.lit(False))


def clean_name(text: Column) -> Column:
    """A file-system name."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|]+', " "), r"\s+", " "))
