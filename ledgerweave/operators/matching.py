"""Matching of descriptions to a chart of accounts.

Distinct queries meet distinct texts once, in blocks. A task puts its texts
into an index whose bounds leave out what cannot be among a query's best, and
scores the rest exactly; a window merges what the blocks have kept.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ledgerweave.functions import codes, similarity, text
from ledgerweave.sources.stage import saved

QUERY_BLOCK, TEXT_BLOCK = 256, 16384
#: Words that make an account a candidate; texts have no accents, so three of them never match, as in the reference.
KEYWORDS = ["caixa", "banco", "estoque", "cliente", "fornecedor", "capital", "lucro", "prejuízo", "receita", "despesa", "ativo", "passivo", "investimento", "imobilizado", "intangível", "empréstimo", "financiamento"]
#: Fixed value: what parts the core of a description from its suffix.
SUFFIX = r"\s[-–—]\s"


@F.arrow_udf(DoubleType())
def set_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(similarity.pair_ratios(a.to_pylist(), b.to_pylist(), "set_ratio"))


@F.arrow_udf(DoubleType())
def sort_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(similarity.pair_ratios(a.to_pylist(), b.to_pylist(), "sort_ratio"))


@F.arrow_udf(DoubleType())
def confidences(a: pa.Array, b: pa.Array) -> pa.Array:
    """Mean of both ratios of two normal texts, 0 to 1; 1 if one is empty."""
    a, b = a.to_pylist(), b.to_pylist()
    both = similarity.pair_ratios(a, b, "set_ratio") + similarity.pair_ratios(a, b, "sort_ratio")
    return pa.array([round(r / 200, 2) if x and y else 1.0 for x, y, r in zip(a, b, both.tolist(), strict=True)], pa.float64())


def build_index(chart: DataFrame, variations: DataFrame | None = None) -> DataFrame:
    """text, codigo, classe, natureza, prazo, lado, learned, boost: each account under its own text, then under learned ones; lado is the chart's natureza (Devedora, Credora) where it has that column."""
    chart = chart.withColumn("lado", F.col("natureza") if "natureza" in chart.columns else F.lit(None).cast("string"))
    base = chart.select("codigo", F.col("descricao").alias("d"), "tipo", "lado", text.normalized(F.col("descricao")).alias("text"), F.lit(False).alias("learned"), F.lit(0.0).alias("boost"))
    if variations is not None:
        more = variations.select("codigo", F.explode("variations").alias("v"), "frequency").join(chart, "codigo")
        base = base.unionByName(more.select("codigo", F.col("descricao").alias("d"), "tipo", "lado", text.normalized(F.col("v")).alias("text"), F.lit(True).alias("learned"), (F.least(F.col("frequency") / 10, F.lit(0.10)) * 100).alias("boost")))
    first = Window.partitionBy("text", "codigo").orderBy("learned", F.col("boost").desc())
    one = base.filter("text <> ''").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    code = F.col("codigo")
    return one.select("text", "codigo", F.col("d").alias("descricao"), "tipo", codes.account_class(code).alias("classe"), text.result_nature(F.col("d")).alias("natureza"), F.coalesce(codes.term_of_code(code), text.term(F.col("d"))).alias("prazo"), "lado", "learned", "boost")


def similar_texts(queries: DataFrame, texts: DataFrame, limit: int = 40, scorer: str = "set_ratio", query_block: int = QUERY_BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """query, text, set_ratio, sort_ratio: for each distinct query the limit most similar texts by the scorer (one of the two ratios), ties by text.

    Exact at every size; a task has about query_block queries and text_block
    texts. Null queries and texts take no part.
    """
    asked, known = queries.select("query").filter("query is not null").distinct(), texts.select("text").filter("text is not null").distinct()
    # The numbers of blocks only set the sizes of tasks; a text's block is its hash.
    across, down = max(1, math.ceil(asked.count() / query_block)), max(1, math.ceil(known.count() / text_block))
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("across", F.pmod(F.xxhash64("query"), F.lit(across).cast("long"))).withColumn("down", blocks(down))
    known = known.withColumn("down", F.pmod(F.xxhash64("text"), F.lit(down).cast("long"))).withColumn("across", blocks(across))

    def score(asked: pa.Table, known: pa.Table) -> pa.Table:
        index = similarity.Index(known["text"].to_pylist(), scorer)
        found = [(q, t, s) for q in asked["query"].to_pylist() for t, s in index.best(q, limit)]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query", "text", scorer])

    found = asked.groupBy("across", "down").cogroup(known.groupBy("across", "down")).applyInArrow(score, f"query string, text string, {scorer} double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col(scorer).desc(), "text"))).filter(F.col("nth") <= limit)
    other, rate = ("sort_ratio", sort_ratios) if scorer == "set_ratio" else ("set_ratio", set_ratios)
    return best.withColumn(other, rate("query", "text")).select("query", "text", "set_ratio", "sort_ratio")


def adjusted(score: Column) -> Column:
    """Score with hints and clashes, in a fixed order: +5 type, +3 nature hint, learned boost, x0.5 class, x0.3 or +5 nature, x0.3 or +5 term, at most 100."""
    s = score + F.when(F.col("tipo") == F.col("q_tipo"), 5).otherwise(0) + F.when(F.col("lado") == F.col("q_hint"), 3).otherwise(0) + F.col("boost")
    s = F.when(F.col("q_classe").isNotNull() & (F.col("classe") != F.col("q_classe")), s * 0.5).otherwise(s)
    for mine, theirs in (("q_natureza", "natureza"), ("q_prazo", "prazo")):
        both = F.col(mine).isNotNull() & F.col(theirs).isNotNull()
        s = F.when(both & (F.col(mine) != F.col(theirs)), s * 0.3).when(both, s + 5).otherwise(s)
    return F.least(s, F.lit(100.0))


def cache_key(q: Column, classe: Column, natureza: Column, prazo: Column) -> Column:
    return F.when(classe.isNull(), q).otherwise(F.concat_ws("|", q, classe, F.coalesce(natureza, prazo)))


def foremost(index: DataFrame, n: int = 10) -> DataFrame:
    """index without what can't be among any query's n best: of accounts that adjusted() can't tell apart under one text, the first n codes stay.

    These have the same score and the same tie for every query, so the code
    decides; whatever else an account is found by, n codes stand before it.
    """
    alike = Window.partitionBy("text", "tipo", "classe", "natureza", "prazo", "lado", "boost").orderBy("codigo")
    return index.withColumn("nth", F.dense_rank().over(alike)).filter(F.col("nth") <= n).drop("nth")


def match(queries: DataFrame, index: DataFrame, decisions: DataFrame | None = None, accept: float = 85.0, limit: int = 40, vocabulary: tuple[Column, Column, Column] | None = None, keywords: list[str] = KEYWORDS) -> DataFrame:
    """query, its hints, codigo, score, confidence, accepted, source, candidates (five when accepted, else ten).

    queries: query (normal text), q_classe, q_natureza, q_prazo, q_tipo,
    q_hint and, if there is one, q_saldo. Decisions (key, codigo) come first;
    the rest is matched, each distinct query once, in the words of the
    vocabulary (abbreviations, phrases, tokens of text.expanded). Where the
    best match is not accepted, accounts that hold a keyword of the query
    compete with it and may be accepted (source heuristic).
    """
    hints = ["q_classe", "q_natureza", "q_prazo", "q_tipo", "q_hint", *(["q_saldo"] if "q_saldo" in queries.columns else [])]
    asked = queries.select("query", *hints).distinct().withColumn("key", cache_key(F.col("query"), F.col("q_classe"), F.col("q_natureza"), F.col("q_prazo")))
    cached = None
    if decisions is not None:
        met = asked.join(decisions.select("key", F.col("codigo").alias("known")), "key", "left")
        cached = met.filter("known is not null").select("query", *hints, F.col("known").alias("codigo"), F.lit(100.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit(True).alias("accepted"), F.lit("cache").alias("source"), F.array(F.col("known")).alias("candidates"))
        asked = met.filter("known is null").drop("known")
    empty = F.create_map().cast("map<string,string>")
    asked = asked.withColumn("expanded", text.expanded(F.col("query"), *(vocabulary or (empty, F.array().cast("array<struct<key:string,value:string>>"), empty))))
    asked, index = saved(asked, "asked"), saved(index, "index")  # each is read by several joins
    found = similar_texts(asked.select(F.col("expanded").alias("query")), index, limit).withColumnRenamed("query", "expanded")
    found = found.withColumn("tie", sort_ratios("expanded", F.trim(F.split("text", SUFFIX, 2)[0])))
    scored = asked.join(found, "expanded").join(foremost(index), "text").withColumn("score", adjusted(F.col("set_ratio")))
    each = Window.partitionBy("query", *hints, "codigo").orderBy(F.col("score").desc(), F.col("tie").desc(), "text")
    best = Window.partitionBy("query", *hints).orderBy(F.col("score").desc(), F.col("tie").desc(), F.when(F.col("tipo") == "S", 0).otherwise(1), "codigo")
    ranked = scored.withColumn("e", F.row_number().over(each)).filter("e = 1").withColumn("rank", F.row_number().over(best)).filter("rank <= 10")
    none = F.lit(None)
    fuzzy = ranked.select("query", *hints, F.struct("rank", "codigo", "score", "descricao", "lado").alias("f"), none.cast("struct<low:double,kind:int,codigo:string,descricao:string,score:double>").alias("k"))
    more = keyword_scores(asked, index, hints, keywords, 11).select("query", *hints, none.cast(fuzzy.schema["f"].dataType).alias("f"), F.struct((-F.col("score")).alias("low"), F.lit(1).alias("kind"), "codigo", "descricao", (F.col("score") * 100).alias("score")).alias("k"))
    lists = fuzzy.unionByName(more).groupBy("query", *hints).agg(F.array_sort(F.collect_list("f")).alias("f"), F.collect_set("k").alias("k")).filter("size(f) > 0")
    lists = lists.withColumn("h", with_heuristics(F.col("f")[0], F.col("k"), "q_saldo" in hints))
    matched, ok = F.col("f")[0]["score"] >= accept, -F.col("h")[0]["low"] >= accept / 100
    codigos = lambda c: F.transform(c, lambda x: x["codigo"])
    chosen = F.when(matched, F.struct(*(F.col("f")[0][x].alias(x) for x in ("codigo", "score", "descricao")))).otherwise(F.struct(*(F.col("h")[0][x].alias(x) for x in ("codigo", "score", "descricao"))))
    lists = lists.select("query", *hints, chosen.alias("d"), (matched | ok).alias("accepted"), F.when(~matched & ok, "heuristic").otherwise("match").alias("source"), F.when(matched, codigos("f")).otherwise(F.array_distinct(F.concat(codigos("h"), codigos("f")))).alias("c"))
    out = lists.select("query", *hints, "d.codigo", "d.score", confidences("query", text.normalized(F.col("d.descricao"))).alias("confidence"), "accepted", "source", F.when(F.col("accepted"), F.slice("c", 1, 5)).otherwise(F.slice("c", 1, 10)).alias("candidates"))
    return out if cached is None else out.unionByName(cached)


def tie_broken(matches: DataFrame, choose, failures=None) -> DataFrame:
    """matches with choose applied where nothing was accepted; its None changes nothing, nor does its failure.

    choose takes two lists, of queries and of their candidates, and gives a
    list of codes. It is called with the open rows of a batch, and where that
    fails with each of them alone; a row that fails then keeps what it had.
    failures, an accumulator, counts such rows.
    """

    def one(query: str, candidates: list[str]) -> str | None:
        try:
            return choose([query], [candidates])[0]
        except Exception:  # whatever the given function raises
            if failures is not None:
                failures.add(1)
            return None

    @F.arrow_udf(StringType())
    def chosen(queries: pa.Array, candidates: pa.Array, accepted: pa.Array) -> pa.Array:
        rows = [(i, q, c) for i, (q, c, done) in enumerate(zip(queries.to_pylist(), candidates.to_pylist(), accepted.to_pylist(), strict=True)) if not done]
        out: list[str | None] = [None] * len(queries)
        try:
            found = choose([q for _, q, _ in rows], [c for _, _, c in rows]) if rows else []
            if len(found) != len(rows):
                raise ValueError("one code for each row")
        except Exception:  # whatever the given function raises
            found = [one(q, c) for _, q, c in rows]
        for (i, _, _), code in zip(rows, found, strict=True):
            out[i] = code
        return pa.array(out, pa.string())

    return matches.withColumn("codigo", F.coalesce(chosen("query", "candidates", "accepted"), F.col("codigo")))


def statistics(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"), F.round(F.avg("score"), 4).alias("mean_score"))


def merged_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """key and its newest decision; manual ones outlive others."""
    both = old.unionByName(new, allowMissingColumns=True)
    other = [c for c in both.columns if c != "key"]
    return both.groupBy("key").agg(F.max_by(F.struct(*other), F.struct("manual", "ts", "codigo")).alias("d")).select("key", "d.*")


def keyword_candidates(queries: DataFrame, chart: DataFrame, keywords: list[str]) -> DataFrame:
    """query, codigo, keyword for accounts whose normal text holds a keyword that is a word of the query."""
    words = F.array(*map(F.lit, keywords))
    asked = queries.select("query").distinct().withColumn("keyword", F.explode(F.array_intersect(F.split("query", " "), words)))
    have = chart.withColumn("t", text.normalized(F.col("descricao"))).withColumn("keyword", F.explode(F.filter(words, lambda w: F.contains("t", w)))).select("codigo", "keyword")
    return asked.join(have, "keyword").select("query", "codigo", "keyword")


def search(index: DataFrame, queries: DataFrame, threshold: float = 60.0, limit: int = 10) -> DataFrame:
    """query, text, sort_ratio, rank of the texts at least threshold similar by sorted words."""
    scored = similar_texts(queries, index, limit, scorer="sort_ratio").filter(F.col("sort_ratio") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("sort_ratio").desc(), "text"))).select("query", "text", "sort_ratio", "rank")


def balanced(score: Column, lado: Column, saldo: bool) -> Column:
    """Score, 0 to 1, with +0.05 where the balance has the sign of the account's side or the account has none; only for queries with a side and a balance."""
    if not saldo:
        return score
    fits = lado.isNull() | (lado == "") | ((F.col("q_saldo") > 0) & (lado == "Devedora")) | ((F.col("q_saldo") < 0) & (lado == "Credora"))
    return F.when(F.col("q_saldo").isNotNull() & F.col("q_hint").isNotNull() & fits, F.least(score + 0.05, F.lit(1.0))).otherwise(score)


def keyword_scores(asked: DataFrame, index: DataFrame, hints: list[str], keywords: list[str], limit: int) -> DataFrame:
    """query, its hints, codigo, descricao, score (0 to 1): for each keyword of the expanded query the limit best accounts whose own text holds it.

    0.70 + 0.10 (type) + 0.05 (side), x0.5 class, x0.3 nature, x0.3 term, +0.05
    balance. The score hangs on keyword and hints alone, so it is taken once
    for each of their combinations.
    """
    words = asked.withColumn("keyword", F.explode(F.array_intersect(F.split("expanded", " "), F.array(*map(F.lit, keywords)))))
    words = words.withColumn("hints", F.struct(*(F.signum("q_saldo").alias(h) if h == "q_saldo" else F.col(h) for h in hints)))
    chart = index.filter("not learned")
    have = keyword_candidates(words.select(F.col("keyword").alias("query")), chart, keywords).select("codigo", "keyword").distinct()
    have = have.join(chart, "codigo").filter(F.contains("text", "keyword")).groupBy("keyword", "codigo").agg(F.min_by(F.struct("descricao", "tipo", "classe", "natureza", "prazo", "lado"), "text").alias("a")).select("keyword", "codigo", "a.*")
    pairs = words.select("keyword", "hints").distinct().join(have, "keyword").select("*", "hints.*")
    score = F.lit(0.70) + F.when(F.col("tipo") == F.col("q_tipo"), 0.10).otherwise(0.0) + F.when(F.col("lado") == F.col("q_hint"), 0.05).otherwise(0.0)
    for mine, theirs, times in (("q_classe", "classe", 0.5), ("q_natureza", "natureza", 0.3), ("q_prazo", "prazo", 0.3)):
        score = F.when(F.col(mine) != F.col(theirs), score * times).otherwise(score)
    top = Window.partitionBy("keyword", "hints").orderBy(F.col("score").desc(), "codigo")
    pairs = pairs.withColumn("score", balanced(score, F.col("lado"), "q_saldo" in hints)).withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= limit).select("keyword", "hints", "codigo", "descricao", "score")
    return words.select("query", *hints, "keyword", "hints").join(pairs, ["keyword", "hints"]).select("query", *hints, "codigo", "descricao", "score")


def with_heuristics(best: Column, more: Column, saldo: bool) -> Column:
    """Array of (low, kind, codigo, descricao, score), best first: the best match, and the keyword candidates but for its own account. Only these have been cut for clashes; the match is from adjusted()."""
    one = balanced(best["score"] / 100, best["lado"], saldo)
    first = F.struct((-one).alias("low"), F.lit(0).alias("kind"), best["codigo"].alias("codigo"), best["descricao"].alias("descricao"), F.when(one == best["score"] / 100, best["score"]).otherwise(one * 100).alias("score"))
    return F.array_sort(F.concat(F.array(first), F.filter(more, lambda x: x["codigo"] != best["codigo"])))


def synonym_map(entries: DataFrame) -> DataFrame:
    """kind, key, value of entries (kind, lang, place, key, value): one for each kind and normal key.

    Entries without a language win, the last of them by place; of those with
    one, the first. Phrases are resolved where values are keys themselves.
    """
    one = entries.withColumn("key", text.normalized(F.col("key"))).filter("key <> ''")
    base = F.col("lang").isNull()
    first = F.min_by("value", F.struct((~base).alias("other"), F.when(base, -F.col("place")).otherwise(F.col("place")).alias("place")))
    found = one.groupBy("kind", "key").agg(first.alias("value"))
    phrases = resolved_chains(found.filter("kind = 'phrase'").select("key", "value", F.lit(0).alias("priority")))
    return found.filter("kind <> 'phrase'").unionByName(phrases.select(F.lit("phrase").alias("kind"), "key", "value"))


def resolved_chains(pairs: DataFrame, hops: int = 5) -> DataFrame:
    """key, value of synonyms (key, value, priority): the first by priority, followed hops times while the value is a key.

    Where a chain comes back to what it has met, it ends there; so a key on a
    circle stays itself. The way is found by doubling: a join appends to each
    way that of its end, so that hops cost their binary digits in joins.
    """
    ways = pairs.groupBy("key").agg(F.min_by("value", "priority").alias("value")).select("key", F.array("value").alias("way"))
    for _ in range(hops.bit_length()):
        more = ways.select(F.col("key").alias("end"), F.col("way").alias("more"))
        ways = ways.withColumn("end", F.element_at("way", -1)).join(more, "end", "left").select("key", F.concat("way", F.coalesce("more", F.array().cast("array<string>"))).alias("way"))
    way = F.slice("way", 1, hops + 1)
    met = F.filter(way, lambda x, i: (x == F.col("key")) | F.array_contains(F.slice(way, F.lit(1), i), x))
    return ways.select("key", F.coalesce(F.get(met, F.lit(0)), F.element_at(way, -1)).alias("value"))


def humanized(warnings: DataFrame, rules: DataFrame) -> DataFrame:
    """id, phrases: for each warning (id, warning) the phrase of the first rule (rule_no, pattern, phrase) that it holds, each once."""
    met = warnings.join(rules, F.contains(F.lower("warning"), F.col("pattern"))).groupBy("id", "warning").agg(F.min_by("phrase", "rule_no").alias("phrase"))
    return met.groupBy("id").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))


def without_decisions(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Decisions but for those of the given keys."""
    return decisions.join(keys.select("key").distinct(), "key", "left_anti")


def decision_statistics(decisions: DataFrame) -> DataFrame:
    """One row: decisions, manual ones, and codes that they name."""
    return decisions.agg(F.count(F.lit(1)).alias("decisions"), F.count_if("manual").alias("manual"), F.count_distinct("codigo").alias("codes"))


def low_confidence(matched: DataFrame, by: list[str], accept: float = 85.0) -> DataFrame:
    """by, low, matched: how many of the matched rows (score, codigo) have a score below accept."""
    hit = F.col("codigo").isNotNull()
    return matched.groupBy(*by).agg(F.count_if(hit & (F.col("score") < accept)).alias("low"), F.count_if(hit).alias("matched"))
