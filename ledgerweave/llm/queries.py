"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.base import table, tokenizer_path
from ledgerweave.llm.chat_format import chained, conversation_report, formatted_paths
from ledgerweave.llm.collocations import collocations
from ledgerweave.llm.exact_dedup import exact_dedup
from ledgerweave.llm.html_extract import extract_text
from ledgerweave.llm.lexical_search import lexical_search
from ledgerweave.llm.line_dedup import line_report
from ledgerweave.llm.minhash import near_duplicates
from ledgerweave.llm.mixing import mix_sources
from ledgerweave.llm.packing import pack_tokens
from ledgerweave.llm.substring_dedup import substring_dedup
from ledgerweave.llm.token_counts import token_counts
from ledgerweave.llm.topk import top_k
from ledgerweave.llm.toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumn("first_slot", F.coalesce("first_slot", F.lit(-1).cast("long")))  # documents that the mix doesn't take


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    given = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], rows.schema)
    return conversation_report(formatted_paths(chained(rows.union(given)))).drop("leaf")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_substring_dedup, op4_exact_dedup, op5_packing, op6_minhash, op7_toxicity, op8_html_extract, op9_top_k, op10_mixing, op11_collocations, op12_chat_format, op13_lexical_search, pipeline)}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h),
s AS (SELECT doc_id, list(DISTINCT i) AS starts FROM h JOIN m USING (h) WHERE doc_id > low GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: generate_series(i, i + 49)))) AS gone FROM s),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON r.doc_id = u.a WHERE r.c < u.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM m JOIN n USING (doc_id)
"""

OP9_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
v AS (SELECT arg_min(lv, cap / w) AS level FROM l WHERE lv <= cap / w),
t AS (SELECT source, r, source_size, least(cap, coalesce(level * w, cap)) AS target FROM l, v),
p AS (SELECT d.*, r, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id) AS BIGINT) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT r, source_size, target, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(source_size / 1024.0) AS BIGINT) AS nb, sum(target) OVER () AS total, max(r) OVER () AS last FROM t WHERE target > 0),
g AS (SELECT *, (goal // source_size) * nb + CAST(ceil((goal % source_size) / 1024.0) AS BIGINT) AS need, CAST(ceil(total / 1024.0) AS BIGINT) AS slots, CASE WHEN r = last THEN 1.0::DOUBLE ELSE sum(target) OVER (ORDER BY r) / total END AS high FROM q),
e AS (SELECT *, coalesce(lag(high) OVER (ORDER BY r), 0.0::DOUBLE) AS low FROM g),
k AS (SELECT slot, slot::DOUBLE * '0.6180339887498949'::DOUBLE - floor(slot::DOUBLE * '0.6180339887498949'::DOUBLE) AS u FROM (SELECT unnest(range(0, (SELECT max(slots) FROM e))) AS slot)),
m AS (SELECT slot, r, row_number() OVER (PARTITION BY r ORDER BY slot) - 1 AS nth FROM k JOIN e ON u >= low AND u < high),
h AS (SELECT r, count(*) AS n FROM m GROUP BY r),
a AS (SELECT slot, r, nth FROM m JOIN e USING (r) WHERE nth < need UNION ALL SELECT slots + row_number() OVER (ORDER BY nth, r) - 1, r, nth FROM (SELECT r, slots, unnest(generate_series(least(coalesce(n, 0), need), need - 1)) AS nth FROM e LEFT JOIN h USING (r))),
u AS (SELECT slot, r, nth % nb AS block, least(1024, source_size - (nth % nb) * 1024, goal - (nth // nb) * source_size - (nth % nb) * 1024) AS words FROM a JOIN e USING (r)),
x AS (SELECT doc_id, r, start, size, unnest(generate_series(start // 1024, (start + size - 1) // 1024)) AS block FROM p WHERE size > 0),
f AS (SELECT doc_id, min(slot) AS first_slot FROM x JOIN u USING (r, block) WHERE least(start + size - block * 1024, words) > greatest(start - block * 1024, 0) GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CAST(greatest(least(start + size, round(target)) - start, 0) + greatest(least(start + size, round(target) - source_size) - start, 0) AS BIGINT) AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM p LEFT JOIN f USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i : i + k - 1] AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1 : cut] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[cut + 1 : c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT lang, phrase[i : i + m - 1] AS phrase, a FROM (SELECT lang, k, phrase, f AS a, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
h AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
r AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place, length(role) + len(regexp_extract_all(role, '<\\*\|')) AS role_chars, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
  CAST(sum(role_chars + text_chars + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
p AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_minhash": OP6_SQL, "op9_top_k": OP9_SQL, "op10_mixing": OP10_SQL, "op11_collocations": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_lexical_search": OP13_SQL}
