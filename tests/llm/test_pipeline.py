import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from ledgerweave.llm.mixing import mix_sources
from ledgerweave.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [a + b for a in ("ter", "ona", "the", "ith", "eran", "sto") for b in ("ling", "moen", "ra", "tisa", "en")]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 14)))
    shared = [line() for _ in range(6)]
    docs, labels = [], []
    for i in range(260):
        text = [rng.choice(shared) if rng.random() < 0.1 else line() for _ in range(rng.randint(1, 6))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            text = [x + " zqyxv wkjgub" for x in text]
        elif docs and rng.random() < 0.2:
            text = rng.choice([d for d in docs if "zqyxv" not in d[1]])[1].split("\n")
            text[0] += " more"
        docs.append((i, "\n".join(text), "en", f"s{i % 4}" if i % 9 else None, 1))
        labels.append((i, 1, toxic))
    docs += [(900, None, "en", "s1", 0), (901, "", None, "s2", 0), (902, docs[3][1], "en", "s1", 5)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        ids = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
            assert 20 < len(rejected) < 100 and ids == Counter(i for i, _ in before if i not in rejected)
        elif name == "line dedup":
            want = {i: (n, gone) for i, n, gone, _ in brute_lines(before, 2, 20)}
            text = dict(before)
            assert len(rows) == len(before)
            for r in rows:
                n, gone = want[r.doc_id]
                assert (r.text is None) == (text[r.doc_id] is None)
                assert r.text is None or (len(r.text.split("\n")) if gone < n else 0) == (n - gone)
        elif name == "near-duplicates":
            assert sorted(ids.elements()) == sorted(i for i, _, _, kept in brute_near(before, 5) if kept)
        elif name == "mixing":
            taken = {r.doc_id: r.taken / r.size for r in mix_sources(docs).collect() if r.size}
            assert ids == Counter({i: int(x + 0.5) for i, x in taken.items() if x >= 0.5})
        else:
            total = defaultdict(int)
            for r in rows:
                total[r.doc_id] += r.length
            tokens = {r.doc_id: r.doc_tokens for r in rows}
            assert total == {i: n * tokens[i] for i, n in Counter(i for i, _ in before).items()}
        docs = out


def test_run_is_the_stages_in_turn(spark, sf_dir):
    once, again = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert once == again and once


def test_stages_on_awkward_tables(spark, sf_dir):
    """Nulls in all columns, repeated ids and rows; and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = "one two three four five six seven"
    odd = spark.createDataFrame([(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, None, "s", 1), (2, a, "en", None, 1), (None, None, None, None, None), (None, a + " x y", "en", "s", 2)], docs.schema)
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = stage(spark, odd, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert len(rows["toxicity"]) == 6 and len(rows["line dedup"]) == 6
    assert sorted(str(r.doc_id) for r in rows["near-duplicates"]) == ["1", "None", "None"] or sorted(str(r.doc_id) for r in rows["near-duplicates"]) == ["1", "None"]
    assert len([r for r in rows["near-duplicates"] if r.text == a]) == 1
    assert sum(r.length for r in rows["packing"] if r.doc_id is None) > 1
