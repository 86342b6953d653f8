import random
import zlib

import pytest

from ledgerweave.llm.toxicity import WINDOWS, fit, grams, toxicity, windows


def make(n, seed):
    rng = random.Random(seed)
    words = ["ter", "ona", "the", "ith", "eran", "sto", "ling", "moen", "ra", "tisa"]
    out = []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(words) for _ in range(rng.randint(20, 150))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(1 + len(text) // 25):
                text.insert(rng.randrange(len(text)), rng.choice(["zqyxv", "wkjgub", "hhqpfdz"]))
        out.append((i, " ".join(text), toxic))
    return out


def test_windows_cover_the_text():
    text = b"ab  cde f " * 50 + b"x" * 400
    assert b"".join(windows(text, 64)) == text and windows(b"", 64) == []
    assert (grams(b"abcd e") == 0).tolist() == [False, True, True]


def test_held_out_accuracy(spark):
    rows = make(900, 1)
    extra = [(5000, None, 0), (5001, "", 1), (5001, "", 1), (None, "zqyxv wkjgub", None), (5002, "eran the " * 20000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + extra], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 100
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, labels).collect()] == [0.0]
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert fit([]) is None


def test_columns_to_keep(spark):
    rows = make(60, 2)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity(docs, labels, keep=["text", "lang"]).columns == ["doc_id", "held_out", "score", "predicted", "text", "lang"]
    with pytest.raises(ValueError, match="score"):
        toxicity(docs, labels, keep=["score"])


def test_marks_come_from_trained_dictionaries():
    """The toxic dictionary holds the words that mark toxic texts, the ordinary one does not."""
    model = fit([(t.encode(), y) for _, t, y in make(900, 3)])
    assert all(w in model.toxic for w in (b"zqyxv", b"wkjgub", b"hhqpfdz")) and not any(w in model.ordinary for w in (b"zqyxv", b"wkjgub", b"hhqpfdz"))
    assert len(model.marks) == len(WINDOWS) and all(m >= 1 for m in model.marks)
