from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerweave.llm.base import tokenizer_path
from ledgerweave.llm.token_counts import WHITE, Counter, pieces_of, token_counts

PATH = tokenizer_path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
COUNTER = Counter(PATH)
ODD = ["", " ", "a\x0bb", "  \n x", "it's I'LL don't", "x" * 300, "aaa aaaa aaaaa", "a<|endoftext|> b<|endoftext|>", "a\x1c b", "é 　  w", "12345 67", "!?! ...", "\r\n\r\n  a", "😀😀 👍🏽", "a\xa0b \xa0 c", "​ x"]


def expected(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    assert COUNTER.count(ODD).tolist() == expected(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stae" + WHITE.replace("-", "")))), max_size=5))
def test_any_text(texts):
    assert COUNTER.count(texts).tolist() == expected(texts)


def test_long_texts_are_cut_where_nothing_changes():
    text = "word  and\n more's " * 500
    assert "".join(pieces_of(text, 100)) == text
    assert sum(sum(COUNTER.count([p])) for p in pieces_of(text, 100)) == expected([text])[0]


def test_query_shape(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (2, None, 5), (None, "", 5), (3, "é" * 3000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, PATH, limit=100).collect()), key=str)
    n = expected(["é" * 3000])[0]
    assert got == sorted([(1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (None, 0, 0, False), (3, 6000, n, n > 100)], key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0
