import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerweave.llm.base import tokenizer_path
from ledgerweave.llm.packing import WordIds, fill, pack, pack_tokens

PATH = tokenizer_path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t's<|>aÉ́"))), max_size=4))
def test_words_encode_as_whole_texts(texts):
    import pyarrow as pa

    texts = [*texts, "a <|endoftext|>b don't É", "", "  x  "]
    ids, at = WordIds(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts]


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(1, 60))
def test_fill_is_closest(lengths, room):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    got = fill(sorted(counts, reverse=True), dict(counts), room)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)


def test_pack_leaves_little():
    rng = np.random.default_rng(0)
    lengths = np.r_[rng.integers(1, 3000, 1000), rng.integers(1, 800, 1000), np.repeat(2 ** np.arange(11), 20)]
    window, offset = pack(lengths, 4096)
    total = np.bincount(window, lengths)
    assert total.max() <= 4096 and sum(4096 - n for n in total.astype(int) if n & (n - 1)) < 4096 and (total < 4096).sum() < 20
    for w in range(window.max() + 1):
        m = np.flatnonzero(window == w)
        m = m[np.argsort(offset[m])]
        assert (offset[m] == np.cumsum(lengths[m]) - lengths[m]).all()


def test_pieces_cover_documents(spark):
    rows = [(i, f"word {i} " * (i * 7 % 90), 0) for i in range(300)] + [(900, None, 0), (901, "", 0), (None, "a b", 0), (902, "many words " * 6000, 0), (5, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = pack_tokens(docs, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t, _ in rows:
        ids = np.array([*ids_of(t or ""), 2], "<u4")
        pieces = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert pack_tokens(docs.limit(0), PATH).count() == 0
