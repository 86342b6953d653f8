import numpy as np
import pyarrow as pa

from ledgerweave.llm.words import shingle_hashes, word_hashes


def test_slices_give_what_whole_arrays_give():
    texts = ["É Été  Über", "", " a\tB\n", "x" * 3000 + " É", "Ñ ß ABC abc"] * 50
    for lower in (False, True):
        whole, at = word_hashes(pa.array(texts), lower)
        for start in (0, 1, 7, 133):
            part, own = word_hashes(pa.array(texts).slice(start, 60), lower)
            assert (part == whole[at[start] : at[start + 60]]).all() and (own == at[start : start + 61] - at[start]).all()
    h, _ = word_hashes(pa.array(["ABC abc É é"]), True)
    assert h[0] == h[1] and h[2] != h[3]


def test_shingles():
    w = np.arange(1, 6, dtype=np.uint64)
    assert [len(shingle_hashes(w, n)) for n in (1, 2, 5, 9)] == [5, 4, 1, 1] and len(shingle_hashes(w[:0], 2)) == 0
