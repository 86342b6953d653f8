"""Words of texts as numbers, for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, dictionary-coded, and where each text's words begin; one more entry than texts."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy() > 0
    at = parts.offsets.to_numpy()
    return flat.filter(pa.array(full)).dictionary_encode(), np.r_[0, np.cumsum(full)][at - at[0]]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (for lower, with A-Z in lower case), and where each text's words begin."""
    coded, at = word_arrays(texts)
    # Arrow's ascii_lower garbles sliced arrays; the distinct words are a whole one, and fewer.
    names = np.array((pc.ascii_lower(coded.dictionary) if lower else coded.dictionary).to_pylist(), object)
    hashed = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, U)
    return hashed[coded.indices.to_numpy()], at


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words, or of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, U)
    for j in range(size):
        h = mix(h ^ words[j : j + n]) + U(j)
    return h
