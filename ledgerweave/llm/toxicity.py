"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one
on stretches of toxic text that ordinary text hardly has (byte 4-grams that
come in many toxic and few ordinary documents, joined where they are near each
other). Toxic texts are ordinary for the most part, so their compressor gets
both dictionaries, the ordinary one nearest. A document is cut into windows at
white space; the two compressed lengths of each are compared, and a saving
above a threshold, calibrated on ordinary text, marks a window as toxic.
Logistic calibration turns savings and marks into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4
TABLE = 1 << 22
#: Window sizes in bytes; each gives a document one group of features.
WINDOWS = (48, 160)
LEVEL = 6
#: Sizes of the dictionaries, and bytes of context around a toxic stretch.
ORDINARY, TOXIC, AROUND = 8192, 2048, 4


def windows(text: bytes, size: int) -> list[bytes]:
    """The whole text in windows of size bytes, prolonged to the next space if it is near."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        space = text.find(b" ", end, end + 32)
        end = space if space >= 0 else end
        out.append(text[at:end])
        at = end
    return out


def grams(text: bytes) -> np.ndarray:
    """Numbers of the byte 4-grams of a text; 0 for those with white space in them."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(a) - GRAM + 1)
    key, bare = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(GRAM):
        key = key * 257 + a[i : i + n]
        bare &= a[i : i + n] > 32
    return np.where(bare, key % (TABLE - 1) + 1, 0)


def stretches(toxic: list[bytes], ordinary: list[bytes], least: int = 8, ratio: float = 12.0) -> list[bytes]:
    """Stretches of toxic texts whose 4-grams hardly occur in ordinary ones, each as often as it occurs."""
    seen = []
    for texts in (toxic, ordinary):
        count = np.zeros(TABLE, np.int32)
        for t in texts:
            count[np.unique(grams(t))] += 1
        seen.append(count)
    rate = ((seen[0] + 0.5) / (len(toxic) + 1)) / ((seen[1] + 0.5) / (len(ordinary) + 1))
    chosen = (rate > ratio) & (seen[0] >= min(least, max(2, len(toxic) // 20)))
    chosen[0] = False
    out = []
    for t in toxic:
        at = np.flatnonzero(chosen[grams(t)])
        if len(at):
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1 + AROUND) + 1):
                out.append(t[max(0, run[0] - AROUND) : run[-1] + GRAM + AROUND])
    return out


def dictionary(samples: list[bytes], size: int, segment: int, mer: int) -> bytes:
    """A dictionary trained on samples; where these are too few to train on, their end."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=mer).as_bytes()
    except zstd.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    """Dictionaries, the saving that marks a window of each size, and weights for the features that they give."""

    ordinary: bytes
    toxic: bytes
    marks: Sequence[float] = (1.0,) * len(WINDOWS)
    weights: Sequence[float] = ()

    def compressors(self) -> list[tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]]:
        def one(content: bytes, size: int) -> zstd.ZstdCompressor:
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=size, dict_size=len(content), write_content_size=False, write_dict_id=False)
            return zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))

        return [(one(self.ordinary, n), one(self.toxic + self.ordinary, n)) for n in WINDOWS]

    @staticmethod
    def savings(text: bytes, tools: list) -> list[np.ndarray]:
        """For each window size, by how many bytes the toxic dictionary makes each window shorter."""
        return [np.sort([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text, size)] or [0]) for (plain, toxic), size in zip(tools, WINDOWS, strict=True)]

    def features(self, savings: list[np.ndarray], length: int) -> list[float]:
        out = []
        for saved, least in zip(savings, self.marks, strict=True):
            marked = saved >= least
            out += [saved.mean(), saved[-3:].mean(), marked.mean(), np.log1p(marked.sum())]
        return [*out, np.log1p(length), 1.0]

    def scores(self, texts: list[bytes], tools: list) -> np.ndarray:
        x = np.array([self.features(self.savings(t, tools), len(t)) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression; the last column of x is constant."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    middle[-1], spread[-1] = 0, 1
    z = (x - middle) / spread
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(w)), z.T @ (y - p) - w)
    weights = w / spread
    weights[-1] -= (w[:-1] * middle[:-1] / spread[:-1]).sum()
    return weights


def fit(rows: list[tuple[bytes, int]]) -> Model | None:
    """A model from labelled texts; None if a class has no text.

    Dictionaries come from two thirds of the rows, thresholds and weights from
    the rest, so that these see texts as new as any later one.
    """
    parts = [[(t, y) for i, (t, y) in enumerate(rows) if i % 3 != 2], [(t, y) for i, (t, y) in enumerate(rows) if i % 3 == 2]]
    toxic, ordinary = ([t for t, y in parts[0] if y == k and t] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    model = Model(dictionary([w for t in ordinary for w in windows(t, 512)], ORDINARY, 64, 6), dictionary(stretches(toxic, ordinary), TOXIC, 16, 8))
    held = parts[1] if len({y for _, y in parts[1]}) == 2 else parts[0]
    tools = model.compressors()
    savings, y = [model.savings(t, tools) for t, _ in held], np.array([y for _, y in held], float)
    model.marks = [float(max(1, 1 + np.quantile(np.concatenate([s[i] for s, k in zip(savings, y, strict=True) if k == 0]), 0.99))) for i in range(len(WINDOWS))]
    model.weights = logistic(np.array([model.features(s, len(t)) for s, (t, _) in zip(savings, held, strict=True)]), y).tolist()
    return model


def held_out(id_col: str):
    """Rows that never serve for learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1800, ordinary_rows: int = 3600, longest: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learn from at most so many labelled rows of each class, in the order of a hash of the id, with texts of at most longest bytes.

    The sample, at most (toxic_rows + ordinary_rows) * longest bytes, goes to
    one task, which fits the model; the driver gets the dictionaries and
    weights only.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col("toxic").alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = [usable.filter(F.col("__y") == y).orderBy(*order).limit(n) for y, n in ((1, toxic_rows), (0, ordinary_rows))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the parameters
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).filter(F.octet_length("__t") <= longest)
    rows = texts.join(sample, "__id").select(F.col("__id").cast("string").alias("id"), F.col("__t").alias("text"), F.col("__y").cast("int").alias("y"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(zlib.crc32(r["id"].encode()), r["id"], r["text"].encode(), r["y"]) for b in batches for r in b.to_pylist()}
        model = fit([(t, y) for _, _, t, y in sorted(found)])
        if model:
            n = [sum(r[3] == y for r in found) for y in (0, 1)]
            yield pa.RecordBatch.from_pydict({"ordinary": [model.ordinary], "toxic": [model.toxic], "marks": [list(model.marks)], "weights": [list(model.weights)], "n": pa.array([n], pa.list_(pa.int64()))})

    learnt = rows.repartition(1).mapInArrow(learn, "ordinary binary, toxic binary, marks array<double>, weights array<double>, n array<long>").first()
    if not learnt:
        return None
    model = Model(bytes(learnt["ordinary"]), bytes(learnt["toxic"]), learnt["marks"], learnt["weights"])
    # The sample's classes are not as frequent as the table's.
    n = dict(usable.groupBy(F.col("__y").cast("int")).count().collect())
    model.weights[-1] += float(np.log(n[1] / n[0] * learnt["n"][0] / learnt["n"][1]))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), **bounds: int) -> DataFrame:
    """A row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.5), and the columns in keep.

    Scores read whole texts and nothing else; a null text counts as empty
    and gets the score of an empty text. Null ids are not held out. Labels
    other than 0 and 1 are not learnt from; if one class has no text to learn
    from, all scores are 0. Repeated rows each get a row, an empty table gives
    none; columns other than id, text and those in keep are not read, and
    columns in keep must not be named like an output column.
    """
    if clash := {id_col, "held_out", "score", "predicted"} & set(keep):
        raise ValueError(f"columns to keep are named like output columns: {sorted(clash)}")
    model = train(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors() if model else []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                s = model.scores(part.column(2).cast(pa.binary()).to_pylist(), tools) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *part.columns[3:]], names=[id_col, "held_out", "score", "predicted", *keep])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), *keep)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int{kept}")
