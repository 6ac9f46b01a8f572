"""Language identification with a blended-spectrum n-gram presence kernel.

K(x, y) = shared distinct byte n-grams (n = 1..3, hashed to BINS) / sqrt(|x| |y|). Nystrom landmarks m
give features phi(x) = K(x, m) K(m, m)^-1/2, one ridge regression a language is fitted on them, and
texts are scored in batches. K(x, m) = P(x) P(m)^T / norms, so P(m)^T, the whitening and the ridge weights are
multiplied once on the driver; a batch of texts then is one product P(x) W, BINS by languages, and costs
nothing per landmark.

The classifier is fitted on a bounded sample: PER_LANG documents of each language (lowest hash of the id) of
the learning folds whose text has 1 to MAX_BYTES bytes. Scoring covers every whole text.

Cases: a null text, an empty one and one without any Unicode letter get `und` and score 0; rows with null lang are never
learned from; repeated rows get one row each; an empty table gives no rows; without any labelled row
all texts get `und`; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, small_batches, table

FOLDS, HELD_OUT = 4, 2
BINS = 1 << 15
PER_LANG, LANDMARKS, MAX_BYTES, RIDGE = 400, 96, 20_000, 1e-2
_LUT = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 float32 matrix texts x BINS of the hashed byte n-grams of each text. data: uint8; offsets: len + 1."""
    n_texts, n = len(offsets) - 1, len(data)
    out = np.zeros((n_texts, BINS), dtype=np.bool_)
    if n == 0:
        return out
    low = _LUT[data]
    # Capital letters of the Latin-1 block in UTF-8: C3 80..9E, but for the times sign.
    lead = np.zeros(n, dtype=bool)
    lead[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[lead] += 0x20
    c = low.astype(np.uint32)
    row = np.repeat(np.arange(n_texts, dtype=np.int64) * BINS, np.diff(offsets))
    flat = out.reshape(-1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    flat[row + c] = True
    two = c[:-1] * np.uint32(256) + c[1:]
    ok = at[:-1] + 2 <= end[:-1]
    flat[(row[:-1] + ((two * np.uint32(2654435761)) >> np.uint32(17)))[ok]] = True
    if n > 2:
        three = two[:-1] * np.uint32(256) + c[2:]
        ok = at[:-2] + 3 <= end[:-2]
        flat[(row[:-2] + (((three ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(17)))[ok]] = True
    return out


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    large = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class KernelModel:
    """langs: sorted values; weights: BINS x langs, the product of landmarks, whitening and ridge weights; bias: per language."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One-versus-rest values, texts x langs, in runs of texts of bounded bytes."""
        out, i, n = [], 0, len(offsets) - 1
        while i < n:
            j = min(n, i + 128, max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1))
            p = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            norm = np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]
            out.append(p.astype(np.float32) @ self.weights / norm + self.bias)
            i = j
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def _normed(texts: list[bytes], run: int = 64) -> Iterator[np.ndarray]:
    """Presence rows of length 1, a few texts at a time: the whole sample's would fill the driver."""
    for i in range(0, len(texts), run):
        part = texts[i : i + run]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64)
        p = presence(np.frombuffer(b"".join(part), dtype=np.uint8), offsets).astype(np.float32)
        yield p / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]


def train(texts: list[bytes], langs: list[str]) -> KernelModel:
    """Nystrom landmarks are spread over the languages in turn; ridge regression of +1/-1 on the features."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    turn = np.argsort(np.array([np.sum(y[:i] == y[i]) for i in range(len(y))]), kind="stable")
    marks = np.concatenate([m for m in _normed([texts[k] for k in turn[:LANDMARKS]])])
    kmm = (marks @ marks.T).astype(np.float64)
    val, vec = np.linalg.eigh(kmm)
    white = vec / np.sqrt(np.maximum(val, 1e-6))
    phi = np.concatenate([m @ marks.T for m in _normed(texts)]).astype(np.float64) @ white
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    mean, t_mean = phi.mean(axis=0), target.mean(axis=0)
    a = phi - mean
    ridge = np.linalg.solve(a.T @ a + RIDGE * len(texts) * np.eye(a.shape[1]) * 1e-2, a.T @ (target - t_mean))
    weights = marks.T.astype(np.float64) @ (white @ ridge)
    return KernelModel(names, weights.astype(np.float32), (t_mean - mean @ ridge).astype(np.float32))


def fit(docs: DataFrame) -> KernelModel | None:
    """Model of the learning folds of docs (doc_id, text, lang); None without labelled texts."""
    size = F.octet_length("text")
    usable = docs.where((fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & size.between(1, MAX_BYTES))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANG)
    picked = [r[0] for r in ids.select("doc_id").distinct().collect()]
    rows = usable.where(F.col("doc_id").isin(picked)).select(F.col("text").cast("binary"), "lang", "doc_id").collect() if picked else []
    rows = sorted(rows, key=lambda r: (r.doc_id, r.lang, bytes(r.text)))
    return train([bytes(r.text) for r in rows], [r.lang for r in rows]) if rows else None


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    low = data | 0x20
    total = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    found = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
        found[k] = any(c.isalpha() for c in text)
    return found


def identify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score; all columns of docs stay."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast(model)  # BINS x languages floats: half a megabyte for four languages
    kept = docs.drop(*out)
    at = kept.columns.index(text_col)
    names = [*kept.columns, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, *predict(held.value, cols[at])], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return kept.mapInArrow(run, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_ids(docs, fit(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def identify_ids(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, lang_pred, score): the text goes to the workers once and does not come back."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = predict(held.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pred, score], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predict(model: KernelModel | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Language and score of each text of a column."""
    n = len(texts)
    pred, score = np.full(n, "und", dtype=object), np.zeros(n)
    if model is not None and n:
        data, offsets = _buffers(texts)
        has, s = _has_letter(data, offsets), model.scores(data, offsets)
        pred[has] = np.array(model.langs, dtype=object)[s.argmax(axis=1)[has]]
        score[has] = np.clip((s.max(axis=1)[has] + 1) / 2, 0, 1)
    return pa.array(pred, pa.string()), pa.array(score.astype(np.float64))
