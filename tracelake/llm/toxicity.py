"""Toxicity by a convolutional text classifier.

Words (A-Z lower-cased, ASCII punctuation stripped from both ends) and their prefixes of PREFIXES letters are units, known by
their crc32. The UNITS units whose shrunk log-odds of the classes are largest in the sample have an embedding; a word takes that of
its most telling unit, so that inflected and new forms of a stem count, and all other words share one. Filters of WIDTHS words run
over the whole text, each filter's maximum feeds a logistic output. Trained in numpy with Adam; the first dimension starts as the
unit's log-odds. The filters are linear in the embeddings, so for scoring their products with every embedding are tabled once and a
window's response is a sum of table rows.

Fitted on a bounded sample: the MAX_DOCS labelled documents of each class with the lowest hash of their id, from
the learning folds. A score is calibrated (Platt) on a part of the sample that the weights do not see. Thresholds by
language, for filtering, are chosen there too; lang picks a threshold and never enters a score.

Cases: null, empty and blank texts have a window of padding and get its score; unlabelled or null labels are not
learned from; a document with several labels counts once with the largest; repeated rows get a row each; an empty
table gives no rows; without both classes the score is the constant 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, small_batches, table

FOLDS, HELD_OUT = 5, 0
UNITS, DIM, WIDTHS, FILTERS, PREFIXES = 8192, 8, (1, 2, 3), 6, (4, 5, 6, 7)
ROWS = UNITS + 2
MAX_DOCS, MAX_BYTES, MIN_DOCS, EPOCHS, BATCH, SEED = 4000, 20_000, 3, 4, 32, 11
#: Of texts that a language's threshold flags, so many are toxic at least, as measured on the calibration part.
MIN_PRECISION = 0.9
PAD, RARE = 0, 1
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def units_of(word: bytes) -> list[int]:
    """Hashes of a word and of its prefixes; a prefix is marked, so that it differs from the word of the same letters."""
    w = word.strip(_STRIP)
    return [zlib.crc32(w), *[zlib.crc32(b"^" + w[:n]) for n in PREFIXES if len(w) > n]]


def row_of(word: bytes, known: dict[int, tuple[int, float]]) -> int:
    """Embedding of a word's most telling unit, the word itself first."""
    best, row = 0.0, RARE
    for h in units_of(word):
        found = known.get(h)
        if found and abs(found[1]) > best:
            row, best = found[0], abs(found[1])
    return row


def tokens_of(text: bytes, known: dict[int, tuple[int, float]], cache: dict[bytes, int]) -> np.ndarray:
    """Embedding row of each word; PAD alone for a text without words. cache: words seen, bounded by the caller."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, dtype=np.int32)
    got = list(map(cache.get, words))
    if None in got:
        for k, g in enumerate(got):
            if g is None:
                got[k] = cache[words[k]] = row_of(words[k], known)
    return np.array(got, dtype=np.int32)


def telling_units(texts: list[bytes], y: np.ndarray) -> dict[int, tuple[int, float]]:
    """For the UNITS most telling hashes of MIN_DOCS texts or more: row and log-odds that a toxic and another text hold it, shrunk."""
    seen: dict[int, list[int]] = {}
    for text, t in zip(texts, y):
        for h in {h for w in set(text.lower().split()) for h in units_of(w)}:
            seen.setdefault(h, [0, 0])[int(t)] += 1
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    odds = {h: (np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1))) * (a + b) / (a + b + 5) for h, (a, b) in seen.items() if a + b >= MIN_DOCS}
    top = sorted(odds, key=lambda h: (-abs(odds[h]), h))[:UNITS]
    return {h: (2 + k, float(odds[h])) for k, h in enumerate(top)}


class Net:
    """Embeddings e, filters w (one array a width: width * DIM x FILTERS), biases b, output u and v, Platt pair, thresholds."""

    def __init__(self, rng: np.random.Generator):
        self.e = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
        self.e[PAD] = 0
        self.w = [rng.normal(0, 0.3, (n * DIM, FILTERS)).astype(np.float32) for n in WIDTHS]
        self.b = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.u = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.v = np.float32(0)
        self.platt, self.thresholds, self.known = (1.0, 0.0), {}, {}

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place: the embeddings' products with that place's filters."""
        return [[self.e @ w[k * DIM : (k + 1) * DIM] for k in range(n)] for n, w in zip(WIDTHS, self.w)]

    @staticmethod
    def responses(tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (texts x filters) of concatenated padded texts, and all responses by width. starts: first token of each text."""
        best, each = [], []
        ends = np.append(starts[1:], len(ids))
        for parts in tables:
            n = len(parts)
            r = parts[0][ids[: len(ids) - n + 1]].copy()
            for k in range(1, n):
                r += parts[k][ids[k : len(ids) - n + 1 + k]]
            for k in range(1, n):  # windows that would reach into the next text
                r[ends[ends - k < len(r)] - k] = -np.inf
            each.append(r)
            best.append(np.maximum.reduceat(r, starts, axis=0))
        return np.concatenate(best, axis=1), each

    def logits(self, tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        best, _ = self.responses(tables, ids, starts)
        return np.maximum(best + np.concatenate(self.b), 0) @ self.u + self.v


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by the padding that keeps windows inside it; the starts."""
    pad = np.zeros(max(WIDTHS) - 1, dtype=np.int32)
    ids = np.concatenate([x for d in docs for x in (d, pad)])
    starts = np.cumsum([0, *[len(d) + len(pad) for d in docs[:-1]]])
    return ids, starts


def train(texts: list[bytes], y: np.ndarray, langs: list[str]) -> Net:
    """The last fifth of the shuffled sample calibrates, the rest trains."""
    rng = np.random.default_rng(SEED)
    net, order = Net(rng), rng.permutation(len(texts))
    cut = max(1, len(texts) * 4 // 5)
    fit, cal = order[:cut], order[cut:]
    net.known = telling_units([texts[k] for k in fit], y[fit])
    cache: dict[bytes, int] = {}
    docs = [tokens_of(t, net.known, cache) for t in texts]
    net.e[:, 0] = 0
    for row, odds in net.known.values():
        net.e[row, 0] = odds
    for k, n in enumerate(WIDTHS):
        net.w[k][:, 0] = 0
        net.w[k][0 :: DIM, 0] = 1 / n
        net.u[k * FILTERS] = 0.5
    params = [net.e, *net.w, *net.b, net.u]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    nw = len(WIDTHS)
    for _ in range(EPOCHS):
        for i in range(0, len(fit), BATCH):
            rows = fit[i : i + BATCH]
            ids, starts = joined([docs[k] for k in rows])
            ends = np.append(starts[1:], len(ids))
            best, each = net.responses(net_tables_small(net, ids), np.arange(len(ids)), starts)
            h = np.maximum(best + np.concatenate(net.b), 0)
            p = 1 / (1 + np.exp(-(h @ net.u + net.v)))
            d = ((p - y[rows]) / len(rows)).astype(np.float32)
            grads: list[np.ndarray] = [np.zeros_like(net.e), *[np.zeros_like(w) for w in net.w], *[np.zeros_like(b) for b in net.b], h.T @ d]
            dh = (d[:, None] * net.u[None, :]) * (h > 0)
            for k, n in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                top = np.stack([each[k][a : b if b <= len(each[k]) else len(each[k])].argmax(axis=0) + a for a, b in zip(starts, ends)])
                grads[1 + nw + k] += g.sum(axis=0)
                for place in range(n):
                    at = ids[np.minimum(top + place, len(ids) - 1)]
                    w = net.w[k][place * DIM : (place + 1) * DIM]
                    grads[1 + k][place * DIM : (place + 1) * DIM] += np.einsum("tfd,tf->df", net.e[at], g)
                    np.add.at(grads[0], at.reshape(-1), (g[:, :, None] * w.T[None, :, :]).reshape(-1, DIM))
            grads[0][PAD] = 0
            step += 1
            net.v -= np.float32(0.05) * d.sum()
            live = np.flatnonzero(np.abs(grads[0]).sum(axis=1))
            for j, (q, g) in enumerate(zip(params, grads)):
                at = live if j == 0 else slice(None)
                m1[j][at] = 0.9 * m1[j][at] + 0.1 * g[at]
                m2[j][at] = 0.99 * m2[j][at] + 0.01 * g[at] ** 2
                q[at] -= 0.01 * m1[j][at] / (np.sqrt(m2[j][at]) + 1e-4)
    ids, starts = joined([docs[k] for k in (cal if len(cal) else fit)])
    z, t = net.logits(net.tables(), ids, starts).astype(np.float64), y[cal if len(cal) else fit]
    net.platt = platt(z, t)
    calibrate_by_language(net, z, t, [langs[k] for k in (cal if len(cal) else fit)])
    return net


def net_tables_small(net: Net, ids: np.ndarray) -> list[list[np.ndarray]]:
    """Products for the tokens of a batch only, by position."""
    x = net.e[ids]
    return [[x @ w[k * DIM : (k + 1) * DIM] for k in range(n)] for n, w in zip(WIDTHS, net.w)]


def platt(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton steps that never raise the loss."""
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    mean, scale = z.mean(), z.std() + 1e-6
    m, w = np.stack(((z - mean) / scale, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    loss = lambda v: np.logaddexp(0, m @ v).sum() - (target * (m @ v)).sum() + 0.01 * v @ v
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        hess = (m * (p * (1 - p))[:, None]).T @ m + 0.02 * np.eye(2)
        move, rate = np.linalg.solve(hess, m.T @ (p - target) + 0.02 * w), 1.0
        while rate > 1e-4 and loss(w - rate * move) > loss(w):
            rate /= 2
        w = w - rate * move
    slope = max(w[0] / scale, 1e-3)
    return float(slope), float(w[1] - slope * mean)


def calibrate_by_language(net: Net, z: np.ndarray, t: np.ndarray, langs: list[str]) -> None:
    a, b = net.platt
    p, names = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60))), np.array([str(x) for x in langs])
    for lang in sorted({str(x) for x in langs}):
        own = names == lang
        order = np.argsort(-p[own])
        ok = np.flatnonzero(np.cumsum(t[own][order]) / np.arange(1, own.sum() + 1) >= MIN_PRECISION)
        net.thresholds[lang] = float(min(max(p[own][order][ok[-1]], 0.05), 0.95)) if len(ok) else 0.5


def fit(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Net of the labelled documents of the learning folds; None without both classes."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    known = docs.where(F.octet_length("text") <= MAX_BYTES).select("doc_id").join(y, "doc_id").distinct()
    ids = known.withColumn("h", F.xxhash64("doc_id")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_DOCS)
    picked = {r.doc_id: r.toxic for r in ids.select("doc_id", "toxic").collect()}
    if len({bool(v) for v in picked.values()}) < 2:
        return None
    rows = docs.where(F.col("doc_id").isin(list(picked)) & (F.octet_length("text") <= MAX_BYTES)).select("doc_id", F.col("text").cast("binary"), "lang").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.text)))
    return train([bytes(r.text) for r in rows], np.array([float(bool(picked[r.doc_id])) for r in rows]), [r.lang for r in rows])


def score(net: Net | None, texts: list[bytes], tables, cache: dict[bytes, int]) -> np.ndarray:
    """Probability of the toxic class of each text."""
    if net is None:
        return np.zeros(len(texts))
    out, docs, size = [], [], 0
    for k, t in enumerate(texts):
        if len(cache) > 500_000:
            cache.clear()
        docs.append(tokens_of(t, net.known, cache)), (size := size + len(docs[-1]))
        if size >= 50_000 or k == len(texts) - 1:
            out.append(net.logits(tables, *joined(docs)))
            docs, size = [], 0
    a, b = net.platt
    return 1 / (1 + np.exp(-np.clip(a * np.concatenate(out).astype(np.float64) + b, -60, 60))) if out else np.zeros(0)


def classify(docs: DataFrame, net: Net | None) -> DataFrame:
    """Per row: doc_id, score, flagged (score at or above the threshold of the row's lang, 0.5 for others)."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast(net)  # ROWS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = held.value
        tables, cache = n.tables() if n is not None else None, {}
        for b in batches:
            p = score(n, [x or b"" for x in b.column(1).to_pylist()], tables, cache)
            flagged = [float(v) >= (n.thresholds.get(str(g), 0.5) if n is not None else 2.0) for v, g in zip(p, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(flagged, pa.bool_())], names=["doc_id", "score", "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, f"doc_id {kind}, score double, flagged boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
