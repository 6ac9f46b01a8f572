"""Language-model scores by logistic context mixing, and the add-one unigram base.

Model. A text is its UTF-8 bytes and one end symbol. Each symbol is written in a prefix code that depends on the
byte before it, so its probability is a product of bit probabilities. Predictors with the contexts of ORDERS
bytes and the code node, hashed to places beyond order 1, hold counts n0, n1 of all learning documents
and give stretch((n1 + a) / (n0 + n1 + 2a)). Nodes of NEAR levels lie side by side for a context, so a symbol's bits share memory lines. A mixer adds them with weights gated by the bit's depth in the code and by
how much the longest context has seen. The weights are learned by logistic regression on every bit of all learning documents, each bit's own
count left out: one pass counts the bits by gate and inputs (in steps of 1 / GRID), and Newton steps on these counts find
each gate's weights, drawn to START by PRIOR. Within a document they are refined online: after bytes STEPS, then after every
SEGMENT bytes, they take a step along the gradient of the bits just coded, starting anew for each document. Probabilities are
those before the step, so they sum to one over all texts. score is the log10 probability; bits_per_byte
is total bits by bytes.

Everything that is gathered covers all learning documents: the byte pairs that make the prefix code, the predictors' counts, the mixer's
weights and the token counts; nothing is fitted on a sample. Tables grow with the learning bytes, a place of the longest order for BYTES_PLACE of them,
from MIN_PLACES to MAX_PLACES, which bounds memory; beyond, contexts share places. Tasks are as many as keep what they send, a
table each, below what they read.

Base. Tokens by their XXH64. The FREQUENT most frequent tokens are sent to the workers with their counts; the others
of a document are joined with the token counts, so a hot token never meets in one task.

Cases: null and empty texts are the end token alone; repeated rows get a row each; an empty table gives no rows; without
learning documents N and V are 0 and all bits have probability 1/2; a text's score does not depend on the others; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fold_of, shared_dir, shuffle_width, small_batches, stored, table

FOLDS, HELD_OUT = 7, 2
END, SYMBOLS = 256, 257
ORDERS = (1, 2, 4)
CHUNK = 1 << 14
ALPHA, CLAMP = 0.4, 8.0
BYTES_PLACE, MIN_PLACES, MAX_PLACES, MIN_TASKS = 128, 1 << 19, 1 << 24, 16
FREQUENT, SEGMENT, STEPS, RATE = 100_000, 512, (64, 128, 256, 512), 0.3
GATES_DEPTH, GATES_SEEN = 6, 3
#: Weights of the orders that learning starts from, by what the longest context has seen: nothing, little, often.
START = ((0.25, 0.75, 0.0), (0.15, 0.45, 0.45), (0.1, 0.25, 0.75))
#: Learning: steps of a predictor's input to 1, its values from -CLAMP to CLAMP, and how strongly weights are drawn to START.
GRID, PRIOR = 2, 1.0
LEVELS = 2 * int(CLAMP) * GRID + 1
#: Levels of the code whose nodes lie side by side in a table for one context, 2 ** NEAR places: few memory lines for a symbol.
NEAR = 5
#: Symbols worked on at once, and bytes of texts whose contexts are held.
BLOCK, PIECE = 1 << 14, 1 << 20
#: Steps of a packed stretch value.
UNIT = 1000
_END_WORD = -1  # the hash kept for the end token


class Code:
    """For each previous byte a prefix code of the 257 symbols; nodes are numbered prev * 257 + inner node."""

    def __init__(self, pairs: np.ndarray):
        """pairs: 257 x 257 counts (row 256: at the start of a text)."""
        lens, steps, homes = [], [], []
        back = pairs.sum(axis=0) + 1e-3
        for prev in range(SYMBOLS):
            weight = pairs[prev] + back * (4.0 / back.sum()) + 1e-4
            for path in self._tree(weight):
                lens.append(len(path))
                steps += [(prev * SYMBOLS + n) << 4 | min(d, GATES_DEPTH - 1) << 1 | b for d, (n, b) in enumerate(path)]
                for d, (n, b) in enumerate(path):
                    if d % NEAR == 0:
                        top, slot = prev * SYMBOLS + n, 1
                    homes.append(top << NEAR | slot)
                    slot = slot << 1 | b
        self.lens = np.array(lens)
        self.base = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        #: Node, depth (three bits, capped) and bit of every step of every code word.
        self.steps = np.array(steps, dtype=np.int32)
        #: For every step the first node of its NEAR levels, hashed, and in the lowest NEAR bits its number in their tree.
        homes = np.array(homes, dtype=np.uint32)
        self.homes = (homes >> np.uint32(NEAR)) * np.uint32(0x9E3779B1) >> np.uint32(NEAR) << np.uint32(NEAR) | homes & np.uint32((1 << NEAR) - 1)

    @staticmethod
    def _tree(weight: np.ndarray) -> list[list[tuple[int, int]]]:
        heap = [(float(w), s) for s, w in enumerate(weight)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        n = SYMBOLS
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (n, 0), (n, 1)
            heapq.heappush(heap, (a + b, n))
            n += 1
        out = []
        for s in range(SYMBOLS):
            path, at = [], s
            while at in parent:
                up, bit = parent[at]
                path.append((up - SYMBOLS, bit))
                at = up
            out.append(path[::-1])
        return out


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each with END behind, and the offsets."""
    sizes = np.array([len(t) + 1 for t in texts])
    off = np.concatenate(([0], np.cumsum(sizes)))
    sym = np.zeros(off[-1], dtype=np.int32)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sym[:] = raw
    sym[off[1:] - 1] = END
    return sym, off


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of (byte before, symbol), END before the first; 257 x 257."""
    sym, off = symbols_of(texts)
    prev = np.empty_like(sym)
    prev[1:], prev[0] = sym[:-1], END
    prev[off[:-1]] = END
    return np.bincount(prev * SYMBOLS + sym, minlength=SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)


def places_for(n_bytes: int) -> tuple[int, ...]:
    """Places of each order's table: a place for each node of order 1, a power of two for the longest order and half of it for order 2."""
    most = min(max(1 << int(math.log2(max(n_bytes // BYTES_PLACE, 1))), MIN_PLACES), MAX_PLACES)
    return SYMBOLS * SYMBOLS, most // 2, most


def limits_of(slots: tuple[int, ...]) -> np.ndarray:
    """Numbers of the first chunk of each table."""
    return np.concatenate(([0], np.cumsum([-(-s // CHUNK) for s in slots])))


def contexts(sym: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each symbol: the byte before (256 at the start), then the hashed contexts of the longer orders (uint32)."""
    first = np.zeros(len(sym), dtype=bool)
    first[off[:-1]] = True
    prev = np.empty_like(sym)
    prev[1:], prev[0] = sym[:-1], END
    prev[first] = END
    hashes, h, p = [], prev.astype(np.uint32), prev
    for k in range(2, max(ORDERS) + 1):
        q = np.empty_like(p)
        q[1:], q[0] = p[:-1], END
        q[first] = END  # nothing before the text
        h = (h * np.uint32(0x2C1B3C6D) + q.astype(np.uint32) + np.uint32(1)) * np.uint32(0x297A2D39)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            hashes.append(h)
        p = q
    return [prev, *hashes]


def bits_of(code: Code, sym: np.ndarray, ctx: list[np.ndarray], slots: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of bits of each symbol; bit, capped depth and the places in each table of every coded bit."""
    at = ctx[0] * SYMBOLS + sym
    n = code.lens.take(at)
    ends = np.cumsum(n)
    owner = np.zeros(ends[-1], dtype=np.int64)  # the symbol of each bit
    owner[ends[:-1]] = 1
    np.cumsum(owner, out=owner)
    idx = (code.base.take(at) - ends + n).take(owner, mode="clip")
    idx += np.arange(len(idx))
    step = code.steps.take(idx, mode="clip")
    node = step >> 4
    mixed = code.homes.take(idx, mode="clip")
    slot = mixed & np.uint32((1 << NEAR) - 1)
    mixed ^= slot
    places = [node]
    for h, size in zip(ctx[1:], slots[1:]):
        x = h.take(owner, mode="clip")
        x ^= mixed
        x *= np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - (size.bit_length() - 1))
        x ^= slot
        places.append(x.view(np.int32))
    return n, step & 1, (step >> 1) & 7, places


def count_in(table: np.ndarray, at: np.ndarray) -> None:
    """Adds one to table at each place. With a one of the table's type numpy takes its fast path."""
    np.add.at(table, at.astype(np.intp, copy=False), table.dtype.type(1))


def pieces(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Runs of texts of at most so many bytes, one at least."""
    run, size = [], 0
    for k, t in enumerate(texts):
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(k)
        size += len(t)
    if run:
        yield run


def token_hashes(text: bytes) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()
    return np.fromiter(map(h, words), dtype=np.uint64, count=len(words)).view(np.int64)


def stretched(count: np.ndarray) -> np.ndarray:
    return np.log((count[:, 1] + ALPHA) / (count[:, 0] + ALPHA)).clip(-CLAMP, CLAMP).astype(np.float32)


def seen_of(count: np.ndarray) -> np.ndarray:
    """0: a place not seen, 1: little, 2: often."""
    n = count[:, 0] + count[:, 1]
    return (n > 0).astype(np.int32) + (n > 30)


def packed(count: np.ndarray) -> np.ndarray:
    """A table as int16: stretch in steps of 1 / UNIT, and the two bits of seen_of()."""
    return (np.rint(stretched(count) * UNIT).astype(np.int16) << 2) | seen_of(count).astype(np.int16)


def without_own(count: np.ndarray, seen: bool) -> np.ndarray:
    """For each place and bit (0, 1) what the mixer gets for such a bit, its own count left out (int8): the input's level,
    turned so that higher is better for this bit, and if asked for seen_of() times LEVELS. Zero counts are never looked up with their bit."""
    out = np.empty((len(count), 2), dtype=np.int8)
    for bit in (0, 1):
        left = count.copy()
        left[:, bit] = np.maximum(left[:, bit] - 1, 0)
        out[:, bit] = (seen_of(left) * LEVELS if seen else 0) + np.rint((2 * bit - 1) * GRID * stretched(left)).astype(np.int32) + LEVELS // 2
    return out.reshape(-1)


def start_weights() -> np.ndarray:
    """START for every gate, a row each: what the longest context has seen, then depth."""
    return np.repeat(np.array(START, dtype=np.float64), GATES_DEPTH, axis=0)


def fit_weights(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of each gate: least coding cost of n bits in each cell, and PRIOR / 2 times the squared distance to START."""
    out = start_weights()
    gate, inputs = np.divmod(cells, LEVELS ** len(ORDERS))
    gate = gate % GATES_SEEN * GATES_DEPTH + gate // GATES_SEEN
    x = np.stack([inputs // LEVELS**k % LEVELS - LEVELS // 2 for k in range(len(ORDERS))], axis=1) / GRID
    for g in np.unique(gate):
        a, c, w0 = x[gate == g], n[gate == g].astype(np.float64), out[g].copy()

        def cost(w: np.ndarray) -> float:
            return float(c @ np.logaddexp(0, -(a @ w))) + PRIOR / 2 * float((w - w0) @ (w - w0))

        w = w0
        for _ in range(50):
            miss = 1 / (1 + np.exp(a @ w))
            slope = -(c * miss) @ a + PRIOR * (w - w0)
            step = np.linalg.solve((a * (c * miss * (1 - miss))[:, None]).T @ a + PRIOR * np.eye(len(w)), slope)
            size = 1.0
            while cost(w - size * step) > cost(w) and size > 1e-6:
                size /= 2
            w = w - size * step
            if np.abs(step).max() < 1e-6:
                break
        out[g] = w
    return out


def learn_weights(learning: DataFrame, code: Code, slots: tuple[int, ...], tables: list[np.ndarray]) -> np.ndarray:
    """The mixer's weights from all bits of all learning documents; tables: without_own() of each order, the longest with seen."""
    spark = learning.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast((code, tables))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = held.value
        total = np.zeros(GATES_SEEN * GATES_DEPTH * LEVELS ** len(ORDERS), dtype=np.int64)
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            for run in pieces(texts, 1 << 18):
                count_cells(total, code, slots, tables, [texts[k] for k in run])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    each = learning.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "cell int, n long")
    rows = each.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # GATES_SEEN * GATES_DEPTH * LEVELS ** 3 rows at most
    held.destroy()
    cells, n = (rows.column(k).to_numpy() for k in ("cell", "n"))
    order = np.argsort(cells)
    return fit_weights(cells[order].astype(np.int64), n[order])


def count_cells(total: np.ndarray, code: Code, slots: tuple[int, ...], tables: list[np.ndarray], texts: list[bytes]) -> None:
    """Adds the texts' bits to total: cells are numbered by depth, what the longest context has seen, and the level of each order's input."""
    sym, off = symbols_of(texts)
    ctx = contexts(sym, off)
    for lo in range(0, len(sym), BLOCK):
        part = slice(lo, lo + BLOCK)
        _, bit, cell, places = bits_of(code, sym[part], [c[part] for c in ctx], slots)
        for t, p, n in reversed(list(zip(tables, places, [LEVELS] * (len(tables) - 1) + [GATES_SEEN * LEVELS]))):
            cell *= n
            cell += t.take((p << 1) | bit)
        count_in(total, cell)


class Model:
    """code, packed tables and their places, frequent tokens (sorted hashes, counts), the totals, and the mixer's weights by gate."""

    def __init__(self, code: Code, tables: list[np.ndarray], slots: tuple[int, ...], frequent: tuple[np.ndarray, np.ndarray], total: int, distinct: int, weights: np.ndarray | None = None):
        self.code, self.tables, self.slots, self.frequent, self.total, self.distinct = code, tables, slots, frequent, total, distinct
        self.weights = start_weights() if weights is None else weights

    def log2(self, texts: list[bytes]) -> np.ndarray:
        """log2 probability of each text; the same whatever other texts are given."""
        sym, off = symbols_of(texts)
        ctx = contexts(sym, off)
        sizes = np.diff(off)
        out = np.zeros(len(texts))
        move = np.zeros((len(texts), len(ORDERS)), dtype=np.float32)
        w = np.ascontiguousarray(self.weights.T, dtype=np.float32) / np.float32(UNIT)
        s, longest = 0, sizes.max()
        while s < longest:
            until = next((x for x in STEPS if x > s), s + SEGMENT)
            alive = np.flatnonzero(sizes > s)
            ends = np.minimum(sizes[alive], until) - s
            cuts = np.flatnonzero(np.diff(np.cumsum(ends) // BLOCK)) + 1  # blocks of texts, so that a block's arrays stay in the cache
            for some, size in zip(np.split(alive, cuts), np.split(ends, cuts)):
                heads = np.cumsum(size) - size
                at = np.repeat(off[some] + s - heads, size)
                at += np.arange(len(at))
                n_sym, bit, gate, places = bits_of(self.code, sym.take(at), [c.take(at) for c in ctx], self.slots)
                n = np.add.reduceat(n_sym, heads)
                first = np.cumsum(n) - n
                got = [t.take(p) for t, p in zip(self.tables, places)]
                gate = (gate + (got[-1] & 3) * GATES_DEPTH).astype(np.intp)
                st = [(g >> 2).astype(np.float32) for g in got]
                z = np.zeros(len(bit), dtype=np.float32)
                for k, x in enumerate(st):
                    v = w[k].take(gate, mode="clip")
                    if s:
                        v += np.repeat(move[some, k], n)
                    v *= x
                    z += v
                sign = (1 - 2 * bit).astype(np.float32)
                z *= sign
                np.clip(z, -25, 25, out=z)
                miss = np.exp(z, out=z)
                hit = miss + np.float32(1)  # 1 / hit: probability of the bit
                miss /= hit
                out[some] -= np.add.reduceat(np.log(hit, out=hit), first, dtype=np.float64)
                if until < longest:
                    miss *= sign
                    rate = -(RATE / UNIT**2 / np.maximum(n, 200)).astype(np.float32)
                    for k, x in enumerate(st):
                        x *= miss
                        move[some, k] += rate * np.add.reduceat(x, first)
            s = until
        return out / math.log(2)


def pairs_of(learning: DataFrame) -> tuple[np.ndarray, int]:
    """Byte pairs of all learning documents (257 x 257), and their bytes with an end each."""
    small_batches(learning.sparkSession, 512)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            for run in pieces(texts, 1 << 20):
                total += pair_counts([texts[k] for k in run]).reshape(-1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    each = learning.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "pair int, n long")
    out = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    rows = each.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # 257 x 257 rows at most
    out[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out.reshape(SYMBOLS, SYMBOLS), int(out.sum())


def gather(learning: DataFrame, code: Code, slots: tuple[int, ...], tasks: int, base: str) -> tuple[DataFrame, DataFrame]:
    """Counts of all learning documents: (word, c) of the tokens, and (chunk, counts) of the predictors' places.

    Each task sends packed arrays: its token counts by hash bucket and its non-empty chunks of places.
    """
    spark = learning.sparkSession
    small_batches(spark, 512)
    width = shuffle_width(spark)
    buckets, held = 4 * width, spark.sparkContext.broadcast(code)
    limits = limits_of(slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * (limits[k + 1] - limits[k]) * CHUNK, dtype=np.int32) for k in range(len(slots))]
        words, n_words, kept, docs = [], 0, [], 0

        def settle() -> None:
            nonlocal words, n_words
            if words:
                u, c = np.unique(np.concatenate(words), return_counts=True)
                kept.append((u, c))
                words, n_words = [], 0

        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            docs += len(texts)
            for t in texts:
                words.append(token_hashes(t))
                n_words += len(words[-1])
                if n_words >= 2_000_000:
                    settle()
            for run in pieces(texts, 1 << 18):
                sym, off = symbols_of([texts[k] for k in run])
                ctx = contexts(sym, off)
                for lo in range(0, len(sym), BLOCK):
                    part = slice(lo, lo + BLOCK)
                    _, bit, _, places = bits_of(held.value, sym[part], [c[part] for c in ctx], slots)
                    for t, p in zip(tables, places):
                        count_in(t, 2 * p + bit)
        settle()
        if not docs:
            return
        kept.append((np.array([_END_WORD]), np.array([docs])))
        word, inv = np.unique(np.concatenate([u for u, _ in kept]), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate([c for _, c in kept])).astype(np.int64)
        home = ((word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[k] : cuts[k + 1]]
            yield _row("word", int(k), np.concatenate((word[rows], c[rows])))
        for k, t in enumerate(tables):
            for j, part in enumerate(t.reshape(-1, 2 * CHUNK)):
                if part.any():
                    yield _row("place", int(limits[k] + j), part.astype(np.uint32))

    sent = learning.select(F.col("text").cast("binary").alias("text")).coalesce(tasks).mapInArrow(count, "kind string, key int, data binary")
    sent = sent.repartition(width, "kind", "key").sortWithinPartitions("kind", "key")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, parts, size = None, None, [], 0

        def fold() -> None:
            nonlocal parts, size
            u, inv = np.unique(np.concatenate([p[: len(p) // 2] for p in parts]), return_inverse=True)
            c = np.bincount(inv, weights=np.concatenate([p[len(p) // 2 :] for p in parts])).astype(np.int64)
            parts, size = [np.concatenate((u, c))], 0

        def close() -> Iterator[pa.RecordBatch]:
            if here is None:
                return
            if here[0] == "word":
                fold()
                yield _row(*here, parts[0])
            else:
                yield _row(*here, total)

        for b in batches:
            for kind, key, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (kind, key) != here:
                    yield from close()
                    here, total, parts, size = (kind, key), None, [], 0
                if kind == "word":
                    parts.append(np.frombuffer(data, dtype=np.int64)), (size := size + len(data))
                    if size > 32 << 20:
                        fold()
                else:
                    x = np.frombuffer(data, dtype=np.uint32).astype(np.int64)
                    total = x if total is None else total + x
        yield from close()

    merged = stored(sent.mapInArrow(lambda it: _few(merge(it)), "kind string, key int, data binary"), f"{base}/merged")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                x = np.frombuffer(data, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[: len(x) // 2]), pa.array(x[len(x) // 2 :])], names=["word", "c"])

    words = stored(merged.where("kind = 'word'").select("data").mapInArrow(spread, "word long, c long"), f"{base}/words")
    return words, merged.where("kind = 'place'").select("key", "data")


def _row(kind: str, key: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([key], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["kind", "key", "data"])


def _few(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from rows


def fit(learning: DataFrame, base: str) -> tuple[Model, DataFrame]:
    """The model and the stored token counts (word, c)."""
    pairs, n_bytes = pairs_of(learning)
    code, slots = Code(pairs.astype(float)), places_for(n_bytes)
    words, places = gather(learning, code, slots, max(MIN_TASKS, n_bytes // (8 * sum(slots))), base)
    t = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = words.orderBy(F.desc("c"), "word").limit(FREQUENT).toPandas().sort_values("word")
    limits = limits_of(slots)
    tables = [np.zeros((limits[k + 1] - limits[k]) * CHUNK, dtype=np.int16) for k in range(len(slots))]
    inputs = [np.zeros(2 * len(t), dtype=np.int8) for t in tables]
    for r in places.toLocalIterator():  # MAX_PLACES bounds them
        k = int(np.searchsorted(limits, r.key, "right")) - 1
        count = np.frombuffer(r.data, dtype=np.int64).reshape(-1, 2).astype(np.float32)
        tables[k][(r.key - limits[k]) * CHUNK :][:CHUNK] = packed(count)
        inputs[k][2 * (r.key - limits[k]) * CHUNK :][: 2 * CHUNK] = without_own(count, k == len(slots) - 1)
    weights = learn_weights(learning, code, slots, inputs)
    frequent = (top["word"].to_numpy(dtype=np.int64), top["c"].to_numpy(dtype=np.float64))
    return Model(code, tables, slots, frequent, int(t.n or 0), int(t.v), weights), words


def score(docs: DataFrame, model: Model, words: DataFrame, base: str) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        top, log_c = m.frequent[0], np.log10(m.frequent[1] + 1)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            tokens, known, base_sum, rare = [], [], [], []
            for t in texts:
                h = np.append(token_hashes(t), _END_WORD)
                at = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
                hit = top[at] == h if len(top) else np.zeros(len(h), bool)
                tokens.append(len(h)), known.append(int(hit.sum())), base_sum.append(float(log_c[at[hit]].sum()) if len(top) else 0.0), rare.append(h[~hit])
            bits = np.concatenate([m.log2([texts[k] for k in r]) for r in pieces(texts, PIECE)]) if texts else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32)), pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base_sum, pa.float64()), lists, pa.array(bits), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "n_tokens", "known", "part", "rare", "bits", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, part double, rare array<long>, bits double, n_bytes long")
    one = stored(one.withColumn("row", F.monotonically_increasing_id()), f"{base}/scored")
    found = one.select("row", F.explode("rare").alias("word")).join(words, "word").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("rest"))
    out = one.drop("rare").join(found, "row", "left")
    share = F.lit(float(np.log10(model.total + model.distinct + 1)))
    base_score = F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * share
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("bits") * float(np.log10(2))).alias("score"), (-F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    fold = fold_of(F.col("doc_id"), FOLDS)
    model, words = fit(docs.where(fold != HELD_OUT), base)
    found = score(docs, model, words, base)
    drop_path(spark, f"{base}/merged")
    cols = found.columns
    return found.withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).select("doc_id", "held_out", *cols[1:])
