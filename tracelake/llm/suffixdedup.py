"""Removal of repeated byte strings by distributed difference-cover suffix sorting.

A string of LENGTH bytes that starts at two places sorts next to its copy, so it is enough to sort suffixes and to compare the
LENGTH-byte prefixes of neighbours. To sort in parallel, the text is dealt into independent parts first:

1. Anchors. Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one with the least hash (leftmost) is its anchor,
   chosen by the string's bytes alone, so equal strings have equal anchors at equal offsets. The starts that share one
   anchor place are a run. Runs whose anchor gram occurs once in the corpus cannot repeat and go no further.
2. Runs of equal anchor grams are compared with each other only; equal run texts are one from here on, with a count. Grams with
   more than HOT distinct runs are dealt out anew: starts of equal offset to the anchor, FINER of them at a time, with the hash of the
   bytes that all their strings share, which equal strings share too; runs alone under the finer key go no further.
3. Distinct run texts of whole grams, up to SORT_BYTES at a time, joined with separators, are sorted by the difference-cover algorithm: triples at
   positions 1 and 2 modulo 3 are sorted and named, the names sorted by recursion, the other suffixes sorted by one symbol and the
   rank behind it, and both merged. Neighbouring starts with equal LENGTH-byte prefixes are repeats.
4. Repeated starts go back to the texts, whose covered bytes are removed.

Equal texts are one text with a count from the beginning; a text of LENGTH bytes or more with copies is removed whole.

The same steps run over a second unit, words (runs of bytes other than the six ASCII spaces, each as its 64-bit hash): passages of over
50 words that another document also holds, whatever stands between the words. They are counted, not removed. A key's lowest bit names its unit.

Cases: null texts are empty; a text shorter than LENGTH loses nothing; repeated rows are copies of each other, repeated doc_ids with different
texts are different documents; copies share all words of a text of over 50; an empty table gives no rows; other columns are ignored. Kept bytes may split a
UTF-8 character: they are returned as binary by kept_bytes() and hashed as bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, release, shared_dir, shuffle_width, small_batches, stored, table

class Unit(NamedTuple):
    """length: symbols that a repeated string has at least; gram: symbols of an anchor; finer: offsets that a frequent gram is dealt out
    anew by, each time."""

    length: int
    gram: int
    finer: tuple[int, ...]


BYTES, WORDS = Unit(400, 128, (22, 1)), Unit(51, 11, (3, 1))
UNITS, LENGTH = (BYTES, WORDS), BYTES.length
#: Symbols that are sorted together; runs of one gram beyond which it is dealt out anew.
SORT_BYTES, HOT = 1 << 20, 2000
#: Starts that one step of the anchor search covers: places take 24 bits beside 40 of the hash.
STEP = 1 << 20
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hash of every gram of a width: sums of byte * BASE^i, shifted back by powers of the inverse, mod 2^64."""

    def __init__(self, width: int):
        self.width = width
        self.size = 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        if n <= self.size:
            return
        base, self.size = 0x9E3779B97F4A7C15, n
        inv = pow(base, -1, 1 << 64)
        self.up, self.down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for arr, b in ((self.up, base), (self.down, inv)):
            arr[:] = np.uint64(b)
            arr[0] = 1
            np.multiply.accumulate(arr, out=arr)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """data: unsigned integers, width at least; a mixed 64-bit hash for each start."""
        self._grow(len(data) + 1)
        s = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=s[1:])
        h = s[self.width :] - s[: -self.width]
        h *= self.down[: len(h)]
        h ^= h >> np.uint64(32)
        h *= _ADD
        h ^= h >> np.uint64(29)
        return h


    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A mixed 64-bit hash of each of the ordered, disjoint byte ranges."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
            lo, part = starts[i], data[starts[i] : ends[j - 1]]
            self._grow(len(part) + 1)
            s = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=s[1:])
            h = (s[ends[i:j] - lo] - s[starts[i:j] - lo]) * self.down[starts[i:j] - lo]
            h ^= h >> np.uint64(32)
            h *= _ADD
            out[i:j] = h ^ (h >> np.uint64(29))
            i = j
        return out


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_hashes(rolling: Rolling, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes, and the offsets of each text's."""
    space, border = _SPACE[data], np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(~space & (border[:-1] | np.concatenate(([True], space[:-1]))))
    ends = np.flatnonzero(~space & (border[1:] | np.concatenate((space[1:], [True])))) + 1
    return rolling.spans(data, starts, ends), np.searchsorted(starts, offsets)


def anchors(rolling: Rolling, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of all texts: (text, first start, starts, place of the anchor, hash of its gram); starts and places within the text."""
    window = length - rolling.width + 1
    out = []
    for lo in range(0, len(data), STEP):
        part = data[lo : lo + STEP + length - 1]
        if len(part) < length:
            break
        h = rolling(part)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n = len(h) - window + 1
        low = np.minimum(low[:n], low[window - size : window - size + n])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(lo, lo + n)
        text = np.searchsorted(offsets, start, "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
        ok = start + length <= offsets[text + 1]
        edge = np.empty(n, dtype=bool)
        edge[0] = True
        edge[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, n))
        keep = ok[first]
        first, count = first[keep], count[keep]
        t = text[first]
        out.append((t, first + lo - offsets[t], count, place[first] + lo - offsets[t], h[place[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive integers by difference covers modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    bits = int(t.max()).bit_length()
    if 3 * bits > 63:
        t = np.unique(t, return_inverse=True)[1] + 1
        bits = int(t.max()).bit_length()
    s = np.concatenate((t, np.zeros(3, t.dtype))).astype(np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate((ones, twos))
    # Sort the sampled triples and name them.
    if 3 * bits <= 63:
        key = (s[cover] << (2 * bits)) | (s[cover + 1] << bits) | s[cover + 2]
        order = np.argsort(key)
        fresh = np.concatenate(([True], np.diff(key[order]) != 0))
    else:
        order = np.lexsort((s[cover + 2], s[cover + 1], s[cover]))
        c = cover[order]
        fresh = np.concatenate(([True], (np.diff(s[c]) != 0) | (np.diff(s[c + 1]) != 0) | (np.diff(s[c + 2]) != 0)))
    names = np.empty(len(cover), dtype=np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():  # recurse on the names
        order = suffix_order(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sample = cover[order]
    sample = sample[sample < n]
    # The other suffixes: one symbol, then the rank of the suffix behind it.
    wide = int(len(cover) + 2)
    zeros = np.arange(0, n, 3)
    zkey = s[zeros] * wide + rank[zeros + 1]
    zorder = np.argsort(zkey)
    zeros, zkey = zeros[zorder], zkey[zorder]
    # Merge: how many sampled suffixes of either kind precede each of them.
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[one] * wide + rank[one + 1], zkey)
    if bits * 2 + wide.bit_length() <= 62:
        pair = lambda i: (s[i] * (1 << bits) + s[i + 1]) * wide + rank[i + 2]
        before = before + np.searchsorted(pair(two), pair(zeros))
    else:
        both = np.unique(np.concatenate((s[two] * (1 << bits) + s[two + 1], s[zeros] * (1 << bits) + s[zeros + 1])), return_inverse=True)[1]
        before = before + np.searchsorted(both[: len(two)] * wide + rank[two + 2], both[len(two) :] * wide + rank[zeros + 2])
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(zeros))
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    out[at] = zeros
    out[~taken] = sample
    return out


def repeated_starts(texts: list[bytes], marks: list[tuple[int, int, int]], unit: Unit = BYTES) -> list[np.ndarray]:
    """For each distinct run text whether each of its n - length + 1 starts begins a repeated string. marks: (occurrences, least and
    greatest document). Of words, a string is repeated only if two documents hold it."""
    length = unit.length
    if unit == BYTES:
        sizes = np.array([len(t) + 1 for t in texts])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        seq = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    else:
        words, at = word_hashes(Rolling(1), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        sizes = np.diff(at) + 1
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        seq = np.zeros(offsets[-1], dtype=np.int64)
        seq[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes - 1)] = np.unique(words, return_inverse=True)[1].reshape(-1) + 1
    seq[offsets[1:] - 1] = seq.max() + 1
    order = suffix_order(seq)
    own = np.repeat(np.arange(len(texts)), sizes)
    order = order[order + length <= offsets[own[order] + 1] - 1]
    # Adjacent prefixes, the last symbols first, then from the front; what differs drops out.
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    if unit == BYTES:
        padded = np.concatenate(((seq - 1).astype(np.uint8), np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.as_strided(padded, (len(seq) + 1, 8), (1, 1))
        at, steps = (lambda i: eight[i].view(np.uint64)[:, 0]), (length - 8, *range(0, length - 8, 8))
    else:
        at, steps = (lambda i: seq[i]), (length - 1, *range(length - 1))
    for k in steps:
        live = live[at(a[live] + k) == at(b[live] + k)]
        if not len(live):
            break
    hit = np.zeros(len(seq), dtype=bool)
    if unit == BYTES:
        hit[a[live]] = True
        hit[b[live]] = True
        whole = [c > 1 for c, _, _ in marks]
    else:
        fresh = np.ones(len(order), dtype=bool)
        fresh[live + 1] = False
        if len(order):
            heads, low, high = np.flatnonzero(fresh), np.array([m[1] for m in marks]), np.array([m[2] for m in marks])
            many = np.minimum.reduceat(low[own[order]], heads) != np.maximum.reduceat(high[own[order]], heads)
            hit[order[np.repeat(many, np.diff(np.append(heads, len(order))))]] = True
        whole = [low != high for _, low, high in marks]
    return [np.ones(sizes[k] - length, bool) if w else hit[offsets[k] : offsets[k] + sizes[k] - length] for k, w in enumerate(whole)]


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def distinct_texts(docs: DataFrame, base: str) -> str:
    """Writes (tid, copies, text), one row for each distinct text, bucketed by tid for the joins that follow; the table's name."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    each = docs.select(F.md5(text).alias("tid"), text.alias("text")).groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    each.write.bucketBy(shuffle_width(spark), "tid").option("path", f"{base}/texts").saveAsTable(name)
    return name


def _text(symbols: bytes | list[bytes]) -> bytes:
    """A run's text: its bytes, or its words with a space between."""
    return symbols if isinstance(symbols, bytes) else b" ".join(symbols)


def find_runs(texts: DataFrame, base: str, k: int = 0) -> DataFrame:
    """(key, rh, owner, first, starts, off, c, low, high, text): the runs, in the k-th unit, of each text (owner) whose anchor gram occurs
    twice at least; stored."""
    spark, unit = texts.sparkSession, UNITS[k]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(unit.gram)
        for b in batches:
            data, offsets = _buffers(b.column(1))
            if unit == WORDS:
                data, offsets = word_hashes(rolling, data, offsets)
            t, first, starts, place, key = anchors(rolling, data, offsets, unit.length)
            key = key & ~1 | k
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(key), pa.array(first), pa.array(starts), pa.array(place - first)], names=["tid", "key", "first", "starts", "off"])

    # A whole text that repeats is one text here, so a gram that only its copies hold counts once, and needs no search: the copies go whole.
    found = texts.where(F.octet_length("text") >= (LENGTH if unit == BYTES else 2 * WORDS.length - 1)).select("tid", "text").mapInArrow(search, "tid string, key long, first long, starts long, off long")
    found = stored(found, f"{base}/anchors")
    # Written first: joined straight after the count, both sides would keep its partitioning, and Spark could not split a frequent gram.
    again = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), f"{base}/again")
    lists = found.join(again, "key", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("key", "first", "starts", "off")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _KINDS]
            for tid, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                symbols, doc = (text if unit == BYTES else text.split()), int.from_bytes(bytes.fromhex(tid[:16]), "little", signed=True)
                for r in runs:
                    part = _text(symbols[r["first"] : r["first"] + r["starts"] + unit.length - 1])
                    for c, v in zip(cols, (r["key"], _digest(part), tid, r["first"], r["starts"], r["off"], 1, doc, doc, part)):
                        c.append(v)
            yield _runs(cols)

    joined = texts.join(lists, "tid").select("tid", "text", "runs")
    return stored(joined.mapInArrow(cut, _RUNS), f"{base}/runs")


#: c: occurrences; low, high: least and greatest document that holds it; text: see _text().
_RUNS = "key long, rh binary, owner string, first long, starts long, off long, c long, low long, high long, text binary"
_KINDS = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _runs(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=[f.split()[0] for f in _RUNS.split(", ")])


def finer(each: DataFrame, level: int) -> DataFrame:
    """Distinct runs cut by offset to the anchor, a few of them at a time, under the hash of the slice and of the symbols that all
    its strings share. The owner of a cut is the run it comes from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _KINDS]
            for key, owner, starts, off, c, low, high, text in zip(*(b.column(k).to_pylist() for k in range(8))):
                u, symbols = UNITS[key & 1], text if key & 1 == 0 else text.split()
                width = u.finer[level]
                # Start j of the run has offset off - j; slice q holds the offsets q * width .. q * width + width - 1.
                j = 0
                while j < starts:
                    q = (off - j) // width
                    last = min(starts - 1, off - q * width)
                    core = _text(symbols[off - q * width : off - q * width + u.length - width + 1])
                    part = _text(symbols[j : last + u.length])
                    name = _digest(key.to_bytes(8, "little", signed=True) + q.to_bytes(4, "little") + core)
                    fine = int.from_bytes(name[:8], "little", signed=True) & ~1 | key & 1
                    for col, v in zip(cols, (fine, _digest(part), owner, j, last - j + 1, off - j, c, low, high, part)):
                        col.append(v)
                    j = last + 1
            yield _runs(cols)

    return each.select("key", owner_of(), "starts", "off", "c", "low", "high", "text").mapInArrow(cut, _RUNS)


def owner_of():
    """Name of a distinct run, as owner of its cuts."""
    return F.concat(F.col("key").cast("string"), F.lit("/"), F.hex("rh")).alias("owner")


def distinct_runs(runs: DataFrame) -> DataFrame:
    """(key, rh, c, low, high, starts, off, text): equal run texts of a key as one row."""
    return runs.groupBy("key", "rh").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("starts").alias("starts"), F.min("off").alias("off"), F.any_value("text").alias("text"))


def repeats(each: DataFrame) -> DataFrame:
    """(key, rh, lo, hi): ranges of repeated starts of each distinct run, by sorting suffixes of whole keys together."""
    spark = each.sparkSession
    flow = each.select("key", "rh", "c", "low", "high", "text").repartition(shuffle_width(spark), "key").sortWithinPartitions("key")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        ready: list[tuple] = []
        size = 0

        def solve() -> Iterator[pa.RecordBatch]:
            rows = []
            for k, unit in enumerate(UNITS):
                own = [r for r in ready if r[0] & 1 == k]
                if own:
                    for (key, rh, *_), hit in zip(own, repeated_starts([r[5] for r in own], [r[2:5] for r in own], unit)):
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        rows += [(key, rh, int(x), int(y)) for x, y in zip(edge[::2], edge[1::2])]
            if rows:
                k, r, lo, hi = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(r, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["key", "rh", "lo", "hi"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if group and group[0][0] != row[0]:
                    if len(group) > 1 or group[0][2] > 1:
                        ready += group
                        size += sum(len(r[5]) + 1 for r in group)
                    group = []
                    if size >= SORT_BYTES:
                        yield from solve()
                        ready, size = [], 0
                group.append(row)
        if group and (len(group) > 1 or group[0][2] > 1):
            ready += group
        yield from solve()

    return flow.mapInArrow(sort, "key long, rh binary, lo long, hi long")


def covered(docs: DataFrame, base: str) -> tuple[str, DataFrame]:
    """The table of distinct texts, and (tid, spans array<struct<unit, a, b>>) of the symbols that repeated strings cover."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    texts = distinct_texts(docs, base)
    release(spark)
    spans = None
    for k, unit in enumerate(UNITS):  # one after the other: each leaves as much on disk as the texts
        own = f"{base}/unit{k}"
        runs = find_runs(spark.table(texts), own, k)
        drop_path(spark, f"{own}/anchors"), release(spark)
        found = repeated_ranges(runs, own).select(F.col("owner").alias("tid"), F.lit(k).alias("unit"), F.col("lo").alias("a"), (F.col("hi") + unit.length - 1).alias("b"))
        found = stored(found, f"{base}/spans{k}")
        drop_path(spark, own), release(spark)
        spans = found if spans is None else spans.union(found)
    return texts, stored(spans.groupBy("tid").agg(F.collect_list(F.struct("unit", "a", "b")).alias("spans")), f"{base}/spans")


def repeated_ranges(runs: DataFrame, base: str, level: int = 0) -> DataFrame:
    """(owner, lo, hi): ranges of repeated starts within each owner."""
    each = stored(distinct_runs(runs), f"{base}/each{level}")
    found = None
    if level < len(BYTES.finer):
        hot = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), f"{base}/hot{level}")
        if hot.limit(1).count():
            fine = stored(finer(each.join(hot, "key", "left_semi"), level), f"{base}/finer{level}")
            again = fine.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1").select("key")
            inner = repeated_ranges(fine.join(again, "key", "left_semi").select(*fine.columns), base, level + 1)
            found = each.select("key", "rh", owner_of()).join(inner, "owner").select("key", "rh", "lo", "hi")
            each = each.join(hot, "key", "left_anti").select(*each.columns)
    cold = stored(repeats(each), f"{base}/repeats{level}")
    found = cold if found is None else found.unionByName(cold)
    return runs.select("key", "rh", "owner", "first").join(found, ["key", "rh"]).select("owner", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def merged(spans: list[dict] | None, unit: int) -> list[tuple[int, int]]:
    """Maximal covered runs of a text, in symbols of the unit."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or () if s["unit"] == unit):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_of(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def deduplicate(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words (words inside passages of over 50 words that another
    document also holds), and with with_bytes the kept bytes."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    texts, spans = covered(docs, base)
    fields = "tid string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + ", kept binary" * with_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tid, copies, text, sp in zip(*(b.column(k).to_pylist() for k in range(4))):
                removed = [(0, len(text))] if copies > 1 and len(text) >= LENGTH else merged(sp, 0)
                words = len(text.split()) if copies > 1 else 0
                shared = words if words >= WORDS.length else sum(b - a for a, b in merged(sp, 1))
                kept = kept_of(text, removed)
                rows.append((tid, len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), shared, kept))
            if rows:
                cols = list(zip(*rows))[: 6 + with_bytes]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in fields.split(", ")])

    per_text = spark.table(texts).join(spans, "tid", "left").select("tid", "copies", "text", "spans").mapInArrow(cut, fields)
    per_text = stored(per_text, f"{base}/kept")
    spark.sql(f"DROP TABLE {texts}")
    drop_path(spark, f"{base}/texts")
    release(spark)
    ids = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tid"))
    return ids.join(per_text, "tid").drop("tid")


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
