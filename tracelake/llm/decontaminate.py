"""Benchmark decontamination with a distributed positional inverted index.

build_index() stores the postings (row, pos, term) of the training text: one row for each occurrence of a word that a
test item uses, and one closing posting a document (term CLOSE, pos = number of words). Words that no test
item uses are in no list that a phrase could read, so they are not stored. Test phrases are windows of WINDOW
words. Each window's terms are ordered by their corpus counts; the lists of its rarest terms, shifted by the
term's offset, are intersected first, and only what is left of the documents meets the lists of its other
terms. exact_matches() returns phrase occurrences, proximity_matches() places where a window's terms lie
within `slop` words of their offsets. DataFrame functions only.

Skew: no list is ever gathered; the joins on a term broadcast the test side, up to BROADCAST_ROWS counted rows, and beyond
that are sort-merge joins that Spark splits; intersections group by (document, window, start).

Cases: null or empty texts have no words; items without words have no windows; repeated doc_ids are
documents of their own (an internal row number tells them apart); repeated items count once for each item_id, items without id hit words but are not counted; empty tables give
no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, stored, table

#: Words, before A-Z are lower-cased: what is not an ASCII character other than a letter or digit.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW, MIN_ITEMS = 8, 2
#: Lists of a window that are intersected before others are read.
RAREST = 2
#: A counted side of so many narrow rows at most is broadcast (about 10 MB).
BROADCAST_ROWS = 250_000
CLOSE = "\u0000"


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def words(text) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def windows(items: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (wid, n, terms array) and their (wid, item_id)."""
    tokens = items.select("item_id", F.transform(words(F.col("text")), ascii_lower).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))))
    each = tokens.select("item_id", "w", at.alias("i")).select("item_id", F.slice("w", F.col("i") + 1, WINDOW).alias("terms")).distinct()
    phrases = stored(each.select("terms").distinct().select(F.monotonically_increasing_id().alias("wid"), F.size("terms").alias("n"), "terms"), f"{base}/phrases")
    members = stored(each.join(phrases, "terms").select("wid", "item_id"), f"{base}/members")
    return phrases, members


def build_index(docs: DataFrame, phrases: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The stored postings (row, doc_id, pos, term) and the vocabulary (term, word)."""
    vocab = phrases.select(F.explode("terms").alias("word")).distinct().select(F.monotonically_increasing_id().alias("term"), "word")
    vocab = stored(vocab.union(docs.sparkSession.range(1).select(F.lit(-1).cast("long"), F.lit(CLOSE))), f"{base}/vocab")
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_append(words(F.col("text")), F.lit(CLOSE)).alias("w"))
    each = tokens.select("row", "doc_id", F.posexplode("w").alias("pos", "raw")).select("row", "doc_id", "pos", ascii_lower(F.col("raw")).alias("word"))
    return stored(each.join(_small(vocab), "word").select("row", "doc_id", "pos", "term"), f"{base}/index"), vocab


def ranked_terms(phrases: DataFrame, index: DataFrame, vocab: DataFrame, base: str) -> DataFrame:
    """(wid, n, offset, term, rank): rank 1 is the window's rarest term. Windows with a word that no document has go."""
    counts = stored(index.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{base}/counts")
    each = phrases.select("wid", "n", F.posexplode("terms").alias("offset", "word")).join(vocab, "word").join(counts, "term")
    w = Window.partitionBy("wid")
    ranked = each.withColumn("found", F.count(F.lit(1)).over(w)).where("found = n")
    return stored(ranked.withColumn("rank", F.row_number().over(w.orderBy("df", "term", "offset"))).select("wid", "n", "offset", "term", "rank"), f"{base}/ranked")


def exact_matches(index: DataFrame, ranked: DataFrame, base: str) -> DataFrame:
    """(row, wid, start, n): every occurrence of every phrase."""
    lists = index.where("term >= 0").join(_small(ranked.where(F.col("rank") <= RAREST)), "term")
    shifted = lists.select("row", "wid", "n", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    left = shifted.groupBy("row", "wid", "n", "start").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == F.least("n", F.lit(RAREST)))
    left = stored(left.drop("c"), f"{base}/left")
    done, open_ = left.where(F.col("n") <= RAREST), left.where(F.col("n") > RAREST)
    need = open_.join(_small(ranked.where(F.col("rank") > RAREST).drop("n")), "wid")
    need = need.select("row", (F.col("start") + F.col("offset")).alias("pos"), "term", "wid", "start", "n")
    near = index.where("term >= 0").join(_small(open_.select("row").distinct()), "row", "left_semi").select("row", "pos", "term")
    full = need.join(near, ["row", "pos", "term"]).groupBy("row", "wid", "start", "n").agg(F.count(F.lit(1)).alias("c"))
    full = full.where(F.col("c") == F.col("n") - RAREST).drop("c")
    return stored(done.unionByName(full.select(*done.columns)).select("row", "wid", "start", "n"), f"{base}/found")


def proximity_matches(index: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(row, wid, start): starts given by the rarest term where every other term lies within slop words of its offset."""
    first = index.join(_small(ranked.where("rank = 1")), "term").select("row", "wid", "n", (F.col("pos") - F.col("offset")).alias("start"))
    rest = first.join(_small(ranked.where("rank > 1").drop("n")), "wid")
    around = F.explode(F.sequence(F.col("start") + F.col("offset") - slop, F.col("start") + F.col("offset") + slop))
    probe = rest.select("row", "wid", "n", "start", "offset", "term", around.alias("pos"))
    near = probe.join(index.join(_small(first.select("row").distinct()), "row", "left_semi").select("row", "pos", "term"), ["row", "pos", "term"])
    hit = near.groupBy("row", "wid", "n", "start").agg(F.count_distinct("offset").alias("c")).where("c = n - 1")
    return hit.select("row", "wid", "start").union(first.where("n = 1").select("row", "wid", "start")).distinct()


def covered(found: DataFrame) -> DataFrame:
    """(row, n_hit): words inside any occurrence."""
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    w = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    return spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base = shared_dir(docs.sparkSession)
    phrases, members = windows(items, base)
    index, vocab = build_index(docs, phrases, base)
    found = exact_matches(index, ranked_terms(phrases, index, vocab, base), base)
    per_item = found.select("row", "wid").distinct().join(_small(members), "wid").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    closing = index.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = closing.join(covered(found).join(per_item, "row"), "row", "left")
    ids = F.array_sort(F.coalesce("ids", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size(ids) >= min_items).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH cls AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS lo),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, lo), re) AS w FROM documents, cls),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, lo), re) AS w FROM benchmark, cls),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS phrase, least(len(w), 8) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.n, g.i, win.item_id FROM grams g JOIN win ON g.phrase = win.phrase AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
