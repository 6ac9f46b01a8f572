"""Mixing sources to target weights with a low-discrepancy schedule.

Slots are numbered 1, 2, ...; the golden-ratio point of slot k, k * PHI mod 2^32, falls into one source's share of the cumulative
targets. The rank of a slot among its source's slots names the block of the source's shuffled word stream that it carries: block b
holds words [b * n, (b + 1) * n) of the stream, which is repeated CAP times and then ends. mixture() joins slots with blocks and is the
mix itself; what is taken of a document is the sum of its words there. How often a source is met, so how much of it is taken, follows
from the points alone: they keep it within a few blocks of its target. Blocks are equal, of one word up to BLOCK, such that there are
SLOTS slots or more once there are as many words. Integer arithmetic throughout: reruns agree.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share all sizes; a target above CAP times
its source's size stops there and its excess is reshared by weight until none is above. Each pass sums over sources.

Documents lie in a source's stream by the md5 of (SEED, doc_id, size): words up to a document are
a running sum in two levels, hash ranges of a source first, so that a source with most rows is spread over tasks.

Cases: null, empty and blank texts have size 0 and take nothing; null is a source of its own; repeated doc_ids are
documents of their own; an empty table gives no rows; sources without words have target 0, and a source whose target is a word or two
may be met by no point; other columns are ignored.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

WEIGHTS, CAP, BLOCK, SEED = (5, 2, 1), 3, 1024, 42
#: 2^32 divided by the golden ratio, odd.
PHI, POINTS = 2654435769, 1 << 32
#: Slots at least, as long as there are as many words.
SLOTS = 1 << 16
#: Slots whose ranks one task counts at once; hash ranges a source's stream is cut into.
SLOT_RANGE, STREAM_RANGES = 8192, 4096
#: A counted side of so many narrow rows at most is broadcast.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def sized(docs: DataFrame, base: str) -> DataFrame:
    """(row, doc_id, source, size, place): place is the 128-bit shuffle key, as hex; stored."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    one = docs.select("doc_id", "source", size.alias("size"))
    # Rows of one source that share id and size share a place and are interchangeable.
    key = F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    return stored(one.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", F.md5(key.cast("binary")).alias("place")), f"{base}/sized")


def targets(docs: DataFrame, base: str) -> DataFrame:
    """(source, source_size, weight, target, lo, hi): target words and the share [lo, hi) of the 2^32 points; one row a source."""
    each = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    cur = stored(ranked.select("source", "rank", "source_size", weight.alias("weight"), F.lit(False).alias("full")), f"{base}/sources0")
    cap, step = CAP * F.col("source_size"), 0
    while True:
        t = cur.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("full"), cap).otherwise(0)).alias("capped"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open")).first()
        level = (t.total - t.capped) / t.open if t.open else 0.0
        now = F.col("full") | (level * F.col("weight") > cap)
        if not cur.where(~F.col("full") & now).limit(1).count():
            break
        step += 1
        cur = stored(cur.withColumn("full", now), f"{base}/sources{step}")
    out = cur.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.lit(float(level)) * F.col("weight")))
    quota = F.round("target").cast("long")
    cum = F.sum("quota").over(Window.orderBy("rank"))
    out = stored(out.withColumn("quota", quota).withColumn("cum", cum), f"{base}/quotas")
    out = out.withColumn("all", F.lit(max(out.agg(F.max("cum")).first()[0] or 0, 1)).cast("long"))
    point = lambda c: F.floor(F.least(c / F.col("all"), F.lit(1.0)) * POINTS).cast("long")
    return stored(out.select("source", "rank", "source_size", "weight", "target", "quota", point(F.col("cum") - F.col("quota")).alias("lo"), point(F.col("cum")).alias("hi")), f"{base}/targets")


def block_words(goals: DataFrame) -> tuple[int, int]:
    """Words of a block and number of slots."""
    total = goals.agg(F.sum("quota")).first()[0] or 0
    block = max(1, min(BLOCK, total // SLOTS))
    return block, -(-total // block)


def schedule(spark: SparkSession, goals: DataFrame, base: str) -> DataFrame:
    """(slot, source_rank, nth): the slots in order, each source's ranks from 0; stored."""
    slots = block_words(goals)[1]
    # k * PHI mod 2^32 by halves of k, which no product overflows.
    high, low = F.shiftright("id", 16).bitwiseAND(F.lit(0xFFFF)), F.col("id").bitwiseAND(F.lit(0xFFFF))
    k = spark.range(1, slots + 1).select(F.col("id").alias("slot"), ((high * PHI % 65536 * 65536 + low * PHI) % POINTS).alias("point"))
    share = goals.select(F.col("rank").alias("source_rank"), "lo", "hi").where("hi > lo")
    # Sources are joined by the 2^16 cells of the points they reach into, so that this is an equi-join for any number of them.
    cell = F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright(F.col("hi") - 1, 16)))
    placed = k.withColumn("cell", F.shiftright("point", 16)).join(share.withColumn("cell", cell), "cell").where("point >= lo AND point < hi")
    placed = stored(placed.select("slot", "source_rank", F.floor(F.col("slot") / SLOT_RANGE).alias("part")), f"{base}/slots")
    before = placed.groupBy("source_rank", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source_rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source_rank", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("source_rank", "part").orderBy("slot")) - 1
    nth = placed.withColumn("r", rank).join(before, ["source_rank", "part"]).select("slot", "source_rank", (F.col("r") + F.col("earlier")).alias("nth"))
    return stored(nth, f"{base}/schedule")


def streams(docs: DataFrame) -> DataFrame:
    """docs with `at`: words of the source before the document in its shuffled stream."""
    part = F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % STREAM_RANGES
    cut = docs.withColumn("part", part)
    sums = cut.groupBy("source", "part").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = cut.withColumn("inner", inner).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return out.withColumn("at", F.col("inner") + F.col("earlier")).drop("s", "p", "part", "inner", "earlier")


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """The words of blocks: (source_rank, nth, row, doc_id, from_word, to_word). docs: streams() with source_rank, source_size and slots,
    the source's number of slots; blocks that no slot carries are left out."""
    reach = F.least(F.col("slots") * block, CAP * F.col("source_size"))
    s = docs.where("size > 0").withColumn("reach", reach).where(F.col("at") < F.col("reach"))
    s = s.withColumn("lap", F.explode(F.sequence(F.lit(0), F.floor((F.col("reach") - 1 - F.col("at")) / F.col("source_size")).cast("int"))))
    s = s.withColumn("start", F.col("at") + F.col("lap") * F.col("source_size"))
    s = s.withColumn("nth", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.least(F.col("start") + F.col("size"), F.col("reach")) - 1) / block))))
    lo = F.greatest(F.lit(0), F.col("nth") * block - F.col("start"))
    hi = F.least("size", F.least((F.col("nth") + 1) * block, F.col("reach")) - F.col("start"))
    return s.select("source_rank", "nth", "row", "doc_id", lo.alias("from_word"), hi.alias("to_word"))


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sources' figures, slots, and the words of their blocks."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    each = sized(docs, base)
    goals = targets(each, base)
    block, slots = block_words(goals)[0], schedule(spark, goals, base)
    met = slots.groupBy("source_rank").agg(F.count(F.lit(1)).alias("slots"))
    per = goals.withColumnRenamed("rank", "source_rank").join(met, "source_rank", "left")
    per = per.select(F.col("source").alias("src"), "source_rank", "source_size", "target", F.coalesce("slots", F.lit(0)).alias("slots"))
    full = stored(streams(each).join(_small(per), F.col("source").eqNullSafe(F.col("src"))).drop("src", "place"), f"{base}/streams")
    return full, slots, blocks(full, block)


def mixture(docs: DataFrame) -> DataFrame:
    """The mix: (slot, doc_id, from_word, to_word), the words of each document that a slot carries, slots in order of the training stream."""
    _, slots, words = _parts(docs)
    return slots.join(words, ["source_rank", "nth"]).select("slot", "doc_id", "from_word", "to_word")


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mix)."""
    full, slots, words = _parts(docs)
    taken = slots.join(words, ["source_rank", "nth"]).groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = full.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


# A source that the points meet n times takes the first n blocks of its repeated stream.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT *, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size) AS place FROM d),
s AS (SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
o AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, coalesce(CAST(sum(3 * source_size) OVER before AS BIGINT), 0) AS capped, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k
      FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - capped) / open, k) FILTER ((total - capped) / open * w <= 3 * source_size), 0) AS level FROM o),
t AS (SELECT source AS src, source_size, CASE WHEN level * w > 3 * source_size THEN 3.0::DOUBLE * source_size ELSE level * w END AS target FROM s, l),
u AS (SELECT *, CAST(sum(quota) OVER (ORDER BY src NULLS LAST) AS BIGINT) AS cum, CAST(sum(quota) OVER () AS BIGINT) AS every FROM (SELECT *, CAST(round(target) AS BIGINT) AS quota FROM t)),
n AS (SELECT greatest(1, least(1024, every // 65536)) AS block, every FROM u LIMIT 1),
k AS (SELECT CAST(k AS HUGEINT) * 2654435769 % 4294967296 AS point FROM (SELECT unnest(range(1, CAST((every + block - 1) // block AS BIGINT) + 1)) AS k FROM n)),
m AS (SELECT src, count(*) AS slots FROM k JOIN u ON point >= floor(least((cum - quota) / greatest(every, 1), 1.0) * 4294967296) AND point < floor(least(cum / greatest(every, 1), 1.0) * 4294967296) GROUP BY src),
r AS (SELECT u.src, u.source_size, u.target, least(coalesce(slots, 0) * block, 3 * u.source_size) AS reach FROM u CROSS JOIN n LEFT JOIN m ON m.src IS NOT DISTINCT FROM u.src),
q AS (SELECT p.*, r.source_size, r.target, r.reach, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_word FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.src)
SELECT doc_id, size, source_size, target, CAST(reach // greatest(source_size, 1) * size + greatest(0, least(size, reach % greatest(source_size, 1) - at_word)) AS BIGINT) AS taken FROM q
"""
