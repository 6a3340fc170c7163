"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its weight's share of the mix, at most `most` times its size; what a full
source leaves is shared again by weight, which one pass over the sources in the order of
(capacity / weight) settles exactly. Within a source a document's expected copies m grow with its length: they are
proportional to the bits of its number of words, at most `most`, and scaled so that the source's expected words are its target.
floor(m) whole copies are certain. The rest is a fixed-size sample of unequal probabilities p = m - floor(m): a document has
inclusion odds p / (1 - p) and random odds u / (1 - u); documents are ranked by the quotient and taken in that order as long as
their words fit into what the certain copies leave. What the first that does not fit leaves open is filled, in `ROUNDS` - 1 more
rounds, by those of the rest that are short enough, in the same order; in the last round a document is taken if its middle lies
before the end, so a source's words miss the target by at most half of one short document.

No source is sorted in one place: quotients q fall by q / (1 + q) into `buckets` ranges, whose word sums are made with
map-side combining; a running sum over the buckets of a source finds the one in which its end lies,
and only the documents of that bucket are ranked. A source then has one cut, (quotient, doc_id), at
which every document is judged on its own. Expected copies need the word sums of a source's length classes only, of
which there are 64 at most. One row for each source meets in one task, nothing larger.

Defined results: a null or blank text has size 0 and is never taken; a null source is the last
source; documents with equal doc_id and length class in one source have equal quotients and are taken or left together;
a source of size 0 has target 0; an empty table gives an empty result; other columns, whatever their names, are carried
unchanged by `mix_documents` and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import WORD_RE, cut, read, small

WEIGHTS, SHARE, MOST, BUCKETS, SEED, ROUNDS = (5, 2, 1), 1.5, 2, 4096, "mix", 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the document's id and the seed only."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target. One row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(float(most)) * F.col("source_size")).alias("cap")
    each = sizes.withColumn("w", w).select("*", cap)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    full, left = F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(full, F.lit(0.0))) / left
    each = each.withColumn("level", level)
    # the first source, in this order, that is not full sets the level of all that follow
    end = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)
    return each.withColumn("end", end["level"]).select("source", "source_size", F.when(F.col("end").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("end") * F.col("w"))).alias("target"))


def quotient(u: Column, p: Column) -> Column:
    """Pareto rank: random odds divided by inclusion odds."""
    return F.try_divide(u / (1 - u), p / (1 - p))


def shares(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized: source, bits, size. For each source and length class: source_size, target, rest (words to be sampled), copies and p."""
    classes = cut(sized.groupBy("source", "bits").agg(F.sum("size").alias("words")))
    goal = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    each = classes.join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    down = Window.partitionBy("source").orderBy(F.desc("bits"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("bits")).over(down.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", F.try_divide(F.col("target") - F.lit(float(most)) * full, open_.cast("double")))
    # the longest class that is not full sets the level of all shorter ones
    level = F.max(F.when(F.col("level") * F.col("bits") <= most, F.struct("bits", "level"))).over(Window.partitionBy("source"))["level"]
    m = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(most)), level * F.col("bits")), F.lit(float(most))))
    each = each.withColumn("m", m).withColumn("copies", F.floor("m").cast("long"))
    certain = F.sum(F.col("copies") * F.col("words")).over(Window.partitionBy("source"))
    return each.select("source", "bits", "source_size", "target", "copies", (F.col("m") - F.col("copies")).alias("p"), (F.col("target") - certain).alias("rest"))


def _ranked(docs: DataFrame, share: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, source, bits. Adds each document's share, its rank `at` (quotient and id) and bucket, null where p is 0."""
    share = share.withColumnsRenamed({"source": "s_source", "bits": "s_bits"})
    u = draw(F.col("doc_id"))
    q = quotient(u, F.col("p"))
    met = docs.join(small(share), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bits") == F.col("s_bits"))).drop("s_source", "s_bits")
    return met.withColumns({"q": q, "bucket": F.floor(q / (1 + q) * buckets).cast("int"), "id": F.coalesce(F.col("doc_id"), F.lit(-(2**63)))})


def cuts(ranked: DataFrame, last: bool) -> DataFrame:
    """ranked: source, size, room, q, bucket, id. One row for each source that samples: its cut (last_bucket, end) and `left`, the room after it."""
    held = cut(ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("room").alias("room")))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).where(F.col("before") < F.col("room"))
    ends = cut(before.groupBy("source").agg(F.max("bucket").alias("last_bucket"), F.max("before").alias("before"), F.first("room").alias("s_room")).withColumnRenamed("source", "s"))
    inside = ranked.join(small(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("last_bucket"))).withColumn("at", F.struct("q", "id"))
    placed = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("at"))).withColumn("same", F.sum("size").over(Window.partitionBy("s", "at")))
    fits = F.col("upto") - F.col("same") / 2 < F.col("room") if last else F.col("upto") <= F.col("room")
    end = placed.where(fits).groupBy("s").agg(F.max("at").alias("end"), F.max("upto").alias("upto")).withColumnRenamed("s", "e")
    out = ends.join(end, F.col("e").eqNullSafe(F.col("s")), "left")
    return cut(out.select(F.col("s").alias("c_source"), "last_bucket", "end", (F.col("s_room") - F.coalesce("upto", "before")).alias("left")))


def _taken() -> Column:
    """Whether a ranked document lies before its source's cut."""
    more = (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (F.struct("q", "id") <= F.col("end")))
    return F.coalesce(more, F.lit(False))


def _times(docs: DataFrame, weights, share: float, most: int, buckets: int) -> DataFrame:
    """docs: doc_id (long), source, size. Adds source_size, target and times, the copies that the mix takes."""
    sized = docs.withColumn("bits", F.length(F.bin("size")))
    plain = cut(sized.select("doc_id", "source", "size", "bits"))
    parted = cut(shares(plain, weights, share, most))
    met = _ranked(sized, parted, buckets).withColumns({"room": F.col("rest"), "sampled": F.lit(0).cast("long")})
    pool = _ranked(plain, parted, buckets).where("bucket is not null").withColumn("room", F.col("rest"))
    for k in range(ROUNDS):
        ends = cuts(pool, k == ROUNDS - 1)
        here = F.col("source").eqNullSafe(F.col("c_source"))
        asked = (F.col("sampled") == 0) & (F.col("size") <= F.col("room")) if k else F.lit(True)
        met = met.join(small(ends), here, "left").withColumn("sampled", F.when(asked & _taken(), 1).otherwise(F.col("sampled")).cast("long"))
        met = met.withColumn("room", F.coalesce("left", "room")).drop("c_source", "last_bucket", "end", "left")
        pool = pool.join(small(ends), here).where(~_taken() & (F.col("size") <= F.col("left"))).withColumn("room", F.col("left")).drop("c_source", "last_bucket", "end", "left")
    return met.withColumn("times", F.when(F.col("size") > 0, F.col("copies") + F.col("sampled")).otherwise(F.lit(0).cast("long")))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, source, text)."""
    met = _times(cut(docs.select(*_own(docs))), weights, share, most, buckets)
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns."""
    met = _times(docs.select(F.struct("*").alias("row"), *_own(docs)), weights, share, most, buckets)
    return met.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w,
         2.0::DOUBLE * source_size::DOUBLE AS cap
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS k
  FROM weighed),
goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels),
classes AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
steps AS (
  SELECT c.*, g.source_size, g.target,
         (g.target - 2.0::DOUBLE * coalesce(sum(words) OVER down, 0)::DOUBLE) / nullif(sum(words * bits) OVER rest, 0)::DOUBLE AS level
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
  WINDOW down AS (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
expected AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
            ELSE coalesce(least(2.0::DOUBLE, (arg_max(level, bits) FILTER (level * bits <= 2) OVER (PARTITION BY source)) * bits), 2.0::DOUBLE) END AS m
  FROM steps),
shares AS (SELECT *, floor(m) AS copies, m - floor(m) AS p, target - sum(floor(m) * words) OVER (PARTITION BY source) AS rest FROM expected),
met AS (
  SELECT d.*, s.source_size, s.target, s.copies, s.rest, CASE WHEN s.p > 0 THEN (u / (1 - u)) / (s.p / (1 - s.p)) END AS q
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND length(bin(d.size)) = s.bits),
r1 AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS t1 FROM met),
room1 AS (SELECT *, rest - coalesce(sum(CASE WHEN t1 THEN size END) OVER (PARTITION BY source), 0) AS left1 FROM r1),
r2 AS (
  SELECT *, q IS NOT NULL AND NOT t1 AND size <= left1 AS in2 FROM room1),
f2 AS (SELECT *, in2 AND sum(size) OVER (PARTITION BY source, in2 ORDER BY q, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= left1 AS t2 FROM r2),
room2 AS (SELECT *, left1 - coalesce(sum(CASE WHEN t2 THEN size END) OVER (PARTITION BY source), 0) AS left2 FROM f2),
r3 AS (SELECT *, in2 AND NOT t2 AND size <= left2 AS in3 FROM room2),
f3 AS (
  SELECT *, in3 AND sum(size) OVER (PARTITION BY source, in3 ORDER BY q, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    - sum(size) OVER (PARTITION BY source, in3, q, doc_id) / 2.0 < left2 AS t3
  FROM r3)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN t1 OR t2 OR t3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f3
"""
