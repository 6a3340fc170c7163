"""Forward as-of match: the first commit at or after each event, per key.

Events and commits are tagged, unioned and matched by one window in descending time, whose frame ends at the
current row, so that Spark keeps one running value and the work is linear in a key's rows. The plan has one shuffle on the
keys and one sort. With `bucket_seconds` a key's time line is cut into buckets, each a partition of its own,
and the first commit of the later buckets is carried back, so that one huge repository is dealt over
many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(events: DataFrame, commits: DataFrame, keys: list[str], event_time: str, commit_time: str, commit_order: str, keep_unmatched: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """All columns of events and `commit`, a struct of all columns of the matched commit.

    The match is inclusive; among commits of one time the first in `commit_order`, of any type, wins (nulls first). Events without a later commit
    are dropped, or kept with a null commit. Rows with a null time never match. Null keys match each other.
    Keys and columns may have any names; an event column named `commit` stays beside the added one.
    """
    part = [f"__key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(p) for k, p in zip(keys, part)]
    order_type = commits.schema[commit_order].dataType
    e = events.select(*named, F.col(event_time).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(order_type).alias("__o"), F.struct("*").alias("__event"))
    c = commits.select(*named, F.col(commit_time).alias("__t"), F.lit(1).alias("__k"), F.col(commit_order).alias("__o"), F.struct("*").alias("__commit")).where("__t is not null")
    both = e.unionByName(c, allowMissingColumns=True)
    if bucket_seconds:
        both = both.withColumn("__bucket", F.floor(F.unix_seconds(F.col("__t").cast("timestamp")) / bucket_seconds))
        keyed, part = part, [*part, "__bucket"]
        first = F.min_by(F.when(F.col("__k") == 1, F.col("__commit")), F.when(F.col("__k") == 1, F.struct("__t", "__o")))
        firsts = both.groupBy(*part).agg(first.alias("__first"))
        later = Window.partitionBy(*keyed).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carry = firsts.select(*[F.col(p).alias(f"__c{p}") for p in part], F.last("__first", ignorenulls=True).over(later).alias("__carry"))
        same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"__c{p}")) for p in part))
        both = both.join(carry, same, "left")
    # latest first; of commits at one time the first in order comes last, and before the events of that time
    w = Window.partitionBy(*part).orderBy(F.desc("__t"), F.desc("__k"), F.col("__o").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.last("__commit", ignorenulls=True).over(w)
    if bucket_seconds:
        hit = F.coalesce(hit, F.col("__carry"))
    out = both.withColumn("__hit", F.when(F.col("__t").isNotNull(), hit)).where("__k = 0")
    out = out if keep_unmatched else out.where("__hit is not null")
    return out.select("__event.*", F.col("__hit").alias("commit"))
