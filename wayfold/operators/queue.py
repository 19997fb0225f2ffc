"""Review queue as snapshots: claims and resolutions produce the next version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def claim(queue: DataFrame, n: int, reviewer: str) -> DataFrame:
    """The queue after ``reviewer`` has taken the ``n`` oldest open items."""
    taken = queue.where("status = 'OPEN'").orderBy("created_at", "item_id").limit(n).select("item_id", F.lit(True).alias("_taken"))
    took = F.col("_taken").isNotNull()
    return queue.join(taken, "item_id", "left").select(
        *(c for c in queue.columns if c not in ("status", "version", "assigned_to")),
        F.when(took, "CLAIMED").otherwise(F.col("status")).alias("status"),
        F.when(took, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(took, F.lit(reviewer)).otherwise(F.col("assigned_to")).alias("assigned_to"),
    )


def shares(queue: DataFrame, reviewers: list[str], n: int) -> DataFrame:
    """Disjoint shares of the ``n`` oldest open items a reviewer, dealt in turn."""
    k = len(reviewers)
    first = queue.where("status = 'OPEN'").orderBy("created_at", "item_id").limit(n * k)
    place = F.row_number().over(W.orderBy("created_at", "item_id")) - 1
    return first.withColumn("_place", place).select("item_id", F.element_at(F.array(*map(F.lit, reviewers)), (F.col("_place") % k + 1).cast("int")).alias("reviewer"))


def resolve(queue: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next queue, and the resolutions that do not fit: the item is not claimed or has another version."""
    wanted = resolutions.select("item_id", F.col("expected_version").alias("_expected"), F.col("resolution").alias("_resolution"))
    joined = queue.join(wanted, "item_id", "left")
    fits = (F.col("status") == "CLAIMED") & (F.col("version") == F.col("_expected"))
    done = F.col("_expected").isNotNull() & fits
    after = joined.select(
        *(c for c in queue.columns if c not in ("status", "version", "resolution")),
        F.when(done, "RESOLVED").otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(done, F.col("_resolution")).otherwise(F.col("resolution")).alias("resolution"),
    )
    lost = resolutions.join(queue.select("item_id", "status", "version"), "item_id", "left")
    clash = lost.where(~F.coalesce((F.col("status") == "CLAIMED") & (F.col("version") == F.col("expected_version")), F.lit(False)))
    return after, clash.select("item_id", "expected_version", "status", "version")
