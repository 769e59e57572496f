"""Edit history as tables: steps (session_id, seq, label) and pointers (session_id, at); nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def push(steps: DataFrame, pointers: DataFrame, new: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Steps after the pointer go, the new one (session_id, label) is added, the last ``most`` stay."""
    kept = steps.join(pointers, "session_id", "left").where(F.col("at").isNull() | (F.col("seq") <= F.col("at"))).drop("at")
    last = kept.groupBy("session_id").agg(F.max("seq").alias("last"))
    added = new.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("seq"), "label")
    out = capped(kept.unionByName(added), most)
    at = out.groupBy("session_id").agg(F.max("seq").alias("at"))
    return out, at


def capped(steps: DataFrame, most: int = 20) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    return steps.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def moved(steps: DataFrame, pointers: DataFrame, by: int) -> DataFrame:
    """Undo (-1), redo (+1) or a jump: the pointer stays within the steps there are."""
    ends = steps.groupBy("session_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return pointers.join(ends, "session_id").select("session_id", F.greatest("lo", F.least("hi", F.col("at") + by)).cast("int").alias("at"))


def undo(steps: DataFrame, pointers: DataFrame) -> DataFrame:
    return moved(steps, pointers, -1)


def redo(steps: DataFrame, pointers: DataFrame) -> DataFrame:
    return moved(steps, pointers, 1)


def start_over(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the first step is left."""
    first = steps.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy("seq"))).where("rank = 1").drop("rank")
    return first, first.select("session_id", F.col("seq").alias("at"))


def current(steps: DataFrame, pointers: DataFrame) -> DataFrame:
    return steps.join(pointers, "session_id").where("seq = at").drop("at")


def pop(steps: DataFrame) -> DataFrame:
    """Without each session's last step: one critique undone."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    return steps.withColumn("rank", rank).where("rank > 1").drop("rank")


def mask_snapshots(steps: DataFrame, most: int = 21) -> DataFrame:
    """Mask history keeps the last 20 and the present one."""
    return capped(steps, most)
