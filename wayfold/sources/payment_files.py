"""Payment messages in large XML files, split at their transactions.

A file may hold one message of any length or many messages one after another.
It is read as text whose records end with the transaction's closing tag, so
Spark splits one file over many tasks and no task holds a message whole. What
stands before a transaction's opening tag is the end of the last message or the
head of the next, with its identification.

Which message a transaction belongs to, and its number there, depend on the
records before it. Records are landed once with the block that they were read
in; a running number within each block and the sums of the blocks before give
the rest. The one window over a whole file has a row a block.

Transactions are those of ``parties``, numbered from 0 by message; one that does not
parse keeps its number and gives no rows; a file without an identification is
named by its file name. Closing tags within comments or character data are not
told apart. Compressed files are read by one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.sources.payments import POSTAL, ROLES


def transactions(spark: SparkSession, path: str, tag: str = "CdtTrfTxInf", message: str = "MsgId") -> DataFrame:
    """One row a transaction: ``file, block, seq, head, xml``; ``head`` is the identification of the message that starts there."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    opened = F.regexp_instr("value", F.lit(rf"<{tag}[\s/>]"))
    rows = rows.withColumn("_at", opened).where("_at > 0")
    before = F.expr("substring(value, 1, _at - 1)")
    head = F.regexp_extract(before, rf"(?s).*<{message}>\s*(.*?)\s*</{message}>", 1)
    return rows.select("file", "block", "seq", F.nullif(head, F.lit("")).alias("head"), F.concat(F.expr("substring(value, _at)"), F.lit(f"</{tag}>")).alias("xml"))


def land(spark: SparkSession, path: str, target: str, roles: tuple[str, ...] = ROLES[:2]) -> DataFrame:
    """Parse the transactions of ``path`` and write them to ``target``, a new folder that driver and executors share."""
    schema = ",".join(f"{r} struct<Nm:string,PstlAdr:{POSTAL}>" for r in roles)
    rows = transactions(spark, path).withColumn("t", F.from_xml(F.col("xml"), schema, {"mode": "PERMISSIVE"}))
    rows.select("file", "block", "seq", "head", *(F.col(f"t.{r}.PstlAdr").alias(r) for r in roles)).write.parquet(target)
    return spark.read.parquet(target)


def numbered(landed: DataFrame) -> DataFrame:
    """Append ``message_id`` and ``tx``, the transaction's number in its message."""
    inside = Window.partitionBy("file", "block").orderBy("seq")
    rows = landed.withColumn("_k", F.row_number().over(inside))
    starts = F.when(F.col("head").isNotNull(), F.struct("_k", "head"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("_n"), F.max(starts).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # places count from the file's first transaction
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    blocks = blocks.withColumn("_base", base).withColumn("_open", F.when(F.col("_last").isNotNull(), F.struct((F.col("_base") + F.col("_last._k")).alias("place"), F.col("_last.head").alias("head"))))
    blocks = blocks.select("file", "block", "_base", F.last("_open", ignorenulls=True).over(earlier).alias("_before"))
    own = F.last(starts, ignorenulls=True).over(inside)
    joined = rows.withColumn("_own", own).join(blocks, ["file", "block"])
    start = F.coalesce(F.col("_base") + F.col("_own._k"), F.col("_before.place"), F.lit(1))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return joined.select(*landed.columns, F.coalesce("_own.head", "_before.head", name).alias("message_id"), (F.col("_base") + F.col("_k") - start).cast("int").alias("tx"))


def parties(landed: DataFrame, roles: tuple[str, ...] = ROLES[:2]) -> DataFrame:
    """One row an address, as ``payments.parties`` gives for whole messages."""
    both = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("PstlAdr")) for r in roles))
    rows = numbered(landed).select("message_id", "tx", F.explode(both).alias("p")).select("message_id", "tx", "p.*").where("PstlAdr is not null")
    return rows.withColumn("correlation_id", F.concat_ws("/", "message_id", "tx", "role"))
