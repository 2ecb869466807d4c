"""Scan events as a stream: latest scan per repository and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcstrata.operators.relational import top1_per_group

EVENT_COLUMNS = ["scan_run_id", "repository_id", "head_commit_sha", "status", "trigger_type",
                 "started_at"]
EVENT_SCHEMA = ("scan_run_id long, repository_id long, head_commit_sha string, status string, "
                "trigger_type string, started_at timestamp")


def _latest(events: DataFrame) -> DataFrame:
    newest = F.max(F.struct("started_at", "scan_run_id", "head_commit_sha", "status",
                            "trigger_type")).alias("e")
    return events.groupBy("repository_id").agg(newest).select("repository_id", "e.*")


def start_latest_scans(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest scan per repository; changes are appended to a log folder.

    The state store holds one row per repository. Each micro-batch writes only
    the repositories that changed, into its own partition, and a repeated batch
    overwrites that partition: the log is the same after a restart. Replayed or
    late events cannot win over a newer one, since the state is a maximum.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
         .write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy("batch_id").parquet(log))

    return (_latest(events.select(*EVENT_COLUMNS)).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())


def read_latest_scans(spark: SparkSession, log: str) -> DataFrame:
    """Latest scan per repository over all batches of the log; empty where no batch was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    changes = spark.read.schema(EVENT_SCHEMA).parquet(log)
    return top1_per_group(changes, ["repository_id"], [
        F.col("started_at").desc(), F.col("scan_run_id").desc()]).select(*EVENT_COLUMNS)


def start_daily_counts(events: DataFrame, out: str, checkpoint: str, lateness: str = "1 day"
                       ) -> StreamingQuery:
    """Scans per day and trigger, written once a day is closed by the watermark.

    A scan that arrives twice within the lateness counts once; events older than
    the watermark are dropped.
    """
    counts = (events.select("scan_run_id", "trigger_type", "started_at")
              .withWatermark("started_at", lateness)
              .dropDuplicatesWithinWatermark(["scan_run_id"])
              .groupBy(F.window("started_at", "1 day"), "trigger_type")
              .agg(F.count("*").alias("scans"))
              .select(F.to_date("window.start").alias("day"), "trigger_type", "scans"))
    return (counts.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
