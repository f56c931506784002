"""The incremental history as a stream: the versions that newly arrived snapshot files touch are told anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symloom.operators import history as H
from symloom.plans.lineage import cut

#: Batch number of what no batch has told; compacted tables begin with it.
NONE = -1
TOLD = "package_id string, version string, batch long"


def _told(spark: SparkSession, history_path: str, before: int | None = None) -> DataFrame:
    """(package_id, version, batch): the latest batch that told each version, of those before ``before``.

    Read from the last compacted list and the lists of the batches after it.
    """
    bases = spark.read.schema(f"{TOLD}, upto long").parquet(f"{history_path}/told_base")
    bases = bases if before is None else bases.filter(F.col("upto") < before)
    upto = bases.agg(F.max("upto")).first()[0]
    base = bases.filter((F.col("upto") == upto) & (F.col("batch") > NONE)).select("package_id", "version", "batch")
    later = spark.read.schema(TOLD).parquet(f"{history_path}/told").filter(F.col("batch") > upto)
    later = later if before is None else later.filter(F.col("batch") < before)
    return base.unionByName(later.filter("version IS NOT NULL")).groupBy("package_id", "version").agg(F.max("batch").alias("batch"))


def of_versions(kept: DataFrame, needed: DataFrame, listed: int = 5_000) -> DataFrame:
    """The rows of ``kept`` (partitioned by package and version) of the ``needed`` versions.

    Up to ``listed`` versions are named in the plan, so that no other folder is opened; more are met by a join.
    """
    few = needed.limit(listed + 1).collect()
    if len(few) <= listed:
        kept = kept.filter(F.concat_ws("\n", "package_id", "version").isin([f"{r['package_id']}\n{r['version']}" for r in few]))
    return kept.join(needed, ["package_id", "version"], "left_semi")


def stream_history(spark: SparkSession, symbols_dir: str, history_path: str, checkpoint: str, schema: StructType, mode: str = "build") -> None:
    """Read what has arrived in ``symbols_dir`` (parquet) and tell the versions that it touches.

    Each batch keeps its rows below ``snapshots``, by package and version. Versions that it brings rows of, also for
    a second time, and those that follow them, are diffed from all rows kept; ``told`` lists them, also those without
    changes, and the rows of the latest batch that told a version count. So rows that come in several files, late
    releases and files that come twice end in the history of the whole table, and a batch that runs again writes
    the same files anew.

    What a batch reads follows the batch: the list of versions told tells which ones are neighbours, and of the
    snapshots only the folders of the versions it touches, of those before and those after them are opened. Rows of
    one version are spread over as many files as their size asks for. ``compact`` keeps the lists short.
    """
    snapshots, told, deltas = (f"{history_path}/{name}" for name in ("snapshots", "told", "deltas"))
    spark.createDataFrame([(None, None, NONE)], TOLD).withColumn("upto", F.lit(NONE)).write.mode("ignore").partitionBy("upto").parquet(f"{history_path}/told_base")
    spark.createDataFrame([], TOLD).drop("batch").write.mode("ignore").parquet(f"{told}/batch={NONE}")

    def step(batch: DataFrame, number: int) -> None:
        touched = cut(batch.select("package_id", "version").distinct())
        if touched.isEmpty():
            return
        batch.hint("rebalance", "package_id", "version").write.mode("overwrite").partitionBy("package_id", "version").parquet(f"{snapshots}/batch={number}")
        here = touched.select("package_id").distinct()
        before = _told(spark, history_path, number).join(here, "package_id", "left_semi").select("package_id", "version").join(touched, ["package_id", "version"], "left_anti")
        versions = cut(before.unionByName(touched))
        stale = cut(H.stale_versions(versions.join(touched, ["package_id", "version"], "left_anti"), versions, versions))
        needed = stale.select("package_id", "version").union(stale.filter("previous_version IS NOT NULL").select("package_id", "previous_version")).distinct()
        kept = spark.read.schema(schema).parquet(snapshots).filter(F.col("batch") <= number)
        symbols = of_versions(kept, needed).select(*schema.names)
        new = H.deltas_of(stale, symbols, versions, mode)
        new.write.mode("overwrite").parquet(f"{deltas}/batch={number}")
        stale.select("package_id", "version").write.mode("overwrite").parquet(f"{told}/batch={number}")

    query = spark.readStream.schema(schema).parquet(symbols_dir).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start()
    query.awaitTermination()


def compact(spark: SparkSession, history_path: str) -> int:
    """Write the valid rows of all batches so far as one table and one list; returns the last batch they cover.

    From then on batches and ``read_history`` open what that batch and older ones wrote no more, and it may be deleted
    (``deltas/batch=n`` and ``told/batch=n``; batch -1 stays, and so do the snapshots, which hold the symbols). Run it
    between streams. Nothing new since the last time writes nothing.
    """
    valid = cut(_told(spark, history_path))
    upto = valid.agg(F.max("batch")).first()[0]
    last = spark.read.schema(f"{TOLD}, upto long").parquet(f"{history_path}/told_base").agg(F.max("upto")).first()[0]
    if upto is None or upto <= last:
        return last
    read_history(spark, history_path).write.mode("overwrite").parquet(f"{history_path}/deltas_base/upto={upto}")
    valid.write.mode("overwrite").parquet(f"{history_path}/told_base/upto={upto}")  # what readers go by comes last
    return upto


def read_history(spark: SparkSession, history_path: str) -> DataFrame:
    """The deltas of every version, from the latest batch that told it."""
    upto = spark.read.schema(f"{TOLD}, upto long").parquet(f"{history_path}/told_base").agg(F.max("upto")).first()[0]
    told = _told(spark, history_path)
    deltas = spark.read.parquet(f"{history_path}/deltas").filter(F.col("batch") > upto)
    recent = deltas.join(told.filter(F.col("batch") > upto), ["package_id", "version", "batch"], "left_semi").drop("batch")
    if upto == NONE:
        return recent
    base = spark.read.parquet(f"{history_path}/deltas_base").filter(F.col("upto") == upto).drop("upto")
    return base.join(told.filter(F.col("batch") <= upto), ["package_id", "version"], "left_semi").select(*recent.columns).unionByName(recent)
