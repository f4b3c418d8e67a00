"""Live chunks and what becomes of packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a pack is rewritten from this share of dead bytes on.
DEAD_SHARE = 0.25
#: Bytes of stored tables for a task of a join. Rows that it sorts take several times as many.
TASK_BYTES = 16 << 20


def tasks_for(*tables: DataFrame) -> int:
    """To how many tasks a join of these tables is dealt, so that the share of a task does not grow with what they are read from;
    0 where Spark deals to as many. Nothing is run: plans know the sizes of files, and what has no known size is left out."""
    spark, size = tables[0].sparkSession, 0
    unknown = int(spark.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1)))
    for df in tables:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < unknown)
    n = -(-size // TASK_BYTES)
    return n if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else 0


def live_chunks(refs: DataFrame, kept: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Distinct chunks (data and delta sources) of the kept snapshots. Their names are few and go to all tasks: dealt by
    snapshot, all references of one would come to one task."""
    return refs.join(F.broadcast(kept.select(snapshot)), snapshot, "left_semi").select("chunk_id").distinct()


def with_live(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Entries, with a column that says whether their chunk is live."""
    live, tasks = live.select("chunk_id"), tasks_for(entries, live)
    if tasks:
        entries, live = entries.repartition(tasks, "chunk_id"), live.repartition(tasks, "chunk_id")
    return entries.join(live.withColumn("live", F.lit(True)), "chunk_id", "left").withColumn("live", F.col("live").isNotNull())


def dead_chunks(index: DataFrame, live: DataFrame) -> DataFrame:
    """An outer join too: the optimizer would push an anti join below the dealing."""
    return with_live(index, live).where("not live").drop("live")


def classify_packs(pack_entries: DataFrame, live: DataFrame, packs: DataFrame, threshold: float = DEAD_SHARE) -> DataFrame:
    """(pack_id, bytes, live_chunks, dead_chunks, dead_bytes, action): keep, delete or rewrite. What a pack holds decides, not
    what the index says of it: a chunk stored twice counts in both packs, and a pack without entries is kept."""
    alive = F.col("live")
    sums = with_live(pack_entries.select("chunk_id", "pack_id", "comp_size"), live).groupBy("pack_id").agg(F.count_if(alive).alias("live_chunks"), F.count_if(~alive).alias("dead_chunks"), F.sum(F.when(alive, 0).otherwise(F.col("comp_size"))).alias("dead_bytes"))
    rows = packs.select("pack_id", "bytes").join(sums, "pack_id", "left").fillna(0, ["live_chunks", "dead_chunks", "dead_bytes"])
    action = F.when(F.col("dead_chunks") == 0, "keep").when(F.col("live_chunks") == 0, "delete").when(F.col("dead_bytes") < threshold * F.col("bytes"), "keep").otherwise("rewrite")
    return rows.select("pack_id", "bytes", "live_chunks", "dead_chunks", "dead_bytes", action.alias("action"))


def prune_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Packs and bytes before and after, and the bytes freed, in one row."""
    side = lambda df, x: df.agg(F.count("*").alias(f"packs_{x}"), F.coalesce(F.sum("bytes"), F.lit(0)).alias(f"bytes_{x}"))
    return side(before, "before").crossJoin(side(after, "after")).withColumn("freed", F.col("bytes_before") - F.col("bytes_after"))  # one row each


def planned_stats(classified: DataFrame) -> DataFrame:
    """The same row of what classify_packs returns, in one pass: packs that are not deleted stay as they are."""
    stays = F.col("action") != "delete"
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = classified.agg(F.count("*").alias("packs_before"), total(F.col("bytes")).alias("bytes_before"), F.count_if(stays).alias("packs_after"), total(F.when(stays, F.col("bytes"))).alias("bytes_after"))
    return sums.withColumn("freed", F.col("bytes_before") - F.col("bytes_after"))


def dry_run(retained: DataFrame) -> DataFrame:
    return retained.agg(F.count("*").alias("total"), F.count_if("keep").alias("keep"), F.count_if(~F.col("keep")).alias("delete"))
