"""Change envelopes as a stream: the ledger as keyed state, one micro-batch at a time.

A key's changes reach one task, in order of seq within a micro-batch; between micro-batches the source keeps a key's
order, as a topic's partitions do. Redelivery of a batch is harmless: a change at or below the key's last
seq is ignored and counted in the column late, and sinks write a folder a batch, which a repeated batch overwrites. A deleted
key's state goes TOMBSTONE_DAYS after its last change, with the next batch that has data; what comes for it later starts anew.
Keys of a stretch of 32 ids are kept and called together, as a call costs far more than a key's few changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haulmark.operators.cdc import parse, route
from haulmark.schemas import OPS

LOG = "seq long, value string"
ROW = "source_id long, lane string, status string, attempts int, source_version long, last_seq long, deleted boolean, late int"
TOMBSTONE_DAYS = 7
#: Bits of an id within its stretch, the unit of calls and states: at most 32 keys, however many there are in all.
STRETCH = 5
#: expires: when a deleted key is forgotten, in milliseconds since 1970; null while it is alive.
STATE = "held array<struct<id:bigint,attempts:int,source_version:bigint,last_seq:bigint,alive:boolean,expires:bigint>>"
#: A processing-time timeout asks for another batch after every one: with batches without data, a job would never have caught up.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def advance(state: tuple | None, seq: int, op: str, version: int) -> tuple:
    """(attempts, version, seq, alive) after one change; the vendor well, the source there."""
    attempts, held, last, alive = state or (0, 0, -1, False)
    if seq <= last:
        return state
    if op == "d":
        return 0, 0, seq, False
    if op == "u":
        return (attempts if alive else 0) + 1, version, seq, True
    return (attempts, held, seq, True) if alive else (1, 0, seq, True)


def apply_changes(changes: DataFrame) -> DataFrame:
    """Streaming changes (seq, id, op, version) -> a row for each key that a micro-batch touched."""

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        clock = state.getCurrentProcessingTimeMs()
        held = {i: (tuple(now), expires) for i, *now, expires in (state.get[0] if state.exists else [])}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.iloc[np.lexsort((rows["seq"], rows["id"]))]
            ids, starts = np.unique(rows["id"].to_numpy(), return_index=True)
            seqs, ops, versions = (rows[c].tolist() for c in ("seq", "op", "version"))
            for i, at, end in zip(ids.tolist(), starts, [*starts[1:], len(rows)], strict=True):
                (now, _), late = held.get(i, (None, None)), 0
                for seq, op, version in zip(seqs[at:end], ops[at:end], versions[at:end], strict=True):
                    late += now is not None and seq <= now[2]
                    now = advance(now, seq, op, version)
                attempts, version, seq, alive = now
                held[i] = now, None if alive else clock + max(1, int(TOMBSTONE_DAYS * 86_400_000))
                out.append((i, "cdc", "DONE" if alive else "DELETED", attempts, version, seq, not alive, late))
        kept = [(i, *now, expires) for i, (now, expires) in held.items() if expires is None or expires > clock]
        if kept:
            state.update((kept,))
        else:
            state.remove()
        if tombstones := [k[-1] for k in kept if k[-1] is not None]:
            state.setTimeoutDuration(min(tombstones) - clock)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    return changes.withColumn("stretch", F.shiftright("id", STRETCH)).groupBy("stretch").applyInPandasWithState(step, ROW, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def read_log(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run(spark: SparkSession, log: str, out: str, files_a_batch: int = 1) -> None:
    """Everything that is in the log folder now, into out/ledger and out/bad. Restarts where it stopped."""
    routed = parse(read_log(spark, log, files_a_batch)).withColumn("route", route())
    bad = routed.where(~F.coalesce(F.col("route").isin(*OPS), F.lit(False))).select("seq", "value", "route")
    good = routed.where(F.col("route").isin(*OPS)).select("seq", "id", "op", "version")

    def keep(name: str):
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    jobs = [
        apply_changes(good).writeStream.outputMode("update").foreachBatch(keep("ledger")).option("checkpointLocation", f"{out}/checkpoint/ledger"),
        bad.writeStream.outputMode("append").foreachBatch(keep("bad")).option("checkpointLocation", f"{out}/checkpoint/bad"),
    ]
    held = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:  # a job keeps the setting it was started under
        started = [j.trigger(availableNow=True).start() for j in jobs]
    finally:
        spark.conf.set(EMPTY_BATCHES, held)
    for job in started:
        job.awaitTermination()


def ledger_of(spark: SparkSession, out: str) -> DataFrame:
    """The ledger after all batches: each key's newest row, without deleted keys."""
    rows = spark.read.schema(ROW + ", batch long").parquet(f"{out}/ledger")
    newest = rows.groupBy("source_id").agg(F.max_by(F.struct("lane", "status", "attempts", "source_version", "last_seq", "deleted"), F.struct("last_seq", "batch")).alias("r"))
    return newest.select("source_id", "r.*").where("not deleted").drop("deleted")
