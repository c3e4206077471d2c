"""Streaming twin of the ticket dedup (M4).

A file stream of ticket extracts is merged into a table that is split by a
hash of the key.  Each micro-batch is reduced to its latest row per key and
written to a new folder, one part for each partition that holds one of its
keys; publishing the new list of folders makes the batch visible at once (see
``published``).  A partition is a list of such folders, and readers keep the
latest row per key of all of them.  ``FAN_IN`` folders of a level are merged
into one of the next, so that a row is written again once for each level and
the work of a stream grows with its rows (times the logarithm of the number of
batches), not with its batches times the table.  The table itself is the
state: nothing grows in a state store, a batch that is delivered twice changes
nothing, and the drained result equals the batch dedup.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.operators import dedup
from fieldlens.session import checkpoint_dir
from fieldlens.streaming.published import Published

#: Partitions of the target; choose them so that one holds a few hundred MB.
PARTITIONS = 16


#: So many folders of one level of a partition become one of the next.
FAN_IN = 16


def upsert(store: Published, batch: DataFrame, schema: T.StructType, keys: list[str], order_cols: list[str],
           partitions: int = PARTITIONS) -> list[int]:
    """Merge ``batch`` into the table (latest row per key wins); returns the
    partitions that it has rows of."""
    order = [F.col(c) for c in order_cols]
    names = [f.name for f in schema.fields]
    version, state = store.latest()
    number = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    fresh = dedup.latest_per_key(batch.select(*names).withColumn("_part", number), ["_part", *keys], order)
    folder = _write(store, fresh, names, partitions)
    touched = _parts(store, folder)
    if not touched:
        return []
    for p in touched:
        held = state.get(str(p), {"folders": []})["folders"]
        state[str(p)] = {"keys": keys, "order": order_cols, "folders": [*held, [0, f"{folder}/_part={p}"]]}
    level = 0
    while due := [p for p in state if sum(n == level for n, _ in state[p]["folders"]) >= FAN_IN]:
        _compact(store, state, due, level, schema, number)
        level += 1
    store.publish(state, version)
    store.clean()
    return touched


def _write(store: Published, rows: DataFrame, names: list[str], partitions: int) -> str:
    # more tasks than partitions, so that few of them take two
    folder = store.new_folder("batch")
    rows.select(*names, "_part").repartition(4 * partitions, "_part").write.partitionBy("_part").parquet(folder)
    return folder


def _parts(store: Published, folder: str) -> list[int]:
    return sorted(int(n.removeprefix("_part=")) for n in store.names_in(folder) if n.startswith("_part="))


def _compact(store: Published, state: dict, due: list[str], level: int, schema: T.StructType, number: Column) -> None:
    """Replace the folders of ``level`` of the partitions ``due`` by one of the next level each."""
    names = [f.name for f in schema.fields]
    old = [f for p in due for n, f in state[p]["folders"] if n == level]
    keys, order = state[due[0]]["keys"], [F.col(c) for c in state[due[0]]["order"]]
    # dealt by partition once; the aggregate and the writer keep that layout
    held = store.spark.read.schema(schema).parquet(*old).withColumn("_part", number).repartition(4 * len(due), "_part")
    folder = store.new_folder("merged")
    dedup.latest_per_key(held, ["_part", *keys], order).select(*names, "_part").write.partitionBy("_part").parquet(folder)
    for p in due:
        kept = [x for x in state[p]["folders"] if x[0] != level]
        state[p]["folders"] = [*kept, [level + 1, f"{folder}/_part={p}"]]


def read_upserted(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of the version published last: the latest per key."""
    _, state = Published(spark, root).latest()
    if not state:
        return spark.createDataFrame([], schema)
    any_part = next(iter(state.values()))
    rows = spark.read.schema(schema).parquet(*sorted(f for part in state.values() for _, f in part["folders"]))
    rows = dedup.latest_per_key(rows, any_part["keys"], [F.col(c) for c in any_part["order"]])
    return rows.select(*[f.name for f in schema.fields])


def upsert_stream(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str], order_cols: list[str],
                  root: str, ckpt: str, files_per_trigger: int = 1, partitions: int = PARTITIONS) -> list[list[int]]:
    """Run the stream until the source is drained (availableNow); returns the
    partitions that each micro-batch had rows of.  A batch that Spark delivers again
    after a failure is merged again, with the same result."""
    written: list[list[int]] = []

    def sink(batch: DataFrame, _epoch: int) -> None:
        written.append(upsert(Published(batch.sparkSession, root), batch, schema, keys, order_cols, partitions))

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
         .writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return written


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"fieldlens-{name}-{uuid.uuid4().hex}")


def append_new_keys_stream(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str,
                           keys: list[str], ckpt: str, files_per_trigger: int = 1) -> str:
    """M3 as a stream: every micro-batch appends to ``target_dir`` the rows
    that are not there yet, so replaying a file or restarting after a failure
    adds nothing twice.  ``keys`` names what tells rows apart: for unpacked
    lines that is the line *and* its serial, since a line has one row for each
    serial.  The checkpoint location makes each file count once; the anti join
    covers re-delivered batches."""
    from fieldlens.operators import joins
    from fieldlens.streaming.incremental import read_if_present

    def sink(batch: DataFrame, _epoch: int) -> None:
        fresh = batch.dropDuplicates(keys)
        done = read_if_present(spark, target_dir, schema)
        if done is not None:
            fresh = joins.not_yet_processed(fresh, done, keys)
        fresh.write.mode("append").parquet(target_dir)

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
         .writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return target_dir
