"""Rows that are new or changed, as a streaming operator with keyed state: the state store holds a checksum per id.

Unlike :func:`.changes.stream_push_delta`, which keeps a table of what became of each push, this is a transformation of
a stream: it goes into any sink, and Spark writes the checksums of the ids of a batch, and no others, to the state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import checksum

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGED = "id string, op string, checksum string, at timestamp, data string"


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, with its changes written as a log instead of whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def changed_rows(source: DataFrame, key: str = "_id", by: str = "_at") -> DataFrame:
    """``CHANGED`` rows of a stream: of each id's rows in a batch the last by ``by`` (then by its data), if its checksum differs
    from the one that was last emitted; ``op`` is insert for an id that wasn't known, else patch.

    A task sees an id's rows one by one and keeps the last. Null ids are an id of their own. :func:`use_keyed_state` must
    have been called for the session. A batch that runs again starts from the state before it and emits the same.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class LastChecksum(StatefulProcessor):  # defined here, so that workers get it whole and need no package
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("checksum", "checksum string")

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, N802, N803
            order = lambda row: (row.at is None, row.at or 0, row.data)
            last = max(rows, key=order)
            before = self.known.get()
            if before is None or before[0] != last.checksum:
                self.known.update((last.checksum,))
                yield Row(id=last.id, op="insert" if before is None else "patch", checksum=last.checksum, at=last.at, data=last.data)

        def close(self) -> None:
            pass

    data = [c for c in source.columns if c not in (key, by)]
    rows = source.select(F.col(key).cast("string").alias("id"), checksum(source, data).alias("checksum"), F.unix_micros(F.col(by).cast("timestamp")).alias("at"), F.to_json(F.struct(*data), {"ignoreNullFields": "false"}).alias("data"))
    out = rows.groupBy("id").transformWithState(LastChecksum(), outputStructType=CHANGED.replace("at timestamp", "at long"), outputMode="Append", timeMode="None")
    return out.withColumn("at", F.timestamp_micros("at"))
