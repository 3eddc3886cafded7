"""Tables that a stream keeps, as sorted runs: a batch writes the rows it changed, reading lays newer runs over older ones.

A run is ``folder/name/r=A-B``: what the batches ``A`` to ``B`` made of the table. Each batch adds one of its own, so what
it writes follows the rows it changed and not the table. When enough runs of about one size have gathered they are merged
to one, so a row is written again once per size only, and a table of any length has few runs. Rows of a merged run lie
in buckets by a hash of their key, twice as many whenever the run outgrows them, and a reader of some keys opens their
buckets only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import TableError

#: Rows that no file exceeds; a bucket holds half as many on average.
BUCKET_ROWS = 1_000_000
#: Runs of one size that are merged, and how much longer the runs of the next size are.
FANOUT = 8
#: Rows up to which runs count as of the least size.
SMALL_ROWS = 20_000
_DONE = "_DONE-"


class Run(NamedTuple):
    first: int
    last: int
    rows: int
    buckets: int
    path: str


class State:
    """Named tables in a folder, each with its schema and key (``keys``, by default its first column).

    Those in ``logs`` are append-only: their runs are read one after the other. A batch that runs again reads what the
    batches before it left and writes its run anew, so the latest run is never merged.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str] | None = None, logs: tuple[str, ...] = ("log",), bucket_rows: int = BUCKET_ROWS, fanout: int = FANOUT, small_rows: int = SMALL_ROWS) -> None:
        self.spark, self.folder, self.schemas, self.logs = spark, folder.rstrip("/"), schemas, set(logs)
        self.keys = {name: (keys or {}).get(name, schema.split()[0]) for name, schema in schemas.items()}
        self.bucket_rows, self.fanout, self.small_rows = bucket_rows, fanout, small_rows

    def _hadoop(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _delete(self, path: str) -> None:
        system, target = self._hadoop(path)
        system.delete(target, True)

    def _complete(self, name: str) -> list[Run]:
        """Runs that were written to the end, oldest first, the longer ones of those that begin together first."""
        system, target = self._hadoop(f"{self.folder}/{name}/r=*/{_DONE}*")
        found = []
        for status in system.globStatus(target) or ():
            path, mark = status.getPath().toString().rsplit("/", 1)
            first, last = path.rsplit("/r=", 1)[1].split("-")
            rows, buckets = mark.removeprefix(_DONE).split("-")
            found.append(Run(int(first), int(last), int(rows), int(buckets), path))
        return sorted(found, key=lambda r: (r.first, -r.last))

    def runs(self, name: str, before: int | None = None) -> list[Run]:
        """The runs that make the table as the batches before ``before``, or all, left it; parts of merged ones don't count."""
        out: list[Run] = []
        for run in self._complete(name):
            if out and run.last <= out[-1].last:
                continue
            if before is not None and run.first < before <= run.last:
                raise TableError(f"the rows of {name} before batch {before} are merged with later ones")
            if before is None or run.last < before:
                out.append(run)
        return out

    def rows_before(self, name: str, before: int) -> int:
        """Entries of a log that the batches before ``before`` wrote."""
        return sum(r.rows for r in self.runs(name, before))

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.keys[name]).cast("string")), F.lit(buckets)).cast("int")

    def read(self, name: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as the last batch, or the last one before ``before``, left it; empty at first.

        With ``keys``, a checkpointed frame of distinct key values in one column, only their rows, from their buckets.
        """
        return self._read(name, self.runs(name, before), keys).drop("__gone")

    def _read(self, name: str, runs: list[Run], keys: DataFrame | None = None, gone: bool = False) -> DataFrame:
        schema, key = self.schemas[name] + ", __gone boolean", self.keys[name]
        touched: set[int] = set()
        most = max((r.buckets for r in runs), default=1)
        if keys is not None and most > 1:  # fewer numbers than buckets reach the driver
            named = keys.toDF(key)
            touched = {r[0] for r in named.select(self._bucket(name, most)).distinct().collect()}
        out: DataFrame | None = None
        for number, run in enumerate(runs):
            rows = self.spark.read.schema(f"{schema}, __bucket int").parquet(run.path)
            if keys is not None and run.buckets > 1:
                rows = rows.filter(F.col("__bucket").isin(sorted({b % run.buckets for b in touched})))
            rows = rows.drop("__bucket").withColumn("__run", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], schema)
        if keys is not None:
            out = out.join(keys.toDF(key), key, "left_semi")
        if name in self.logs:
            return out.drop("__run")
        if len(runs) > 1:
            columns = [c for c in out.columns if c != "__run"]
            out = out.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "__run").alias("__row")).select("__row.*")
        out = out.drop("__run")
        return out if gone else out.filter("not __gone")

    def write(self, name: str, version: int, df: DataFrame) -> None:
        """The run of batch ``version``: changed rows, each key once, ``__gone`` true for those that went; then merges."""
        self._write(name, f"{self.folder}/{name}/r={version:09d}-{version:09d}", df, 1)
        old = [r for r in self.runs(name) if r.last < version]
        for size in range(64):
            tail: list[Run] = []
            for run in reversed(old):
                if self._size(run) > size:
                    break
                tail.insert(0, run)
            if len(tail) >= self.fanout:
                self._merge(name, tail, oldest=tail[0] == old[0])
                return
            if len(tail) == len(old):
                return

    def _size(self, run: Run) -> int:
        return 0 if run.rows <= self.small_rows else math.ceil(math.log(run.rows / self.small_rows, self.fanout))

    def _write(self, name: str, path: str, df: DataFrame, buckets: int) -> None:
        columns = [f.split()[0] for f in self.schemas[name].split(", ")]
        gone = F.coalesce("__gone", F.lit(False)) if "__gone" in df.columns else F.lit(False)
        rows = df.select(*columns, gone.alias("__gone"))
        if name in self.logs or buckets == 1:
            rows = rows.withColumn("__bucket", F.lit(0))
        else:
            rows = rows.withColumn("__bucket", self._bucket(name, buckets)).repartition(buckets, "__bucket").sortWithinPartitions("__bucket", self.keys[name])
        self._delete(path)  # with the mark of an earlier attempt
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", self.bucket_rows).partitionBy("__bucket").parquet(path)
        system, target = self._hadoop(f"{path}/{_DONE}{seen.get['rows']}-{buckets}")
        system.create(target, True).close()

    def _merge(self, name: str, runs: list[Run], oldest: bool) -> None:
        """One run of several neighbours. It counts once it is complete, and only then the others go, so a failure on the
        way loses nothing and doubles nothing. What went is forgotten with the oldest run."""
        rows = sum(r.rows for r in runs)
        buckets = 1 if name in self.logs else 1 << max(0, math.ceil(math.log2(max(1, 2 * rows / self.bucket_rows))))
        merged = self._read(name, runs, gone=not oldest)
        if name in self.logs:
            merged = merged.repartitionByRange(max(1, math.ceil(rows / self.bucket_rows)), self.keys[name]).sortWithinPartitions(self.keys[name])
        self._write(name, f"{self.folder}/{name}/r={runs[0].first:09d}-{runs[-1].last:09d}", merged, buckets)
        for run in runs:
            self._delete(run.path)

    def merge(self, name: str) -> None:
        """Makes one run of all but the latest, for a time between the stream's runs; then its batch alone may come again."""
        old = self.runs(name)[:-1]
        if len(old) > 1:
            self._merge(name, old, oldest=True)
