"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, in rows, that an operator broadcasts after counting it. Rows are narrow (keys and numbers).
MAX_BROADCAST_ROWS = 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Run the plan once and go on from its rows in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: The tables of the innermost :func:`discarding` block first.
_made: list[list[str]] = []


def shared_place(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _made:
        _made[0].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut` as a Parquet table: compressed, and readers take only the columns they need."""
    path = shared_place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def discarding(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that the block writes are deleted behind it, unless it takes their path from the list it gets.

    Frames that were made from them must have been written or counted before.
    """
    _made.insert(0, [])
    try:
        yield _made[0]
    finally:
        for path in _made.pop(0):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed table for broadcast if it has at most ``most`` rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def together(df: DataFrame, rows: int, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A narrow table that was counted in one partition if it has at most ``most`` rows: joins and groups of such tables need no
    shuffle, so a loop over them takes one task a step and not one for each of the session's partitions, which the driver keeps."""
    return df.coalesce(1) if rows <= most else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of a caller's table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
