"""Sinks: flat CSV, JSON lines, triples, split export tables, Derby databases."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableError
from ..operators.project import flatten, to_json_safe


def flat(df: DataFrame) -> DataFrame:
    """Flat JSON-safe columns: ``a.b``, ``a[].b``, and ``_page`` as ``_page.next``."""
    out = to_json_safe(flatten(df))
    return out.withColumnRenamed("_page", "_page.next") if "_page" in out.columns else out


def write_csv_flat(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    to_json_safe(df).write.mode(mode).json(path)


def to_triples(df: DataFrame, model_uri: str, uris: Mapping[str, str], key: str = "_id", uri_column: str | None = None, refs: Mapping[str, str] | None = None) -> DataFrame:
    """``subject, predicate, object`` of every value that has a property URI, and the type of every row; nulls are left out.

    The subject is the row's own URI if it has one, else made of the model's URI and the key; references to the models
    in ``refs`` (column to model URI) become URIs.
    """
    made = F.concat(F.lit(f"<{model_uri}/"), F.col(key).cast("string"), F.lit(">"))
    subject = F.coalesce(F.concat(F.lit("<"), F.col(uri_column), F.lit(">")), made) if uri_column else made

    def shown(name: str) -> Column:
        value = F.col(name)
        if refs and name in refs:
            return F.concat(F.lit(f"<{refs[name]}/"), value.cast("string"), F.lit(">"))
        text = F.to_json(value) if isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
        escaped = F.regexp_replace(F.regexp_replace(escaped, "\r", r"\\r"), "\t", r"\\t")
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    entries = [F.struct(F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("predicate"), F.lit(f"<{model_uri}>").alias("object"))]
    entries += [F.struct(F.lit(f"<{uri}>").alias("predicate"), shown(name).alias("object")) for name, uri in uris.items()]
    rows = df.select(subject.alias("subject"), F.inline(F.array(*entries)))
    return rows.filter("object is not null")


def write_triples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """N-Triples, a line each."""
    triples.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit("."))).write.mode(mode).text(path)


def export_tables(df: DataFrame, txn: str, at: Column, lists: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The main table, one table per list column (``_txn, _rid, item``), and the first changelog."""
    names = list(lists) if lists is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    out = {"": df.drop(*names)}
    for name in names:
        out[f"/:list/{name}"] = df.select(F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), F.explode(name).alias("item"))
    data = F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")]))
    out["/:changelog"] = df.select(F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), at.alias("datetime"), F.lit("insert").alias("action"), data.alias("data"))
    return out


_DERBY_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR(32672)"}


def write_derby(df: DataFrame, folder: str, table: str, parts: int = 4) -> list[str]:
    """A table as ``parts`` read-only Derby databases in a folder that all machines mount; gives their JDBC URLs.

    An embedded database belongs to the process that opened it, so one that is written through JDBC can't be seen from
    other executors. Here each task loads its rows into a database of its own and packs it into one file, which any
    number of processes may open. Nothing but the URLs reaches the driver.
    """
    spark, place = df.sparkSession, urlsplit(folder)
    if place.scheme not in ("", "file"):
        raise TableError(f"Derby opens mounted folders only, not {folder}")
    kinds = dict(df.dtypes)
    if unknown := [c for c in df.columns if kinds[c] not in _DERBY_TYPES]:
        raise TableError(f"no Derby type for {', '.join(unknown)}")
    columns = ", ".join(f"{c} {_DERBY_TYPES[kinds[c]]}" for c in df.columns)
    target, java = place.path, spark.sparkContext._jvm.System.getProperty("java.home")

    def load(rows):  # defined here, so that workers get it whole and need no package
        import csv
        import glob
        import os
        import subprocess
        import tempfile
        import zipfile

        from pyspark import TaskContext
        from pyspark.find_spark_home import _find_spark_home

        number = TaskContext.get().partitionId()
        with tempfile.TemporaryDirectory(prefix="spark-derby-") as own:
            with open(f"{own}/rows.csv", "w", newline="", encoding="utf-8") as file:
                csv.writer(file, quoting=csv.QUOTE_STRINGS, lineterminator="\n").writerows(tuple(r) for r in rows)
            with open(f"{own}/load.sql", "w", encoding="utf-8") as file:
                file.write(f"CONNECT 'jdbc:derby:db;create=true';\nCREATE TABLE {table} ({columns});\n")
                file.write(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{own}/rows.csv', ',', '\"', 'UTF-8', 0);\n")
                file.write("CONNECT 'jdbc:derby:db;shutdown=true';\nEXIT;\n")
            jars = os.pathsep.join(glob.glob(f"{os.environ.get('SPARK_HOME') or _find_spark_home()}/jars/derby*.jar"))
            command = [f"{java}/bin/java" if os.path.exists(f"{java}/bin/java") else "java", "-Xmx256m", "-cp", jars, "org.apache.derby.tools.ij", f"{own}/load.sql"]
            said = subprocess.run(command, cwd=own, capture_output=True, text=True, check=True).stdout
            if failed := [line for line in said.splitlines() if "ERROR" in line and "ERROR 08006" not in line]:  # 08006 tells of the shutdown
                raise RuntimeError(failed[0])
            os.makedirs(target, exist_ok=True)
            mine = f"{target}/part-{number}.{uuid.uuid4().hex}"
            with zipfile.ZipFile(mine, "w", zipfile.ZIP_STORED) as packed:  # stored, so that Derby reads a page where it lies
                for at, _, names in os.walk(f"{own}/db"):
                    for name in names:
                        path = os.path.join(at, name)
                        packed.write(path, os.path.relpath(path, own))
            os.replace(mine, f"{target}/part-{number}.jar")

    df.repartition(parts).foreachPartition(load)
    return [f"jdbc:derby:jar:({target}/part-{number}.jar)db" for number in range(parts)]
