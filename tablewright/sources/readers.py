"""Sources: CSV, JSON trees, XML rows, JDBC tables, mixed files, parameters, namespaces, single rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableError


def read_csv(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", schema: str | T.StructType | None = None) -> DataFrame:
    """Files as one table, columns named by the header; all text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(paths if isinstance(paths, str) else list(paths))


def _below(dtype: T.DataType, names: Sequence[str]) -> T.DataType:
    for n in names:
        while isinstance(dtype, T.ArrayType):
            dtype = dtype.elementType
        if not isinstance(dtype, T.StructType) or n not in dtype.fieldNames():
            raise TableError(f"no {'.'.join(names)!r} in the source")
        dtype = dtype[n].dataType
    return dtype


def json_tree(df: DataFrame, source: str, props: Mapping[str, str]) -> DataFrame:
    """Rows from nested data: one per object at ``source`` (``a.b[].c[]``), columns by paths from there.

    A path may go down (``x.y``) or, by two dots or more, up to a parent (``..x``, ``...x``). What is missing is
    null; what is no object at the place is skipped.
    """
    rows, bases, trail = df, [None], []
    for part in [p for p in source.split(".") if p.removesuffix("[]")] if source else []:
        name = part.removesuffix("[]")
        trail.append(name)
        value, at = F.col(f"`{bases[-1]}`.`{name}`" if bases[-1] else f"`{name}`"), f"__at{len(trail)}"
        if isinstance(_below(df.schema, trail), T.ArrayType):
            rows = rows.withColumn(at, F.explode(value))
        else:
            rows = rows.withColumn(at, value)
        bases.append(at)
        rows = rows.filter(F.col(at).isNotNull())

    def column(path: str) -> Column:
        up = max(0, len(path) - len(path.lstrip(".")) - 1)
        steps = path.lstrip(".").split(".")
        base = bases[-1 - up] if up < len(bases) else None
        try:
            _below(df.schema if base is None else rows.schema[base].dataType, steps)
        except TableError:
            return F.lit(None).cast("string")
        quoted = ".".join(f"`{s}`" for s in steps)
        return F.col(quoted if base is None else f"`{base}`.{quoted}")

    return rows.select(*[column(path).alias(name) for name, path in props.items()])


def read_json_tree(spark: SparkSession, paths: str | Sequence[str], source: str, props: Mapping[str, str], schema: str | T.StructType | None = None) -> DataFrame:
    """:func:`json_tree` of whole JSON files."""
    reader = spark.read.option("multiLine", True)
    return json_tree((reader.schema(schema) if schema else reader).json(paths), source, props)


def read_xml_rows(spark: SparkSession, paths: str | Sequence[str], row_tag: str, props: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """A row per element ``row_tag``; each column from a relative XPath: an element's text, or an attribute ``@name``.

    Missing ones are null; a list of paths gives the list of key values.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(paths)
    return _xml_columns(rows, props)


def _xml_columns(rows: DataFrame, props: Mapping[str, str | Sequence[str]]) -> DataFrame:
    def column(path: str) -> Column:
        dtype: T.DataType = rows.schema
        names = []
        for step in path.strip("/").split("/"):
            name = f"_{step[1:]}" if step.startswith("@") else step
            if not isinstance(dtype, T.StructType) or name not in dtype.fieldNames():
                if isinstance(dtype, T.StructType) and f"_{step}" in dtype.fieldNames():
                    name = f"_{step}"  # without such an element, an attribute of the name
                else:
                    return F.lit(None).cast("string")
            names.append(name)
            dtype = dtype[name].dataType
        value = F.col(".".join(f"`{n}`" for n in names))
        if isinstance(dtype, T.StructType) and "_VALUE" in dtype.fieldNames():
            value = value.getField("_VALUE")
        return value.cast("string")

    return rows.select(*[(column(p) if isinstance(p, str) else F.array(*[column(x) for x in p])).alias(n) for n, p in props.items()])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of an external database. With a numeric column and its bounds it is read by ranges of equal width in parallel,
    with the column alone by ranges of about as many rows each (:func:`even_ranges`).

    Filters and columns are pushed down by Spark.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    elif column:
        ranges = even_ranges(spark, url, table, column, partitions, **options)
        return spark.read.jdbc(url, table, predicates=ranges, properties={"fetchsize": "10000", **options})
    return reader.load()


def even_ranges(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, **options: str) -> list[str]:
    """Conditions on a numeric column that part a table in ranges of about equal row counts; nulls go with the first.

    The column alone is read, in parallel by ranges of equal width, into a sketch of its quantiles; only the
    ``partitions - 1`` bounds reach the driver. They are off by a tenth of a range at most; rows of one value stay together.
    """
    plain = read_jdbc(spark, url, table, **options)
    column = plain.columns[[c.lower() for c in plain.columns].index(column.lower())]
    low, high = plain.agg(F.min(column), F.max(column)).first()  # the database answers this
    if low is None or low == high or partitions < 2:
        return ["1 = 1"]
    keys = read_jdbc(spark, url, table, column, (math.floor(low), math.ceil(high)), partitions, **options).select(F.col(column).cast("double").alias("k"))
    shares = [i / partitions for i in range(1, partitions)]
    cuts = sorted(set(keys.approxQuantile("k", shares, 0.1 / partitions)))
    whole = isinstance(plain.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    edges = [str(int(c)) if whole else repr(c) for c in cuts if c > low]
    if not edges:
        return ["1 = 1"]
    column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:], strict=False)]
    return [f"{column} < {edges[0]} OR {column} IS NULL", *inner, f"{column} >= {edges[-1]}"]


#: Catalogue queries for :func:`.quality.infer_keys`, for databases with the standard information schema, to be read as tables by JDBC.
CATALOGUE = {
    "columns": """(SELECT table_name AS "table", column_name AS "column", data_type AS sql_type FROM information_schema.columns WHERE table_schema = '{schema}') c""",
    "constraints": """(
  SELECT k.table_name AS "table", k.constraint_name AS name, CASE t.constraint_type WHEN 'PRIMARY KEY' THEN 'p' WHEN 'UNIQUE' THEN 'u' ELSE 'f' END AS kind,
    k.ordinal_position AS position, k.column_name AS "column", r.table_name AS target, r.column_name AS target_column
  FROM information_schema.key_column_usage k
  JOIN information_schema.table_constraints t ON t.constraint_name = k.constraint_name AND t.constraint_schema = k.constraint_schema AND t.table_name = k.table_name
  LEFT JOIN information_schema.referential_constraints f ON f.constraint_name = k.constraint_name AND f.constraint_schema = k.constraint_schema
  LEFT JOIN information_schema.key_column_usage r ON r.constraint_name = f.unique_constraint_name AND r.constraint_schema = f.unique_constraint_schema AND r.ordinal_position = k.position_in_unique_constraint
  WHERE t.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY') AND k.table_schema = '{schema}'
) k""",
}


def read_catalogue(spark: SparkSession, url: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The columns and constraints of a database's schema, as :func:`.quality.infer_keys` takes them."""
    if "'" in schema:
        raise TableError("a schema's name can't hold a quote")
    return tuple(read_jdbc(spark, url, CATALOGUE[k].format(schema=schema), **options) for k in ("columns", "constraints"))


def read_multi_model(df: DataFrame, model: str, type_column: str = "_type") -> DataFrame:
    """One model of a mixed table: its rows, without the columns that hold a null there."""
    rows = df.filter(F.col(type_column) == model)
    nulls = rows.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns]).first()  # one row: how many nulls per column
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if nulls[c] == 0 and c != type_column])


def combinations(params: Mapping[str, DataFrame]) -> DataFrame:
    """Every combination of parameter values: one column per parameter, from one-column tables."""
    return reduce(lambda a, b: a.crossJoin(b), [df.toDF(name) for name, df in params.items()])


def dependent(params: DataFrame, rows: DataFrame, on: Sequence[tuple[str, str]], value: str, name: str) -> DataFrame:
    """A parameter read from another model's rows, chosen by parameters before it."""
    condition = reduce(lambda a, b: a & b, [F.col(p) == F.col(f"__{c}") for p, c in on])
    taken = rows.select(*[F.col(c).alias(f"__{c}") for _, c in on], F.col(value).alias(name))
    return params.join(taken, condition).drop(*[f"__{c}" for _, c in on])


def read_parametrized(spark: SparkSession, template: str, params: DataFrame, fmt: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """The files that a template such as ``.../{year}/{code}.parquet`` names for each combination, as one table.

    All paths are read by one plan; each row has its parameters, from its file's name. The table of parameters names
    files, so it is as small as a list of files and comes to the driver as such.
    """
    path = F.lit(template)
    for c in params.columns:
        path = F.replace(path, F.lit("{" + c + "}"), F.col(c).cast("string"))
    listed = params.withColumn("__path", path)
    paths = sorted({r["__path"] for r in listed.select("__path").collect()})
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(paths)
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+|/+$", "")
    # A file is the one that a path names, or a part in the folder that it names. Each file is placed once, rows are not.
    files = spark.createDataFrame([(f,) for f in rows.inputFiles()], "__file string")
    found = plain(F.url_decode(F.replace(F.col("__file"), F.lit("+"), F.lit("%2B"))))
    places = files.select(plain(F.col("__file")).alias("__file"), F.explode(F.array_distinct(F.array(found, F.regexp_replace(found, r"/[^/]*$", "")))).alias("__place"))
    listed = listed.select(*params.columns, plain(F.col("__path")).alias("__place")).distinct()
    placed = listed.join(places, "__place").drop("__place")
    return rows.select(*rows.columns, plain(F.col("_metadata.file_path")).alias("__file")).join(placed, "__file").drop("__file")


def read_namespace(models: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of several models, with the model in ``_type``; columns that a model lacks are null."""
    frames = [df.select(F.lit(name).alias("_type"), *df.columns) for name, df in models.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def get_one(df: DataFrame, value: object, key: str = "_id", prop: str | None = None) -> DataFrame:
    """The row of a key, or one property of it; reading it fails if there is none."""
    rows = df.filter(F.col(key) == F.lit(value)).limit(2)
    rows = rows.select(key, prop) if prop else rows
    found = df.sparkSession.range(1).join(rows, F.lit(True), "left")
    guard = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"no row with {key} = {value}")).cast(df.schema[key].dataType)).otherwise(F.col(key))
    return found.select(*[guard.alias(c) if c == key else F.col(c) for c in rows.columns])
