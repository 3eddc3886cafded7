"""Summaries of one column: binned numbers and times, declared values, references, points; duplicates and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import bbox as meets
from ..functions.shapes import MEASURES, centre, measures
from ..model import TableError
from ..runtime import cut

BINS = 100
TOP = 10
CLUSTERS = 25


def count(df: DataFrame) -> DataFrame:
    """One row, ``count()``."""
    return df.agg(F.count(F.lit(1)).alias("count()"))


def _binned(df: DataFrame, value: Column, row_id: str, low: Column, high: Column, edge: Column, spark_range: DataFrame) -> DataFrame:
    """``i, count, _id`` of all bins, zero ones too; bounds come from one aggregated row joined to every row."""
    rows = df.select(value.alias("__v"), F.col(row_id).alias("__id")).filter(F.col("__v").isNotNull())
    bounds = rows.agg(F.min("__v").alias("min"), F.max("__v").alias("max")).filter(F.col("min").isNotNull())
    bounds = bounds.select("min", high.alias("max")).withColumn("size", (F.col("max") - F.col("min")) / BINS)
    placed = rows.join(F.broadcast(bounds)).withColumn("i", (F.width_bucket("__v", low, edge, F.lit(BINS)) - 1).cast("int"))
    counts = placed.groupBy("i").agg(F.count(F.lit(1)).alias("count"), F.min("__id").alias("__id"))
    bins = spark_range.select(F.col("id").cast("int").alias("i")).join(F.broadcast(bounds))
    joined = bins.join(F.broadcast(counts), "i", "left")
    return joined.select("i", "min", "size", F.coalesce("count", F.lit(0)).alias("count"), F.when(F.col("count") == 1, F.col("__id")).alias("_id"))


def summary_numeric(df: DataFrame, column: str, row_id: str = "_id") -> DataFrame:
    """``bin, count, _id`` in ``BINS`` equal bins; ``bin`` is the centre, ``_id`` is given where one row is in it.

    Nulls are left out. Equal values get a range of 100. An empty table gives no rows.
    """
    high = F.when(F.col("max") == F.col("min"), F.col("max") + 100).otherwise(F.col("max"))
    edge = F.col("max") + F.least(F.lit(0.01), 0.01 * F.col("size"))
    out = _binned(df, F.col(column).cast("double"), row_id, F.col("min"), high, edge, df.sparkSession.range(BINS))
    return out.select((F.col("min") + F.col("size") / 2 + F.col("i") * F.col("size")).alias("bin"), "count", "_id")


#: A declared unit and what :func:`summary_time` adds for equal values: months, or seconds.
UNIT_MONTHS = {"Y": 12, "Q": 3, "M": 1}
UNIT_SECONDS = {"W": 604_800.0, "D": 86_400.0, "H": 3_600.0, "T": 60.0, "S": 1.0, "L": 0.001, "U": 0.000001}


def summary_time(df: DataFrame, column: str, row_id: str = "_id", unit: str | None = None) -> DataFrame:
    """Like :func:`summary_numeric` for dates and datetimes; ``bin`` is a timestamp.

    Equal values get a range of 100 units as declared (``14D``, ``10Y``), else of 100 days. Buckets have edges of whole
    seconds, centres are to the microsecond.
    """
    import re

    m = re.fullmatch(r"(\d*)([YMQWDHTSLU])", unit or "D")
    if not m:
        raise TableError(f"{unit!r} is no time unit")
    n, kind = 100 * int(m[1] or 1), m[2]
    top = F.timestamp_seconds(F.col("max"))
    if kind in UNIT_MONTHS:
        more = F.unix_micros(F.try_add(top, F.make_ym_interval(F.lit(0), F.lit(n * UNIT_MONTHS[kind])))) / 1e6
    else:
        more = F.col("max") + n * UNIT_SECONDS[kind]
    high = F.when(F.col("max") == F.col("min"), more).otherwise(F.col("max"))
    seconds = F.unix_micros(F.col(column).cast("timestamp")) / 1e6
    out = _binned(df, seconds, row_id, F.floor("min").cast("double"), high, F.floor("max").cast("double") + 1, df.sparkSession.range(BINS))
    centre = F.col("min") + F.col("size") / 2 + F.col("i") * F.col("size")
    return out.select(F.timestamp_micros(F.round(centre * 1e6).cast("long")).alias("bin"), "count", "_id")


def summary_clock(df: DataFrame, column: str, row_id: str = "_id") -> DataFrame:
    """Like :func:`summary_time` for times of day, as text ``HH:mm:ss[.f]``; ``bin`` is such a text, to the microsecond.

    Equal values get a range of 100 minutes, or of 100 seconds, milliseconds or microseconds where that would pass midnight.
    """
    top = F.col("max")
    more = F.when(top + 6000 < 86_400, top + 6000).when(top + 100 < 86_400, top + 100).when(top + 0.1 < 86_400, top + 0.1).otherwise(top + 0.0001)
    high = F.when(F.col("max") == F.col("min"), more).otherwise(top)
    seconds = F.unix_micros(F.concat(F.lit("1970-01-01 "), F.col(column), F.lit("Z")).try_cast("timestamp")) / 1e6
    out = _binned(df, seconds, row_id, F.floor("min").cast("double"), high, F.floor("max").cast("double") + 1, df.sparkSession.range(BINS))
    micros = F.round((F.col("min") + F.col("size") / 2 + F.col("i") * F.col("size")) * 1e6).cast("long")
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(micros / 3_600_000_000), F.floor(micros / 60_000_000) % 60, F.floor(micros / 1_000_000) % 60, micros % 1_000_000)
    return out.select(clock.alias("bin"), "count", "_id")


def _declared(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    listed = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, bin {kind}")
    counts = df.filter(F.col(column).isin(list(values))).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("count"))
    joined = listed.join(counts, F.col("bin") == F.col("__v"), "left")
    return joined.select("bin", F.coalesce("count", F.lit(0)).alias("count"), "place").orderBy("place").drop("place")


def summary_boolean(df: DataFrame, column: str) -> DataFrame:
    """``bin, count`` for false and true, zero ones too; nulls are left out."""
    return _declared(df, column, [False, True])


def summary_enum(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """``bin, count`` per declared value, zero ones too; undeclared values are left out."""
    if not values:
        raise TableError(f"{column!r} declares no values")
    return _declared(df, column, values)


def summary_ref(df: DataFrame, fk: str, created: str, row_id: str = "_id", top: int = TOP, uri: str | None = None) -> DataFrame:
    """The ``top`` referenced keys: ``bin`` (first 8 characters), ``count``, ``_id`` of a single row, ``label``."""
    groups = df.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).cast("string").alias("__k"))
    counts = groups.agg(F.count(F.lit(1)).alias("count"), F.min(created).alias("__first"), F.min(row_id).alias("__id"))
    best = counts.orderBy(F.desc("count"), F.asc("__first"), F.asc("__k")).limit(top)
    return best.select(F.substring("__k", 1, 8).alias("bin"), "count", F.when(F.col("count") == 1, F.col("__id")).alias("_id"), F.lit(uri).cast("string").alias("label"))


def summary_geometry(df: DataFrame, geom: str, y: str | None = None, row_id: str = "_id", clusters: int = CLUSTERS, seed: int = 1, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Clusters of geometries: ``cluster, centroid, count, _id`` (of a cluster of one); nulls and empty shapes are left out.

    ``geom`` is a column of well-known text, or the x of points with their ``y``. With ``bbox`` (x0, y0, x1, y1) only shapes
    that meet the box count. Up to ``clusters`` distinct places, centroids of shapes, are clusters of their own; more are
    gathered by k-means, to which a place is one point that weighs as much as it has rows, so copies cost nothing.
    The centroid is that of all shapes of the cluster: by area, without areas by length, else of the points.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if bbox is not None and len(bbox) != 4:
        raise TableError("a box is four numbers")
    if y is None:
        shapes = df.select(F.col(geom).alias("__wkt"), F.col(row_id).alias("__id")).filter("__wkt is not null")
        if bbox is not None:
            shapes = shapes.filter(meets(F.col("__wkt"), *bbox))
        each = shapes.groupBy("__wkt").agg(F.count(F.lit(1)).alias("rows"), F.min("__id").alias("__id")).withColumn("__m", measures(F.col("__wkt")))
        each = each.withColumn("__at", centre(F.col("__m"))).filter("__at is not null").select(F.col("__at.x").alias("x"), F.col("__at.y").alias("y"), "rows", "__id", *[F.col(f"__m.{m}").alias(m) for m in MEASURES])
    else:
        points = df.select(F.col(geom).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(row_id).alias("__id")).dropna(subset=["x", "y"])
        if bbox is not None:
            points = points.filter(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
        each = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("rows"), F.min("__id").alias("__id"))
        zeros = {m: F.lit(0.0) for m in MEASURES}
        each = each.withColumns(zeros | {"points": F.lit(1.0), "points_x": F.col("x"), "points_y": F.col("y")})
    places = each.groupBy("x", "y").agg(F.sum("rows").alias("rows"), F.min("__id").alias("__id"), *[F.sum(F.col("rows") * F.col(m)).alias(m) for m in MEASURES])
    places = cut(places)
    few = places.limit(clusters + 1).count()
    if few <= clusters:  # at most ``clusters`` rows to number
        placed = places.withColumn("cluster", F.row_number().over(Window.orderBy("x", "y")) - 1)
    else:
        vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(places)
        model = KMeans(k=clusters, seed=seed, maxIter=40, initSteps=5, weightCol="rows").fit(vectors)
        placed = model.transform(vectors).withColumnRenamed("prediction", "cluster")
    grouped = placed.groupBy("cluster").agg(F.sum("rows").alias("count"), F.min("__id").alias("__id"), F.struct(*[F.sum(m).alias(m) for m in MEASURES]).alias("__m")).withColumn("__c", centre(F.col("__m")))
    text = F.concat(F.lit("POINT("), F.col("__c.x").cast("string"), F.lit(" "), F.col("__c.y").cast("string"), F.lit(")"))
    return grouped.select("cluster", text.alias("centroid"), "count", F.when(F.col("count") == 1, F.col("__id")).alias("_id"))


def find_duplicates(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of keys that occur more than once, nulls being equal; ``by`` orders them (``-ts``: newest first).

    Keys are counted before the shuffle and met by a semi-join, so a key with very many rows isn't sorted in one task.
    """
    from .paging import order

    several = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    out = df.join(several, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")
    return out.orderBy(*keys, *order(df, *by)) if by else out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_tables(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """``model, count`` of every table, counts cut off at ``limit``."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("count"))
        row = n.select(F.lit(name).alias("model"), F.least("count", F.lit(limit)).cast("long").alias("count") if limit else F.col("count"))
        out = row if out is None else out.union(row)
    if out is None:
        raise TableError("no table to count")
    return out
