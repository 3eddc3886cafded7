"""Queries of summaries, cleaning, checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C
from ..model import Model, Property
from ..operators import quality as Q
from ..operators import summary as S
from .base import query, table


@query('SELECT count(*) AS "count()" FROM orders WHERE o_orderstatus = \'F\'')
def count_rows(spark, sf):
    """The number of rows after a filter."""
    return S.count(table(spark, sf, "orders").filter("o_orderstatus = 'F'"))


BINNED = """
, b AS (SELECT min(v) AS lo, max(v) AS hi FROM v WHERE v IS NOT NULL), w AS (SELECT lo, hi, (hi - lo) / 100 AS size, {low} AS blo, {edge} AS bhi FROM b),
p AS (SELECT CASE WHEN v < blo THEN 0 WHEN v >= bhi THEN 101 ELSE floor((v - blo) / ((bhi - blo) / 100)) + 1 END::INTEGER - 1 AS i, id FROM v, w WHERE v IS NOT NULL),
c AS (SELECT i, count(*) AS n, min(id) AS id FROM p GROUP BY i)
"""


@query(
    "WITH v AS (SELECT CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS v, l_orderkey AS id FROM lineitem)"
    + BINNED.format(low="lo", edge="hi + least(0.01, 0.01 * (hi - lo) / 100)")
    + "SELECT lo + size / 2 + r.i * size AS bin, coalesce(c.n, 0) AS count, CASE WHEN c.n = 1 THEN c.id END AS _id FROM range(100) r(i), w LEFT JOIN c ON c.i = r.i"
)
def summary_num(spark, sf):
    """100 equal bins of a number."""
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_id"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice")).alias("v"))
    return S.summary_numeric(df, "v")


@query("SELECT b.bin, count(x.v) AS count FROM (VALUES (false), (true)) b(bin) LEFT JOIN (SELECT CASE WHEN l_partkey % 7 <> 0 THEN l_discount > 0.05 END AS v FROM lineitem) x ON x.v = b.bin GROUP BY b.bin ORDER BY b.bin")
def summary_bool(spark, sf):
    """E5: false and true."""
    return S.summary_boolean(table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount") > 0.05).alias("v")), "v")


@query("SELECT b.bin, count(o.o_orderkey) AS count FROM (VALUES (0, 'P'), (1, 'none'), (2, 'F')) b(i, bin) LEFT JOIN orders o ON o.o_orderstatus = b.bin GROUP BY b.i, b.bin ORDER BY b.i")
def summary_enum(spark, sf):
    """Declared values, zero ones too."""
    return S.summary_enum(table(spark, sf, "orders"), "o_orderstatus", ["P", "none", "F"])


@query(
    "WITH v AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) / 1000000.0::DOUBLE END AS v, o_orderkey AS id FROM orders)"
    + BINNED.format(low="floor(lo)", edge="floor(hi) + 1")
    + "SELECT make_timestamp(round((lo + size / 2 + r.i * size) * 1000000.0::DOUBLE)::BIGINT) AS bin, coalesce(c.n, 0) AS count, CASE WHEN c.n = 1 THEN c.id END AS _id FROM range(100) r(i), w LEFT JOIN c ON c.i = r.i"
)
def summary_date(spark, sf):
    """100 equal bins of time."""
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("v"))
    out = S.summary_time(df, "v")
    return out.withColumn("bin", F.col("bin").cast("timestamp_ntz"))


@query(
    "WITH v AS (SELECT CASE WHEN event_id % 7 <> 0 THEN ((epoch_us(ts) % 86400000000) // 1000000)::DOUBLE END AS v, event_id AS id FROM events)"
    + BINNED.format(low="floor(lo)", edge="floor(hi) + 1")
    + "SELECT strftime(make_timestamp(round((lo + size / 2 + r.i * size) * 1000000.0::DOUBLE)::BIGINT), '%H:%M:%S.%f') AS bin, coalesce(c.n, 0) AS count, CASE WHEN c.n = 1 THEN c.id END AS _id FROM range(100) r(i), w LEFT JOIN c ON c.i = r.i"
)
def summary_clock(spark, sf):
    """100 equal bins of the time of day."""
    df = table(spark, sf, "events").select(F.col("event_id").alias("_id"), F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "HH:mm:ss")).alias("v"))
    return S.summary_clock(df, "v")


@query("SELECT substr(o_custkey::VARCHAR, 1, 8) AS bin, count(*) AS count, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS _id, 'https://example.org/customer' AS label FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, min(o_orderdate), o_custkey::VARCHAR LIMIT 10")
def summary_ref(spark, sf):
    """The most referenced rows."""
    return S.summary_ref(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", uri="https://example.org/customer")


@query("SELECT 'POINT(' || (g * 1000)::DOUBLE || ' ' || (g * g * 100)::DOUBLE || ')' AS centroid, count(*) AS count, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS _id FROM (SELECT CASE WHEN c_custkey = 1 THEN 9 ELSE c_custkey % 4 END AS g, c_custkey FROM customer WHERE c_custkey % 10 <> 7) GROUP BY g")
def summary_points(spark, sf):
    """Clusters of points that lie in five far places, one of them alone; some have no place."""
    g = F.when(F.col("c_custkey") == 1, 9).otherwise(F.col("c_custkey") % 4)
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 10 != 7, g * 1000).alias("x"), (g * g * 100).alias("y"))
    return S.summary_geometry(df, "x", "y").select("centroid", "count", "_id")


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 7 ELSE c_custkey % 5 END AS g, c_custkey % 11 = 0 AS lost FROM customer)
SELECT 'POINT(' || CASE WHEN g = 4 THEN 4005.0 WHEN g = 3 THEN 3003.0 ELSE g * 1000 + 3.0 END::DOUBLE || ' ' || CASE WHEN g = 4 THEN 5.0 WHEN g = 3 THEN 0.0 ELSE 3.0 END::DOUBLE || ')' AS centroid, count(*) AS count, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS _id
FROM c WHERE NOT lost AND g <> 0 GROUP BY g
""")
def summary_shapes(spark, sf):
    """Clusters of triangles, lines and frames as text, of those that meet a box; centroids by area and length."""
    g = F.when(F.col("c_custkey") == 1, 7).otherwise(F.col("c_custkey") % 5)
    at = lambda x, y: F.concat((g * 1000 + x).cast("string"), F.lit(f" {y}"))
    triangle = F.concat(F.lit("POLYGON (("), at(0, 0), F.lit(", "), at(9, 0), F.lit(", "), at(0, 9), F.lit(", "), at(0, 0), F.lit("))"))
    line = F.concat(F.lit("LINESTRING ("), at(0, 0), F.lit(", "), at(6, 0), F.lit(")"))
    frame = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in ("POLYGON ((", at(0, 0), ", ", at(10, 0), ", ", at(10, 10), ", ", at(0, 10), ", ", at(0, 0), "), (", at(2, 2), ", ", at(8, 2), ", ", at(8, 8), ", ", at(2, 8), ", ", at(2, 2), "))")])
    shape = F.when(g == 3, line).when(g == 4, frame).otherwise(triangle)
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 11 != 0, shape).alias("shape"))
    return S.summary_geometry(df, "shape", bbox=(9.5, 0, 1e6, 100)).select("centroid", "count", "_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def duplicates(spark, sf):
    """Rows of keys that occur more than once."""
    return S.find_duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    """Values of a column."""
    return S.distinct_values(table(spark, sf, "events"), "event_type")


@query("SELECT 'region' AS model, count(*) AS count FROM region UNION ALL SELECT 'orders', least(count(*), 1000) FROM orders UNION ALL SELECT 'customer', least(count(*), 1000) FROM customer")
def count_tables(spark, sf):
    """Rows per model, up to a limit."""
    return S.count_tables({n: table(spark, sf, n) for n in ("region", "orders", "customer")}, 1000)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderstatus IS NULL THEN 'done' WHEN o_orderpriority = '5-LOW' THEN 'slow' ELSE o_orderstatus END AS swapped, CASE o_orderpriority WHEN '1-URGENT' THEN 'one' WHEN '2-HIGH' THEN 'two' ELSE o_orderpriority END AS replaced FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders)")
def swap_values(spark, sf):
    """Values replaced, null too; a dictionary with itself as the default."""
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    swapped = C.swap(C.swap(status, "F", "done"), None, "done")
    swapped = F.when((swapped != "done") & (F.col("o_orderpriority") == "5-LOW"), "slow").otherwise(swapped)
    return table(spark, sf, "orders").select("o_orderkey", swapped.alias("swapped"), C.replace_values(F.col("o_orderpriority"), {"1-URGENT": "one", "2-HIGH": "two"}).alias("replaced"))


@query("SELECT page_id, len(string_split(url, '/'))::INTEGER AS parts, string_split(url, '.')[2] AS second FROM pages")
def split_text(spark, sf):
    """H2: parts around a literal separator."""
    return table(spark, sf, "pages").select("page_id", F.size(C.split(F.col("url"), "/")).alias("parts"), F.try_element_at(C.split(F.col("url"), "."), F.lit(2)).alias("second"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS text, CASE WHEN page_id % 3 = 0 THEN true ELSE false END AS bad FROM pages")
def base64_text(spark, sf):
    """H3: decoded text, and what is no base64."""
    coded = F.when(F.col("page_id") % 3 != 0, F.base64(F.col("url").cast("binary"))).otherwise(F.lit("*no*"))
    return table(spark, sf, "pages").select("page_id", C.from_base64(coded).alias("text"), C.from_base64(coded).isNull().alias("bad"))


RAW = """WITH raw AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' || c_custkey WHEN 2 THEN '+12' WHEN 3 THEN ' 12 ' WHEN 4 THEN '1.50' WHEN 5 THEN 'yes' WHEN 6 THEN '2024-02-30' ELSE '2024-02-28T10:00:00' END AS v FROM customer)"""


def _raw(spark, sf):
    k = F.col("c_custkey")
    values = {1: k.cast("string"), 2: F.lit("+12"), 3: F.lit(" 12 "), 4: F.lit("1.50"), 5: F.lit("yes"), 6: F.lit("2024-02-30"), 7: F.lit("2024-02-28T10:00:00")}
    v = F.when(k % 8 == 0, F.lit(None).cast("string"))
    for i, value in values.items():
        v = v.when(k % 8 == i, value)
    return table(spark, sf, "customer").select(k.alias("id"), v.alias("v"))


@query(RAW + """
SELECT id, coalesce(v, '') AS as_string, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v::BIGINT END AS as_integer,
  CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+(\\.[0-9]*)?') THEN trim(v)::DOUBLE END AS as_number,
  CASE WHEN v IN ('yes', '1') THEN true END AS as_boolean, CASE WHEN v LIKE '2024%' THEN try_cast(substr(v, 1, 10) AS DATE) END AS as_date FROM raw
""")
def cast_strict(spark, sf):
    """H4: strict casts of text; what has not the form is null."""
    v = F.col("v")
    out = {f"as_{to}": C.cast_to(v, T.StringType(), to) for to in ("string", "integer", "number", "boolean", "date")}
    return _raw(spark, sf).select("id", *[c.alias(n) for n, c in out.items()])


@query(RAW + "SELECT id, v FROM raw WHERE v IS NOT NULL AND NOT regexp_full_match(v, '[+-]?[0-9]+')")
def cast_rejects(spark, sf):
    """H4: the rows that a strict cast rejects."""
    return C.cast_strict(_raw(spark, sf), "v", "integer")[1]


@query("""
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS p, CASE l_partkey % 5 WHEN 0 THEN '1,' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '.5' WHEN 1 THEN l_partkey || ',5' WHEN 2 THEN 'n/a' WHEN 3 THEN 'NaN' ELSE '1,234,' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 1000.5 + l_partkey % 1000 WHEN 1 THEN l_partkey + 0.5 WHEN 4 THEN 1234000.0 + l_partkey % 1000 END::DOUBLE AS number FROM raw
""")
def clean_numbers(spark, sf):
    """H5: numbers from loose text."""
    k = F.col("l_partkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    text = F.when(k % 5 == 0, F.concat(F.lit("1,"), three, F.lit(".5"))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(",5"))).when(k % 5 == 2, "n/a").when(k % 5 == 3, "NaN").otherwise(F.concat(F.lit("1,234,"), three))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k, C.clean(text, "number").alias("number"))


@query("SELECT c_custkey, 'POINT (' || c_custkey || ' ' || c_nationkey || ')' AS wkt, 'SRID=3346;POINT (' || c_nationkey || ' ' || c_custkey || ')' AS flipped, -c_nationkey AS neg, 'POINT (' || c_nationkey || ' ' || c_custkey || ')' AS label, 'https://www.openstreetmap.org/?mlat=' || c_nationkey || '&mlon=' || c_custkey || '#map=19/' || c_nationkey || '/' || c_custkey AS link FROM customer")
def points(spark, sf):
    """Points, flipped ones, negatives and labels."""
    p = C.point(F.col("c_custkey"), F.col("c_nationkey"))
    flipped = C.flip(F.concat(F.lit("SRID=3346;"), p))
    return table(spark, sf, "customer").select("c_custkey", C.flip(p, 2).alias("wkt"), flipped.alias("flipped"), C.negative(F.col("c_nationkey")).alias("neg"), C.geometry_label(flipped).alias("label"), C.centroid_link(F.col("c_custkey"), F.col("c_nationkey")).alias("link"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN l_orderkey || ',' || l_linenumber END AS id, CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber::VARCHAR END AS second FROM lineitem")
def composite_ids(spark, sf):
    """Comma-joined keys and back; null with a null part."""
    made = C.composite_id(F.col("l_orderkey"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", made.alias("id"), F.try_element_at(C.split_id(made), F.lit(2)).alias("second"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS number, CASE WHEN c_custkey % 3 <> 0 THEN substr('YMQWDHTSLU', c_nationkey % 10 + 1, 1) END AS unit FROM customer")
def time_units(spark, sf):
    """Texts like 14D."""
    letter = F.substring(F.lit("YMQWDHTSLU"), F.col("c_nationkey") % 10 + 1, F.lit(1))
    unit = C.parse_time_unit(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.col("c_custkey").cast("string"), letter)).otherwise("D14"))
    return table(spark, sf, "customer").select("c_custkey", unit.getField("number").alias("number"), unit.getField("unit").alias("unit"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 1 END AS code, o_orderstatus IN ('F', 'P') AS is_one FROM orders")
def map_enum(spark, sf):
    """Prepared values of codes, and the codes of a value."""
    mapping = {"F": 1, "O": 2, "P": 1}
    return table(spark, sf, "orders").select("o_orderkey", C.map_enum(F.col("o_orderstatus"), mapping).alias("code"), F.col("o_orderstatus").isin(*C.enum_codes(mapping, 1)).alias("is_one"))


@query("""
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '9' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') ELSE (3 + c_custkey % 4) || lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey % 14)::VARCHAR, 2, '0') || lpad((c_custkey % 32)::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS ten FROM customer),
x AS (SELECT *, [substr(ten, i, 1)::INTEGER FOR i IN range(1, 11)] AS g FROM d),
y AS (SELECT *, (g[1]*1+g[2]*2+g[3]*3+g[4]*4+g[5]*5+g[6]*6+g[7]*7+g[8]*8+g[9]*9+g[10]*1) % 11 AS a, (g[1]*3+g[2]*4+g[3]*5+g[4]*6+g[5]*7+g[6]*8+g[7]*9+g[8]*1+g[9]*2+g[10]*3) % 10 AS b FROM x)
SELECT c_custkey, ten || (c_custkey % 2 * CASE WHEN a <> 10 THEN a ELSE b END) AS code,
  g[1] = 9 OR ((c_custkey % 2 * CASE WHEN a <> 10 THEN a ELSE b END) = CASE WHEN a <> 10 THEN a ELSE b END
  AND (substr(ten, 2, 2) = '00' OR substr(ten, 4, 2) = '00' OR substr(ten, 6, 2) = '00' OR coalesce(try_cast((17 + g[1] // 2) || substr(ten, 2, 2) || '-' || substr(ten, 4, 2) || '-' || substr(ten, 6, 2) AS DATE) <= DATE '2025-06-01', false))) AS valid FROM y
""")
def national_id(spark, sf):
    """Personal codes: a leading 9, a date that exists or is unknown, and the check digit."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ten = F.when(k % 5 == 0, F.concat(F.lit("9"), pad(k * 7919 % 1000000000, 9))).otherwise(F.concat((3 + k % 4).cast("string"), pad(k % 100, 2), pad(k % 14, 2), pad(k % 32, 2), pad(k % 1000, 3)))
    digit = [F.substring(ten, i + 1, 1).cast("int") for i in range(10)]
    weigh = lambda ws: sum((d * w for d, w in zip(digit, ws, strict=True)), F.lit(0))
    a, b = weigh((1, 2, 3, 4, 5, 6, 7, 8, 9, 1)) % 11, weigh((3, 4, 5, 6, 7, 8, 9, 1, 2, 3)) % 10
    last = F.when(a != 10, a).otherwise(b)
    df = table(spark, sf, "customer").select("c_custkey", F.concat(ten, (k % 2 * last).cast("string")).alias("code"))
    return df.withColumn("valid", C.is_national_id(F.col("code"), F.lit("2025-06-01").cast("date")))


TYPED = Model("customer", (Property("number", "integer", required=True), Property("day", "date"), Property("flag", "boolean", required=True)), ("_id",))


def _typed(spark, sf):
    k = F.col("c_custkey")
    number = F.when(k % 6 == 0, "x1").when(k % 6 == 1, F.lit(None)).otherwise(k.cast("string"))
    day = F.when(k % 5 == 0, "2024-02-30").when(k % 5 == 1, "").otherwise("2024-02-28")
    return table(spark, sf, "customer").select(k.alias("_id"), number.alias("number"), day.alias("day"), F.when(k % 4 == 0, "maybe").otherwise("on").alias("flag"))


@query("""
SELECT 'customer' AS model, c_custkey::VARCHAR AS _id, 'number' AS property, 'type:integer' AS code, 'x1' AS value FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'day', 'type:date', '2024-02-30' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'flag', 'type:boolean', 'maybe' FROM customer WHERE c_custkey % 4 = 0
""")
def check_types(spark, sf):
    """Values that don't have the form of their type."""
    return Q.check_types(_typed(spark, sf), TYPED)


@query("SELECT 'customer' AS model, c_custkey::VARCHAR AS _id, 'number' AS property, 'required' AS code, NULL::VARCHAR AS value FROM customer WHERE c_custkey % 6 = 1")
def check_required(spark, sf):
    """Required values that are missing."""
    return Q.check_required(_typed(spark, sf), TYPED)


@query("SELECT 'line' AS model, l_partkey::VARCHAR AS _id, 'ok,l_linenumber' AS property, 'unique' AS code, ok || ',' || l_linenumber AS value FROM (SELECT *, CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey END AS ok FROM lineitem) WHERE ok IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ok, l_linenumber) > 1")
def check_unique(spark, sf):
    """Keys that several rows have; a null equals nothing."""
    df = table(spark, sf, "lineitem").withColumn("ok", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey")))
    return Q.check_unique(df, ["ok", "l_linenumber"], "line", "l_partkey")


@query("SELECT 'orders' AS model, o_orderkey::VARCHAR AS _id, 'fk' AS property, 'ref' AS code, (o_custkey * 2)::VARCHAR AS value FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def check_refs(spark, sf):
    """I4: references to nothing."""
    df = table(spark, sf, "orders").withColumn("fk", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 2))
    return Q.check_refs(df, "fk", table(spark, sf, "customer"), "c_custkey", "orders", "o_orderkey")


@query("SELECT DISTINCT 'orders' AS model, 'status' AS property, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS value FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus NOT IN ('F', 'done', 'X')")
def check_enum(spark, sf):
    """Values outside the enum."""
    df = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    return Q.check_enum(df, Property("status", required=True, enum={"F": "done", "X": None}), "orders")


@query("SELECT 'c' AS model, c_custkey::VARCHAR AS _id, 'u' AS property, 'uuid' AS code, substr(md5(c_name), 1, 8) AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'c', c_custkey::VARCHAR, 'm', 'unknown-language', 'xx' FROM customer WHERE c_custkey % 4 = 0")
def check_values(spark, sf):
    """Malformed ids, undeclared keys."""
    h = F.md5(F.col("c_name").cast("binary"))
    full = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(k.alias("_id"), F.when(k % 3 == 0, F.substring(h, 1, 8)).otherwise(full).alias("u"), F.create_map(F.when(k % 4 == 0, "xx").otherwise("lt"), F.lit("v"), F.lit("en"), F.lit("w")).alias("m"))
    return Q.check_uuid(df, "u", "c").unionByName(Q.check_langs(df, "m", ["lt", "en"], "c"))


@query("SELECT 'c' AS model, c_custkey::VARCHAR AS _id, 'name' AS property, 'base' AS code, 'other' AS value FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey % 3 = 0")
def check_base_values(spark, sf):
    """Inherited values that differ from the base row's."""
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id")).join(base, "_id", "left").withColumn("name", F.when(F.col("_id") % 3 == 0, "other").otherwise(F.col("name")))
    return Q.check_base_values(own, base, ["name"], "c")


@query("SELECT 'c' AS model, c_custkey::VARCHAR AS _id, 'wkt' AS property, 'bounds' AS code, 'POINT (' || c_custkey % 100 || ' ' || c_nationkey || ')' AS value FROM customer WHERE NOT (c_custkey % 100 > 10 AND c_custkey % 100 < 60 AND c_nationkey > 2 AND c_nationkey < 20)")
def check_bounds(spark, sf):
    """I8: points on or beyond the bounds."""
    df = table(spark, sf, "customer").withColumn("wkt", C.point(F.col("c_custkey") % 100, F.col("c_nationkey")))
    return Q.check_bounds(df, "wkt", (10, 2, 60, 20), "c", "c_custkey")


@query("SELECT property, code, count(*) AS count, 'customer' AS model FROM (SELECT 'number' AS property, 'type:integer' AS code FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'day', 'type:date' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'flag', 'type:boolean' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'number', 'required' FROM customer WHERE c_custkey % 6 = 1) GROUP BY ALL")
def check_all_counts(spark, sf):
    """All checks together, counted."""
    df = _typed(spark, sf)
    return Q.rule_counts(Q.check_all(df, [Q.check_types(df, TYPED), Q.check_required(df, TYPED)])[1])


@query("SELECT c_custkey AS _id FROM customer WHERE c_custkey % 6 NOT IN (0, 1) AND c_custkey % 5 <> 0 AND c_custkey % 4 <> 0")
def check_all_valid(spark, sf):
    """The rows that pass all checks."""
    df = _typed(spark, sf)
    return Q.check_all(df, [Q.check_types(df, TYPED), Q.check_required(df, TYPED)])[0].select("_id")


@query(r"""
WITH p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id || '@b.org' WHEN doc_id % 3 = 1 THEN '+370 612 ' || lpad((doc_id % 100000)::VARCHAR, 5, '0') ELSE 'see a@b.org' END AS contact,
  CASE WHEN doc_id % 4 <> 0 THEN '9' || lpad(doc_id::VARCHAR, 10, '0') ELSE 'a' || doc_id || '@b.org' END AS code, CASE WHEN doc_id % 5 <> 0 THEN 'a' || doc_id || '@b.org' END AS mail, lang, text FROM documents),
cells AS (SELECT 'contact' AS "column", contact AS v FROM p UNION ALL SELECT 'code', code FROM p UNION ALL SELECT 'mail', mail FROM p UNION ALL SELECT 'lang', lang FROM p UNION ALL SELECT 'text', text FROM p),
one AS (SELECT *, regexp_full_match(v, '9[0-9]{10}') AS i FROM cells WHERE v IS NOT NULL),
two AS (SELECT *, CASE WHEN NOT i THEN regexp_full_match(v, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') END AS e FROM one),
three AS (SELECT *, CASE WHEN NOT i AND NOT e THEN regexp_matches(v, '(?:\+370|\b8)[ -]?(?:\(?[0-9]{1,3}\)?[ -]?)?[0-9]{2,3}[ -]?[0-9]{2,5}') END AS f FROM two),
s AS (SELECT "column", avg(i::INTEGER::DOUBLE) AS id, avg(e::INTEGER::DOUBLE) AS email, avg(f::INTEGER::DOUBLE) AS phone FROM three GROUP BY "column")
SELECT *, CASE WHEN phone > 0.5 THEN 'pii:phone' WHEN email > 0.5 THEN 'pii:email' WHEN id > 0.5 THEN 'pii:id' END AS uri FROM s
""")
def pii_profile(spark, sf):
    """Shares of cells that are a personal code, an address or a phone number, in this order, and the column's tag."""
    k = F.col("doc_id")
    mail = F.concat(F.lit("a"), k.cast("string"), F.lit("@b.org"))
    contact = F.when(k % 3 == 0, mail).when(k % 3 == 1, F.concat(F.lit("+370 612 "), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise("see a@b.org")
    code = F.when(k % 4 != 0, F.concat(F.lit("9"), F.lpad(k.cast("string"), 10, "0"))).otherwise(mail)
    df = table(spark, sf, "documents").select(contact.alias("contact"), code.alias("code"), F.when(k % 5 != 0, mail).alias("mail"), "lang", "text")
    return Q.detect_pii(df, today=F.lit("2025-06-01").cast("date"))


@query(r"""
WITH raw AS (SELECT o_orderkey::VARCHAR AS ok, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 100 / 4)::VARCHAR ELSE '' END AS qty, o_orderstatus AS flag, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_orderkey % 2)::VARCHAR || '0' AS bits, CASE WHEN o_custkey % 3 = 0 THEN 'true' ELSE 'False' END AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS name FROM orders),
cells AS (SELECT 'ok' AS "column", ok AS v FROM raw UNION ALL SELECT 'qty', nullif(qty, '') FROM raw UNION ALL SELECT 'flag', flag FROM raw UNION ALL SELECT 'day', day FROM raw UNION ALL SELECT 'bits', bits FROM raw UNION ALL SELECT 'b', b FROM raw UNION ALL SELECT 'name', name FROM raw)
SELECT "column", CASE WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean' WHEN bool_and(regexp_full_match(v, '[01]{2,}')) THEN 'binary' WHEN bool_and(regexp_full_match(v, '-?[0-9]+')) THEN 'integer' WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (WHERE v IS NOT NULL) THEN 'number' WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'date' ELSE 'string' END AS type,
  count(v) = count(*) AS required, count(DISTINCT v) = count(v) AS "unique" FROM cells GROUP BY "column"
""")
def infer_schema(spark, sf):
    """Types of text columns by one aggregation; two of them are unique."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf, "orders").select(
        k.cast("string").alias("ok"),
        F.when(c % 7 != 0, (c % 100 / 4).cast("string")).otherwise("").alias("qty"),
        F.col("o_orderstatus").alias("flag"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat((k % 2).cast("string"), F.lit("0")).alias("bits"),
        F.when(c % 3 == 0, "true").otherwise("False").alias("b"),
        F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"),
    )
    return Q.infer_schema(df)


@query("""
SELECT 't' || c_nationkey AS "table", 'c' || c_custkey AS "column", CASE WHEN c_custkey % 5 = 0 THEN 'ref' ELSE CASE c_custkey % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'datetime' WHEN 4 THEN 'boolean' ELSE 'date' END END AS type,
  c_custkey % 4 = 0 AS pk, CASE WHEN c_custkey % 5 = 0 THEN 't' || c_custkey % 25 END AS ref FROM customer
""")
def infer_refs(spark, sf):
    """Properties from a database's catalogue: types, primary keys and references."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table"), F.concat(F.lit("c"), k.cast("string")).alias("column"))
    kinds = F.array(*map(F.lit, ("bigint", "NUMERIC(10,2)", "varchar(20)", "timestamp without time zone", "BOOLEAN", "date")))
    columns = c.select("table", "column", F.get(kinds, (k % 6).cast("int")).alias("sql_type"))
    primary = c.filter(k % 4 == 0).select("table", "column", F.lit("p").alias("kind"), F.lit(None).cast("string").alias("target"))
    foreign = c.filter(k % 5 == 0).select("table", "column", F.lit("f").alias("kind"), F.concat(F.lit("t"), (k % 25).cast("string")).alias("target"))
    return Q.infer_refs(columns, primary.union(foreign))


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 't' || k AS "table", 'a' AS property, 'a' AS columns, CASE WHEN k % 3 = 0 THEN 'ref' ELSE 'integer' END AS type, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS pk,
  CASE WHEN k % 3 = 0 THEN 't' || (k + 1) END AS ref, CASE WHEN k % 3 = 0 THEN CASE WHEN (k + 1) % 2 = 0 THEN 'a' ELSE '' END END AS refprops, CASE WHEN k % 3 = 0 THEN (k + 1) % 2 <> 0 AND k + 1 <= (SELECT max(k) FROM s) END AS "unique" FROM s
UNION ALL SELECT 't' || k, 'b', 'b', 'string', CASE WHEN k % 2 = 0 THEN 1 END, NULL, NULL, NULL FROM s
UNION ALL SELECT 't' || k, 'c', 'c', 'date', NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT 't' || k, 'c_b', 'c,b', 'ref', NULL, 't' || (k + 2), CASE WHEN k % 2 = 0 AND k % 4 = 0 AND k + 2 <= (SELECT max(k) FROM s) THEN '' WHEN k % 4 = 0 THEN 'b,a' ELSE 'a,b' END, k % 2 = 0 AND k + 2 <= (SELECT max(k) FROM s) FROM s
""")
def infer_keys(spark, sf):
    """Keys of several columns: of every other table the primary key, of each a foreign key, in the target's order or not."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("table"))
    columns = s.select("table", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("sql_type")) for c, t in (("a", "bigint"), ("b", "varchar(9)"), ("c", "date"))])))
    k = F.col("k")
    row = lambda name, kind, position, column, target=None, to=None: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(position).alias("position"), F.lit(column).alias("column"), (F.lit(None) if target is None else target).cast("string").alias("target"), (F.lit(None) if to is None else to).cast("string").alias("target_column"))
    next_, after = F.concat(F.lit("t"), (k + 1).cast("string")), F.concat(F.lit("t"), (k + 2).cast("string"))
    primary = F.when(k % 2 == 0, F.array(row("pk", "p", 2, "a"), row("pk", "p", 1, "b"))).otherwise(F.array(row("pk", "p", 1, "a")))
    single = F.when(k % 3 == 0, F.array(row("f1", "f", 1, "a", next_, F.lit("a")))).otherwise(F.array().cast("array<struct<name:string,kind:string,position:int,column:string,target:string,target_column:string>>"))
    first, second = (F.when(k % 4 == 0, x).otherwise(y) for x, y in (("b", "a"), ("a", "b")))
    composite = F.array(row("f2", "f", 2, "b", after, second), row("f2", "f", 1, "c", after, first))
    constraints = s.select("table", F.inline(F.concat(primary, single, composite)))
    found = Q.infer_keys(columns, constraints)
    return found.withColumns({"columns": F.array_join("columns", ","), "refprops": F.array_join("refprops", ",")})


@query("""
SELECT coalesce(o.c_nationkey, n.c_nationkey) AS model, coalesce(o.c_name, n.c_name) AS property, CASE WHEN o.c_name IS NULL THEN 'added' WHEN n.c_name IS NULL THEN 'removed' WHEN o.t = n.t THEN 'same' ELSE 'changed' END AS change,
  coalesce(n.t, o.t) AS type, coalesce(o.title, n.title) AS title
FROM (SELECT *, c_custkey AS t, 'old' AS title FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS t, 'new' AS title FROM customer WHERE c_custkey % 4 <> 0) n ON o.c_name = n.c_name AND o.c_nationkey = n.c_nationkey
""")
def schema_diff(spark, sf):
    """What was added, removed and changed; old descriptions win."""
    df = table(spark, sf, "customer").select(F.col("c_nationkey").alias("model"), F.col("c_name").alias("property"), F.col("c_custkey").alias("type"))
    old = df.filter("type % 3 <> 0").withColumn("title", F.lit("old"))
    new = df.filter("type % 4 <> 0").withColumns({"type": F.when(F.col("type") % 5 == 0, -1).otherwise(F.col("type")), "title": F.lit("new")})
    return Q.schema_diff(old, new)
