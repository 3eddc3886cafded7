"""Queries of projection, predicates, references, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.clean import point
from ..functions.predicates import Field
from ..model import Model, Property, Table
from ..operators import paging, project, refs
from .base import REPORTS, catalog, query, reports, table


@query("""
SELECT o.o_orderkey, o.o_totalprice, n.n_name AS o_custkey_c_nationkey_n_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE n.n_name = 'NATION_3' ORDER BY o.o_totalprice DESC NULLS FIRST, o.o_orderkey LIMIT 20
""")
def search_path_page(spark, sf):
    """The orders of a nation's customers, dearest first, one page."""
    path = "o_custkey.c_nationkey.n_name"
    return refs.search(catalog(spark, sf), "orders", ["o_orderkey", "o_totalprice", path], lambda df: F.col(f"`{path}`") == "NATION_3", ["-o_totalprice", "o_orderkey"], 20)


@query(REPORTS + "SELECT id, key AS \"customer.key\", array_to_string(list_sort([x FOR x IN flags IF x IS NOT NULL]), ',') AS flags FROM r WHERE flags IS NOT NULL")
def select_paths(spark, sf):
    """Nested paths, and the values below a list."""
    df = project.select(reports(spark, sf), "id", "customer.key", "lines.flag").filter("`lines.flag` is not null")
    return df.select("id", "`customer.key`", F.array_join(F.array_sort(F.filter("`lines.flag`", lambda x: x.isNotNull())), ",").alias("flags"))


@query(REPORTS + "SELECT '{\"key\":' || key || ',\"status\":\"' || prio || '\"}' AS customer FROM r")
def select_struct(spark, sf):
    """B2: a whole object."""
    return project.select_struct(reports(spark, sf), "customer").select(F.to_json("customer").alias("customer"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{\"_id\":' || c_nationkey || ',\"n_name\":\"' || n_name || '\"}' ELSE '{\"n_name\":\"' || n_name || '\"}' END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def select_ref(spark, sf):
    """A reference as the target's id with a denormalised value, or as its natural key."""
    df = refs.join_ref(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey")
    columns = {"_id": F.col("c_nationkey"), "n_name": F.col("`c_nationkey.n_name`")}
    ident, loose = Property("c_nationkey", "ref", level=4), Property("c_nationkey", "ref", level=3, refprops=("n_name",))
    shown = [F.to_json(project.ref_struct(p, columns)) for p in (ident, loose)]
    return df.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, shown[0]).otherwise(shown[1]).alias("nation"))


@query(REPORTS + "SELECT id, 0::INTEGER AS n_lines FROM r")
def expand_none(spark, sf):
    """Lists that aren't expanded are empty."""
    return project.expand(reports(spark, sf)).select("id", F.size("lines").alias("n_lines"))


@query(REPORTS + "SELECT id, coalesce(len(flags), -1)::INTEGER AS n_lines FROM r")
def expand_all(spark, sf):
    """Lists that are."""
    return project.expand(reports(spark, sf), "*").select("id", F.when(F.col("lines").isNull(), -1).otherwise(F.size("lines")).alias("n_lines"))


def _texts(spark, sf):
    name, k = F.col("c_name"), F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.map_filter(F.create_map(F.lit("lt"), F.when(k % 3 != 0, F.concat(name, F.lit("_lt"))), F.lit("en"), F.when(k % 2 != 0, F.concat(name, F.lit("_en"))), F.lit("de"), name), lambda k, v: v.isNotNull()).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_name || '_en' WHEN c_custkey % 3 <> 0 THEN c_name || '_lt' ELSE c_name END AS title FROM customer")
def pick_language(spark, sf):
    """The first accepted language that has a value, then the default, then the declared ones."""
    return _texts(spark, sf).select("c_custkey", project.pick_language(F.col("title"), ["fr", "en"], ["lt", "en", "de"], ["lt"]).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'lt,de' ELSE 'de' END AS langs FROM customer")
def select_languages(spark, sf):
    """Some languages of a text."""
    return _texts(spark, sf).select("c_custkey", F.array_join(F.map_keys(project.select_languages(F.col("title"), ["lt", "de"])), ",").alias("langs"))


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, 'x' AS fixed, o_orderkey || '|' || o_custkey AS pair FROM orders")
def compute_columns(spark, sf):
    """Derived columns from an expression, a literal and a tuple."""
    df = table(spark, sf, "orders")
    df = project.compute(project.compute(df, "doubled", F.col("o_totalprice") * 2), "fixed", "x")
    df = project.compute(df, "pair", (F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))
    return df.select("o_orderkey", "doubled", "fixed", F.array_join("pair", "|").alias("pair"))


CUSTOMER = Model("customer", (Property("c_custkey", "integer", access="open"), Property("c_name", access="public"), Property("c_acctbal", "number", access="private"), Property("c_mktsegment", access="open"), Property("c_nationkey", "ref", access="protected")), ("c_custkey",))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_private(spark, sf):
    """Only columns open enough."""
    return project.drop_private(table(spark, sf, "customer"), CUSTOMER, "public")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 10 ORDER BY c_custkey")
def apply_scope(spark, sf):
    """A named view, queried inside its columns."""
    df = table(spark, sf, "customer")
    scope = project.Scope(df, ["c_custkey", "c_name", "c_mktsegment"], Field(df, "c_mktsegment").eq("BUILDING"))
    return scope.query(lambda d: Field(d, "c_custkey").gt(10), ["c_custkey", "c_name"], ["c_custkey"], ["c_custkey"])


@query("""
WITH a AS (SELECT conv_id, role, substr(text, 1, 5) AS t FROM conversations),
u AS (SELECT conv_id, t FROM a WHERE role = 'user'), s AS (SELECT conv_id, t FROM a WHERE role = 'assistant' AND conv_id % 3 <> 0),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, u.t AS asked, s.t AS said FROM c LEFT JOIN u ON c.conv_id = u.conv_id LEFT JOIN s ON c.conv_id = s.conv_id
""")
def flatten_two_lists(spark, sf):
    """Lists side by side give every combination, an empty one keeps the row."""
    rows = table(spark, sf, "conversations").withColumn("t", F.substring("text", 1, 5))
    said = F.when(F.col("conv_id") % 3 != 0, F.when(F.col("role") == "assistant", F.col("t")))
    lists = rows.groupBy("conv_id").agg(F.struct(F.collect_list(F.when(F.col("role") == "user", F.col("t"))).alias("asked"), F.collect_list(said).alias("said")).alias("turns"))
    return project.flatten(lists).toDF("conv_id", "asked", "said")


@query(REPORTS + "SELECT id, key, prio FROM r")
def nest_again(spark, sf):
    """Flat columns into objects and back."""
    flat = project.flatten(reports(spark, sf).drop("lines"))
    return project.nest(flat).select("id", F.col("customer.key").alias("key"), F.col("customer.status").alias("prio"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation, c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'nation=1:5' ELSE '' END AS name FROM customer)
SELECT c_custkey AS _id, sha1(concat_ws(chr(10), 'name=' || length(name) || ':' || name, 'nation=' || length(nation::VARCHAR) || ':' || nation)) AS checksum FROM c
""")
def checksum_rows(spark, sf):
    """The checksum of the sorted path and value pairs, without nulls and reserved columns; values hold separators."""
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 0, "\nnation=1:5").otherwise(""))
    df = table(spark, sf, "customer").select(k.alias("_id"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("nation"), name.alias("name"))
    return df.select("_id", project.checksum(df).alias("checksum"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day, base64(encode(o_orderstatus)) AS raw, o_orderkey / 4.0::DOUBLE AS part FROM orders")
def json_safe(spark, sf):
    """Dates, binary and decimals as JSON can hold them."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").cast("binary").alias("raw"), (F.col("o_orderkey").cast("decimal(18,2)") / F.lit(4).cast("decimal(3,0)")).alias("part"))
    return project.to_json_safe(df)


@query(REPORTS + "SELECT id, status IS NULL AS none, coalesce(status = 'F', false) AS f FROM r WHERE status IS NULL OR status = 'F'")
def eq_values(spark, sf):
    """Equal to a value, and to null."""
    df = reports(spark, sf)
    return df.filter(P.any_of(Field(df, "status").eq(None), Field(df, "status").eq("F"))).select("id", F.col("status").isNull().alias("none"), F.coalesce(F.col("status") == "F", F.lit(False)).alias("f"))


@query(REPORTS + "SELECT id, (price > 1000) AS dear FROM r WHERE status <> 'F' AND status IS NOT NULL AND (CASE WHEN id % 5 <> 0 THEN price > 1000 END) IS NOT TRUE")
def ne_values(spark, sf):
    """Unequal drops nulls, is-not of a boolean keeps them."""
    df = reports(spark, sf).withColumn("big", F.when(F.col("id") % 5 != 0, F.col("price") > 1000))
    return df.filter(P.all_of(Field(df, "status").ne("F"), Field(df, "status").ne(None), Field(df, "big").ne(True))).select("id", (F.col("price") > 1000).alias("dear"))


@query(REPORTS + "SELECT id FROM r WHERE (price >= 1000 AND price < 200000.5) AND day > DATE '1995-01-01' AND id <= 50000")
def compare_values(spark, sf):
    """Ordered comparisons; ISO text is coerced for dates."""
    df = reports(spark, sf)
    return df.filter(P.all_of(Field(df, "price").ge(1000), Field(df, "price").lt(200000.5), Field(df, "day").gt("1995-01-01"), Field(df, "id").le(50000))).select("id")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer') AND contains(c_name, '1') OR starts_with(c_mktsegment, 'A')")
def text_predicates(spark, sf):
    """C4: beginnings and parts of text."""
    df = table(spark, sf, "customer")
    name = Field(df, "c_name")
    return df.filter(P.any_of(P.all_of(name.startswith("Customer"), name.contains("1")), Field(df, "c_mktsegment").startswith("A"))).select("c_custkey", "c_name")


@query(REPORTS + "SELECT id, status FROM r WHERE status IN ('F', 'P') AND prio NOT IN ('1-URGENT', '5-LOW')")
def in_lists(spark, sf):
    """One of, none of."""
    df = reports(spark, sf)
    return df.filter(P.all_of(Field(df, "status").eq(["F", "P"]), Field(df, "customer.status").ne(["1-URGENT", "5-LOW"]))).select("id", "status")


@query(REPORTS + "SELECT id FROM r WHERE starts_with(prio, '1') OR starts_with(prio, '3')")
def any_values(spark, sf):
    """One predicate over several values."""
    df = reports(spark, sf)
    return df.filter(P.any_value("startswith", Field(df, "customer.status"), "1", "3")).select("id")


@query(REPORTS + "SELECT id FROM r WHERE status = 'F' OR prio = 'F' OR status = '2-HIGH' OR prio = '2-HIGH'")
def any_recurse(spark, sf):
    """Over every leaf of a name, at any depth."""
    df = reports(spark, sf)
    return df.filter(P.any_of(P.recurse_any(df, "status", "eq", "F"), P.recurse_any(df, "status", "eq", "2-HIGH"))).select("id")


@query(REPORTS + "SELECT id FROM r WHERE len([x FOR x IN coalesce(flags, []) IF x = 'R']) > 0 AND len([x FOR x IN coalesce(qtys, []) IF x > 45]) > 0")
def array_any(spark, sf):
    """Any element."""
    df = reports(spark, sf)
    return df.filter(Field(df, "lines.flag").eq("R") & Field(df, "lines.qty").gt(45)).select("id")


@query(REPORTS + "SELECT id FROM r WHERE len([x FOR x IN coalesce(flags, []) IF x IS NOT NULL]) > 0 AND len([x FOR x IN flags IF x = 'R']) = 0")
def array_ne(spark, sf):
    """Some element, and none of that value."""
    df = reports(spark, sf)
    return df.filter(Field(df, "lines.flag").ne("R")).select("id")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' AND c.c_acctbal > 5000
""")
def foreign_predicates(spark, sf):
    """Predicates four references away; one join per distinct path."""
    region, balance = "l_orderkey.o_custkey.c_nationkey.n_regionkey.r_name", "l_orderkey.o_custkey.c_acctbal"
    df = refs.join_path(catalog(spark, sf), "lineitem", [region, balance])
    return df.filter((F.col(f"`{region}`") == "ASIA") & (F.col(f"`{balance}`") > 5000)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(REPORTS + "SELECT id, upper(status) AS status FROM r WHERE lower(status) = 'f' OR lower(prio) LIKE '%high%' OR length(prio) > 10")
def case_and_length(spark, sf):
    """Lower, upper and length compared."""
    df = reports(spark, sf)
    test = P.any_of(P.recurse_any(df, "status", "eq", "f", "lower"), Field(df, "customer.status").lower().contains("high"), Field(df, "customer.status").length().gt(10))
    return df.filter(test).select("id", F.upper("status").alias("status"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN l_orderkey END AS fk FROM lineitem)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM l LEFT JOIN orders o ON l.fk = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE l_linenumber < 5 AND (o.o_orderstatus IS NULL OR o.o_orderstatus = 'F') AND (n.n_regionkey IS NULL OR n.n_regionkey <> 2)
""")
def ref_filters_null_tolerant(spark, sf):
    """Own filters of referenced models, through the chain; rows without the reference pass."""
    c = catalog(spark, sf)
    line = c["lineitem"].df.withColumn("fk", F.when(F.col("l_partkey") % 7 != 0, F.col("l_orderkey")))
    c["lineitem"] = Table(line, "l_orderkey", {"fk": "orders", "l_partkey": "part"}, lambda df: Field(df, "l_linenumber").lt(5))
    c["orders"] = Table(c["orders"].df, "o_orderkey", c["orders"].refs, lambda df: Field(df, "o_orderstatus").eq("F"))
    c["nation"] = Table(c["nation"].df, "n_nationkey", c["nation"].refs, lambda df: Field(df, "n_regionkey").ne(2))
    return refs.inherit_ref_filters(c, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def enum_access(spark, sf):
    """Only enum values open enough."""
    return refs.enum_access_filter(table(spark, sf, "orders"), "o_orderstatus", {"F": "open", "O": "public", "P": "private"}, "public").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_custkey % 90 BETWEEN 10 AND 40")
def bbox_points(spark, sf):
    """C17: points in a box."""
    df = table(spark, sf, "customer").withColumn("wkt", point(F.col("c_acctbal"), F.col("c_custkey") % 90))
    return df.filter(P.bbox(F.col("wkt"), 0, 10, 5000, 40)).select("c_custkey")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 60 AS k, c_custkey % 5 AS s FROM customer)
SELECT c_custkey FROM c WHERE CASE s
  WHEN 0 THEN k >= 30
  WHEN 1 THEN k >= 30
  WHEN 2 THEN k BETWEEN 20 AND 31
  WHEN 3 THEN k >= 30 OR k BETWEEN 10 AND 30
  ELSE k <= 30 END
""")
def bbox_shapes(spark, sf):
    """C17: lines, triangles, frames around a hole, several lines and collections that meet a box, not only by their envelope."""
    k = (F.col("c_custkey") % 60).cast("string")
    less = ((F.col("c_custkey") % 60) - 1).cast("string")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    slope = text("(", k, " 0, 0 ", k, ")")  # meets the box from its nearest corner on, 10 + 20
    shapes = [
        text("LINESTRING ", slope),
        text("POLYGON ((0 0, ", k, " 0, 0 ", k, ", 0 0))"),
        text("SRID=4326;POLYGON ((0 0, ", k, " 0, ", k, " ", k, ", 0 ", k, ", 0 0), (1 1, ", less, " 1, ", less, " ", less, ", 1 ", less, ", 1 1))"),
        text("MULTILINESTRING (", slope, ", (", k, " 0, ", k, " 100))"),
        text("GEOMETRYCOLLECTION (POINT (", k, " 25), MULTIPOLYGON (((40 0, ", k, " 0, ", k, " 100, 40 100, 40 0)), ((41 0, 42 0, 42 1, 41 0))), POINT (0 0))"),
    ]
    wkt = F.element_at(F.array(*shapes), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "customer").filter(P.bbox(wkt, 10, 20, 30, 30)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' AND o_totalprice < 150000")
def merged_filters(spark, sf):
    """Model, request and enum filters one after the other."""
    df = table(spark, sf, "orders")
    return refs.merged_filters(df, lambda d: Field(d, "o_orderkey").gt(100), None, lambda d: Field(d, "o_orderstatus").eq("F"), lambda d: Field(d, "o_totalprice").lt(150000)).select("o_orderkey")


@query("SELECT c.c_custkey, n.n_name, n.n_regionkey FROM customer c LEFT JOIN nation n ON CASE WHEN c.c_custkey % 5 <> 0 THEN c.c_nationkey END = n.n_nationkey")
def join_ref(spark, sf):
    """Left join on a reference; null ones stay."""
    df = table(spark, sf, "customer").withColumn("ref", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")))
    return refs.join_ref(df, "ref", table(spark, sf, "nation"), "n_nationkey").select("c_custkey", F.col("`ref.n_name`").alias("n_name"), F.col("`ref.n_regionkey`").alias("n_regionkey"))


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_mktsegment = 'BUILDING'")
def join_ref_keys(spark, sf):
    """D3: composite keys, one of them a literal."""
    out = refs.join_ref_keys(table(spark, sf, "supplier"), "c", table(spark, sf, "customer"), [("s_nationkey", "c_nationkey"), (F.lit("BUILDING"), "c_mktsegment")])
    return out.select("s_suppkey", F.col("`c.c_custkey`").alias("c_custkey"))


@query("SELECT c.c_custkey AS _id, coalesce(CASE WHEN c.c_custkey % 4 <> 0 THEN c.c_name END, 'base') AS name, s.s_acctbal AS balance FROM customer c LEFT JOIN (SELECT *, 'base' AS b FROM supplier) s ON c.c_custkey = s.s_suppkey WHERE c.c_custkey % 4 <> 0 OR s.s_suppkey IS NOT NULL")
def join_base(spark, sf):
    """Inherited columns of the base row; own values first."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"))
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_id"), F.lit("base").alias("name"), F.col("s_acctbal").alias("balance"))
    return refs.join_base(own, base).filter("name is not null")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o ON c.c_custkey = o.o_custkey")
def join_backref(spark, sf):
    """The one row that refers back."""
    first = paging.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"])
    return refs.join_backref(table(spark, sf, "customer"), "c_custkey", first, "o_custkey", "o").select("c_custkey", F.col("`o.o_orderkey`").alias("o_orderkey"))


@query("SELECT c.c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def backref_array(spark, sf):
    """Rows that refer back, as a list; gathered before the join."""
    out = refs.join_backref_array(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"], "orders")
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders"))


@query("SELECT p.p_partkey, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey), '') AS suppliers FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_partkey")
def m2m_array(spark, sf):
    """Many to many through a link table; no links give an empty list."""
    out = refs.join_m2m_array(table(spark, sf, "part").select("p_partkey"), "p_partkey", table(spark, sf, "lineitem"), "l_partkey", ["l_suppkey"], "suppliers")
    return out.select("p_partkey", F.array_join(F.col("suppliers").cast("array<string>"), ",").alias("suppliers"))


@query("SELECT l_orderkey, string_agg(l_partkey || '-' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey) AS pairs FROM lineitem GROUP BY l_orderkey")
def group_array(spark, sf):
    """Several columns of a group as a list of lists."""
    out = refs.group_array(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey"], "pairs")
    return out.select("l_orderkey", F.array_join(F.transform("pairs", lambda p: F.array_join(p.cast("array<string>"), "-")), ",").alias("pairs"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_by_list(spark, sf):
    """Some list row matches."""
    return refs.semi_by_list(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_by_list(spark, sf):
    """No list row matches."""
    return refs.anti_by_list(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R").select("o_orderkey")


@query("""
WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'nowhere' ELSE n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT n_name, count(*) AS n, min('id' || n_nationkey) AS id FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey = 24) GROUP BY n_name)
SELECT c_custkey, CASE WHEN nation IS NULL THEN NULL WHEN k.n_name IS NOT NULL THEN 'key' || k.n_nationkey WHEN t.n = 1 THEN t.id END AS ref,
  CASE WHEN nation IS NOT NULL AND k.n_name IS NULL THEN CASE WHEN t.n IS NULL THEN 'not found' WHEN t.n > 1 THEN 'more than one' END END AS ref_error
FROM f LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) k ON f.nation = k.n_name LEFT JOIN t ON f.nation = t.n_name
""")
def resolve_ref_ids(spark, sf):
    """Natural keys to ids, by keymap, then by the target's rows."""
    nation = table(spark, sf, "nation")
    fk = F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).when(F.col("c_custkey") % 13 == 0, "nowhere").otherwise(F.col("n_name"))
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", fk.alias("nation"))
    keymap = nation.filter("n_nationkey < 10").select("n_name", F.concat(F.lit("key"), F.col("n_nationkey")).alias("_id"))
    target = nation.union(nation.filter("n_nationkey = 24")).select("n_name", F.concat(F.lit("id"), F.col("n_nationkey")).alias("_id"))
    return refs.resolve_ref_ids(rows, ["nation"], keymap, target, ["n_name"], "ref").select("c_custkey", "ref", "ref_error")


@query("""
WITH k AS (SELECT c_mktsegment AS seg, 's' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS made FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment <> 'MACHINERY'),
live AS (SELECT seg, arg_min(id, (CASE WHEN made IS NULL THEN 1 ELSE 0 END, -coalesce(made, 0), id)) AS id FROM k GROUP BY seg)
SELECT c_custkey, coalesce(live.id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'target' END) AS ref, NULL::VARCHAR AS ref_error FROM customer LEFT JOIN live ON c_mktsegment = seg
""")
def resolve_ref_live(spark, sf):
    """Of several ids of a key the newest one counts that isn't redirected, and no row doubles."""
    df = table(spark, sf, "customer")
    k = F.col("c_custkey")
    ids = df.filter("c_mktsegment <> 'MACHINERY'").select("c_mktsegment", F.concat(F.lit("s"), k).alias("_id"), F.when(k % 4 == 0, "elsewhere").alias("redirect"), F.when(k % 3 != 0, F.timestamp_seconds(k % 50)).alias("modified_at"))
    target = df.limit(1).select(F.lit("MACHINERY").alias("c_mktsegment"), F.lit("target").alias("_id"))
    return refs.resolve_ref_ids(df.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ids, target, ["c_mktsegment"], "ref").select("c_custkey", "ref", "ref_error")


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'left' WHEN a.c_custkey IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) b ON a.c_custkey = b.c_custkey")
def full_outer_sync(spark, sf):
    """What is on either side, and on both."""
    df = table(spark, sf, "customer")
    return refs.full_outer_sync(df.filter("c_custkey % 3 <> 0"), df.filter("c_custkey % 4 <> 0"), "c_custkey").select("c_custkey", "side")


SORTED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, (row_number() OVER (ORDER BY CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END {0}, o_orderkey))::INTEGER AS place FROM orders ORDER BY place LIMIT 500"


def _sorted(spark, sf, key):
    df = reports(spark, sf).drop("lines")
    top = paging.limit(paging.sort(df, key, "id"), 500)
    return top.select(F.col("id").alias("o_orderkey"), "status", F.row_number().over(Window.orderBy(*paging.order(df, key, "id"))).alias("place"))


@query(SORTED.format("ASC NULLS LAST"))
def sort_up(spark, sf):
    """up, nulls last."""
    return _sorted(spark, sf, "+status")


@query(SORTED.format("DESC NULLS FIRST"))
def sort_down(spark, sf):
    """down, nulls first."""
    return _sorted(spark, sf, "-status")


@query("SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey ORDER BY min(CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END) DESC NULLS FIRST, l_orderkey LIMIT 300")
def sort_by_list(spark, sf):
    """by the least item of a list."""
    df = reports(spark, sf).filter("lines is not null")
    return paging.top_k(df, 300, "-lines.flag", "id").select("id")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 25")
def limit_offset(spark, sf):
    """a limit behind an offset."""
    return paging.limit(paging.sort(table(spark, sf, "orders"), "-o_totalprice", "o_orderkey"), 40, 25).select("o_orderkey")


@query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio, o_totalprice FROM orders)
SELECT o_orderkey, prio FROM p WHERE (prio > '3-MEDIUM' OR prio IS NULL) OR (prio = '3-MEDIUM' AND o_totalprice < 100000)
ORDER BY prio ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 700
""")
def keyset_page_2keys(spark, sf):
    """the page behind a cursor of two keys, one going down."""
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("prio"), "o_totalprice")
    rows = df.filter(paging.after(df, ["prio", "-o_totalprice"], ["3-MEDIUM", 100000.0]))
    return paging.top_k(rows, 700, "prio", "-o_totalprice", "o_orderkey").select("o_orderkey", "prio")


@query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio FROM orders)
SELECT o_orderkey, prio FROM p WHERE (prio IS NOT NULL) OR (prio IS NULL AND (o_orderkey > 70 OR o_orderkey IS NULL)) ORDER BY prio DESC NULLS FIRST, o_orderkey LIMIT 400
""")
def keyset_page_null_cursor(spark, sf):
    """a cursor on a null, going down."""
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("prio"))
    return paging.page_after(df, ["-prio", "o_orderkey"], [None, 70], 400)


@query("SELECT o_orderkey, replace(replace(base64(encode('[' || o_orderkey || ',\"' || o_orderpriority || '\"]')), '+', '-'), '/', '_') AS _page, o_orderpriority AS back FROM orders")
def page_tokens(spark, sf):
    """a cursor as text, and back."""
    df = table(spark, sf, "orders").withColumn("_page", paging.page_token(table(spark, sf, "orders"), ["o_orderkey", "-o_orderpriority"]))
    return df.select("o_orderkey", "_page", F.element_at(paging.page_values(F.col("_page")), 2).alias("back"))


#: Where the keys of a page order begin, in SQL: groups of the keys with their first place and page.
PLACES = """
WITH k AS (SELECT {keys}, count(*) AS rows FROM {table} GROUP BY ALL),
g AS (SELECT *, (sum(rows) OVER (ORDER BY {order}) - rows + 1)::BIGINT AS first FROM k), p AS (SELECT *, (first - 1) // {size} + 1 AS page FROM g)
"""


@query(PLACES.format(keys="o_orderpriority, o_custkey", table="orders", order="o_orderpriority ASC NULLS LAST, o_custkey DESC NULLS FIRST", size=50) + "SELECT o_orderpriority, o_custkey, rows, page, page * 50 - first + 1 AS before FROM p WHERE first + rows - 1 > page * 50")
def page_key_guard(spark, sf):
    """keys that the edge of a page cuts."""
    return paging.check_page_keys(table(spark, sf, "orders"), ["o_orderpriority", "-o_custkey"], 50)


@query(PLACES.format(keys="o_orderpriority, o_orderstatus", table="orders", order="o_orderpriority ASC NULLS LAST, o_orderstatus DESC NULLS FIRST", size=80) + "SELECT o_orderpriority, o_orderstatus, rows, page, page * 80 - first + 1 AS before FROM p WHERE first + rows - 1 > page * 80")
def page_key_too_long(spark, sf):
    """keys whose rows don't fit a page are cut too."""
    return paging.check_page_keys(table(spark, sf, "orders"), ["o_orderpriority", "-o_orderstatus"], 80)


@query(PLACES.format(keys="o_orderdate::DATE AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust", table="orders", order="day DESC NULLS FIRST, cust ASC NULLS LAST", size=64) + "SELECT page, min(first) AS first, sum(rows)::BIGINT AS rows, arg_max(day, first) AS day, last(cust ORDER BY first) AS cust FROM p GROUP BY page")
def page_cuts(spark, sf):
    """the pages of an order and the cursors behind them, of whole keys only."""
    df = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("cust"))
    return paging.page_cuts(df, ["-day", "cust"], 64)


@query(PLACES.format(keys="l_suppkey, l_quantity", table="lineitem", order="l_suppkey ASC NULLS LAST, l_quantity DESC NULLS FIRST", size=100) + "SELECT l_orderkey, l_linenumber, page FROM lineitem JOIN p USING (l_suppkey, l_quantity)")
def page_all_rows(spark, sf):
    """all pages read at once hold every row once, though keys repeat."""
    return paging.all_pages(table(spark, sf, "lineitem"), ["l_suppkey", "-l_quantity"], 100).select("l_orderkey", "l_linenumber", "page")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def top_k(spark, sf):
    """the first k in an order."""
    return paging.top_k(table(spark, sf, "customer"), 15, "-c_acctbal", "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf):
    """G1: the last event of every user."""
    return paging.latest_per_key(table(spark, sf, "events"), ["user_id"], ["-ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id AS _id, (row_number() OVER w)::INTEGER AS rank, first(event_id) OVER w AS "primary" FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id)
""")
def rank_duplicates(spark, sf):
    """The newest of a key is primary, the others follow it."""
    df = table(spark, sf, "events").withColumnRenamed("event_id", "_id")
    return paging.rank_duplicates(df, ["user_id", "event_type"], ["-ts", "_id"]).select("_id", "rank", "primary")


@query("SELECT c_name AS name, c_nationkey::BIGINT AS nation, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_name, NULL, 'supplier' FROM supplier")
def union_by_name(spark, sf):
    """Columns matched by name, missing ones null."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return paging.union_by_name([c, s])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def distinct_pk(spark, sf):
    """One row per key, the least."""
    return paging.distinct(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"]).drop("l_suppkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def distinct_rows(spark, sf):
    """Whole rows once."""
    return paging.distinct(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax"))
