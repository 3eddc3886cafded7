"""Queries of sources, exports, writes, change history, ids and incremental push."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Table
from ..operators import history as H
from ..operators import keymap as K
from ..operators import summary as S
from ..operators import sync as Y
from ..operators.project import checksum
from ..runtime import scratch
from ..sources import readers as R
from ..sources import writers as W
from .base import catalog, query, table

NOW = "2025-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::VARCHAR AS missing FROM events")
def json_tree(spark, sf):
    """A2: rows from JSON text, a value from the parent, and one that is missing."""
    df = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return R.json_tree(df, "props", {"k": "k", "event_id": "..event_id", "missing": "x.y"})


@query("SELECT conv_id AS conv, turn, role FROM conversations")
def json_tree_list(spark, sf):
    """A2: rows from the objects of a nested list."""
    df = table(spark, sf, "conversations").groupBy("conv_id").agg(F.struct(F.collect_list(F.struct("turn", "role")).alias("turns")).alias("body"))
    return R.json_tree(df, "body.turns[]", {"turn": "turn", "role": "role", "conv": "...conv_id"})


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'k' || c_nationkey || ',' || c_mktsegment AS keys FROM customer")
def xml_rows(spark, sf):
    """A3: rows from XML: elements, attributes, lists of keys, missing ones null."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("<row id='"), k, F.lit("'><who><name>"), F.col("c_name"), F.lit("</name></who><segment>"), F.col("c_mktsegment"), F.lit("</segment><nation code='k"), F.col("c_nationkey").cast("string"), F.lit("'/></row>"))
    parsed = table(spark, sf, "customer").select(F.from_xml(text, F.lit("_id STRING, who STRUCT<name: STRING>, segment STRING, nation STRUCT<_code: STRING>")).alias("r")).select("r.*")
    out = R._xml_columns(parsed, {"id": "@id", "name": "who/name", "segment": "segment", "keys": ["nation/@code", "segment"]})
    return out.withColumns({"id": F.col("id").cast("long"), "keys": F.array_join("keys", ",")})


@query("SELECT c_custkey, c_name FROM customer")
def multi_model(spark, sf):
    """A5: one model of a mixed table, without the columns it doesn't have."""
    mixed = R.read_namespace({"customer": table(spark, sf, "customer").select("c_custkey", "c_name"), "supplier": table(spark, sf, "supplier").select("s_suppkey", "s_name")})
    return R.read_multi_model(mixed, "customer")


@query("SELECT r_name AS region, s AS status, n_name AS nation FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) JOIN nation ON n_regionkey = r_regionkey")
def parameter_combinations(spark, sf):
    """Every combination of parameters, and one that depends on another model's rows."""
    regions, status = table(spark, sf, "region").select("r_name"), table(spark, sf, "orders").select("o_orderstatus").distinct()
    params = R.combinations({"region": regions, "status": status})
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.dependent(params, rows, [("region", "r_name")], "n_name", "nation")


@query("SELECT 'customer' AS _type, c_name, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT 'supplier', NULL, s_name FROM supplier")
def namespace(spark, sf):
    """All rows of several models."""
    return R.read_namespace({"customer": table(spark, sf, "customer"), "supplier": table(spark, sf, "supplier")}).select("_type", "c_name", "s_name")


@query("SELECT c_custkey::INTEGER AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0")
def jdbc_table(spark, sf):
    """A4: a table of a database in four parts, each read by ranges of its key and filtered there, by any executor."""
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"))
    parts = [R.read_jdbc(spark, url, "customers", "ID", partitions=4, **options) for url in W.write_derby(rows, scratch(spark), "customers")]
    return reduce(DataFrame.unionByName, parts).filter("id % 2 = 0").toDF("id", "name")


@query("SELECT 'customer' AS model, 0::BIGINT AS count UNION ALL SELECT 'orders', count(*) FROM orders")
def wipe_tables(spark, sf):
    """A model without its rows, beside one that keeps them."""
    return S.count_tables({"customer": H.wipe(table(spark, sf, "customer")), "orders": table(spark, sf, "orders")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def get_one(spark, sf):
    """One property of one row."""
    return R.get_one(table(spark, sf, "customer"), 42, "c_custkey", "c_name")


@query("""
WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '<urn:n:' || c_custkey || '>' ELSE '<https://e.org/customer/' || c_custkey || '>' END AS s, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 3 = 2 THEN c_name || '\\r\\n\\t\\"' END AS name, c_nationkey FROM customer)
SELECT s AS subject, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS predicate, '<https://e.org/customer>' AS object FROM n
UNION ALL SELECT s, '<http://xmlns.com/foaf/0.1/name>', '"' || name || '"' FROM n WHERE name IS NOT NULL
UNION ALL SELECT s, '<https://e.org/in>', '<https://e.org/nation/' || c_nationkey || '>' FROM n
""")
def triples(spark, sf):
    """Rows as triples; line ends, tabs and quotes are escaped."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 1, F.col("c_name")).when(k % 3 == 2, F.concat("c_name", F.lit('\r\n\t"')))
    df = table(spark, sf, "customer").select(k.alias("_id"), name.alias("name"), F.col("c_nationkey").alias("nation"), F.when(k % 4 == 0, F.concat(F.lit("urn:n:"), k.cast("string"))).alias("uri"))
    return W.to_triples(df, "https://e.org/customer", {"name": "http://xmlns.com/foaf/0.1/name", "nation": "https://e.org/in"}, uri_column="uri", refs={"nation": "https://e.org/nation"})


def _exported(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    df = table(spark, sf, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("_id"), "c_name", "orders")
    return W.export_tables(df, "t1", _now())


@query("SELECT 't1' AS _txn, o_custkey AS _rid, o_orderkey AS item FROM orders")
def export_lists(spark, sf):
    """The table of list items."""
    return _exported(spark, sf)["/:list/orders"]


@query("SELECT 't1' AS _txn, c_custkey AS _rid, 'insert' AS action, '{\"c_name\":\"' || c_name || '\"' || coalesce(',\"orders\":[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']', '') || '}' AS data FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def export_log(spark, sf):
    """The first changelog."""
    return _exported(spark, sf)["/:changelog"].select("_txn", "_rid", "action", "data")


def _current(spark, sf):
    k = F.col("c_custkey")
    stamps = [F.lit("2024-01-01 00:00:00").cast("timestamp").alias("_created"), F.lit(None).cast("timestamp").alias("_updated")]
    return table(spark, sf, "customer").select(k.cast("string").alias("_id"), F.concat(F.lit("r"), k.cast("string")).alias("_revision"), *stamps, F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), k.alias("no"))


def _given(spark, sf):
    """Changes: every third customer, some values new, some absent, some null; a wrong revision and unknown rows."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.col("c_name"), F.lit("!"))).otherwise(F.col("c_name"))
    absent = F.when(k % 4 == 0, F.array(F.lit("balance"))).otherwise(F.array().cast("array<string>"))
    revision = F.when(k % 15 == 0, "other").when(k % 5 == 0, F.concat(F.lit("r"), k.cast("string")))
    return table(spark, sf, "customer").filter(k % 3 == 0).select(F.when(k % 21 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("_id"), revision.alias("_revision"), name.alias("name"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"), k.alias("no"), absent.alias("_absent"))


def _repeated(given):
    """The changes, every eleventh of them twice, with another name."""
    return given.union(given.filter("no % 33 = 0").withColumn("name", F.concat("name", F.lit("~"))))


@query("""
WITH g AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS n2, c_acctbal AS b, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b2 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 21 <> 0)
SELECT k::VARCHAR AS _id, concat_ws(',', CASE WHEN b IS DISTINCT FROM b2 THEN 'balance' END, CASE WHEN c_name <> n2 THEN 'name' END) AS changed, n2 AS name, b2 AS balance FROM g
""")
def patch_diff(spark, sf):
    """What a patch changes; absent is not null."""
    out = H.build_patch(_given(spark, sf), _current(spark, sf), "patch").filter("found")
    return out.select("_id", F.array_join(F.array_sort(F.map_keys("_patch")), ",").alias("changed"), "name", "balance")


@query("""
SELECT c_custkey::VARCHAR AS _id, concat_ws(',', CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN 'balance' END, CASE WHEN c_custkey % 2 = 0 THEN 'name' END) AS changed, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance
FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 21 <> 0
""")
def patch_update(spark, sf):
    """An update nulls what is absent."""
    out = H.build_patch(_given(spark, sf), _current(spark, sf), "update").filter("found")
    return out.select("_id", F.array_join(F.array_sort(F.map_keys("_patch")), ",").alias("changed"), "balance")


@query("SELECT k AS _id, name, CASE WHEN new THEN 'new' ELSE 'old' END AS kind FROM (SELECT c_custkey::VARCHAR AS k, c_name AS name, false AS new FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, true FROM supplier WHERE s_suppkey % 4 <> 0)")
def insert_rows(spark, sf):
    """New rows; ids that exist are refused."""
    given = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.lit("1")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("_id"), F.col("s_name").alias("name"))
    out = H.insert(_current(spark, sf), given, "customer", "t1", _now()).current
    return out.select("_id", "name", F.when(F.col("_created") == _now(), "new").otherwise("old").alias("kind"))


@query("""
SELECT c_custkey::VARCHAR AS _id, CASE WHEN g AND c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN g AND c_custkey % 4 <> 0 AND c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
  g AND (c_custkey % 2 = 0 OR (c_custkey % 7 = 0 AND c_custkey % 4 <> 0)) AS touched
FROM (SELECT *, c_custkey % 3 = 0 AND c_custkey % 21 <> 0 AND c_custkey % 15 <> 0 AND c_custkey % 33 <> 0 AS g FROM customer)
""")
def patch_rows(spark, sf):
    """Rows after patches; other revisions, unknown rows and repeated ids are refused."""
    out = H.update(_current(spark, sf), _repeated(_given(spark, sf)), "t1", _now()).current
    return out.select("_id", "name", "balance", F.col("_updated").isNotNull().alias("touched"))


@query("SELECT CASE WHEN c_custkey % 21 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS _id, CASE WHEN c_custkey % 33 = 0 THEN 'repeated' WHEN c_custkey % 21 = 0 THEN 'not-found' ELSE 'conflict' END AS code FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 21 = 0 OR c_custkey % 15 = 0 OR c_custkey % 33 = 0)")
def patch_errors(spark, sf):
    """What patches refuse."""
    return H.update(_current(spark, sf), _repeated(_given(spark, sf)), "t1", _now()).errors


@query("""
SELECT no, name, count(*) AS n FROM (SELECT c_custkey AS no, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN c_name || '?' ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name || '?' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 5 <> 0
UNION ALL SELECT -1, 'repeated ' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE 'new' END FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 5 = 0) GROUP BY ALL
""")
def upsert(spark, sf):
    """No match inserts, one patches; keys given twice are refused, which the rows of number -1 tell."""
    k = F.col("c_custkey")
    given = table(spark, sf, "customer").filter(k % 3 != 2).select(F.when(k % 3 == 0, k).otherwise(k + 1000000).alias("no"), F.concat("c_name", F.lit("?")).alias("name"))
    given = given.union(given.filter("(no - if(no >= 1000000, 1000000, 0)) % 5 = 0"))
    out = H.upsert(_current(spark, sf), given, ["no"], "customer", "t1", _now())
    refused = out.errors.select(F.lit(-1).alias("no"), F.concat_ws(" ", "code", F.coalesce("_id", F.lit("new"))).alias("name"))
    return out.current.select("no", "name").unionByName(refused).groupBy("no", "name").agg(F.count(F.lit(1)).alias("n"))


def _term(path, op, value):
    return F.struct(F.lit(path).alias("path"), F.lit(op).alias("op"), value.cast("string").alias("value"))


def _by_predicate(spark, sf):
    """Changes that say by a predicate of their own what they mean: a number, a nation and a lowest balance, a name's beginning and a range of numbers."""
    k = F.col("c_custkey")
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    one = customers.filter(k % 4 == 0).select(F.array(_term("no", "eq", k)).alias("_where"), F.concat("c_name", F.lit("!")).alias("name"))
    many = nations.select(F.array(_term("nation", "eq", F.col("n_nationkey")), _term("balance", "ge", F.lit(9000)), _term("no", "ne", F.lit(1))).alias("_where"), F.col("n_name").alias("name"))
    few = nations.filter("n_nationkey < 3").select(F.array(_term("name", "startswith", F.lit("Customer")), _term("no", "gt", F.col("n_nationkey") * 40), _term("no", "le", F.col("n_nationkey") * 40 + 5), _term("no", "lt", F.lit(100))).alias("_where"), F.lit("few").alias("name"))
    gone = nations.filter("n_nationkey between 1 and 3").select(F.array(_term("_id", "eq", -F.col("n_nationkey"))).alias("_where"), F.lit("unknown").alias("name"))
    bad = nations.filter("n_nationkey = 5").select(F.array(_term("no", "eq", F.lit("five"))).alias("_where"), F.lit("bad").alias("name"))
    return one, many, few, gone, bad


#: The same hits in SQL: each given row with each customer that it means.
HITS = """
WITH hit AS (
  SELECT c_custkey AS k, c_name || '!' AS name FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 9000 AND c_custkey <> 1
  UNION ALL SELECT c_custkey, 'few' FROM customer, range(3) t(n) WHERE c_name LIKE 'Customer%' AND c_custkey > n * 40 AND c_custkey <= n * 40 + 5 AND c_custkey < 100
), per AS (SELECT k, count(*) AS n, min(name) AS name FROM hit GROUP BY k)
"""


@query(HITS + """
SELECT c_custkey::VARCHAR AS _id, CASE WHEN n = 1 THEN per.name ELSE c_name END AS name, CASE WHEN n > 1 THEN 'repeated' END AS code FROM customer LEFT JOIN per ON c_custkey = k
UNION ALL SELECT '-' || n, NULL, 'not-found' FROM range(1, 4) t(n) UNION ALL SELECT NULL, NULL, 'invalid'
""")
def update_where(spark, sf):
    """Rows that change by predicates of three shapes and more, many hits each; what none or several mean is refused."""
    given = None
    for part in _by_predicate(spark, sf):
        given = part if given is None else given.unionByName(part)
    out = H.update_where(_current(spark, sf), given, "t1", _now())
    found = out.current.select("_id", "name").join(out.errors, "_id", "left").select("_id", "name", "code")
    return found.unionByName(out.errors.filter("code <> 'repeated'").select("_id", F.lit(None).cast("string").alias("name"), "code"))


@query("""
WITH g AS (SELECT c_custkey AS k, c_name, c_nationkey, c_acctbal, c_custkey % 4 AS r FROM customer WHERE c_custkey % 4 < 3),
hit AS (
  SELECT g.k AS given, c.c_custkey AS k FROM g JOIN customer c ON r = 0 AND c.c_custkey = g.k
  UNION ALL SELECT g.k, c.c_custkey FROM g JOIN customer c ON r = 1 AND c.c_nationkey = g.c_nationkey AND c.c_acctbal >= g.c_acctbal AND c.c_acctbal < g.c_acctbal + 200
  UNION ALL SELECT g.k, c.c_custkey FROM g JOIN customer c ON r = 2 AND c.c_custkey = g.k + 10000000
), n AS (SELECT given, count(*) AS n, min(k) AS k FROM hit GROUP BY given), m AS (SELECT k, count(DISTINCT given) AS n FROM hit GROUP BY k),
judged AS (SELECT g.k, r, coalesce(n.n, 0) AS n, n.k AS hit, m.n AS given FROM g LEFT JOIN n ON g.k = n.given LEFT JOIN m ON n.k = m.k)
SELECT c_custkey AS no, CASE WHEN EXISTS (SELECT 1 FROM judged j WHERE j.n = 1 AND j.given = 1 AND j.hit = c_custkey) THEN 'changed' ELSE c_name END AS name, 1::BIGINT AS n FROM customer
UNION ALL SELECT k + 10000000, 'changed', 1 FROM judged WHERE n = 0
UNION ALL SELECT -1, code, count(*) FROM (SELECT CASE WHEN n > 1 THEN 'multiple' END AS code FROM judged UNION ALL SELECT DISTINCT CASE WHEN n = 1 AND given > 1 THEN 'repeated ' || hit END FROM judged) WHERE code IS NOT NULL GROUP BY code
""")
def upsert_where(spark, sf):
    """By predicates of three shapes: none found inserts, one patches, several are refused, and so is a row that several mean."""
    k, rest = F.col("c_custkey"), F.col("c_custkey") % 4
    balance = F.col("c_acctbal").cast("decimal(20,2)")
    shapes = F.when(rest == 0, F.array(_term("no", "eq", k))).when(rest == 1, F.array(_term("nation", "eq", F.col("c_nationkey")), _term("balance", "ge", balance), _term("balance", "lt", balance + 200))).when(rest == 2, F.array(_term("_id", "eq", k + 10_000_000)))
    given = table(spark, sf, "customer").filter(rest < 3).select(shapes.alias("_where"), F.lit("changed").alias("name"), F.when(rest == 2, k + 10_000_000).alias("no"), F.when(rest != 2, F.array(F.lit("no"))).otherwise(F.array().cast("array<string>")).alias("_absent"))
    out = H.upsert_where(_current(spark, sf), given, "customer", "t1", _now())
    refused = out.errors.select(F.lit(-1).alias("no"), F.when(F.col("code") == "multiple", F.col("code")).otherwise(F.concat_ws(" ", "code", "_id")).alias("name"))
    return out.current.select("no", "name").unionByName(refused).groupBy("no", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey::VARCHAR AS _id FROM customer WHERE c_custkey % 3 <> 0")
def delete_rows(spark, sf):
    """Without the deleted rows."""
    ids = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("_id"))
    return H.delete(_current(spark, sf), ids.union(ids), "t1", _now()).current.select("_id")


MOVES = """
WITH m AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 1 THEN c_custkey + 1 WHEN 2 THEN c_custkey + 2 WHEN 3 THEN -c_custkey END AS t FROM customer),
good AS (SELECT k, t FROM m WHERE t IN (SELECT c_custkey FROM customer)),
ends AS (SELECT a.k AS _id, coalesce(b.t, a.t) AS redirect FROM good a LEFT JOIN good b ON a.t = b.k)
"""


def _moved(spark, sf):
    """Customers merged in chains of two steps, and into unknown ones."""
    k = F.col("c_custkey")
    target = F.when(k % 5 == 1, k + 1).when(k % 5 == 2, k + 2).when(k % 5 == 3, -k)
    moves = table(spark, sf, "customer").select(k.alias("_id"), target.alias("redirect")).filter("redirect is not null")
    c = {k: v for k, v in catalog(spark, sf).items() if k in ("customer", "orders")}
    return H.move(c, "customer", moves)


@query(MOVES + "SELECT o_orderkey, coalesce(redirect, o_custkey) AS o_custkey FROM orders LEFT JOIN ends ON o_custkey = _id")
def move_repoint(spark, sf):
    """References follow merged rows to the end of the chain."""
    return _moved(spark, sf)[0]["orders"].df.select("o_orderkey", "o_custkey")


@query(MOVES + "SELECT _id, redirect FROM ends")
def move_redirects(spark, sf):
    """Redirects led to their ends."""
    return _moved(spark, sf)[1].select("_id", "redirect")


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer), m AS (
  SELECT k AS _id, k + 1 AS t FROM c WHERE k % 10 IN (0, 4, 7) UNION ALL SELECT k, k + 2 FROM c WHERE k % 10 = 0 UNION ALL SELECT k, k FROM c WHERE k % 10 = 1 UNION ALL SELECT -k, k FROM c WHERE k % 10 = 2
  UNION ALL SELECT k, -k FROM c WHERE k % 10 = 3 UNION ALL SELECT k, k - 1 FROM c WHERE k % 10 IN (5, 6)
)
SELECT DISTINCT _id, CASE abs(_id) % 10 WHEN 0 THEN 'repeated' WHEN 1 THEN 'self' WHEN 2 THEN 'unknown' WHEN 3 THEN 'not-found' ELSE CASE WHEN t IN (SELECT k FROM c) THEN 'cycle' ELSE 'not-found' END END AS code
FROM m WHERE abs(_id) % 10 <= 3 OR abs(_id) % 10 IN (4, 5) OR t NOT IN (SELECT k FROM c)
""")
def move_errors(spark, sf):
    """Moves named twice, to themselves, of and to unknown rows, and in cycles are refused; one into a cycle is not."""
    k = F.col("c_custkey")
    rest, one = k % 10, lambda t: F.array(t.cast("long"))
    targets = F.when(rest == 0, F.array((k + 1).cast("long"), (k + 2).cast("long"))).when(rest.isin(4, 7), one(k + 1)).when(rest.isin(1, 2), one(k)).when(rest == 3, one(-k)).when(rest.isin(5, 6), one(k - 1))
    moves = table(spark, sf, "customer").select(F.when(rest == 2, -k).otherwise(k).cast("long").alias("_id"), F.explode(targets).alias("redirect"))
    c = {k: v for k, v in catalog(spark, sf).items() if k in ("customer", "orders")}
    return H.move(c, "customer", moves)[2]


@query("""
WITH RECURSIVE m AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 50 = 49 THEN c_custkey - c_custkey % 7 ELSE c_custkey + 1 END AS b FROM customer WHERE c_custkey % 50 > 5),
walk AS (SELECT a AS start, b AS here, least(a, b) AS low, 1 AS steps FROM m UNION ALL SELECT start, b, least(low, b), steps + 1 FROM walk JOIN m ON here = a WHERE here <> start AND steps < 60)
SELECT start AS _id, min(low) AS cycle FROM walk WHERE here = start GROUP BY start
""")
def redirect_cycles(spark, sf):
    """Ids that come back to themselves in redirects, and the least of their round."""
    k = F.col("c_custkey")
    moves = table(spark, sf, "customer").filter(k % 50 > 5).select(k.alias("_id"), F.when(k % 50 == 49, k - k % 7).otherwise(k + 1).alias("redirect"))
    return H.find_cycles(moves)


def _log(spark, sf):
    """Events as a changelog: a row per user, a key per event type, some deletes."""
    e = table(spark, sf, "events")
    action = F.when(F.col("event_id") % 17 == 0, "delete").when(F.col("event_id") % 5 == 0, "insert").otherwise("patch")
    data = F.to_json(F.create_map(F.col("event_type"), F.round("value", 2).cast("string")))
    return e.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("_revision"), F.lit("t").alias("_txn"), F.col("user_id").cast("string").alias("_rid"), F.col("ts").cast("timestamp").alias("datetime"), action.alias("action"), data.alias("data"))


LOG = """
WITH log AS (SELECT row_number() OVER (ORDER BY ts, user_id::VARCHAR, 'r' || event_id) AS _id, 'r' || event_id AS _revision, user_id::VARCHAR AS _rid, ts, event_type, round(value, 2) AS value,
  CASE WHEN event_id % 17 = 0 THEN 'delete' WHEN event_id % 5 = 0 THEN 'insert' ELSE 'patch' END AS action FROM events)
"""


def _numbered(spark, sf):
    return H.changelog_append(spark.createDataFrame([], H.LOG_SCHEMA), _log(spark, sf))


@query(LOG + "SELECT _id, _revision, _rid, action FROM log")
def changelog_append(spark, sf):
    """Numbers without gaps in the order of time."""
    return _numbered(spark, sf).select("_id", "_revision", "_rid", "action")


@query(LOG + "SELECT _id, _rid, action, NULL::VARCHAR AS _same_as FROM log WHERE _id > (SELECT max(_id) FROM log) - 50 ORDER BY _id LIMIT 20")
def changes_neg_offset(spark, sf):
    """The last changes."""
    return H.changes(_numbered(spark, sf), offset=-50, limit=20).select("_id", "_rid", "action", "_same_as")


@query(LOG + "SELECT _id, _rid, action FROM log WHERE _id >= 100 AND _rid = (SELECT min(_rid) FROM log) ORDER BY _id LIMIT 100")
def changes_of_row(spark, sf):
    """The changes of one row from an offset on."""
    log = _numbered(spark, sf)
    first = log.agg(F.min("_rid").alias("x"))
    return H.changes(log.join(F.broadcast(first), F.col("_rid") == F.col("x")), offset=100).select("_id", "_rid", "action")


@query(LOG + """, l AS (SELECT *, max(_id) OVER (PARTITION BY _rid, event_type) AS m, max(_id) OVER (PARTITION BY _rid) AS r FROM log)
SELECT _rid, max(CASE WHEN _id = r THEN action END) AS action, string_agg(event_type, ',' ORDER BY event_type) AS keys, round(sum(value), 6) AS total FROM l WHERE _id = m GROUP BY _rid""")
def state_from_log(spark, sf):
    """The latest value of every key."""
    out = H.state_from_changelog(_numbered(spark, sf))
    total = F.aggregate(F.map_values("data"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("_rid", "action", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("keys"), F.round(total, 6).alias("total"))


CORRUPT = """
WITH w AS (SELECT o_orderkey::VARCHAR AS _id, first(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS redirect FROM orders WHERE o_orderkey % 7 <> 0),
bad AS (SELECT _id, redirect FROM w WHERE _id <> redirect AND EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F'))
"""


def _orders_log(spark, sf):
    """Orders as rows with their customer as natural key: all inserted, some deleted later, some moved away."""
    o = table(spark, sf, "orders")
    rid = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    entry = lambda df, action, days, data: df.select(F.lit(action[0]).alias("_revision"), F.lit("t").alias("_txn"), rid.alias("_rid"), (F.to_timestamp("o_orderdate") + F.expr(f"interval {days} days")).alias("datetime"), F.lit(action).alias("action"), data.alias("data"))
    rows = entry(o, "insert", 0, F.to_json(F.struct("o_custkey"))).union(entry(o.filter("o_orderstatus = 'F'"), "delete", 4000, F.lit("{}")))
    rows = rows.union(entry(o.filter("o_orderkey % 7 = 0"), "move", 8000, F.lit('{"_id":"0"}')))
    return H.changelog_append(spark.createDataFrame([], H.LOG_SCHEMA), rows)


def _short(*names):
    return [F.col(n).cast("long").cast("string").alias(n) for n in names]


@query(CORRUPT + "SELECT _id, redirect FROM bad")
def corrupt_changelog(spark, sf):
    """Rows whose keys a newer row took over without a move."""
    return H.find_corrupt_changelog(_orders_log(spark, sf), ["o_custkey"]).select(_short("_id", "redirect"))


@query(CORRUPT + """, n AS (SELECT count(*) + count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n FROM orders)
SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE redirect END AS redirect, n + row_number() OVER (PARTITION BY redirect IS NULL ORDER BY o_orderkey) * (redirect IS NOT NULL)::INTEGER AS entry
FROM orders LEFT JOIN bad ON o_orderkey::VARCHAR = _id CROSS JOIN n""")
def repaired_changelog(spark, sf):
    """The repair moves each such row to the newest, in the changelog and from there in the keymap; ``entry`` is its number in the log, or the last one before."""
    log = _orders_log(spark, sf)
    last = log.agg(F.max("_id").alias("last"))
    repaired = H.repair_changelog(log, ["o_custkey"], "fix", F.lit("2040-01-01 00:00:00").cast("timestamp"))
    keymap, _ = K.sync(spark.createDataFrame([], K.SCHEMA), repaired, ["o_custkey"])
    moves = repaired.filter("_txn = 'fix'").select(F.col("_rid").alias("key"), F.col("_id").alias("entry"))
    rows = keymap.join(moves, "key", "left").join(F.broadcast(last)).withColumn("entry", F.coalesce("entry", "last"))
    return rows.select(*_short("key", "redirect"), "entry")


@query("""
WITH d AS (SELECT *, first(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS p FROM orders)
SELECT 'line' AS kind, l_orderkey AS old, p AS new FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN d ON l_orderkey = o_orderkey
UNION ALL SELECT 'order', o_orderkey, NULL FROM d WHERE o_orderkey = p UNION ALL SELECT 'redirect', o_orderkey, p FROM d WHERE o_orderkey <> p
""")
def dedup_primary(spark, sf):
    """Duplicates merged into the newest: the table itself, the references that follow, and the redirects."""
    o = Table(table(spark, sf, "orders"), "o_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey").distinct().select(F.col("l_orderkey").alias("old"), F.col("l_orderkey").alias("new"))
    out, ends, _ = H.deduplicate({"orders": o, "lines": Table(lines, "old", {"new": "orders"})}, "orders", ["o_custkey", "o_orderstatus"], ["-o_orderdate", "o_orderkey"])
    rows = [("line", out["lines"].df), ("order", out["orders"].df.select(F.col("o_orderkey").alias("old"), F.lit(None).cast("long").alias("new"))), ("redirect", ends.toDF("old", "new"))]
    frames = [df.select(F.lit(kind).alias("kind"), F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new")) for kind, df in rows]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(LOG + "SELECT _revision, ts AS datetime FROM log ORDER BY _id DESC LIMIT 1")
def latest_change(spark, sf):
    """The last change."""
    return H.latest_change(_numbered(spark, sf)).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query("SELECT CASE WHEN o_custkey % 2 = 0 THEN 't2' ELSE 't1' END AS _txn, o_custkey AS _rid, CASE WHEN o_custkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END AS item FROM orders")
def array_rewrite(spark, sf):
    """The lists of changed rows written anew."""
    o = table(spark, sf, "orders")
    items = o.select(F.lit("t1").alias("_txn"), F.col("o_custkey").alias("_rid"), F.col("o_orderkey").alias("item"))
    changed = o.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("_id")).agg(F.collect_list(-F.col("o_orderkey")).alias("orders"))
    return H.array_rewrite(items, changed, "orders", "t2")


def _keymap(spark, sf):
    k = F.col("c_custkey")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k)
    base = table(spark, sf, "customer").filter(k % 3 == 0)
    one = base.select(F.concat(F.lit("id"), k.cast("string")).alias("key"), K.key_value(F.col("c_name"), F.col("c_nationkey")).alias("value"), F.when(k % 9 == 0, "gone").alias("redirect"), at.alias("modified_at"))
    two = base.filter(k % 2 == 0).select(F.concat(F.lit("new"), k.cast("string")).alias("key"), K.key_value(F.col("c_name"), F.col("c_nationkey")).alias("value"), F.lit(None).cast("string").alias("redirect"), F.timestamp_seconds(F.lit(1_800_000_000) + k).alias("modified_at"))
    return one.union(two)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' || c_custkey WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 THEN 'id' || c_custkey END AS known, c_custkey % 5 <> 0 AS has_id
FROM customer
""")
def keymap_encode(spark, sf):
    """Ids of natural keys: the newest that isn't redirected, a hashed one for new values, none for nulls."""
    k = F.col("c_custkey")
    # Nulls in every fifth row's copy show that they get no id.
    named = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    out, _ = K.encode(named, ["c_name", "c_nationkey"], _keymap(spark, sf), "customer", _now())
    none, _ = K.encode(named.withColumns({c: F.when(k % 5 != 0, F.col(c)) for c in ("c_name", "c_nationkey")}), ["c_name", "c_nationkey"], _keymap(spark, sf), "customer", _now())
    known = F.when(F.col("_id").rlike("^(new|id)[0-9]+$"), F.col("_id"))
    return out.select("c_custkey", known.alias("known")).join(none.select("c_custkey", F.col("_id").isNotNull().alias("has_id")), "c_custkey")


@query("SELECT 'id' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '[\"' || c_name || '\",\"' || c_nationkey || '\"]' END AS value FROM customer")
def keymap_decode(spark, sf):
    """Key values behind ids."""
    return K.decode(table(spark, sf, "customer").select(F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("id")), "id", _keymap(spark, sf))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def keymap_contains(spark, sf):
    """Ids that exist."""
    df = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("id"))
    return K.contains(df, "id", _keymap(spark, sf)).select("c_custkey")


@query("""
WITH base AS (SELECT 'id' || c_custkey AS key, c_custkey AS k, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'new' || c_custkey, NULL, c_name, c_nationkey FROM customer WHERE c_custkey % 6 = 0),
fresh AS (SELECT 'id' || c_custkey AS key, c_custkey AS k, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 1)
SELECT key, '["' || CASE WHEN k % 4 = 0 THEN c_name || '+' ELSE c_name END || '","' || c_nationkey || '"]' AS value, CASE WHEN k % 15 = 0 THEN 'to' || k WHEN k % 9 = 0 THEN 'gone' END AS redirect FROM base
UNION ALL SELECT key, '["' || c_name || '","' || c_nationkey || '"]', NULL FROM fresh
""")
def keymap_sync(spark, sf):
    """The keymap after a log of inserts, patches and moves."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    rid = F.concat(F.lit("id"), k.cast("string")).alias("_rid")
    at = _now().alias("datetime")
    kinds = [
        c.filter(k % 3 == 1).select((k * 10).alias("_id"), rid, at, F.lit("insert").alias("action"), F.to_json(F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_nationkey"), F.col("c_nationkey").cast("string"))).alias("data")),
        c.filter((k % 3 == 0) & (k % 4 == 0)).select((k * 10 + 1).alias("_id"), rid, at, F.lit("patch").alias("action"), F.to_json(F.create_map(F.lit("c_name"), F.concat("c_name", F.lit("+")))).alias("data")),
        c.filter(k % 15 == 0).select((k * 10 + 2).alias("_id"), rid, at, F.lit("move").alias("action"), F.to_json(F.create_map(F.lit("_id"), F.concat(F.lit("to"), k.cast("string")))).alias("data")),
    ]
    log = kinds[0].union(kinds[1]).union(kinds[2])
    return K.sync(_keymap(spark, sf), log, ["c_name", "c_nationkey"])[0].select("key", "value", "redirect")


@query("SELECT count(*) AS \"values\", (count(*) * 2)::BIGINT AS rows FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 9 <> 0")
def keymap_duplicates(spark, sf):
    """Values with several live ids."""
    return K.validate(_keymap(spark, sf))


def _state(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    known = o.select(F.col("_id").cast("string").alias("id"), F.concat(F.lit("r"), F.col("_id").cast("string")).alias("revision"), checksum(o, ["o_custkey", "o_orderstatus"]).alias("checksum"), F.lit("2025-01-01").cast("timestamp").alias("pushed"), (F.col("_id") % 13 == 0).alias("error"), F.lit(None).cast("string").alias("data"))
    gone = known.withColumns({"id": F.concat(F.lit("x"), "id")})
    return known.union(gone)


DELTA = """
WITH o AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS c, CASE WHEN o_orderkey % 5 = 0 THEN '-1' ELSE o_custkey::VARCHAR END AS was, o_orderstatus AS s FROM orders),
sums AS (SELECT *, sha1('o_custkey=' || length(c) || ':' || c || chr(10) || 'o_orderstatus=' || length(s) || ':' || s) AS fresh, sha1('o_custkey=' || length(was) || ':' || was || chr(10) || 'o_orderstatus=' || length(s) || ':' || s) AS known,
  '{"o_custkey":' || c || ',"o_orderstatus":"' || s || '"}' AS json FROM o),
d AS (
  SELECT *, k::VARCHAR AS id, CASE WHEN k % 3 = 0 THEN 'insert' WHEN k % 5 = 0 THEN 'patch' ELSE 'same' END AS op FROM sums
  UNION ALL SELECT * REPLACE (NULL AS json), 'x' || k, CASE WHEN k % 13 = 0 THEN 'same' ELSE 'delete' END FROM sums WHERE k % 3 <> 0)
"""


def _delta(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus")
    again = rows.filter("_id % 11 = 0")
    return Y.push_delta(rows.union(again).union(again.withColumn("o_custkey", F.lit(-5))), _state(spark, sf))


@query(DELTA + "SELECT id, op, CASE WHEN op <> 'insert' THEN 'r' || k END AS revision, CASE WHEN op IN ('insert', 'patch') THEN fresh WHEN op = 'same' AND id = k::VARCHAR THEN fresh ELSE known END AS checksum, json AS data FROM d")
def push_delta(spark, sf):
    """What is new, changed, the same, and gone; one row of an id that is given several times."""
    return _delta(spark, sf).select("id", "op", "revision", "checksum", "data")


@query(DELTA + """
SELECT id, CASE WHEN op = 'same' THEN 'r' || k WHEN k % 7 = 0 THEN CASE WHEN op <> 'insert' THEN 'r' || k END ELSE 'new' END AS revision, CASE WHEN op = 'same' THEN k % 13 = 0 ELSE k % 7 = 0 END AS error,
  CASE WHEN op = 'same' THEN known WHEN k % 7 = 0 THEN CASE WHEN op <> 'insert' THEN known END ELSE fresh END AS checksum, op <> 'same' AS touched, CASE WHEN op <> 'same' AND k % 7 = 0 THEN json END AS data
FROM d WHERE NOT (op = 'delete' AND k % 7 <> 0)
""")
def push_state(spark, sf):
    """The state after the push; failures stay, what was deleted goes; of several results of an id the last counts."""
    number = F.regexp_replace("id", "^x", "").cast("long")
    results = _delta(spark, sf).withColumns({"revision": F.lit("new"), "error": number % 7 == 0, "seq": F.lit(2)})
    former = results.filter(number % 4 == 0).withColumns({"revision": F.lit("old"), "error": ~F.col("error"), "seq": F.lit(1)})
    out = Y.save_push_state(_state(spark, sf), results.union(former), _now(), by=["seq"])
    return out.select("id", "revision", "error", "checksum", (F.col("pushed") == _now()).alias("touched"), "data")


@query("SELECT p || o_orderkey AS id FROM orders, (VALUES (''), ('x')) t(p) WHERE o_orderkey % 3 <> 0 AND o_orderkey % 13 = 0")
def retry_set(spark, sf):
    """What is to be pushed again."""
    return Y.retry_set(_state(spark, sf)).select("id")


@query("SELECT o_orderkey::VARCHAR AS id, 't' || o_orderkey AS revision, false AS error, o_orderkey % 3 <> 0 AS known FROM orders WHERE o_orderkey % 2 = 0")
def rebuilt_state(spark, sf):
    """The state aligned with what the target holds."""
    target = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("revision"), F.lit("c").alias("checksum"))
    return Y.rebuild_push_state(target, _state(spark, sf)).select("id", "revision", "error", F.col("pushed").isNotNull().alias("known"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey > 10)")
def incremental_cursor(spark, sf):
    """Rows behind the saved cursor."""
    df = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return Y.incremental_cursor(df, ["o_orderdate", "o_orderkey"], [datetime.datetime(1996, 1, 1, tzinfo=datetime.UTC), 10]).select("o_orderkey")
