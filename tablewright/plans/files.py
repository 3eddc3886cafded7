"""Queries that write tables derived from the given ones to files, or stream them, and read the result."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..model import TableError
from ..operators import history as H
from ..operators import keymap as K
from ..operators import project
from ..operators import quality as Q
from ..operators import sync as Y
from ..runtime import scratch
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import changes as S
from ..streaming import keyed as KS
from .base import query, reports, table


@query("SELECT c_custkey, c_name AS \"who.name\", c_mktsegment AS \"who.segment\", o_orderkey AS \"orders[].key\" FROM customer JOIN orders ON o_custkey = c_custkey")
def csv_files(spark, sf):
    """Nested rows as flat CSV, and read again."""
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"))).alias("orders"))
    nested = table(spark, sf, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"), "orders")
    W.write_csv_flat(nested, path := scratch(spark))
    return R.read_csv(spark, path, schema="c_custkey long, `who.name` string, `who.segment` string, `orders[].key` long")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def json_files(spark, sf):
    """A2 A10: rows as JSON lines, and rows of a list inside them."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("qty"))).alias("lines"))
    nested = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"), "lines")
    W.write_json_lines(nested, path := scratch(spark))
    df = spark.read.schema("id long, day string, lines array<struct<qty: double>>").json(path)
    return R.json_tree(df, "lines[]", {"qty": "qty", "id": "..id", "day": "..day"})


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def xml_files(spark, sf):
    """A3: rows from XML files, by elements and attributes."""
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.struct(F.col("c_name").alias("name")).alias("who"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    df.write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path := scratch(spark))
    return R.read_xml_rows(spark, path, "customer", {"id": "@id", "name": "who/name", "segment": "segment"})


@query("SELECT o_orderstatus AS status, (o_orderkey % 2)::INTEGER AS half, o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def parametrized_files(spark, sf):
    """The files that a template names for every combination of parameters, read by one plan."""
    path = scratch(spark)
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 2).alias("h"))
    df.write.partitionBy("s", "h").parquet(path)
    params = R.combinations({"status": df.filter("s in ('F', 'O')").select("s").distinct(), "half": df.select(F.col("h").cast("int")).distinct()})
    return R.read_parametrized(spark, path + "/s={status}/h={half}", params, schema="id long").select("status", "half", "id")


@query("SELECT '<https://e.org/p/' || p_partkey || '> <urn:name> \"' || p_name || '\\r\" .' AS line FROM part UNION ALL SELECT '<https://e.org/p/' || p_partkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://e.org/p> .' FROM part")
def triple_files(spark, sf):
    """Triples as lines of text, a carriage return among them."""
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("_id"), F.concat("p_name", F.lit("\r")).alias("name"))
    W.write_triples(W.to_triples(df, "https://e.org/p", {"name": "urn:name"}), path := scratch(spark))
    return spark.read.text(path).toDF("line")


CURRENT = "_id string, _revision string, _created timestamp, _updated timestamp, name string, value double"


def _events(spark, sf):
    """The events as a stream of files; the pattern lets the source be one file or a folder."""
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def _by_batches(rows, part, batches, folder, run):
    """The rows of each part arrive as files, as many as there are tasks, and a run of the stream takes them as one batch."""
    for k in range(batches):
        rows.filter(part == k).write.parquet(f"{folder}/in/b={k}")
        run().awaitTermination()


@query("SELECT user_id::VARCHAR AS _id, event_type AS name, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'upsert' END) = 1) WHERE event_id % 17 <> 0")
def stream_apply(spark, sf):
    """K1: a stream of changes into a current table."""
    op = F.when(F.col("event_id") % 17 == 0, "delete").otherwise("upsert")
    source = _events(spark, sf).select(F.col("user_id").cast("string").alias("_id"), op.alias("_op"), F.col("ts").cast("timestamp").alias("_at"), F.col("event_type").alias("name"), "value")
    folder = scratch(spark)
    state = S.State(spark, folder, {"current": CURRENT, "log": H.LOG_SCHEMA})
    S.stream_apply_changes(source, state, "event", f"{folder}/checkpoint").awaitTermination()
    return state.read("current").select("_id", "name", "value")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS rid, ts, event_id, event_id % 17 = 0 AS del, event_type AS name, event_id % 3 AS seen FROM events),
p AS (SELECT *, lag(del) OVER w AS pdel, lag(name) OVER w AS pname, lag(seen) OVER w AS pseen FROM e WINDOW w AS (PARTITION BY rid ORDER BY ts, event_id)),
a AS (SELECT *, pdel IS NOT NULL AND NOT pdel AS there FROM p),
l AS (
  SELECT rid, ts, event_id, CASE WHEN del THEN CASE WHEN there THEN 'delete' END WHEN NOT there THEN 'insert' WHEN name <> pname OR seen <> pseen THEN 'update' END AS action,
    CASE WHEN del THEN '{}' ELSE '{' || concat_ws(',', CASE WHEN NOT there OR name <> pname THEN '"name":"' || name || '"' END, CASE WHEN NOT there OR seen <> pseen THEN '"seen":"' || seen || '"' END) || '}' END AS data
  FROM a
)
SELECT batches, rid AS _rid, action, data, ts::TIMESTAMP AS datetime, count(*) OVER (PARTITION BY batches) AS entries FROM l, (VALUES (1), (3), (7)) b(batches) WHERE action IS NOT NULL
""")
def stream_log(spark, sf):
    """K1: every change is in the changelog, at its own time, however the stream is cut into batches."""
    events = table(spark, sf, "events")
    low, high = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp"))) + 1).first()
    op = F.when(F.col("event_id") % 17 == 0, "delete").otherwise("upsert")
    changes = events.select(F.col("user_id").cast("string").alias("_id"), op.alias("_op"), F.col("ts").cast("timestamp").alias("_at"), "event_id", F.col("event_type").alias("name"), (F.col("event_id") % 3).cast("int").alias("seen"))
    out = None
    for batches in (1, 3, 7):
        folder = scratch(spark)
        part = F.floor((F.unix_micros("_at") - low) * batches / (high - low))
        source = spark.readStream.schema(changes.schema).parquet(f"{folder}/in/*")
        state = S.State(spark, folder, {"current": "_id string, _revision string, _created timestamp, _updated timestamp, name string, seen int", "log": H.LOG_SCHEMA}, small_rows=100, fanout=3)
        _by_batches(changes, part, batches, folder, functools.partial(S.stream_apply_changes, source, state, "event", f"{folder}/checkpoint", by=["event_id"]))
        log = state.read("log")
        ends = log.agg(F.max("_id").alias("entries"))  # numbered without gaps, so the last number is their count
        log = log.join(F.broadcast(ends)).select(F.lit(batches).alias("batches"), "_rid", "action", "data", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "entries")
        out = log if out is None else out.unionByName(log)
    return out


@query("SELECT 'u' || user_id AS key, '[\"' || max_by(event_type, event_id) || '\"]' AS value FROM events GROUP BY user_id")
def stream_keys(spark, sf):
    """K2: a stream of a changelog into the keymap."""
    data = F.to_json(F.create_map(F.lit("code"), F.col("event_type")))
    source = _events(spark, sf).select(F.col("event_id").alias("_id"), F.lit("r").alias("_revision"), F.lit("t").alias("_txn"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("_rid"), F.col("ts").cast("timestamp").alias("datetime"), F.lit("insert").alias("action"), data.alias("data"))
    folder = scratch(spark)
    state = S.State(spark, folder, {"keymap": K.SCHEMA})
    S.stream_keymap_sync(source, state, ["code"], f"{folder}/checkpoint").awaitTermination()
    return state.read("keymap").select("key", "value")


@query("SELECT user_id::VARCHAR AS id, 'insert' AS op, sha1('event_type=' || length(event_type) || ':' || event_type) AS checksum, user_id % 10 = 0 AS error FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1")
def stream_push(spark, sf):
    """K3: a stream of rows, pushed where their checksum is new: what was sent, and what the state says came of it."""
    source = _events(spark, sf).select(F.col("user_id").cast("string").alias("_id"), F.col("ts").cast("timestamp").alias("_at"), "event_type")
    folder = scratch(spark)
    state = S.State(spark, folder, {"state": Y.STATE_SCHEMA})

    def emit(delta, number):
        delta.write.mode("overwrite").parquet(f"{folder}/sent/b={number}")
        return delta.select("id", (F.col("id").cast("long") % 10 == 0).alias("error"))

    S.stream_push_delta(source, state, emit, f"{folder}/checkpoint").awaitTermination()
    sent = spark.read.parquet(f"{folder}/sent").select(F.col("id").alias("sent"), "op", "checksum")
    return state.read("state").select("id", "error").join(sent, F.col("id") == F.col("sent")).select("id", "op", "checksum", "error")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS id, ts, event_type, event_id, least(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 4.0 / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)), 3) AS part FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY ts DESC, event_type DESC) = 1),
c AS (SELECT *, lag(event_type) OVER (PARTITION BY id ORDER BY part) AS before FROM l)
SELECT id, CASE WHEN before IS NULL THEN 'insert' ELSE 'patch' END AS op, sha1('event_type=' || length(event_type) || ':' || event_type) AS checksum, ts::TIMESTAMP AS at FROM c WHERE before IS NULL OR before <> event_type
""")
def stream_changed(spark, sf):
    """K3: rows that are new or changed in four batches, by checksums in the state store."""
    events = table(spark, sf, "events")
    low, high = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp"))) + 1).first()
    rows = events.select(F.col("user_id").cast("string").alias("_id"), F.col("ts").cast("timestamp").alias("_at"), "event_type")
    folder = scratch(spark)
    KS.use_keyed_state(spark)
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    sink = KS.changed_rows(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    _by_batches(rows, F.floor((F.unix_micros("_at") - low) * 4 / (high - low)), 4, folder, sink.start)
    return spark.read.schema(KS.CHANGED).parquet(f"{folder}/out").select("id", "op", "checksum", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT c_custkey AS _id FROM customer WHERE c_custkey % 40 <> 0")
def fault_tolerant(spark, sf):
    """K4: bad rows aside, the good ones kept, as long as few are bad."""
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 40 == 0, "bad").alias("back"))
    return S.fault_tolerant_write(df, [Q.check_readonly(df, ["back"], "customer")], 1_000_000)[0].select("_id")


@query("SELECT bad - less AS max_errors, less = 1 AS refused, CASE less WHEN 0 THEN good ELSE 0 END AS kept FROM (SELECT count(*) FILTER (o_orderkey % 40 = 0) AS bad, count(*) FILTER (o_orderkey % 40 <> 0) AS good FROM orders), (VALUES (0), (1)) t(less)")
def fault_limit(spark, sf):
    """K4: as many bad rows as allowed are put aside, one more refuses all."""
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 40 == 0, "bad").alias("back"))
    most, rows = df.filter("back is not null").count(), []
    for limit in (most, most - 1):
        try:
            rows.append((limit, False, S.staged_write(df, f"{scratch(spark)}/out", F.col("back").isNotNull(), limit)[0].count()))
        except TableError:
            rows.append((limit, True, 0))
    return spark.createDataFrame(rows, "max_errors long, refused boolean, kept long")


@query("SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def object_sizes(spark, sf):
    """B1: a list picked by its path, and its size, null as none."""
    return project.select(reports(spark, sf), "id", "lines").select("id", F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n"))
