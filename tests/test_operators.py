"""Cases that the shared tables don't hold: nulls, nesting, errors, files, streams."""

import datetime
import json
import random
import subprocess
import sys
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import clean as C
from tablewright.functions import shapes
from tablewright.functions.predicates import Field, bbox, literal, recurse_any
from tablewright.model import Model, Property, Table, TableError, load_order
from tablewright.operators import history as H
from tablewright.operators import keymap as K
from tablewright.operators import paging, project, quality, refs, summary
from tablewright.operators import sync as Y
from tablewright.sources import readers as R
from tablewright.sources import writers as W
from tablewright.streaming import changes as ST
from tablewright.streaming import keyed as KS

REPORT = "status string, count int, day date, notes array<struct<note:string, kinds:array<string>>>, sync struct<id:string, parts:array<struct<id:string>>>"


@pytest.fixture(scope="module")
def reports(spark):
    d = datetime.date
    rows = [
        ("OK", 10, d(2019, 3, 14), [("hello", ["valid", "invalid"])], ("a", [("x",)])),
        ("invalid", 42, d(2019, 4, 20), [("world", ["expired"]), (None, None)], ("b", [])),
        ("invalid", 13, d(2019, 2, 1), [], None),
        (None, None, None, None, ("x", [("ok",)])),
    ]
    return spark.createDataFrame(rows, REPORT)


def kept(df, condition):
    return sorted(r["count"] or 0 for r in df.filter(condition).collect())


def test_predicates(reports):
    f = lambda p: Field(reports, p)
    assert kept(reports, f("status").eq("invalid")) == [13, 42]
    assert kept(reports, f("status").ne("invalid")) == [10] and kept(reports, f("status").ne(None)) == [10, 13, 42]
    assert kept(reports, f("status").eq(None)) == [0] and kept(reports, f("status").eq([])) == []
    assert kept(reports, f("day").ge("2019-03-14")) == [10, 42] and kept(reports, f("count").lt(13)) == [10]
    assert kept(reports, f("notes.note").eq("hello")) == [10] and kept(reports, f("notes.kinds").eq("expired")) == [42]
    assert kept(reports, f("notes.kinds").ne("expired")) == [10] and kept(reports, f("notes.note").ne("hello")) == [42]
    assert kept(reports, f("status").lower().eq("ok")) == [10] and kept(reports, f("notes.note").upper().startswith("WOR")) == [42]
    assert kept(reports, f("status").length().gt(2)) == [13, 42]
    assert kept(reports, recurse_any(reports, "id", "eq", "x")) == [0, 10]
    for bad in (lambda: f("nothing"), lambda: f("status").lt("a"), lambda: f("count").eq("a"), lambda: f("status").contains(""), lambda: f("count").gt(None), lambda: recurse_any(reports, "nope", "eq", 1)):
        with pytest.raises(TableError):
            bad()
    with pytest.raises(TableError):
        literal(T.DateType(), "yesterday")


def test_boolean_predicates(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "count int, b boolean")
    assert kept(df, Field(df, "b").eq(True)) == [1] and kept(df, Field(df, "b").ne(True)) == [2, 3]


def test_select_nested(reports):
    rows = project.select(reports, "count", "notes.kinds", "sync.parts.id").collect()
    assert [(r["count"], r["notes.kinds"], r["sync.parts.id"]) for r in rows][0] == (10, ["valid", "invalid"], ["x"])
    assert project.select(reports).columns == reports.columns
    flat = project.flatten(reports.select("count", "notes", "sync")).collect()
    assert len(flat) == 2 + 2 + 1 + 1 and flat[0].asDict()["notes[].kinds[]"] == "valid"


def test_texts(spark):
    df = spark.createDataFrame([({"lt": "L", "en": "E"},), ({"en": "E"},), ({},)], "title map<string,string>")
    assert [r[0] for r in project.select(df, "title@lt").collect()] == ["L", None, None]
    with pytest.raises(TableError):
        project.select(df, "title", "title@lt")
    picked = df.select(project.pick_language(F.col("title"), ["de", "lt"], ["en", "lt"]).alias("t"))
    assert [r.t for r in picked.collect()] == ["L", "E", None]
    assert project.flatten_languages(df, "title", ["lt", "en"]).columns == ["title@lt", "title@en"]


def test_scope_refuses_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "s")], "id int, name string, secret string")
    scope = project.Scope(df, ["id", "name"])
    for wrong in (dict(columns=["secret"]), dict(sort=["-secret"]), dict(uses=["secret"])):
        with pytest.raises(TableError):
            scope.query(**wrong)
    assert scope.query().columns == ["id", "name"]


def test_checksum_sees_changes(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (1, "a", [2, 1]), (1, None, [1, 2]), (1, "a", [1, 2])], "_id int, n string, l array<int>")
    a, b, c, d = (r.c for r in df.select(project.checksum(df).alias("c")).collect())
    assert a == d and len({a, b, c}) == 3


def test_hashes_tell_values_from_separators(spark):
    df = spark.createDataFrame([("1\nb=2", None), ("1", "2"), ("1\nb=1:2", None)], "a string, b string")
    assert len({r.c for r in df.select(project.checksum(df).alias("c")).collect()}) == 3
    pairs = spark.createDataFrame([("a\n=b", "c"), ("a", "b\n=c"), ("a1:", "x"), ("a", "1:x"), (None, "~"), ("~", None)], "x string, y string")
    assert len({r.c for r in pairs.select(H.stable_id("m", F.col("x"), F.col("y")).alias("c")).collect()}) == 6


def test_repeated_ids_and_keys_are_refused(spark):
    at = F.lit("2025-01-01").cast("timestamp")
    saved = spark.createDataFrame([("1", "r", None, None, "a", []), ("2", "r", None, None, "b", [])], CURRENT)
    given = spark.createDataFrame([("1", "x", []), ("1", "y", []), ("2", "z", [])], "_id string, name string, tags array<string>")
    out = H.update(saved, given, "t", at)
    assert sorted((r["_id"], r.name) for r in out.current.collect()) == [("1", "a"), ("2", "z")] and [tuple(r) for r in out.errors.collect()] == [("1", "repeated")]
    given = spark.createDataFrame([("n", ["1"]), ("n", ["2"]), ("b", ["3"]), ("b", ["4"]), ("a", ["5"]), (None, []), (None, [])], "name string, tags array<string>")
    out = H.upsert(saved, given, ["name"], "m", "t", at)
    assert sorted((r["_id"], r.name, r.tags) for r in out.current.collect()) == [("1", "a", ["5"]), ("2", "b", [])]
    assert sorted((r.code, r["_id"] or "") for r in out.errors.collect()) == [("repeated", ""), ("repeated", ""), ("repeated", "2")]


def test_one_row_and_one_result_of_an_id(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "_id string, name string")
    none = spark.createDataFrame([], Y.STATE_SCHEMA)
    delta = Y.push_delta(rows, none)
    assert sorted((r.id, r.op, r.data) for r in delta.collect()) == [("a", "insert", '{"name":"y"}'), ("b", "insert", '{"name":"z"}')]
    results = delta.withColumns({"revision": F.lit("1"), "error": F.lit(True), "n": F.lit(1)}).union(delta.withColumns({"revision": F.lit("2"), "error": F.lit(False), "n": F.lit(2)}))
    state = Y.save_push_state(none, results, F.current_timestamp(), by=["n"]).collect()
    assert sorted((r.id, r.revision, r.error) for r in state) == [("a", "2", False), ("b", "2", False)]


def test_too_many_bad_rows_fail(spark):
    df = spark.range(200).select(F.col("id").alias("_id"), F.lit("bad").alias("back"))
    with pytest.raises(TableError, match="more than 100"):
        ST.fault_tolerant_write(df, [quality.check_readonly(df, ["back"], "m")])
    good, found = ST.fault_tolerant_write(df.withColumn("back", F.when(F.col("_id") < 100, F.col("back"))), [quality.check_readonly(df.filter("_id < 100"), ["back"], "m")])
    assert good.count() == 100 == found.count()


def test_personal_codes(spark):
    codes = ["90000000000", "91234567890", "9123456789", "00000000000", "39001010077", "39002300000", "39900000003"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    today = F.lit("2025-06-01").cast("date")
    assert [r.v for r in df.select(C.is_national_id(F.col("c"), today).alias("v")).collect()][:4] == [True, True, False, True]


def test_summary_of_five_numbers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 3, 410, 707, 1000, None])], "_id int, v int")
    rows = summary.summary_numeric(df, "v").orderBy("bin").collect()
    hits = [(r.bin, r["count"], r["_id"]) for r in rows if r["count"]]
    assert len(rows) == 100 and hits == [(5.0, 2, None), (405.0, 1, 2), (705.0, 1, 3), (995.0, 1, 4)]
    assert summary.summary_numeric(df.limit(0), "v").count() == 0
    one = summary.summary_numeric(df.filter("v = 3"), "v").orderBy("bin").collect()
    assert one[0].bin == 3.5 and one[0]["count"] == 1 and one[-1].bin == 102.5


@pytest.mark.parametrize("unit,first,last", [("14D", "2023-01-08 00:00:00", "2026-10-25 00:00:00"), ("10Y", "2028-01-01 05:02:24", None)])
def test_summary_of_one_date(spark, unit, first, last):
    df = spark.createDataFrame([(1, datetime.date(2023, 1, 1))], "_id int, v date")
    rows = summary.summary_time(df, "v", unit=unit).orderBy("bin").select(F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("b"), "count").collect()
    assert rows[0].b == first and rows[0]["count"] == 1 and (last is None or rows[-1].b == last)


@pytest.mark.parametrize("at,step", [("10:00:00", 60), ("23:30:00", 1), ("23:59:59", 0.001)])
def test_summary_of_one_time(spark, at, step):
    df = spark.createDataFrame([(1, at), (2, None)], "_id int, v string")
    rows = summary.summary_clock(df, "v").orderBy("bin").collect()
    seconds = sum(int(x) * y for x, y in zip(at.split(":"), (3600, 60, 1), strict=True)) + step / 2
    assert rows[0]["count"] == 1 and sum(float(x) * y for x, y in zip(rows[0].bin.split(":"), (3600, 60, 1), strict=True)) == pytest.approx(seconds)


def test_summary_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 10.0, 20.0), (4, 40.0, 80.0), (5, None, 1.0)], "_id int, x double, y double")
    rows = summary.summary_geometry(df, "x", "y").collect()
    assert sorted((r["count"], r["_id"] or 0) for r in rows) == [(1, 3), (1, 4), (2, 0)]
    with pytest.raises(TableError):
        summary.summary_enum(df, "x", [])


def test_casts(spark):
    def one(value, kind, to):
        df = spark.createDataFrame([(value,)], f"v {kind}")
        return df.select(C.cast_to(F.col("v"), df.schema["v"].dataType, to)).first()[0]

    assert one(None, "string", "string") == "" and one([1, 2], "array<int>", "string") == "[1,2]" and one({"a": 1}, "map<string,int>", "string") == '{"a":1}'
    assert [one(v, "string", "integer") for v in ("42", "-42", "+1", "1.0", " 1", "a")] == [42, -42, 1, None, None, None]
    assert [one(v, "double", "integer") for v in (1.0, 1.5, -3.0)] == [1, None, -3]
    assert [one(v, "string", "boolean") for v in ("Yes", "off", "", "x")] == [True, False, False, None]
    assert one("2024-02-28T10:11:12", "string", "date") == datetime.date(2024, 2, 28) and one("2024-02-30", "string", "date") is None
    assert one("10:11", "string", "time") == "10:11" and one("25:00", "string", "time") is None
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    good, bad = C.cast_strict(df, "v", "integer")
    assert [r.v for r in good.collect()] == [1, None] and [r.v for r in bad.collect()] == ["x"]
    with pytest.raises(Exception, match="v is no integer"):
        df.select(C.cast_or_fail(df, "v", "integer")).collect()


def test_cleaning(spark):
    ask = lambda *cols: spark.range(1).select(*cols).first()
    texts = {"1,5": 1.5, "1,234.5": 1234.5, "1,234,567": 1234567.0, " 7 ": 7.0, "nan": None, "x": None, "1.2.3": None}
    assert [ask(C.clean(F.lit(t), "number"))[0] for t in texts] == list(texts.values())
    assert ask(C.flip(F.lit("SRID=1;LINESTRING (1 2, -3.5 4)")), C.flip(F.lit("POINT Z (1 2 3)")), C.flip(F.lit("POINT (1 2)"), 2)) == ("SRID=1;LINESTRING (2 1, 4 -3.5)", None, "POINT (1 2)")
    assert ask(C.geometry_label(F.lit("SRID=3;polygon ((0 0))")))[0] == "POLYGON"
    assert ask(C.swap(F.lit(float("nan")), float("nan"), 1.0))[0] == 1.0
    assert ask(C.split(F.lit("a.b|c"), "."))[0] == ["a", "b|c"]
    assert ask(C.is_national_id(F.lit("38703181745")), C.is_national_id(F.lit("38703181746")), C.is_national_id(F.lit("39913310001")), C.is_national_id(F.lit(None).cast("string"))) == (True, False, False, False)
    for bad in ("a,b", "/a", "?a"):
        with pytest.raises(Exception, match="no id can hold"):
            ask(C.composite_id(F.lit(bad)))
    with pytest.raises(Exception, match="not in the enum"):
        ask(C.map_enum(F.lit("z"), {"a": 1}))


def test_bbox_of_shapes(spark):
    wkts = {"POINT (5 5)": True, "POINT (11 5)": False, "LINESTRING (-5 -5, 20 20)": True, "POLYGON ((11 11, 12 12, 11 12, 11 11))": False}
    assert [spark.range(1).select(bbox(F.lit(w), 0, 0, 10, 10)).first()[0] for w in wkts] == list(wkts.values())


def test_paging_walks_everything(spark):
    rows = [(i, None if i % 5 == 0 else i % 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    for keys in (["a", "-b", "id"], ["-a", "b", "-id"]):
        want = [r.id for r in paging.sort(df, *keys).collect()]
        found, cursor = [], None
        while True:
            page = paging.page_after(df, keys, cursor, 7).collect()
            found += [r.id for r in page]
            if len(page) < 7:
                break
            cursor = [page[-1][k.lstrip("-")] for k in keys]
        assert found == want
    assert paging.after(df, ["a"], [None]) is not None and df.filter(paging.after(df, ["a"], [None])).count() == 0
    for bad in (lambda: paging.limit(df, 0), lambda: paging.limit(df, 1, -1)):
        with pytest.raises(TableError):
            bad()


def test_reference_loop_stops(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, friend int")
    catalog = {"p": Table(a, "id", {"friend": "p"}, lambda df: F.col("id") > 1)}
    assert sorted(r.id for r in refs.inherit_ref_filters(catalog, "p").collect()) == [2, 3]
    with pytest.raises(TableError):
        refs.join_path(catalog, "p", ["id.friend"])


def test_checks(spark):
    df = spark.createDataFrame([("1", ("a",), "x"), ("2", (None,), None), ("3", None, None)], "_id string, ref struct<_id:string>, back string")
    assert [r["_id"] for r in quality.check_ref_objects(df, "ref", "m").collect()] == ["2"]
    assert [r["_id"] for r in quality.check_readonly(df, ["back"], "m").collect()] == ["1"]
    with pytest.raises(TableError):
        quality.check_required(df, Model("m"))
    with pytest.raises(TableError):
        ST.fault_tolerant_write(df, [quality.check_readonly(df, ["back"], "m")], 0)
    good, bad = ST.fault_tolerant_write(df, [quality.check_readonly(df, ["back"], "m")], 1)
    assert good.count() == 2 and bad.count() == 1
    people = spark.createDataFrame([("Ann", "a@b.org", "+370 612 34567", "38703181745")] * 3, "name string, email string, phone string, code string")
    assert {r.column: r.uri for r in quality.detect_pii(people).collect()} == {"name": None, "email": "pii:email", "phone": "pii:phone", "code": "pii:id"}


def test_inference(spark):
    nested = T._parse_datatype_string("id bigint, at struct<lat:double>, items array<struct<name:string>>, tags array<string>")
    models = quality.infer_models(nested, "order")
    assert {p.name: p.dtype for p in models["order"].properties} == {"id": "integer", "at.lat": "number", "tags": "array"}
    assert models["order/items"].prop("parent").ref == "order"
    columns = spark.createDataFrame([("city", "id", "bigint"), ("city", "country", "int4"), ("city", "name", "varchar(20)"), ("city", "at", "timestamp without time zone")], "table string, column string, sql_type string")
    keys = spark.createDataFrame([("city", "id", "p", None), ("city", "country", "f", "country")], "table string, column string, kind string, target string")
    found = {r.column: (r.type, r.pk, r.ref) for r in quality.infer_refs(columns, keys).collect()}
    assert found == {"id": ("integer", True, None), "country": ("ref", False, "country"), "name": ("string", False, None), "at": ("datetime", False, None)}
    assert load_order({"city": ["country"], "country": ["planet"], "planet": [], "a": ["a"]}) == ["planet", "country", "city", "a"]


CURRENT = "_id string, _revision string, _created timestamp, _updated timestamp, name string, tags array<string>"


def test_patch_of_lists_and_defaults(spark):
    saved = spark.createDataFrame([("1", "r", None, None, "a", ["x"]), ("2", "r", None, None, "b", [])], CURRENT)
    given = spark.createDataFrame([("1", "a", None, []), ("2", None, None, ["name"]), ("3", "c", ["y"], [])], "_id string, name string, tags array<string>, _absent array<string>")
    rows = {r["_id"]: r for r in H.build_patch(given, saved, "update", {"name": "none"}).collect()}
    assert rows["1"]["_patch"] == {"tags": "[]"} and rows["2"]["_patch"] == {"name": "none"} and rows["3"]["_patch"] == {"name": "c", "tags": '["y"]'} and not rows["3"].found


def test_move_cycles_and_chains(spark):
    ends = H.resolve_redirects(spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(100, 101), (101, 100), (200, 100)], "_id int, redirect int")).collect()
    assert {r["_id"]: r.redirect for r in ends} == {i: 20 for i in range(1, 20)}


def test_errors_can_be_required(spark):
    errors = spark.createDataFrame([("1", "conflict")], "_id string, code string")
    with pytest.raises(TableError, match="conflict: 1"):
        H.require(errors)
    H.require(errors.limit(0))
    assert H.wipe(errors).count() == 0


def test_ids_are_stable(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("", 1)], "x string, y int")
    ids = [r[0] for r in df.select(H.stable_id("m", F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 36 and i[14] == "5" and i[19] in "89ab" for i in ids)
    keymap = spark.createDataFrame([], K.SCHEMA)
    at = F.lit("2025-01-01").cast("timestamp")
    first, keymap = K.encode(df, ["x"], keymap, "m", at)
    again, more = K.encode(df, ["x"], keymap, "m", at)
    assert first.collect() == again.collect() and more.count() == keymap.count() == 2
    assert K.check_given_ids(first.withColumn("_id", F.lit("other")), ["x"], keymap).count() == 2
    with pytest.raises(Exception, match="several ids"):
        K.validate(keymap.union(keymap.withColumn("key", F.lit("k2"))), fail=True).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("šalis;miestas\nlt;Vilnius\n")
    (tmp_path / "b.csv").write_text("šalis;miestas\nlv;Ryga\n")
    rows = R.read_csv(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"], ";")
    assert sorted(map(tuple, rows.collect())) == [("lt", "Vilnius"), ("lv", "Ryga")]
    data = {"countries": [{"code": "lt", "location": {"lat": 1.5}, "cities": [{"name": "Vilnius"}, {"name": "Kaunas"}]}, {"code": "lv", "cities": []}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    out = R.read_json_tree(spark, f"file://{tmp_path}/c.json", "countries[]", {"code": "code", "lat": "location.lat", "no": "nope"})
    assert sorted((r.code, r.lat, r.no) for r in out.collect()) == [("lt", 1.5, None), ("lv", None, None)]
    cities = R.read_json_tree(spark, f"file://{tmp_path}/c.json", "countries[].cities[]", {"name": "name", "code": "..code"})
    assert sorted(map(tuple, cities.collect())) == [("Kaunas", "lt"), ("Vilnius", "lt")]
    (tmp_path / "d.xml").write_text("<cities><city code='lt'><name>Vilnius</name></city><city><code>lv</code><name>Ryga</name></city></cities>")
    cities = R.read_xml_rows(spark, f"file://{tmp_path}/d.xml", "city", {"code": "@code", "tag": "code", "name": "name", "keys": ["name", "none"]}).collect()
    assert sorted((r.code, r.tag, r.name, r["keys"]) for r in cities if r.code) == [("lt", None, "Vilnius", ["Vilnius", None])] and {r.tag for r in cities} == {None, "lv"}


def test_written_files(spark, reports, tmp_path):
    W.write_csv_flat(reports.select("count", "sync"), f"file://{tmp_path}/csv")
    assert "sync.parts[].id" in spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns
    W.write_json_lines(reports.select("count", "day"), f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").filter("day = '2019-03-14'").count() == 1
    triples = W.to_triples(spark.createDataFrame([(1, 'a"b\n')], "_id int, name string"), "urn:m", {"name": "urn:name"})
    W.write_triples(triples, f"file://{tmp_path}/nt")
    assert '<urn:m/1> <urn:name> "a\\"b\\n" .' in {r[0] for r in spark.read.text(f"file://{tmp_path}/nt").collect()}


def test_parametrized_files(spark, tmp_path):
    for year in (2023, 2024):
        for code in ("lt", "lv"):
            spark.createDataFrame([(f"{code}{year}",)], "v string").coalesce(1).write.parquet(f"file://{tmp_path}/{year}/{code}.parquet")
    params = R.combinations({"year": spark.createDataFrame([(2023,), (2024,)], "x int"), "code": spark.createDataFrame([("lt",), ("lv",)], "x string")})
    files = R.read_parametrized(spark, f"file://{tmp_path}/{{year}}/{{code}}.parquet", params)
    assert sorted((r.year, r.code, r.v) for r in files.collect()) == [(y, c, f"{c}{y}") for y in (2023, 2024) for c in ("lt", "lv")]


def test_pages_of_repeated_keys(spark):
    """Read page after page some of these rows would never come; the guard names their keys, and the cuts take them in."""
    df = spark.createDataFrame([(i, i // 3 if i != 7 else None, f"n{i}") for i in range(12)], "id int, k int, name string")
    read, cursor = [], None
    while page := paging.page_after(df, ["k"], cursor, 4).collect():
        read, cursor = read + page, [page[-1].k]
    assert len(read) < 12
    assert [(r.k, r.rows, r.page, r.before) for r in paging.check_page_keys(df, ["k"], 4).collect()] == [(1, 3, 1, 1)]
    assert [(r.k, r.rows, r.page, r.before) for r in paging.check_page_keys(df, ["-k"], 2).orderBy("page").collect()] == [(3, 3, 1, 1), (1, 3, 4, 2), (0, 3, 5, 1)]
    assert paging.check_page_keys(df, ["k", "id"], 4).isEmpty()
    for keys, size in ((["k"], 4), (["-k"], 2), (["k", "-id"], 5), (["-k"], 1), (["name"], 100)):
        cuts = paging.page_cuts(df, keys, size).orderBy("page").collect()
        cursors = [None, *[[c[k.lstrip("-")] for k in keys] for c in cuts]]
        pages = [paging.page_between(df, keys, a, b).collect() for a, b in zip(cursors, cursors[1:], strict=False)]
        assert sorted(r.id for p in pages for r in p) == list(range(12)) and [len(p) for p in pages] == [c.rows for c in cuts]
        every = {r.id: r.page for r in paging.all_pages(df, keys, size).collect()}
        assert len(every) == 12 and all(every[r.id] == c.page for p, c in zip(pages, cuts, strict=True) for r in p)
    assert paging.page_cuts(df.limit(0), ["k"], 4).isEmpty() and paging.all_pages(df.limit(0), ["k"], 4).isEmpty()
    with pytest.raises(TableError):
        paging.page_cuts(df, ["k"], 0)


def test_moves_that_are_refused(spark):
    t = Table(spark.createDataFrame([(x,) for x in "abcdefgh"], "_id string"), "_id")
    child = Table(spark.createDataFrame([(i, x) for i, x in enumerate("abcdefgh")], "id int, up string"), "id", {"up": "m"})
    moves = spark.createDataFrame([("a", "b"), ("a", "c"), ("zzz", "b"), ("c", "d"), ("d", "c"), ("e", "e"), ("f", "nowhere"), ("g", "h"), ("h", "c"), ("b", None)], "_id string, redirect string")
    out, ends, errors = H.move({"m": t, "n": child}, "m", moves)
    assert sorted((r["_id"], r.code) for r in errors.collect()) == [("a", "repeated"), ("b", "not-found"), ("c", "cycle"), ("d", "cycle"), ("e", "self"), ("f", "not-found"), ("zzz", "unknown")]
    assert sorted(tuple(r) for r in ends.select("_id", "redirect").collect()) == [("g", "c"), ("h", "c")]
    assert sorted(r["_id"] for r in out["m"].df.collect()) == list("abcdef")
    assert [r.up for r in out["n"].df.orderBy("id").collect()] == list("abcdef") + ["c", "c"]


def test_writes_by_predicate(spark):
    at = F.lit("2025-01-01 00:00:00").cast("timestamp")
    schema = "_id string, _revision string, _created timestamp, _updated timestamp, name string, n int, o struct<x:int>"
    current = spark.createDataFrame([(str(i), "r", None, None, f"n{i % 3}" if i else None, i, (i % 2,)) for i in range(6)], schema)
    where = "_where array<struct<path:string,op:string,value:string>>, n int, _revision string"
    given = lambda *rows: spark.createDataFrame(list(rows), where)
    show = lambda w: ({r["_id"]: r.n for r in w.current.collect()}, sorted((r["_id"] or "", r.code) for r in w.errors.collect()), w.log.count())
    run = lambda *rows: show(H.update_where(current, given(*rows), "t", at))
    plain = {str(i): i for i in range(6)}
    assert run(([("name", "eq", "n1")], 100, None)) == (plain | {"1": 100, "4": 100}, [], 2)
    assert run(([("o.x", "eq", "1"), ("n", "gt", "2")], 7, None), ([("name", "eq", None)], 8, None)) == (plain | {"3": 7, "5": 7, "0": 8}, [], 3)
    assert run(([("n", "lt", "2")], 9, None), ([("n", "ge", "1"), ("n", "le", "2")], 9, None)) == (plain | {"0": 9, "2": 9}, [("1", "repeated")], 2)
    assert run(([("_id", "eq", "2")], 9, "other"), ([("_id", "eq", "77")], 9, None), ([("n", "eq", "x")], 9, None), ([("name", "eq", "none")], 9, None)) == (plain, [("", "invalid"), ("2", "conflict"), ("77", "not-found")], 0)
    assert run(([("name", "ne", None), ("name", "contains", "2")], 5, None)) == (plain | {"2": 5}, [], 1) and run() == (plain, [], 0)
    for bad in ([("n", "like", "2")], [("o", "eq", "2")], [("nothing", "eq", "2")]):
        with pytest.raises(TableError):
            run((bad, 1, None))
    put = lambda *rows: show(H.upsert_where(current, given(*rows).drop("_revision"), "m", "t", at))
    after, errors, logged = put(([("n", "eq", "3")], 33, None), ([("n", "eq", "50")], 50, None), ([("name", "eq", "n1")], 1, None), ([("_id", "eq", "5"), ("n", "lt", "9")], 5, None))
    assert sorted(after.values()) == [0, 1, 2, 4, 5, 33, 50] and errors == [("1", "multiple")] and logged == 2


def test_keys_with_many_pairs_are_cut_in_blocks(spark):
    """Joined by blocks or not, the rows are the same, and no task makes all pairs of a key."""
    own = spark.createDataFrame([(i, "hot" if i % 3 else "cold" if i % 2 else None, i % 5) for i in range(300)], "id int, `k.x` string, n int")
    target = spark.createDataFrame([(i, "hot" if i % 4 else "rare" if i % 8 else None, "A" if i % 10 else "B") for i in range(400)], "no int, k string, kind string")
    on = [("k.x", "k"), (F.lit("A"), "kind")]
    want, got = refs.join_ref_keys(own, "r", target, on), refs.join_ref_keys(own, "r", target, on, most=400)
    assert got.columns == want.columns and want.count() == 200 * 280 + 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 56_000 / 10


def test_batches_come_as_many_files(spark, tmp_path):
    """A part of the rows is one batch of the stream, from as many tasks as the rows have."""
    from tablewright.plans import files

    rows, folder, seen = spark.range(0, 100, 1, 4), f"file://{tmp_path}", []
    source = spark.readStream.schema("id long").parquet(f"{folder}/in/*")
    sink = source.writeStream.foreachBatch(lambda batch, n: seen.append((n, batch.count()))).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
    files._by_batches(rows, F.col("id") % 3, 3, folder, sink.start)
    assert seen == [(0, 34), (1, 33), (2, 33)]
    assert [len(list((tmp_path / f"in/b={k}").glob("part-*.parquet"))) for k in range(3)] == [4, 4, 4]


def test_upserts_by_ranges_make_no_hits(spark, monkeypatch):
    """Equalities and a range of one column: counted from the order, the same as from the hits; nulls, NaN and empty ranges among them."""
    at, chance = F.lit("2025-01-01 00:00:00").cast("timestamp"), random.Random(5)
    values = [None, float("nan"), -0.0, 0.0, 1.5, 2.0, 2.0, 3.25, 7.0]
    rows = [(str(i), "r", None, None, chance.choice(["a", "b", None]), chance.choice(values), i) for i in range(24)]
    current = spark.createDataFrame(rows, "_id string, _revision string, _created timestamp, _updated timestamp, k string, x double, n int")
    low, high = ["ge", "gt"], ["lt", "le"]
    given = []
    for i in range(120):
        terms = [("k", "eq", chance.choice(["a", "b", "c", None]))] + chance.choice([[], [("n", "eq", str(chance.randrange(24)))]])
        ends = chance.choice([[], [chance.choice(low)], [chance.choice(high)], [chance.choice(low), chance.choice(high)]])
        given.append((terms + [("x", op, chance.choice(["-1", "0", "2", "2.5", "7", "NaN", "x", None])) for op in ends], f"k{i}", i))
    given = spark.createDataFrame(given, "_where array<struct<path:string,op:string,value:string>>, k string, n int")
    def seen():
        w = H.upsert_where(current, given, "m", "t", at)
        return sorted((r["_id"], r.k, r.n) for r in w.current.collect()), sorted((r["_id"] or "", r.code) for r in w.errors.collect() if r.code != "multiple"), w.errors.filter("code = 'multiple'").count(), w.log.count()

    with monkeypatch.context() as m:
        m.setattr(H, "_interval", lambda shape: None)
        want = seen()
    assert want[2] > 10 and any(code == "repeated" for _, code in want[1])

    def refuse(*_):
        raise AssertionError("hits were made")

    monkeypatch.setattr(H, "_hits", refuse)
    assert seen() == want


def ring(points):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + ")"


def meets_plainly(shape, box):
    """Segments are clipped with exact fractions; a box in no part of the outline is in the shape or not by its corner."""
    kind, rings = shape
    x0, y0, x1, y1 = box

    def clipped(p, q):
        low, high = Fraction(0), Fraction(1)
        for a, b, lo, hi in ((p[0], q[0], x0, x1), (p[1], q[1], y0, y1)):
            if a == b:
                if not lo <= a <= hi:
                    return False
                continue
            t = sorted((Fraction(lo - a, b - a), Fraction(hi - a, b - a)))
            low, high = max(low, t[0]), min(high, t[1])
        return low <= high

    closed = [[*r, r[0]] if kind == "POLYGON" else r for r in rings]
    if any(x0 <= x <= x1 and y0 <= y <= y1 for r in rings for x, y in r) or kind != "MULTIPOINT" and any(clipped(p, q) for r in closed for p, q in zip(r, r[1:], strict=False)):
        return True
    hits = sum((p[1] > y0) != (q[1] > y0) and x0 < Fraction((q[0] - p[0]) * (y0 - p[1]), q[1] - p[1]) + p[0] for r in closed for p, q in zip(r, r[1:], strict=False)) if kind == "POLYGON" else 0
    return hits % 2 == 1


def test_shapes_meet_a_box(spark):
    rng = random.Random(8)
    spot = lambda: (rng.randrange(-8, 9), rng.randrange(-8, 9))
    made = []
    for _ in range(400):
        kind = rng.choice(["MULTIPOINT", "MULTILINESTRING", "POLYGON", "POLYGON"])
        rings = [[spot() for _ in range(rng.randrange(2 if kind != "POLYGON" else 3, 6))] for _ in range(rng.randrange(1, 3))]
        if kind == "POLYGON" and rng.random() < 0.3:
            rings = [[(-9, -9), (9, -9), (9, 9), (-9, 9)], *[r for r in rings[:1]]]
        text = f"{kind} (" + ", ".join(ring(r) if kind == "POLYGON" else ring(r)[: ring(r).rindex(",")] + ")" for r in rings) + ")"
        made.append(((kind, rings), text))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "id int, wkt string").cache()
    for box in ((0, 0, 2, 3), (-3, -1, -1, 5), (-2, -2, -2, -2), (5, 5, 30, 30)):
        found = {r.id for r in df.filter(bbox(F.col("wkt"), *box)).collect()}
        assert found == {i for i, (s, _) in enumerate(made) if meets_plainly(s, box)}


def test_odd_shapes(spark):
    texts = ["POINT EMPTY", "POLYGON EMPTY", "nonsense", "", None, "point(1 1)", "POINT Z (1 1 7)", "MULTIPOINT (9 9, 1 1)", "GEOMETRYCOLLECTION (POINT (5 5), LINESTRING (0 0, 1.5e0 1.5E0))", "LINESTRING (1 1)", "SRID=3346;POINT (1 1)", "POINT (1e-3 1)"]
    df = spark.createDataFrame([(t,) for t in texts], "wkt string")
    rows = df.select("wkt", bbox(F.col("wkt"), 0.5, 0.5, 2, 2).alias("b"), shapes.centroid(F.col("wkt")).alias("c")).collect()
    assert [bool(r.b) for r in rows] == [False, False, False, False, False, True, True, True, True, True, True, False]
    assert [None if r.c is None else (r.c.x, r.c.y) for r in rows] == [None] * 5 + [(1, 1), (1, 1), (5, 5), (0.75, 0.75), (1, 1), (1, 1), (0.001, 1)]
    far = 4_000_000.0
    square = "POLYGON ((" + ", ".join(f"{far + x} {far + y}" for x, y in ((0, 0), (0, 2), (2, 2), (2, 0), (0, 0))) + "))"
    two = "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((10 0, 12 0, 12 4, 10 4, 10 0)))"
    got = spark.createDataFrame([(square,), (two,)], "wkt string").select(shapes.measures(F.col("wkt")).alias("m"), shapes.centroid(F.col("wkt")).alias("c")).collect()
    assert (got[0].m.area, got[0].c.x, got[0].c.y) == (4, far + 1, far + 1)
    assert got[1].m.area == 16 and got[1].c.x == pytest.approx((8 * 1.5 + 8 * 11) / 16) and got[1].c.y == pytest.approx((8 * 1.5 + 8 * 2) / 16)


def test_clusters_weigh_places_by_their_rows(spark):
    """Sixty places in three far heaps: copies of a place change the weights and nothing else; 25 places are clusters of their own."""
    places = [(heap * 1000 + i % 5, i // 5) for heap in range(3) for i in range(20)]
    rows = [(f"{x}-{y}-{n}", f"POINT ({x} {y})") for x, y in places for n in range(1 + (x + y) % 3)]
    df = spark.createDataFrame(rows, "_id string, wkt string")
    few = summary.summary_geometry(df, "wkt", clusters=3).collect()
    assert sorted(r["count"] for r in few) == sorted(sum(1 + (x + y) % 3 for x, y in places if x // 1000 == h) for h in range(3)) and {r["_id"] for r in few} == {None}
    own = summary.summary_geometry(df.filter("wkt like '%(1 %' or wkt like '%(2 %'"), "wkt").collect()
    assert len(own) == 8 and sorted(r["count"] for r in own) == sorted(1 + (x + y) % 3 for x, y in places if x in (1, 2)) and all((r["_id"] is None) == (r["count"] > 1) for r in own)
    assert summary.summary_geometry(df, "wkt", bbox=(-5, -5, -1, -1)).collect() == [] and len(summary.summary_geometry(df, "wkt", bbox=(0, 0, 1, 1)).collect()) == 4
    with pytest.raises(TableError):
        summary.summary_geometry(df, "wkt", bbox=(1, 2, 3))


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(50).selectExpr("cast(id as int) as id", "concat('n', id) as name").write.format("jdbc").options(url=url, dbtable="things", **options).save()
    assert R.read_jdbc(spark, url, "things", "ID", (0, 50), 4, **options).filter("id >= 40").count() == 10


def test_derby_of_all_executors(spark, tmp_path):
    """Databases that every executor can open, through a cluster with executors of its own; odd texts come back as they were."""
    texts = ["plain", "", None, 'a "b", c', "line\nbreak", "ąž"]
    df = spark.createDataFrame([(i, t, i / 2 if i % 2 else None) for i, t in enumerate(texts)], "id int, name string, x double")
    parts = [R.read_jdbc(spark, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver") for url in W.write_derby(df, f"file://{tmp_path}/derby", "things", 3)]
    assert sorted(tuple(r) for p in parts for r in p.collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(TableError):
        W.write_derby(df, "hdfs://host/derby", "things")
    code = (
        "import sys; from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local-cluster[2,1,1024]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/c').getOrCreate()\n"
        "from tablewright.plans import changes\nprint('rows', changes.jdbc_table(s, sys.argv[1]).count())"
    )
    out = subprocess.run([sys.executable, "-c", code, "/root/testdata/sf0.001"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert f"rows {spark.read.parquet('/root/testdata/sf0.001/customer.parquet').filter('c_custkey % 2 = 0').count()}" in out.stdout


def test_jdbc_ranges_are_even(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/even;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    skewed = spark.range(4000).selectExpr("cast(pow(id, 3) as bigint) as id", "case when id % 50 = 0 then null else cast(id as double) / 7 end as share")
    skewed.write.format("jdbc").options(url=url, dbtable="skewed", **options).save()
    for column in ("ID", "SHARE"):
        df = R.read_jdbc(spark, url, "skewed", column, partitions=6, **options)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 6 and sum(sizes) == 4000 and max(sizes) < 2 * min(sizes)
    spark.createDataFrame([(3,)] * 5, "id int").write.format("jdbc").options(url=url, dbtable="same", **options).save()
    assert R.read_jdbc(spark, url, "same", "ID", partitions=4, **options).count() == 5


def test_catalogue_of_composite_keys(spark):
    """The catalogue queries on a database with the standard information schema, and what is made of their rows."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE country (code VARCHAR, year INTEGER, name VARCHAR UNIQUE, PRIMARY KEY (code, year))")
    con.sql("CREATE TABLE city (id BIGINT PRIMARY KEY, c VARCHAR, y INTEGER, called VARCHAR REFERENCES country (name), FOREIGN KEY (c, y) REFERENCES country (code, year))")
    kinds = {"columns": "table string, column string, sql_type string", "constraints": "table string, name string, kind string, position int, column string, target string, target_column string"}
    frames = [spark.createDataFrame(con.sql(f"SELECT * FROM {R.CATALOGUE[k].format(schema='main')}").fetchall(), t) for k, t in kinds.items()]
    found = {(r.table, r.property): (list(r["columns"]), r.type, r.pk, r.ref, r.refprops, r["unique"]) for r in quality.infer_keys(*frames).collect()}
    assert found == {
        ("country", "code"): (["code"], "string", 1, None, None, None), ("country", "year"): (["year"], "integer", 2, None, None, None), ("country", "name"): (["name"], "string", None, None, None, None),
        ("city", "id"): (["id"], "integer", 1, None, None, None), ("city", "c"): (["c"], "string", None, None, None, None), ("city", "y"): (["y"], "integer", None, None, None, None),
        ("city", "called"): (["called"], "ref", None, "country", ["name"], True), ("city", "c_y"): (["c", "y"], "ref", None, "country", [], True),
    }


def test_staged_write(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, "x").alias("back"))
    bad = F.col("back").isNotNull()
    with pytest.raises(TableError, match="more than 9"):
        ST.staged_write(df, f"file://{tmp_path}/out", bad, 9)
    assert list(tmp_path.iterdir()) == []  # nothing is left of what was refused
    good, refused = ST.staged_write(df, f"file://{tmp_path}/out", bad, 10)
    assert good.columns == ["id", "back"] and good.count() == 90 and sorted(r.id for r in refused.collect()) == list(range(0, 100, 10))
    with pytest.raises(TableError, match="exists"):
        ST.staged_write(df, f"file://{tmp_path}/out", bad)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    good, refused = ST.staged_write(df.limit(0), f"file://{tmp_path}/none", bad)
    assert good.count() == refused.count() == 0


def test_get_one_fails_without_row(spark):
    df = spark.createDataFrame([("1", "a")], "_id string, name string")
    assert R.get_one(df, "1").first().name == "a"
    with pytest.raises(Exception, match="no row with _id = 2"):
        R.get_one(df, "2").collect()


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in/*")


def test_stream_of_changes_equals_batch(spark, tmp_path):
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    schema = "_id string, _op string, _at timestamp, name string, tags array<string>"
    batches = [[("1", "upsert", at(1), "a", ["x"]), ("2", "upsert", at(1), "b", []), ("1", "upsert", at(2), "a2", [])], [("2", "delete", at(3), None, None), ("3", "upsert", at(3), "c", []), ("1", "upsert", at(3), "a2", [])]]
    source = stream_of(spark, tmp_path, batches, schema)
    state = ST.State(spark, f"file://{tmp_path}/state", {"current": CURRENT, "log": H.LOG_SCHEMA})
    ST.stream_apply_changes(source, state, "m", f"file://{tmp_path}/check").awaitTermination()
    current = {r["_id"]: (r.name, r["_created"], r["_updated"]) for r in state.read("current").collect()}
    log = state.read("log").orderBy("_id").collect()
    assert current == {"1": ("a2", at(1), at(2)), "3": ("c", at(3), None)} and [r["_id"] for r in log] == [1, 2, 3, 4, 5]
    want = [("1", "insert", at(1), '{"name":"a","tags":"[\\"x\\"]"}'), ("2", "insert", at(1), '{"name":"b","tags":"[]"}'), ("1", "update", at(2), '{"name":"a2","tags":"[]"}'), ("2", "delete", at(3), "{}"), ("3", "insert", at(3), '{"name":"c","tags":"[]"}')]
    assert sorted((r["_rid"], r.action, r.datetime, r.data) for r in log) == sorted(want)
    revisions = {r["_rid"]: r["_revision"] for r in log}
    assert {r["_id"]: r["_revision"] for r in state.read("current").collect()} == {k: revisions[k] for k in ("1", "3")}


def test_replay_one_batch_of_many_changes(spark):
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    saved = spark.createDataFrame([("k", "r0", at(0), None, "old", ["t"]), ("q", "r0", at(0), None, "same", None)], CURRENT)
    batch = [("a", "upsert", at(1), "x"), ("a", "upsert", at(2), "x"), ("a", "delete", at(3), None), ("a", "upsert", at(4), "y"), ("k", "upsert", at(1), "new"), ("k", "upsert", at(1), "newer"), ("k", "delete", at(1), None), ("z", "delete", at(1), None), ("q", "upsert", at(2), "same")]
    rows, log = ST.replay(saved, spark.createDataFrame(batch, "_id string, _op string, _at timestamp, name string"), "m", "t")
    found = sorted((r["_rid"], r.datetime, r.action, r.data) for r in log.collect())
    assert found == sorted([
        ("a", at(1), "insert", '{"name":"x","tags":"[]"}'), ("a", at(3), "delete", "{}"), ("a", at(4), "insert", '{"name":"y","tags":"[]"}'),
        ("k", at(1), "update", '{"name":"new","tags":"[]"}'), ("k", at(1), "update", '{"name":"newer"}'), ("k", at(1), "delete", "{}"), ("q", at(2), "update", '{"tags":"[]"}'),
    ])
    assert {r["_id"]: (r.name, r["_created"], r["_updated"], r["__gone"]) for r in rows.collect() if not r["__gone"]} == {"a": ("y", at(4), None, False), "q": ("same", at(0), at(2), False)}
    assert {r["_id"] for r in rows.collect() if r["__gone"]} == {"k"}


def test_stream_of_keys_and_pushes(spark, tmp_path):
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    rows = [[(1, "r", "t", "k1", at(1), "insert", '{"code":"a"}')], [(2, "r", "t", "k1", at(2), "patch", '{"code":"b"}'), (3, "r", "t", "k2", at(2), "move", '{"_id":"k1"}')]]
    state = ST.State(spark, f"file://{tmp_path}/keys/state", {"keymap": K.SCHEMA})
    ST.stream_keymap_sync(stream_of(spark, tmp_path / "keys", rows, H.LOG_SCHEMA), state, ["code"], f"file://{tmp_path}/keys/check").awaitTermination()
    assert {r.key: (r.value, r.redirect) for r in state.read("keymap").collect()} == {"k1": ('["b"]', None), "k2": (None, "k1")}
    sent = []
    failed = spark.createDataFrame([("1", True)], "id string, error boolean")
    emit = lambda df, n: (sent.extend((n, r.id, r.op) for r in df.collect()), failed.filter(F.lit(n == 0)))[1]
    state = ST.State(spark, f"file://{tmp_path}/push/state", {"state": "id string, revision string, checksum string, pushed timestamp, error boolean, data string"})
    rows = [[("1", at(1), "a"), ("2", at(1), "b")], [("1", at(2), "a"), ("2", at(2), "c")]]
    ST.stream_push_delta(stream_of(spark, tmp_path / "push", rows, "_id string, _at timestamp, name string"), state, emit, f"file://{tmp_path}/push/check").awaitTermination()
    assert sorted(sent) == [(0, "1", "insert"), (0, "2", "insert"), (1, "1", "patch"), (1, "2", "patch")]
    assert {r.id: r.error for r in state.read("state").collect()} == {"1": False, "2": False}
    assert {r.id: r.error for r in state.read("state", before=1).collect()} == {"1": True, "2": False}


def test_keyed_state_holds_what_changed(spark, tmp_path):
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    schema = "_id string, _at timestamp, name string"
    first = [(str(i), at(0), f"n{i}") for i in range(500)]
    batches = [first, [("1", at(1), "n1"), ("2", at(1), "x"), ("2", at(2), "n2"), ("3", at(1), "y"), (None, at(1), None), ("new", at(1), None)], [("3", at(3), "y"), ("new", at(3), "z"), ("4", at(3), None)]]
    source = stream_of(spark, tmp_path, batches, schema)
    KS.use_keyed_state(spark)
    run = lambda: KS.changed_rows(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query = run()
    query.awaitTermination()
    rows = [(r.id, r.op, json.loads(r.data)["name"]) for r in spark.read.schema(KS.CHANGED).parquet(f"file://{tmp_path}/out").filter("at > '2025-01-01 00:00:00'").collect()]
    assert sorted(rows, key=str) == sorted([("3", "patch", "y"), (None, "insert", None), ("new", "insert", None), ("new", "patch", "z"), ("4", "patch", None)], key=str)
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert written == [500, 3, 2]  # the state follows the ids that changed


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_batches_write_what_they_change(spark, tmp_path):
    """A thousand random keys of a table of many are written as a thousand rows, and read from their buckets only."""
    schema = "id long, value string"
    state = ST.State(spark, f"file://{tmp_path}/state", {"t": schema}, logs=(), bucket_rows=10_000, small_rows=2_000, fanout=3)
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("value"))
    state.write("t", 0, rows)
    base = folder_bytes(tmp_path / "state/t")
    state.merge("t")  # the latest run stays as it is
    state.write("t", 1, rows.limit(5))
    state.merge("t")
    sizes = []
    for n in range(2, 12):
        keys = spark.range(1_000).select(((F.col("id") * 7919 + n * 31) % 60_000).alias("id")).distinct().checkpoint()
        known = state.read("t", n, keys)
        state.write("t", n, known.select("id", F.concat(F.lit(f"{n}:"), "value").alias("value"), (F.col("id") % 100 == n).alias("__gone")))
        run = next(r for r in state.runs("t") if r.last == n)
        assert run.first == n and run.rows == keys.count()
        sizes.append(folder_bytes(tmp_path / f"state/t/r={n:09d}-{n:09d}"))
    assert max(sizes) < base / 20 and max(sizes) < 1.5 * min(sizes)
    assert len(state.runs("t")) <= 6 and [r.last for r in state.runs("t")][-1] == 11
    expected = {i: None for i in range(60_000)}
    gone = set()
    for n in range(2, 12):
        for i in {(j * 7919 + n * 31) % 60_000 for j in range(1_000)} - gone:
            expected[i] = n
            if i % 100 == n:
                gone.add(i)
    found = {r.id: r.value for r in state.read("t").collect()}
    assert set(found) == set(expected) - gone and all((found[i][:3].split(":")[0] == str(expected[i])) == (expected[i] is not None) for i in list(found)[:5000])
    state.write("t", 12, rows.limit(1))
    state.merge("t")
    merged = state.runs("t")[0]
    assert merged.first == 0 and merged.buckets == 16
    per = [spark.read.parquet(f"{merged.path}/{f.relative_to(tmp_path / f'state/t/{merged.path.rsplit(chr(47), 1)[1]}')}").count() for f in (tmp_path / f"state/t/{merged.path.rsplit('/', 1)[1]}").rglob("*.parquet")]
    assert max(per) <= 10_000 and sum(per) == merged.rows
    some = spark.createDataFrame([(5,), (77,)], "id long").checkpoint()
    plan = state.read("t", None, some)
    assert sorted(r.id for r in plan.collect()) == [5, 77]
    opened = {f.split("__bucket=")[1].split("/")[0] for f in plan.inputFiles() if merged.path.split("file:")[-1].lstrip("/") in f}
    assert len(opened) <= 16


def test_batches_that_come_again(spark, tmp_path):
    """A batch that runs again reads what it read and writes what it wrote; an unfinished run doesn't count."""
    schema = "_id string, _op string, _at timestamp, name string, tags array<string>"
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    batches = [[(str(i), "upsert", at(0), f"n{i}", []) for i in range(30)], [("7", "upsert", at(1), "again", []), ("8", "delete", at(1), None, None)]]
    state = ST.State(spark, f"file://{tmp_path}/state", {"current": CURRENT, "log": H.LOG_SCHEMA})
    ST.stream_apply_changes(stream_of(spark, tmp_path, batches, schema), state, "m", f"file://{tmp_path}/check").awaitTermination()
    show = lambda: (sorted(map(str, state.read("current").collect())), sorted(map(str, state.read("log").collect())))
    before = show()
    assert len(before[0]) == 29 and len(before[1]) == 32
    (tmp_path / "check/commits/1").unlink()  # as if the stream had failed before it could say that batch 1 was done
    (tmp_path / "check/commits/.1.crc").unlink(missing_ok=True)
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    ST.stream_apply_changes(again, state, "m", f"file://{tmp_path}/check").awaitTermination()
    assert show() == before
    next((tmp_path / f"state/current/r={1:09d}-{1:09d}").glob("_DONE-*")).unlink()
    assert state.read("current").count() == 30 and state.read("current", before=1).count() == 30


def test_merged_logs_go_on(spark, tmp_path):
    """Merging keeps all entries, leaves the last run to its batch, and the numbers go on behind it."""
    schema = "_id string, _op string, _at timestamp, name string, tags array<string>"
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    batches = [[(str(n), "upsert", at(n), "x", [])] for n in range(4)]
    state = ST.State(spark, f"file://{tmp_path}/state", {"current": CURRENT, "log": H.LOG_SCHEMA})
    run = lambda b: ST.stream_apply_changes(stream_of(spark, tmp_path, b, schema), state, "m", f"file://{tmp_path}/check").awaitTermination()
    numbers = lambda: sorted(r["_id"] for r in state.read("log").collect())
    parts = lambda: [(r.first, r.last) for r in state.runs("log")]
    state.merge("log")  # nothing there yet
    run(batches)
    state.merge("log")
    assert parts() == [(0, 2), (3, 3)] and numbers() == [1, 2, 3, 4]
    assert state.rows_before("log", 3) == 3  # batch 3 again finds the number to go on from
    run([[("9", "upsert", at(9), "y", [])], [("9", "delete", at(10), None, None)]])
    state.merge("log")
    state.merge("log")
    assert parts() == [(0, 4), (5, 5)] and numbers() == [1, 2, 3, 4, 5, 6]
    with pytest.raises(TableError, match="merged"):
        state.read("log", 2)
    many = ST.State(spark, f"file://{tmp_path}/many", {"log": "_id long"}, fanout=3, small_rows=4)
    for n in range(20):
        many.write("log", n, spark.range(n * 2, n * 2 + 2).toDF("_id"))
    assert len(many.runs("log")) < 8 and sorted(r[0] for r in many.read("log").collect()) == list(range(40)) and many.rows_before("log", 19) == 38


def test_properties():
    assert Property("x", level=3).identifiable is False
    with pytest.raises(TableError):
        Model("m").prop("x")


def test_repair_changelog(spark):
    entries = [
        ("a", "insert", '{"k":"1","n":"x"}'), ("b", "insert", '{"k":"1"}'), ("a", "delete", "{}"),  # b is newer, though a was deleted later
        ("c", "insert", '{"k":"2"}'), ("d", "insert", '{"k":"3"}'), ("d", "patch", '{"k":"2"}'),  # d took c's key
        ("e", "insert", '{"k":null}'), ("f", "insert", '{"n":"y"}'), ("g", "insert", '{"k":null}'),  # no key is not a null one
        ("h", "insert", '{"k":"2"}'), ("h", "move", '{"_id":"c"}'), ("i", "delete", None),
    ]
    rows = [(n, f"r{n}", "t", rid, datetime.datetime(2024, 1, 1, 0, n), action, data) for n, (rid, action, data) in enumerate(entries, 1)]
    log = spark.createDataFrame(rows, H.LOG_SCHEMA)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert sorted(tuple(r) for r in H.find_corrupt_changelog(log, ["k"]).collect()) == [("a", "b"), ("c", "d"), ("e", "g")]
    repaired = H.repair_changelog(log, ["k"], "fix", at)
    moves = repaired.filter("_txn = 'fix'").orderBy("_id").collect()
    assert [(r._id, r._rid, r.action, r.data) for r in moves] == [(13, "a", "move", '{"_id":"b"}'), (14, "c", "move", '{"_id":"d"}'), (15, "e", "move", '{"_id":"g"}')]
    assert H.find_corrupt_changelog(repaired, ["k"]).isEmpty()
    assert H.find_corrupt_changelog(log.filter("action <> 'delete'"), ["k"]).isEmpty() and H.find_corrupt_changelog(log.limit(0), ["k"]).isEmpty()
