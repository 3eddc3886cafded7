"""Sharding, mixing, URL filter and decontamination against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontam, mixing, queries, sharding, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    wanted = con.sql(queries.ORACLE[name])
    columns, got = sorted(wanted.columns), queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    show = lambda rows: sorted(tuple(v.hex() if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(r for r in got.select(columns).collect()) == show([r[i] for i in at] for r in wanted.fetchall())


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        slots[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_shards_follow_weights_and_confine_movement(spark):
    ids = spark.range(40_000).select(F.col("id").alias("k"))
    flat = sharding.planned(16)
    heavy = tuple(leaf._replace(weight=3.0) if leaf.shard == 5 else leaf for leaf in flat)
    gone = tuple(leaf._replace(weight=0.0) if leaf.shard == 5 else leaf for leaf in flat)
    at = lambda t: sharding.shard_of(F.col("k"), t)
    rows = ids.select(at(flat).alias("a"), at(heavy).alias("b"), at(gone).alias("c"), at(sharding.grow(flat)).alias("d"), at(sharding.grow(sharding.grow(flat))).alias("e")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(n / 40_000 - 1 / 16) < 0.006 for n in share.values()) and len(share) == 16
    assert abs(Counter(r.b for r in rows)[5] / 40_000 - 3 / 18) < 0.01 and Counter(r.c for r in rows)[5] == 0
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    for r in rows:
        if r.a != r.b:  # a row moves only into the region that gained, from inside it only into its rack, from that only into its shard
            assert region(r.b) == 0 and (region(r.a) == 1 or rack(r.b) == 1) and (rack(r.a) != 1 or r.b == 5)
        assert r.d in (r.a, 16) and r.e in (r.d, 17)
    assert abs(sum(r.d == 16 for r in rows) / 40_000 - 1 / 17) < 0.006


def test_slots_of_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 14 + [(3, "c")], "id int, t string").withColumn("shard", F.lit(0))
    out = sharding.number_in_shard(rows, "shard", ["id"], buckets=4).collect()
    assert sorted(r.slot for r in out) == list(range(65)) and Counter(r.id for r in out) == {1: 50, 2: 14, 3: 1}


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, keep=("label",)).collect()
    assert len(rows) == odd.count() and len({(r["shard"], r.slot) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), (None, 5), ("d", 0)], "source string, source_size long")
    rows = {r.source: r for r in mixing.targets(mixing.cyclic_weights(sizes)).collect()}
    total, live = 1106, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert {k: r.weight for k, r in rows.items()} == live
    wanted, size = {}, {k: r.source_size for k, r in rows.items()}
    while True:  # share out, cap, and share the excess out again
        left = total - sum(wanted.values())
        open_ = {k: w for k, w in live.items() if k not in wanted}
        over = [k for k in open_ if left * open_[k] / sum(open_.values()) >= 3 * size[k]]
        if not over:
            wanted |= {k: left * w / sum(open_.values()) for k, w in open_.items()}
            break
        wanted |= {k: 3 * size[k] for k in over}
    assert all(math.isclose(rows[k].target, wanted[k], abs_tol=1e-6) for k in live)
    assert rows["d"].rate == 0


def test_mix_emits_copies(spark, docs, odd):
    plan = {r.doc_id: r for r in mixing.plan_copies(docs).collect()}
    out = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert out == Counter({k: r.mix_copies for k, r in plan.items() if r.mix_copies})
    for r in plan.values():
        assert r.mix_size == len(WORD.findall(r.text)) and math.floor(r.mix_rate) <= r.mix_copies <= math.ceil(r.mix_rate) <= 3
    assert mixing.mix(odd).columns == odd.columns and mixing.plan_copies(odd).count() == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0


def test_url_parts(spark):
    urls = ["http://U:p@A.b.Example.com.:80/x?y", "https://localhost", "nothing", None, "ftp://x.org#f"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(urlfilter.host_of(F.col("url")).alias("h")).collect()
    assert [r.h for r in rows] == ["a.b.example.com", "localhost", None, None, "x.org"]
    assert spark.range(1).select(urlfilter.suffixes(F.lit("a.b.example.com"))).first()[0] == ["a.b.example.com", "b.example.com", "example.com", "com"]
    assert spark.range(1).select(urlfilter.suffixes(F.lit("localhost"))).first()[0] == ["localhost"]


def test_url_filter_as_of(spark):
    d = lambda n: date(2024, 1, n)
    entries = [("x.com", d(3), True), ("x.com", d(5), True), ("x.com", d(8), False), ("a.x.com", d(6), True), ("x.com", d(8), True), (None, d(1), True), ("x.com", None, True)]
    listed = spark.createDataFrame(entries, "pattern string, dated date, listed boolean")
    captures = [("http://a.x.com/1", d(n)) for n in range(1, 10)] + [("http://y.com", d(4)), (None, d(4)), ("http://x.com", None), ("http://x.com", d(4)), ("http://x.com", d(4))]
    rows = spark.createDataFrame([(*c, "clash") for c in captures], "url string, fetched date, host string")
    out = urlfilter.filter_captures(rows, listed)
    assert out.count() == len(captures)
    found = {(r.url, r.fetched): (r.blocked, r.pattern, r.listed_since) for r in out.collect()}
    for n in range(1, 10):
        want = (True, "a.x.com", d(6)) if n >= 6 else (True, "x.com", d(5)) if n == 5 else (True, "x.com", d(3)) if n >= 3 else (False, None, None)
        assert found["http://a.x.com/1", d(n)] == want
    assert not found[None, d(4)][0] and not found["http://x.com", None][0] and found["http://x.com", d(4)][0]
    assert urlfilter.filter_captures(rows, listed.limit(0)).filter("blocked").count() == 0 and urlfilter.filter_captures(rows.limit(0), listed).count() == 0


def test_very_long_urls(spark):
    day = date(2024, 1, 5)
    hosts = ["a." * 60_000 + "b.org", "x" * 300_000 + ".b.org", "a." * 60_000 + "c.org"]
    urls = [f"http://{h}/" for h in hosts] + ["http://b.org/" + "p/" * 200_000]
    rows = spark.createDataFrame([(u, day) for u in urls], "url string, fetched date")
    listed = spark.createDataFrame([("b.org", date(2024, 1, 1), True)], "pattern string, dated date, listed boolean")
    found = {r.url: (r.host, r.blocked) for r in urlfilter.filter_captures(rows, listed).collect()}
    assert [found[u] for u in urls] == [(hosts[0], True), (hosts[1], True), (hosts[2], False), ("b.org", True)]


def plain_filter(captures, entries):
    """Every capture against all entries, one by one."""
    said = defaultdict(dict)
    for pattern, dated, listed in entries:
        name = pattern.lower().removesuffix(".") if pattern else None
        if name and dated:
            said[name][dated] = said[name].get(dated, True) and bool(listed)
    for host, fetched in captures:
        labels, hit = host.split("."), (False, None, None)
        for i in range(len(labels)):
            pattern = ".".join(labels[i:])
            before = max((d for d in said.get(pattern, ()) if fetched and d <= fetched), default=None)
            if before and said[pattern][before]:
                hit = (True, pattern, before)
                break
        yield hit


def test_url_filter_equals_plain(spark):
    draw = random.Random(5)
    hosts = ["a.b.x.com", "b.x.com", "x.com", "y.x.com", "com", "a.org", "deep.a.org", "other.net"]
    when = lambda: datetime(2024, 1, 1) + timedelta(hours=6 * draw.randrange(60))
    entries = [(draw.choice(["b.x.com", "X.com.", "x.com", "com", "a.org", "A.ORG", ".", None]), draw.choice([when(), when(), when(), None]), draw.choice([True, True, False, None])) for _ in range(150)]
    entries += [("many.org", datetime(2024, 1, 3) + timedelta(minutes=n), n % 2 == 0) for n in range(2000)]  # many entries of one pattern, on two days
    captures = [(draw.choice(hosts), draw.choice([when(), when(), when() - timedelta(days=3), None])) for _ in range(600)]
    captures += [("w.many.org", datetime(2024, 1, 3) + timedelta(minutes=n, seconds=30)) for n in range(-2, 2003, 7)] + [("y.x.com", datetime(2024, 1, 5))] * 300
    rows = spark.createDataFrame([(n, f"https://{h}/{'p' * (n % 7)}", t) for n, (h, t) in enumerate(captures)], "n long, url string, fetched timestamp")
    found = urlfilter.filter_captures(rows, spark.createDataFrame(entries, "pattern string, dated timestamp, listed boolean"))
    assert [(r.blocked, r.pattern, r.listed_since) for r in sorted(found.collect(), key=lambda r: r.n)] == list(plain_filter(captures, entries))
    long = spark.createDataFrame([("http://" + "a." * 100 + "com/" + "p" * 1_000_000, datetime(2024, 1, 5))], "url string, fetched timestamp")
    assert urlfilter.filter_captures(long, spark.createDataFrame([("com", datetime(2024, 1, 5), True)], "pattern string, dated timestamp, listed boolean")).first().pattern == "com"


TOKEN = re.compile(r"[^\W_]+")


def plain_leaks(docs, items):
    out = {}
    for d, text in docs:
        toks = TOKEN.findall((text or "").lower())
        for i, item in items:
            want = TOKEN.findall((item or "").lower())
            if len(want) < decontam.SPAN:
                continue
            best = max((sum(a == b for a, b in zip(want[max(-s, 0):], toks[max(s, 0):])), -s) for s in range(-len(want), len(toks) + 1))
            if best[0] >= decontam.LEAST and best[0] / len(want) >= decontam.OVERLAP:
                out[d, i] = best[0]
    return out


def test_leaks(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = [(r.doc_id, r.text[:6000]) for r in docs.collect() if r.doc_id % 3 == 0]
    items = [(r.item_id, r.text) for r in bench.collect()]
    whole = "zero " + items[0][1].replace(" ", "  ") + " end"
    words = items[1][1].split()
    changed = " ".join("changed" if k % 6 == 5 else w for k, w in enumerate(words))
    some += [(-1, whole), (-2, "x " * 50 + changed), (-3, " ".join(items[2][1].split()[:4])), (-4, None), (-5, "")]
    found = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(spark.createDataFrame(some, "doc_id long, text string"), bench).collect()}
    assert found == plain_leaks(some, items) and (-1, items[0][0]) in found and (-2, items[1][0]) in found


def test_no_agreement_without_seed():
    width = max(m[-1] for m in decontam.MASKS)
    most = {(0,) * width: 0}  # the last tokens' agreement: most agreeing tokens so far without a seed
    for n in range(1, 200):
        longer = defaultdict(int)
        for last, agreed in most.items():
            for bit in (0, 1):
                now = (*last, bit)
                if not any(all(now[o - m[-1] - 1] for o in m) for m in decontam.MASKS):
                    longer[now[1:]] = max(longer[now[1:]], agreed + bit)
        most = longer
        assert max(most.values()) < max(decontam.LEAST, decontam.OVERLAP * n)


def test_least_hits_of_an_agreement():
    width = max(m[-1] for m in decontam.MASKS)
    fewest = {((0,) * width, 0): 0}  # the last tokens' agreement, agreeing tokens: fewest hits so far
    for n in range(1, 70):
        longer = {}
        for (last, agreed), hits in fewest.items():
            for bit in (0, 1):
                now = (*last, bit)
                more = hits + bit * sum(all(now[o - m[-1] - 1] for o in m) for m in decontam.MASKS)
                key = now[1:], agreed + bit
                longer[key] = min(longer.get(key, more), more)
        fewest = longer
        for (_, agreed), hits in fewest.items():
            if agreed >= decontam.LEAST:
                assert hits >= 2 * agreed - n - 2
            if n == decontam.WITHIN and agreed >= decontam.STRETCH:
                assert hits >= decontam.STRETCH


def test_rare_seeds_come_first(spark):
    """What all documents and all items say in common makes no pairs, and no leak is lost."""
    rng = random.Random(4)
    common = "it is one of".split()
    own = [[f"i{i}w{k}" for k in range(40)] for i in range(60)]
    items = [(i, " ".join(w[:9] + common + w[9:])) for i, w in enumerate(own)]
    docs = []
    for d in range(300):
        words = [rng.choice([f"d{d}w{k}", f"x{rng.randrange(500)}"]) for k in range(80)] + common + [f"d{d}end"]
        if d % 10 == 0:
            take = items[d // 10][1].split()
            words += take if d % 20 else [w if k % 5 else "changed" for k, w in enumerate(take)]
        docs.append((d, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(df, bench).collect()}
    assert found == plain_leaks(docs, items) and len(found) == 30
    toks = lambda t: decontam.tokens(F.col("text")).alias("toks")
    item_seeds = decontam.seeds(bench.select("item_id", toks(bench)), ["item_id"]).select("item_id", F.col("pos").alias("item_pos"), "seed")
    met = decontam.seeds(df.select("doc_id", F.xxhash64("text").alias("text_hash"), toks(df)), ["doc_id", "text_hash"]).join(item_seeds.select("seed").distinct(), "seed")
    every = met.join(item_seeds, "seed").select("doc_id", "item_id").distinct().count()
    hits = decontam.hits_of(met, item_seeds, bench.select("item_id", F.lit(44).alias("n")))
    assert every == 300 * 60 and hits.select("doc_id", "item_id").distinct().count() == 30
    whole = met.join(item_seeds, "seed").join(hits.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_semi")
    assert hits.count() == whole.count()  # of the pairs that met every hit is there


def test_leaks_with_substitutions(spark):
    rng = random.Random(7)
    items, texts = [], []
    for n in (8, 9, 10, 12, 15, 20, 30, 59):
        for changes in range(n - max(decontam.LEAST, math.ceil(decontam.OVERLAP * n)) + 2):
            for _ in range(3):
                words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                at = set(rng.sample(range(n), changes))
                items.append((len(items), " ".join(words)))
                texts.append((len(texts), " ".join(["before"] * 5 + ["other" if k in at else w for k, w in enumerate(words)])))
    words = [f"v{k}" for k in range(10)]
    for gone in (0, 3, 9):
        texts.append((len(texts), " ".join("other" if k == gone else w for k, w in enumerate(words))))
    items.append((-1, " ".join(words)))
    found = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v for k, v in plain_leaks(texts, items).items() if k not in found} == {}
    assert all(found[len(texts) - k, -1] == 9 for k in (1, 2, 3))


def test_leaks_of_parts_and_shifted_words(spark):
    words = [[f"i{i}w{k}" for k in range(59)] for i in range(4)] + [[f"short{k}" for k in range(15)]]
    items = [(i, " ".join(w)) for i, w in enumerate(words)]
    texts = {1: words[0][20:33], 2: words[0][:35], 3: words[1][5:12] + ["x"] + words[1][13:21], 4: words[1][40:52]}
    wanted = {(1, 0), (2, 0), (3, 1)}
    for at in range(1, 59):  # one word put in, one left out
        texts[100 + at], texts[200 + at] = words[3][:at] + ["x"] + words[3][at:], words[3][:at] + words[3][at + 1 :]
        wanted |= {(100 + at, 3), (200 + at, 3)}
    for at in range(1, 15):
        texts[300 + at], texts[400 + at] = words[4][:at] + ["x", "y"] + words[4][at:], words[4][:at] + words[4][at + 1 :]
        wanted |= {(300 + at, 4), (400 + at, 4)}
    rows = spark.createDataFrame([(k, "so it began " + " ".join(v) + " and ended") for k, v in texts.items()], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == wanted
    assert found[1, 0].matched == 13 and found[1, 0].doc_start == 3 - 20 and found[2, 0].matched == 35


def test_clean_rows_of_leaking_ids_stay(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = spark.createDataFrame([(None, item), (None, "clean without id"), (1, item), (1, "clean with id"), (2, None)], "doc_id long, text string")
    kept = decontam.clean_documents(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows.collect() if r.text != item)


def test_decontamination_of_odd_rows(spark, odd, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaked = bench.first().text
    more = odd.withColumn("text", F.when(F.col("doc_id") == 6, F.lit(leaked)).otherwise(F.col("text")))
    assert [r.doc_id for r in decontam.leaks(more, bench).collect()] == [6]
    unnamed = bench.withColumn("item_id", F.lit(None).cast("long"))
    assert decontam.leaks(more, unnamed).count() == 0 and decontam.leaks(more, bench.union(bench)).count() == 1
    assert decontam.clean_documents(more, bench).count() == odd.count() - 2
    assert decontam.leaks(odd.limit(0), bench).count() == 0 and decontam.leaks(more, bench.limit(0)).count() == 0
