"""Near duplicates, quality rules and the pipeline against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontam, mixing, neardup, quality, urlfilter
from tablewright.llm.common import written

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out = (text or "").translate(ASCII_LOWER)
    for blank in "\t\n\x0b\x0c\r":
        out = out.replace(blank, " ")
    return [w for w in out.split(" ") if w]


def plain_components(rows, width, percent=80):
    """doc_id -> (set size, component); ids are distinct."""
    sets = {}
    for d, text in rows:
        w = words_of(text)
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def family():
    """Chains of edits, a star around a base that is not the smallest id, exact copies, short texts."""
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows += [(1000 + i, " ".join(edited(rng, base, rng.randint(1, 6)))) for i in range(70)]
    rows += [(1500, " ".join(base)), (990, " ".join(base).upper().replace("W", "w")), (1501, "\n".join(base))]
    chain = [f"c{i}" for i in range(120)]
    for i in range(25):
        rows.append((2000 + i, " ".join(chain)))
        chain = edited(rng, chain, 2)
    rows += [(10, "a b c"), (11, "A  B c"), (12, "a b"), (13, ""), (14, None), (15, " \t"), (16, "x"), (17, "x")]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, family, width):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(d + 10_000, t) for d, t in family]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, words=width).collect()}
    assert found == plain_components(rows, width)


def test_near_duplicates_in_blocks(spark, family, monkeypatch):
    """With tiny blocks, pivots and the second meeting decide; the result is the same."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    frame = spark.createDataFrame(family, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, words=4).collect()}
    assert found == plain_components(family, 4)


def template_pages(n, first=0, template=150, own=80):
    """Pages that share most of their words and are no near duplicates, and two that are."""
    frame = [f"t{i}" for i in range(template)]
    page = lambda d: [f"p{d}x{i}" for i in range(own)]
    rows = [(first + d, " ".join(frame + page(d))) for d in range(n)]
    return [*rows, (first + n, " ".join([*frame, *page(n // 2)[:-3], "end"]))]


def test_template_pages_cost_rows_in_proportion(spark, monkeypatch):
    """Pages of one template chain into one cluster and link nothing: what is shuffled grows with them, not their square."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    linked, likely = neardup._linked, neardup._likely
    counts = Counter()

    def counting(rows, percent):
        counts["linked"] += rows.count()
        return linked(rows, percent)

    def counting_pairs(pairs, signatures, percent):
        counts["pairs"] += pairs.count()
        return likely(pairs, signatures, percent)

    monkeypatch.setattr(neardup, "_linked", counting)
    monkeypatch.setattr(neardup, "_likely", counting_pairs)
    seen = {}
    for n in (400, 1600):
        counts.clear()
        rows = template_pages(n)
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4)
        assert [(r.doc_id, r.component_id) for r in found.filter("not kept").collect()] == [(n, n // 2)]
        seen[n] = dict(counts)
    assert seen[1600]["linked"] <= 4.5 * seen[400]["linked"] and seen[1600]["pairs"] <= 4


def section_pages(rng, sections, pages):
    """Pages of one site: words of the site, of their section and their own; no two are linked but the last, a copy with a word changed."""
    site = [f"site{i}" for i in range(100)]
    rows = []
    for section in range(sections):
        words = [f"s{section}w{i}" for i in range(60)]
        for _ in range(pages):
            rows.append((len(rows), " ".join(site + words + [f"p{len(rows)}w{i}" for i in range(60)])))
    changed = rows[len(rows) // 2][1].split()
    changed[-3] = "changed"
    return [*rows, (len(rows), " ".join(changed))]


def test_sections_of_a_site_cost_rows_in_proportion(spark, monkeypatch):
    """Templates within a template: what one section has in common is in no prefix either, however many pages it has."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    likely, counts = neardup._likely, []

    def counting_pairs(pairs, signatures, percent):
        counts.append(pairs.count())
        return likely(pairs, signatures, percent)

    monkeypatch.setattr(neardup, "_likely", counting_pairs)
    for pages in (4, 8, 16):
        rows = section_pages(random.Random(pages), 40, pages)
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=1)
        assert [(r.doc_id, r.component_id) for r in found.filter("not kept").collect()] == [(len(rows) - 1, (len(rows) - 1) // 2)]
    assert len(counts) == 3 and max(counts) <= 4


def test_prefixes_of_sections_lose_no_link(spark, monkeypatch):
    """Pages of sections whose own parts are so small that some are linked: the same components as by brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(3)
    site, rows = [f"site{i}" for i in range(40)], []
    for section in range(6):
        words = [f"s{section}w{i}" for i in range(30)]
        for _ in range(14):
            own = [f"p{len(rows)}w{i}" for i in range(rng.randrange(4, 22))]
            rows.append((len(rows), " ".join(edited(rng, site + words + own, rng.randrange(0, 5)))))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()}
    assert found == plain_components(rows, 1) and 6 < len({c for _, c in found.values()}) < len(rows)


def test_columns_of_any_name_stay(spark, sf):
    """Tables whose own columns have the names that the operators would use."""
    names = ["__node", "__gone", "__id", "__first", "__last", "__bad", "__hash", "__hit", "__source", "__ROW", "first", "last", "settled", "mean"]
    text = " ".join(f"w{i}" for i in range(40))
    item = " ".join(f"i{i}" for i in range(30))
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, item, "en", "b"), (4, "other " * 3, "de", None), (4, "another text", "de", None), (None, "no id", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = lambda df: (df.columns == docs.columns, sorted((r.doc_id or 0, r.text) for r in df.collect()), {tuple(r[n] for n in names) for r in df.collect()} <= {tuple(names)})
    wanted = sorted((r[0] or 0, r[1]) for r in rows)
    assert kept(neardup.one_of_each(docs)) == (True, [r for r in wanted if r != (2, text)], True)
    assert kept(neardup.one_of_each(docs.filter("doc_id < 4"))) == (True, [(1, text), (3, item)], True)
    assert kept(decontam.clean_documents(docs, bench)) == (True, [r for r in wanted if r != (3, item)], True)
    planned = mixing.plan_copies(docs)
    assert planned.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies"] and planned.count() == 6
    assert all(tuple(r[n] for n in names) == tuple(names) for r in planned.collect())
    assert mixing.mix(docs).columns == docs.columns
    captures = docs.select(F.lit("http://a.b.org/").alias("url"), F.lit("2024-01-02").cast("date").alias("fetched"), *names)
    entries = spark.createDataFrame([("b.org", True)], "pattern string, listed boolean").withColumn("dated", F.lit("2024-01-01").cast("date"))
    found = urlfilter.filter_captures(captures, entries)
    assert found.columns == ["url", "fetched", *names, "host", "blocked", "pattern", "listed_since"] and found.filter("blocked").count() == 6


def test_prefixes_lose_no_link(spark, monkeypatch):
    """Sets of many similarities around the threshold, with no pivots to join them, in one cluster of several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"t{i}" for i in range(60)] + [f"f{family}w{i}" for i in range(rng.randrange(20, 90))]
        for _ in range(9):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, 6))[: rng.randrange(len(base) - 12, len(base) + 1)])))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert found == plain_components(rows, 2) and len({c for _, c in found.values()}) > 12


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        rest = rng.integers(0, 2**63, 4000 - len(both), dtype=np.uint64)
        sig = [np.frombuffer(neardup.packed(neardup.minima(np.concatenate((both, part)))).ljust(104, b"\0"), np.uint64) for part in np.array_split(rest, 2)]
        assert abs(float(neardup.estimated(sig[0], np.array([sig[1]]))[0]) - share) < 0.12


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[5][0].component_id == 4 and by_id[8][0].component_id == 7 and not by_id[8][0].kept
    assert all(r.component_id is None and r.kept for r in by_id[None])
    assert [by_id[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and len(by_id[6]) == 2
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_other_texts_of_a_copy_stay(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (5, text["b"]), (5, text["c"]), (7, text["d"]), (None, text["a"])]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "a"), (1, "a"), (5, "b"), (5, "c"), (7, "d")]


def plain_counts(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dups += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    marked = {k for v in windows.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), symbols, dups, len(marked)


def test_quality_counts(spark, docs, odd):
    again = spark.createDataFrame([(90, "a b c d e f g h i " * 3), (91, "x " * 40), (92, "l\nl\n\n \n l\nl\r\n" + "q w e r t y u i " * 2)], "doc_id long, text string")
    for frame in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), again):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in quality.measure(frame, ["doc_id"]).collect():
            want = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def half_up(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def plain_fit(rows):
    """The estimates in numpy: rows of (group, vector); the same starts and steps on gathered groups."""
    groups = defaultdict(list)
    for g, x in rows:
        groups[g].append(x)
    groups = {g: np.array(x, float) for g, x in groups.items()}
    floor, now, dets = quality._FLOOR, {}, {}
    for g, x in groups.items():
        middle = np.median(x, axis=0)
        scale = np.sqrt((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2 + np.diag(floor))
        z = (x - middle) / scale
        t, u = half_up(1024 * np.tanh(z)), half_up(1024 * z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None])
        for k, shape in enumerate((np.eye(quality.P), np.cov(t.T, bias=True) if len(t) > 1 else np.zeros((quality.P, quality.P)), u.T @ u)):
            d = np.sqrt(np.maximum(np.diag(shape), 1e-9))
            r = (1 - quality.SHRINK) * np.clip(shape / np.outer(d, d), -1, 1)
            np.fill_diagonal(r, 1)
            now[g, k] = middle, np.linalg.inv(np.outer(scale, scale) * r)
    for step in range(quality.STEPS):
        own, falls = {}, []
        for (g, k), (mean, precision) in now.items():
            x = groups[g]
            d = x - mean
            far = np.floor(np.log2(np.einsum("ni,ij,nj->n", d, precision, d) + 2**-10) * quality.BINS_PER_OCTAVE)
            wanted = math.ceil(len(x) * quality.SUBSET)
            last = np.sort(far)[wanted - 1]
            share = (wanted - (far < last).sum()) / (far == last).sum()
            w = np.where(far < last, 1.0, np.where(far == last, share, 0.0))
            own[g, k] = wanted, half_up(w @ x), half_up((w[:, None] * x).T @ x)
        for g, k in own:
            lang = [sum(v[i] for (h, m), v in own.items() if h[0] == g[0] and m == k) for i in range(3)]
            n = own[g, k][0]
            a, b = ((s / m, c / m - np.outer(s / m, s / m)) for m, s, c in (own[g, k], lang))
            w = n / (n + quality.PRIOR_ROWS)
            scatter = quality.CONSISTENCY * (w * a[1] + (1 - w) * b[1]) + floor
            now[g, k] = w * a[0] + (1 - w) * b[0], np.linalg.inv(scatter)
            det = round(float(np.linalg.slogdet(scatter)[1]), 6)
            falls.append(dets.get((g, k), math.inf) - det)
            dets[g, k] = det
        if step and max(falls) <= quality.FALL:
            break
    return {g: now[g, min(range(quality.STARTS), key=lambda k: (dets[g, k], k))] for g in groups}


def independent_mcd(x, rng, share=quality.SUBSET, starts=40):
    """Minimum covariance determinant by many random elemental starts and exact subsets; scatter made consistent."""
    h, best = math.ceil(len(x) * share), None
    for _ in range(starts):
        part = x[rng.choice(len(x), quality.P + 2, replace=False)]
        for _ in range(60):
            mean, cov = part.mean(axis=0), np.cov(part.T, bias=True) + 1e-6 * np.eye(quality.P)
            d = x - mean
            part = x[np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))[:h]]
            det = np.linalg.slogdet(np.cov(part.T, bias=True))[1]
            if best is None or det < best[0] - 1e-9:
                best = det, part
            elif det > best[0] + 1e-9 or part is best[1]:
                break
    return best[1].mean(axis=0), quality.CONSISTENCY * np.cov(best[1].T, bias=True)


@pytest.mark.parametrize("contaminated", [0.0, 0.2])
def test_scatter_is_that_of_another_estimator(spark, contaminated):
    """Correlated normal rows with a tight far cluster: the estimates are those of random-start searches on exact subsets."""
    rng, n = np.random.default_rng(7), 1500
    root = rng.normal(size=(quality.P, quality.P)) * 500
    x = rng.normal(size=(n, quality.P)) @ root.T
    bad = int(n * contaminated)
    x[:bad] = rng.normal(size=(bad, quality.P)) * 100 + 4000
    x = np.round(x).astype(int)
    rows = [("en", "a", False, *map(int, v)) for v in x]
    frame = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{c} int" for c in quality.X))
    (found,) = quality.fit(frame).collect()
    mean, scatter = independent_mcd(x.astype(float), rng)
    other = np.linalg.inv(scatter + quality._FLOOR)
    ours = quality._square(found["mean"] and found.precision)
    whiten = np.linalg.cholesky(other)
    assert np.abs((np.array(found["mean"]) - mean) @ whiten).max() < 0.1
    assert abs(np.linalg.slogdet(ours)[1] - np.linalg.slogdet(other)[1]) < 0.3
    far = lambda m, p: np.einsum("ni,ij,nj->n", x - m, p, x - m)
    mine, theirs = far(np.array(found["mean"]), ours), far(mean, other)
    assert np.abs(np.log(mine / theirs)).max() < 0.35 and (mine[:bad] > quality.CUTOFF).all()


def test_quality_estimates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    measured = written(quality.measure(docs, ["doc_id", "lang", "source"]))
    fitted = {(r["lang"], r["source"]): r for r in quality.fit(measured).collect()}
    rows = [((r["lang"], r["source"]), [r[x] for x in quality.X]) for r in measured.filter("not base_failed").collect()]
    want = plain_fit(rows)
    assert set(fitted) == set(want)
    for g, (mean, precision) in want.items():
        assert np.allclose(fitted[g].mean, mean) and np.allclose(fitted[g].precision, [precision[i, j] for i, j in quality._PAIRS], rtol=1e-6, atol=1e-12)


def test_chi_square():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.95, 7), 7) - 0.95) < 1e-9 and abs(quality.chi2_quantile(0.95, 7) - 14.0671) < 1e-3


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    measured = written(quality.measure(docs, ["doc_id", "lang", "source"]))
    judged = quality.judge(measured, quality.fit(measured)).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in judged}
    assert n.get((1, False), 0) <= 0.02 * (n.get((1, False), 0) + n[1, True])
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_quality_of_odd_rows(spark, odd):
    measured = quality.measure(odd)
    judged = quality.judge(measured, quality.fit(measured))
    assert judged.count() == odd.count() and judged.filter("kept and doc_id = 7").count() == 1
    assert judged.filter("doc_id in (1, 2, 3, 6) and kept").count() == 0
    empty = quality.measure(odd.limit(0))
    assert quality.judge(empty, quality.fit(empty)).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, sf))
        assert kept.columns == docs.columns, name
        ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
        assert set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert set(ids) == {d for d, (_, c) in plain_components(rows, 5).items() if c == d} and set(ids.values()) == {1}
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == ids and len({(r["shard"], r.slot) for r in out}) == len(out)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 for r in out)


def test_pipeline_of_odd_rows(spark, odd, sf):
    rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, sf))
        assert rows.columns == odd.columns, name
        assert rows.filter("size <> 'x' or shard <> 1 or kept <> 'y' or x0 <> 0 or label <> 'z' or target <> 2").count() == 0
    assert corpus_pipeline.shard(spark, rows, sf).count() == rows.count() >= 1
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, sf))
    assert empty.count() == 0


def test_loops_over_few_rows_are_one_task(spark):
    """A chain of edges is followed in one partition, and gives the same labels as in many."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long").repartition(8)
    want = {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    few = neardup.components(edges)
    assert few.rdd.getNumPartitions() == 1 and {r.node: r.label for r in few.collect()} == want
