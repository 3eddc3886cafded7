"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

``measure`` reads each text once and gives counts and a vector of transformed statistics. ``fit`` estimates location
and scatter per language and source by the minimum covariance determinant: from three starts (median deviations alone, and
these with the correlations of squashed values and of signs) it takes concentration steps until no determinant falls any
more, and keeps the one of the lowest. A step weighs the share ``SUBSET`` of the rows with the smallest Mahalanobis distance
and estimates anew from them. It is one aggregation over all rows: distances fall into fine bins, moments are summed per
group and bin, and the bins up to the subset's size are added up, the last one in part. So no group is ever gathered in
one place, however many of the rows it holds. ``judge`` rejects rows whose distance is beyond the cutoff.

Statistics are whole multiples of 1/256 and sums of them whole numbers, so every run gives the same verdicts. Scatter is
kept away from singular by a least spread per statistic, so the determinant is that of the regularised matrix.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, cut, small, together, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SUBSET = 0.75
#: Concentration steps end when no logarithm of a determinant falls by this much, or after ``STEPS``.
FALL = 0.01
STEPS = 15
#: Starts of all groups up to which a step's sums over them are one task.
MAX_TOGETHER = 1_000
STARTS = 3
#: Steps of a squashed or projected value, and the share of independence mixed into a start's correlations.
GRAIN = 1024
SHRINK = 0.1
#: Rows of the whole language that a group's own moments are blended with, so small groups lean on their language.
PRIOR_ROWS = 20
#: Chance of a larger distance that a row from a normal distribution has; beyond it a row is rejected.
TAIL = 1e-3
UNIT = 256
BINS_PER_OCTAVE = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Statistic and the spread that every group is granted at least.
STATISTICS = {
    "log_words": 0.5,  # ln(1 + words)
    "log_word_length": 0.1,  # ln(characters per word)
    "symbols": 0.06,  # square root of symbols per character
    "duplicate_lines": 0.25,  # square root of the share of lines that repeat
    "repeats": 0.2,  # square root of the share of words in repeated windows
    "capitals": 0.06,  # square root of capitals per character
    "variety": 0.05,  # ln(distinct words) / ln(words)
}
P = len(STATISTICS)
X = [f"x{i}" for i in range(P)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes], hashes: dict) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more, first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled += each[k : k + n] * _MIX[k]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():  # equal hashes are confirmed on the words
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    marks = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(marks, places, 1)
            np.add.at(marks, np.array(places) + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure_text(text: str | None, hashes: dict) -> tuple[list[int], bool, list[int]]:
    """The counts, whether the base rules fail, and the statistics in units of 1/256."""
    text = text or ""
    words = text.encode().split()  # bytes.split parts at the six ASCII blanks exactly
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words, hashes)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    if not n:
        return [0, 0, symbols, duplicates, repeats], failed, [0] * P
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    vector = [
        math.log1p(n),
        math.log(chars / n),
        math.sqrt(symbols / chars),
        math.sqrt(duplicates / max(1, len(lines))),
        math.sqrt(repeats / n),
        math.sqrt(capitals / chars),
        math.log(len(set(words))) / math.log(n) if n > 1 else 1.0,
    ]
    return [n, chars, symbols, duplicates, repeats], failed, [round(x * UNIT) for x in vector]


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with counts, ``base_failed`` and statistics, in one narrow pass.

    Columns that carry the added names are replaced. A null text counts as empty and fails the base rules.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {*COUNTS, "base_failed", *X}]
    sent = kept if "text" in kept else [*kept, "text"]
    text_at = sent.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [measure_text(text.as_py(), hashes) for text in batch.column(text_at)]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            vectors = np.array([f[2] for f in found], np.int32).reshape(-1, P)
            arrays = [*batch.columns[: len(kept)], *map(pa.array, counts.T.copy()), pa.array([f[1] for f in found], pa.bool_()), *map(pa.array, vectors.T.copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *COUNTS, "base_failed", *X])

    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), *(T.StructField(c, T.IntegerType()) for c in X)]
    schema = T.StructType([docs.schema[c] for c in kept] + added)
    return docs.select(*sent).mapInArrow(scan, schema)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever these are called.

    Each text is measured once and written with its measures; the verdicts come from that table.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang", "source")}
    measured = written(measure(docs.withColumnsRenamed(own)))
    judged = judge(measured, fit(measured)).filter("kept")
    return judged.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_cdf(x: float, k: int) -> float:
    return _gamma_p(k / 2, x / 2)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


#: Makes the scatter of a normal distribution's subset that of the whole.
CONSISTENCY = SUBSET / chi2_cdf(chi2_quantile(SUBSET, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_FLOOR = np.diag([(s * UNIT) ** 2 for s in STATISTICS.values()])


#: The squared Mahalanobis distance of a row with columns ``mean`` and ``precision``; null without estimate.
DISTANCE = " + ".join(f"{1 if i == j else 2}D * precision[{k}] * (x{i} - mean[{i}]) * (x{j} - mean[{j}])" for k, (i, j) in enumerate(_PAIRS))


def _on_group(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` with the estimates of their language and source; null is a language or source like any other."""
    f = small(fitted.withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.join(f, same, "left").drop("__lang", "__source")


def _square(values: list) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), value in zip(_PAIRS, values, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _correlations(scatter: np.ndarray) -> np.ndarray:
    """Correlations, drawn towards independence; 0 for what does not vary."""
    spread = np.sqrt(np.maximum(np.diag(scatter), 1e-9))
    out = (1 - SHRINK) * np.clip(scatter / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def _estimates(frame: DataFrame, solve: Callable[[dict], list[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """``lang, source, start, mean, precision, logdet, fall`` for what ``solve`` makes of a row: start, mean and scatter.

    ``fall`` is by how much the logarithm of the determinant is below the row's ``former`` one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for start, mean, scatter in solve(row):
                    inverse, logdet = np.linalg.inv(scatter), round(float(np.linalg.slogdet(scatter)[1]), 6)
                    rows.append((row["lang"], row["source"], start, mean.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], logdet, row.get("former", logdet) - logdet))
            kinds = {"lang": pa.string(), "source": pa.string(), "start": pa.int32(), "mean": pa.list_(pa.float64()), "precision": pa.list_(pa.float64()), "logdet": pa.float64(), "fall": pa.float64()}
            lists = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds.values(), strict=True)], names=list(kinds))

    return frame.mapInArrow(scan, "lang string, source string, start int, mean array<double>, precision array<double>, logdet double, fall double")


def _begun(row: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The starts: median and median deviations, with no correlation, those of squashed values, and those of signs."""
    scale, n, squashed = np.sqrt(np.array(row["variance"])), row["n"], np.array(row["t"], float)
    tanh = _square(row["tt"]) / n - np.outer(squashed, squashed) / n**2
    spread = np.outer(scale, scale)
    return [(k, np.array(row["mean"]), spread * c) for k, c in enumerate((np.eye(P), _correlations(tanh), _correlations(_square(row["uu"]))))]


def _concentrated(row: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """A group's moments, leaning on its language's."""
    own, lang = _moments(row["n"], row["s"], row["c"]), _moments(row["ln"], row["ls"], row["lc"])
    weight = row["n"] / (row["n"] + PRIOR_ROWS)
    mean, scatter = (weight * a + (1 - weight) * b for a, b in zip(own, lang, strict=True))
    return [(row["start"], mean, CONSISTENCY * scatter + _FLOOR)]


def _moments(n: float, sums: list, crosses: list) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array(sums, float) / n
    return mean, _square(crosses) / n - np.outer(mean, mean)


def _starts(rows: DataFrame) -> DataFrame:
    group = ["lang", "source"]
    middle = cut(rows.groupBy(*group).agg(F.array(*[F.percentile(x, F.lit(0.5)) for x in X]).alias("mean")))
    away = _on_group(rows, middle).select(*group, "mean", *[F.abs(F.col(x) - F.get("mean", F.lit(i))).alias(x) for i, x in enumerate(X)])
    spread = away.groupBy(*group).agg(F.first("mean").alias("mean"), *[F.percentile(x, F.lit(0.5)).alias(x) for x in X])
    variance = F.array(*[F.pow(1.4826 * F.col(x), F.lit(2)) + float(_FLOOR[i, i]) for i, x in enumerate(X)])
    spread = cut(spread.select(*group, "mean", variance.alias("variance")))
    z = [f"(x{i} - mean[{i}]) / sqrt(variance[{i}]) AS z{i}" for i in range(P)]
    placed = _on_group(rows, spread).selectExpr(*group, "mean", "variance", *z)
    norm = "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + "), 1e-9D)"
    whole = [f"CAST(round({GRAIN} * tanh(z{i})) AS LONG) AS t{i}" for i in range(P)] + [f"CAST(round({GRAIN} * z{i} / {norm}) AS LONG) AS u{i}" for i in range(P)]
    total = lambda v: F.expr("array(" + ", ".join(f"sum({v}{i} * {v}{j})" for i, j in _PAIRS) + ")")
    sums = placed.selectExpr(*group, "mean", "variance", *whole).groupBy(*group).agg(
        F.first("mean").alias("mean"), F.first("variance").alias("variance"), F.count(F.lit(1)).alias("n"),
        F.expr("array(" + ", ".join(f"sum(t{i})" for i in range(P)) + ")").alias("t"), total("t").alias("tt"), total("u").alias("uu"),
    )
    return _estimates(sums, _begun)


def fit(measured: DataFrame) -> DataFrame:
    """``lang, source, mean, precision, settled`` for each language and source with a row that passes the base rules.

    ``settled`` is false where a start of the group still fell after ``STEPS`` steps; a warning says how many did.

    ``measured`` should be a written table: it is read three times and once per step. An empty one gives no estimates.
    """
    group = ["lang", "source"]
    rows = measured.filter(~F.col("base_failed")).select(*[F.col(c).cast("string").alias(c) for c in group], *X)
    now = cut(_starts(rows))
    starts = now.count()
    now = cut(together(now, starts, MAX_TOGETHER))
    s, c = [f"s{i}" for i in range(P)], [f"c{k}" for k in range(len(_PAIRS))]
    for step in range(STEPS):
        binned = _on_group(rows, now).selectExpr(*group, "start", f"CAST(floor(log2({DISTANCE} + {2**-10}D) * {BINS_PER_OCTAVE}) AS INT) AS bin", *X)
        sums = [F.expr(f"sum(CAST(x{i} AS LONG)) AS s{i}") for i in range(P)] + [F.expr(f"sum(CAST(x{i} AS LONG) * x{j}) AS c{k}") for k, (i, j) in enumerate(_PAIRS)]
        bins = binned.groupBy(*group, "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
        whole = Window.partitionBy(*group, "start")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        near = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("wanted", F.ceil(F.sum("n").over(whole) * SUBSET))
        near = near.filter(F.col("before") < F.col("wanted")).withColumn("share", F.least(F.lit(1.0), (F.col("wanted") - F.col("before")) / F.col("n")))
        moments = lambda names: F.expr("array(" + ", ".join(f"CAST(round(sum(IF(share = 1, {x}, 0)) + max(IF(share = 1, 0D, share)) * sum(IF(share = 1, 0, {x}))) AS LONG)" for x in names) + ")")
        own = cut(together(near.groupBy(*group, "start").agg(F.max("wanted").alias("n"), moments(s).alias("s"), moments(c).alias("c")), starts, MAX_TOGETHER))
        added = lambda name, n: F.expr("array(" + ", ".join(f"sum({name}[{i}])" for i in range(n)) + ")")
        lang = own.groupBy(F.col("lang").alias("__lang"), F.col("start").alias("__start")).agg(F.sum("n").alias("ln"), added("s", P).alias("ls"), added("c", len(_PAIRS)).alias("lc"))
        joined = own.join(lang, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("start") == F.col("__start"))).drop("__lang", "__start")
        former = now.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("start").alias("__start"), F.col("logdet").alias("former"))
        same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("start") == F.col("__start"))
        now = cut(_estimates(joined.join(former, same).drop("__lang", "__source", "__start"), _concentrated))
        if step and now.filter(F.col("fall") > FALL).isEmpty():
            break
    else:
        late = now.filter(F.col("fall") > FALL).count()
        warnings.warn(f"{late} estimates still fell after {STEPS} steps", RuntimeWarning, stacklevel=2)
    settled = (F.max("fall") <= FALL).alias("settled")
    lowest = F.min_by(F.struct("mean", "precision"), F.struct("logdet", "start")).alias("low")
    return cut(now.groupBy(*group).agg(lowest, settled).select(*group, "low.*", "settled"))


def judge(measured: DataFrame, fitted: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``measured`` with ``distance`` (null without estimate) and ``kept``: base rules pass and distance is within."""
    rows = _on_group(measured.drop("distance", "kept", "mean", "precision", "settled"), fitted).withColumn("distance", F.expr(DISTANCE)).drop("mean", "precision", "settled")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))
