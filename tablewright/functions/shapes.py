"""Plane geometry of well-known text as array expressions: parts and coordinates, meeting a box, measures and centroids.

A shape is a list of parts, each a ``kind`` (points, a line, a polygon's outline or a hole in it) and its coordinates. All
two-dimensional types are read, collections too; of more dimensions the first two count, and text that is none of them has
no parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS, LINE, OUTLINE, HOLE = range(4)
#: A name with what stands in its brackets, which holds no other name; an E behind a digit belongs to a number.
_ELEMENT = r"([A-Z]{5,}?)(?:\s+(?:Z|M|ZM))?\s*\(((?:[^A-Z]|(?<=[0-9.])E)*)\)"
_LIST = r"\(([^()]+)\)"
_RING = r"([(,])\s*\(([^()]+)\)"


def _points(text: Column) -> Column:
    """The coordinates of a list like ``1 2, 3 4``."""
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    pairs = F.transform(F.split(text, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _part(kind: Column, text: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), _points(text).alias("points"))


def parts(wkt: Column) -> Column:
    """The parts of a shape: ``array<struct<kind:int, points:array<struct<x:double, y:double>>>>``; null for null."""
    body = F.upper(F.regexp_replace(wkt, r"^SRID=[0-9]+;\s*", ""))
    names, texts = (F.regexp_extract_all(body, F.lit(_ELEMENT), F.lit(i)) for i in (1, 2))

    def of(name: Column, text: Column) -> Column:
        text = F.concat(F.lit("("), text, F.lit(")"))
        kind = F.when(name.endswith("POINT"), POINTS).otherwise(LINE)
        plain = F.transform(F.regexp_extract_all(text, F.lit(_LIST), F.lit(1)), lambda t: _part(kind, t))
        before, ring = (F.regexp_extract_all(text, F.lit(_RING), F.lit(i)) for i in (1, 2))
        rings = F.zip_with(before, ring, lambda b, t: _part(F.when(b == "(", OUTLINE).otherwise(HOLE), t))
        return F.when(name.endswith("POLYGON"), rings).otherwise(plain)

    return F.flatten(F.zip_with(names, texts, of))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(points: Column) -> Column:
    """Neighbouring coordinates ``p`` and ``q``."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def meets_box(wkt: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a shape and a box have a point in common, on their edges too; null for null, false for shapes without coordinates.

    A segment meets the box unless the x axis, the y axis or the segment's own direction separates them. A polygon whose
    outline and holes don't meet the box holds it whole or not at all, which one corner tells.
    """
    box = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    (left, low), (right, high) = box[0], box[3]

    def inside(p: Column) -> Column:
        return (p["x"] >= left) & (p["x"] <= right) & (p["y"] >= low) & (p["y"] <= high)

    def cut(s: Column) -> Column:
        p, q = s["p"], s["q"]
        overlap = reduce(lambda a, b: a & b, [(F.greatest(p[k], q[k]) >= lo) & (F.least(p[k], q[k]) <= hi) for k, lo, hi in (("x", left, right), ("y", low, high))])
        sides = [(q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) for x, y in box]
        return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    def crossed(s: Column) -> Column:
        """Whether the ray from the corner to the right crosses the segment."""
        p, q = s["p"], s["q"]
        return ((p["y"] > low) != (q["y"] > low)) & (left < (q["x"] - p["x"]) * (low - p["y"]) / (q["y"] - p["y"]) + p["x"])

    def meets(found: Column) -> Column:
        touched = F.exists(found, lambda part: F.exists(part["points"], inside) | ((part["kind"] != POINTS) & F.exists(segments(part["points"]), cut)))
        rings = F.filter(found, lambda part: part["kind"] >= OUTLINE)
        crossings = F.aggregate(rings, F.lit(0), lambda n, part: n + F.size(F.filter(segments(part["points"]), crossed)))
        return touched | (crossings % 2 == 1)

    return _once(parts(wkt), meets)


#: Sums over a shape: of areas, lengths and coordinates, each with its first moments.
MEASURES = ("area", "area_x", "area_y", "length", "length_x", "length_y", "points", "points_x", "points_y")


def measures(wkt: Column) -> Column:
    """A struct of ``MEASURES``: areas of outlines without their holes, lengths of lines, numbers of coordinates, and their moments."""

    def of_segments(part: Column, term) -> Column:
        return F.aggregate(segments(part["points"]), F.lit(0.0), lambda total, s: total + term(s["p"], s["q"]))

    def ring(part: Column) -> list[Column]:
        first = F.get(part["points"], F.lit(0))  # moments about it, as far coordinates cancel badly
        x, y = (lambda p: p["x"] - first["x"]), (lambda p: p["y"] - first["y"])
        cross = lambda p, q: x(p) * y(q) - x(q) * y(p)
        area = of_segments(part, cross) / 2
        sign = F.signum(area) * F.when(part["kind"] == HOLE, -1.0).otherwise(1.0)
        along = [of_segments(part, lambda p, q, c=c: (c(p) + c(q)) * cross(p, q)) / 6 for c in (x, y)]
        return [sign * area, *[sign * (m + area * first[k]) for m, k in zip(along, ("x", "y"), strict=True)]]

    def line(part: Column) -> list[Column]:
        length = lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        return [of_segments(part, length), *[of_segments(part, lambda p, q, k=k: length(p, q) * (p[k] + q[k]) / 2) for k in ("x", "y")]]

    def points(part: Column) -> list[Column]:
        total = lambda k: F.aggregate(part["points"], F.lit(0.0), lambda sum_, p: sum_ + p[k])
        return [F.size(part["points"]).cast("double"), total("x"), total("y")]

    def of(part: Column) -> Column:
        zero = [F.lit(0.0)] * 3
        rows = [F.struct(*[v.alias(n) for n, v in zip(MEASURES, values, strict=True)]) for values in ([*zero, *zero, *points(part)], [*zero, *line(part), *points(part)], [*ring(part), *zero, *points(part)])]
        return F.when(part["kind"] == POINTS, rows[0]).when(part["kind"] == LINE, rows[1]).otherwise(rows[2])

    none = F.struct(*[F.lit(0.0).alias(n) for n in MEASURES])
    return F.aggregate(F.transform(parts(wkt), of), none, lambda a, b: F.struct(*[(a[n] + b[n]).alias(n) for n in MEASURES]))


def centre(sums: Column) -> Column:
    """The centroid ``x, y`` that ``MEASURES`` give: by area if there is one, else by length, else of the coordinates; else null."""
    at = lambda k: F.struct(*[(sums[f"{k}_{c}"] / sums[k]).alias(c) for c in ("x", "y")])
    return F.when(sums["area"] > 0, at("area")).when(sums["length"] > 0, at("length")).when(sums["points"] > 0, at("points"))


def centroid(wkt: Column) -> Column:
    """A shape's centroid ``x, y``, weighted by area or length; null without coordinates."""
    return centre(measures(wkt))
