"""Row-level expressions of the quality engine: Column in, Column out, no I/O and no Python on the rows.

Conventions: coordinates are ``array<double>`` x1, y1, x2, y2, ...; a "soft" coordinate is outside [0, 1] but within [-0.01, 1.01], a "hard" one is
beyond that or not a number (NaN and infinities are hard everywhere).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerance of soft coordinates, area limits of small and medium objects in square pixels.
SOFT_LOW, SOFT_HIGH = -0.01, 1.01
SMALL_AREA, MEDIUM_AREA = 1024.0, 9216.0
#: Line ends of a label file; a file may mix them.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it. Unlike a step of its own it leaves columns that nobody asks for to be pruned."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def sample_key(path: Column) -> Column:
    """Path without its last suffix, with forward slashes, in lower case: the key that pairs an image with its label."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/])\.[^./]+$", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def numbered_lines(text: Column) -> Column:
    """``array<struct<line_no, raw>>`` of the lines that are not blank; numbers count blank lines too."""
    lines = F.transform(F.split(text, LINE_END, -1), lambda raw, i: F.struct((i + 1).cast("int").alias("line_no"), raw.alias("raw")))
    return F.filter(lines, lambda x: F.trim(F.regexp_replace(x["raw"], r"\s", "")) != "")


def tokens(raw: Column) -> Column:
    """White-space separated tokens; none for a blank line."""
    return F.filter(F.split(raw, r"\s+"), lambda t: t != "")


def number(token: Column) -> Column:
    """The token as a double, null if it isn't one. Forms that only some parsers take (1d, 1f, 1_0, 0x1) are not numbers."""
    return let(token, lambda t: F.when(t.rlike(_NUMBER), t.try_cast("double")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def integral_class(token: Column) -> Column:
    """The class id, null if the token is not numeric, not integral or negative."""
    return let(number(token), lambda v: F.when(finite(v) & (v == F.floor(v)) & (v >= 0) & (v < 2147483648.0), v.cast("int")))


def line_class(raw: Column) -> Column:
    """``integral_class`` of a line's first token, without parsing the rest."""
    return integral_class(F.regexp_extract(raw, r"(\S+)", 1))


def inside(x: Column) -> Column:
    return finite(x) & (x >= 0) & (x <= 1)


def within_tolerance(x: Column) -> Column:
    return finite(x) & (x >= SOFT_LOW) & (x <= SOFT_HIGH)


def clamp01(x: Column) -> Column:
    """To [0, 1]; NaN to 0."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def overflow(x: Column) -> Column:
    """Distance to [0, 1]."""
    return F.greatest(-x, x - 1.0, F.lit(0.0))


def points(coords: Column) -> Column:
    """``array<struct<x, y>>`` of the whole pairs."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(coords) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(coords, i * 2).alias("x"), F.get(coords, i * 2 + 1).alias("y")))


def evens(coords: Column) -> Column:
    return F.filter(coords, lambda v, i: i % 2 == 0)


def odds(coords: Column) -> Column:
    return F.filter(coords, lambda v, i: i % 2 == 1)


def signed_area(coords: Column) -> Column:
    """Shoelace area; positive is clockwise when y points down."""
    n = F.floor(F.size(coords) / 2).cast("int")
    terms = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(coords, i * 2) * F.get(coords, ((i + 1) % n) * 2 + 1) - F.get(coords, ((i + 1) % n) * 2) * F.get(coords, i * 2 + 1))
    return F.when(n < 1, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2.0)


def area(coords: Column) -> Column:
    return F.abs(signed_area(coords))


def distinct_points(coords: Column) -> Column:
    """Number of different points."""
    return F.size(F.array_distinct(points(coords)))


def dedup_points(coords: Column, digits: int = 12) -> Column:
    """Points rounded to ``digits``, each once, in the order of their first places."""
    rounded = F.transform(points(coords), lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return F.array_distinct(rounded)


def bounds(coords: Column) -> Column:
    xs, ys = evens(coords), odds(coords)
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def size_bucket(area_px: Column) -> Column:
    return F.when(area_px < SMALL_AREA, "small").when(area_px < MEDIUM_AREA, "medium").otherwise("large")


def geometry(coords: Column, width: Column, height: Column) -> Column:
    """Box and mask sizes of a polygon, in pixels and as shares of the image, and its size bucket by box area."""
    b = bounds(coords)
    w, h = (b["x_max"] - b["x_min"]) * width, (b["y_max"] - b["y_min"]) * height
    mask = area(coords)
    return F.struct(
        w.alias("bbox_width_px"), h.alias("bbox_height_px"), (w * h).alias("bbox_area_px"),
        ((b["x_max"] - b["x_min"]) * (b["y_max"] - b["y_min"])).alias("bbox_area_relative"),
        (mask * width * height).alias("mask_area_px"), mask.alias("mask_area_relative"),
        size_bucket(w * h).alias("size"),
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height != 0, width / height).otherwise(F.lit(0.0))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once. A plain projection would be merged into the next one, and a costly expression repeated at each of its
    uses; a generator of one row is not."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _parsed(raw: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a line's ``head`` token, its number of tokens ``size``, the ``rest`` of them, their ``coords``, and ``used``, those clamped."""

    def of_tokens(t: Column) -> Column:
        return F.struct(F.get(t, F.lit(0)).alias("head"), F.size(t).alias("size"), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("rest"))

    def with_coords(x: Column) -> Column:
        return let(F.transform(x["rest"], number), lambda c: F.struct(x["head"].alias("head"), x["size"].alias("size"), x["rest"].alias("rest"), c.alias("coords"), F.transform(c, clamp01).alias("used"), F.exists(c, lambda v: v.isNull()).alias("null"), integral_class(x["head"]).alias("cls")))

    return let(let(let(tokens(raw), of_tokens), with_coords), f)


def _first_point(coords: Column, ok: Callable[[Column], Column]) -> Column:
    """Number of the first point with a coordinate that isn't ``ok``, 0 if there is none."""
    return F.floor((F.array_position(F.transform(coords, ok), False) + 1) / 2).cast("long")


def validate_lines(lines: DataFrame, num_classes: int | None = None, mode: str = "strict", raw: str = "raw") -> DataFrame:
    """``lines`` with ``error_type, message, fixed_line, fixed_points, max_offset``: the first fault of each polygon label line.

    Order: polygon_format (no token), class_id, polygon_non_numeric, bbox_format (exactly four coordinates), polygon_coordinate_count (odd, or under
    three points), polygon_coordinate_range (a point beyond the tolerance; in mode ``strict`` any point outside [0, 1]), polygon_geometry (under three
    distinct points). In other modes soft points are clamped: only clamped tokens are rewritten, as 0 or 1, and points and offset are reported.
    """
    strict = mode == "strict"

    def checked(x: Column) -> Column:
        n = F.size(x["rest"])
        bad_class = x["cls"].isNull() if num_classes is None else x["cls"].isNull() | (x["cls"] >= num_classes)
        soft = _first_point(x["coords"], inside)
        early = (
            F.when(x["size"] == 0, "polygon_format").when(bad_class, "class_id").when(x["null"], "polygon_non_numeric").when(n == 4, "bbox_format")
            .when((n % 2 == 1) | (n < 6), "polygon_coordinate_count")
        )
        return let(F.struct(early.alias("early"), F.when(early.isNull(), soft).alias("soft")), lambda y: let(y_error(x, y), lambda z: outcome(x, y, z)))

    def y_error(x: Column, y: Column) -> Column:
        hard = F.when(y["soft"] > 0, _first_point(x["coords"], within_tolerance)).otherwise(F.lit(0).cast("long"))
        late = lambda h: F.when(h > 0, "polygon_coordinate_range").when(F.lit(strict) & (y["soft"] > 0), "polygon_coordinate_range").when(distinct_points(x["used"]) < 3, "polygon_geometry")
        return let(hard, lambda h: F.struct(h.alias("hard"), F.coalesce(y["early"], late(h)).alias("error")))

    def outcome(x: Column, y: Column, z: Column) -> Column:
        message = F.when(z["error"] == "class_id", x["head"]).when(z["error"] == "polygon_coordinate_count", F.size(x["rest"]).cast("string")).when(z["error"] == "polygon_coordinate_range", F.concat(F.lit("point "), F.when(z["hard"] > 0, z["hard"]).otherwise(y["soft"]).cast("string")))
        fixed = z["error"].isNull() & (y["soft"] > 0)
        rewritten = F.zip_with(x["rest"], x["coords"], lambda s, v: F.when(inside(v), s).when(v < 0, "0").otherwise("1"))
        return F.struct(
            z["error"].alias("error_type"), message.alias("message"), F.when(fixed, F.concat_ws(" ", x["head"], F.array_join(rewritten, " "))).alias("fixed_line"),
            F.when(fixed, F.size(F.filter(points(x["coords"]), lambda q: ~(inside(q["x"]) & inside(q["y"]))))).alias("fixed_points"), F.when(fixed, F.array_max(F.transform(x["coords"], overflow))).alias("max_offset"),
        )

    names = ("error_type", "message", "fixed_line", "fixed_points", "max_offset")
    own = [c for c in lines.columns if c not in names]
    return lines.select(*own, _parsed(F.col(raw), checked).alias("_v")).select(*own, *(F.col(f"_v.{c}").alias(c) for c in names))


def parse_instances(lines: DataFrame, class_ids: list[int], raw: str = "raw", values: str | None = None, mask: str | None = None) -> DataFrame:
    """``lines`` with ``class_id, coords, geometry_status, hard_error, soft_error``: label lines for the statistics.

    The class counts before the coordinates are looked at, and is read on its own: counts of classes parse no coordinates. A line has at most two errors: a
    soft range error, and then the geometry that clamping leaves. ``geometry_status`` is valid, soft_clipped or null; ``coords`` are the clamped ones. ``values`` names a column for
    the coordinates as written, of lines whose coordinates were looked at, and ``mask`` one for the polygon's area as a share of the image; null for the others.
    """

    def known(c: Column) -> Column:
        return F.coalesce(c.isin(*class_ids), F.lit(False))

    def checked(x: Column) -> Column:
        early = F.when(~known(x["cls"]), "class_id").when((x["size"] < 7) | (F.size(x["coords"]) % 2 == 1), "polygon_coordinate_count").when(x["null"], "polygon_coordinate_value")
        outside = F.exists(x["coords"], lambda v: ~inside(v))
        return let(F.struct(early.alias("early"), F.when(early.isNull(), outside).otherwise(F.lit(False)).alias("outside")), lambda y: let(y_error(x, y), lambda z: outcome(x, y, z)))

    def y_error(x: Column, y: Column) -> Column:
        # fewer than three different points have no area either, exactly: their edges cancel in pairs
        late = lambda a: F.when(y["outside"] & ~F.forall(x["coords"], within_tolerance), "polygon_coordinate_range").when(a <= 0, "polygon_geometry")
        return let(F.when(y["early"].isNull(), area(x["used"])), lambda a: F.struct(F.coalesce(y["early"], late(a)).alias("error"), a.alias("area")))

    def outcome(x: Column, y: Column, z: Column) -> Column:
        e = z["error"]
        ok = e.isNull()
        more = [F.when(y["early"].isNull(), x["coords"]).alias(values)] if values else []
        more += [F.when(ok, z["area"]).alias(mask)] if mask else []
        return F.struct(
            F.when(ok, x["used"]).alias("coords"), F.when(ok, F.when(y["outside"], "soft_clipped").otherwise("valid")).alias("geometry_status"), e.alias("hard_error"),
            F.when(ok | (e == "polygon_geometry"), y["outside"]).otherwise(F.lit(False)).alias("soft_error"), *more,
        )

    names = ("coords", "geometry_status", "hard_error", "soft_error", *(c for c in (values, mask) if c))
    own = [c for c in lines.columns if c not in (*names, "class_id")]
    cls = let(line_class(F.col(raw)), lambda c: F.when(known(c), c))
    return lines.select(*own, cls.alias("class_id"), _parsed(F.col(raw), checked).alias("_v")).select(*own, "class_id", *(F.col(f"_v.{c}").alias(c) for c in names))


def line_span(raw: Column) -> Column:
    """Least and greatest coordinate of a line as written and its largest overflow, for the record of an error: ``low, high, most``. Tokens that are no numbers are left out."""
    return let(F.transform(tokens(raw), number), lambda c: let(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"), F.array_max(F.transform(v, overflow)).alias("most"))))


def coordinate_issues(coords: Column) -> Column:
    """One struct for each coordinate outside [0, 1] of a line whose coordinates are all numbers."""
    line_soft = F.forall(coords, within_tolerance)

    def issue(v: Column, i: Column) -> Column:
        axis = F.when(i % 2 == 0, "x").otherwise("y")
        low = ~F.isnan(v) & (v < 0)
        soft = within_tolerance(v)
        point = (F.floor(i / 2) + 1).cast("int")
        return F.struct(
            point.alias("point_index"), axis.alias("axis"), F.concat(F.lit("point_"), point.cast("string"), F.lit("_"), axis).alias("position"), v.alias("value"),
            F.when(low, 0).otherwise(1).alias("boundary"), F.when(low, "below").otherwise("above").alias("direction"), overflow(v).alias("amount"),
            F.when(soft, "soft").otherwise("hard").alias("coordinate_severity"), F.when(line_soft, "soft").otherwise("hard").alias("line_severity"),
            F.when(line_soft, clamp01(v)).alias("reset_value"), F.when(line_soft, "clip").otherwise("review").alias("action"),
        )

    return F.filter(F.transform(coords, lambda v, i: F.when(~inside(v), issue(v, i))), lambda x: x.isNotNull())


def obb_error(raw: Column, num_classes: int = 15, min_area: float = 1e-8) -> Column:
    """The first fault of an oriented-box line (class and four corners), null if it has none."""
    t = tokens(raw)
    cls, coords = number(F.get(t, F.lit(0))), F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), number)
    p = points(coords)
    rounded = F.array_distinct(F.transform(p, lambda q: F.struct(F.round(q["x"], 12), F.round(q["y"], 12))))
    first = F.array_min(F.transform(p, lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x"))))
    start = F.get(p, F.lit(0))
    return (
        F.when(F.size(t) != 9, "obb_field_count")
        .when(~F.coalesce(finite(cls), F.lit(False)), "obb_numeric_format")
        .when((cls != F.floor(cls)) | (cls < 0) | (cls >= num_classes), "obb_class_id")
        .when(F.exists(coords, lambda v: ~F.coalesce(finite(v), F.lit(False))), "obb_numeric_format")
        .when(F.exists(coords, lambda v: (v < 0) | (v > 1)), "obb_coordinate_range")
        .when(F.size(rounded) < 4, "obb_duplicate_points")
        .when(area(coords) <= min_area, "obb_area_too_small")
        .when(signed_area(coords) <= 0, "obb_point_order")
        .when((first["y"] != start["y"]) | (first["x"] != start["x"]), "obb_point_order")
    )


def light_class(raw: Column) -> Column:
    """Class of a ground-truth line with three tokens at least; null for lines to skip."""
    t = tokens(raw)
    return F.when((F.size(t) >= 3) & F.get(t, F.lit(0)).rlike(r"^[+-]?\d+$"), F.get(t, F.lit(0)).try_cast("int"))


def class_group(name: Column) -> Column:
    """What stands before ``--``; a name without it is its own group."""
    return F.substring_index(name, "--", 1)


def class_label(name: Column, class_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("unknown_"), class_id.cast("string")))


def capture_key(stem: Column) -> Column:
    """Text before the five-digit frame number of a file stem, ``unparsed`` without one."""
    key = F.regexp_replace(F.regexp_extract(stem, r"(?i)^(.*?)-?DSC(\d{5})", 1), "-+$", "")
    return F.when(stem.rlike(r"(?i)^.*?-?DSC\d{5}"), key).otherwise("unparsed")


def frame_number(stem: Column) -> Column:
    return F.regexp_extract(stem, r"(?i)^(.*?)-?DSC(\d{5})", 2).try_cast("int")


def difference_hash(grid: Column, rows: int = 8, columns: int = 9) -> Column:
    """64 bits, most significant first: whether each cell of a grid is greater than its right neighbour."""
    bits = [F.when(F.get(grid, F.lit(r * columns + c)) > F.get(grid, F.lit(r * columns + c + 1)), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for r in range(rows) for c in range(columns - 1)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(b, len(bits) - 1 - k) for k, b in enumerate(bits)])


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hash_chunks(h: Column, chunks: int = 4, bits: int = 16) -> Column:
    """``array<struct<chunk_index, chunk>>``, from the low end."""
    return F.array(*(F.struct(F.lit(k).alias("chunk_index"), F.shiftrightunsigned(h, bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("chunk")) for k in range(chunks)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fps(milliseconds: Column) -> Column:
    return F.when(milliseconds > 0, 1000.0 / milliseconds).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall != 0, 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def tolerant_float(text: Column) -> Column:
    return F.coalesce(number(F.trim(text)), F.lit(float("nan")))


def format_number(x: Column) -> Column:
    """Eight decimals without closing zeros."""
    return F.regexp_replace(F.format_string("%.8f", x), r"\.?0+$", "")


def corner_order(corners: Column, tolerance: float = 1e-9) -> Column:
    """Points clockwise (y down) about their centre, starting at the top-most, of equal ones the left-most."""

    def centre(c: Column) -> Column:
        mean = lambda axis: F.aggregate(c, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(c)
        return F.struct(mean("x").alias("x"), mean("y").alias("y"))

    def turned(c: Column, m: Column) -> Column:
        return F.array_sort(F.transform(c, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("angle"), p["x"].alias("x"), p["y"].alias("y"))))

    def from_top(t: Column, top: Column) -> Column:
        left = F.array_min(F.transform(F.filter(t, lambda p: p["y"] <= top + tolerance), lambda p: p["x"]))
        start = let(left, lambda x: F.array_position(F.transform(t, lambda p: (p["y"] <= top + tolerance) & (p["x"] <= x + tolerance)), True).cast("int"))
        return let(start, lambda k: F.concat(F.slice(t, k, F.size(t)), F.slice(t, F.lit(1), F.greatest(k - 1, F.lit(0)))))

    ring = let(corners, lambda c: let(centre(c), lambda m: let(turned(c, m), lambda t: let(F.array_min(F.transform(t, lambda p: p["y"])), lambda top: from_top(t, top)))))
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def to_pixels(coords: Column, width: Column, height: Column) -> Column:
    return F.transform(coords, lambda v, i: F.rint(clamp01(v) * F.when(i % 2 == 0, width - 1).otherwise(height - 1)).cast("int"))


# Least padding in pixels to the sides and above and below, padding as a share of the polygon, least window side.
PAD_X, PAD_Y, PAD_SHARE, LEAST_SIDE = 180, 140, 0.35, 32


def crop_window(coords: Column, width: Column, height: Column) -> Column:
    """Pixel window around a polygon, padded and kept inside the image; the whole image if the window would be too small."""
    b = bounds(F.transform(coords, clamp01))

    def axis(low: Column, high: Column, size: Column, pad: int) -> tuple[Column, Column]:
        margin = F.greatest(F.lit(float(pad)), (high - low) * size * PAD_SHARE)
        return F.greatest(F.lit(0), (low * size - margin).cast("int")), F.least(size.cast("int"), (high * size + margin).cast("int"))

    (left, right), (top, bottom) = axis(b["x_min"], b["x_max"], width, PAD_X), axis(b["y_min"], b["y_max"], height, PAD_Y)
    tiny = (right - left < LEAST_SIDE) | (bottom - top < LEAST_SIDE)
    whole = {"left": F.lit(0), "top": F.lit(0), "right": width.cast("int"), "bottom": height.cast("int")}
    return F.struct(*(F.when(tiny, whole[k]).otherwise(v).alias(k) for k, v in (("left", left), ("top", top), ("right", right), ("bottom", bottom))))


def decision_status(action: Column) -> Column:
    """kept, kept_negative (label emptied) or dropped."""
    return F.when(action.isin("exclude", "review"), "dropped").when(action == "keep_negative", "kept_negative").otherwise("kept")


def bin_number(x: Column, edges: list[float]) -> Column:
    """Number of edges not over ``x``: left-closed bins, 0 below the first edge."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= x))


def mean_or_zero(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)).otherwise(F.lit(0.0))
