"""Column expressions for keys, statuses, geometry and slide properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.split_part(basename(path), F.lit("."), F.lit(1))


def without_suffix(name: Column, suffix: str) -> Column:
    """``name`` without ``suffix`` at its end, once; never a set of characters."""
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def key_prefix(key: Column, parts: int, by: str = "-") -> Column:
    return F.substring_index(key, by, parts)


def without_last(text: Column) -> Column:
    return F.left(text, F.greatest(F.length(text) - 1, F.lit(0)))


def split_right(text: Column, by: str = "-") -> tuple[Column, Column]:
    """What stands before and after the last ``by``."""
    pattern = f"(?s)^(.*){by}([^{by}]*)$"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def region_class(name: Column) -> tuple[Column, Column]:
    """(architecture, grade) of a region's name ``+architecture-grade``; nulls for ``+null`` and where there is no ``-`` or number."""
    before, after = split_right(name)
    known = (name != "+null") & name.contains("-")
    return F.when(known, F.substring(before, 2, 1 << 30)), F.when(known, after.try_cast("int"))


def largest_loop(xs: Column, ys: Column) -> Column:
    """A struct (xs, ys) of the corners of the loop with the largest area, the first of equal ones; nulls where either is null.

    A loop ends where its first corner comes again, which it includes; the next starts
    behind it, and corners that never close form the last one. Areas are those of closed
    rings. One fold over the corners carries the open loop's first corner and twice its signed area.
    """
    corners = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    nothing = F.struct(F.lit(-1.0).alias("area"), F.lit(0).alias("a"), F.lit(0).alias("n"))
    no = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("from"), *[no.alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0.0).alias("twice"), nothing.alias("best"))

    def larger(s: Column, twice: Column, n: Column) -> Column:
        area = F.abs(twice) / 2
        return F.when((area > s["best"]["area"]) & ~F.isnan(area), F.struct(area.alias("area"), s["from"].alias("a"), n.alias("n"))).otherwise(s["best"])

    def step(s: Column, p: Column) -> Column:
        opens, twice = p["i"] == s["from"], s["twice"] + (s["x1"] * p["y"] - p["x"] * s["y1"])
        first = F.struct(s["from"].alias("from"), p["x"].alias("x0"), p["y"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1"), F.lit(0.0).alias("twice"), s["best"].alias("best"))
        on = F.struct(s["from"].alias("from"), s["x0"].alias("x0"), s["y0"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1"), twice.alias("twice"), s["best"].alias("best"))
        n = p["i"] - s["from"] + 1
        closed = F.struct((p["i"] + 1).alias("from"), *[no.alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0.0).alias("twice"), larger(s, twice, n).alias("best"))
        same = (p["x"] == s["x0"]) & (p["y"] == s["y0"]) & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
        return F.when(opens, first).when(same, closed).otherwise(on)

    def finish(s: Column) -> Column:
        left = F.size(xs) - s["from"]
        return F.when(left > 0, larger(s, s["twice"] + (s["x1"] * s["y0"] - s["x0"] * s["y1"]), left)).otherwise(s["best"])

    known = xs.isNotNull() & ys.isNotNull()
    part = lambda b, v: F.when(known, F.slice(v, b["a"] + 1, b["n"]))
    best = F.array(F.aggregate(corners, start, step, finish))  # the fold runs once for both
    return F.get(F.transform(best, lambda b: F.struct(part(b, xs).alias("xs"), part(b, ys).alias("ys"))), F.lit(0))


def grade(text: Column) -> Column:
    """1 to 4 of G1 to G4, else null."""
    return F.when(text.rlike("^G[1-4]$"), F.substring(text, 2, 1).cast("int"))


def status_number(text: Column, by: str = ":") -> Column:
    """The integer before ``by``; null where there is none."""
    return F.split_part(text, F.lit(by), F.lit(1)).try_cast("int")


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    level = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")
    return F.format_string("#%02x%02x%02x", level(r), level(g), level(b))


def mapped(value: Column, names: dict) -> Column:
    """``names[value]``, null where there is none."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value]


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a ring given by its corners, without the first one repeated."""
    turned = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.abs(total(xs, turned(ys)) - total(ys, turned(xs))) / 2


def resolution_factor(props: Column, target: float = 0.5) -> Column:
    """round(target / mean of the properties whose name has 'mpp'); null where there is none."""
    values = F.map_values(F.map_filter(props, lambda k, v: F.lower(k).contains("mpp")))
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(values))
    return F.bround(F.try_divide(F.lit(target), mean)).cast("int")


def pyramid_level(downsamples: Column, factor: Column, tolerance: float = 0.025) -> Column:
    """(level, resize): the level within ``tolerance`` of ``factor``, else the last finer one, which needs a resize."""
    spots = F.transform(downsamples, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    near = F.filter(spots, lambda s: F.abs(s["d"] - factor) < tolerance)
    finer = F.filter(spots, lambda s: s["d"] < factor)
    best = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s["d"] - factor).alias("gap"), s["i"].alias("i"))))
    return F.when(F.size(near) > 0, F.struct(best["i"].alias("level"), F.lit(False).alias("resize"))).otherwise(
        F.struct(F.coalesce(F.try_element_at(finer, F.lit(-1))["i"], F.lit(0)).alias("level"), F.lit(True).alias("resize"))
    )


def optical_density(intensity: Column) -> Column:
    return F.greatest(-F.ln(F.greatest(intensity, F.lit(1)) / 255.0), F.lit(1e-6))


def intensity(density: Column) -> Column:
    """The whole intensity of an optical density, rounded down; densities are 1e-6 or more, so it is 254 at most."""
    return F.when(density.isNotNull(), F.floor(255 * F.exp(-F.greatest(density, F.lit(1e-6)))).cast("int"))


def inverted(m: Column) -> Column:
    """The map from values to keys; of keys with one value the last stays, and null values have no entry."""
    entries = F.map_entries(m)
    values = F.map_values(m)
    last = lambda e, i: e["value"].isNotNull() & ~F.exists(F.slice(values, i + 2, F.size(values)), lambda v: v.eqNullSafe(e["value"]))
    return F.map_from_entries(F.transform(F.filter(entries, last), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def text_of(content: Column) -> Column:
    """Text of UTF-8 bytes."""
    return F.decode(content, "UTF-8")


def first_preferred(items: Column, preferred: str) -> Column:
    """0-based place of the first item that contains ``preferred``, else 0; null for an empty array."""
    hits = F.filter(F.transform(items, lambda x, i: F.when(x.contains(preferred), i)), lambda i: i.isNotNull())
    return F.when(F.size(items) > 0, F.coalesce(F.get(hits, 0), F.lit(0)))
