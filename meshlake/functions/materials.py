"""Compositions, units, colours and labels of materials, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units offered for a property, by a part of its name.
UNITS = (("temperature", ["°C", "K", "°F"]), ("density", ["g/cm³", "kg/m³"]), ("modulus", ["GPa", "MPa", "Pa"]), ("ratio", ["-"]), ("composition", ["-"]))
EMPTY = "map<string,double>"


def bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _pairs(text: Column) -> Column:
    """Structs (k, v) of the parts of "a:1,b:2"; v is NULL where it isn't a number."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.btrim(F.split_part(p, F.lit(":"), F.lit(1))).alias("k"), F.btrim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("double").alias("v"), F.contains(p, F.lit(":")).alias("named")))


def as_map(pairs: Column) -> Column:
    """Of pairs with the same key the last one holds."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p.k, p.v)))


def parsed(text: Column) -> Column:
    """A composition from "PLA:0.2,ABS:0.8" or a bare name; parts that can't be read are left out, and nothing is NULL."""

    def read(pairs: Column) -> Column:
        good = F.filter(pairs, lambda p: p.named & p.v.isNotNull() & (p.k != ""))
        return F.when(F.size(good) > 0, bound(good, as_map))

    trimmed = F.btrim(text)
    named = F.contains(trimmed, F.lit(":"))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(None).cast(EMPTY)).when(named, bound(_pairs(trimmed), read)).otherwise(F.create_map(trimmed, F.lit(1.0)))


def number(v: Column) -> Column:
    """Up to six significant digits, without trailing zeros."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-300))))).cast("int")
    scaled = F.round(v * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    fixed = F.format_string("%.10f", scaled)
    return F.when(v == 0, F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ""))


def entries(composition: Column) -> Column:
    return F.array_sort(F.map_entries(composition))


def formatted(composition: Column) -> Column:
    """"ABS:0.8,PLA:0.2": sorted by name."""
    return F.array_join(F.transform(entries(composition), lambda e: F.concat(e.key, F.lit(":"), number(e.value))), ",")


def display_name(composition: Column, suffix: Column | None = None) -> Column:
    """"ABS:800_PLA:200", in thousandths, and _suffix."""
    name = F.array_join(F.transform(entries(composition), lambda e: F.concat(e.key, F.lit(":"), F.rint(e.value * 1000).cast("int").cast("string"))), "_")
    return name if suffix is None else F.when(suffix.isNull() | (suffix == ""), name).otherwise(F.concat(name, F.lit("_"), suffix))


def valid(composition: Column, eps: float = 1e-6) -> Column:
    """Each share within [0, 1] and their sum 1, to eps."""
    values = F.map_values(composition)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: (v >= -eps) & (v <= 1 + eps)) & (F.abs(total - 1) <= eps), F.lit(False))


def checked(composition: Column, eps: float = 1e-6) -> Column:
    """The composition, or an error where it isn't valid."""
    return F.when(valid(composition, eps), composition).otherwise(F.raise_error(F.lit("shares must be within 0 and 1 and sum to 1")))


def edited(pairs: Column, default: str = "PLA", eps: float = 1e-6) -> Column:
    """From an editor's rows (name, ratio): ratios that can't be read are 0, rows of one name are summed, nothing at all is
    all of the default, and a sum other than 1 is NULL."""
    clean = F.transform(F.filter(pairs, lambda p: F.btrim(p["name"]) != ""), lambda p: F.struct(F.btrim(p["name"]).alias("k"), F.coalesce(p["ratio"].try_cast("double"), F.lit(0.0)).alias("v")))

    def summed(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda r: r.k))
        sums = F.transform(names, lambda n: F.struct(n.alias("k"), F.aggregate(F.filter(rows, lambda r: r.k == n), F.lit(0.0), lambda a, r: a + r.v).alias("v")))
        return bound(sums, lambda s: F.when(F.abs(F.aggregate(s, F.lit(0.0), lambda a, r: a + r.v) - 1) <= eps, F.map_from_entries(s)))

    return bound(clean, lambda rows: F.when(F.size(rows) == 0, F.create_map(F.lit(default), F.lit(1.0))).otherwise(summed(rows)))


def strict_label(text: Column) -> Column:
    """The formatted composition; the text itself if any part of it can't be read."""
    pairs = _pairs(text)
    good = F.forall(pairs, lambda p: p.named & p.v.isNotNull() & (p.k != ""))
    return F.when(text.isNull() | ~F.contains(text, F.lit(":")) | ~good, text).otherwise(formatted(bound(pairs, as_map)))


def units(name: Column) -> Column:
    chosen = F
    for part, offered in UNITS:
        chosen = chosen.when(F.contains(F.lower(name), F.lit(part)), F.array(*map(F.lit, offered)))
    return chosen.otherwise(F.array(F.lit("-")))


def ids(values: Column) -> Column:
    """Object ids from strings: what isn't a whole number goes, the first of each stays, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: v.try_cast("int")), lambda v: v.isNotNull()))


def include_exclude(neighbours: Column, include: Column, exclude: Column, least: int = 2) -> Column:
    """include and exclude among the neighbours; no include means all, exclude loses what is included, and fewer than least
    includes become the first neighbours."""
    wanted = F.when(include.isNull() | (F.size(include) == 0), neighbours).otherwise(F.array_intersect(include, neighbours))
    return bound(wanted, lambda w: bound(F.when(F.size(w) >= least, w).otherwise(F.slice(neighbours, 1, least)), lambda i: F.struct(i.alias("include"), F.array_except(F.array_intersect(exclude, neighbours), i).alias("exclude"))))


def position_key(text: Column) -> Column:
    """A layer number, or a point of three numbers from a list or from an object with x, y, z in either case."""
    low = F.lower(text)
    axis = lambda c: F.regexp_extract(low, rf'"{c}"\s*:\s*(-?[0-9.]+)', 1).try_cast("double")
    flat = F.transform(F.split(F.regexp_replace(F.regexp_replace(low, r'^\s*\{\s*"xyz"\s*:', ""), r"[\[\](){}\s]", ""), ","), lambda v: v.try_cast("double"))
    point = lambda x, y, z: F.struct(F.lit(None).cast("long").alias("layer"), x.alias("x"), y.alias("y"), z.alias("z"))
    none = F.lit(None).cast("double")
    layer = F.struct(text.try_cast("long").alias("layer"), none.alias("x"), none.alias("y"), none.alias("z"))
    return F.when(text.try_cast("long").isNotNull(), layer).when(axis("x").isNotNull(), point(axis("x"), axis("y"), axis("z"))).when((F.size(flat) == 3) & F.forall(flat, lambda v: v.isNotNull()), point(flat[0], flat[1], flat[2]))


def rgb(hex_colour: Column) -> Column:
    """Shares of red, green and blue from "#rrggbb"; grey where it can't be read."""
    good = hex_colour.rlike("^#[0-9A-Fa-f]{6}$")
    part = lambda k: F.when(good, F.conv(F.substring(hex_colour, 2 + 2 * k, 2), 16, 10).cast("double") / 255).otherwise(0.5)
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def hsl(colour: Column) -> Column:
    """Hue in degrees, saturation and lightness of a struct r, g, b."""

    def made(c: Column) -> Column:
        hi, lo = F.greatest(c.r, c.g, c.b), F.least(c.r, c.g, c.b)
        d, light = hi - lo, (hi + lo) / 2
        hue = F.when(d == 0, 0.0).when(hi == c.r, F.pmod(60 * (c.g - c.b) / d, F.lit(360.0))).when(hi == c.g, 60 * (c.b - c.r) / d + 120).otherwise(60 * (c.r - c.g) / d + 240)
        return F.struct(hue.alias("h"), F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))).alias("s"), light.alias("l"))

    return bound(colour, made)


def byte_size(n: Column) -> Column:
    step = lambda k, unit: F.concat(F.format_number(n / 1024**k, 2), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def identity(*columns: str) -> Column:
    """A material's identity: the hash of its columns as JSON, in the order of their names, without NULLs."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def plain(v: Column) -> Column:
    """A number for hashing: NaN and infinities are NULL, and -0 is 0."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(v + F.lit(0.0))
