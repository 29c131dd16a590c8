"""Column functions on names, keys and clinical labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def slide_of(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def case_of(slide: Column) -> Column:
    return F.substring_index(slide, "_", 1)


def patient_of(slide: Column, length: int = 12) -> Column:
    return F.substring(slide, 1, length)


def sample_of(barcode: Column) -> Column:
    """The first four dash-separated parts of a barcode, without the last character."""
    four = F.substring_index(barcode, "-", 4)
    return F.left(four, F.length(four) - 1)


def tile_of(name: Column) -> Column:
    """struct(focus, x, y, w, h) of a tile's file name such as Focus2_10_20_256_256_image.png; missing parts are null."""
    full = "^(?:Focus(\\d+)_)?(\\d+)_(\\d+)(?:_(\\d+)_(\\d+))?"
    part = lambda k: F.nullif(F.regexp_extract(name, full, k), F.lit("")).cast("int")
    return F.struct(*(part(k + 1).alias(c) for k, c in enumerate(("focus", "x", "y", "w", "h"))))


def grade_group(primary: Column, secondary: Column, total: Column) -> Column:
    """low, 3+4, 4+3 or high; the pairs go before the total."""
    return F.when((primary == 3) & (secondary == 4), "3+4").when((primary == 4) & (secondary == 3), "4+3").when(total == 6, "low").otherwise("high")


def grade_text(primary: Column, secondary: Column, total: Column) -> Column:
    """The total if it is 6, 8, 9 or 10; else 3+4, 4+3 or NA."""
    return F.when(total.isin(6, 8, 9, 10), total.cast("string")).when((primary == 3) & (secondary == 4), "3+4").when((primary == 4) & (secondary == 3), "4+3").otherwise("NA")


def encode(label: Column, order: list[str]) -> Column:
    """The label's place in ``order``, null if it has none."""
    return F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in enumerate(order)))[label]


def yes(text: Column) -> Column:
    """TRUE, released → true; FALSE → false; else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "released"), True).when(t == "false", False)


def specimen(*parts: Column) -> Column:
    """Parts joined by colons; a null one is empty."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def clean_key(text: Column) -> Column:
    """A key safe for file names: dots, slashes, spaces and braces go."""
    return F.translate(text, "./ {}", "___")


def human_bytes(n: Column) -> Column:
    """A size in the largest unit (powers of 1024) that it reaches, with two decimals."""
    out = F.format_string("%.2fB", n.cast("double"))
    for k, unit in enumerate("KMGTPEZY", 1):
        out = F.when(F.abs(n) >= 1024.0**k, F.format_string(f"%.2f{unit}B", n / 1024.0**k)).otherwise(out)
    return out


#: Twelve colours for labels 0 to 11 (red, green, blue).
PALETTE = [
    (166, 206, 227), (31, 120, 180), (178, 223, 138), (51, 160, 44), (251, 154, 153), (227, 26, 28),
    (253, 191, 111), (255, 127, 0), (202, 178, 214), (106, 61, 154), (255, 255, 153), (177, 89, 40),
]


def colour(label: Column) -> Column:
    """struct(hue in whole degrees, lightness, saturation) of a label: from PALETTE, hashed beyond it."""
    rgb = F.get(F.array(*[F.array(*[F.lit(v / 255) for v in c]) for c in PALETTE]), label.cast("int"))
    hashed = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.pmod(F.xxhash64(label, k), F.lit(256)) / 255.0)
    c = F.when(label.between(0, len(PALETTE) - 1), rgb).otherwise(hashed)
    top, low = F.array_max(c), F.array_min(c)
    span, light = top - low, (top + low) / 2
    saturation = F.when(span == 0, 0.0).when(light <= 0.5, span / (top + low)).otherwise(span / (2 - top - low))
    turn = F.when(c[0] == top, (c[1] - c[2]) / span).when(c[1] == top, 2 + (c[2] - c[0]) / span).otherwise(4 + (c[0] - c[1]) / span)
    degrees = F.when(span == 0, 0).otherwise(F.floor(F.pmod(turn / 6, F.lit(1.0)) * 360 + 1e-9)).cast("int")
    return F.struct(degrees.alias("hue"), light.alias("lightness"), saturation.alias("saturation"))


def hue(label: Column, colours: int = 12) -> Column:
    """A stable hue in degrees: evenly spread for labels below ``colours``, hashed beyond."""
    spread = (label * F.lit(360.0 / colours)).cast("int")
    return F.when(label.between(0, colours - 1), spread).otherwise(F.pmod(F.xxhash64(label), F.lit(360)).cast("int"))


def argmax(values: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def run_key(params: Column) -> Column:
    """A map of parameters as name:value pairs in name order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def from_run_key(text: Column) -> Column:
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit(":")), lambda k, v: v.cast("double"))
