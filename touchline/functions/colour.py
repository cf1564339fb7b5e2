"""Colours: hex text, RGB, BGR, CIE Lab and team matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.geometry import half_even

MAX_DISTANCE = 62.0
MIN_SEPARATION = 10.0


def hex_to_rgb(text: Column) -> tuple[Column, Column, Column]:
    """Channels of '#RRGGBB' (the sign may be missing, white space around it is ignored); null for other texts."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    good = bare.rlike("^[0-9A-Fa-f]{6}$")
    return tuple(F.when(good, F.conv(F.substring(bare, k, 2), 16, 10).cast("int")) for k in (1, 3, 5))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("int")), 2, "0") for x in (r, g, b)])


def with_lab(df: DataFrame) -> DataFrame:
    """df with CIE Lab (l, a, lab_b, under D65) of its columns b, g, r, clipped to 0..255.

    Built in steps of columns, so that each power is written, and computed, once a row.
    """

    def linear(v: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)) / 255
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    c = F.col
    df = df.withColumns({f"__{k}": linear(c(k)) for k in "rgb"})
    df = df.withColumns(
        {
            "__x": (0.412453 * c("__r") + 0.357580 * c("__g") + 0.180423 * c("__b")) / 0.950456,
            "__y": 0.212671 * c("__r") + 0.715160 * c("__g") + 0.072169 * c("__b"),
            "__z": (0.019334 * c("__r") + 0.119193 * c("__g") + 0.950227 * c("__b")) / 1.088754,
        }
    )
    df = df.withColumns({f"__f{k}": f(c(f"__{k}")) for k in "xyz"})
    light = F.when(c("__y") > 0.008856, 116 * c("__fy") - 16).otherwise(903.3 * c("__y"))
    df = df.withColumns({"l": light, "a": 500 * (c("__fx") - c("__fy")), "lab_b": 200 * (c("__fy") - c("__fz"))})
    return df.drop(*[f"__{k}" for k in (*"rgbxyz", "fx", "fy", "fz")])


def lab_of(bgr: tuple[float, float, float]) -> tuple[float, float, float]:
    """Lab of one known colour, such as a team's kit."""
    linear = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in (min(max(v, 0.0), 255.0) / 255 for v in bgr)]
    lb, lg, lr = linear
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    return (116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y), 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def match_team(df: DataFrame, kits: dict[int, tuple[float, float, float]], most: float = MAX_DISTANCE, margin: float = MIN_SEPARATION) -> DataFrame:
    """df with team_id (0: unknown), confidence, distance and separation of its colour against two teams' BGR kits."""
    (one, kit1), (two, kit2) = sorted(kits.items())

    def away(kit: tuple[float, float, float]) -> Column:
        steps = [F.col(c) - F.lit(v) for c, v in zip(("l", "a", "lab_b"), lab_of(kit), strict=True)]
        return F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2])

    rows = with_lab(df).withColumns({"__d1": away(kit1), "__d2": away(kit2)}).drop("l", "a", "lab_b")
    rows = rows.withColumns({"__best": F.least("__d1", "__d2"), "__gap": F.abs(F.col("__d1") - F.col("__d2"))})
    best, gap = F.col("__best"), F.col("__gap")
    sure = 0.7 * F.greatest(F.lit(0.0), 1 - best / most) + 0.3 * F.least(F.lit(1.0), gap / max(2 * margin, 1.0))
    known = (best <= most) & (gap >= margin)
    return rows.withColumns(
        {
            "team_id": F.when(known, F.when(F.col("__d1") <= F.col("__d2"), one).otherwise(two)).otherwise(0),
            "confidence": half_even(sure, 3),
            "distance": F.round(best, 4),
            "separation": F.round(gap, 4),
        }
    ).drop("__d1", "__d2", "__best", "__gap")
