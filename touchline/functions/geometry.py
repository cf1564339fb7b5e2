"""Boxes, distances and the pitch projection, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image corners of the pitch, and the homography that takes them to metres.
PITCH_CORNERS = [(110, 1035), (265, 275), (910, 260), (1640, 915)]
HOMOGRAPHY = [
    0.07506343019417587, 0.015308989052759557, -24.10178099096549,
    0.011404452102902233, 0.49039144042479504, -137.87982592408775,
    -5.982298801408521e-05, 0.004310560963302639, 1.0,
]


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def to_int(x: Column) -> Column:
    """Towards zero."""
    return x.cast("int")


def half_even(x: Column, digits: int) -> Column:
    """x rounded to so many digits, halves to the even one: the nearest whole number of x times a power of ten, in doubles as
    other engines do it; ``bround`` rounds the shortest decimal text of x, which lies beside a half where the product is one."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def center(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return to_int((c(x1) + c(x2)) / 2), to_int((c(y1) + c(y2)) / 2)


def foot(x1="x1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return to_int((c(x1) + c(x2)) / 2), to_int(c(y2))


def position(object_class: Column) -> tuple[Column, Column]:
    """The ball's centre; anything else's foot."""
    (cx, cy), (fx, fy) = center(), foot()
    ball = object_class == "ball"
    return F.when(ball, cx).otherwise(fx), F.when(ball, cy).otherwise(fy)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def in_pitch(x: Column, y: Column) -> Column:
    """Whether the point, cut to whole pixels, lies in the pitch or on its edge."""
    px, py = to_int(x), to_int(y)
    tests = [
        (bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0
        for (ax, ay), (bx, by) in zip(PITCH_CORNERS, PITCH_CORNERS[1:] + PITCH_CORNERS[:1], strict=True)
    ]
    return tests[0] & tests[1] & tests[2] & tests[3]


def project(x: Column, y: Column) -> tuple[Column, Column]:
    """Pitch metres of an image point; null outside the pitch."""
    h = [F.lit(v) for v in HOMOGRAPHY]
    w = h[6] * x + h[7] * y + h[8]
    inside = in_pitch(x, y)
    return F.when(inside, (h[0] * x + h[1] * y + h[2]) / w), F.when(inside, (h[3] * x + h[4] * y + h[5]) / w)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def player_crop(width: int, height: int) -> dict[str, Column]:
    """Box cut to the frame; too small a crop is not usable."""
    x1, x2 = clip(to_int(c("x1")), 0, width), clip(to_int(c("x2")), 0, width)
    y1, y2 = clip(to_int(c("y1")), 0, height), clip(to_int(c("y2")), 0, height)
    return {"px1": x1, "py1": y1, "px2": x2, "py2": y2, "p_ok": (y2 - y1 >= 40) & (x2 - x1 >= 20)}


def colour_crop(width: int, height: int) -> dict[str, Column]:
    """Upper half of the box."""
    x1, x2 = clip(to_int(c("x1")), 0, width), clip(to_int(c("x2")), 0, width)
    y1, y2 = clip(to_int(c("y1")), 0, height), clip(to_int(c("y2")), 0, height)
    return {"c_y2": y1 + to_int((y2 - y1) / 2), "c_ok": (y2 - y1 >= 4) & (x2 - x1 >= 4)}


def jersey_crop(width: int, height: int) -> dict[str, Column]:
    """The back of the shirt: 8 % off left, right and top, down to 67 % of the height."""
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    x1, x2 = clip(to_int(c("x1") + w * 0.08), 0, width), clip(to_int(c("x2") - w * 0.08), 0, width)
    y1, y2 = clip(to_int(c("y1") + h * 0.08), 0, height), clip(to_int(c("y1") + h * 0.67), 0, height)
    return {"jx1": x1, "jy1": y1, "jx2": x2, "jy2": y2, "j_ok": (y2 - y1 >= 24) & (x2 - x1 >= 16)}


def crop_quality(h: Column, w: Column, sharpness: Column, rear: Column) -> Column:
    raw = 0.45 * F.least(F.lit(1.0), h * w / 12000) + 0.35 * F.least(F.lit(1.0), sharpness / 180) + 0.20 * rear
    return half_even(clip(raw, 0.0, 1.0), 3)
