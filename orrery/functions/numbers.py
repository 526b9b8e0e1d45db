"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(c, lit(low)), lit(high))


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a * (1 - f) + b * f


def cauchy(d2: Column) -> Column:
    """Student-t similarity of a squared distance."""
    return 1 / (1 + d2)


def nice_interval(low: Column, high: Column, n: int) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten that cuts the range into about n parts."""
    rough = (high - low) / n
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    part = rough / power
    return F.when(part < 1.5, 1.0).when(part < 3, 2.0).when(part < 7, 5.0).otherwise(10.0) * power


def bit_reverse(n: Column, bits: int) -> Column:
    """The low bits in the opposite order."""
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long")


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text."""
    return F.format_string(f"%.{digits}f", c)


def with_phong(df: DataFrame, colour: list[float], normal: list[Column], light: list[Column], view: list[Column], ambient: float, diffuse: float, specular: float, power: int, tinted: bool = False, two_sided: bool = True, dark: float | None = None) -> DataFrame:
    """df with Phong colours r, g, b by (unnormalised) normal, light and view vectors; all other columns stay.

    two_sided turns the normal to the light; tinted multiplies the highlight by the colour; a normal of no length gives ambient light only, or dark.
    Lengths and products are columns of their own on the way, so that no expression is written out many times.
    """
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    cols = df.columns
    step = df.select("*", *(c.alias(f"{n}{k}__") for n, v in (("n", normal), ("l", light), ("v", view)) for k, c in enumerate(v)))
    vec = {n: [F.col(f"{n}{k}__") for k in range(3)] for n in "nlv"}
    step = step.withColumns({f"{n}__": F.sqrt(dot(v, v)) for n, v in vec.items()})
    step = step.withColumns({f"{a}{b}__": dot(vec[a], vec[b]) / F.nullif(F.col(f"{a}__") * F.col(f"{b}__"), F.lit(0.0)) for a, b in ("nl", "nv", "lv")})
    side = F.when(F.col("nl__") < 0, -1.0).otherwise(1.0) if two_sided else F.lit(1.0)
    # the mirrored light is 2 (n l) n - l, so its product with the view is 2 (n l) (n v) - (l v), whichever way the normal points
    step = step.withColumns({"cos__": F.greatest(F.col("nl__") * side, F.lit(0.0)), "high__": F.pow(F.greatest(2 * F.col("nl__") * F.col("nv__") - F.col("lv__"), F.lit(0.0)), F.lit(float(power)))})
    channel = lambda c: F.when(F.col("n__") < 1e-6, F.lit(ambient * c if dark is None else dark)).otherwise(clamp(F.lit(ambient * c) + diffuse * c * F.col("cos__") + specular * (c if tinted else 1.0) * F.col("high__"), 0.0, 1.0))
    return step.select(*cols, *(channel(c).alias(n) for c, n in zip(colour, "rgb", strict=True)))
