"""Colour spaces and spectral indices as expressions over columns r, g, b in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees 0..360, saturation and value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.when(turn < 0, turn + 360).otherwise(turn))
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(span / top), top


def _linear(x: Column) -> Column:
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65 of sRGB."""
    r, g, b = map(_linear, (r, g, b))
    x, y, z = (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456, r * 0.212671 + g * 0.715160 + b * 0.072169, (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116)

    return F.when(y > 0.008856, F.lit(116.0) * F.cbrt(y) - 16).otherwise(y * 903.3), F.lit(500.0) * (f(x) - f(y)), F.lit(200.0) * (f(y) - f(z))


def vegetation(r: Column, g: Column) -> Column:
    return (g - r) / (g + r + F.lit(1e-6))


def asphalt_score(r: Column, g: Column, b: Column) -> Column:
    """High where there is neither green nor colour, 0 in the dark."""
    _, s, _ = hsv(r, g, b)
    score = F.lit(1.0) - (F.lit(2.5) * vegetation(r, g) + F.lit(1.2) * s)
    return F.when(gray(r, g, b) > 0.2, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def spectral_mask(r: Column, g: Column, b: Column) -> Column:
    """Little colour, neither dark nor glaring."""
    _, s, v = hsv(r, g, b)
    return (s < 0.28) & (v > 0.18) & (v < 0.94)


def yellow(r: Column, g: Column, b: Column) -> Column:
    """A range of hue, saturation and value (annotation colour)."""
    h, s, v = hsv(r, g, b)
    return h.between(40, 70) & (s >= 0.4) & (v >= 0.4)


def hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179, saturation and value 0..255 of bands 0..255, rounded as whole bytes."""
    h, s, v = hsv(r / 255.0, g / 255.0, b / 255.0)
    return F.pmod(F.round(h / 2), F.lit(180.0)), F.round(s * 255), F.round(v * 255)


def lab8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L scaled to 0..255, a and b shifted by 128, of bands 0..255, rounded as whole bytes."""
    light, a, bb = lab(r / 255.0, g / 255.0, b / 255.0)
    return F.round(light * 255 / 100), F.round(a + 128), F.round(bb + 128)


def from_lab(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB in 0..1 of CIE L*a*b* under D65."""
    fy = (light + 16) / 116.0

    def back(t: Column) -> Column:
        return F.when(t > 6 / 29, t * t * t).otherwise((t - 16.0 / 116) / 7.787)

    x, y, z = back(fy + a / 500.0) * 0.950456, back(fy), back(fy - b / 200.0) * 1.088754
    linear = (x * 3.240479 - y * 1.537150 - z * 0.498535, -x * 0.969256 + y * 1.875992 + z * 0.041556, x * 0.055648 - y * 0.204043 + z * 1.057311)

    def gamma(v: Column) -> Column:
        return F.when(v > 0.0031308, F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(v * 12.92)

    return tuple(F.least(F.greatest(gamma(v), F.lit(0.0)), F.lit(1.0)) for v in linear)


def asphalt_hsv(s: Column, v: Column) -> Column:
    """Little saturation and medium value, in bytes."""
    return (s < 60) & (v > 40) & (v < 160)


def asphalt_lab(light: Column, a: Column, b: Column) -> Column:
    """Nearly neutral and of medium lightness, in bytes."""
    return (F.abs(a - 128) < 12) & (F.abs(b - 128) < 12) & (light > 50) & (light < 180)
