"""Colour expressions: sRGB, CIE Lab (D65), CIEDE2000 after Sharma, Wu and Dalal, HSL and OKLab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sRGB matrix and the D65 white.
SRGB = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
#: OKLab's two matrices.
OK_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OK_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)


def _times(matrix, v: list[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix]


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.pow(t, 1 / 3)).otherwise((24389 / 27 * t + 16) / 116)

    x, y, z = (f(v / w) for v, w in zip(_times(SRGB, [linear(c) for c in (r, g, b)]), WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(_times(OK_LAB, [F.cbrt(v) for v in _times(OK_LMS, [linear(c) for c in (r, g, b)])]))


def rgb_to_oklch(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lightness, a, bb = rgb_to_oklab(r, g, b)
    return lightness, chroma(a, bb), hue(a, bb)


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """In degrees from 0 up to 360; 0 without chroma."""
    h = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)


def delta_e2(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Squared Euclidean distance."""
    return (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])


def _weight(c: Column) -> Column:
    c7 = F.pow(c, 7.0)
    return F.sqrt(c7 / (c7 + 25.0**7))


def _cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def bind(values: dict[str, Column], body) -> Column:
    """body of a struct of the values: each is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def ciede2000(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """The published formula with all weights 1."""

    def polar(v):
        a1, a2 = v["a1"] * v["widen"], v["a2"] * v["widen"]
        return bind({"v": v, "c1": chroma(a1, v["b1"]), "c2": chroma(a2, v["b2"]), "h1": hue(a1, v["b1"]), "h2": hue(a2, v["b2"])}, means)

    def means(w):
        grey = w["c1"] * w["c2"] == 0
        turn, around = w["h2"] - w["h1"], w["h1"] + w["h2"]
        far = F.abs(turn) > 180
        dh = F.when(grey, 0.0).when(~far, turn).otherwise(turn - 360 * F.signum(turn))
        mean_h = F.when(grey, around).when(~far, around / 2).otherwise((around + F.when(around < 360, 360).otherwise(-360)) / 2)
        return bind({"w": w, "dh": dh, "h": mean_h, "l": (w["v"]["l1"] + w["v"]["l2"]) / 2 - 50, "c": (w["c1"] + w["c2"]) / 2}, terms)

    def terms(m):
        w, h = m["w"], m["h"]
        t = 1 - 0.17 * _cos(h - 30) + 0.24 * _cos(2 * h) + 0.32 * _cos(3 * h + 6) - 0.2 * _cos(4 * h - 63)
        light = (w["v"]["l2"] - w["v"]["l1"]) / (1 + 0.015 * m["l"] * m["l"] / F.sqrt(20 + m["l"] * m["l"]))
        sat = (w["c2"] - w["c1"]) / (1 + 0.045 * m["c"])
        tone = 2 * F.sqrt(w["c1"] * w["c2"]) * F.sin(F.radians(m["dh"] / 2)) / (1 + 0.015 * m["c"] * t)
        mixed = -2 * _weight(m["c"]) * F.sin(F.radians(60 * F.exp(-F.pow((h - 275) / 25, 2.0))))
        return bind({"light": light, "sat": sat, "tone": tone, "mixed": mixed}, total)

    def total(x):
        return F.sqrt(F.greatest(F.lit(0.0), x["light"] * x["light"] + x["sat"] * x["sat"] + x["tone"] * x["tone"] + x["mixed"] * x["sat"] * x["tone"]))

    widen = 1.5 - 0.5 * _weight((chroma(p[1], p[2]) + chroma(q[1], q[2])) / 2)
    return bind({"l1": p[0], "a1": p[1], "b1": p[2], "l2": q[0], "a2": q[1], "b2": q[2], "widen": widen}, polar)


#: Upper bounds of the match tiers.
TIERS = (("exact", 1), ("close", 3), ("good", 5), ("fair", 10), ("poor", 20))


def match_tier(delta: Column) -> Column:
    out = F.when(delta.isNull() | (delta < 0), "none")
    for name, upper in TIERS:
        out = out.when(delta < upper, name)
    return out.otherwise("none")


def old_match_class(delta: Column, official: Column) -> Column:
    """The older classes, closed above; a charted match counts as exact up to 5."""
    return F.when(official & (delta <= 5), "exact").when(delta <= 2, "close").when(delta <= 5, "good").when(delta <= 10, "fair").otherwise("poor")


def difference_words(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """At most two words for how q differs from p, by axes that differ by 5 or more."""
    dl, da, db = q[0] - p[0], q[1] - p[1], q[2] - p[2]
    dc = chroma(q[1], q[2]) - chroma(p[1], p[2])
    word = lambda d, low, high: F.when(F.abs(d) >= 5, F.when(d < 0, low).otherwise(high))
    red, yellow = word(da, "greener", "redder"), word(db, "bluer", "yellower")
    a_first = F.abs(da) >= F.abs(db)
    words = F.array_compact(F.array(word(dl, "darker", "lighter"), word(dc, "less saturated", "more saturated"), F.when(a_first, red).otherwise(yellow), F.when(a_first, yellow).otherwise(red)))
    return F.when(F.size(words) == 0, "very close").otherwise(F.array_join(F.slice(words, 1, 2), ", "))


#: Words that name a metallic thread.
METALS = "metalli|effect|jewel|gold|silver|copper|bronze|pearl|fluor"
#: Hue bounds of the colour families.
FAMILIES = ((12, "reds"), (30, "pinks"), (55, "oranges"), (75, "yellows"), (165, "greens"), (200, "teals"), (260, "blues"), (320, "purples"), (340, "pinks"), (361, "reds"))


def family(name: Column, lab: tuple[Column, ...]) -> Column:
    light, a, b = lab
    c, h = chroma(a, b), hue(a, b)
    out = F.when(F.lower(name).rlike(METALS), "metallics").when((light >= 92) & (c < 14), "whites").when((light <= 18) & (c < 14), "blacks").when(c < 10, "greys").when((a > 6) & (b > 6) & (light < 60) & (c < 38), "browns")
    for upper, label in FAMILIES:
        out = out.when(h < upper, label)
    return out.otherwise("reds")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def contrast_ratio(r1, g1, b1, r2, g2, b2) -> Column:
    """Of two colours, the lighter over the darker, as WCAG defines it."""
    l1, l2 = (0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b) for r, g, b in ((r1, g1, b1), (r2, g2, b2)))
    return (F.greatest(l1, l2) + 0.05) / (F.least(l1, l2) + 0.05)


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness from 0 to 1."""
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    d, light = top - low, (top + low) / 2
    sector = F.when(top == x, (y - z) / d + F.when(y < z, 6.0).otherwise(0.0)).when(top == y, (z - x) / d + 2).otherwise((x - y) / d + 4)
    return F.when(d == 0, 0.0).otherwise(60 * sector), F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))), light


#: The matrix from D65 XYZ back to linear sRGB.
TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channels from 0 to 255, rounded and held in range."""
    y = (light + 16) / 116
    back = lambda t: F.when(t > 0.2069, t * t * t).otherwise((t - 16 / 116) / 7.787)
    xyz = [back(v) * w for v, w in zip((a / 500 + y, y, y - b / 200), WHITE, strict=True)]
    gamma = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(gamma(c) * 255 + 0.5))).cast("int") for c in _times(TO_SRGB, xyz))


#: OKLab's two matrices back to linear sRGB.
OK_ROOTS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
OK_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _rgb(channels) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip("rgb", channels, strict=True)))


def oklab_to_rgb(light: Column, a: Column, b: Column) -> Column:
    """A struct of channels from 0 to 255, rounded and held in range."""
    gamma = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c)
    held = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(gamma(v) * 255 + 0.5))).cast("int")
    roots = dict(zip("lms", _times(OK_ROOTS, [light, a, b]), strict=True))
    linear_rgb = lambda v: dict(zip("rgb", _times(OK_RGB, [v[k] * v[k] * v[k] for k in "lms"]), strict=True))
    return bind(roots, lambda v: bind(linear_rgb(v), lambda w: _rgb(held(w[k]) for k in "rgb")))


def in_oklch(r: Column, g: Column, b: Column, moved) -> Column:
    """A struct of the channels of moved(lightness, chroma, hue), which gives these three again."""
    back = lambda light, ch, h: oklab_to_rgb(light, ch * F.cos(F.radians(h)), ch * F.sin(F.radians(h)))
    polar = lambda v: {"l": v["l"], "c": chroma(v["a"], v["b"]), "h": hue(v["a"], v["b"])}
    placed = lambda w: bind(dict(zip("lch", moved(w["l"], w["c"], w["h"]), strict=True)), lambda z: back(z["l"], z["c"], z["h"]))
    return bind(dict(zip("lab", rgb_to_oklab(r, g, b), strict=True)), lambda v: bind(polar(v), placed))


def turned(r: Column, g: Column, b: Column, degrees: Column) -> Column:
    """The colour with its OKLCH hue turned, as a struct of channels."""
    return in_oklch(r, g, b, lambda light, ch, h: (light, ch, F.pmod(h + degrees, F.lit(360.0))))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb"""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0") for c in (r, g, b)))
