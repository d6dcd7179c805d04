"""Colour conversions as column expressions on (r, g, b) structs of doubles in 0..1.

Each function takes and returns a struct column of three fields; they stay in
the JVM and fuse with whatever surrounds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries and CIE tables.
XYZ_FROM_RGB = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
RGB_CIE_FROM_XYZ = ((0.418456, -0.158657, -0.082833), (-0.091167, 0.252426, 0.015707), (0.000921, -0.002550, 0.178595))
YUV_FROM_RGB = ((0.299, 0.587, 0.114), (-0.14714119, -0.28886916, 0.43601035), (0.61497538, -0.51496512, -0.10001026))
YIQ_FROM_RGB = ((0.299, 0.587, 0.114), (0.59590059, -0.27455667, -0.32134392), (0.21153661, -0.52273617, 0.31119955))
YPBPR_FROM_RGB = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
YCBCR_FROM_RGB = ((65.481, 128.553, 24.966), (-37.797, -74.203, 112.0), (112.0, -93.786, -18.214))
YDBDR_FROM_RGB = ((0.299, 0.587, 0.114), (-0.45, -0.883, 1.333), (-1.333, 1.116, 0.217))
RGB_FROM_HED = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
GRAY = (0.2125, 0.7154, 0.0721)
WHITE = {
    ("A", "2"): (1.098466069456375, 1, 0.3558228003436005), ("A", "10"): (1.111420406956693, 1, 0.3519978321919493),
    ("D50", "2"): (0.9642119944211994, 1, 0.8251882845188288), ("D50", "10"): (0.9672062750333777, 1, 0.8142801513128616),
    ("D55", "2"): (0.956797052643698, 1, 0.9214805860173273), ("D55", "10"): (0.9579665682254781, 1, 0.9092525159847462),
    ("D65", "2"): (0.95047, 1.0, 1.08883), ("D65", "10"): (0.94809667673716, 1, 1.0730513595166162),
    ("D75", "2"): (0.9497220898840717, 1, 1.226393520724154), ("D75", "10"): (0.9441713925645873, 1, 1.2064272211720228),
    ("E", "2"): (1.0, 1.0, 1.0), ("E", "10"): (1.0, 1.0, 1.0),
}


def triple(a, b, c) -> Column:
    return F.struct(F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"), F.lit(c).cast("double").alias("c"))


def _parts(x: Column) -> tuple[Column, Column, Column]:
    return x["a"], x["b"], x["c"]


def _dot(m, x: Column, shift=(0.0, 0.0, 0.0)) -> Column:
    p = _parts(x)
    return triple(*[row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + s for row, s in zip(m, shift)])


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return tuple(tuple(v / det for v in row) for row in ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d)))


def let(x: Column, use) -> Column:
    return F.get(F.transform(F.array(x), use), F.lit(0))


def rgb2gray(x: Column) -> Column:
    r, g, b = _parts(x)
    return GRAY[0] * r + GRAY[1] * g + GRAY[2] * b


def gray2rgb(v: Column) -> Column:
    return triple(v, v, v)


def rgba2rgb(x: Column, alpha: Column, background=(1.0, 1.0, 1.0)) -> Column:
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return triple(*[clip((1 - alpha) * bg + alpha * v) for v, bg in zip(_parts(x), background)])


def rgb2hsv(x: Column) -> Column:
    r, g, b = _parts(x)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    safe = F.when(d == 0, 1.0).otherwise(d)
    h = F.when(d == 0, 0.0).when(hi == b, 4 + (r - g) / safe).when(hi == g, 2 + (b - r) / safe).otherwise((g - b) / safe) / 6
    return triple(F.pmod(h, F.lit(1.0)), F.when(hi == 0, 0.0).otherwise(d / F.when(hi == 0, 1.0).otherwise(hi)), hi)


def hsv2rgb(x: Column) -> Column:
    h, s, v = _parts(x)
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = F.pmod(i, F.lit(6))
    out = triple(v, p, q)
    for n, value in enumerate(((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v))):
        out = F.when(k == n, triple(*value)).otherwise(out)
    return out


def _linear(v: Column) -> Column:
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _gamma(v: Column) -> Column:
    out = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(v * 12.92)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def rgb2xyz(x: Column) -> Column:
    return let(triple(*map(_linear, _parts(x))), lambda y: _dot(XYZ_FROM_RGB, y))


def xyz2rgb(x: Column) -> Column:
    return let(_dot(_inverse(XYZ_FROM_RGB), x), lambda y: triple(*map(_gamma, _parts(y))))


def rgb2rgbcie(x: Column) -> Column:
    return let(rgb2xyz(x), lambda y: _dot(RGB_CIE_FROM_XYZ, y))


def rgbcie2rgb(x: Column) -> Column:
    return xyz2rgb(_dot(_inverse(RGB_CIE_FROM_XYZ), x))


def xyz2lab(x: Column, illuminant="D65", observer="2") -> Column:
    def f(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    scaled = triple(*[f(v / w) for v, w in zip(_parts(x), WHITE[illuminant, observer])])
    return let(scaled, lambda y: triple(116 * y["b"] - 16, 500 * (y["a"] - y["b"]), 200 * (y["b"] - y["c"])))


def lab2xyz(x: Column, illuminant="D65", observer="2") -> Column:
    lum, a, b = _parts(x)
    y = (lum + 16) / 116
    z = F.greatest(y - b / 200, F.lit(0.0))

    def g(t):
        return F.when(t > 0.2068966, F.pow(t, F.lit(3.0))).otherwise((t - 16.0 / 116.0) / 7.787)

    return let(triple(a / 500 + y, y, z), lambda p: triple(*[g(v) * w for v, w in zip(_parts(p), WHITE[illuminant, observer])]))


def rgb2lab(x: Column) -> Column:
    return let(rgb2xyz(x), lambda y: xyz2lab(y))


def lab2rgb(x: Column) -> Column:
    return xyz2rgb(lab2xyz(x))


def xyz2luv(x: Column, illuminant="D65", observer="2") -> Column:
    wx, wy, wz = WHITE[illuminant, observer]
    u0, v0 = 4 * wx / (wx + 15 * wy + 3 * wz), 9 * wy / (wx + 15 * wy + 3 * wz)
    eps = 2.220446049250313e-16

    def run(p):
        a, b, c = _parts(p)
        t = b / wy
        lum = F.when(t > 0.008856, 116 * F.cbrt(t) - 16).otherwise(903.3 * t)
        den = a + 15 * b + 3 * c + eps
        return let(lum, lambda el: triple(el, 13 * el * (4 * a / den - u0), 13 * el * (9 * b / den - v0)))

    return let(x, run)


def luv2xyz(x: Column, illuminant="D65", observer="2") -> Column:
    wx, wy, wz = WHITE[illuminant, observer]
    u0, v0 = 4 * wx / (wx + 15 * wy + 3 * wz), 9 * wy / (wx + 15 * wy + 3 * wz)
    eps = 2.220446049250313e-16

    def run(p):
        lum, u, v = _parts(p)
        y = F.when(lum > 7.999625, F.pow((lum + 16) / 116, F.lit(3.0))).otherwise(lum / 903.3) * wy
        a, b = u0 + u / (13 * lum + eps), v0 + v / (13 * lum + eps)
        return let(F.struct(y.alias("y"), a.alias("a"), b.alias("b")), lambda q: triple(9 * q["y"] * q["a"] / (4 * q["b"]), q["y"], q["y"] * (12 - 3 * q["a"] - 20 * q["b"]) / (4 * q["b"])))

    return let(x, run)


def rgb2luv(x: Column) -> Column:
    return xyz2luv(rgb2xyz(x))


def luv2rgb(x: Column) -> Column:
    return xyz2rgb(luv2xyz(x))


def lab2lch(x: Column) -> Column:
    lum, a, b = _parts(x)
    h = F.atan2(b, a)
    return triple(lum, F.hypot(a, b), F.when(h < 0, h + 2 * 3.141592653589793).otherwise(h))


def lch2lab(x: Column) -> Column:
    lum, c, h = _parts(x)
    return triple(lum, c * F.cos(h), c * F.sin(h))


def rgb2yuv(x: Column) -> Column:
    return _dot(YUV_FROM_RGB, x)


def yuv2rgb(x: Column) -> Column:
    return _dot(_inverse(YUV_FROM_RGB), x)


def rgb2yiq(x: Column) -> Column:
    return _dot(YIQ_FROM_RGB, x)


def yiq2rgb(x: Column) -> Column:
    return _dot(_inverse(YIQ_FROM_RGB), x)


def rgb2ypbpr(x: Column) -> Column:
    return _dot(YPBPR_FROM_RGB, x)


def ypbpr2rgb(x: Column) -> Column:
    return _dot(_inverse(YPBPR_FROM_RGB), x)


def rgb2ycbcr(x: Column) -> Column:
    return _dot(YCBCR_FROM_RGB, x, (16.0, 128.0, 128.0))


def ycbcr2rgb(x: Column) -> Column:
    a, b, c = _parts(x)
    return _dot(_inverse(YCBCR_FROM_RGB), triple(a - 16.0, b - 128.0, c - 128.0))


def rgb2ydbdr(x: Column) -> Column:
    return _dot(YDBDR_FROM_RGB, x)


def ydbdr2rgb(x: Column) -> Column:
    return _dot(_inverse(YDBDR_FROM_RGB), x)


def separate_stains(x: Column, conv=None) -> Column:
    """Optical densities against log(1e-6), unmixed; stains may be negative."""
    conv = _inverse(RGB_FROM_HED) if conv is None else conv
    base = F.log(F.lit(1e-6))
    dens = [F.log(F.greatest(v, F.lit(1e-6))) / base for v in _parts(x)]
    return triple(*[sum(dens[k] * conv[k][j] for k in range(3)) for j in range(3)])


def combine_stains(x: Column, conv=RGB_FROM_HED) -> Column:
    p = _parts(x)
    base = -F.log(F.lit(1e-6))
    out = [F.exp(-base * sum(p[k] * conv[k][j] for k in range(3))) for j in range(3)]
    return triple(*[F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in out])


rgb2hed, hed2rgb = separate_stains, combine_stains

CONVERT = {"HSV": (hsv2rgb, rgb2hsv), "RGB CIE": (rgbcie2rgb, rgb2rgbcie), "XYZ": (xyz2rgb, rgb2xyz), "YUV": (yuv2rgb, rgb2yuv), "YIQ": (yiq2rgb, rgb2yiq), "YPbPr": (ypbpr2rgb, rgb2ypbpr), "YCbCr": (ycbcr2rgb, rgb2ycbcr), "YDbDr": (ydbdr2rgb, rgb2ydbdr), "RGB": (lambda x: x, lambda x: x)}


def convert_colorspace(x: Column, fromspace: str, tospace: str) -> Column:
    return CONVERT[tospace][1](CONVERT[fromspace][0](x))


# Colour differences of two Lab structs ---------------------------------------


def deltaE_cie76(p: Column, q: Column) -> Column:
    return F.sqrt(sum((a - b) * (a - b) for a, b in zip(_parts(p), _parts(q))))


def get_dH2(p: Column, q: Column) -> Column:
    """Squared hue difference, without cancellation."""
    a1, b1, a2, b2 = p["b"], p["c"], q["b"], q["c"]
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    return 2 * (c1 * c2 - (a1 * a2 + b1 * b2))


def deltaE_ciede94(p: Column, q: Column, kL=1, kC=1, kH=1, k1=0.045, k2=0.015) -> Column:
    c1, c2 = F.hypot(p["b"], p["c"]), F.hypot(q["b"], q["c"])
    dl, dc = (p["a"] - q["a"]) / kL, (c1 - c2) / (kC * (1 + k1 * c1))
    sh = kH * (1 + k2 * c1)
    return F.sqrt(F.greatest(dl * dl + dc * dc + get_dH2(p, q) / (sh * sh), F.lit(0.0)))


def deltaE_cmc(p: Column, q: Column, kL=1, kC=1) -> Column:
    lum, a1, b1 = _parts(p)
    c1, c2 = F.hypot(a1, b1), F.hypot(q["b"], q["c"])
    h = F.pmod(F.degrees(F.atan2(b1, a1)), F.lit(360.0))
    t = F.when((h >= 164) & (h <= 345), 0.56 + 0.2 * F.abs(F.cos(F.radians(h + 168)))).otherwise(0.36 + 0.4 * F.abs(F.cos(F.radians(h + 35))))
    c4 = F.pow(c1, F.lit(4.0))
    f = F.sqrt(c4 / (c4 + 1900))
    sl = F.when(lum < 16, 0.511).otherwise(0.040975 * lum / (1 + 0.01765 * lum))
    sc = 0.638 + 0.0638 * c1 / (1 + 0.0131 * c1)
    sh = sc * (f * t + 1 - f)
    sq = lambda v: v * v
    return F.sqrt(F.greatest(sq((lum - q["a"]) / (kL * sl)) + sq((c1 - c2) / (kC * sc)) + get_dH2(p, q) / sq(sh), F.lit(0.0)))


def deltaE_ciede2000(p: Column, q: Column, kL=1, kC=1, kH=1) -> Column:
    """CIEDE2000; the steps are bound once each (``let``), the tree stays small."""
    pi, seven = 3.141592653589793, 25.0**7

    def hue(a, b):
        h = F.atan2(b, a)
        return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 2 * pi).otherwise(h)

    def stretched(s):
        return F.struct(s["l1"].alias("l1"), s["l2"].alias("l2"), F.hypot(s["a1"] * s["g"], s["b1"]).alias("c1"), F.hypot(s["a2"] * s["g"], s["b2"]).alias("c2"), hue(s["a1"] * s["g"], s["b1"]).alias("h1"), hue(s["a2"] * s["g"], s["b2"]).alias("h2"))

    def means(s):
        d, total, flat = s["h2"] - s["h1"], s["h1"] + s["h2"], s["c1"] * s["c2"] == 0
        dh = F.when(flat, 0.0).when(d > pi, d - 2 * pi).when(d < -pi, d + 2 * pi).otherwise(d)
        h = F.when(flat, total).when(F.abs(d) <= pi, total / 2).when(total < 2 * pi, total / 2 + pi).otherwise(total / 2 - pi)
        return F.struct((s["l2"] - s["l1"]).alias("dl"), (s["c2"] - s["c1"]).alias("dc"), (2 * F.sqrt(s["c1"] * s["c2"]) * F.sin(dh / 2)).alias("dh"), ((s["l1"] + s["l2"]) / 2).alias("l"), ((s["c1"] + s["c2"]) / 2).alias("c"), h.alias("h"))

    def final(s):
        h, c, far = s["h"], s["c"], (s["l"] - 50) * (s["l"] - 50)
        t = 1 - 0.17 * F.cos(h - pi / 6) + 0.24 * F.cos(2 * h) + 0.32 * F.cos(3 * h + pi / 30) - 0.2 * F.cos(4 * h - 63 * pi / 180)
        sl, sc, sh = 1 + 0.015 * far / F.sqrt(20 + far), 1 + 0.045 * c, 1 + 0.015 * c * t
        c7 = F.pow(c, F.lit(7.0))
        turn = 30 * F.exp(-F.pow((F.degrees(h) - 275) / 25, F.lit(2.0)))
        rt = -2 * F.sqrt(c7 / (c7 + seven)) * F.sin(F.radians(2 * turn))
        x, y, z = s["dl"] / (kL * sl), s["dc"] / (kC * sc), s["dh"] / (kH * sh)
        return F.sqrt(F.greatest(x * x + y * y + z * z + rt * y * z, F.lit(0.0)))

    cm = F.pow((F.hypot(p["b"], p["c"]) + F.hypot(q["b"], q["c"])) / 2, F.lit(7.0))
    g = 1 + 0.5 * (1 - F.sqrt(cm / (cm + seven)))
    start = F.struct(p["a"].alias("l1"), p["b"].alias("a1"), p["c"].alias("b1"), q["a"].alias("l2"), q["b"].alias("a2"), q["c"].alias("b2"), g.alias("g"))
    return let(let(let(start, stretched), means), final)


# The named colours of CSS as (r, g, b) in 0..1.
color_dict = {
    "aliceblue": (0.941, 0.973, 1), "antiquewhite": (0.98, 0.922, 0.843), "aqua": (0, 1, 1), "aquamarine": (0.498, 1, 0.831), "azure": (0.941, 1, 1),
    "beige": (0.961, 0.961, 0.863), "bisque": (1, 0.894, 0.769), "black": (0, 0, 0), "blanchedalmond": (1, 0.922, 0.804), "blue": (0, 0, 1),
    "blueviolet": (0.541, 0.169, 0.886), "brown": (0.647, 0.165, 0.165), "burlywood": (0.871, 0.722, 0.529), "cadetblue": (0.373, 0.62, 0.627), "chartreuse": (0.498, 1, 0),
    "chocolate": (0.824, 0.412, 0.118), "coral": (1, 0.498, 0.314), "cornflowerblue": (0.392, 0.584, 0.929), "cornsilk": (1, 0.973, 0.863), "crimson": (0.863, 0.078, 0.235),
    "cyan": (0, 1, 1), "darkblue": (0, 0, 0.545), "darkcyan": (0, 0.545, 0.545), "darkgoldenrod": (0.722, 0.525, 0.043), "darkgray": (0.663, 0.663, 0.663),
    "darkgreen": (0, 0.392, 0), "darkgrey": (0.663, 0.663, 0.663), "darkkhaki": (0.741, 0.718, 0.42), "darkmagenta": (0.545, 0, 0.545), "darkolivegreen": (0.333, 0.42, 0.184),
    "darkorange": (1, 0.549, 0), "darkorchid": (0.6, 0.196, 0.8), "darkred": (0.545, 0, 0), "darksalmon": (0.914, 0.588, 0.478), "darkseagreen": (0.561, 0.737, 0.561),
    "darkslateblue": (0.282, 0.239, 0.545), "darkslategray": (0.184, 0.31, 0.31), "darkslategrey": (0.184, 0.31, 0.31), "darkturquoise": (0, 0.808, 0.82), "darkviolet": (0.58, 0, 0.827),
    "deeppink": (1, 0.078, 0.576), "deepskyblue": (0, 0.749, 1), "dimgray": (0.412, 0.412, 0.412), "dimgrey": (0.412, 0.412, 0.412), "dodgerblue": (0.118, 0.565, 1),
    "firebrick": (0.698, 0.133, 0.133), "floralwhite": (1, 0.98, 0.941), "forestgreen": (0.133, 0.545, 0.133), "fuchsia": (1, 0, 1), "gainsboro": (0.863, 0.863, 0.863),
    "ghostwhite": (0.973, 0.973, 1), "gold": (1, 0.843, 0), "goldenrod": (0.855, 0.647, 0.125), "gray": (0.502, 0.502, 0.502), "green": (0, 0.502, 0),
    "greenyellow": (0.678, 1, 0.184), "grey": (0.502, 0.502, 0.502), "honeydew": (0.941, 1, 0.941), "hotpink": (1, 0.412, 0.706), "indianred": (0.804, 0.361, 0.361),
    "indigo": (0.294, 0, 0.51), "ivory": (1, 1, 0.941), "khaki": (0.941, 0.902, 0.549), "lavender": (0.902, 0.902, 0.98), "lavenderblush": (1, 0.941, 0.961),
    "lawngreen": (0.486, 0.988, 0), "lemonchiffon": (1, 0.98, 0.804), "lightblue": (0.678, 0.847, 0.902), "lightcoral": (0.941, 0.502, 0.502), "lightcyan": (0.878, 1, 1),
    "lightgoldenrodyellow": (0.98, 0.98, 0.824), "lightgray": (0.827, 0.827, 0.827), "lightgreen": (0.565, 0.933, 0.565), "lightgrey": (0.827, 0.827, 0.827), "lightpink": (1, 0.714, 0.757),
    "lightsalmon": (1, 0.627, 0.478), "lightseagreen": (0.125, 0.698, 0.667), "lightskyblue": (0.529, 0.808, 0.98), "lightslategray": (0.467, 0.533, 0.6), "lightslategrey": (0.467, 0.533, 0.6),
    "lightsteelblue": (0.69, 0.769, 0.871), "lightyellow": (1, 1, 0.878), "lime": (0, 1, 0), "limegreen": (0.196, 0.804, 0.196), "linen": (0.98, 0.941, 0.902),
    "magenta": (1, 0, 1), "maroon": (0.502, 0, 0), "mediumaquamarine": (0.4, 0.804, 0.667), "mediumblue": (0, 0, 0.804), "mediumorchid": (0.729, 0.333, 0.827),
    "mediumpurple": (0.576, 0.439, 0.859), "mediumseagreen": (0.235, 0.702, 0.443), "mediumslateblue": (0.482, 0.408, 0.933), "mediumspringgreen": (0, 0.98, 0.604), "mediumturquoise": (0.282, 0.82, 0.8),
    "mediumvioletred": (0.78, 0.082, 0.522), "midnightblue": (0.098, 0.098, 0.439), "mintcream": (0.961, 1, 0.98), "mistyrose": (1, 0.894, 0.882), "moccasin": (1, 0.894, 0.71),
    "navajowhite": (1, 0.871, 0.678), "navy": (0, 0, 0.502), "oldlace": (0.992, 0.961, 0.902), "olive": (0.502, 0.502, 0), "olivedrab": (0.42, 0.557, 0.137),
    "orange": (1, 0.647, 0), "orangered": (1, 0.271, 0), "orchid": (0.855, 0.439, 0.839), "palegoldenrod": (0.933, 0.91, 0.667), "palegreen": (0.596, 0.984, 0.596),
    "paleturquoise": (0.686, 0.933, 0.933), "palevioletred": (0.859, 0.439, 0.576), "papayawhip": (1, 0.937, 0.835), "peachpuff": (1, 0.855, 0.725), "peru": (0.804, 0.522, 0.247),
    "pink": (1, 0.753, 0.796), "plum": (0.867, 0.627, 0.867), "powderblue": (0.69, 0.878, 0.902), "purple": (0.502, 0, 0.502), "red": (1, 0, 0),
    "rosybrown": (0.737, 0.561, 0.561), "royalblue": (0.255, 0.412, 0.882), "saddlebrown": (0.545, 0.271, 0.075), "salmon": (0.98, 0.502, 0.447), "sandybrown": (0.957, 0.643, 0.376),
    "seagreen": (0.18, 0.545, 0.341), "seashell": (1, 0.961, 0.933), "sienna": (0.627, 0.322, 0.176), "silver": (0.753, 0.753, 0.753), "skyblue": (0.529, 0.808, 0.922),
    "slateblue": (0.416, 0.353, 0.804), "slategray": (0.439, 0.502, 0.565), "slategrey": (0.439, 0.502, 0.565), "snow": (1, 0.98, 0.98), "springgreen": (0, 1, 0.498),
    "steelblue": (0.275, 0.51, 0.706), "tan": (0.824, 0.706, 0.549), "teal": (0, 0.502, 0.502), "thistle": (0.847, 0.749, 0.847), "tomato": (1, 0.388, 0.278),
    "turquoise": (0.251, 0.878, 0.816), "violet": (0.933, 0.51, 0.933), "wheat": (0.961, 0.871, 0.702), "white": (1, 1, 1), "whitesmoke": (0.961, 0.961, 0.961),
    "yellow": (1, 1, 0), "yellowgreen": (0.604, 0.804, 0.196),
}
#: Colours for labels, in turn.
LABEL_COLOURS = ("red", "blue", "yellow", "magenta", "green", "indigo", "darkorange", "cyan", "pink", "yellowgreen")


def rgb_of(colour) -> tuple[float, float, float]:
    """A colour by its name, or as given."""
    return color_dict[colour] if isinstance(colour, str) else tuple(colour)[:3]


def label2rgb(label: Column, gray: Column | None = None, alpha: float = 0.3, background: int = 0, colours=LABEL_COLOURS) -> Column:
    """A colour a label (by name or value), laid over a grey image; the background shows the image."""
    palette = F.array(*[triple(*rgb_of(c)) for c in colours])
    base = F.lit(0.0) if gray is None else gray
    part = 1.0 if gray is None else alpha
    own = F.get(palette, F.pmod(label - 1, F.lit(len(colours))).cast("int"))
    mixed = triple(*[part * own[k] + (1 - part) * base for k in "abc"])
    return F.when(label == background, triple(base, base, base)).otherwise(mixed)


def adapt_rgb(x: Column, change, how: str = "each_channel") -> Column:
    """Applies a grey column function to each channel, or to the value of HSV."""
    if how == "each_channel":
        return triple(*[change(v) for v in _parts(x)])
    return let(rgb2hsv(x), lambda h: hsv2rgb(triple(h["a"], h["b"], change(h["c"]))))


def gray2rgba(v: Column, alpha: Column | float = 1.0) -> Column:
    """Grey as r, g, b and alpha."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return F.struct(v.alias("a"), v.alias("b"), v.alias("c"), a.alias("alpha"))


rgb2grey, grey2rgb = rgb2gray, gray2rgb


def get_xyz_coords(illuminant: str, observer: str) -> tuple[float, float, float]:
    """Tristimulus of a white point."""
    try:
        return WHITE[illuminant.upper(), observer]
    except KeyError:
        raise ValueError(f"unknown white point {illuminant}, {observer}") from None


def palette(number: Column) -> Column:
    """The named colours in order of name, over and over: struct (name, r, g, b) of a whole number."""
    rows = [F.struct(F.lit(n).alias("name"), *[F.lit(float(v)).alias(c) for c, v in zip("rgb", color_dict[n])]) for n in sorted(color_dict)]
    return F.get(F.array(*rows), F.pmod(number, F.lit(len(rows))).cast("int"))


def is_rgb_like(shape) -> bool:
    """Whether a shape is that of an image with three or four channels."""
    return len(shape) == 3 and shape[-1] in (3, 4)
