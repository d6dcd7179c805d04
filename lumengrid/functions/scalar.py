"""Elementwise functions as column expressions: special, dtype and intensity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Range of each logical image type.
DTYPE_RANGE = {"bool": (0, 1), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint8": (0, 255), "uint10": (0, 1023), "uint12": (0, 4095), "uint14": (0, 16383), "uint16": (0, 65535), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1), "float16": (-1, 1), "float32": (-1, 1), "float64": (-1, 1), "float": (-1, 1)}


def entr(x: Column) -> Column:
    """-x ln x; 0 at 0 and -inf below."""
    return F.when(x > 0, -x * F.log(x)).when(x == 0, 0.0).when(x < 0, -INF).otherwise(x)


def rel_entr(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), x * F.log(x / y)).when((x == 0) & (y >= 0), 0.0).otherwise(INF)


def kl_div(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), x * F.log(x / y) - x + y).when((x == 0) & (y >= 0), y).otherwise(INF)


def huber(delta: Column, r: Column) -> Column:
    a = F.abs(r)
    return F.when(delta < 0, INF).when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def pseudo_huber(delta: Column, r: Column) -> Column:
    safe = F.when(delta == 0, 1.0).otherwise(delta)
    return F.when(delta < 0, INF).when((delta == 0) | (r == 0), 0.0).otherwise(delta * delta * (F.sqrt(1 + (r / safe) * (r / safe)) - 1))


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def dtype_limits(logical: str, clip_negative: bool = False) -> tuple[float, float]:
    lo, hi = DTYPE_RANGE[logical]
    return (0 if clip_negative else lo), hi


def img_as_float(x: Column, logical: str) -> Column:
    """Integer image values to floats: unsigned to 0..1; signed to -1..1, the middle between two numbers at 0."""
    lo, hi = DTYPE_RANGE[logical]
    if logical.startswith("float"):
        return x.cast("double")
    return x.cast("double") / hi if lo == 0 else (x.cast("double") + 0.5) * (2 / (hi - lo))


def _from_float(x: Column, logical: str, uniform: bool = False) -> Column:
    """Values of -1..1 to whole numbers: nearest, or (``uniform``) to as many intervals of one size."""
    lo, hi = DTYPE_RANGE[logical]
    if uniform:
        return clip(F.floor(x * ((hi - lo + 1) / (1 if lo == 0 else 2))), lo, hi)
    return clip(F.rint(x * float(hi) if lo == 0 else x * ((hi - lo) / 2) - 0.5), float(lo), float(hi))


def _scaled(x: Column, n: int, m: int, most: Column | None) -> Column:
    """Whole numbers of n bits to m bits: cut off, or repeated; as they are if the greatest, ``most``, fits."""
    if n == m:
        return x
    if n > m:
        cut = F.shiftright(x, n - m)
        return cut if most is None else F.when(most < 2**m, x).otherwise(cut)
    wide = -(-m // n) * n
    return F.shiftright(x * F.lit((2**wide - 1) // (2**n - 1)).cast("long"), wide - m)


def convert(x: Column, source: str, target: str, uniform: bool = False, most: Column | None = None) -> Column:
    """Image values of one logical type as another: floats (-1..1), whole numbers of 8 to 32 bits, or bool.

    Unsigned numbers scale from 0..max, signed ones keep their sign; negative
    values become 0 in unsigned types.  ``most`` is the image's greatest value:
    where that fits the target, narrowing leaves the values as they are.
    """
    if source == target:
        return x
    if target == "bool":
        return img_as_bool(x, source)
    if source == "bool":
        return x.cast("double") if target.startswith("float") else x.cast("long") * DTYPE_RANGE[target][1]
    if target.startswith("float"):
        return img_as_float(x, source)
    if source.startswith("float"):
        return _from_float(x, target, uniform).cast("long")
    n, m = (int(t.lstrip("uint")) for t in (source, target))
    if max(n, m) > 32:
        raise ValueError("whole numbers of more than 32 bits are not converted")
    x, signed, into = x.cast("long"), source[0] == "i", target[0] == "i"
    if not signed:
        return _scaled(x, n, m - into, most)
    if not into:
        return F.greatest(_scaled(x, n - 1, m, most), F.lit(0).cast("long"))
    if n > m:
        return _scaled(x, n - 1, m - 1, most)
    return _scaled(x - DTYPE_RANGE[source][0], n, m, most) + DTYPE_RANGE[target][0]


def img_as_ubyte(x: Column) -> Column:
    return _from_float(x, "uint8").cast("int")


def img_as_uint(x: Column) -> Column:
    return _from_float(x, "uint16").cast("int")


def img_as_int(x: Column) -> Column:
    return _from_float(x, "int16").cast("int")


def img_as_bool(x: Column, logical: str = "float64") -> Column:
    hi = DTYPE_RANGE[logical][1]
    return x > (0.5 if logical.startswith("float") else hi / 2)


def invert(x: Column, logical: str = "float64", signed_float: bool = False) -> Column:
    lo, hi = DTYPE_RANGE[logical]
    if logical == "bool":
        return ~x
    if logical.startswith("float"):
        return -x if signed_float else 1 - x
    return -1 - x if lo < 0 else hi - x


def adjust_gamma(x: Column, gamma: float = 1.0, gain: float = 1.0, scale: float = 1.0) -> Column:
    return F.pow(x / scale, F.lit(gamma)) * scale * gain


def adjust_log(x: Column, gain: float = 1.0, inv: bool = False, scale: float = 1.0) -> Column:
    if inv:
        return (F.pow(F.lit(2.0), x / scale) - 1) * scale * gain
    return F.log2(1 + x / scale) * scale * gain


def adjust_sigmoid(x: Column, cutoff: float = 0.5, gain: float = 10.0, inv: bool = False, scale: float = 1.0) -> Column:
    s = 1 / (1 + F.exp(gain * (cutoff - x / scale)))
    return (1 - s if inv else s) * scale


def rescale_intensity(x: Column, in_lo, in_hi, out_lo, out_hi) -> Column:
    c = F.least(F.greatest(x, F.lit(in_lo)), F.lit(in_hi))
    span = F.lit(in_hi) - F.lit(in_lo)
    return F.when(span != 0, (c - in_lo) / F.when(span != 0, span).otherwise(1.0) * (out_hi - out_lo) + out_lo).otherwise(clip(x, out_lo, out_hi))


def ravel_multi_index(coords: list[Column], dims: list[int], mode: str = "wrap", order: str = "C") -> Column:
    if order == "F":
        coords, dims = coords[::-1], dims[::-1]
    out = F.lit(0).cast("long")
    for c, n in zip(coords, dims):
        at = F.pmod(c, F.lit(n)) if mode == "wrap" else F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)) if mode == "clip" else F.when((c >= 0) & (c < n), c).otherwise(F.raise_error(F.lit("invalid entry in coordinates array")).cast("long"))
        out = out * n + at
    return out


def boundary(i: Column, n: int, mode: str) -> Column:
    """Source index of position i on an axis of n; -1 stands for the constant."""
    if mode in ("reflect", "grid-mirror"):
        m = F.pmod(F.when(i < 0, -1 - i).otherwise(i), F.lit(2 * n))
        return F.least(m, 2 * n - 1 - m)
    if mode == "mirror":
        m = F.pmod(F.abs(i), F.lit(max(2 * n - 2, 1)))
        return F.least(m, 2 * n - 2 - m) if n > 1 else F.lit(0)
    if mode == "nearest":
        return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0))
    if mode in ("wrap", "grid-wrap"):
        return F.pmod(i, F.lit(n))
    return F.when((i >= 0) & (i < n), i).otherwise(-1)


def img_as_float64(x: Column, logical: str) -> Column:
    return img_as_float(x, logical)


def img_as_float32(x: Column, logical: str) -> Column:
    return img_as_float(x, logical).cast("float")
