"""The codec's scalar rules as Catalyst expressions; integers are bigint unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import indexes, let, squares, total


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def varint_len(v: Column) -> Column:
    """Bytes of a canonical varint of a non-negative value."""
    return reduce(lambda out, k: F.when(v < F.lit(1 << 7 * k).cast("bigint"), k).otherwise(out), range(8, 0, -1), F.lit(9))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def svarint_len(v: Column) -> Column:
    return varint_len(zigzag(v))


def div_round(v: Column, d: Column | int) -> Column:
    """Nearest, halves away from zero."""
    d = _c(d)
    half = F.floor(d / 2)
    return F.when(v >= 0, F.floor((v + half) / d)).otherwise(-F.floor((-v + half) / d))


def audio_divisor(i: Column, q: Column | int) -> Column:
    q = _c(q)
    return F.when(q <= 1, F.lit(1).cast("bigint")).when(i < 4, q).when(i < 16, 2 * q).otherwise(3 * q)


def clip8(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0).cast("bigint")), F.lit(255).cast("bigint"))


def quantize_audio(block: Column, q: Column | int) -> Column:
    return F.transform(block, lambda v, i: div_round(v, audio_divisor(i, q)))


def dequantize_audio(block: Column, q: Column | int) -> Column:
    return F.transform(block, lambda v, i: v * audio_divisor(i, q))


def quantize_video(block: Column, q: Column | int) -> Column:
    return F.transform(block, lambda v: div_round(v, q))


def haar(block: Column) -> Column:
    """Forward lifting transform of 64 values."""

    def level(v: Column, n: int) -> Column:
        if n == 1:
            return v
        half = n // 2
        d = F.transform(indexes(half), lambda i: F.get(v, 2 * i + 1) - F.get(v, 2 * i))
        joined = let(d, lambda d: F.concat(F.transform(indexes(half), lambda i: F.get(v, 2 * i) + F.shiftright(F.get(d, i), 1)), d, F.slice(v, n + 1, 64)))
        return let(joined, lambda w: level(w, half))

    return level(block, 64)


def inverse_haar(block: Column) -> Column:
    def level(v: Column, n: int) -> Column:
        if n > 64:
            return v
        half = n // 2
        a = F.transform(indexes(half), lambda i: F.get(v, i) - F.shiftright(F.get(v, i + half), 1))
        pair = let(a, lambda a: F.concat(F.flatten(F.transform(indexes(half), lambda i: F.array(F.get(a, i), F.get(v, i + half) + F.get(a, i)))), F.slice(v, n + 1, 64)))
        return let(pair, lambda w: level(w, n * 2))

    return level(block, 2)


def hadamard(block: Column) -> Column:
    """8x8 transform of a raster block: butterflies over the six bits of the position."""

    def stage(v: Column, h: int) -> Column:
        if h == 64:
            return v
        one = lambda i: F.when(i.bitwiseAND(F.lit(h)) == 0, F.get(v, i) + F.get(v, i + h)).otherwise(F.get(v, i - h) - F.get(v, i))
        return let(F.transform(indexes(64), one), lambda w: stage(w, 2 * h))

    return stage(block, 1)


def inverse_hadamard(block: Column) -> Column:
    return F.transform(hadamard(block), lambda v: div_round(v, 64))


def sparse(block: Column) -> Column:
    """(index, value) of the nonzero coefficients, ascending."""
    return F.filter(F.transform(block, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"] != 0)


def token_bytes(block: Column) -> Column:
    """Bytes of a block's sparse tokens."""
    return let(sparse(block), lambda t: varint_len(F.size(t).cast("bigint")) + total(F.transform(t, lambda x: varint_len(x["i"].cast("bigint")) + svarint_len(x["v"]))))


def sad(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sse(a: Column, b: Column) -> Column:
    return squares(F.zip_with(a, b, lambda x, y: x - y))


def decibels(signal: Column, noise: Column) -> Column:
    """10 log10(signal / noise); infinite without noise."""
    return F.when(noise == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.when(noise == 0, F.lit(1.0)).otherwise(signal / noise)))


def palette(block: Column) -> Column:
    """Distinct colours in order of first appearance; null for more than four or fewer than 16 samples."""
    return let(F.array_distinct(block), lambda c: F.when((F.size(c) <= 4) & (F.size(block) >= 16), c))


def palette_pack(indexes_: Column) -> Column:
    """Two bits an index, lowest first, four to a value."""
    byte = lambda k: total(F.transform(F.slice(indexes_, k * 4 + 1, 4), lambda x, j: F.call_function("shiftleft", x, (2 * j).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(indexes_) / 4).cast("int") - 1), byte)


def meta_fields(v: Column) -> Column:
    """matrix, transfer, primaries, full range, chroma location and whether all are known and the high bits zero."""
    part = lambda at, bits: F.shiftright(v, at).bitwiseAND(F.lit((1 << bits) - 1))
    m, t, p, r, c = part(0, 4), part(4, 4), part(8, 4), part(12, 1), part(13, 3)
    return F.struct(m.alias("matrix"), t.alias("transfer"), p.alias("primaries"), r.alias("full_range"), c.alias("chroma"), ((m < 4) & (t < 5) & (p < 4) & (c < 3) & (F.shiftright(v, 16) == 0)).alias("valid"))


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    side = right - left
    return left + F.shiftright(side, 1), side


def left_right(mid: Column, side: Column) -> tuple[Column, Column]:
    left = mid - F.shiftright(side, 1)
    return left, side + left


def in_16_bits(v: Column) -> Column:
    return v.between(-32768, 32767)


def frame_ticks(fps_n: Column, fps_d: Column) -> Column:
    """Microseconds of a frame, floored; null where 0 or above 32 bits."""
    t = F.floor(1_000_000 * fps_d / fps_n)
    return F.when((fps_n > 0) & (t > 0) & (t <= 0xFFFFFFFF), t)


def sample_ticks(sample: Column, rate: Column | int) -> Column:
    return F.floor(sample * 1_000_000 / _c(rate))


def color_meta(matrix: Column, transfer: Column, primaries: Column, color_range: Column, location: Column) -> Column:
    """Packed metadata of a probe's colour names; unknown names are unspecified."""
    # fixed values: names and their codes
    names = {
        0: (matrix, {"smpte170m": 1, "bt470bg": 1, "bt709": 2, "bt2020nc": 3}),
        4: (transfer, {"bt709": 1, "iec61966-2-1": 2, "smpte2084": 3, "arib-std-b67": 4}),
        8: (primaries, {"smpte170m": 1, "bt470bg": 1, "bt709": 2, "bt2020": 3}),
        12: (color_range, {"pc": 1, "jpeg": 1}),
        13: (location, {"left": 1, "center": 2}),
    }
    out = F.lit(0)
    for at, (column, codes) in names.items():
        for name, value in codes.items():
            out = out + F.when(column == name, value << at).otherwise(0)
    return out


#: Fixed values of the presentation transform by (matrix, full range): luma scale, luma offset, then red by v, green by u and v, blue by u.
#: Any matrix but 1 (BT.601) and 3 (BT.2020) is shown as BT.709.
PRESENTATION = {
    (1, True): (1, 0, 1.402, -0.344136, -0.714136, 1.772),
    (1, False): (1.164, 16 / 255, 1.596, -0.392, -0.813, 2.017),
    (3, True): (1, 0, 1.4746, -0.16455, -0.57135, 1.8814),
    (3, False): (1.164, 16 / 255, 1.6787, -0.1873, -0.6504, 2.1418),
    (2, True): (1, 0, 1.5748, -0.187324, -0.468124, 1.8556),
    (2, False): (1.164, 16 / 255, 1.793, -0.213, -0.533, 2.112),
}


def presented(y: Column, u: Column, v: Column, meta0: Column) -> tuple[Column, Column, Column]:
    """Eight-bit red, green and blue of samples, by the matrix and range bits of the packed metadata; halves go to the even number."""
    matrix, full = meta0.bitwiseAND(15), meta0.bitwiseAND(1 << 12) != 0

    def pick(k: int) -> Column:
        out = F.when(full, F.lit(float(PRESENTATION[2, True][k]))).otherwise(F.lit(float(PRESENTATION[2, False][k])))
        for m in (1, 3):
            for f in (True, False):
                out = F.when((matrix == m) & (full == f), F.lit(float(PRESENTATION[m, f][k]))).otherwise(out)
        return out

    scale, offset, rv, gu, gv, bu = map(pick, range(6))
    luma, cu, cv = scale * (y / 255 - offset), u / 255 - 0.5, v / 255 - 0.5
    return tuple(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255))).cast("bigint") for x in (luma + rv * cv, luma + gu * cu + gv * cv, luma + bu * cu))
