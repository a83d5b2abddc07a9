"""Vector and score functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def rounded(x: Column | str, places: int) -> Column:
    """x rounded half up; what rounds to zero keeps its sign, as IEEE arithmetic has it and F.round, which goes by decimals, has not."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x, places)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def with_scalar(v: Column, scalar: Column, fn) -> Column:
    """fn(x, scalar) of each x: the scalar is worked out once, which a lambda that holds it would do for every x."""
    return F.zip_with(v, F.array_repeat(scalar, F.size(v)), fn)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """x / |x|; a zero vector has no direction and gives NaN."""
    return with_scalar(doubles(v), norm(v), lambda x, n: F.when(n == 0, F.lit(float("nan"))).otherwise(x / n))


def softmax(v: Column) -> Column:
    """Max-shifted; an empty array stays empty."""
    e = with_scalar(doubles(v), F.array_max(doubles(v)), lambda x, most: F.exp(x - most))
    return with_scalar(e, total(e), lambda x, t: x / t)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_pool(vectors: Column, mask: Column, weighted: bool = False) -> Column:
    """Mean of token vectors by mask, with weights 1, 2, 3 ... if weighted."""
    place = F.sequence(F.lit(1), F.greatest(F.size(vectors), F.lit(1)))
    weight = F.zip_with(mask, place, lambda m, i: m.cast("double") * (i.cast("double") if weighted else F.lit(1.0)))
    scaled = F.zip_with(vectors, weight, lambda v, w: F.transform(doubles(v), lambda x: x * w))
    zero = F.transform(doubles(F.element_at(vectors, 1)), lambda x: x * 0)
    return with_scalar(F.aggregate(scaled, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), total(weight), lambda x, t: x / t)


def first_pool(vectors: Column) -> Column:
    return F.element_at(vectors, 1)


def last_pool(vectors: Column) -> Column:
    return F.element_at(vectors, -1)


def standardize(v: Column, length: Column, pad: float = 0.0) -> Column:
    """(x - mean) / sqrt(var + 1e-7) over the first `length` values, pad after them."""
    own = F.slice(doubles(v), F.lit(1), length)
    centred = with_scalar(own, total(own) / F.size(own), lambda x, mean: x - mean)
    spread = F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(own) + 1e-7)
    return F.concat(with_scalar(centred, spread, lambda x, s: x / s), F.array_repeat(F.lit(pad), F.size(v) - F.size(own)))


def padded(v: Column, length: Column, pad: Column, left: bool = False) -> Column:
    fill = F.array_repeat(pad, F.greatest(length - F.size(v), F.lit(0)).cast("int"))
    return F.concat(fill, v) if left else F.concat(v, fill)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def truncated(v: Column, length: int, multiple: int = 1) -> Column:
    return F.slice(v, 1, -(-length // multiple) * multiple)


def stride_slice(v: Column, step: int) -> Column:
    """Every step-th element from the first on."""
    return F.filter(v, lambda _, i: i % step == 0)


def sink_positions(n: Column, sinks: int, window: int) -> Column:
    """Positions that a bounded cache with sinks keeps: the first few and the last."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda p: (p < sinks) | (p >= n - (window - sinks)))


# ---------------------------------------------------------------- boxes


def center_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - 0.5 * w).alias("x0"), (cy - 0.5 * h).alias("y0"), (cx + 0.5 * w).alias("x1"), (cy + 0.5 * h).alias("y1"))


def corners_to_center(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    common = side("x0", "x1") * side("y0", "y1")
    return common / (area(a) + area(b) - common)


def box_to_grid(x: Column, size: Column) -> Column:
    """A coordinate on a grid of 1000, truncated."""
    return (1000 * (x / size)).cast("int")


def patch_index(x0: Column, y0: Column, x1: Column, y1: Column, side: int) -> Column:
    """Numbers of the upper left and lower right patch that a box of the unit square covers; an empty box is an error."""
    bad = (x1 <= x0) | (y1 <= y0)
    ul = F.floor(y0 * side) * side + F.floor(x0 * side)
    lr = (F.ceil(y1 * side) - 1) * side + F.ceil(x1 * side) - 1
    return F.when(bad, F.raise_error(F.lit("a box needs x1 > x0 and y1 > y0")).cast("struct<ul:bigint,lr:bigint>")).otherwise(F.struct(ul.cast("long").alias("ul"), lr.cast("long").alias("lr")))


def patch_box(ul: Column, lr: Column, side: int) -> Column:
    """The box between patches: whole cell for one cell, cell width for one row or column, else centre to centre."""
    cell = 1.0 / side
    x1, y1, x2, y2 = F.pmod(ul, F.lit(side)), F.floor(ul / side), F.pmod(lr, F.lit(side)), F.floor(lr / side)
    half = cell / 2
    one, line = ul == lr, (x1 == x2) | (y1 == y2)
    low = lambda v: F.when(one, v * cell).when(line, v * cell).otherwise(v * cell + half)
    high = lambda v: F.when(one, v * cell + cell).when(line, v * cell + cell).otherwise(v * cell + half)
    return F.struct(low(x1).alias("x0"), low(y1).alias("y0"), high(x2).alias("x1"), high(y2).alias("y1"))


# ---------------------------------------------------------------- audio and distributions

#: The three mel scales.
HTK, KALDI, SLANEY = "htk", "kaldi", "slaney"
_KNEE_HZ, _KNEE_MEL, _LOG_STEP = 1000.0, 15.0, 27.0


def hertz_to_mel(hz: Column, scale: str = HTK) -> Column:
    if scale == HTK:
        return 2595.0 * F.log10(1 + hz / 700.0)
    if scale == KALDI:
        return 1127.0 * F.log(1 + hz / 700.0)
    return F.when(hz >= _KNEE_HZ, _KNEE_MEL + F.log(hz / _KNEE_HZ) * (_LOG_STEP / F.log(F.lit(6.4)))).otherwise(3.0 * hz / 200.0)


def mel_to_hertz(mel: Column, scale: str = HTK) -> Column:
    if scale == HTK:
        return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)
    if scale == KALDI:
        return 700.0 * (F.exp(mel / 1127.0) - 1)
    return F.when(mel >= _KNEE_MEL, _KNEE_HZ * F.exp(F.log(F.lit(6.4)) / _LOG_STEP * (mel - _KNEE_MEL))).otherwise(200.0 * mel / 3.0)


def hertz_to_octave(hz: Column, tuning: float = 0.0, bins: int = 12) -> Column:
    return F.log2(hz / (440.0 * 2.0 ** (tuning / bins) / 16.0))


def decibels(x: Column, reference: float = 1.0, least: float = 1e-10, span: float | None = None, power: bool = True) -> Column:
    """10 or 20 log10 of x over the reference, both clipped at `least`; span is for db_range over a whole spectrogram."""
    k = 10.0 if power else 20.0
    out = k * (F.log10(F.greatest(x, F.lit(least))) - F.log10(F.lit(max(reference, least))))
    return out if span is None else F.greatest(out, F.lit(-span))


def signal_window(length: int, name: str = "hann", periodic: bool = True) -> Column:
    """An array of window weights: boxcar, hamming, hann or povey."""
    n = length + 1 if periodic else length
    at = F.sequence(F.lit(0), F.lit(length - 1))
    turn = lambda i: F.cos(2 * 3.141592653589793 * i / (n - 1))
    shapes = {"boxcar": lambda i: F.lit(1.0), "hamming": lambda i: 0.54 - 0.46 * turn(i), "hann": lambda i: 0.5 - 0.5 * turn(i), "povey": lambda i: F.pow(0.5 - 0.5 * turn(i), 0.85)}
    return F.transform(at, shapes[name])


def squareplus(x: Column) -> Column:
    return (x + F.sqrt(x * x + 4.0)) / 2.0


def student_parameters(df: Column, loc: Column, scale: Column) -> Column:
    return F.struct((2.0 + squareplus(df)).alias("df"), loc.alias("loc"), F.greatest(squareplus(scale), F.lit(1.1920929e-07)).alias("scale"))


def rgb_to_id(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b


def id_to_rgb(n: Column) -> Column:
    return F.struct(F.pmod(n, F.lit(256)).alias("r"), F.pmod(F.floor(n / 256), F.lit(256)).alias("g"), F.pmod(F.floor(n / 65536), F.lit(256)).alias("b"))
