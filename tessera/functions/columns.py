"""The same functions as native column expressions over ARRAY columns; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import kernels


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def doubles(s: Column) -> Column:
    return s.cast("array<double>")


def array_of(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def mean(s: Column) -> Column:
    return _sum(doubles(s)) / F.size(s)


def deviation(s: Column) -> Column:
    """Population standard deviation."""
    return let(doubles(s), lambda v: let(mean(v), lambda m: F.sqrt(_sum(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v))))


def z_normalize(s: Column) -> Column:
    def body(v: Column) -> Column:
        return let(F.struct(mean(v).alias("m"), deviation(v).alias("d")), lambda t: F.transform(v, lambda x: F.when(t["d"] > 0, (x - t["m"]) / t["d"]).otherwise(F.lit(0.0))))

    return let(doubles(s), body)


def segment(s: Column, dim: int, segments: int, i: int) -> Column:
    e = kernels.edges(dim, segments)
    return F.slice(s, int(e[i]) + 1, int(e[i + 1] - e[i]))


def paa(s: Column, dim: int, segments: int) -> Column:
    return let(doubles(s), lambda v: F.array(*(mean(segment(v, dim, segments, i)) for i in range(segments))))


def symbolize(means: Column, cuts: Column) -> Column:
    return let(cuts, lambda k: F.transform(means, lambda m: F.size(F.filter(k, lambda c: c < m))))


def symbol_at_bits(symbol: Column, bits: int, full: int) -> Column:
    """The first ``bits`` bits of a symbol of ``full`` bits."""
    return F.shiftright(symbol, full - bits)


def root_mask(word: Column, bits: int) -> Column:
    return F.aggregate(word, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.shiftright(x, bits - 1))


def z_key_hex(word: Column, segments: int, bits: int) -> Column:
    """The z-order key in hexadecimal; its length is a whole number of bytes."""
    return let(word, lambda w: _z_key_hex(w, segments, bits))


def _z_key_hex(word: Column, segments: int, bits: int) -> Column:
    planes = [F.shiftright(F.get(word, s), b).bitwiseAND(1).cast("string") for b in range(bits - 1, -1, -1) for s in range(segments)]
    planes += [F.lit("0")] * (-len(planes) % 8)
    return F.concat(*(F.lpad(F.conv(F.concat(*planes[i : i + 8]), 2, 16), 2, "0") for i in range(0, len(planes), 8)))


def region(symbol: Column, bits: int, cuts: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper cut of the region of a symbol of ``bits`` bits, under cuts for the full number of symbols; null: no end."""
    step = (len(cuts) + 1) >> bits
    table = array_of(cuts)
    return F.get(table, (symbol * step - 1).cast("int")), F.get(table, ((symbol + 1) * step - 1).cast("int"))


def midpoint(symbol: Column, cuts: Sequence[float]) -> Column:
    """The middle of a symbol's region; the outer regions go on as far as their neighbours are wide."""
    c = list(cuts)
    lows, highs = [2 * c[0] - c[1], *c], [*c, 2 * c[-1] - c[-2]]
    return F.get(array_of([(a + b) / 2 for a, b in zip(lows, highs, strict=True)]), symbol)


def envelope(s: Column, band: int) -> tuple[Column, Column]:
    """(greatest, least) within ``band`` places, as arrays."""

    def around(of):
        def body(x: Column) -> Column:
            n = F.size(x)
            return F.transform(F.sequence(F.lit(1), n), lambda i: of(F.slice(x, F.greatest(F.lit(1), i - band), F.least(n, i + band) - F.greatest(F.lit(1), i - band) + 1)))

        return let(doubles(s), body)

    return around(F.array_max), around(F.array_min)


def fourier(s: Column, dim: int, coefficients: int, skip_mean: bool = False) -> Column:
    """(real, -imaginary) pairs as sums of cosines and sines."""
    import math

    waves = []
    for j in range(coefficients):
        f = j // 2 + (1 if skip_mean else 0)
        wave = [(math.cos if j % 2 == 0 else math.sin)(2 * math.pi * f * t / dim) * math.sqrt(2.0 / dim) for t in range(dim)]
        waves.append(array_of(wave))
    return let(doubles(s), lambda x: F.array(*(_sum(F.zip_with(x, w, lambda a, b: a * b)) for w in waves)))


def quantize(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def sketch(s: Column, dim: int, segments: int) -> Column:
    """Array of (mean, deviation) by segment."""
    return let(doubles(s), lambda v: F.array(*(F.struct(mean(p).alias("mean"), deviation(p).alias("deviation")) for p in (segment(v, dim, segments, i) for i in range(segments)))))


def l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_compiled(a: Column, b: Column, dim: int) -> Column:
    """The same sum for arrays of ``dim`` doubles, an expression an element: no lambda, so it is compiled; long series keep the lambda."""
    if dim > 128:
        return l2(a, b)
    gaps = [F.get(a, i) - F.get(b, i) for i in range(dim)]
    return reduce(lambda acc, g: acc + g * g, gaps, F.lit(0.0))


def lb_keogh(upper: Column, lower: Column, s: Column) -> Column:
    over = _sum(F.zip_with(doubles(s), upper, lambda x, u: F.greatest(F.lit(0.0), x - u) * F.greatest(F.lit(0.0), x - u)))
    under = _sum(F.zip_with(doubles(s), lower, lambda x, v: F.greatest(F.lit(0.0), v - x) * F.greatest(F.lit(0.0), v - x)))
    return over + under


def sax_bound(means: Column, word: Column, cuts: Sequence[float], length: float) -> Column:
    """Lower bound of the squared L2 distance, from a query's segment means to a word."""
    table, n = array_of(cuts), len(cuts)

    def part(m: Column, w: Column) -> Column:
        lo, hi = F.get(table, (w - 1).cast("int")), F.when(w < n, F.get(table, w.cast("int")))
        return F.pow(F.greatest(F.lit(0.0), F.coalesce(lo - m, F.lit(0.0)), F.coalesce(m - hi, F.lit(0.0))), 2)

    return F.lit(float(length)) * _sum(F.zip_with(means, word, part))
