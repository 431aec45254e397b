"""Rules on one grey image as expressions over its row: no explosion, no exchange, no Python.

An image is an array of levels 0 .. 255, row by row, with its height and width in columns of integers. Every function gives
a column (a number or a struct), null where a level is null. Sums that decide between places or bins are rounded first, so that
the order of adding cannot turn a decision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a list of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def percentile(ordered: Column, share: float) -> Column:
    """Between the two nearest of sorted numbers, in proportion."""
    place = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(place).cast("int")
    return F.get(ordered, low) + (F.get(ordered, F.ceil(place).cast("int")) - F.get(ordered, low)) * (place - low)


def dct_periodicity(levels: Column, height: Column, width: Column) -> Column:
    """score, n_blocks, zero_bin_fraction: gaps in the histogram of the coefficient (1, 2) of the 8 x 8 blocks. Under ten blocks
    or five bins the score is 0 and the fraction null."""
    basis = numbers([0.25 * math.cos((2 * y + 1) * math.pi / 16) * math.cos((2 * x + 1) * math.pi / 8) for y in range(8) for x in range(8)])
    across = F.floor(width / 8)

    def coefficient(b: Column) -> Column:
        corner = (F.floor(b / across) * 8) * width + (b % across) * 8
        at = lambda i: F.get(levels, (corner + F.floor(i / 8) * width + i % 8).cast("int")) - 128.0
        return F.rint(F.round(F.aggregate(counted(F.lit(64)), F.lit(0.0), lambda s, i: s + F.get(basis, i) * at(i)), 6)).cast("bigint")

    def histogram(q: Column) -> Column:
        n = F.size(q)
        low, high = (F.round(percentile(q, p), 6).cast("bigint") for p in (0.02, 0.98))

        def scored(span: Column) -> Column:
            # The last bin holds its upper edge as well.
            bins = F.transform(F.sequence(span["low"], span["high"]), lambda k: F.size(F.filter(q, lambda v: (v == k) | ((k == span["high"]) & (v == k + 1)))).cast("double"))

            def rated(h: Column) -> Column:
                steps = F.transform(counted(F.size(h) - 1), lambda i: F.abs(F.get(h, i + 1) - F.get(h, i)))
                zero = F.size(F.filter(h, lambda v: v == 0)) / F.size(h)
                score = F.least(F.lit(1.0), 0.5 * zero + 0.05 * (mean(steps) / (mean(h) + 1e-9)))
                return F.when(F.size(h) >= 5, F.struct(score.alias("score"), n.alias("n_blocks"), zero.alias("zero_bin_fraction")))

            return let(bins, rated)

        return F.when(n >= 10, let(F.struct(low.alias("low"), high.alias("high")), scored))

    def whole(q: Column) -> Column:
        return F.coalesce(histogram(q), F.struct(F.lit(0.0).alias("score"), F.size(q).alias("n_blocks"), F.lit(None).cast("double").alias("zero_bin_fraction")))

    blocks = F.floor(height / 8) * across
    return F.when(~F.exists(levels, F.isnull), let(F.sort_array(F.transform(counted(blocks), coefficient)), whole))


def haar_step(x: Column, height: Column, width: Column) -> Column:
    """ll and the mean squares lh, hl, hh of one level; null under four pixels a side."""
    h, w = F.floor(height / 2), F.floor(width / 2)
    quads = F.transform(counted(h * w), lambda k: let((F.floor(k / w) * 2 * width + k % w * 2).cast("int"), lambda c: F.struct(F.get(x, c).alias("a"), F.get(x, c + 1).alias("b"), F.get(x, (c + width).cast("int")).alias("c"), F.get(x, (c + width + 1).cast("int")).alias("d"))))

    def bands(q: Column) -> Column:
        of = lambda sb, sc, sd: F.transform(q, lambda v: (v["a"] + sb * v["b"] + sc * v["c"] + sd * v["d"]) * 0.5)
        energy = lambda sb, sc, sd: mean(F.transform(of(sb, sc, sd), lambda v: v * v))
        return F.struct(of(1, 1, 1).alias("ll"), energy(-1, 1, -1).alias("lh"), energy(1, -1, -1).alias("hl"), energy(-1, -1, 1).alias("hh"), h.cast("int").alias("height"), w.cast("int").alias("width"))

    return F.when((h >= 2) & (w >= 2), let(quads, bands))


def haar_energies(levels: Column, height: Column, width: Column) -> Column:
    """Array of three structs lh, hl, hh, hf_total (null from the level on that has under four pixels a side)."""
    def energies(step: Column) -> Column:
        return F.when(step.isNotNull(), F.struct(step["lh"].alias("lh"), step["hl"].alias("hl"), step["hh"].alias("hh"), (step["lh"] + step["hl"] + step["hh"]).alias("hf_total")))

    third = lambda s: haar_step(s["ll"], s["height"], s["width"])
    two = lambda one: let(third(one), lambda second: let(third(second), lambda last: F.array(energies(one), energies(second), energies(last))))
    return let(F.transform(levels, lambda v: v / 255.0), lambda x: let(haar_step(x, height, width), two))


#: Steps (rows, columns) of distances 1 and 2 at 0, 45 and 90 degrees, rounded to pixels: at 45 degrees both are one pixel.
GLCM_STEPS = ((0, 1), (1, 1), (1, 0), (0, 2), (1, 1), (2, 0))


def glcm(levels: Column, height: Column, width: Column) -> Column:
    """contrast, dissimilarity, homogeneity, energy, correlation of 16 grey levels: means over the symmetric matrices of six
    steps. A matrix of one level has correlation 1; an image too small for a step gives null."""
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")

    def properties(q: Column, dy: int, dx: int) -> Column:
        h, w = height - dy, width - dx
        pair = lambda k: let((F.floor(k / w) * width + k % w).cast("int"), lambda c: F.get(q, c) * 16 + F.get(q, (c + width * dy + dx).cast("int")))
        codes = F.transform(counted(F.greatest(h, F.lit(0)) * F.greatest(w, F.lit(0))), pair)
        turned = lambda c: F.transform(c, lambda v: v % 16 * 16 + F.floor(v / 16).cast("int"))

        def cells(c: Column) -> Column:
            """Of sorted codes each once, with its share: at most 256."""
            starts = F.filter(counted(F.size(c)), lambda k: (k == 0) | (F.get(c, k) != F.get(c, k - 1)))
            return let(starts, lambda s: F.transform(s, lambda k, i: F.struct(F.floor(F.get(c, k) / 16).cast("int").alias("i"), (F.get(c, k) % 16).alias("j"), ((F.coalesce(F.get(s, i + 1), F.size(c)) - k) / F.size(c)).alias("p"))))

        def rated(p: Column) -> Column:
            average = lambda f: F.aggregate(p, F.lit(0.0), lambda s, v: s + v["p"] * f(v["i"], v["j"]))

            def correlation(mid: Column) -> Column:
                return let(average(lambda i, j: (i - mid) * (i - mid)), lambda var: F.when(var < 1e-15, F.lit(1.0)).otherwise(average(lambda i, j: (i - mid) * (j - mid)) / var))

            energy = F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, v: s + v["p"] * v["p"]))
            return F.when(F.size(p) > 0, F.array(average(lambda i, j: (i - j) * (i - j)), average(lambda i, j: F.abs(i - j)), average(lambda i, j: 1.0 / (1.0 + (i - j) * (i - j))), energy, let(average(lambda i, j: i), correlation)))

        return let(codes, lambda c: let(F.sort_array(F.concat(c, turned(c))), lambda o: let(cells(o), rated)))

    def averaged(q: Column) -> Column:
        each = lambda found, k: mean(F.transform(found, lambda v: F.get(v, F.lit(k))))
        return let(F.array(*[properties(q, dy, dx) for dy, dx in GLCM_STEPS]), lambda found: F.when(~F.exists(found, F.isnull), F.struct(*[each(found, k).alias(name) for k, name in enumerate(names)])))

    return let(F.transform(levels, lambda v: F.least(F.lit(15), F.greatest(F.lit(0), F.floor(v / 16.0).cast("int")))), averaged)


def area_rows(levels: Column, height: Column, width: Column, n: int, along: bool) -> Column:
    """levels with n rows (along: n columns) of area means; height and width are those of levels."""
    size = width if along else height
    other = height if along else width

    def target(k: Column) -> Column:
        t, rest = (k % n, F.floor(k / n)) if along else (F.floor(k / other), k % other)
        low, high = t * size / F.lit(float(n)), (t + 1) * size / F.lit(float(n))
        first, last = F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int")
        at = lambda i: F.get(levels, (rest * width + i if along else i * width + rest).cast("int"))
        return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda s, i: s + at(i) * (F.least(high, i + 1.0) - F.greatest(low, i.cast("double")))) / (high - low)

    return F.transform(counted(other * n), target)


def dct_hash(levels: Column, height: Column, width: Column) -> Column:
    """64 bits in hex: which of the 8 x 8 lowest frequencies of the image at 32 x 32 reach the median of rows 1 to 7. Null under
    32 pixels a side, where the image would have to be made larger."""
    side = 32
    cosine = [[math.sqrt((1 if u == 0 else 2) / side) * math.cos((2 * x + 1) * u * math.pi / (2 * side)) for x in range(side)] for u in range(8)]
    waves = numbers([v for row in cosine for v in row])
    small = let(area_rows(levels, height, width, side, True), lambda s: area_rows(s, height, F.lit(side), side, False))
    rounded = F.transform(small, lambda v: F.rint(F.round(v, 6)))
    dot = lambda at, wave: F.aggregate(counted(F.lit(side)), F.lit(0.0), lambda s, i: s + at(i) * F.get(waves, wave * side + i))

    def spectrum(p: Column) -> Column:
        lines = F.transform(counted(F.lit(side * 8)), lambda k: dot(lambda i: F.get(p, (F.floor(k / 8) * side + i).cast("int")), k % 8))
        return let(lines, lambda t: F.transform(counted(F.lit(64)), lambda k: F.round(dot(lambda i: F.get(t, i * 8 + k % 8), F.floor(k / 8).cast("int")), 6)))

    def bits(c: Column) -> Column:
        ordered = F.sort_array(F.slice(c, 9, 56))
        middle = (F.get(ordered, F.lit(27)) + F.get(ordered, F.lit(28))) / 2.0

        def word(m: Column) -> Column:
            bit = lambda k, weight: F.when(F.get(c, k) >= m, weight).otherwise(0)
            return F.array_join(F.transform(counted(F.lit(16)), lambda k: F.substring(F.lit("0123456789abcdef"), 1 + bit(4 * k, 8) + bit(4 * k + 1, 4) + bit(4 * k + 2, 2) + bit(4 * k + 3, 1), F.lit(1))), "")

        return let(middle, word)

    return F.when((height >= side) & (width >= side), let(rounded, lambda p: let(spectrum(p), bits)))


def row_means(levels: Column, height: Column, width: Column) -> Column:
    """The profile of an image from top to bottom."""
    return F.transform(counted(height), lambda y: mean(F.slice(levels, (y * width + 1).cast("int"), width.cast("int"))))


def profile_peak(profile: Column) -> Column:
    """peak, lag: the largest autocorrelation from lag max(2, n // 64) to under n // 2, the first of equals; 0 and 0 for profiles
    under eight values or without variation."""
    none = F.struct(F.lit(0.0).alias("peak"), F.lit(0).alias("lag"))

    def searched(z: Column) -> Column:
        n = F.size(z)
        energy = total(F.transform(z, lambda v: v * v))
        start = F.greatest(F.lit(2), F.floor(n / 64).cast("int"))
        stop = F.greatest(start + 1, F.floor(n / 2).cast("int"))
        product = lambda lag: F.aggregate(counted(n - lag), F.lit(0.0), lambda s, i: s + F.get(z, i) * F.get(z, i + lag))
        best = lambda e: F.array_max(F.transform(F.sequence(start, stop - 1), lambda lag: F.struct(F.round(product(lag) / e, 9).alias("peak"), (-lag).alias("back"))))
        found = lambda b: F.struct(b["peak"].alias("peak"), (-b["back"]).alias("lag"))
        return let(energy, lambda e: F.when(e > 1e-12, let(best(e), found)).otherwise(none))

    centred = lambda p: let(mean(p), lambda m: let(F.transform(p, lambda v: v - m), searched))
    return let(profile, lambda p: F.when(F.size(p) < 8, none).otherwise(centred(p)))
