"""Array expressions over modes: everything stays in Catalyst, nothing is exploded.

A mode is ``array<array<double>>`` (harmonics by radii) on the uniform radial grid 0..1; boundary
profiles are ``array<double>`` with NULL where undefined. Missing values are NULL throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-14


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once. An expression is computed at each place it stands in, and within a lambda at
    each call; a lambda's variable is not."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def total(a: Column) -> Column:
    """Sum of an array, NULL entries left out."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def population_std(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.nullif(F.size(a), F.lit(0)))


def median(a: Column) -> Column:
    """Middle value, or the mean of the two middle ones."""
    s, n = F.array_sort(a), F.size(a)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(s, F.floor(n / 2).cast("int"))) / 2


def grid(n: Column) -> Column:
    """The uniform grid 0..1 of n points (n > 1)."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("double") / (n - 1))


def radial_energy(mode: Column) -> Column:
    """W(r): the sum of squared amplitudes over the harmonics at each radius."""
    zero = F.transform(F.get(mode, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(mode, zero, lambda acc, row: F.zip_with(acc, row, lambda w, a: w + a * a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def centroid(w: Column, r: Column) -> Column:
    return dot(w, r) / (total(w) + TINY)


def spread(w: Column, r: Column, center: Column) -> Column:
    return F.sqrt(total(F.zip_with(w, r, lambda x, y: x * (y - center) * (y - center))) / (total(w) + TINY))


def differences(a: Column) -> Column:
    """a[i+1] - a[i]; empty for fewer than two values."""
    n = F.size(a)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(1))), lambda y, x: y - x))


def flat(mode: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.flatten(F.transform(mode, f))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def band_distance(omega2: Column, low2: Column, high2: Column) -> Column:
    """Distance of omega squared from the band [low2, high2] at each radius, 0 inside, NULL where a
    boundary is missing."""
    return F.zip_with(low2, high2, lambda lo, hi: F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("double")).when(omega2 < lo, lo - omega2).when(omega2 > hi, omega2 - hi).otherwise(F.lit(0.0)))


def first_at(a: Column, value: Column) -> Column:
    """0-based position of the first entry equal to value, NULL if none."""
    return F.array_position(a, value).cast("int") - 1


def interpolate(x: Column, r: Column, y: Column) -> Column:
    """Piecewise linear y(r) at x on the uniform grid r of at least two points; ends are held."""
    n = F.size(r)
    at = F.least(F.greatest(F.floor(x * (n - 1)).cast("int"), F.lit(0)), n - 2)
    # Rounding may put x just outside the cell: step to the one that holds it.
    at = F.when((F.get(r, at) > x) & (at > 0), at - 1).when((F.get(r, at + 1) < x) & (at < n - 2), at + 1).otherwise(at)
    r0, r1, y0, y1 = F.get(r, at), F.get(r, at + 1), F.get(y, at), F.get(y, at + 1)
    return F.when(x <= F.get(r, F.lit(0)), F.get(y, F.lit(0))).when(x >= F.get(r, n - 1), F.get(y, n - 1)).otherwise(y0 + (y1 - y0) * (x - r0) / (r1 - r0))


def crossings(boundary: str, f: Column, valid: Column, r: Column, w: Column, shear_from: float) -> Column:
    """Zeros of f over runs of valid radii, as structs (boundary, r_cross, W_peak, shear_weighted).

    Each index looks only at its neighbours: it opens a zero run (f = 0 here, not before), whose end is
    the last index before the first later one that is not a valid zero, or it sees a change of sign to
    the next index. One record comes from each, at the run's middle or at the linear root.
    """

    def place(v: Column, zeros: Column, i: Column) -> Column:
        f, valid, r, w = (v[c] for c in ("f", "valid", "r", "w"))
        n, zero = F.size(f), lambda k: F.coalesce(F.get(zeros, k), F.lit(False))
        opens = zero(i) & ((i == 0) | ~zero(i - 1))
        end = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k > i) & ~zero(k)), F.lit(0)), n) - 1
        both = F.coalesce(F.get(valid, i), F.lit(False)) & (i < n - 1) & F.coalesce(F.get(valid, i + 1), F.lit(False))
        a, b = F.get(f, i), F.get(f, i + 1)
        part = F.try_divide(-a, b - a)
        root = F.when(both & (a * b < 0), F.get(r, i) + part * (F.get(r, i + 1) - F.get(r, i)))
        at = F.when(opens, (F.get(r, i) + F.get(r, end)) / 2).otherwise(root)
        height = lambda x: F.when(opens, interpolate(x, r, w)).otherwise(F.get(w, i) + part * (F.get(w, i + 1) - F.get(w, i)))
        return once(at, lambda x: F.when(x.isNotNull(), F.struct(x.alias("r_cross"), height(x).alias("W_peak"))))

    def places(v: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(v["f"]) - 1)
        zeros = F.transform(index, lambda i: F.get(v["valid"], i) & (F.get(v["f"], i) == 0))
        return once(zeros, lambda z: F.filter(F.transform(index, lambda i: place(v, z, i)), lambda x: x.isNotNull()))

    found = once(F.struct(f.alias("f"), valid.alias("valid"), r.alias("r"), w.alias("w")), places)
    past = lambda x: F.greatest(x["r_cross"] - shear_from, F.lit(0.0))
    return F.transform(found, lambda x: F.struct(F.lit(boundary).alias("boundary"), x["r_cross"].alias("r_cross"), x["W_peak"].alias("W_peak"), (x["W_peak"] * past(x) * past(x)).alias("shear_weighted")))


def cumulative_share(w: Column) -> Column:
    """Running sum over the total, by one pass that appends to an array of running sums."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    run = lambda a: F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"] + x)).alias("out")), lambda acc: acc["out"])
    return once(w, lambda a: once(total(a), lambda whole: F.transform(run(a), lambda x: F.try_divide(x, whole))))


def inverse_interpolate(q: float, share: Column, r: Column) -> Column:
    """r where the non-decreasing share reaches q, linear in between; the ends are held."""

    def place(share: Column, r: Column, j: Column) -> Column:
        n, a, b = F.size(share), F.get(share, j), F.get(share, j + 1)
        inner = F.get(r, j) + (F.get(r, j + 1) - F.get(r, j)) * F.try_divide(F.lit(q) - a, b - a)
        return F.when(j.isNull(), F.get(r, F.lit(0))).when(j >= n - 1, F.get(r, n - 1)).otherwise(inner)

    # The cell [j, j+1) that holds q begins at the last index with share <= q.
    last = lambda s: F.get(F.filter(F.reverse(F.sequence(F.lit(0), F.size(s) - 1)), lambda k: F.get(s, k) <= q), F.lit(0))
    return once(F.struct(share.alias("share"), r.alias("r")), lambda v: once(last(v["share"]), lambda j: place(v["share"], v["r"], j)))


def quantile_width(profile: Column, r: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """r(high) - r(low) of the profile's cumulative squared weight; 0 for a vanishing profile."""
    between = lambda v: inverse_interpolate(high, v["share"], v["r"]) - inverse_interpolate(low, v["share"], v["r"])
    width = lambda w: F.when(total(w) <= TINY, F.lit(0.0)).otherwise(once(F.struct(cumulative_share(w).alias("share"), r.alias("r")), between))
    return once(F.transform(profile, lambda a: a * a), width)


def abs_cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(F.abs(F.try_divide(dot(a, b), na * nb)))


def slew_limit(a: Column, step: int) -> Column:
    """Each value moved to within step of the one before it in the output."""
    start = F.slice(a, 1, 1)
    rest = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    last = lambda acc: F.element_at(acc, -1)
    return F.when(F.size(a) < 2, a).otherwise(F.aggregate(rest, start, lambda acc, x: F.concat(acc, F.array(F.least(F.greatest(x, last(acc) - step), last(acc) + step)))))


def median_filter(a: Column, k: int = 3) -> Column:
    """Median over a window of k clipped at the ends, cut to an integer (towards zero)."""
    half, n = k // 2, F.size(a)
    window = lambda i: F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: median(F.transform(window(i), lambda x: x.cast("double"))).cast("int"))


def fill_both_ways(a: Column) -> Column:
    """Missing values take the last known one before them, else the first known one after."""
    n = F.size(a)
    known = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i).isNotNull())
    before = lambda i: F.element_at(F.filter(known, lambda k: k <= i), -1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, F.when(F.size(F.filter(known, lambda k: k <= i)) > 0, before(i)).otherwise(F.get(known, F.lit(0)))))


def finite_blocks(a: Column) -> Column:
    """Runs of known values as structs (first, last), 0-based."""
    n = F.size(a)
    known = lambda i: (i >= 0) & (i < n) & F.get(a, i).isNotNull()
    index = F.sequence(F.lit(0), n - 1)
    firsts = F.filter(index, lambda i: known(i) & ~F.coalesce(known(i - 1), F.lit(False)))
    lasts = F.filter(index, lambda i: known(i) & ~F.coalesce(known(i + 1), F.lit(False)))
    return F.zip_with(firsts, lasts, lambda x, y: F.struct(x.alias("first"), y.alias("last")))


def mask_sentinel(a: Column, above: float = 999.0) -> Column:
    return F.transform(a, lambda x: F.when(F.isnan(x) | (x > above), F.lit(None).cast("double")).otherwise(x))


def smooth5(a: Column) -> Column:
    """Weights 1 2 3 2 1 over each run of known values, the run's ends repeated."""
    at = lambda i: F.when((i >= 0) & (i < F.size(a)), F.get(a, i))

    def one(x: Column, i: Column) -> Column:
        sides = lambda k: (F.coalesce(at(i + k), x), F.coalesce(F.when(at(i + k).isNotNull(), at(i + 2 * k)), at(i + k), x))
        (l1, l2), (r1, r2) = sides(-1), sides(1)
        return (l2 + 2 * l1 + 3 * x + 2 * r1 + r2) / 9

    return F.transform(a, one)


def monotonicity(a: Column) -> Column:
    """Size of the net change over the sum of the sizes of all steps between known neighbours: 1 for a monotone
    or constant profile, near 0 for a wavy one, NULL without a step."""
    steps = F.filter(differences(a), lambda x: x.isNotNull())
    way = total(absolute(steps))
    return F.when(F.size(steps) == 0, F.lit(None).cast("double")).when(way == 0, F.lit(1.0)).otherwise(F.abs(total(steps)) / way)


def turns(a: Column, sign: int) -> Column:
    """Number of inner maxima (sign 1) or minima (-1) within runs of known values; a flat top counts once."""
    moves = F.filter(F.transform(differences(a), lambda x: F.coalesce(F.signum(x), F.lit(2.0))), lambda x: x != 0)
    n = F.size(moves)
    pairs = F.zip_with(F.slice(moves, 1, F.greatest(n - 1, F.lit(0))), F.slice(moves, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: (x == sign) & (y == -sign))
    return F.size(F.filter(pairs, lambda x: x))
