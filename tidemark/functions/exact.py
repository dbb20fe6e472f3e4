"""Exact arithmetic beyond the digits that Spark's decimal operators keep, as Column expressions.

A decimal(38,9) is taken as its *units*, a whole number of billionths in decimal(38,0): operators on scale 0 never round,
and the ``try_`` ones give null where 38 digits don't hold the result, which callers report as OUT_OF_RANGE. A fraction
is struct(n, d) of two such numbers in lowest terms, d above 0. Products are divided by common factors before they are
made, so that only a result that really has more than 38 digits is refused; comparisons multiply crosswise in limbs of
13 digits and refuse nothing. Everyday amounts take Spark's own operators, whose results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL, WHOLE = "decimal(38,9)", "decimal(38,0)"
PLACES = 9
LIMB = 10**13
TRIES = 40  # steps of Euclid's algorithm on bigints before it goes on with decimals
STEPS = 185  # of Euclid's algorithm for numbers of 38 digits: F(184) has 38 digits


def whole(n: int) -> Column:
    return F.lit(str(n)).cast(WHOLE)


def let(x: Column, f) -> Column:
    """f(x), x being computed once."""
    return F.transform(F.array(x), f)[0]


def negated(u: Column) -> Column:
    """-u of a whole number. Spark's own minus sign and ``abs`` keep 34 digits only."""
    return F.try_multiply(u, whole(-1)).cast(WHOLE)


def size(u: Column) -> Column:
    return F.when(u < 0, negated(u)).otherwise(u.cast(WHOLE))


def units(v: Column) -> Column:
    """A decimal(38,9) in billionths."""
    return F.replace(v.cast(DECIMAL).cast("string"), F.lit("."), F.lit("")).cast(WHOLE)


def of_units(u: Column, places: int = PLACES) -> Column:
    """The decimal(38, places) of so many units of its last place."""

    def made(s):
        t = F.when(F.length(s["t"]) <= places, F.lpad(s["t"], places + 1, "0")).otherwise(s["t"])
        cut = F.greatest(F.length(s["t"]) - places, F.lit(1))
        return F.concat(s["sign"], t.substr(F.lit(1), cut), F.lit("."), F.right(t, F.lit(places))).try_cast(f"decimal(38,{places})")

    parts = let(u, lambda u: F.struct(size(u).cast("string").alias("t"), F.when(u < 0, "-").otherwise("").alias("sign")))
    return let(parts, made)


def divided(n: Column, d: Column) -> Column:
    """n / d of whole numbers where d divides n. Spark's own quotient holds 32 digits before the point."""
    big, cut = whole(10**32), whole(10**19)
    plain = lambda a, b: F.try_divide(a, b).cast(WHOLE)

    def long(s):
        n, d, high = s["n"], s["d"], s["h"]
        rest = F.try_add(F.try_multiply((high % d).cast(WHOLE), cut), (n % cut).cast(WHOLE))
        return F.try_add(F.try_multiply(plain(high - high % d, d), cut), plain(rest, d))

    def made(s):
        n, d = s["n"], s["d"]
        split = let(F.struct(n.alias("n"), d.alias("d"), plain(n - n % cut, cut).alias("h")), long)
        return F.when(((n < big) & (n > negated(big))) | (d >= cut), plain(n, d)).otherwise(split)

    return let(F.struct(n.cast(WHOLE).alias("n"), d.cast(WHOLE).alias("d")), made)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers; that of 0 and 0 is 1."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(WHOLE).alias("b")))
    start = F.struct(size(a).alias("a"), size(b).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.when(s["a"] == 0, whole(1)).otherwise(s["a"]))


def _pair(n: Column, d: Column) -> Column:
    """struct(n, d) with d above 0."""
    return F.struct(F.when(d < 0, negated(n)).otherwise(n).cast(WHOLE).alias("n"), size(d).alias("d"))


def _lowest_long(n: Column, d: Column) -> Column:
    """struct(n, d) in lowest terms of numbers that fit a bigint, by Euclid's algorithm on what is left without common
    closing zeros; null where TRIES steps don't end it."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))

    def zeros(x):
        t = x.cast("string")
        return F.when(x == 0, 18).otherwise(F.length(t) - F.length(F.rtrim(t, F.lit("0"))))

    def cut(s):
        ten = F.pow(F.lit(10.0), F.least(zeros(s["n"]), zeros(s["d"]))).cast("long")
        return F.struct(F.call_function("div", s["n"], ten).alias("n"), F.call_function("div", s["d"], ten).alias("d"))

    def made(s):
        start = F.struct(F.abs(s["n"]).alias("a"), F.abs(s["d"]).alias("b"))
        g = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, step, lambda s: F.when(s["b"] == 0, s["a"]))
        part = lambda x, g: F.call_function("div", x, g).cast(WHOLE)
        sign = F.when(s["d"] < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
        return let(g, lambda g: F.when(g > 0, F.struct(part(s["n"] * sign, g).alias("n"), part(F.abs(s["d"]), g).alias("d"))))

    return let(let(F.struct(n.cast("long").alias("n"), d.cast("long").alias("d")), cut), made)


def lowest(n: Column, d: Column) -> Column:
    """struct(n, d) in lowest terms with d above 0; null for a zero or null denominator or a null numerator."""

    def made(s):
        small = F.greatest(s["n"], s["d"]) < whole(10**18)
        small &= F.least(s["n"], s["d"]) > whole(-(10**18))
        slow = let(gcd(s["n"], s["d"]), lambda g: _pair(divided(s["n"], g), divided(s["d"], g)))
        return F.when(s["n"].isNotNull() & (s["d"] != 0), F.coalesce(F.when(small, _lowest_long(s["n"], s["d"])), slow))

    return let(F.struct(n.cast(WHOLE).alias("n"), d.cast(WHOLE).alias("d")), made)


def fraction(num: Column, den: Column | None = None) -> Column:
    """num / den of decimals (without den: num itself) as struct(n, d) in lowest terms."""
    return lowest(units(num), whole(10**PLACES) if den is None else units(den))


def _checked(n: Column, d: Column) -> Column:
    """struct(n, d) of parts in lowest terms already; null if one of them has more than 38 digits."""
    pair = F.struct(n.cast(WHOLE).alias("n"), d.cast(WHOLE).alias("d"))
    return let(pair, lambda s: F.when(s["n"].isNotNull() & s["d"].isNotNull(), s))


def _both(x: Column, y: Column, f) -> Column:
    """f(x, y), each computed once."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: f(s["x"], s["y"]))


def times(x: Column, y: Column) -> Column:
    """Product of two fractions; null if it doesn't fit."""

    def made(x, y):
        cross = F.struct(gcd(x["n"], y["d"]).alias("g"), gcd(y["n"], x["d"]).alias("h"))
        return let(cross, lambda s: _checked(F.try_multiply(divided(x["n"], s["g"]), divided(y["n"], s["h"])), F.try_multiply(divided(x["d"], s["h"]), divided(y["d"], s["g"]))))

    return _both(x, y, made)


def over(x: Column, y: Column) -> Column:
    """Quotient of two fractions; null if it doesn't fit or y is 0."""
    return _both(x, y, lambda x, y: times(x, F.when(y["n"] != 0, _pair(y["d"], y["n"]))))


def plus_fractions(x: Column, y: Column) -> Column:
    """Sum of two fractions; null if it, or its terms over their common denominator, don't fit."""

    def made(x, y):
        def sum_of(s):
            return lowest(F.try_add(F.try_multiply(x["n"], s["b"]), F.try_multiply(y["n"], s["a"])), F.try_multiply(x["d"], s["b"]))

        return let(gcd(x["d"], y["d"]), lambda g: let(F.struct(divided(x["d"], g).alias("a"), divided(y["d"], g).alias("b")), sum_of))

    return _both(x, y, made)


def _limbs(a: Column) -> Column:
    """A whole number from 0 as [low, middle, high] of 13 digits each."""

    def made(a):
        low = (a % whole(LIMB)).cast(WHOLE)
        rest = divided(a - low, whole(LIMB))
        return let(F.struct(low.alias("l"), rest.alias("r")), lambda s: F.array(s["l"], (s["r"] % whole(LIMB)).cast(WHOLE), divided(s["r"] - s["r"] % whole(LIMB), whole(LIMB))))

    return let(size(a), made)


def wide_product(a: Column, b: Column) -> Column:
    """|a| * |b| of whole numbers as an array of six limbs of 13 digits, highest first; such arrays compare as numbers."""

    def carry(acc, c):
        return let((c + acc["c"]).cast(WHOLE), lambda t: F.struct(F.try_divide(t - t % whole(LIMB), whole(LIMB)).cast(WHOLE).alias("c"), F.concat(F.array((t % whole(LIMB)).cast(WHOLE)), acc["l"]).alias("l")))

    def made(x, y):
        sums = [sum((x[i] * y[k - i] for i in range(3) if 0 <= k - i < 3), whole(0)).cast(WHOLE) for k in range(5)]
        start = F.struct(whole(0).alias("c"), F.array().cast(f"array<{WHOLE}>").alias("l"))
        return F.aggregate(F.array(*sums), start, carry, lambda acc: F.concat(F.array(acc["c"]), acc["l"]))

    return _both(_limbs(a), _limbs(b), made)


def compare(x: Column, y: Column) -> Column:
    """-1, 0 or 1 as fraction x is below, equal to or above y, by products crosswise; null only for nulls."""

    def made(x, y):
        sign = lambda f: F.signum(f["n"].cast("double")).cast("int")
        order = _both(wide_product(x["n"], y["d"]), wide_product(y["n"], x["d"]), lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0))
        return F.when(sign(x) != sign(y), F.when(sign(x) > sign(y), 1).otherwise(-1)).when(sign(x).isNotNull(), order * F.when(sign(x) < 0, -1).otherwise(1))

    return _both(x, y, made)


def rounded(f: Column, places: int = PLACES) -> Column:
    """A fraction as decimal(38, places), halves away from zero; null if its digits don't fit."""
    unit = whole(10**places)

    def made(f):
        def parts(s):  # a = quotient * d + rest; rest * unit = part * d + left
            part = divided(s["m"] - s["l"], f["d"]) + F.when(s["l"] >= f["d"] - s["l"], 1).otherwise(0)
            made = F.try_add(F.try_multiply(divided(size(f["n"]) - s["r"], f["d"]), unit), part.cast(WHOLE))
            return of_units(let(made, lambda m: F.when(f["n"] < 0, negated(m)).otherwise(m)), places)

        rest = (size(f["n"]) % f["d"]).cast(WHOLE)
        more = let(rest, lambda r: F.struct(r.alias("r"), F.try_multiply(r, unit).alias("m")))
        return let(let(more, lambda s: F.struct(s["r"].alias("r"), s["m"].alias("m"), (s["m"] % f["d"]).cast(WHOLE).alias("l"))), parts)

    def quick(f):  # as a bigint of units
        few = (f["n"] > whole(-(10**18))) & (f["n"] < whole(10**18)) & (f["d"] < whole(10**18))
        near = few & (size(f["n"]) < (f["d"] * whole(10 ** (17 - places))).cast(WHOLE))
        q = F.call_function("div", (size(f["n"]) * whole(2 * 10**places) + f["d"]).cast(WHOLE), (f["d"] * whole(2)).cast(WHOLE)) * F.when(f["n"] < 0, F.lit(-1)).otherwise(F.lit(1))
        return F.when(near, F.try_divide(q.cast("decimal(18,0)"), F.lit(str(10**places)).cast(f"decimal({places + 1},0)")).cast(f"decimal(38,{places})"))

    return let(f, lambda f: F.coalesce(quick(f), made(f)))


def ends_within(f: Column, places: int = PLACES) -> Column:
    """Whether a fraction is a decimal of at most so many places."""
    return whole(10**places) % f["d"] == 0


def plus(a: Column, b: Column) -> Column:
    """a + b of decimals as decimal(38,9); null if it doesn't fit."""
    fast = a.try_cast("decimal(28,9)") + b.try_cast("decimal(28,9)")
    return F.coalesce(fast.cast(DECIMAL), of_units(F.try_add(units(a), units(b))))


def minus(a: Column, b: Column) -> Column:
    """a - b of decimals as decimal(38,9); null if it doesn't fit."""
    fast = a.try_cast("decimal(28,9)") - b.try_cast("decimal(28,9)")
    return F.coalesce(fast.cast(DECIMAL), of_units(F.try_subtract(units(a), units(b))))


def total(values: list[Column]) -> Column:
    """Sum of decimals, null ones left out, as decimal(38,9); 0 without any, null if it doesn't fit."""
    each = F.array_compact(F.array(*[units(v) for v in values]))
    return of_units(F.aggregate(each, whole(0), lambda a, x: F.try_add(a, x).cast(WHOLE)))


def by_whole(v: Column, k: Column) -> Column:
    """v times a whole number as decimal(38,9); null if it doesn't fit."""
    fast = v.try_cast("decimal(28,9)") * k.try_cast("decimal(9,0)")
    return F.coalesce(fast.cast(DECIMAL), of_units(F.try_multiply(units(v), k.cast(WHOLE))))


def quotient(num: Column, den: Column, places: int) -> Column:
    """num / den of decimals as decimal(38, places); null for a zero denominator or if it doesn't fit."""
    small = num.try_cast("decimal(24,9)").isNotNull() & den.try_cast("decimal(24,9)").isNotNull()
    fast = F.try_divide(num.try_cast("decimal(24,9)"), den.try_cast("decimal(24,9)")).try_cast(f"decimal(38,{places})")
    return F.when(small, fast).when(num.isNotNull() & den.isNotNull(), rounded(fraction(num, den), places))
