"""Standard normal distribution function, its inverse, and roots of monotone functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation (1968) in the arrangement of West (2005),
# "Better approximations to cumulative normal functions"; double precision over the whole range.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SPLIT = 7.07106781186547
FAR_TAIL = 37.0
ROOT_TWO_PI = 2.506628274631
FRACTION_END = 0.65

# Wichura's algorithm AS 241 (1988), PPND16; coefficients from the constant term on.
# Near the centre in 0.180625 - (p - 0.5)^2, in the tails in sqrt(-log p) - 1.6 and, far out, - 5.
CENTRE_TOP = (
    3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
TAIL_TOP = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_BOTTOM = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
FAR_TOP = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
FAR_BOTTOM = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
CENTRE_REACH, CENTRE_SQUARE, TAIL_SHIFT, FAR_SHIFT = 0.425, 0.180625, 1.6, 5.0
# Halvings of a bracket: more than a double has binary digits.
HALVINGS = 56


def with_value(value: Column, formula: Callable[[Column], Column]) -> Column:
    """``formula(value)``, with the value computed once however often the formula names it."""
    return F.get(F.transform(F.array(value), formula), 0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda total, c: total * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(name: str) -> Column:
    """P(Z <= x) for a standard normal Z, x being the column ``name``.

    It takes a column name, not an expression, as x occurs in many places of the formula.
    """
    return _cdf(F.col(name))


def cdf_of(value: Column) -> Column:
    """P(Z <= value) of any expression; slower than ``normal_cdf``, as it is not compiled."""
    return with_value(value, _cdf)


def _cdf(x: Column) -> Column:
    size = F.abs(x)
    density = F.exp(-size * size / 2)
    centre = density * _polynomial(NUMERATOR, size) / _polynomial(DENOMINATOR, size)
    fraction = reduce(lambda rest, k: size + F.lit(float(k)) / rest, (4, 3, 2, 1), size + FRACTION_END)
    tail = (
        F.when(size > FAR_TAIL, 0.0)
        .when(size < SPLIT, centre)
        .otherwise(density / fraction / ROOT_TWO_PI)
    )
    return F.when(x > 0, 1.0).otherwise(0.0) + F.when(x > 0, -1.0).otherwise(1.0) * tail


def quantile_of(value: Column) -> Column:
    """The x with P(Z <= x) = value, for a value between 0 and 1; null otherwise."""
    return with_value(value, lambda p: F.when((p > 0) & (p < 1), _quantile(p)))


def _quantile(p: Column) -> Column:
    away = p - 0.5
    near = with_value(CENTRE_SQUARE - away * away, lambda r: _ratio(CENTRE_TOP, CENTRE_BOTTOM, r))
    far = with_value(F.sqrt(-F.log(F.least(p, 1 - p))), _tail_quantile)
    return F.when(F.abs(away) <= CENTRE_REACH, away * near).otherwise(F.signum(away) * far)


def _tail_quantile(root: Column) -> Column:
    return F.when(root <= FAR_SHIFT, _ratio(TAIL_TOP, TAIL_BOTTOM, root - TAIL_SHIFT)).otherwise(_ratio(FAR_TOP, FAR_BOTTOM, root - FAR_SHIFT))


def _ratio(top: tuple[float, ...], bottom: tuple[float, ...], x: Column) -> Column:
    return _polynomial(top[::-1], x) / _polynomial(bottom[::-1], x)


def crossing(low: Column, high: Column, is_below: Callable[[Column], Column]) -> Column:
    """The x between low and high up to which ``is_below(x)`` holds: the bracket is halved in one expression.

    Null if either end is null.
    """

    def halve(bracket: Column, _: Column) -> Column:
        return with_value(
            (bracket["low"] + bracket["high"]) / 2,
            lambda x: F.when(is_below(x), _bracket(x, bracket["high"])).otherwise(_bracket(bracket["low"], x)),
        )

    halvings = F.sequence(F.lit(1), F.lit(HALVINGS))
    found = F.aggregate(halvings, _bracket(low, high), halve, lambda bracket: (bracket["low"] + bracket["high"]) / 2)
    return F.when(low.isNotNull() & high.isNotNull(), found)


def _bracket(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
