"""Special functions as column expressions: tail probabilities without a Python worker.

Series and continued fractions are evaluated from their far end with a number of terms that
follows the arguments, so each is one ``aggregate`` over a sequence with a single number as state.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, taken back by the recurrence."""
    x = x.cast("double")
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - back


def _backward(terms: Column, start: Column, step) -> Column:
    """step(value, k) for k = terms, ..., 1."""
    return F.aggregate(F.reverse(F.sequence(F.lit(1), terms.cast("int"))), start, lambda t, k: step(t, k.cast("double")))


def gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x), the upper regularized incomplete gamma function, for a > 0 and x >= 0."""
    a, x = a.cast("double"), x.cast("double")
    terms = F.least(F.lit(20_000.0), 200 + 6 * F.sqrt(a))
    lead = F.exp(-x + a * F.log(x) - log_gamma(a))
    below = lead / a * _backward(terms, F.lit(1.0), lambda s, k: 1 + s * x / (a + k))
    fraction = _backward(terms, x + 2 * F.floor(terms) + 1 - a, lambda t, k: x + 2 * k - 1 - a - k * (k - a) / t)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - below).otherwise(lead / fraction)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """I(x; a, b), the regularized incomplete beta function, for a, b > 0 and 0 <= x <= 1."""

    def share(a: Column, b: Column, x: Column) -> Column:
        def step(t: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            return 1 + F.when(k % 2 == 1, odd).otherwise(even) / t

        lead = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        return lead / _backward(F.least(F.lit(40_000.0), 200 + 12 * F.sqrt(a + b)), F.lit(1.0), step)

    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, share(a, b, x)).otherwise(1 - share(b, a, 1 - x))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Probability of at least x with df degrees of freedom; 1 without any."""
    return F.when(df > 0, gamma_tail(df / 2, x / 2)).otherwise(1.0)


def binomial_at_most(k: Column, n: Column, p: Column) -> Column:
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(beta_share(n - k, k + 1, 1 - p))


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    """Twice the smaller tail, at most 1."""
    return F.least(F.lit(1.0), 2 * F.least(binomial_at_most(k, n, p), 1 - binomial_at_most(k - 1, n, p)))


def kolmogorov_tail(x: Column) -> Column:
    """Probability that the limit of the scaled largest difference is at least x."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * j * j * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
