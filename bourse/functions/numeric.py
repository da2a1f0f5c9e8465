"""Rounding, the normal distribution and option pricing as native column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hart's rational approximation of the normal distribution, numerator and denominator, highest power first.
HART_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Beyond this many deviations the tail is taken as its value there (about 1e-12).
CDF_CLAMP = 7.0


def fix(x: Column, digits: int) -> Column:
    """Half-up rounding that gives values next to a tie the same result whatever the order of summation."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.500001) / scale


def poly(z, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * z + c
    return total


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 1e-15 within CDF_CLAMP deviations."""
    z = F.least(F.abs(x), F.lit(CDF_CLAMP))
    tail = F.exp(-z * z / 2) * poly(z, HART_UP) / poly(z, HART_DOWN)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def with_model(rows: DataFrame, is_call: str, spot: str, strike: str, years: str, rate: str, vol: str, out: str = "model", more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the Black-Scholes price of a European option in ``out``, and of delta, gamma, vega, theta (a year) and rho those in ``more``.

    Null where time or volatility isn't positive. Each shared term is a projection of its own, which the optimiser doesn't
    inline, so the plan stays in one stage of generated code; the column forms below repeat them and suit few rows.
    """
    s, k, t, r, v = (F.col(c) for c in (spot, strike, years, rate, vol))
    sound = (t > 0) & (v > 0)
    rows = rows.withColumns({"_root": F.when(sound, v * F.sqrt(t)), "_due": k * F.exp(-r * t)})
    rows = rows.withColumn("_a", (F.ln(s / k) + (r + v * v / 2) * t) / F.col("_root")).withColumn("_b", F.col("_a") - F.col("_root"))
    rows = rows.withColumns({f"_z{x}": F.least(F.abs(f"_{x}"), F.lit(CDF_CLAMP)) for x in "ab"})
    rows = rows.withColumns({f"_t{x}": F.exp(-F.col(f"_z{x}") * F.col(f"_z{x}") / 2) * poly(F.col(f"_z{x}"), HART_UP) / poly(F.col(f"_z{x}"), HART_DOWN) for x in "ab"})
    above = {x: F.when(F.col(f"_{x}") > 0, 1 - F.col(f"_t{x}")).otherwise(F.col(f"_t{x}")) for x in "ab"}
    below = {x: F.when(F.col(f"_{x}") < 0, 1 - F.col(f"_t{x}")).otherwise(F.col(f"_t{x}")) for x in "ab"}
    rows = rows.withColumns({f"_n{x}": F.when(F.col(is_call), above[x]).otherwise(-below[x]) for x in "ab"} | {"_pdf": norm_pdf(F.col("_a"))})
    due, decay = F.col("_due") * F.col("_nb"), -s * F.col("_pdf") * v / (2 * F.sqrt(t))
    made = {
        out: s * F.col("_na") - due, "delta": F.col("_na"), "gamma": F.col("_pdf") / (s * F.col("_root")), "vega": s * F.col("_pdf") * F.sqrt(t),
        "theta": decay - r * due, "rho": t * due,
    }
    return rows.withColumns({c: F.when(sound, made[c]) for c in (out, *more)}).drop("_root", "_due", "_a", "_b", "_za", "_zb", "_ta", "_tb", "_na", "_nb", "_pdf")


def two_decimals(x: Column) -> Column:
    """A display number to two places."""
    return fix(x, 2)


def d1(spot: Column, strike: Column, years: Column, rate: Column, vol: Column) -> Column:
    return (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * F.sqrt(years))


def black_scholes(is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, vol: Column) -> Column:
    """Price of a European option; null where time or volatility isn't positive."""
    a = d1(spot, strike, years, rate, vol)
    b = a - vol * F.sqrt(years)
    paid = strike * F.exp(-rate * years)
    price = F.when(is_call, spot * norm_cdf(a) - paid * norm_cdf(b)).otherwise(paid * norm_cdf(-b) - spot * norm_cdf(-a))
    return F.when((years > 0) & (vol > 0), price)


def delta(is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, vol: Column) -> Column:
    a = d1(spot, strike, years, rate, vol)
    return F.when(is_call, norm_cdf(a)).otherwise(-norm_cdf(-a))


def greeks(is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, vol: Column) -> dict[str, Column]:
    """Closed forms of gamma, vega, theta (a year) and rho."""
    a = d1(spot, strike, years, rate, vol)
    b = a - vol * F.sqrt(years)
    paid = strike * F.exp(-rate * years)
    decay = -spot * norm_pdf(a) * vol / (2 * F.sqrt(years))
    return {
        "gamma": norm_pdf(a) / (spot * vol * F.sqrt(years)),
        "vega": spot * norm_pdf(a) * F.sqrt(years),
        "theta": F.when(is_call, decay - rate * paid * norm_cdf(b)).otherwise(decay + rate * paid * norm_cdf(-b)),
        "rho": F.when(is_call, paid * years * norm_cdf(b)).otherwise(-paid * years * norm_cdf(-b)),
    }


def intrinsic(is_call: Column, spot: Column, strike: Column) -> Column:
    return F.when(is_call, F.greatest(F.lit(0.0), spot - strike)).otherwise(F.greatest(F.lit(0.0), strike - spot))


def implied_vol(is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, price: Column) -> Column:
    """Volatility in (0.001, 3) at which the model gives ``price``; prices out of reach give the nearer bound.

    A bisection over whole Arrow batches: 60 halvings of an interpreted column lambda would cost far more.
    Null where an input is null or time isn't positive.
    """

    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def solve(call: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, p: pd.Series) -> pd.Series:
        def cdf(x):
            z = np.minimum(np.abs(x), CDF_CLAMP)
            tail = np.exp(-z * z / 2) * poly(z, HART_UP) / poly(z, HART_DOWN)
            return np.where(x > 0, 1 - tail, tail)

        ok = (call.notna() & s.notna() & k.notna() & r.notna() & p.notna() & (t > 0) & (s > 0) & (k > 0)).to_numpy()
        c = call.fillna(False).to_numpy(bool)
        s, k, t, r, p = (np.where(ok, x.to_numpy(float), 1.0) for x in (s, k, t, r, p))
        low, high = np.full(len(p), 0.001), np.full(len(p), 3.0)
        paid, root = k * np.exp(-r * t), np.sqrt(t)
        for _ in range(60):
            v = (low + high) / 2
            a = (np.log(s / k) + (r + v * v / 2) * t) / (v * root)
            b = a - v * root
            value = np.where(c, s * cdf(a) - paid * cdf(b), paid * cdf(-b) - s * cdf(-a))
            under = value < p
            low, high = np.where(under, v, low), np.where(under, high, v)
        return pd.Series(np.where(ok, (low + high) / 2, np.nan)).where(ok, None)

    return F.nanvl(solve(is_call, spot, strike, years, rate, price), F.lit(None).cast("double"))
