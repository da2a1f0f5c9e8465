"""Option surfaces in long form: mid prices, densified grids, implied volatilities, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import implied_vol


def mid(bid: Column, ask: Column, last: Column) -> Column:
    middle = (bid + ask) / 2
    return F.when(middle != 0, middle).otherwise(last)


def from_chain(chain: DataFrame, order: str) -> DataFrame:
    """One mid per type, strike and expiry; of repeated quotes the last by ``order`` counts."""
    return chain.groupBy("underlying", "option_type", "strike", "expiry").agg(F.max_by(mid(F.col("bid"), F.col("ask"), F.col("last")), order).alias("mid"))


def _fill(rows: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """Linear between the known values along an axis, the nearest known one outside them."""
    before, after = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.col(axis).asc(), F.col(axis).desc()))
    known = F.when(F.col(value).isNotNull(), F.col(axis))
    rows = rows.withColumns({f"_{c}{i}": F.last(x, True).over(w) for i, w in enumerate((before, after)) for c, x in (("x", known), ("y", F.col(value)))})
    share = F.try_divide(F.col(axis) - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    line = F.coalesce(value, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * share, "_y0", "_y1")
    return rows.withColumn(value, line).drop("_x0", "_y0", "_x1", "_y1")


def grid(surface: DataFrame, keys: list[str], step: float = 0.5) -> DataFrame:
    """Strikes every ``step`` from the least to ``step`` beyond the greatest, and every day of expiry, with the known mids."""
    span = surface.groupBy(*keys).agg(F.min("strike").alias("s0"), F.max("strike").alias("s1"), F.min("expiry_days").alias("e0"), F.max("expiry_days").alias("e1"))
    n = F.floor((F.col("s1") + step - F.col("s0")) / step + 1e-9).cast("int")
    cells = span.select(*keys, "s0", F.explode(F.sequence("e0", "e1")).alias("expiry_days"), n.alias("n")).select(*keys, "expiry_days", "s0", F.explode(F.sequence(F.lit(0), "n")).alias("slot"))
    placed = surface.join(span.select(*keys, "s0"), keys).groupBy(*keys, "expiry_days", F.floor((F.col("strike") - F.col("s0")) / step + 0.5).cast("int").alias("slot")).agg(F.avg("mid").alias("mid"))
    return cells.join(placed, [*keys, "expiry_days", "slot"], "left").select(*keys, "expiry_days", (F.col("s0") + F.col("slot") * step).alias("strike"), "mid")


def densify(surface: DataFrame, keys: list[str], step: float = 0.5) -> DataFrame:
    """The grid filled linearly along strikes, then along expiries."""
    along = _fill(grid(surface, keys, step), [*keys, "expiry_days"], "strike", "mid")
    return _fill(along, [*keys, "strike"], "expiry_days", "mid")


def natural_spline(x, y, at):
    """The natural cubic spline through (x, y), x ascending, at ``at``; constant outside, linear through two points.

    The second derivatives come from one sweep down and one up the three diagonals.
    """
    import numpy as np

    if len(x) < 3:
        return np.interp(at, x, y)
    h, slope, n = np.diff(x), np.diff(y) / np.diff(x), len(x)
    m, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        whole = 2 * (h[i - 1] + h[i]) - h[i - 1] * up[i - 1]
        up[i], rhs[i] = h[i] / whole, (6 * (slope[i] - slope[i - 1]) - h[i - 1] * rhs[i - 1]) / whole
    for i in range(n - 2, 0, -1):
        m[i] = rhs[i] - up[i] * m[i + 1]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    p, q = x[k + 1] - at, at - x[k]
    return (m[k] * p**3 + m[k + 1] * q**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * p + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * q


def _splined(rows: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """``mid`` along an axis by the natural cubic spline of its known values; a line without known values stays as it is."""

    def fill(table: "pa.Table") -> "pa.Table":  # noqa: F821
        import numpy as np
        import pyarrow as pa

        at, mid = table.column(axis).to_numpy().astype(float), table.column("mid").to_numpy()
        order = np.argsort(at)
        known = order[~np.isnan(mid[order])]
        if not len(known):
            return table
        return table.set_column(table.column_names.index("mid"), "mid", pa.array(natural_spline(at[known], mid[known], at)))

    return rows.groupBy(*keys).applyInArrow(fill, rows.schema)


def cubic(surface: DataFrame, keys: list[str], step: float = 0.5) -> DataFrame:
    """The grid with natural cubic splines along strikes, then along days of expiry, constant outside the known values.

    A group is one line of one surface's grid: an expiry's strikes, then a strike's expiries.
    """
    along = _splined(grid(surface, keys, step), [*keys, "expiry_days"], "strike")
    return _splined(along, [*keys, "strike"], "expiry_days")


def ordered(surface: DataFrame, keys: list[str]) -> DataFrame:
    """The surface by strike, then expiry."""
    return surface.orderBy(*keys, "strike", "expiry_days")


def vols(surface: DataFrame, as_of_days: int = 0, rate: float = 0.01) -> DataFrame:
    """Implied volatility of each cell; whole days to expiry over 365, counted from ``as_of_days``."""
    years = F.floor(F.col("expiry_days") - as_of_days) / 365.0
    return surface.withColumn("iv", implied_vol(F.col("is_call"), F.col("spot"), F.col("strike"), years, F.lit(rate), F.col("mid")))


def extent(surface: DataFrame, value: str) -> DataFrame:
    """Least and greatest strike, expiry and value, and the mean that ignores missing values."""
    v = F.when(~F.isnan(value), F.col(value))
    return surface.agg(F.min("strike").alias("min_strike"), F.max("strike").alias("max_strike"), F.min("expiry_days").alias("min_expiry"), F.max("expiry_days").alias("max_expiry"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"))


def lookups(surface: DataFrame, key: str, strike: float | None = None) -> DataFrame:
    """The mids of one strike by the place of their expiry; the strike defaults to the middle one, cut to an integer, and must occur.

    Places come from the distinct expiries and strikes, as many as a surface has, so the quotes themselves aren't sorted.
    """
    days, strikes = (surface.select(key, c).distinct() for c in ("expiry_days", "strike"))
    days = days.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("expiry_days")) - 1)
    n, r = F.count(F.lit(1)).over(W.partitionBy(key)), F.row_number().over(W.partitionBy(key).orderBy("strike"))
    middle = strikes.withColumns({"_n": n, "_r": r}).filter("_r = floor(_n / 2) + 1").select(key, F.floor("strike").cast("double").alias("wanted"))
    if strike is not None:
        middle = middle.withColumn("wanted", F.lit(float(strike)))
    return surface.join(middle, key).filter("strike = wanted").join(days, [key, "expiry_days"]).select(key, "place", "expiry_days", "strike", "mid")


def lookup(surface: DataFrame, key: str, expiry_index: int, strike: float | None = None) -> DataFrame:
    """The mid at an expiry by its place."""
    return lookups(surface, key, strike).filter(F.col("place") == expiry_index).drop("place")
