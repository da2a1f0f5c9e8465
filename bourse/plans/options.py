"""Queries over symbols, options and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import symbols as S
from ..operators import surface
from ..sources import views
from .registry import query, sql_fix


def _cdf(x: str) -> str:
    z = f"least(abs({x}), {N.CDF_CLAMP})"
    up, down = (_poly(z, c) for c in (N.HART_UP, N.HART_DOWN))
    tail = f"exp(-{z} * {z} / 2) * {up} / {down}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _poly(z: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r}::DOUBLE)"
    return out


#: The priced contracts: d1, d2 and the model's price.
PRICED = f"""d AS (SELECT *, (ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * sqrt(years)) AS a FROM contracts), dd AS (SELECT *, a - vol * sqrt(years) AS b, strike * exp(-rate * years) AS paid FROM d),
    priced AS (SELECT *, CASE WHEN is_call THEN spot * {_cdf("a")} - paid * {_cdf("b")} ELSE paid * {_cdf("(-b)")} - spot * {_cdf("(-a)")} END AS model FROM dd)"""
CHAIN = PRICED + f""", chain AS (SELECT *, CASE WHEN id % 17 = 0 THEN 0 ELSE {sql_fix("model - 0.05", 4)} END AS bid, CASE WHEN id % 17 = 0 THEN 0 ELSE {sql_fix("model + 0.05", 4)} END AS ask, {sql_fix("model", 4)} AS last FROM priced),
    mids AS (SELECT *, CASE WHEN (bid + ask) / 2 <> 0 THEN (bid + ask) / 2 ELSE last END AS mid FROM chain)"""


_NAMES = ("is_call", "spot", "strike", "years", "rate", "vol")


def _chain(spark, sf_dir):
    rows = N.with_model(views.contracts(spark, sf_dir), *_NAMES)
    quiet = F.col("id") % 17 == 0
    rows = rows.withColumns({"bid": F.when(quiet, 0.0).otherwise(N.fix(F.col("model") - 0.05, 4)), "ask": F.when(quiet, 0.0).otherwise(N.fix(F.col("model") + 0.05, 4)), "last": N.fix(F.col("model"), 4)})
    return rows.withColumn("mid", surface.mid(F.col("bid"), F.col("ask"), F.col("last")))


@query("""SELECT id, symbol, CASE WHEN symbol LIKE 'O:%' THEN 'Option' WHEN symbol LIKE 'X:%' THEN 'Crypto' WHEN symbol LIKE 'C:%' THEN 'Forex' WHEN symbol LIKE 'I:%' THEN 'Index' ELSE 'Stock' END AS asset_class,
    CASE WHEN substr(symbol, 2, 1) = ':' THEN substr(symbol, 3) ELSE symbol END AS bare FROM symbols""")
def symbol_class(spark, sf_dir):
    return views.symbols(spark, sf_dir).select("id", "symbol", S.asset_class(F.col("symbol")).alias("asset_class"), S.bare_symbol(F.col("symbol")).alias("bare"))


@query(r"""SELECT id, nullif(regexp_extract(symbol, 'O:([A-Z]+)([0-9]{6})([CP])([0-9]+)', 1), '') AS underlying, try_strptime('20' || nullif(regexp_extract(symbol, 'O:([A-Z]+)([0-9]{6})([CP])([0-9]+)', 2), ''), '%Y%m%d')::DATE AS expiry,
    CASE regexp_extract(symbol, 'O:([A-Z]+)([0-9]{6})([CP])([0-9]+)', 3) WHEN 'C' THEN 'call' WHEN 'P' THEN 'put' END AS option_type, CAST(nullif(regexp_extract(symbol, 'O:([A-Z]+)([0-9]{6})([CP])([0-9]+)', 4), '') AS DOUBLE) / 1000 AS strike FROM symbols""")
def occ_parse(spark, sf_dir):
    parts = S.occ_parts(F.col("symbol"))
    return views.symbols(spark, sf_dir).select("id", *[c.alias(n) for n, c in parts.items()])


@query("SELECT id, substr(symbol, 3, 3) AS base, substr(symbol, 6, 3) AS quote FROM symbols WHERE symbol LIKE 'C:%' OR symbol LIKE 'X:%'")
def pair_split(spark, sf_dir):
    rows = views.symbols(spark, sf_dir).filter(S.asset_class(F.col("symbol")).isin("Forex", "Crypto"))
    base, quote = S.pair_parts(S.bare_symbol(F.col("symbol")))
    return rows.select("id", base.alias("base"), quote.alias("quote"))


@query("""SELECT c_custkey AS id, CASE WHEN try_cast(t AS INT) IS NULL THEN 100 ELSE least(greatest(try_cast(t AS INT), 1), 5000) END AS page, CASE WHEN t IN ('1') THEN true WHEN t IN ('0') THEN false ELSE c_custkey % 2 = 0 END AS flag
    FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'abc' WHEN 3 THEN '9999' ELSE CAST(c_nationkey AS VARCHAR) END AS t FROM customer)""")
def page_limits(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", F.when(kind == 0, "1").when(kind == 1, "0").when(kind == 2, "abc").when(kind == 3, "9999").otherwise(F.col("c_nationkey").cast("string")).alias("t"))
    return rows.select(F.col("c_custkey").alias("id"), S.clamped_limit(F.col("t")).alias("page"), S.flag(F.col("t"), F.col("c_custkey") % 2 == 0).alias("flag"))


@query(f"SELECT id, {sql_fix('c_dollars', 2)} AS amount FROM (SELECT c_custkey AS id, round(abs(c_acctbal)) * CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 1 END AS c_dollars FROM customer)")
def money_texts(spark, sf_dir):
    whole = F.format_number(F.floor(F.abs("c_acctbal") + 0.5), 0)
    text = F.concat(F.lit("$"), whole, F.when(F.col("c_custkey") % 2 == 0, "K").otherwise(""))
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), N.fix(S.money(text), 2).alias("amount"))


@query(f"SELECT n_nationkey AS id, {sql_fix('2 * sin(radians(90 - lat)) * cos(radians(lon + 180))', 6)} AS x, {sql_fix('2 * cos(radians(90 - lat))', 6)} AS y, {sql_fix('2 * sin(radians(90 - lat)) * sin(radians(lon + 180))', 6)} AS z FROM (SELECT *, n_nationkey * 7.0 - 85 AS lat, n_nationkey * 14.0 - 170 AS lon FROM nation)")
def globe_points(spark, sf_dir):
    x, y, z = S.on_sphere(F.col("n_nationkey") * 7.0 - 85, F.col("n_nationkey") * 14.0 - 170)
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), N.fix(x, 6).alias("x"), N.fix(y, 6).alias("y"), N.fix(z, 6).alias("z"))


@query(f"SELECT id, {sql_fix('greatest(0, CASE WHEN is_call THEN spot - strike ELSE strike - spot END)', 4)} AS intrinsic FROM contracts")
def option_intrinsic(spark, sf_dir):
    return views.contracts(spark, sf_dir).select("id", N.fix(N.intrinsic(F.col("is_call"), F.col("spot"), F.col("strike")), 4).alias("intrinsic"))


@query(f"WITH {CHAIN} SELECT id, {sql_fix('mid - greatest(0, CASE WHEN is_call THEN spot - strike ELSE strike - spot END)', 4)} AS time_value FROM mids")
def option_time_value(spark, sf_dir):
    return _chain(spark, sf_dir).select("id", N.fix(F.col("mid") - N.intrinsic(F.col("is_call"), F.col("spot"), F.col("strike")), 4).alias("time_value"))


@query(f"WITH {CHAIN} SELECT id, bid, ask, last, {sql_fix('mid', 4)} AS mid FROM mids")
def option_mid(spark, sf_dir):
    return _chain(spark, sf_dir).select("id", "bid", "ask", "last", N.fix(F.col("mid"), 4).alias("mid"))


@query(f"WITH {PRICED} SELECT id, {sql_fix('model', 6)} AS price FROM priced")
def bs_price(spark, sf_dir):
    return N.with_model(views.contracts(spark, sf_dir), *_NAMES).select("id", N.fix(F.col("model"), 6).alias("price"))


@query(f"WITH {PRICED} SELECT id, {sql_fix('CASE WHEN is_call THEN ' + _cdf('a') + ' ELSE -' + _cdf('(-a)') + ' END', 6)} AS delta FROM priced")
def bs_delta(spark, sf_dir):
    return N.with_model(views.contracts(spark, sf_dir), *_NAMES, more=("delta",)).select("id", N.fix(F.col("delta"), 6).alias("delta"))


_PDF = "(exp(-a * a / 2) / 2.5066282746310002)"


@query(f"""WITH {PRICED} SELECT id, {sql_fix(f'{_PDF} / (spot * vol * sqrt(years))', 6)} AS gamma, {sql_fix(f'spot * {_PDF} * sqrt(years)', 4)} AS vega,
    {sql_fix(f"-spot * {_PDF} * vol / (2 * sqrt(years)) + CASE WHEN is_call THEN -rate * paid * {_cdf('b')} ELSE rate * paid * {_cdf('(-b)')} END", 4)} AS theta, {sql_fix(f"CASE WHEN is_call THEN paid * years * {_cdf('b')} ELSE -paid * years * {_cdf('(-b)')} END", 4)} AS rho FROM priced""")
def bs_greeks(spark, sf_dir):
    names = ("gamma", "vega", "theta", "rho")
    return N.with_model(views.contracts(spark, sf_dir), *_NAMES, more=names).select("id", *[N.fix(F.col(n), 6 if n == "gamma" else 4).alias(n) for n in names])


@query(f"WITH {PRICED} SELECT id, {sql_fix('model', 4)} AS repriced, CASE WHEN spot * {_PDF} * sqrt(years) > 1 THEN {sql_fix('vol', 3)} END AS vol FROM priced")
def implied_vol(spark, sf_dir):
    """Of each contract at the model's price: the implied volatility gives that price again, and is the model's where the price depends on it."""
    rows = N.with_model(views.contracts(spark, sf_dir), *_NAMES, more=("vega",))
    rows = rows.withColumn("iv", N.implied_vol(*map(F.col, _NAMES[:5]), F.col("model")))
    rows = N.with_model(rows, *_NAMES[:5], "iv", out="again")
    return rows.select("id", N.fix(F.col("again"), 4).alias("repriced"), F.when(F.col("vega") > 1, N.fix(F.col("iv"), 3)).alias("vol"))


#: Sixty halvings of the bracket (0.001, 3) about the volatility that gives the mid price.
_HALVED = f"""halved AS (SELECT id, is_call, spot, strike, years, rate, mid, 0 AS k, 0.001::DOUBLE AS low, 3.0::DOUBLE AS high FROM mids
    UNION ALL SELECT id, is_call, spot, strike, years, rate, mid, k + 1, CASE WHEN value < mid THEN v ELSE low END, CASE WHEN value < mid THEN high ELSE v END FROM (
        SELECT *, CASE WHEN is_call THEN spot * {_cdf("a")} - due * {_cdf("b")} ELSE due * {_cdf("(-b)")} - spot * {_cdf("(-a)")} END AS value FROM (SELECT *, a - v * sqrt(years) AS b FROM (
            SELECT *, (ln(spot / strike) + (rate + v * v / 2) * years) / (v * sqrt(years)) AS a, strike * exp(-rate * years) AS due FROM (SELECT *, (low + high) / 2 AS v FROM halved WHERE k < 60)))))"""


@query(f"WITH RECURSIVE {CHAIN}, {_HALVED} SELECT m.id, underlying, m.is_call, m.strike, expiry_days, {sql_fix('(low + high) / 2', 4)} AS iv FROM mids m JOIN halved h ON h.id = m.id WHERE k = 60")
def iv_surface(spark, sf_dir):
    return surface.vols(_chain(spark, sf_dir)).select("id", "underlying", "is_call", "strike", "expiry_days", N.fix(F.col("iv"), 4).alias("iv"))


_KNOTS = CHAIN + """, knots AS (SELECT underlying, expiry_days, strike, mid FROM mids WHERE is_call), span AS (SELECT underlying, min(strike) AS s0, max(strike) AS s1, min(expiry_days) AS e0, max(expiry_days) AS e1 FROM knots GROUP BY 1),
    cells AS (SELECT underlying, s0, slot, unnest(range(e0, e1 + 1)) AS expiry_days FROM (SELECT *, unnest(range(0, CAST(floor((s1 + 0.5 - s0) / 0.5 + 1e-9) AS INT) + 1)) AS slot FROM span)),
    placed AS (SELECT underlying, expiry_days, CAST(floor((strike - s0) / 0.5 + 0.5) AS INT) AS slot, avg(mid) AS mid FROM knots JOIN span USING (underlying) GROUP BY 1, 2, 3),
    grid AS (SELECT c.underlying, c.expiry_days, c.slot, c.s0 + c.slot * 0.5 AS strike, p.mid FROM cells c LEFT JOIN placed p USING (underlying, expiry_days, slot))"""


def _line(x: str, keys: str, src: str, dst: str) -> str:
    return f"""{dst}0 AS (SELECT *, last_value(CASE WHEN mid IS NOT NULL THEN {x} END IGNORE NULLS) OVER b AS x0, last_value(mid IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN mid IS NOT NULL THEN {x} END IGNORE NULLS) OVER f AS x1, first_value(mid IGNORE NULLS) OVER f AS y1
    FROM {src} WINDOW b AS (PARTITION BY {keys} ORDER BY {x} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY {keys} ORDER BY {x} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {dst} AS (SELECT underlying, expiry_days, strike, coalesce(mid, y0 + (y1 - y0) * ({x} - x0) / nullif(x1 - x0, 0), y0, y1) AS mid FROM {dst}0)"""


@query(f"WITH {_KNOTS}, {_line('strike', 'underlying, expiry_days', 'grid', 'along')}, {_line('expiry_days', 'underlying, strike', 'along', 'full_grid')} SELECT underlying, CAST(expiry_days AS INT) AS expiry_days, strike, {sql_fix('mid', 4)} AS mid FROM full_grid")
def surface_linear(spark, sf_dir):
    calls = _chain(spark, sf_dir).filter("is_call").select("underlying", "expiry_days", "strike", "mid")
    return surface.densify(calls, ["underlying"]).select("underlying", "expiry_days", "strike", N.fix(F.col("mid"), 4).alias("mid"))


def _spline_sql(axis: str, keys: str, src: str, out: str) -> str:
    """Natural cubic splines along an axis in SQL: each line's knots as lists, the second derivatives by a sweep down and one up."""
    x, y, h, g = f"{out}_k.x", f"{out}_k.y", "s.h", "s.g"
    i = f"len({out}_d.up) + 1"
    return f"""{out}_k AS (SELECT {keys}, list(CAST({axis} AS DOUBLE) ORDER BY {axis}) AS x, list(mid ORDER BY {axis}) AS y FROM {src} WHERE mid IS NOT NULL GROUP BY {keys}),
    {out}_s AS (SELECT *, len(x) AS n, [x[i + 1] - x[i] FOR i IN range(1, len(x))] AS h, [(y[i + 1] - y[i]) / (x[i + 1] - x[i]) FOR i IN range(1, len(x))] AS g FROM {out}_k),
    {out}_d AS (SELECT {keys}, [0.0::DOUBLE] AS up, [0.0::DOUBLE] AS rhs FROM {out}_s UNION ALL
        SELECT {keys}, list_append(up, h1 / w), list_append(rhs, (6 * (g1 - g0) - h0 * r0) / w) FROM (SELECT {keys}, up, rhs, up[-1] AS u0, rhs[-1] AS r0, s.h[{i} - 1] AS h0, s.h[{i}] AS h1, s.g[{i} - 1] AS g0, s.g[{i}] AS g1,
            2 * (s.h[{i} - 1] + s.h[{i}]) - s.h[{i} - 1] * up[-1] AS w FROM {out}_d JOIN {out}_s s USING ({keys}) WHERE len({out}_d.up) + 1 < s.n)),
    {out}_m AS (SELECT {keys}, n, up, rhs, [0.0::DOUBLE] AS m FROM {out}_d JOIN {out}_s USING ({keys}) WHERE len(up) = greatest(n - 1, 1) UNION ALL
        SELECT {keys}, n, up, rhs, list_prepend(rhs[n - len(m)] - up[n - len(m)] * m[1], m) FROM {out}_m WHERE len(m) < n - 1),
    {out}_f AS (SELECT s.*, CASE WHEN s.n > 2 THEN list_prepend(0.0::DOUBLE, m) ELSE [0.0::DOUBLE, 0.0] END AS m FROM {out}_s s JOIN (SELECT * FROM {out}_m WHERE len(m) = greatest(n - 1, 1)) USING ({keys})),
    {out}_p AS (SELECT c.*, f.x, f.y, f.h, f.m, f.n, least(greatest(CAST(c.{axis} AS DOUBLE), f.x[1]), f.x[-1]) AS pos FROM {src} c LEFT JOIN {out}_f f USING ({keys})),
    {out}_q AS (SELECT *, least(greatest(len(list_filter(x, lambda e: e <= pos)), 1), n - 1) AS k FROM {out}_p),
    {out} AS (SELECT underlying, expiry_days, strike, CASE WHEN x IS NULL THEN NULL WHEN n = 1 THEN y[1] ELSE (m[k] * pow(x[k + 1] - pos, 3) + m[k + 1] * pow(pos - x[k], 3)) / (6 * h[k])
        + (y[k] / h[k] - m[k] * h[k] / 6) * (x[k + 1] - pos) + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * (pos - x[k]) END AS mid FROM {out}_q)"""


@query(f"WITH RECURSIVE {_KNOTS}, {_spline_sql('strike', 'underlying, expiry_days', 'grid', 'sa')}, {_spline_sql('expiry_days', 'underlying, strike', 'sa', 'sb')} SELECT underlying, CAST(expiry_days AS INT) AS expiry_days, strike, {sql_fix('mid', 3)} AS mid FROM sb")
def surface_cubic(spark, sf_dir):
    calls = _chain(spark, sf_dir).filter("is_call").select("underlying", "expiry_days", "strike", "mid")
    return surface.cubic(calls, ["underlying"]).select("underlying", "expiry_days", "strike", N.fix(F.col("mid"), 3).alias("mid"))


@query(f"WITH {CHAIN}, c AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY strike, expiry_days, id) AS place FROM mids WHERE is_call) SELECT underlying, strike, expiry_days, {sql_fix('mid', 4)} AS mid FROM c")
def surface_ordered(spark, sf_dir):
    calls = _chain(spark, sf_dir).filter("is_call").select("underlying", "strike", "expiry_days", N.fix(F.col("mid"), 4).alias("mid"))
    return surface.ordered(calls, ["underlying"])


@query(f"WITH {CHAIN} SELECT underlying, CASE WHEN is_call THEN 'call' ELSE 'put' END AS option_type, strike, expiry_days AS expiry, {sql_fix('arg_max(mid, id)', 4)} AS mid FROM mids GROUP BY 1, 2, 3, 4")
def surface_of_chain(spark, sf_dir):
    """One mid per type, strike and expiry of a chain with repeated quotes."""
    chain = _chain(spark, sf_dir).select("underlying", F.when(F.col("is_call"), "call").otherwise("put").alias("option_type"), "strike", F.col("expiry_days").alias("expiry"), "bid", "ask", "last", "id")
    return surface.from_chain(chain, "id").withColumn("mid", N.fix(F.col("mid"), 4))


@query(f"WITH {CHAIN} SELECT min(strike) AS min_strike, max(strike) AS max_strike, min(expiry_days) AS min_expiry, max(expiry_days) AS max_expiry, {sql_fix('min(mid)', 4)} AS min_value, {sql_fix('max(mid)', 4)} AS max_value, {sql_fix('avg(mid)', 4)} AS mean_value FROM mids")
def surface_extent(spark, sf_dir):
    return surface.extent(_chain(spark, sf_dir), "mid").withColumns({c: N.fix(F.col(c), 4) for c in ("min_value", "max_value", "mean_value")})


@query(f"""WITH {CHAIN}, c AS (SELECT underlying, expiry_days, floor(strike) AS strike, avg(mid) AS mid FROM mids WHERE is_call GROUP BY 1, 2, 3), e AS (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY expiry_days) AS k FROM c),
    s AS (SELECT underlying, strike, row_number() OVER (PARTITION BY underlying ORDER BY strike) AS r, count(*) OVER (PARTITION BY underlying) AS n FROM (SELECT DISTINCT underlying, strike FROM c)),
    m AS (SELECT underlying, floor(strike) AS wanted FROM s WHERE r = n // 2 + 1)
    SELECT underlying, k - 1 AS place, expiry_days, strike, {sql_fix("mid", 4)} AS mid FROM e JOIN m USING (underlying) WHERE strike = wanted""")
def surface_lookup(spark, sf_dir):
    """The middle strike's mid at each place among the expiries, where it was quoted; strikes in whole numbers."""
    calls = _chain(spark, sf_dir).filter("is_call").groupBy("underlying", "expiry_days", F.floor("strike").cast("double").alias("strike")).agg(F.avg("mid").alias("mid"))
    return surface.lookups(calls, "underlying").select("underlying", F.col("place").cast("long").alias("place"), "expiry_days", "strike", N.fix(F.col("mid"), 4).alias("mid"))
