"""Symbols, display texts, flags and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefixes of vendor symbols.
PREFIXES = {"O:": "Option", "X:": "Crypto", "C:": "Forex", "I:": "Index"}
OCC = r"O:([A-Z]+)([0-9]{6})([CP])([0-9]+)"


def asset_class(symbol: Column) -> Column:
    out = F.lit("Stock")
    for prefix, name in PREFIXES.items():
        out = F.when(symbol.startswith(prefix), name).otherwise(out)
    return out


def portfolio_type(asset_type: Column) -> Column:
    """The bag's key of an asset class; Forex is kept under FX."""
    return F.when(asset_type == "Forex", "FX").otherwise(asset_type)


def bare_symbol(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "^.:", "")


def with_prefix(symbol: Column, kind: Column) -> Column:
    """The vendor's symbol of a bare one of an asset class."""
    out = symbol
    for prefix, name in PREFIXES.items():
        out = F.when(kind == name, F.concat(F.lit(prefix), symbol)).otherwise(out)
    return out


def locale(kind: Column) -> Column:
    """The market's segment of a vendor's address."""
    return F.when(kind == "Forex", "global/markets/fx").when(kind == "Crypto", "global/markets/crypto").otherwise("us/markets/stocks")


def asset_parameter(kind: Column) -> Column:
    """An asset class as a vendor's parameter."""
    return F.when(kind == "Option", "options").when(kind == "Forex", "fx").when(kind == "Crypto", "crypto").when(kind == "Index", "indices").otherwise("stocks")


def occ_parts(symbol: Column) -> dict[str, Column]:
    """Underlying, expiry (years 20xx), type and strike of an option symbol found anywhere; null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(symbol, OCC, i), F.lit(""))
    return {"underlying": part(1), "expiry": F.to_date(F.concat(F.lit("20"), part(2)), "yyyyMMdd"), "option_type": F.when(part(3) == "C", "call").when(part(3) == "P", "put"), "strike": part(4).cast("double") / 1000}


def pair_parts(pair: Column) -> tuple[Column, Column]:
    return F.substring(pair, 1, 3), F.substring(pair, 4, 3)


def flag(text: Column, default: Column) -> Column:
    return F.when(text.isin("1", "true", "TRUE", "yes", "YES"), True).when(text.isin("0", "false", "FALSE", "no", "NO"), False).otherwise(default)


def clamped_limit(text: Column, default: int = 100, least: int = 1, most: int = 5000) -> Column:
    return F.least(F.greatest(F.coalesce(F.expr("1") * text.try_cast("int"), F.lit(default)), F.lit(least)), F.lit(most))


def epoch_day(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO day, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def money(text: Column) -> Column:
    """Number of a display text such as $1,500, +2.5% or $1.2M."""
    bare = F.regexp_replace(text, "[$,%+\\s]", "")
    scale = F.when(bare.endswith("K"), 1e3).when(bare.endswith("M"), 1e6).when(bare.endswith("B"), 1e9).otherwise(1.0)
    return F.regexp_replace(bare, "[KMB]$", "").try_cast("double") * scale


def alert_parts(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, ": ", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def on_sphere(lat: Column, lon: Column, radius: float = 2.0) -> tuple[Column, Column, Column]:
    """Cartesian place of a latitude and longitude in degrees, the poles on y."""
    phi, theta = F.radians(90 - lat), F.radians(lon + 180)
    return radius * F.sin(phi) * F.cos(theta), radius * F.cos(phi), radius * F.sin(phi) * F.sin(theta)


def dividend_payout(yield_percent: Column, shares: Column, close: Column) -> Column:
    return yield_percent / 100 * shares * close


def direction(change: Column) -> Column:
    return F.when(change >= 0, "up").otherwise("down")
