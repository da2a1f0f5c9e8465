"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
_BAR = (("open_price", _D), ("close_price", _D), ("high_price", _D), ("low_price", _D), ("volume", _L), ("date", T.DateType()))
ASSET = _schema(("id", _L), ("ticker", _S), *_BAR)
STOCK = _schema(("id", _L), ("ticker", _S), *_BAR, ("stock_name", _S), ("exchange", _S), ("sector", _S))
OPTION = _schema(("id", _L), ("ticker", _S), *_BAR, ("option_symbol", _S), ("option_type", _S), ("expiry_date", T.DateType()), ("strike_price", _D))
#: Older files: no id, the date second, volumes in scientific notation.
LEGACY = _schema(("ticker", _S), ("date", T.DateType()), ("open_price", _D), ("close_price", _D), ("high_price", _D), ("low_price", _D), ("volume", _D))
#: The tables that the store serves.
TABLES = {"asset_data": ASSET, "stock_data": STOCK, "option_data": OPTION}
#: A vendor's answer to a request for aggregates.
AGGREGATES = _schema(
    ("status", _S), ("resultsCount", _L),
    ("results", T.ArrayType(_schema(("t", _L), ("o", _D), ("h", _D), ("l", _D), ("c", _D), ("v", _D), ("vw", _D), ("n", _L)))),
)
BOARD = _schema(("name", _S), ("price", _D), ("change", _D))
PORTFOLIOS = _schema(("portfolio_id", _L), ("username", _S), ("balance", _D), ("total_value", _D), ("initial_capital", _D))
HOLDINGS = _schema(("portfolio_id", _L), ("ticker", _S), ("quantity", _L), ("avg_cost", _D))
TRANSACTIONS = _schema(("transaction_id", _L), ("portfolio_id", _L), ("ticker", _S), ("transaction_type", _S), ("quantity", _L), ("price", _D), ("transaction_date", T.DateType()))
#: Keys of a portfolio's bag, in the order of a report.
ASSET_TYPES = ("Stock", "Option", "Cash", "FX", "Crypto", "Index")
TIME_SPANS = ("minute", "hour", "day", "week", "month")
