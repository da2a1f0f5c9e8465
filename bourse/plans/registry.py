"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def sql_fix(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.500001) / {float(10**digits)}"


#: The canonical views in DuckDB SQL, in order of dependence.
VIEWS = {
    "trades": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS price, CAST(l_quantity AS BIGINT) AS qty,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "bars": f"""SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume,
        {sql_fix("sum(price * qty) / sum(qty)", 4)} AS vw, count(*) AS n FROM trades GROUP BY ticker, date""",
    "months": f"""SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_min(price, row(date, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(date, seq)) AS close,
        CAST(sum(qty) AS BIGINT) AS volume, {sql_fix("sum(price * qty) / sum(qty)", 4)} AS vw, count(*) AS n FROM trades GROUP BY 1, 2""",
    "returns": "SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM months QUALIFY ret IS NOT NULL",
    "stock_bars": f"""SELECT p_partkey AS id, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, p_name AS stock_name, r_name AS exchange, p_type AS sector, max(price) AS high_price, min(price) AS low_price, CAST(sum(qty) AS BIGINT) AS volume
        FROM (SELECT *, floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS price, CAST(l_quantity AS BIGINT) AS qty FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
    "ticks": "SELECT event_type AS ticker, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, event_id AS seq, user_id AS trader FROM events",
    "quotes": """SELECT user_id % 50 AS symbol, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side,
        floor(value / 5) * 5 AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events""",
    "order_events": "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS order_id, event_id AS seq FROM events",
    "parents": "SELECT o_orderkey AS parent_id, o_orderkey % 8 AS qty FROM orders",
    "children": "SELECT l_orderkey AS parent_id, CAST(1 AS BIGINT) AS qty FROM lineitem",
    "ladder": "SELECT p_brand AS symbol, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS level, p_retailprice AS price, CAST(p_size AS BIGINT) AS size, CAST(substr(p_brand, 7) AS BIGINT) * 20 AS target FROM part",
    "contracts": """SELECT p_partkey AS id, p_brand AS underlying, p_partkey % 2 = 0 AS is_call, p_retailprice AS strike, 7 + p_size AS expiry_days, (7 + p_size) / 365.0::DOUBLE AS years, 950.0::DOUBLE AS spot, 0.01::DOUBLE AS rate,
        0.1::DOUBLE + (p_partkey % 40) / 100.0::DOUBLE AS vol FROM part""",
    "symbols": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'O:' || upper(substr(p_type, 1, 4)) || '25' || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') || (CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END) || lpad(CAST(CAST(floor(p_retailprice * 1000 + 0.5) AS BIGINT) AS VARCHAR), 8, '0')
        WHEN 1 THEN 'X:BTCUSD' WHEN 2 THEN 'C:EURUSD' WHEN 3 THEN 'I:SPX' ELSE p_brand END AS symbol FROM part""",
    "transactions": """SELECT o_custkey AS portfolio_id, p_brand AS ticker, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS transaction_type, CAST(l_quantity AS BIGINT) AS quantity, floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS price,
        CAST(l_shipdate AS DATE) AS date, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "ledger": f"""SELECT portfolio_id, ticker, CAST(s.q AS BIGINT) AS quantity, {sql_fix("s.a", 4)} AS avg_cost, {sql_fix("s.r", 4)} AS realised, CAST(s.o AS BIGINT) AS oversold FROM (
        SELECT portfolio_id, ticker, list_reduce(list({{'d': CASE transaction_type WHEN 'buy' THEN quantity ELSE -quantity END::DOUBLE, 'p': price::DOUBLE, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'o': 0.0::DOUBLE}} ORDER BY date, seq),
        lambda s, x: {{'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': greatest(s.q + x.d, 0.0)::DOUBLE, 'a': (CASE WHEN x.d > 0 THEN (s.q * s.a + x.d * x.p) / (s.q + x.d) WHEN s.q + x.d > 0 THEN s.a ELSE 0.0 END)::DOUBLE,
            'r': (CASE WHEN x.d < 0 THEN s.r + least(s.q, -x.d) * (x.p - s.a) ELSE s.r END)::DOUBLE, 'o': (s.o + greatest(-x.d - s.q, 0.0))::DOUBLE}},
        {{'d': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'o': 0.0::DOUBLE}}) AS s FROM transactions GROUP BY 1, 2)""",
    "holdings": "SELECT portfolio_id, ticker, quantity, avg_cost FROM ledger WHERE quantity > 0",
    "portfolios": "SELECT c_custkey AS portfolio_id, c_name AS username, c_acctbal AS balance FROM customer",
    "latest": "SELECT ticker, arg_max(close, date) AS close, max(date) AS date FROM bars GROUP BY ticker",
    "board": f"""SELECT ticker, close AS price, {sql_fix("100 * (close - prev) / prev", 4)} AS change FROM (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars)
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
}


def with_views(body: str) -> str:
    """The query with the views that it or they need, as common table expressions before its own."""
    need, text = [], body
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            need.insert(0, name)
            text += " " + VIEWS[name]
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = body.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if not need:
        return body
    if head:
        return f"WITH {head[1] or ''}{own}, {body[head.end() :]}"
    return f"WITH {own} {body}"


def query(oracle: str | None = None):
    """Registers a plan under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add
