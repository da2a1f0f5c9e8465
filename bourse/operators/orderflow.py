"""Order flow: rolling VWAP, duplicate orders, crossing levels, reconciliation, best bid and offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Units of the order column in a chunk of a rolling window, at least: a day of seconds.
CHUNK_SECONDS = 86_400


def in_chunks(rows: DataFrame, at: str, reach: int, chunk: int) -> DataFrame:
    """Rows dealt into chunks of ``at``, those within ``reach`` before a chunk's start copied into it with ``_own`` false.

    So a window of that reach runs within (key, chunk), and a busy key's rows are spread over many tasks.
    """
    length = max(chunk, reach)
    own = F.floor(F.col(at) / length)
    copies = F.when(F.col(at) >= (own + 1) * length - reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_next", F.explode(copies)).withColumns({"_chunk": own + F.col("_next"), "_own": F.col("_next") == 0}).drop("_next")


def _moves(at: str, reach: int, chunk: int) -> Column:
    """What a row does to the sums over (t - reach, t]: it enters at its time and goes ``reach`` later, with the sign -1. Structs
    of _chunk, _when, _sign and _own, which tells its own time; a row still in the window at a chunk's start enters that one too.

    So a window's sums are running ones within (key, chunk), whose cost doesn't grow with the rows in a window.
    """
    length = max(chunk, reach)
    x, gone = F.col(at), F.col(at) + reach
    of = lambda c: ((c - F.pmod(c, F.lit(length))) / length).cast("long")
    move = lambda to, when, sign, own=False: F.struct(of(to).alias("_chunk"), when.alias("_when"), F.lit(sign).alias("_sign"), F.lit(own).alias("_own"))
    enters, goes = move(x, x, 1, True), move(gone, gone, -1)
    return F.when(x.isNull(), F.array(enters)).when(of(x) == of(gone), F.array(enters, goes)).otherwise(F.array(enters, move(gone, gone - F.pmod(gone, F.lit(length)), 1), goes))


def rolling_vwap(trades: DataFrame, seconds: int, key: str = "ticker", sec: str = "sec", seq: str = "seq", cents: int = 10_000, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """VWAP of the trades in (sec - seconds, sec] as each arrives: later arrivals at its own second are not seen.

    Sums run in integers (price in units of 1/cents), so they don't depend on order; zero volume gives 0. The windows' sums are
    those of seconds, at most two moves for each, within chunks; then each second's trades are led by what its window has before it.
    """
    rows = trades.withColumns({"_pq": F.floor(F.col("price") * cents + 0.5) * F.col("qty"), "_q": F.col("qty").cast("long")})
    summed = ("_pq", "_q")
    moves = rows.select(key, *summed, F.explode(_moves(sec, seconds, chunk)).alias("_m")).select(key, *summed, "_m.*").groupBy(key, "_chunk", "_when")
    net = [x for c in summed for x in (F.sum(F.col("_sign") * F.col(c)).alias(f"_in{c}"), F.sum(F.col("_sign") * F.col(c).isNotNull().cast("long")).alias(f"_n{c}"), F.sum(F.when(F.col("_own"), F.col(c))).alias(f"_own{c}"))]
    running = W.partitionBy(key, "_chunk").orderBy("_when").rowsBetween(W.unboundedPreceding, 0)
    before = [x for c in summed for x in ((F.coalesce(F.sum(f"_in{c}").over(running), F.lit(0)) - F.coalesce(f"_own{c}", F.lit(0))).alias(c), F.sum(f"_n{c}").over(running).alias(f"_n{c}"))]
    lead = moves.agg(*net, F.max("_own").alias("_real")).select(key, F.col("_when").alias(sec), *before, "_real").filter("_real").withColumn("_real", F.lit(False))
    arrived = W.partitionBy(key, sec).orderBy("_real", seq).rowsBetween(W.unboundedPreceding, 0)
    sums = {f"_sum{c}": F.when(F.max(f"_n{c}").over(arrived) > 0, F.sum(c).over(arrived)) for c in summed}  # null if its window has no value
    out = rows.withColumn("_real", F.lit(True)).unionByName(lead, allowMissingColumns=True).withColumns(sums).filter("_real")
    vwap = F.when(F.col("_sum_q") == 0, 0.0).otherwise(F.try_divide(F.col("_sum_pq"), F.col("_sum_q")) / cents)
    return out.select(*trades.columns, vwap.alias("vwap"))


def rolling_vwap_continuous(trades: DataFrame, seconds: int, key: str = "ticker", ts: str = "ts", cents: int = 10_000, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """VWAP over the half-open window (ts - seconds, ts] in microseconds, all peers of ts seen; null without volume."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    rows = trades.withColumns({"_us": micros, "_pq": F.floor(F.col("price") * cents + 0.5) * F.col("qty"), "_q": F.col("qty").cast("long")})
    rows = rows.withColumn("_m", F.explode(_moves("_us", seconds * 1_000_000, chunk * 1_000_000)))
    own = [F.col(c) if c == key else F.when(F.col("_m._own"), F.col(c)).alias(c) for c in trades.columns]
    rows = rows.select(*own, *[(F.col("_m._sign") * F.col(c)).alias(c) for c in ("_pq", "_q")], "_m.*")
    seen = W.partitionBy(key, "_chunk").orderBy("_when").rangeBetween(W.unboundedPreceding, 0)
    some = F.sum(F.col("_sign") * F.col("_pq").isNotNull().cast("long")).over(seen) > 0
    out = rows.withColumn("vwap", F.when(some, F.try_divide(F.sum("_pq").over(seen), F.nullif(F.sum("_q").over(seen), F.lit(0)))) / cents)
    return out.filter("_own").select(*trades.columns, "vwap")


def duplicate_orders(orders: DataFrame, horizon: int, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """Occurrences within ``horizon`` seconds of the one before with the same id; repeats stay. Dealt by (id, chunk of time)."""
    rows = in_chunks(orders, "ts", horizon, chunk)
    prev = F.lag("ts").over(W.partitionBy("order_id", "_chunk").orderBy("ts", "seq"))
    return rows.withColumn("prev_ts", prev).filter(F.col("_own") & (F.col("ts") - F.col("prev_ts") <= horizon)).drop("_chunk", "_own")


#: Levels of a ladder in a block of running sums.
BLOCK_LEVELS = 65_536


def crossing_level(ladder: DataFrame, key: str = "symbol", block: int = BLOCK_LEVELS) -> DataFrame:
    """Price of the first level whose running size reaches the target; the first one for a target of 0 or less; null if none does.

    Sums run within blocks of levels and over the blocks' totals, so a deep ladder is spread over many tasks.
    """
    rows = ladder.withColumn("_block", F.floor(F.col("level") / block))
    totals = rows.groupBy(key, "_block").agg(F.sum("size").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(totals.select(key, "_block", before.alias("_before")), [key, "_block"])
    within = F.sum("size").over(W.partitionBy(key, "_block").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    hit = F.when(F.col("_before") + F.col("_within") >= F.col("target"), F.col("level"))
    return rows.withColumn("_within", within).groupBy(key, "target").agg(F.min_by("price", hit).alias("crossing_price"))


def crossing_in_arrays(prices, sizes, target):
    """The same for one row's arrays, in one pass over them."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("price"))

    def step(state, level):
        total = state["total"] + level["s"]
        return F.struct(total.alias("total"), F.coalesce(state["price"], F.when(total >= target, level["p"])).alias("price"))

    levels = F.zip_with(prices, sizes, lambda p, s: F.struct(p.cast("double").alias("p"), s.cast("double").alias("s")))
    return F.aggregate(levels, start, step, lambda state: state["price"])


def match_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with the sum of their children; ``matched`` if it equals their own quantity; children alone are dropped."""
    sums = children.groupBy("parent_id").agg(F.sum("qty").alias("child_qty"))
    out = parents.join(sums, "parent_id", "left").withColumn("child_qty", F.coalesce("child_qty", F.lit(0)))
    return out.withColumn("matched", F.col("qty") == F.col("child_qty"))


#: Units of the events' order in a chunk of a book: what is live at a chunk's start is carried into it.
CHUNK_EVENTS = 65_536


def in_book_chunks(quotes: DataFrame, chunk: int = CHUNK_EVENTS, live: DataFrame | None = None) -> DataFrame:
    """Events dealt by (symbol, _chunk), each chunk led by the levels that are live at its start (``_own`` false).

    A chunk is about ``chunk`` events of one symbol in order, twice as many at most, so a quiet symbol has one and a busy one is
    spread over many tasks. A chunk is summed up by the last event of each level; these summaries compose: a level that its
    chunk leaves live is handed on to the symbol's chunks up to that of its next event. So what is carried is at most the
    live levels of each chunk. ``live``: levels (symbol, side, price) from before the first event.
    """
    rows = quotes.filter("symbol IS NOT NULL").select("symbol", "seq", "action", "side", "price", "size", F.lit(True).alias("_own"))
    if live is not None:
        before = live.select("symbol", F.lit(-(1 << 62)).alias("seq"), F.lit("upsert").alias("action"), "side", "price", F.lit(1).cast("long").alias("size"), F.lit(False).alias("_own"))
        rows = rows.unionByName(before.join(rows.select("symbol").distinct(), "symbol", "left_semi"))
    rows = rows.withColumn("_run", F.floor(F.col("seq") / chunk))
    runs = rows.groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("symbol").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("symbol", "_run", F.floor(earlier / chunk).alias("_chunk"))
    rows = rows.join(runs, ["symbol", "_run"]).drop("_run")
    last = rows.groupBy("symbol", "side", "price", "_chunk").agg(F.max_by(_is_live(), "seq").alias("stays"), F.max("seq").alias("seq"))
    ends = last.withColumn("_next", F.lead("_chunk").over(W.partitionBy("symbol", "side", "price").orderBy("_chunk"))).filter("stays")
    ends = ends.join(runs.groupBy("symbol").agg(F.max("_chunk").alias("_last")), "symbol").withColumn("_until", F.coalesce("_next", "_last")).filter("_until > _chunk")
    into = F.explode(F.sequence(F.col("_chunk") + 1, F.col("_until"))).alias("_chunk")
    carried = ends.select("symbol", "seq", F.lit("upsert").alias("action"), "side", "price", F.lit(1).cast("long").alias("size"), F.lit(False).alias("_own"), into)
    return rows.unionByName(carried)


def _is_live():
    return F.coalesce((F.lower("action") == "upsert") & (F.col("size") > 0), F.lit(False))


def live_levels(quotes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The levels that are live after the events, of those that were and those that came: symbol, side, price."""
    last = quotes.filter("symbol IS NOT NULL").groupBy("symbol", "side", "price").agg(F.max_by(_is_live(), "seq").alias("stays"))
    if live is not None:
        last = last.unionByName(live.join(last, ["symbol", "side", "price"], "left_anti").withColumn("stays", F.lit(True)))
    return last.filter("stays").select("symbol", "side", "price")


def best_quotes_by_interval(quotes: DataFrame, chunk: int = 2_048) -> DataFrame:
    """Best bid and ask after each event, by joining the events of each (symbol, chunk) with the levels alive in it."""
    rows = in_book_chunks(quotes, chunk)
    until = F.lead("seq").over(W.partitionBy("symbol", "_chunk", "side", "price").orderBy("seq"))
    lives = rows.withColumn("until", until).filter((F.lower("action") == "upsert") & (F.col("size") > 0)).select("symbol", "_chunk", "side", "price", F.col("seq").alias("since"), "until")
    alive = (F.col("e.symbol") == F.col("l.symbol")) & (F.col("e._chunk") == F.col("l._chunk")) & (F.col("l.since") <= F.col("e.seq")) & (F.col("l.until").isNull() | (F.col("l.until") > F.col("e.seq")))
    joined = rows.filter("_own").select("symbol", "_chunk", "seq").alias("e").join(lives.alias("l"), alive, "left")
    best = joined.groupBy(F.col("e.symbol").alias("symbol"), F.col("e.seq").alias("seq"))
    return best.agg(F.max(F.when(F.col("l.side") == "B", F.col("l.price"))).alias("best_bid"), F.min(F.when(F.col("l.side") == "A", F.col("l.price"))).alias("best_ask"))


class Book:
    """Live price levels of one symbol: the prices of each side in order."""

    def __init__(self, live=()):
        self.prices = {side: sorted(p for s, p in live if s == side) for side in "BA"}

    def apply(self, action: str, side: str, price: float, size: int) -> None:
        from bisect import bisect_left, insort

        prices = self.prices[side]
        at = bisect_left(prices, price)
        held = at < len(prices) and prices[at] == price
        if action.lower() == "upsert" and size is not None and size > 0:
            if not held:
                insort(prices, price)
        elif held:
            del prices[at]

    def best(self, side: str) -> float | None:
        return self.prices[side][-1 if side == "B" else 0] if self.prices[side] else None

    def live(self) -> list:
        return [(side, p) for side in "BA" for p in self.prices[side]]


def best_quotes(quotes: DataFrame, chunk: int = CHUNK_EVENTS, live: DataFrame | None = None) -> DataFrame:
    """Best bid and ask after each event: a symbol's chunks are dealt to tasks, sorted by event, and replayed in Arrow batches.

    Only the live levels of one symbol are held at a time. ``live``: levels from before the first event.
    """

    def replay(frames):
        import pandas as pd

        group, book = None, None
        for frame in frames:
            bids, asks = [], []
            for symbol, part, *event in zip(*(frame[c] for c in ("symbol", "_chunk", "action", "side", "price", "size"))):
                if (symbol, part) != group:
                    group, book = (symbol, part), Book()
                book.apply(*event)
                bids.append(book.best("B"))
                asks.append(book.best("A"))
            out = pd.DataFrame({"symbol": frame["symbol"], "seq": frame["seq"], "best_bid": pd.Series(bids, dtype="float64"), "best_ask": pd.Series(asks, dtype="float64")})
            yield out[frame["_own"].to_numpy(bool)]

    rows = in_book_chunks(quotes, chunk, live).repartition("symbol", "_chunk").sortWithinPartitions("symbol", "_chunk", "_own", "seq")
    out = rows.mapInPandas(replay, "symbol long, seq long, best_bid double, best_ask double")
    blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("symbol", "seq", blank("best_bid"), blank("best_ask"))
