"""Trade status vocabulary, fail-closed masks, staleness, and the daily quality summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions import calendars
from paneltide.functions.text import collapse, first_reason, fold
from paneltide.operators import joins

#: Phrases of the status text, folded.
_BUY_CLOSED, _SELL_CLOSED = "alımına kapalı", "bozumuna kapalı"
_BUY_OPEN, _SELL_OPEN = "alımına açık", "bozumuna açık"
_BOTH_CLOSED = "alımına ve bozumuna kapalı|bozumuna ve alımına kapalı"
_NOT_TRADED, _TRADED = "işlem görmüyor", "işlem görüyor|işlem yapılabilir"


def _status(c: str) -> Column:
    return fold(collapse(F.col(c)))


def legacy_masks(c: str = "tefas_status") -> tuple[Column, Column]:
    """(buy, sell) by the lenient reading: open unless the text closes it, blank is open."""
    s = _status(c)
    closed = s.rlike(_NOT_TRADED)
    return ~closed & ~s.rlike(_BUY_CLOSED), ~closed & ~s.rlike(_SELL_CLOSED)


def strict_masks(c: str = "tefas_status") -> tuple[Column, Column, Column]:
    """(buy, sell, known) by the strict reading: open only where the text says so, unknown text is closed."""
    s = _status(c)
    traded, not_traded, both = s.rlike(_TRADED), s.rlike(_NOT_TRADED), s.rlike(_BOTH_CLOSED)
    buy_closed, sell_closed = s.rlike(_BUY_CLOSED) | both, s.rlike(_SELL_CLOSED) | both
    buy_open, sell_open = s.rlike(_BUY_OPEN), s.rlike(_SELL_OPEN)
    # A text that closes one direction only leaves the other open.
    buy = (traded | buy_open | sell_closed) & ~buy_closed & ~not_traded
    sell = (traded | sell_open | buy_closed) & ~sell_closed & ~not_traded
    return buy, sell, traded | not_traded | buy_closed | sell_closed | buy_open | sell_open


def execution_masks(c: str = "tefas_status") -> tuple[Column, Column, Column]:
    """(buy, sell, known): what both readings allow, and only where the text is recognised."""
    (lb, ls), (sb, ss, known) = legacy_masks(c), strict_masks(c)
    return lb & sb & known, ls & ss & known, known


def suspended(c: str = "tefas_status") -> Column:
    s = _status(c)
    return s.contains(_BUY_CLOSED) & s.contains(_SELL_CLOSED)


def with_masks(df: DataFrame, c: str = "tefas_status") -> DataFrame:
    (lb, ls), (sb, ss, known), (eb, es, _) = legacy_masks(c), strict_masks(c), execution_masks(c)
    return df.select("*", lb.alias("legacy_buy"), ls.alias("legacy_sell"), sb.alias("strict_buy"), ss.alias("strict_sell"), known.alias("known"), eb.alias("exec_buy"), es.alias("exec_sell"), suspended(c).alias("suspended"))


def mask_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose stored flags differ from the masks derived from their text (null counts as a difference)."""
    buy, sell, _ = execution_masks()
    return df.filter(~F.col("can_buy").eqNullSafe(buy) | ~F.col("can_sell").eqNullSafe(sell))


def last_valid_dates(panel: DataFrame) -> DataFrame:
    return panel.groupBy("code").agg(F.max(F.when(F.col("price").isNotNull(), F.col("d"))).alias("last_d"))


def stale(behind: Column, most: int) -> Column:
    """More than ``most`` business days behind; without a date always."""
    return F.coalesce(behind > most, F.lit(True))


def bad_cells(panel: DataFrame, limit: float = 0.25) -> DataFrame:
    """(code, d, kind): prices that are not positive, and jumps between neighbouring rows."""
    from paneltide.operators import windows as w

    marked = panel.withColumn("_jump", w.jumps(limit))
    kind = F.when(F.col("price") <= 0, "non_positive").when(F.col("_jump"), "jump")
    return marked.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("code", "d", "kind")


def quality_summary(panel: DataFrame, master: DataFrame, most_stale: int = 3) -> DataFrame:
    """One row: entities, fresh share, stale, closed and suspended counts, bad cells."""
    from paneltide.operators import windows as w

    last = panel.agg(F.max("i").alias("n"))
    age = panel.groupBy("code").agg(F.max(F.when(F.col("price").isNotNull(), F.col("i"))).alias("last_i")).crossJoin(F.broadcast(last))
    fresh = age.agg(F.count("*").alias("n_codes"), F.avg(F.when(F.col("n") == F.col("last_i"), 1.0).otherwise(0.0)).alias("fresh_ratio"), F.count_if(stale(F.col("n") - F.col("last_i"), most_stale)).alias("n_stale"))
    buy, sell, known = execution_masks()
    masks = master.agg(F.count_if(~buy).alias("n_buy_closed"), F.count_if(~sell).alias("n_sell_closed"), F.count_if(~known).alias("n_unknown"), F.count_if(suspended()).alias("n_suspended"))
    cells = panel.withColumn("_j", w.jumps()).agg(F.count_if(F.col("price") <= 0).alias("n_non_positive"), F.count_if("_j").alias("n_jumps"))
    return fresh.crossJoin(masks).crossJoin(cells)


def source_stale(asked: DataFrame, prices: DataFrame, snapshots: DataFrame, calendar: DataFrame, most_behind: int = 2, least_fresh: float = 0.95, ready_hour: int = 10) -> DataFrame:
    """Whether the source was stale at each moment, from what could be seen on its day: at, expected, newest, behind, fresh_ratio, stale, reason.

    ``asked``: at (timestamp); ``prices``: code, d, price; ``snapshots``: snapshot_date; ``calendar``: business days (d). ``expected`` is the
    newest day whose price is due, ``behind`` the business days from ``newest``, the last day with a price, up to it; ``fresh_ratio`` the share of
    the funds seen so far whose last price is no business day older than ``newest`` (a fund that begins later does not count). Reasons in
    order: ``no_snapshot``, ``no_price``, ``behind`` (``most_behind`` days or more), ``few_fresh`` (below ``least_fresh``), ``ok``. Every moment
    has one row; null moments, and null, NaN or repeated prices, change nothing. Before the calendar begins ``expected`` and ``behind`` are null: stale.

    The prices are aggregated once by fund and number of business days; what is left grows with the calendar and the moments alone.
    """
    there = prices.filter(F.col("price").isNotNull() & ~F.isnan("price") & F.col("code").isNotNull() & F.col("d").isNotNull())
    dates = calendars.with_index(there.select("d").distinct(), calendar, "d", "before")
    firsts = there.join(F.broadcast(dates), "d").groupBy("code", "before").agg(F.min("d").alias("d"))
    fresh = firsts.groupBy("d").agg(F.count("*").alias("_fresh"))
    born = firsts.groupBy("code").agg(F.min("d").alias("d")).groupBy("d").agg(F.count("*").alias("_born"))
    along = Window.orderBy("d")
    seen = dates.join(fresh, "d", "left").join(born, "d", "left").fillna(0, ["_fresh", "_born"])
    ratio = F.sum("_fresh").over(Window.partitionBy("before").orderBy("d")) / F.sum("_born").over(along)
    seen = seen.select(F.lit(1).alias("_one"), F.col("d").alias("newest"), "before", ratio.alias("fresh_ratio"))
    moments = asked.select("at").filter("at IS NOT NULL").distinct().select("at", F.to_date("at").alias("_day"), F.lit(1).alias("_one"))
    got = joins.asof_last(moments, seen, "_one", "_day", "newest", ["before", "fresh_ratio"])
    taken = snapshots.filter("snapshot_date IS NOT NULL").select(F.lit(1).alias("_one"), "snapshot_date").distinct()
    got = joins.asof_last(got, taken, "_one", "_day", "snapshot_date", [])
    got = calendars.with_index(calendars.expected_label(got, calendar, "at", ready_hour), calendar, "expected", "_due")
    behind = F.when(F.col("expected").isNotNull(), F.col("_due") - F.col("before"))
    reason = first_reason(
        (F.col("snapshot_date").isNull(), "no_snapshot"),
        (F.col("newest").isNull(), "no_price"),
        (F.coalesce(behind >= most_behind, F.lit(True)), "behind"),
        (F.col("fresh_ratio") < least_fresh, "few_fresh"),
    )
    return got.select("at", "expected", "newest", behind.alias("behind"), "fresh_ratio", (reason != "ok").alias("stale"), reason.alias("reason"))
