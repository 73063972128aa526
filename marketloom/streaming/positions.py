"""Cash, quantities and first-in-first-out lots of transactions as they arrive.

Rows wait in keyed state until the watermark has passed their day, so the result depends neither on how the input is cut into
batches nor on the order within the allowed lateness: a day's rows are booked by action and event_id, as the operators
over whole tables book them. Rows behind the watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
TX_SCHEMA = "account_id long, event_id long, action string, symbol string, date date, quantity double, price double, amount double"
POSITION_SCHEMA = "account_id long, event_id long, cash double, open_quantity double, violation string"
LOT_SCHEMA = "account_id long, symbol string, kind string, version long, buy_id long, sell_id long, buy_date date, sell_date date, quantity double, buy_price double, sell_price double"
_PENDING = "event_id long, action string, symbol string, day int, quantity double, price double, amount double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EPSILON = 1e-12  # what is left of a lot or a sell below this is nothing


def keyed_state(spark: SparkSession) -> None:
    """Lets the queries that are started next keep their state in RocksDB, as processors with several states need."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(tx: DataFrame, late: str) -> DataFrame:
    """`tx` with a watermark and days since 1970."""
    return tx.where("date is not null").withColumn("event_time", F.col("date").cast("timestamp")).withColumn("day", F.unix_date("date")).withWatermark("event_time", late)


class _ByDay(StatefulProcessor):
    """Holds rows back until their day is over, then hands them to `book` in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.pending.appendList([_plain(r) for r in part[[c.split()[0] for c in _PENDING.split(", ")]].itertuples(index=False, name=None)])
            for day in part["day"].unique().tolist():
                self.handle.registerTimer((int(day) + 1) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = list(self.pending.get()) if self.pending.exists() else []
        due = [r for r in held if r[3] < over]
        if not due:
            return
        left = [r for r in held if r[3] >= over]
        if left:
            self.pending.put([tuple(r) for r in left])
        else:
            self.pending.clear()
        yield self.book(key, sorted(due, key=lambda r: (r[3], r[1] or "", r[0])))

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    return tuple(None if x is None or x != x else x for x in row)


class CashAndQuantities(_ByDay):
    """By account: a value state of cash and whether there ever was a deposit, and a map state of open quantities by symbol."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.cash = handle.getValueState("cash", "cash double, funded boolean")
        self.open = handle.getMapState("open", "symbol string", "quantity double")

    def book(self, key, rows) -> pd.DataFrame:
        cash, funded = self.cash.get() if self.cash.exists() else (0.0, False)
        held, out = {}, []
        for event_id, action, symbol, _, quantity, price, amount in rows:
            trade = action in ("buy", "sell")
            traded = (quantity or 0.0) * (price or 0.0) if trade else 0.0
            cash += {"buy": -traded, "sell": traded, "deposit": amount or 0.0, "distribution": amount or 0.0}.get(action, -(amount or 0.0))
            funded = funded or action == "deposit"
            name = symbol or ""
            if name not in held:
                held[name] = self.open.getValue((name,))[0] if self.open.containsKey((name,)) else 0.0
            if trade:
                held[name] += (quantity or 0.0) if action == "buy" else -(quantity or 0.0)
            wrong = "oversold" if action == "sell" and held[name] < -1e-9 else "cash below 0" if funded and cash < -1e-6 else None
            out.append((key[0], event_id, cash, held[name], wrong))
        self.cash.update((cash, funded))
        for name, quantity in held.items():
            self.open.updateValue((name,), (quantity,))
        return pd.DataFrame(out, columns=["account_id", "event_id", "cash", "open_quantity", "violation"])


class LotQueue(_ByDay):
    """By account and symbol: a queue of lots as a map state from place to lot, with the places of its ends.

    Only lots that a batch opens or uses are read and written. A sell of more than is open closes the group: it is told
    once and nothing is matched any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ends = handle.getValueState("ends", "head long, tail long, version long, closed boolean")
        self.lots = handle.getMapState("lots", "place long", "event_id long, day int, quantity double, price double")

    def book(self, key, rows) -> pd.DataFrame:
        head, tail, version, closed = self.ends.get() if self.ends.exists() else (0, 0, 0, False)
        begin, version, changed, out = head, version + 1, {}, []

        def lot(place):
            if place not in changed:
                changed[place] = list(self.lots.getValue((place,)))
            return changed[place]

        open_now = None
        for event_id, action, _, day, quantity, price, _ in rows:
            if closed or action not in ("buy", "sell"):
                continue
            quantity = quantity or 0.0
            if action == "buy":
                changed[tail] = [event_id, day, quantity, price]
                tail += 1
                if open_now is not None:
                    open_now += quantity
                continue
            rest, place, used = quantity, head, []
            while rest > EPSILON and place < tail:
                take = min(rest, lot(place)[2])
                used.append((place, take))
                rest -= take
                place += 1
            if rest > 1e-9:
                closed = True
                out.append((*key, "oversold", version, None, event_id, None, day, rest, None, price))
                continue
            for place, take in used:
                own = lot(place)
                if take > EPSILON:
                    out.append((*key, "match", version, own[0], event_id, own[1], day, take, own[3], price))
                own[2] -= take
                if own[2] <= EPSILON:
                    head = place + 1
        for place, (event_id, day, quantity, price) in sorted(changed.items()):
            if place < head:
                if place >= begin and self.lots.containsKey((place,)):
                    self.lots.removeKey((place,))
                quantity = 0.0
            else:
                self.lots.updateValue((place,), (event_id, day, quantity, price))
            out.append((*key, "lot", version, event_id, None, day, None, quantity, price, None))
        self.ends.update((head, tail, version, closed))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in LOT_SCHEMA.split(", ")])
        for c in ("buy_date", "sell_date"):
            table[c] = pd.to_datetime(table[c].astype("Int64"), unit="D").dt.date.where(table[c].notna(), None)
        for c in ("buy_id", "sell_id"):
            table[c] = table[c].astype("Int64")
        return table


def running_positions(tx: DataFrame, late: str = "0 days") -> DataFrame:
    """Cash and open quantity of each account after every transaction, with what it violates; a day is told when it is over."""
    keyed_state(tx.sparkSession)
    return _timed(tx, late).groupBy("account_id").transformWithStateInPandas(CashAndQuantities(), POSITION_SCHEMA, "Append", "EventTime")


def running_lots(tx: DataFrame, late: str = "0 days") -> DataFrame:
    """Rows of three kinds: `match` of a buy and a sell, `lot` with what is left of a buy from this version on, `oversold`."""
    keyed_state(tx.sparkSession)
    return _timed(tx, late).groupBy("account_id", "symbol").transformWithStateInPandas(LotQueue(), LOT_SCHEMA, "Append", "EventTime")


def sound_groups(told: DataFrame) -> DataFrame:
    """What `running_lots` told, without the groups that sell more than they hold."""
    return told.join(told.where("kind = 'oversold'").select("account_id", "symbol").distinct(), ["account_id", "symbol"], "left_anti")


def matches_told(told: DataFrame) -> DataFrame:
    """The matches in the columns of `ledger.fifo_match`."""
    q, b, s = F.col("quantity"), F.col("buy_price"), F.col("sell_price")
    return sound_groups(told).where("kind = 'match'").select("account_id", "symbol", "buy_id", "sell_id", "buy_date", "sell_date", "quantity", (q * b).alias("cost"), (q * s).alias("proceeds"), (q * (s - b)).alias("gain"), F.date_diff("sell_date", "buy_date").alias("holding_days"))


def lots_told(told: DataFrame) -> DataFrame:
    """What is left of each buy by its newest row, as `ledger.open_lots` has it."""
    last = sound_groups(told).where("kind = 'lot'").groupBy("account_id", "symbol", F.col("buy_id").alias("event_id")).agg(F.max_by(F.struct("buy_date", "quantity", "buy_price"), "version").alias("l"))
    return last.select("account_id", "symbol", "event_id", F.col("l.buy_date").alias("purchase_date"), F.col("l.quantity").alias("quantity"), F.col("l.buy_price").alias("purchase_price")).where(f"quantity > {EPSILON}")
