"""Keyed state of the ad job: what one user has clicked and whether it is listed, and one minute's clicks within the last hour.

State is kept in RocksDB by Spark, is spread by key, and costs a batch what its keys cost. It ends: a user's counts of a day go
when the watermark has passed that day, or when the user is listed; a minute's panes go one by one as they leave the window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What happens in a batch: kind is daily (n: the day's count so far), stat and trend (n: to be added) or listed.
EVENTS = "kind string, date string, minute string, province string, city string, user_id bigint, ad_id bigint, n bigint"
_FIELDS = [f.split()[0] for f in EVENTS.split(", ")]


def _events(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _FIELDS})


class UserClicks(StatefulProcessor):
    """Of one user: the counts by (date, ad) and whether it is listed. A user who is listed when a batch begins adds to the trend
    only; one who reaches `least` clicks on an ad in a day is listed once, from the next batch on."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "date string, ad_id bigint", "n bigint")
        self.listed = handle.getValueState("listed", "listed boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.listed.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stat, trend, ends = Counter(), Counter(), {}
        for part in rows:  # a user's rows come in bounded pieces
            for at, n in part.groupby(["date", "province", "city", "ad_id"], dropna=False).size().items():
                stat[at] += n
            for at, n in part.groupby(["date", "minute", "ad_id"]).size().items():
                trend[at] += n
            ends.update(zip(part["date"], part["day_end"], strict=True))
        out = [{"kind": "trend", "date": d, "minute": m, "ad_id": int(a), "n": int(n)} for (d, m, a), n in trend.items()]
        if not self.listed.exists():
            clicked = Counter()
            for (d, p, c, a), n in stat.items():
                clicked[d, a] += n
                out.append({"kind": "stat", "date": d, "province": None if pd.isna(p) else p, "city": None if pd.isna(c) else c, "ad_id": int(a), "n": int(n)})
            known = {}
            for at, n in clicked.items():
                at = (at[0], int(at[1]))
                known[at] = (self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + int(n)
                out.append({"kind": "daily", "date": at[0], "user_id": int(key[0]), "ad_id": at[1], "n": known[at]})
            if max(known.values(), default=0) >= self.least:
                self.listed.update((True,))
                self.counts.clear()  # nothing more is counted
                out.append({"kind": "listed", "user_id": int(key[0])})
            else:
                for at, n in known.items():
                    self.counts.updateValue(at, (n,))
                for end in set(ends.values()):
                    self.handle.registerTimer(int(end))
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").strftime("%Y-%m-%d")
        for at in [k for k in self.counts.keys() if k[0] < last]:  # noqa: SIM118
            self.counts.removeKey(tuple(at))
        yield _events([])

    def close(self) -> None:
        pass


class MinuteWindow(StatefulProcessor):
    """Of one (minute, ad): the clicks of each pane, a slide of arrival time, and their sum. A pane that leaves the window is subtracted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", "n bigint")
        self.total = handle.getValueState("total", "n bigint")

    def _now(self, key, change: int, step: int) -> pd.DataFrame:
        n = (self.total.get()[0] if self.total.exists() else 0) + change
        if n:
            self.total.update((n,))
        else:
            self.total.clear()
        return pd.DataFrame({"minute": pd.Series([key[0]], dtype=object), "ad_id": [int(key[1])], "n": [n], "step": [step]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = Counter()
        for part in rows:
            for pane, n in part.groupby("pane").size().items():
                new[int(pane)] += int(n)
        for pane, n in new.items():
            if self.panes.containsKey((pane,)):
                self.panes.updateValue((pane,), (self.panes.getValue((pane,))[0] + n,))
            else:
                self.panes.updateValue((pane,), (n,))
                self.handle.registerTimer(pane)
        yield self._now(key, sum(new.values()), 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pane = (expiredTimerInfo.getExpiryTimeInMs(),)
        if self.panes.containsKey(pane):
            gone = self.panes.getValue(pane)[0]
            self.panes.removeKey(pane)
            yield self._now(key, -gone, pane[0])

    def close(self) -> None:
        pass


def user_events(clicks: DataFrame, least: int, lateness: str, listed: DataFrame | None = None) -> DataFrame:
    """clicks(ts, province, city, user_id, ad_id) -> EVENTS of each batch. Clicks that are later than the watermark are not counted;
    listed(user_id) are those who are on the list before the stream's first batch."""
    date = F.date_format("ts", "yyyy-MM-dd")
    day_end = F.unix_millis(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"))
    rows = clicks.withWatermark("ts", lateness).select("ts", date.alias("date"), F.date_format("ts", "HH:mm").alias("minute"), day_end.alias("day_end"), "province", "city", "user_id", "ad_id")
    first = listed.select("user_id").distinct().groupBy("user_id") if listed is not None else None
    return rows.groupBy("user_id").transformWithStateInPandas(UserClicks(least), outputStructType=EVENTS, outputMode="Update", timeMode="EventTime", initialState=first)


def hour_counts(clicks: DataFrame, window: str = "60 minutes", slide_ms: int = 10_000) -> DataFrame:
    """clicks(ts, ad_id, arrived) -> (minute, ad_id, n, step): how many clicks of each event minute arrived within the window that ends with the
    latest arrival, as far as that has changed; 0 where none is left. Of several rows of a key and batch the one with the largest step counts. The
    watermark on arrivals is the window's start."""
    pane = (F.floor(F.unix_millis("arrived") / slide_ms) + 1) * slide_ms
    rows = clicks.withWatermark("arrived", window).select("arrived", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "ad_id", pane.alias("pane"))
    return rows.groupBy("minute", "ad_id").transformWithStateInPandas(MinuteWindow(), outputStructType="minute string, ad_id bigint, n bigint, step bigint", outputMode="Update", timeMode="EventTime")
