"""Streams: new alerts of components against what was known, and the newest status of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Characters of a description that name an alert.
NAME = 80
STORE = "spark.sql.streaming.stateStore.providerClass"


def new_alerts(checks: DataFrame) -> DataFrame:
    """The batch form. checks: component, checked_at, id, alerts (list); what each check has that the one before it had not.

    A check without alerts clears what is known.
    """
    w = Window.partitionBy("component").orderBy("checked_at", "id")
    cut = F.array_distinct(F.transform("alerts", lambda a: F.left(a, F.lit(NAME))))
    x = checks.select("component", "checked_at", "id", cut.alias("now")).withColumn("before", F.coalesce(F.lag("now").over(w), F.array().cast("array<string>")))
    return x.select("component", "checked_at", "id", F.explode(F.array_except("now", "before")).alias("alert"))


class _Alerts(StatefulProcessor):
    """State of a component: the number of its last check, and each alert with the number of the last check that had it."""

    def __init__(self, forget_after: int | None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "alert string", "number long", self.forget_after)
        self.last = handle.getValueState("last", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.last.get()[0] if self.last.exists() else 0
        for r in sorted(rows, key=lambda r: (r["checked_at"], r["id"])):
            now = list(dict.fromkeys(a[:NAME] for a in (r["alerts"] or [])))
            for a in now:
                if not self.known.containsKey((a,)) or self.known.getValue((a,))[0] != n:
                    yield Row(component=key[0], checked_at=r["checked_at"], id=r["id"], alert=a)
                self.known.updateValue((a,), (n + 1,))
            n += 1
        self.last.update((n,))
        for k in [k for k, v in self.known.iterator() if v[0] != n]:
            self.known.removeKey(k)

    def close(self) -> None:
        pass


def watch_alerts(checks: DataFrame, forget_after: int | None = None) -> DataFrame:
    """The stream form of new_alerts: equal to it as long as checks of a component arrive in their order.

    Each alert is a state entry of its own, so a check rewrites only what it names; what the last check hasn't is removed. With
    forget_after (milliseconds), an alert that no check has named for so long is forgotten, and new when it comes again; such a stream looks
    for what has expired for ever, so it needs an interval, and no trigger that ends by itself. State lies in
    RocksDB beside the checkpoint, and is there again after a restart. A micro-batch holds the checks of one component in a worker.
    """
    conf = checks.sparkSession.conf
    if not conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = checks.select("component", "checked_at", "id", "alerts").groupBy("component")
    return x.transformWithState(_Alerts(forget_after), "component string, checked_at timestamp, id long, alert string", "Append", "ProcessingTime" if forget_after else "None")


def newest_status(scans: DataFrame) -> DataFrame:
    """A stream of scans to the newest of each domain, for update mode."""
    return scans.groupBy("domain").agg(F.max(F.struct("scanned_at", "id", "score")).alias("s")).select("domain", "s.scanned_at", "s.id", "s.score")


class Scheduler:
    """Runs jobs over what has arrived: start with an interval, change it while running, stop each by itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.running = spark, {}

    def start(self, name: str, stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, mode: str = "append"):
        """Every `interval` (as "6 hours"), or once over what is there."""
        self.stop(name)
        w = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
        self.running[name] = (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
        return self.running[name]

    def stop(self, name: str) -> None:
        if q := self.running.pop(name, None):
            q.stop()

    def status(self) -> dict[str, bool]:
        return {name: q.isActive for name, q in self.running.items()}
