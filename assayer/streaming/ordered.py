"""Ordered folds on streams: rows wait until the watermark has passed them, so that late rows still fall into their place.

``start`` and ``step`` are those of ``operators.folds.ordered_fold``, and the result is the same: whatever micro-batches the rows come
in, a key's rows are folded in the order of event time and then of ``order``. A row later than the watermark is dropped by
Spark, as its place has been passed. Per key the store holds the state and the rows of the time that the watermark allows for; both are
kept as JSON, so step functions and rows must survive it. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows wait together by so many milliseconds of event time, a timer and an entry of the store each.
BUCKET_MS = 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class OrderedFold(StatefulProcessor):
    def __init__(self, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | list[dict]], columns: list[str]):
        self.order, self.start, self.step, self.columns = order, start, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows string")
        self.folded = handle.getValueState("folded", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for bucket, own in pdf.groupby(-(-pdf["fold_ms"] // BUCKET_MS) * BUCKET_MS):
                bucket, fresh = int(bucket), json.loads(own.to_json(orient="records"))
                held = json.loads(self.waiting.getValue((bucket,))[0]) if self.waiting.containsKey((bucket,)) else []
                if not held:
                    self.handle.registerTimer(bucket)
                self.waiting.updateValue((bucket,), (json.dumps(held + fresh),))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= passed)
        if due:
            state = json.loads(self.folded.get()[0]) if self.folded.exists() else self.start()
            out: list[dict] = []
            for bucket in due:
                rows = json.loads(self.waiting.getValue((bucket,))[0])
                self.waiting.removeKey((bucket,))
                for row in sorted(rows, key=lambda r: (r["fold_ms"], *(r[c] for c in self.order))):
                    got = self.step(state, row)
                    out += got if isinstance(got, list) else [got]
            self.folded.update((json.dumps(state),))
            yield pd.DataFrame(out, columns=self.columns)
        else:
            yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, keys: list[str], at: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | list[dict]], schema: str, lateness: str = "10 minutes") -> DataFrame:
    """``step(state, row)`` for every row of a key in the order of ``at`` and ``order``, once the watermark has passed it.

    ``schema`` names the step's results in their order.
    """
    use_rocksdb(rows.sparkSession)
    timed = rows.withColumn("fold_at", F.col(at).cast("timestamp")).withColumn("fold_ms", F.unix_millis("fold_at")).withWatermark("fold_at", lateness)
    columns = [part.strip().split()[0].strip("`") for part in schema.split(",")]
    return timed.groupBy(*keys).transformWithStateInPandas(OrderedFold(order, start, step, columns), schema, "append", "eventTime")
