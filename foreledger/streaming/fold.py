"""The same semantics on a stream: keyed state, causal means, quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE = "score double, legal long, falls long, since double, n long, total double, last_order string"


def _totals(x: np.ndarray) -> np.ndarray:
    """Running sums; a missing value has no total of its own and adds nothing to later ones."""
    gap = np.isnan(x)
    return np.where(gap, np.nan, np.cumsum(np.where(gap, 0.0, x)))


class EventFold(StatefulProcessor):
    """Per-key running state; emits the state before each event.

    Input rows carry ``order`` (a sortable text), ``value``, ``legal``, ``fall``
    and ``signal``.  Rows of a micro-batch are folded in order.  An event that
    sorts before the last one folded cannot be folded any more: it comes out
    with ``late`` set and leaves the state alone.
    """

    def __init__(self, keep: Sequence[str]):
        self.keep = list(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self.state.get() if self.state.exists() else (0.0, 0, 0, 0.0, 0, 0.0, "")
        score, legal, falls, since, n, total, last = got
        # One key's rows of one micro-batch: bound it with maxFilesPerTrigger.
        batch = pd.concat(list(rows)).sort_values("order", kind="stable").reset_index(drop=True)
        late = (batch["order"] <= last) | batch["order"].duplicated()
        counts = ~late
        # Running totals after each row; a late row adds nothing.  Arrays, since most keys have few rows.
        value, signal = (batch[c].to_numpy("float64", na_value=np.nan) for c in ("value", "signal"))
        fell = (batch["fall"] & counts).to_numpy(bool)
        after = {
            "score": score + _totals(value * counts.to_numpy()),
            "legal_count": legal + np.cumsum((batch["legal"] & counts).to_numpy(bool), dtype="int64"),
            "falls": falls + np.cumsum(fell, dtype="int64"),
            "n_before": n + np.cumsum(counts.to_numpy(), dtype="int64"),
            "sum_before": total + _totals(signal * counts.to_numpy())}
        known = fell & ~np.isnan(after["score"])
        at = np.maximum.accumulate(np.where(known, np.arange(len(batch)), -1))
        after["at_fall"] = np.where(at >= 0, after["score"][at], score - since)
        start = {"score": score, "legal_count": legal, "falls": falls, "n_before": n, "sum_before": total, "at_fall": score - since}
        pre = {c: np.concatenate(([start[c]], v[:-1])) for c, v in after.items()}
        end = {c: v[-1] for c, v in after.items()}
        self.state.update((
            float(end["score"]), int(end["legal_count"]), int(end["falls"]), float(end["score"] - end["at_fall"]),
            int(end["n_before"]), float(end["sum_before"]), max(last, batch["order"].iloc[-1])))
        pre |= {"since_fall": pre["score"] - pre["at_fall"], "late": late.to_numpy(bool)}
        names = ["score", "legal_count", "falls", "since_fall", "n_before", "sum_before", "late"]
        yield pd.DataFrame({c: batch[c] for c in self.keep} | {c: pre[c] for c in names})

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame, key: str, order: Column, *, value: Column, legal: Column,
                fall: Column, signal: Column, keep: Sequence[str]) -> DataFrame:
    """Pre-event state of a streaming (or batch) frame of keyed events."""
    src = events.withColumns({
        "order": order, "value": value.cast("double"), "legal": legal.cast("boolean"),
        "fall": fall.cast("boolean"), "signal": signal.cast("double")})
    cols = list(dict.fromkeys([key, *keep]))
    kept = StructType([f for f in src.schema.fields if f.name in cols])
    schema = StructType(sorted(kept.fields, key=lambda f: cols.index(f.name)))
    for name, kind in (("score", "double"), ("legal_count", "long"), ("falls", "long"), ("since_fall", "double"),
                       ("n_before", "long"), ("sum_before", "double"), ("late", "boolean")):
        schema = schema.add(name, kind)
    return (
        src.select(*cols, *[c for c in ("order", "value", "legal", "fall", "signal") if c not in cols])
        .groupBy(key).transformWithStateInPandas(
            EventFold(cols), outputStructType=schema, outputMode="Append", timeMode="None"))


def stream_causal_mean(folded: DataFrame, kappa: float, out: str = "theta") -> DataFrame:
    """Shrunken running mean of the signal over strictly earlier events."""
    return folded.withColumn(out, F.col("sum_before") / (F.col("n_before") + F.lit(float(kappa))))


def route_stream(events: DataFrame, reason: Column, good: Callable[[DataFrame, int], None],
                 bad: Callable[[DataFrame, int], None], checkpoint: str):
    """Split every micro-batch into sound and reason-coded rows, one sink each.

    A sink gets the batch's number and must replace what that number wrote before:
    a batch is run again when the query fails between the sink and its commit.
    """
    def both(batch: DataFrame, epoch: int) -> None:
        tagged = batch.withColumn("reason", reason).persist()
        try:
            good(tagged.filter("reason is null").drop("reason"), epoch)
            bad(tagged.filter("reason is not null"), epoch)
        finally:
            tagged.unpersist()

    return (events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def replace_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, over an earlier try."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def drain_to(folded: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming frame over everything available into Parquet."""
    q = (folded.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
