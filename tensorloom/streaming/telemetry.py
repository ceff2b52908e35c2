"""Telemetry streams: live reading, a stateful monitor per run, idempotent incremental processing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tensorloom.runtime import is_empty
from tensorloom.sources.files import append_once

# Fixed value: the columns of all record types of the log.
RECORD = "type string, run string, step bigint, epoch bigint, loss double, grad_norm double, lr double, tokens bigint, it_s double, samples_seen bigint, peak_gib double, val_loss double, n_rows bigint, ts double"


def read_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Append-only folder of JSON lines as a stream of tagged records."""
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def monitor(records: DataFrame, keep: float = 0.98, width: int = 200, loss_k: float = 1.5, gnorm_k: float = 3.0, cooldown: int = 50, warm: int = 10) -> DataFrame:
    """One row per train record: moving averages, medians of the last ``width`` values, and whether it raises an alert.

    State per run: the averages, two windows of at most ``width`` values and the step of the last alert.
    Records of a run are taken in order of step within a micro-batch; null losses are passed over.
    """
    columns = ["run", "step", "loss", "loss_median", "loss_ema", "grad_norm", "gnorm_median", "gnorm_ema", "lr", "alert"]
    out = "run string, step bigint, " + ", ".join(f"{c} double" for c in columns[2:-1]) + ", alert boolean"
    state = "loss_ema double, gnorm_ema double, losses array<double>, gnorms array<double>, last bigint"

    def middle(ordered: list[float]) -> float:
        n = len(ordered)
        return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else float("nan")

    def push(window: deque, ordered: list[float], value: float) -> None:
        if len(window) == width:
            del ordered[bisect_left(ordered, window[0])]
        window.append(value)
        insort(ordered, value)

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        le, ge, losses, gnorms, last = held.get if held.exists else (None, None, [], [], None)
        losses, gnorms = deque(losses, maxlen=width), deque(gnorms, maxlen=width)
        by_loss, by_gnorm = sorted(losses), sorted(gnorms)
        rows = []
        batch = pd.concat(list(batches)).sort_values("step")
        for step, loss, gnorm, lr in zip(batch["step"], batch["loss"], batch["grad_norm"], batch["lr"], strict=True):
            if pd.isna(loss):
                continue
            le = loss if le is None else keep * le + (1 - keep) * loss
            push(losses, by_loss, loss)
            if not pd.isna(gnorm):
                ge = gnorm if ge is None else keep * ge + (1 - keep) * gnorm
                push(gnorms, by_gnorm, gnorm)
            ml, mg = middle(by_loss), middle(by_gnorm)
            ready = len(losses) >= max(warm, 2) and (last is None or step - last > cooldown)
            alert = bool(ready and loss > loss_k * ml and gnorm > gnorm_k * mg)
            last = int(step) if alert else last
            rows.append((key[0], step, loss, ml, le, gnorm, mg, ge, lr, alert))
        held.update((le, ge, list(losses), list(gnorms), last))
        yield pd.DataFrame(rows, columns=columns)

    train = records.where("type = 'train'").select("run", "step", "loss", "grad_norm", "lr")
    return train.groupBy("run").applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def alert_records(monitored: DataFrame) -> DataFrame:
    """Alerts of a monitored stream or table as log records, rounded."""
    digits = {"loss": 5, "loss_median": 5, "loss_ema": 5, "grad_norm": 4, "gnorm_median": 4, "gnorm_ema": 4}
    return monitored.where("alert").select(F.lit("alert").alias("type"), "run", "step", *[F.round(c, n).alias(c) for c, n in digits.items()], "lr")


def act_on_alerts(monitored: DataFrame, checkpoint: str, path: str, action: Callable[[DataFrame], None]) -> None:
    """Hand the alerts that have arrived to ``action`` and log them below ``path``, batch by batch.

    A batch that is repeated after a failure replaces its log; ``action`` may then see it again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        alerts = alert_records(batch)
        append_once(alerts, path, batch_id)
        if not is_empty(alerts):
            action(alerts)

    run_available(monitored, checkpoint, each)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what has arrived and stop; each micro-batch goes to ``each`` once per committed batch id."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived into a Parquet folder with an exactly-once commit log."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
