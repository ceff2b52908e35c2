"""Time series of runs: rolling medians, spikes with cooldown, latencies, counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.operators.order import chunked, index_within, linear_scan, running_totals


# Bounds of an alert.
LOSS_K, GNORM_K, COOLDOWN, WARM, WIDTH, KEEP = 1.5, 3.0, 50, 10, 200, 0.98


def rolling_median(df: DataFrame, group: str, order: list[str], values: dict[str, str], width: int = WIDTH, chunk: int = 20_000, position: str | None = None) -> DataFrame:
    """Median of the last ``width`` rows of each group, the current one included.

    ``values``: column -> name of its median. Also adds ``n_window``, the rows in the window. Long
    groups are cut into chunks with the rows before them, so that no task gets a whole group. ``position``
    names a column that numbers the rows of each group from 0 without gaps; without it they are numbered by ``order``.
    """
    placed = df.withColumn("_pos", F.col(position)) if position else index_within(df, group, *order, name="_pos")
    cut = chunked(placed, group, "_pos", chunk, width - 1)
    frame = Window.partitionBy(group, "_chunk").orderBy("_pos").rowsBetween(-(width - 1), 0)
    out = cut.select("*", *[F.expr(f"percentile({c}, 0.5)").over(frame).alias(m) for c, m in values.items()], F.count("*").over(frame).alias("n_window"))
    return out.where(~F.col("_lead")).drop("_chunk", "_lead")


def spikes(
    df: DataFrame, group: str, order: list[str], step: str, loss: str = "loss", gnorm: str = "gnorm",
    width: int = WIDTH, loss_k: float = LOSS_K, gnorm_k: float = GNORM_K, cooldown: int = COOLDOWN, warm: int = WARM, position: str | None = None,
) -> DataFrame:
    """Alerts of each group: loss above ``loss_k`` medians and gradient norm above ``gnorm_k``, not within the cooldown of the last alert.

    The window must hold ``warm`` rows, two at least, the current one included. An alert also tells the moving averages
    of both. Only candidates, which are rare, are folded in order. ``position``: see ``rolling_median``.
    """
    averaged = linear_scan(df, {loss: "loss_ema", gnorm: "gnorm_ema"}, KEEP, *order, group=group)
    med = rolling_median(averaged, group, order, {loss: "loss_median", gnorm: "gnorm_median"}, width, position=position)
    hot = med.where((F.col("n_window") >= max(warm, 2)) & (F.col(loss) > F.col("loss_median") * loss_k) & (F.col(gnorm) > F.col("gnorm_median") * gnorm_k))
    kind = df.schema[group].dataType.simpleString()

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos").reset_index(drop=True)
        last: dict = {}
        out = []
        for k, (g, s) in enumerate(zip(rows[group], rows["step"], strict=True)):
            g = None if pd.isna(g) else g
            if g not in last or s - last[g] > cooldown:
                out.append(k)
                last[g] = s
        return rows.iloc[out].drop(columns=["_pos", "_bucket"])

    shown = {"loss": 5, "loss_median": 5, "loss_ema": 5, "gnorm": 4, "gnorm_median": 4, "gnorm_ema": 4}
    schema = f"{group} {kind}, step long, " + ", ".join(f"{c} double" for c in shown)
    own = {"loss": loss, "gnorm": gnorm}
    narrow = hot.select(group, F.col(step).cast("long").alias("step"), *[F.col(own.get(c, c)).cast("double").alias(c) for c in shown], "_pos")
    narrow = narrow.withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(64)))
    alerts = narrow.groupBy("_bucket").applyInPandas(keep, schema)
    return alerts.select(group, "step", *[F.round(c, digits).alias(c) for c, digits in shown.items()])


def throughput(df: DataFrame, group: str, order: list[str], tokens: str, at: str, step_ms: str, steps_total: int, batch_size: int = 8) -> DataFrame:
    """Counters of a run so far: ``samples_seen, tokens_seen, tok_s, it_s, eta_min``.

    ``at`` is the time in seconds; rates are averages since the run's first row, the time left follows the last step.
    """
    began = df.groupBy(F.col(group).alias("_g")).agg(F.min(at).alias("_began"))
    seen = running_totals(df, group, order, {"tokens_seen": F.col(tokens)}).join(began, F.col(group).eqNullSafe(F.col("_g")))
    elapsed = F.greatest(F.lit(1e-9), F.col(at) - F.col("_began"))
    return seen.select(
        *df.columns, F.col("n_so_far").alias("step"), (F.col("n_so_far") * batch_size).alias("samples_seen"), "tokens_seen",
        F.round(F.col("tokens_seen") / elapsed, 1).alias("tok_s"), F.round(F.col("n_so_far") / elapsed, 3).alias("it_s"),
        F.round((F.lit(steps_total) - F.col("n_so_far")) * F.col(step_ms) / 60_000, 1).alias("eta_min"),
    )


def progress(df: DataFrame, group: str, order: list[str], rows: str, at: str, began: float, rows_total: int) -> DataFrame:
    """Rows done so far, rows a second since ``began`` (seconds) and minutes left: ``rows_done, rows_s, eta_min``."""
    seen = running_totals(df, group, order, {"rows_done": F.col(rows)})
    rate = F.col("rows_done") / F.greatest(F.lit(1e-9), F.col(at) - began)
    left = (F.lit(rows_total) - F.col("rows_done")) / F.greatest(F.lit(1e-9), rate) / 60
    return seen.select(*df.columns, "rows_done", F.round(rate, 1).alias("rows_s"), F.round(left, 1).alias("eta_min"))


def chart_series(records: DataFrame, run: str = "run") -> DataFrame:
    """Points of the three training charts as rows of ``run, panel, series, step, value``: loss (raw, averaged, validation),
    gradient norm (raw, averaged), rates (learning rate, tokens a second), and the alerts of the first two."""
    train = records.where("type = 'train'")
    averaged = linear_scan(train, {"loss": "_loss_ema", "grad_norm": "_gnorm_ema"}, KEEP, "step", group=run)
    points = F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(s).alias("series"), F.col(c).cast("double").alias("value")) for p, s, c in (
        ("loss", "train", "loss"), ("loss", "train average", "_loss_ema"), ("gradient norm", "raw", "grad_norm"), ("gradient norm", "average", "_gnorm_ema"), ("rates", "lr", "lr"), ("rates", "tokens/s", "tok_s"))])
    curves = averaged.select(run, "step", F.explode(points).alias("p")).select(run, "p.panel", "p.series", "step", "p.value")
    val = records.where("type = 'val'").select(run, F.lit("loss").alias("panel"), F.lit("validation").alias("series"), "step", F.col("val_loss").cast("double").alias("value"))
    marks = records.where("type = 'alert'").select(run, F.explode(F.array(F.lit("loss"), F.lit("gradient norm"))).alias("panel"), F.lit("alert").alias("series"), "step", F.lit(None).cast("double").alias("value"))
    return curves.unionByName(val).unionByName(marks).where("value is not null or series = 'alert'")


def grok_window(samples: int = 57_600, batch_size: int = 8) -> tuple[int, int]:
    """Steps between which a late fall of the loss is expected: 0.8 to 1.25 times the samples of the published run."""
    return int(samples / batch_size * 0.8), int(samples / batch_size * 1.25)


def latency_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, total and p95 (the element at ``int(0.95 n) - 1`` of the sorted values, the first for n = 1) of each group.

    Equal values are counted first, so one that repeats is one row; its place follows from running counts. Nulls are
    left out.
    """
    known = df.select(group, value).where(F.col(value).isNotNull())
    totals = known.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.sum(value), 4).alias("total"))
    counts = known.groupBy(group, value).agg(F.count("*").alias("_k"))
    placed = running_totals(counts, group, [value], {"_upto": F.col("_k")}).select(F.col(group).alias("_g"), "_k", "_upto", F.col(value).alias("p95"))
    place = F.greatest(F.floor(F.col("n") * 95 / 100), F.lit(1)) - 1
    at = totals.join(placed, F.col(group).eqNullSafe(F.col("_g"))).where((F.col("_upto") > place) & (F.col("_upto") - F.col("_k") <= place))
    return at.select(group, "n", "mean", "total", "p95")


def mean_of_means(df: DataFrame, group: str, batch: str, value: str) -> DataFrame:
    """Mean of batch means (not weighted by rows) and the number of rows."""
    each = df.groupBy(group, batch).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    return each.groupBy(group).agg(F.round(F.avg("_m"), 6).alias("mean_of_means"), F.sum("_n").alias("n_rows"))


def sweep_stats(samples: DataFrame, setting: str, images: str, seconds: str, memory: str, load: str) -> DataFrame:
    """Images a second, peak memory and mean load of each setting of a sweep; load is null without samples."""
    rate = F.sum(images) / F.greatest(F.lit(1e-9), F.sum(seconds))
    return samples.groupBy(setting).agg(F.round(rate, 6).alias("img_s"), F.max(memory).alias("peak"), F.round(F.avg(load), 6).alias("load"))
