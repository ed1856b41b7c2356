"""Recent against base figures as events arrive: a ring of the newest rows of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.metrics import FIGURES

#: What the ring of a key holds: the order of each row, newest first, and its figures one row after the other.
STATE = "orders array<bigint>, figures array<double>"


def _newest(orders: np.ndarray, figures: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(-orders, kind="stable")[:size]
    return orders[at], figures[at]


def _means(figures: np.ndarray, recent: int, base: int) -> list[float | None]:
    """The means of the newest rows and of the base, column by column; see metrics.recent_and_base."""
    n_recent, n_base = min(len(figures), recent), min(len(figures), base)
    kept = max(10, n_base - n_recent) if n_base > n_recent else n_base
    parts = (figures[:recent], figures[max(0, n_base - kept) : n_base])
    out = []
    for part in parts:
        counts = (~np.isnan(part)).sum(0)
        out += [float(s / c) if c else None for s, c in zip(np.nansum(part, 0), counts, strict=True)]
    return out


def recent_and_base_stream(events: DataFrame, keys: list[str], figures: tuple[str, ...] = FIGURES, *, recent: int = 100, base: int = 300, order: str = "id") -> DataFrame:
    """metrics.recent_and_base of a stream: after each batch, the figures of the keys that it held (output mode update).

    State is a ring of the newest max(recent, base) rows a key by their order, whenever they arrive, so memory doesn't grow
    with the stream and late rows count as in a batch over all of them. Rows that can't be among the newest of their own
    task's batch are left out before the shuffle, so a key with most of the events sends a ring's worth a batch and task.
    Rows with a null order are left out; a key's columns may be null.
    """
    recent, base = max(10, recent), max(20, base)
    size = max(recent, base)
    rows = events.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("bigint").alias("_order"), *[F.col(c).try_cast("double").alias(c) for c in figures])

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            newest = batch.sort_values("_order", ascending=False, kind="stable")
            yield newest.groupby(keys, dropna=False, sort=False).head(size)

    def ring(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, held = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        orders, held = orders.astype(np.int64), held.astype(np.float64).reshape(-1, len(figures))
        for batch in batches:
            more = batch[list(figures)].to_numpy(np.float64, na_value=np.nan)
            orders, held = _newest(np.concatenate([orders, batch["_order"].to_numpy(np.int64)]), np.concatenate([held, more]), size)
        state.update((orders.tolist(), held.ravel().tolist()))
        yield pd.DataFrame([[*key, *_means(held, recent, base)]], columns=[*keys, *names])

    names = [f"{c}_{side}" for side in ("recente", "base") for c in figures]
    schema = StructType([rows.schema[c] for c in keys])
    for name in names:
        schema = schema.add(name, "double")
    told = rows.mapInPandas(narrowed, rows.schema).groupBy(*keys).applyInPandasWithState(ring, schema, STATE, "update", GroupStateTimeout.NoTimeout)
    return told.select(*keys, *[F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in names])


def latest(told: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what has arrived; path holds a folder of answers for each batch, written again if it is run again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_epoch={epoch}")

    told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key, of answers that carry their _epoch."""
    figures = [c for c in answers.columns if c not in (*keys, "_epoch")]
    return answers.groupBy(*keys).agg(F.max_by(F.struct(*figures), "_epoch").alias("_last")).select(*keys, "_last.*")
