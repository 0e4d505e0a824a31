"""Cooldown filter: an event passes only if enough time went by since the last one that passed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from learnloom.operators.sequence import fold_blocks


def accept(times, cooldowns, last: int | None) -> tuple[list[bool], int | None]:
    """Flags for ordered event times, starting from the last accepted time."""
    flags = []
    for at, wait in zip(times, cooldowns):
        ok = last is None or at - last >= wait
        flags.append(ok)
        if ok:
            last = at
    return flags, last


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _flags(times: pd.Series, cooldowns: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series(
        [
            accept(at.tolist(), wait.tolist(), None if pd.isna(first) else int(first))[0]
            for at, wait, first in zip(times, cooldowns, last)
        ]
    )


def cooldown_filter(events: DataFrame, keys: list[str], at: str, cooldown: str, order: str = "seq") -> DataFrame:
    """Add ``accepted``. ``cooldown`` is a column (0 = always accept); the state is only the
    last accepted time, so chained blocks settle at the first gap longer than the cooldown.

    Spark gathers and sorts each (keys, block); one Arrow batch then holds many groups, so
    the Python loop costs no per-group frame.
    """
    group = [*keys, "block"]
    rest = [c for c in events.columns if c not in [*group, order]]

    def flagged(frame: DataFrame, columns: list[str], starts: DataFrame | None) -> DataFrame:
        rows = frame.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
        if starts is None:
            rows = rows.withColumn("state", F.lit(None).cast("bigint"))
        else:
            saved = starts.select(*group, F.get("state.value", F.lit(0)).alias("state"))
            rows = rows.join(saved.hint("merge"), group, "left")  # small files of many rows: no broadcast
        return rows.withColumn("accepted", _flags(f"rows.{at}", f"rows.{cooldown}", "state"))

    def run(frame, starts):
        passed = F.filter(F.arrays_zip(F.col(f"rows.{at}").alias("at"), F.col("accepted").alias("ok")), lambda e: e.ok)
        last = F.array_max(F.transform(passed, lambda e: e["at"]))
        ended = flagged(frame, [at, cooldown], starts).select(*group, F.lit("last").alias("part"), last.alias("value"))
        return ended.where("value is not null")

    starts = fold_blocks(events, keys, run, "bigint")
    out = flagged(events, rest, starts).select(*group, F.inline(F.arrays_zip("rows", "accepted")))
    return out.select(*group, "rows.*", "accepted").select(*events.columns, "accepted")
