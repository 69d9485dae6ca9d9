"""New-item alerts: a key is emitted when it is first seen or becomes actionable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.register import ACTIONABLE


def new_items(stream: DataFrame, key: str = "unique_key", priority: str = "review_priority", seq: str = "seq") -> DataFrame:
    """Stream of (key, seq, priority, why): why is `first` or `promoted`. State per key: whether it was actionable yet.

    Rows of one batch are taken in the order of seq; replayed rows say nothing new.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(priority).alias("priority"))

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, acted = (True, state.get[0]) if state.exists else (False, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            able = r.priority in ACTIONABLE
            if not seen:
                out.append((keys[0], r.seq, r.priority, "first"))
            elif able and not acted:
                out.append((keys[0], r.seq, r.priority, "promoted"))
            seen, acted = True, acted or able
        state.update((acted,))
        yield pd.DataFrame(out, columns=["key", "seq", "priority", "why"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, priority string, why string", "acted boolean", "append", GroupStateTimeout.NoTimeout)


def new_items_batch(rows: DataFrame, key: str = "unique_key", priority: str = "review_priority", seq: str = "seq") -> DataFrame:
    """The same over a table."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    able = F.col("priority").isin(*ACTIONABLE)
    r = rows.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(priority).alias("priority"))
    r = r.withColumns({"_n": F.count(F.lit(1)).over(before), "_acted": F.coalesce(F.max(able.cast("int")).over(before), F.lit(0))})
    why = F.when(F.col("_n") == 0, "first").when(able & (F.col("_acted") == 0), "promoted")
    return r.withColumn("why", why).where("why is not null").select("key", "seq", "priority", "why")
