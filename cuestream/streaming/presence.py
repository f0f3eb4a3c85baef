"""Concurrent editors: who is live in a project, as a batch timeline and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuestream.plans.scan import OrderedScan, next_row, sum_upto

EXPIRY_US = 15_000_000


def presence_timeline(messages: DataFrame, expiry_us: int = EXPIRY_US, hot: bool | None = None) -> DataFrame:
    """Number of live tabs after each change, per project.

    ``messages(project_id, tab_id, seq, type, at_us)``. A message keeps its tab
    live until the next message of the tab or the expiry; ``closed`` ends it.
    The count is a running sum of +1 and -1 steps, summed per instant first.
    """
    per_tab = OrderedScan.over(messages, ["project_id", "tab_id"], ["at_us", "seq"], hot=hot).add(_next=next_row("at_us"))
    live = per_tab.done().filter(F.col("type") != "closed")
    until = F.least(F.col("at_us") + expiry_us, F.coalesce("_next", F.col("at_us") + expiry_us))
    steps = live.select("project_id", F.explode(F.array(F.struct(F.col("at_us").alias("t"), F.lit(1).alias("d")), F.struct(until.alias("t"), F.lit(-1).alias("d")))).alias("x"))
    net = steps.groupBy("project_id", F.col("x.t").alias("at_us")).agg(F.sum("x.d").alias("_d")).filter(F.col("_d") != 0)
    return OrderedScan.over(net, ["project_id"], ["at_us"], hot=hot).add(live=sum_upto("_d")).done().drop("_d").withColumn(
        "conflict", F.col("live") > 1
    )


OUT = "project_id bigint, at_us bigint, live bigint, primary_tab string"
STATE = "tabs string"


def live_tabs_stream(messages: DataFrame, lateness: str = "1 minute", expiry_us: int = EXPIRY_US) -> DataFrame:
    """Live tab count per project after each micro-batch and on expiry; the earliest live tab is primary.

    ``messages(project_id, tab_id, type, ts)`` with event time ``ts``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tabs: dict[str, list[int]] = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs() * 1000 if state.hasTimedOut else 0
        for pdf in batches:
            for row in pdf.sort_values("ts").itertuples(index=False):
                at = int(row.ts.value // 1000)
                now = max(now, at)
                if row.type == "closed":
                    tabs.pop(row.tab_id, None)
                else:
                    first = tabs[row.tab_id][0] if row.tab_id in tabs else at
                    tabs[row.tab_id] = [first, at]
        tabs = {tab: seen for tab, seen in tabs.items() if seen[1] + expiry_us > now}
        if tabs:
            state.update((json.dumps(tabs),))
            due = (min(seen[1] for seen in tabs.values()) + expiry_us) // 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        primary = min(tabs, key=lambda tab: (tabs[tab][0], tab)) if tabs else None
        yield pd.DataFrame({"project_id": [key[0]], "at_us": [now], "live": [len(tabs)], "primary_tab": [primary]})

    keyed = messages.withWatermark("ts", lateness).groupBy("project_id")
    return keyed.applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
