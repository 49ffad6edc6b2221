"""Live consumer groups, publish/subscribe and log tailing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, grp string, id_ms long, id_seq long, consumer string, event string"
STATE = "last_ms long, last_seq long, next_consumer int, ms array<long>, seq array<long>, consumer array<string>"


def consumer_group(entries: DataFrame, grp: str, consumers: list[str]) -> DataFrame:
    """Deliver each entry (key, id_ms, id_seq, kind = 'entry') once, in turn to the consumers; 'ack' rows drop it from the pending list.

    State of each key: the cursor and what is pending; it lives in the state store and survives restarts.
    Entries at or before the cursor are late and come out as 'late'.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ms, seq, turn, pm, ps, pc = state.get if state.exists else (-1, -1, 0, [], [], [])
        pending = {(a, b): c for a, b, c in zip(pm, ps, pc)}
        out = []
        rows = pd.concat(list(batches))
        rows["kind_order"] = (rows["kind"] == "ack").astype(int)
        for r in rows.sort_values(["kind_order", "id_ms", "id_seq"]).itertuples():
            at = (int(r.id_ms), int(r.id_seq))
            if r.kind == "ack":
                who = pending.pop(at, None)
                if who is not None:
                    out.append((key[0], grp, *at, who, "acked"))
            elif at <= (ms, seq):
                out.append((key[0], grp, *at, None, "late"))
            else:
                who = consumers[turn % len(consumers)]
                turn += 1
                ms, seq = at
                pending[at] = who
                out.append((key[0], grp, *at, who, "delivered"))
        state.update((ms, seq, turn, [a for a, _ in pending], [b for _, b in pending], list(pending.values())))
        yield pd.DataFrame(out, columns=["key", "grp", "id_ms", "id_seq", "consumer", "event"])

    return entries.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def fan_out(messages: DataFrame, subs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Live PUBLISH: a stream of messages (seq, channel) joined to static subscriptions; subscriptions are the small side."""
    from keyloom.operators.pubsub import deliver_channels

    out = deliver_channels(messages, subs)
    if patterns is not None:
        hit = messages.join(patterns, F.col("channel").startswith(F.col("prefix")) & F.expr("channel rlike regex")).select("seq", "channel", "client_id", "name")
        out = out.unionByName(hit)
    return out


def windows(entries: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """Counts of entries (key, id_ms) in tumbling windows of event time, closed by a watermark."""
    at = entries.withColumn("at", F.timestamp_millis("id_ms")).withWatermark("at", late)
    return at.groupBy("key", F.window("at", width).alias("w")).agg(F.count("*").alias("n")).select("key", F.unix_millis("w.start").alias("window_ms"), "n")


def replica(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Tail a log: each micro-batch goes to ``apply(batch, number)``, which must accept a repeated number; the checkpoint keeps the place."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
