"""The fog timeline as a stream: alternating transitions of each unit from packets as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a packet may come, and for how long after a match's end its units are remembered.
LATENESS = "10 seconds"
LATENESS_MS = 10_000
#: Length of a match whose duration isn't known.
LONGEST_S = 7200.0
_OUT = "match_id string, net_id long, t double, seq long, visible int"


def timed(packets: DataFrame) -> DataFrame:
    """``packets`` (match_id, t, started_at and more) on the clock of the wall: ``at`` is started_at + t, with a watermark."""
    rows = packets.filter("match_id IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND abs(t) < 1e9 AND started_at IS NOT NULL")
    return rows.withColumn("at", F.expr("CAST(started_at AS TIMESTAMP) + make_dt_interval(0, 0, 0, t)")).withWatermark("at", LATENESS)


def fog_stream(packets: DataFrame) -> DataFrame:
    """Transitions (match_id, net_id, t, seq, visible) of a stream of fog packets.

    ``packets``: match_id, seq, t, net_id, leaving, started_at and duration of the match. Matches may follow one another or
    overlap: time is that of the wall. Rows without net_id or leaving only move the clock on, such as one at the end of a
    match. Per unit the state holds the packets that something earlier may still come before, and what the unit's last
    transition was; packets leave it in order of (t, seq) once the watermark has passed them. The state is removed when the
    watermark has passed the match's end.

    Defined results: rows without t, match_id or started_at are left out; resent packets count once; a packet that comes
    later than the watermark is dropped; a match without a duration is remembered for LONGEST_S.
    """
    shape = timed(packets).select("match_id", "net_id", "seq", "t", "at", F.col("leaving").cast("int").alias("on"), F.unix_millis(F.col("started_at").cast("timestamp")).alias("began"), F.coalesce("duration", F.lit(LONGEST_S)).alias("lasts"))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, began, end = [], 0, 0, 0
        if state.exists:
            times, seqs, ons, last, began, end = state.get
            held = list(zip(times, seqs, ons))
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame[frame["on"].notna() & frame["net_id"].notna()]
                if len(frame):
                    began, end = int(frame["began"].iloc[0]), int(frame["began"].iloc[0] + 1000 * frame["lasts"].iloc[0])
                    held.extend(zip(frame["t"].tolist(), frame["seq"].tolist(), frame["on"].astype(int).tolist()))
        if pd.isna(key[1]) or not (held or state.exists):
            return
        held = sorted(set(held))
        watermark = state.getCurrentWatermarkMs()
        out, k = [], 0
        while k < len(held) and began + 1000 * held[k][0] < watermark:
            t, seq, on = held[k]
            if on != last:
                out.append((*key, t, seq, on))
                last = on
            k += 1
        held = held[k:]
        if not held and end + LATENESS_MS < watermark:
            state.remove()
        else:
            state.update(([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], last, began, end))
            due = began + int(1000 * held[0][0]) + 1 if held else end + LATENESS_MS + 1
            state.setTimeoutTimestamp(max(due, watermark + 1))
        yield pd.DataFrame(out, columns=["match_id", "net_id", "t", "seq", "visible"])

    state = "times array<double>, seqs array<long>, ons array<int>, last int, began long, end long"
    return shape.groupBy("match_id", "net_id").applyInPandasWithState(advance, _OUT, state, "append", GroupStateTimeout.EventTimeTimeout)
