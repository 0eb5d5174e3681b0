"""Reads as streams. The filters of ``operators.reads`` are stateless and work here unchanged;
pairing mates keeps unmatched reads until they time out. Pairing with a time-out is an
extension: a mate that comes later than that starts a new pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READ = "name string, seqname string, start long, end long, strand string, mapq int, duplicate boolean"
PAIR = "name string, seqname string, start long, end long, strand string, mapq int, duplicate boolean, paired_end boolean"
COLUMNS = [c.split()[0] for c in READ.split(", ")]


def pair_mates(reads: DataFrame, time_out: str | None = None) -> DataFrame:
    """Fragments of the first two reads of each name, as soon as the second comes.

    With ``time_out`` (milliseconds as text) a waiting read is dropped after that processing time.
    """

    def run(key, frames, state: GroupState):
        waiting = list(state.get) if state.exists and not state.hasTimedOut else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for frame in frames:
            for row in frame[COLUMNS].itertuples(index=False, name=None):
                if waiting is None:
                    waiting = list(row)
                    continue
                a, b = sorted((waiting, list(row)), key=lambda r: (r[2], r[3]))
                if a[1] == b[1]:
                    out.append((key[0], a[1], a[2], max(a[3], b[3]), "*", min(a[5], b[5]), bool(a[6] or b[6]), True))
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(None if v is None else v.item() if hasattr(v, "item") else v for v in waiting))
            if time_out:
                state.setTimeoutDuration(int(time_out))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIR.split(", ")])

    return reads.groupBy("name").applyInPandasWithState(run, PAIR, READ, "append", GroupStateTimeout.ProcessingTimeTimeout if time_out else GroupStateTimeout.NoTimeout)


def dropped(reads: DataFrame, name: str) -> DataFrame:
    """``reads`` with a counter of its rows, which query progress reports."""
    return reads.observe(name, F.count(F.lit(1)).alias("rows"))
