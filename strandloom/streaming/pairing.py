"""Pairing of mates on a stream: the state holds the reads of a name that still wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "qname string, first long, second long"
STATE = "waiting array<long>"


def _pair(timeout_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the mate did not come: the read is single
            left = list(state.get[0])
            state.remove()
            yield pd.DataFrame({"qname": [key[0]] * len(left), "first": left, "second": pd.array([None] * len(left), "Int64")})
            return
        waiting = list(state.get[0]) if state.exists else []
        out = []
        for ord_ in sorted(x for b in batches for x in b["ord"]):
            if waiting:
                out.append((key[0], waiting.pop(0), ord_))
            else:
                waiting.append(ord_)
        if waiting:
            state.update((waiting,))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["qname", "first", "second"]).astype({"second": "Int64"})

    return run


def pair_stream(records: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """(qname, first, second) of a stream of (qname, ord): the first and second read of a name are mates, and so on.

    With a timeout, a read whose mate does not come within it is given out alone, with a null second; without
    one it waits on. A name has one waiting read at most.
    """
    return records.select("qname", "ord").groupBy("qname").applyInPandasWithState(_pair(timeout_ms), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
