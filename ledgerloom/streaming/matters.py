"""Exceptions and findings over a stream of events: each micro-batch goes on from the state that the last one left."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, StructType

from ledgerloom.operators.events import VERDICT, Judge, verdict


def judged_stream(events: DataFrame, key: str, judge: Judge) -> DataFrame:
    """Every event of a stream with its VERDICT; a micro-batch's events of a key are judged by arrival.

    The state of a key is kept by Spark, with the offsets that it belongs to, so a restarted stream
    judges no event twice.
    """
    schema = StructType(events.schema.fields + VERDICT.fields)

    whole = [f.name for f in events.schema if isinstance(f.dataType, IntegralType)]

    def step(_: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else {}
        rows = pd.concat(list(parts)).astype(object)  # one key's events of one micro-batch
        rows = rows.where(rows.notna(), None).sort_values("arrival", kind="stable")
        for name in whole:  # a column with nulls comes as doubles
            rows[name] = [None if x is None else int(x) for x in rows[name]]
        judged = [verdict(state, event, judge) for event in rows.to_dict("records")]
        kept.update((json.dumps(state),))
        yield pd.DataFrame(judged, columns=schema.names).astype(object)

    return events.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)
