"""The replay of a learner over a stream: each key's state is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import Learner, one, told


def replayed(observed: DataFrame, members: list[str], every: int = 25) -> DataFrame:
    """What operators.replay.replayed says of the same rows, micro-batch by micro-batch.

    A row that comes after a later one of its key was taken is late: it teaches nothing, and its kind says so.
    A key's rows of one micro-batch are sorted in a task; bound a trigger by maxFilesPerTrigger.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        learner, last = Learner(len(members), every), None
        if state.exists:
            last, numbers = state.get
            learner.read(list(numbers))
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts_us", "id"], kind="stable")
        for r in rows.itertuples(index=False):
            late = last is not None and r.ts_us < last
            last = last if late or r.ts_us != r.ts_us else int(r.ts_us)
            out.append(one(learner, r.key, r.id, "late" if late else r.kind, r.target, [getattr(r, m) for m in members]))
        state.update((last, learner.numbers()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in told(members).split(", ")])

    return observed.groupBy("key").applyInPandasWithState(step, told(members), "ts_us long, numbers array<double>", "append", GroupStateTimeout.NoTimeout)
