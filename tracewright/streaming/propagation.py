"""Strapdown propagation over a stream of samples.

State per segment: time, attitude, velocity, position, and the last good acceleration. Samples of a trigger are put in time order; one that comes later than
its successors is a step back in time and is held, as in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import params as P
from ..operators.scans import State, _triple, advance

STATE = "t double, q array<double>, v array<double>, p array<double>, a array<double>"


def propagate(samples: DataFrame, key: str = "segment_id", idle: str | None = None, max_step: float = P.MAX_INTEGRATION_STEP_S) -> DataFrame:
    """samples: key, t_s, force_*, gyro_*. A segment without samples for `idle` (such as "10 minutes") gives up its state."""
    kind = dict(samples.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values("t_s", kind="stable")
        t, force, rate = pdf["t_s"].to_numpy(float), _triple(pdf, "force"), _triple(pdf, "gyro")
        out, first = [], 0
        if state.exists:
            st, q, v, p, a = state.get
            s = State(st, np.array(q), np.array(v), np.array(p), np.array(a) if a else None)
        else:
            s, first = State(t[0], np.array([0.0, 0.0, 0.0, 1.0]), np.zeros(3), np.zeros(3)), 1
            out.append((t[0], *s.v, *s.p, 0))
        for i in range(first, len(t)):
            s, flag = advance(s, t[i], force[i], rate[i], None, max_step)
            out.append((t[i], *s.v, *s.p, flag))
        state.update((float(s.t), s.q.tolist(), s.v.tolist(), s.p.tolist(), [] if s.a is None else s.a.tolist()))
        if idle:
            state.setTimeoutDuration(idle)
        res = pd.DataFrame(out, columns=["t_s", "v_x", "v_y", "v_z", "p_x", "p_y", "p_z", "flags"]).astype({"flags": "int32"})
        res.insert(0, key, k[0])
        yield res

    schema = f"{key} {kind}, t_s double, " + ", ".join(f"{a}_{b} double" for a in "vp" for b in "xyz") + ", flags int"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return samples.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", timeout)
