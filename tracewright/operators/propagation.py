"""Strapdown propagation of a recording by many tasks at once.

Attitudes are products of the turns of the steps, and products are associative: each block of time multiplies its own turns, the blocks' products are multiplied through, and a second pass starts every block from its attitude. All blocks of a
task go side by side, by doubling, so what a task does is a few array operations, however short its blocks are. Velocities and positions then are sums, added up the same way. A step that can't be integrated is the identity, so it needs no loop either. Equal to scans.mechanize with on_gap "skip", which
walks a recording sample by sample, to rounding; a trajectory that has to end at a bad step, or attitudes that are supplied, stay with that one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .store import Tables
from .timeline import _key

BLOCK_S = 60.0
GROUP_ROWS = 200_000  # samples of blocks that one group walks, one block after the other
LAST = 1 << 62  # the block of samples without a time, which come last
VECTORS = [*[f"force_{a}" for a in "xyz"], *[f"gyro_{a}" for a in "xyz"]]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of quaternions (x, y, z, w)."""
    v, u, s, r = a[..., :3], b[..., :3], a[..., 3:], b[..., 3:]
    return np.concatenate([s * u + r * v + np.cross(v, u), s * r - (v * u).sum(axis=-1, keepdims=True)], axis=-1)


def running(x: np.ndarray, at: np.ndarray, join) -> np.ndarray:
    """join of each row with all earlier ones of its stretch, by doubling; at: a row's number in its stretch, from 0."""
    out, step, longest = x.copy(), 1, int(at.max(initial=-1)) + 1
    while step < longest:
        rows = np.flatnonzero(at >= step)
        out[rows] = join(out[rows - step], out[rows])
        step *= 2
    return out


def products(turns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running products of rows in their stretches."""
    out = running(turns, at, multiply)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2.0 * np.cross(q[:, :3], v)
    return v + q[:, 3:] * t + np.cross(q[:, :3], t)


class Steps:
    """The steps of blocks of samples, one below the other: their lengths, flags and turns. at: a sample's number in its block; first: whether its block is a recording's first; before: the last finite time of earlier blocks."""

    def __init__(self, t: np.ndarray, force: np.ndarray, rate: np.ndarray, at: np.ndarray, first: np.ndarray, before: np.ndarray, max_step: float):
        known, i = np.isfinite(t), np.arange(len(t))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(known, i, -1))[:-1]])
        held = np.where(last >= i - at, t[last], np.where(first, np.nan, before))
        starts = first & (at == 0)
        dt = t - held
        size = lambda x: np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore"):
            sensed = (size(force) <= P.MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2) & (size(rate) <= P.MAX_PLAUSIBLE_RATE_RPS)
            self.flags = np.select([~np.isfinite(dt), dt <= 0, dt > max_step, ~sensed], [32, 8, 16, 32], 0).astype(np.int32)
        self.flags[starts] = 0
        self.good = (self.flags == 0) & ~starts  # where the trajectory starts, nothing is integrated
        self.dt = np.where(self.good, dt, 0.0)
        r = np.where(self.good[:, None], rate, 0.0) * self.dt[:, None]
        n = size(r)
        k = np.where(n < 1e-12, 0.5, np.sin(n / 2) / np.where(n < 1e-12, 1.0, n))
        self.turns = np.column_stack([k[:, None] * r, np.cos(n / 2)])


def numbers(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Each row's number in its stretch of equal columns, from 0; rows are in the order of these columns."""
    own = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    i = np.arange(len(pdf))
    return i - np.maximum.accumulate(np.where(np.diff(own, prepend=-1) != 0, i, 0))


def mechanize(df: DataFrame, key: str = "segment_id", ties: list[str] | None = None, max_step: float = P.MAX_INTEGRATION_STEP_S, block_s: float = BLOCK_S) -> DataFrame:
    """Velocity, position and attitude of each sample from the segment's first: key, ties, t_s, v, p, q and flags.

    df: key, t_s, force_*, gyro_*, in the order of t_s and then of `ties`; q_* and v0_* of the first sample are the state to start from where these columns are there, else level and at rest.
    """
    k, ties = _key(key), list(ties or [])
    tables = Tables(df.sparkSession, "propagation")
    have = [c for c in (*[f"q_{a}" for a in "xyzw"], *[f"v0_{a}" for a in "xyz"]) if c in df.columns]
    finite = F.col("t_s").isNotNull() & ~F.isnan("t_s") & (F.abs("t_s") != float("inf"))
    rows = df.withColumn("__b", F.when(finite, F.floor(F.col("t_s") / block_s)).otherwise(LAST).cast("bigint")).select(*k, *ties, "__b", F.col("t_s").cast("double").alias("t_s"), *[F.col(c).cast("double").alias(c) for c in (*VECTORS, *have)])
    at = F.struct("t_s", *ties)
    ends = rows.groupBy(*k, "__b").agg(F.count("*").alias("n"), F.max(F.when(F.col("__b") != LAST, F.col("t_s"))).alias("end"), F.max_by(F.struct(*VECTORS[:3]), at).alias("force"))
    w = W.partitionBy(*k).orderBy("__b")
    ends, _ = tables.keep(ends.select(*k, "__b", "n", F.last("end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.lag("force").over(w).alias("__force"), (F.row_number().over(w) == 1).alias("__first")))
    total, count = (x or 0 for x in ends.agg(F.sum("n"), F.count("*")).first())
    shares = lambda n: max(1, -(-n // GROUP_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, n // 1000))
    groups, chains = shares(total), shares(count)
    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in k)

    def blocks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, Steps]:
        """A group's samples in order, their numbers in their blocks, and their steps."""
        pdf = pdf.sort_values([*k, "__b", "t_s", *ties], kind="stable").reset_index(drop=True)
        at = numbers(pdf, [*k, "__b"])
        columns = lambda names: pdf[names].to_numpy(float)
        return pdf, at, Steps(columns("t_s"), columns(VECTORS[:3]), columns(VECTORS[3:]), at, pdf["__first"].to_numpy(bool), columns("__before"), max_step)

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, s = blocks(pdf)
        lo = np.flatnonzero(at == 0)
        hi = np.append(lo[1:], len(pdf)) - 1
        start = np.tile([0.0, 0.0, 0.0, 1.0], (len(lo), 1))
        if "q_x" in pdf:
            own = pdf["__first"].to_numpy(bool)[lo]
            start[own] = pdf[[f"q_{a}" for a in "xyzw"]].to_numpy(float)[lo[own]]
        head = pdf.iloc[lo][[*k, "__b"]].reset_index(drop=True)
        return head.assign(turn=products(s.turns, at)[hi].tolist(), start=start.tolist(), good=s.good[hi])

    def grouped(df: DataFrame):
        return df.withColumn("__g", F.pmod(F.xxhash64(*k, "__b"), F.lit(groups))).groupBy("__g")

    dealt = rows.join(ends.drop("n"), [*k, "__b"])
    found = grouped(dealt).applyInPandas(turns, f"{kinds}, __b long, turn array<double>, start array<double>, good boolean")

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        """The attitude that each block of a group of recordings starts from, and whether the sample before it was integrated."""
        pdf = pdf.sort_values([*k, "__b"]).reset_index(drop=True)
        at = numbers(pdf, k)
        turn, good = np.array(pdf["turn"].tolist()), pdf["good"].to_numpy(bool)
        chain = np.where((at == 0)[:, None], np.array(pdf["start"].tolist()), np.roll(turn, 1, axis=0))
        q = running(chain, at, multiply)
        later = (at > 0)[:, None]
        q = np.where(later, q / np.where(later, np.linalg.norm(q, axis=1, keepdims=True), 1.0), q)
        return pdf[[*k, "__b"]].assign(__q=q.tolist(), __good=(at > 0) & np.roll(good, 1))

    chained = found.withColumn("__g", F.pmod(F.xxhash64(*k), F.lit(chains))).groupBy("__g")
    starts, _ = tables.keep(chained.applyInPandas(through, f"{kinds}, __b long, __q array<double>, __good boolean"))
    names = ["v_x", "v_y", "v_z", "p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, s = blocks(pdf)
        out, lo = pdf[[*k, *ties, "__b", "t_s"]].copy(), at == 0
        columns = lambda names: pdf[names].to_numpy(float)
        down = np.array([0.0, 0.0, P.STANDARD_GRAVITY_MPS2])
        q0 = columns([f"__q{j}" for j in range(4)])
        q = multiply(q0, products(s.turns, at))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        a = turned(q, columns(VECTORS[:3])) - down
        head = np.where(pdf["__good"].to_numpy(bool)[lo, None], turned(q0[lo], columns([f"__{c}" for c in VECTORS[:3]])[lo]) - down, np.nan)
        before = np.roll(np.where(s.good[:, None], a, np.nan), 1, axis=0)
        before[lo] = head
        before = np.where(np.isnan(before), a, before)
        dv = np.where(s.good[:, None], 0.5 * (before + a), 0.0) * s.dt[:, None]
        v = running(dv, at, np.add)
        out[names] = np.column_stack([v, running((v - 0.5 * dv) * s.dt[:, None], at, np.add), q])
        out["moved_s"], out["flags"] = running(s.dt, at, np.add), s.flags
        out["v0"] = np.nan_to_num(pdf[[f"v0_{c}" for c in "xyz"]].to_numpy(float)).tolist() if "v0_x" in pdf else [[0.0, 0.0, 0.0]] * len(pdf)
        return out

    tie_kinds = "".join(f", `{c}` {dict(df.dtypes)[c]}" for c in ties)
    relative, _ = tables.keep(grouped(dealt.join(starts, [*k, "__b"]).select("*", *[F.col("__q")[j].alias(f"__q{j}") for j in range(4)], *[F.col(f"__force.{c}").alias(f"__{c}") for c in VECTORS[:3]]).drop("__q", "__force")).applyInPandas(run, f"{kinds}{tie_kinds}, __b long, t_s double, " + ", ".join(f"{c} double" for c in names) + ", moved_s double, flags int, v0 array<double>"))
    sums = relative.groupBy(*k, "__b").agg(F.max_by(F.struct("moved_s", *names[:6]), at).alias("e"), F.min_by("v0", at).alias("v0"))
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    begin = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    at0 = F.first("v0").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    sums = sums.select(*k, "__b", "e", *[(begin(F.col(f"e.v_{a}")) + at0[j]).alias(f"__v_{a}") for j, a in enumerate("xyz")])
    sums = sums.select(*k, "__b", *[f"__v_{a}" for a in "xyz"], *[begin(F.col(f"__v_{a}") * F.col("e.moved_s") + F.col(f"e.p_{a}")).alias(f"__p_{a}") for a in "xyz"])
    out = relative.join(sums, [*k, "__b"])
    v = [(F.col(f"v_{a}") + F.col(f"__v_{a}")).alias(f"v_{a}") for a in "xyz"]
    p = [(F.col(f"p_{a}") + F.col(f"__p_{a}") + F.col(f"__v_{a}") * F.col("moved_s")).alias(f"p_{a}") for a in "xyz"]
    return out.select(*k, *ties, "t_s", *v, *p, *names[6:], "flags")
