"""Recordings in the memory of a task, many short ones at once, so that recurrences walk them side by side as lanes of arrays, and long ones piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(batches: Iterator[pd.DataFrame], key: list[str], rows: int) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """(frame, begun, ends): batches of a partition that is sorted by key, joined and cut between recordings, about `rows` samples each.

    A recording of more comes in frames of its own, each of which begins with the last sample of the one before (begun); where it goes on after the frame, ends is false.
    """
    held, n, begun = [], 0, False
    for pdf in chain(batches, [None]):
        if pdf is not None:
            held.append(pdf)
            n += len(pdf)
        if n < (rows if pdf is not None else 1):
            continue
        over, pdf = pdf is None, pd.concat(held, ignore_index=True)
        own, at = lane_of(pdf, key), 0
        if begun:
            at = int(np.searchsorted(own, 0, side="right"))
            begun = at == n and not over
            yield pdf.iloc[:at], True, not begun
        if not begun:
            last = n if over else int(np.searchsorted(own, own[-1]))
            if last > at:
                yield pdf.iloc[at:last], False, True
                at = last
            begun = n - at >= rows
            if begun:
                yield pdf.iloc[at:], False, False
        rest = (pdf.iloc[-1:] if begun else pdf.iloc[at:]).copy()
        held, n = [rest], len(rest)


def whole(batches: Iterator[pd.DataFrame], key: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """pieces with each recording in one frame, however long it is."""
    held = []
    for pdf, begun, ends in pieces(batches, key, rows):
        held.append(pdf.iloc[1:] if begun else pdf)
        if ends:
            yield pd.concat(held, ignore_index=True)
            held = []


def lane_of(pdf: pd.DataFrame, key: list[str]) -> np.ndarray:
    """The number of each row's recording, in the order of rows."""
    return pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()


def alike(length: np.ndarray, most: int = 2_000_000) -> list[np.ndarray]:
    """Recordings dealt into batches of similar length, so that lanes are at least half full, of no more than `most` places but for single recordings."""
    out: list[list[int]] = []
    for j in np.argsort(-length, kind="stable"):
        if not out or length[out[-1][0]] > 2 * length[j] or (len(out[-1]) + 1) * length[out[-1][0]] > most:
            out.append([])
        out[-1].append(int(j))
    return [np.array(b) for b in out]


class Lanes:
    """A batch of recordings of a frame: places (lane, sample) and the rows they hold."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.length = first, length
        self.at = np.concatenate([np.arange(n) for n in length])
        self.own = np.repeat(np.arange(len(length)), length)
        self.rows = np.repeat(first, length) + self.at

    def place(self, values: np.ndarray) -> np.ndarray:
        """Values of all rows of the frame by lane and sample; not a number where a lane has ended."""
        held = np.full((len(self.length), int(self.length.max()), *values.shape[1:]), np.nan)
        held[self.own, self.at] = values[self.rows]
        return held

    def taken(self, held: np.ndarray) -> np.ndarray:
        """What is at the places of self.rows, in their order."""
        return held[self.own, self.at]


def batches(pdf: pd.DataFrame, key: list[str], most: int = 2_000_000) -> Iterator[Lanes]:
    """Lanes of a frame of whole recordings, one below the other."""
    first = np.flatnonzero(np.diff(lane_of(pdf, key), prepend=-1))
    length = np.diff(np.append(first, len(pdf)))
    for some in alike(length, most):
        yield Lanes(first[some], length[some])


def over(df: DataFrame, key: list[str], order: list[str], run: Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]], schema: str, rows: int, at_end: bool = False) -> DataFrame:
    """What run gives for all recordings, each in order, unknown values last. Spark deals them by key and sorts them; a task holds about `rows` samples at a time, however long a recording is.

    run(frame, before) has a frame of whole recordings and None, or a piece of one recording and its state at the first sample (None where the piece is its first); it gives rows, and the state at the last sample. The first sample of a piece with a state is
    the last of the piece before. at_end: rows count only where a recording ends.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf, begun, ends in pieces(frames, key, rows):
            out, state = run(pdf.reset_index(drop=True), state if begun else None)
            if ends or not at_end:
                yield out

    dealt = df.repartition(*key).sortWithinPartitions(*key, *[F.col(c).asc_nulls_last() for c in order])
    return dealt.mapInPandas(each, schema)
