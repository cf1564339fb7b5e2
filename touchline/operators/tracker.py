"""Tracks from detections: motion of each track, and two-stage assignment by overlap, frame by frame.

A track's box moves on by its velocity to the frame at hand. Sure detections go to the tracks that they overlap most, then
unsure ones to the tracks in view that are left, with a stricter overlap; what is left of the sure ones starts tracks. A track
that is not seen is kept for a time and can come back. The state of a match is its tracks, so it does not grow with
its length; rows stream through a task in order of frames, and no match is held as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From this confidence on a detection is sure; unsure ones count down to the least. A new track needs more than a sure one.
SURE, LEAST, STARTS = 0.25, 0.1, 0.35
#: Least overlap (intersection over union) of a detection with a track, for sure and for unsure ones.
OVERLAP, OVERLAP_UNSURE = 0.2, 0.5
#: Frames that a track is kept without being seen, and the weight of the last step in its velocity.
KEPT = 30
STEP = 0.5
BOX = ["x1", "y1", "x2", "y2"]
#: What identifies a detection within its frame, in the order in which equal ones are taken.
ORDER = ["confidence", *BOX, "object_class"]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every one of b."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a.T[:, :, None], b.T[:, None, :]
    area = lambda x1, y1, x2, y2: np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    shared = area(np.maximum(ax1, bx1), np.maximum(ay1, by1), np.minimum(ax2, bx2), np.minimum(ay2, by2))
    whole = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def assign(gain: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of row and column, the greatest overlap first, each once; equal ones by row, then column."""
    r, c = np.nonzero(gain >= least)  # few of all
    if len(r) < 2:
        return list(zip(r.tolist(), c.tolist(), strict=True))
    pairs, rows, columns = [], set(), set()
    for _, r, c in sorted(zip((-gain[r, c]).tolist(), r.tolist(), c.tolist(), strict=True)):
        if r not in rows and c not in columns:
            pairs.append((r, c))
            rows.add(r)
            columns.add(c)
    return pairs


class Tracker:
    """The tracks of one match: number, box, velocity and the frame they were last seen in, a row each, and how many were
    started. ``advance`` takes the detections of the next frame."""

    def __init__(self, tracks: list[tuple] | None = None, started: int = 0) -> None:
        """tracks: as ``rows`` returns them."""
        values = np.array([t[1:-1] for t in tracks or []], dtype=float).reshape(-1, 8)
        self.number, self.seen = (np.array([t[k] for t in tracks or []], dtype=np.int64) for k in (0, -1))
        self.box, self.velocity, self.started = values[:, :4], values[:, 4:], started

    def rows(self) -> list[tuple]:
        """A tuple a track: number, box, velocity, seen."""
        values = np.hstack([self.box, self.velocity]).tolist()
        return [(n, *v, at) for n, v, at in zip(self.number.tolist(), values, self.seen.tolist(), strict=True)]

    def advance(self, frame: int, boxes: np.ndarray, confidence: np.ndarray) -> list[int]:
        """The track number of each detection, 0 for none. Detections stand in their order, the surest first."""
        age = frame - self.seen
        if len(age) and age.max() > KEPT:
            self.keep(age <= KEPT)
            age = frame - self.seen
        given = [0] * len(boxes)
        n_sure, n_least = (int((confidence >= limit).sum()) for limit in (SURE, LEAST))  # the surest stand first
        if len(age) and n_least:
            gain = overlaps(boxes[:n_least], self.box + self.velocity * age[:, None])
            self.take(frame, boxes, given, assign(gain[:n_sure], OVERLAP), age)
            if n_least > n_sure:  # what the first stage left of the tracks that were in view
                free = (age <= 1) & (self.seen < frame)
                self.take(frame, boxes, given, [(n_sure + r, c) for r, c in assign(gain[n_sure:] * free, OVERLAP_UNSURE)], age)
        fresh = [k for k in range(n_sure) if not given[k] and confidence[k] >= STARTS]
        if fresh:
            for k in fresh:
                self.started += 1
                given[k] = self.started
            self.number = np.concatenate([self.number, [given[k] for k in fresh]])
            self.box = np.concatenate([self.box, boxes[fresh]])
            self.velocity = np.concatenate([self.velocity, np.zeros((len(fresh), 4))])
            self.seen = np.concatenate([self.seen, [frame] * len(fresh)])
        return given

    def keep(self, which: np.ndarray) -> None:
        self.number, self.box, self.velocity, self.seen = (x[which] for x in (self.number, self.box, self.velocity, self.seen))

    def take(self, frame: int, boxes: np.ndarray, given: list[int], pairs: list[tuple[int, int]], age: np.ndarray) -> None:
        """Give each pair's detection to its track, which moves on to it."""
        for r, k in pairs:
            box = boxes[r]
            self.velocity[k] = (1 - STEP) * self.velocity[k] + STEP * (box - self.box[k]) / age[k]
            self.box[k], self.seen[k] = box, frame
            given[r] = int(self.number[k])

    def follow(self, frames: np.ndarray, boxes: np.ndarray, confidence: np.ndarray) -> list[int]:
        """The track number of each detection of several frames, which stand in order, their detections as in ``advance``."""
        cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
        given = []
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                given += self.advance(int(frames[a]), boxes[a:b], confidence[a:b])
        return given


COLUMNS = ["match_id", "frame_num", *BOX, "object_class", "confidence"]
SCHEMA = "match_id long, frame_num long, x1 double, y1 double, x2 double, y2 double, object_class string, confidence double"


def assign_tracks(detections: DataFrame) -> DataFrame:
    """detections with the track_id that they belong to, numbered from 1 in each match.

    detections: match_id, frame_num, x1, y1, x2, y2, object_class, confidence; other columns are left out, and so are rows with
    a null in one of these and detections that no track takes. Two equal detections of a frame are two.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, tracker, held = None, Tracker(), None  # held: the frame that may go on in the next part
        for part in itertools.chain(parts, [None]):
            whole = held if part is None else part if held is None else pd.concat([held, part], ignore_index=True)
            if whole is None or not len(whole):
                continue
            matches, frames = whole["match_id"].to_numpy(), whole["frame_num"].to_numpy()
            done = len(whole) if part is None else int(np.argmax((matches == matches[-1]) & (frames == frames[-1])))
            held, whole = whole.iloc[done:], whole.iloc[:done]
            boxes, confidence = whole[BOX].to_numpy(dtype=float), whole["confidence"].to_numpy(dtype=float)
            cuts, given = [0, *(np.flatnonzero(np.diff(matches[:done])) + 1).tolist(), done], []
            for a, b in zip(cuts, cuts[1:]):
                if a < b and matches[a] != match:
                    match, tracker = matches[a], Tracker()
                given += tracker.follow(frames[a:b], boxes[a:b], confidence[a:b])
            given = np.array(given, dtype=np.int64)
            yield whole.assign(track_id=given)[given > 0]

    whole = detections.select(*COLUMNS).na.drop()
    order = ["match_id", "frame_num", F.desc("confidence"), *ORDER[1:]]
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes are much work here
    return whole.repartition(parts, "match_id").sortWithinPartitions(*order).mapInPandas(rows, f"{SCHEMA}, track_id long")
