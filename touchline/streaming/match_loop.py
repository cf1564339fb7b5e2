"""A match as one stateful loop: observe, possess, confirm, attribute, frame by frame, with one state per match.

Rows wait in a list state until the watermark has passed them; a timer wakes the match then. The frames that are ready are
gone through in order, within a frame first what was seen of the players (teams, crops), then the touch, then the event. What is
kept between wakes is bounded whatever the match's length: of each track its first known team and its best crops, the touches
of the lookback, and the frame of the last confirmed event. It is read and written once a wake, not once a row, and a match
wakes once a trigger: rows that come in take the place of the timer that was set. Of a track's teams only the first one waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.events import COOLDOWN, START
from touchline.operators.possession import LOOKBACK, RECENT
from touchline.streaming.stateful import IDLE_MS

#: The state store that list and map states need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TEAM, CROP, TOUCH, EVENT = range(4)
CROPS_KEPT, CROPS_READ = 16, 8
COLUMNS = ["frame_num", "kind", "track_id", "team_id", "score", "quality", "event", "ts"]
OUT = "match_id long, goal_frame long, track_id long, last_touch_frame long, possession_confidence double, team_id int, crop_frames array<long>, crop_qualities array<double>"


def loop_rows(teams: DataFrame, crops: DataFrame, touches: DataFrame, events: DataFrame) -> DataFrame:
    """One table of what a match's frames hold: teams (track_id, team_id), crops (track_id, score, quality), touches
    (track_id), and eligible events (event), each with match_id and frame_num."""
    kinds = {"track_id": "long", "team_id": "int", "score": "double", "quality": "double", "event": "string"}
    parts = [
        df.select("match_id", "frame_num", F.lit(k).alias("kind"), *[(F.col(c) if c in held else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        for k, (df, held) in enumerate([(teams.where("team_id <> 0"), ["track_id", "team_id"]), (crops, ["track_id", "score", "quality"]), (touches, ["track_id"]), (events, ["event"])])
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


class MatchLoop(StatefulProcessor):
    def __init__(self, cooldown: int = COOLDOWN, lookback: int = LOOKBACK, recent: int = RECENT) -> None:
        self.cooldown, self.lookback, self.recent = cooldown, lookback, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame_num long, kind int, track_id long, team_id int, score double, quality double, event string, ts long")
        self.touches = handle.getListState("touches", "frame_num long, track_id long")
        self.teams = handle.getMapState("teams", "track_id long", "team_id int")
        self.crops = handle.getMapState("crops", "track_id long", "scores array<double>, frames array<bigint>, qualities array<double>")
        self.clock = handle.getValueState("clock", "confirmed long, last_ts long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            part = part[COLUMNS].assign(ts=part["ts"].astype("int64") // 1_000_000)  # nanoseconds of a pandas time
            for frame, kind, track, team, score, quality, event, ts in zip(*(part[c].tolist() for c in COLUMNS), strict=True):
                if kind == EVENT:
                    fresh.append((frame, kind, None, None, None, None, event, ts))
                elif track is not None and track == track:  # a column with a null holds floats; the state wants whole numbers
                    crop = (score, quality) if kind == CROP else (None, None)
                    fresh.append((frame, kind, int(track), int(team) if kind == TEAM else None, *crop, None, ts))
        yield from self.advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key: Any, fresh: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        confirmed, last, timer = self.clock.get() or (START, 0, None)
        held = [tuple(x) for x in self.waiting.get()] + fresh
        last = max([last, *(x[-1] for x in held)])
        known = {k[0]: v[0] for k, v in self.teams.iterator()} if held else {}
        held = self.first_teams(held, known)
        ready = sorted((x for x in held if x[-1] <= mark), key=lambda x: (x[0], x[1], x[6] or ""))
        left = [x for x in held if x[-1] > mark]
        if timer is not None:
            self.handle.deleteTimer(timer)
        confirmed, out = self.run(key, ready, confirmed, known)
        if not left and mark >= last + IDLE_MS:  # the match is over
            for state in (self.waiting, self.touches, self.teams, self.crops, self.clock):
                state.clear()
        else:
            self.waiting.put(left) if left else self.waiting.clear()
            timer = max(mark + 1, (min(x[-1] for x in left) if left else last + IDLE_MS) + 1)
            self.clock.update((confirmed, last, timer))
            self.handle.registerTimer(timer)
        yield from out

    @staticmethod
    def first_teams(held: list[tuple], known: dict[int, int]) -> list[tuple]:
        """held with one team a track at most, that of the first frame, and none of a track whose team is known."""
        first, rest = {}, []
        for x in held:
            if x[1] != TEAM:
                rest.append(x)
            elif x[2] not in known and (x[2] not in first or x[0] < first[x[2]][0]):
                first[x[2]] = x
        return [*first.values(), *rest]

    def run(self, key: Any, ready: list[tuple], confirmed: int, teams: dict[int, int]) -> tuple[int, list[pd.DataFrame]]:
        """The ready rows, gone through in order, with the states read before and written after."""
        if not ready:
            return confirmed, []
        touches = [tuple(t) for t in self.touches.get()]
        crops: dict[int, list[tuple]] = {}

        def team(track: int) -> int:
            return teams.get(track) or 0

        def best(track: int) -> list[tuple]:
            if track not in crops:
                crops[track] = list(zip(*(self.crops.getValue((track,)) or ([], [], [])), strict=True))
            return crops[track]

        changed, found = set(), []
        for frame, kind, track, team_id, score, quality, event, _ in ready:
            if kind == TEAM:
                if not team(track):
                    teams[track] = team_id
                    self.teams.updateValue((track,), (team_id,))
            elif kind == CROP:
                crops[track] = sorted([*best(track), (score, frame, quality)], reverse=True)[:CROPS_KEPT]
                changed.add(track)
            elif kind == TOUCH:
                touches = [*(t for t in touches if t[0] >= frame - self.lookback), (frame, track)]
            elif frame - confirmed >= self.cooldown:
                confirmed = frame
                if event == "goal":
                    found.append((key[0], frame, *self.attribute(frame, touches, team, best)))
        self.touches.put(touches) if touches else self.touches.clear()
        for track in changed:
            scores, frames, qualities = zip(*crops[track], strict=True)
            self.crops.updateValue((track,), (list(scores), list(frames), list(qualities)))
        if not found:
            return confirmed, []
        names = [c.split()[0] for c in OUT.split(", ")]
        return confirmed, [pd.DataFrame(found, columns=names).astype({"track_id": "Int64", "last_touch_frame": "Int64", "team_id": "Int32"})]

    def attribute(self, frame: int, touches: list[tuple], team: Any, best: Any) -> tuple:
        near = [t for t in touches if t[0] >= frame - self.lookback]
        if not near:
            return None, None, None, None, [], []
        at, track = near[-1]
        few = near[-self.recent :]
        share = round(sum(t[1] == track for t in few) / len(few), 3)
        read = best(track)[:CROPS_READ]
        return track, at, share, team(track), [c[1] for c in read], [c[2] for c in read]

    def close(self) -> None:
        pass


def attributed_goals(rows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The confirmed goals of a stream of ``loop_rows`` with ts: scorer, last touch, share, team as of the goal, best crops."""
    keyed = rows.withWatermark("ts", delay).groupBy("match_id")
    return keyed.transformWithStateInPandas(MatchLoop(), OUT, "Append", "EventTime")
