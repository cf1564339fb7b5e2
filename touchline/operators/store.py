"""Reads and writes of the match store as joins. Upserts return the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as tx
from touchline.sources.tables import staged


#: Hexadecimal digits of the hash that deals rows out to chunks: 4096 chunks, whatever the table.
CHUNK_DIGITS = 3


def new_ids(rows: DataFrame, last: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number rows from max(key)+1, by chunk (a hash of ``order``) and then by ``order`` within it.

    Two steps, so that no task holds all rows: the first numbers of the chunks, whose number is fixed, and the places within.
    """
    start = last.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    rows = rows.withColumn("__c", F.substring(F.md5(F.concat_ws("/", *order)), 1, CHUNK_DIGITS))
    counts = rows.groupBy("__c").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    counts = counts.select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__c").orderBy(*order))
    return rows.join(counts, "__c").withColumn(key, F.lit(start) + F.col("__base") + within).drop("__base", "__c")


def upsert_teams(teams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Get or create teams by lower-case name; a non-empty colour overwrites, the last one where there are several.

    wanted: team_name, color, and order where there are several rows of a team; a new team is named as in its first row.
    """
    order = F.col("order") if "order" in wanted.columns else F.lit(0)
    told = F.when(F.length("color") > 0, F.struct(order.alias("o"), "color"))
    one = wanted.groupBy(F.lower("team_name").alias("__k")).agg(F.min(F.struct(order.alias("o"), "team_name"))["team_name"].alias("__name"), F.coalesce(F.max(told)["color"], F.lit("")).alias("__color"))
    named = teams.withColumn("__k", F.lower("team_name"))
    kept = named.join(one, "__k", "left").select("team_id", "team_name", F.coalesce(F.nullif("__color", F.lit("")), "color").alias("color"))
    fresh = new_ids(one.join(named, "__k", "left_anti"), teams, "team_id", ["__k"])
    return kept.unionByName(fresh.select("team_id", F.col("__name").alias("team_name"), F.col("__color").alias("color")))


def upsert_players(players: DataFrame, seen: DataFrame) -> DataFrame:
    """Get or create players by team and number; a name only fills an empty one. seen: team_id, jersey_no, name, event_id."""
    named = F.min(F.when(F.length("name") > 0, F.struct("event_id", "name")))  # the first event that has a name
    first = seen.groupBy("team_id", "jersey_no").agg(named["name"].alias("__name"))
    key = ["team_id", "jersey_no"]
    kept = players.join(first, key, "left").select("player_id", *key, F.coalesce(F.nullif("name", F.lit("")), "__name").alias("name"))
    fresh = new_ids(first.join(players, key, "left_anti"), players, "player_id", key)
    return kept.unionByName(fresh.select("player_id", *key, F.col("__name").alias("name")))


#: So few requests that are still undecided are gone through one after another, in one task.
UNDECIDED_ROWS = 20_000


def registrable(users: DataFrame, wanted: DataFrame, alone: int = UNDECIDED_ROWS) -> DataFrame:
    """The requests that get in if all are tried in order of request_id: user name and email are free, letter case aside,
    neither a user's nor those of a request that got in before.

    In rounds: a request that is the first of all undecided ones both for its name and for its email gets in; the others of
    that name or email are struck off. Each round decides at least the first request of every connected set, and
    is written before the next. Once ``alone`` or fewer are undecided, one task goes through them in order. Repeated
    rows of a request are one.
    """
    low = lambda d: d.withColumns({"__u": F.lower("username"), "__e": F.lower("email")})
    free = low(wanted).dropDuplicates(["request_id"])
    for key in ("__u", "__e"):
        free = free.join(low(users).select(key).distinct(), key, "left_anti")
    free = staged(free)
    left, accepted = staged(free.select("request_id", "__u", "__e")), []
    while (n := left.count()) > alone:
        first = [left.groupBy(k).agg(F.min("request_id").alias("request_id")).select("request_id") for k in ("__u", "__e")]
        won = staged(left.join(first[0], "request_id").join(first[1], "request_id"))
        accepted.append(won.select("request_id"))
        for key in ("__u", "__e"):
            left = left.join(won.select(key), key, "left_anti")
        left = staged(left)
    if n:
        accepted.append(left.coalesce(1).sortWithinPartitions("request_id").mapInPandas(_in_order, "request_id " + dict(left.dtypes)["request_id"]))
    ids = reduce(DataFrame.unionByName, accepted) if accepted else left.select("request_id")
    return free.join(ids, "request_id", "left_semi").select(*wanted.columns)


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows whose name and email no accepted row before them has."""
    names, emails = set(), set()
    for part in parts:
        got = []
        for request_id, name, email in zip(part["request_id"], part["__u"], part["__e"], strict=True):
            if name not in names and email not in emails:
                names.add(name)
                emails.add(email)
                got.append(request_id)
        yield pd.DataFrame({"request_id": got})


def register(users: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """New user rows (user_id, username, email) of the requests that are free, and their log rows.

    User names lose the white space around them; emails are in lower case as well. at: the time of the log rows.
    """
    clean = wanted.withColumns({"username": F.trim("username"), "email": F.lower(F.trim("email"))})
    fresh = new_ids(registrable(users, clean), users, "user_id", ["email"]).select("user_id", "username", "email")
    return fresh, log_rows(fresh, "register", at)


def log_rows(users: DataFrame, action: str, at: Column) -> DataFrame:
    """A log row for every row of users."""
    return users.select("user_id", F.lit(action).alias("action"), at.alias("timestamp"))


def login(users: DataFrame, attempts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """attempts (email, verified) with user_id and status 200 or 401, and log rows of those that came in.

    verified: what the check of the password said; it is made outside.
    """
    known = users.select("user_id", F.lower("email").alias("__e"))
    rows = attempts.withColumn("__e", F.lower(F.trim("email"))).join(known, "__e", "left").drop("__e")
    good = F.col("user_id").isNotNull() & F.coalesce("verified", F.lit(False))
    rows = rows.withColumn("status", F.when(good, 200).otherwise(401))
    return rows, log_rows(rows.where("status = 200"), "login", at)


def job_results(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """wanted (job_id) with code 404 for no such job, 409 for one that is not completed, 200 and its result otherwise."""
    rows = wanted.join(jobs.select("job_id", "status", "result"), "job_id", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 409).otherwise(200)
    return rows.select("job_id", code.alias("code"), F.when(code == 200, F.col("result")).alias("result"))


def job_status(jobs: DataFrame) -> DataFrame:
    """The six keys that a poll returns; absent ones are null."""
    keys = ["job_id", "status", "stage", "progress_percent", "team_candidates", "error"]
    return jobs.select(*[F.col(k) if k in jobs.columns else F.lit(None).cast("string").alias(k) for k in keys])


def stored_match(matches: DataFrame, plays: DataFrame, teams: DataFrame, players: DataFrame, detected: DataFrame, fps: float) -> dict[str, DataFrame]:
    """The rows that storing matches adds: matches, plays with scores, events, occurrences, and players as they are then.

    plays: play_id, match_id, team_id; detected: match_id, frame_num, event, with the scorer's track_id, team_name,
    jersey_number, player_name and confidences where known. Event ids follow from match and frame; an event has one
    occurrence, with play and player of the scorer's team, null where the match has no such team. A player of a team and
    number not seen before is made; a name fills an empty one.
    """
    named = plays.join(teams.select("team_id", "team_name"), "team_id", "left")
    event_id = F.col("match_id") * 1_000_000 + F.col("frame_num")
    rows = detected.withColumns({"event_id": event_id, "time_seconds": F.col("frame_num") / F.greatest(F.lit(float(fps)), F.lit(1.0))})
    rows = rows.join(named.select("match_id", "team_name", "play_id", "team_id"), ["match_id", "team_name"], "left")
    goal = tx.goal_text(F.coalesce("team_name", F.lit("unknown_team")), F.col("jersey_number"), F.col("player_name"))
    events = rows.select(
        "event_id", "match_id", F.col("event").alias("event_type"), F.initcap("event").alias("event_name"),
        event_description(F.col("event"), goal).alias("description"), "time_seconds",
    )
    seen = rows.where("jersey_number is not null and team_id is not null")
    seen = seen.select("team_id", F.col("jersey_number").alias("jersey_no"), F.col("player_name").alias("name"), "event_id")
    kept = upsert_players(players, seen)
    who = kept.select("player_id", "team_id", F.col("jersey_no").alias("jersey_number"))
    occurrences = rows.join(who, ["team_id", "jersey_number"], "left").select(
        F.col("event_id").alias("occurrence_id"), "event_id", "play_id", "player_id", F.col("time_seconds").alias("start_time"),
        F.col("time_seconds").alias("end_time"), F.col("track_id").alias("detected_track_id"), F.col("jersey_number").alias("detected_jersey_no"),
        F.col("player_name").alias("detected_player_name"), F.coalesce("team_name", F.lit("unknown_team")).alias("detected_team_name"),
        "jersey_confidence", "name_confidence",
    )
    goals = rows.where("event = 'goal' and play_id is not null").groupBy("play_id").agg(F.count("*").alias("score"))
    scored = plays.join(goals, "play_id", "left").na.fill(0, ["score"])
    return {"matches": matches, "plays": scored, "events": events, "occurrences": occurrences, "players": kept}


def match_objects(stored: dict[str, DataFrame], teams: DataFrame) -> DataFrame:
    """A row a match: the match and the lists of its teams, plays, events, occurrences and players, each in order of id."""
    plays, events, players = stored["plays"], stored["events"], stored["players"]
    occurrences = stored["occurrences"].join(events.select("event_id", "match_id"), "event_id")

    def listed(rows: DataFrame, kind: str, **fields: str) -> DataFrame:
        return rows.groupBy("match_id").agg(F.array_sort(F.collect_set(F.struct(*[F.col(v).alias(k) for k, v in fields.items()]))).alias(kind))

    team_of = plays.select("match_id", "team_id").join(teams, "team_id")
    players_of = occurrences.select("match_id", "player_id").where("player_id is not null").distinct().join(players, "player_id")
    told = events.join(last_occurrence(stored["occurrences"]), "event_id", "left")
    rows = stored["matches"].select("match_id", F.struct(F.col("match_id").alias("matchId"), F.col("match_date").alias("matchDate"), F.col("user_id").alias("userId")).alias("match"))
    for part in (
        listed(team_of, "teams", teamId="team_id", teamName="team_name"),
        listed(plays, "play", playId="play_id", teamId="team_id", matchId="match_id", score="score"),
        listed(told, "events", eventId="event_id", eventType="event_type", eventName="event_name", description="description", timeSec="time_seconds",
               teamName="detected_team_name", jerseyNumber="detected_jersey_no", playerName="detected_player_name"),
        listed(occurrences, "occurBy", occurId="occurrence_id", eventId="event_id", playId="play_id", playerId="player_id", startTime="start_time", endTime="end_time",
               detectedPlayerTrackId="detected_track_id", detectedJerseyNo="detected_jersey_no", detectedPlayerName="detected_player_name", teamName="detected_team_name"),
        listed(players_of, "players", playerId="player_id", name="name", jerseyNo="jersey_no", teamId="team_id"),
    ):
        rows = rows.join(part, "match_id", "left")
    return rows


def result_json(objects: DataFrame) -> DataFrame:
    """match_id and the result of its job as JSON: score sheet, players and events. objects: see ``match_objects``."""
    name = lambda team_id: F.get(F.filter("teams", lambda t: t["teamId"] == team_id), F.lit(0))["teamName"]
    sheet = F.transform("play", lambda p: F.struct(name(p["teamId"]).alias("team"), p["score"].alias("score")))
    return objects.select("match_id", F.to_json(F.struct(sheet.alias("score_sheet"), "players", "events")).alias("result"))


def with_job_ids(rows: DataFrame) -> DataFrame:
    """rows with a random job_id, another one each time the plan runs: write them before they are used twice."""
    return rows.withColumn("job_id", F.uuid())


def match_list(matches: DataFrame, user_id: int | None = None) -> DataFrame:
    """Matches, newest first, of one user or all."""
    rows = matches if user_id is None else matches.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("match_date"), "match_id").select(
        F.col("match_id").alias("matchId"), F.col("match_date").alias("matchDate"), F.col("user_id").alias("userId"), "status"
    )


def last_occurrence(occurrences: DataFrame) -> DataFrame:
    """One occurrence an event: the one with the greatest id."""
    top = Window.partitionBy("event_id").orderBy(F.desc("occurrence_id"))
    return occurrences.withColumn("__k", F.row_number().over(top)).where("__k = 1").drop("__k")


def event_entries(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Events with what their occurrence says; an event without one has nulls."""
    return events.join(last_occurrence(occurrences), "event_id", "left")


def match_summary(matches: DataFrame, plays: DataFrame, events: DataFrame, teams: DataFrame) -> DataFrame:
    """A row a match: its teams by slot, and how many events of each kind it has."""
    named = plays.join(teams, "team_id", "left").groupBy("match_id").agg(
        F.max(F.when(F.col("team_slot") == 1, F.col("team_name"))).alias("team_1"),
        F.max(F.when(F.col("team_slot") == 2, F.col("team_name"))).alias("team_2"),
    )
    kinds = events.groupBy("match_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event") == "goal").alias("goals"),
        F.count_if(F.col("event") == "foul").alias("fouls"), F.count_if(F.col("event") == "card").alias("cards"),
    )
    rows = matches.join(named, "match_id", "left").join(kinds, "match_id", "left")
    return rows.na.fill(0, ["n_events", "goals", "fouls", "cards"])


def event_description(event: Column, text: Column) -> Column:
    """Goals by their text, others as '<TYPE> detected'."""
    return F.when(event == "goal", text).otherwise(F.concat(F.upper(event), F.lit(" detected")))
