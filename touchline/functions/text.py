"""Texts read from shirts, and texts shown to people, as column expressions."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a broadcast shows and that are no names, and video file endings.
IGNORED_NAMES = ["GOAL", "TEAM", "PLAYER", "SCORE", "SPORT", "LIVE", "MATCH", "HOME", "AWAY"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".avi", ".mkv"]


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def numbers(text: Column) -> Column:
    """Runs of one or two digits that stand alone, as ints."""
    return F.transform(F.regexp_extract_all(normal(text), F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1)), lambda x: x.cast("int"))


def name(text: Column) -> Column:
    """A player's name, or null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(normal(text), r"[^A-Z '\-]", " "), r"\s+", " "))
    ignored = F.array(*[F.lit(w) for w in IGNORED_NAMES])
    fits = bare.rlike(r"^[A-Z][A-Z '\-]{2,23}$") & ~F.forall(F.split(bare, " "), lambda w: F.array_contains(ignored, w))
    return F.when(fits, bare)


def has_digit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{Nd}"), F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def shown(value: Column, placeholder: str = "—") -> Column:
    """value as a text, or what is shown where it is missing or blank."""
    as_text = value.cast("string")
    return F.when(F.coalesce(F.length(F.trim(as_text)) > 0, F.lit(False)), as_text).otherwise(placeholder)


def _readings(payload: str | None) -> list[tuple[str, float]]:
    """Texts with their scores, in the order of the payload: its tree is gone down to any depth, without recursion."""
    try:
        waiting, found = [json.loads(payload or "null")], []
    except (ValueError, RecursionError):
        return []
    scored = lambda x: isinstance(x, list) and len(x) == 2 and isinstance(x[0], str)
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            node = node.get("res", node)
        if isinstance(node, dict):
            texts, scores = (node.get(f"rec_{k}") or node.get(k) for k in ("texts", "scores"))
            if texts is None or scores is None:
                waiting += reversed(node.values())
            elif isinstance(texts, list) and isinstance(scores, list):
                found += zip(texts, scores)  # what has no partner is left out
        elif scored(node) and isinstance(node[1], (int, float)):
            found.append(node)
        elif isinstance(node, list) and len(node) > 1 and scored(node[1]):
            found.append(node[1])
        elif isinstance(node, list):
            waiting += reversed(node)
    out = []
    for text, score in found:
        try:
            sure = float(score)
        except (TypeError, ValueError):
            continue
        if text is not None and not math.isnan(sure):
            out.append((text if isinstance(text, str) else json.dumps(text), max(0.0, min(1.0, sure))))
    return out


def payload_readings(payload: Column) -> Column:
    """array<struct<text, score>> of what a reader returned as JSON, whichever shape it has, scores cut to 0..1.

    Shapes: an object with rec_texts and rec_scores, or texts and scores, as they are or under res, whose texts belong to the
    scores at the same place; a pair [text, score]; a list whose second entry is such a pair, as [box, [text, score]], of which nothing
    else counts; and lists
    and objects of these under any key and to any depth, mixed or not. An empty list counts as absent. A text or score without
    partner, a null text and a score that is no number are left out; null and what is no JSON hold nothing.
    """

    @F.pandas_udf("array<struct<text:string,score:double>>")
    def readings(payloads: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "score": s} for t, s in _readings(p)] for p in payloads], dtype=object)

    return readings(payload)


def clock(frame: Column, fps: float) -> Column:
    """mm:ss of a frame, cut to whole seconds."""
    seconds = F.floor(frame / F.greatest(F.lit(fps), F.lit(1.0))).cast("long")
    return F.concat(_two(F.floor(seconds / 60)), F.lit(":"), _two(seconds % 60))


def _two(n: Column) -> Column:
    text = n.cast("long").cast("string")
    return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)


def clock_rounded(seconds: Column) -> Column:
    """m:ss, rounded to whole seconds, never below zero."""
    s = F.greatest(F.floor(seconds + 0.5), F.lit(0)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), _two(s % 60))


def goal_text(team: Column, number: Column, player: Column) -> Column:
    dash = " — "
    head = F.concat(F.lit("GOAL" + dash), team, F.lit(dash))
    named = F.coalesce(F.length(F.trim(player)) > 0, F.lit(False))
    return (
        F.when(number.isNull(), F.concat(head, F.lit("scorer number unavailable")))
        .when(named, F.concat(head, F.lit("#"), number.cast("string"), F.lit(" "), player, F.lit(" scored")))
        .otherwise(F.concat(head, F.lit("#"), number.cast("string"), F.lit(" scored")))
    )


def suffix(file_name: Column) -> Column:
    """The ending of a file name in lower case; that of a nameless upload is .mp4."""
    named = F.when(F.coalesce(F.length(file_name), F.lit(0)) == 0, F.lit("match.mp4")).otherwise(file_name)
    return F.lower(F.regexp_extract(named, r"(\.[^./]+)$", 1))


def is_video(file_name: Column) -> Column:
    return suffix(file_name).isin(VIDEO_SUFFIXES)


def join_url(prefix: Column, file_name: Column) -> Column:
    return F.when(F.length(prefix) > 0, F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), file_name)).otherwise(file_name)
