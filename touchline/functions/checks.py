"""Checks of what users send: each gives the first reason for a refusal, or null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The text of the first test that holds; an unknown test holds."""
    known = lambda test: F.coalesce(test, F.lit(True))
    rest = [F.when(known(test), F.lit(text)) for test, text in tests]
    return F.coalesce(*rest) if len(rest) > 1 else rest[0]


def team_setting(team_id: Column, name: Column, rgb: Sequence[Column]) -> Column:
    """A team's id is 1 or 2, its name is not blank, its three channels are 0 to 255."""
    channels = reduce(lambda a, b: a | b, [~x.between(0, 255) for x in rgb])
    return first_reason((~team_id.isin(1, 2), "no such team"), (F.length(F.trim(name)) == 0, "nameless team"), (channels, "no such colour"))


def registration(username: Column, email: Column, password: Column) -> Column:
    """User names have 2 to 100 characters, passwords 6 to 128, emails one @ with something like a domain after it."""
    size = lambda x, low, high: ~F.length(x).between(low, high)
    bad_email = ~email.rlike(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$")
    return first_reason((size(username, 2, 100), "username"), (bad_email, "email"), (size(password, 6, 128), "password"))


def team_names(one: Column, two: Column) -> Column:
    """Names of 1 to 100 characters, not the same but for case and white space around them."""
    size = lambda x: ~F.length(x).between(1, 100)
    return first_reason((size(one), "team_1_name"), (size(two), "team_2_name"), (F.lower(F.trim(one)) == F.lower(F.trim(two)), "same name"))


def upload(file_name: Column, size: Column, accepted: Column, most: int = 2 << 30) -> Column:
    """Status of an upload: 415 for another kind of file, 413 for one over ``most`` bytes, else 202."""
    return F.when(~F.coalesce(accepted, F.lit(False)), 415).when(size > most, 413).otherwise(202)
