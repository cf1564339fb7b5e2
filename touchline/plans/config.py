"""Settings of a run: limits of the operators, and two teams that the rules of ``functions.checks`` accept."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from touchline.functions import checks, colour

#: What an operator works with where a run says nothing else; all are above zero.
LIMITS = {"fps": 24.0, "lookback": 180, "cooldown": 60, "reach": 70.0, "crop_stride": 3, "crops_kept": 16, "crops_read": 8, "least_reading": 0.5}


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes; names and kit colours (b, g, r) by team number; limits by name."""

    source: str
    target: str
    names: Mapping[int, str]
    kits: Mapping[int, tuple[float, float, float]]
    limits: Mapping[str, float] = field(default_factory=lambda: dict(LIMITS))

    @classmethod
    def of(cls, spark: SparkSession, source: str, target: str, teams: list[tuple[str, str]], **limits: float) -> Run:
        """teams: name and colour, as #RRGGBB, of both. The rules are those of the tables, applied to one row."""
        wrong = {k: v for k, v in limits.items() if k not in LIMITS or v <= 0}
        if not (source and target and len(teams) == 2) or wrong:
            raise ValueError(f"source, target, two teams and positive limits are needed {wrong or ''}".strip())
        row = {}
        for k, (name, kit) in enumerate(teams, 1):
            channels = colour.hex_to_rgb(F.trim(F.lit(kit)))
            row[f"reason_{k}"] = checks.team_setting(F.lit(k), F.lit(name), channels)
            row |= {f"{c}_{k}": v for c, v in zip("rgb", channels, strict=True)}
        row["reason"] = checks.team_names(*[F.lit(name) for name, _ in teams])
        got = spark.range(1).select(*[v.alias(k) for k, v in row.items()]).first()
        if reason := got["reason_1"] or got["reason_2"] or got["reason"]:
            raise ValueError(reason)
        kits = {k: tuple(float(got[f"{c}_{k}"]) for c in "bgr") for k in (1, 2)}
        return cls(source, target, {k: name.strip() for k, (name, _) in enumerate(teams, 1)}, kits, LIMITS | limits)
