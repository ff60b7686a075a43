"""Adaptive freshness: how long a document may rest until its next check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Freshness:
    """Intervals in seconds; bias: by how many thousandths the top rank shortens the wait."""

    base_s: int = 21_600
    min_s: int = 900
    max_s: int = 2_592_000
    grow: tuple[int, int] = (3, 2)
    shrink: tuple[int, int] = (1, 4)
    bias: int = 500

    def next_interval(self, interval: Column, outcome: Column) -> Column:
        """Outcomes: 0 unchanged, 1 changed, 2 error, 3 gone."""
        held = lambda c: F.least(F.greatest(c, F.lit(self.min_s)), F.lit(self.max_s)).cast("long")
        scaled = lambda up, down: held(F.floor(interval * up / F.lit(down)))
        return (
            F.when(outcome == 0, scaled(*self.grow)).when(outcome == 1, scaled(*self.shrink))
            .when(outcome == 2, F.lit(self.min_s).cast("long")).otherwise(interval)
        )

    def next_check_ms(self, fetched_ms: Column, interval: Column, permille: Column) -> Column:
        bias, rank = F.lit(min(self.bias, 1000)), F.least(F.coalesce(permille, F.lit(0)), F.lit(1000))
        return fetched_ms + interval * (1000 - F.floor(bias * rank / 1000).cast("long"))


OUTCOMES = {"unchanged": 0, "changed": 1, "error": 2, "gone": 3}


def outcome_tag(name: Column) -> Column:
    """The number of an outcome's name; an unknown name is an error (2)."""
    out = F.lit(2)
    for k, n in OUTCOMES.items():
        out = F.when(F.lower(name) == k, n).otherwise(out)
    return out


def interval_after(outcomes: Column, how: Freshness = Freshness()) -> Column:
    """The interval after an array of structs with `outcome`, in the array's order, from the base on."""
    return F.aggregate(outcomes, F.lit(how.base_s).cast("long"), lambda held, x: how.next_interval(held, x["outcome"]))
