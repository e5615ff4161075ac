"""Stages of a chain over one narrow table (2.M): what each measures, the status it gives, what it drops.

A stage names the one it follows, what it needs to know of a row (measures, joined by key), and an ordered list of cases
(status, condition, drops). The first case that is true gives the status; a condition that is null is not true, so
missing evidence never drops a row (R4). Rows that an earlier stage dropped do not enter: their flags are null.

Measures do not depend on what other stages drop, so all of them are taken from the rows of the chain at once and joined to one
narrow table by its key, each once; what enters, stays and goes is then an expression. A chain of any length is a plan
of that many joins on one key, computed when flags, ledger or kept rows are asked for. Catalogue matches of equal radius
share one radius join over the union of their catalogues.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skyjoin import tagged_matches


@dataclass(frozen=True)
class Match:
    """Nearest row of a catalogue (id, ra, dec) within radius: <stage>_match_id, <stage>_sep, <stage>_count."""

    catalogue: DataFrame
    radius: float


@dataclass(frozen=True)
class Case:
    status: str
    condition: str
    drops: bool = False


@dataclass(frozen=True)
class Stage:
    """`shows` names columns that go to the flags; `measures` are functions of the rows that give tables by key."""

    name: str
    cases: list[Case]
    otherwise: Case
    after: str | None = None
    match: Match | None = None
    measures: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    shows: list[str] = field(default_factory=list)


class Chain:
    """Stages in the order in which they are given; a stage without `after` takes all rows."""

    def __init__(self, rows: DataFrame, key: str, stages: list[Stage]):
        known: set[str] = set()
        for s in stages:
            if s.name in known or (s.after is not None and s.after not in known):
                raise ValueError(f"stage {s.name} is repeated or follows none that is known")
            known.add(s.name)
        self.rows, self.key, self.stages = rows, key, stages

    def measured(self) -> DataFrame:
        table = self.rows
        radii: dict[float, dict[str, DataFrame]] = {}
        for s in self.stages:
            if s.match:
                radii.setdefault(s.match.radius, {})[s.name] = s.match.catalogue
        for radius, catalogues in radii.items():
            table = table.join(tagged_matches(self.rows, self.key, catalogues, radius), self.key, "left")
        for s in self.stages:
            for measure in s.measures:
                table = table.join(measure(self.rows), self.key, "left")
        return table

    def judged(self) -> DataFrame:
        """All rows and measures with <stage>_status and <stage>_keep, null where a row did not enter."""
        table = self.measured()
        for s in self.stages:
            enters = F.coalesce(F.col(f"{s.after}_keep"), F.lit(False)) if s.after else F.lit(True)
            status, drops = F.lit(s.otherwise.status), F.lit(s.otherwise.drops)
            for c in reversed(s.cases):
                met = F.coalesce(F.expr(c.condition), F.lit(False))
                status, drops = F.when(met, c.status).otherwise(status), F.when(met, c.drops).otherwise(drops)
            table = table.withColumns({f"{s.name}_status": F.when(enters, status), f"{s.name}_keep": F.when(enters, ~drops)})
        return table

    def flags(self) -> DataFrame:
        """A row for each row of the input: key, and of each stage its status, whether it keeps the row, and what it shows."""
        shown = [c for s in self.stages for c in (f"{s.name}_status", f"{s.name}_keep", *s.shows)]
        return self.judged().select(self.key, *shown)

    def kept(self, stage: str) -> DataFrame:
        """The input's rows that are left after a stage, joined back once."""
        return self.rows.join(self.judged().where(f"{stage}_keep").select(self.key), self.key, "left_semi")

    def ledger(self) -> DataFrame:
        """step, stage, follows, status, rows, input_rows, dropped_rows, kept_rows: one aggregate over the flags."""
        counts = []
        for k, s in enumerate(self.stages):
            here = F.col(f"{s.name}_status")
            total = [F.count(here), F.count(F.when(~F.col(f"{s.name}_keep"), 1)), F.count(F.when(F.col(f"{s.name}_keep"), 1))]
            for case in dict.fromkeys([c.status for c in [*s.cases, s.otherwise]]):
                counts.append(F.struct(F.lit(k).alias("step"), F.lit(s.name).alias("stage"), F.lit(s.after).cast("string").alias("follows"), F.lit(case).alias("status"), F.count(F.when(here == case, 1)).alias("rows"), *(t.alias(n) for t, n in zip(total, ("input_rows", "dropped_rows", "kept_rows"), strict=True))))
        return self.judged().agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
