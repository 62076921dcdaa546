"""The three levels of the category tree, and the long form that holds all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """A category level; ``extra`` key columns come before the category id."""

    name: str
    extra: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.name}_id"

    @property
    def label(self) -> str:
        return f"{self.name}_name"

    @property
    def keys(self) -> list[str]:
        return [*self.extra, self.id]


LEAF = Level("leaf")
MID = Level("mid")
TOP = Level("top")
LEVELS = (LEAF, MID, TOP)
ANY = Level("any", ("level",))
"""All levels in one frame: a ``level`` column, ``any_id`` and, if wanted, ``any_name``."""


def all_levels(df: DataFrame, levels=LEVELS, names: bool = False) -> DataFrame:
    """One row per level; rows without a category at a level are left out there."""
    rows = [
        F.struct(
            F.lit(lv.name).alias("level"),
            F.col(lv.id).cast("bigint").alias(ANY.id),
            *([F.col(lv.label).alias(ANY.label)] if names else []),
        )
        for lv in levels
    ]
    gone = {c for lv in LEVELS for c in (lv.id, lv.label)}
    kept = [c for c in df.columns if c not in gone]
    return df.select(*kept, F.inline(F.array(*rows))).where(F.col(ANY.id).isNotNull())
