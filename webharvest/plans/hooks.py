"""Extension points: hooks around stages, and the choice of a detail mode."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the stages at which hooks run.
STAGES = (
    "init", "process", "prepare", "precrawl", "crawl", "postcrawl", "preparse", "parse", "postparse", "result", "next", "continue",
    "repetition", "error", "finish"
)

Hook = Callable[[DataFrame], DataFrame]


class Hooks:
    """DataFrame functions by stage; higher priorities first, equal ones in the order of registration."""

    def __init__(self):
        self._by_stage: dict[str, list[tuple[int, int, Hook]]] = {}

    def register(self, stage: str, hook: Hook, priority: int = 0) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        rows = self._by_stage.setdefault(stage, [])
        rows.append((-priority, len(rows), hook))

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        for _, _, hook in sorted(self._by_stage.get(stage, []), key=lambda r: r[:2]):
            df = df.transform(hook)
        return df


def detail_mode(url: Column, choices: Iterable[Callable[[Column], Column]], default: str = "item") -> Column:
    """The first mode that a function gives for a URL."""
    return F.coalesce(*[f(url) for f in choices], F.lit(default))
