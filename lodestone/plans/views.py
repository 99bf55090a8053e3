"""Planning views over tasks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import field, le, literal
from ..operators.tasks import expand_in_window, latest_on_or_before


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that aren't done; taken before recurring ones are expanded, since occurrences are made of open tasks only, and are open."""
    return tasks.where(~F.col("done"))


def on_day(tasks: DataFrame, day: str) -> DataFrame:
    """Open tasks scheduled or due on a day, later occurrences included."""
    return expand_in_window(open_tasks(tasks), day, day).where((F.col("scheduled") == day) | (F.col("due") == day))


def in_week(tasks: DataFrame, start: str) -> DataFrame:
    """Open tasks scheduled or due in the seven days from start."""
    end = (date.fromisoformat(start) + timedelta(days=6)).isoformat()
    return expand_in_window(open_tasks(tasks), start, end).where(F.col("scheduled").between(start, end) | F.col("due").between(start, end))


def due_by(tasks: DataFrame, day: str) -> DataFrame:
    """Open tasks due up to a day, recurring ones by their latest occurrence; by the comparison order, no due date isn't due."""
    d = latest_on_or_before(open_tasks(tasks), day)
    return d.where(le(field(d, "due"), literal(day)))


overdue = due_by


def repeating(tasks: DataFrame) -> DataFrame:
    return open_tasks(tasks).where(F.coalesce(F.col("repeat") != "", F.lit(False)))


@dataclass(frozen=True)
class TaskQuery:
    """A query over tasks that knows its dates: later occurrences are made for the window that its first dated condition asks for.

    on(day) asks for tasks scheduled or due on a day, within(start, end) for those in a span, and by(day) for those due up to a day.  Other
    conditions are columns over the expanded rows.
    """

    tasks: DataFrame
    conditions: tuple[Column, ...] = ()
    window: tuple[str, str, str] | None = None

    def _dated(self, condition: Column, *window: str) -> TaskQuery:
        return replace(self, conditions=(*self.conditions, condition), window=self.window or window)

    def on(self, day: str) -> TaskQuery:
        return self._dated((F.col("scheduled") == day) | (F.col("due") == day), "all", day, day)

    def within(self, start: str, end: str) -> TaskQuery:
        return self._dated(F.col("scheduled").between(start, end) | F.col("due").between(start, end), "all", start, end)

    def by(self, day: str) -> TaskQuery:
        return self._dated(F.coalesce(F.col("due") <= day, F.lit(False)), "latest", day, day)

    def where(self, condition: Column) -> TaskQuery:
        return replace(self, conditions=(*self.conditions, condition))

    def records(self) -> DataFrame:
        d = self.tasks
        if self.window:
            kind, start, end = self.window
            d = latest_on_or_before(d, end) if kind == "latest" else expand_in_window(d, start, end).drop("occurrence")
        for c in self.conditions:
            d = d.where(c)
        return d
