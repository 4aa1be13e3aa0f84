"""Plan-time and run-time contract checks.

``enforce`` looks at once, in a pass of its own. With a ``Watch`` the checks ride on the frame instead: they are
counted while the caller writes the table, and ``settle`` raises after that one write.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.errors import ContractError, DataViolation

QUOTED = 5
#: Seconds to wait for figures of a part of the plan that did not run, as its input was empty.
PATIENCE = 2.0


@dataclass(frozen=True)
class Check:
    """``failing`` is true on rows that break the rule, ``shown`` is what the message quotes.

    A check with a ``contract`` is about the specification: it raises ``ContractError`` with that text.
    """

    name: str
    failing: Column
    shown: Column
    contract: str | None = None


def _figures(observation: Observation, seconds: float | None) -> Mapping[str, object]:
    """The figures of an observation, or none where its part of the plan was left out (an empty input)."""
    found: list[Mapping[str, object]] = []
    reader = threading.Thread(target=lambda: found.append(observation.get), daemon=True)
    reader.start()
    reader.join(seconds)
    return found[0] if found else {}


class Watch:
    """Checks and row counts that ride on the next write of a table, and what they found.

    ``on`` attaches checks to a frame on its way to the write, ``written`` marks the frame that is written, and
    ``settle`` reads everything after the write. All of it costs no job and no pass of its own: counts and up to five
    quoted values per check are partial aggregates of the tasks that make the rows.
    """

    def __init__(self) -> None:
        self._open: list[tuple[Observation, list[Check], list[str]]] = []
        self._last: Observation | None = None
        self.counts: dict[str, int] = {}

    def on(self, df: DataFrame, checks: Iterable[Check] = (), counts: Mapping[str, Column | None] | None = None) -> DataFrame:
        """``df`` with ``checks``, and with the number of rows under each of ``counts`` (all rows for None)."""
        checks, counts = list(checks), dict(counts or {})
        if not checks and not counts:
            return df
        figures = []
        for i, c in enumerate(checks):
            failing, shown = F.coalesce(c.failing, F.lit(False)), c.shown.cast("string")
            figures.append(F.count_if(failing).alias(f"n{i}"))
            # five values at most: the least one of each fifth of all hashes
            figures += [F.min(F.when(failing & (F.pmod(F.xxhash64(shown), F.lit(QUOTED)) == k), shown)).alias(f"e{i}_{k}") for k in range(QUOTED)]
        figures += [(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(f"c{i}") for i, c in enumerate(counts.values())]
        observation = Observation()
        self._open.append((observation, checks, list(counts)))
        return df.observe(observation, *figures)

    def written(self, df: DataFrame) -> DataFrame:
        """The frame as it is written; by its figures ``settle`` knows that the write is over."""
        self._last = Observation()
        return df.observe(self._last, F.count(F.lit(1)).alias("n"))

    def include(self, other: Watch) -> None:
        """Take over what rides on a frame that became a part of this one."""
        self._open += other._open
        other._open = []

    def settle(self) -> None:
        """After the write: raise if a check failed, else keep the counts."""
        if self._last is None:
            raise RuntimeError("settle follows the write of the frame that written() gave")
        _figures(self._last, None)
        failed: dict[str, int] = {}
        examples: dict[str, list[str]] = {}
        contracts: list[str] = []
        for observation, checks, names in self._open:
            found = _figures(observation, PATIENCE)
            for i, c in enumerate(checks):
                if n := found.get(f"n{i}", 0):
                    quoted = sorted(str(v) for k in range(QUOTED) if (v := found.get(f"e{i}_{k}")) is not None)
                    if c.contract:
                        contracts.append(f"{c.contract}: {'; '.join(quoted)}")
                    failed[c.name] = failed.get(c.name, 0) + int(n)
                    examples[c.name] = [*examples.get(c.name, []), *quoted][:QUOTED]
            for i, name in enumerate(names):
                self.counts[name] = int(found.get(f"c{i}", 0))
        self._open, self._last = [], None
        if contracts:
            raise ContractError(" | ".join(contracts))
        if failed:
            raise DataViolation(failed, examples)


def require_columns(df: DataFrame, names: Iterable[str], where: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"{where}: missing columns {', '.join(missing)}")


def violation_counts(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row: the number of failing rows per check."""
    return df.agg(*[F.count_if(c.failing).alias(c.name) for c in checks])


def enforce(df: DataFrame, checks: list[Check], watch: Watch | None = None, quoted: int = QUOTED) -> DataFrame:
    """Return ``df`` when no row fails, else raise with counts and a few of the offending values; with a ``watch``, later."""
    if not checks:
        return df
    if watch is not None:
        return watch.on(df, checks)
    counts = violation_counts(df, checks).first().asDict()
    failed = {name: n for name, n in counts.items() if n}
    if failed:
        examples = {
            c.name: [r[0] for r in df.filter(c.failing).select(c.shown.cast("string")).distinct().limit(quoted).collect()]
            for c in checks
            if c.name in failed
        }
        raise DataViolation(failed, examples)
    return df
