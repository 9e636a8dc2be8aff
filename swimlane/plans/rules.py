"""Declarative rules as column predicates.

A rule is (column, operator, value); a rule set is their conjunction, true when
empty.  Missing values (NULL or NaN) behave as they do in data frames: no
comparison holds for them, but ``!=`` and ``not_in`` do.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def _present(c: Column, kind: str | None) -> Column:
    """NaN as NULL where the column can hold one."""
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def _compare(op: Callable) -> Callable[[Column, Any], Column]:
    return lambda c, v: F.coalesce(op(c, F.lit(v)), F.lit(False))


def _in(c: Column, v: Iterable) -> Column:
    return F.coalesce(c.isin(list(v)), F.lit(False))


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {name: _compare(op) for name, op in (("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge), ("==", operator.eq))}
OPERATORS["!="] = lambda c, v: ~OPERATORS["=="](c, v)
OPERATORS["in"] = _in
OPERATORS["not_in"] = lambda c, v: ~_in(c, v)


def register(name: str, build: Callable[[Column, Any], Column]) -> None:
    """Add an operator, a function of (column, value) that gives a boolean column."""
    OPERATORS[name] = build


@dataclass(frozen=True)
class Rule:
    column: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"Unknown operator {self.op!r}; there are {', '.join(OPERATORS)}")

    def predicate(self, kinds: dict[str, str] | None = None) -> Column:
        """``kinds``: the columns' types, so that NaN can count as missing."""
        return OPERATORS[self.op](_present(F.col(self.column), (kinds or {}).get(self.column)), self.value)

    @property
    def label(self) -> str:
        return f"{self.column}{self.op}{self.value}"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()

    def predicate(self, kinds: dict[str, str] | None = None) -> Column:
        return reduce(operator.and_, (r.predicate(kinds) for r in self.rules), F.lit(True))

    @property
    def label(self) -> str:
        return "_".join(r.label for r in self.rules)


def parse(config: dict[str, dict[str, Any]] | None) -> RuleSet:
    """{column: {operator: value}} as a rule set."""
    return RuleSet(tuple(Rule(c, op, v) for c, ops in (config or {}).items() for op, v in ops.items()))


def apply(df: DataFrame, rules: RuleSet) -> DataFrame:
    return df.where(rules.predicate(dict(df.dtypes)))


def funnel(df: DataFrame, rules: RuleSet) -> DataFrame:
    """(step, rule, removed, fraction): rows that each rule removes of those the earlier ones left, and their share of all; one pass."""
    kinds, passed, sums = dict(df.dtypes), F.lit(True), []
    for n, r in enumerate(rules.rules):
        ok = r.predicate(kinds)
        sums.append(F.count_if(passed & ~ok).alias(f"r{n}"))
        passed = passed & ok
    if not sums:
        return df.sparkSession.createDataFrame([], "step int, rule string, removed long, fraction double")
    one = df.agg(F.count("*").alias("n"), *sums)
    steps = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(r.label).alias("rule"), F.col(f"r{n}").alias("removed")) for n, r in enumerate(rules.rules)))
    e = one.select("n", F.explode(steps).alias("s"))
    return e.select("s.step", "s.rule", "s.removed", F.coalesce(F.try_divide(F.col("s.removed").cast("double"), F.col("n")), F.lit(0.0)).alias("fraction"))
