"""Ordered rule lists by incremental reduced-error pruning, and their export to SQL CASE.

A rule is a conjunction of conditions ``feature <= x`` or ``feature > x`` for the wanted class. A
rule is grown on one part of the examples by information gain, pruned on the other part, and kept
while it is right more often than wrong there; covered examples are taken away and the next rule
is grown. Rows that no rule covers belong to the other class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    over: bool
    value: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.value if self.over else x <= self.value

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.over else '<='} {self.value!r}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, columns: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(columns.values()))), bool)
    for c in rule:
        out &= c.holds(columns)
    return out


def predict(rules: list[Rule], columns: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), bool)
    for r in rules:
        out |= covers(r, columns)
    return out


def _part(columns, mask):
    return {k: v[mask] for k, v in columns.items()}


def _grow(columns: dict[str, np.ndarray], label: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(label), bool)
    while len(rule) < most:
        p0, n0 = int((label & inside).sum()), int((~label & inside).sum())
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, x in columns.items():
            v, y = x[inside], label[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            at = np.flatnonzero(v[1:] != v[:-1])
            if not len(at):
                continue
            p_le, n_le = np.cumsum(y)[at], np.cumsum(~y)[at]
            for over, p, n in ((False, p_le, n_le), (True, p0 - p_le, n0 - n_le)):
                g = p * (np.log2((p + 1) / (p + n + 1)) - np.log2((p0 + 1) / (p0 + n0 + 1)))
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, over, round(float(v[at[k]] + v[at[k] + 1]) / 2, 4)), float(g[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(columns)
    return rule


def _prune(rule: Rule, columns: dict[str, np.ndarray], label: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule with the best (right - wrong) / covered, and its share of right."""
    best, score, right = rule[:1], -2.0, 0.0
    for k in range(1, len(rule) + 1):
        c = covers(rule[:k], columns)
        p, n = int((c & label).sum()), int((c & ~label).sum())
        if (s := (p - n) / max(p + n, 1)) > score:
            best, score, right = rule[:k], s, p / max(p + n, 1)
    return best, right


def induce(columns: dict[str, np.ndarray], label: np.ndarray, seed: int = 5, most_rules: int = 30, most_conditions: int = 7, tries: int = 6, least: float = 0.8) -> list[Rule]:
    """The ordered rule list for ``label``; a third of the examples left prunes each rule.

    It ends after ``tries`` rules in a row that are right for less than the share ``least``.
    """
    rng = np.random.default_rng(seed)
    left, rules, failed = np.ones(len(label), bool), [], 0
    while len(rules) < most_rules and failed < tries and (label & left).any():
        grow = left & (rng.random(len(label)) < 2 / 3)
        check = left & ~grow
        if not (label & grow).any() or not check.any():
            break
        rule = _grow(_part(columns, grow), label[grow], most_conditions)
        if not rule:
            break
        rule, right = _prune(rule, _part(columns, check), label[check])
        if right <= least:
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left &= ~covers(rule, columns)
    return rules


def to_case(rules: list[Rule], then: str = "true", other: str = "false") -> str:
    """SQL for the class of a row: the rules in order, then the other class."""
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {then}" for r in rules)
    return f"CASE {whens} ELSE {other} END" if rules else other


def from_case(case: str) -> list[Rule]:
    """The rules of a CASE expression that ``to_case`` made."""
    term = re.compile(r"(\w+) (<=|>) (\S+)")
    return [tuple(Condition(f, op == ">", float(x)) for f, op, x in term.findall(when)) for when in re.findall(r"WHEN (.*?) THEN", case, re.S)]


def to_column(rules: list[Rule], of) -> Column:
    """Whether a rule holds, as a native expression over the features that ``of`` gives by name."""
    any_ = F.lit(False)
    for r in rules:
        all_ = F.lit(True)
        for c in r:
            all_ = all_ & (of(c.feature) > c.value if c.over else of(c.feature) <= c.value)
        any_ = any_ | all_
    return any_
