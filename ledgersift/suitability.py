"""Whether data suit a method: pure rules over measured facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from .codes import SEVERITY, Verdict


@dataclass(frozen=True)
class Threshold:
    value: float
    basis: str
    validated: bool = False


@dataclass(frozen=True)
class Rule:
    """If ``fails`` holds of the facts it needs, the verdict is at least this; unless one of ``unless`` has failed."""

    code: str
    verdict: Verdict
    needs: tuple[str, ...]
    fails: Callable[[Mapping], bool]
    unless: tuple[str, ...] = ()
    threshold: Threshold | None = None


@dataclass(frozen=True)
class Assessment:
    verdict: Verdict
    reasons: tuple[str, ...] = ()
    unvalidated: tuple[str, ...] = field(default=())


class RuleSet:
    def __init__(self, rules: Iterable[Rule], inputs: Iterable[str] = ()) -> None:
        self.rules, self.inputs = tuple(rules), tuple(inputs)
        by = {r.code: r for r in self.rules}
        state: dict[str, int] = {}

        def visit(code: str) -> None:
            if state.get(code) == 1:
                raise ValueError(f"rules suppress one another in a cycle: {code}")
            if state.get(code) != 2 and code in by:
                state[code] = 1
                for x in by[code].unless:
                    visit(x)
                state[code] = 2

        for r in self.rules:
            visit(r.code)
        self._order = sorted(self.rules, key=lambda r: self._depth(r, by))

    def _depth(self, rule: Rule, by: Mapping[str, Rule]) -> int:
        return 1 + max((self._depth(by[c], by) for c in rule.unless if c in by), default=0)

    def facts_required(self) -> set[str]:
        """What the profiler has to measure, and nothing else."""
        return {f for r in self.rules for f in r.needs}

    def assess(self, facts: Mapping, inputs: Mapping[str, bool] | None = None) -> Assessment:
        """``inputs``: for each domain input that was given, whether a named person confirmed it."""
        failed: dict[str, Verdict] = {}
        relied = []
        for name in self.inputs:
            if name not in (inputs or {}):
                failed[f"MISSING_{name.upper()}"] = Verdict.INSUFFICIENT_DATA
            elif not inputs[name]:
                failed[f"UNCONFIRMED_{name.upper()}"] = Verdict.REQUIRES_CONFIRMATION
        for r in self._order:
            if any(facts.get(f) is None for f in r.needs):
                failed[f"UNMEASURED_{r.code}"] = Verdict.INSUFFICIENT_DATA
                continue
            if not any(u in failed for u in r.unless) and r.fails(facts):
                failed[r.code] = r.verdict
            if r.threshold is not None and not r.threshold.validated:
                relied.append(r.code)
        worst = max(failed.values(), key=SEVERITY.index, default=Verdict.SUPPORTED)
        reasons = sorted(failed, key=lambda c: (-SEVERITY.index(failed[c]), c))
        return Assessment(worst, tuple(reasons), tuple(sorted(relied)))
