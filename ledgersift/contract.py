"""The one shape of results: small, masked, and tied to a dataset version."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from .codes import Code, FindingClass, Refusal

METHOD_BUDGET = 2000
SUITE_BUDGET = 6000
TOP = 5
STATES = ("completed", "declined", "refused", "error")
_SUBJECT = re.compile(r"[a-p]{12}|group-\d+|rank-\d+|row-\d+|digit-[1-9]|column-\d+")
_TOKEN = re.compile(r"[a-z][a-z0-9_]{0,30}")


@dataclass(frozen=True)
class Signal:
    subject: str
    metrics: dict = field(default_factory=dict)
    strength: float = 0.0


@dataclass(frozen=True)
class MethodResult:
    status: str
    method: str
    verdict: str | None = None
    why: tuple[str, ...] = ()
    scanned: int | None = None
    finding_class: FindingClass | None = None
    summary: str = ""
    top: tuple[Signal, ...] = ()
    total: int = 0
    dataset: str | None = None
    run: str | None = None
    finding_ids: tuple[str, ...] = ()
    evidence: dict = field(default_factory=dict)
    limits: str | None = None
    code: str | None = None
    values: str | None = None

    def as_dict(self) -> dict:
        out = {
            "status": self.status,
            "method": self.method,
            "code": self.code,
            "verdict": self.verdict,
            "why": list(self.why),
            "scanned": self.scanned,
            "class": self.finding_class and str(self.finding_class),
            "summary": self.summary,
            "top": [{"subject": s.subject, "strength": round(s.strength, 4), **s.metrics} for s in self.top],
            "total": self.total or None,
            "values": self.values,
            "dataset": self.dataset,
            "run": self.run,
            "finding_ids": list(self.finding_ids),
            "evidence": self.evidence,
            "limits": self.limits,
        }
        return {k: v for k, v in out.items() if v not in (None, [], {}, "")}


def _unpresentable(why: str) -> Refusal:
    return Refusal(Code.RESULT_NOT_PRESENTABLE, why)


def build(result: MethodResult, revealed: frozenset[str] = frozenset()) -> MethodResult:
    """Checked, with at most five signals, the weakest trimmed to the budget. No raw value passes."""
    if result.status not in STATES:
        raise _unpresentable(f"unknown status {result.status!r}")
    if result.status == "completed" and not result.dataset:
        raise _unpresentable("a completed result names no dataset version")
    if result.finding_class is not None and not isinstance(result.finding_class, FindingClass):
        raise _unpresentable("only OBSERVATION and ANOMALY can be emitted")
    for s in result.top:
        if not _SUBJECT.fullmatch(s.subject) and s.subject not in revealed:
            raise _unpresentable("a signal's subject is a raw value")
        if not 0 <= s.strength <= 1:
            raise _unpresentable("a strength lies outside 0..1")
        for k, v in s.metrics.items():
            if not _TOKEN.fullmatch(k) or not (isinstance(v, (bool, int, float)) or isinstance(v, str) and _TOKEN.fullmatch(v)):
                raise _unpresentable(f"metric {k!r} is not a number, boolean or short token")
    top = tuple(sorted(result.top, key=lambda s: -s.strength)[:TOP])
    out = replace(result, top=top, total=max(result.total, len(result.top)))
    while len(present(out)) > METHOD_BUDGET and out.top:
        out = replace(out, top=out.top[:-1])
    if len(present(out)) > METHOD_BUDGET:
        raise _unpresentable("the result does not fit its budget")
    return out


def present(result: MethodResult) -> str:
    """One compact line."""
    return json.dumps(result.as_dict(), ensure_ascii=False, separators=(",", ":"))
