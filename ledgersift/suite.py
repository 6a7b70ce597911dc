"""All methods that fit a table, in one call."""

from __future__ import annotations

import json

from . import registry, version
from .codes import Code, Refusal, Verdict
from .contract import SUITE_BUDGET
from .names import need_columns
from .operators import profile
from .roles import Role, sensitive, suggest
from .runner import run_test
from .session import pinned
from .sources import Case

TIMEOUT_SECONDS = 300


def plan(amount: list[str], identifier: str | None, entity_name: str | None, confirmed: bool) -> tuple[list[dict], list[dict]]:
    """(steps, skipped): steps name a method and its arguments."""
    steps, skipped = [], []
    for c in amount:
        steps.append({"method": "benford", "column": c})
    if not amount:
        skipped.append({"method": "benford", "reason": "no amount column"})
    if identifier:
        steps.append({"method": "duplicate-analysis", "identifier": identifier})
        if entity_name:
            steps.append({"method": "duplicate-analysis", "identifier": identifier, "value": entity_name})
            steps.append({"method": "fuzzy-entity-match", "identifier": identifier, "entity_name": entity_name})
        else:
            skipped.append({"method": "fuzzy-entity-match", "reason": "no entity-name column"})
    else:
        skipped += [{"method": m, "reason": "no identifier column"} for m in ("duplicate-analysis", "fuzzy-entity-match")]
    skipped.append({"method": "cross-dataset-match", "reason": "needs a second table"})
    if not confirmed:
        skipped, steps = skipped + [{**s, "reason": "pending: nobody confirmed the columns"} for s in steps], []
    return steps, skipped


def run_suite(
    case: Case,
    table: str,
    schema: str = "source",
    amount: list[str] | str | None = None,
    identifier: str | None = None,
    entity_name: str | None = None,
    confirmed_by: str | None = None,
    timeout_seconds: int = TIMEOUT_SECONDS,
    allow_large_profile: bool = False,
    size_limit: int = profile.SIZE_GATE,
    **options,
) -> dict:
    """One reply with buckets ran, declined, refused, errors, skipped. One step's failure stops no other."""
    amount = [amount] if isinstance(amount, str) else list(amount or [])
    store = case.evidence
    try:
        df = case.table(table, schema)
        need_columns(df, [*amount, *filter(None, (identifier, entity_name))])
        if not profile.size_gate(df, size_limit, allow_large_profile):
            return {"status": "declined", "verdict": str(Verdict.UNSAFE_TO_RUN), "table": table}
        confirmed = bool((confirmed_by or "").strip())
        if not confirmed:
            return _proposals(df, table)
        with pinned(case.spark):
            before = version.fingerprint(df)
    except Refusal as e:
        store.audit("refused", table=table, code=str(e.code), why=e.why)
        return {"status": "refused", "code": str(e.code), "why": e.why}
    steps, skipped = plan(amount, identifier, entity_name, confirmed)
    reply: dict = {"status": "completed", "table": table, "ran": [], "declined": [], "refused": [], "errors": [], "skipped": skipped}
    bucket = {"completed": "ran", "declined": "declined", "refused": "refused", "error": "errors"}
    versions = set()
    for step in steps:
        args = {k: v for k, v in step.items() if k != "method"}
        try:
            # the table has passed the gate already, or was let through
            result = run_test(case, step["method"], table, schema, confirmed_by=confirmed_by, statement_timeout_ms=timeout_seconds * 1000, allow_large_profile=True, **args, **options)
            out = result.as_dict()
        except Exception:  # whatever a step does, the others run
            out = {"status": "error", "method": step["method"], "code": str(Code.TEST_ERROR)}
        if out.get("dataset"):
            versions.add(out["dataset"])
        reply[bucket[out.pop("status")]].append(out | args)
    with pinned(case.spark):
        drifted = len(versions) > 1 or version.fingerprint(case.table(table, schema)) != before
    if drifted:
        reply |= {"code": str(Code.DATASET_CHANGED_DURING_SUITE), "versions": sorted(versions)}
    store.audit("suite", table=table, steps=len(steps), ran=len(reply["ran"]), declined=len(reply["declined"]), refused=len(reply["refused"]), errors=len(reply["errors"]))
    try:
        return trim(reply)
    except Refusal as e:  # the runs are recorded all the same
        return {"status": "error", "table": table, "code": str(e.code), "ran": len(reply["ran"]), "declined": len(reply["declined"]), "refused": len(reply["refused"]), "errors": len(reply["errors"])}


def _proposals(df, table: str) -> dict:
    profiled = profile.scan(df)
    found = suggest(profiled)
    out = {str(r): [{"column": s.column, "label": s.label, "evidence": list(s.evidence)} for s in found if s.role == r][:3] for r in Role}
    return {"status": "needs_confirmation", "table": table, "proposals": out, "sensitive": sorted(c for c, f in profiled.items() if sensitive(c, f))}


def trim(reply: dict, budget: int = SUITE_BUDGET) -> dict:
    """A copy within the budget: signals and texts go, every method and verdict stays."""
    size = lambda r: len(json.dumps(r, ensure_ascii=False, separators=(",", ":")))
    out = json.loads(json.dumps(reply))
    for field in ("top", "summary", "evidence", "finding_ids", "limits", "why", "values"):
        for name in ("ran", "declined", "refused", "errors"):
            for step in reversed(out[name]):
                if size(out) <= budget:
                    return out
                step.pop(field, None)
    # every method and verdict stays; of what is skipped, reasons go last
    for step in reversed(out["skipped"]):
        if size(out) <= budget:
            break
        step.pop("reason", None)
    for name in ("ran", "declined", "refused", "errors"):
        for step in reversed(out[name]):
            if size(out) <= budget:
                return out
            for k in [k for k in step if k not in ("method", "status", "verdict", "code", "run", "column", "identifier")]:
                step.pop(k)
    if size(out) > budget:
        raise Refusal(Code.RESULT_NOT_PRESENTABLE, "the reply does not fit its budget; ask for fewer columns at once")
    return out


def describe(pointer: str) -> dict:
    return registry.describe(pointer)
