"""One test: checked, versioned, run, recorded, masked, presented."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evidence, identity, masking, names, registry, version
from .codes import Code, FindingClass, Refusal, Verdict
from .contract import MethodResult, Signal, build
from .functions import encode_columns
from .names import ident
from .operators import benford, cross, duplicate, fuzzy, profile
from .roles import sensitive
from .session import StatementTimeout, limited, pinned, timeout_ms
from .sources import Case
from .suitability import Assessment


@dataclass(frozen=True)
class Outcome:
    """What a method hands back: numbers, ranked groups, and the flagged rows."""

    finding_class: FindingClass
    summary: str
    scanned: int
    metrics: dict
    signals: list[tuple[str, dict, float]] = field(default_factory=list)
    total: int = 0
    masked_columns: tuple[str, ...] = ()
    flagged: DataFrame | None = None
    #: Flagged rows of a second table, and its key columns.
    other: tuple[DataFrame, list[str]] | None = None
    verdict: str | None = None
    why: tuple[str, ...] = ()
    details: dict = field(default_factory=dict)
    labels: bool = False


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    case: Case
    df: DataFrame
    table: str
    schema: str
    keys: list[str]
    args: Mapping


class Declined(Exception):
    def __init__(self, assessment) -> None:
        super().__init__(str(assessment.verdict))
        self.assessment = assessment


def _arg(args: Mapping, *needed: str) -> list[str]:
    for n in needed:
        if not args.get(n):
            raise Refusal(Code.MISSING_ARGUMENT, f"argument {n!r} is needed")
    return [args[n] for n in needed]


def _top(groups: DataFrame, by: str, k: int = 5) -> list:
    return groups.orderBy(F.desc(by), "key").limit(k).collect()


def _benford(c: Context) -> Outcome:
    (column,) = _arg(c.args, "column")
    value = profile.as_number(c.df, column)
    if not isinstance(c.df.schema[column].dataType, profile.NumericType):
        row = c.df.agg(F.count(F.col(ident(column))).alias("n"), F.count(value).alias("ok")).first()
        if row.n != row.ok:
            raise Refusal(Code.WRONG_COLUMN_TYPE, f"column {column!r} holds text that is no number")
    if not profile.size_gate(c.df, int(c.args.get("size_limit") or profile.SIZE_GATE), bool(c.args.get("allow_large_profile"))):
        raise Declined(Assessment(Verdict.UNSAFE_TO_RUN, ("TOO_MANY_ROWS",)))
    need = benford.RULES.facts_required()
    facts = profile.facts_for(c.df, column, need)
    words = masking.name_words(column)
    facts |= {"words": words, "is_key": c.keys == [column], "sensitive": sensitive(column, facts)}
    verdict = benford.RULES.assess(facts)
    overridden = verdict.verdict in (Verdict.INSUFFICIENT_DATA, Verdict.NOT_APPLICABLE)
    if overridden and not c.args.get("allow_unsuitable"):
        raise Declined(verdict)
    rows = benford.digits(c.df, value).orderBy("digit").collect()
    s = benford.summary(c.spark.createDataFrame(rows)).first()
    label = "no claim of conformity" if overridden else s.band
    anomaly = s.mad > benford.BANDS[-1][0] and not overridden
    flagged = c.df.where(benford.first_digit(value) == s.worst_digit) if anomaly else None
    return Outcome(
        FindingClass.ANOMALY if anomaly else FindingClass.OBSERVATION,
        f"first digits of {s.n} values: MAD {s.mad:.5f}, {label}",
        facts["rows"],
        {"mad": s.mad, "chi2": s.chi2, "p_value": s.p_value, "n": float(s.n)},
        [(f"digit-{s.worst_digit}", {"mad": round(s.mad, 5), "chi2": round(s.chi2, 3), "band": s.band}, min(1.0, s.mad / 0.1))],
        flagged=flagged,
        verdict=str(verdict.verdict),
        why=verdict.reasons,
        details={"counts": {r.digit: r.n for r in rows}, "unvalidated": list(verdict.unvalidated)},
        labels=True,
    )


def _groups(c: Context, column: str, groups: DataFrame, by: str, what: str, flagged: DataFrame, extra: Mapping) -> Outcome:
    n, rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = c.df.count()
    top = _top(groups, by)
    signals = [(r["key"], {by: int(r[by])}, min(1.0, r["n"] / max(1, total))) for r in top]
    return Outcome(
        FindingClass.ANOMALY if n else FindingClass.OBSERVATION,
        f"{n} {what}, {rows} rows",
        total,
        {"groups": float(n), "rows": float(rows), **extra},
        signals,
        int(n),
        (column,),
        flagged if n else None,
    )


def _duplicates(c: Context) -> Outcome:
    (column,) = _arg(c.args, "identifier")
    names.need_columns(c.df, [column])
    blank = duplicate.blanks(c.df, [column]).first().blank
    if other := c.args.get("value"):
        names.need_columns(c.df, [other])
        groups = duplicate.shared(c.df, column, other)
        return _groups(c, column, groups, "n_values", "identifiers shared by different values", duplicate.flagged_rows(c.df, [column], groups), {"blank": float(blank)})
    groups = duplicate.duplicates(c.df, [column])
    return _groups(c, column, groups, "n", "duplicate identifiers", duplicate.flagged_rows(c.df, [column], groups), {"blank": float(blank)})


def _fuzzy(c: Context) -> Outcome:
    column, entity = _arg(c.args, "identifier", "entity_name")
    names.need_columns(c.df, [column, entity])
    found = fuzzy.conflicts(c.df, column, entity, float(c.args.get("threshold") or fuzzy.THRESHOLD))
    sizes = c.df.select(duplicate.keyed(c.df, [column]).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    groups = found.join(sizes, "key")
    return _groups(c, column, groups, "n_entities", "identifiers of several entities", duplicate.flagged_rows(c.df, [column], groups), {})


def _cross(c: Context) -> Outcome:
    column, right_table, right_column = _arg(c.args, "identifier", "right_table", "right_column")
    names.need_columns(c.df, [column])
    right = c.case.table(right_table, c.args.get("right_schema") or "source")
    names.need_columns(right, [right_column])
    amounts = None
    if c.args.get("amount") and c.args.get("right_amount"):
        amounts = (names.col(c.df, c.args["amount"]), names.col(right, c.args["right_amount"]))
    row = cross.reconcile(c.df, [column], right, [right_column], amounts, float(c.args.get("tolerance") or 0.01)).first()
    missing = cross.only_left(c.df, [column], right, [right_column])
    gap = cross.unmatched(c.df, [column], right, [right_column], amounts, float(c.args.get("tolerance") or 0.01))
    back = cross.unmatched(right, [right_column], c.df, [column], amounts and amounts[::-1], float(c.args.get("tolerance") or 0.01))
    here, there = row.only_left + row.differing, row.only_right + row.differing
    other = None
    if there:
        # rows of the other table can be linked if it has an identity; else its keys stand for them
        try:
            keys = identity.resolve(right, c.case.declared_key(right_table, c.args.get("right_schema") or "source"))
            other = (duplicate.flagged_rows(right, [right_column], back), keys)
        except Refusal:
            other = (back.select(F.col("key").alias(right_column)), [right_column])
    top = _top(missing, "n")
    gaps = row.only_left + row.only_right + row.differing
    safe = all(masking.harmless(d, k) for d, k in ((c.df, column), (right, right_column)))  # both, or neither
    return Outcome(
        FindingClass.ANOMALY if gaps else FindingClass.OBSERVATION,
        f"{row.matched} keys match, {row.only_left} only here, {row.only_right} only there, {row.differing} differ",
        row.left_keys + row.right_keys,
        {k: float(v) for k, v in row.asDict().items()},
        [(r.key, {"n": int(r.n)}, min(1.0, row.only_left / max(1, row.left_keys))) for r in top],
        int(row.only_left),
        (column,) if safe else (column, ""),
        duplicate.flagged_rows(c.df, [column], gap) if here else None,
        other,
    )


BENFORD_LIMITS = "First digit only; thresholds are unvalidated starting values. A deviation is a structural fact, no evidence of wrongdoing."
registry.register(registry.MethodSpec("benford", "1.1.0", "implemented", BENFORD_LIMITS, ("amount",), _benford))
registry.register(registry.MethodSpec("duplicate-analysis", "1.0.0", "implemented", "Blank keys are left out and counted. Sharing may be legitimate.", ("identifier",), _duplicates))
registry.register(registry.MethodSpec("fuzzy-entity-match", "1.0.0", "implemented", "Trigram similarity of 0.55: short names one letter apart stay separate.", ("identifier", "entity-name"), _fuzzy))
registry.register(registry.MethodSpec("cross-dataset-match", "1.0.0", "implemented", "Keys are compared after normalisation; blank keys are left out.", ("identifier",), _cross))


def register_dataset(case: Case, df: DataFrame, table: str, ms: int) -> str:
    """The version of the table's content: an earlier one if the content is the same."""
    shape = version.layout(df)
    try:
        with limited(case.spark, ms):
            mark, notes = version.fingerprint(df), None
    except StatementTimeout:
        mark, notes = None, "fingerprint timed out: weak basis, the number of rows; content is not verified"
    rows = int(mark.split(":")[1]) if mark else df.count()
    found = version.version_id(table, shape, mark or f"rows:{rows}")
    known = case.evidence.read("datasets").where(F.col("dataset_version") == found)
    if mark is None or known.where(F.col("table_hash") == mark).isEmpty():
        case.evidence.append("datasets", {"dataset_version": found, "table": table, "layout": shape, "row_count": rows, "table_hash": mark, "notes": notes, "created_at": evidence.now()})
    return found


def run_test(
    case: Case,
    method: str,
    table: str,
    schema: str = "source",
    confirmed_by: str | None = None,
    allow_unsuitable: bool = False,
    reveal_values: bool = False,
    statement_timeout_ms: int | None = None,
    salt_folder: str | None = None,
    **args,
) -> MethodResult:
    """Run one registered method on one table of the case. Every outcome is a result; nothing raises."""
    try:
        with pinned(case.spark):
            return _run(case, method, table, schema, confirmed_by, allow_unsuitable, reveal_values, statement_timeout_ms, salt_folder, args)
    except Refusal as e:
        case.evidence.audit("refused", method=method, table=table, code=str(e.code), why=e.why)
        return MethodResult("refused", method, code=str(e.code), why=(e.why[:200],))


def _run(case, method, table, schema, confirmed_by, allow_unsuitable, reveal, ms, salt_folder, args) -> MethodResult:
    spark, store = case.spark, case.evidence
    ms = timeout_ms(ms)
    spec = registry.lookup(method)
    pointer = f"{spec.name}@{spec.version}"
    for v in (table, schema, *(v for k, v in args.items() if isinstance(v, str) and k not in ("threshold", "tolerance"))):
        names.check_name(v)
    df = case.table(table, schema)
    names.need_columns(df, [v for k, v in args.items() if k in ("column", "identifier", "value", "entity_name") and v])
    keys = identity.resolve(df, case.declared_key(table, schema))
    if method == "benford" and not (confirmed_by or "").strip():
        store.audit("declined", method=method, table=table, verdict=str(Verdict.REQUIRES_CONFIRMATION))
        return build(MethodResult("declined", method, str(Verdict.REQUIRES_CONFIRMATION), ("NO_CONFIRMATION",), limits=pointer))
    if confirmed_by:
        store.audit("confirmed", actor=confirmed_by.strip(), method=method, table=table, args=args)
    dataset = register_dataset(case, df, f"{schema}.{table}", ms)
    context = Context(spark, case, df, table, schema, keys, {**args, "allow_unsuitable": allow_unsuitable})
    run = evidence.new_id("run")
    params = {k: str(v) for k, v in args.items() if v is not None}
    start = {"run_id": run, "dataset_version": dataset, "method": spec.name, "method_version": spec.version, "params": params, "at": evidence.now()}
    store.audit("started", run=run, method=pointer, table=table)
    finding, links = evidence.new_id("finding"), 0
    try:
        with limited(spark, ms):
            out = _custom(spec, context) if spec.name.startswith("custom:") else spec.run(context)
            if out.flagged is not None:
                links = store.append_links(finding, identity.encoded_columns(keys), out.flagged.select(encode_columns(out.flagged, keys)))
            if out.other is not None:
                rows, its = out.other
                links += store.append_links(finding, f"{args.get('right_schema') or 'source'}.{args['right_table']}:{identity.encoded_columns(its)}", rows.select(encode_columns(rows, its)))
    except Declined as d:
        a = d.assessment
        store.audit("declined", run=run, method=pointer, verdict=str(a.verdict), why=list(a.reasons), unvalidated=list(a.unvalidated))
        return build(MethodResult("declined", method, str(a.verdict), a.reasons, dataset=dataset, limits=pointer))
    except StatementTimeout as e:
        return _failed(store, method, run, Code.STATEMENT_TIMEOUT, e)
    except Refusal:
        raise
    except AnalysisException as e:
        return _failed(store, method, run, Code.DATABASE_ERROR, e)
    except Exception as e:
        return _failed(store, method, run, Code.TEST_ERROR, e)
    found = {"finding_id": finding, "run_id": run, "class": str(out.finding_class), "summary": out.summary, "metrics": {k: float(v) for k, v in out.metrics.items()}, "details_json": json.dumps(out.details), "at": evidence.now()}
    store.append("findings", found)
    store.append("test_runs", start | {"query_text": pointer, "status": "completed"})
    shown, how = _subjects(out, df, reveal, salt_folder)
    result = MethodResult(
        "completed", method, out.verdict, out.why, out.scanned, out.finding_class, out.summary, tuple(Signal(s, m, w) for s, (_, m, w) in zip(shown, out.signals)), out.total, dataset, run, (finding,), {"key": identity.encoded_columns(keys), "links": links}, pointer, values=how
    )
    return build(result, frozenset(shown) if how == "revealed" else frozenset())


def _subjects(out: Outcome, df: DataFrame, reveal: bool, salt_folder) -> tuple[list[str], str | None]:
    values = [v for v, _, _ in out.signals]
    if out.labels or not values:
        return values, None
    safe = reveal and "" not in out.masked_columns and all(masking.harmless(df, c) for c in out.masked_columns)
    return masking.subjects(values, masking.secret(salt_folder), reveal, safe)


def _custom(spec, c: Context) -> Outcome:
    columns = {r: _arg(c.args, r)[0] for r in spec.needs}
    names.need_columns(c.df, columns.values())
    flagged = spec.run(c.df, **columns)
    names.need_columns(flagged, c.keys)
    n, total = flagged.count(), c.df.count()
    return Outcome(FindingClass.ANOMALY if n else FindingClass.OBSERVATION, f"{n} of {total} rows flagged", total, {"rows": float(n)}, [("group-1", {"rows": n}, n / max(1, total))], n, flagged=flagged if n else None, labels=True)


def _failed(store, method: str, run: str, code: Code, e: Exception) -> MethodResult:
    store.audit("failed", run=run, method=method, code=str(code), error=str(e)[:500])
    return MethodResult("error", method, code=str(code), run=run)
