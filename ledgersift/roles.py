"""Roles of columns: suggested from evidence, bound only by a named person."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame

from .codes import Code, Refusal
from .functions import PATTERNS
from .masking import name_words, sensitive_name
from .names import need_columns
from .operators import profile
from .operators.benford import AMOUNT_WORDS, COUNTER_WORDS


class Role(StrEnum):
    AMOUNT = "amount"
    IDENTIFIER = "identifier"
    ENTITY_NAME = "entity-name"


IDENTIFIER_WORDS = {"code", "id", "key", "no", "number", "ref", "reference", "reg", "registration"}
NAME_WORDS = {"company", "customer", "entity", "establishment", "firm", "name", "party", "payee", "supplier", "vendor"}
#: Share of the values with the shape of an identifier, from which a column counts as sensitive.
SENSITIVE_SHARE = 0.2


@dataclass(frozen=True)
class Suggestion:
    role: Role
    column: str
    evidence: tuple[str, ...]

    @property
    def label(self) -> str:
        """How much evidence agrees; not a probability."""
        return ("weak", "medium", "strong")[min(len(self.evidence), 3) - 1]


def sensitive(column: str, facts: Mapping) -> bool:
    return sensitive_name(column) and not set(name_words(column)) & AMOUNT_WORDS or any((facts.get(f"{k}_share") or 0) >= SENSITIVE_SHARE for k in PATTERNS)


def suggest(profiled: Mapping[str, Mapping]) -> list[Suggestion]:
    """Suggestions with their evidence, the best first. Nothing is bound."""
    out = []
    for column, f in profiled.items():
        words = set(name_words(column))
        pattern = any((f.get(f"{k}_share") or 0) >= SENSITIVE_SHARE for k in PATTERNS)
        if pattern:
            continue
        rows, known = f["rows"], f["rows"] - f["nulls"]
        amount = []
        if f.get("numeric"):
            whole = f["integer_share"] == 1
            if words & AMOUNT_WORDS:
                amount.append("name_amount")
            if not whole:
                amount.append("fractions")
            if (f["span"] or 0) >= 2:
                amount.append("wide_range")
            # whole numbers without an amount's name may count or identify anything
            if whole and not words & AMOUNT_WORDS or words & COUNTER_WORDS and not words & AMOUNT_WORDS:
                amount = []
        if amount and not (sensitive_name(column) and not words & AMOUNT_WORDS):
            out.append(Suggestion(Role.AMOUNT, column, tuple(amount)))
        if sensitive_name(column):
            continue
        ids = []
        if words & IDENTIFIER_WORDS:
            ids.append("name_identifier")
        if known and f["approx_distinct"] >= 0.9 * known:
            ids.append("mostly_distinct")
        if known and not f.get("numeric") and f["approx_distinct"] >= 0.5 * known:
            ids.append("text_key")
        if ids and (words & IDENTIFIER_WORDS) and rows:
            out.append(Suggestion(Role.IDENTIFIER, column, tuple(ids)))
        names = []
        if words & NAME_WORDS and not f.get("numeric"):
            names.append("name_entity")
            if known and f["approx_distinct"] > 1:
                names.append("varied_text")
            out.append(Suggestion(Role.ENTITY_NAME, column, tuple(names)))
    return sorted(out, key=lambda s: (s.role, -len(s.evidence), s.column))


class Bindings:
    """Columns in their roles, each confirmed by a named person."""

    def __init__(self, df: DataFrame) -> None:
        self._df, self._bound = df, {}

    def confirm(self, role: Role, column: str, confirmed_by: str) -> None:
        if not confirmed_by or not confirmed_by.strip():
            raise Refusal(Code.MISSING_ARGUMENT, "a binding needs the name of a person")
        need_columns(self._df, [column])
        self._bound[Role(role)] = (column, confirmed_by.strip())

    def column(self, role: Role) -> str | None:
        return self._bound.get(Role(role), (None, None))[0]

    def facts_for(self, role: Role, need: set[str] | None = None) -> dict:
        """Measurements of the column that is confirmed for the role; of no other."""
        column = self.column(role)
        if column is None:
            raise Refusal(Code.MISSING_ARGUMENT, f"no column is confirmed as {role}")
        return profile.facts_for(self._df, column, need)
