"""Codes of refusals, verdicts and states."""

from __future__ import annotations

from enum import StrEnum


class Code(StrEnum):
    NO_SUCH_TABLE = "NO_SUCH_TABLE"
    NO_SUCH_COLUMN = "NO_SUCH_COLUMN"
    NO_ROW_IDENTITY = "NO_ROW_IDENTITY"
    UNSAFE_IDENTIFIER = "UNSAFE_IDENTIFIER"
    MISSING_ARGUMENT = "MISSING_ARGUMENT"
    WRONG_COLUMN_TYPE = "WRONG_COLUMN_TYPE"
    NOT_IMPLEMENTED = "NOT_IMPLEMENTED"
    BAD_CONFIGURATION = "BAD_CONFIGURATION"
    TABLE_TOO_LARGE = "TABLE_TOO_LARGE"
    STATEMENT_TIMEOUT = "STATEMENT_TIMEOUT"
    LOCK_TIMEOUT = "LOCK_TIMEOUT"  # reserved: files that never change take no locks
    DATABASE_ERROR = "DATABASE_ERROR"
    TEST_ERROR = "TEST_ERROR"
    RESULT_NOT_PRESENTABLE = "RESULT_NOT_PRESENTABLE"
    DATASET_CHANGED_DURING_SUITE = "DATASET_CHANGED_DURING_SUITE"


class Verdict(StrEnum):
    SUPPORTED = "SUPPORTED"
    SUPPORTED_WITH_WARNING = "SUPPORTED_WITH_WARNING"
    NOT_APPLICABLE = "NOT_APPLICABLE"
    INSUFFICIENT_DATA = "INSUFFICIENT_DATA"
    REQUIRES_CONFIRMATION = "REQUIRES_CONFIRMATION"
    UNSAFE_TO_RUN = "UNSAFE_TO_RUN"


#: From the least to the most restrictive.
SEVERITY = tuple(Verdict)


class FindingClass(StrEnum):
    OBSERVATION = "OBSERVATION"
    ANOMALY = "ANOMALY"


class Refusal(Exception):
    """A request that is turned down before anything is computed."""

    def __init__(self, code: Code, why: str) -> None:
        super().__init__(f"{code}: {why}")
        self.code, self.why = code, why
