"""Names of tables and columns: validated, quoted, and checked for existence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import Code, Refusal

MAX_BYTES = 63


def check_name(name: str) -> str:
    """The name itself; refused if empty, over 63 bytes, or with NUL or %."""
    if not isinstance(name, str) or not name:
        raise Refusal(Code.UNSAFE_IDENTIFIER, "a name is empty")
    if "\x00" in name or "%" in name:
        raise Refusal(Code.UNSAFE_IDENTIFIER, "a name holds NUL or %")
    if len(name.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise Refusal(Code.UNSAFE_IDENTIFIER, f"a name is longer than {MAX_BYTES} bytes")
    return name


def ident(name: str) -> str:
    """Quoted for SQL text. Quotes, spaces, reserved words and any script are allowed."""
    return "`" + check_name(name).replace("`", "``") + "`"


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, case included."""
    need_columns(df, [name])
    return F.col(ident(name))


def need_columns(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        check_name(name)
        if name not in df.columns:
            raise Refusal(Code.NO_SUCH_COLUMN, f"column {name!r} does not exist")
