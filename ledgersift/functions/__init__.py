"""Column expressions that the tests share; all run inside Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..names import ident

#: Full-width forms of ASCII lie at a fixed distance.
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)

NUMBER = "decimal(38,10)"

#: Shapes of identifiers that are always masked.
PATTERNS = {
    "aadhaar": r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$",
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "mobile": r"^(\+?91[ -]?)?[6-9][0-9]{9}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}


def half_width(x: Column) -> Column:
    return F.translate(x.cast("string"), _WIDE, _ASCII)


def norm_key(x: Column) -> Column:
    """An identifier without what doesn't tell identifiers apart: case, spacing, hyphens, digit width. Blank is null."""
    return F.nullif(F.upper(F.regexp_replace(half_width(x), r"[\s\-]+", "")), F.lit(""))


def norm_name(x: Column) -> Column:
    """A name in upper case, its words apart by single spaces. Blank is null."""
    return F.nullif(F.trim(F.upper(F.regexp_replace(half_width(x), r"[\s\-]+", " "))), F.lit(""))


def number(x: Column) -> Column:
    """An exact number, or null."""
    return x.try_cast(NUMBER)


def first_digit(x: Column) -> Column:
    """The first significant digit, of values below 1 too; null for 0 and null."""
    return F.nullif(F.regexp_extract(F.abs(x).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def benford_share(digit: Column) -> Column:
    return F.log10(1 + 1 / digit.cast("double"))


def trigrams(name: Column) -> Column:
    """Distinct trigrams of the words of a name, each word padded with two spaces before and one after."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    words = F.filter(F.split(name, " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, of)))


def encode_key(*keys: Column) -> Column:
    """One text for a key: a single one as it is, several as a JSON array."""
    texts = [k.cast("string") for k in keys]
    return texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))


def whole_numbers(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether all of these columns hold whole numbers: they need no normalisation and no escapes."""
    return all(isinstance(df.schema[n].dataType, IntegralType) for n in names)


def encode_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """``encode_key`` of columns; whole numbers are put together without a JSON writer."""
    cols = [F.col(ident(n)) for n in names]
    if len(names) == 1 or not whole_numbers(df, names):
        return encode_key(*cols)
    texts = [c.cast("string") for c in cols]
    text = F.concat(F.lit('["'), texts[0], *[x for t in texts[1:] for x in (F.lit('","'), t)], F.lit('"]'))
    null = cols[0].isNull()
    for c in cols[1:]:
        null = null | c.isNull()
    return F.when(null, encode_key(*cols)).otherwise(text)


def decode_key(text: Column, width: int) -> Column:
    """The array of a key's parts."""
    return F.array(text) if width == 1 else F.from_json(text, "array<string>")


def mask_token(x: Column, secret: bytes) -> Column:
    """Twelve letters from HMAC-SHA256, built from SHA-256 so that it runs inside Spark.

    The secret is a literal of the plan: use it where plans aren't shown to readers.
    """
    import hashlib

    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(x, "UTF-8")), 256))
    digest = F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
    return F.translate(F.substring(digest, 1, 12), "0123456789", "ghijklmnop")
