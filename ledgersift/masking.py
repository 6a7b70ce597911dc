"""Tokens in place of identifiers; values are shown only where all of them look harmless."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import PATTERNS, half_width, norm_key
from .names import ident

#: Fixed value: the name under which a case keeps its secret.
SALT_FILE = ".forensic_mask_salt"
#: Words in a column's name that mark it as sensitive.
SENSITIVE_WORDS = {"aadhaar", "account", "acct", "address", "bank", "dob", "email", "ifsc", "mail", "mobile", "pan", "passport", "password", "person", "phone", "ssn", "uid"}


def secret(folder: str | os.PathLike | None = None) -> bytes | None:
    """FORENSIC_MASK_SALT, else a file beside the configuration, made on first use."""
    if text := os.environ.get("FORENSIC_MASK_SALT"):
        return text.encode()
    if folder is None:
        return None
    path = Path(folder) / SALT_FILE
    try:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(secrets.token_hex(32))
    except FileExistsError:
        pass
    except OSError:
        return None
    return path.read_text().strip().encode() or None


def normalise(value: str) -> str:
    """As functions.norm_key, for the few values that reach the driver."""
    text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in str(value))
    return re.sub(r"[\s\-]+", "", text).upper()


def token(value: str, key: bytes) -> str:
    """Twelve letters; the same for all spellings of one identifier, and in every run."""
    digest = hmac.new(key, normalise(value).encode(), hashlib.sha256).hexdigest()
    return digest[:12].translate(str.maketrans("0123456789", "ghijklmnop"))


def name_words(column: str) -> list[str]:
    plain = unicodedata.normalize("NFKD", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column)).lower()
    return re.findall(r"[a-z]+", plain)


def sensitive_name(column: str) -> bool:
    return not SENSITIVE_WORDS.isdisjoint(name_words(column))


def harmless(df: DataFrame, column: str) -> bool:
    """Whether name and every single value look harmless. One scan; fails closed."""
    if sensitive_name(column):
        return False
    text = half_width(F.col(ident(column)))
    bad = F.length(F.regexp_replace(text, "[^0-9]", "")) >= 9
    for pattern in PATTERNS.values():
        bad = bad | F.upper(F.trim(text)).rlike(pattern.replace("a-z", "A-Z")) | norm_key(text).rlike(pattern)
    return not df.agg(F.coalesce(F.max(F.coalesce(bad, F.lit(False))), F.lit(False))).first()[0]


def subjects(values: list[str], key: bytes | None, reveal: bool, safe: bool) -> tuple[list[str], str]:
    """What stands for each value, and ``masked``, ``revealed`` or ``withheld``."""
    if reveal and safe:
        return [str(v)[:40] for v in values], "revealed"
    if key is None:
        return [f"rank-{i + 1}" for i in range(len(values))], "withheld"
    return [token(v, key) for v in values], "masked"
