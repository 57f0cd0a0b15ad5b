"""Native expressions that bring differently spelt keys to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII and the ideographic space, and what NFKC makes of them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Characters without width.
INVISIBLE = "[​-‏⁠-⁤﻿­᠎]"


def narrow(c: Column) -> Column:
    """Full-width characters become ASCII; everything else stays."""
    return F.translate(c, _WIDE, _NARROW)


def tidy(c: Column) -> Column:
    """Narrow, without invisible characters, white space trimmed and runs of it made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(narrow(c), INVISIBLE, ""), r"[\s ]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(tidy(c)) > 0, c)


def uuid_key(c: Column) -> Column:
    """32 lower-case hex digits, or null if the value is no UUID (URN prefix, braces, case and dashes are spelling)."""
    bare = F.regexp_replace(F.lower(tidy(c)), r"^urn:uuid:|[{}\-]", "")
    bare = F.regexp_replace(bare, r"\s", "")
    return F.when(bare.rlike(r"^[0-9a-f]{32}$"), bare)


def receipt_key(c: Column) -> Column:
    """14 digits of a receipt number, or null: a query-string prefix and separators are spelling."""
    bare = F.regexp_replace(F.lower(tidy(c)), r"^(rcpno|rcept_no|no)=|[\s\-]", "")
    return F.when(bare.rlike(r"^[0-9]{14}$"), bare)


def stock_key(c: Column) -> Column:
    """A ticker without exchange prefix or suffix, upper-case, numeric codes with six digits; null if it has another shape."""
    bare = F.upper(F.regexp_replace(tidy(c), r"\s", ""))
    bare = F.regexp_replace(bare, r"^(KRX|KOSPI|KOSDAQ|NASDAQ|NYSE|AMEX)[:.]|^\$|\.(KS|KQ|KR|O|N|OQ|US)$", "")
    bare = F.regexp_replace(bare, r"^A(?=[0-9]{6}$)", "")
    bare = F.when(bare.rlike(r"^[0-9]{1,6}$"), F.lpad(bare, 6, "0")).otherwise(bare)
    return F.when(bare.rlike(r"^([0-9]{6}|[A-Z]{1,5})$"), bare)


def digest_key(c: Column) -> Column:
    """64 lower-case hex digits of an event id with or without its algorithm's prefix; another non-blank value stays as it is, tidied; blank is null."""
    bare = F.regexp_replace(F.lower(tidy(c)), r"^sha-?256[:=]|\s", "")
    return F.when(F.length(bare) > 0, bare)
