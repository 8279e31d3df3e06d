"""Identifier patterns.

Java's word boundary takes any Unicode letter for a word character and its white space is ASCII's; the identifiers
are defined with the ASCII boundary and Unicode's white space, so both are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import text as T

ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Identifier formats, month names and categories, as results must equal them.
MONTHS = [
    "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember",
    "january", "february", "march", "may", "june", "july", "august", "october", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
MONTH_NUMBER = "(?:0?[1-9]|1[012])"
YEAR = r"(?:19|20)\d{2}"
NUMERIC_DATE = rf"{DAY}[/\-.]{MONTH_NUMBER}[/\-.]{YEAR}"
PATTERNS = {
    "nik": r"\b(?:(?:\d{4}[\s.-]){3}\d{4}|\d{16})\b",
    "phone": r"\b(?:\+?62[\s-]?8\d{8,11}|08\d{8,11}|\(?0\d{2,4}\)?[\s.-]?\d{6,8})\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "dob": rf"\b(?:{NUMERIC_DATE}|{DAY}\s+<month>\s+{YEAR})\b",
    "ttl": rf"\b[A-Za-z]{{3,18}},\s*(?:{NUMERIC_DATE})\b",
    "npwp": r"\b\d{2}\.\d{3}\.\d{3}\.\d{1}-\d{3}\.\d{3}\b",
    "bpjs": r"\b000\d{10}\b",
    "bank": r"\b\d{10,16}\b",
    "id": r"\b[A-Za-z]{1,2}\d{7,8}\b",
}
CATEGORIES = [
    ("nik", "NIK (KTP)"),
    ("phone", "Phone number"),
    ("email", "E-mail address"),
    ("dob", "Date of birth"),
    ("ttl", "Place and date of birth"),
    ("npwp", "Tax number"),
    ("bpjs", "Health insurance number"),
    ("bank", "Bank account"),
    ("id", "Passport or document number"),
]
ALL_TYPES = [*PATTERNS, "date", "custom"]


def java(kind: str) -> str:
    """The pattern of a category (`date` is that of `dob`). Every pattern ends in a letter or digit, and most begin with one; there, one
    look suffices for the boundary. Month names match ASCII letters of either case."""
    start = ASCII_BOUNDARY if kind in ("phone", "email") else r"(?<![A-Za-z0-9_])"
    body = PATTERNS["dob" if kind == "date" else kind].removeprefix(r"\b").removesuffix(r"\b")
    body = body.replace("<month>", f"(?i:{'|'.join(MONTHS)})").replace(r"[\s", f"[{T.WHITE_CLASS}").replace(r"\s", T.WHITE)
    return start + body + r"(?![A-Za-z0-9_])"


def has(kind: str, raw: Column, fuzzy: Column, clean: Column) -> Column:
    """Whether any of a token's three forms holds the identifier."""
    p = java(kind)
    return raw.rlike(p) | fuzzy.rlike(p) | clean.rlike(p)


#: Five characters that are digits or taken for them; the same within one word.
_LIKE, _OTHER = "[0-9OoIlSB|]", "0-9OoIlSB|"
FIVE_DIGITS = f"{_LIKE}(?:[^{_OTHER}]*{_LIKE}){{4}}"
FIVE_IN_A_WORD = f"{_LIKE}(?:[^{_OTHER}{T.WHITE_CLASS}]*{_LIKE}){{4}}"


def worth_matching(token: Column) -> Column:
    """Necessary for any of the patterns in any form: an @, or five digits once look-alikes count as digits."""
    return (F.length(token) >= 5) & (token.contains("@") | token.rlike(FIVE_DIGITS))


def worth_reading(text: Column) -> Column:
    """Necessary for a text to have a word that is worth matching."""
    return text.contains("@") | text.rlike(FIVE_IN_A_WORD)


def categories(token: Column) -> Column:
    """The token's categories in their fixed order; empty for null, empty and noise tokens."""

    def of(forms: Column) -> Column:
        return F.array_compact(F.array(*[F.when(has(kind, token, forms["fuzzy"], forms["clean"]), F.lit(kind)) for kind, _ in CATEGORIES]))

    found = T.let(F.struct(T.fuzzy_digits(token).alias("fuzzy"), T.clean_text(token).alias("clean")), of)
    none = F.array().cast("array<string>")
    return F.when(token.isNull() | (token == "") | T.is_noise(token) | ~worth_matching(token), none).otherwise(found)
