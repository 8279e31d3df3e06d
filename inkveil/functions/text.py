"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and names, as results must equal them.
WHITE_CLASS = r"\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WIDE_WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CLEANED = "[\"'“”:=;,./#()\\\\\\]^_]"
NOISE = r"\A[-_~—|•*#:=;,.\\/]+\z"
COLOURS = {"#000000": "Black", "#ffffff": "White", "#374151": "Grey", "#1e3a8a": "Navy", "#b91c1c": "Red"}
DEFAULT_COLOUR = "Black"

#: One white-space character, Unicode's included.
WHITE = f"[{WHITE_CLASS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fuzzy_digits(text: Column) -> Column:
    """Letters that scanners take for digits, as digits."""
    return F.translate(text, "OoIl|SB", "0011158")


def clean_text(text: Column) -> Column:
    """Lower-cased, punctuation as spaces (not the hyphen), spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), CLEANED, " "), WHITE + "+", " "))


def is_noise(text: Column) -> Column:
    return text.rlike(NOISE)


def wide_trim(text: Column) -> Column:
    """Without Unicode white space and byte order marks at both ends."""
    return F.btrim(text, F.lit(WIDE_WHITE))


def contains_query(text: Column, query: str | None) -> Column:
    """Case-insensitive containment; a blank query matches nothing."""
    q = (query or "").strip(WIDE_WHITE).lower()
    return F.lower(text).contains(q) if q else F.lit(False)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def is_day(text: Column) -> Column:
    return digits_only(text).rlike(r"\A(0?[1-9]|[12][0-9]|3[01])\z")


def is_month(text: Column) -> Column:
    from inkveil.functions.patterns import MONTHS

    return letters_only(text).isin(MONTHS)


def is_year(text: Column) -> Column:
    return digits_only(text).rlike(r"\A(19|20)\d{2}\z")


def half_up(value: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(value + F.lit(0.5))


def scrub(text: Column, secrets: Column) -> Column:
    """Each occurrence of each secret (array of strings) as as many spaces; longest first, ties in array order."""
    usable = F.array_distinct(F.filter(F.transform(secrets, wide_trim), lambda s: F.length(s) > 0))
    ranked = F.array_sort(F.transform(usable, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return F.aggregate(ranked, text, lambda acc, x: F.replace(acc, x["s"], F.repeat(F.lit(" "), F.length(x["s"]))))


def hex_channel(colour: Column, channel: int) -> Column:
    """Channel 0 to 2 (red, green, blue) of a hex colour, 0 to 1; malformed colours are black."""
    body = F.regexp_replace(colour, r"\A([^#]*)#", "$1")
    long = F.when(F.length(body) == 3, F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    digits = F.regexp_extract(long, r"\A[0-9A-Fa-f]+", 0)
    number = F.when(digits != "", F.conv(digits, 16, 10).cast("long"))
    return F.coalesce(F.shiftright(number, 16 - 8 * channel).bitwiseAND(255) / 255, F.lit(0.0))


def format_bytes(n: Column) -> Column:
    """Base 1024, one decimal, without a trailing zero; TB above GB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None).cast("string")
    for k in reversed(range(len(units))):
        scaled = F.round(n / F.lit(float(1024**k)), 1)
        label = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(F.format_string("%.1f", scaled))
        out = F.when((n >= 1024**k) & (n < 1024 ** (k + 1)) if k < len(units) - 1 else n >= 1024**k, F.concat(label, F.lit(f" {units[k]}"))).otherwise(out)
    return F.when(n.isNull() | (n == 0), F.lit("0 B")).otherwise(out)


def extension(name: Column, document_type: Column) -> Column:
    whole = F.coalesce(F.when(name != "", name), F.lit("document_redacted.pdf"))
    fallback = F.when(document_type.contains("pdf"), ".pdf").otherwise(".jpg")
    return F.when(whole.contains("."), F.concat(F.lit("."), F.substring_index(whole, ".", -1))).otherwise(fallback)


def default_base(document_type: Column, pages: Column) -> Column:
    return F.when(document_type.contains("pdf"), "redacted-pdf").when(pages > 1, "redacted-images").otherwise("redacted-image")


def base_of(name: Column) -> Column:
    """The name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def clean_base(base: Column, document_type: Column, pages: Column) -> Column:
    usable = wide_trim(base)
    return F.regexp_replace(F.coalesce(F.when(usable != "", usable), default_base(document_type, pages)), r'[/\\?%*:|"<>]', "_")


def final_name(name: Column, document_type: Column, pages: Column, custom_extension: Column | None = None) -> Column:
    ext = extension(name, document_type) if custom_extension is None else F.coalesce(F.when(custom_extension != "", custom_extension), extension(name, document_type))
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.concat(clean_base(base_of(name), document_type, pages), dotted)


def colour_name(colour: Column) -> Column:
    pairs = [F.lit(x) for item in COLOURS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.lower(colour)], F.when(colour != "", colour), F.lit(DEFAULT_COLOUR))


def savings_percent(original: Column, exported: Column) -> Column:
    """Whole percent saved; null where nothing was."""
    shown = (original > 0) & (exported < original)
    return F.when(shown, half_up((1 - exported / original) * 100).cast("long"))


def face_id(page: Column, index: Column) -> Column:
    return F.concat(F.lit("face-"), page.cast("string"), F.lit("-"), index.cast("string"))


def page_id(page: Column) -> Column:
    return F.concat(F.lit("pdf-page-"), page.cast("string"))


def page_label(page: Column) -> Column:
    return F.concat(F.lit("Page "), page.cast("string"))


def page_or_first(page: Column) -> Column:
    """Missing and zero page numbers are page 1."""
    return F.when(page.isNull() | (page == 0), F.lit(1)).otherwise(page)
