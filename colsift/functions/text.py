"""Text normalization, tokens and the numeric and date patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space characters of Unicode text, as a character class.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}]"

# Fixed value: the same characters, listed.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Date labels and their full-match patterns; the first match wins.
DATE_PATTERNS = {
    "ISO_DATETIME": r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T ]\p{Nd}{2}:\p{Nd}{2}",
    "YYYY-MM-DD": r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
    "YYYY/MM/DD": r"\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}",
    "SLASH_DATE": r"\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{4}",
    "MON_DD_YYYY": rf"[A-Za-z]{{3,9}}{SPACE}+\p{{Nd}}{{1,2}},{SPACE}+\p{{Nd}}{{4}}",
    "DD_MON_YYYY": rf"\p{{Nd}}{{1,2}}{SPACE}+[A-Za-z]{{3,9}}{SPACE}+\p{{Nd}}{{4}}",
}

# Words in a column name that hint at an identifier.
IDENTIFIER_WORDS = {"id", "uuid", "guid", "identifier", "key", "index", "code"}

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY = r"^[+-]?(?i:inf|infinity)$"

# Text up to this length is its own token.
TOKEN_CHARS = 64
_LONG = "\x00"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Every run of white space turned into one blank; single blanks are left alone."""
    return F.regexp_replace(text, rf"{SPACE}(?:{SPACE}+|(?<! ))", " ")


def collapse(text: Column) -> Column:
    """Stripped text with every run of white space turned into one blank."""
    return squeeze(strip(text))


def casefold(text: Column) -> Column:
    """Case-insensitive form; upper-casing first also folds letters such as ß.

    The final sigma joins the plain one. The dotless i, which upper-casing
    would turn into a plain I, waits behind a character no text contains.
    ``replace`` is used throughout: it leaves text without a hit untouched.
    """
    def swap(value: Column, old: str, new: str) -> Column:
        return F.replace(value, F.lit(old), F.lit(new))

    upper = swap(F.upper(swap(swap(text, "ẞ", "ß"), "ı", "\ufdd0")), "ς", "Σ")
    return swap(swap(F.lower(upper), "ς", "σ"), "\ufdd0", "ı")


def category_key(text: Column) -> Column:
    return casefold(collapse(text))


def is_plain(text: Column) -> Column:
    """Whether text is printable ASCII without white space: it is its own stripped and collapsed form, and folds to lower case.

    One pattern that saves most values the steps above.
    """
    return text.rlike(r"^[!-~]*+\z")


def is_long(text: Column) -> Column:
    return (F.char_length(text) > TOKEN_CHARS) | text.startswith(_LONG)


def token(text: Column) -> Column:
    """Short text as is; longer text as a marked 128-bit digest.

    Tokens keep shuffles narrow when a column holds whole documents. A short
    token never equals a digest, so values up to ``TOKEN_CHARS`` are exact.
    """
    digest = F.concat(
        F.lit(_LONG),
        F.lpad(F.hex(F.xxhash64(text)), 16, "0"),
        F.lpad(F.hex(F.xxhash64(F.lit(1), text)), 16, "0"))
    return F.when(is_long(text), digest).otherwise(text)


def is_digest(tok: Column) -> Column:
    return tok.startswith(_LONG)


def is_number(stripped: Column) -> Column:
    """Whether text reads as a number: decimal or exponent form within the
    range of a double, or an infinity word."""
    value = F.expr("double('inf')")
    finite = stripped.rlike(NUMBER) & (F.abs(stripped.try_cast("double")) < value)
    return F.coalesce(finite, F.lit(False)) | stripped.rlike(INFINITY)


def date_label(stripped: Column) -> Column:
    label = None
    for name, pattern in DATE_PATTERNS.items():
        test = stripped.rlike(rf"^(?:{pattern})\z")
        label = F.when(test, name) if label is None else label.when(test, name)
    return label


def may_be_value(stripped: Column) -> Column:
    """Whether text is a number or a date, by one pattern over the text."""
    patterns = [NUMBER.strip("^$"), INFINITY.strip("^$"), *DATE_PATTERNS.values()]
    return stripped.rlike(rf"^(?:{'|'.join(patterns)})\z")


def has_identifier_name(name: str) -> bool:
    folded = name.strip().casefold()
    words = set(re.findall(r"[a-z0-9]+", folded))
    return folded.startswith("unnamed:") or not words.isdisjoint(IDENTIFIER_WORDS)


def is_unnamed(name: str) -> bool:
    folded = name.strip().casefold()
    rest = folded.removeprefix("unnamed")
    return rest != folded and (not rest or rest[0] == ":" or rest[0].isspace())
