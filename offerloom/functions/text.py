"""Text repair and normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelled-out German letters.
UMLAUT_DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
UMLAUT_BASES = {"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}


def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII letter plus marks, with that letter."""
    src, dst = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and parts[0].isascii():
                src.append(chr(code))
                dst.append(parts[0])
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1 is turned back; anything else stays as it is."""
    raw = F.encode(text, "ISO-8859-1").cast("string")
    repairable = text.rlike("[Ãâ€™]") & text.rlike(r"^[\x{00}-\x{FF}]*$")
    return F.when(repairable, F.coalesce(F.try_validate_utf8(raw), text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact_text(text: Column) -> Column:
    return squeeze(repair_mojibake(F.coalesce(text, F.lit(""))))


def _fold(text: Column, letters: dict[str, str]) -> Column:
    out = F.lower(text)
    for letter, spelled in letters.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    out = F.regexp_replace(F.translate(out, ACCENTED, UNACCENTED), r"\p{Mn}+", "")
    out = F.regexp_replace(out, r"(?U)[^a-z0-9\s]", " ")
    return squeeze(out)


def normalize_text(text: Column) -> Column:
    """Search form: lower case, ä as ae, no accents, only a-z, 0-9 and single blanks."""
    return _fold(F.coalesce(text, F.lit("")), UMLAUT_DIGRAPHS)


def normalize_search_text(text: Column) -> Column:
    return normalize_text(compact_text(text))


def base_vowel_text(text: Column) -> Column:
    """Second matching form, with ä as a."""
    return _fold(F.coalesce(text, F.lit("")), UMLAUT_BASES)


def words(text: Column) -> Column:
    """Non-empty words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def city_slug(city: Column) -> Column:
    out = F.regexp_replace(city, r"(?U)\s*\([^)]*\)", "")
    for separator in (" / ", "/", " - ", " "):
        out = F.replace(out, F.lit(separator), F.lit("-"))
    out = F.regexp_replace(out, r"(?U)[^\w\-]", "")
    return F.trim(F.regexp_replace(out, "-+", "-"), F.lit("-"))


def lenient_decimal(text: Column) -> Column:
    """Comma or dot decimal, null when it is neither."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def iso_day(text: Column) -> Column:
    """Calendar date as written in the first ten characters."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
