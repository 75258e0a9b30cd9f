"""SQL counterparts of the text expressions, used only to check results."""

from __future__ import annotations


def squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def norm_sql(text: str) -> str:
    out = f"lower({text})"
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = f"replace({out}, '{letter}', '{spelled}')"
    return squeeze_sql(f"regexp_replace(strip_accents({out}), '[^a-z0-9\\s]', ' ', 'g')")


def base_vowel_sql(text: str) -> str:
    out = f"lower({text})"
    for letter, spelled in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss")):
        out = f"replace({out}, '{letter}', '{spelled}')"
    return squeeze_sql(f"regexp_replace(strip_accents({out}), '[^a-z0-9\\s]', ' ', 'g')")
