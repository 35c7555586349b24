"""Column expressions for text. Everything here stays inside JVM code generation.

``WS`` spells out the Unicode white-space class so that the same pattern text means the
same characters in Java and in RE2 (whose ``\\s`` is ASCII only).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS_CHARS = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"
# The same class as a plain character list, for trimming without a regex.
WS_LIST = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters read as values.

    A filter on a plain projected column is pushed below it by copying the expression into every
    place the filter mentions it; a generated column stops that for costly expressions.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one base letter plus combining marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", char) if not 0x300 <= ord(x) <= 0x36F)
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    # Letters without a decomposition that still map to one ASCII letter.
    source += ["ø", "Ø", "ł", "Ł"]
    target += ["o", "O", "l", "L"]
    # translate() deletes source characters that have no target: free-standing marks.
    source += [chr(code) for code in range(0x300, 0x370)]
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WS_LIST))


def strip_accents(c: Column | str) -> Column:
    """Letters without diacritics. Pure ASCII text, told by its byte length, is passed through."""
    col = _col(c)
    out = col
    # Ligatures that become two letters.
    for char, plain in (("æ", "ae"), ("Æ", "Ae"), ("ß", "ss")):
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(F.translate(out, ACCENTED, PLAIN))


def fold(c: Column | str, lower: bool = True, trim: bool = True) -> Column:
    out = strip_accents(c)
    if lower:
        out = F.lower(out)
    return trim_ws(out) if trim else out


def ascii_only(c: Column | str) -> Column:
    return trim_ws(F.regexp_replace(_col(c), r"[^\x00-\x7F]", ""))


# What a comparison key drops of the first letter blocks.
KEY_DROPS = "".join(c for c in map(chr, range(0x250)) if not ("a" <= c <= "z" or "0" <= c <= "9" or c in WS_LIST))


def comparison_key(c: Column | str) -> Column:
    """Lower-case a-z, digits and white space. The pattern is run only where a text still holds other alphabets after
    the letters of :data:`KEY_DROPS` went one by one, and tries the common letters first."""
    few = F.translate(F.lower(_col(c)), KEY_DROPS, "")
    rest = F.regexp_replace(few, rf"[[^a-z0-9 ]&&[^{WS_CHARS}]]", "")
    return trim_ws(F.when(F.octet_length(few) == F.length(few), few).otherwise(rest))


def clean_title(c: Column | str) -> Column:
    return trim_ws(F.regexp_replace(_col(c), f"{WS}*/{WS}*$", ""))


def strip_author_role(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), rf"{WS}*\([^)]*\){WS}*", "")
    out = F.regexp_replace(out, rf",{WS}*[0-9]{{4}}-([0-9]{{4}})?{WS}*$", "")
    return trim_ws(F.regexp_replace(out, f",{WS}*$", ""))


def collapse_ws(c: Column | str) -> Column:
    return trim_ws(F.regexp_replace(_col(c), f"{WS}+", " "))


# Markdown constructs and what is left of them, applied in this order.
MARKDOWN_RULES = (
    (r"\*\*\[([^\]]*)\]\(([^)]*)\)\*\*", "$1 ($2)"),
    (r"\[([^\]]*)\]\(([^)]*)\)", "$1 ($2)"),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"(?m)^#{1,6}" + WS + "+", ""),
    (r"(?m)^[-•]" + WS + "*", "- "),
    (r"\n{3,}", "\n\n"),
)


def strip_markdown(c: Column | str) -> Column:
    out = _col(c)
    for pattern, kept in MARKDOWN_RULES:
        out = F.regexp_replace(out, pattern, kept)
    return trim_ws(out)


def tokens(c: Column | str, min_len: int = 2) -> Column:
    return F.filter(F.split(_col(c), f"[{WS_CHARS},]+"), lambda t: F.length(t) >= min_len)


def capitalise_words(c: Column | str) -> Column:
    """First letter of every space-separated word upper-cased, the rest untouched."""
    return F.array_join(
        F.transform(
            F.split(_col(c), " "),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
        ),
        " ",
    )


def missing_to_null(c: Column | str, missing: tuple[str, ...] = ("", "nan", "none")) -> Column:
    """Null for null and for any text that is a missing marker once trimmed and lower-cased.

    Anchored, so a long text is judged by its first characters.
    """
    col = _col(c)
    marker = "|".join(literal_pattern(m) for m in missing)
    return F.when(~col.rlike(f"(?iu)^{WS}*(?:{marker}){WS}*\\z"), col)


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """One alternation instead of one scan per word."""
    return c.rlike("|".join(literal_pattern(w) for w in words)) if words else F.lit(False)


def literal_pattern(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in text)


_FOLD_TABLE = {ord(a): b for a, b in zip(ACCENTED, PLAIN, strict=False)} | {
    **{code: None for code in range(0x300, 0x370)},
    **{ord(a): b for a, b in (("æ", "ae"), ("Æ", "Ae"), ("ß", "ss"))},
}


def fold_text(text: str) -> str:
    """:func:`fold` for a literal parameter."""
    return text.translate(_FOLD_TABLE).lower().strip(WS_LIST)
