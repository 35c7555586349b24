"""The text functions written as DuckDB SQL, for the oracles only."""

from __future__ import annotations

from shelfspark.functions.text import MARKDOWN_RULES, WS, WS_CHARS, WS_LIST


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, kept: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(kept)}, '{flags}')"


def trim_ws(x: str) -> str:
    return f"trim({x}, {lit(WS_LIST)})"


def strip_accents(x: str) -> str:
    for char, plain in (("æ", "ae"), ("Æ", "Ae"), ("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L")):
        x = f"replace({x}, '{char}', '{plain}')"
    return f"strip_accents({x})"


def fold(x: str) -> str:
    return trim_ws(f"lower({strip_accents(x)})")


def ascii_only(x: str) -> str:
    return trim_ws(sub(x, r"[^\x00-\x7F]"))


def comparison_key(x: str) -> str:
    return trim_ws(sub(f"lower({x})", f"[^a-z0-9{WS_CHARS}]"))


def clean_title(x: str) -> str:
    return trim_ws(sub(x, f"{WS}*/{WS}*$"))


def strip_author_role(x: str) -> str:
    x = sub(x, rf"{WS}*\([^)]*\){WS}*")
    x = sub(x, rf",{WS}*[0-9]{{4}}-([0-9]{{4}})?{WS}*$")
    return trim_ws(sub(x, f",{WS}*$"))


def collapse_ws(x: str) -> str:
    return trim_ws(sub(x, f"{WS}+", " "))


def strip_markdown(x: str) -> str:
    for pattern, kept in MARKDOWN_RULES:
        kept = kept.replace("$1", "\\1").replace("$2", "\\2")
        x = sub(x, pattern, kept)
    return trim_ws(x)


def capitalise_words(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def present(x: str, missing: tuple[str, ...] = ("", "nan")) -> str:
    marks = ", ".join(lit(m) for m in missing)
    return f"({x} IS NOT NULL AND lower({trim_ws(x)}) NOT IN ({marks}))"
