"""URL column expressions: normalising, resolving and judging crawl candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import _col, computed_once, contains_any

ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"

# Url parts that are never worth indexing.
IRRELEVANT_PARTS = (
    "/rss/", "/feed/", "/print/", "/export/", "/search/", "/login", "/logout", "/admin", "/api/",
    "?print=", "?share=", "/galerie/", "/fotogalerie/", "/knihovnici-doporucuji", "/tipy-ke-cteni",
    "/ctenarska-vyzva",
)
# Url parts that are kept at any depth.
IMPORTANT_PARTS = (
    "/sluzby/", "/pujcovani", "/vse-o-pujcovani", "/kontakt/", "/o-knihovne/", "/akce/", "/katalog/",
    "/vzdelavani/",
)
# Download paths and file endings that are not pages.
DOWNLOAD_PARTS = ("/getfile/", "/download/")
BINARY_ENDINGS = (
    "pdf", "jpg", "jpeg", "png", "gif", "webp", "svg", "mp4", "avi", "mov", "wmv", "flv", "mp3", "wav",
    "ogg", "m4a", "zip", "rar", "7z", "tar", "gz", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe",
    "dmg", "pkg", "deb", "rpm",
)


def url_origin(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), ORIGIN, 1))


def url_path(c: Column | str) -> Column:
    path = F.regexp_replace(F.regexp_replace(_col(c), r"(?s)[?#].*$", ""), ORIGIN, "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def normalize_url(c: Column | str) -> Column:
    """Drop query and fragment, lower-case scheme and host, drop default ports, '/' for no path."""
    return F.when(url_origin(c) == "", F.regexp_replace(_col(c), r"(?s)[?#].*$", "")).otherwise(
        F.concat(_without_default_port(url_origin(c)), url_path(c))
    )


def _without_default_port(origin: Column) -> Column:
    return F.regexp_replace(origin, r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")


def relevant_url(c: Column | str) -> Column:
    url = F.lower(_col(c))
    shallow = F.size(F.split(_col(c), "/")) <= 4
    return ~contains_any(url, IRRELEVANT_PARTS) & (contains_any(url, IMPORTANT_PARTS) | shallow)


def fetchable_url(c: Column | str) -> Column:
    url = F.lower(_col(c))
    binary = url.rlike(r"\.(" + "|".join(BINARY_ENDINGS) + ")$")
    return relevant_url(c) & ~contains_any(url, DOWNLOAD_PARTS) & ~binary


def _percent_encode(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch == " ", F.lit("%20"))
            .when(ch.rlike(r'[^\x21-\x7E]|["<>`{}]'), F.url_encode(ch))
            .otherwise(ch),
        ),
        "",
    )
    return F.when(path.rlike(r'[^\x21-\x7E]|["<>`{}]'), encoded).otherwise(path)


def _drop_dot_segments(path: Column) -> Column:
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(part == ".", acc)
        .otherwise(F.array_append(acc, part)),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(path)


def resolve_links(df: DataFrame, href: str, base: str, name: str) -> DataFrame:
    """Adds the absolute, normalised target of ``href`` on page ``base``; null for non-web targets.

    Built in steps, so that each step is computed once per row.
    """
    link = F.regexp_replace(F.trim(F.col(href)), r"(?s)[?#].*$", "")
    parts = df.withColumns(
        {"_link": link, "_origin": url_origin(base), "_folder": F.regexp_replace(url_path(base), r"[^/]*$", "")}
    )
    raw = F.col("_link")
    web = raw.rlike(r"(?i)^https?://")
    foreign = ~web & raw.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:")
    schemeless = F.concat(F.regexp_extract("_origin", r"^[^:]*:", 0), raw)
    full = F.when(raw.startswith("//"), schemeless).otherwise(raw)
    parts = parts.withColumns({"_full": full, "_absolute": web | raw.startswith("//"), "_foreign": foreign})
    origin = F.when(F.col("_absolute"), _without_default_port(url_origin("_full"))).otherwise(F.col("_origin"))
    path = (
        F.when(F.col("_absolute"), url_path("_full"))
        .when(raw == "", url_path(base))
        .when(raw.startswith("/"), raw)
        .otherwise(F.concat("_folder", raw))
    )
    parts = parts.withColumns({"_host": origin, "_path": path})
    parts = computed_once(parts, {"_clean": _drop_dot_segments(F.col("_path"))})
    target = F.when(~F.col("_foreign"), F.concat("_host", _percent_encode(F.col("_clean"))))
    return computed_once(parts, {name: target}).drop("_clean", "_link", "_origin", "_folder", "_full", "_absolute", "_foreign", "_host", "_path")
