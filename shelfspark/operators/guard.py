"""Text guards, question routing, caller identity, origin checks and log retention.

The request limiter lives in :mod:`shelfspark.operators.rate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import _col, contains_any, fold, literal_pattern, trim_ws

MAX_INPUT_CHARS = 1000
MAX_OUTPUT_CHARS = 4000
RETENTION_DAYS = 30

# Marker and replacement texts.
CUT_MARKER = "\n\n…(odpověď byla zkrácena)"
FILTERED_TEXT = (
    "Omlouvám se, ale nemohu poskytnout tuto odpověď. Jak vám mohu pomoci s dotazem ohledně knihovny?"
)
# Wording of the instructions that must not leak, in any letter case.
LEAK_PHRASES = (
    "VÝBĚR FUNKCÍ", "BEZPEČNOSTNÍ PRAVIDLA", "ZAKÁZÁNO (strict)", "OCHRANA PROTI MANIPULACI", "tool_calls",
)
# Tool names, letter case as given.
LEAK_NAMES = (
    "getOpeningHours", "getContact", "getEvents", "getOfficeInfo", "searchCatalog", "recommendBooks",
    "findBookByPlot", "searchWebsite",
)
# Languages of a code fence, and markup that marks an answer as code.
CODE_LANGUAGES = (
    "html", "css", "javascript", "typescript", "python", "java", "cpp", "c#", "php", "ruby", "go", "rust", "sql",
    "bash", "shell", "powershell",
)
CODE_MARKUP = (r"<html[\s>]", r"<!doctype\s+html", r"<script[\s>]", r"<style[\s>]")

# Folded words that send a question to opening hours, to a branch, or to events.
HOURS_WORDS = (
    "oteviraci doba", "oteviraci", "otevira", "otevreno", "zavreno", "hodiny", "provozni doba", "provozni",
    "pracovni doba", "otevrit", "otevrena", "kdy ma", "kdy je", "doba pobocka", "pobocka",
)
BRANCH_WORDS = (
    "machnin", "rochlice", "vesec", "ruprechtice", "kraluvhaj", "kraluv haj", "kunraticka", "hlavni budova", "hlavni",
)
EVENT_WORDS = (
    "kurz", "kurzy", "workshop", "workshopy", "skoleni", "akce", "udalost", "udalosti", "prednaska", "prednasky",
    "koncert", "vystava", "vystavy", "cteni",
)
# Operations that need no origin.
EXEMPT_OPERATIONS = ("login", "heartbeat", "IntrospectionQuery", "Login", "Heartbeat")


def sanitize_text(c: Column | str) -> Column:
    """Control characters other than tab and line breaks removed, then trimmed."""
    return trim_ws(F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def split_oversized(df: DataFrame, col: str, max_chars: int = MAX_INPUT_CHARS) -> DataFrame:
    """Adds the sanitised text and whether it exceeds ``max_chars``."""
    return df.withColumn("clean_text", sanitize_text(col)).withColumn("too_long", F.length("clean_text") > max_chars)


def leaks_instructions(
    text: Column, phrases: tuple[str, ...] = LEAK_PHRASES, names: tuple[str, ...] = LEAK_NAMES
) -> Column:
    """Any phrase in any letter case, or any name as written. Plain substring tests, no regex."""
    lowered, hit = F.lower(text), F.lit(False)
    for phrase in phrases:
        hit = hit | lowered.contains(phrase.lower())
    for name in names:
        hit = hit | text.contains(name)
    return hit


def contains_code(
    text: Column, languages: tuple[str, ...] = CODE_LANGUAGES, markup: tuple[str, ...] = CODE_MARKUP
) -> Column:
    """A fence with a language, or page markup; the patterns only run where their first character occurs."""
    fence = text.contains("```") & text.rlike("(?i)```(?:" + "|".join(literal_pattern(x) for x in languages) + ")")
    return fence | (text.contains("<") & text.rlike("(?i)" + "|".join(markup)))


def guard_output(
    df: DataFrame,
    col: str,
    max_chars: int = MAX_OUTPUT_CHARS,
    leaks=leaks_instructions,
    code=contains_code,
    fallback: str = FILTERED_TEXT,
) -> DataFrame:
    """Cut over-long answers, replace leaking or code answers, and say why.

    ``leaks`` and ``code`` turn the cut text into a condition.
    """
    text = F.col(col)
    too_long = F.length(text) > max_chars
    cut = F.when(too_long, F.concat(F.substring(text, 1, max_chars), F.lit(CUT_MARKER))).otherwise(text)
    reason = (
        F.when(leaks(F.col("_cut")), "leak")
        .when(code(F.col("_cut")), "code")
        .when(F.length(col) > max_chars, "truncated")
    )
    checked = df.withColumn("_cut", cut).withColumn("reason", reason)
    blocked = F.col("reason").isin("leak", "code")
    return checked.withColumn(
        "answer", F.when(blocked, F.lit(fallback)).otherwise(F.col("_cut"))
    ).drop("_cut")


def route_queries(
    df: DataFrame,
    col: str,
    hours_words: tuple[str, ...] = HOURS_WORDS,
    branch_words: tuple[str, ...] = BRANCH_WORDS,
    event_words: tuple[str, ...] = EVENT_WORDS,
) -> DataFrame:
    """Where a question goes: opening hours (with the branch it names), events, or semantic search."""
    folded = df.withColumn("_folded", fold(sanitize_text(col), trim=False))
    text = F.col("_folded")
    branch = F.lit(None).cast("string")
    for word in reversed(branch_words):
        branch = F.when(text.contains(word), word).otherwise(branch)
    routed = folded.withColumn("branch", branch)
    route = (
        F.when(contains_any(text, hours_words) | F.col("branch").isNotNull(), "opening_hours")
        .when(contains_any(text, event_words), "events")
        .otherwise("semantic_search")
    )
    return routed.withColumn("route", route).drop("_folded")


def route_report(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def client_key(forwarded_for: Column | str, real_ip: Column | str) -> Column:
    """First forwarded address, else the real address, else 'unknown'."""
    forwarded, real = _col(forwarded_for), _col(real_ip)
    return (
        F.when(F.coalesce(forwarded, F.lit("")) != "", trim_ws(F.split_part(forwarded, F.lit(","), F.lit(1))))
        .when(F.coalesce(real, F.lit("")) != "", trim_ws(real))
        .otherwise("unknown")
    )


def allowed_origins(
    df: DataFrame,
    allowlist: list[str],
    exempt_operations: tuple[str, ...] = EXEMPT_OPERATIONS,
) -> DataFrame:
    """Judge (origin, referer, operation) rows: allowed or not, and the reason for a refusal.

    An entry admits itself and paths below it, never a host that merely starts with it.
    """
    source = F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.nullif(F.col("referer"), F.lit("")))
    plain = F.regexp_replace(source, r"/+$", "")
    admitted = F.lit(False)
    for entry in allowlist:
        root = entry.strip().rstrip("/")
        if root:
            admitted = admitted | (plain == root) | plain.startswith(root + "/")
    exempt = F.coalesce(F.col("operation"), F.lit("")).isin(*exempt_operations)
    reason = (
        F.when(exempt, F.lit(None).cast("string"))
        .when(source.isNull(), "missing origin")
        .when(~admitted, "invalid origin")
    )
    return df.withColumn("reject_reason", reason).withColumn("allowed", F.col("reject_reason").isNull())


def retain_days(df: DataFrame, ts: str, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``; a plain comparison, so it prunes date partitions."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col(ts) >= oldest)


def overwrite_expired(df: DataFrame, ts: str, as_of: str, path: str, days: int = RETENTION_DAYS) -> None:
    """Write the retained rows by day to a new folder; the caller swaps it in."""
    kept = retain_days(df, ts, as_of, days)
    kept.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(path)
