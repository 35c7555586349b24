"""Web pages -> links, visit order, chunks, chunk diffs and index maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import WS_LIST, computed_once, contains_any, trim_ws
from shelfspark.functions.urls import fetchable_url, normalize_url, resolve_links, url_origin
from shelfspark.operators.skew import first_per_key, with_matches
from shelfspark.session import cut_lineage, scratch_path, shuffled_over, write_bucketed
from shelfspark.sources.html_pages import decode_entities
from shelfspark.sources.keyed_store import KeyedStore

MIN_CHUNK_CHARS = 800
MAX_CHUNK_CHARS = 2000
MIN_VALID_CHARS = 100
MAX_PLAIN_ID_CHARS = 100
MAX_PAGE_TEXT = 4000
MIN_PAGE_TEXT = 20
SALTS = 4
EDGES_PER_BUCKET = 1_000_000

# Wording of chunk texts.
CONTINUED = " (pokračování)"
CUT_MARKER = "\n\n[…obsah zkrácen]"
# Recommendation urls and texts, navigation openings, boilerplate words.
RECOMMENDATION_URLS = ("/knihovnici-doporucuji", "/tipy-ke-cteni", "/ctenarska-vyzva")
RECOMMENDATION_TEXT = (
    "knihovníci doporučují", "tipy ke čtení", "čtenářská výzva", "kniha v našem katalogu", "autor:", "isbn",
)
PAGE_COUNT = "[0-9]+ stran"  # in lower case only
NAVIGATION_TEXT = (
    "(?:menu|navigace|breadcrumb)", "(?:přejít na|skip to|go to)", "(?:zobrazit|show|hide|skrýt)", "kategorie.*odebrat",
)
BOILERPLATE_WORDS = ("cookies", "gdpr", "ochrana osobních údajů")
SHORT_BOILERPLATE_CHARS = 500

# Parts of a page whose markup is not the page's own.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>"
# The value of the attribute href of an anchor, after any number of other attributes.
HREF = r"(?i)<a(?=\s)(?:\s+(?!href\b)[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*+\s+href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) edges to same-origin pages worth fetching."""
    shown = F.regexp_replace(F.col(html), HIDDEN, " ")
    quoted = F.array_distinct(F.regexp_extract_all(shown, F.lit(HREF), F.lit(1)))
    found = pages.select(normalize_url(url).alias("src"), F.explode(quoted).alias("_quoted"))
    hrefs = found.select("src", decode_entities(F.btrim("_quoted", F.lit("\"'"))).alias("href")).filter("href <> ''")
    resolved = resolve_links(hrefs, "href", "src", "dst")
    same = url_origin("dst") == url_origin("src")
    return resolved.filter(same & fetchable_url("dst")).select("src", "dst").distinct()


def reachable(
    edges: DataFrame, seeds: DataFrame, max_pages: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """Breadth-first visit order from the seeds: url and depth; all pages, or the first ``max_pages`` and
    those up to ``max_depth``.

    The edges are written once, dealt by a hash of page and salt, so a page with very many links lies in ``SALTS``
    buckets; the pages found are dealt by a hash of the page. A level joins the pages of the level before with the
    edges where these lie, and looks its pages up among those found where those lie: only the newly met pages
    are exchanged. The buckets of the edges grow in number with the rows of ``edges``, so none outgrows a task. What is
    written survives a lost executor, and the plan stays short. Within a level pages are taken in url order.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, mark = scratch_path(spark, "reach"), uuid.uuid4().hex
    links, found = f"reach_links_{mark}", f"reach_found_{mark}"
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = max(buckets, -(-edges.count() // EDGES_PER_BUCKET))
    known = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    try:
        with shuffled_over(spark, dealt):
            salted = known.select("src", salt, "dst").repartition(dealt, "src", "salt")
            write_bucketed(salted, links, f"{place}/links", dealt, "src", "salt")
        depth, seen = 0, 0
        met = seeds.select("url").distinct()
        while True:
            write_bucketed(met.select("url", F.lit(depth).alias("depth")), found, f"{place}/found", buckets, "url")
            spark.catalog.refreshTable(found)
            new = spark.table(found).filter(F.col("depth") == depth).count()
            seen += new
            if new == 0 or (max_pages is not None and seen >= max_pages) or (max_depth is not None and depth >= max_depth):
                break
            met = next_level(spark.table(links), spark.table(found), depth)
            depth += 1
    finally:
        for table in (links, found):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    ordered = spark.read.schema("url string, depth int").parquet(f"{place}/found").orderBy("depth", "url")
    return ordered if max_pages is None else ordered.limit(max_pages)


def next_level(links: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """``url`` of the pages linked from those of ``depth`` that are not found yet; no exchange of ``links`` or ``found``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    frontier = found.filter(F.col("depth") == depth).select(F.col("url").alias("src"), salts)
    met = links.join(frontier, ["src", "salt"]).select(F.col("dst").alias("url")).distinct()
    return met.join(found.select("url"), "url", "left_anti")


def _departments(sections: Column) -> Column:
    """Heading of the latest non-empty level-2 section up to each section."""
    def latest(_: Column, i: Column) -> Column:
        upto = F.slice(sections, 1, i + 1)
        heads = F.filter(upto, lambda s: (s["level"] == 2) & (trim_ws(s["content"]) != ""))
        return F.when(F.size(heads) > 0, F.element_at(heads, -1)["heading"])

    return F.transform(sections, latest)


def _sentences(content: Column, keep_tail: bool) -> Column:
    pattern = r"[^.!?]+[.!?]+|[^.!?]+$" if keep_tail else r"[^.!?]+[.!?]+"
    # A match ends in a terminator or with the trimmed content, so only its front can hold space.
    pieces = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    found = F.filter(F.transform(pieces, lambda s: F.ltrim(s, F.lit(WS_LIST))), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(content))


def _cut_points(sizes: Column, first: Column, later: Column, low: int, high: int) -> Column:
    """Positions at which a new chunk starts, from the sentence sizes and the two header sizes."""
    start = F.struct(
        F.array().cast("array<int>").alias("cuts"), first.cast("int").alias("filled"), F.lit(0).alias("at")
    )

    def step(acc: Column, n: Column) -> Column:
        flush = (acc["filled"] + n > high) & (acc["filled"] > low)
        return F.struct(
            F.when(flush, F.array_append(acc["cuts"], acc["at"])).otherwise(acc["cuts"]).alias("cuts"),
            (F.when(flush, later.cast("int")).otherwise(acc["filled"]) + n + 1).alias("filled"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["cuts"])


def chunk_sections(
    pages: DataFrame,
    min_chars: int = MIN_CHUNK_CHARS,
    max_chars: int = MAX_CHUNK_CHARS,
    keep_tail: bool = True,
    valid_only: bool = True,
    crawled_at: Column | None = None,
) -> DataFrame:
    """Chunks of every section, each with page and heading in front; long sections split on sentences.

    With ``crawled_at`` every chunk carries it as ``last_crawled``. The fold runs over sentence lengths and yields cut positions only; texts are put together
    once afterwards. No shuffle and one pass: a page is chunked where it is read.
    """
    contact = F.lower("url").contains("/kontakt")
    departments = F.when(contact, _departments(F.col("sections")))
    sections = (
        pages.withColumn("_departments", departments)
        .select("url", "path", "title", "_departments", F.posexplode("sections").alias("_i", "_s"))
        .select(
            "url", "path", "title", F.col("_i").alias("section_ord"), F.col("_s.heading").alias("heading"),
            F.col("_s.level").alias("level"), F.col("_s.content").alias("_raw"),
            F.get("_departments", F.col("_i")).alias("_department"),
        )
    )
    sections = computed_once(sections, {"content": trim_ws("_raw")}).drop("_raw").filter(F.col("content") != "")
    department = F.when(
        (F.col("level") == 3) & F.col("_department").isNotNull(),
        F.concat(F.lit("Oddělení: "), F.col("_department"), F.lit("\n")),
    ).otherwise("")
    prefix = F.concat(F.lit("Stránka: "), "title", F.lit("\nURL: "), "path", F.lit("\n"), department, F.lit("\n"))
    head = F.concat(F.col("_prefix"), F.col("heading"), F.lit("\n\n"))
    head_later = F.concat(F.col("_prefix"), F.col("heading"), F.lit(CONTINUED + "\n\n"))
    headed = sections.withColumn("_prefix", prefix).withColumn("_head", head).withColumn("_later", head_later)
    long = F.length("content") > max_chars
    split = computed_once(
        headed.withColumn("_long", long),
        {"_parts": F.when(long, _sentences(F.col("content"), keep_tail)).otherwise(F.array("content"))},
    )
    cuts = _cut_points(
        F.transform("_parts", lambda s: F.length(s)), F.length("_head"), F.length("_later"), min_chars, max_chars
    )
    split = (
        split.withColumn("_cuts", F.when(F.col("_long"), cuts).otherwise(F.array().cast("array<int>")))
        .withColumn("_starts", F.concat(F.array(F.lit(0)), F.col("_cuts")))
        .select("*", F.posexplode("_starts").alias("chunk_index", "_from"))
        .withColumn("_to", F.coalesce(F.get("_starts", F.col("chunk_index") + 1), F.size("_parts")))
    )
    body = F.array_join(F.slice("_parts", F.col("_from") + 1, F.col("_to") - F.col("_from")), " ")
    header = F.when(F.col("chunk_index") == 0, F.col("_head")).otherwise(F.col("_later"))
    split = computed_once(split, {"body": body})
    chunks = computed_once(split, {"text": trim_ws(F.concat(header, F.col("body")))}).filter(
        ~F.col("_long")
        | (F.col("chunk_index") < F.size("_cuts"))
        | (F.length("text") > F.length("_prefix") + F.length("heading") + 10)
    )
    if valid_only:
        chunks = chunks.filter(valid_chunk(F.col("url"), F.col("text"), F.col("body")))
    stamp = [] if crawled_at is None else [crawled_at.alias("last_crawled")]
    return chunks.select(
        "url", "section_ord", F.col("heading").alias("section_heading"), "chunk_index", "text",
        chunk_hash("text").alias("hash"), *stamp,
    )


def valid_chunk(url: Column, text: Column, content: Column | None = None) -> Column:
    """Long enough, no reading recommendation, no navigation, no short cookie notice."""
    lowered = F.lower(text)
    recommendation = contains_any(F.lower(url), RECOMMENDATION_URLS) | text.rlike("(?iu)" + "|".join(RECOMMENDATION_TEXT)) | text.rlike(PAGE_COUNT)
    navigation = (text if content is None else content).rlike("(?iu)^(?:" + "|".join(NAVIGATION_TEXT) + ")")
    notice = F.length(text) < SHORT_BOILERPLATE_CHARS
    for word in BOILERPLATE_WORDS:
        notice = notice & lowered.contains(word)
    return (F.length(text) >= MIN_VALID_CHARS) & ~recommendation & ~navigation & ~notice


def chunk_hash(text: Column | str) -> Column:
    return F.sha2(trim_ws(text), 256)


def chunk_key(url: Column | str = "url", heading: Column | str = "section_heading", index: Column | str = "chunk_index") -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.concat_ws("::", url, heading, index.cast("string"))


def chunk_id(key: Column) -> Column:
    """The key itself while short, else a digest of it."""
    return F.when(F.length(key) <= MAX_PLAIN_ID_CHARS, key).otherwise(F.concat(F.lit("hash_"), F.md5(key)))


def _last_per_key(chunks: DataFrame) -> DataFrame:
    return first_per_key(chunks.withColumn("key", chunk_key()), ["key"], [F.desc("ord")])


def diff_chunks(new: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per chunk key with its status and both versions.

    Inputs: url, section_heading, chunk_index, text, hash, ord; the highest ord wins per key.
    """
    sides = []
    for name, df in (("new", new), ("old", existing)):
        sides.append(
            _last_per_key(df).select(
                "key", F.struct("url", "section_heading", "chunk_index", "text", "hash", "ord").alias(name)
            )
        )
    joined = sides[0].join(sides[1], "key", "full_outer")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("new.hash").eqNullSafe(F.col("old.hash")), "changed")
        .otherwise("unchanged")
    )
    return joined.withColumn("status", status)


def chunks_to_add(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("added", "changed")).select("key", "new.*")


def chunks_to_remove(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("removed", "changed")).select("key", "old.*")


def dedup_by_hash(chunks: DataFrame) -> DataFrame:
    return first_per_key(chunks, ["hash"], ["ord"])


def apply_diff(index: DataFrame, to_add: DataFrame, to_remove: DataFrame) -> DataFrame:
    """The next version of the index: removals first, then additions. Rows are keyed by ``id``."""
    return index.join(to_remove.select("id").distinct(), "id", "left_anti").unionByName(to_add)


def refresh_index(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The next index from freshly crawled chunks: repeated texts count once, unchanged rows keep their age.

    Both: url, section_heading, chunk_index, text, hash, ord, last_crawled; the index also has ``id``. Of
    index rows that share an id the one with the highest ord counts, so the result has each id once.
    """
    order = ["url", "section_heading", "chunk_index", "text", "hash", "ord", "last_crawled", "id"]
    fresh = dedup_by_hash(chunks).withColumn("id", chunk_id(chunk_key()))
    latest = first_per_key(fresh, ["id"], [F.desc("ord")]).select(*order)
    current = first_per_key(index.select(*order), ["id"], [F.desc("ord"), "hash", "last_crawled"])
    kept = current.join(latest.select("id", "hash"), ["id", "hash"], "left_semi").select(*order)
    return kept.unionByName(latest.join(current.select("id", "hash"), ["id", "hash"], "left_anti"))


def refresh_store(store: KeyedStore, version: str, chunks: DataFrame) -> bool:
    """:func:`refresh_index` on a stored index: only rows that enter, change or go are written, with the buckets they lie in.

    ``store`` holds id, url, section_heading, chunk_index, text, hash, ord and last_crawled, keyed by id. Ids, hashes and
    ords alone are compared, once; the texts are joined to what enters.
    """
    named = chunks.withColumn("id", chunk_id(chunk_key()))
    once = first_per_key(named.select("id", "hash", "ord"), ["hash"], ["ord", "id"])
    latest = first_per_key(once, ["id"], [F.desc("ord"), "hash"]).withColumn("crawled", F.lit(True))
    known = store.read().select("id", F.col("hash").alias("known_hash"))
    same = F.coalesce(F.col("hash") == F.col("known_hash"), F.lit(False))
    changes = cut_lineage(latest.join(known, "id", "full_outer").filter(~same).select("id", "hash", "ord", "crawled"))
    entering, gone = changes.filter("crawled"), changes.filter("crawled IS NULL").select("id")
    batch = with_matches(named, entering, ["id", "hash", "ord"], "left_semi").select(*store.schema.fieldNames())
    return store.merge(version, batch, ["ord"], removed=gone, keys=entering.select("id"))


def run_metrics(pages: DataFrame, new: DataFrame, existing: DataFrame, diff: DataFrame) -> DataFrame:
    """Counters of one refresh: pages, chunks, averages, and what the diff changed."""
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    n_old = existing.agg(F.count(F.lit(1))).scalar()
    n_new = new.agg(F.count(F.lit(1))).scalar()
    status = F.col("status")
    counted = diff.agg(
        F.count_if(status.isin("added", "changed")).alias("added"),
        F.count_if(status.isin("removed", "changed")).alias("removed"),
        F.count_if(status == "unchanged").alias("unchanged"),
    )
    facts = counted.select(n_pages.alias("pages"), n_new.alias("chunks"), n_old.alias("existing"), "added", "removed", "unchanged")
    return facts.select(
        "pages", "chunks", "added", "removed", "unchanged",
        F.when(F.col("pages") > 0, F.col("chunks") / F.col("pages")).otherwise(0.0).alias("avg_chunks_per_page"),
        F.when(
            F.col("chunks") + F.col("existing") > 0,
            (F.col("added") + F.col("removed")) * 100.0 / (F.col("chunks") + F.col("existing")),
        ).alias("change_percent"),
    )


def page_text(c: Column | str) -> Column:
    """Tabs removed, long runs of line breaks shortened, trimmed; null when too short to be content."""
    raw = F.col(c) if isinstance(c, str) else c
    text = trim_ws(F.regexp_replace(F.replace(raw, F.lit("\t"), F.lit("")), r"\n{3,}", "\n\n"))
    return F.when(F.length(text) >= MIN_PAGE_TEXT, text)


def page_lookup(requests: DataFrame, pages: DataFrame, max_chars: int = MAX_PAGE_TEXT) -> DataFrame:
    """Text of each requested page (slug), cut with a marker; unknown or empty pages give an error row.

    ``requests``: request_id, slug. ``pages``: slug, title, content. The join strategy is left to
    the optimizer, because the page table may be of any size.
    """
    known = pages.select("slug", "title", page_text("content").alias("_text"), F.lit(True).alias("_known"))
    cut = F.when(
        F.length("_text") > max_chars, F.concat(F.substring("_text", 1, max_chars), F.lit(CUT_MARKER))
    ).otherwise(F.col("_text"))
    status = F.when(F.col("_known").isNull(), "unknown page").when(F.col("_text").isNull(), "no content").otherwise("ok")
    return requests.join(known, "slug", "left").select(
        "request_id", "slug", "title", status.alias("status"), cut.alias("content")
    )
