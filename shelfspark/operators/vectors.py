"""Nearest neighbours over vector columns, re-ranking, title enrichment, recommendations.

Exact search never forms item-query pairs in Spark: every task scores its own items against the
query block with one matrix product and passes on at most k rows per query. Query tables too
large for one block are spread over a grid of item parts and query blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.codes import Codebook
from shelfspark.functions.text import WS, WS_CHARS, contains_any, fold, trim_ws
from shelfspark.operators.search import DEFAULT_COUNT, catalog_search
from shelfspark.operators.skew import bounded_rows, first_per_key, top_per_key
from shelfspark.session import cut_lineage

MAX_QUERY_BLOCK = 1000
PART_BYTES = 1 << 26
BLOCK_BYTES = 1 << 24
QUERIES_PER_BLOCK = 2_000
QUERY_SLAB = 128
CODES_PER_PART = 200_000
CODEBOOK_SAMPLE = 16_384
SAMPLE_BYTES = 1 << 26
SLAB_BYTES = 1 << 25
DISTANCE_DIGITS = 9
OVERFETCH = 5
DEDUP_CHARS = 100
MAX_TITLE_WORDS = 12

# Url part, words the query must mention (any of them; none = always), boost; first hit counts.
URL_BOOSTS = (
    ("/kontakt", ("ředitel", "vedení"), 0.4),
    ("/sluzby/", (), 0.2),
    ("/pujcovani", (), 0.25),
    ("/vse-o-pujcovani", (), 0.3),
    ("/registrace", (), 0.2),
    ("/kontakt", (), 0.15),
    ("/knihovnici-doporucuji", (), -0.5),
    ("/tipy-ke-cteni", (), -0.5),
    ("/ctenarska-vyzva", (), -0.5),
)
# Request wording around a title, removed in this order.
REQUEST_PREFIXES = (
    r"^podobn[éá]\s+knih[yaou]\s+jako\s+",
    r"^knih[yaou]\s+podobn[éá]\s+",
    r"^doporuč(?:it|ení)?\s+(?:mi\s+)?(?:knih[yaou]\s+)?(?:podobn[éá]\s+)?(?:jako\s+)?",
    r"^něco\s+podobného\s+jako\s+",
    r"^hledám\s+(?:knih[yaou]\s+)?podobn[éá]\s+(?:jako\s+)?",
    r"^chci\s+(?:knih[yaou]\s+)?podobn[éá]\s+(?:jako\s+)?",
)
REQUEST_SUFFIXES = (r"\s+(?:podobn[éá]\s+)?knih[yaou]$", r"\s+doporuč(?:ení|it)?$")


def _distances(items: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Items x queries, in double precision, rounded so that equal vectors tie exactly."""
    dots = items @ queries.T
    if metric == "cosine":
        norms = np.linalg.norm(items, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - dots / norms
        out[norms == 0] = 1.0
    elif metric == "l2":
        out = (items**2).sum(axis=1)[:, None] - 2.0 * dots + (queries**2).sum(axis=1)[None, :]
    else:
        raise ValueError(f"unknown metric {metric}")
    return np.round(out, DISTANCE_DIGITS) + 0.0


def _nearest(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest, ties by id."""
    rows = np.arange(len(ids))
    if len(ids) > k:
        edge = np.partition(distances, k - 1)[k - 1]
        rows = rows[distances <= edge]
    return rows[np.lexsort((ids[rows], distances[rows]))][:k]


def _best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, metric: str):
    """(query number, ids, distances) per query for one block of items."""
    for first in range(0, len(queries), QUERY_SLAB):
        distances = _distances(vectors, queries[first : first + QUERY_SLAB], metric)
        for q in range(distances.shape[1]):
            rows = _nearest(ids, distances[:, q], k)
            yield first + q, ids[rows], distances[rows, q]


def _usable(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull() & (F.size(name) > 0))


def _result_type(items: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", items.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _scan(items: DataFrame, rows: list, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """One pass over the items against a block of queries; a running top k per task."""
    query_ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids = [np.empty(0, dtype=object)] * len(query_ids)
        kept_far = [np.empty(0)] * len(query_ids)
        for batch in batches:
            vectors = batch.column("vector")
            if not len(vectors):
                continue
            block = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
            ids = np.array(batch.column("id").to_pylist())
            for q, near, far in _best(ids, block, matrix, k, metric):
                near = np.concatenate([kept_ids[q].astype(near.dtype), near]) if len(kept_ids[q]) else near
                far = np.concatenate([kept_far[q], far])
                best = _nearest(near, far, k)
                kept_ids[q], kept_far[q] = near[best], far[best]
        out_query = [query_ids[q] for q in range(len(query_ids)) for _ in kept_ids[q]]
        if out_query:
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": out_query,
                    "id": [x.item() if hasattr(x, "item") else x for ids in kept_ids for x in ids],
                    "distance": np.concatenate(kept_far),
                },
                schema=arrow_schema,
            )

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    dim = matrix.shape[1]
    return items.filter(F.size("vector") == dim).select("id", "vector").mapInArrow(task, schema)


def _grid(items: DataFrame, queries: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """Top k per query within each vector size, for any number of items and queries.

    Inputs carry their size as ``bucket``. A bucket is cut into item parts and query blocks of bounded
    bytes by its measured counts; items repeat once per block and queries once per part.
    """
    bytes_held = F.count(F.lit(1)) * F.first("bucket") * 8
    parts = items.groupBy("bucket").agg(F.ceil(bytes_held / PART_BYTES).cast("int").alias("_parts"))
    blocks = queries.groupBy("bucket").agg(F.ceil(bytes_held / BLOCK_BYTES).cast("int").alias("_blocks"))
    shape = parts.join(blocks, "bucket")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def spot(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    left = items.join(shape, "bucket").select(
        "bucket", spot("id", "_parts").alias("part"), every("_blocks").alias("block"), "id", "vector"
    )
    right = queries.join(shape, "bucket").select(
        "bucket", every("_parts").alias("part"), spot("query_id", "_blocks").alias("block"), "query_id", "vector"
    )

    def cell(near: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if near.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        vectors = np.stack(near["vector"].to_numpy()).astype(np.float64)
        matrix = np.stack(asked["vector"].to_numpy()).astype(np.float64)
        asked_ids, found = asked["query_id"].to_numpy(), []
        for q, ids, far in _best(near["id"].to_numpy(), vectors, matrix, k, metric):
            found.append(pd.DataFrame({"query_id": asked_ids[q], "id": ids, "distance": far}))
        return pd.concat(found)

    keys = ["bucket", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def _top(items: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    items, queries = _usable(items, "vector"), _usable(queries, "vector")
    schema = _result_type(items, queries)
    rows = bounded_rows(queries.select("query_id", "vector"), MAX_QUERY_BLOCK)
    if rows is None:
        one = F.size("vector").alias("bucket")
        local = _grid(
            items.select(one, "id", "vector"), queries.select(one, "query_id", "vector"), k, metric, schema
        )
    elif not rows:
        local = items.sparkSession.createDataFrame([], schema)
    else:
        sizes = sorted({len(r["vector"]) for r in rows})
        local = None
        for size in sizes:
            part = _scan(items, [r for r in rows if len(r["vector"]) == size], k, metric, schema)
            local = part if local is None else local.unionByName(part)
    return top_per_key(local, ["query_id"], ["distance", "id"], k, "rank")


def knn(items: DataFrame, queries: DataFrame, k: int = DEFAULT_COUNT, metric: str = "cosine") -> DataFrame:
    """Exact k nearest items (id, vector) per query (query_id, vector): distance and rank.

    ``metric``: 'cosine' distance or 'l2' (squared).
    """
    return _top(items, queries, k, metric).withColumn("score", 1.0 - F.col("distance"))


def _fit_codebook(items: DataFrame, k: int, metric: str, dim: int, sample: int, seed: int) -> Codebook | None:
    """A codebook from a bounded sample of the vectors of one size; None where there are none."""
    usable = items.filter(F.size("vector") == dim)
    n_rows = usable.count()
    if n_rows == 0:
        return None
    most = max(k + 2, min(sample, SAMPLE_BYTES // (8 * dim)))
    drawn = usable.select("vector") if n_rows <= most else usable.select("vector").sample(most / n_rows, seed=seed)
    rows = [r["vector"] for r in drawn.limit(2 * most).collect()]
    return Codebook.fit(_placed(np.array(rows, dtype=np.float64), metric), n_rows, k, seed)


def _placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Unit vectors for cosine, whose squared distances order as the cosine does; a zero vector stays."""
    if metric != "cosine":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)


def _coded(items: DataFrame, book: Broadcast, metric: str, dim: int) -> DataFrame:
    """``(cell, id, code)`` of every item, a byte per segment in place of the vector."""

    @F.pandas_udf("cell int, code binary")
    def code(vectors: pd.Series) -> pd.DataFrame:
        cells, codes = [], []
        for i in range(0, len(vectors), QUERY_SLAB):
            block = _placed(np.stack(vectors.iloc[i : i + QUERY_SLAB].to_numpy()).astype(np.float64), metric)
            own, some = book.value.encode(block)
            cells += own.tolist()
            codes += [row.tobytes() for row in some]
        return pd.DataFrame({"cell": cells, "code": pd.Series(codes, dtype=object)})

    rows = items.filter(F.size("vector") == dim)
    return rows.select("id", code.asNondeterministic()("vector").alias("c")).select("c.cell", "id", "c.code")


def _probing(queries: DataFrame, book: Broadcast, metric: str, dim: int) -> DataFrame:
    """``(cell, query_id, vector)``: a query for each cell it looks into."""

    @F.pandas_udf("array<int>")
    def probe(vectors: pd.Series) -> pd.Series:
        block = _placed(np.stack(vectors.to_numpy()).astype(np.float64), metric)
        return pd.Series(list(book.value.cells_to_probe(block).astype(np.int32)), dtype=object)

    rows = queries.filter(F.size("vector") == dim)
    return rows.select(F.explode(probe.asNondeterministic()("vector")).alias("cell"), "query_id", F.col("vector").cast("array<double>").alias("vector"))


def _candidates(coded: DataFrame, probing: DataFrame, book: Broadcast, metric: str, schema: T.StructType) -> DataFrame:
    """The nearest codes of each query in each cell it looks into: at most ``refine`` a query and part of a cell.

    A cell is cut into parts of bounded size by its measured count, so a cell full of copies is shared by many tasks.
    """
    parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CODES_PER_PART).cast("int").alias("_parts"))
    blocks = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("_blocks"))
    shape = parts.join(blocks, "cell")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def spot(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    left = coded.join(shape, "cell").select("cell", spot("id", "_parts").alias("part"), every("_blocks").alias("block"), "id", "code")
    right = probing.join(shape, "cell").select(
        "cell", every("_parts").alias("part"), spot("query_id", "_blocks").alias("block"), "query_id", "vector"
    )

    def near_codes(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if codes.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        fitted, ids = book.value, codes["id"].to_numpy()
        own, packed = codes["cell"].to_numpy(), np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        matrix = _placed(np.stack(asked["vector"].to_numpy()).astype(np.float64), metric)
        asked_ids, found = asked["query_id"].to_numpy(), []
        slab = max(1, SLAB_BYTES // (8 * matrix.shape[1]))
        for i in range(0, len(ids), slab):
            vectors = fitted.decode(own[i : i + slab], packed[i : i + slab])
            for q, some, far in _best(ids[i : i + slab], vectors, matrix, fitted.refine, "l2"):
                found.append(pd.DataFrame({"query_id": asked_ids[q], "id": some, "distance": far}))
        return pd.concat(found)

    keys = ["cell", "part", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near_codes, schema)
    return top_per_key(near, ["query_id"], ["distance", "id"], book.value.refine)


def _exact_distance(metric: str) -> Callable[[str, str], Column]:
    @F.pandas_udf("double")
    def far(items: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(items), QUERY_SLAB):
            a = np.stack(items.iloc[i : i + QUERY_SLAB].to_numpy()).astype(np.float64)
            b = np.stack(asked.iloc[i : i + QUERY_SLAB].to_numpy()).astype(np.float64)
            dots = np.einsum("ij,ij->i", a, b)
            if metric == "cosine":
                norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                out.append(np.where(norms > 0, 1.0 - dots / np.where(norms > 0, norms, 1.0), 1.0))
            else:
                out.append((a**2).sum(axis=1) - 2.0 * dots + (b**2).sum(axis=1))
        return pd.Series(np.round(np.concatenate(out), DISTANCE_DIGITS) + 0.0)

    return far


def knn_approx(
    items: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_COUNT,
    metric: str = "cosine",
    sample: int = CODEBOOK_SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Approximate k nearest: compressed codes propose candidates, exact distances rank them.

    Coarse cells and codes of what a cell leaves over are fitted on at most about ``sample`` vectors; every item gets
    a code. A query looks into as many cells, and keeps as many candidates, as reach 98 % of the neighbours that the
    sample's own vectors have in it, so the recall holds for clustered and for evenly spread vectors. Only ids and
    codes are dealt over cells; the full vectors join once, for the candidates. Queries whose cells hold fewer than k
    items are searched exactly.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    items, queries = _usable(items, "vector"), _usable(queries, "vector")
    schema = _result_type(items, queries)
    sizes = [r[0] for r in queries.select(F.size("vector").alias("n")).distinct().collect()]
    near = None
    for dim in sorted(sizes):
        fitted = _fit_codebook(items, k, metric, dim, sample, seed)
        if fitted is None:
            continue
        book = items.sparkSession.sparkContext.broadcast(fitted)
        some = _candidates(_coded(items, book, metric, dim), _probing(queries, book, metric, dim), book, metric, schema)
        near = some if near is None else near.unionByName(some)
    if near is None:
        return knn(items, queries, k, metric)
    vectors = items.select("id", F.col("vector").alias("_item"))
    asked = queries.select("query_id", F.col("vector").alias("_asked"))
    both = near.select("query_id", "id").distinct().join(vectors, "id").join(asked, "query_id")
    exact_far = both.select("query_id", "id", _exact_distance(metric)("_item", "_asked").alias("distance"))
    ranked = exact_far.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    found = cut_lineage(top_per_key(ranked, ["query_id"], ["distance", "id"], k, "rank"))
    full = found.filter(F.col("rank") == k).select("query_id")
    exact = _top(items, queries.join(full, "query_id", "left_anti"), k, metric)
    return found.join(full, "query_id", "left_semi").unionByName(exact).withColumn("score", 1.0 - F.col("distance"))


def url_boost(url: Column, query: Column, boosts: tuple = URL_BOOSTS) -> Column:
    """Boost of the first rule whose url part and query words both match, else 0."""
    out = F.lit(0.0)
    for part, words, boost in reversed(boosts):
        hit = F.lower(url).contains(part)
        if words:
            hit = hit & contains_any(F.lower(query), words)
        out = F.when(hit, boost).otherwise(out)
    return out


def rerank(
    candidates: DataFrame, queries: DataFrame, limit: int = DEFAULT_COUNT, boosts: tuple = URL_BOOSTS
) -> DataFrame:
    """Drop repeats of (url, opening of the text), boost by url, sort by score, keep ``limit``.

    ``candidates``: query_id, id, url, text, distance (``limit`` x 5 or more per query).
    ``queries``: query_id, query_text.
    """
    opening = F.substring("text", 1, DEDUP_CHARS)
    unique = first_per_key(
        candidates.withColumn("_opening", opening), ["query_id", "url", "_opening"], ["distance", "id"]
    ).drop("_opening")
    scored = unique.join(queries.select("query_id", "query_text"), "query_id").withColumn(
        "score", 1.0 - F.col("distance") + url_boost(F.col("url"), F.col("query_text"), boosts)
    )
    return top_per_key(scored, ["query_id"], [F.desc("score"), "id"], limit, "rank")


def search_content(
    chunks: DataFrame, queries: DataFrame, limit: int = DEFAULT_COUNT, boosts: tuple = URL_BOOSTS
) -> DataFrame:
    """Nearest chunks by squared distance with five-fold over-fetch, then :func:`rerank`.

    ``chunks``: id, vector, url, text. ``queries``: query_id, query_text, vector.
    """
    near = _top(chunks.select("id", "vector"), queries, limit * OVERFETCH, "l2").select("query_id", "id", "distance")
    return rerank(near.join(chunks.drop("vector"), "id"), queries, limit, boosts)


def title_key(c: Column | str) -> Column:
    """Folded title without a trailing slash and punctuation, for matching titles."""
    out = F.regexp_replace(fold(c, trim=False), f"{WS}*/{WS}*$", "")
    out = F.regexp_replace(out, f"[^A-Za-z0-9_{WS_CHARS}]", "")
    return trim_ws(F.regexp_replace(out, f"{WS}+", " "))


def strip_request_phrasing(c: Column | str) -> Column:
    """The bare title of a 'books like …' request; unchanged when nothing would be left."""
    whole = trim_ws(c)
    out = whole
    for pattern in (*REQUEST_PREFIXES, *REQUEST_SUFFIXES):
        out = F.regexp_replace(out, "(?iu)" + pattern, "")
    out = trim_ws(out)
    return F.when(F.length(out) > 0, out).otherwise(whole)


def _enrichment() -> Column:
    described = F.nullif(F.col("description"), F.lit(""))
    themes = F.when(F.coalesce("subject", F.lit("")) != "", F.concat(F.lit("Témata: "), F.col("subject")))
    return F.nullif(F.concat_ws(". ", described, themes), F.lit(""))


def _first_title_match(hits: DataFrame, order: list) -> DataFrame:
    found, asked = F.col("_title_key"), F.col("_query_key")
    near = hits.filter(found.contains(asked) | asked.contains(found))
    first = first_per_key(near, ["query_id"], order)
    return first.select("query_id", F.col("title").alias("source_title"), _enrichment().alias("enriched"))


def enrich_title_queries(queries: DataFrame, books: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """Replace a title request by the description and subjects of the book it names.

    ``queries``: query_id, query. The catalogue decides first; ``nearest`` (query_id, rank, title,
    description, subject: the 3 nearest vectors) is the fallback. Queries over 12 words and
    queries without a match stay as they are, with a null source_title.
    """
    words = F.size(F.split(trim_ws("query"), f"{WS}+"))
    short = queries.filter(words <= MAX_TITLE_WORDS).select("query_id", strip_request_phrasing("query").alias("query"))
    keys = short.select("query_id", title_key("query").alias("_query_key"))
    hits = catalog_search(books, short, "TITLE", 5).join(keys, "query_id").withColumn("_title_key", title_key("title"))
    match = _first_title_match(hits, ["ord", "id"]).select(
        "query_id", F.col("source_title").alias("_t1"), F.col("enriched").alias("_e1")
    )
    joined = queries.join(match, "query_id", "left")
    if nearest is not None:
        close = nearest.join(keys, "query_id").withColumn("_title_key", title_key("title"))
        second = _first_title_match(close, ["rank"]).select(
            "query_id", F.col("source_title").alias("_t2"), F.col("enriched").alias("_e2")
        )
        joined = joined.join(second, "query_id", "left")
    else:
        joined = joined.withColumns({"_t2": F.lit(None).cast("string"), "_e2": F.lit(None).cast("string")})
    source = F.when(F.col("_e1").isNotNull(), F.col("_t1")).when(F.col("_e2").isNotNull(), F.col("_t2"))
    return joined.withColumns(
        {"enriched_query": F.coalesce("_e1", "_e2", "query"), "source_title": source}
    ).drop("_t1", "_e1", "_t2", "_e2")


def recommend(items: DataFrame, queries: DataFrame, k: int = DEFAULT_COUNT, metric: str = "cosine") -> DataFrame:
    """k nearest titles per query, without the title the query was built from.

    ``items``: id, vector, title. ``queries``: query_id, vector, source_title (null when none; one
    more neighbour is fetched when there is one).
    """
    near = _top(items.select("id", "vector"), queries.select("query_id", "vector"), k + 1, metric)
    titled = near.join(items.drop("vector"), "id").join(queries.select("query_id", "source_title"), "query_id")
    source = F.col("source_title")
    fetched = F.col("rank") <= k + F.when(source.isNotNull(), 1).otherwise(0)
    other = source.isNull() | ~F.coalesce(F.lower("title").contains(F.lower(source)), F.lit(False))
    kept = titled.filter(fetched & other).drop("rank")
    return top_per_key(kept, ["query_id"], ["distance", "id"], k, "rank")


def find_by_description(
    items: DataFrame, queries: DataFrame, k: int = DEFAULT_COUNT, metric: str = "cosine"
) -> DataFrame:
    """Nearest items to a described plot: plain :func:`knn`, joined with the item columns."""
    return knn(items.select("id", "vector"), queries, k, metric).join(items.drop("vector"), "id")


def index_profile(df: DataFrame, n: int = 5, preview_chars: int = 200) -> DataFrame:
    """The first ``n`` entries by id with a preview of the document, and the row count of the collection."""
    total = df.agg(F.count(F.lit(1))).scalar()
    first = df.orderBy("id").limit(n)
    return first.select("id", F.substring("document", 1, preview_chars).alias("preview"), total.alias("n_rows"))
