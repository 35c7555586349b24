"""Near copies by similarity of word shingles, without comparing texts that only look alike.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of ``least`` or more.
Texts of the same words are one class from the start. Then the operator's SimHash finds what is closest, and the
rest is completed so that no link is lost:

0. Each class has the SimHash of its shingles. Fingerprints that differ in at most two bits meet by the covering masks of
   :mod:`shelfspark.llm.simhash`; the sets of those that meet are compared, and the links that hold join their classes before
   anything else is compared.
1. Similar texts may differ in more bits, so each class also has ``BANDS`` keys of ``ROWS`` min-wise hashes. A class that shares none is done: a pair of
   similarity 0.8 shares no key in 3 of a million cases, one of 0.9 in none of 10^12.
2. The sets of all others are written as hashes, and their shingles are counted. In the order of these counts, rarest
   first, two sets that are similar enough must share one of their first ``n - ceil(least n) + 1`` shingles
   (the prefix filter). A shingle of one class alone takes a place in the prefix but is no key. So texts of
   one template, whose common shingles are frequent and whose own words come first, do not meet.
3. Keys held by the same classes count once. In the bucket of a key, leaders drawn by hash from all but its largest
   component are compared with the members of other components. A bucket is settled when those who never led are one
   component, since every other pair has a leader in it. The number of leaders grows from round to round, so a large
   group of near copies closes after a few leaders, and a few strangers in it lead themselves.
4. Members whose sizes, numbers of shared shingles, places of the key or parities of hashed elements exclude the similarity
   do not meet; each of these bounds is exact. Two that share many keys meet in the first of them only. For the others the
   hashed sets are compared; a leader's set is sent once for a block of its pairs.

All links of step 2 on are exact. Tables written on the way are removed at the end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.components import components
from shelfspark.llm.scratch import beside, room, rows_per_batch, written
from shelfspark.llm.simhash import fingerprint_of, linked_fingerprints

SEED = 42
SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
LEADERS, MORE = 1, 8
PAIRS_PER_BLOCK = 256
KEYS_SEEN = 64
CHUNK = 1 << 12
MARKS = 8
FILTER_BITS = 24
BITMAP_BYTES = 4096
HASH_STEPS = 1 << 30
BATCH = 512
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
FACTORS, OFFSETS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def words_of(text: str | None) -> list[bytes]:
    """A-Z are lowered; words are runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def all_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles, repeats included; fewer words than a shingle are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    rows = zip(*(words[k:] for k in range(min(shingle, len(words)))), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(row), SEED) for row in rows), dtype=np.uint64)


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order."""
    return np.unique(all_hashes(words, shingle))


def keys_of(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK, None] * FACTORS + OFFSETS).min(axis=0))
    bands = [xxhash.xxh64_intdigest(band.tobytes(), SEED + k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(bands, dtype=np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; two empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def prefix_length(n: Column, least: float) -> Column:
    """How many elements of a set of ``n``, in a common order, must hold one that a similar set holds too."""
    return n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1


def copy_key(text: Column) -> Column:
    """Equal for texts of the same words, 128 bits."""

    @F.pandas_udf(T.BinaryType())
    def keyed(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_128_digest(b" ".join(words_of(x))) for x in texts], dtype=object)

    return keyed.asNondeterministic()(text)


def _prints(text: Column, shingle: int) -> Column:
    @F.pandas_udf("copy binary, fp bigint, keys array<bigint>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        copies, fps, keys = [], np.zeros(len(texts), np.uint64), []
        for k, text in enumerate(texts):
            words = words_of(text)
            hashes = all_hashes(words, shingle)
            copies.append(xxhash.xxh3_128_digest(b" ".join(words)))
            fps[k] = fingerprint_of(hashes)
            keys.append(keys_of(np.unique(hashes)))
        return pd.DataFrame({"copy": copies, "fp": fps.view(np.int64), "keys": keys})

    return printed.asNondeterministic()(text)


def parity(hashes: np.ndarray) -> list[int]:
    """``MARKS`` words of bits: one bit for each residue of the hashes, set where an odd number of them have it."""
    odd = np.bincount((hashes % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _hash_set(text: Column, shingle: int) -> Column:
    marks = ", ".join(f"m{k}: bigint" for k in range(MARKS))

    @F.pandas_udf(f"hashes array<bigint>, {marks}")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(words_of(x), shingle) for x in texts]
        out = pd.DataFrame([parity(s) for s in sets], columns=[f"m{k}" for k in range(MARKS)])
        out.insert(0, "hashes", pd.Series([s.view(np.int64) for s in sets], dtype=object))
        return out

    return hashed.asNondeterministic()(text)


def _place(copy: Column) -> Column:
    """The first ``FILTER_BITS`` bits of a digest as a number."""
    return F.conv(F.hex(F.substring(copy, 1, FILTER_BITS // 8)), 16, 10).cast("bigint")


def _known_places(few: DataFrame) -> np.ndarray:
    """A bit for every place that a digest in ``few`` has: 2^FILTER_BITS bits, however many digests there are."""
    places = few.select((_place(F.col("copy")) + 1).alias("at")).distinct()  # the bitmap functions number bits from 1 on
    words = places.groupBy(F.bitmap_bucket_number("at").alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in words.collect():
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        first = (row["of"] - 1) * BITMAP_BYTES
        out[first : first + len(bits)] = bits
    return out


def _copy_if_known(text: Column, known: Broadcast) -> Column:
    """The digest of a text, null where no wanted digest begins like it."""

    @F.pandas_udf(T.BinaryType())
    def keyed(texts: pd.Series) -> pd.Series:
        bits, out = known.value, []
        for text in texts:
            copy = xxhash.xxh3_128_digest(b" ".join(words_of(text)))
            at = int.from_bytes(copy[: FILTER_BITS // 8], "big")
            out.append(copy if bits[at >> 3] >> (at & 7) & 1 else None)
        return pd.Series(out, dtype=object)

    return keyed.asNondeterministic()(text)


def _close_prints(classes: DataFrame) -> DataFrame:
    """Pairs ``(lead, other)`` of classes whose fingerprints differ in at most two bits; pairs that are left out are connected
    by those that are given. One class stands for each fingerprint, and leads the others of the same."""
    firsts = written(classes.groupBy("fp").agg(F.min("cls").alias("lead")), "prints_first")
    same = classes.join(firsts, "fp").filter("cls <> lead").select("lead", F.col("cls").alias("other"))
    near = linked_fingerprints(firsts.select("fp"))
    of_a = firsts.select(F.col("fp").alias("a"), "lead")
    of_b = firsts.select(F.col("fp").alias("b"), F.col("lead").alias("other"))
    apart = near.join(of_a, "a").join(of_b, "b").select("lead", "other")
    return written(same.unionByName(apart).distinct(), "close")


def _sets_of_meeting(classes: DataFrame, close: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(cls, n, hashes, m0, ...)``: the shingle sets of the classes that share a min-wise key with another or have
    a close fingerprint.

    A filter of fixed size keeps most other texts out of the exchange before the exact join.
    """
    keyed = classes.select("cls", F.posexplode("keys").alias("band", "key"))
    ends = keyed.groupBy("band", "key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    meeting = keyed.join(ends.filter("low <> high").select("band", "key"), ["band", "key"], "left_semi").select("cls")
    meeting = meeting.union(close.select("lead")).union(close.select("other")).distinct()
    few = written(classes.select("cls", "copy").join(meeting, "cls"), "meeting")
    known = docs.sparkSession.sparkContext.broadcast(_known_places(few))
    likely = docs.select(_copy_if_known(F.col(text_col), known).alias("copy"), F.col(text_col).alias("text")).filter("copy IS NOT NULL")
    texts = likely.join(few.hint("merge"), "copy").groupBy("cls").agg(F.first("text").alias("text"))
    sets = texts.select("cls", _hash_set(F.col("text"), shingle).alias("s"))
    return written(sets.select("cls", F.size("s.hashes").alias("n"), "s.*"), "sets")


def _prefix_buckets(sets: DataFrame, least: float) -> DataFrame:
    """``(h, cls, n, f, p, most, m0, ...)``: the members of each bucket, one bucket for each distinct group of members.

    ``f`` of the ``n`` shingles of a class are another's too, and ``h`` is in place ``p`` of these. As no more than ``f`` can
    be shared, a similar set holds at most ``most`` shingles; who finds no partner of such a size in a bucket leaves it.
    """
    each = sets.select("cls", "n", F.explode("hashes").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    frequent = each.join(counts, "h").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("frequent"))
    alone = F.col("n") - F.size("frequent")
    budget = (prefix_length(F.col("n"), least) - alone).cast("int")
    sized = frequent.select("cls", "n", F.size("frequent").alias("f"), "frequent", budget.alias("budget")).filter("budget > 0")
    most = F.col("f") * F.lit((1 + least) / least) - F.col("n") + F.lit(1e-9)
    keyed = sized.select("cls", "n", "f", most.alias("most"), F.posexplode(F.slice("frequent", 1, F.col("budget"))).alias("p", "key"))
    prefix = written(keyed.select("key.h", "cls", "n", "f", "p", "most"), "prefix")
    ends = prefix.groupBy("h").agg(F.min("n").alias("smallest"), F.max("most").alias("largest"))
    fitting = prefix.join(ends, "h").filter("smallest <= most AND n <= largest").select(*prefix.columns)
    mark = [F.bit_xor(F.xxhash64("cls")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(SEED), "cls")).alias("m2")]
    groups = fitting.groupBy("h").agg(F.count(F.lit(1)).alias("held"), *mark).filter("held > 1")
    once = groups.groupBy("held", "m1", "m2").agg(F.min("h").alias("h"))
    marked = sets.select("cls", *[f"m{k}" for k in range(MARKS)])
    return written(fitting.join(once.select("h"), "h").join(marked, "cls"), "members")


def may_be_similar(least: float) -> Column:
    """Whether two members ``a`` and ``b`` of a bucket can be: what they share lies before, at and behind its key, and
    every bit in which their parities differ needs an element that only one of them has."""
    behind = F.least(F.col("a.f") - F.col("a.p"), F.col("b.f") - F.col("b.p")) - 1
    shared = F.least("a.p", "b.p") + 1 + behind
    enough = shared >= (F.col("a.n") + F.col("b.n")) * F.lit(least / (1 + least)) - F.lit(1e-9)
    differing = sum((F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(MARKS)), F.lit(0))
    close = differing <= (F.col("a.n") + F.col("b.n")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)
    return enough & close & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least) - F.lit(1e-9))


def _meetings(rooted: DataFrame, leads: DataFrame, least: float) -> DataFrame:
    """``(lead, other)`` of the leaders ``(h, cls)`` and the members of their buckets that are of other components.

    Whoever shares many keys with a leader would meet it in each of them. A leader's row names the keys below its own that it
    leads too, a member's row the keys that it holds, ``KEYS_SEEN`` of the smallest each; where one of these is common, the two have met
    there. The smallest common key always counts, so no pair is lost; keys that are not named can only repeat one.
    """
    smallest = F.slice(F.array_sort(F.collect_set("h")), 1, KEYS_SEEN)
    led = leads.groupBy("cls").agg(smallest.alias("led"))
    below = F.filter("led", lambda x: x < F.col("h"))
    first = rooted.join(leads, ["h", "cls"]).join(led, "cls").withColumn("below", below).drop("led")
    visited = rooted.join(leads.select("h").distinct(), "h", "left_semi")
    visited = visited.join(visited.groupBy("cls").agg(smallest.alias("held")), "cls")
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root"))
    met = first.alias("a").join(visited.alias("b"), apart & may_be_similar(least) & ~F.arrays_overlap("a.below", "b.held"))
    return met.select(F.col("a.cls").alias("lead"), F.col("b.cls").alias("other"))


def _compared(least: float) -> Callable:
    """Rows (lead, block, other, hashes) sorted so that a leader's own set, with a null ``other``, comes before the sets of
    its block of pairs; gives the pairs that are similar enough."""

    def compare(batches):
        lead, own = None, None
        for batch in batches:
            found = []
            for of, other, hashes in zip(batch["lead"], batch["other"], batch["hashes"], strict=True):
                if pd.isna(other):
                    lead, own = of, np.asarray(hashes)
                elif of == lead and similarity(own, np.asarray(hashes)) >= least:
                    found.append((of, int(other)))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return compare


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of the pairs ``(lead, other)`` whose sets are similar enough."""
    held = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_BLOCK).alias("blocks"))
    dealt = written(pairs.join(held, "lead").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks"))).drop("blocks"), "pairs")
    some = sets.select("cls", "hashes")
    others = dealt.join(some.withColumnRenamed("cls", "other"), "other").select("lead", "block", "other", "hashes")
    leaders = dealt.select("lead", "block").distinct().join(some.withColumnRenamed("cls", "lead"), "lead")
    rows = others.unionByName(leaders.select("lead", "block", F.lit(None).cast("bigint").alias("other"), "hashes"))
    in_order = rows.repartition("lead", "block").sortWithinPartitions("lead", "block", F.asc_nulls_first("other"))
    return written(in_order.mapInPandas(_compared(least), "a bigint, b bigint"), "alike")


def _links(sets: DataFrame, close: DataFrame, least: float) -> DataFrame:
    """``(id, root)`` of the classes that are linked to another: first those of close fingerprints, then all others."""
    edges, leaders = _alike(close, sets, least), LEADERS
    roots = components(edges)
    untried = members = _prefix_buckets(sets, least)
    while True:
        rooted = members.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        waiting = rooted.join(untried, ["h", "cls"], "left_semi")
        by_root = waiting.groupBy("h", "root").agg(F.count(F.lit(1)).alias("held"))
        shape = by_root.groupBy("h").agg(
            F.max_by("root", F.struct("held", "root")).alias("largest"), (F.sum("held") - F.max("held")).alias("others"), F.count(F.lit(1)).alias("roots")
        )
        waiting = waiting.join(shape.filter("roots > 1"), "h")
        draw = F.pmod(F.xxhash64("cls"), F.lit(HASH_STEPS)) * F.col("others") < F.lit(leaders * HASH_STEPS)
        leads = (F.col("root") != F.col("largest")) & ((F.col("others") <= leaders) | draw)
        drawn = written(waiting.select("h", "cls", leads.alias("leads")), "drawn")
        if drawn.isEmpty():
            return roots
        rooted = written(rooted.join(drawn.select("h").distinct(), "h", "left_semi"), "rooted")
        both = _meetings(rooted, drawn.filter("leads").select("h", "cls"), least)
        pairs = both.groupBy(F.least("lead", "other").alias("x"), F.greatest("lead", "other").alias("y")).agg(F.min("lead").alias("lead"))
        pairs = pairs.select("lead", F.when(F.col("lead") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("other"))
        alike = _alike(pairs, sets, least)
        edges = edges.unionByName(alike)
        roots = components(edges)
        members = rooted.drop("root")
        untried = written(drawn.filter(~F.col("leads")).select("h", "cls"), "untried")
        leaders *= MORE


def linked_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, copy)`` of every document, and ``(copy, first_id, root)`` of every class of equal words."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), _prints(F.col(text_col), shingle).alias("p"))
    prints = written(hashed.select("doc_id", "p.copy", "p.fp", "p.keys"), "prints")
    found = prints.groupBy("copy").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = written(found.withColumn("cls", F.monotonically_increasing_id()), "classes")
    close = _close_prints(classes.select("cls", "fp"))
    roots = _links(_sets_of_meeting(classes, close, docs, text_col, shingle), close, least)
    plain = classes.select("copy", "first_id", "cls")
    rooted = plain.join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    return prints.select("doc_id", "copy"), rooted.select("copy", "first_id", F.coalesce("root", "cls").alias("root"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST
) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, all columns kept.

    A group is what links connect. Texts without words are copies of each other. A null id is kept
    only where the whole group has none. An empty table gives no rows.
    """
    with room(docs.sparkSession), rows_per_batch(docs.sparkSession, BATCH):
        prints, rooted = linked_classes(docs, id_col, text_col, shingle, least)
        best = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "copy")
        kept = rooted.groupBy("root").agg(F.min(best).alias("best"))
        kept = written(kept.select(F.col("best.first_id").alias("kept_id"), F.col("best.copy").alias("kept_copy")), "kept", stays=True)
        ids_unique = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    same_id = F.col("id").eqNullSafe(F.col("kept_id"))
    if ids_unique:
        return beside(docs, id=F.col(id_col)).join(kept.hint("merge"), same_id, "left_semi").select("row.*")
    marked = beside(docs, id=F.col(id_col), copy=copy_key(F.col(text_col)))
    joined = marked.join(kept, same_id & (F.col("copy") == F.col("kept_copy")))
    return joined.dropDuplicates(["kept_id", "kept_copy"]).select("row.*")
