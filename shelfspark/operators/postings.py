"""A stored index of three-character pieces: which texts contain a word, without reading the texts.

Every position of a text starts one piece of three characters; the end is padded, so a word of one or two
characters is found by the pieces that begin with it. The index is a ledger of batches. A batch holds
signed postings (field, piece, id) of texts that came and texts that went, and the signed number
of texts per piece. Both are partitioned by a hash of the piece, so a look-up reads the folders of
the pieces asked for only, and an update writes its own postings only.

A batch counts once its frequencies are complete; applying it again does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import path_exists, path_names

PIECE = 3
PAD = "\x03"
BUCKETS = 32
TEXTS_PER_TASK = 50_000
POSTINGS = "field string, piece string, id string, sign int, bucket int"
FREQUENCIES = "field string, piece string, n bigint, bucket int"


def pieces(text: Column) -> Column:
    """The distinct pieces of a text, one for each position."""
    padded = F.concat(text, F.lit(PAD * (PIECE - 1)))
    starts = F.sequence(F.lit(1), F.length(text))
    found = F.transform(starts, lambda i: F.substr(padded, i, F.lit(PIECE)))
    return F.when(F.length(text) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def word_pieces(words: Column) -> Column:
    """The pieces inside each word; a shorter word is its own."""
    starts = lambda w: F.sequence(F.lit(1), F.length(w) - (PIECE - 1))
    inside = lambda w: F.transform(starts(w), lambda i: F.substr(w, i, F.lit(PIECE)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= PIECE, inside(w)).otherwise(F.array(w)))))


class PostingIndex:
    """Postings below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("field", "piece"), F.lit(self.buckets)).cast("int").alias("bucket")

    def committed(self, batch: str) -> bool:
        return path_exists(self.spark, f"{self.path}/frequencies/{batch}/_SUCCESS")

    def batches(self) -> list[str]:
        return [b for b in path_names(self.spark, f"{self.path}/frequencies") if self.committed(b)]

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{b}") for b in self.batches()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _write(self, rows: DataFrame, table: str, batch: str) -> None:
        ordered = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "piece")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{batch}")

    def apply(self, batch: str, after: DataFrame, before: DataFrame | None = None) -> bool:
        """Commit texts ``(id, field, text)`` that hold from now on and those that no longer do; False if done before.

        A text that changes stands in both. Null and empty texts have no pieces. Repeated rows count as often as
        they stand.
        """
        if self.committed(batch):
            return False
        signed = after.select("id", "field", "text", F.lit(1).alias("sign"))
        if before is not None:
            signed = signed.unionByName(before.select("id", "field", "text", F.lit(-1).alias("sign")))
        # A table of a few MB is read by one task, but its pieces are many times as much.
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() // TEXTS_PER_TASK))
        signed = signed.repartition(tasks, "field", "id", "text")
        rows = signed.select("field", F.explode(pieces(F.col("text"))).alias("piece"), F.col("id").cast("string").alias("id"), "sign")
        self._put(batch, rows.select("field", "piece", "id", "sign", self._bucket()))
        return True

    def _put(self, batch: str, rows: DataFrame) -> None:
        self._write(rows, "postings", batch)
        stored = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings/{batch}")
        counts = stored.groupBy("bucket", "field", "piece").agg(F.sum("sign").cast("bigint").alias("n"))
        self._write(counts.filter("n <> 0").select("field", "piece", "n", "bucket"), "frequencies", batch)

    def postings(self) -> DataFrame:
        """``(field, piece, id, sign, bucket)`` as they stand over all batches; ``sign`` counts repeated rows."""
        signed = self._read("postings", POSTINGS)
        if len(self.batches()) < 2:
            return signed
        keys = ["bucket", "field", "piece", "id"]
        return signed.groupBy(*keys).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0").select("field", "piece", "id", "sign", "bucket")

    def frequencies(self) -> DataFrame:
        """``(field, piece, n, bucket)``: the number of texts with a piece."""
        counts = self._read("frequencies", FREQUENCIES).groupBy("bucket", "field", "piece").agg(F.sum("n").alias("n"))
        return counts.filter("n <> 0").select("field", "piece", "n", "bucket")

    def compact(self, path: str) -> PostingIndex:
        """All batches as one, in a new folder."""
        out = PostingIndex(self.spark, path, self.buckets)
        if not out.committed("compact"):
            out._put("compact", self.postings())
        return out

    def candidates(self, needles: DataFrame, words: str, keys: list[str]) -> DataFrame:
        """``keys`` and ``id`` of the texts that hold the rarest piece of each needle; verify them next.

        ``needles`` has the column ``field``, and in ``words`` an array of non-empty words. A text that holds all
        words holds all their pieces, so none is missed. ``keys`` with ``field`` identify a needle.
        """
        keyed = [k for k in keys if k != "field"]
        wanted = needles.select(*keyed, "field", F.explode(word_pieces(F.col(words))).alias("wanted"))
        known = self.frequencies().select("field", "piece", "n")
        exact = wanted.filter(F.length("wanted") >= PIECE).withColumn("piece", F.col("wanted"))
        heads = F.explode(F.array(*[F.substring("piece", 1, k) for k in range(1, PIECE)]))
        by_head = known.select("field", "piece", heads.alias("wanted")).distinct()
        short = wanted.filter(F.length("wanted") < PIECE).join(by_head, ["field", "wanted"])
        asked = exact.unionByName(short.select(*exact.columns))
        # A needle whose piece no text holds has no candidates, so the missing count must win.
        weighed = asked.join(known, ["field", "piece"], "left").groupBy(*keyed, "field", "wanted")
        spread = weighed.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list("piece").alias("heads"))
        none = wanted.groupBy(*keyed, "field").agg(F.count(F.lit(1)).alias("n_wanted"))
        rarest = spread.groupBy(*keyed, "field").agg(F.min(F.struct("n", "wanted", "heads")).alias("r"), F.count(F.lit(1)).alias("n_found"))
        same = [*keyed, "field"]
        complete = rarest.join(none, same).filter("n_found = n_wanted AND r.n > 0")
        anchors = complete.select(*same, F.explode("r.heads").alias("piece")).withColumn("bucket", self._bucket())
        held = self.postings().filter("sign > 0").select("bucket", "field", "piece", "id")
        found = held.join(anchors, ["bucket", "field", "piece"])
        return found.select(*same, "id").distinct()
