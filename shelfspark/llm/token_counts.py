"""Token counts kept by delta: additive totals by source, language and tokenizer version.

A ledger is a folder of two tables partitioned by batch. ``deltas`` holds the signed changes of single
documents: an insert adds, a delete takes away what is there, a revised count takes the old row away
and adds the new one. ``totals`` holds each batch's sums. Totals of all batches add up to the current
state, and a document's current row is the sum of its deltas. Deltas lie in folders by a hash of the id, so a
batch that names few documents reads only their folders; nothing is rewritten.

The totals of a batch are written last, in one commit: with its success mark the batch counts, before it
does not. A batch that is sent again after its commit is left alone; one that broke off is redone in
place. Batches must be applied one at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.bpe import ID_BYTES, encoder
from shelfspark.llm.scratch import written

INSERT, REVISE, DELETE = "insert", "revise", "delete"
KEY = ["doc_id", "source", "lang", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
BUCKETS = 16
DELTAS = "doc_id long, source string, lang string, tokenizer string, d_docs long, d_tokens long, bucket int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of ids of a byte-level BPE file; 0 for a null text."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        encode = encoder(tokenizer_path).encode
        return pd.Series([len(encode(x)) // ID_BYTES for x in texts], dtype="int64")

    return counted.asNondeterministic()(text)


class Ledger:
    """Totals below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/totals/batch={batch}/_SUCCESS")

    def batches(self) -> list[str]:
        """Committed batches."""
        folder = f"{self.path}/totals"
        if not self._exists(folder):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        names = [str(f.getPath().getName()).removeprefix("batch=") for f in found]
        return sorted(n for n in names if self.committed(n))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``: the sum over all batches; groups without documents go."""
        sums = self._read("totals", TOTALS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")

    def current(self, of: DataFrame | None = None) -> DataFrame:
        """Documents as they stand: ``doc_id, source, lang, tokenizer, n_tokens``; only the keys in ``of``, if given.

        Documents without an id cannot be named again and are left out.
        """
        deltas = self._read("deltas", DELTAS).filter("doc_id is not null")
        if of is not None:
            touched = [r["bucket"] for r in of.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            deltas = deltas.filter(F.col("bucket").isin(touched))
            named = of.select(*[F.col(k).alias(f"_{k}") for k in KEY])
            deltas = deltas.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]), "left_semi")
        sums = deltas.groupBy(*KEY).agg(F.sum("d_docs").alias("n"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n > 0").select(*KEY, "n_tokens")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes(doc_id, source, lang, tokenizer, op, n_tokens)``; False if the batch was committed before.

        A key is (doc_id, source, lang, tokenizer); a null source or language is a value of its own. Within a batch
        repeated rows of a key count once; of several inserts or revisions the one with the most tokens holds,
        and it outweighs a delete. Insert and revise set the key's row whether it is there or not; a delete of a key that is
        not there does nothing. Every inserted row with a null id is a document of its own, which no later change
        reaches. A null count is 0; other columns are ignored; an empty batch is a commit without changes.
        """
        if self.committed(batch):
            return False
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows = changes.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
            F.col("tokenizer").cast("string"), "op", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
        )
        one, sets = F.lit(1).cast("long"), F.col("op").isin(INSERT, REVISE)
        apart = F.col("doc_id").isNull() & (F.col("op") == INSERT)
        counted = rows.groupBy(*KEY).agg(
            F.max(F.when(sets, F.col("n_tokens"))).alias("v"), F.count_if(apart).alias("n"), F.sum(F.when(apart, F.col("n_tokens"))).alias("t")
        )
        wanted = written(counted.select(*KEY, bucket, "v", "n", "t"), "batch")
        known = wanted.filter("doc_id is not null")
        fresh = known.filter("v is not null").select(*KEY, one.alias("d_docs"), F.col("v").alias("d_tokens"), "bucket")
        nameless = wanted.filter("doc_id is null and n > 0").select(*KEY, F.col("n").alias("d_docs"), F.col("t").alias("d_tokens"), "bucket")
        deltas = fresh.unionByName(nameless)
        if self.batches():
            stale = self.current(known)
            deltas = deltas.unionByName(stale.select(*KEY, (-one).alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"), bucket))
        place = f"{self.path}/deltas/batch={batch}"
        deltas.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        sums = self.spark.read.schema(DELTAS).parquet(place).groupBy(*GROUP)
        totals = sums.agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        return True


def document_counts(docs: DataFrame, tokenizers: dict[str, str], op: str = INSERT) -> DataFrame:
    """Changes for every document and tokenizer version (name to file)."""
    each = [
        docs.select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), F.lit(op).alias("op"), token_count(F.col("text"), path).alias("n_tokens"))
        for name, path in tokenizers.items()
    ]
    return reduce(DataFrame.unionByName, each)
