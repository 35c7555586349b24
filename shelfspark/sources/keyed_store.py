"""A keyed table in the shared folder that takes batches without being rewritten as a whole.

Rows lie in folders by a hash of their key. A merge reads and rewrites the folders of the keys it names, into a
folder of its own version; what other versions hold stays where it is. A manifest, one row per bucket with
the folder that counts, is written last and is the commit: readers see the version before or the one
after, never a mixture, and a version that is sent again is left alone. Merges are applied one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.skew import first_per_key, groups_within
from shelfspark.session import path_exists, path_names

BUCKETS = 32
#: Tasks that write one bucket, at most; rows of one key in a batch that may meet in one task.
PARTS, MAX_REPEATS = 16, 1000
#: Of one key, a row of the batch counts before its removal, and that before the old row.
ENTERS, GOES, STAYS = 0, 1, 2
MANIFEST = "bucket int, folder string, number bigint"


class KeyedStore:
    """Rows of ``schema`` below ``path``, one for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self._key()), F.lit(self.buckets)).cast("int")

    def _key(self) -> Column:
        return F.col(f"`{self.key}`")

    def committed(self, version: str) -> bool:
        return path_exists(self.spark, f"{self.path}/manifest/{version}/_SUCCESS")

    def _manifest(self) -> tuple[dict[int, str], int]:
        """The folder of each bucket and the number of the latest commit; at most ``buckets`` rows."""
        versions = [v for v in path_names(self.spark, f"{self.path}/manifest") if self.committed(v)]
        if not versions:
            return {}, 0
        paths = [f"{self.path}/manifest/{v}" for v in versions]
        rows = self.spark.read.schema(MANIFEST).parquet(*paths)
        latest = rows.filter(F.col("number") == rows.agg(F.max("number")).scalar()).collect()
        return {r["bucket"]: r["folder"] for r in latest if r["bucket"] is not None}, latest[0]["number"]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(folders))

    def read(self) -> DataFrame:
        return self._rows(list(self._manifest()[0].values()))

    def touched(self, *keyed: DataFrame) -> list[int]:
        """Buckets of the keys in the given tables; at most ``buckets`` numbers."""
        found: set[int] = set()
        for df in keyed:
            found |= {r[0] for r in df.select(self.bucket().alias("b")).distinct().collect()}
        return sorted(found)

    def merge(self, version: str, batch: DataFrame, order: list | None = None, removed: DataFrame | None = None, keys: DataFrame | None = None) -> bool:
        """Remove the keys in ``removed``, then put the rows of ``batch`` in place of those with their keys; False if done.

        Of batch rows with one key the last in ``order`` (columns, ascending) holds. A null key is a key. ``keys`` are those of
        ``batch``, few rows each, where they are known without computing it. Rows of the batch, old rows and removed keys meet
        in one exchange, dealt as they are written.
        """
        if self.committed(version):
            return False
        names = self.schema.fieldNames()
        placed = [F.col(o).desc() if isinstance(o, str) else o for o in (order or names)]
        if keys is None:
            keys = batch.select(self.key)
            if not groups_within(keys, [f"`{self.key}`"], MAX_REPEATS):
                batch = first_per_key(batch, [self.key], placed)
        gone = None if removed is None else removed.select(self.key).distinct()
        folders, number = self._manifest()
        buckets = self.touched(keys) if gone is None else self.touched(keys.union(gone))
        rows = batch.select(*names, F.lit(ENTERS).alias("_kind"))
        old = [folders[b] for b in buckets if b in folders]
        if old:
            rows = rows.unionByName(self._rows(old).select(*names, F.lit(STAYS).alias("_kind")))
            if gone is not None:
                rows = rows.unionByName(gone.withColumn("_kind", F.lit(GOES)), allowMissingColumns=True)
        place = f"{self.path}/data/{version}"
        dealt = rows.withColumns({"_bucket": self.bucket(), "_part": F.pmod(F.xxhash64(F.lit("part"), self._key()), F.lit(PARTS))})
        last = first_per_key(dealt.repartition("_bucket", "_part"), ["_bucket", "_part", self._key()], ["_kind", *placed])
        last.filter(F.col("_kind") != GOES).select(*names, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(place)
        for b in buckets:
            folder = f"{place}/_bucket={b}"
            folders.pop(b, None)
            if path_exists(self.spark, folder):
                folders[b] = folder
        listed = [(b, f, number + 1) for b, f in folders.items()] or [(None, None, number + 1)]
        manifest = self.spark.createDataFrame(listed, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        return True

    def replace(self, version: str, rows: DataFrame, order: list | None = None) -> bool:
        """All rows anew, whatever was there."""
        return self.merge(version, rows, order, removed=self.read().select(self.key))
