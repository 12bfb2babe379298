"""Titles seen by earlier batches of a harvest: a table in hash buckets with a Bloom filter in front of it.

Folders, below one for the settings: ``new`` and ``whole`` hold the keys as ``batch=…/bucket=…``, ``new_marks`` and
``whole_marks`` the filter as ``batch=…``. A batch writes its own keys to ``new``. Every ``every`` batches the keys of all
batches before are written together to ``whole``, so a batch reads one whole table and fewer than ``every`` small ones.
Which folders those are follows from the batch number alone, and a batch writes only folders of its own number: run again
after a failure, it reads and writes the same. Folders that a merged table replaced go one batch later, when no batch
can ask for them any more.

The filter is one 64-bit word per block: a key belongs to one block and sets four bits of its word. Words of different
batches are joined by ``bit_or``. A key whose bits are not all set is new; for the others the keys themselves decide, read
from the buckets that are asked for only. A filter too small for its keys costs reading, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import materialise, sized_side

BITS = 4


@dataclass(frozen=True)
class SeenTitles:
    """The table at ``folder``. The other settings belong to it: with other ones a later batch finds no table and fails."""

    folder: str
    buckets: int = 64
    blocks: int = 1 << 20
    every: int = 16

    def _path(self, kind: str, batch: int | None = None) -> str:
        root = f"{self.folder}/{self.buckets}-{self.blocks}-{self.every}/{kind}"
        return root if batch is None else f"{root}/batch={batch}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("title_key"), F.lit(self.buckets)).cast("int")

    def _marked(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with the block of each key and the bits it sets there."""
        hashed = F.xxhash64("title_key", F.lit(1))
        one = F.lit(1).cast("bigint")
        bits = F.lit(0).cast("bigint")
        for k in range(BITS):
            place = F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
            bits = bits.bitwiseOR(F.call_function("shiftleft", one, place))
        block = F.pmod(F.xxhash64("title_key", F.lit(2)), F.lit(self.blocks))
        return keyed.withColumn("_block", block).withColumn("_bits", bits)

    def _read(self, spark: SparkSession, kind: str, batch_id: int, merged: int) -> DataFrame:
        """Rows of all batches before ``batch_id``, of the keys (``""``) or of the filter (``"_marks"``): those of the
        table merged at batch ``merged`` and those of later batches."""
        schema = "block bigint, bits bigint" if kind else "title_key string, bucket int"
        paths = [self._path("new" + kind, b) for b in range(merged, batch_id)]
        if merged:
            paths.append(self._path("whole" + kind, merged))
        parts = [spark.read.schema(schema).parquet(p) for p in paths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _write_keys(self, keys: DataFrame, kind: str, batch_id: int) -> None:
        """``keys`` as one file per bucket."""
        keys.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            self._path(kind, batch_id)
        )

    def _merge(self, spark: SparkSession, batch_id: int) -> None:
        """Write the keys and the filter of all batches before ``batch_id`` as one table each."""
        merged = batch_id - self.every
        self._write_keys(self._read(spark, "", batch_id, merged), "whole", batch_id)
        words = self._read(spark, "_marks", batch_id, merged).groupBy("block").agg(F.bit_or("bits").alias("bits"))
        words.write.mode("overwrite").parquet(self._path("whole_marks", batch_id))

    def _drop_replaced(self, spark: SparkSession, merged: int) -> None:
        """Delete what the table merged at batch ``merged`` holds. That batch is done for good by now."""
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        old = [("new", b) for b in range(merged - self.every, merged)] + [("whole", merged - self.every)]
        for kind, batch in old:
            for name in (kind, f"{kind}_marks"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name, batch))
                path.getFileSystem(hadoop).delete(path, True)

    def unseen(self, keyed: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ``keyed`` (title_key, …) whose title no batch before ``batch_id`` had."""
        spark = keyed.sparkSession
        if batch_id == 0:
            return keyed
        if batch_id % self.every == 0:
            self._merge(spark, batch_id)
        elif batch_id > self.every and batch_id % self.every == 1:
            self._drop_replaced(spark, batch_id - 1)
        merged = batch_id - batch_id % self.every
        words = self._read(spark, "_marks", batch_id, merged).groupBy("block").agg(F.bit_or("bits").alias("bits"))
        asked = self._marked(keyed)
        met = asked.join(sized_side(words), asked["_block"] == words["block"], "left")
        maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))
        tested = materialise(met.withColumn("_maybe", maybe).drop("_block", "_bits", "block", "bits"), "tested")
        new, open_ = tested.where(~F.col("_maybe")), tested.where("_maybe")
        wanted = [r[0] for r in open_.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        seen = self._read(spark, "", batch_id, merged).where(F.col("bucket").isin(wanted)).select("title_key")
        return new.unionByName(open_.join(seen, "title_key", "left_anti")).drop("_maybe")

    def add(self, keyed: DataFrame, batch_id: int) -> None:
        """Note the titles of a batch; ``keyed`` should be a written table."""
        self._write_keys(keyed.select("title_key", self._bucket().alias("bucket")), "new", batch_id)
        words = self._marked(keyed.select("title_key")).groupBy(F.col("_block").alias("block"))
        words.agg(F.bit_or("_bits").alias("bits")).write.mode("overwrite").parquet(self._path("new_marks", batch_id))
