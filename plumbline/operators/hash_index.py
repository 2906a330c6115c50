"""A stored index of perceptual hashes, to which new images are compared before they are added.

The index is a table bucketed and sorted by the keys of ``dedup.near_hash_classes``. An addition is shuffled to its buckets and joined there: the old rows are read where they lie, never
shuffled, and a batch costs as much as it and what it meets. Rows are one for each hash, split and addition, with the number of files and the smallest id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.dedup import _masks, first_key, near_classes
from plumbline.sources.tables import keep

KEYS = ["key_index", "key"]


@dataclass(frozen=True)
class HashIndex:
    """``table`` in the session's catalog over the files in ``path``. The other settings are those it was made with."""

    table: str
    path: str
    id_type: str = "string"
    threshold: int = 4
    pieces: int = 8
    buckets: int = 64
    sides: tuple[str, str] = ("train", "val")

    def attach(self, spark: SparkSession) -> DataFrame:
        """The index, registered if this session does not know it yet; empty where there are no files."""
        columns = f"key_index int, key bigint, hash bigint, split string, n bigint, id {self.id_type}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet CLUSTERED BY (key_index, key) SORTED BY (key_index, key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return spark.table(self.table)

    def keyed(self, prints: DataFrame) -> DataFrame:
        """Rows of the index for ``prints``: ``id, split, hash``. Null hashes and other splits have none."""
        known = prints.where(F.col("hash").isNotNull() & F.col("split").isin(*self.sides))
        classes = known.groupBy("hash", "split").agg(F.count("*").alias("n"), F.min(F.col("id").cast(self.id_type)).alias("id"))
        masks = [F.col("hash").bitwiseAND(F.lit(m).cast("long")) for m in _masks(self.pieces, self.threshold)]
        return classes.select(F.posexplode(F.array(*masks)).alias(*KEYS), "hash", "split", "n", "id")

    def links(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """``train_hash, val_hash, distance, train_count, val_count, train_id, val_id`` across the splits between two sets of rows of the index."""
        # Names of the old side stay as they are in the table: a bucketed scan is known by its own columns.
        other = new.select(*(F.col(c).alias(f"_{c}") for c in [*KEYS, "hash", "n", "id"]), (F.col("split") == self.sides[0]).alias("_train"))
        met = old.join(other, (F.col("key_index") == F.col("_key_index")) & (F.col("key") == F.col("_key")))
        different, train = F.col("hash").bitwiseXOR(F.col("_hash")), F.col("split") == self.sides[0]
        # Distances come first: most rows of a key that meet are of one split, and a comparison of their texts costs more than one of bits.
        near = met.where((F.bit_count(different) <= self.threshold) & (train != F.col("_train")) & first_key(different, F.col("key_index"), self.pieces, self.threshold))
        side = lambda c, yes, no, name: F.when(train, F.col(yes)).otherwise(F.col(no)).alias(name)
        columns = [side(c, *pair, f"{n}_{c2}") for n, swap in (("train", False), ("val", True)) for c, c2 in (("hash", "hash"), ("n", "count"), ("id", "id")) for pair in [(f"_{c}", c) if swap else (c, f"_{c}")]]
        return near.select(*columns, F.bit_count(different).alias("distance"))

    def add(self, prints: DataFrame) -> DataFrame:
        """Compare ``prints`` with the index and with each other, then append them: the links that they bring, stored. A pair of hashes is there once for each addition that holds one of its
        sides; counts are those of the addition and of one earlier one, so sums over all links of a pair are not sums of files. Null ids count as files without an id."""
        old = self.attach(prints.sparkSession)
        new = keep(self.keyed(prints), "additions")
        one = {n: F.col("split") == s for s, n in zip(self.sides, ("train", "val"), strict=True)}
        counts = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long")).alias(f"{n}_count") for n, c in one.items()]
        classes = new.where("key_index = 0").groupBy("hash").agg(*counts, *(F.min(F.when(c, F.col("id"))).alias(f"{n}_id") for n, c in one.items()))
        within = near_classes(keep(classes, "hashes"), self.threshold)
        found = keep(self.links(new, old).unionByName(within), "links")
        new.repartition(self.buckets, *KEYS).write.mode("append").format("parquet").bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", self.path).saveAsTable(self.table)
        return found
