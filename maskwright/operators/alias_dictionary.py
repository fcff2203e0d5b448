"""Sequential aliases that outlive a run: a table of keys and numbers which later runs extend and never change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import discard

from .pseudonym import first_seen, global_rank

SCHEMA = "key string, number long"
FILE_ROWS = 2_000_000


@dataclass(frozen=True)
class AliasDictionary:
    """(key, number) as Parquet in the folder `path`, which all executors can reach; an alias is the prefix and the number in `digits` digits, or in as many as it needs beyond.

    A run adds the keys that the table lacks: they follow its largest number in the order of their first appearance in that run, keys of one place by value.  So a key keeps
    its number for ever, whatever comes later.  Null and empty keys have none.  One run may extend a dictionary at a time.  A run that dies while it adds keys leaves a dictionary
    that holds some of them; the others get numbers beyond the largest when they come again, so numbers stay unique, with gaps at most.

    The table holds the keys in clear: keep it where the salt is kept."""

    path: str
    prefix: str = "ID"
    digits: int = 4

    def table(self, spark: SparkSession) -> DataFrame:
        """The keys of all runs so far, none at first."""
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self.path)
        return spark.read.schema(SCHEMA).parquet(self.path)

    def extend(self, df: DataFrame, key: Column, order_col: str) -> DataFrame:
        """Gives every key of df that has no number yet the next one; the result is aliases().

        One shuffle for the distinct keys, one for the anti join and one for the ranks of new keys; only the largest number and a count of new keys come to the driver."""
        known = self.table(df.sparkSession)
        last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        fresh = global_rank(first_seen(df, key, order_col).join(known.select("key"), "key", "left_anti"), "first", "key")
        if n := fresh.count():
            fresh.select("key", (F.col("rank") + last).alias("number")).coalesce(-(-n // FILE_ROWS)).write.mode("append").parquet(self.path)
        discard(fresh)
        return self.aliases(df.sparkSession)

    def aliases(self, spark: SparkSession) -> DataFrame:
        """(key, alias) of all runs so far."""
        number = F.col("number").cast("string")
        return self.table(spark).select("key", F.concat(F.lit(f"{self.prefix}_"), F.lpad(number, F.greatest(F.lit(self.digits), F.length(number)), F.lit("0"))).alias("alias"))
