"""The stored matches of my catalogue with other stores, kept up store by store.

The table is partitioned by store. After a crawl only the stores whose products changed are matched
anew, all of them if mine did, and their partitions alone are replaced, in one commit; files of other
stores are not touched. Each store that has been matched has a row without products, so that one that
lost its last match, or all of its products, replaces its partition too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators import matching
from shelfscope.sources import sinks

MATCH = "mine long, theirs long, method string, confidence long"


class MatchTable:
    """Matches by store at a path; limits are those of matching.match()."""

    def __init__(self, spark: SparkSession, path: str, store: str = "store", **limits: object):
        self.spark, self.path, self.store, self._limits = spark, path, store, limits

    def refresh(self, mine: DataFrame, theirs: DataFrame, changed: DataFrame | None = None) -> None:
        """Matches mine with theirs (with the store's name) anew: with all stores, or only with those
        in `changed`, which may have no products any more."""
        if changed is None:
            stores = theirs.select(self.store).distinct()
            if self._exists():  # also those that are gone
                stores = stores.unionByName(self.spark.read.parquet(self.path).select(F.col(self.store).cast(theirs.schema[self.store].dataType))).distinct()
        else:
            stores = changed.select(self.store).distinct()
            theirs = theirs.join(stores, self.store, "left_semi")
        found = matching.match(mine, theirs, by=(self.store,), **self._limits)
        marks = stores.select(self.store, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MATCH.split(", ")))
        sinks.replace_partitions(found.unionByName(marks), self.path, [self.store])

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def read(self) -> DataFrame:
        """(store, mine, theirs, method, confidence)."""
        return self.spark.read.parquet(self.path).where("mine IS NOT NULL").select(self.store, *(c.split()[0] for c in MATCH.split(", ")))

    def reconciler(self, mine: Callable[[], DataFrame], theirs: Callable[[], DataFrame], own: str, origin: str = "origin") -> Callable[[DataFrame], None]:
        """What merge_crawls() calls with the origins whose products changed. mine and theirs give the
        catalogues as they are then; own is the origin of mine."""

        def reconcile(moved: DataFrame) -> None:
            everything = not moved.where(F.col(origin) == own).isEmpty()
            changed = moved.where(F.col(origin) != own).select(F.col(origin).alias(self.store))
            self.refresh(mine(), theirs(), None if everything else changed)

        return reconcile
