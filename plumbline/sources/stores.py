"""Stored values of costly functions, keyed by content, that runs share and add to.

A store is a folder of appended parts, each a Parquet folder bucketed by the keys' hash.  Spark writes a part's
``_SUCCESS`` file last, when its job commits, and a part counts only with it: what a lost driver left half-written
is not seen.  Parts carry a generation; compaction writes all rows as one part of the next, from then on older
ones are not read, and deletes those.  Two runs that add the same key at once leave two rows, of which readers
take the one of the first part.

Stores are read as a bucketed table, so a join on the keys moves the other side only.  The table stands in the
session's catalog as ``plumbline_store_<hash of the folder>``; its files belong to the folder, not to the catalog.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sheets import Refusal


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return os.path.join(root, f"plumbline-{uuid.uuid4().hex}")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back; the files go when the application ends."""
    folder = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    files, place = _files(df.sparkSession, folder)
    files.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def stamp_of(model: str, size: int | None = None, overlap: int | None = None) -> str:
    """What values of one store must have in common: the model and, for windows of texts, their size and overlap."""
    return model if size is None else f"{model}|{size}:{overlap}"


def default_root(base: str, model: str, size: int, overlap: int) -> str:
    """A folder a stamp, so that two settings get two stores and neither is refused."""
    return f"{base}/{re.sub('[/:]', '-', model)}-{size}-{overlap}"


@dataclass(frozen=True)
class Store:
    """``keys`` and ``value`` as (name, type); see the module. ``Store.open`` checks or creates the folder."""

    spark: SparkSession
    root: str
    keys: tuple[tuple[str, str], ...]
    value: tuple[str, str]
    stamp: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, root: str, keys: dict[str, str], value: tuple[str, str], stamp: str, buckets: int = 16) -> Store:
        """The store in ``root``; one of another stamp or shape is refused by name, never mixed with."""
        store = cls(spark, root.rstrip("/"), tuple(keys.items()), value, stamp, buckets)
        about = {"stamp": stamp, "keys": list(map(list, keys.items())), "value": list(value), "buckets": buckets}
        files, place = _files(spark, f"{store.root}/_about")
        if not files.exists(place):
            spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{store.root}/_about")
        held = json.loads(spark.read.text(f"{store.root}/_about").first()[0])
        for name, own in about.items():
            if held[name] != own:
                raise Refusal(f"{store.root}: its {name} is {held[name]!r}, this run's is {own!r}; values of both must not mix")
        return store

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.keys]

    def parts(self) -> list[tuple[int, str]]:
        """(generation, name) of the committed parts, oldest first."""
        files, place = _files(self.spark, self.root)
        out = []
        for status in files.listStatus(place) if files.exists(place) else []:
            found = re.fullmatch(r"part=((\d{6})-[0-9a-f]+)", status.getPath().getName())
            if found and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append((int(found[2]), found[1]))
        return sorted(out)

    def live(self) -> list[str]:
        parts = self.parts()
        return [name for generation, name in parts if generation == parts[-1][0]]

    def read(self) -> DataFrame:
        """Keys and value of what is stored, a row a key."""
        spark, live = self.spark, self.live()
        columns = ", ".join(f"`{n}` {t}" for n, t in (*self.keys, self.value))
        if not live:
            return spark.createDataFrame([], columns.replace("`", ""))
        table = f"plumbline_store_{hashlib.md5(self.root.encode()).hexdigest()[:16]}"
        by = ", ".join(f"`{n}`" for n in self.names)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, part string) USING parquet PARTITIONED BY (part) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}'")
        known = {r[0].removeprefix("part=") for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
        for name in sorted(known - set(live)):
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (part='{name}')")
        for name in sorted(set(live) - known):
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (part='{name}') LOCATION '{self.root}/part={name}'")
        spark.catalog.refreshTable(table)
        return spark.table(table).groupBy(*self.names).agg(F.min_by(self.value[0], "part").alias(self.value[0]))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The distinct keys of ``wanted`` that are not stored."""
        return wanted.select(*self.names).distinct().join(self.read().select(*self.names), self.names, "left_anti")

    def append(self, rows: DataFrame, generation: int | None = None) -> None:
        """Add rows as one part, which is seen whole or not at all."""
        parts = self.parts()
        generation = (parts[-1][0] if parts else 0) if generation is None else generation
        name, table = f"{generation:06d}-{uuid.uuid4().hex}", f"plumbline_part_{uuid.uuid4().hex}"
        out = rows.select(*[F.col(n).cast(t).alias(n) for n, t in (*self.keys, self.value)]).repartition(self.buckets, *self.names)
        out.write.format("parquet").bucketBy(self.buckets, *self.names).sortBy(*self.names).option("path", f"{self.root}/part={name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay: their place was given

    def compact(self) -> None:
        """All rows in one part; run it while nobody reads, for the old files go."""
        old = self.parts()
        if not old:
            return
        self.append(self.read(), old[-1][0] + 1)
        for _, name in old:
            files, place = _files(self.spark, f"{self.root}/part={name}")
            files.delete(place, True)

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
        """Store ``compute`` of the keys that are missing, each once; (found, computed) in distinct keys.

        ``compute`` takes a table of keys and gives keys and value.  A run with nothing missing adds no part.
        """
        counts = wanted.select(*self.names).distinct().join(self.read().select(*self.names, F.lit(1).alias("_hit")), self.names, "left").agg(F.count("_hit"), F.count_if(F.col("_hit").isNull())).first()
        if counts[1]:
            self.append(compute(self.missing(wanted)))
        return counts[0], counts[1]
