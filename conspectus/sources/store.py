"""The stored index: tables in generations, changed together.

A change writes new tables beside the old ones and then replaces one small manifest by
a rename, so readers see all of a change or nothing of it, and a job that is lost half
way leaves the old state. Tables are Parquet; what an index of a database would serve
is done by their sort order and statistics.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

SCHEMAS = {
    "videos": "video_id string, title string, description string, channel string, publication_date string, duration_seconds int, language string, domain string, ratio double, processing_status string",
    "segments": "segment_id string, video_id string, start_time double, text string, language string, educational_value double",
    "concepts": f"{catalog.SCHEMA}, category string",
    "representations": "representation_id string, concept_id string, language string, text string, normalized_text string",
    "relationships": "source_id string, target_id string, relationship_type string",
    "occurrences": "occurrence_id string, concept_id string, video_id string, segment_id string, start_time double, significance double, kind string, similarity double, context string",
    "candidates": "candidate_id string, video_id string, text string, method string, score double, domain string, segments array<string>, rank int, status string, language string, concept_id string, rejection_reason string",
    "search_index": "id string, text string, language string, item_type string, video_id string, significance double",
}
SORTED = {"segments": ["video_id", "start_time"], "occurrences": ["video_id", "concept_id"], "search_index": ["video_id", "id"]}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def manifest(self) -> dict[str, str]:
        """Table name to folder."""
        path = self._path("manifest.json")
        if not path.getFileSystem(self.conf).exists(path):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest.json").collect()))

    def read(self, name: str) -> DataFrame:
        """A table; an empty one where none is stored yet."""
        folder = self.manifest().get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}")

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """Store all changed tables, then let the manifest name them."""
        now = self.manifest()
        for name, df in changes.items():
            now[name] = f"{name}-{uuid.uuid4().hex}"
            fields = [c.split(" ")[0] for c in SCHEMAS[name].replace("array<string>", "array").split(", ")]
            df.select(*fields).write.parquet(f"{self.root}/{now[name]}")
        text, fresh = json.dumps(now), self._path(f".manifest-{uuid.uuid4().hex}")
        out = fresh.getFileSystem(self.conf).create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.conf)
        option = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path("manifest.json"), option)

    def bootstrap(self) -> None:
        """All tables that are missing, empty."""
        have = self.manifest()
        missing = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in have}
        if missing:
            self.commit(missing)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self.commit({name: catalog.upsert(self.read(name), rows, keys)})

    def replace_segments(self, segments: DataFrame) -> None:
        """All segments of the given videos, in the table and in the index."""
        old = self.read("search_index").filter("item_type = 'segment'").join(segments.select("video_id").distinct(), "video_id", "left_anti")
        rest = self.read("search_index").filter("item_type <> 'segment'").unionByName(old)
        self.commit({"segments": catalog.replace_group(self.read("segments"), segments, "video_id"), "search_index": rest.unionByName(segment_entries(segments))})

    def upsert_concepts(self, concepts: DataFrame) -> None:
        """Concepts with their texts and links, derived anew."""
        every = catalog.upsert(self.read("concepts"), concepts, ["concept_id"])
        self.commit({"concepts": every, "representations": catalog.representations(every), "relationships": catalog.relationships(every)})

    def update(self, name: str, condition: str, values: dict[str, str]) -> int:
        """Set columns (SQL expressions) where a condition holds; returns how many rows changed."""
        df = self.read(name)
        n = df.filter(condition).count()
        if n:
            self.commit({name: df.withColumns({c: F.when(F.expr(condition), F.expr(e)).otherwise(F.col(c)) for c, e in values.items()})})
        return n

    def delete_videos(self, ids: list[str]) -> None:
        """Videos with their segments, occurrences and index rows."""
        self.commit({n: self.read(n).filter(~F.col("video_id").isin(ids)) for n in ("videos", "segments", "occurrences", "search_index")})

    def index_content(self, videos: DataFrame, segments: DataFrame, occurrences: DataFrame, indexed: float = 1.5) -> None:
        """Processed videos in place of what was stored of them, in one change.

        Occurrences without a stored concept or a segment of theirs are left out; those of at
        least ``indexed`` enter the search index in the language of their segment.
        """
        ids = videos.select("video_id")
        new = lambda name, rows: catalog.upsert(self.read(name), rows, ["video_id"])
        own = occurrences.join(ids, "video_id", "left_semi").join(self.read("concepts").select("concept_id"), "concept_id", "left_semi").join(segments.select("segment_id"), "segment_id", "left_semi")
        kind = F.when(F.col("significance") >= 2.5, "comprehensive").otherwise(F.col("kind"))
        own = own.withColumn("kind", kind)
        found = own.filter(F.col("significance") >= indexed).join(segments.select("segment_id", "language"), "segment_id", "left")
        entries = found.select(F.col("occurrence_id").alias("id"), F.col("context").alias("text"), F.coalesce("language", F.lit("en")).alias("language"), F.lit("occurrence").alias("item_type"), "video_id", "significance")
        old = self.read("search_index").join(ids, "video_id", "left_anti")
        changes = {
            "videos": new("videos", videos.withColumn("processing_status", F.lit("completed"))), "segments": self.read("segments").join(ids, "video_id", "left_anti").unionByName(segments),
            "occurrences": self.read("occurrences").join(ids, "video_id", "left_anti").unionByName(own.select(*self.read("occurrences").columns)),
            "search_index": old.unionByName(segment_entries(segments)).unionByName(entries),
        }
        self.commit(changes)

    def optimise(self, target_bytes: int = 128 << 20) -> dict[str, int]:
        """Rewrite each table in files of about ``target_bytes``, sorted for its readers; returns the rows of each."""
        counts, changes = {}, {}
        for name in self.manifest():
            df = self.read(name)
            folder = self._path(self.manifest()[name])
            size = folder.getFileSystem(self.conf).getContentSummary(folder).getLength()
            parts = max(1, -(-size // target_bytes))
            order = SORTED.get(name)
            changes[name] = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else df.repartition(parts)
            counts[name] = df.count()
        self.commit(changes)
        return counts

    def sweep(self) -> int:
        """Delete table folders that the manifest no longer names; for when no reader holds an old state."""
        live, root, n = set(self.manifest().values()), self._path(""), 0
        system = root.getFileSystem(self.conf)
        for status in system.listStatus(root):
            path = status.getPath()
            if status.isDirectory() and path.getName() not in live:
                system.delete(path, True)
                n += 1
        return n


def segment_entries(segments: DataFrame) -> DataFrame:
    """Index rows of segments."""
    return segments.select(F.col("segment_id").alias("id"), "text", F.coalesce("language", F.lit("en")).alias("language"), F.lit("segment").alias("item_type"), "video_id", F.col("educational_value").alias("significance"))


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """A parameterised SQL query over named tables: {name} in the text stands for a table, :name for a value."""
    return spark.sql(sql, args=values or None, **tables)
