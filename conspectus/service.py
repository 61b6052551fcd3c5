"""What the index answers and takes, as functions over a store: the surface behind the command line.

Results are DataFrames; changes go through the store's commits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions import text as T
from .operators import ingest, mining, paths, reports, search
from .sources import catalog
from .sources.store import Store


@dataclass
class Config:
    """Settings with their defaults."""

    page_limit: int = 100
    markers: tuple[str, ...] = tuple(L.MARKERS)
    path_length: int = 15


class Service:
    def __init__(self, store: Store, config: Config | None = None):
        self.store, self.config = store, config or Config()
        self.spark = store.spark

    # ---- what is asked

    def _page(self, page: int, limit: int) -> None:
        if page < 1 or not 1 <= limit <= self.config.page_limit:
            raise ValueError(f"a page is 1 at least, a limit 1 to {self.config.page_limit}")

    def names(self) -> DataFrame:
        """concept_id and the text to show."""
        return self.store.read("concepts").select("concept_id", T.display_name(F.col("representations")).alias("text"))

    def search(self, phrase: str, page: int = 1, limit: int = 20, language: str | None = None, least: float | None = None, types: list[str] | None = None, ratio: float | None = None) -> DataFrame:
        """A page of the ranked hits of a phrase; if none is found, of the phrase with synonyms."""
        self._page(page, limit)
        if ratio is not None and not 0 <= ratio <= 1:
            raise ValueError("a ratio is between 0 and 1")
        index, videos = self.store.read("search_index"), self.store.read("videos")
        asked = self.spark.createDataFrame([(1, phrase)], "query_id int, phrase string")
        posted = search.postings(index)
        options = {"language": language, "least": least, "types": types, "limit": 1000}
        hits = search.search(index, posted, asked, videos, **options)
        if hits.isEmpty():
            wider = asked
            for domain in L.SYNONYMS:
                wider = wider.unionByName(search.synonym_phrases(asked, search.synonym_table(self.spark, domain)))
            hits = search.search(index, posted, wider.distinct(), videos, **options)
        known = hits.join(videos.select("video_id", F.coalesce("ratio", F.lit(0.5)).alias("ratio")), "video_id")
        best = search.ranked(known, asked, ratio, language)
        return reports.page(best.select("place", "id", "item_type", "text", "title", "video_id", "significance", "score"), ["place"], page, limit)

    def concept(self, concept_id: str) -> DataFrame:
        """A concept with the names of its prerequisites and related concepts; those that are missing are marked."""
        own = self.store.read("concepts").filter(F.col("concept_id") == concept_id)
        both = F.array(F.struct(F.lit("prerequisite").alias("kind"), F.col("prerequisites").alias("ids")), F.struct(F.lit("related").alias("kind"), F.col("related").alias("ids")))
        links = own.select("concept_id", F.explode(both).alias("l")).select("concept_id", "l.kind", F.explode("l.ids").alias("id"))
        named = links.join(self.names().select(F.col("concept_id").alias("id"), "text"), "id", "left")
        shown = named.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("kind", "id", F.coalesce("text", F.lit("(missing)")).alias("text")))).alias("links"))
        return own.join(shown, "concept_id", "left")

    def occurrences(self, concept_id: str, limit: int = 10) -> DataFrame:
        """A concept's occurrences with the video's title and a time code, the most significant first."""
        o = self.store.read("occurrences").filter(F.col("concept_id") == concept_id).join(self.store.read("videos").select("video_id", "title"), "video_id")
        return o.orderBy(F.desc("significance"), "occurrence_id").limit(limit).select("video_id", "title", T.timecode(F.col("start_time")).alias("at"), "significance", T.shortened(F.col("context")).alias("context"))

    def video_concepts(self, video_id: str) -> DataFrame:
        o = self.store.read("occurrences").filter(F.col("video_id") == video_id)
        by = o.groupBy("video_id", "concept_id").agg(F.max("significance").alias("significance"), F.count("*").alias("n"))
        return by.withColumn("is_educational", F.col("significance") >= 2.5).join(self.names(), "concept_id", "left").orderBy(F.desc("significance"), "concept_id")

    def status(self, video_id: str) -> str:
        wanted = self.spark.createDataFrame([(video_id,)], "video_id string")
        return ingest.status_of(wanted, self.store.read("videos")).first()["status"]

    def _edges(self) -> tuple[DataFrame, DataFrame]:
        r = self.store.read("relationships").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relationship_type")
        of = lambda kind: r.filter(F.col("relationship_type") == kind).select("src", "dst")
        return of("prerequisite"), of("related")

    def learning_path(self, targets: list[str], most: int | None = None) -> DataFrame:
        needs, near = self._edges()
        requests = self.spark.createDataFrame([(0, t) for t in targets], "path_id int, id string")
        return paths.learning_paths(requests, self.names(), needs, near, most or self.config.path_length).orderBy("place")

    def find_path(self, source: str, target: str) -> list[str]:
        """The shortest way from one concept to another over related ones and prerequisites; empty without any."""
        c = self.store.read("concepts")
        ranked = lambda name, kind: c.select(F.col("concept_id").alias("src"), F.posexplode(name).alias("pos", "dst")).withColumn("kind", F.lit(kind))
        if c.filter(F.col("concept_id").isin(source, target)).count() < len({source, target}):
            return []
        rows = paths.concept_paths(ranked("related", 0).unionByName(ranked("prerequisites", 1)), source).filter(F.col("node") == target).select("path").collect()
        return rows[0]["path"] if rows else []

    def list_concepts(self, page: int = 1, limit: int = 20, language: str | None = None) -> DataFrame:
        self._page(page, limit)
        c = self.store.read("concepts")
        c = c if language is None else c.filter(F.map_contains_key("representations", language))
        created = F.coalesce(F.try_element_at("metadata", F.lit("created_at")), F.lit(""))
        return reports.page(c.withColumn("created_at", created), [F.desc("created_at"), "concept_id"], page, limit)

    def statistics(self) -> DataFrame:
        """Concepts, links and texts by category, and candidates by status."""
        by = catalog.statistics(self.store.read("concepts"))
        one = by.select("category", F.posexplode(F.array("concepts", "prerequisites", "related", "texts")).alias("k", "n"))
        names = F.element_at(F.array(*map(F.lit, ("concepts", "prerequisites", "related", "texts"))), F.col("k") + 1)
        counted = one.select(F.col("category").alias("group"), names.alias("figure"), F.col("n").cast("long").alias("n"))
        return counted.unionByName(self.store.read("candidates").groupBy(F.lit("candidates").alias("group"), F.col("status").alias("figure")).agg(F.count("*").alias("n")))

    # ---- what is changed

    def process(self, metadata: DataFrame, captions: DataFrame) -> DataFrame:
        """Process and index the videos that are not completed yet; returns a row of results for each."""
        todo = ingest.submitted(metadata, self.store.read("videos")).filter("status = 'accepted'").select("video_id")
        metadata, captions = metadata.join(todo, "video_id", "left_semi"), captions.join(todo, "video_id", "left_semi")
        c = self.store.read("concepts").select("concept_id", F.explode("representations").alias("language", "texts"), F.coalesce(F.try_element_at("metadata", F.lit("domain")), F.lit("unknown")).alias("domain"))
        names = c.select("concept_id", "language", F.explode("texts").alias("text"), "domain").filter(F.trim("text") != "")
        done = ingest.process(metadata, captions, names, list(self.config.markers))
        none = F.lit(None).cast("string")
        videos = done.videos.select("video_id", "title", none.alias("description"), none.alias("channel"), none.alias("publication_date"), F.lit(None).cast("int").alias("duration_seconds"), "language", "domain", "ratio", F.lit("completed").alias("processing_status"))
        segments = done.segments.select("segment_id", "video_id", "start_time", "text", "language", "educational_value")
        occ = done.occurrences.join(done.segments.select("segment_id", F.col("text").alias("context")), "segment_id")
        occ = occ.select(F.md5(F.concat_ws(":", "concept_id", "segment_id")).alias("occurrence_id"), "concept_id", "video_id", "segment_id", "start_time", "significance", "kind", "similarity", "context")
        fresh = done.candidates.join(done.videos.select("video_id", "language"), "video_id").withColumns({"concept_id": none, "rejection_reason": none, "segments": F.col("segments").cast("array<string>")})
        results = done.results.collect()  # a row for each video of the batch
        self.store.index_content(videos, segments, occ)
        self.store.commit({"candidates": catalog.upsert(self.store.read("candidates"), fresh.select(*self.store.read("candidates").columns), ["candidate_id"])})
        return self.spark.createDataFrame(results, done.results.schema)

    def _concepts(self, changed: DataFrame) -> None:
        self.store.commit({"concepts": changed, "representations": catalog.representations(changed), "relationships": catalog.relationships(changed)})

    def add_concept(self, concept_id: str, representations: dict[str, list[str]], category: str = "interdisciplinary", domain: str | None = None) -> bool:
        """A new concept, with one text at least; False where the id is taken."""
        if not any(t.strip() for texts in representations.values() for t in texts):
            raise ValueError("a concept has one text at least")
        c = self.store.read("concepts")
        if not c.filter(F.col("concept_id") == concept_id).isEmpty():
            return False
        row = (concept_id, representations, [], [], {"domain": domain} if domain else {}, category)
        self._concepts(catalog.add_concepts(c, self.spark.createDataFrame([row], c.schema)))
        return True

    def add_representation(self, concept_id: str, language: str, text: str) -> None:
        self._concepts(catalog.add_representation(self.store.read("concepts"), concept_id, language, text))

    def add_relationship(self, source: str, prerequisite: str | None = None, related: str | None = None) -> None:
        if (prerequisite is None) == (related is None):
            raise ValueError("name a prerequisite or a related concept")
        kind = "prerequisite" if related is None else "related"
        self._concepts(catalog.add_relationship(self.store.read("concepts"), source, prerequisite or related, kind))

    def edit_concept(self, concept_id: str, **change) -> None:
        """change: new_id, add_prerequisites, drop_prerequisites, add_related, drop_related, metadata, category."""
        kinds = "concept_id string, new_id string, add_prerequisites array<string>, drop_prerequisites array<string>, add_related array<string>, drop_related array<string>, metadata map<string,string>, category string"
        row = (concept_id, *(change.get(k.split(" ")[0]) for k in kinds.split(", ")[1:]))
        self._concepts(catalog.edit(self.store.read("concepts"), self.spark.createDataFrame([row], kinds)))

    def candidates(self, status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
        self._page(page, limit)
        return mining.list_page(self.store.read("candidates"), status, page, limit)

    def candidate(self, candidate_id: str) -> DataFrame:
        return self.store.read("candidates").filter(F.col("candidate_id") == candidate_id)

    def _review(self, candidate_id: str, to: str, reason: str | None = None) -> None:
        if self.candidate(candidate_id).isEmpty():
            raise ValueError(f"no candidate {candidate_id}")
        changes = self.spark.createDataFrame([(candidate_id, to, reason)], "candidate_id string, to string, reason string")
        kept = self.store.read("candidates").withColumnRenamed("rejection_reason", "was")
        out = mining.set_status(kept, changes).withColumn("rejection_reason", F.coalesce("rejection_reason", "was"))
        self.store.commit({"candidates": out})

    def reject(self, candidate_id: str, reason: str) -> None:
        self._review(candidate_id, "rejected", reason)

    def approve(self, candidate_id: str) -> str:
        """The candidate becomes a concept, with its occurrences; approving again changes nothing. Returns the concept's id."""
        self._review(candidate_id, "approved")
        own = self.candidate(candidate_id)
        concept = mining.approved_concepts(own)
        found = mining.candidate_occurrences(own, self.store.read("segments"))
        name = concept.first()["concept_id"]
        self._concepts(catalog.add_concepts(self.store.read("concepts"), concept))
        o = self.store.read("occurrences")
        rows = found.join(self.store.read("segments").select("segment_id", F.col("text").alias("context")), "segment_id")
        rows = rows.withColumn("occurrence_id", F.md5(F.concat_ws(":", "concept_id", "segment_id"))).select(*o.columns)
        marked = self.store.read("candidates").withColumn("concept_id", F.when(F.col("candidate_id") == candidate_id, name).otherwise(F.col("concept_id")))
        self.store.commit({"occurrences": catalog.upsert(o, rows, ["occurrence_id"]), "candidates": marked})
        return name

    def edit_candidate(self, candidate_id: str, text: str | None = None, domain: str | None = None) -> None:
        changes = self.spark.createDataFrame([(candidate_id, text, domain)], "candidate_id string, new_text string, new_domain string")
        self.store.commit({"candidates": mining.edit(self.store.read("candidates"), changes)})

    def delete_candidate(self, candidate_id: str) -> None:
        self.store.commit({"candidates": self.store.read("candidates").filter(F.col("candidate_id") != candidate_id)})

    def clear_cache(self) -> None:
        """Drop what the session holds in memory."""
        self.spark.catalog.clearCache()
