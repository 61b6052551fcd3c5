"""From transcripts to an index: all videos of a batch in one job.

A video that cannot be processed is a row with its reason, and does not touch the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import extraction, mining, transcripts


@dataclass
class Processed:
    videos: DataFrame
    segments: DataFrame
    occurrences: DataFrame
    concepts: DataFrame
    candidates: DataFrame
    results: DataFrame


def analysed(metadata: DataFrame, captions: DataFrame, markers: list[str], keywords: dict[str, list[str]], theory: list[str], practice: list[str]) -> tuple[DataFrame, DataFrame]:
    """Videos with language, domain and ratio, and their segments with value. captions: video_id, pos, start, duration, text."""
    captions = captions.select("video_id", "pos", "start", "duration", "text")
    full = transcripts.full_text(captions)
    known = full.select("video_id", T.language(F.col("text")).alias("language"), T.keyword_domain(F.col("text"), keywords).alias("domain"), F.round(T.indicator_ratio(F.col("text"), theory, practice), 6).alias("ratio"))
    videos = metadata.select("video_id", "title").join(known, "video_id")
    some = captions.filter(F.trim("text") != "").join(known.select("video_id", "language", "domain"), "video_id")
    text = F.when(F.col("language") == "ru", T.normalise_russian(F.col("text"))).otherwise(T.normalise_transcript(F.col("text")))
    value = F.when(F.col("language") == "ru", T.educational_value_ru(F.col("text"))).otherwise(T.educational_value(F.col("text"), markers))
    cleaned = some.withColumn("text", text)
    return videos, cleaned.select(F.concat_ws("-", F.col("video_id").cast("string"), F.col("pos").cast("string")).alias("segment_id"), "video_id", "pos", F.col("start").alias("start_time"), "text", "language", "domain", F.round(value, 6).alias("educational_value"))


def process(metadata: DataFrame, captions: DataFrame, catalogue: DataFrame, markers: list[str] | None = None, keywords: dict[str, list[str]] | None = None, theory: list[str] | None = None, practice: list[str] | None = None, groups: dict[str, str] | None = None, terms: dict[str, list[str]] | None = None) -> Processed:
    """Segments, occurrences, concepts, new candidates and a result of each video of a batch.

    metadata: video_id, title; captions: video_id, pos, start, duration, text; catalogue:
    concept_id, text, language, domain. A video without captions is an error.
    """
    markers = markers or L.MARKERS
    videos, segments = analysed(metadata, captions, markers, keywords or L.DOMAIN_KEYWORDS["en"], theory or L.THEORETICAL["en"], practice or L.PRACTICAL["en"])
    found = extraction.matches(segments, catalogue)
    occ = extraction.occurrences(segments, catalogue, found, markers, terms, groups)
    concepts = extraction.concepts_of(occ)
    weighed = mining.weighted_terms(segments, ["video_id"], "segment_id")
    raw = weighed.join(videos.select("video_id", "domain"), "video_id").select("video_id", F.col("term").alias("text"), F.lit("tfidf").alias("method"), F.col("score").alias("base"), "domain", F.col("rank").alias("seq"), F.lit(None).cast("string").alias("segment"))
    candidates = mining.new_candidates(raw, catalogue.select(T.collapse(F.col("text")).alias("known")).distinct(), mining.key_terms(captions))
    per = concepts.groupBy("video_id").agg(F.count("*").alias("concepts"), F.count_if("is_educational").alias("educational"))
    counted = candidates.groupBy("video_id").agg(F.count("*").alias("candidates"))
    rows = metadata.select("video_id").join(videos.select("video_id", "language", "domain"), "video_id", "left").join(per, "video_id", "left").join(counted, "video_id", "left")
    failed = F.col("language").isNull()
    results = rows.select("video_id", F.when(failed, "error").otherwise("completed").alias("status"), F.when(failed, "no transcript").alias("reason"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("concepts", "educational", "candidates")])
    return Processed(videos, segments, occ, concepts, candidates, results)


def playlist_totals(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Per playlist (playlist_id, video_id): videos, completed ones and the sums of their figures."""
    done = F.col("status") == "completed"
    joined = entries.join(results, "video_id", "left")
    sums = [F.sum(F.when(done, F.col(c)).otherwise(0)).alias(c) for c in ("concepts", "educational", "candidates")]
    return joined.groupBy("playlist_id").agg(F.count("*").alias("videos"), F.count_if(done).alias("completed"), *sums)


def submitted(wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and what a submission gets: already_processed where the video is completed, else accepted."""
    done = videos.filter("processing_status = 'completed'").select("video_id", F.lit(True).alias("done"))
    return wanted.select("video_id").distinct().join(done, "video_id", "left").select("video_id", F.when(F.col("done"), "already_processed").otherwise("accepted").alias("status"))


def status_of(wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and its stored status, not_found without one."""
    return wanted.select("video_id").join(videos.select("video_id", "processing_status"), "video_id", "left").select("video_id", F.coalesce("processing_status", F.lit("not_found")).alias("status"))


def explained(concepts: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """The most significant explained concepts of each video. names: concept_id, text."""
    from .reports import top_per_group

    top = top_per_group(concepts.filter("is_educational"), ["video_id"], [F.desc("significance"), "concept_id"], most)
    return top.join(names.select("concept_id", "text"), "concept_id").select("video_id", "rank", "concept_id", "text", "significance")


def address_kind(c) -> object:
    """playlist, video or unknown: playlists are looked for first."""
    return F.when(T.address_id(c, T.PLAYLIST_FORMS).isNotNull(), "playlist").when(T.address_id(c, T.VIDEO_FORMS).isNotNull(), "video").otherwise("unknown")
