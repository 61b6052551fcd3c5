"""Videos, playlists and transcripts from stored payloads.

Nothing here reaches a network: a loader brings the payloads, these functions read
them as columns. Every function works on all rows of a table at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

_SNIPPET = "title string, channelTitle string, publishedAt string, categoryId string, tags array<string>, description string, defaultLanguage string, defaultAudioLanguage string, channelId string, position int, thumbnails map<string,string>"
VIDEO = f"items array<struct<id: string, snippet: struct<{_SNIPPET.replace(' string', ': string').replace(' array', ': array').replace(' int', ': int').replace(' map', ': map')}>, contentDetails: struct<duration: string>, statistics: struct<viewCount: string>>>"
LIST_PAGE = "items array<struct<snippet: struct<title: string, description: string, position: int, resourceId: struct<videoId: string>>>>, nextPageToken string"
LIST_META = "items array<struct<id: string, snippet: struct<title: string, description: string, channelTitle: string, channelId: string, publishedAt: string, defaultLanguage: string>, contentDetails: struct<itemCount: int>, status: struct<privacyStatus: string>>>"
TRACKS = "array<struct<languageCode: string, kind: string, baseUrl: string>>"


def video_metadata(payloads: DataFrame, keywords: dict[str, list[str]] | None = None, bonus: dict[str, str] | None = None) -> DataFrame:
    """A row for each payload (video_id, payload) that has an item: the twelve fields of a video."""
    item = payloads.select("video_id", F.get(F.from_json("payload", VIDEO)["items"], F.lit(0)).alias("i")).filter("i is not null")
    s = item.select("video_id", "i.snippet.*", F.coalesce("i.contentDetails.duration", F.lit("PT0S")).alias("duration"), F.coalesce(F.expr("try_cast(i.statistics.viewCount as long)"), F.lit(0)).alias("view_count"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    language = T.declared_language(F.coalesce("defaultLanguage", "defaultAudioLanguage"), text)
    domain = T.metadata_domain(text, keywords, bonus)
    known = s.select("*", language.alias("language"), domain.alias("d"))
    return known.select(
        "video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("channelTitle", F.lit("")).alias("channel"), F.coalesce("publishedAt", F.lit("")).alias("publication_date"),
        T.duration_seconds(F.col("duration")).alias("duration_seconds"), F.coalesce("categoryId", F.lit("")).alias("category"), F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        F.coalesce("description", F.lit("")).alias("description"), "language", "view_count", F.col("d.domain").alias("domain"), F.col("d.confidence").alias("domain_confidence"),
    )


def playlist_videos(pages: DataFrame, most: int = 50) -> DataFrame:
    """playlist_id, position, video_id and title of the first ``most`` entries over all pages (playlist_id, payload)."""
    each = pages.select("playlist_id", F.explode(F.from_json("payload", LIST_PAGE)["items"]).alias("i")).select("playlist_id", "i.snippet.position", F.col("i.snippet.resourceId.videoId").alias("video_id"), "i.snippet.title")
    w = Window.partitionBy("playlist_id").orderBy("position", "video_id")
    return each.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def playlist_metadata(payloads: DataFrame) -> DataFrame:
    item = payloads.select("playlist_id", F.get(F.from_json("payload", LIST_META)["items"], F.lit(0)).alias("i")).filter("i is not null")
    return item.select("playlist_id", "i.snippet.title", F.col("i.snippet.channelTitle").alias("channel"), F.col("i.contentDetails.itemCount").alias("item_count"), F.col("i.status.privacyStatus").alias("privacy_status"), F.coalesce("i.snippet.defaultLanguage", F.lit("en")).alias("language"))


def wanted_codes(preferred: list[str]) -> list[str]:
    """Preferred languages with their regional forms, each once."""
    return list(dict.fromkeys(c for lang in preferred for c in [lang, *L.LANGUAGE_CODES.get(lang, [])]))


def _preference(code: Column, preferred: list[str]) -> Column:
    """The place of the first wanted code that a track's language is, or is a region of; after all of them otherwise."""
    codes = wanted_codes(preferred)
    out = F.when(F.lit(False), 0)
    for k, c in enumerate(codes):
        out = out.when((code == c) | code.startswith(f"{c}-"), k)
    return out.otherwise(len(codes))


def best_tracks(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """The best track of each video (video_id, code, is_generated, seq): wanted languages in order, then made by hand, then the first.

    Where no wanted language is there, any track made by hand, else any.
    """
    w = Window.partitionBy("video_id").orderBy(_preference(F.col("code"), preferred), "is_generated", "seq")
    return tracks.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def page_tracks(pages: DataFrame) -> DataFrame:
    """video_id, code, is_generated, seq and address of the caption tracks that a watch page's text lists."""
    raw = F.regexp_extract("html", r'"captionTracks":\s*(\[.*?\])', 1)
    found = pages.select("video_id", F.posexplode(F.from_json(F.replace(F.nullif(raw, F.lit("")), F.lit("\\u0026"), F.lit("&")), TRACKS)).alias("seq", "t"))
    return found.select("video_id", F.col("t.languageCode").alias("code"), F.coalesce(F.col("t.kind") == "asr", F.lit(False)).alias("is_generated"), "seq", F.col("t.baseUrl").alias("address"))


def timed_text(documents: DataFrame) -> DataFrame:
    """video_id, pos, start, duration and text of the captions in XML (video_id, xml)."""
    part = lambda g: F.regexp_extract_all("xml", F.lit(r'<text start="([\d.]+)" dur="([\d.]+)"[^>]*>([^<]*)</text>'), F.lit(g))
    each = documents.select("video_id", F.posexplode(F.arrays_zip(part(1).alias("s"), part(2).alias("d"), part(3).alias("t"))).alias("pos", "x"))
    text = T.strip(F.col("x.t"))
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    return each.select("video_id", "pos", F.col("x.s").cast("double").alias("start"), F.col("x.d").cast("double").alias("duration"), text.alias("text"))


def first_source(*sources: DataFrame) -> DataFrame:
    """Of each video all rows of the first source that has any, and the number of that source."""
    rows = None
    for k, s in enumerate(sources):
        own = s.withColumn("source", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("video_id").agg(F.min("source").alias("source"))
    return rows.join(best, ["video_id", "source"])


def formatted(captions: DataFrame) -> DataFrame:
    """Captions with text, and their language as two letters in lower case."""
    return captions.filter(F.trim("text") != "").withColumn("language", F.lower(F.substring(F.coalesce("language", F.lit("en")), 1, 2)))


#: The stand-in transcript: start, duration and text.
MOCK_CAPTIONS = [
    (0.0, 5.0, "Welcome to this calculus lecture."), (5.0, 10.0, "Today we'll discuss derivatives and their applications."), (15.0, 8.0, "Let's start with the definition of a derivative."),
    (23.0, 12.0, "A derivative is defined as the limit of the difference quotient as the interval approaches zero."), (35.0, 10.0, "Now let's solve a problem. Find the derivative of f(x) = x^2."),
]


def mock_transcript(spark: SparkSession, video_id: str) -> DataFrame:
    rows = [(video_id, pos, start, duration, text, "en") for pos, (start, duration, text) in enumerate(MOCK_CAPTIONS)]
    return spark.createDataFrame(rows, "video_id string, pos int, start double, duration double, text string, language string")


def mock_metadata(spark: SparkSession, video_id: str) -> DataFrame:
    row = (video_id, f"Mock video {video_id}", "Mock channel", "2023-01-01T00:00:00Z", 630, "27", ["mathematics", "calculus", "derivatives"], "A stand-in for tests.", "en", 1000, "mathematics", 0.8)
    kinds = "video_id string, title string, channel string, publication_date string, duration_seconds int, category string, tags array<string>, description string, language string, view_count long, domain string, domain_confidence double"
    return spark.createDataFrame([row], kinds)


def mock_playlist(spark: SparkSession, playlist_id: str, n: int = 5) -> DataFrame:
    return spark.createDataFrame([(playlist_id, i, f"mock_video_{i}_{playlist_id[-6:]}", f"Mock video {i}") for i in range(n)], "playlist_id string, position int, video_id string, title string")
