"""Captions, records, label files, feature lines and feeds as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import cues as C

LABELS = (
    "video_id string, channel string, title string, duration double, segments array<struct<category:string,start:double,end:double,"
    "confidence:string,borderline:boolean,first_line:string,last_line:string,advertiser:string,reason:string,labeler:string,relabeled:string,time_corrected:string,excluded:string>>"
)
WEIGHTS = "edge string, bias double, trained_on array<string>, videos int, rows int, weights map<string,double>"
FEATURES = (
    "channel string, video string, rule string, anchor_start double, anchor_end double, id string, start double, end double, text string, "
    "values map<string,double>, predicate double"
)


def vtt(spark: SparkSession, path: str) -> DataFrame:
    """Cues (path, seq, start, end, text) of WebVTT files, one file a row; text cleaned, empty cues dropped, rolling repeats removed."""
    return parsed_vtt(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), ["path"], "value")


def parsed_vtt(files: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    kinds = dict(files.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq int, start double, end double, text string"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*[r[k] for k in keys], n, s, e, " ".join(body)) for r in part.to_dict("records") for n, (s, e, body) in enumerate(C.read_vtt(r[text_col]))]
            yield pd.DataFrame(rows, columns=[*keys, "seq", "start", "end", "text"])

    raw = files.select(*keys, text_col).mapInPandas(parse, schema).withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    return C.deduplicated(raw, keys)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files, one JSON object each; malformed ones are an error."""
    return spark.read.schema(LABELS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def label_segments(files: DataFrame) -> DataFrame:
    return files.select("channel", "video_id", "duration", F.posexplode("segments").alias("seq", "_s")).select("channel", "video_id", "duration", "seq", "_s.*")


def weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows, one JSON object a line."""
    return spark.read.schema(FEATURES).option("mode", "FAILFAST").json(path)


def records(spark: SparkSession, root: str, schema: str, name: str = "render.m4a.json") -> DataFrame:
    """JSON records at root/<channel>/<video_id>/<name>; a record whose channel or id is not its path's is an error."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    path = F.col("_metadata.file_path")
    owner = F.concat_ws("/", "channel", "video_id") == F.regexp_extract(path, rf"([^/]+/[^/]+)/{name}$", 1)
    checked = F.when(owner, F.col("video_id")).otherwise(F.raise_error(F.concat(F.lit("record is not its path's: "), path)))
    return read.select(*[checked.alias(c) if c == "video_id" else F.col(c) for c in read.columns])


def listing(spark: SparkSession, path: str, wanted: int) -> DataFrame:
    """The newest `wanted` accessible uploads of each saved listing (a file of one JSON object a line, unreadable ones skipped);
    skipped ones between them stay."""
    read = spark.read.schema("id string, title string, availability string, position long").option("mode", "DROPMALFORMED").json(path)
    rows = read.select("*", F.col("_metadata.file_path").alias("_file"))
    usable = F.coalesce(F.col("availability"), F.lit("public")).isin("public", "unlisted")
    seen = F.sum((usable).cast("int")).over(Window.partitionBy("_file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return rows.where(F.col("id").isNotNull()).withColumn("accessible", usable).withColumn("_n", F.coalesce(seen, F.lit(0))).where(F.col("_n") < wanted).drop("_n", "_file")


_ITEM = (
    "struct<title:string,guid:string,description:string,pubDate:string,enclosure:struct<_url:string,_length:string>,duration:string,"
    "image:struct<_href:string>,chapters:array<struct<_url:string,chapter:array<struct<_start:string,_title:string>>>>>"
)
#: An RSS document, read without its namespaces: podcast and simple chapters are both `chapters` then.
FEED = (
    "channel array<struct<title:string,description:string,language:string,category:array<struct<_text:string>>,image:array<struct<_href:string>>,"
    f"item:array<{_ITEM}>>>"
)


def _or_error(value: Column, given: Column, what: str) -> Column:
    """value, or an error that names what was given."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(given, F.lit("nothing")))))


def parsed_feeds(files: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """files (keys and the text of a feed) with what they hold (_feed).  What is not RSS with one channel is an error, never an empty feed."""
    read = F.from_xml(F.col(text_col), FEED, {"ignoreNamespace": "true", "mode": "FAILFAST"})
    parsed = files.select(*keys, F.col(text_col).rlike(r"<rss[\s>]").alias("_rss"), read.alias("_x"))
    one = F.when(F.col("_rss") & (F.size("_x.channel") == 1), F.get("_x.channel", 0))
    return parsed.select(*keys, _or_error(one, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), "not RSS with one channel").alias("_feed"))


def feed_channels(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title, description, language, category, image) of parsed feeds.  Their own addresses are known from where they lie."""
    attribute = lambda name, key: F.get(F.filter(F.col(f"_feed.{name}"), lambda x: x[key].isNotNull()), 0)[key]
    return parsed.select(*keys, "_feed.title", "_feed.description", "_feed.language", attribute("category", "_text").alias("category"), attribute("image", "_href").alias("image"))


def clock_seconds(text: Column, least: int = 1) -> Column:
    """Seconds of up to three numbers parted by colons, `least` at least; null if there are others."""
    parts = F.split(text, ":")
    ok = F.size(parts).between(least, 3) & F.forall(parts, lambda p: p.rlike(r"^\d+(\.\d+)?$"))
    return F.when(ok, F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p))


def feed_entries(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Items of parsed feeds: keys, prior (their place in the document), guid, title, description, published_at, url, bytes, seconds, image,
    chapters_url and chapters (start, title).  A date, length, duration or chapter that can't be read is an error."""
    # of a plain posexplode Spark infers a filter on the items' number and pushes it below the parse, which then runs for each of its terms
    rows = parsed.select(*keys, F.posexplode_outer("_feed.item").alias("prior", "_i")).where("prior is not null")
    i = lambda name: F.col(f"_i.{name}")
    at = F.try_to_timestamp(F.regexp_replace(i("pubDate"), r"^\w+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    size = i("enclosure._length").try_cast("long")
    listed = F.flatten(F.transform(F.coalesce(i("chapters"), F.array().cast("array<struct<_url:string,chapter:array<struct<_start:string,_title:string>>>>")), lambda c: F.coalesce(c["chapter"], F.array().cast("array<struct<_start:string,_title:string>>"))))
    chapter = lambda c: F.struct(_or_error(clock_seconds(c["_start"], 3), c["_start"], "chapter start").alias("start"), c["_title"].alias("title"))
    return rows.select(
        *keys, "prior", i("guid").alias("guid"), i("title").alias("title"), i("description").alias("description"), _or_error(at, i("pubDate"), "publication date").alias("published_at"),
        i("enclosure._url").alias("url"), _or_error(size, i("enclosure._length"), "enclosure length").alias("bytes"), _or_error(clock_seconds(i("duration")), i("duration"), "duration").alias("seconds"),
        i("image._href").alias("image"), F.get(F.filter(i("chapters"), lambda c: c["_url"].isNotNull()), 0)["_url"].alias("chapters_url"), F.transform(listed, chapter).alias("chapters"),
    )


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: guid, title, published_at, url, bytes, seconds and what else feed_entries() reads."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return feed_entries(parsed_feeds(files, ["path"], "value"), ["path"]).drop("path")


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Rows of a saved state (JSON); None if nothing was saved yet.  What is saved and can't be read is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def missing(requested: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys with nothing available, for an all-or-nothing check before a run."""
    return requested.select(*keys).distinct().join(available.select(*keys).distinct(), keys, "left_anti")


def selected(labels_df: DataFrame, selectors: list[str]) -> DataFrame:
    """Labels whose video or channel is named; a selector that names nothing is an error, as is a video that comes twice."""
    out = labels_df.where(F.col("video_id").isin(*selectors) | F.col("channel").isin(*selectors)) if selectors else labels_df
    known = {r[0] for c in ("video_id", "channel") for r in labels_df.select(c).where(F.col(c).isin(*selectors)).distinct().collect()} if selectors else set()
    if unknown := sorted(set(selectors) - known):
        raise ValueError(f"selectors that match nothing: {unknown}")
    if twice := [r.video_id for r in out.groupBy("channel", "video_id").count().where("count > 1").take(5)]:
        raise ValueError(f"labelled more than once: {twice}")
    return out
