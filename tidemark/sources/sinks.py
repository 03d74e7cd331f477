"""Feeds, show lists and records as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, duration_text


def escaped(text: Column) -> Column:
    """Text for XML."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))


def _linked(name: str, attribute: str, value: Column, more: str = "") -> Column:
    """An element that is one address or name; nothing without it."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f'<{name} {attribute}="'), escaped(value), F.lit(f'"{more}/>')))


#: The namespaces of a feed's elements.
NAMESPACES = (
    ("itunes", "http://www.itunes.com/dtds/podcast-1.0.dtd"),
    ("atom", "http://www.w3.org/2005/Atom"),
    ("podcast", "https://podcastindex.org/namespace/1.0"),
    ("psc", "http://podlove.org/simple-chapters"),
)


def feed_xml(feeds: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, xml): RSS of each show.  feeds: key, title, link, description; items: key, place, guid, title, published_at, url, bytes, seconds.

    Columns that may be there: language, category, image of a feed (link is then its own address, too); description, image,
    chapters_url and chapters (array of start, title) of an item.
    """
    more = [_element("description", F.col("description"))] if "description" in items.columns else []
    more += [_linked("itunes:image", "href", F.col("image"))] if "image" in items.columns else []
    more += [_linked("podcast:chapters", "url", F.col("chapters_url"), ' type="application/json+chapters"')] if "chapters_url" in items.columns else []
    if "chapters" in items.columns:
        one = lambda c: F.concat(F.lit('<psc:chapter start="'), clock(c["start"], True), F.lit('" title="'), escaped(c["title"]), F.lit('"/>'))
        listed = F.array_join(F.transform("chapters", one), "")
        more.append(F.when(F.size("chapters") > 0, F.concat(F.lit('<psc:chapters version="1.2">'), listed, F.lit("</psc:chapters>"))).otherwise(""))
    item = F.concat(
        F.lit("<item>"), _element("title", F.col("title")), _element("guid", F.col("guid")),
        _element("pubDate", F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss Z")),
        F.lit('<enclosure url="'), escaped(F.col("url")), F.lit('" length="'), F.col("bytes").cast("string"), F.lit('" type="audio/x-m4a"/>'),
        _element("itunes:duration", duration_text(F.col("seconds"))), *more, F.lit("</item>"),
    )
    lists = items.withColumn("_x", item).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_x"))), lambda x: x["_x"]), "\n").alias("_items"))
    head = F.concat(_element("title", F.col("title")), _element("link", F.col("link")), _element("description", F.col("description")))
    own = []
    if "language" in feeds.columns:
        own.append(_element("language", F.when(F.coalesce("language", F.lit("")) == "", "en-us").otherwise(F.col("language"))))
    if "category" in feeds.columns:
        own.append(_linked("itunes:category", "text", F.when(F.coalesce("category", F.lit("")) == "", "Technology").otherwise(F.col("category"))))
    if "image" in feeds.columns:
        own.append(_linked("itunes:image", "href", F.col("image")))
        own.append(F.concat(F.lit('<atom:link href="'), escaped(F.col("link")), F.lit('" rel="self" type="application/rss+xml"/>')))
    head = F.concat(head, *own) if own else head
    spaces = NAMESPACES if own or more else NAMESPACES[:1]
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"' + "".join(f' xmlns:{n}="{u}"' for n, u in spaces) + "><channel>"), head, F.coalesce("_items", F.lit("")), F.lit("</channel></rss>"))
    return feeds.join(lists, key, "left").select(key, xml.alias("xml"))


def opml(feeds: DataFrame, key: str) -> DataFrame:
    """(opml): one document of all shows (title, url), by title.  A show list is short."""
    outline = F.concat(F.lit('<outline type="rss" text="'), escaped(F.col("title")), F.lit('" xmlUrl="'), escaped(F.col("url")), F.lit('"/>'))
    rows = F.array_sort(F.collect_list(F.struct("title", key, outline.alias("o"))))
    body = F.array_join(F.transform(rows, lambda r: r["o"]), "\n")
    return feeds.agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0"><body>\n'), body, F.lit("\n</body></opml>")).alias("opml"))


#: Fixed value: where a feed's address opens a podcast app that subscribes to it.
SUBSCRIBE = "https://antennapod.org/deeplink/subscribe?url="


def subscription_page(feeds: DataFrame, key: str, heading: str = "Feeds", opml_name: str = "feeds.opml") -> DataFrame:
    """(html): a page of all shows (title, url) by title, each with its address and a link that subscribes to it, and one to the list."""
    entry = F.concat(
        F.lit("<li><b>"), escaped(F.col("title")), F.lit(f'</b> <a href="{SUBSCRIBE}'), F.url_encode("url"), F.lit('">Subscribe</a> <a href="'), escaped(F.col("url")), F.lit('">'), escaped(F.col("url")), F.lit("</a></li>"),
    )
    rows = F.array_sort(F.collect_list(F.struct("title", key, entry.alias("o"))))
    body = F.array_join(F.transform(rows, lambda r: r["o"]), "\n")
    head = f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><meta name="robots" content="noindex"><title>{heading}</title></head>\n<body><h1>{heading}</h1>\n<ul>\n'
    return feeds.agg(F.concat(F.lit(head), body, F.lit(f'\n</ul>\n<p><a href="{opml_name}" download="{opml_name}">All feeds as one list</a></p></body></html>')).alias("html"))


def vtt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vtt): cues (keys, seq, start, end, text) as WebVTT texts; a text is one line."""
    line = F.regexp_replace("text", r"\s+", " ")
    cue = F.concat(clock(F.col("start"), True), F.lit(" --> "), clock(F.col("end"), True), F.lit("\n"), line, F.lit("\n"))
    lists = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", cue.alias("c")))).alias("_c"))
    return lists.select(*keys, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_c", lambda c: c["c"]), "\n")).alias("vtt"))


def changed(documents: DataFrame, written: DataFrame, key: str, content: str) -> DataFrame:
    """Documents whose content is not what was written under their key: those to write."""
    new = documents.withColumn("sha256", F.sha2(content, 256))
    return new.join(written.select(key, "sha256"), [key, "sha256"], "left_anti")


def feature_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): rows as JSON lines, in their order over all rows (a sort by ranges, so no task holds them all)."""
    columns = [c for c in rows.columns if c not in order]
    return rows.orderBy(*order).select(*order, F.to_json(F.struct(*order, *columns)).alias("line"))


def write_complete(rows: DataFrame, path: str, expected: int, order: list[str]) -> int:
    """Rows as JSON lines at path, replaced only by a complete set: `expected` rows, and some."""
    n = rows.count()
    if not n or n != expected:
        raise ValueError(f"{n} rows of {expected}: what is there stays")
    rows.orderBy(*order).write.mode("overwrite").json(path)
    return n
