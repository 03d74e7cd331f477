"""Text and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

#: Domain endings whose dot ends no sentence.
WEB_ENDINGS = ("com", "org", "net", "io", "co", "ai", "tv", "fm", "dev", "app", "gov", "edu", "us", "uk", "ly", "me")
#: Entities and what they stand for, decoded in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))


def clean(text: Column) -> Column:
    """Tags removed, entities decoded, blanks collapsed and trimmed."""
    out = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ends_sentence(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"\s+$", "")).rlike(r"[.?!]$")


def split_sentences(text: Column) -> Column:
    """Pieces of a text, each with the `.`, `?` or `!` that ends it; a dot before a letter or digit ends none."""
    marked = F.regexp_replace(text, r"([?!]|\.(?![A-Za-z0-9]))", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda p: p != "")


def starts_web_ending(text: Column) -> Column:
    return text.rlike(rf"(?i)^({'|'.join(WEB_ENDINGS)})(?![A-Za-z0-9_])")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normal_words(text: Column) -> Column:
    """Words in lower case without anything but ASCII letters and digits."""
    return words(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", ""))


def overlap_suffix(previous: Column, following: Column) -> Column:
    """Words at the end of one text that stand at the head of the next, in any case: how many, at most."""
    said = F.struct(words(F.lower(previous)).alias("a"), words(F.lower(following)).alias("b"))

    def most(x: Column) -> Column:
        a, b = x["a"], x["b"]
        # the first word tells most places apart
        starts = lambda k: F.get(a, F.size(a) - k) == F.get(b, 0)
        same = lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k)
        return F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: (k == 0) | (starts(k) & same(k))))

    # words are found once for each pair, not at each length tried
    return F.when(previous.isNotNull() & following.isNotNull(), let(said, most))


def lexical(text: Column, needles: list[str]) -> Column:
    """1.0 if the text holds any of the needles, in any case."""
    low = F.lower(text)
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(low, F.lit(needle.lower()))
    return F.coalesce(found, F.lit(False)).cast("double")


def spoken(text: Column) -> Column:
    """A caption without its [annotations], trimmed."""
    return F.trim(F.regexp_replace(text, r"\[[^\]]*\]", ""))


def speech_end(start: Column, end: Column, text: Column, rate: float = 8.0, margin: float = 1.5) -> Column:
    """When a spoken caption is likely over: characters at a slow rate and a margin, no later than its end."""
    return F.least(start + F.char_length(spoken(text)) / rate + margin, end)


def timestamp_seconds(text: Column) -> Column:
    """Seconds of [HH:]MM:SS with a fraction after dot or comma; null if it is none."""
    ok = text.rlike(r"^(\d+:)?\d{1,2}:\d{1,2}([.,]\d+)?$")
    parts = F.transform(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def milliseconds(seconds: Column) -> Column:
    """Rounded to milliseconds."""
    return F.round(seconds, 3)


def clock(seconds: Column, fractional: bool = False) -> Column:
    """HH:MM:SS, with milliseconds if asked for."""
    ms = F.round(seconds * 1000).cast("long")
    whole = F.expr("0") + (F.floor(ms / 1000) if fractional else F.floor(seconds).cast("long"))
    head = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.concat(head, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")) if fractional else head


def duration_text(seconds: Column) -> Column:
    """H:MM:SS"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def video_id(url: Column, hosts: tuple[str, ...] = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")) -> Column:
    """The 11-character id of a video address, or of a bare id; null otherwise."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    candidate = (
        F.when(url.rlike(r"^[A-Za-z0-9_-]{11}$"), url)
        .when(~host.isin(*hosts), None)
        .when(host == "youtu.be", F.regexp_extract(path, r"^/([^/]+)", 1))
        .when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
        .otherwise(F.regexp_extract(path, r"^/(?:shorts|live|embed)/([^/]+)", 1))
    )
    return F.when(candidate.rlike(r"^[A-Za-z0-9_-]{11}$"), candidate)


def line_chapter(line: Column) -> Column:
    """struct(start, title) of a line with a timestamp at either end; null if there is none or its parts are 60 or more."""
    stamp = r"((?:\d{1,2}:)?\d{1,2}:\d{2})"
    lead, lead_title = F.regexp_extract(line, rf"^\s*[\[(]?{stamp}[\])]?[\s:–—-]+(.+?)\s*$", 1), F.regexp_extract(line, rf"^\s*[\[(]?{stamp}[\])]?[\s:–—-]+(.+?)\s*$", 2)
    tail, tail_title = F.regexp_extract(line, rf"^\s*(.+?)[\s:–—-]+[\[(]?{stamp}[\])]?\s*$", 2), F.regexp_extract(line, rf"^\s*(.+?)[\s:–—-]+[\[(]?{stamp}[\])]?\s*$", 1)
    time = F.when(lead != "", lead).when(tail != "", tail)
    title = F.when(lead != "", lead_title).otherwise(tail_title)
    parts = F.transform(F.split(time, ":"), lambda p: p.cast("int"))
    fits = F.forall(F.slice(parts, -2, 2), lambda p: p < 60)
    return F.when(time.isNotNull() & fits, F.struct(timestamp_seconds(time).alias("start"), title.alias("title")))
