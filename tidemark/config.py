"""Rules and channels from a TOML file, as small tables."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers with a meaning of their own.
CONTENT_RULE, RESERVED_SLUGS = "content", ("subscribe",)
BITRATES = range(32, 321)
COUNTS = ("latest", "keep", "watch_limit")


@dataclass(frozen=True)
class Rule:
    id: str
    prompt: str
    threshold: float = 0.0  # carried, not used: anchoring sums over all rules


@dataclass(frozen=True)
class Channel:
    name: str
    slug: str
    url: str = ""
    title: str = ""
    description: str = ""
    category: str = ""
    latest: int = 0
    keep: int = 0
    watch_limit: int = 0
    bitrate_kbps: int = 0
    rules: tuple[str, ...] = ()
    no_weights: bool = False
    keep_tail: bool = False


@dataclass(frozen=True)
class Config:
    rules: tuple[Rule, ...] = ()
    channels: tuple[Channel, ...] = ()
    bitrate_kbps: int = 128
    other: dict = field(default_factory=dict)  #: all tables but these, as they are


def selection_limit(channel: Channel, default: int = 10) -> int:
    return channel.latest or channel.watch_limit or default


def retention_limit(channel: Channel, default: int = 10) -> int:
    return channel.keep or max(default, selection_limit(channel, default))


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text())


def parse(text: str) -> Config:
    """The settings of a TOML text; what is wrong with them is a ValueError that names the place."""
    raw = tomllib.loads(text)
    rules = tuple(Rule(r.get("id", ""), r.get("prompt", ""), float(r.get("threshold", 0))) for r in raw.get("rules", ()))
    channels = []
    for c in raw.get("channels", ()):
        where = f"channel {c.get('slug')!r}"
        # a count that is written must be positive: a written zero is not "unset"
        for key in COUNTS:
            if key in c and (not isinstance(c[key], int) or isinstance(c[key], bool) or c[key] <= 0):
                raise ValueError(f"{where}: {key} must be a positive integer")
        if "latest" in c and "watch_limit" in c:
            raise ValueError(f"{where}: latest and watch_limit exclude each other")
        known = {k: v for k, v in c.items() if k in Channel.__dataclass_fields__}
        channels.append(Channel(**known | {"name": c.get("name", ""), "slug": c.get("slug", ""), "rules": tuple(c.get("rules", ()))}))
    config = Config(rules, tuple(channels), int(raw.get("audio", {}).get("bitrate_kbps", 128)), {k: v for k, v in raw.items() if k not in ("rules", "channels", "audio")})
    if problem := next(_problems(config), None):
        raise ValueError(problem)
    return config


def _problems(config: Config):
    if config.bitrate_kbps not in BITRATES:
        yield "audio.bitrate_kbps is out of range"
    ids: set[str] = set()
    for r in config.rules:
        if not r.id or not r.prompt:
            yield f"a rule needs an id and a prompt: {r.id!r}"
        if r.id == CONTENT_RULE:
            yield f"rule id {r.id!r} is reserved"
        if r.id in ids:
            yield f"rule id {r.id!r} comes twice"
        ids.add(r.id)
    slugs: set[str] = set()
    for c in config.channels:
        if retention_limit(c) < selection_limit(c):
            yield f"channel {c.slug!r}: keep is less than latest"
        if c.bitrate_kbps and c.bitrate_kbps not in BITRATES:
            yield f"channel {c.slug!r}: bitrate_kbps is out of range"
        if not re.fullmatch(r"[A-Za-z0-9_-]+", c.slug):
            yield f"channel {c.name!r}: slug {c.slug!r} is none"
        if c.slug.lower() in RESERVED_SLUGS:
            yield f"channel {c.name!r}: slug {c.slug!r} is reserved"
        if c.slug.lower() in slugs:
            yield f"slug {c.slug!r} comes twice but for letter case"
        slugs.add(c.slug.lower())
        if unknown := [r for r in c.rules if r not in ids]:
            yield f"channel {c.slug!r}: unknown rules {unknown}"


def tables(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """(rules, channels) as DataFrames."""
    rules = spark.createDataFrame([(r.id, r.prompt, i) for i, r in enumerate(config.rules)], "rule string, prompt string, position int")
    rows = [(c.slug, c.title or c.name, list(c.rules), selection_limit(c), retention_limit(c), c.bitrate_kbps or config.bitrate_kbps) for c in config.channels]
    return rules, spark.createDataFrame(rows, "channel string, title string, rules array<string>, latest int, keep int, bitrate_kbps int")


def channel_rules(rules: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel, rule): the rules of each channel; a channel that names none has all."""
    return channels.join(F.broadcast(rules), (F.size("rules") == 0) | F.array_contains("rules", F.col("rule"))).select("channel", "rule", "position")


def criteria(rules: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, criteria): a scan's choices, a map of the rules (keys, rule, prompt) and of content itself."""
    entry = F.struct(F.col("rule").alias("key"), F.col("prompt").alias("value"))
    own = F.struct(F.lit(CONTENT_RULE).alias("key"), F.lit(content).alias("value"))
    return rules.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.array_append(F.collect_list(entry), own))).alias("criteria"))
