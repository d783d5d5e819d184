"""What every adapter gives: a bundle of canonical tables, its configuration and
what the source can support."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import COHORT, EPISODE


@dataclass(frozen=True)
class Technique:
    name: str
    pattern: str
    families: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class AdapterConfig:
    name: str = "generic"
    families: dict[str, str] = field(default_factory=dict)
    cohort_regex: str = COHORT
    episode_regex: str = EPISODE
    extra_items: dict[str, list[str]] = field(default_factory=dict)
    techniques: tuple[Technique, ...] = ()
    featured_disputes: tuple = ()
    disputes: tuple = ()
    instant_threshold_s: float = 2.0
    ignore_authors: tuple[str, ...] = ()
    family_from_channel: bool = False
    family_from_roster: bool = True
    roster_aliases: dict[str, str] = field(default_factory=dict)
    schedule_tz: str | None = None
    digest_as_posts: bool = False

    def over(self, values: dict) -> "AdapterConfig":
        """These settings over one's own; unknown keys are ignored."""
        known = {f.name for f in fields(self)}
        values = {k: v for k, v in values.items() if k in known}
        if "techniques" in values:
            values["techniques"] = tuple(t if isinstance(t, Technique) else Technique(**{k: tuple(v) if k == "families" else v for k, v in t.items()}) for t in values["techniques"])
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def from_file(self, text: str, name: str) -> "AdapterConfig":
        """Overrides from JSON or TOML text, by the file's name."""
        return self.over(tomllib.loads(text) if name.endswith(".toml") else json.loads(text))


@dataclass(frozen=True)
class Capabilities:
    has_wall_clock: bool = False
    has_channels: bool = True
    has_deletions: bool = False
    has_reads: bool = False
    has_episodes: bool = False
    has_threading: bool = False
    has_roster: bool = False
    has_audience: bool = False
    has_probes: bool = False

    def as_dict(self) -> dict[str, bool]:
        return asdict(self)


@dataclass
class Bundle:
    events: DataFrame | None = None
    lifecycle: DataFrame | None = None
    probes: DataFrame | None = None
    roster: DataFrame | None = None
    directory: DataFrame | None = None
    channels: DataFrame | None = None
    activity: DataFrame | None = None
    eras: DataFrame | None = None
    summaries: DataFrame | None = None
    digest: DataFrame | None = None
    records: DataFrame | None = None
    capabilities: Capabilities = field(default_factory=Capabilities)
    notes: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: v for f in fields(self) if isinstance(v := getattr(self, f.name), DataFrame)}


class Adapter(Protocol):
    name: str

    def sniff(self, spark: SparkSession, path: str) -> bool: ...

    def config(self) -> AdapterConfig: ...

    def load(self, spark: SparkSession, path: str) -> Bundle: ...
