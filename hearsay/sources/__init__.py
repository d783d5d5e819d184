"""Adapters, and which of them a source belongs to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .base import Adapter, AdapterConfig, Bundle, Capabilities, Technique
from .chat import ChatAdapter
from .corpus import CorpusAdapter
from .tables import ReleaseAdapter, RoomsAdapter, RosterAdapter
from .wiki import WikiAdapter

ADAPTERS: dict[str, Callable[[], Adapter]] = {"wiki": WikiAdapter, "corpus": CorpusAdapter, "release": ReleaseAdapter, "rooms": RoomsAdapter, "roster": RosterAdapter, "chat": ChatAdapter}


def get(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name!r}; there are {', '.join(ADAPTERS)}")
    return ADAPTERS[name]()


def detect(spark: SparkSession, path: str) -> Adapter:
    """The first adapter that knows the source; one that fails does not know it."""
    for make in ADAPTERS.values():
        adapter = make()
        try:
            if adapter.sniff(spark, path):
                return adapter
        except (PySparkException, ValueError, OSError, KeyError, AttributeError):
            continue
    raise ValueError(f"no adapter knows {path}")


@dataclass(frozen=True)
class HubPath:
    """hf://datasets/owner/name[@revision][/file]"""

    repo: str
    revision: str | None
    file: str | None


def parse_hub(uri: str) -> HubPath | None:
    m = re.fullmatch(r"hf://(?:datasets/)?([^/@]+/[^/@]+)(?:@([^/]+))?(?:/(.+))?", uri)
    return HubPath(m[1], m[2], m[3] or None) if m else None


def resolve(uri: str, fetch: Callable[[HubPath], str] | None = None) -> str:
    """A path as it is; a hub URI through the caller's ``fetch``."""
    hub = parse_hub(uri)
    if hub is None:
        if uri.startswith("hf://"):
            raise ValueError(f"not a dataset URI: {uri}")
        return uri
    if fetch is None:
        raise ValueError("hub URIs need a fetch function")
    return fetch(hub)


__all__ = ["ADAPTERS", "Adapter", "AdapterConfig", "Bundle", "Capabilities", "HubPath", "Technique", "detect", "get", "parse_hub", "resolve"]
