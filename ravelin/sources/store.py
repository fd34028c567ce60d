"""A store of loaded tables with what is known of them, kept while they are used."""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ravelin.operators.quality import DatasetSchema, infer_schema
from ravelin.plans.nl import Parser

from . import readers
from .catalog import Catalog, Link, discover_links, enrich

MOST_UPLOAD = 2 * 1024 * 1024


@dataclass
class Bundle:
    """Tables that were loaded together. Schemas, links and parsers are made when first asked for, once."""

    name: str
    catalog: Catalog
    _schemas: dict[str, DatasetSchema] = field(default_factory=dict)
    _parsers: dict[str, Parser] = field(default_factory=dict)
    _links: list[Link] | None = None
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def links(self) -> list[Link]:
        with self._lock:
            if self._links is None:
                self._links = discover_links(self.catalog)
            return self._links

    def table(self, name: str | None = None, enriched: bool = True) -> DataFrame:
        name = name or self.catalog.default()
        return enrich(self.catalog, name, self.links())[0] if enriched else self.catalog.tables[name]

    def schema(self, name: str | None = None) -> DatasetSchema:
        name = name or self.catalog.default()
        with self._lock:
            if name not in self._schemas:
                self._schemas[name] = infer_schema(self.table(name))
            return self._schemas[name]

    def parser(self, name: str | None = None) -> Parser:
        name = name or self.catalog.default()
        with self._lock:
            if name not in self._parsers:
                self._parsers[name] = Parser(self.table(name), self.schema(name))
            return self._parsers[name]


class Store:
    """The bundles used last; the one unused for longest goes, with what it had cached."""

    def __init__(self, spark: SparkSession, most: int = 8):
        self.spark, self.most = spark, most
        self._bundles: OrderedDict[str, Bundle] = OrderedDict()
        self._lock = threading.RLock()

    def load(self, name: str, paths: dict[str, str]) -> Bundle:
        return self.put(Bundle(name, Catalog({t: readers.load(self.spark, p) for t, p in paths.items()})))

    def put(self, bundle: Bundle) -> Bundle:
        with self._lock:
            self._bundles[bundle.name] = bundle
            self._bundles.move_to_end(bundle.name)
            while len(self._bundles) > self.most:
                _, old = self._bundles.popitem(last=False)
                for d in old.catalog.tables.values():
                    d.unpersist()
            return bundle

    def get(self, name: str) -> Bundle:
        with self._lock:
            if name not in self._bundles:
                raise KeyError(f"no dataset {name!r}")
            self._bundles.move_to_end(name)
            return self._bundles[name]

    def names(self) -> list[str]:
        return list(self._bundles)


def add_document(folder: str, name: str, content: bytes) -> Path:
    """Adds a document to a folder of knowledge: .md or .txt, in UTF-8, of at most two megabytes, under a safe name."""
    safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in Path(name).name).lstrip(".")
    if Path(safe).suffix.lower() not in (".md", ".txt"):
        raise ValueError("only .md and .txt files can be added")
    if len(content) > MOST_UPLOAD:
        raise ValueError("the file is larger than two megabytes")
    content.decode("utf-8")
    path = Path(folder) / safe
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path
