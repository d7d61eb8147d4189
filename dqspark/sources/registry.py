"""Datasets by alias, with virtual datasets made from metric outputs."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from dqspark.sources.readers import load

VIRTUAL = "virtual:"


class DatasetRegistry(Mapping[str, DataFrame]):
    """Looks a dataset up by alias, then by name or path; loads it on first use.

    ``entries`` are inventory rows ``{"alias", "name", "source": {"kind", "path" | "table"}}``, or
    a mapping alias -> DataFrame, local frame, path or table name. ``overrides`` replace the
    source of an alias for one run.
    """

    def __init__(
        self,
        spark: SparkSession,
        entries: Iterable[Mapping[str, Any]] | Mapping[str, Any] = (),
        overrides: Mapping[str, Any] | None = None,
    ):
        self.spark = spark
        self._sources: dict[str, dict[str, Any]] = {}
        self._names: dict[str, str] = {}
        self._loaded: dict[str, DataFrame] = {}
        self._persisted: dict[str, DataFrame] = {}
        if isinstance(entries, Mapping):
            entries = [{"alias": alias, "source": source} for alias, source in entries.items()]
        for entry in entries:
            self.add(entry)
        for alias, source in (overrides or {}).items():
            known = self._alias_of(alias)
            self._sources[known or alias] = _load_arguments(source)

    def add(self, entry: Mapping[str, Any]) -> None:
        alias = entry.get("alias")
        if not alias:
            raise ValueError(f"dataset without an alias: {dict(entry)}")
        self._sources[alias] = _load_arguments(entry["source"])
        self._loaded.pop(alias, None)
        path = self._sources[alias].get("src")
        for name in (entry.get("name"), path, path and posixpath.basename(path)):
            if name:
                self._names.setdefault(name, alias)

    def _alias_of(self, name: str) -> str | None:
        if name in self._sources or name in self._loaded:
            return name
        stem = posixpath.splitext(name)[0]
        return self._names.get(name) or (stem if stem in self._sources else None)

    def __getitem__(self, name: str) -> DataFrame:
        alias = self._alias_of(name)
        if alias is None:
            raise KeyError(f"dataset '{name}' is unknown; known are {sorted(self)}")
        if alias in self._persisted:
            return self._persisted[alias]
        if alias not in self._loaded:
            self._loaded[alias] = load(self.spark, **self._sources[alias])
        return self._loaded[alias]

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self._alias_of(name) is not None

    def __iter__(self):
        return iter(dict.fromkeys([*self._sources, *self._loaded]))

    def __len__(self) -> int:
        return len(list(iter(self)))

    def copy(self) -> DatasetRegistry:
        """The same datasets, those loaded so far as they are; what is added to one is not in the other."""
        other = DatasetRegistry(self.spark)
        other._sources, other._names = dict(self._sources), dict(self._names)
        other._loaded, other._persisted = dict(self._loaded), dict(self._persisted)
        return other

    def create_views(self) -> None:
        """A temporary view per alias, for SQL datasets and custom checks."""
        for alias in list(self):
            self[alias].createOrReplaceTempView(alias.replace(":", "_").replace(".", "_"))

    def add_virtual(self, metric_id: str, df: DataFrame) -> str:
        """A metric's output table under ``virtual:<metric id>``."""
        alias = VIRTUAL + metric_id
        self._loaded[alias] = df
        return alias

    def check_refs(self, name: str, columns: Iterable[str] = ()) -> list[str]:
        """What is wrong with a reference to a dataset and its columns; empty when nothing is."""
        if name not in self:
            return [f"dataset '{name}' is unknown"]
        have = self[name].columns
        return [
            f"column '{c}' is not in '{name}'; columns are {have}" for c in columns if c not in have
        ]

    def cached(self, name: str) -> DataFrame:
        """Keep a dataset that several jobs read; :meth:`release` lets it go."""
        alias = self._alias_of(name)
        df = self[name]
        if alias not in self._persisted:
            self._persisted[alias] = df.persist()
        return self._persisted[alias]

    def release(self) -> None:
        for df in self._persisted.values():
            df.unpersist()
        self._persisted.clear()


def _load_arguments(source: Any) -> dict[str, Any]:
    """Arguments of :func:`load` for one source."""
    if isinstance(source, str):
        return {"src": source}
    if not isinstance(source, Mapping):
        return {"frame": source}
    if "path" in source or "table" in source:
        kind = source.get("kind", "local")
        if kind not in ("local", "hive", "hdfs"):
            raise ValueError(f"sources of kind '{kind}' must be given as an override")
        arguments = {
            k: source[k] for k in ("table", "fmt", "schema", "options", "null_tokens") if k in source
        }
        if "table" not in source:
            arguments["src"] = source["path"]
        return arguments
    if "query" in source:
        return {"query": source["query"]}
    raise ValueError(f"unsupported source: {dict(source)}")
