"""A paged vector store as a Spark data source: one input partition a page, read in parallel.

The client is any object with ``list() -> [(name, count)]`` and ``get(name, limit, offset) ->
[dict(id, text, embedding, metadata)]``; it is made on the executor by an importable factory, so
nothing but its name travels. An in-memory store stands in for a server in tests.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "collection string, chunk_id string, text string, embedding array<float>, metadata map<string,string>"


class Page(InputPartition):
    def __init__(self, name: str, limit: int, offset: int):
        super().__init__(None)
        self.name, self.limit, self.offset = name, limit, offset


def make_client(factory: str):  # noqa: ANN201
    module, name = factory.split(":")
    return getattr(importlib.import_module(module), name)()


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.factory, self.prefix = options["client"], options.get("prefix", "")
        self.size = int(options.get("pageSize", 500))
        self.deadline = float(options.get("deadline", "inf"))

    def partitions(self) -> list[Page]:
        names = sorted((n, c) for n, c in make_client(self.factory).list() if n.startswith(self.prefix))
        return [Page(n, self.size, o) for n, c in names for o in range(0, c, self.size)] or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.limit or time.time() > self.deadline:  # the fetch budget is used up
            return
        for r in make_client(self.factory).get(partition.name, partition.limit, partition.offset):
            e = r.get("embedding")
            yield (partition.name[len(self.prefix):], r["id"], r.get("text") or "", None if e is None else [float(x) for x in e],
                   {k: str(v) for k, v in (r.get("metadata") or {}).items()})


class PagedStore(DataSource):
    """spark.dataSource.register(PagedStore); spark.read.format("paged_store").option("client", "module:factory")."""

    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> str:
        return SCHEMA

    @staticmethod
    def counts(options: dict) -> list[tuple[str, int]]:
        """(collection, records) as the store counts them."""
        prefix = options.get("prefix", "")
        return sorted((n[len(prefix):], c) for n, c in make_client(options["client"]).list() if n.startswith(prefix))

    def reader(self, schema) -> StoreReader:  # noqa: ANN001
        return StoreReader(self.options)


class MemoryStore:
    """Collections held in a class attribute: the stand-in for a server."""

    data: dict[str, list[dict]] = {"prod_a": [{"id": f"a{i}", "text": f"t{i}", "embedding": [float(i)], "metadata": {"page": i}} for i in range(7)],
                                   "prod_b": [{"id": "b0", "text": None, "embedding": None}], "dev_c": [{"id": "c0", "text": "x"}], "prod_empty": []}

    def list(self) -> list[tuple[str, int]]:
        return [(k, len(v)) for k, v in self.data.items()]

    def get(self, name: str, limit: int, offset: int) -> list[dict]:
        return self.data[name][offset : offset + limit]
