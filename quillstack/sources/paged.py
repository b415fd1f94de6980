"""Tables behind a service that answers pages: filters, an order, a limit, and a key to go on from.

``spark.dataSource.register(PagedStore)``, then ``spark.read.format("paged")`` with the options ``client`` (module:factory
of an object with the two methods of ``Client``, which executors can import), ``table``, ``key``, and optionally
``parts`` and ``page``.  Equality and range filters on columns go to the service with every request (with
``spark.sql.python.filterPushdown.enabled``); the service's key ranges are the partitions, each read by its own task page by
page, going on behind the last key it has seen.  A task holds one page; a page that is asked for again after a
failure is the same page, as it is told by keys and not by a count.

A null never passes a filter that is pushed; rows come in no order across partitions.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: filters that services know, and their signs
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
Condition = tuple[str, str, Any]  # column, sign, value


class Client(Protocol):
    def ranges(self, table: str, key: str, conditions: list[Condition], parts: int) -> list[tuple[Any, Any]]:
        """Key ranges (from, to), both included, that hold all rows of the conditions, about ``parts`` of them."""

    def fetch(self, table: str, columns: list[str], conditions: list[Condition], key: str, limit: int) -> list[tuple]:
        """At most ``limit`` rows, in the order of the key."""


class KeyRange(InputPartition):
    def __init__(self, low: Any, high: Any):
        self.low, self.high = low, high


class PagedStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = schema.names, options
        self.table, self.key = options["table"], options["key"]
        self.conditions: list[Condition] = []

    def _client(self) -> Client:
        module, factory = self.options["client"].split(":")
        return getattr(importlib.import_module(module), factory)()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in SIGNS and len(f.attribute) == 1:
                self.conditions.append((f.attribute[0], SIGNS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        found = self._client().ranges(self.table, self.key, self.conditions, int(self.options.get("parts", 8)))
        return [KeyRange(*x) for x in found] or [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        if partition.low is None:
            return
        client, limit, at = self._client(), int(self.options.get("page", 500)), self.columns.index(self.key)
        here = [*self.conditions, (self.key, "<=", partition.high)]
        behind: Condition = (self.key, ">=", partition.low)
        while True:
            rows = client.fetch(self.table, self.columns, [*here, behind], self.key, limit)
            yield from map(tuple, rows)
            if len(rows) < limit:
                return
            behind = (self.key, ">", rows[-1][at])
