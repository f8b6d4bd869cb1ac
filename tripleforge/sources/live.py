"""A live triple source as a data source of Spark: ranges of a key are read as tasks, page by page, by a client that is handed in.

A client is made once a task and called as ask(low, high, after): it gives a page {rows, complete} of the bindings whose key is
low or more, less than high, and more than after (each None where open), in the key's order; a page ends between keys, and one
without rows ends the range. A row maps a variable to {"value": text}, as SPARQL's JSON results do. `complete` is false where
the server broke off, as headers or a body of partial results tell.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.runners import asked

Ask = Callable[[str | None, str | None, str | None], dict]


@dataclass
class Range(InputPartition):
    low: str | None
    high: str | None


class Pages(DataSourceReader):
    """Rows of the ranges that the option `bounds`, a JSON list of keys in order, cuts between `from` and `until`.

    Partial pages count as none and are asked for again, as are errors, with waits that double; an empty page ends a range
    once it has come twice. If there is no whole page after all tries, the task fails: it never hands on a part as the whole.
    """

    def __init__(self, schema: StructType, options: dict, client: Callable[[], Ask], key: str, tries: int, wait: float):
        self.fields, self.options, self.client, self.key, self.tries, self.wait = schema.names, options, client, key, tries, wait

    def partitions(self) -> list[Range]:
        cuts = [self.options.get("from"), *json.loads(self.options.get("bounds", "[]")), self.options.get("until")]
        inner = [c for c in cuts if c is not None]
        if any(a >= b for a, b in zip(inner, inner[1:])):
            raise ValueError(f"keys are not in order: {inner}")
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[tuple]:
        ask, after = self.client(), None
        while True:
            page, why = asked(lambda: ask(partition.low, partition.high, after), usable=lambda p: p["complete"], empty=lambda p: not p["rows"], confirm=2, tries=self.tries, wait=self.wait, sleep=time.sleep)  # noqa: B023 - called at once
            if page is None:
                raise RuntimeError(f"range {partition.low!r} to {partition.high!r} after {after!r}: {why}")
            if not page["rows"]:
                return
            keys = [r[self.key]["value"] for r in page["rows"]]
            if keys != sorted(keys) or (after is not None and keys[0] <= after):
                raise RuntimeError(f"a page after {after!r} is not in the order of {self.key}")
            yield from (tuple(r.get(f, {}).get("value") for f in self.fields) for r in page["rows"])
            after = keys[-1]


def live_source(name: str, schema: str, client: Callable[[], Ask], key: str, tries: int = 10, wait: float = 1.5) -> type[DataSource]:
    """The class to register (`spark.dataSource.register`), after which `spark.read.format(name)` gives the bindings as columns of text, null where a row has none."""

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> Pages:
            return Pages(schema, self.options, client, key, tries, wait)

    return Live
