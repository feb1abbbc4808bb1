"""A paged history as a Spark data source, with waits that the server asks for."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

PAGE, MOST, ATTEMPTS = 100, 5000, 20


class Wait(Exception):
    """Raised by a fetcher when the server wants a pause."""

    def __init__(self, seconds: float):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds


def patiently(call: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; a :class:`Wait` is waited for, ``attempts`` times at most."""
    for last in range(attempts - 1, -1, -1):
        try:
            return call()
        except Wait as w:
            if not last:
                raise
            sleep(w.seconds)
    raise ValueError("attempts must be positive")


def pages(fetch: Callable[[int, int], list[dict]], after: int = 0, most: int = MOST, page: int = PAGE, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Records from the newest on, down to the id ``after``.

    ``fetch(offset, limit)`` gives up to ``limit`` records with an id under ``offset`` (0: the newest),
    newest first.  It ends at an empty page, at ``most`` records, at a known id, or when the cursor no
    longer moves.  The last page is no larger than what is still wanted.
    """
    offset = given = 0
    while given < most:
        found = patiently(lambda: fetch(offset, min(page, most - given)), sleep=sleep)  # noqa: B023
        ids = [r["source_msg_id"] for r in found if r["source_msg_id"] > 0]
        for r in found:
            if r["source_msg_id"] > max(0, after) and given < most:
                given += 1
                yield r
        if not ids or min(ids) <= after or (offset and min(ids) >= offset):
            return
        offset = min(ids)


class HistorySource(DataSource):
    """``spark.read.format("history")`` with options ``fetcher`` ("module:function" of (chat, offset,
    limit)), ``chat``, ``after``, ``most`` and ``page``, and the schema of the records."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return "source_chat string, source_msg_id long, date_epoch long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = dict(options), names

    def read(self, partition) -> Iterator[tuple]:
        module, _, function = self.options["fetcher"].partition(":")
        fetch, chat = getattr(importlib.import_module(module), function), self.options.get("chat", "")
        number = lambda k, default: int(self.options.get(k, default))
        for r in pages(lambda offset, limit: fetch(chat, offset, limit), number("after", 0), number("most", MOST), number("page", PAGE)):
            yield tuple(r.get(n) for n in self.names)
