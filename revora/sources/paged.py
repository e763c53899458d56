"""A source that delivers records page by page, as a Spark data source with a high-water mark.

It stands for a vendor's paged interface, with a folder of JSON-lines pages in
its place: each page is read by one task, and a stream's offset counts the
entries of a log of pages in the order in which they were seen, kept beside
them, so a page is delivered once however often a batch is run and however late
it comes.  The folder must be one that driver and executors share.
Records published before ``since`` are left out at the source.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "dataset_id string, review_id string, title string, body string, rating double, published_at string, reviewer string, place string"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def _pages(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".jsonl")) if os.path.isdir(folder) else []


def _seen(folder: str) -> list[str]:
    """The log of pages in the order in which they were seen, with those that are new written at its end."""
    log = os.path.join(folder, "_seen")
    known = open(log, encoding="utf-8").read().splitlines() if os.path.exists(log) else []
    new = sorted(set(map(os.path.basename, _pages(folder))) - set(known))
    if new:
        with open(log, "a", encoding="utf-8") as out:
            out.write("".join(f"{n}\n" for n in new))
    return [os.path.join(folder, n) for n in known + new]


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _records(page: _Page, since: str) -> Iterator[tuple]:
    with open(page.path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                r = json.loads(line)
                if (r.get("published_at") or "") >= since:
                    yield tuple(float(r[f]) if f == "rating" and r.get(f) is not None else r.get(f) for f in _FIELDS)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.since = options["path"], options.get("since", "")

    def partitions(self) -> list[_Page]:
        return [_Page(p) for p in _pages(self.folder)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _records(partition, self.since)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.since = options["path"], options.get("since", "")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pages": len(_seen(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(p) for p in _seen(self.folder)[start["pages"] : end["pages"]]]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _records(partition, self.since)

    def commit(self, end: dict) -> None:
        pass


class PagedReviews(DataSource):
    """``spark.dataSource.register(PagedReviews)``, then ``spark.read.format("paged_reviews").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_reviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)
