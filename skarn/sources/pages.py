"""Recorded search pages as a Spark data source: partitions of whole files, items checked one by one.

    spark.dataSource.register(SearchPages)
    spark.read.format("search_pages").option("path", "/data/pages").load()

A page is a JSON file {"total_count": n, "items": [...]}, named by its file or, as Spark writes it, by its folder ``page=``. With option ``lines`` true, files have
many pages, one on each line, with their name as "page"; many pages then need few files. An item is good if it has a full name of the form owner/name, a whole
number of stars that isn't negative and, if any, a list of texts as topics; others come with what is wrong with them. A page whose items are all
bad, or which can't be read, says that the source has changed: it fails the read, or with option ``abort`` false is one row with the error.
"""
from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "page string, place int, full_name string, stars long, topics array<string>, total long, error string"
NAME = re.compile(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+")


def violations(item) -> str | None:
    """What is wrong with an item, by field; None if nothing is."""
    if not isinstance(item, dict):
        return "item"
    stars, topics = item.get("stargazers_count"), item.get("topics", [])
    bad = [] if isinstance(item.get("full_name"), str) and NAME.fullmatch(item["full_name"]) else ["full_name"]
    bad += [] if isinstance(stars, int) and not isinstance(stars, bool) and stars >= 0 else ["stargazers_count"]
    bad += [] if isinstance(topics, list) and all(isinstance(t, str) for t in topics) else ["topics"]
    return ",".join(bad) or None


#: Bytes and files of a partition, about.
PART_BYTES, PART_FILES = 16_000_000, 1_000


class Pages(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        on = lambda name, default: str(options.get(name, default)).lower() != "false"
        self.path, self.abort, self.lines = options["path"], on("abort", "true"), on("lines", "false")

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        fs, root = self._fs()
        out, held, size = [], [], 0
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if not f.is_file or f.base_name[0] in "._":
                continue
            if held and (size + f.size > PART_BYTES or len(held) == PART_FILES):
                out.append(Pages(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Pages(held)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fs, _ = self._fs()
        for path in partition.paths:
            *_, folder, file = path.split("/")
            with fs.open_input_stream(path) as f:
                if self.lines:
                    for n, line in enumerate(io.BufferedReader(f)):
                        if line.strip():
                            yield from self._page(f"{file}:{n + 1}", line)
                else:
                    yield from self._page(folder.removeprefix("page=") if folder.startswith("page=") else file.removesuffix(".json"), f.read())

    def _page(self, name: str, raw: bytes) -> Iterator[tuple]:
        try:
            page = json.loads(raw)
            name = str(page["page"]) if self.lines else name
            items, total = page["items"], page.get("total_count")
            if not isinstance(items, list):
                raise TypeError("items")
        except (ValueError, KeyError, TypeError) as e:
            yield from self._whole(name, None, f"unreadable: {type(e).__name__}")
            return
        total = total if isinstance(total, int) else None
        found = [violations(i) for i in items]
        if items and all(found):
            yield from self._whole(name, total, f"all {len(items)} items are bad: {found[0]}")
            return
        for place, (item, bad) in enumerate(zip(items, found, strict=True)):
            yield (name, place, None, None, None, total, bad) if bad else (name, place, item["full_name"], item["stargazers_count"], item.get("topics", []), total, None)

    def _whole(self, name: str, total: int | None, error: str) -> Iterator[tuple]:
        if self.abort:
            raise ValueError(f"page {name}: {error}")
        yield name, None, None, None, None, total, error


class SearchPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(self.options)
