"""A stream of what happens to the files of a folder, as a Python data source: files created, modified and deleted between its batches.

    spark.dataSource.register(FolderEvents)
    spark.readStream.format("folder_events").option("path", folder).load()

A stream's offset is a snapshot of the folder: the size and the time of change of each file. What a batch holds follows
from the snapshots before and behind it, both of which Spark keeps in the checkpoint, so a batch that is run again holds
the same rows, and a restarted stream goes on from the last snapshot. The snapshot is taken by the driver, which must see
the folder; it is meant for folders of up to some hundred thousand files. Files are named by their paths below the folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Events that one task makes rows of.
PART_EVENTS = 10_000


def snapshot(folder: str) -> dict[str, list[int]]:
    """Size and time of change, in nanoseconds, of every file below folder; temporary files (~$ and hidden ones) are left out."""
    found: dict[str, list[int]] = {}
    for top, folders, names in os.walk(folder):
        folders[:] = [x for x in folders if not x.startswith(".")]
        for name in names:
            path = os.path.join(top, name)
            if not name.startswith((".", "~$")):
                try:
                    state = os.stat(path)
                except FileNotFoundError:  # deleted since it was listed
                    continue
                found[os.path.relpath(path, folder)] = [state.st_size, state.st_mtime_ns]
    return found


def changes(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str, int | None]]:
    """path, kind and size (none of a deleted file) of what differs, by path."""
    out = []
    for path in sorted(before.keys() | after.keys()):
        if path not in before:
            out.append((path, "created", after[path][0]))
        elif path not in after:
            out.append((path, "deleted", None))
        elif before[path] != after[path]:
            out.append((path, "modified", after[path][0]))
    return out


class FolderEvents(DataSource):
    """Option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return "path string, kind string, size long"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


class _Some(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int | None]]) -> None:
        super().__init__(len(rows))
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return snapshot(self.folder)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = changes(start, end)
        return [_Some(rows[k : k + PART_EVENTS]) for k in range(0, len(rows), PART_EVENTS)] or [_Some([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows
