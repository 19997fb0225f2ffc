"""A queue as a streaming source: messages are taken in order, and given up to the queue only once their batch is done.

The queue is a shared folder. ``publish`` adds a segment, a file of JSON lines
whose name says the number of its first message. A consumer group's place is a
file of its own that moves when Spark commits a batch, so a batch that fails
after it wrote is read again from the same place, with the same messages.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, correlation_header string, offset long, timestamp timestamp"
MOST = 100
#: Messages that one task reads.
PART = 1000


def _put(path: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """First number, number of messages, and file of each segment, in order."""
    folder = f"{path}/segments"
    names = sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n.endswith(".jsonl"))
    out = []
    for n in names:
        first, count = n.removesuffix(".jsonl").split("-")
        out.append((int(first), int(count), f"{folder}/{n}"))
    return out


def end(path: str) -> int:
    """The number that the next message will get."""
    found = segments(path)
    return found[-1][0] + found[-1][1] if found else 0


def publish(path: str, messages: Iterable[tuple[str, str | None]]) -> int:
    """Add (value, correlation id) messages; one publisher at a time."""
    lines = [json.dumps({"value": v, "id": i}) for v, i in messages]
    first = end(path)
    if lines:
        _put(f"{path}/segments/{first:020d}-{len(lines)}.jsonl", "\n".join(lines))
    return first + len(lines)


def committed(path: str, group: str) -> int:
    try:
        with open(f"{path}/groups/{group}", encoding="utf-8") as f:
            return int(f.read())
    except FileNotFoundError:
        return 0


def purge(path: str) -> int:
    """Remove segments that every group is past; returns how many. The newest stays, for the numbers to go on."""
    folder = f"{path}/groups"
    groups = [n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if not n.endswith(".tmp")]
    past = min((committed(path, g) for g in groups), default=0)
    gone = [file for first, count, file in segments(path)[:-1] if first + count <= past]
    for file in gone:
        os.remove(file)
    return len(gone)


@dataclass
class Part(InputPartition):
    file: str
    first: int
    low: int
    high: int


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.group, self.most = options["path"], options.get("group", "default"), int(options.get("most", MOST))
        self.place = committed(self.path, self.group)

    def initialOffset(self) -> dict:
        return {"next": committed(self.path, self.group)}

    def latestOffset(self) -> dict:
        return {"next": max(self.place, min(end(self.path), self.place + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = start["next"], end["next"]
        self.place = max(self.place, high)
        out = []
        for first, count, file in segments(self.path):
            a, b = max(low, first), min(high, first + count)
            out += [Part(file, first, k, min(k + PART, b)) for k in range(a, b, PART)]
        if sum(p.high - p.low for p in out) != high - low:
            raise RuntimeError(f"messages {low} to {high - 1} are no longer all in the queue")
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        when = os.path.getmtime(partition.file)
        from datetime import datetime

        with open(partition.file, encoding="utf-8") as f:
            for k, line in enumerate(f, partition.first):
                if partition.low <= k < partition.high:
                    said = json.loads(line)
                    yield said["value"], said["id"], k, datetime.fromtimestamp(when)

    def commit(self, end: dict) -> None:
        if end["next"] > committed(self.path, self.group):
            _put(f"{self.path}/groups/{self.group}", str(end["next"]))


class QueueSource(DataSource):
    """``spark.readStream.format("address_queue")`` with options path, group and most (messages of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "address_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(dict(self.options))


def stream(spark: SparkSession, path: str, group: str = "default", most: int = MOST) -> DataFrame:
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("address_queue").options(path=path, group=group, most=str(most)).load()
