"""A streaming source of file changes: new, rewritten, grown and vanished transcripts.

A file stream of Spark's own sees a file once, under its name. Here an offset
is the number of an inventory pass: each look at the roots that finds a
difference in names, lengths or times writes what changed under the next
number, and a micro-batch is what changed between two numbers, cut into
partitions of some files each. Where a query starts again, its checkpoint names
the last pass it took, and the log gives what came after.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, change string, length long, modified_ns long"
LOGGED = pa.schema([("path", pa.string()), ("change", pa.string()), ("length", pa.int64()), ("modified_ns", pa.int64())])

#: What a pass knows of a file: length and time of change.
Known = dict[str, tuple[int, int]]


def place(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a URI or local path, the path in it, and what stands before such a path in a URI. Local paths get `file:`, as Spark writes them."""
    local = re.sub(r"^file:/*(?=/)", "", uri)
    if "://" not in local:
        return fs.LocalFileSystem(), local, "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: uri.index(path.lstrip("/"))].rstrip("/") + ("" if path.startswith("/") else "/")


def look(roots: Sequence[str], older_than_ns: int) -> tuple[Known, set[str]]:
    """Length and time of the *.jsonl files under the roots that hold bytes and did not change since; and the paths of those that did, which wait for a later pass."""
    known: Known = {}
    active: set[str] = set()
    for root in roots:
        system, path, prefix = place(root)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        for f in found or [system.get_file_info(path)]:
            if f.type == fs.FileType.File and f.path.endswith(".jsonl") and f.size and not re.search(r"(^|/)[._]", f.path.removeprefix(path)):
                if f.mtime_ns > older_than_ns:
                    active.add(prefix + f.path)
                else:
                    known[prefix + f.path] = (f.size, f.mtime_ns)
    return known, active


def differences(before: Known, now: Known, active: set[str]) -> list[tuple[str, str, int | None, int | None]]:
    """What changed from one pass to the next; files that are still being written stay as they were."""
    out = [(p, "new" if p not in before else "changed", *v) for p, v in now.items() if before.get(p) != v]
    return sorted(out) + sorted((p, "vanished", None, None) for p in before.keys() - now.keys() - active)


class Log:
    """The passes so far in a folder that survives the driver: `changes-n` holds what pass n found, `files-n` all files as of pass n."""

    def __init__(self, uri: str):
        self.fs, self.path, _ = place(uri)

    def numbers(self, kind: str) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(rf"{kind}-(\d+)\.parquet", f.base_name)))

    def name(self, kind: str, n: int) -> str:
        return f"{self.path}/{kind}-{n:09d}.parquet"

    def write(self, kind: str, n: int, rows: Sequence[tuple]) -> None:
        """A file under its name is whole, as it gets it last."""
        self.fs.create_dir(self.path, recursive=True)
        columns = zip(*rows, strict=True) if rows else [[]] * len(LOGGED)
        with self.fs.open_output_stream(self.name(kind, n) + ".part") as out:
            pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, LOGGED.types, strict=True)], schema=LOGGED), out)
        self.fs.move(self.name(kind, n) + ".part", self.name(kind, n))

    def read(self, kind: str, n: int) -> list[tuple]:
        with self.fs.open_input_file(self.name(kind, n)) as f:
            return [tuple(r.values()) for r in pq.read_table(f).to_pylist()]

    def last(self) -> int:
        return max([0, *self.numbers("changes"), *self.numbers("files")])

    def since(self, start: int, end: int) -> list[tuple]:
        """The last change of each path in the passes after `start` up to `end`. Where passes were folded since, all files of the fold count as new."""
        found: dict[str, tuple] = {}
        fold = max((n for n in self.numbers("files") if n <= end), default=0)
        if fold > max(start, 0):
            found = {r[0]: r for r in self.read("files", fold)}
        for n in self.numbers("changes"):
            if max(start, fold if found else 0) < n <= end:
                found |= {r[0]: r for r in self.read("changes", n)}
        return [found[p] for p in sorted(found)]

    def files(self, end: int) -> Known:
        return {p: (length, ns) for p, change, length, ns in self.since(-1, end) if change != "vanished"}

    def fold(self, end: int, known: Known) -> None:
        """All files as of pass `end` in one, and earlier passes deleted."""
        self.write("files", end, [(p, "new", *v) for p, v in sorted(known.items())])
        for kind in ("changes", "files"):
            for n in self.numbers(kind):
                if n < end + (kind == "changes"):
                    self.fs.delete_file(self.name(kind, n))


@dataclass
class Some(InputPartition):
    """Some changes of a micro-batch."""

    rows: list[tuple]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.log = json.loads(options["roots"]), Log(options["log"])
        self.quiet_ns = int(float(options.get("quiet_s", "5")) * 1e9)
        self.each, self.fold_after = int(options.get("files_per_partition", "1000")), int(options.get("fold_after", "10"))
        self.now: tuple[int, Known] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pass": 0}

    def known(self, n: int) -> Known:
        if self.now is None or self.now[0] != n:
            self.now = n, self.log.files(n)
        return self.now[1]

    def latestOffset(self) -> dict:  # noqa: N802
        """Looks at the roots; a difference makes a new pass."""
        n = self.log.last()
        known = self.known(n)
        seen, active = look(self.roots, time.time_ns() - self.quiet_ns)
        if found := differences(known, seen, active):
            n += 1
            self.log.write("changes", n, found)
            self.now = n, seen | {p: known[p] for p in active & known.keys()}
        return {"pass": n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        rows = self.log.since(start["pass"], end["pass"]) if start["pass"] < end["pass"] else []
        return [Some(rows[i : i + self.each]) for i in range(0, len(rows), self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Folds passes that no batch will ask for again, once there are some."""
        if sum(n <= end["pass"] for n in self.log.numbers("changes")) >= self.fold_after:
            self.log.fold(end["pass"], self.log.files(end["pass"]))


class FileChanges(DataSource):
    """Format `file_changes`: path, change (new, changed, vanished), length and time of the *.jsonl files under the roots. Options: roots (a JSON list), log (a folder of its own that outlives the driver), quiet_s, files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> ChangeReader:  # noqa: N802
        return ChangeReader(dict(self.options))
