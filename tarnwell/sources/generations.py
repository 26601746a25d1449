"""Generation-versioned datasets: write beside, then move one small pointer."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tarnwell.schemas import schema


class Conflict(RuntimeError):
    """The base generation is no longer the active one."""


@dataclass(frozen=True)
class Delta:
    """Rows to add to a table, and the keys (one column of that name) whose rows go first."""

    rows: DataFrame
    gone: DataFrame | None = None
    key: str = ""


#: Parts of a table from which on it is written anew as one.
MOST_PARTS = 8


class GenerationStore:
    """Tables of a folder by generation. Readers keep the generation that they opened.

    Data is written by Spark to folders of its own, which never change. A table is a
    list of parts, each rows with the keys that it takes from the parts before, so a
    change writes in proportion to itself. A generation is published by
    creating its state file, which only one publisher can do; nothing is locked, so a
    publisher that dies leaves nothing to clear away. A state that was not written to its
    end carries no valid checksum and is passed over, as is a failed write of data.
    Folder and states are reached through Hadoop's file systems, so they may lie in any
    store that the executors share.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        master = spark.sparkContext.master
        if "://" not in root and master != "local" and not master.startswith("local["):
            raise ValueError("on a cluster the folder must be the URI of a shared store")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._paths(self.root))

    def _state(self, generation: int) -> dict | None:
        """A published state; None if there is none or it was not written to its end."""
        path = self._paths(f"{self.root}/generation-{generation:09d}.json")
        if not self._files.exists(path):
            return None
        source = self._files.open(path)
        try:
            text = bytes(source.readAllBytes()).decode("utf-8", "replace")
        finally:
            source.close()
        digest, _, body = text.partition("\n")
        return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == digest else None

    def _published(self) -> list[int]:
        found = [str(f.getPath().getName()) for f in self._files.listStatus(self._paths(self.root))]
        return sorted((int(n[11:20]) for n in found if n.startswith("generation-") and n.endswith(".json")), reverse=True)

    def active(self) -> dict:
        for generation in self._published():
            state = self._state(generation)
            if state is not None:
                return state
        return {"generation": 0, "tables": {}, "manifest": "", "profile": ""}

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        """A table of a generation; empty, with its schema, before the first."""
        parts = (at or self.active())["tables"].get(table)
        if not parts:
            return self.spark.createDataFrame([], schema(table))
        return self._joined(parts)

    def _joined(self, parts: list[dict]) -> DataFrame:
        """The parts' rows without those that a later part takes away."""
        out = None
        for k, part in enumerate(parts):
            rows = self.spark.read.parquet(part["data"])
            later = [p for p in parts[k + 1 :] if p["gone"]]
            for p in later:
                gone = self.spark.read.parquet(p["gone"])
                rows = rows.join(gone, p["key"], "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _write(self, df: DataFrame, name: str, base: int) -> str:
        path = f"{self.root}/{name}-{base + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path

    def publish(self, base: int, tables: dict[str, DataFrame | Delta], manifest: str | None = None, profile: str | None = None) -> dict:
        """Make a new generation of the given tables; the others stay. Raises Conflict if ``base`` is not active.

        A DataFrame is the whole table, a Delta is added to what is there. A table of
        MOST_PARTS parts is written anew as one.
        """
        now = self.active()
        if now["generation"] != base:
            raise Conflict(f"base {base}, active {now['generation']}")
        written = dict(now["tables"])
        for name, table in tables.items():
            if isinstance(table, DataFrame):
                written[name] = [{"data": self._write(table, name, base), "gone": None, "key": ""}]
                continue
            part = {"data": self._write(table.rows, name, base), "gone": self._write(table.gone, f"{name}-gone", base) if table.gone is not None and written.get(name) else None, "key": table.key}
            parts = [*written.get(name, []), part]
            if len(parts) >= MOST_PARTS:
                parts = [{"data": self._write(self._joined(parts), name, base), "gone": None, "key": ""}]
            written[name] = parts
        # Numbers of states that were not written to their end are not used again.
        number = max([base, *self._published()]) + 1
        state = {"generation": number, "tables": written, "manifest": now["manifest"] if manifest is None else manifest, "profile": now.get("profile", "") if profile is None else profile}
        if self.active()["generation"] != base:
            raise Conflict(f"base {base}, active {self.active()['generation']}")
        body = json.dumps(state, sort_keys=True)
        try:
            out = self._files.create(self._paths(f"{self.root}/generation-{number:09d}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(f"generation {number} is being published") from e
        try:
            out.write(bytearray(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode()))
        finally:
            out.close()
        return state

    def collect(self, keep: int = 2) -> int:
        """Delete states older than the newest ``keep`` and the data that none of these names; the number of folders.

        Readers of an older generation fail from then on. Data of a publication under
        way is newer than the active generation and stays.
        """
        states = [s for n in self._published() if (s := self._state(n)) is not None]
        kept, old = states[:keep], states[keep:]
        named = {path for s in kept for parts in s["tables"].values() for part in parts for path in (part["data"], part["gone"]) if path}
        newest = kept[0]["generation"] if kept else 0
        gone = 0
        for f in self._files.listStatus(self._paths(self.root)):
            name = str(f.getPath().getName())
            made = re.fullmatch(r"[a-z_-]+-(\d+)-[0-9a-f]{8}", name)
            if made and int(made.group(1)) <= newest and f"{self.root}/{name}" not in named:
                self._files.delete(f.getPath(), True)
                gone += 1
        for s in old:
            self._files.delete(self._paths(f"{self.root}/generation-{s['generation']:09d}.json"), False)
        return gone


def replace_file(path: str, data: bytes) -> None:
    """Write a file so that a reader sees the old or the new one, whole."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def write_artifact(folder: str, files: dict[str, bytes]) -> str:
    """An immutable folder of small files with their checksums; refuses to overwrite one."""
    if os.path.exists(folder):
        raise FileExistsError(folder)
    temp = f"{folder}.{uuid.uuid4().hex[:8]}.tmp"
    os.makedirs(temp)
    sums = []
    for name, data in sorted(files.items()):
        with open(os.path.join(temp, name), "wb") as f:
            f.write(data)
        sums.append(f"{hashlib.sha256(data).hexdigest()}  {name}\n")
    with open(os.path.join(temp, "SHA256SUMS"), "w", encoding="utf-8") as f:
        f.writelines(sums)
    os.rename(temp, folder)
    return hashlib.sha256("".join(sums).encode()).hexdigest()


def verify_artifact(folder: str) -> None:
    """Raise unless every file has its checksum and there is no other."""
    with open(os.path.join(folder, "SHA256SUMS"), encoding="utf-8") as f:
        wanted = {line.rstrip("\n").split("  ", 1)[1]: line[:64] for line in f}
    if set(os.listdir(folder)) != {*wanted, "SHA256SUMS"}:
        raise ValueError("files and checksums differ")
    for name, digest in wanted.items():
        with open(os.path.join(folder, name), "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != digest:
                raise ValueError(f"{name} has another checksum")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; an existing folder is not overwritten."""
    df.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line fails the read."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
