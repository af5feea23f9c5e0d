"""Commits that happen once: a log of numbered files, batches with an expected sequence, generations of several tables,
archives with their record.

An entry of a log counts from the moment its file exists, and a file is created only where none is: two writers of the
same number cannot both succeed. Data is written first, under a name of its own, and is only read through the log, so
what a failed or beaten writer leaves behind is never seen. Counts and hashes are gathered while the data is written
(``Observation``), not by a second pass over the input.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other content stands where a writer wanted to commit."""


class Stale(RuntimeError):
    """The writer's expected sequence is not the newest one."""


class Log:
    """Numbered JSON entries in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at, fs = self._fs(self.folder)
        if not fs.exists(at):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName())))

    def entry(self, number: int) -> dict | None:
        at, fs = self._fs(f"{self.folder}/{number:020d}.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """The highest number and its entry, or 0 and None."""
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (0, None)

    def add(self, number: int, entry: dict) -> bool:
        """Create the entry whole, if there is none yet."""
        target, spare = f"{self.folder}/{number:020d}.json", f"{self.folder}/.{uuid.uuid4().hex}"
        at, fs = self._fs(spare)
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link is made only where no file is; Hadoop's local rename looks first, then moves
                os.link(at.toUri().getPath(), self._fs(target)[0].toUri().getPath())
                return True
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(at, self._fs(target)[0], none)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            fs.delete(at, False)


def _hash(columns: list[str]) -> Column:
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def content(rows: DataFrame) -> dict[str, str | int]:
    """Count and order-insensitive hash, by a pass of its own."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), _hash(rows.columns).alias("hash")).first().asDict()


def observed_write(rows: DataFrame, path: str, by_column: bool = False) -> dict:
    """Write Parquet; count and hash (and each column's hash) come from the same pass."""
    seen = Observation(uuid.uuid4().hex)
    each = [_hash([f"`{c}`"]).alias(f"hash_{i}") for i, c in enumerate(rows.columns)] if by_column else []
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), _hash([f"`{c}`" for c in rows.columns]).alias("hash"), *each).write.parquet(path)
    found = dict(seen.get)
    return {"rows": found["rows"], "hash": found["hash"]} | ({"columns": {c: found[f"hash_{i}"] for i, c in enumerate(rows.columns)}} if by_column else {})


class Batches:
    """Batches of events with a state each, under sequences that follow one another."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def commit(self, events: DataFrame, state: dict, expected: int) -> dict:
        """Commit ``events`` and ``state`` as sequence ``expected`` + 1. The same batch again is reconciled; another one
        under a sequence that is there raises Conflict; a sequence that does not follow raises Stale."""
        if state.get("sequence") != expected + 1:
            raise ValueError("the state's sequence must follow the expected one")
        newest, _ = self.log.newest()
        if newest > expected:
            return self._reconciled(state, content(events)) if newest == expected + 1 else self._stale(newest)
        if newest != expected:
            self._stale(newest)
        attempt = uuid.uuid4().hex
        found = observed_write(events, f"{self.folder}/data/sequence={expected + 1}/attempt={attempt}")
        if self.log.add(expected + 1, {"attempt": attempt, "state": state} | found):
            return {"reconciled": False} | found
        return self._reconciled(state, found)  # another writer was first

    def _stale(self, newest: int):
        raise Stale(f"the newest sequence is {newest}")

    def _reconciled(self, state: dict, found: dict) -> dict:
        there = self.log.entry(state["sequence"])
        if there["state"] != state or (there["rows"], there["hash"]) != (found["rows"], found["hash"]):
            raise Conflict(f"sequence {state['sequence']} holds other content")
        return {"reconciled": True, "rows": there["rows"], "hash": there["hash"]}

    def state(self) -> dict | None:
        entry = self.log.newest()[1]
        return entry and entry["state"]

    def events(self) -> DataFrame | None:
        """All committed events with their sequence; None before the first commit."""
        paths = [f"{self.folder}/data/sequence={n}/attempt={self.log.entry(n)['attempt']}" for n in self.log.numbers()]
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*paths).drop("attempt") if paths else None

    def seen(self, record: str = "record_id") -> DataFrame | None:
        """The ids that committed events hold, each once."""
        events = self.events()
        return events and events.select(record).distinct()

    def damaged(self) -> list[int]:
        """Sequences whose data is not what was committed."""
        found = []
        for n in self.log.numbers():
            entry = self.log.entry(n)
            now = content(self.spark.read.parquet(f"{self.folder}/data/sequence={n}/attempt={entry['attempt']}"))
            if (now["rows"], now["hash"]) != (entry["rows"], entry["hash"]):
                found.append(n)
        return found


class Generations:
    """Several tables that change together: readers see all of one generation or all of the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/manifests")
        self.started = Log(spark, f"{self.folder}/started")

    def write(self, tables: dict[str, DataFrame], fingerprint: str | None = None) -> dict:
        """Commit the tables as the next generation; another writer that was first raises Conflict."""
        number, name = self.log.newest()[0] + 1, uuid.uuid4().hex
        self.started.add(max(self.started.numbers(), default=0) + 1, {"data": name, "generation": number})
        rows = {t: observed_write(frame, f"{self.folder}/data/{name}/{t}") for t, frame in tables.items()}
        manifest = {"data": name, "tables": rows, "fingerprint": fingerprint}
        if not self.log.add(number, manifest):
            raise Conflict(f"generation {number} was committed by another writer")
        return manifest

    def write_if_changed(self, tables: dict[str, DataFrame], fingerprint: DataFrame) -> dict:
        """Write only if the one-value frame ``fingerprint`` is not the last generation's."""
        now = fingerprint.first()[0]
        last = self.log.newest()[1]
        if last is not None and last["fingerprint"] == now:
            return {"skipped": True, "reason": "no_changes"}
        manifest = self.write(tables, now)
        counts = {t: found["rows"] for t, found in manifest["tables"].items()}
        return {"skipped": False, "tables": counts, "total_rows": sum(counts.values())}

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        entry = self.log.newest()[1] if generation is None else self.log.entry(generation)
        if entry is None:
            raise FileNotFoundError(self.folder)
        return self.spark.read.parquet(f"{self.folder}/data/{entry['data']}/{table}")

    def recover(self) -> list[str]:
        """Remove what unfinished generations wrote; to be called while nobody writes. Returns the folders removed."""
        kept = {self.log.entry(n)["data"] for n in self.log.numbers()}
        gone = []
        for n in self.started.numbers():
            name = self.started.entry(n)["data"]
            at, fs = self.log._fs(f"{self.folder}/data/{name}")
            if name not in kept and fs.exists(at):
                fs.delete(at, True)
                gone.append(name)
        return gone


def archive_names(header: list[str | None]) -> list[str]:
    """Column names of an archive: lower case, words joined by underscores, unique, never blank."""
    names: list[str] = []
    for i, raw in enumerate(header, 1):
        name = re.sub(r"\W+", "_", (raw or "").strip()).strip("_").lower() or f"col_{i}"
        while name in names:
            name += "_"
        names.append(name)
    return names


def as_text(rows: DataFrame) -> DataFrame:
    """All columns as text, under archive names."""
    names = archive_names(rows.columns)
    return rows.toDF(*names).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])


class Archive:
    """Snapshots of tables as text, each with a record of its rows and hashes, and a check of live tables against them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.generations = Generations(spark, folder)

    def snapshot(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        """Write all tables, each in one pass over its input, read them back, and commit them with their record."""
        kept = self.generations
        name = uuid.uuid4().hex
        record = {}
        for table, rows in tables.items():
            path = f"{kept.folder}/data/{name}/{table}"
            record[table] = observed_write(as_text(rows), path, by_column=True)
            back = content(self.spark.read.parquet(path))
            if (back["rows"], back["hash"]) != (record[table]["rows"], record[table]["hash"]):
                raise ValueError(f"{table} differs from what was written")
        if not kept.log.add(kept.log.newest()[0] + 1, {"data": name, "tables": record, "fingerprint": None}):
            raise Conflict("another snapshot was committed meanwhile")
        return record

    def read(self, table: str) -> DataFrame:
        return self.generations.read(table)

    def verify(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        """Per table: ok, rows, archived_rows and the columns that differ. One pass over each table."""
        record = (self.generations.log.newest()[1] or {"tables": {}})["tables"]
        found = {}
        for table, rows in tables.items():
            text, known = as_text(rows), record.get(table, {"rows": None, "hash": None, "columns": {}})
            each = [_hash([f"`{c}`"]).alias(f"hash_{i}") for i, c in enumerate(text.columns)]
            now = text.agg(F.count(F.lit(1)).alias("rows"), _hash([f"`{c}`" for c in text.columns]).alias("hash"), *each).first()
            differ = [c for i, c in enumerate(text.columns) if now[f"hash_{i}"] != known["columns"].get(c)] + [c for c in known["columns"] if c not in text.columns]
            found[table] = {"ok": (now["rows"], now["hash"]) == (known["rows"], known["hash"]) and not differ, "rows": now["rows"], "archived_rows": known["rows"], "differ": differ}
        return found
