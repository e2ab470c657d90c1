"""The store on disk: Parquet tables in version folders and one pointer file, changed as a whole or not at all."""

from __future__ import annotations

import json
import posixpath
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..schema import SCHEMA_VERSION, TABLES

POINTER = "CURRENT"


class StoreError(RuntimeError):
    pass


class Store:
    """One writer at a time. A commit writes the changed tables beside the old ones and then moves the pointer."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(folder)

    def _pointer(self) -> dict | None:
        at = posixpath.join(self.base, POINTER)
        if self.fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def stored_version(self) -> int | None:
        """Schema version of what is stored: None if nothing is, 0 if it doesn't say. Creates nothing."""
        held = self._pointer()
        return None if held is None else held.get("schema_version", 0)

    def open(self) -> "Store":
        """Create an empty store, bring one of version 4 up to date, or refuse any other version."""
        version = self.stored_version()
        if version is None:
            self._point({"schema_version": SCHEMA_VERSION, "commit": 0, "tables": {}})
        elif version == SCHEMA_VERSION - 1:
            # version 5 added parked_lines, which starts empty
            self._point(self._pointer() | {"schema_version": SCHEMA_VERSION})
        elif version != SCHEMA_VERSION:
            raise StoreError(f"the store has schema version {version}, this library reads {SCHEMA_VERSION}")
        return self

    def _point(self, held: dict) -> None:
        self.fs.create_dir(self.base, recursive=True)
        fresh = posixpath.join(self.base, f"{POINTER}-{uuid.uuid4().hex}")
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps(held, sort_keys=True).encode())
        self.fs.move(fresh, posixpath.join(self.base, POINTER))

    def read(self, table: str) -> DataFrame:
        """A table as of the last commit; its schema is fixed, so an empty store has empty tables."""
        at = (self._pointer() or {"tables": {}})["tables"].get(table)
        if at is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(posixpath.join(self.folder, at))

    def commit(self, **changed: DataFrame) -> int:
        """Replace tables; all become visible at once. Fails if another writer has committed since."""
        before = self._pointer()
        if before is None:
            raise StoreError("open() the store first")
        number = before["commit"] + 1
        tables = dict(before["tables"])
        for name, df in changed.items():
            at = f"v{number:08d}-{uuid.uuid4().hex[:8]}/{name}"
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            self.spark.createDataFrame([], TABLES[name]).unionByName(df.select(*columns)).write.parquet(posixpath.join(self.folder, at))
            tables[name] = at
        if self._pointer() != before:
            raise StoreError("another writer has committed")
        self._point(before | {"commit": number, "tables": tables})
        return number

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(f"key = '{key}'").first() if key.replace("_", "").replace(".", "").isalnum() else None
        return row.value if row else None

    def tables(self) -> list[str]:
        return sorted(TABLES)
