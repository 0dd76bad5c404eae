"""Objects in a folder or bucket: a client that works from any executor, and tables of what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haulmark.schemas import OBJECTS
from haulmark.sources.sinks import delete_objects, put_objects
from haulmark.sources.tables import stored_objects


class Missing(KeyError):
    """There is no such object."""


@dataclass(frozen=True)
class ObjectStore:
    """put, get and delete below a URI that Arrow's file systems open; the client is made anew wherever it is sent."""

    root: str

    def _at(self, key: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        return store, f"{base.rstrip('/')}/{key}" if key else base

    def put(self, key: str, content: bytes) -> None:
        store, path = self._at(key)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(content)

    def get(self, key: str) -> bytes:
        store, path = self._at(key)
        try:
            with store.open_input_stream(path) as source:
                return source.read()
        except FileNotFoundError as e:
            raise Missing(key) from e

    def delete(self, key: str) -> None:
        """An object that isn't there is deleted already."""
        store, path = self._at(key)
        try:
            store.delete_file(path)
        except FileNotFoundError:
            pass


class Objects:
    """The store as a table: what is put overwrites, so retries do no harm."""

    schema = OBJECTS

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, ObjectStore(root)
        store, path = self.store._at("")
        store.create_dir(path, recursive=True)

    def read(self) -> DataFrame:
        return stored_objects(self.spark, self.store.root)

    def put(self, rows: DataFrame) -> None:
        put_objects(rows, self.store.put)

    def delete(self, keys: DataFrame) -> None:
        delete_objects(keys, self.store.delete)


def fetched(keys: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """keys (object_key) -> (object_key, bytes, error): no row for an object that get says is Missing; any other failure is
    the row's error, so that the caller can tell the two apart."""

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for key in frame["object_key"]:
                try:
                    out.append((key, get(key), None))
                except Missing:
                    continue
                except Exception as e:  # whatever a client throws is this object's error
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["object_key", "bytes", "error"])

    return keys.select("object_key").mapInPandas(read, "object_key string, bytes binary, error string")
