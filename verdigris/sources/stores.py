"""A store of tensors and training states, addressed by what they were made from.

An entry's key is the digest of all its fields (source, split, model, options, and a digest
of the source's content), so entries of different origin cannot meet; the fields lie beside
the entry and are compared when it is read.  Tables are Parquet, committed by Spark; states
are arrays in one file, which is written under another name and then moved.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .image_files import opened

#: Changes when entries written before could not be read any more.
VERSION = 1


def content_digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of the rows, whatever their order and partitioning: their number and two sums of hashes."""
    columns = list(columns or df.columns)
    hashes = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")) for k in (1, 2)]
    return hashlib.sha256(repr(tuple(df.agg(F.count("*"), *hashes).first())).encode()).hexdigest()


def _text(fields: Mapping) -> str:
    return json.dumps({"version": VERSION} | dict(fields), sort_keys=True, ensure_ascii=False)


class Store:
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def key(self, fields: Mapping) -> str:
        return hashlib.sha256(_text(fields).encode()).hexdigest()

    def _put(self, name: str, data: bytes) -> None:
        files, root = opened(self.root)
        files.create_dir(f"{root}/{name.rpartition('/')[0]}")
        temporary = f"{root}/{name.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as f:
            f.write(data)
        files.move(temporary, f"{root}/{name}")

    def _get(self, name: str) -> bytes | None:
        files, root = opened(self.root)
        if files.get_file_info(f"{root}/{name}").type != fs.FileType.File:
            return None
        with files.open_input_stream(f"{root}/{name}") as f:
            return f.read()

    def _checked(self, key: str, fields: Mapping) -> None:
        told = self._get(f"{key}/fields.json")
        if told is None or told.decode() != _text(fields):
            raise ValueError(f"entry {key} was made from other fields: {told and told.decode()}")

    def table(self, spark: SparkSession, fields: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
        """The entry's table; made and written only if it is not there whole."""
        key = self.key(fields)
        if self._get(f"{key}/table/_SUCCESS") is None:
            self._put(f"{key}/fields.json", _text(fields).encode())
            make().write.mode("overwrite").parquet(f"{self.root}/{key}/table")
        self._checked(key, fields)
        return spark.read.parquet(f"{self.root}/{key}/table")

    def save(self, fields: Mapping, state: Mapping[str, np.ndarray | float | int]) -> str:
        """Writes a state, in place of the entry's last; its key."""
        key, out = self.key(fields), io.BytesIO()
        np.savez(out, **state)
        self._put(f"{key}/fields.json", _text(fields).encode())
        self._put(f"{key}/state.npz", out.getvalue())
        return key

    def load(self, fields: Mapping, key: str | None = None) -> dict[str, np.ndarray] | None:
        """The entry's state, or None; a `key` of an entry with other fields is refused."""
        key = key or self.key(fields)
        data = self._get(f"{key}/state.npz")
        if data is None:
            return None
        self._checked(key, fields)
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return {name: z[name] for name in z.files}
