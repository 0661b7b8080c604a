"""Snapshots of a store's layer in one file, valid for one version of one store.

A file holds the version (u64, big-endian), eight bytes of a digest of the
store's identity, and the layer in its plain binary form. A file that is not
this version's, not this store's, a link, or (when strict) another user's or
writable by others, is not served.
"""

from __future__ import annotations

import os
import stat
import struct
import tempfile

from pyspark.sql import SparkSession

from ..operators.layers import Layer
from .codec import FormatError, decode_layer, encode_layer
from .store import CountStore

_HEAD = struct.Struct(">Q8s")


def _digest(identity: str) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(identity.encode())


class FileSnapshot:
    """A layer's snapshot at a path of the driver's machine."""

    def __init__(self, path: str, strict: bool = True, mode: int = 0o600) -> None:
        """mode: the permissions that a file is written with. Strict readers refuse a file that others may write."""
        if strict and mode & 0o022:
            raise ValueError("a file that others may write would not be served when strict")
        self.path, self.strict, self.mode = path, strict, mode

    def _trusted(self) -> bool:
        try:
            found = os.lstat(self.path)
        except OSError:
            return False
        if not stat.S_ISREG(found.st_mode):
            return False
        return not self.strict or (found.st_uid == os.geteuid() and not found.st_mode & 0o022)

    def read(self, spark: SparkSession, version: int, identity: str) -> Layer | None:
        if not self._trusted():
            return None
        with open(self.path, "rb") as f:
            head = f.read(_HEAD.size)
            if len(head) < _HEAD.size or _HEAD.unpack(head) != (version, _digest(identity)):
                return None
            try:
                return decode_layer(spark, f.read())
            except FormatError:
                return None

    def write(self, layer: Layer, version: int, identity: str) -> None:
        """Written beside its place and moved, so a reader sees a whole file."""
        folder = os.path.dirname(self.path) or "."
        os.makedirs(folder, 0o700, exist_ok=True)
        data = _HEAD.pack(version, _digest(identity)) + encode_layer(layer, compressed=False)
        handle, temp = tempfile.mkstemp(dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.chmod(temp, self.mode)
            os.replace(temp, self.path)
        finally:
            if os.path.exists(temp):
                os.unlink(temp)

    def load(self, store: CountStore) -> Layer:
        """The store's layer: from the file if it is this version's, else from the store, and then written."""
        version, identity = store.version(), store.identity()
        found = self.read(store.spark, version, identity)
        if found is None:
            found = store.load()
            if store.version() == version:
                self.write(found, version, identity)
        return found
