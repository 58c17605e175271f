"""Versioned manifest of an index: which files make it up. A version never changes; a commit adds the next one.

Manifests are small JSON files, ``manifest/v<number>.json``. Of two writers that commit the same version one fails: on a
local disk the name is a hard link to a complete draft, on HDFS a draft is renamed, which doesn't overwrite there, and on
object stores, whose rename is a copy, the file is created on the condition that there is none. Parquet files that are
being read are never overwritten: every write goes to a new path, and ``vacuum`` removes what neither a kept version nor
a write that is going on uses.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Segment:
    """A set of posting rows (term, rid, freq) in files of their own, with its smallest and largest term; start and level are those of log-merge.

    A segment without rows has no path.
    """

    path: str
    kind: str  # main, aux, level or tail
    level: int | None = None
    start: int | None = None
    rows: int = 0
    first: str | None = None
    last: str | None = None


@dataclass
class Manifest:
    version: int = 0
    strategy: str = "simple"
    capacity: int = 0
    next_rid: int = 1
    flushes: int = 0
    malformed: int = 0
    #: rows, their kept terms and all their tokens in the metadata files, deleted reviews among them until they are purged
    reviews: int = 0
    tokens: int = 0
    raw_tokens: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    meta: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)

    def paths(self) -> set[str]:
        return {s.path for s in self.segments if s.rows} | set(self.meta) | set(self.tombstones)


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @contextmanager
    def draft(self) -> Iterator[None]:
        """While it lasts, files at ``fresh`` paths are known to belong to a write that is going on."""
        self._token = uuid.uuid4().hex
        mark = self._path(f"{self.root}/open/{self._token}")
        self.fs.create(mark, True).close()
        try:
            yield
        finally:
            self._token = ""
            self.fs.delete(mark, False)

    def fresh(self, label: str) -> str:
        return f"{self.root}/data/{getattr(self, '_token', '') or 'none'}-{label}-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int | None = None) -> Manifest:
        """A version, the latest by default; an index that was never written is an error."""
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"no index at {self.root}")
            version = known[-1]
        stream = self.fs.open(self._path(f"{self.root}/manifest/v{version}.json"))
        try:
            raw = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        raw["segments"] = [Segment(**s) for s in raw["segments"]]
        return Manifest(**raw)

    def exists(self) -> bool:
        return bool(self.versions())

    def commit(self, manifest: Manifest, conditional: bool | None = None) -> Manifest:
        """Make the manifest the next version; fails if another writer was faster. conditional: as on an object store."""
        manifest.version += 1
        name = self._path(f"{self.root}/manifest/v{manifest.version}.json")
        data = bytearray(json.dumps(asdict(manifest)).encode())
        scheme = self.fs.getUri().getScheme()
        lost = RuntimeError(f"version {manifest.version} was committed by another writer")
        if conditional if conditional is not None else scheme not in ("file", "hdfs", "viewfs"):
            try:
                builder = self.fs.createFile(name).overwrite(False).recursive()
                stream = builder.opt("fs.option.create.conditional.overwrite", "true").build()
                stream.write(data)
                stream.close()  # where the store decides
            except Exception as e:
                if self.fs.exists(name):
                    raise lost from e
                raise
            return manifest
        draft = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(data)
        stream.close()
        try:
            if scheme == "file":
                os.link(draft.toUri().getPath(), name.toUri().getPath())
            elif self.fs.exists(name) or not self.fs.rename(draft, name):
                raise lost
        except FileExistsError:
            raise lost from None
        finally:
            self.fs.delete(draft, False)
        return manifest

    def vacuum(self, keep: int = 1, spare_s: float = 86_400, stale_s: float = 7 * 86_400) -> list[str]:
        """Remove old versions but the last ``keep``, and the files that no kept one uses; the names of what was removed.

        Spared are files younger than spare_s seconds and those of writes that are going on. A write that has been
        going on for stale_s seconds is taken for dead.
        """

        def listed(folder: str) -> list:
            path = self._path(folder)
            return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

        # in this order: a write whose files are seen here is then either going on or committed
        now, files = time.time(), listed(f"{self.root}/data")
        open_ = {x.getPath().getName() for x in listed(f"{self.root}/open") if now - x.getModificationTime() / 1000 < stale_s}
        known = self.versions()
        used = {p.rsplit("/data/", 1)[-1] for v in known[-keep:] for p in self.load(v).paths()}
        for v in known[:-keep]:
            self.fs.delete(self._path(f"{self.root}/manifest/v{v}.json"), False)
        gone = []
        for status in files:
            path = status.getPath()
            name = path.getName()
            if name in used or name.split("-", 1)[0] in open_ or now - status.getModificationTime() / 1000 < spare_s:
                continue
            parts = [x.getPath() for x in listed(path.toString())]
            dead = [x for x in parts if x.getName().startswith("seg=") and f"{name}/{x.getName()}" not in used]
            for x in dead if len(dead) < sum(x.getName().startswith("seg=") for x in parts) else [path]:
                self.fs.delete(x, True)
                gone.append(x.getName())
        return gone

    def drop(self) -> None:
        self.fs.delete(self._path(self.root), True)

    def disk_bytes(self, manifest: Manifest | None = None) -> int:
        """Bytes of the files of a version; of everything there is without one."""
        paths = [self.root] if manifest is None else sorted(manifest.paths())
        return sum(self.fs.getContentSummary(self._path(p)).getLength() for p in paths)
