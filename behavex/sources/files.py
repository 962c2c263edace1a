"""Small files through Hadoop's file systems: the one-off names by which table versions are committed."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session within one process may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._of(self.path))

    def _at(self, name: str):
        return self._of(f"{self.path}/{name}")

    def names(self, under: str = "", hidden: bool = False) -> list[str]:
        """The names in the folder or one below it; those that begin with _ or . only if hidden."""
        where = self._at(under) if under else self._of(self.path)
        found = (s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else ()
        return sorted(n for n in found if hidden or n[0] not in "_.")

    def files(self, under: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files in a folder below this one."""
        where = self._at(under)
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(where) if s.isFile()] if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Makes the file with its whole text, by renaming one that nobody else knows; False if the name is taken,
        also by a writer that came between. A file, since a folder would be renamed into an existing one."""
        tmp, final = self._at(f"_{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            done = not self._fs.exists(final) and self._fs.rename(tmp, final)
        except Exception:  # some file systems say so by an exception
            if not self._fs.exists(final):
                raise
            done = False
        if not done:
            self._fs.delete(tmp, False)
        return done

    def move(self, name: str, to: str) -> None:
        if self._fs.exists(self._at(to)) or not self._fs.rename(self._at(name), self._at(to)):
            raise FileExistsError(f"{self.path}/{to}")

    def age_hours(self, path: str) -> float:
        return (time.time() - self._fs.getFileStatus(self._of(path)).getModificationTime() / 1000) / 3600

    def delete_path(self, path: str) -> None:
        self._fs.delete(self._of(path), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
