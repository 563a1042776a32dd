"""Small files and text lines through Spark's file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.session import shared_dir

SMALL = 16 << 20


class Folder:
    """A path on any Hadoop file system, for the few small files of a dataset."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def is_folder(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._at(name)).isDirectory()

    def names(self, name: str = "") -> list[tuple[str, int]]:
        """Names and sizes of what lies in the folder."""
        return [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._at(name))]

    def read(self, name: str = "", most: int = SMALL) -> bytes:
        if self.fs.getFileStatus(self._at(name)).getLen() > most:
            raise ValueError(f"{name or self.path} is larger than {most} bytes")
        # these files may be edited by hand, which local checksum files don't survive
        self.fs.setVerifyChecksum(False)
        try:
            stream = self.fs.open(self._at(name))
        finally:
            self.fs.setVerifyChecksum(True)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: the file is renamed into place."""
        part = self._at(f"{name}.partial")
        self.fs.setWriteChecksum(False)
        try:
            stream = self.fs.create(part, True)
        finally:
            self.fs.setWriteChecksum(True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._put(part, self._at(name))

    def _put(self, old, new) -> None:
        """Rename over what is there, in one step of the file system. Where Hadoop has no such rename for a store, what is
        there goes first."""
        hadoop = self._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        try:
            context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        except Py4JJavaError as e:
            if "UnsupportedFileSystem" not in str(e.java_exception):
                raise
            self.fs.delete(new, False)
            self.fs.rename(old, new)
            return
        context.rename(context.makeQualified(old), context.makeQualified(new), over)

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._at(name)).getLen()

    def footer(self, name: str) -> bytes:
        """The footer of a Parquet file: its metadata, their length and the closing sign."""
        size = self.fs.getFileStatus(self._at(name)).getLen()
        stream = self.fs.open(self._at(name))
        try:
            stream.seek(max(0, size - 8))
            tail = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.seek(max(0, size - 8 - int.from_bytes(tail[:4], "little")))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def append_to(self, stream, name: str) -> None:
        """Copy a file's bytes to an open stream, within the JVM."""
        own = self.fs.open(self._at(name))
        try:
            self._jvm.org.apache.commons.io.IOUtils.copyLarge(own, stream)
        finally:
            own.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"can't rename {old} to {new}")

    def move_to(self, target: str) -> None:
        """Rename the whole folder; the target must not exist."""
        where = self._jvm.org.apache.hadoop.fs.Path(target)
        if self.fs.exists(where) or not self.fs.rename(self._at(""), where):
            raise FileExistsError(target)

    def remove(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)

    def start(self, n: int) -> bytes:
        stream = self.fs.open(self._at(""))
        try:
            return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
        finally:
            stream.close()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``ordinal`` (growing in file order) of a file, or a folder of parts. Gzip is told by its first bytes; as
    Spark goes by names, a file whose name doesn't say so is first copied to one that does, byte by byte and within the JVM. Gzip can't be
    split, so one task streams such a file; block-compressed or partitioned text is read by many."""
    folder = Folder(spark, path)
    if not folder.is_folder() and folder.start(2) == b"\x1f\x8b" and not path.endswith(".gz"):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        source, path = jvm.org.apache.hadoop.fs.Path(path), f"{shared_dir(spark)}/named-{uuid.uuid4().hex}.gz"
        target = jvm.org.apache.hadoop.fs.Path(path)
        jvm.org.apache.hadoop.fs.FileUtil.copy(folder.fs, source, target.getFileSystem(conf), target, False, conf)
        target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


def contig_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, length) of a sizes or .fai file: the first two fields of each line that isn't blank or a comment."""
    out: list[tuple[str, int]] = []
    for n, line in enumerate(Folder(spark, path).read().decode().splitlines(), 1):
        fields = line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if len(fields) < 2 or not fields[1].isdigit() or int(fields[1]) < 1:
            raise ValueError(f"line {n}: a contig has a name and a positive length")
        out.append((fields[0], int(fields[1])))
    return checked_contigs(out)


def checked_contigs(contigs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    if not contigs or len({n for n, _ in contigs}) < len(contigs):
        raise ValueError("contigs are needed, each once")
    if any(not n or n.split() != [n] or length < 1 for n, length in contigs):
        raise ValueError("a contig's name has no white space, its length is positive")
    return contigs


def contig_frame(spark: SparkSession, contigs: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(contigs)], "contig_id int, contig string, length bigint")
