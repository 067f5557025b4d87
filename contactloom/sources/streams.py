"""Bytes in and out: standard input and output, any file system, pipes to other programs."""

from __future__ import annotations

import bz2
import gzip
import subprocess
import sys
import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.runtime import Scratch

#: Codecs whose compressed files stand one after the other as one, by suffix.
CODECS = {".gz": ("gzip", gzip.compress), ".bz2": ("bzip2", bz2.compress)}
CHUNK = 1 << 20


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, None if it is on another file system."""
    fs, at = _at(spark, path)
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _chunks(spark: SparkSession, path: str) -> Iterator[bytes]:
    if (local := local_path(spark, path)) is not None:
        with open(local, "rb") as f:
            while data := f.read(CHUNK):
                yield data
        return
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        while data := bytes(stream.readNBytes(CHUNK)):
            yield data
    finally:
        stream.close()


@contextmanager
def _sink(spark: SparkSession, path: str, command: str | None):
    """A function that takes bytes for path ('-' is standard output), through a program if one is given."""
    if command is not None:
        with _sink(spark, path, None) as plain:
            p = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            def drain():
                for data in iter(lambda: p.stdout.read(CHUNK), b""):
                    plain(data)

            reader = threading.Thread(target=drain)
            reader.start()
            yield p.stdin.write
            p.stdin.close()
            reader.join()
            if p.wait():
                raise RuntimeError(f"{command} failed with status {p.returncode}")
    elif path == "-":
        sys.stdout.flush()
        out = getattr(sys.stdout, "buffer", None)
        yield out.write if out is not None else lambda data: sys.stdout.write(data.decode())
        sys.stdout.flush()
    elif (local := local_path(spark, path)) is not None:
        with open(local, "wb") as f:
            yield f.write
    else:
        fs, at = _at(spark, path)
        stream = fs.create(at, True)
        yield lambda data: stream.write(bytearray(data))
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    with _sink(spark, path, None) as write:
        write(data)


def write_lines(lines: DataFrame, path: str, head: str = "", command: str | None = None) -> None:
    """The column value of lines as one text with head before it, on path or ('-') standard output.

    All tasks write their part side by side, compressed as the suffix says; then the parts are put one
    after the other by the file system, without being read as rows. command: a program through which the
    text goes."""
    spark = lines.sparkSession
    codec = next((v for k, v in CODECS.items() if path.endswith(k)), None) if command is None else None
    scratch = Scratch(spark, "text")
    folder = f"{scratch.root}/lines"
    lines.select("value").write.options(**({"compression": codec[0]} if codec else {})).text(folder)
    top = codec[1](head.encode()) if codec and head else head.encode()
    parts = part_files(spark, folder)
    if command is None and path != "-" and local_path(spark, path) is None:
        fs, at = _at(spark, path)
        stream = fs.create(at, True)
        stream.write(bytearray(top))
        for p in parts:
            source_fs, source = _at(spark, p)
            source_stream = source_fs.open(source)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source_stream, stream, spark._jsc.hadoopConfiguration(), False)
            source_stream.close()
        stream.close()
    else:
        with _sink(spark, path, command) as write:
            write(top)
            for p in parts:
                for data in _chunks(spark, p):
                    write(data)
    fs, at = _at(spark, folder)
    fs.delete(at, True)


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a folder in the order of their partitions."""
    fs, at = _at(spark, folder)
    names = [x.getPath() for x in fs.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return [p.toString() for p in sorted(names, key=lambda p: (len(p.getName()), p.getName()))]


def stage(spark: SparkSession, path: str = "-", command: str | None = None) -> str:
    """A file in the shared folder with what standard input ('-') or a file gives, through a program if one
    is given; for inputs that have no path Spark could read."""
    data = iter(lambda: sys.stdin.buffer.read(CHUNK), b"") if path in ("", "-") else _chunks(spark, path)
    if command is not None:
        p = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        def feed(source=data):
            for x in source:
                p.stdin.write(x)
            p.stdin.close()

        threading.Thread(target=feed, daemon=True).start()
        data = iter(lambda: p.stdout.read(CHUNK), b"")
    first = next(data, b"")
    suffix = ".gz" if first.startswith(b"\x1f\x8b") else ".bz2" if first.startswith(b"BZh") else ".txt"
    root = Scratch(spark, "input").root
    target = f"{root}/stdin{suffix}"
    fs, at = _at(spark, target)
    fs.mkdirs(at.getParent())
    with _sink(spark, target, None) as write:
        write(first)
        for x in data:
            write(x)
    if command is not None and p.wait():
        raise RuntimeError(f"{command} failed with status {p.returncode}")
    return target


def write_table(df: DataFrame, path: str, names: Sequence[str] | None = None) -> None:
    """df as one text with a line of column names and fields between tabs; nulls are empty."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    write_lines(df.select(F.concat_ws("\t", *cells).alias("value")), path, "\t".join(names or df.columns) + "\n")
