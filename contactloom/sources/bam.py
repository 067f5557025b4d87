"""BAM files as SAM lines.

A file is cut into ranges of bytes that are decoded side by side. A task finds the first block of its
range and, in what that unpacks to, the first place where records follow each other; it decodes the
records that begin in blocks of its range. Files that are not made of blocks are decoded by one task."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from contactloom.runtime import ship

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BATCH = 20_000
#: Bytes of a file that one task decodes, and bytes that may hold what has to be looked for in a range.
RANGE, LOOK = 64 << 20, 1 << 20
#: Successive records that have to be sound where a range is entered.
SOUND = 8


def _open(path: str):
    """The file for random access, on any file system that pyarrow knows."""
    if "://" not in path or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _block_size(head: bytes) -> int:
    """Bytes of the block that begins with head, 0 if none does."""
    if len(head) < 18 or not head.startswith(b"\x1f\x8b\x08\x04"):
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _first_block(f, start: int, size: int) -> int:
    """Where the first block at start or later begins: a block that others follow up to the end of what
    is looked at. The size of the file if there is none."""
    f.seek(start)
    data = f.read(LOOK)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n, follow = _block_size(data[at : at + 512]), at
        while n and follow + n + 512 <= len(data):
            follow += n
            n = _block_size(data[follow : follow + 512])
        if n:
            return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


class _Stream:
    """Bytes of a gzip file from one of its blocks on, unpacked as they are asked for. at: how many were
    taken; born(at): where the block is that the byte at comes from."""

    def __init__(self, f, start: int = 0):
        self.f, self.ready, self.at, self.place = f, bytearray(), 0, start
        f.seek(start)
        self.raw, self.unzip = b"", zlib.decompressobj(31)
        self.blocks = [(0, start)]

    def more(self) -> bool:
        """Unpacks some more; false at the end."""
        data = self.raw or self.f.read(1 << 16)
        if not data:
            return False
        out = self.unzip.decompress(data)
        self.ready += out
        if self.unzip.eof:
            self.raw = self.unzip.unused_data
            self.place += len(data) - len(self.raw)
            self.blocks.append((self.at + len(self.ready), self.place))
            self.unzip = zlib.decompressobj(31)
        else:
            self.raw = b""
            self.place += len(data)
        return True

    def have(self, n: int) -> bool:
        while len(self.ready) < n and self.more():
            pass
        return len(self.ready) >= n

    def take(self, n: int) -> bytes:
        self.have(n)
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.at += len(out)
        return out

    def born(self) -> int:
        """Where the block of the next byte begins in the file; what was taken before it is forgotten."""
        while len(self.blocks) > 1 and self.blocks[1][0] <= self.at:
            self.blocks.pop(0)
        return self.blocks[0][1]


def _header(stream: _Stream) -> tuple[list[str], list[str]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return text.splitlines(), names


def _tags(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            yield f"{name}:A:{chr(data[at])}"
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            yield f"{name}:{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", data, at + 5)
            yield f"{name}:B:{','.join([sub, *(f'{v:g}' if sub == 'f' else str(v) for v in values)])}"
            at += 5 + struct.calcsize(f"<{n}{NUMBERS[sub]}")
        else:
            (v,) = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)
            yield f"{name}:f:{v:g}" if kind == "f" else f"{name}:i:{v}"
            at += struct.calcsize(NUMBERS[kind])


def _record(data: bytes, names: list[str]) -> str:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    qname = data[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (l_seq + 1) // 2]
    at += len(packed)
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] or "*"
    qual = data[at : at + l_seq]
    at += l_seq
    quality = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
    mate = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
    own = names[ref] if ref >= 0 else "*"
    return "\t".join([qname, str(flag), own, str(pos + 1), str(mapq), cigar, mate, str(next_pos + 1), str(tlen), seq, quality, *_tags(data[at:])])


def _sound(data: bytearray, at: int, names: int) -> int:
    """The end of a record that begins at, as far as its fixed fields are sound: 0 if they are not, -1 if
    data ends before that can be told."""
    if at + 37 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fixed = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < names and -1 <= next_ref < names and pos >= -1 and next_pos >= -1 and l_name >= 2 and l_seq >= 0 and fixed <= size < 1 << 28):
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) < l_name:
        return -1
    return at + 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def _enter(stream: _Stream, names: int) -> None:
    """Skips what belongs to a record that began earlier: up to the first place from which SOUND sound
    records follow each other, or as many as the file has left."""
    start = 0
    while True:
        at, n = start, 0
        while n < SOUND:
            if not stream.have(at + 37) and at == len(stream.ready):
                break  # the records end with the file
            end = _sound(stream.ready, at, names)
            if end < 0:
                if not stream.more():
                    end = 0
                else:
                    continue
            if not end:
                n = -1
                break
            stream.have(end)
            if end > len(stream.ready):
                n = -1
                break
            at, n = end, n + 1
        if n >= 0:
            stream.take(start)
            return
        start += 1
        if not stream.have(start + 1):
            stream.take(start)
            return


def _range_lines(f, start: int, stop: int, size: int, names: list[str]) -> Iterator[str]:
    """SAM lines of the records that begin in blocks of [start, stop)."""
    first = _first_block(f, start, size) if start else 0
    if first >= stop:
        return
    stream = _Stream(f, first)
    if start:
        _enter(stream, len(names))
    else:
        _header(stream)
    # a block that has been unpacked to its end gives way to the next
    while stream.have(1) and stream.born() < stop and len(head := stream.take(4)) == 4:
        yield _record(stream.take(struct.unpack("<i", head)[0]), names)


def _decode(names: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, path, start, stop, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
                lines: list[str] = []
                done = 0
                with _open(path) as f:
                    for line in _range_lines(f, start, stop, size, names[path]):
                        lines.append(line)
                        if len(lines) == BATCH:
                            yield _lines(lines, (idx << 40) + done)
                            done, lines = done + len(lines), []
                yield _lines(lines, (idx << 40) + done)

    return run


def _lines(lines: list[str], first: int) -> pa.RecordBatch:
    at = pa.array(range(first, first + len(lines)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), at], names=["value", "_ord"])


def read_bam(spark: SparkSession, path: str, bytes_per_task: int = RANGE) -> tuple[DataFrame, list[str]]:
    """(lines, header): SAM lines (value, _ord) of BAM files, in the order of the files, and the first
    file's header lines. The driver reads the headers only, a few lines for each chromosome."""
    from contactloom.sources.pairs_text import _files

    ship(spark)
    jvm = spark._jvm
    ranges, names, top = [], {}, []
    for path in _files(spark, path):
        at = jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
        with _open(path) as f:
            blocks = _block_size(f.read(512)) > 0
            lines, names[path] = _header(_Stream(f))
        top = top or lines
        step = bytes_per_task if blocks else max(1, size)
        ranges += [(len(ranges) + i, path, a, min(a + step, size), size) for i, a in enumerate(range(0, size, step))]
    table = spark.createDataFrame(ranges, "idx long, path string, start long, stop long, size long")
    table = table.repartitionByRange(min(len(ranges), 10_000), "idx")
    return table.mapInArrow(_decode(names), "value string, _ord long"), top
