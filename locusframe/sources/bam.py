"""Binary alignments (BAM) as a data source whose partitions are ranges of a file's compressed bytes.

A BAM file is a row of gzip members (blocks) of at most 64 KiB, in which records follow one another without regard to the
blocks. A task looks for the first block that starts in its range, and in the data from there for the first place from which
records follow that fit together; it takes the records that start in blocks of its range, and reads behind its
end what its last one needs. So one file is read by many tasks without an index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ALIGNMENTS
from ..steps import ship_package

#: Compressed bytes of a partition, and of one read from the store.
SPLIT, READ = 64 << 20, 4 << 20
#: Records that must follow one another for a place to count as the start of one.
CHAIN = 12
#: Rows and bytes of sequences of an Arrow batch.
ROWS, BYTES = 4096, 8 << 20
# The format's codes of bases, operations and numbers in tags.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_HEX = str.maketrans("0123456789abcdef", _BASES)
_FIXED = struct.Struct("<iiiBBHHHiiii")
_KIND = pa.schema([("read_idx", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos0", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("tlen", pa.int32()), ("seq", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("rg_platform", pa.string()), ("error", pa.string())])


class BadData(Exception):
    """Bytes that are no block or no record."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """Bytes of the block that starts here, by the extra field of its gzip header; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = int.from_bytes(head[10:12], "little"), 12
    end = at + extra
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


class Blocks:
    """The blocks of a file from a place on, read in large pieces."""

    def __init__(self, file, start: int, length: int):
        self.file, self.at, self.length, self.base, self.held = file, start, length, start, b""

    def peek(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at a place of the file."""
        if at < self.base or at + n > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, READ))
        return self.held[at - self.base : at - self.base + n]

    def find(self) -> bool:
        """Go on to the next place where a block starts, with another one or the file's end behind it."""
        while self.at < self.length:
            piece = self.peek(self.at, READ)
            k = piece.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                self.at += max(1, len(piece) - 3)
                continue
            self.at += k
            size = block_size(self.peek(self.at, 1 << 16))
            if size and (self.at + size == self.length or block_size(self.peek(self.at + size, 1 << 16))):
                return True
            self.at += 1
        return False

    def next(self) -> tuple[int, bytes] | None:
        """Place and data of the block here; None at the end of the file."""
        if self.at >= self.length:
            return None
        raw = self.peek(self.at, 1 << 16)
        size = block_size(raw)
        if size is None or len(raw) < size:
            raise BadData(f"no block at byte {self.at}")
        at, extra = self.at, int.from_bytes(raw[10:12], "little")
        try:
            data = zlib.decompress(raw[12 + extra : size - 8], -15)
        except zlib.error as e:
            raise BadData(f"block at byte {at}: {e}") from None
        if zlib.crc32(data) != int.from_bytes(raw[size - 8 : size - 4], "little"):
            raise BadData(f"block at byte {at}: wrong checksum")
        self.at += size
        return at, data


class Header:
    """Names and lengths of the references and platforms of the read groups."""

    def __init__(self, blocks: Blocks):
        self.data = bytearray()
        more = lambda n: self._fill(blocks, n)
        more(8)
        if self.data[:4] != b"BAM\x01":
            raise BadData("no BAM file")
        n = int.from_bytes(self.data[4:8], "little")
        more(12 + n)
        self.platforms = {}
        for line in self.data[8 : 8 + n].rstrip(b"\0").decode(errors="replace").splitlines():
            if line.startswith("@RG"):
                told = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
                self.platforms.setdefault(told.get("ID", ""), told.get("PL", ""))
        count, at = int.from_bytes(self.data[8 + n : 12 + n], "little"), 12 + n
        self.names, self.lengths = [], []
        for _ in range(count):
            more(at + 4)
            size = int.from_bytes(self.data[at : at + 4], "little")
            more(at + 8 + size)
            self.names.append(self.data[at + 4 : at + 3 + size].decode())
            self.lengths.append(int.from_bytes(self.data[at + 4 + size : at + 8 + size], "little"))
            at += 8 + size
        self.size = at

    def _fill(self, blocks: Blocks, n: int) -> None:
        while len(self.data) < n:
            got = blocks.next()
            if got is None:
                raise BadData("the header has no end")
            self.data += got[1]


def record_size(data: bytes | bytearray, at: int, header: Header) -> int | None:
    """Bytes of the record that starts here, its size included; None if its fields don't fit together, -1 if there is too little to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, n_ops, _, bases, ref2, pos2, _ = _FIXED.unpack_from(data, at)
    n = len(header.names)
    if not (-1 <= ref < n and -1 <= ref2 < n and name and bases >= 0 and pos >= -1 and pos2 >= -1 and (ref < 0 or pos <= header.lengths[ref])):
        return None
    if 32 + name + 4 * n_ops + (bases + 1) // 2 + bases > size:
        return None
    end = at + 36 + name
    if end > len(data):
        return -1
    told = data[at + 36 : end]
    if told[-1] or not all(33 <= b <= 126 for b in told[:-1]):
        return None
    if end + 4 * n_ops <= len(data) and any(data[end + 4 * k] & 15 > 8 for k in range(n_ops)):
        return None
    return 4 + size


def first_record(data: bytes | bytearray, most: int, header: Header, whole: bool) -> int | None:
    """The first place below ``most`` from which CHAIN records, or all up to the end of the data, follow one another; None if there is none.

    ``whole``: no data follow, so the last record must end with them.
    """
    for start in range(most):
        at, seen = start, 0
        while seen < CHAIN:
            if at == len(data):
                break
            size = record_size(data, at, header)
            if size is None or (size < 0 and whole):
                seen = -1
                break
            if size < 0 or at + size > len(data):
                seen = -1 if whole or not seen else CHAIN
                break
            at, seen = at + size, seen + 1
        if seen > 0 or seen == 0 and at == len(data) and start < at:
            return start
    return None


def _tags(data: bytes) -> dict[str, str]:
    """Optional fields as SAM text has them, the first of each name."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode("latin1"), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(errors="replace"), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = chr(data[at]), int.from_bytes(data[at + 1 : at + 5], "little")
            form = f"<{n}{_NUMBERS[of]}"
            value = ",".join([of, *[_told(x) for x in struct.unpack_from(form, data, at + 5)]])
            at += 5 + struct.calcsize(form)
        else:
            form = "<" + _NUMBERS[kind]
            value, at = _told(struct.unpack_from(form, data, at)[0]), at + struct.calcsize(form)
        out.setdefault(name, value)
    return out


def _told(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def _cigar(raw: bytes) -> str | None:
    return "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack(f"<{len(raw) // 4}I", raw)) or None


def record(data: bytes | bytearray, at: int, size: int, header: Header) -> tuple:
    """The columns of ``schema.ALIGNMENTS`` behind read_idx."""
    _, ref, pos, name, mapq, _, n_ops, flag, bases, _, _, tlen = _FIXED.unpack_from(data, at)
    a = at + 36 + name
    b = a + 4 * n_ops
    c = b + (bases + 1) // 2
    tags = _tags(bytes(data[c + bases : at + size]))
    cigar = _cigar(bytes(data[a:b]))
    if "CG" in tags and n_ops == 2 and cigar.startswith(f"{bases}S"):  # more operations than the field can count are in a tag
        parts = tags.pop("CG").split(",")[1:]
        cigar = _cigar(struct.pack(f"<{len(parts)}I", *map(int, parts)))
    seq = bytes(data[b:c]).hex().translate(_HEX)[:bases] or None
    return data[at + 36 : a - 1].decode(), flag, header.names[ref] if ref >= 0 else "*", pos, mapq, cigar, tlen, seq, tags, header.platforms.get(tags.get("RG"))


def records(path: str, start: int, end: int, length: int) -> Iterator[tuple]:
    """Columns and error of the records that start in blocks from byte ``start`` to ``end`` of the file.

    Where a block or record is damaged a row has the error and nothing else, and reading goes on at the next record that can be found.
    """
    fs, at = _open(path)
    with fs.open_input_file(at) as file:
        header = Header(Blocks(file, 0, length))
        blocks = Blocks(file, start, length)
        data, skip, lost = bytearray(), header.size if start == 0 else 0, start > 0
        own, over = 0, False  # bytes of ``data`` that come from blocks of the range, and whether those have all been read
        if start and not blocks.find():
            return
        while True:
            failed, place = None, blocks.at
            try:
                got = blocks.next()
            except BadData as e:
                failed, got = str(e), None
                blocks.at += 1
                blocks.find()
            last = got is None and not failed
            if got:
                over = over or got[0] >= end
                data += got[1]
                own = own if over else len(data)
            if skip:
                cut = min(skip, len(data))
                del data[:cut]
                skip, own = skip - cut, max(0, own - cut)
                if skip and not last:
                    continue
            at, stop = 0, last or bool(failed)
            while at < own:
                if lost:
                    if not stop and len(data) - at < 4 << 16 and len(data) < own + (1 << 22):
                        break  # more data to tell by
                    found = first_record(memoryview(data)[at:].tobytes(), own - at, header, stop)
                    if found is None:
                        at = own
                        break
                    at, lost = at + found, False
                size = record_size(data, at, header)
                if size is None:
                    yield (*[None] * 10, f"no record behind byte {blocks.at} of {path}")
                    at, lost = at + 1, True
                elif size < 0 or at + size > len(data):
                    if last:
                        yield (*[None] * 10, f"{path} ends inside a record")
                    break
                else:
                    try:
                        row = (*record(data, at, size, header), None)
                    except (ValueError, IndexError, KeyError, struct.error) as e:
                        row = (*[None] * 10, f"bad record: {e}")
                    yield row
                    at += size
            if failed and place < end:  # behind it the next range has that row
                yield (*[None] * 10, failed)
            if last or failed and blocks.at >= end or over and at >= own:
                return
            if failed:
                data, own, lost = bytearray(), 0, True
            else:
                del data[:at]
                own -= at


class Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int, length: int):
        self.number, self.path, self.start, self.end, self.length = number, path, start, end, length


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        """Ranges in the order of file names and places."""
        fs, at = _open(self.path)
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name.endswith(".bam")), key=lambda f: f.path)
        cuts = [(scheme + f.path, a, min(a + self.split, f.size), f.size) for f in files for a in range(0, f.size, self.split)]
        return [Range(i, *c) for i, c in enumerate(cuts)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size, number = [], 0, partition.number << 33
        for row in records(partition.path, partition.start, partition.end, partition.length):
            rows.append(row)
            size += len(row[7] or "") + 200
            if len(rows) >= ROWS or size >= BYTES:
                yield _batch(rows, number)
                number, rows, size = number + len(rows), [], 0
        if rows:
            yield _batch(rows, number)


def _batch(rows: list[tuple], number: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    columns[8] = [None if t is None else list(t.items()) for t in columns[8]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([range(number, number + len(rows)), *columns], _KIND, strict=True)], schema=_KIND)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return f"{ALIGNMENTS}, error string"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def bam_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Every record of a BAM file, or of the BAM files of a folder, in the columns of ``schema.ALIGNMENTS``, and error: null, or what is damaged there.

    The same rows as ``text.sam_lines`` gives of the same alignments as text, but for read_idx, which goes by file name and place.
    A damaged place is one row with its error; records that can be found behind it are there. Files may be in any store that Arrow opens.
    """
    ship_package(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", str(split)).load(path)


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files in the schema of ``schema.ALIGNMENTS``; what is damaged is left out."""
    return bam_lines(spark, path, split).filter("error is null").drop("error")
