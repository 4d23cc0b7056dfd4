"""BAM files that are made here, against the same alignments as text."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from locusframe.operators import observe
from locusframe.sources import bam
from locusframe.sources import text as sources

NAMES = [("chr1", 100_000), ("chr2", 50_000), ("chrUn_x", 900)]
HEAD = "@HD\tVN:1.6\n@RG\tID:g\tPL:ONT\n@RG\tID:h\tPL:ILLUMINA\n@RG\tID:g\tPL:OTHER\n"
COLUMNS = ["qname", "flag", "chrom", "pos0", "mapq", "cigar", "tlen", "seq", "tags", "rg_platform"]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def tag(name, kind, value):
    forms = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    head = name.encode() + (kind[0] if kind[0] == "B" else kind).encode()
    if kind in "ZH":
        return head + value.encode() + b"\0", f"{name}:{kind}:{value}"
    if kind == "A":
        return head + value.encode(), f"{name}:A:{value}"
    if kind[0] == "B":
        return head + kind[1].encode() + struct.pack(f"<I{len(value)}{forms[kind[1]]}", len(value), *value), f"{name}:B:{kind[1]},{','.join(map(str, value))}"
    told = f"{value:g}" if kind == "f" else str(value)
    return head + struct.pack("<" + forms[kind], value), f"{name}:{'f' if kind == 'f' else 'i'}:{told}"


def reads(n, seed=0):
    """Each read as BAM record and as SAM line."""
    r = random.Random(seed)
    for i in range(n):
        ref = r.choice([0, 0, 1, 2, -1])
        ops = [] if ref < 0 or i % 11 == 0 else [(r.randrange(1, 90), op) for op in r.choice(["M", "SMIM", "SMDMNMS", "HM", "M=XM", "MPM"])]
        bases = sum(k for k, op in ops if op in "MIS=X") if i % 7 else 0
        if not ops and i % 7:
            bases = r.randrange(1, 60)
        seq = "".join(r.choice("ACGTN") for _ in range(bases))
        tags = [tag("RG", "Z", r.choice("gh"))] if i % 3 else []
        tags += r.sample([tag("SA", "Z", "chr2,5,+,10S40M,60,0;"), tag("NM", "C", 200), tag("AS", "s", -300), tag("XI", "I", 4_000_000_000), tag("XA", "A", "q"), tag("XF", "f", 0.5), tag("XB", "Bc", [-1, 2]), tag("XS", "BS", [65000]), tag("XH", "H", "1AE3"), tag("NM", "i", 7)], r.randrange(6))
        name, flag, mapq, tlen = f"read{i}:{'x' * r.randrange(30)}", r.randrange(4096), r.randrange(256), r.randrange(-5000, 5000)
        pos = r.randrange(800) if ref >= 0 else -1
        code = b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(op)) for k, op in ops)
        nibbles = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(nibbles[k] << 4 | nibbles[k + 1] for k in range(0, bases, 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, bases, -1, -1, tlen) + name.encode() + b"\0" + code + packed + b"\xff" * bases + b"".join(b for b, _ in tags)
        cigar = "".join(f"{k}{op}" for k, op in ops) or "*"
        yield struct.pack("<i", len(body)) + body, "\t".join([name, str(flag), NAMES[ref][0] if ref >= 0 else "*", str(pos + 1), str(mapq), cigar, "*", "0", str(tlen), seq or "*", "*", *[t for _, t in tags]])


def header():
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in NAMES)
    return b"BAM\x01" + struct.pack("<i", len(HEAD)) + HEAD.encode() + struct.pack("<i", len(NAMES)) + refs


def write(path, some, sizes):
    """A BAM file whose blocks take so many bytes in turn, wherever records begin."""
    data, out, at, k = header() + b"".join(b for b, _ in some), [], 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out.append(block(data[at : at + n]))
        at, k = at + n, k + 1
    path.write_bytes(b"".join(out) + block(b""))
    return out


def rows(df):
    return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("sizes", "split"), [([60_000], 1 << 26), ([700, 3000, 64], 4096), ([1500], 300), ([65_280], 20_000)])
def test_the_rows_of_the_text(spark, tmp_path, sizes, split):
    some = list(reads(1500 if split > 300 else 200, split))
    write(tmp_path / "a.bam", some, sizes)
    (tmp_path / "a.sam").write_text(HEAD + "\n".join(line for _, line in some) + "\n")
    got = bam.bam_lines(spark, str(tmp_path / "a.bam"), split)
    assert (got.rdd.getNumPartitions() > 1) == (split < 1 << 26)
    assert got.filter("error is not null").count() == 0
    assert rows(got) == rows(sources.read_sam(spark, str(tmp_path / "a.sam")))
    ordered = [r.qname for r in got.orderBy("read_idx").collect()]
    assert ordered == [line.split("\t")[0] for _, line in some]


def test_folders_and_operators(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"{k}.bam", list(reads(60, k)), [5000])
    (tmp_path / "notes.txt").write_text("no reads")
    got = bam.read_bam(spark, "file://" + str(tmp_path), 2000)
    assert got.count() == 120 and got.select("read_idx").distinct().count() == 120
    assert observe.read_type(got).first()[0] == "short"
    assert observe.length_sample(bam.bam_lines(spark, str(tmp_path), 2000), 20).first().n_reads == 20
    with pytest.raises(Exception, match="none.bam"):
        bam.read_bam(spark, str(tmp_path / "none.bam")).count()


def test_reads_longer_than_ranges_and_blocks(spark, tmp_path):
    def long_read(i):
        bases = 90_000
        name = f"long{i}"
        body = struct.pack("<iiBBHHHiiii", 0, 5, len(name) + 1, 60, 0, 1, 0, bases, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", bases << 4) + random.Random(i).randbytes(bases // 2) + b"\xff" * bases
        return struct.pack("<i", len(body)) + body, ""

    some = [x for i in range(4) for x in (long_read(i), *reads(20, i))]
    write(tmp_path / "a.bam", some, [8000])
    got = bam.bam_lines(spark, str(tmp_path / "a.bam"), 10_000)
    assert got.filter("error is not null").count() == 0
    assert sorted(len(r.seq or "") for r in got.collect())[-4:] == [90_000] * 4 and got.count() == 84


def test_operations_in_a_tag(spark, tmp_path):
    ops = [(1, "M"), (2, "I")] * 3
    code = [k << 4 | "MIDNSHP=X".index(op) for k, op in ops]
    body = struct.pack("<iiBBHHHiiii", 0, 5, 2, 60, 0, 2, 0, 9, -1, -1, 0) + b"r\0" + struct.pack("<II", 9 << 4 | 4, 3 << 4 | 3) + b"\x11" * 5 + b"\xff" * 9 + tag("CG", "BI", code)[0]
    write(tmp_path / "a.bam", [(struct.pack("<i", len(body)) + body, "")], [5000])
    r = bam.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (r.cigar, r.seq, r.tags) == ("1M2I1M2I1M2I", "A" * 9, {})


def test_damaged_files(spark, tmp_path):
    some = list(reads(900, 5))
    blocks = write(tmp_path / "a.bam", some, [4000])
    names = {line.split("\t")[0] for _, line in some}
    raw = bytearray((tmp_path / "a.bam").read_bytes())
    at = sum(map(len, blocks[:20])) + 40
    raw[at : at + 30] = bytes(30)
    (tmp_path / "b.bam").write_bytes(raw)
    for split in (1 << 26, 6000):
        got = bam.bam_lines(spark, str(tmp_path / "b.bam"), split)
        good = {r.qname for r in got.filter("error is null").collect()}
        assert good <= names and len(good) >= 900 - 60 and good != names
        assert 1 <= got.filter("error is not null").count() <= 3
    (tmp_path / "c.bam").write_bytes(bytes((tmp_path / "a.bam").read_bytes()[: sum(map(len, blocks[:30])) - 100]))
    got = bam.bam_lines(spark, str(tmp_path / "c.bam"))
    assert got.filter("error is not null").count() >= 1 and got.filter("error is null").count() > 300
