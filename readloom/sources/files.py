"""Sequence and alignment file formats as Python data sources: readloom_fasta, readloom_fastq, readloom_blast, readloom_match,
readloom_bam, readloom_lines.

Plain FASTA and FASTQ files are cut into byte ranges that synchronise on a record's start, BAM files into ranges that synchronise on a compressed block and the first record in
it; other compressed files (.gz .bz2 .xz .lzma .zst .Z) are one partition each. Paths are files, directories or glob patterns every executor can read: local or mounted ones, or
URIs of a file system that Arrow knows (hdfs://, s3://, gs://, file://).

    register(spark); spark.read.format("readloom_fastq").load("/shared/run1/*.fastq")
"""

from __future__ import annotations

import fnmatch
import glob
import io
import os
import struct
import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT = 64 << 20
SUFFIXES = (".gz", ".bz2", ".xz", ".lzma", ".zst", ".Z")


def _remote(path: str):
    """(file system, path in it) of a URI, None for a plain path."""
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def sink(path: str):
    """(file system, folder in it) of a target, made if it is not there."""
    from pyarrow import fs

    system, folder = _remote(path) or (fs.LocalFileSystem(), path)
    system.create_dir(folder, recursive=True)
    return system, folder.rstrip("/")


def clear(path: str, ending: str = "") -> None:
    """Delete the part files of a target."""
    from pyarrow import fs

    system, folder = sink(path)
    for x in system.get_file_info(fs.FileSelector(folder)):
        if x.is_file and x.base_name.startswith("part-") and x.base_name.endswith(ending):
            system.delete_file(x.path)


def expand(path: str) -> list[str]:
    """Files of a path, directory, glob pattern (in the last part of a URI) or comma list; a file '@list' names one path per line."""
    out: list[str] = []
    for p in path.split(","):
        p = p.strip()
        if p.startswith("@"):
            with raw(p[1:]) as f:
                out += [x for line in f.read().decode().splitlines() if line.strip() for x in expand(line.strip())]
        elif "://" in p:
            out += _expand_remote(p)
        elif os.path.isdir(p):
            out += sorted(os.path.join(d, f) for d, _, fs in os.walk(p) for f in fs if not f.startswith((".", "_")))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out


def _expand_remote(uri: str) -> list[str]:
    from pyarrow import fs

    head, last = uri.rstrip("/").rsplit("/", 1)
    wild = any(c in last for c in "*?[")
    system, path = _remote(head if wild else uri)
    if not wild and system.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    base = (head if wild else uri).removesuffix(path)
    found = [x for x in system.get_file_info(fs.FileSelector(path, recursive=not wild)) if x.is_file and not x.base_name.startswith((".", "_"))]
    return sorted(base + x.path for x in found if not wild or fnmatch.fnmatch(x.base_name, last))


def size_of(path: str) -> int:
    remote = _remote(path)
    return remote[0].get_file_info(remote[1]).size if remote else os.path.getsize(path)


def raw(path: str):
    """The bytes of a file or URI as a seekable binary stream."""
    remote = _remote(path)
    return io.BufferedReader(remote[0].open_input_file(remote[1]), 1 << 20) if remote else open(path, "rb")


def opened(path: str):
    """A binary stream, decompressed by suffix."""
    if path.endswith(".gz") or path.endswith(".bam"):
        import gzip

        return gzip.open(raw(path))
    if path.endswith(".bz2"):
        import bz2

        return bz2.open(raw(path))
    if path.endswith((".xz", ".lzma")):
        import lzma

        return lzma.open(raw(path))
    if path.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw(path), read_across_frames=True, closefd=True))
    if path.endswith(".Z"):
        from readloom.sources.bytes import uncompress

        with raw(path) as f:
            return io.BytesIO(uncompress(f.read()))
    return raw(path)


def quality_file(path: str) -> str | None:
    """The quality file that goes with a FASTA file, if it is there."""
    base = os.path.realpath(path)
    for p in dict.fromkeys((path, base)):
        for q in (f"{p}.qual", p.replace(".fna", ".qual"), p.replace(".fasta", ".qual"), p.replace("/fasta/", "/qual/")):
            if q != p and os.path.exists(q):
                return q
    return None


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    split = True

    def __init__(self, options):
        self.paths = expand(options["path"])
        self.size = int(options.get("splitBytes", SPLIT))

    def partitions(self):
        out = []
        for p in self.paths:
            n = size_of(p)
            if not self.split or p.endswith(SUFFIXES) or n <= self.size:
                out.append(Range(p, 0, None))
            else:
                out += [Range(p, s, min(s + self.size, n)) for s in range(0, n, self.size)]
        return out

    def read(self, partition):
        rows, schema = [], self.arrow
        for r in self.records(partition):
            rows.append(r)
            if len(rows) == 4096:
                yield _columns(rows, schema)
                rows = []
        if rows:
            yield _columns(rows, schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


READ_ARROW = pa.schema([("file", pa.string()), ("read_idx", pa.int64()), ("name", pa.string()), ("comment", pa.string()), ("seq", pa.string()), ("qual", pa.list_(pa.int32()))])
READ_DDL = "file string, read_idx bigint, name string, comment string, seq string, qual array<int>"


def _head(line: bytes) -> tuple[str, str | None]:
    name, _, comment = line[1:].decode(errors="replace").strip("\r\n").partition(" ")
    return name.split("\t")[0], comment or None


class FastaReader(_Reader):
    arrow = READ_ARROW

    def records(self, part: Range) -> Iterator[tuple]:
        """read_idx is the byte offset of the record's header, so it orders the records of a file."""
        with opened(part.path) as f:
            if part.start:
                f.seek(part.start - 1)
                f.readline()
            at, head, seq, start = f.tell(), None, [], 0
            for line in iter(f.readline, b""):
                if line[:1] == b">":
                    if head is not None:
                        yield (part.path, start, *head, b"".join(seq).decode(errors="replace"), None)
                        head = None
                    if part.stop is not None and at >= part.stop:
                        return
                    head, seq, start = _head(line), [], at
                elif head is not None:
                    seq.append(line.strip())
                at += len(line)
            if head is not None:
                yield (part.path, start, *head, b"".join(seq).decode(errors="replace"), None)


class FastqReader(_Reader):
    arrow = READ_ARROW

    def records(self, part: Range) -> Iterator[tuple]:
        """Strict four-line records; a line that should start a record but has no '@' is skipped."""
        with opened(part.path) as f:
            at = part.start
            if part.start:
                f.seek(part.start - 1)
                at += len(f.readline()) - 1
                at = self._sync(f, at)
            while part.stop is None or at < part.stop:
                head = f.readline()
                if not head:
                    return
                if head[:1] != b"@":
                    at += len(head)
                    continue
                seq, plus, qual = f.readline(), f.readline(), f.readline()
                q = [max(0, min(255, c - 33)) for c in qual.strip(b"\r\n")]
                yield (part.path, at, *_head(head), seq.strip().decode(errors="replace"), q)
                at += len(head) + len(seq) + len(plus) + len(qual)

    @staticmethod
    def _sync(f, at: int) -> int:
        """Offset of the first line that starts with '@' and is followed by a '+' line two lines on and by no other such line before."""
        lines = [f.readline() for _ in range(8)]
        for i in range(4):
            if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+" and len(lines[i + 1]) == len(lines[i + 3].rstrip(b"\n")) + 1:
                break
        else:
            i = 0
        at += sum(map(len, lines[:i]))
        f.seek(at)
        return at


MATCH_ARROW = pa.schema([("query_id", pa.string()), ("id", pa.string()), *[(c, pa.int64()) for c in ("length", "identity", "score", "start", "stop", "s_start", "s_stop")], ("qs", pa.string()), ("ss", pa.string())])
MATCH_DDL = "query_id string, id string, length bigint, identity bigint, score bigint, start bigint, stop bigint, s_start bigint, s_stop bigint, qs string, ss string"
_SWAP = str.maketrans("acgtACGT", "tgcaTGCA")


class BlastReader(_Reader):
    """Pairwise text of alignments: coordinates 1-based as printed; a match on the other strand is turned to the query's forward strand."""

    arrow, split = MATCH_ARROW, False

    def records(self, part: Range) -> Iterator[tuple]:
        query = other = None
        length, m = 0, None
        with opened(part.path) as f:
            for raw in f:
                line = raw.decode(errors="replace").rstrip("\r\n")
                word = line.split()
                if line.startswith("Query="):
                    if m:
                        yield self.done(m)
                    m, query = None, word[1] if len(word) > 1 else line[6:].strip()
                elif line.startswith(">"):
                    if m:
                        yield self.done(m)
                    m, other = None, line[1:].split()[0] if line[1:].split() else ""
                elif "Length = " in line:
                    length = int(line.split("Length = ")[1].split()[0].replace(",", ""))
                elif line.startswith(" Score = "):
                    if m:
                        yield self.done(m)
                    m = {"query_id": query, "id": other, "length": length, "score": int(float(word[2])), "identity": 0, "start": None, "qs": [], "ss": [], "stop": 0, "s_start": None, "s_stop": 0}
                elif m and "Identities = " in line:
                    m["identity"] = int(line.split("Identities = ")[1].split("/")[0])
                elif m and line.startswith("Query:") and len(word) >= 4:
                    m["start"] = int(word[1]) if m["start"] is None else m["start"]
                    m["qs"].append(word[2])
                    m["stop"] = int(word[3])
                elif m and line.startswith("Sbjct:") and len(word) >= 4:
                    m["s_start"] = int(word[1]) if m["s_start"] is None else m["s_start"]
                    m["ss"].append(word[2])
                    m["s_stop"] = int(word[3])
        if m:
            yield self.done(m)

    @staticmethod
    def done(m: dict) -> tuple:
        qs, ss = "".join(m["qs"]), "".join(m["ss"])
        a, b, c, d = m["start"], m["stop"], m["s_start"], m["s_stop"]
        if a is not None and a > b:
            a, b, c, d = b, a, d, c
            qs, ss = qs[::-1].translate(_SWAP), ss[::-1].translate(_SWAP)
        return (m["query_id"], m["id"], m["length"], m["identity"], m["score"], a, b, c, d, qs, ss)


class MatchReader(_Reader):
    """Compact matches: '=query', '>id length', 'identity score start stop s_start s_stop', then the one or two aligned sequences."""

    arrow, split = MATCH_ARROW, False

    def records(self, part: Range) -> Iterator[tuple]:
        query = other = numbers = None
        length = 0
        with opened(part.path) as f:
            for raw in f:
                word = raw.decode(errors="replace").split()
                if not word:
                    continue
                if word[0].startswith("="):
                    query, numbers = " ".join(word)[1:], None
                elif word[0].startswith(">"):
                    other, length, numbers = word[0][1:], int(word[1]) if len(word) > 1 else 0, None
                elif numbers is None:
                    numbers = [int(x) for x in word[:6]]
                else:
                    i, s, a, b, c, d = numbers
                    yield (query, other, length, i, s, a, b, c, d, word[0], word[1] if len(word) > 1 else word[0])
                    numbers = None


def compact_match(m: dict) -> str:
    """The compact text of one match (without its '=query' line)."""
    head = f">{m['id']} {m['length']}\n{m['identity']} {m['score']} {m['start']} {m['stop']} {m['s_start']} {m['s_stop']}\n"
    return head + (m["qs"] if m["qs"] == m["ss"] else f"{m['qs']} {m['ss']}") + "\n"


BAM_ARROW = pa.schema([("full_name", pa.string()), ("flag", pa.int32()), ("ref_name", pa.string()), ("pos", pa.int64()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("hole_number", pa.int64()), ("q_start", pa.int64()), ("q_end", pa.int64()), ("num_passes", pa.int64())])
BAM_DDL = "full_name string, flag int, ref_name string, pos bigint, seq string, qual array<int>, hole_number bigint, q_start bigint, q_end bigint, num_passes bigint"
_BASES = "=ACMGRSVTWYHKDBN"  # fixed value: the format's 4-bit base codes
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


def _tags(data: bytes) -> dict[str, int]:
    """Integer tags of a record."""
    out, i = {}, 0
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in _TAG_SIZES:
            n = _TAG_SIZES[kind]
            if kind in _TAG_CODES:
                out[tag] = struct.unpack("<" + _TAG_CODES[kind], data[i : i + n])[0]
            i += n
        elif kind in "ZH":
            i = data.index(b"\0", i) + 1
        elif kind == "B":
            n, = struct.unpack("<I", data[i + 1 : i + 5])
            i += 5 + n * _TAG_SIZES[chr(data[i])]
        else:
            return out
    return out


class Blocks:
    """The data of a block-compressed file from a block on."""

    def __init__(self, f, at: int):
        self.f, self.next, self.data, self.i = f, at, b"", 0
        self.marks: list[tuple[int, int]] = []  # where in data each block begins, and its offset in the file

    def _more(self) -> bool:
        while True:
            at = self.next
            self.f.seek(at)
            head = self.f.read(12)
            if len(head) < 12:
                return False
            extra = self.f.read(struct.unpack("<H", head[10:12])[0])
            size = _block_size(extra) if head[:4] == b"\x1f\x8b\x08\x04" else None
            if size is None:
                raise ValueError(f"no compressed block at byte {at}")
            data = zlib.decompress(self.f.read(size - 12 - len(extra))[:-8], -15)
            self.next = at + size
            if data:
                behind = [m for m in self.marks if m[0] <= self.i][-1:] if self.i < len(self.data) else []
                self.marks = [(p - self.i, o) for p, o in behind + [m for m in self.marks if m[0] > self.i]]
                self.data, self.i = self.data[self.i :], 0
                self.marks.append((len(self.data), at))
                self.data += data
                return True

    def block(self) -> int | None:
        """File offset of the block that holds the next byte; None at the end."""
        if self.i >= len(self.data) and not self._more():
            return None
        return [o for p, o in self.marks if p <= self.i][-1]

    def read(self, n: int) -> bytes:
        while len(self.data) - self.i < n and self._more():
            pass
        out = self.data[self.i : self.i + n]
        self.i += len(out)
        return out


def _block_size(extra: bytes) -> int | None:
    i = 0
    while i + 4 <= len(extra):
        n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
        if extra[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(extra):
            return struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
        i += 4 + n
    return None


def _next_block(f, at: int, size: int) -> int | None:
    """Offset of the first block at or after a byte: a block header whose successor is one too, or the end of the file."""
    while at < size:
        f.seek(at)
        data = f.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            n = _block_size(data[i + 12 : i + 12 + struct.unpack("<H", data[i + 10 : i + 12])[0]]) if i + 18 <= len(data) else None
            if n is not None:
                f.seek(at + i + n)
                follow = f.read(4)
                if follow == b"\x1f\x8b\x08\x04" or (not follow and at + i + n == size):
                    return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        if len(data) < 1 << 17:
            return None
        at += len(data) - 17
    return None


class BamReader(_Reader):
    """A range of a BAM file is the records that start in its compressed blocks; its first record is found by the records that follow it."""

    arrow = BAM_ARROW

    @staticmethod
    def _header(f) -> list[str]:
        if f.read(4) != b"BAM\x01":
            raise ValueError("no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        refs = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            (n,) = struct.unpack("<i", f.read(4))
            refs.append(f.read(n)[:-1].decode())
            f.read(4)
        return refs

    @staticmethod
    def _length(data: bytes, i: int, refs: int) -> int | None:
        """Length of what looks like a record at i, None if it does not; -1 if the data ends before that is known."""
        if i + 36 > len(data):
            return -1
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", data[i : i + 36])
        need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        if not (l_name > 0 and l_seq >= 0 and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and need <= size <= need + (1 << 24)):
            return None
        end = i + 36 + l_name
        if end > len(data):
            return -1
        name = data[i + 36 : end]
        return size + 4 if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else None

    def _synchronised(self, f, at: int, refs: int) -> int:
        """How many bytes of the data from block `at` on come before the first record that starts there: the first place from which records follow one another."""
        most = 1 << 18
        while True:
            window = Blocks(f, at).read(most)
            whole = len(window) < most
            for start in range(len(window)):
                i, chained, ok = start, 0, False
                while chained < 20 and not (whole and i == len(window)):
                    n = self._length(window, i, refs)
                    if n is None or n < 0 or i + n > len(window):
                        ok = n is not None and not whole and chained >= 3  # the window ends amid records
                        break
                    i, chained = i + n, chained + 1
                else:
                    ok = chained > 0
                if ok:
                    return start
            if whole:
                return len(window)
            most *= 4

    def records(self, part: Range) -> Iterator[tuple]:
        with raw(part.path) as f:
            size = f.seek(0, 2)
            b = Blocks(f, 0)
            refs = self._header(b)
            if part.start:
                at = _next_block(f, part.start, size)
                if at is None:
                    return
                b = Blocks(f, at)
                b.read(self._synchronised(f, at, len(refs)))
            while (at := b.block()) is not None and (part.stop is None or at < part.stop):
                (n,) = struct.unpack("<i", b.read(4))
                yield self.record(b.read(n), refs)

    @staticmethod
    def record(d: bytes, refs: list[str]) -> tuple:
        ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack("<iiBBHHHi", d[:20])
        at = 32
        name = d[at : at + l_name - 1].decode()
        at += l_name + 4 * n_cigar
        packed = d[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        at += len(packed)
        qual = None if d[at : at + 1] == b"\xff" else list(d[at : at + l_seq])
        t = _tags(d[at + l_seq :])
        return (name, flag, refs[ref] if 0 <= ref < len(refs) else None, pos, seq, qual, t.get("zm"), t.get("qs"), t.get("qe"), t.get("np"))


def bgzf(data: bytes) -> bytes:
    """One compressed block of at most 64 KiB of data."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BamWriter(DataSourceArrowWriter):
    """One unaligned BAM file a partition in the given directory (columns full_name, seq, qual and the integer tags)."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        sink(self.path)
        if overwrite:
            clear(self.path, ".bam")

    def write(self, iterator):
        from pyspark import TaskContext

        c = TaskContext.get()
        system, folder = sink(self.path)
        part = f"{folder}/.{c.partitionId():05d}.{c.taskAttemptId()}.tmp"
        with system.open_output_stream(part) as f:
            text = b"@HD\tVN:1.6\tSO:unknown\n"
            f.write(bgzf(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0)))
            buffer = bytearray()
            for batch in iterator:
                for r in batch.to_pylist():
                    buffer += self.record(r)
                    while len(buffer) >= 60_000:
                        f.write(bgzf(bytes(buffer[:60_000])))
                        del buffer[:60_000]
            if buffer:
                f.write(bgzf(bytes(buffer)))
            f.write(bgzf(b""))
        system.move(part, f"{folder}/part-{c.partitionId():05d}.bam")
        return WriterCommitMessage()

    @staticmethod
    def record(r: dict) -> bytes:
        seq = (r.get("seq") or "").upper()
        code = [_BASES.find(b) if b in _BASES else 15 for b in seq] + [0] * (len(seq) % 2)
        name = (r.get("full_name") or "*").encode()[:254] + b"\0"
        qual = r.get("qual")
        q = bytes(min(93, max(0, x)) for x in qual) if qual is not None and len(qual) == len(seq) else b"\xff" * len(seq)
        tags = b"".join(t.encode() + b"i" + struct.pack("<i", r[c]) for t, c in (("zm", "hole_number"), ("qs", "q_start"), ("qe", "q_end"), ("np", "num_passes")) if r.get(c) is not None)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 255, 4680, 0, 4, len(seq), -1, -1, 0) + name + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True)) + q + tags
        return struct.pack("<i", len(body)) + body


def _compressed(stream, codec: str):
    """A binary file that writes compressed data to a stream."""
    if codec == "gz":
        import gzip

        return gzip.GzipFile(fileobj=stream, mode="wb")
    if codec == "bz2":
        import bz2

        return bz2.BZ2File(stream, "wb")
    if codec in ("xz", "lzma"):
        import lzma

        return lzma.LZMAFile(stream, "wb", format=lzma.FORMAT_XZ if codec == "xz" else lzma.FORMAT_ALONE)
    if codec == "zst":
        import zstandard

        return zstandard.ZstdCompressor().stream_writer(stream, closefd=False)
    if codec == "none":
        return nullcontext(stream)
    raise ValueError(f"unknown codec {codec}")


class LineWriter(DataSourceArrowWriter):
    """One file of lines a partition (column value; null is an empty line); a file appears under its name once it is whole."""

    def __init__(self, options, overwrite: bool):
        self.path, self.codec = options["path"], options.get("codec", "none")
        sink(self.path)
        if overwrite:
            clear(self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        c = TaskContext.get()
        system, folder = sink(self.path)
        part = f"{folder}/.{c.partitionId():05d}.{c.taskAttemptId()}.tmp"
        with system.open_output_stream(part) as stream, _compressed(stream, self.codec) as f:
            for batch in iterator:
                lines = [(x.as_py() or "").encode() for x in batch.column(0)]
                if lines:
                    f.write(b"\n".join(lines) + b"\n")
        system.move(part, f"{folder}/part-{c.partitionId():05d}" + ("" if self.codec == "none" else f".{self.codec}"))
        return WriterCommitMessage()


class LineReader(_Reader):
    """Lines of plain or compressed files: file, line_no (from 0), value. One partition a file."""

    arrow, split = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string())]), False

    def records(self, part: Range) -> Iterator[tuple]:
        with opened(part.path) as f:
            for i, line in enumerate(f):
                yield (part.path, i, line.rstrip(b"\n").decode(errors="replace"))


def _source(short: str, ddl: str, reader: type, writer: type | None = None) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return short

        def schema(self):
            return ddl

        def reader(self, schema):
            return reader(self.options)

        def writer(self, schema, overwrite):
            if writer is None:
                raise NotImplementedError(f"{short} is read only; see readloom.sources.text for writers")
            return writer(self.options, overwrite)

    return Source


SOURCES = [
    _source("readloom_fasta", READ_DDL, FastaReader),
    _source("readloom_fastq", READ_DDL, FastqReader),
    _source("readloom_blast", MATCH_DDL, BlastReader),
    _source("readloom_match", MATCH_DDL, MatchReader),
    _source("readloom_bam", BAM_DDL, BamReader, BamWriter),
    _source("readloom_lines", "file string, line_no bigint, value string", LineReader, LineWriter),
]


def register(spark: SparkSession) -> None:
    from readloom.session import ship

    ship(spark)
    for s in SOURCES:
        spark.dataSource.register(s)
