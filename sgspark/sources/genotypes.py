"""Genotype files as a data source: two-bit files and variable-length dosage files, by blocks of variants.

    register(spark)
    spark.read.format("genotypes").option("path", "chr1.pgen").option("block", 4096).load().where("idx between 0 and 999")

gives path, idx (the variant's number in the file) and dosages (array<double>, one a sample: counts of the first allele;
null where missing). The driver reads the files' first bytes only. A partition is ``block`` variants of a file, and a task
opens the file, reads the index of its own variants and their bytes. Comparisons of idx with numbers and a list of samples
(option "samples": numbers in increasing order, comma-separated) are applied before anything is read or decoded: blocks
outside a range are no partitions. Paths are opened by pyarrow, on the driver and in tasks.

Formats, from the public descriptions: two-bit files (variant-major), and dosage files of storage modes 2 and 3 (fixed
width) and 16 (variable width: plain, one-bit, difference lists against the most frequent genotype or the last variant
that isn't coded so itself, phase skipped, dosages as a list, a bit set or in full). Variants of more than two alleles
raise, and so do truncated and foreign files. A file without variants gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Variants of a partition, unless the option "block" says otherwise, and values decoded at once.
BLOCK, BATCH_CELLS = 4096, 1 << 22
#: Fixed values of the formats: first bytes, variants of an index block, units of one allele, a missing dosage.
MAGIC, TWO_BIT, INDEX, UNIT, MISSING = b"\x6c\x1b", 1, 1 << 16, 16384, 65535
#: Fixed value: counts of the first allele of two-bit codes.
CODES = np.array([2, -1, 1, 0], dtype=np.int8)


def _file(path: str):
    system, at = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _listed(path: str) -> list[str]:
    """The file, or the genotype files of a folder, by name."""
    system, at = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    inside = system.get_file_info(fs.FileSelector(at))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in inside if f.extension in ("bed", "pgen") and not f.base_name.startswith((".", "_")))


@dataclass
class Layout:
    """What a file's first bytes say: mode, numbers of variants and samples, and how its index is stored."""

    mode: int
    variants: int
    samples: int
    type_bits: int = 0
    length_bytes: int = 0
    allele_bytes: int = 0
    flags: int = 0

    def block_bytes(self, n: int) -> int:
        """Bytes of the index of n variants of one block."""
        return -(-n * self.type_bits // 8) + n * self.length_bytes + n * self.allele_bytes + (-(-n // 8) if self.flags == 3 else 0)


def layout(path: str, samples: int) -> Layout:
    """Of a file; two-bit files don't say how many samples they hold."""
    with _file(path) as f:
        head = f.read(12)
        if len(head) < 3 or head[:2] != MAGIC:
            raise ValueError(f"{path} isn't a genotype file")
        mode = head[2]
        if mode == TWO_BIT:
            body, stride = f.size() - 3, -(-samples // 4)
            if samples < 1 or body % stride:
                raise ValueError(f"{path} isn't a variant-major genotype file of {samples} samples")
            return Layout(mode, body // stride, samples)
        if mode not in (2, 3, 16) or len(head) < 12:
            raise ValueError(f"{path} has storage mode {mode}")
        variants, held, control = struct.unpack("<IIB", head[3:12])
        if samples and samples != held:
            raise ValueError(f"{path} holds {held} samples, not {samples}")
        out = Layout(mode, variants, held)
        if mode == 16:
            low = control & 15
            if low > 7:
                raise ValueError(f"{path} has an index of kind {low}")
            out.type_bits, out.length_bytes = (4, low + 1) if low < 4 else (8, low - 3)
            out.allele_bytes, out.flags = control >> 4 & 3, control >> 6
            size = 12 + 8 * -(-variants // INDEX) + sum(out.block_bytes(min(INDEX, variants - k)) for k in range(0, variants, INDEX))
        else:
            size = 12 + variants * (-(-held // 4) + (2 * held if mode == 3 else 0))
        if f.size() < size:
            raise ValueError(f"{path} is truncated")
        return out


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _two_bits(data: np.ndarray, n: int) -> np.ndarray:
    return ((data[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).ravel()[:n]


def _bits(data: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(data, bitorder="little", count=n).astype(bool)


class Record:
    """A variable-width record's bytes, read from the front."""

    def __init__(self, data: bytes, samples: int):
        self.view, self.bytes, self.at, self.n = memoryview(data), np.frombuffer(data, np.uint8), 0, samples

    def take(self, size: int) -> np.ndarray:
        if self.at + size > len(self.bytes):
            raise ValueError("a record is shorter than its contents")
        self.at += size
        return self.bytes[self.at - size : self.at]

    def varint(self) -> int:
        value, self.at = _varint(self.view, self.at)
        return value

    def members(self, valued: bool) -> tuple[np.ndarray, np.ndarray]:
        """A difference list: increasing sample numbers and, if ``valued``, their genotypes. Groups of 64 start at given
        numbers; the rest are distances."""
        count = self.varint()
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        groups, width = -(-count // 64), max(1, -(-self.n.bit_length() // 8))
        starts = self.take(groups * width).reshape(groups, width).astype(np.int64) @ (1 << 8 * np.arange(width))
        self.take(groups - 1)  # sizes of the groups, for jumps
        values = _two_bits(self.take(-(-count // 4)), count) if valued else np.zeros(0, np.uint8)
        ids = np.empty(count, np.int64)
        for g in range(groups):
            at = ids[g * 64] = starts[g]
            for k in range(g * 64 + 1, min(count, g * 64 + 64)):
                at += self.varint()
                ids[k] = at
        if ids[-1] >= self.n or (np.diff(ids) <= 0).any():
            raise ValueError("a difference list isn't in order")
        return ids, values

    def genotypes(self, kind: int, base: np.ndarray | None) -> np.ndarray:
        """Counts of the second allele, 3 for missing."""
        track = kind & 7
        if kind & 8:
            raise ValueError("variants of more than two alleles aren't supported")
        if track == 0:
            return _two_bits(self.take(-(-self.n // 4)), self.n).copy()
        if track == 1:
            pair = int(self.take(1)[0])
            out = (pair // 4 + (pair & 3) * _bits(self.take(-(-self.n // 8)), self.n)).astype(np.uint8)
        elif track in (2, 3):
            if base is None:
                raise ValueError("a difference from a variant that isn't there")
            out = base.copy()
        elif track == 5:
            raise ValueError("a record of a kind that is reserved")
        else:
            out = np.full(self.n, track & 3, np.uint8)
        ids, values = self.members(True)
        out[ids] = values
        return np.array([2, 1, 0, 3], np.uint8)[out] if track == 3 else out

    def dosages(self, kind: int, geno: np.ndarray) -> np.ndarray:
        """Dosages of the second allele, nan for missing."""
        out = np.where(geno == 3, np.nan, geno.astype(np.float64))
        if kind & 16:  # phases of heterozygous calls
            hets = int((geno == 1).sum())
            start = self.at
            some = _bits(self.take(-(-(hets + 1) // 8)), hets + 1)
            if some[0]:
                self.take(-(-int(some[1:].sum()) // 8))
            else:
                self.at = start + -(-(hets + 1) // 8)
        how = kind >> 5 & 3
        if how == 0:
            return out
        if how == 1:
            ids, _ = self.members(False)
        elif how == 3:
            ids = np.flatnonzero(_bits(self.take(-(-self.n // 8)), self.n))
        else:
            ids = np.arange(self.n)
        raw = self.take(2 * len(ids)).view("<u2")
        value = raw.astype(np.float64) / UNIT
        known = raw != MISSING
        out[ids[known]] = value[known]
        if how == 2:
            out[ids[~known]] = np.nan
        return out


def _ahead(f, spec: Layout, start: int, stop: int) -> Iterator[np.ndarray]:
    """Dosages of the second allele of the variants start to stop of a variable-width file."""
    base, number = None, -1
    for first in range(start // INDEX * INDEX, stop, INDEX):
        n = min(INDEX, spec.variants - first)
        block = first // INDEX
        f.seek(12 + 8 * block)
        place = struct.unpack("<Q", f.read(8))[0]
        f.seek(12 + 8 * -(-spec.variants // INDEX) + sum(spec.block_bytes(min(INDEX, spec.variants - k)) for k in range(0, first, INDEX)))
        index = np.frombuffer(f.read(spec.block_bytes(n)), np.uint8)
        size = -(-n * spec.type_bits // 8)
        kinds = index[:size] if spec.type_bits == 8 else np.stack([index[:size] & 15, index[:size] >> 4], axis=1).ravel()[:n]
        sizes = index[size : size + n * spec.length_bytes].reshape(n, spec.length_bytes).astype(np.int64) @ (1 << 8 * np.arange(spec.length_bytes))
        if spec.allele_bytes and (index[size + n * spec.length_bytes :][: n * spec.allele_bytes].reshape(n, -1).astype(np.int64) @ (1 << 8 * np.arange(spec.allele_bytes)) > 2).any():
            raise ValueError("variants of more than two alleles aren't supported")
        places = place + np.cumsum(sizes) - sizes
        low, high = max(0, start - first), min(n, stop - first)
        own = (kinds & 7 != 2) & (kinds & 7 != 3)
        if low < high and not own[low]:  # the last variant before that isn't a difference itself
            before = np.flatnonzero(own[:low])
            if not len(before):
                raise ValueError("a block starts with a difference")
            at = int(before[-1])
            f.seek(places[at])
            base, number = Record(f.read(int(sizes[at])), spec.samples).genotypes(int(kinds[at]), None), first + at
        f.seek(places[low])
        for k in range(low, high):
            record = Record(f.read(int(sizes[k])), spec.samples)
            geno = record.genotypes(int(kinds[k]), base if number >= first else None)
            if own[k]:
                base, number = geno, first + k
            yield record.dosages(int(kinds[k]), geno)


def read_range(path: str, spec: Layout, start: int, stop: int) -> Iterator[np.ndarray]:
    """Counts of the first allele of each variant from start to stop, nan for missing."""
    n = spec.samples
    with _file(path) as f:
        if spec.mode == 16:
            for x in _ahead(f, spec, start, stop):
                yield 2 - x
            return
        four = -(-n // 4)
        stride, head = (four, 3) if spec.mode == TWO_BIT else (four + (2 * n if spec.mode == 3 else 0), 12)
        f.seek(head + start * stride)
        for _ in range(start, stop):
            data = np.frombuffer(f.read(stride), np.uint8)
            two = _two_bits(data[:four], n)
            if spec.mode == TWO_BIT:
                calls = CODES[two].astype(np.float64)
                calls[calls < 0] = np.nan
                yield calls
            elif spec.mode == 2:
                yield np.where(two == 3, np.nan, 2 - two.astype(np.float64))
            else:
                raw = data[four:].view("<u2")
                yield np.where(raw == MISSING, np.nan, 2 - raw.astype(np.float64) / UNIT)


class Part(InputPartition):
    """Variants start to stop of a file."""

    def __init__(self, path: str, spec: Layout, start: int, stop: int):
        self.path, self.spec, self.start, self.stop = path, spec, start, stop


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.samples, self.block = int(options.get("n", 0)), int(options.get("block", BLOCK))
        some = options.get("samples")
        self.some = None if some is None else np.array([int(x) for x in some.split(",") if x.strip()], np.int64)
        if self.some is not None and (not len(self.some) or self.some[0] < 0 or (np.diff(self.some) <= 0).any()):
            raise ValueError("samples are numbers in increasing order")
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            whole = isinstance(getattr(f, "value", None), int) and getattr(f, "attribute", None) == ("idx",)
            if whole and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if whole and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            if not (whole and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual))):
                yield f

    def partitions(self):
        out = []
        for path in _listed(self.path):
            spec = layout(path, self.samples)
            if self.some is not None and self.some[-1] >= spec.samples:
                raise ValueError(f"{path} holds {spec.samples} samples")
            low, high = max(0, self.low), min(spec.variants, self.high)
            if low < high:
                out += [Part(path, spec, max(low, k), min(high, k + self.block)) for k in range(low // self.block * self.block, high, self.block)]
        return out or [Part(self.path, Layout(TWO_BIT, 0, 0), 0, 0)]

    def read(self, partition: Part):
        spec = partition.spec
        if partition.start >= partition.stop:
            return
        n = spec.samples if self.some is None else len(self.some)
        step = max(1, BATCH_CELLS // max(spec.samples, 1))
        held: list[np.ndarray] = []
        first = partition.start

        def batch() -> pa.RecordBatch:
            x = np.stack(held)
            values = pa.array(x.ravel(), mask=np.isnan(x.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(x)), pa.array(np.arange(first, first + len(x))), lists], ["path", "idx", "dosages"])

        for x in read_range(partition.path, spec, partition.start, partition.stop):
            held.append(x if self.some is None else x[self.some])
            if len(held) >= step:
                yield batch()
                first, held = first + len(held), []
        if held:
            yield batch()


class Genotypes(DataSource):
    """Options: path (a file or a folder of them), n (samples, which two-bit files need), samples, block."""

    @classmethod
    def name(cls) -> str:
        return "genotypes"

    def schema(self) -> str:
        return "path string, idx long, dosages array<double>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark hand it comparisons of idx."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Genotypes)


def read(spark: SparkSession, path: str, n: int = 0, samples: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """Variants of a file or folder: path, idx and dosages."""
    register(spark)
    source = spark.read.format("genotypes").option("n", n).option("block", block)
    return (source if samples is None else source.option("samples", ",".join(map(str, samples)))).load(path)


# --- writing -------------------------------------------------------------------------------------------------------


def _put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _put_two_bits(x: np.ndarray) -> bytes:
    wide = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    wide[: len(x)] = x
    return (wide.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _put_members(ids: np.ndarray, n: int, values: np.ndarray | None) -> bytes:
    if not len(ids):
        return _put_varint(0)
    width = max(1, -(-n.bit_length() // 8))
    groups = [ids[k : k + 64].tolist() for k in range(0, len(ids), 64)]
    steps = [b"".join(_put_varint(b - a) for a, b in zip(g, g[1:])) for g in groups]  # noqa: B905
    starts = b"".join(g[0].to_bytes(width, "little") for g in groups)
    return _put_varint(len(ids)) + starts + bytes(len(s) - 63 for s in steps[:-1]) + (_put_two_bits(values) if values is not None else b"") + b"".join(steps)


def encoded(x: np.ndarray, base: np.ndarray | None) -> tuple[int, bytes, np.ndarray]:
    """The shortest record of dosages of the second allele (nan: missing): kind, bytes and genotypes. base: those of the last
    variant that isn't a difference; None where the record can't be one."""
    n = len(x)
    units = np.where(np.isnan(x), MISSING, np.round(np.nan_to_num(x) * UNIT)).astype(np.int64)
    near = np.clip(np.round(np.nan_to_num(x)), 0, 2).astype(np.uint8)
    geno = np.where(np.isnan(x) | (np.abs(units - near.astype(np.int64) * UNIT) > UNIT // 10 * 4), 3, near).astype(np.uint8)
    ways = [(0, _put_two_bits(geno))]
    counts = np.bincount(geno, minlength=4)
    first, second = sorted(np.argsort(-counts, kind="stable")[:2].tolist())
    rest = np.flatnonzero((geno != first) & (geno != second))
    ways.append((1, bytes([first * 4 + second - first]) + np.packbits(geno == second, bitorder="little").tobytes() + _put_members(rest, n, geno[rest])))
    for common in (0, 2, 3):
        rest = np.flatnonzero(geno != common)
        ways.append((4 | common, _put_members(rest, n, geno[rest])))
    if base is not None:
        rest = np.flatnonzero(geno != base)
        ways.append((2, _put_members(rest, n, geno[rest])))
        turned = np.array([2, 1, 0, 3], np.uint8)[geno]
        rest = np.flatnonzero(turned != base)
        ways.append((3, _put_members(rest, n, turned[rest])))
    kind, body = min(ways, key=lambda w: (len(w[1]), w[0]))
    plain = np.where(geno == 3, MISSING, geno.astype(np.int64) * UNIT)
    some = np.flatnonzero(units != plain)
    if len(some):
        raw = units.astype("<u2")
        more = [(0x20, _put_members(some, n, None) + raw[some].tobytes()), (0x40, raw.tobytes()), (0x60, np.packbits(units != plain, bitorder="little").tobytes() + raw[some].tobytes())]
        how, track = min(more, key=lambda w: (len(w[1]), w[0]))
        kind, body = kind | how, body + track
    return kind, body, geno


def write_pgen(rows: DataFrame, path: str) -> None:
    """Writes dosages (idx, dosages: counts of the first allele, null where missing) as one variable-width file in the order
    of idx, by one task that holds a variant at a time and 5 bytes for each; dosages are rounded to 1 / 16384. ``path`` is
    one that executors can write to. No rows give a file without variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(at.rsplit("/", 1)[0])
        kinds, sizes, samples, base = bytearray(), [], 0, None
        with system.open_output_stream(f"{at}.body") as f:
            for batch in batches:
                for row in batch.column(1):
                    x = 2 - np.array([np.nan if v is None else v for v in row.as_py()], np.float64)
                    if kinds and len(x) != samples:
                        raise ValueError("variants of different numbers of samples")
                    samples = len(x)
                    kind, body, geno = encoded(x, base if len(kinds) % INDEX else None)
                    if kind & 7 not in (2, 3):
                        base = geno
                    kinds.append(kind)
                    sizes.append(len(body))
                    f.write(body)
        m = len(kinds)
        spec = Layout(16, m, samples, 8, 4)
        place = 12 + 8 * -(-m // INDEX) + sum(spec.block_bytes(min(INDEX, m - k)) for k in range(0, m, INDEX))
        with system.open_output_stream(at) as f:
            f.write(MAGIC + bytes([16]) + struct.pack("<IIB", m, samples, 7 | 1 << 6))
            lengths = np.array(sizes, "<u4")
            for k in range(0, m, INDEX):
                f.write(struct.pack("<Q", place + int(lengths[:k].sum(dtype=np.int64))))
            for k in range(0, m, INDEX):
                f.write(bytes(kinds[k : k + INDEX]) + lengths[k : k + INDEX].tobytes())
            with system.open_input_stream(f"{at}.body") as body:
                while part := body.read(1 << 22):
                    f.write(part)
        system.delete_file(f"{at}.body")
        yield pa.RecordBatch.from_arrays([pa.array([m])], ["done"])

    if not rows.select("idx", "dosages").repartition(1).sortWithinPartitions("idx").mapInArrow(run, "done long").collect():
        system, at = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
        with system.open_output_stream(at) as f:
            f.write(MAGIC + bytes([16]) + struct.pack("<IIB", 0, 0, 7 | 1 << 6))
