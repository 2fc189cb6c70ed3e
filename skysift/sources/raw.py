"""Raw voltage recordings of the text-header kind.

``spark.read.format("raw_voltage").load(path)`` gives a row per block and
channel: block, chan, nbits, npol, nchan, chan_bw, obs_freq, obs_bw, tbin,
telescope, data.  One partition per block, or per some small ones; filters on block and chan, and
``option("blocks", "0,3")``, are taken before anything but headers is read.

A search reads overlapping chunks instead: ``index()`` walks the headers of many
files in tasks, ``chunk_table()`` cuts their blocks to chunks, and a task reads
each channel's bytes of a chunk with ``Voltages``.  ``raw_chunks`` is the same
table as a stream over the files of a folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from skysift.functions.lineage import cut

CARD = 80
#: Samples of a batch.
CELLS = 1 << 16
#: Bytes of samples that make a task worth while; smaller chunks and blocks share one.
TASK_BYTES = 1 << 18
SCHEMA = "block long, chan long, nbits int, npol int, nchan int, chan_bw double, obs_freq double, obs_bw double, tbin double, telescope string, data binary"
TELESCOPES = ("GBT", "PARKES")
#: Bits of a number and how it is stored; other depths are refused.
DEPTHS = {8: "i1", 16: "<i2"}


def parse_header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Keywords of the cards up to END, and the header's bytes; None if it isn't one."""
    out: dict[str, str] = {}
    for at in range(0, len(raw), CARD):
        card = raw[at : at + CARD].decode("ascii", "replace")
        if card.startswith("END") and not card[3:].strip():
            size = at + CARD
            if int(out.get("DIRECTIO", "0")):
                size = -(-size // 512) * 512
            return out, size
        if "=" in card:
            key, _, value = card.partition("=")
            out[key.strip()] = value.split(" /")[0].strip().strip("'").strip()
    return None


def normalised(h: dict[str, str]) -> dict:
    """Typed header: bandwidths and frequency positive; a negative channel width means channels run downwards.

    A header that nowhere says RAW is of another mode, and that is an error, as is a depth that can't be read.
    """
    if not any("RAW" in x for pair in h.items() for x in pair):
        raise ValueError("not a header of raw mode")
    if int(h.get("NBITS", 8)) not in DEPTHS:
        raise ValueError(f"samples of {h['NBITS']} bits cannot be read")
    bw = float(h["CHAN_BW"])
    name = h.get("TELESCOP", "")
    return {
        "nbits": int(h.get("NBITS", 8)), "npol": int(h.get("NPOL", 4)), "nchan": int(h["OBSNCHAN"]), "chan_bw": abs(bw), "descending": bw < 0,
        "obs_freq": abs(float(h["OBSFREQ"])), "obs_bw": abs(float(h["OBSBW"])), "block_size": int(h["BLOCSIZE"]), "tbin": float(h["TBIN"]),
        "telescope": next((t for t in TELESCOPES if t in name), "OTHER"), "direct_io": bool(int(h.get("DIRECTIO", "0"))),
    }


def normalised_width(bw) -> list:
    """Columns chan_bw and straight_order of a signed channel width, as normalised() has them."""
    return [F.abs(bw).alias("chan_bw"), (bw >= 0).alias("straight_order")]


class Block:
    def __init__(self, path: str, block: int, offset: int, header: dict):
        self.path, self.block, self.offset, self.header = path, block, offset, header


class _Blocks(InputPartition):
    def __init__(self, blocks: list[Block]):
        super().__init__(blocks[0].block if blocks else -1)
        self.blocks = blocks


def shared_out(items: list, size) -> list[list]:
    """Items in order, put together as long as they have no more than TASK_BYTES by size()."""
    out, full = [], TASK_BYTES
    for x in items:
        if full + size(x) > TASK_BYTES:
            out.append([])
            full = 0
        out[-1].append(x)
        full += size(x)
    return out


#: Bytes within which a header must end.
HEADER = 1 << 20


def open_file(path: str):
    """A file of any store that has a URI, or a local path, for random reads."""
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return pa.OSFile(path)


def files_of(path: str) -> list[str]:
    """A recording, or all in a folder in the order of their names."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and not f.base_name.startswith("."))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def plan_blocks(path: str, wanted: set[int] | None = None) -> list[Block]:
    """Blocks of a recording, or of all in a folder, counted on in the order of their names."""
    out: list[Block] = []
    first = 0
    for f in files_of(path):
        every = blocks_of(f, first)
        first += len(every)
        out += [b for b in every if wanted is None or b.block in wanted]
    return out


def blocks_of(path: str, n: int = 0, growing: bool = False) -> list[Block]:
    """Blocks of one recording, counted from n; it ends after a whole block, else it is damaged and that is an error.

    A growing recording may end anywhere: its whole blocks are taken.
    """
    out, at = [], 0
    with open_file(path) as f:
        end = f.size()
        while at < end:
            head = f.read_at(min(64 * 1024, end - at), at)
            found = parse_header(head) or parse_header(f.read_at(min(HEADER, end - at), at))
            if found is None and not growing:
                raise ValueError(f"{path}: no header at byte {at}")
            header = normalised(found[0]) if found else None
            if header is None or at + found[1] + header["block_size"] > end:
                if growing:
                    break
                raise ValueError(f"{path}: block {n} is cut short")
            out.append(Block(path, n, at + found[1], header))
            size = header["block_size"]
            at += found[1] + (-(-size // 512) * 512 if header["direct_io"] else size)
            n += 1
    return out


#: Filters that a reader takes, and what they say of a value.
COMPARED = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted = {int(x) for x in options["blocks"].split(",")} if options.get("blocks") else None
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in COMPARED and f.attribute in (("block",), ("chan",)) and f.value is not None:
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _passes(self, name: str, value: int) -> bool:
        return all(COMPARED[kind](value, x) for n, kind, x in self.filters if n == name)

    def partitions(self) -> list[_Blocks]:
        blocks = [b for b in plan_blocks(self.path, self.wanted) if self._passes("block", b.block)]
        return [_Blocks(x) for x in shared_out(blocks, lambda b: b.header["block_size"])] or [_Blocks([])]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        for b in partition.blocks:
            h = b.header
            each = h["block_size"] // h["nchan"]
            with open_file(b.path) as f:
                for i in range(h["nchan"]):
                    chan = h["nchan"] - 1 - i if h["descending"] else i
                    if self._passes("chan", chan):
                        yield b.block, chan, h["nbits"], h["npol"], h["nchan"], h["chan_bw"], h["obs_freq"], h["obs_bw"], h["tbin"], h["telescope"], f.read_at(each, b.offset + i * each)


class RawVoltage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_voltage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


#: A block of a recording: where its payload lies, how long it is, and its header.
BLOCKS = "file string, paths array<string>, layout string, block long, offset long, stride long, samples long, npol int, nbits int, nchan int, descending boolean, chan_bw double, obs_freq double, obs_bw double, tbin double, telescope string"
#: A chunk of it: its first sample, its samples, and the part of them that no neighbour has too.
CHUNKS = f"{BLOCKS}, chunk long, first long, taken long, own_from long, own_to long"
NPOL, NBITS, NCHAN, TAKEN = ([c.split()[0] for c in CHUNKS.split(", ")].index(c) for c in ("npol", "nbits", "nchan", "taken"))


def _row(b: Block) -> tuple:
    h = b.header
    stride = h["block_size"] // h["nchan"]
    samples = stride * 8 // (h["npol"] * h["nbits"])
    return (b.path.rsplit("/", 1)[-1], [b.path], "channels", b.block, b.offset, stride, samples, h["npol"], h["nbits"], h["nchan"], h["descending"], h["chan_bw"], h["obs_freq"], h["obs_bw"], h["tbin"], h["telescope"])


def index(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS of a recording or of all in a folder; each file's headers are walked in a task, and blocks count from 0 in each file."""
    paths = files_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                rows = [_row(b) for b in blocks_of(p)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = pa.schema([(x.split()[0], types[x.split()[1]]) for x in BLOCKS.split(", ")])
    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_of(spark, len(paths), 0))
    return cut(table.mapInArrow(run, BLOCKS))


def channels(blocks: DataFrame) -> DataFrame:
    """(file, block, chan, nbits, npol, data) of index()'s blocks, each read by a task; a filter on the blocks leaves the others unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["paths"][0]) as f:
                    for i in range(r["nchan"]):
                        row = {k: r[k] for k in ("file", "block", "nbits", "npol")} | {"chan": r["nchan"] - 1 - i if r["descending"] else i, "data": f.read_at(r["stride"], r["offset"] + i * r["stride"])}
                        yield pa.RecordBatch.from_pylist([row], schema=kinds)

    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("chan", pa.int64()), ("nbits", pa.int32()), ("npol", pa.int32()), ("data", pa.binary())])
    return dealt(blocks).mapInArrow(run, "file string, block long, chan long, nbits int, npol int, data binary")


def chunk_table(blocks: DataFrame, length: int, overlap: int) -> DataFrame:
    """CHUNKS of the blocks: so many samples each, two overlaps more than the step, the last one ending with its block.

    A sample in two chunks is owned by the one in which it lies further from the edge.
    """
    if length <= 2 * overlap:
        raise ValueError("a chunk must be longer than its overlaps")
    step = length - 2 * overlap
    last = F.expr(f"greatest(0L, (samples - {2 * overlap + 1}) div {step})")
    start = lambda c: F.greatest(F.lit(0), F.least(c * step, F.col("samples") - length)).cast("long")
    rows = blocks.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    rows = rows.withColumn("first", start(F.col("chunk"))).withColumn("taken", F.least(F.lit(length), F.col("samples")).cast("long"))
    own_from = F.when(F.col("chunk") == 0, 0).otherwise(start(F.col("chunk") - 1) + length - overlap - F.col("first"))
    own_to = F.when(F.col("chunk") == F.col("last"), F.col("taken")).otherwise(F.col("taken") - overlap)
    return rows.withColumns({"own_from": own_from.cast("long"), "own_to": own_to.cast("long")}).drop("last")


def tasks_of(spark: SparkSession, n: int, tasks: int) -> int:
    """So many tasks for n rows that are alike, but a few for each core, if there are rows."""
    return max(1, min(n, max(tasks, 4 * spark.sparkContext.defaultParallelism)))


def dealt(places: DataFrame) -> DataFrame:
    """Every chunk or block a task of its own, if it is not small (``TASK_BYTES``) and there are not very many; rows are only places in files."""
    taken = F.col("taken") if "taken" in places.columns else F.col("samples")
    n, size = places.agg(F.count("*"), F.sum(taken * F.col("nchan") * F.col("npol") * F.col("nbits") / 8)).first()
    return places.repartition(tasks_of(places.sparkSession, n, min(100_000, int((size or 0) // TASK_BYTES))))


class Voltages:
    """The samples of one chunk, as they lie in the file; a row of CHUNKS."""

    def __init__(self, row: dict):
        self.row, kind = row, np.dtype(DEPTHS[row["nbits"]])
        nchan, taken, first = row["nchan"], row["taken"], row["first"]
        self.parts = []
        if row["layout"] == "planes":
            for p in row["paths"]:
                with open_file(p) as f:
                    self.parts.append(np.frombuffer(f.read_at(taken * nchan * kind.itemsize, row["offset"] + first * nchan * kind.itemsize), kind).reshape(taken, nchan))
            return
        each = row["npol"] * kind.itemsize
        with open_file(row["paths"][0]) as f:
            for i in range(nchan):
                raw = f.read_at(taken * each, row["offset"] + i * row["stride"] + first * each)
                self.parts.append(np.frombuffer(raw, kind).reshape(taken, row["npol"] // 2, 2))

    def channel(self, chan: int) -> np.ndarray:
        """(polarisation, sample) of a channel, complex."""
        if self.row["layout"] == "planes":
            v = [p[:, chan].astype(float) for p in self.parts]
            return np.array([v[i] + 1j * v[i + 1] for i in range(0, len(v), 2)])
        v = self.parts[self.row["nchan"] - 1 - chan if self.row["descending"] else chan]
        return (v[..., 0] + 1j * v[..., 1]).T


class _Places(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class _Stream(DataSourceStreamReader):
    """Chunks of the recordings of a folder, in the order of files' names, blocks and chunks.

    An offset is the file, block and chunk that come next.  Only whole blocks
    count, so a recording may still grow; new files must come later in the order
    of names.
    """

    def __init__(self, options: dict):
        self.path, self.length, self.overlap = options["path"], int(options["length"]), int(options["overlap"])

    def _rows(self, start: dict) -> Iterator[tuple[tuple, tuple]]:
        """(place, row) of all chunks from a place on."""
        step, place = self.length - 2 * self.overlap, (start["file"], start["block"], start["chunk"])
        for f in files_of(self.path):
            if f.rsplit("/", 1)[-1] < place[0]:
                continue
            for b in blocks_of(f, growing=True):
                row = _row(b)
                n = row[6]
                last = max(0, (n - 2 * self.overlap - 1) // step)
                firsts = [max(0, min(j * step, n - self.length)) for j in range(last + 1)]
                for j, first in enumerate(firsts):
                    taken = min(self.length, n)
                    own = (0 if j == 0 else firsts[j - 1] + self.length - self.overlap - first, taken if j == last else taken - self.overlap)
                    if (row[0], b.block, j) >= place:
                        yield (row[0], b.block, j), (*row, j, first, taken, *own)

    def initialOffset(self) -> dict:
        return {"file": "", "block": 0, "chunk": 0}

    def latestOffset(self) -> dict:
        files = files_of(self.path)
        for f in reversed(files):  # the last file that has a whole block
            if blocks := blocks_of(f, growing=True):
                return {"file": f.rsplit("/", 1)[-1], "block": blocks[-1].block + 1, "chunk": 0}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Places]:
        stop = (end["file"], end["block"], end["chunk"])
        rows = [row for place, row in self._rows(start) if place < stop]
        return [_Places(x) for x in shared_out(rows, lambda r: r[TAKEN] * r[NCHAN] * r[NPOL] * r[NBITS] // 8)] or [_Places([])]

    def read(self, partition: _Places) -> Iterator[tuple]:
        yield from partition.rows


class RawChunks(DataSource):
    """``readStream.format("raw_chunks").option("length", ...).option("overlap", ...).load(folder)``: CHUNKS as files arrive."""

    @classmethod
    def name(cls) -> str:
        return "raw_chunks"

    def schema(self) -> str:
        return CHUNKS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets it hand them filters."""
    spark.dataSource.register(RawVoltage)
    spark.dataSource.register(RawChunks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def samples(raw: DataFrame) -> DataFrame:
    """(block, chan, pol, isamp, re, im) of data that interleave time, polarisation, and real and imaginary part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, chan, npol, nbits, data in zip(*(batch.column(c) for c in ("block", "chan", "npol", "nbits", "data")), strict=True):
                pairs = npol.as_py() // 2
                v = np.frombuffer(data.as_buffer(), DEPTHS[nbits.as_py()]).astype(float).reshape(-1, 2)
                for first in range(0, len(v), CELLS):
                    part = v[first : first + CELLS]
                    at = np.arange(first, first + len(part))
                    yield pa.RecordBatch.from_arrays([pa.repeat(block, len(part)), pa.repeat(chan, len(part)), pa.array((at % pairs).astype(np.int32)), pa.array(at // pairs), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["block", "chan", "pol", "isamp", "re", "im"])

    return raw.select("block", "chan", "npol", "nbits", "data").mapInArrow(run, "block long, chan long, pol int, isamp long, re double, im double")
