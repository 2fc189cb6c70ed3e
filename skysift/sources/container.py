"""Headers of four-file recordings from the binary container beside them.

The container is a tree of groups with attributes, in a published format: a
superblock leads to the object header of the root group; a group's members are in
its header, or in a tree of symbol tables; attributes are messages of a header.
Only what such headers use is read: plain numbers, strings, and how long an axis
is.  Anything else, and a damaged file, is an error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skysift.sources.raw import files_of, open_file

# Signatures, and kinds of messages.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
LINK, ATTRIBUTE, CONTINUED, SYMBOLS, DENSE = 0x06, 0x0C, 0x10, 0x11, 0x15
NOWHERE = (1 << 64) - 1
#: Largest container that is read; it holds no samples.
LARGEST = 64 << 20


def _padded(n: int) -> int:
    return -(-n // 8) * 8


class Container:
    """An open container: groups by path, and their attributes."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != SIGNATURE:
            raise ValueError("not a container of this format")
        version = data[8]
        if data[13 if version < 2 else 9] != 8 or data[14 if version < 2 else 10] != 8:
            raise ValueError("only containers with 8-byte addresses are read")
        self.root = self._long((68 if version else 64) if version < 2 else 36)

    def _long(self, at: int) -> int:
        return struct.unpack_from("<Q", self.data, at)[0]

    def _expect(self, at: int, what: bytes) -> None:
        if self.data[at : at + len(what)] != what:
            raise ValueError(f"no {what.decode()} at byte {at}")

    def _messages(self, at: int) -> Iterator[tuple[int, int, int]]:
        """(kind, first byte, bytes) of an object's messages, over all its blocks."""
        if self.data[at : at + 4] == b"OHDR":
            flags = self.data[at + 5]
            head = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            wide = 1 << (flags & 3)
            size = int.from_bytes(self.data[head : head + wide], "little")
            blocks, lead = [(head + wide, size)], 6 if flags & 4 else 4
        elif self.data[at] == 1:
            blocks, lead = [(at + 16, struct.unpack_from("<I", self.data, at + 8)[0])], 8
        else:
            raise ValueError(f"no object at byte {at}")
        while blocks:
            now, size = blocks.pop(0)
            end = now + size
            while now + lead <= end:
                kind, n = struct.unpack_from("<HH", self.data, now) if lead == 8 else (self.data[now], struct.unpack_from("<H", self.data, now + 1)[0])
                now += lead
                if kind == CONTINUED:
                    first, length = struct.unpack_from("<QQ", self.data, now)
                    if lead != 8:
                        self._expect(first, b"OCHK")
                        first, length = first + 4, length - 8  # between its name and its checksum
                    blocks.append((first, length))
                else:
                    yield kind, now, n
                now += n

    def _text(self, at: int) -> str:
        return self.data[at : self.data.index(b"\0", at)].decode()

    def _tree(self, at: int, names: int) -> Iterator[tuple[str, int]]:
        if self.data[at : at + 4] == b"SNOD":
            for i in range(struct.unpack_from("<H", self.data, at + 6)[0]):
                name, there = struct.unpack_from("<QQ", self.data, at + 8 + 40 * i)
                yield self._text(names + name), there
            return
        self._expect(at, b"TREE")
        for i in range(struct.unpack_from("<H", self.data, at + 6)[0]):
            yield from self._tree(self._long(at + 32 + 16 * i), names)

    def members(self, at: int) -> dict[str, int]:
        """Addresses of a group's members by name."""
        out: dict[str, int] = {}
        for kind, m, _ in self._messages(at):
            if kind == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", self.data, m)
                self._expect(heap, b"HEAP")
                out |= dict(self._tree(tree, self._long(heap + 24)))
            elif kind == LINK:
                flags, now = self.data[m + 1], m + 2
                soft = flags & 8 and self.data[now]
                now += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                wide = 1 << (flags & 3)
                n = int.from_bytes(self.data[now : now + wide], "little")
                if not soft:
                    out[self.data[now + wide : now + wide + n].decode()] = self._long(now + wide + n)
        return out

    def group(self, path: str) -> int:
        at = self.root
        for name in path.split("/"):
            found = self.members(at)
            if name not in found:
                raise ValueError(f"no group {path}")
            at = found[name]
        return at

    def _value(self, kind: int, value: int, n: int):
        """The first n elements at a place; kind: the place of their type."""
        which, bits, size = self.data[kind] & 15, self.data[kind + 1], struct.unpack_from("<I", self.data, kind + 4)[0]
        if which in (0, 1):
            order = ">" if bits & 1 else "<"
            dtype = f"{order}f{size}" if which else f"{order}{'i' if bits & 8 else 'u'}{size}"
            return np.frombuffer(self.data, dtype, n, value).tolist()
        if which == 3:
            return [self.data[value + i * size : value + (i + 1) * size].split(b"\0")[0].decode() for i in range(n)]
        if which == 9 and bits & 15 == 1:
            out = []
            for i in range(n):
                length, heap, number = struct.unpack_from("<IQI", self.data, value + 16 * i)
                out.append(self._from_heap(heap, number)[:length].split(b"\0")[0].decode() if length else "")
            return out
        return None

    def _from_heap(self, at: int, number: int) -> bytes:
        self._expect(at, b"GCOL")
        end, now = at + self._long(at + 8), at + 16
        while now < end:
            own, size = struct.unpack_from("<H", self.data, now)[0], self._long(now + 8)
            if own == number:
                return self.data[now + 16 : now + 16 + size]
            if not own:
                break
            now += 16 + _padded(size)
        raise ValueError(f"no object {number} in the heap at byte {at}")

    def attributes(self, at: int) -> dict[str, tuple[int, object]]:
        """An object's attributes: how many elements each has, and their values (None for other kinds)."""
        out = {}
        for kind, m, n in self._messages(at):
            if kind == DENSE and self._long(m + 2 + (2 if self.data[m + 1] & 1 else 0)) != NOWHERE:
                raise ValueError("attributes outside of headers are not read")
            if kind != ATTRIBUTE:
                continue
            version, name, kind_size, space_size = self.data[m], *struct.unpack_from("<HHH", self.data, m + 2)
            pad = _padded if version == 1 else int
            first = m + (9 if version == 3 else 8)
            of = first + pad(name)
            space = of + pad(kind_size)
            value = space + pad(space_size)
            rank = self.data[space + 1]
            dims = struct.unpack_from(f"<{rank}Q", self.data, space + (8 if self.data[space] == 1 else 4))
            count = int(np.prod(dims, dtype=np.int64)) if rank else 1
            out[self._text(first)] = (count, self._value(of, value, count) if value < m + n or not count else None)
        return out


def header_of(data: bytes, name: str) -> dict:
    """Header of a four-file recording from its container; the pointing and the beam are in its name.

    Frequencies in Hz become MHz; 8 bits and four planes; the channels are as many as
    the second axis has values.
    """
    ids = [re.search(rf"_{k}(\d+)", name) for k in ("SAP", "B")]
    if not all(ids):
        raise ValueError(f"{name} tells no pointing and beam")
    c = Container(data)
    # Names of groups and attributes.
    pointing = "SUB_ARRAY_POINTING_%03d" % int(ids[0][1])
    beam = f"{pointing}/BEAM_%03d" % int(ids[1][1])

    def get(group: str, attribute: str):
        found = c.attributes(c.group(group))
        if attribute not in found or found[attribute][1] is None:
            raise ValueError(f"no attribute {attribute} in {group}")
        return found[attribute][1][0]

    def in_mhz(attribute: str) -> float:
        return get(beam, attribute) * (1e-6 if get(beam, f"{attribute}_UNIT") == "Hz" else 1.0)

    nchan = c.attributes(c.group(f"{beam}/COORDINATES/COORDINATE_1"))["AXIS_VALUES_WORLD"][0]
    width = in_mhz("CHANNEL_WIDTH")
    return {
        "nbits": 8, "npol": 4, "nchan": nchan, "chan_bw": width, "cent_freq": in_mhz("BEAM_FREQUENCY_CENTER"), "obs_bw": nchan * width,
        "block_size": get(beam, "NOF_SAMPLES") * 4 * nchan, "t_resolution": get(f"{beam}/COORDINATES/COORDINATE_0", "INCREMENT"), "tstart": get(pointing, "EXPTIME_START_MJD"),
        "ra": get(pointing, "POINT_RA"), "dec": get(pointing, "POINT_DEC"), "source": get(beam, "TARGETS"),
    }


def read_header(path: str) -> dict:
    with open_file(path) as f:
        if f.size() > LARGEST:
            raise ValueError(f"{path} is too large for a header")
        return header_of(f.read_at(f.size(), 0), path.rsplit("/", 1)[-1])


def planes_of(path: str) -> str:
    """The first of the four files whose container this is."""
    found = re.fullmatch(r"(.*)_S[0-3]_(.*)\.h5", path)
    if not found:
        raise ValueError("a container's name has a part _S0_ and ends with .h5")
    return f"{found[1]}_S0_{found[2]}.raw"


HEADERS = "path string, nbits int, npol int, nchan int, chan_bw double, cent_freq double, obs_bw double, block_size long, t_resolution double, tstart double, ra double, dec double, source string"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS of a container or of all in a folder, each read in a task."""
    paths = [p for p in files_of(path) if p.endswith(".h5")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in HEADERS.split(", ")])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"path": p} | read_header(p) for p in batch.column("path").to_pylist()], schema=schema)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, HEADERS)
