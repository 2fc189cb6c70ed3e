"""A small writer of containers, in both of the format's generations, for the tests of their reader."""

import struct

NOWHERE = (1 << 64) - 1


def padded(b):
    return b + bytes(-len(b) % 8)


def typed(value):
    """(type, space, data or None) of an attribute: float, int, string, or a list of floats as an axis."""
    if isinstance(value, list):
        return struct.pack("<BBBBI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023), struct.pack("<BBBB4xQ", 1, 1, 0, 0, len(value)), struct.pack(f"<{len(value)}d", *value)
    scalar = struct.pack("<BBBB4x", 1, 0, 0, 0)
    if isinstance(value, float):
        return struct.pack("<BBBBI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023), scalar, struct.pack("<d", value)
    if isinstance(value, int):
        return struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 4, 0, 32), scalar, struct.pack("<I", value)
    if value.startswith("fixed:"):
        text = value[6:].encode() + b"\0"
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, len(text)), scalar, text
    return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1), scalar, None


class Writer:
    def __init__(self, new=False):
        self.out, self.new = bytearray(96 if not new else 48), new

    def put(self, data):
        at = len(self.out)
        self.out += padded(data)
        return at

    def attribute(self, name, value, version=1):
        kind, space, data = typed(value)
        if data is None:
            text = value.encode()
            body = struct.pack("<HH4xQ", 1, 0, len(text)) + padded(text) + struct.pack("<HH4xQ", 0, 0, 0)
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
            data = struct.pack("<IQI", len(text), heap, 1)
        label = name.encode() + b"\0"
        if version == 1:
            return struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + padded(label) + padded(kind) + padded(space) + data
        return struct.pack("<BBHHHB", 3, 0, len(label), len(kind), len(space), 0) + label + kind + space + data

    def header(self, messages):
        """An object header whose second half is in another block."""
        if self.new:
            body = [struct.pack("<BHB", k, len(m), 0) + m for k, m in messages]
            half = len(body) // 2
            more = b"OCHK" + b"".join(body[half:]) + bytes(4)
            at = self.put(more)
            first = b"".join(body[:half]) + struct.pack("<BHBQQ", 0x10, 16, 0, at, len(more))
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(first)) + first + bytes(4))
        body = [struct.pack("<HHB3x", k, len(padded(m)), 0) + padded(m) for k, m in messages]
        half = len(body) // 2
        more = b"".join(body[half:])
        at = self.put(more)
        first = b"".join(body[:half]) + struct.pack("<HHB3xQQ", 0x10, 16, 0, at, len(more))
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages) + 1, 1, len(first)) + first)

    def group(self, attributes, members):
        messages = [(0x0C, self.attribute(k, v, 3 if self.new else 1)) for k, v in attributes.items()]
        there = {k: self.group(*v) for k, v in members.items()}
        if self.new:
            for k, at in there.items():
                messages.append((0x06, struct.pack("<BBB", 1, 0, len(k)) + k.encode() + struct.pack("<Q", at)))
        elif there:
            names, offsets = bytearray(8), []
            for k in sorted(there):
                offsets.append(len(names))
                names += padded(k.encode() + b"\0")
            segment = self.put(bytes(names))
            heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, segment))
            # Two leaves below one node, as many members as each holds.
            entries = [struct.pack("<QQII16x", o, there[k], 0, 0) for o, k in zip(offsets, sorted(there), strict=True)]
            leaves = [entries[: len(entries) // 2 + 1], entries[len(entries) // 2 + 1 :]]
            nodes = [self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(leaf)) + b"".join(leaf)) for leaf in leaves if leaf]
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NOWHERE, NOWHERE) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + bytes(8))
            messages.append((0x11, struct.pack("<QQ", tree, heap)))
        return self.header(messages)

    def file(self, attributes, members):
        root = self.group(attributes, members)
        magic = b"\x89HDF\r\n\x1a\n"
        if self.new:
            self.out[:48] = magic + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(self.out), root, 0)
        else:
            self.out[:96] = magic + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.out), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        return bytes(self.out)


def sidecar(new=False, nchan=4, samples=480, centre=4.08e8, unit="Hz", width=4.0e6, tsamp=2.5e-7):
    axis = [centre + i * width for i in range(nchan)]
    beam = ({"NOF_SAMPLES": samples, "BEAM_FREQUENCY_CENTER": centre, "BEAM_FREQUENCY_CENTER_UNIT": unit, "CHANNEL_WIDTH": width, "CHANNEL_WIDTH_UNIT": f"fixed:{unit}", "TARGETS": "B0329+54"}, {"COORDINATES": ({}, {"COORDINATE_0": ({"INCREMENT": tsamp}, {}), "COORDINATE_1": ({"AXIS_VALUES_WORLD": axis}, {})}), "STOKES_0": ({}, {})})
    pointing = ({"EXPTIME_START_MJD": 59000.5, "POINT_DEC": 54.5, "POINT_RA": 53.2}, {"BEAM_001": beam, "BEAM_000": ({}, {}), "PROCESS": ({}, {})})
    return Writer(new).file({"GROUPTYPE": "Root"}, {"SUB_ARRAY_POINTING_002": pointing, "SYS_LOG": ({}, {})})
