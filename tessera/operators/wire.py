"""The container's byte layout: header, front index, packets; building, scanning and repairing whole files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.functions.checksum import crc32c

from .errors import Rejected

#: The eight bytes that a file begins with by default; readers and writers take others as an option.
FILE_MAGIC = b"TESSERA\0"
#: Fixed values of the format.
FRONT_MAGIC, PACKET_MAGIC = b"AVFR", b"AVPK"
PACKET_KINDS = {1: "epoch_start", 2: "video_frame", 3: "audio_frame", 4: "metadata"}
STREAM_KINDS = {1: "video", 2: "audio"}
HEADER_LEN, PACKET_HEAD, PACKET_TAIL = 32, 28, 4
MAX_PACKET, MAX_ENTROPY, MAX_BUFFER, MAX_PIXELS = 128 << 20, 8 << 20, 160 << 20, 8192 * 8192
TIMESCALE = 1_000_000
MATRIX = ("unspecified", "bt601", "bt709", "bt2020")
TRANSFER = ("unspecified", "bt709", "srgb", "pq", "hlg")
PRIMARIES = ("unspecified", "bt601", "bt709", "bt2020")
CHROMA = ("unspecified", "left", "center")

_HEADER = struct.Struct("<8sHHIIHHI")
_STREAM = struct.Struct("<HBBIIIII")
_EPOCH = struct.Struct("<IIQQQ")
_PACKET = struct.Struct("<4sBBHQII")


@dataclass(frozen=True)
class Stream:
    id: int
    kind: int
    codec: int
    timescale: int
    param0: int
    param1: int
    flags: int = 0
    meta0: int = 0


@dataclass(frozen=True)
class Epoch:
    id: int
    pts: int
    offset: int
    length: int
    duration: int


@dataclass(frozen=True)
class Packet:
    kind: int
    stream_id: int
    pts: int
    duration: int
    payload: bytes

    @property
    def size(self) -> int:
        return PACKET_HEAD + len(self.payload) + PACKET_TAIL


@dataclass
class Prefix:
    flags: int
    streams: list[Stream] = field(default_factory=list)
    epochs: list[Epoch] = field(default_factory=list)
    length: int = HEADER_LEN


def _sealed(body: bytes) -> bytes:
    return body + struct.pack("<I", crc32c(body))


def _seal_of(b: bytes, end: int) -> int:
    return struct.unpack_from("<I", b, end)[0]


def pack_meta(matrix: int, transfer: int, primaries: int, full_range: bool, chroma: int) -> int:
    return matrix | transfer << 4 | primaries << 8 | bool(full_range) << 12 | chroma << 13


def unpack_meta(v: int) -> tuple[int, int, int, bool, int]:
    """(matrix, transfer, primaries, full range, chroma location); unknown values and high bits are rejected."""
    parts = v & 15, v >> 4 & 15, v >> 8 & 15, bool(v >> 12 & 1), v >> 13 & 7
    known = parts[0] < len(MATRIX) and parts[1] < len(TRANSFER) and parts[2] < len(PRIMARIES) and parts[4] < len(CHROMA)
    if v >> 16 or not known:
        raise Rejected("BadFront")
    return parts


def file_magic(name: str | None) -> bytes:
    """A brand of up to eight characters as the bytes that a file begins with; the default for None."""
    if name is None:
        return FILE_MAGIC
    raw = name.encode("latin-1")
    if not 0 < len(raw) <= 8:
        raise ValueError("a magic has one to eight characters")
    return raw.ljust(8, b"\0")


def encode_header(flags: int, streams: int, front_len: int, magic: bytes = FILE_MAGIC) -> bytes:
    return _sealed(_HEADER.pack(magic, 1, 0, flags, HEADER_LEN, streams, 0, front_len))


def decode_header(b: bytes, magic: bytes = FILE_MAGIC) -> tuple[int, int, int]:
    """(flags, streams, front length)."""
    if len(b) < HEADER_LEN:
        raise Rejected("UnexpectedEof")
    found, major, minor, flags, size, streams, reserved, front = _HEADER.unpack_from(b)
    if found != magic:
        raise Rejected("BadMagic")
    if major != 1:
        raise Rejected("UnsupportedVersion", major)
    if minor or flags & ~1 or size != HEADER_LEN or reserved:
        raise Rejected("BadHeader")
    if crc32c(b[:28]) != _seal_of(b, 28):
        raise Rejected("HeaderChecksum")
    return flags, streams, front


def encode_front(streams: list[Stream], epochs: list[Epoch]) -> bytes:
    body = bytearray(struct.pack("<4sHHI", FRONT_MAGIC, 1, len(streams), len(epochs)))
    for s in streams:
        body += _STREAM.pack(s.id, s.kind, s.codec, s.timescale, s.param0, s.param1, s.flags, s.meta0)
    for e in epochs:
        body += _EPOCH.pack(e.id, e.duration, e.pts, e.offset, e.length)
    return _sealed(bytes(body))


def decode_front(b: bytes, expected_streams: int) -> tuple[list[Stream], list[Epoch]]:
    if len(b) < 16:
        raise Rejected("UnexpectedEof")
    magic, version, n_streams, n_epochs = struct.unpack_from("<4sHHI", b)
    if magic != FRONT_MAGIC or version != 1 or n_streams != expected_streams:
        raise Rejected("BadFront")
    body = 12 + _STREAM.size * n_streams + _EPOCH.size * n_epochs
    if len(b) != body + 4:
        raise Rejected("UnexpectedEof" if len(b) < body + 4 else "TrailingData")
    if crc32c(b[:body]) != _seal_of(b, body):
        raise Rejected("FrontChecksum")
    at = 12 + _STREAM.size * n_streams
    streams: list[Stream] = []
    taken: set[int] = set()
    for row in _STREAM.iter_unpack(b[12:at]):
        s = Stream(*row)
        if s.id in taken or s.kind not in STREAM_KINDS:
            raise Rejected("BadFront")
        if s.codec == 1 and s.kind == 1:
            unpack_meta(s.meta0)
        if s.codec == 1 and s.kind == 2 and (s.flags or s.meta0):
            raise Rejected("BadFront")
        taken.add(s.id)
        streams.append(s)
    epochs, taken = [], set()
    for i, duration, pts, offset, length in _EPOCH.iter_unpack(b[at:body]):
        if i in taken or offset + length >= 1 << 64:
            raise Rejected("BadFront")
        taken.add(i)
        epochs.append(Epoch(i, pts, offset, length, duration))
    return streams, epochs


def parse_prefix(b: bytes, magic: bytes = FILE_MAGIC) -> Prefix:
    """Header and front index at the start of a file."""
    flags, n, front = decode_header(b, magic)
    if len(b) < HEADER_LEN + front:
        raise Rejected("UnexpectedEof")
    streams, epochs = decode_front(b[HEADER_LEN : HEADER_LEN + front], n)
    return Prefix(flags, streams, epochs, HEADER_LEN + front)


def encode_packet(p: Packet) -> bytes:
    if len(p.payload) > MAX_PACKET:
        raise Rejected("PacketTooLarge", len(p.payload))
    head = _PACKET.pack(PACKET_MAGIC, p.kind, 0, p.stream_id, p.pts, p.duration, len(p.payload))
    return _sealed(head) + p.payload + struct.pack("<I", crc32c(p.payload))


def decode_packet(b: bytes, at: int = 0, max_packet: int = MAX_PACKET) -> Packet:
    """The packet that begins at ``at``; checks come in the format's order, the kind last."""
    if len(b) - at < PACKET_HEAD:
        raise Rejected("UnexpectedEof")
    magic, kind, flags, stream, pts, duration, size = _PACKET.unpack_from(b, at)
    if magic != PACKET_MAGIC:
        raise Rejected("BadMagic")
    if crc32c(b[at : at + 24]) != _seal_of(b, at + 24):
        raise Rejected("PacketHeaderChecksum")
    if flags:
        raise Rejected("BadHeader")
    if size > max_packet:
        raise Rejected("PacketTooLarge", size)
    if len(b) - at < PACKET_HEAD + size + PACKET_TAIL:
        raise Rejected("UnexpectedEof")
    payload = bytes(b[at + PACKET_HEAD : at + PACKET_HEAD + size])
    if crc32c(payload) != _seal_of(b, at + PACKET_HEAD + size):
        raise Rejected("PayloadChecksum")
    if kind not in PACKET_KINDS:
        raise Rejected("UnknownPacketKind", kind)
    return Packet(kind, stream, pts, duration, payload)


def scan(b: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, Packet]]:
    """(offset, packet) of every packet of a range."""
    end = len(b) if end is None else end
    view = b if end == len(b) else b[:end]
    while at < end:
        p = decode_packet(view, at)
        yield at, p
        at += p.size


def route(p: Packet, streams: dict[int, Stream]) -> Stream | None:
    """The stream of a media packet; epoch starts and metadata need none."""
    if p.kind not in (2, 3):
        return None
    s = streams.get(p.stream_id)
    if s is None or s.kind != p.kind - 1:
        raise Rejected("BadStream")
    return s


class EpochTracker:
    """The epoch that is open while packets are read in order."""

    def __init__(self, expected: int | None = None):
        self.expected, self.current = expected, None

    def observe(self, p: Packet) -> int | None:
        """Start an epoch or return the open one; media before the first is rejected."""
        if p.kind == 1:
            if len(p.payload) != 4:
                raise Rejected("BadEpoch")
            (epoch,) = struct.unpack("<I", p.payload)
            if self.expected is not None and epoch != self.expected:
                raise Rejected("BadEpoch")
            self.current = epoch
        elif p.kind in (2, 3) and self.current is None:
            raise Rejected("BadEpoch")
        return self.current


def epoch_start(epoch: int, pts: int, duration: int) -> Packet:
    return Packet(1, 0, pts, duration, struct.pack("<I", epoch))


def check_epoch(epoch: int, data: bytes) -> None:
    """An indexed range is whole packets, begins with its own epoch start and has no other."""
    for i, (_, p) in enumerate(scan(data)):
        if (p.kind == 1) != (i == 0):
            raise Rejected("BadEpoch")
        if i == 0 and p.payload != struct.pack("<I", epoch):
            raise Rejected("BadEpoch")
    if not data:
        raise Rejected("BadEpoch")


def index_of(streams: list[Stream], epochs: list[tuple[int, int, int, int]], magic: bytes = FILE_MAGIC) -> bytes:
    """Header and front of a file of (id, pts, duration, length) epochs; offsets are the running sum of their lengths."""
    front_len = 12 + _STREAM.size * len(streams) + _EPOCH.size * len(epochs) + 4
    at, index = HEADER_LEN + front_len, []
    for i, pts, duration, length in epochs:
        index.append(Epoch(i, pts, at, length, duration))
        at += length
    front = encode_front(streams, index)
    decode_front(front, len(streams))
    return encode_header(1, len(streams), front_len, magic) + front


def build_file(streams: list[Stream], epochs: list[tuple[int, int, int, bytes]], checked: bool = True, magic: bytes = FILE_MAGIC) -> bytes:
    """A whole file of (id, pts, duration, packets) epochs."""
    if checked:
        for i, _, _, data in epochs:
            check_epoch(i, data)
    return index_of(streams, [(i, pts, duration, len(data)) for i, pts, duration, data in epochs], magic) + b"".join(e[3] for e in epochs)


def regroup(b: bytes, repair: bool, magic: bytes = FILE_MAGIC) -> tuple[bytes, int, int]:
    """(file, epochs, packets dropped): packets grouped under the epoch start before them, with a new index.

    Strict: any packet error, or media before the first epoch, rejects. Repair: after an error the scan goes on at the
    next packet magic, and packets before the first epoch are dropped. The prefix must be valid either way.
    """
    prefix = parse_prefix(b, magic)
    streams = {s.id: s for s in prefix.streams}
    at, dropped, groups = prefix.length, 0, []
    while at < len(b):
        try:
            p = decode_packet(b, at)
            route(p, streams)
        except Rejected:
            if not repair:
                raise
            dropped += 1
            at = b.find(PACKET_MAGIC, at + 1)
            if at < 0:
                break
            continue
        if p.kind == 1:
            if len(p.payload) != 4:
                if not repair:
                    raise Rejected("BadEpoch")
                dropped += 1
            else:
                groups.append([struct.unpack("<I", p.payload)[0], p.pts, p.duration, bytearray()])
                groups[-1][3] += b[at : at + p.size]
        elif groups:
            groups[-1][3] += b[at : at + p.size]
        elif repair:
            dropped += 1
        else:
            raise Rejected("BadEpoch")
        at += p.size
    if not groups:
        raise Rejected("BadEpoch")
    known = {e.id: e for e in prefix.epochs}
    rows = [(i, pts, known[i].duration if not duration and i in known else duration, bytes(data)) for i, pts, duration, data in groups]
    return build_file(prefix.streams, rows, magic=magic), len(rows), dropped
