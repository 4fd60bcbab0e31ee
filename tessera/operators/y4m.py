"""Y4M clips of 8-bit 4:2:0 frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import Rejected
from .video import Frame
from .wire import pack_meta, unpack_meta

#: Chroma tags that are accepted, and the chroma location they stand for.
CHROMA_TAGS = {"420": 0, "420mpeg2": 1, "420jpeg": 2}


@dataclass
class Clip:
    width: int
    height: int
    fps_n: int = 30
    fps_d: int = 1
    meta0: int = 0
    frames: list[Frame] = field(default_factory=list)


def parse(b: bytes) -> Clip:
    end = b.find(b"\n")
    words = b[:end].decode("ascii", "replace").split(" ") if end >= 0 else []
    if not words or words[0] != "YUV4MPEG2":
        raise Rejected("BadHeader")
    width = height = 0
    rate, chroma, full = (30, 1), 0, False
    try:
        for w in words[1:]:
            tag, value = w[:1], w[1:]
            if tag == "W":
                width = int(value)
            elif tag == "H":
                height = int(value)
            elif tag == "F":
                n, d = value.split(":")
                rate = int(n), int(d)
            elif tag == "C":
                chroma = CHROMA_TAGS[value]
            elif w.startswith("XCOLORRANGE="):
                full = w.endswith("=FULL")
    except (ValueError, KeyError):
        raise Rejected("BadHeader") from None
    if not all(0 < x < 65536 for x in rate) or width <= 0 or height <= 0 or width % 2 or height % 2:
        raise Rejected("BadHeader")
    clip = Clip(width, height, *rate, pack_meta(0, 0, 0, full, chroma))
    at, luma = end + 1, width * height
    while at < len(b):
        line = b.find(b"\n", at)
        if line < 0 or b[at : at + 5] != b"FRAME":
            raise Rejected("BadHeader")
        at = line + 1
        if len(b) - at < luma * 3 // 2:
            raise Rejected("UnexpectedEof")
        clip.frames.append(Frame.of(width, height, b[at : at + luma], b[at + luma : at + luma * 5 // 4], b[at + luma * 5 // 4 : at + luma * 3 // 2]))
        at += luma * 3 // 2
    return clip


def emit(clip: Clip) -> bytes:
    """An unspecified chroma location is written as 420jpeg, so it comes back as centred."""
    _, _, _, full, chroma = unpack_meta(clip.meta0)
    tag = "420mpeg2" if chroma == 1 else "420jpeg"
    head = f"YUV4MPEG2 W{clip.width} H{clip.height} F{clip.fps_n}:{clip.fps_d} Ip A1:1 C{tag}" + " XCOLORRANGE=FULL" * full + "\n"
    return head.encode() + b"".join(b"FRAME\n" + b"".join(p.tobytes() for p in f.planes) for f in clip.frames)
