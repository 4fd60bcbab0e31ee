"""Incremental encoding: frames of clips in, in any order and split into micro-batches, video packets out as soon as their turn comes.

State is kept for each clip: the encoder with the frames that it retains, the epoch and the frame before (for scene cuts), and, in a
map of their own, frames that came early. ``encode_epochs`` gives whole epochs instead, as the container sink takes them: the
packets of an epoch wait in state until the next begins or the clip's last frame has come. The packets are those that ``media.encode_video`` gives for the whole clip, so a
batch of them can be muxed at any time into the epochs that are complete.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import media, video, wire
from tessera.operators.errors import Rejected

from .packets import PROVIDER, Parts

FRAMES_IN = "clip_id string, frame_index long, width int, height int, y binary, u binary, v binary"
PACKETS_OUT = "file_id string, epoch_id long, stream_id int, kind string, seq long, pts string, duration long, payload binary, error_code string"


class EncodeSession:
    """One clip's encoder. Epochs begin every ``every`` frames and, with ``cuts``, at scene cuts; each starts without references.

    ``early`` are the numbers of the frames that wait, ``open`` the epochs of the packets that do.
    """

    early: set[int] | None = None
    open: dict[int, int] | None = None

    def __init__(self, q: int, preset: str, every: int, cuts: bool):
        self.options, self.every, self.cuts = (q, preset), every, cuts
        self.encoder, self.before, self.epoch, self.next = video.Encoder(q, preset), None, -1, 0
        self.early, self.open = set(), {}

    def push(self, frame: video.Frame) -> tuple[int, int, bytes]:
        """(epoch, index, payload) of the next frame."""
        i = self.next
        if i % self.every == 0 or self.cuts and video.scene_cut(self.before, frame):
            self.epoch, self.encoder = self.epoch + 1, video.Encoder(*self.options)
        self.next, self.before = i + 1, frame
        return self.epoch, i, self.encoder.encode(i, frame)[0]


class EncodeProcessor(StatefulProcessor):
    def __init__(self, stream_id: int, frame_us: int, q: int, preset: str, every: int, cuts: bool, max_buffer: int):
        self.stream_id, self.frame_us, self.options, self.max_buffer = stream_id, frame_us, (q, preset, every, cuts), max_buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "data binary")
        self.parts = handle.getMapState("early", "frame_index long", "width int, height int, y binary, u binary, v binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        session, held, failed = (EncodeSession(*self.options), 0, False) if found is None else pickle.loads(found[0])
        waiting, out = Parts(self.parts, session.early), []

        def tell(epoch, i, payload, code):
            out.append((key[0], epoch, self.stream_id, "video_frame", i, str(i * self.frame_us), self.frame_us, payload, code))

        for r in pd.concat(list(rows)).sort_values("frame_index").itertuples():
            i = int(r.frame_index)
            self.note(r)
            if failed or i < session.next or i in waiting:
                continue
            one = (int(r.width), int(r.height), bytes(r.y), bytes(r.u), bytes(r.v))
            size = sum(map(len, one[2:]))
            try:
                if i > session.next:
                    if held + size > self.max_buffer:
                        raise Rejected("ResourceLimit")
                    waiting[i] = one
                    held += size
                    continue
                while True:
                    tell(*session.push(video.Frame.of(*one)), None)
                    if session.next not in waiting:
                        break
                    i, one = session.next, waiting[session.next]
                    del waiting[i]
                    held -= sum(map(len, one[2:]))
            except Rejected as e:
                tell(session.epoch, i, None, e.code)
                failed, held = True, 0
                waiting.clear()
        session.early = waiting.numbers
        rows = self.result(key[0], session, out)
        self.state.update((pickle.dumps((session, held, failed)),))
        yield rows

    def note(self, row) -> None:
        """A frame has come."""

    def result(self, clip: str, session: EncodeSession, out: list[tuple]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in PACKETS_OUT.split(", ")]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("epoch_id", "seq", "duration")})

    def close(self) -> None:
        pass


class EpochProcessor(EncodeProcessor):
    """Whole epochs of a clip; its frames carry ``last``, true on the one with the largest index."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "seq long", "epoch long, payload binary")
        self.end = handle.getValueState("end", "frame_index long")

    def note(self, row) -> None:
        if bool(row.last):
            self.end.update((int(row.frame_index),))

    def result(self, clip: str, session: EncodeSession, out: list[tuple]) -> pd.DataFrame:
        end = self.end.get()
        ended = end is not None and session.next > end[0]
        if session.open is None:
            session.open = {k[0]: v[0] for k, v in self.open.iterator()}
        epochs: dict[int, list[dict]] = {}
        bad = [(clip, r[1], None, None, None, None, r[8]) for r in out if r[8]]
        told = {r[4]: (r[1], r[7]) for r in out if not r[8]}
        closed = {e for e, _ in told.values()} | set(session.open.values())
        closed = {e for e in closed if e < session.epoch or ended}
        for i in sorted(i for i, e in session.open.items() if e in closed):
            epoch, payload = self.open.getValue((i,))
            epochs.setdefault(epoch, []).append(self._packet(i, bytes(payload)))
            self.open.removeKey((i,))
            del session.open[i]
        for i, (epoch, payload) in sorted(told.items()):
            if epoch in closed:
                epochs.setdefault(epoch, []).append(self._packet(i, payload))
            else:
                self.open.updateValue((i,), (epoch, payload))
                session.open[i] = epoch
        rows = []
        for epoch, packets in sorted(epochs.items()):
            first, length, data = media.epoch_bytes(epoch, packets)
            streams = media.described([wire.Stream(self.stream_id, 1, 1, wire.TIMESCALE, 0, 0)], packets)
            rows.append((clip, epoch, Decimal(first), length, data, media.streams_to_json(streams), None))
        return pd.DataFrame(rows + bad, columns=[c.split(" ")[0] for c in media.EPOCH_ROWS.split(", ")]).astype({c: "Int64" for c in ("epoch_id", "duration")})

    def _packet(self, i: int, payload: bytes) -> dict:
        return {"kind": "video_frame", "stream_id": self.stream_id, "seq": i, "pts": i * self.frame_us, "duration": self.frame_us, "payload": payload}


def encode_stream(frames: DataFrame, stream_id: int, frame_us: int, q: int = 96, preset: str = "balanced", every: int = 48, cuts: bool = False, max_buffer: int = wire.MAX_BUFFER) -> DataFrame:
    """A streaming frame of FRAMES_IN as video packets; needs the RocksDB state store provider in the session.

    Frames that come early wait, at most ``max_buffer`` bytes of a clip; beyond that, or at a frame that cannot be encoded, the
    clip ends with an error_code. A repeated frame is ignored.
    """
    processor = EncodeProcessor(stream_id, frame_us, q, preset, every, cuts, max_buffer)
    return _keyed(frames, processor, PACKETS_OUT)


def encode_epochs(frames: DataFrame, stream_id: int, frame_us: int, q: int = 96, preset: str = "balanced", every: int = 48, cuts: bool = False, max_buffer: int = wire.MAX_BUFFER) -> DataFrame:
    """A streaming frame of FRAMES_IN and ``last`` (true on a clip's last frame) as EPOCH_ROWS, each as soon as its epoch is complete; for ``container.sink``."""
    return _keyed(frames, EpochProcessor(stream_id, frame_us, q, preset, every, cuts, max_buffer), media.EPOCH_ROWS)


def _keyed(frames: DataFrame, processor: EncodeProcessor, schema: str) -> DataFrame:
    if frames.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    return frames.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
