"""Incremental container parsing and decoding: fragments of files in, packets or frames and samples out, whatever the split into fragments and micro-batches.

State is kept for each file (or each epoch range): its generation, the unread tail and the parse position; apart from
these a map of the parts that came early, and a map of the frames that each stream retains, of which a batch reads and writes only
those of the streams that it has packets of. Files that get nothing for a while can be dropped by a timer. A newer generation discards the older one's bytes and later fragments of it are
ignored. A fragment with ``last`` ends the file: an unread tail is then an error. The unread tail and the parts that wait
are bounded together; beyond the bound the file is rejected, and a rejected file keeps nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import audio, video, wire
from tessera.operators.errors import Rejected

FRAGMENTS = "file_id string, generation long, part long, data binary, last boolean"
#: Fragments of one epoch's byte range each; parts are counted within the range.
RANGES = FRAGMENTS + ", epoch_id long"
_PLACE = "file_id string, generation long, seq long, epoch_id long, kind string, stream_id long, pts string, duration long"
OUT = _PLACE + ", payload_len long, error_code string, payload binary"
DECODED = _PLACE + ", frame_id string, width long, height long, y binary, u binary, v binary, rate long, channels long, samples array<int>, error_code string"


class Parser:
    """Pushed fragments become packets as soon as they are complete; plain Python, so it pickles into state.

    ``epoch`` is the expected id of a single epoch's range, which has no prefix: its packets are not routed.
    ``waiting`` holds parts that came early; the caller may keep it elsewhere, and their numbers in ``early``.
    """

    early: set[int] | None = None

    def __init__(self, generation: int, max_buffer: int = wire.MAX_BUFFER, epoch: int | None = None, magic: bytes = wire.FILE_MAGIC):
        self.generation, self.max_buffer, self.magic = generation, max_buffer, magic
        self.tail, self.started, self.seq, self.next_part = b"", epoch is not None, 0, 0
        self.waiting: MutableMapping[int, tuple[bytes, bool]] = {}
        self.held = 0  # bytes that wait
        self.streams: dict[int, wire.Stream] | None = None
        self.tracker, self.failed, self.ended = wire.EpochTracker(epoch), False, False

    def push(self, part: int, data: bytes, last: bool) -> Iterator[tuple]:
        """Rows (seq, epoch, packet, error_code); a part that comes early waits for those before it, a repeated one is ignored."""
        if self.failed or part < self.next_part or part in self.waiting:
            return
        if part > self.next_part:
            if len(self.tail) + self.held + len(data) > self.max_buffer:
                yield self._fail("ResourceLimit")
                return
            self.waiting[part] = (data, last)
            self.held += len(data)
            return
        while not self.failed:
            self.next_part += 1
            yield from self._take(data, last)
            if self.failed or self.next_part not in self.waiting:
                return
            data, last = self.waiting[self.next_part]
            del self.waiting[self.next_part]
            self.held -= len(data)

    def _fail(self, code: str) -> tuple:
        self.failed, self.tail, self.held = True, b"", 0
        for part in list(self.waiting):
            del self.waiting[part]
        return self.seq, self.tracker.current, None, code

    def _take(self, data: bytes, last: bool) -> Iterator[tuple]:
        try:
            if len(self.tail) + self.held + len(data) > self.max_buffer:
                raise Rejected("ResourceLimit")
            buf, at = self.tail + data, 0
            if not self.started:
                at = self._prefix(buf)
            while self.started:
                try:
                    p = wire.decode_packet(buf, at)
                except Rejected as e:
                    if e.code == "UnexpectedEof":
                        break
                    raise
                epoch = self.tracker.observe(p)
                if self.streams is not None:
                    wire.route(p, self.streams)
                yield self.seq, epoch, p, None
                at, self.seq = at + p.size, self.seq + 1
            self.tail = buf[at:]
            if last:
                self.ended = True
                if self.tail or not self.started:
                    raise Rejected("TrailingData")
        except Rejected as e:
            yield self._fail(e.code)

    def _prefix(self, buf: bytes) -> int:
        try:
            p = wire.parse_prefix(buf, self.magic)
        except Rejected as e:
            if e.code == "UnexpectedEof":
                return 0
            raise
        self.started, self.streams = True, {s.id: s for s in p.streams}
        return p.length


#: What a stream retains: a row for each frame, in the order of ``n``.
FRAME_KEY, FRAME_VALUE = "stream_id int, frame_id string", "n long, width int, height int, y binary, u binary, v binary"


class Session:
    """Decodes the packets of a parser in order; an epoch's start clears the references of every video stream.

    ``state`` is a map state of the frames that streams retain. A stream's are read when its first packet of a batch comes, and ``save``
    writes what has changed: of a stream without packets nothing is read or written.
    """

    def __init__(self, state):
        self.state, self.decoders, self.stored = state, {}, {}
        self.cleared = False

    def _decoder(self, stream: int) -> video.Decoder:
        if stream not in self.decoders:
            decoder, rows = video.Decoder(), []
            if not self.cleared:
                rows = sorted((self.state.getValue(k), k[1]) for k in map(tuple, self.state.keys()) if k[0] == stream)
            for (_, width, height, *planes), frame_id in rows:
                decoder.kept.frames[int(frame_id)] = video.Frame.of(width, height, *map(bytes, planes))
            self.decoders[stream] = decoder
            self.stored[stream] = {int(frame_id): v[0] for v, frame_id in rows}
        return self.decoders[stream]

    def _clear(self) -> None:
        self.decoders, self.stored, self.cleared = {}, {}, True

    def save(self) -> None:
        if self.cleared:
            self.state.clear()
            self.cleared = False
        for stream, decoder in self.decoders.items():
            kept, stored = decoder.kept.frames, self.stored[stream]
            for gone in [i for i in stored if i not in kept]:
                self.state.removeKey((stream, str(gone)))
                del stored[gone]
            for i, frame in kept.items():
                if i not in stored:
                    stored[i] = max(stored.values(), default=-1) + 1
                    self.state.updateValue((stream, str(i)), (stored[i], *frame.size, *(x.tobytes() for x in frame.planes)))

    def row(self, p: wire.Packet, streams: dict[int, wire.Stream]) -> tuple:
        """(frame_id, width, height, y, u, v, rate, channels, samples, error_code) of a packet."""
        if p.kind == 1:
            self._clear()
        none = (None,) * 9
        s = streams.get(p.stream_id)
        try:
            if p.kind in (2, 3) and (s is None or s.codec != 1):
                raise Rejected("BadStream")
            if p.kind == 2:
                head, frame = self._decoder(s.id).decode(p.payload)
                if (head.width, head.height) != (s.param0, s.param1):
                    raise Rejected("BadStream")
                return str(head.frame_id), head.width, head.height, *(x.tobytes() for x in frame.planes), None, None, None, None
            if p.kind == 3:
                rate, channels, pcm = audio.decode(p.payload)
                if (rate, channels) != (s.param0, s.param1):
                    raise Rejected("BadStream")
                return *none[:6], rate, channels, pcm.tolist(), None
        except Rejected as e:
            return *none, e.code
        return *none, None


class Parts(MutableMapping):
    """What waits by number, in a state map of its own: a batch reads and writes only what comes or goes.

    ``numbers`` are those that wait, which the caller keeps with its own state: every question to the map is a message to the JVM. None: the map is asked for them.
    """

    def __init__(self, state, numbers: set[int] | None):
        self.state, self.numbers = state, {k[0] for k in state.keys()} if numbers is None else numbers

    def __getitem__(self, part):
        if part not in self.numbers:
            raise KeyError(part)
        return tuple(self.state.getValue((part,)))

    def __setitem__(self, part, value):
        self.state.updateValue((part,), value)
        self.numbers.add(part)

    def __delitem__(self, part):
        self.state.removeKey((part,))
        self.numbers.remove(part)

    def __iter__(self):
        return iter(list(self.numbers))

    def __len__(self):
        return len(self.numbers)

    def __contains__(self, part):
        return part in self.numbers

    def clear(self):
        if self.numbers:
            self.state.clear()
            self.numbers.clear()


class PacketProcessor(StatefulProcessor):
    """Packets of a file's fragments, or of an epoch range's where the key holds an epoch."""

    columns = OUT

    def __init__(self, magic: bytes = wire.FILE_MAGIC, max_buffer: int = wire.MAX_BUFFER, idle_ms: int | None = None):
        self.magic, self.max_buffer, self.idle_ms = magic, max_buffer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("parser", "data binary")
        self.parts = handle.getMapState("waiting", "part long", "data binary, last boolean")

    def begin(self) -> None:
        """A batch of a file begins."""

    def reset(self) -> None:
        """A newer generation begins."""

    def end(self) -> None:
        """A batch of a file ends."""

    def tell(self, parser: Parser, p: wire.Packet | None, code: str | None) -> tuple:
        return p and len(p.payload), code, p and p.payload

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for the file within the time set: all that is kept of it goes, and a row says so unless it had ended."""
        parser = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        out = []
        if parser is not None and not parser.ended and not parser.failed:
            out.append((key[0], parser.generation, parser.seq, parser.tracker.current, *(None,) * 4, *self.tell(parser, None, "Abandoned")))
        self.parts.clear()
        self.begin()
        self.reset()
        self.end()
        self.state.clear()
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        names, kinds = zip(*(c.split(" ") for c in self.columns.split(", ")), strict=True)
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c, k in zip(names, kinds, strict=True) if k == "long"})

    def _watch(self, timerValues) -> None:
        """One timer for the file, from now on."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        parser = None if found is None else pickle.loads(found[0])
        waiting = Parts(self.parts, set() if parser is None else parser.early)
        self.begin()
        if parser is not None:
            parser.waiting = waiting
        epoch = int(key[1]) if len(key) > 1 else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["generation", "part"]).itertuples():
            if parser is None or r.generation > parser.generation:
                waiting.clear()
                parser = Parser(int(r.generation), self.max_buffer, epoch, self.magic)
                parser.waiting = waiting
                self.reset()
            if r.generation < parser.generation:
                continue
            for seq, current, p, code in parser.push(int(r.part), bytes(r.data) if r.data is not None else b"", bool(r.last)):
                out.append((key[0], parser.generation, seq, current, p and wire.PACKET_KINDS[p.kind], p and p.stream_id, p and str(p.pts), p and p.duration, *self.tell(parser, p, code)))
        parser.waiting, parser.early = {}, waiting.numbers
        self.end()
        self.state.update((pickle.dumps(parser),))
        if self.idle_ms is not None:
            self._watch(timerValues)
        yield self._frame(out)

    def close(self) -> None:
        pass


class MediaProcessor(PacketProcessor):
    """Frames and samples as soon as their packets are complete; what each stream retains is state of its own."""

    columns = DECODED

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.frames = handle.getMapState("frames", FRAME_KEY, FRAME_VALUE)

    def begin(self) -> None:
        self.session = Session(self.frames)

    def reset(self) -> None:
        self.session._clear()

    def end(self) -> None:
        self.session.save()

    def tell(self, parser, p, code):
        return (*(None,) * 9, code) if p is None else self.session.row(p, parser.streams or {})


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(fragments: DataFrame, keys: tuple[str, ...], processor: PacketProcessor) -> DataFrame:
    found = fragments.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if found != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    return fragments.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.columns, outputMode="Append", timeMode="None" if processor.idle_ms is None else "ProcessingTime")


def parse_stream(fragments: DataFrame, magic: bytes = wire.FILE_MAGIC, idle_ms: int | None = None) -> DataFrame:
    """A streaming frame of FRAGMENTS as packets with their payloads; needs the RocksDB state store provider in the session.

    A file that gets no fragment for ``idle_ms`` is dropped from the state, with a row of error_code Abandoned if it had not ended.
    """
    return _keyed(fragments, ("file_id",), PacketProcessor(magic, idle_ms=idle_ms))


def parse_ranges(fragments: DataFrame) -> DataFrame:
    """A streaming frame of RANGES as packets: each (file, epoch) is parsed from its range's first byte and must start that epoch."""
    return _keyed(fragments, ("file_id", "epoch_id"), PacketProcessor())


def decode_stream(fragments: DataFrame, magic: bytes = wire.FILE_MAGIC, idle_ms: int | None = None) -> DataFrame:
    """A streaming frame of FRAGMENTS as DECODED rows: frames and samples, decoded within the stream. ``idle_ms`` as for ``parse_stream``."""
    return _keyed(fragments, ("file_id",), MediaProcessor(magic, idle_ms=idle_ms))
