"""Media columns: Matroska files as binary values, parsed to packet tables.

``read_file`` walks EBML elements with identifiers and sizes of variable length - unknown sizes included - through segment,
tracks, clusters, block groups and cues, undoes every kind of lacing, and gives one packet for each frame: track, timestamp
in nanoseconds, byte range in the file, key frame, lacing.  ``write_audio`` stores a payload as one track of 8-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: element identifiers.
EBML, EBML_DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that stand directly in a segment: one of them ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: The payload is padded to a multiple of this.
UNIT = 192
#: Samples a second, samples in a frame, frames in a laced block, blocks in a cluster of the files that are written here.
RATE, FRAME, LACED, BLOCKS = 8000, 192, 8, 16


class Malformed(ValueError):
    """A file that isn't well-formed."""


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Malformed(f"no element at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise Malformed(f"identifier at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_number(data: bytes, at: int, end: int) -> tuple[int | None, int, int]:
    """A variable-length number, where it ends, and its length in bytes; None: all its bits are set, a size that isn't known."""
    if at >= end or not data[at]:
        raise Malformed(f"number at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Malformed(f"number at {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n, n


def _unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", data[at:end])[0], 8: lambda: struct.unpack(">d", data[at:end])[0]}.get(end - at, lambda: 0.0)()


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    end: int
    key: bool
    lacing: int
    cluster: int


@dataclass
class File:
    scale: int = 1_000_000
    duration: float | None = None
    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, place of the cluster in the file


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a laced block's frames, and where the first begins; ``at`` is after the block's flags."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed(f"lacing at {at}")
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise Malformed(f"fixed lacing at {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"lacing at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            value, at, n = read_number(data, at, end)
            if value is None:
                raise Malformed(f"lacing at {at}")
            size = value if not i else sizes[-1] + value - ((1 << 7 * n - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Malformed(f"laced frames beyond {end}")
    return [*sizes, last], at


def read_file(data: bytes) -> File:
    """Tracks, packets, clusters and cues of a file; Malformed if elements or lacing don't fit."""
    out = File()
    segment = 0

    def children(at: int, end: int, within: int):
        while at < end:
            element, body = read_id(data, at, end)
            if within == CLUSTER and element in TOP:
                return
            size, body, _ = read_number(data, body, end)
            if size is None and element not in (SEGMENT, CLUSTER):
                raise Malformed(f"unknown size at {at}")
            stop = end if size is None else body + size
            if stop > end:
                raise Malformed(f"element at {at} beyond {end}")
            reach = yield element, at, body, stop, size is None
            at = stop if size is not None else reach

    def walk(at: int, end: int, within: int, visit) -> int:
        """Where the last child ended."""
        gen, sent = children(at, end, within), None
        last = at
        try:
            item = next(gen)
            while True:
                element, start, body, stop, unknown = item
                reach = visit(element, start, body, stop)
                last = stop if not unknown else (reach if reach is not None else stop)
                sent = last
                item = gen.send(sent)
        except StopIteration:
            return last

    def block(body: int, stop: int, time: int, key: bool | None, cluster: int) -> None:
        track, at, _ = read_number(data, body, stop)
        if track is None or at + 3 > stop:
            raise Malformed(f"block at {body}")
        flags = data[at + 2]
        stamp = (time + struct.unpack(">h", data[at : at + 2])[0]) * out.scale
        lacing = flags >> 1 & 3
        sizes, at = frame_sizes(data, at + 3, stop, lacing)
        step = out.tracks.get(track, {}).get("default_duration", 0)
        for i, size in enumerate(sizes):
            out.packets.append(Packet(track, stamp + i * step, at, at + size, bool(flags & 0x80) if key is None else key, lacing, cluster))
            at += size

    def cluster(start: int, body: int, stop: int) -> int:
        state = {"time": 0}
        out.clusters.append(start)

        def group(element, s, b, e):
            if element == BLOCK:
                state["block"] = (b, e)
            elif element == REFERENCE_BLOCK:
                state["key"] = False

        def visit(element, s, b, e):
            if element == CLUSTER_TIMESTAMP:
                state["time"] = _unsigned(data, b, e)
            elif element == SIMPLE_BLOCK:
                block(b, e, state["time"], None, start)
            elif element == BLOCK_GROUP:
                state.pop("block", None)
                state["key"] = True
                walk(b, e, element, group)
                if "block" in state:
                    block(*state["block"], state["time"], state["key"], start)

        return walk(body, stop, CLUSTER, visit)

    def track(element, s, b, e, own):
        name = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration", CHANNELS: "channels", BIT_DEPTH: "bits"}.get(element)
        if name:
            own[name] = _unsigned(data, b, e)
        elif element == CODEC_ID:
            own["codec"] = data[b:e].decode("ascii", "replace")
        elif element == SAMPLING_FREQUENCY:
            own["rate"] = _real(data, b, e)
        elif element == AUDIO:
            walk(b, e, element, lambda *x: track(*x, own))

    def tracks(element, s, b, e):
        if element == TRACK_ENTRY:
            own: dict = {}
            walk(b, e, element, lambda *x: track(*x, own))
            out.tracks[own.get("number", 0)] = own

    def info(element, s, b, e):
        if element == TIMESTAMP_SCALE:
            out.scale = _unsigned(data, b, e)
        elif element == DURATION:
            out.duration = _real(data, b, e)

    def cues(element, s, b, e):
        if element == CUE_POINT:
            own = {"time": 0, "track": 0, "place": 0}

            def point(x, s, b, e):
                if x == CUE_TIME:
                    own["time"] = _unsigned(data, b, e)
                elif x == CUE_TRACK:
                    own["track"] = _unsigned(data, b, e)
                elif x == CUE_CLUSTER_POSITION:
                    own["place"] = _unsigned(data, b, e)
                elif x == CUE_TRACK_POSITIONS:
                    walk(b, e, x, point)

            walk(b, e, element, point)
            out.cues.append((own["time"] * out.scale, own["track"], segment + own["place"]))

    def top(element, s, b, e):
        if element == CLUSTER:
            return cluster(s, b, e)
        if element in (INFO, TRACKS, CUES):
            walk(b, e, element, {INFO: info, TRACKS: tracks, CUES: cues}[element])
        return None

    def root(element, s, b, e):
        nonlocal segment
        if element == EBML:
            walk(b, e, element, lambda x, s, b, e: setattr(out, "doc_type", data[b:e].decode("ascii", "replace")) if x == EBML_DOC_TYPE else None)
        elif element == SEGMENT:
            segment = b
            return walk(b, e, element, top)
        return None

    walk(0, len(data), 0, root)
    return out


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(identifier: int, body: bytes) -> bytes:
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(identifier: int, value: int) -> bytes:
    return element(identifier, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The frames of one block with their lacing head."""
    if lacing == NO_LACING:
        return frames[0]
    head = [bytes([len(frames) - 1])]
    if lacing == XIPH:
        head += [b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]]
    elif lacing == EBML_LACING and len(frames) > 1:
        head.append(_size(len(frames[0])))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d, k = len(b) - len(a), 1
            while abs(d) > (1 << 7 * k - 1) - 1:
                k += 1
            head.append((d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big"))
    return b"".join([*head, *frames])


def write_audio(payload: bytes) -> bytes:
    """A file with ``payload`` as 8-bit PCM: one track, laced blocks of LACED frames in clusters, with cues."""
    step = FRAME * 1000 // RATE
    info = _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, step * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, entry))]
    at, points, block_bytes = sum(map(len, parts)), [], FRAME * LACED
    for c in range(0, len(payload), block_bytes * BLOCKS):
        time = c // FRAME * step
        body = [_uint(CLUSTER_TIMESTAMP, time)]
        for k, b in enumerate(range(c, min(c + block_bytes * BLOCKS, len(payload)), block_bytes)):
            own = payload[b : b + block_bytes]
            frames = [own[i : i + FRAME] for i in range(0, len(own), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else (FIXED, XIPH, EBML_LACING)[k % 3]
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", k * LACED * step, 0x80 | lacing << 1) + laced(frames, lacing)))
        parts.append(element(CLUSTER, b"".join(body)))
        points.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(points)))
    return element(EBML, element(EBML_DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


def stored_payload(media: bytes, track: int = 1) -> tuple[bytes, File]:
    """The bytes of a track's packets in order of time."""
    file = read_file(media)
    packets = sorted((p for p in file.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.start))
    return b"".join([media[p.start : p.end] for p in packets]), file


def feature_of(payload: bytes, file: File) -> str:
    """Packets, clusters, cues, length in ms, and mean, standard deviation and sign changes of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    changes = int(np.count_nonzero(np.diff(x >= 128)))
    total, squares = int(x.sum()), int((x * x).sum())
    variance = (squares * len(x) - total * total) / len(x) ** 2
    return f"packets={len(file.packets)};clusters={len(file.clusters)};cues={len(file.cues)};ms={len(x) * 1000 // RATE};mean={total / len(x):.6f};std={variance**0.5:.6f};changes={changes}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media, n_bytes): each text of ``docs`` as a Matroska file.  A null text is empty."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                both = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_audio(p) for _, p in both], pa.binary()), pa.array([n for n, _ in both], pa.int64())], ["doc_id", "media", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, media binary, n_bytes long")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of each file of ``media`` (doc_id, media).  A null or malformed file has one row with ``error`` set."""
    names = ["track", "timestamp_ns", "start", "end", "key", "lacing", "cluster"]

    def rows(batches):
        for batch in batches:
            out: list[dict] = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out += [{"doc_id": i, "error": None} | {n: getattr(p, n) for n in names} for p in read_file(data.as_py() or b"").packets] if data.is_valid else [{"doc_id": i, "error": "null"}]
                except Malformed as e:
                    out.append({"doc_id": i, "error": str(e)})
            kinds = {"doc_id": pa.int64(), "error": pa.string(), "key": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], kinds.get(n, pa.int64())) for n in ["doc_id", *names, "error"]], ["doc_id", *names, "error"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(rows, "doc_id long, track long, timestamp_ns long, start long, end long, key boolean, lacing long, cluster long, error string")


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from ``media`` (doc_id, media, n_bytes), with hashes and a feature string."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(batches):
        for batch in batches:
            out = []
            for i, data, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                payload, file = stored_payload(data)
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload, file)))
            kinds = [pa.string() if n.endswith("sha256") or n == "feature" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return media.select("doc_id", "media", "n_bytes").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
