"""Capture files to packet rows.

Record borders in a capture are known only by walking it. The first step cuts every file into segments that
are walked in parallel: a task finds a border in its segment by a chain of plausible headers and walks on
from there. That the guess was right is proved by the neighbour: the first segment starts at the file
header, and where one segment's walk ends in front of the border from which the next one started, both have
walked what a single walk would have. A segment that disagrees is walked again from where the one before
ended, by the task that puts the few chunk descriptions of a file together. The second step reads the chunks so found, spread over all tasks, and decodes their frames. Only
chunk descriptions travel between the steps.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wiretide.operators.chain import materialize
from wiretide.schema import FLAGS

CHUNK_BYTES = 32 << 20
#: Chunks that one task walks.
SEGMENT_CHUNKS = 4
#: Headers that must follow each other for a border to be believed, bytes searched at once, and the longest record looked for.
_CHAIN, _SEARCHED, _LONGEST = 8, 1 << 20, 1 << 24
_FRAMES_PER_BATCH = 8_192
_FRAME_BITS = 36

CHUNK_SCHEMA = ("path string, format string, big_endian boolean, ticks long, linktype int, offset long, length long, "
                "first_frame long, cut_short boolean")
FRAME_SCHEMA = ("path string, frame long, parsed boolean, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, "
                "protocol string, packet_length int, payload_length int, " + ", ".join(f"{f} boolean" for f in FLAGS)
                + ", raw_payload binary")

# Pcap magic numbers with their ticks per second
_MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
_SECTION, _INTERFACE, _OLD_PACKET, _PACKET = 0x0A0D0D0A, 1, 2, 6
# Link types
_RAW_IP = (12, 14, 101, 228, 229)


def _open(path: str):
    """Random access to a file of any file system the cluster can name."""
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


# ---- step 1: chunks -----------------------------------------------------------------------------

class _Walk:
    """Buffered forward reader for headers."""

    def __init__(self, handle):
        self.handle, self.size, self.at, self.base, self.data = handle, handle.size(), 0, 0, b""

    def peek(self, count: int) -> bytes:
        if not self.base <= self.at <= self.at + count <= self.base + len(self.data):
            self.base = self.at
            self.handle.seek(self.at)
            self.data = self.handle.read(min(8 << 20, max(0, self.size - self.at)))
        start = self.at - self.base
        return self.data[start:start + count]


def _resolution(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at:at + 4])
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
        if code == 0:
            break
        at += 4 + size + (-size) % 4
    return 1_000_000


@dataclass
class _Head:
    """What a file says of itself. ``start`` is the first record border, ``seconds`` the time of the first record."""

    kind: str = "unknown"
    order: str = "<"
    ticks: int = 0
    linktype: int = -1
    start: int = 0
    seconds: int = 0


def _head(walk: _Walk) -> _Head:
    magic = walk.peek(4)
    if len(magic) < 4:
        return _Head()
    for order in ("<", ">"):
        ticks = _MAGIC.get(struct.unpack(order + "I", magic)[0])
        if ticks and walk.size >= 24:
            first = walk.peek(28)
            seconds = struct.unpack(order + "I", first[24:28])[0] if len(first) == 28 else 0
            return _Head("pcap", order, ticks, struct.unpack(order + "I", first[20:24])[0] & 0xFFFF, 24, seconds)
    if struct.unpack("<I", magic)[0] != _SECTION:
        return _Head()
    head = _Head("pcapng", "<" if walk.peek(12)[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 1_000_000)
    while True:  # the interface comes before its packets
        block, size = _record(walk, head)
        if not size or block in (_PACKET, _OLD_PACKET):
            break
        if block == _INTERFACE:
            body = walk.peek(size)
            head.linktype, head.ticks = struct.unpack(head.order + "H", body[8:10])[0], _resolution(body[16:size - 4], head.order)
            break
        walk.at += size
    walk.at = 0
    return head


def _record(walk: _Walk, head: _Head) -> tuple[int, int]:
    """Kind and size of the record at the walk's place; size 0 where the file ends or is cut short."""
    data = walk.peek(16)
    if head.kind == "pcap":
        return (_PACKET, 16 + struct.unpack(head.order + "I", data[8:12])[0]) if len(data) == 16 else (0, 0)
    block, size = struct.unpack(head.order + "II", data[:8]) if len(data) >= 12 else (0, 0)
    return (0, 0) if size < 12 or walk.at + size > walk.size else (block, size)


def _plausible(data: bytes, head: _Head) -> np.ndarray:
    """Places in ``data`` at which a record might begin."""
    step = 1 if head.kind == "pcap" else 4  # blocks are aligned
    count = max(0, len(data) - 16 + step) // step

    def number(at: int) -> np.ndarray:
        return np.ndarray((count,), head.order + "u4", data, at, (step,)).astype(np.int64) if count else np.zeros(0, np.int64)
    if head.kind == "pcap":
        good = ((number(4) < head.ticks) & (number(8) <= number(12)) & (number(8) <= _LONGEST) & (abs(number(0) - head.seconds) < 10 * 365 * 86_400))
    else:
        block, size = number(0), number(4)
        good = ((block > 0) & (block <= 10) | (block == _SECTION)) & (size >= 12) & (size % 4 == 0) & (size <= _LONGEST)
    return np.flatnonzero(good) * step


def _is_border(walk: _Walk, head: _Head, at: int) -> bool:
    """Whether plausible records follow each other from here, for a while or to the end of the file."""
    for _ in range(_CHAIN):
        walk.at = at
        if at == walk.size:
            return True
        _, size = _record(walk, head)
        if not size or at + size > walk.size or not len(_plausible(walk.peek(16), head)):
            return False
        if head.kind == "pcapng":
            walk.at = at + size - 4
            if struct.unpack(head.order + "I", walk.peek(4))[0] != size:
                return False
        at += size
    return True


def _guess(walk: _Walk, head: _Head, low: int, high: int) -> int:
    """A border in [low, high) by the look of what follows, -1 if none is found."""
    low += -low % 4 if head.kind == "pcapng" else 0
    for begin in range(low, high, _SEARCHED):
        walk.at = begin
        for at in _plausible(walk.peek(min(_SEARCHED, high - begin) + 15), head):
            if begin + at < high and _is_border(walk, head, begin + int(at)):
                return begin + int(at)
    return -1


def _walked(path: str, segment: int, begin: int, chunk_bytes: int, segment_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one segment: the records that begin in it, by the chunk that they begin in.

    ``begin`` is the first border at or behind the segment's start, -1 if it has to be guessed. All rows tell from
    where to where was walked; a segment without records gives a row of no bytes.
    """
    with _open(path) as handle:
        walk = _Walk(handle)
        head = _head(walk)
        low, high = segment * segment_bytes, min(walk.size, (segment + 1) * segment_bytes)
        if segment == 0:
            begin = head.start
        elif begin < 0 and head.kind != "unknown":
            begin = _guess(walk, head, low, high)
        fixed = path, head.kind, head.order == ">", head.ticks, head.linktype
        walk.at, rows, cut = begin, [], False
        while head.kind != "unknown" and 0 <= walk.at < high:
            block, size = _record(walk, head)
            if not size:
                cut = True
                break
            # A frame whose data is cut is kept as far as it goes
            number, at, walk.at = walk.at // chunk_bytes, walk.at, min(walk.size, walk.at + size)
            if not rows or rows[-1][0] != number:
                rows.append([number, at, 0, 0])
            rows[-1][2] += walk.at - at
            rows[-1][3] += block in (_PACKET, _OLD_PACKET)
        for _, offset, length, frames in rows or [(0, max(begin, 0), 0, 0)]:
            yield *fixed, offset, length, frames, cut, segment, begin, walk.at if begin >= 0 else -1


_SEGMENT_SCHEMA = CHUNK_SCHEMA.replace("first_frame", "frames") + ", segment long, seg_begin long, seg_end long"


def chunk_index(spark: SparkSession, folder: str, pattern: str = "*.pcap*", chunk_bytes: int = CHUNK_BYTES, segment_chunks: int = SEGMENT_CHUNKS) -> DataFrame:
    """Chunks of all captures in a folder. Only file names are listed by Spark; contents are not read.

    The rows do not depend on ``segment_chunks``: a chunk holds the records that begin in its range of the file.
    """
    segment_bytes = chunk_bytes * segment_chunks
    names = [part.split()[0] for part in _SEGMENT_SCHEMA.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(list(_walked(row.path, row.segment, row.begin, chunk_bytes, segment_bytes)), columns=names)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        """The chunks of one file; a segment that did not begin where the one before ended is walked again from there."""
        path, end, frames, out = frame["path"].iloc[0], 0, 0, []
        for number, rows in frame.sort_values(["segment", "offset"]).groupby("segment"):
            if number and rows["seg_begin"].iloc[0] != end:
                rows = pd.DataFrame(list(_walked(path, int(number), end, chunk_bytes, segment_bytes)), columns=names)
            end = int(rows["seg_end"].iloc[0])
            rows = rows.assign(first_frame=frames + rows["frames"].cumsum() - rows["frames"] + 1)
            frames += int(rows["frames"].sum())
            out.append(rows[(rows["length"] > 0) | (rows["segment"] == 0)])
            if rows["cut_short"].iloc[0]:
                out[-1] = rows
                break
        return pd.concat(out)[columns]

    columns = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
             .select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(length - 1, 0) div {segment_bytes}"))).alias("segment")))
    segments = files.withColumn("begin", F.lit(-1).cast("long")).repartition(F.xxhash64("path", "segment")).mapInPandas(walk, _SEGMENT_SCHEMA)
    return segments.groupBy("path").applyInPandas(settle, CHUNK_SCHEMA)


# ---- step 2: frames -----------------------------------------------------------------------------

def _short(data: bytes, at: int) -> int:
    return int.from_bytes(data[at:at + 2], "big")


def _network_layer(data: bytes, linktype: int) -> bytes | None:
    """The IP packet inside a frame; None for anything else."""
    if linktype in _RAW_IP:
        return data
    if linktype in (0, 108):
        return data[4:]
    if linktype == 1:
        kind, at = _short(data, 12), 14
        while kind in (0x8100, 0x88A8, 0x9100):
            kind, at = _short(data, at + 2), at + 4
        if kind in (0x8847, 0x8848):
            while at + 4 <= len(data) and not data[at + 2] & 1:
                at += 4
            return data[at + 4:]
    elif linktype == 113:
        kind, at = _short(data, 14), 16
    elif linktype == 276:
        kind, at = _short(data, 0), 20
    else:
        return None
    return data[at:] if kind in (0x0800, 0x86DD) else None


def _transport(ip: bytes) -> tuple | None:
    """Addresses, protocol number and transport bytes; the number is -1 where it must not be decoded."""
    if len(ip) >= 20 and ip[0] >> 4 == 4:
        header, total = (ip[0] & 15) * 4, _short(ip, 2)
        if header < 20:
            return None
        number = -1 if _short(ip, 6) & 0x1FFF else ip[9]
        return socket.inet_ntop(socket.AF_INET, ip[12:16]), socket.inet_ntop(socket.AF_INET, ip[16:20]), number, ip[header:total or None]
    if len(ip) >= 40 and ip[0] >> 4 == 6:
        number, body = ip[6], ip[40:40 + _short(ip, 4)] if _short(ip, 4) else ip[40:]
        while number in (0, 43, 44, 51, 60) and len(body) >= 8:
            if number == 44:
                later, size = _short(body, 2) >> 3, 8
            else:
                later, size = 0, (body[1] + 2) * 4 if number == 51 else (body[1] + 1) * 8
            number, body = (-1 if later else body[0]), body[size:]
        return socket.inet_ntop(socket.AF_INET6, ip[8:24]), socket.inet_ntop(socket.AF_INET6, ip[24:40]), number, body
    return None


_SKIPPED = ("", "", 0, 0, "OTHER", 0, 0, False, False, False, False, False, False, b"")


def _packet(data: bytes, linktype: int) -> tuple:
    """Whether a frame holds an IP packet, and its fields."""
    ip = _network_layer(data, linktype)
    layer = _transport(ip) if ip else None
    if layer is None:
        return False, *_SKIPPED
    src, dst, number, body = layer
    sport = dport = flags = 0
    protocol, payload = "OTHER", b""
    if number == 6 and len(body) >= 20 and body[12] >> 4 >= 5:
        protocol, sport, dport, flags = "TCP", _short(body, 0), _short(body, 2), body[13]
        payload = body[(body[12] >> 4) * 4:]
    elif number == 17 and len(body) >= 8:
        protocol, sport, dport, payload = "UDP", _short(body, 0), _short(body, 2), body[8:]
    elif (number == 1 and ip[0] >> 4 == 4 or number == 58 and ip[0] >> 4 == 6) and len(body) >= 4:
        protocol = "ICMP"
    bits = [bool(flags & bit) for bit in (0x02, 0x10, 0x01, 0x04, 0x08, 0x20)]
    return True, src, dst, sport, dport, protocol, len(data), len(payload), *bits, payload


def _frames_of(data: bytes, kind: str, order: str, ticks: int) -> Iterator[tuple[int, bytes]]:
    """Time in microseconds and bytes of the frames in a chunk."""
    at = 0
    while at + 12 <= len(data):
        if kind == "pcap":
            if at + 16 > len(data):
                return
            seconds, part, size = struct.unpack(order + "III", data[at:at + 12])
            yield seconds * 1_000_000 + part * 1_000_000 // ticks, data[at + 16:at + 16 + size]
            at += 16 + size
        else:
            block, length = struct.unpack(order + "II", data[at:at + 8])
            if block in (_PACKET, _OLD_PACKET):
                high, low, size = struct.unpack(order + "III", data[at + 12:at + 24])
                yield ((high << 32) | low) * 1_000_000 // ticks, data[at + 28:at + 28 + size]
            at += max(12, length)


def read_frames(chunks: DataFrame) -> DataFrame:
    """One row per frame; ``parsed`` is false for frames that hold no IP packet."""
    columns = [part.split()[0] for part in FRAME_SCHEMA.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch.itertuples():
                rows, frame = [], chunk.first_frame
                with _open(chunk.path) as handle:
                    handle.seek(chunk.offset)
                    data = handle.read(chunk.length)
                for ts_us, content in _frames_of(data, chunk.format, ">" if chunk.big_endian else "<", chunk.ticks):
                    parsed, *fields = _packet(content, chunk.linktype)
                    rows.append((chunk.path, frame, parsed, ts_us, *fields))
                    frame += 1
                    if len(rows) == _FRAMES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    # Chunks are tiny rows; spreading them by position balances the bytes behind them
    spread = chunks.filter("length > 0").repartition(F.xxhash64("path", "offset"))
    return spread.mapInPandas(decode, FRAME_SCHEMA)


def read_captures(spark: SparkSession, folder: str, pattern: str = "*.pcap*", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packets of all captures in a folder; ``pkt_id`` follows file name and frame number."""
    # The index is read twice and costs a walk over every file; its rows are few
    chunks = materialize(chunk_index(spark, folder, pattern, chunk_bytes))
    files = chunks.select("path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("path")).cast("long"))
    packets = read_frames(chunks).filter("parsed").drop("parsed").join(files, "path")
    number = F.shiftleft(F.col("_file"), _FRAME_BITS) + F.col("frame")
    return packets.withColumns({"pkt_id": number, "ts": F.timestamp_micros("ts_us")}).drop("_file")


def capture_statistics(chunks: DataFrame, frames: DataFrame, max_packets: int | None = None) -> DataFrame:
    """Telemetry per file: frames read, parsed and skipped, cut flag, link type, bytes.

    With ``max_packets`` reading stops at the frame after the last accepted packet, if there is one: then the file
    counts as truncated, and later frames were not read.
    """
    files = chunks.groupBy("path").agg(F.max("format").alias("format"), F.max("linktype").alias("linktype"),
                                       F.bool_or("cut_short").alias("cut_short"), F.max(F.col("offset") + F.col("length")).alias("bytes"))
    truncated = F.lit(False)
    if max_packets is not None:
        # The rank limit is pushed below the shuffle, so no file's frames are gathered
        accepted = (frames.filter("parsed").select("path", "frame").withColumn("_rank", F.row_number().over(Window.partitionBy("path").orderBy("frame")))
                    .filter(F.col("_rank") <= max_packets).groupBy("path").agg(F.count("*").alias("_n"), F.max("frame").alias("_last")))
        full = F.coalesce("_n", F.lit(0)) >= max_packets
        # A negative number stands before every frame
        frames = (frames.select("path", "frame", "parsed").join(accepted.select("path", "_n", "_last"), "path", "left")
                  .withColumn("_beyond", full & (F.col("frame") > F.coalesce("_last", F.lit(-1)))))
        truncated = F.coalesce("_beyond", F.lit(False))
        counts = frames.groupBy("path").agg(F.count_if(~F.col("_beyond")).alias("frames_read"),
                                            F.count_if(F.col("parsed") & ~F.col("_beyond")).alias("packets_parsed"), F.bool_or("_beyond").alias("_beyond"))
    else:
        counts = frames.groupBy("path").agg(F.count("*").alias("frames_read"), F.count_if("parsed").alias("packets_parsed"))
    out = files.join(counts, "path", "left").fillna({"frames_read": 0, "packets_parsed": 0})
    return (out.withColumns({"frames_skipped": F.col("frames_read") - F.col("packets_parsed"), "truncated": truncated, "packets_used": F.col("packets_parsed")})
            .drop("_beyond"))
