"""Media columns in Ogg: writing 8-bit samples as logical streams, and a checked reader."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duplet.llm.common import map_arrow

#: Fixed values of the container (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: Ours: the first packet of a stream of samples: magic, rate, channel, channels, bytes a packet.
INTRO = struct.Struct("<8sIBBH")
MAGIC = b"dupletU8"
FRAME = 192

_reversed_bits = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
_reversed_16 = np.array([int(f"{x:016b}"[::-1], 2) for x in range(1 << 16)], np.uint32)


class OggError(ValueError):
    """The bytes are not a whole and sound Ogg file."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04c11db7, from 0, bits not reflected), by zlib's reflected one over reversed bytes."""
    x = zlib.crc32(page.translate(_reversed_bits), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(_reversed_16[x & 0xFFFF]) << 16 | int(_reversed_16[x >> 16])


def pages(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> Iterator[bytes]:
    """One logical stream: the first packet alone on its page, the others laced over pages of that many segments.

    packets: (bytes, granule position at its end).
    """
    lacing: list[int] = []
    body: list[bytes] = []
    granule, sequence, open_packet = -1, 0, False

    def page(last: bool) -> bytes:
        nonlocal lacing, body, granule, sequence, open_packet
        flags = CONTINUED * open_packet | FIRST * (sequence == 0) | LAST * last
        head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
        whole = head + b"".join(body)
        out = whole[:22] + struct.pack("<I", page_crc(whole)) + whole[26:]
        open_packet = bool(lacing) and lacing[-1] == 255
        lacing, body, granule, sequence = [], [], -1, sequence + 1
        return out

    for n, (data, at) in enumerate(packets):
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        done = 0
        while sizes:
            if len(lacing) == segments:
                yield page(False)
            take, sizes = sizes[: segments - len(lacing)], sizes[segments - len(lacing) :]
            lacing += take
            body.append(data[done : done + sum(take)])
            done += sum(take)
        granule = at
        if n == 0 or n == len(packets) - 1:
            yield page(n == len(packets) - 1)


def write_samples(payload: bytes, rate: int = 48_000, channels: int = 2, packet: int = 1920, segments: int = 64) -> bytes:
    """8-bit samples as Ogg: packets go to the channels' streams in turn, and the streams' pages alternate.

    A packet's granule position is the number of samples of its stream up to its end. Serial numbers come from the
    payload, so equal payloads give equal files. packet must be a multiple of 192, the samples of a frame.
    """
    if packet % FRAME or len(payload) % FRAME or not payload:
        raise ValueError(f"payload and packet must be positive multiples of {FRAME}")
    blocks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    base = zlib.crc32(payload)
    streams = []
    for c in range(channels):
        laid, at = [(INTRO.pack(MAGIC, rate, c, channels, packet), 0)], 0
        for b in blocks[c::channels]:
            laid.append((b, at := at + len(b)))
        streams.append(list(pages((base + c) & 0xFFFFFFFF, laid, segments)))
    turns = max(map(len, streams))
    return b"".join(s[i] for i in range(turns) for s in streams if i < len(s))


@dataclass
class Stream:
    """A logical stream: packets, and for each the granule position of the page on which it ends if it is the last to end there, else -1."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    rest: list[bytes] | None = None


def read(data: bytes) -> list[Stream]:
    """Verifies the checksum and order of every page, reassembles packets and parts the logical streams."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size or data[at : at + 4] != CAPTURE:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"cut page at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"stream {serial} begins {'twice' if flags & FIRST else 'in its middle'}")
        s = streams.setdefault(serial, Stream(serial))
        if sequence != s.pages or s.ended:
            raise OggError(f"stream {serial}: page {sequence} where {s.pages} is due")
        if bool(flags & CONTINUED) != (s.rest is not None):
            raise OggError(f"stream {serial}: broken packet on page {sequence}")
        s.pages += 1
        parts, s.rest = s.rest or [], None
        start = body
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                parts.append(data[start : start + size])
                s.packets.append(b"".join(parts))
                s.granules.append(-1)
                parts, start, size = [], start + size, 0
        if n and lacing[-1] == 255:
            s.rest = [*parts, data[start : start + size]]
        elif not n and flags & CONTINUED:  # a page without segments within a packet
            s.rest = parts
        if granule != -1 and s.granules:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if not s.ended or s.rest is not None:
            raise OggError(f"stream {s.serial} does not end")
    return list(streams.values())


def read_samples(data: bytes) -> tuple[bytes, dict]:
    """The samples that write_samples() stored, and what the container says: streams, pages, packets, rate, seconds, times.

    times: start of each packet in seconds, in payload order; granule positions are those of the pages, the packets
    before count back from them by their sizes.
    """
    by_channel, facts = {}, {"streams": 0, "pages": 0, "packets": 0}
    for s in read(data):
        if not s.packets or len(s.packets[0]) != INTRO.size or s.packets[0][:8] != MAGIC:
            raise OggError(f"stream {s.serial} is of another kind")
        _, rate, c, channels, packet = INTRO.unpack(s.packets[0])
        ends = s.granules[1:]
        sizes = [len(x) for x in s.packets[1:]]
        due = sum(sizes)
        if ends and ends[-1] != due:
            raise OggError(f"stream {s.serial}: {due} samples where {ends[-1]} are due")
        known = due
        starts = [0.0] * len(sizes)
        for i in range(len(sizes) - 1, -1, -1):
            known = ends[i] if ends[i] != -1 else known
            known -= sizes[i]
            starts[i] = known / rate
        by_channel[c] = (s.packets[1:], starts)
        facts = {"streams": facts["streams"] + 1, "pages": facts["pages"] + s.pages, "packets": facts["packets"] + len(sizes), "rate": rate, "channels": channels, "seconds": max(due / rate, facts.get("seconds", 0.0))}
    if len(by_channel) != facts.get("channels"):
        raise OggError("a channel is missing")
    out, times = [], []
    for i in range(max(len(p) for p, _ in by_channel.values())):
        for c in sorted(by_channel):
            if i < len(by_channel[c][0]):
                out.append(by_channel[c][0][i])
                times.append(by_channel[c][1][i])
    return b"".join(out), facts | {"times": times}


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def features(payload: bytes, facts: dict) -> str:
    """Stream facts and statistics of the samples about their middle, 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};ms={round(facts['seconds'] * 1000)};mean={x.mean():.4f};rms={float(np.sqrt((x * x).mean())):.4f};zero_crossings={crossings}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an Ogg file; a null or empty text is one frame of spaces.

    Any doc_id, null too, passes. Equal texts give equal files; repeated rows: each by itself. No rows: no rows. Extra columns are left out.
    """

    def run(batches):
        for b in batches:
            raw = [(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in raw], pa.int64()), pa.array([write_samples(payload_of(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """media with payload, times and feature read from its bytes; error says what is wrong where the bytes are not sound, the rest is null there, and for null media all are null."""
    fields = "doc_id long, n_bytes long, media binary, payload binary, times array<double>, feature string, error string"

    def run(batches):
        for b in batches:
            payloads, times, feats, errors = [], [], [], []
            for m in b.column(2).to_pylist():
                p = t = f = e = None
                try:
                    if m is not None:
                        p, facts = read_samples(m)
                        t, f = facts["times"], features(p, facts)
                except OggError as wrong:
                    p, e = None, str(wrong)
                for to, x in ((payloads, p), (times, t), (feats, f), (errors, e)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.binary()), pa.array(payloads, pa.binary()), pa.array(times, pa.list_(pa.float64())), pa.array(feats, pa.string()), pa.array(errors, pa.string())], ["doc_id", "n_bytes", "media", "payload", "times", "feature", "error"])

    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, fields)


def digest(docs: DataFrame) -> DataFrame:
    """For every whole text its stored form's digests, the payload being read back from the stored bytes. Fails on unsound bytes.

    Null text: as empty. Repeated rows: each by itself. No rows: no rows. Extra columns are left out.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                media = write_samples(payload_of(t))
                payload, facts = read_samples(media)
                rows.append((len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, facts)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
