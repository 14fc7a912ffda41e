"""Media columns as MPEG transport streams (ISO/IEC 13818-1), written and read per document.

``mux`` stores any bytes as the elementary stream of a one-program transport
stream.  ``demux`` reads any transport stream: it assembles the sections of program
tables over packets, checks continuity counters, reassembles the packetised elementary
streams of all programs and reports time stamps and random access points.  The Spark
operator keeps one document in memory at a time, so a task needs a small multiple of
its longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textwords import slices, tidy

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM = 0x06  # stream_type: PES packets holding private data
PRIVATE_STREAM_1 = 0xBD  # stream_id
PES_PAYLOAD = 32 * 1024
TICKS = 3600  # 90 kHz ticks from one access unit to the next (25 units a second)
RAP_EVERY = 8  # every eighth access unit may be entered at random
BLOCK = 64

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else _c << 1
    _CRC.append(_c)


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00"
    return (head + body) + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0x00])
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_TABLES = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _pcr_bytes(pts: int) -> bytes:
    return (pts << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream holding ``payload``; tables first, then one PES packet for each access unit."""
    out, cc = [_TABLES], 0
    for unit, at in enumerate(range(0, max(len(payload), 1), PES_PAYLOAD)):
        data = payload[at : at + PES_PAYLOAD]
        pts = unit * TICKS & 0x1FFFFFFFF
        body = b"\x80\x80\x05" + _pts_bytes(pts) + data
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + len(body).to_bytes(2, "big") + body
        flags = 0x50 if unit % RAP_EVERY == 0 else 0x10  # random access, PCR
        field, pos, start = bytes([flags]) + _pcr_bytes(pts), 0, 0x40
        while pos < len(pes):
            room = 184 - (1 + len(field) if field else 0)
            chunk = pes[pos : pos + room]
            if len(chunk) < room:  # the last packet of the unit is filled up in its adaptation field
                need = 184 - len(chunk) - 1
                field = field if field or not need else b"\x00"
                field += b"\xff" * (need - len(field))
                adapt = bytes([len(field)]) + field
            else:
                adapt = bytes([len(field)]) + field if field else b""
            out.append(bytes([SYNC, start | ES_PID >> 8, ES_PID & 0xFF, (0x30 if adapt else 0x10) | cc]) + adapt + chunk)
            pos += len(chunk)
            cc, field, start = (cc + 1) & 15, b"", 0
    return b"".join(out)


#: Stream ids whose PES packets have no optional header: program stream map and directory, padding, private 2, ECM, EMM, DSMCC, H.222.1 E.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
NULL_PID = 0x1FFF


class Track:
    """One PID: its continuity, and the bytes of the section or PES packet that is being assembled."""

    def __init__(self) -> None:
        self.last: int | None = None  # continuity counter
        self.last_payload = b""
        self.repeats = self.cc_errors = self.duplicates = 0
        self.held = bytearray()
        self.open = False

    def follows(self, cc: int, payload: bytes, jump: bool) -> bool:
        """Whether a packet with payload is new; a single repeat of the last one is legal and skipped, a gap is an error."""
        if self.last is not None and not jump:
            if cc == self.last and payload == self.last_payload and not self.repeats:
                self.repeats, self.duplicates = 1, self.duplicates + 1
                return False
            if cc != (self.last + 1) & 15:
                self.cc_errors += 1
                self.lost()
        self.last, self.last_payload, self.repeats = cc, payload, 0
        return True

    def lost(self) -> None:
        """Called when packets are missing."""


class Sections(Track):
    """Sections of a table, over any number of packets."""

    def lost(self) -> None:
        self.open = False
        self.held.clear()

    def feed(self, payload: bytes, start: bool) -> list[bytes]:
        if start:
            pointer = payload[0]
            found = self.whole(payload[1 : 1 + pointer]) if self.open else []
            self.open = True
            self.held.clear()
            return found + self.whole(payload[1 + pointer :])
        return self.whole(payload) if self.open else []

    def whole(self, more: bytes) -> list[bytes]:
        """The sections that ``more`` completes, checksums confirmed."""
        self.held += more
        out = []
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            end = ((self.held[1] & 0x0F) << 8 | self.held[2]) + 3
            if len(self.held) < end:
                return out
            section = bytes(self.held[:end])
            if crc32_mpeg(section):
                raise ValueError("table checksum")
            out.append(section)
            del self.held[:end]
        if self.held and self.held[0] == 0xFF:  # stuffing up to the packet's end
            self.held.clear()
            self.open = False
        return out


class Elementary(Track):
    """An elementary stream: ``payload``, and ``units`` (pts, dts, first byte in the payload, random access, damaged)."""

    def __init__(self, kind: int) -> None:
        super().__init__()
        self.kind, self.access, self.damaged, self.done = kind, False, False, 0
        self.parts: list[bytes] = []
        self.units: list[tuple[int | None, int | None, int, bool, bool]] = []

    def lost(self) -> None:
        self.damaged = self.open

    def feed(self, payload: bytes, start: bool, access: bool) -> None:
        if start:
            self.close()
            self.open, self.access, self.damaged = True, access, False
        if self.open:  # what comes before the first start belongs to a PES packet whose beginning isn't there
            self.held += payload

    def close(self) -> None:
        raw = bytes(self.held)
        self.held.clear()
        if not self.open:
            return
        self.open = False
        if raw[:3] != b"\x00\x00\x01" or len(raw) < 6:
            raise ValueError("no PES start code")
        length, pts, dts, head = int.from_bytes(raw[4:6], "big"), None, None, 6
        if raw[3] not in BARE:
            head = 9 + raw[8]
            if raw[7] & 0x80:
                pts = _pts_value(raw[9:14])
            if raw[7] & 0xC0 == 0xC0:
                dts = _pts_value(raw[14:19])
        data = raw[head : 6 + length] if length else raw[head:]  # length 0: up to the next start
        self.units.append((pts, dts, self.done, self.access, self.damaged or bool(length) and len(raw) < 6 + length))
        self.parts.append(data)
        self.done += len(data)

    @property
    def payload(self) -> bytes:
        return b"".join(self.parts)


def demux(stream: bytes) -> dict:
    """``programs`` {number: {pmt_pid, pcr_pid, streams {pid: type}}}, ``streams`` {pid: Elementary}, ``packets``, ``cc_errors``, ``duplicates``, ``damaged`` (packets marked as such, whose content isn't used).

    A table whose checksum fails, an elementary packet without its start code, and a
    stream that isn't made of whole packets with sync bytes raise ValueError.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    tables: dict[int, Sections] = {PAT_PID: Sections()}
    programs: dict[int, dict] = {}
    streams: dict[int, Elementary] = {}
    damaged = 0

    def read(pid: int, section: bytes) -> None:
        if not section[5] & 1:  # applies later, not now
            return
        key, body = int.from_bytes(section[3:5], "big"), section[8:-4]
        if pid == PAT_PID and section[0] == 0x00:
            for i in range(0, len(body), 4):
                number, at = int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
                if number:  # 0 names the network's tables
                    programs.setdefault(number, {"pmt_pid": at, "pcr_pid": None, "streams": {}})["pmt_pid"] = at
                    tables.setdefault(at, Sections())
        elif section[0] == 0x02 and key in programs and programs[key]["pmt_pid"] == pid:
            own = {}
            i = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while i < len(body):
                es = int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF
                own[es] = body[i]
                if es not in streams:
                    streams[es] = Elementary(body[i])
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0x0FFF)
            programs[key] |= {"pcr_pid": int.from_bytes(body[:2], "big") & 0x1FFF, "streams": own}

    for at in range(0, len(stream), PACKET):
        if stream[at] != SYNC:
            raise ValueError("no sync byte")
        b1, b3 = stream[at + 1], stream[at + 3]
        pid = (b1 & 0x1F) << 8 | stream[at + 2]
        if b1 & 0x80:
            damaged += 1
            continue
        track = streams.get(pid) or tables.get(pid)
        if track is None or pid == NULL_PID or not b3 & 0x30:
            continue
        skip, access, jump = 4, False, False
        if b3 & 0x20:
            length = stream[at + 4]
            skip = 5 + length
            if length:
                access, jump = bool(stream[at + 5] & 0x40), bool(stream[at + 5] & 0x80)
        if not b3 & 0x10:  # no payload: the counter stands still
            if jump:
                track.last = None
            continue
        payload = stream[at + skip : at + PACKET]
        if not track.follows(b3 & 15, payload, jump):
            continue
        if isinstance(track, Elementary):
            track.feed(payload, bool(b1 & 0x40), access)
        else:
            for section in track.feed(payload, bool(b1 & 0x40)):
                read(pid, section)
    for es in streams.values():
        es.close()
    every = [*streams.values(), *tables.values()]
    return {"programs": programs, "streams": streams, "packets": len(stream) // PACKET, "cc_errors": sum(t.cc_errors for t in every), "duplicates": sum(t.duplicates for t in every), "damaged": damaged}


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int64()))])


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def store_and_read(text: str | None) -> tuple:
    n, payload = padded(text)
    media = mux(payload)
    got = demux(media)
    ((program, told),) = got["programs"].items()
    es = got["streams"][ES_PID]
    back, units = es.payload, es.units
    if got["cc_errors"] or got["damaged"] or back != payload:
        raise ValueError("the stored stream doesn't give the payload back")
    points = [at for _, _, at, access, _ in units if access]
    feature = f"program={program};type={told['streams'][ES_PID]};packets={got['packets']};units={len(units)};access={len(points)};pts={units[0][0]}-{units[-1][0]};cc_errors={got['cc_errors']}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, [u[0] for u in units], points, media


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the stored stream's digest, its time stamps and random access points.

    A null or empty text is 64 zero bytes; texts of any length are stored whole, one at a
    time; a null id stays null; repeated rows give equal rows; other columns of ``docs``
    are not read; an empty table gives none.  ``with_media`` adds ``media`` binary, the
    stream itself.
    """
    arrow = _ARROW.append(pa.field("media", pa.binary())) if with_media else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                rows = [(i, *store_and_read(t.as_py())[: len(arrow) - 1]) for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA + (", media binary" if with_media else ""))
