"""MPEG audio columns: a stream built from bytes, and a reader for such streams.

``encode`` lays a payload into the ancillary bytes of MPEG-1 Layer III frames
(CRC protected, silent: all side information is zero), after an ID3v2 tag and
an information frame with the frame count, the byte count and a seek table.
``parse`` is the general reader: it passes over tags, resynchronises on frame
headers that a second header confirms, verifies checksums of all three layers, reads Xing, Info
and VBRI tables, and returns exact durations and frame offsets.

Null or empty text is a payload of 64 zero bytes.  Bytes that are no frames are
counted, never fatal; an empty stream has no frames and no duration.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

from pyspark.sql import DataFrame

from .shared import map_texts

#: Fixed values of the format, in kbit/s by bitrate index 1 to 14, and in Hz.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        table.append(crc)
    return table


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ CRC_TABLE[crc >> 8 ^ b]
    return crc


def crc16_bits(bits: str) -> int:
    """The checksum of a string of 0 and 1: whole bytes by table, the rest bit by bit."""
    whole = len(bits) // 8 * 8
    crc = crc16(int(bits[:whole] or "0", 2).to_bytes(whole // 8, "big"))
    for bit in bits[whole:]:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ (bit == "1") else 0)
    return crc


def allocation_widths(h: dict) -> list[int]:
    """Bits of each subband's allocation in layer II."""
    if h["version"] != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h["kbit"] if h["mono"] else h["kbit"] // 2
    if each <= 48:
        return [4] * 2 + [3] * (10 if h["hz"] == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h["hz"] == 48000 or each <= 80 else 7)


def protected_bits(b: bytes, at: int, h: dict) -> str:
    """What the checksum of a frame covers: half of the header, and of layer I the allocations, of layer II those and the selection of scale factors."""
    start = at + 6
    body = bits_of(b[start : start + 96])
    channels = 1 if h["mono"] else 2
    widths = [4] * 32 if h["layer"] == 1 else allocation_widths(h)
    # Joint stereo: from this subband on, one allocation serves both channels.
    bound = min(len(widths), 4 * ((b[at + 3] >> 4 & 3) + 1)) if b[at + 3] >> 6 == 1 else len(widths)
    x = used = 0
    for band, width in enumerate(widths):
        own = channels if band < bound else 1
        for _ in range(own):
            used += ("1" in body[x : x + width]) * (channels // own)
            x += width
    return bits_of(b[at + 2 : at + 4]) + body[: x + (2 * used if h["layer"] == 2 else 0)]


def bits_of(b: bytes) -> str:
    return "".join(f"{byte:08b}" for byte in b)


def header(b: bytes, at: int) -> dict | None:
    """The frame header at ``at``, or None."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(b[at + 1] >> 3 & 3), 4 - (b[at + 1] >> 1 & 3)
    index, rate = b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    hz = RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    kbit = BITRATES[(1 if version == 1 else 2, layer)][index - 1]
    samples = {1: 384, 2: 1152, 3: 1152 if version == 1 else 576}[layer]
    padding = b[at + 2] >> 1 & 1
    size = (12 * kbit * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + padding
    mono = b[at + 3] >> 6 == 3
    side = ({True: 17, False: 32} if version == 1 else {True: 9, False: 17})[mono] if layer == 3 else 0
    return {"version": version, "layer": layer, "kbit": kbit, "hz": hz, "samples": samples, "size": size, "crc": not b[at + 1] & 1, "mono": mono, "side": side}


def synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def seek_table(b: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of the frame at ``at``."""
    x = at + 4 + 2 * h["crc"] + h["side"]
    if b[x : x + 4] in (b"Xing", b"Info"):
        flags, x = int.from_bytes(b[x + 4 : x + 8], "big"), x + 8
        out: dict = {"kind": bytes(b[x - 8 : x - 4]).decode(), "frames": None, "bytes": None, "toc": b""}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], x = int.from_bytes(b[x : x + 4], "big"), x + 4
        if flags & 4:
            out["toc"] = bytes(b[x : x + 100])
        return out
    x = at + 36
    if b[x : x + 4] == b"VBRI" and len(b) >= x + 26:
        _, _, _, size, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", b[x + 4 : x + 26])
        steps = [int.from_bytes(b[x + 26 + i * width : x + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": steps}
    return None


def parse(b: bytes) -> dict:
    """Tags, table, frame offsets and sizes, exact duration, checksum results and skipped bytes of a stream."""
    at, end, tags, skipped = 0, len(b), {}, 0
    while b[at : at + 3] == b"ID3" and at + 10 <= end:
        size = synchsafe(b[at + 6 : at + 10])
        x, stop = at + 10, min(end, at + 10 + size)
        while x + 10 <= stop and b[x] and b[x : x + 4].isalnum():
            n = synchsafe(b[x + 4 : x + 8]) if b[at + 3] >= 4 else int.from_bytes(b[x + 4 : x + 8], "big")
            body = bytes(b[x + 10 : x + 10 + n])
            tags[bytes(b[x : x + 4]).decode("ascii")] = body[1:].decode("utf-16" if body[:1] == b"\x01" else "utf-8" if body[:1] == b"\x03" else "latin-1", "replace").strip("\0")
            x += 10 + n
        at += 10 + size + 10 * bool(b[at + 5] & 0x10)
    if end - at >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = bytes(b[end + 3 : end + 33]).rstrip(b"\0 ").decode("latin-1")
    offsets, sizes, heads, bad_crc, checked = [], [], [], 0, 0
    table = None
    locked = False
    while at < end:
        h = header(b, at)
        if h and at + h["size"] <= end and h["size"] > 4 and (locked or at + h["size"] == end or header(b, at + h["size"])):
            if h["crc"]:
                checked += 1
                own = crc16(b[at + 2 : at + 4] + b[at + 6 : at + 6 + h["side"]]) if h["layer"] == 3 else crc16_bits(protected_bits(b, at, h))
                bad_crc += own != int.from_bytes(b[at + 4 : at + 6], "big")
            if table is None and not heads and (table := seek_table(b, at, h)):
                table["offset"] = at
            else:
                offsets.append(at)
                sizes.append(h["size"])
                heads.append(h)
            at += h["size"]
            locked = True
        else:
            nxt = b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at, locked = nxt, False
    by_rate: dict[int, int] = {}
    for h in heads:
        by_rate[h["hz"]] = by_rate.get(h["hz"], 0) + h["samples"]
    duration = sum((Fraction(n, hz) for hz, n in by_rate.items()), Fraction(0))
    return {"tags": tags, "table": table, "offsets": offsets, "sizes": sizes, "heads": heads, "duration": duration, "crc_checked": checked, "crc_bad": bad_crc, "skipped": skipped}


# What encode() writes: MPEG-1 Layer III, CRC, 44.1 kHz, mono, 128 kbit/s; a shorter last frame where the rest fits one.
_SIDE, _HEAD = 17, 4 + 2 + 17
_BLANK_SIDE = bytes(_SIDE)


def _frame_heads() -> list[tuple[int, bytes]]:
    """(capacity, header with checksum and side information) by bitrate, smallest first."""
    out = []
    for index, kbit in enumerate(BITRATES[(1, 3)], 1):
        start = bytes((0xFF, 0xFA, index << 4, 0xC0))
        out.append((144 * kbit * 1000 // 44100 - _HEAD, start + crc16(start[2:4] + _BLANK_SIDE).to_bytes(2, "big") + _BLANK_SIDE))
    return out


HEADS = _frame_heads()
MAIN = 8  # 128 kbit/s


def encode(payload: bytes) -> bytes:
    room, head = HEADS[MAIN]
    frames = []
    full = len(payload) // room
    for i in range(full):
        frames += (head, payload[i * room : (i + 1) * room])
    if rest := payload[full * room :]:
        small, last = next(x for x in HEADS if x[0] >= len(rest))
        frames += (last, rest, bytes(small - len(rest)))
    audio = b"".join(frames)
    count = full + bool(rest)
    info_room, info_head = HEADS[4]  # 64 kbit/s: 185 bytes, enough for the table
    frame_size = room + _HEAD
    total = info_room + _HEAD + len(audio)
    toc = bytes(min(255, (info_room + _HEAD + p * count // 100 * frame_size) * 256 // total) for p in range(100))
    info = (b"Xing" if rest else b"Info") + struct.pack(">III", 7, count, total) + toc
    comment = b"\x03payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + bytes((0, 0, len(comment) >> 7, len(comment) & 127, 0, 0)) + comment
    return b"ID3\x04\x00\x00" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag + info_head + info + bytes(info_room - len(info)) + audio


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload in the ancillary bytes, and what ``parse`` found."""
    found = parse(media)
    n = int(found["tags"]["TXXX"].rpartition("\0")[2])
    body = b"".join(media[o + _HEAD : o + s] for o, s in zip(found["offsets"], found["sizes"], strict=True))
    return body[:n], found


def features(text: str) -> tuple:
    raw = text.encode("utf-8", "replace")
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    media = encode(payload)
    back, found = decode(media)
    seeks = zlib.crc32(b"".join(o.to_bytes(8, "big") for o in found["offsets"]))
    t, d = found["table"], found["duration"]
    said = f"mpeg1-l3;hz=44100;frames={len(found['offsets'])};table={t['kind']}:{t['frames']}:{t['bytes']};samples={d * 44100};seconds={d.numerator}/{d.denominator};crc={found['crc_checked']}:{found['crc_bad']};skipped={found['skipped']};seek_crc32={seeks}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), said, float(d), found["offsets"]


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as an MPEG stream, reads it back and describes it; one row for each row."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<bigint>"
    return map_texts(docs, features, schema, id_col, text_col)


def probe_streams(files: DataFrame, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """Duration, checksum counts and frame seek offsets of a binary column (of ``spark.read.format("binaryFile")``); null data is an empty stream."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .shared import column_ddl, pa_schema

    kind = files.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {kind}, seconds double, n_frames long, crc_checked long, crc_bad long, skipped_bytes long, frame_offsets array<bigint>, tags map<string,string>"
    out = pa_schema(ddl)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = parse(batch.column(1)[i].as_py() or b"")
                row = [batch.column(0)[i].as_py(), float(p["duration"]), len(p["offsets"]), p["crc_checked"], p["crc_bad"], p["skipped"], p["offsets"], list(p["tags"].items())]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

    return files.select(F.col(id_col), F.col(data_col)).mapInArrow(run, ddl)
