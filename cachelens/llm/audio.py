"""MPEG audio columns: streams as bytes, with exact durations and seek offsets.

The writer stores any payload losslessly as MPEG-1 Layer III frames (48 kHz,
224 kbit/s, stereo, checksums on): side information of zeros, that is silence,
then the payload as ancillary data. An ID3v2 tag carries the payload's length,
an Info frame the frame count, byte count and table of contents; an ID3v1 tag ends it.

The reader takes any stream: it skips and parses tags, resynchronises on frame
headers (a header counts if the next one fits at its computed distance, or the
stream ends there), parses Xing/Info and VBRI tables, verifies CRC-16
checksums, and gives samples and the byte offset of each frame.

Defined results: a null or empty text is a payload of padding alone; bytes
without a frame give 0 frames and duration 0; broken checksums and skipped bytes
are counted; a truncated last frame is not counted as a frame; of two headers that both fit the
first one counts; repeated rows and keys give a row each, equal texts equal values; texts of any
length are stored whole; columns beside key and text are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import for_workers

UNIT, FRAME = 576, 672
HEADER, SIDE = b"\xff\xfa\xc4\x04", 32
# Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (0, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (0, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES[0, 3] = BITRATES[0, 2]
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFF00) ^ _CRC[(c >> 8) ^ b]
    return c


def header(data: bytes, at: int) -> dict | None:
    """The fields of a frame header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3)
    rate, index = (b2 >> 2) & 3, b2 >> 4
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15):
        return None
    kbps, hz, pad = BITRATES[int(version == 3), layer][index], RATES[version][rate], (b2 >> 1) & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = b3 >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbps": kbps, "hz": hz, "samples": samples, "size": size, "crc": not b1 & 1, "side": side if layer == 3 else 0, "mono": mono}


def _fits(a: dict, b: dict) -> bool:
    return (a["version"], a["layer"], a["hz"]) == (b["version"], b["layer"], b["hz"])


# -- writing ---------------------------------------------------------------
def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def write(payload: bytes, n_bytes: int) -> bytes:
    """payload: a multiple of 576 bytes, of which the first n_bytes are the text's."""
    frames = len(payload) // UNIT
    body = b"\x03payload_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    id3 = b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + bytes(SIDE))) + bytes(SIDE)
    toc = bytes(i * 256 // 100 for i in range(100))
    info = head + b"Info" + struct.pack(">III", 7, frames, (frames + 1) * FRAME) + toc
    rows = np.zeros((frames, FRAME), np.uint8)
    rows[:, : len(head)] = np.frombuffer(head, np.uint8)
    rows[:, len(head) : len(head) + UNIT] = np.frombuffer(payload, np.uint8).reshape(frames, UNIT)
    return id3 + info + bytes(FRAME - len(info)) + rows.tobytes() + b"TAG" + b"payload".ljust(125, b"\0")


# -- reading ---------------------------------------------------------------
def _tags(data: bytes) -> tuple[int, dict]:
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((data[at + 6 + i] & 0x7F) << (21 - 7 * i) for i in range(4))
        end, p, version = min(len(data), at + 10 + size), at + 10, data[at + 3]
        while version >= 3 and p + 10 <= end and data[p] != 0:
            n = struct.unpack(">I", data[p + 4 : p + 8])[0] if version == 3 else sum((data[p + 4 + i] & 0x7F) << (21 - 7 * i) for i in range(4))
            name, value = data[p : p + 4].decode("latin1"), data[p + 10 : min(end, p + 10 + n)]
            if name[:1] == "T" and value:
                text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin1"), "replace").strip("\0")
                key, _, rest = text.partition("\0")
                tags[f"TXXX:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else text
            p += 10 + n
        at += 10 + size
    return at, tags


def _table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a frame."""
    for skip in {4 + h["side"], 6 + h["side"]}:
        p = at + skip
        if data[p : p + 4] in (b"Xing", b"Info") and len(data) >= p + 8:
            kind, flags, out = data[p : p + 4].decode(), struct.unpack(">I", data[p + 4 : p + 8])[0], {}
            p += 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(data) >= p + 4:
                    out[name], p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            return {"kind": kind, **out, "toc": list(data[p : p + 100]) if flags & 4 else []}
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        size, frames = struct.unpack(">II", data[p + 10 : p + 18])
        n, scale, width, step = struct.unpack(">HHHH", data[p + 18 : p + 26])
        toc = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(n)] if width in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "step": step}
    return None


def read(data: bytes) -> dict:
    """tags, table, offsets (of sound frames), samples, hz, crc_errors, skipped bytes, payload as write() stores it."""
    at, tags = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - 128 >= at else len(data)
    offsets: list[int] = []
    body: list[bytes] = []
    table, samples, hz, errors, skipped, resyncs, first = None, 0, 0, 0, 0, 0, None
    sums: dict[bytes, int] = {}
    in_step = False
    while at + 4 <= end:
        h = header(data, at)
        fits = h is not None and at + h["size"] <= end and (first is None or _fits(first, h))
        if fits and not in_step and at + h["size"] + 4 <= end:
            after = header(data, at + h["size"])
            fits = after is not None and _fits(h, after)
        if not fits:
            if h is not None and in_step and at + h["size"] > end and _fits(first or h, h):
                break  # truncated
            if in_step or not skipped:
                resyncs += 1
            in_step, found = False, data.find(b"\xff", at + 1, end)
            skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if h["crc"] and h["layer"] == 3:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]]
            want = sums.get(covered)
            if want is None:
                want = sums[covered] = crc16(covered)
            errors += want != struct.unpack(">H", data[at + 4 : at + 6])[0]
        in_step = True
        if first is None:
            first, hz = h, h["hz"]
            table = _table(data, at, h)
            if table:
                at += h["size"]
                continue
        offsets.append(at)
        samples += h["samples"]
        start = at + 4 + 2 * h["crc"] + h["side"]
        body.append(data[start : start + UNIT])
        at += h["size"]
    return {"tags": tags, "table": table, "offsets": offsets, "samples": samples, "hz": hz, "crc_errors": errors, "skipped": skipped, "resyncs": resyncs, "payload": b"".join(body)}


def feature(got: dict) -> str:
    ms = got["samples"] * 1000 // got["hz"] if got["hz"] else 0
    seek = hashlib.sha256(np.asarray(got["offsets"], "<i8").tobytes()).hexdigest()[:16]
    table = (got["table"] or {}).get("kind", "none")
    return f"hz={got['hz']};samples={got['samples']};ms={ms};frames={len(got['offsets'])};table={table};crc_errors={got['crc_errors']};skipped={got['skipped']};seek={seek}"


def store_column(df: DataFrame, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Each row's text stored as a stream and read back: its digests, duration and seek offsets (the stream too with media=True).

    One pass without a shuffle; a stream lives only within its row's turn unless it is asked for.
    """
    for_workers(df.sparkSession, 256)
    src = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_ms", "seek_offsets"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
    if media:
        names, types = [*names, "media"], [*types, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                n, payload = payload_of(t.as_py())
                stream = write(payload, n)
                got = read(stream)
                back = got["payload"]
                row = (int(got["tags"]["TXXX:payload_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(got), got["samples"] * 1000 / max(1, got["hz"]), got["offsets"])
                rows.append((*row, stream) if media else row)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names)

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms double, seek_offsets array<long>"
    return src.mapInArrow(run, schema + (", media binary" if media else ""))
