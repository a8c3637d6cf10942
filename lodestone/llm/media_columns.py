"""MPEG audio columns: frames found by resynchronising, tags, variable-rate tables, checksums, exact times and seek offsets.

``parse`` reads any byte string: junk is skipped to the next header that a
second one (or the end) confirms, ID3v2 (any number, with footer), APEv2 and
ID3v1 tags are measured, a first frame that holds a Xing, Info or VBRI table is
read and not counted as sound, and layer III frames that carry a checksum have
it recomputed (those of layers I and II are not verified: they count neither as
right nor as wrong).  Times are exact: whole samples beside the sampling rate.

``store`` keeps a payload losslessly in a valid stream: layer III frames of
silence (all side information zero) whose main data are the payload in units
of 192 bytes, so that a player skips them as ancillary data.

Null and empty texts become one unit of spaces; equal texts equal streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import only, tidy, utf8

UNIT = 192
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The audio frames' checksum (polynomial 0x8005, most significant bit first)."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


known_crc = lru_cache(maxsize=4096)(crc16)


@lru_cache(maxsize=4096)
def header(word: int) -> dict | None:
    """Fields of a frame header, or None if it can't be one (free-format frames have no length and are refused)."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, sampling = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sampling == 3 or word & 3 == 2:
        return None
    hz, one = SAMPLING[version][sampling], version == 3
    kbps = RATES[(1, layer) if one else (2, 1 if layer == 1 else 2)][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return {"key": word & 0xFFFE0C00, "layer": layer, "hz": hz, "kbps": kbps, "samples": samples, "length": length, "crc": not word >> 16 & 1, "side": side, "mono": mono}


def _head(data: bytes, at: int) -> dict | None:
    return header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= len(data) else None


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where sound begins and ends, and what the tags say."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= end and max(data[start + 6 : start + 10]) < 128:
        size = 0
        for x in data[start + 6 : start + 10]:
            size = size << 7 | x
        tags.setdefault("id3v2", []).append(f"2.{data[start + 3]}.{data[start + 4]}")
        at, stop = start + 10, min(start + 10 + size, end)
        while data[start + 3] in (3, 4) and at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if data[start + 3] == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            name = data[at : at + 4].decode("latin-1")
            if name.startswith("T"):
                tags.setdefault(name, data[at + 11 : at + 10 + n].decode("latin-1").rstrip("\0"))
            at += 10 + n
        start = min(end, start + 10 + size + 10 * (data[start + 5] >> 4 & 1))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["id3v1"] = data[end + 3 : end + 33].decode("latin-1").rstrip(" \0")
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(start, end - size - 32 * (flags >> 31))
        tags["ape"] = True
    return start, end, tags


def _table(frame: bytes, h: dict) -> dict | None:
    """A variable-rate table in a frame's data."""
    at = 4 + 2 * h["crc"] + h["side"]
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, out = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}
        at += 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(frame[at : at + 100]) if name == "toc" else int.from_bytes(frame[at : at + size], "big")
                at += size
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "per": per}
    return None


def parse(data: bytes) -> dict:
    """Everything the columns need: frames as (offset, header, checksum: 1 right, 0 wrong, -1 none or, in layers I and II, not verified)."""
    at, end, tags = _tags(data)
    frames, table, junk, last = [], None, 0, None
    while at + 4 <= end:
        h = _head(data, at)
        if h is None or at + h["length"] > end or last != h["key"] and not (at + h["length"] == end or (n := _head(data, at + h["length"])) and n["key"] == h["key"]):
            skip = data.find(b"\xff", at + 1, end)
            skip, last = (end if skip < 0 else skip), None
            junk += skip - at
            at = skip
            continue
        last = h["key"]
        right = -1
        if h["crc"] and h["layer"] == 3:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]]
            right = int(known_crc(covered) == int.from_bytes(data[at + 4 : at + 6], "big"))
        if not frames and table is None and h["layer"] == 3 and (table := _table(data[at : at + h["length"]], h)):
            at += h["length"]
            continue
        frames.append((at, h, right))
        at += h["length"]
    return {"frames": frames, "table": table, "tags": tags, "junk": junk + (end - at if at < end else 0)}


#: Index of a 32 kHz layer III rate and the units of 192 bytes that such a frame holds.
HOLDS = {3: 1, 7: 2, 10: 3, 11: 4, 12: 5, 13: 5, 14: 7}


@lru_cache(maxsize=32)
def _front(rate: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a mono frame, and the frame's length."""
    head = bytes((0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0))
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17), 144 * RATES[1, 3][rate] // 32


def store(payload: bytes) -> bytes:
    """A stream that holds ``payload``, whose length is a positive multiple of 192."""
    units, frames, offsets, at = len(payload) // UNIT, [], [], 0
    size = 144 * 64 // 32
    done = 0
    while done < units:
        left = units - done
        rate = 14 if left >= 7 else next(r for r, n in HOLDS.items() if n >= left)
        front, length = _front(rate)
        take = min(HOLDS[rate], left)
        body = front + payload[done * UNIT : (done + take) * UNIT]
        offsets.append(at)
        frames.append(body + bytes(length - len(body)))
        at, done = at + length, done + take
    total = at + size
    toc = bytes(min(255, 256 * (size + offsets[len(offsets) * i // 100]) // total) for i in range(100))
    front, _ = _front(5)  # 64 kbit/s: room for the table
    first = front + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    comment = f"units={units}".encode()
    tag = b"TXXX" + struct.pack(">IH", len(comment) + 1, 0) + b"\0" + comment
    n = len(tag)
    id3 = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag
    return b"".join([id3, first + bytes(size - len(first)), *frames])


def load(stream: bytes) -> tuple[bytes, dict]:
    """The payload of a stream made by ``store``, and what ``parse`` found."""
    found = parse(stream)
    left, parts = int(found["tags"]["TXXX"].partition("=")[2]), []
    for at, h, right in found["frames"]:
        if right != 1:
            raise ValueError(f"checksum of the frame at {at}")
        start = at + 4 + 2 + h["side"]
        take = min(left, (h["length"] - 6 - h["side"]) // UNIT)
        parts.append(stream[start : start + take * UNIT])
        left -= take
    return b"".join(parts), found


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames int, sampling_hz int, n_samples long, duration_ns long, n_crc_ok int, seek_offsets array<long>"
)


def media_row(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    stream = store(payload)
    back, found = load(stream)
    frames = found["frames"]
    samples, hz = sum(h["samples"] for _, h, _ in frames), frames[0][1]["hz"]
    offsets = [at for at, _, _ in frames]
    kbps = sorted({h["kbps"] for _, h, _ in frames})
    ok = sum(right == 1 for _, _, right in frames)
    feature = f"frames={len(frames)};samples={samples};hz={hz};kbps={'/'.join(map(str, kbps))};crc={ok};table={found['table']['kind']}:{found['table']['frames']};junk={found['junk']};seek={zlib.crc32(struct.pack(f'<{len(offsets)}q', *offsets)):08x}"
    return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, len(frames), hz, samples, samples * 1_000_000_000 // hz, ok, offsets)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as an audio stream, reads it back and returns its columns; one narrow pass."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [media_row(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=names)

    return only(docs, "doc_id", "text").mapInArrow(tidy(kernel), SCHEMA)


PARSED = "n_frames int, sampling_hz int, n_samples long, duration_ns long, n_crc_ok int, n_crc_bad int, junk_bytes long, vbr string, tags map<string,string>, seek_offsets array<long>"


def parse_column(df: DataFrame, key: str, content: str) -> DataFrame:
    """The columns of any binary column ``content``; null content has no frames."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                found = parse(data or b"")
                frames = found["frames"]
                hz = frames[0][1]["hz"] if frames else None
                samples = sum(h["samples"] for _, h, _ in frames)
                rows.append((len(frames), hz, samples, samples * 1_000_000_000 // hz if hz else 0, sum(r == 1 for *_, r in frames), sum(r == 0 for *_, r in frames), found["junk"], found["table"] and found["table"]["kind"], {k: str(v) for k, v in found["tags"].items()}, [a for a, *_ in frames]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=[key, *[x.strip().split(" ")[0] for x in PARSED.replace("map<string,string>", "map").split(",")]])

    return df.select(key, content).mapInArrow(tidy(kernel), f"`{key}` {kind}, {PARSED}")
