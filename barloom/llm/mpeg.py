"""MPEG audio (layer III) as a lossless byte store, and a reader for any MPEG audio stream.

Writer: one ID3v2 tag with the payload's length, one Info frame with frame count, byte count and
100 seek points, then CRC-protected mono frames at 48 kHz whose bit rate follows the rest of the
payload. The frames declare no coded spectrum (they play as silence), so all their main data is
ancillary data: there the payload bytes go, one for one.

Reader: parses ID3v2, ID3v1 and APEv2 tags, finds frames by resynchronising (a header counts only
if a compatible header or the end follows where it says), reads Xing/Info/VBRI tables (frames, bytes,
seek points, encoder delay and padding) and holds them against the frames found, verifies CRC-16 of
all three layers, and returns exact duration (without delay and padding) and the offset of every frame.

Nulls and empty payloads: a null payload is stored as an empty one; null or garbage media give a
row of zeros and empty lists. Equal payloads give equal media.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import in_utc

# Fixed values of the MPEG audio standard: bit rates in kbit/s by (version 1 or 2, layer), sample
# rates by version, and the CRC polynomial.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 0),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 0),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
}
RATES = {3: (44100, 48000, 32000, 0), 2: (22050, 24000, 16000, 0), 0: (11025, 12000, 8000, 0)}
POLY = 0x8005
# Fixed values of the standard: bits of a layer II bit allocation, as (subbands, bits each), by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low rates": ((4, 4), (7, 3), (19, 2)),
}
#: Encoders that write delay and padding behind an Info table.
ENCODERS = (b"LAME", b"Lavf", b"Lavc")

SIDE = 17  # bytes of side information of a mono layer III frame of version 1
HEAD = 4 + 2 + SIDE
#: Frame bytes at 48 kHz are 3 for each kbit/s. The rate's index for a frame that holds so many bytes.
ROOM = [(3 * kbps - HEAD, i) for i, kbps in enumerate(KBPS[1, 3]) if kbps]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ POLY, t << 1) & 0xFFFF
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of a byte matrix."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for col in rows.T:
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ col]
    return c


def crc16_bits(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of the first counts[i] bits of each row of a matrix of bits."""
    c = np.full(len(bits), 0xFFFF, np.uint32)
    for j in range(int(counts.max(initial=0))):
        feed = (c >> 15 ^ bits[:, j]) & 1
        c = np.where(j < counts, c << 1 & 0xFFFF ^ POLY * feed, c)
    return c


def _allocation(version: int, rate: int, kbps: int) -> str:
    """Name of the layer II table for a rate of `kbps` in each channel."""
    if version != 3:
        return "low rates"
    if kbps >= 56 and (rate == 48000 or kbps <= 80):
        return "a"
    if kbps > 80:
        return "b"
    return "d" if rate == 32000 else "c"


def layer2_crc(b: np.ndarray, at: np.ndarray, key: int, mode: int) -> np.ndarray:
    """CRC-16 of layer II frames at `at` that share bytes 1 and 2 (`key`) and byte 3's upper half (`mode`):
    two bytes of the header, all bit allocations, and two bits for each subband of a channel in use."""
    version, channels = key >> 11 & 3, 1 if mode >> 2 == 3 else 2
    table = _allocation(version, int(RATE[key]), KBPS[1 if version == 3 else 2, 2][key >> 4 & 15] // channels)
    widths = np.repeat(*np.array([(w, n) for n, w in ALLOCATION[table]]).T)
    bound = 4 * (mode & 3) + 4 if mode >> 2 == 1 else len(widths)  # joint stereo: above it, both channels share
    slots = [(w, 1 if channels == 1 or i < bound else 2) for i, w in enumerate(widths) for _ in range(channels if i < bound else 1)]
    n = 16 + sum(w for w, _ in slots)
    whole = -(-(n + 4 * len(widths)) // 8)
    rows = b[np.minimum(at[:, None] + np.r_[2, 3, 6 : 4 + whole], len(b) - 1)]
    bits = np.unpackbits(rows, axis=1)
    counts, j = np.full(len(at), n), 16
    for width, uses in slots:
        counts += 2 * uses * bits[:, j : j + width].any(axis=1)
        j += width
    return crc16_bits(bits, counts)


def _head(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 0x04, 0xC0])  # version 1, layer III, protected, 48 kHz, mono
    crc = int(crc16(np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + bytes(SIDE)


HEADS = {i: _head(i) for _, i in ROOM}
#: Bytes and header of a frame for each number of payload bytes that is left, up to the largest frame's.
MOST = ROOM[-1][0]
FIT = [next(x for x in ROOM if x[0] >= n) for n in range(MOST + 1)]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes) -> bytes:
    frames, sizes, at = [], [], 0
    while at < len(payload):
        room, index = FIT[min(MOST, len(payload) - at)]
        body = payload[at : at + room]
        frames += (HEADS[index], body, bytes(room - len(body)))
        sizes.append(HEAD + room)
        at += room
    total, first = sum(sizes), 3 * 64
    ends, n = np.cumsum([0, *sizes]), max(1, len(sizes))
    toc = bytes(int(ends[k * n // 100 if sizes else 0] * 256 // max(1, total + first)) for k in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + (total + first).to_bytes(4, "big") + toc
    head = bytes([0xFF, 0xFB, 5 << 4 | 0x04, 0xC0]) + bytes(SIDE)  # unprotected: readers look for the table right behind the side information
    text = b"\x03payload-bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"".join([b"ID3\x03\0\0", _syncsafe(len(tag)), tag, head, info, bytes(first - len(head) - len(info)), *frames])


def _plain(b: bytes) -> int:
    """A number of seven bits a byte."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3] if len(b) == 4 else 0


def _id3(version: int, flags: int, body: bytes) -> dict[str, str]:
    """Text fields of an ID3v2 tag: three-letter frames of 2.2, extended headers, unsynchronised tags and frames."""
    found: dict[str, str] = {}
    if version == 2 and flags & 0x40:  # a compression that was never defined
        return found
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40:
        at = _plain(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    names, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + names].strip(b"\0"):
        raw = body[at + names : at + 2 * names]
        n = _plain(raw) if version >= 4 else int.from_bytes(raw, "big")
        key, text = body[at : at + names].decode("latin-1"), body[at + head : at + head + n]
        if version >= 4:
            text = text[4:] if body[at + 9] & 1 else text  # its length without unsynchronisation
            text = text.replace(b"\xff\0", b"\xff") if body[at + 9] & 2 or flags & 0x80 else text
        if key[0] == "T" and text:
            parts = text[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(text[0], 3)], "replace").split("\0")
            own = key in ("TXXX", "TXX")
            found[f"{key}:{parts[0]}" if own else key] = parts[-1] if own else parts[0]
        at += head + n
    return found


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where audio starts and ends, and the tags' text fields."""
    start, end, found = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data):
        size, flags = _plain(data[start + 6 : start + 10]), data[start + 5]
        found |= _id3(data[start + 3], flags, data[start + 10 : start + 10 + size])
        start = min(len(data), start + 10 + size + (10 if flags & 0x10 else 0))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                found[f"ID3v1:{key}"] = value
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        found["APEv2:items"] = str(int.from_bytes(data[end - 16 : end - 12], "little"))
        end = max(start, end - size - (32 if data[end - 9] & 0x80 else 0))
    return start, end, found


def _lookup() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the 16 bits of bytes 1 and 2 of a header: frame bytes (0: not a header), samples, sample rate."""
    size, samples, rates = (np.zeros(1 << 16, np.int64) for _ in range(3))
    for b1 in range(0xE0, 0x100):
        version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
        if version == 1 or layer == 4:
            continue
        for b2 in range(256):
            kbps, rate = KBPS[1 if version == 3 else 2, layer][b2 >> 4], RATES[version][b2 >> 2 & 3]
            if kbps and rate:
                n = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
                pad = b2 >> 1 & 1
                k = b1 << 8 | b2
                size[k] = (12000 * kbps // rate + pad) * 4 if layer == 1 else n * 125 * kbps // rate + pad
                samples[k], rates[k] = n, rate
    return size, samples, rates


SIZE, SAMPLES, RATE = _lookup()


def _table(data: bytes, frame: int, x: int) -> dict:
    """Fields of the Xing, Info or VBRI table of the frame at `frame`, whose main data starts at x. Seek points are
    (part of the playing time, offset from that frame)."""
    out: dict = {"frames": -1, "bytes": -1, "points": [], "delay": 0, "padding": 0, "found": False}

    def number(at: int, n: int) -> int:
        return int.from_bytes(data[at : at + n], "big")

    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, at = number(x + 4, 4), x + 8
        out["found"] = True
        for flag, name in ((1, "frames"), (2, "bytes")):
            if flags & flag:
                out[name] = number(at, 4)
                at += 4
        if flags & 4:
            out["points"] = [(k / 100, v * max(0, out["bytes"]) // 256) for k, v in enumerate(data[at : at + 100])]
            at += 100
        at += 4 * (flags >> 3 & 1)
        if data[at : at + 4] in ENCODERS:
            out["delay"], out["padding"] = number(at + 21, 3) >> 12, number(at + 21, 3) & 0xFFF
    elif data[frame + 36 : frame + 40] == b"VBRI":
        out |= {"found": True, "bytes": number(frame + 46, 4), "frames": number(frame + 50, 4)}
        n, scale, width, each = (number(frame + k, 2) for k in (54, 56, 58, 60))
        steps = [number(frame + 62 + i * width, width) * scale for i in range(n) if frame + 62 + (i + 1) * width <= len(data)]
        ends = np.cumsum([0, *steps]).tolist()
        out["points"] = [(min(1.0, i * each / max(1, out["frames"])), e) for i, e in enumerate(ends)]
    return out


def _points_hold(points: list, pos: np.ndarray, end: int, largest: int) -> bool:
    """Whether each seek point is within a 256th of the stream and two frames of where that time starts."""
    if not points:
        return False
    starts = np.append(pos, end) - pos[0]
    part, offset = np.array(points, float).T
    want = starts[np.minimum((part * len(pos)).astype(np.int64), len(pos))]
    return bool((np.abs(want - offset) <= (end - pos[0]) / 256 + 2 * largest).all())


def read_mpeg(data: bytes | None) -> dict:
    data = data or b""
    start, end, tags = _tags(data)
    b = np.frombuffer(data, np.uint8)
    seen = np.flatnonzero((b[start : max(start, end - 3)] == 0xFF) & (b[start + 1 : end - 2] >= 0xE0)) + start if end - start > 3 else np.empty(0, np.int64)
    key = b[seen + 1].astype(np.int64) << 8 | b[seen + 2]
    ok = (SIZE[key] > 0) & (seen + SIZE[key] <= end)
    seen, key = seen[ok], key[ok]
    size, kind = SIZE[key], key & 0xFE0C  # version, layer and sample rate stay the same in a stream
    at = {int(p): i for i, p in enumerate(seen)}
    frames, lost, i, where = [], 0, 0, start
    while i < len(seen):
        j = at.get(int(seen[i] + size[i]))
        sure = seen[i] + size[i] == end or j is not None and kind[j] == kind[i]
        if not sure and not (frames and seen[i] == where and kind[i] == kind[frames[-1]]):
            i += 1
            continue
        lost += seen[i] != where
        frames.append(i)
        where = int(seen[i] + size[i])
        i = j if j is not None else int(np.searchsorted(seen, where))
    lost += bool(frames) and where != end
    out = {"tags": tags, "resyncs": int(lost), "frames": 0, "crc_checked": 0, "crc_ok": 0, "samples": 0, "rate": 0, "duration_ns": 0, "vbr_frames": -1, "vbr_ok": False, "vbr_bytes": -1, "bytes_ok": False, "delay": 0, "padding": 0, "seek_points": [], "seek_ok": False, "offsets": np.empty(0, np.int64), "payload": b"", "kbps_kinds": 0}
    if not frames:
        return out
    f = np.array(frames)
    pos, k, size = seen[f], key[f], size[f]
    layer, version, safe = 4 - (k >> 9 & 3), k >> 11 & 3, k >> 8 & 1 == 0
    mono = b[pos + 3] >> 6 == 3
    side = np.where(version == 3, np.where(mono, 17, 32), np.where(mono, 9, 17))
    mode = b[pos + 3] >> 4
    shared = 16 + 2 * (mode & 3) + 2  # layer I, joint stereo: subbands above the bound have one allocation
    covered = np.where(layer == 3, side, np.where(layer == 1, np.where(mono, 16, np.where(mode >> 2 == 1, shared, 32)), 0))
    for n in set(covered[safe & (covered > 0) & (size > covered + 6)].tolist()):
        some = np.flatnonzero(safe & (covered == n) & (size > n + 6))
        rows = b[pos[some][:, None] + np.r_[2, 3, 6 : 6 + n]]
        out["crc_checked"] += len(some)
        out["crc_ok"] += int((crc16(rows) == (b[pos[some] + 4].astype(np.uint32) << 8 | b[pos[some] + 5])).sum())
    second = safe & (layer == 2)
    for kind2, m in set(zip(k[second].tolist(), mode[second].tolist(), strict=True)):
        some = pos[second & (k == kind2) & (mode == m)]
        out["crc_checked"] += len(some)
        out["crc_ok"] += int((layer2_crc(b, some, kind2, m) == (b[some + 4].astype(np.uint32) << 8 | b[some + 5])).sum())
    skip = 4 + 2 * safe + np.where(layer == 3, side, 0)
    table = _table(data, int(pos[0]), int(pos[0] + skip[0]))
    if safe[0] and not table["found"]:  # common encoders leave it where it stands in unprotected frames
        table = _table(data, int(pos[0]), int(pos[0] + skip[0]) - 2)
    first = int(table["found"])
    rate, stop = int(RATE[k[0]]), int(pos[-1] + size[-1])
    samples = max(0, int(SAMPLES[k[first:]].sum()) - table["delay"] - table["padding"])
    out |= {"frames": len(f) - first, "samples": samples, "rate": rate, "duration_ns": samples * 1_000_000_000 // rate, "offsets": pos[first:], "kbps_kinds": len(set((k[first:] >> 4 & 15).tolist()))}
    out |= {"vbr_frames": table["frames"], "vbr_ok": table["frames"] == len(f) - first, "vbr_bytes": table["bytes"], "bytes_ok": table["bytes"] == stop - pos[0], "delay": table["delay"], "padding": table["padding"]}
    out |= {"seek_points": [int(pos[0]) + o for _, o in table["points"]], "seek_ok": _points_hold(table["points"], pos, stop, int(size.max()))}
    if (n := tags.get("TXXX:payload-bytes", "")).isdigit():
        out["payload"] = b"".join([data[p + s : p + z] for p, s, z in zip(pos[first:].tolist(), skip[first:].tolist(), size[first:].tolist(), strict=True)])[: int(n)]
    return out


def store_audio(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Adds the column `media`: each payload as an MPEG audio stream."""
    schema = df.drop(media).select("*", F.lit(b"").alias(media)).schema
    names = [x.name for x in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_utc(batches):
            got = pa.array([write_mpeg(x or b"") for x in b.column(payload).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([got if n == media else b.column(n) for n in names], names)

    return df.drop(media).mapInArrow(run, schema)


AUDIO = "frames long, samples long, rate int, duration_ns long, resyncs int, crc_checked long, crc_ok long, vbr_frames long, vbr_ok boolean, vbr_bytes long, bytes_ok boolean, delay int, padding int, seek_points array<long>, seek_ok boolean, rates int, tags map<string,string>, offsets array<long>, payload binary"


def probe_audio(df: DataFrame, media: str = "media", audio: str = "audio", drop_media: bool = False) -> DataFrame:
    """Adds the struct `audio`: what the stream in column `media` holds (see AUDIO)."""
    df = df.drop(audio)
    kept = [x for x in df.columns if not (drop_media and x == media)]
    schema = df.select(*[f"`{x}`" for x in kept], F.from_json(F.lit(None).cast("string"), AUDIO).alias(audio)).schema
    fields = ["frames", "samples", "rate", "duration_ns", "resyncs", "crc_checked", "crc_ok", "vbr_frames", "vbr_ok", "vbr_bytes", "bytes_ok", "delay", "padding", "seek_points", "seek_ok", "kbps_kinds", "tags", "offsets", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.binary()]
    names = schema[audio].dataType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_utc(batches):
            rows = [read_mpeg(x) for x in b.column(media).to_pylist()]
            cols = [pa.array([list(r[f].items()) if f == "tags" else r[f] for r in rows], kind) for f, kind in zip(fields, kinds, strict=True)]
            got = pa.StructArray.from_arrays(cols, names)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], got], [*kept, audio])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """Contract columns of op1, from the bytes that were read back."""
    a = F.col("audio")
    tail = F.expr("crc32(substring(audio.payload, -16, 16))")
    feature = F.format_string(
        "mpeg1-layer3 rate=%d frames=%d samples=%d ns=%d crc=%d/%d table=%s resyncs=%d bitrates=%d seek=%016x",
        a["rate"], a["frames"], a["samples"], a["duration_ns"], a["crc_ok"], a["crc_checked"], a["vbr_ok"].cast("string"), a["resyncs"], a["rates"], F.xxhash64(a["offsets"]),
    )
    return df.select(
        "doc_id", "n_bytes", F.octet_length(a["payload"]).cast("long").alias("payload_bytes"), F.sha2(a["payload"], 256).alias("payload_sha256"), tail.cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        a["duration_ns"].alias("duration_ns"), F.size(a["offsets"]).cast("long").alias("n_offsets"),
    )


def payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload: the text's UTF-8, filled with bytes 32 up to a positive multiple of 192."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = docs.select("doc_id", text.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    return d.select("doc_id", "n_bytes", F.expr("rpad(raw, cast(greatest(ceil(n_bytes / 192D), 1L) * 192 as int), X'20')").alias("payload"))
