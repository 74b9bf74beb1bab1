"""Media columns: MPEG audio.

encode() stores bytes as a variable-bitrate MPEG-1 Layer III file: an ID3v2 tag, a Xing frame with the frame count,
byte count and seek table, then protected frames whose granules are silent and whose ancillary part carries the
payload, and an ID3v1 tag. parse() takes any such stream as it comes: it skips tags, resynchronises on frame headers
(a header counts only if another or the stream's end follows where its length says), reads Xing, Info and VBRI
tables with their seek entries, verifies the CRC-16 of protected frames of all three layers, and gives the exact
duration in samples and the offset of each frame. Frames of free format say no length and are skipped as noise.

A null text is stored like an empty one; a null media value gives a null result; texts of any length are stored whole,
one at a time. Empty tables give empty results. Damaged bytes are skipped and counted, never an error. Equal bytes give equal files. Repeated rows and other columns are kept as they are;
columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

# Fixed values of the MPEG audio formats.
BITRATES = {  # kbit/s by (MPEG-1?, layer) and header index 1..14
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
SIDE_INFO = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}  # by (MPEG-1?, mono?)

#: Layer II: bits of each subband's allocation as (bits, subbands) runs, by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),  # MPEG-2 and 2.5
}

RATE, SIDE, HEAD = 48000, 17, 4 + 2 + 17
TOC = 100


@lru_cache(maxsize=1 << 16)
def crc16(data: bytes) -> int:
    """Polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        crc &= 0xFFFF
    return crc


@lru_cache(maxsize=1 << 12)
def header(word: bytes) -> dict | None:
    """Decodes four header bytes; None if they are none."""
    bits = int.from_bytes(word, "big")
    version, layer, rate, index = bits >> 19 & 3, 4 - (bits >> 17 & 3), bits >> 10 & 3, bits >> 12 & 15
    if len(word) < 4 or bits >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or index in (0, 15):
        return None
    one, mono, padding = version == 3, bits >> 6 & 3 == 3, bits >> 9 & 1
    kbps, hertz = BITRATES[one, layer][index - 1], SAMPLE_RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padding
    # intensity stereo shares the allocation of the subbands from here on
    bound = 4 * ((bits >> 4 & 3) + 1) if bits >> 6 & 3 == 1 else 32
    return {"version": version, "layer": layer, "rate": hertz, "kbps": kbps, "samples": samples, "length": length, "protected": not bits >> 16 & 1, "side": SIDE_INFO[one, mono] if layer == 3 else 0, "channels": 1 if mono else 2, "bound": bound}


def _crc_bits(value: int, n: int) -> int:
    """The same checksum over n bits."""
    crc = 0xFFFF
    for k in range(n - 1, -1, -1):
        crc = crc << 1 ^ (0x8005 if (crc >> 15 ^ value >> k) & 1 else 0)
        crc &= 0xFFFF
    return crc


def allocation_bits(h: dict) -> list[int]:
    """Layer II: the width of each subband's allocation."""
    each = h["kbps"] // h["channels"]
    table = "low" if h["version"] != 3 else ("d" if h["rate"] == 32000 else "c") if each <= 48 else "a" if each <= 80 or h["rate"] == 48000 else "b"
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)]


def frame_crc(data: bytes, at: int, h: dict) -> tuple[int, int]:
    """The checksum that the frame at `at` carries, and that of what it protects: the header's last bytes, then Layer
    III's side information, Layer I's allocation, or Layer II's allocation and scale factor selection."""
    said = int.from_bytes(data[at + 4 : at + 6], "big")
    if h["layer"] == 3:
        return said, crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]])
    body = data[at + 6 : at + 6 + 96]
    stream, width = int.from_bytes(body, "big"), 8 * len(body)
    widths, n = [4] * 32 if h["layer"] == 1 else allocation_bits(h), 0
    selections = 0
    for subband, bits in enumerate(widths):
        shared = h["channels"] == 2 and subband >= h["bound"]
        for _ in range(1 if shared else h["channels"]):
            n += bits
            if n <= width and stream >> (width - n) & ((1 << bits) - 1):
                selections += h["channels"] if shared else 1
    n = min(width, n + 2 * selections * (h["layer"] == 2))
    return said, _crc_bits(int.from_bytes(data[at + 2 : at + 4], "big") << n | stream >> (width - n), 16 + n)


def _frame(index: int, protected: bool) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a 48 kHz mono frame, and the frame's length."""
    word = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | index << 12 | 1 << 10 | 3 << 6)
    side = bytes(SIDE)
    crc = struct.pack(">H", crc16(word[2:] + side)) if protected else b""
    return word + crc + side, header(word)["length"]


FRAMES = [_frame(i, True) for i in range(1, 15)]


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x00" + text.encode("latin-1")
    return name + struct.pack(">I", len(body)) + b"\x00\x00" + body


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The file that carries the payload; n_bytes is its length before padding."""
    frames, at = [], 0
    full, room = FRAMES[-1], FRAMES[-1][1] - HEAD
    while at < len(payload):
        head, length = full if len(payload) - at >= room else next((x for x in FRAMES if x[1] - HEAD >= len(payload) - at), full)
        part = payload[at : at + length - HEAD]
        frames.append(head + part + bytes(length - HEAD - len(part)))
        at += len(part)
    head, length = _frame(9, False)  # the table needs 120 bytes and must not be read as sound
    ends = [length]
    for frame in frames:
        ends.append(ends[-1] + len(frame))
    toc = bytes(min(255, 256 * ends[len(frames) * i // TOC] // ends[-1]) for i in range(TOC))
    table = b"Xing" + struct.pack(">III", 7, len(frames), ends[-1]) + toc
    xing = (head + table).ljust(length, b"\x00")
    info = f"payload={len(payload)};bytes={n_bytes};crc32={zlib.crc32(payload):08x}"
    tags = _text_frame(b"TSSE", "mono carrier") + _text_frame(b"TXXX", "carrier\x00" + info)
    size = len(tags)
    safe = bytes(size >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + safe + tags + xing + b"".join(frames) + b"TAG" + info.encode()[:30].ljust(125, b"\x00")


def _tag(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Length and text frames of the ID3v2 tag at `at` (0 if there is none)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0, {}
    major, flags = data[at + 3], data[at + 5]
    size = sum(b << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    out, i, end = {}, at + 10, min(len(data), at + 10 + size)
    if flags & 0x40 and end - i >= 4:  # extended header
        raw = data[i : i + 4]
        i += sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else struct.unpack(">I", raw)[0] + 4
    while major in (3, 4) and i + 10 <= end and data[i]:
        raw = data[i + 4 : i + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else struct.unpack(">I", raw)[0]
        body, name = data[i + 10 : min(end, i + 10 + n)], data[i : i + 4].decode("latin-1")
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\x00")
            key, _, text = text.partition("\x00") if name == "TXXX" else (name, "", text)
            out[key] = text
        i += 10 + n
    return 10 + size + 10 * bool(major == 4 and flags & 0x10), out


def _table(data: bytes, at: int, h: dict) -> dict | None:
    """The variable-bitrate table that the frame at `at` holds; toc has Xing's 256ths of the file, or VBRI's entry lengths."""
    for skip in (4, 6):
        i = at + skip + h["side"]
        if data[i : i + 4] in (b"Xing", b"Info") and len(data) >= i + 8:
            flags, j, out = struct.unpack_from(">I", data, i + 4)[0], i + 8, {"kind": data[i : i + 4].decode(), "frames": None, "bytes": None, "toc": None}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(data) >= j + 4:
                    out[key], j = struct.unpack_from(">I", data, j)[0], j + 4
            if flags & 4 and len(data) >= j + TOC:
                out["toc"] = list(data[j : j + TOC])
            return out
    i = at + 36
    if data[i : i + 4] == b"VBRI" and len(data) >= i + 18:
        size, frames = struct.unpack_from(">II", data, i + 10)
        out = {"kind": "VBRI", "frames": frames, "bytes": size, "toc": None}
        if len(data) >= i + 26:
            entries, scale, width, _ = struct.unpack_from(">HHHH", data, i + 18)
            if 0 < width <= 4 and len(data) >= i + 26 + entries * width:
                out["toc"] = [scale * int.from_bytes(data[j : j + width], "big") for j in range(i + 26, i + 26 + entries * width, width)]
        return out
    return None


def parse(data: bytes) -> dict:
    """Everything that the stream says; offsets are those of sounding frames from the start of the data."""
    at, end, tags = 0, len(data), {}
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["id3v1"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    offsets, spans, table, samples, rates, kbps, skipped, checked, bad = [], [], None, 0, set(), set(), 0, 0, 0
    in_step = False
    while at + 4 <= end:
        n, found = _tag(data, at)
        if n:
            tags, at = tags | found, at + n
            continue
        h = header(data[at : at + 4])
        after = at + h["length"] if h else 0
        # out of step, the next header must be where this one says
        if not h or after > end or not in_step and after + 4 <= end and not (nxt := header(data[after : after + 4])) and data[after : after + 3] != b"ID3" or not in_step and after + 4 <= end and nxt and (nxt["version"], nxt["layer"], nxt["rate"]) != (h["version"], h["layer"], h["rate"]):
            in_step = False
            jump = data.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            skipped, at = skipped + jump - at, jump
            continue
        in_step = True
        if not offsets and table is None and (table := _table(data, at, h)):
            at = after
            continue
        body = at + 4
        if h["protected"]:
            said, computed = frame_crc(data, at, h)
            checked, bad, body = checked + 1, bad + (said != computed), body + 2
        offsets.append(at)
        spans.append((body + h["side"], after))
        samples += h["samples"]
        rates.add(h["rate"])
        kbps.add(h["kbps"])
        at = after
    rate = max(rates) if len(rates) == 1 else 0
    return {"tags": tags, "table": table, "offsets": offsets, "spans": spans, "samples": samples, "rate": rate, "vbr": len(kbps) > 1, "skipped": skipped + max(0, end - at), "crc_checked": checked, "crc_bad": bad}


def carried(data: bytes, found: dict) -> tuple[bytes, int, bool]:
    """Payload, its length before padding, and whether it agrees with the tag's length and checksum."""
    note = dict(x.split("=", 1) for x in found["tags"].get("carrier", "").split(";") if "=" in x)
    raw = b"".join(data[a:b] for a, b in found["spans"])
    payload = raw[: int(note.get("payload", len(raw)))]
    return payload, int(note.get("bytes", len(payload))), note.get("crc32") == f"{zlib.crc32(payload):08x}"


def _with_columns(df: DataFrame, run, fields: list[T.StructField]) -> DataFrame:
    return df.mapInArrow(lean(run), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + fields))


ROWS = 64  # rows handled at once, so memory follows the texts and not the batch size


def store_audio(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df without the text column and with the stored file of its UTF-8 bytes, padded to a positive multiple of 64."""

    def run(batches):
        for batch in batches:
            k = batch.schema.names.index("__raw")
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                media = []
                for raw in part.column(k):
                    raw = raw.as_py() or b""
                    media.append(encode(padded(raw), len(raw)))
                rest = [i for i in range(part.num_columns) if i != k]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.array(media, pa.binary())], [*[part.schema.names[i] for i in rest], media_col])

    rows = df.withColumn("__raw", F.col(text_col).cast("binary")).drop(text_col, media_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "__raw"] + [T.StructField(media_col, T.BinaryType())])
    return rows.mapInArrow(lean(run), schema)


AUDIO = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("intact", T.BooleanType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("duration_samples", T.LongType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("table_kind", T.StringType()),
    T.StructField("table_frames", T.LongType()),
    T.StructField("table_toc", T.ArrayType(T.LongType())),
    T.StructField("variable", T.BooleanType()),
    T.StructField("crc_checked", T.LongType()),
    T.StructField("crc_bad", T.LongType()),
    T.StructField("skipped_bytes", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
]


def read_audio(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what parse() finds in each media value."""
    kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(kinds)
        found = parse(data)
        payload, n_bytes, intact = carried(data, found)
        table = found["table"] or {}
        return (payload, n_bytes, intact, found["rate"], found["samples"], found["offsets"], table.get("kind"), table.get("frames"), table.get("toc"), found["vbr"], found["crc_checked"], found["crc_bad"], found["skipped"], list(found["tags"].items()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [row(x.as_py()) for x in part.column(part.schema.names.index(media_col))]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[f.name for f in AUDIO]])

    return _with_columns(df.drop(*[f.name for f in AUDIO if f.name != media_col]), run, AUDIO)


def digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The contract's columns from stored files that read_audio has read."""
    tail = F.substring("payload", -64, 64)
    seek = F.sha2(F.array_join(F.col("frame_offsets").cast("array<string>"), ","), 256)
    seconds = F.col("duration_samples") / F.nullif(F.col("sample_rate"), F.lit(0))
    feature = F.concat_ws(
        ";", F.concat(F.lit("rate="), "sample_rate"), F.concat(F.lit("samples="), "duration_samples"), F.concat(F.lit("frames="), F.size("frame_offsets")), F.concat(F.lit("table="), "table_kind", F.lit(":"), "table_frames"),
        F.concat(F.lit("crc="), F.col("crc_checked") - F.col("crc_bad"), F.lit("/"), "crc_checked"), F.concat(F.lit("seek="), F.substring(seek, 1, 16)),
    )
    return df.select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length(media_col).cast("long").alias("media_bytes"),
        F.sha2(F.col(media_col), 256).alias("media_sha256"), feature.alias("feature"), "intact", seconds.alias("duration_s"), F.size("frame_offsets").alias("n_frames"), "frame_offsets", "table_toc", "crc_bad", "skipped_bytes",
    )
