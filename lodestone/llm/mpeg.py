"""MPEG audio columns: frames are resynchronised and checked, tags and variable-bitrate tables parsed, durations exact.

parse() reads any byte string: ID3v2 tags (2.2 to 2.4) before and between frames, ID3v1 and APEv2 after them, MPEG 1, 2 and 2.5 of layers I to III, free
format included, Xing, Info and VBRI tables with their seek points, and CRC-16 of protected frames of all layers. A header counts if the frame it
describes ends at the end of the stream or at another header of the same version, layer and sampling rate; anything else is skipped and counted.

carry() is the lossless container used for texts: a silent MPEG-1 layer III stream, each frame's side information all zero and
its main data free for ancillary bytes, which hold the payload. The first frame holds a Xing table and an ID3v2 tag
the payload's length."""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, small_batches

# Fixed values of the MPEG audio standard: kbit/s by bitrate index, for version 1 layers I, II, III, then versions 2 and 2.5 layer I, layers II and III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Samples a second by index, for version 1.
RATES = (44100, 48000, 32000)

# Fixed values of the standard: bits of a subband's allocation in layer II as (subbands, bits) runs, by table.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}

_RATE = 32000
_SIDE = 17  # mono, version 1
_HEADER = 0xFFFA00C0 | 2 << 10  # version 1, layer III, protected, 32 kHz, one channel
#: Frame bytes by bitrate index at 32 kHz, and payload bytes of the largest.
_SIZES = {k: 144 * kbit * 1000 // _RATE for k, kbit in enumerate(BITRATES[1, 3]) if k}
_ROOM = _SIZES[14] - 4 - 2 - _SIDE


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 of the standard: polynomial 0x8005, begun with 0xFFFF."""
    if (c := _crcs.get(data)) is None:
        c = 0xFFFF
        for b in data:
            c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
        if len(_crcs) < 4096:
            _crcs[data] = c
    return c


def crc16_bits(head: bytes, data: bytes, bits: int) -> int | None:
    """The same over head and the first bits of data; None if data has fewer."""
    if bits > 8 * len(data):
        return None
    whole, rest = divmod(bits, 8)
    c = crc16(head + data[:whole])
    for k in range(rest):
        bit = data[whole] >> (7 - k) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


class Header:
    """What a frame header says; size is None if the word is no header. In free format it is 0, as only the distance to the next frame tells."""

    __slots__ = ("bound", "channels", "crc", "kbit", "kind", "layer", "pad", "rate", "samples", "side", "size", "version")

    def __init__(self, word: int):
        self.size = None
        version = {3: 1, 2: 2, 0: 25}.get(word >> 19 & 3)
        layer = 4 - (word >> 17 & 3)
        rate, index, mode = word >> 10 & 3, word >> 12 & 15, word >> 6 & 3
        if word >> 21 != 0x7FF or version is None or layer == 4 or rate == 3 or index == 15 or word & 3 == 2:
            return
        self.version, self.layer, self.crc = version, layer, not word >> 16 & 1
        self.rate = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
        self.kbit = BITRATES[min(version, 2), layer][index]
        self.channels = 1 if mode == 3 else 2
        self.bound = 4 * (word >> 4 & 3) + 4 if mode == 1 else 32  # subbands from here on share their allocation
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
        self.pad = (word >> 9 & 1) * (4 if layer == 1 else 1)
        if not index:
            self.size = 0
        elif layer == 1:
            self.size = 12 * self.kbit * 1000 // self.rate * 4 + self.pad
        else:
            self.size = self.samples // 8 * self.kbit * 1000 // self.rate + self.pad
        self.side = 0 if layer < 3 else (32, 17)[self.channels == 1] if version == 1 else (17, 9)[self.channels == 1]
        self.kind = (version, layer, self.rate)

    def allocation(self, size: int) -> list[int]:
        """Layer II: the bits of each subband's allocation, for a frame of that size."""
        if self.version != 1:
            table = "lsf"
        else:
            each = (self.kbit or size * self.rate * 8 // self.samples // 1000) / self.channels
            if self.rate == 48000 and each >= 56 or 56 <= each <= 80:
                table = "a"
            elif each >= 96:
                table = "b"
            else:
                table = "d" if self.rate == 32000 else "c"
        return [bits for n, bits in ALLOCATION[table] for _ in range(n)]

    def crc_good(self, frame: bytes) -> bool:
        """Whether the checksum of a protected frame is that of what it covers: the header and, by layer, the allocation, also which scale factors there
        are, or the side information."""
        said, head, body = int.from_bytes(frame[4:6], "big"), frame[2:4], frame[6:]
        if self.layer == 3:
            return crc16(head + body[: self.side]) == said
        if self.layer == 1:
            bound = min(self.bound, 32)
            return crc16_bits(head, body, 4 * (bound * self.channels + 32 - bound)) == said
        number, at, bits, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512, 0, 0
        for sub, width in enumerate(self.allocation(len(frame))):
            for _ in range(self.channels if sub < self.bound else 1):
                at -= width
                if number >> at & ((1 << width) - 1):
                    chosen += 1 if sub < self.bound else self.channels
                bits += width
        return crc16_bits(head, body, bits + 2 * chosen) == said


_headers: dict[int, Header] = {}


def _header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    h = _headers.get(word)
    if h is None:
        h = Header(word)
        if len(_headers) < 65536:
            _headers[word] = h
    return h if h.size is not None else None


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _id3v2(data: bytes, at: int) -> tuple[int, dict]:
    """End of an ID3v2 tag at `at` (or `at`) and its text frames."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + safe(data[at + 6 : at + 10])
    tags, p = {}, at + 10
    if flags & 0x40 and major > 2 and p + 4 <= len(data):
        p += safe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    head = 6 if major == 2 else 10
    while major in (2, 3, 4) and p + head <= min(end, len(data)) and data[p]:
        name = data[p : p + (3 if major == 2 else 4)].decode("latin-1")
        size = int.from_bytes(data[p + 3 : p + 6], "big") if major == 2 else safe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + head : min(p + head + size, end)]
        if name[0] == "T" and body:
            text = body[1:].decode(_ENCODINGS.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.rstrip("\0")
        p += head + size
    return end + (10 if flags & 0x10 else 0), tags


def _ape(data: bytes, start: int, end: int) -> dict:
    """The text items of an APEv2 tag between two places."""
    tags, p = {}, start
    while p + 9 <= end:
        size, flags = int.from_bytes(data[p : p + 4], "little"), int.from_bytes(data[p + 4 : p + 8], "little")
        stop = data.find(b"\0", p + 8, end)
        if stop < 0 or stop + 1 + size > end:
            break
        if not flags >> 1 & 3:  # text
            tags[data[p + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + size].decode("utf-8", "replace")
        p = stop + 1 + size
    return tags


def _trailer(data: bytes) -> tuple[int, dict]:
    """Where the tags at the end begin, and what they say."""
    end, tags = len(data), {}
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            tags[key] = data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip()
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = int.from_bytes(data[end - 20 : end - 16], "little"), int.from_bytes(data[end - 12 : end - 8], "little")
        if 32 <= size <= end:
            tags |= _ape(data, end - size, end - 32)
            end = max(0, end - size - (32 if flags >> 31 else 0))
    return end, tags


def _table(data: bytes, at: int, h: Header) -> dict:
    """The Xing, Info or VBRI table in the frame at `at`, empty if there is none."""
    p = at + 4 + h.side
    for q in (p, p + 2) if h.crc else (p,):
        if data[q : q + 4] in (b"Xing", b"Info"):
            out, flags, q = {"table": data[q : q + 4].decode()}, int.from_bytes(data[q + 4 : q + 8], "big"), q + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["toc"] = list(data[q : q + 100])
                q += 100
            if flags & 8:
                q += 4
            if data[q : q + 4] == b"LAME":
                both = int.from_bytes(data[q + 21 : q + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda lo, n: int.from_bytes(data[at + lo : at + lo + n], "big")
        entries, scale, width, every = (number(k, 2) for k in (54, 56, 58, 60))
        place, points = 0, []
        for k in range(entries if 1 <= width <= 4 else 0):  # each entry is the bytes of so many frames
            place += number(62 + k * width, width) * scale
            points.append(place)
        return {"table": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "points": points, "every": every}
    return {}


def parse(data: bytes) -> dict:
    """tags, offsets (of each audio frame), samples, rate, seconds (exact), table, crc_good, crc_bad, skipped, kbits, ancillary.

    No audio frame: rate 0 and no duration. `ancillary` are the byte ranges after each layer III frame's side information. table: of Xing and Info
    frames, bytes, toc (100 places in 256ths), delay and padding, of VBRI frames, bytes and points (bytes up to each `every` frames), as far as they are there."""
    tags, at = {}, 0
    while (end := _id3v2(data, at))[0] > at:
        tags |= end[1]
        at = end[0]
    stop, more = _trailer(data)
    tags = more | tags
    offsets, free, kbits = [], [], set()
    out = {"tags": tags, "offsets": offsets, "table": {}, "crc_good": 0, "crc_bad": 0, "skipped": 0, "samples": 0, "rate": 0, "kind": None, "ancillary": free, "kbits": kbits}
    kind, plain = None, None

    def spaced(at: int, h: Header) -> int:
        """Free format: the bytes of a frame without padding, by the next two headers that fit."""
        near = stop if stop - at < 2 * 8192 else at + 8192
        to = data.find(b"\xff", at + 24, near)
        while to >= 0:
            g = _header(data, to)
            if g and g.kind == h.kind and not g.kbit:
                step = to - at - h.pad
                last = to + step + g.pad
                third = _header(data, last) if last < stop else None
                if last == stop or third is not None and third.kind == h.kind and not third.kbit:
                    return step
            to = data.find(b"\xff", to + 1, near)
        return 0

    while at < stop:
        h, size = _header(data, at), 0
        if h and (kind is None or h.kind == kind):
            size = h.size
            if not size and (step := plain or spaced(at, h)):
                size = step + h.pad
        good = bool(size) and at + size <= stop
        if good:
            after = _header(data, at + size) if at + size < stop else h
            good = after is not None and after.kind == h.kind and bool(after.size) == bool(h.size)
        if not good:
            if (inner := _id3v2(data, at))[0] > at:  # a tag that is not at the beginning
                at = inner[0]
                tags |= inner[1]
                continue
            places = (data.find(b"\xff", at + 1, stop), data.find(b"ID3", at + 1, stop))
            to = min((p for p in places if p >= 0), default=stop)
            out["skipped"] += to - at
            at = to
            continue
        if kind is None:
            kind = h.kind
            out["kind"], out["rate"] = kind, h.rate
            if table := _table(data, at, h):
                out["table"] = table
                out["first"] = at
                at += size
                continue
        plain = None if h.size else size - h.pad
        if h.crc:
            out["crc_good" if h.crc_good(data[at : at + size]) else "crc_bad"] += 1
        offsets.append(at)
        kbits.add(h.kbit)
        out["samples"] += h.samples
        out["end"] = at + size
        if h.layer == 3:
            free.append((at + 4 + 2 * h.crc + h.side, at + size))
        at += size
    trim = out["table"].get("delay", 0) + out["table"].get("padding", 0)
    out["samples"] = max(0, out["samples"] - trim)
    out["seconds"] = Fraction(out["samples"], out["rate"]) if out["rate"] else Fraction(0)
    return out


def _frame(payload: bytes, index: int) -> bytes:
    head = struct.pack(">I", _HEADER | index << 12)
    side = bytes(_SIDE)
    body = head + struct.pack(">H", crc16(head[2:4] + side)) + side + payload
    return body + bytes(_SIZES[index] - len(body))


def carry(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream; payload_of() gives it back."""
    frames = []
    for at in range(0, len(payload), _ROOM):
        part = payload[at : at + _ROOM]
        frames.append(_frame(part, next(k for k, size in _SIZES.items() if size - 6 - _SIDE >= len(part))))
    table_size = _SIZES[1]
    total = table_size + sum(map(len, frames))
    ends = []
    at = table_size
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[k * len(frames) // 100] * 256 // total) for k in range(100)) if frames else bytes(100)
    table = struct.pack(">I", _HEADER | 1 << 16 | 1 << 12) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"TXXX" + safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + safe(len(tag)) + tag + table.ljust(table_size, b"\0") + b"".join(frames)


def payload_of(data: bytes, info: dict | None = None) -> bytes:
    """What carry() stored, read from the frames."""
    info = info or parse(data)
    said = info["tags"].get("payload_bytes", "0")
    n = int(said) if said.isascii() and said.isdigit() and len(said) < 16 else 0  # another's stream may say anything
    return b"".join(data[a:b] for a, b in info["ancillary"])[:n]


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw and zero bytes up to a multiple of unit, at least one unit."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _encode(batches):
    import pyarrow as pa

    for batch in batches:
        for at, n, data, ends in slices(batch, "text"):
            media = [carry(padded(data[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
            size = [b - a for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8 with padding in a media column. A null text is empty; ids and other columns are not looked at, and repeated
    rows are rows of their own. A very long text is encoded alone. No rows give no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(_encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_FOUND = "valid boolean, frames long, samples long, rate int, duration_num long, duration_den long, table string, table_agrees boolean, crc_good long, crc_bad long, skipped long, tags map<string,string>, seek array<long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _analyse(batches):
    import pyarrow as pa

    names = [x.rsplit(" ", 1)[0] for x in _FOUND.split(", ")]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(media: bytes | None) -> tuple:
        m = media or b""
        x = parse(m)
        payload, t = payload_of(m, x), x["table"]
        agrees = t.get("frames") in (None, len(x["offsets"])) and (not t or t.get("bytes") in (None, x.get("end", 0) - x["first"]))
        d, digest = x["seconds"], hashlib.sha256()
        for o in x["offsets"]:
            digest.update(o.to_bytes(8, "big"))
        feature = f"mpeg{x['kind'] or '-'};frames={len(x['offsets'])};seconds={d.numerator}/{d.denominator};kbit={'-'.join(map(str, sorted(x['kbits'])))};table={t.get('table', '-')};crc={x['crc_good']}/{x['crc_good'] + x['crc_bad']};skipped={x['skipped']};seek={digest.hexdigest()[:16]}"
        return (
            bool(x["offsets"]) and not x["crc_bad"] and not x["skipped"], len(x["offsets"]), x["samples"], x["rate"], d.numerator, d.denominator, t.get("table"), bool(t) and agrees, x["crc_good"], x["crc_bad"], x["skipped"],
            list(x["tags"].items()), x["offsets"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature,
        )

    for batch in batches:
        media, at = batch.column(1), 0
        while at < len(media):
            rows, size, begin = [], 0, at
            while at < len(media) and size < 1 << 21:
                m = media[at].as_py()
                rows.append(row(m))
                size += len(m or b"")
                at += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), *cols], names=["doc_id", *names])


def analysed(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the frames of each stored stream say, see parse(); seek has the byte offset of each audio frame, and the duration is exact as
    duration_num / duration_den seconds. A null or empty stream, or one without frames, has no frames, duration 0 / 1 and valid = false. Any bytes are
    read without failing; payload columns are those of an empty payload where no length is stored. Repeated rows are rows of their own, ids and other columns are not
    looked at, and batches of long streams are cut. No rows give no rows."""
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return small_batches(rows).mapInArrow(_analyse, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")
