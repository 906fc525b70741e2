"""Duration, rate, channels and bitrate from the headers of recordings: WAV, MP3, MP4, FLAC and Ogg.

``facts`` gets the bytes of a file that can matter, not the file: the first ones
after a leading tag, the last ones, and those of the movie box.  Kinds are told
by their signatures, not by names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Bytes that ``facts`` gets at most from the beginning, the end and the movie box.
HEAD, TAIL, MOVIE = 1 << 16, 1 << 17, 1 << 20

#: Fixed values of MPEG audio: kbit/s by index 1 to 14 for (MPEG 1, layer), Hz by version bits and index.
_KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Unreadable(ValueError):
    pass


Facts = tuple[float | None, int | None, int | None, int | None]  # seconds, bits a second, Hz, channels


def _wav(head: bytes, size: int) -> Facts:
    at, form = 12, None
    while at + 8 <= len(head):
        name, n = struct.unpack_from("<4sI", head, at)
        if name == b"fmt " and at + 24 <= len(head):
            _, channels, rate, a_second, align, _ = struct.unpack_from("<HHIIHH", head, at + 8)
            form = (channels, rate, a_second, align)
        elif name == b"data" and form:
            channels, rate, a_second, align = form
            if not rate or not align:
                raise Unreadable("WAV format without a rate")
            held = n if n not in (0, 0xFFFFFFFF) else max(0, size - at - 8)  # not known while it was written
            return held // align / rate, a_second * 8, rate, channels
        at += 8 + n + n % 2
    raise Unreadable("WAV without format and data")


def _mpeg_frame(data: bytes, at: int) -> dict | None:
    """The frame that begins at a place, if one can."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    index, hertz, padding = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or hertz == 3:
        return None
    first, rate = version == 3, _HERTZ[version][hertz]
    bits = _KBITS[first, layer][index - 1] * 1000
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    mono = data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {"kind": (version, layer, rate), "bits": bits, "rate": rate, "samples": samples, "size": size, "channels": 1 if mono else 2, "tag": at + 4 + side}


def _counted(data: bytes, at: int, frame: dict) -> tuple[int, int | None] | None:
    """Samples and bytes of the whole file as the first frame says."""
    tag = frame["tag"]
    if data[tag : tag + 4] in (b"Xing", b"Info") and tag + 8 <= len(data):
        flags, place = struct.unpack_from(">I", data, tag + 4)[0], tag + 8
        values = []
        for bit in (1, 2):
            known = flags & bit and place + 4 <= len(data)
            values.append(struct.unpack_from(">I", data, place)[0] if known else None)
            place += 4 if flags & bit else 0
        place += (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
        if values[0]:
            cut = int.from_bytes(data[place + 21 : place + 24], "big") if data[place : place + 4] in (b"LAME", b"Lavc", b"Lavf") else 0
            return max(0, values[0] * frame["samples"] - (cut >> 12) - (cut & 0xFFF)), values[1]
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        held, frames = struct.unpack_from(">II", data, at + 46)
        return frames * frame["samples"], held
    return None


def _mp3(head: bytes, size: int, before: int) -> Facts:
    """A run of frames begins where two follow each other, or where one counts the others; ``before`` bytes are a tag."""
    at = head.find(b"\xff")
    while at >= 0:
        frame = _mpeg_frame(head, at)
        if frame:
            counted = _counted(head, at, frame)
            after = _mpeg_frame(head, at + frame["size"])
            if counted and counted[0]:
                seconds = counted[0] / frame["rate"]
                return seconds, int(counted[1] * 8 / seconds) if counted[1] else frame["bits"], frame["rate"], frame["channels"]
            if after and after["kind"] == frame["kind"]:
                return 8 * (size - before - at) / frame["bits"], frame["bits"], frame["rate"], frame["channels"]
        at = head.find(b"\xff", at + 1)
    raise Unreadable("no run of MPEG frames")


def _stream_info(block: bytes) -> tuple[float | None, int, int]:
    if len(block) < 34:
        raise Unreadable("FLAC without stream information")
    packed = int.from_bytes(block[10:18], "big")
    rate, channels, samples = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
    if not rate:
        raise Unreadable("FLAC without a rate")
    return samples / rate if samples else None, rate, channels


def _flac(head: bytes, size: int, before: int) -> Facts:
    if len(head) < 8 or head[4] & 0x7F:
        raise Unreadable("FLAC without stream information")
    seconds, rate, channels = _stream_info(head[8:42])
    at, last = 4, False
    while not last and at + 4 <= len(head):
        last = bool(head[at] & 0x80)
        at += 4 + int.from_bytes(head[at + 1 : at + 4], "big")
    return seconds, int(8 * max(0, size - before - at) / seconds) if seconds else None, rate, channels


def _ogg(head: bytes, tail: bytes) -> Facts:
    if len(head) < 28:
        raise Unreadable("Ogg without a page")
    serial, segments = head[14:18], head[26]
    packet = head[27 + segments :]
    if packet[:7] == b"\x01vorbis" and len(packet) >= 28:
        channels, rate, _, bits = struct.unpack_from("<BIii", packet, 11)
        skip, shown, hertz = 0, rate, rate
        bits = bits if bits > 0 else None
    elif packet[:8] == b"OpusHead" and len(packet) >= 16:
        channels, skip = struct.unpack_from("<BH", packet, 9)
        bits, hertz, shown = None, 48000, None
    elif packet[:8] == b"Speex   " and len(packet) >= 56:
        rate, _, _, channels, bits = struct.unpack_from("<iiiii", packet, 36)
        skip, shown, hertz, bits = 0, rate, rate, bits if bits > 0 else None
    elif packet[:5] == b"\x7fFLAC" and packet[9:13] == b"fLaC":
        _, rate, channels = _stream_info(packet[17:51])
        skip, shown, hertz, bits = 0, rate, rate, None
    else:
        raise Unreadable("Ogg of an unknown kind")
    if hertz <= 0:
        raise Unreadable("Ogg without a rate")
    at = tail.rfind(b"OggS")
    while at >= 0:
        granule = int.from_bytes(tail[at + 6 : at + 14], "little", signed=True)
        if tail[at + 14 : at + 18] == serial and granule >= 0 and len(tail) >= at + 27:
            return max(0, granule - skip) / hertz, bits, shown, channels
        at = tail.rfind(b"OggS", 0, at)
    raise Unreadable("Ogg without a last page")


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the boxes between two places; the last one may be cut short."""
    while at + 8 <= min(end, len(data)):
        size, kind = struct.unpack_from(">I4s", data, at)
        begin = at + 8
        if size == 1 and at + 16 <= len(data):
            size, begin = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        after = at + size if size else end
        if after < begin:
            raise Unreadable("MP4 box of no size")
        yield kind, begin, min(after, end)
        at = after


def _inside(data: bytes, at: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    for kind, begin, after in _boxes(data, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield begin, after
            else:
                yield from _inside(data, begin, after, *path[1:])


def _bitrate(data: bytes, at: int) -> int | None:
    """The average bitrate of an elementary stream descriptor."""
    at += 4
    for tag, skip in ((3, 3), (4, 0)):
        if at >= len(data) or data[at] != tag:
            return None
        at += 1
        while at < len(data) and data[at] & 0x80:
            at += 1
        at += 1 + skip
    return struct.unpack_from(">I", data, at + 9)[0] or None if at + 13 <= len(data) else None


def _mp4(movie: bytes) -> Facts:
    """movie: the movie box, or as much of its beginning as there is."""
    end = max(len(movie), 8)
    for track, after in _inside(movie, 0, end, b"moov", b"trak"):
        if not any(movie[b + 8 : b + 12] == b"soun" for b, _ in _inside(movie, track, after, b"mdia", b"hdlr")):
            continue
        for b, _ in _inside(movie, track, after, b"mdia", b"mdhd"):
            scale, length = struct.unpack_from(">IQ", movie, b + 20) if movie[b] else struct.unpack_from(">II", movie, b + 12)
            if not scale:
                raise Unreadable("MP4 without a time scale")
            for s, stop in _inside(movie, track, after, b"mdia", b"minf", b"stbl", b"stsd"):
                for _, entry, close in _boxes(movie, s + 8, stop):
                    channels, rate = struct.unpack_from(">H", movie, entry + 16)[0], struct.unpack_from(">I", movie, entry + 24)[0] >> 16
                    bits = next((_bitrate(movie, e) for e, _ in _inside(movie, entry + 28, close, b"esds")), None)
                    return length / scale, bits, rate or None, channels or None
    raise Unreadable("MP4 without a sound track")


def facts(head: bytes, tail: bytes, movie: bytes, size: int, before: int = 0) -> Facts:
    """head: the bytes after a tag of ``before`` bytes; tail: the last bytes; movie: the movie box of an MP4; size of the file."""
    try:
        if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
            return _wav(head, size)
        if head[:4] == b"fLaC":
            return _flac(head, size, before)
        if head[:4] == b"OggS":
            return _ogg(head, tail)
        if head[4:8] == b"ftyp":
            return _mp4(movie)
        return _mp3(head, size, before)
    except (struct.error, IndexError) as e:
        raise Unreadable("a header is cut short") from e


def described(head: bytes | None, tail: bytes | None, movie: bytes | None, size: int, before: int, suffix: str) -> dict:
    """Columns of a recording's header; those of an unreadable one are null beside the reason."""
    try:
        seconds, bits, rate, channels = facts(head or b"", tail or b"", movie or b"", size, before)
    except Unreadable as e:
        return {"duration_seconds": None, "codec": None, "bitrate": None, "sample_rate": None, "channels": None, "metadata_error": f"{type(e).__name__}: {e}"}
    return {"duration_seconds": None if seconds is None else round(seconds, 6), "codec": suffix, "bitrate": bits, "sample_rate": rate, "channels": channels, "metadata_error": None}
