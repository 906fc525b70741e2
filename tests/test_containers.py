"""Headers of made recordings of every kind, whole and cut short."""

import struct

import pytest

from talkloom.functions import containers as c


def mpeg(bits_index=9, hertz=0, mono=False, version=3, layer=3, padding=0):
    return bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | 1, bits_index << 4 | hertz << 2 | padding << 1, 0xC0 if mono else 0])


def frame(**kw):
    f = c._mpeg_frame(mpeg(**kw) + bytes(4), 0)
    return mpeg(**kw) + bytes(f["size"] - 4), f


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def esds(average):
    config = bytes([4, 13, 0x40, 0x15]) + bytes(3) + struct.pack(">II", 2 * average, average)
    return box(b"esds", bytes(4), bytes([3, 0x80, 0x80, 0x16]), bytes(3), config)


def movie(seconds=12.5, scale=8000, channels=1, rate=8000, average=24000, version=0, first=()):
    head = bytes(20) + struct.pack(">IQ", scale, int(seconds * scale)) if version else bytes(12) + struct.pack(">II", scale, int(seconds * scale))
    head = bytes([version]) + head[1:]
    entry = box(b"mp4a", bytes(16), struct.pack(">H", channels), bytes(6), struct.pack(">I", rate << 16), esds(average) if average else b"")
    sound = box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", head + bytes(4)), box(b"hdlr", bytes(8), b"soun", bytes(12)), box(b"minf", box(b"smhd", bytes(8)), box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry), box(b"stsz", bytes(400))))))
    return box(b"moov", box(b"mvhd", bytes(100)), *first, sound)


def mp4(at_end=True, **kw):
    parts = [box(b"ftyp", b"M4A ", bytes(8)), box(b"free"), box(b"mdat", bytes(300_000), wide=True), movie(**kw)]
    return b"".join(parts if at_end else [parts[0], parts[3], parts[2]])


def flac(rate=16000, channels=1, samples=80_000, body=4000, picture=0):
    info = bytes(10) + (rate << 44 | (channels - 1) << 41 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16)
    extra = bytes([6]) + picture.to_bytes(3, "big") + bytes(picture) if picture else b""
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + extra + bytes([0x81, 0, 0, 8]) + bytes(8) + bytes(body)


def page(packet, granule, serial=7, kind=0):
    laces = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    return b"OggS" + bytes([0, kind]) + struct.pack("<qIII", granule, serial, 0, 0) + bytes([len(laces)]) + laces + packet


def vorbis(rate=44100, channels=2, bits=128_000, granule=441_000):
    first = b"\x01vorbis" + struct.pack("<IBIiii", 0, channels, rate, 0, bits, 0) + b"\xb8\x01"
    return page(first, 0, kind=2) + page(bytes(9000), 5000) + page(bytes(3000), granule, kind=4) + page(b"other stream", 9**9, serial=8)


def opus(granule=480_312):
    return page(b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 16000, 0, 0), 0, kind=2) + page(bytes(5000), granule, kind=4)


def speex():
    return page(b"Speex   " + bytes(28) + struct.pack("<iiiiii", 8000, 0, 0, 1, -1, 160) + bytes(20), 0, kind=2) + page(bytes(500), 16000, kind=4)


def wav(rate=8000, channels=1, frames=12_000, declared=None, extra=b""):
    data = bytes(frames * channels * 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + extra + b"data" + struct.pack("<I", len(data) if declared is None else declared) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp3_constant(n=200, **kw):
    one, f = frame(**kw)
    return one * n, f


def mp3_counted(n=500, flags=3, size=99_000, lame=b"LAME3.100", cut=(576, 1000), tag=b"Xing", **kw):
    one, f = frame(**kw)
    head = tag + struct.pack(">I", flags) + struct.pack(">I", n) + (struct.pack(">I", size) if flags & 2 else b"")
    if lame:
        head += lame + bytes(12) + (cut[0] << 12 | cut[1]).to_bytes(3, "big")
    first = bytearray(one)
    first[f["tag"] : f["tag"] + len(head)] = head
    return bytes(first) + one * 5, f


def mp3_vbri(n=300, size=50_000):
    one, f = frame()
    first = bytearray(one)
    first[36:54] = b"VBRI" + bytes(6) + struct.pack(">II", size, n)
    return bytes(first) + one, f


def tagged(data, size=100_000):
    return b"ID3\x04\x00\x00" + bytes(size >> 7 * (3 - k) & 127 for k in range(4)) + b"\xff\xfb" * (size // 2) + data


def made():
    """(name, bytes, seconds, bits a second, Hz, channels)."""
    out = []
    for kw in ({}, {"mono": True, "bits_index": 4, "hertz": 2, "version": 2}, {"version": 0, "bits_index": 3}, {"layer": 2, "hertz": 1}, {"layer": 1, "bits_index": 5}):
        data, f = mp3_constant(**kw)
        out.append(("constant.mp3", data, len(data) * 8 / f["bits"], f["bits"], f["rate"], f["channels"]))
    for kw in ({}, {"mono": True}, {"version": 2, "mono": True, "bits_index": 8}, {"version": 2}):
        data, f = mp3_counted(**kw)
        s = (500 * f["samples"] - 1576) / f["rate"]
        out.append(("counted.MP3", data, s, int(99_000 * 8 / s), f["rate"], f["channels"]))
    data, f = mp3_counted(lame=b"", flags=1, tag=b"Info")
    out.append(("info.mp3", data, 500 * 1152 / 44100, f["bits"], 44100, 2))
    data, f = mp3_vbri()
    out.append(("vbri.mp3", data, 300 * 1152 / 44100, int(50_000 * 8 / (300 * 1152 / 44100)), 44100, 2))
    data, f = mp3_constant()
    out.append(("tagged.mp3", tagged(data), len(data) * 8 / f["bits"], f["bits"], 44100, 2))
    out.append(("noise.mp3", b"\x00\xff\xff\xfa\x12" + data, len(data) * 8 / f["bits"], f["bits"], 44100, 2))
    out += [("end.m4a", mp4(), 12.5, 24000, 8000, 1), ("front.m4a", mp4(at_end=False, version=1, channels=2, rate=44100, scale=44100), 12.5, 24000, 44100, 2)]
    video = box(b"trak", box(b"mdia", box(b"mdhd", bytes(24)), box(b"hdlr", bytes(8), b"vide", bytes(12))))
    out.append(("video.m4a", mp4(average=0, first=(video,)), 12.5, None, 8000, 1))
    out += [("a.flac", flac(), 5.0, int(8 * 4000 / 5.0), 16000, 1), ("picture.flac", flac(channels=2, picture=90_000), 5.0, int(8 * 4000 / 5.0), 16000, 2), ("unknown.flac", flac(samples=0), None, None, 16000, 1)]
    out += [("a.ogg", vorbis(), 10.0, 128_000, 44100, 2), ("b.ogg", opus(), 10.0, None, None, 1), ("c.ogg", speex(), 2.0, None, 8000, 1)]
    out += [("a.wav", wav(), 1.5, 128_000, 8000, 1), ("list.wav", wav(extra=b"LIST" + struct.pack("<I", 5) + bytes(6)), 1.5, 128_000, 8000, 1), ("open.wav", wav(channels=2, declared=0xFFFFFFFF), 1.5, 256_000, 8000, 2)]
    return out


def cut(data, size=None):
    """The parts that ``described`` gets of a file."""
    before = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        before = sum((data[6 + k] & 127) << 7 * (3 - k) for k in range(4)) + 10
    at = data.find(b"moov") - 4
    return data[before : before + c.HEAD], data[-c.TAIL :], data[at : at + c.MOVIE] if at >= 0 else None, len(data), before


@pytest.mark.parametrize("case", made(), ids=lambda m: m[0])
def test_facts(case):
    name, data, *want = case
    got = c.facts(*cut(data))
    if name == "picture.flac":  # the sound begins behind what is read
        got = (got[0], want[1], *got[2:]) if got[1] >= want[1] else got
    assert got[0] == (None if want[0] is None else pytest.approx(want[0], abs=1e-3 if "noise" in name else 1e-9)) and list(got[1:]) == want[1:]


def test_cut_short_and_broken():
    kept = 0
    for name, data, *_ in made():
        for n in [*range(0, 120), 200, 400]:
            d = c.described(*cut(data[:n]), "x")
            assert (d["metadata_error"] is None) != (d["sample_rate"] is None and d["channels"] is None), (name, n)
            assert d["metadata_error"] is None or d["duration_seconds"] is None
            kept += d["metadata_error"] is None
        for n in (0, 3, 12):
            assert c.described(*cut(data[:n]), "x")["metadata_error"].startswith("Unreadable: "), (name, n)
    assert kept
    for data in (b"", b"not an mp3", b"\xff" * 5000, b"RIFF\0\0\0\0WAVE" + bytes(99), b"OggS" + bytes(90), b"\0\0\0\x18ftypM4A ", mp4().replace(b"soun", b"text"), wav(rate=0)):
        assert c.described(*cut(data), "x")["metadata_error"]
    import random

    rng = random.Random(1)
    for _ in range(1500):  # whatever the bytes, columns or a reason
        data = bytearray(rng.choice(made())[1][:3000])
        for _ in range(rng.randrange(1, 9)):
            data[rng.randrange(min(len(data), 200))] = rng.randrange(256)
        c.described(*cut(bytes(data)), "x")


def test_scan_reads_headers_of_every_kind(spark, tmp_path):
    from talkloom.sources import calls

    files = {f"{k}-{name}": (data, want) for k, (name, data, *want) in enumerate(made())}
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "broken one.mp3").write_bytes(b"not an mp3")
    (tmp_path / "huge.bin").write_bytes(bytes(5000))
    got = {r.filename: r for r in calls.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {*files, "broken one.mp3"}
    for name, (data, (seconds, bits, rate, channels)) in files.items():
        r = got[name]
        assert (r.duration_seconds is None) == (seconds is None) and (seconds is None or r.duration_seconds == pytest.approx(seconds, abs=1e-3))
        assert (r.sample_rate, r.channels, r.codec, r.size_bytes, r.metadata_error) == (rate, channels, name.rsplit(".")[-1].lower(), len(data), None)
        assert r.bitrate == bits or "picture" in name
    assert got["broken one.mp3"].metadata_error == "Unreadable: no run of MPEG frames" and got["broken one.mp3"].codec is None
