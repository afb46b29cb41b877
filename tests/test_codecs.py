import io
import struct
import tarfile
import wave
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytefold.functions import codecs as C
from bytefold.functions import disks as D

images = st.tuples(st.integers(1, 9), st.integers(1, 9), st.sampled_from([3, 4]), st.integers(0, 2**32 - 1)).map(lambda t: np.random.default_rng(t[3]).integers(0, 3, t[:3]).astype(np.uint8) * 100)


@settings(max_examples=60, deadline=None)
@given(images)
def test_image_round_trips(x):
    assert (C.png_decode(C.png_encode(x)) == x).all()
    for packed in (True, False):
        assert (C.tga_decode(C.tga_encode(x, packed)) == x).all()
    assert (C.bmp_decode(C.bmp_encode(x)) == x[..., :3]).all()
    for binary in (True, False):
        assert (C.netpbm_decode(C.netpbm_encode(x, "ppm", binary)) == x[..., :3]).all() or x.size < 12
    turned = x
    for _ in range(4):
        turned = C.image_transform(turned, degrees=90)
    assert (turned == x).all()
    assert (C.image_transform(C.image_transform(x, flip_h=True, flip_v=True), flip_h=True, flip_v=True) == x).all()


def test_png_filters_against_plain_rows():
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (6, 5, 3)).astype(np.int64)
    rows = b""
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        line, up = x[y].ravel(), x[y - 1].ravel() if y else np.zeros(15, int)
        out = []
        for i in range(15):
            a, b, c = (line[i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            p = a + b - c
            best = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((line[i] - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        rows += bytes([kind, *out])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = C.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (C.png_decode(png) == x).all()


def test_gray_and_resize():
    x = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128], [255, 255, 255]]], np.uint8)
    assert C.luminance(x).tolist() == [[76, 149, 29, 127, 255]]
    grid = np.zeros((64, 64, 3), np.uint8)
    assert C.image_transform(grid, width=32, height=64).shape[:2] == (32, 32)
    assert C.image_transform(grid[:50, :], width=30, height=30, method="nearest").shape[1] == 30
    assert C.image_transform(grid[:7, :3], width=10, height=10, method="bicubic").shape[:2] == (10, 4)


@pytest.mark.parametrize("bad", [b"", b"BM", b"\x89PNG\r\n\x1a\n", b"P6", b"RIFF" + bytes(60), b"not a thing at all " * 9])
def test_bad_inputs_are_errors(bad):
    for f in (C.bmp_decode, C.png_decode, C.tga_decode, C.netpbm_decode, C.wav_decode, C.obj_decode, C.gzip_decode, C.zip_decode, D.vhd_decode, D.chd_decode, D.iso_decode, D.fat_decode, D.ext2_decode):
        with pytest.raises(C.CodecError):
            f(bad)


def test_wav_against_wave():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(range(64)))
    a = C.wav_decode(out.getvalue())
    assert (a.rate, a.channels, a.bits, a.samples) == (8000, 2, 16, bytes(range(64)))
    assert wave.open(io.BytesIO(C.wav_encode(a))).readframes(99) == bytes(range(64))


def cube():
    v = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    quads = [(1, 2, 4, 3), (5, 7, 8, 6), (1, 5, 6, 2), (3, 4, 8, 7), (1, 3, 7, 5), (2, 6, 8, 4)]
    return "".join(f"v {a} {b} {c}\n" for a, b, c in v) + "".join(f"f {' '.join(map(str, q))}\n" for q in quads)


def test_meshes():
    m = C.obj_decode(cube().encode())
    assert m.triangles.shape == (12, 4, 3)
    for text in (True, False):
        again = C.stl_decode(C.stl_encode(m, text))
        assert np.allclose(again.triangles, m.triangles)
    assert len(C.stl_encode(m, False)) == 684
    back = C.obj_encode(m)
    assert back.count(b"\nv ") == 8 and back.count(b"\nvn ") == 6
    assert np.allclose(C.obj_decode(back).triangles, m.triangles)
    assert len(C.obj_decode(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\nf 0 1 2\nf 1 2 99\n").triangles) == 1


entries = st.lists(st.tuples(st.text("abc", min_size=1, max_size=8), st.binary(max_size=600)), max_size=5, unique_by=lambda t: t[0]).map(lambda x: [C.Entry(n, d) for n, d in x])


@settings(max_examples=40, deadline=None)
@given(entries)
def test_archives(es):
    pairs = [(e.name, e.data) for e in es]
    assert [(e.name, e.data) for e in C.tar_decode(C.tar_encode(es))] == pairs
    assert [(e.name, e.data) for e in C.zip_decode(C.zip_encode(es))] == pairs
    tgz = C.archive_convert(C.zip_encode(es), "zip", "tgz")
    assert [(e.name, e.data) for e in C.zip_decode(C.archive_convert(tgz, "tar.gz", "zip", 9))] == pairs
    assert sorted(zipfile.ZipFile(io.BytesIO(C.zip_encode(es))).namelist()) == sorted(n for n, _ in pairs)
    assert tarfile.open(fileobj=io.BytesIO(C.tar_encode(es))).getnames() == [n for n, _ in pairs]
    with pytest.raises(C.CodecError):
        C.archive_convert(C.tar_encode(es), "tar", "gz")
    raw = b"".join(d for _, d in pairs)
    for level in (0, 6, 9):
        assert C.gzip_decode(C.gzip_encode(raw, level)) == raw
    assert C.zip_decode(C.archive_convert(C.gzip_encode(raw), "gz", "zip"))[0].name == "data.bin"


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 60))
def test_lz77(b, n):
    data, out = b + b[:n] * 3, bytearray()
    for _, literal, length, far in C.lz77_tokens(data):
        if literal >= 0:
            out.append(literal)
        for _ in range(length):
            out.append(out[-far])
    assert bytes(out) == data


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([bytes(700), b"ab" * 350, bytes(range(256)) * 3]), max_size=40))
def test_disk_images(parts):
    raw = b"".join(parts)
    raw += bytes(-len(raw) % 512)
    assert D.vhd_decode(D.vhd_encode(raw)) == raw
    assert D.vhd_decode(D.vhd_encode(raw, True, block=8192)) == raw
    assert D.chd_decode(D.chd_encode(raw, 4096), verify=True) == raw
    for a in D.DISC:
        for b in D.DISC:
            if a != b:
                assert D.DISC[b][0](D.disc_convert(D.DISC[a][1](raw), a, b)) == raw


def test_known_values():
    assert D.crc16(b"123456789") == 0x4B37
    mib = 1 << 20
    assert [D.geometry(n * mib) for n in (1, 100, 1024, 10240, 204800)] == [(30, 4, 17), (1003, 12, 17), (2080, 16, 63), (20805, 16, 63), (65535, 16, 255)]


TREE = [("docs/", True, b""), ("docs/a.txt", False, b"hello"), ("docs/sub/", True, b""), ("docs/sub/b.bin", False, bytes(range(256)) * 40), ("top.txt", False, b"")]


def test_trees():
    want = {(p.upper(), d) for p, _, d in TREE}
    assert {(p.upper(), d) for p, _, d in D.iso_decode(D.iso_encode(TREE))} == want
    assert {(p.upper(), d) for p, _, d in D.fat_decode(D.fat_encode(TREE))} == want
    many = [(f"f{i:03d}.txt", False, b"x") for i in range(90)]
    assert len(D.iso_decode(D.iso_encode(many))) == 90
    with pytest.raises(C.CodecError):
        D.iso_encode([("../x", False, b"")])


def test_cue():
    text = 'FILE "a b.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 02:03:02\n    INDEX 01 02:03:04\n'
    rows = D.cue_decode(text)
    assert rows[-1] == ("a b.bin", "BINARY", 2, "AUDIO", 1, 9229)
    assert D.cue_encode(rows) == text
    whole = 'CATALOG 123\nPERFORMER "p"\nTITLE "t"\nSONGWRITER "s"\nFILE "x.bin" BINARY\n  TRACK 01 AUDIO\n    TITLE "one"\n    PERFORMER "q"\n    PREGAP 00:02:00\n    INDEX 01 00:00:00\n    POSTGAP 00:00:05\n'
    assert D.cue_text(D.cue_sheet(whole)) == whole and D.cue_sheet(whole).files[0][2][0].pregap == 150
    assert D.cue_decode("TRACK 01 AUDIO\nINDEX 01 00:00:00\nREM x\n") == []
    assert D.cue_decode(D.iso_cue("a.bin")) == [("a.bin", "BINARY", 1, "MODE1/2048", 1, 0)]
    sector = b"\0" + b"\xff" * 10 + b"\0" + bytes(4) + b"u" * 2048 + bytes(288)
    assert D.bin_data(sector * 2) == b"u" * 4096 and D.bin_data(sector, "AUDIO") == b""


def ext2(files):
    """A one-group ext2 volume with 1 KiB blocks; a file of several blocks has a hole."""
    b = bytearray(1024 * 64)
    struct.pack_into("<II", b, 1024, 32, 64)
    struct.pack_into("<I", b, 1024 + 20, 1)
    struct.pack_into("<II", b, 1024 + 32, 8192, 8192)
    struct.pack_into("<I", b, 1024 + 40, 32)
    b[1080:1082] = b"\x53\xef"
    struct.pack_into("<I", b, 2048 + 8, 5)
    at, rows = 12, b""

    def inode(n, mode, size, blocks):
        struct.pack_into("<H", b, 5 * 1024 + (n - 1) * 128, mode)
        struct.pack_into("<I", b, 5 * 1024 + (n - 1) * 128 + 4, size)
        struct.pack_into(f"<{len(blocks)}I", b, 5 * 1024 + (n - 1) * 128 + 40, *blocks)

    for i, (name, data) in enumerate(files):
        blocks = []
        for k in range(0, len(data), 1024):
            part = data[k : k + 1024]
            if part.count(0) == len(part):
                blocks.append(0)
                continue
            b[at * 1024 : at * 1024 + len(part)] = part
            blocks.append(at)
            at += 1
        direct = blocks[:12]
        if len(blocks) > 12:
            struct.pack_into(f"<{len(blocks) - 12}I", b, at * 1024, *blocks[12:])
            direct.append(at)
            at += 1
        inode(12 + i, 0x81A4, len(data), direct)
        rows += struct.pack("<IHBB", 12 + i, 8 + len(name) + -len(name) % 4, len(name), 1) + name.encode() + bytes(-len(name) % 4)
    b[at * 1024 : at * 1024 + len(rows)] = rows
    inode(2, 0x41ED, len(rows), [at])
    return bytes(b)


def test_ext2():
    files = [("small", b"abc"), ("holes.bin", b"x" * 1024 + bytes(1024) + b"y" * 100), ("long", b"z" * 14_500)]
    assert [(p, d) for p, _, d in D.ext2_decode(ext2(files))] == files


def test_audio_conversions():
    v = np.array([[0, 100], [10, -7], [21, 8]], "<i2")
    a = C.Audio(100, 2, 16, v.tobytes())
    mono = C.wav_channels(a, 1)
    assert np.frombuffer(mono.samples, "<i2").tolist() == [50, 1, 14]
    assert C.wav_channels(C.wav_channels(mono, 2), 1).samples == mono.samples
    up = np.frombuffer(C.wav_resample(mono, 200).samples, "<i2")
    assert up.tolist() == [50, 25, 1, 7, 14, 14] and C.wav_seconds(a) == 0.03
    assert C.wav_resample(C.Audio(8, 1, 8, b"abc"), 16).samples == b"abc"
    with pytest.raises(C.CodecError):
        C.wav_channels(a, 6)


def test_disk_parts():
    raw = bytes(range(256)) * 32
    d = D.vhd_encode(raw, True, block=4096)
    assert D.vhd_sector(d, 3) == raw[1536:2048] and D.vhd_verified(d)
    c = D.chd_with_metadata(D.chd_encode(raw, 2048), [("CHTR", b"TRACK:1"), ("GDDD", b"x")])
    assert D.chd_metadata(c) == [("CHTR", b"TRACK:1"), ("GDDD", b"x")] and D.chd_decode(c) == raw
    f = D.fat_open(D.fat_encode(TREE))
    assert f.free()[0] == 2 + sum(1 for x in f.table[2:] if x)


def test_hunks_and_sectors_on_their_own():
    raw = bytes(range(256)) * 20 + bytes(9000) + b"tail"
    c = D.chd_encode(raw, 2048)
    assert b"".join(D.chd_hunk(c, i, True) for i in range(D.chd_size(c)[2]))[: len(raw)] == raw
    v = D.vhd_encode(raw, True, block=4096)
    disk = D.vhd_decode(v)
    assert b"".join(D.vhd_sector(v, i) for i in range(len(disk) // 512)) == disk
    assert D.vhd_sector(D.vhd_encode(raw), 1) == raw[512:1024]
    for bad in (lambda: D.chd_hunk(c, 99), lambda: D.vhd_sector(v, -1), lambda: D.chd_map(c[:130])):
        with pytest.raises(C.CodecError):
            bad()
    assert (D.crc16(b"123456789"), D.crc16(b""), D.crc16(b"12345678")) == (0x4B37, 0xFFFF, 0x37DD)
