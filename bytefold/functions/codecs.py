"""Byte codecs at the edge: images, audio, meshes and archives.

Each decoder takes bytes and returns a small structure, each encoder does the reverse,
and a bad input raises CodecError, which batches turn into an error column.
"""

from __future__ import annotations

import gzip as _gzip
import io
import re
import struct
import tarfile
import zipfile
import zlib
from dataclasses import dataclass, field

import numpy as np


class CodecError(ValueError):
    """An input that cannot be decoded; its text is the error code."""


def need(ok: bool, code: str = "INVALID_FORMAT") -> None:
    if not ok:
        raise CodecError(code)


# Images are (height, width, channels) arrays of RGB or RGBA bytes.


def bmp_decode(b: bytes) -> np.ndarray:
    need(len(b) >= 54 and b[:2] == b"BM")
    at, _, w, h, _, bits, method = struct.unpack_from("<IIiiHHI", b, 10)
    need(bits in (24, 32) and method == 0 and w > 0 and h != 0, "UNSUPPORTED_CONVERSION")
    c, rows = bits // 8, abs(h)
    line = (w * c + 3) // 4 * 4
    need(at + line * rows <= len(b))
    x = np.frombuffer(b, np.uint8, line * rows, at).reshape(rows, line)[:, : w * c].reshape(rows, w, c)
    x = x[::-1] if h > 0 else x
    return x[..., [2, 1, 0, 3][:c]].copy()


def bmp_encode(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    line = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, line), np.uint8)
    body[:, : w * 3] = x[::-1, :, 2::-1][:, :, :3].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + line * h, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, line * h, 2835, 2835, 0, 0) + body.tobytes()


PNG = b"\x89PNG\r\n\x1a\n"


def png_decode(b: bytes) -> np.ndarray:
    need(b[:8] == PNG)
    at, head, data = 8, None, b""
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + n]
        need(len(body) == n and zlib.crc32(kind + body) == struct.unpack_from(">I", b, at + 8 + n)[0])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
        at += 12 + n
    need(head is not None)
    w, h, depth, colour, _, _, laced = head
    need(depth == 8 and colour in (0, 2, 6) and not laced, "UNSUPPORTED_CONVERSION")
    c = {0: 1, 2: 3, 6: 4}[colour]
    try:
        raw = zlib.decompressobj(-15).decompress(data[2:])  # the trailing checksum is not looked at
    except zlib.error as e:
        raise CodecError("CORRUPTED_DATA") from e
    need(len(raw) >= h * (w * c + 1), "CORRUPTED_DATA")
    rows = np.frombuffer(raw, np.uint8, h * (w * c + 1)).reshape(h, -1)
    out = np.zeros((h, w * c), np.uint8)
    before = np.zeros(w * c, np.uint8)
    for y in range(h):
        before = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], before, c)
    x = out.reshape(h, w, c)
    return np.repeat(x, 3, axis=2) if c == 1 else x


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    need(kind <= 4)
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
    out = [0] * len(line)
    for i, v in enumerate(line.tolist()):
        a, b = out[i - c] if i >= c else 0, int(up[i])
        if kind == 3:
            p = (a + b) // 2
        else:
            d = int(up[i - c]) if i >= c else 0
            p = min((a, b, d), key=lambda q, e=a + b - d: abs(e - q))
        out[i] = (v + p) & 255
    return np.array(out, np.uint8)


def png_encode(x: np.ndarray, level: int = 6) -> bytes:
    h, w, c = x.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((h, w * c + 1), np.uint8)
    rows[:, 1:] = x.reshape(h, w * c)
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def tga_decode(b: bytes) -> np.ndarray:
    need(len(b) >= 18)
    skip, kind, w, h, depth, flags = b[0], b[2], *struct.unpack_from("<HH", b, 12), b[16], b[17]
    need(kind in (2, 3, 10, 11) and depth in (8, 24, 32) and w and h, "UNSUPPORTED_CONVERSION")
    c, at, size = depth // 8, 18 + skip, w * h * (depth // 8)
    if kind in (2, 3):
        need(len(b) >= at + size)
        flat = np.frombuffer(b, np.uint8, size, at)
    else:
        out = bytearray()
        while len(out) < size:
            need(at < len(b), "CORRUPTED_DATA")
            n = (b[at] & 127) + 1
            if b[at] & 128:
                out += b[at + 1 : at + 1 + c] * n
                at += 1 + c
            else:
                out += b[at + 1 : at + 1 + n * c]
                at += 1 + n * c
        flat = np.frombuffer(bytes(out[:size]), np.uint8)
        need(len(flat) == size, "CORRUPTED_DATA")
    x = flat.reshape(h, w, c)
    x = x if flags & 0x20 else x[::-1]
    return np.repeat(x, 3, axis=2) if c == 1 else x[..., [2, 1, 0, 3][:c]].copy()


def rle_encode(flat: bytes, c: int) -> bytes:
    px = np.frombuffer(flat, np.uint8).reshape(-1, c)
    if not len(px):
        return b""
    new = np.flatnonzero(np.append(True, (px[1:] != px[:-1]).any(1)))
    out, raw = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(raw), 128 * c):
            part = raw[i : i + 128 * c]
            out.append(len(part) // c - 1)
            out.extend(part)
        raw.clear()

    for a, z in zip(new, np.append(new[1:], len(px)), strict=True):
        one = px[a].tobytes()
        if z - a == 1:
            raw += one
            continue
        flush()
        for n in range(int(z - a), 0, -128):
            out.append(127 + min(n, 128))
            out += one
    flush()
    return bytes(out)


def tga_encode(x: np.ndarray, packed: bool = True) -> bytes:
    h, w, c = x.shape
    flat = x[..., [2, 1, 0, 3][:c]].tobytes()
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if packed else 2, 0, 0, 0, 0, 0, w, h, 8 * c, 0x20)
    return head + (rle_encode(flat, c) if packed else flat)


def netpbm_decode(b: bytes) -> np.ndarray:
    need(len(b) >= 7 and b[:1] == b"P" and b[1:2] in b"123456")
    kind, fields, at = b[1] - 48, [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n?)*(\d+)").match(b, at)
        need(m is not None)
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = (*fields, 1)[:3]
    need(w > 0 and h > 0 and 0 < top <= 65535)
    at += b[at : at + 1] in (b" ", b"\n", b"\r")
    c = 3 if kind in (3, 6) else 1
    if kind <= 3:
        text = re.sub(rb"#[^\n]*", b"", b[at:])
        v = np.array(re.findall(rb"[01]" if kind == 1 else rb"\d+", text)[: w * h * c], dtype=np.int64)
        need(len(v) == w * h * c, "CORRUPTED_DATA")
        v = (1 - v) * 255 if kind == 1 else v * 255 // top
    elif kind == 4:
        line = (w + 7) // 8
        need(len(b) >= at + line * h, "CORRUPTED_DATA")
        v = (1 - np.unpackbits(np.frombuffer(b, np.uint8, line * h, at).reshape(h, line), axis=1)[:, :w].astype(np.int64)) * 255
    else:
        need(len(b) >= at + w * h * c, "CORRUPTED_DATA")
        v = np.frombuffer(b, np.uint8, w * h * c, at)
    x = v.astype(np.uint8).reshape(h, w, c)
    return np.repeat(x, 3, axis=2) if c == 1 else x


def luminance(x: np.ndarray) -> np.ndarray:
    r, g, b = (x[..., i].astype(float) for i in range(3))
    return (0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def netpbm_encode(x: np.ndarray, kind: str = "ppm", binary: bool = True) -> bytes:
    h, w = x.shape[:2]
    number = {"pbm": 1, "pgm": 2, "ppm": 3}[kind] + 3 * binary
    head = f"P{number}\n{w} {h}\n" + ("" if kind == "pbm" else "255\n")
    v = x[..., :3] if kind == "ppm" else luminance(x)
    if kind == "pbm":
        v = (v < 128).astype(np.uint8)
        if binary:
            return head.encode() + np.packbits(v, axis=1).tobytes()
    if binary:
        return head.encode() + v.tobytes()
    return (head + "".join(" ".join(map(str, row.ravel())) + "\n" for row in v)).encode()


IMAGE_IN = {"bmp": bmp_decode, "png": png_decode, "tga": tga_decode, "ppm": netpbm_decode, "pgm": netpbm_decode, "pbm": netpbm_decode}


def image_encode(x: np.ndarray, kind: str, quality: int = 85) -> bytes:
    if kind == "tga":
        return tga_encode(x, quality >= 80)
    if kind in ("ppm", "pgm", "pbm"):
        return netpbm_encode(x, kind)
    return {"bmp": bmp_encode, "png": png_encode}[kind](x)


def image_transform(x: np.ndarray, flip_h: bool = False, flip_v: bool = False, degrees: int = 0, width: int = 0, height: int = 0, method: str = "bilinear", keep_aspect: bool = True) -> np.ndarray:
    """Flips, rotation, resize, in that order; 32-bit floats and truncation throughout."""
    f = np.float32
    x = x[:, ::-1] if flip_h else x
    x = x[::-1] if flip_v else x
    need(degrees % 90 == 0, "INVALID_ARGUMENT")
    x = np.rot90(x, -(degrees % 360) // 90)
    if not width and not height:
        return np.ascontiguousarray(x)
    h, w = x.shape[:2]
    nw, nh = width or w, height or h
    if keep_aspect:
        aspect = f(w) / f(h)
        if f(nw) / f(nh) > aspect:
            nw = max(1, int(f(nh) * aspect))
        else:
            nh = max(1, int(f(nw) / aspect))
    gx, gy = np.arange(nw, dtype=f), np.arange(nh, dtype=f)
    if method == "nearest":
        return x[np.minimum((gy * (f(h) / f(nh))).astype(int), h - 1)][:, np.minimum((gx * (f(w) / f(nw))).astype(int), w - 1)]
    sx, sy = gx * (f(w - 1) / f(nw)), gy * (f(h - 1) / f(nh))
    x0, y0 = sx.astype(int), sy.astype(int)
    p = x.astype(f)
    if method == "bilinear":
        tx, ty = (sx - x0.astype(f))[None, :, None], (sy - y0.astype(f))[:, None, None]
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        top = p[y0][:, x0] + (p[y0][:, x1] - p[y0][:, x0]) * tx
        low = p[y1][:, x0] + (p[y1][:, x1] - p[y1][:, x0]) * tx
        return np.clip((top + (low - top) * ty).astype(int), 0, 255).astype(np.uint8)
    need(method == "bicubic", "INVALID_ARGUMENT")
    kernel = lambda t: np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0)).astype(f)
    total, weight = np.zeros((nh, nw, x.shape[2]), f), np.zeros((nh, nw, 1), f)
    for j in range(-1, 3):
        for i in range(-1, 3):
            k = kernel(np.abs(sy - (y0 + j).astype(f)))[:, None, None] * kernel(np.abs(sx - (x0 + i).astype(f)))[None, :, None]
            total += p[np.clip(y0 + j, 0, h - 1)][:, np.clip(x0 + i, 0, w - 1)] * k
            weight += k
    return np.clip((total / weight).astype(int), 0, 255).astype(np.uint8)


# Audio


@dataclass
class Audio:
    rate: int = 44100
    channels: int = 2
    bits: int = 16
    samples: bytes = b""


def wav_decode(b: bytes) -> Audio:
    need(len(b) >= 44 and b[:4] == b"RIFF" and b[8:12] == b"WAVE")
    at, out, seen = 12, Audio(), False
    while at + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        if kind == b"fmt ":
            need(n >= 16 and at + 24 <= len(b))
            tag, out.channels, out.rate, _, _, out.bits = struct.unpack_from("<HHIIHH", b, at + 8)
            need(tag in (1, 3), "UNSUPPORTED_CONVERSION")
            seen = True
        elif kind == b"data":
            out.samples = b[at + 8 : at + 8 + n]  # a cut file gives what is there
            need(seen)
            return out
        at += 8 + n + n % 2
    raise CodecError("INVALID_FORMAT")


def wav_encode(a: Audio) -> bytes:
    step = a.channels * a.bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(a.samples), b"WAVE", b"fmt ", 16, 1, a.channels, a.rate, a.rate * step, step, a.bits, b"data", len(a.samples)) + a.samples


def wav_seconds(a: Audio) -> float:
    step = a.channels * a.bits // 8
    return len(a.samples) // step / a.rate if step and a.rate else 0.0


def wav_resample(a: Audio, rate: int) -> Audio:
    """Linear interpolation of 16-bit samples; other depths are copied under the new rate."""
    need(bool(a.samples) and rate > 0, "INVALID_PARAMETER")
    if a.bits != 16:
        return Audio(rate, a.channels, a.bits, a.samples)
    step = a.channels * 2
    v = np.frombuffer(a.samples, "<i2", len(a.samples) // step * a.channels).reshape(-1, a.channels).astype(np.int64)
    pos = np.arange(int(len(v) * (rate / a.rate))) / (rate / a.rate)
    at = pos.astype(np.int64)
    first, second = v[at], v[np.minimum(at + 1, len(v) - 1)]
    out = np.trunc(first + (second - first) * (pos - at)[:, None])
    return Audio(rate, a.channels, 16, out.astype("<i2").tobytes())


def wav_channels(a: Audio, channels: int) -> Audio:
    """Between mono and stereo, 16-bit; halves are cut toward zero."""
    need(bool(a.samples) and channels > 0, "INVALID_PARAMETER")
    need({a.channels, channels} <= {1, 2}, "UNSUPPORTED_CONVERSION")
    if a.channels == channels:
        return a
    need(a.bits == 16, "UNSUPPORTED_CONVERSION")
    v = np.frombuffer(a.samples, "<i2", len(a.samples) // (2 * a.channels) * a.channels).reshape(-1, a.channels).astype(np.int64)
    out = np.repeat(v, 2, axis=1) if channels == 2 else np.trunc(v.sum(1, keepdims=True) / 2)
    return Audio(a.rate, channels, 16, out.astype("<i2").tobytes())


# Meshes: (n, 4, 3) float32 arrays, a normal and three vertices for each triangle


@dataclass
class Mesh:
    name: str = ""
    triangles: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 3), np.float32))


def _normals(v: np.ndarray) -> np.ndarray:
    n = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return np.where(size < 1e-6, 0, n / np.maximum(size, 1e-30)).astype(np.float32)


def stl_decode(b: bytes) -> Mesh:
    head = b[:100]
    line = head.find(b"\n")
    if head.startswith(b"solid") and line >= 0 and all(c >= 32 or c in (9, 13) for c in head[:line]):
        text = b.decode("utf-8", "replace")
        number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
        found = re.findall(rf"(?:normal|vertex)\s+({number})\s+({number})\s+({number})", text)
        need(len(found) >= 4)
        t = np.array(found[: len(found) // 4 * 4], np.float32).reshape(-1, 4, 3)
        name = text.split("\n", 1)[0][5:].strip()
        return Mesh(name, t)
    need(len(b) >= 84)
    n = struct.unpack_from("<I", b, 80)[0]
    need(len(b) >= 84 + 50 * n)
    kind = np.dtype([("t", "<f4", (4, 3)), ("a", "<u2")])
    return Mesh(b[:80].split(b"\0")[0].decode("utf-8", "replace"), np.frombuffer(b, kind, n, 84)["t"].copy())


def stl_encode(m: Mesh, text: bool = True) -> bytes:
    if not text:
        rows = np.zeros(len(m.triangles), np.dtype([("t", "<f4", (4, 3)), ("a", "<u2")]))
        rows["t"] = m.triangles
        return (m.name or "Binary STL").encode()[:79].ljust(80, b"\0") + struct.pack("<I", len(rows)) + rows.tobytes()
    name, three = m.name or "mesh", lambda v: " ".join(f"{float(x):g}" for x in v)
    out = [f"solid {name}"]
    for t in m.triangles:
        out += [f"  facet normal {three(t[0])}", "    outer loop", *(f"      vertex {three(v)}" for v in t[1:]), "    endloop", "  endfacet"]
    return ("\n".join([*out, f"endsolid {name}"]) + "\n").encode()


def obj_decode(b: bytes) -> Mesh:
    points: list[list[float]] = []
    normals: list[list[float]] = []
    tris, name = [], ""
    for line in b.decode("utf-8", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] in ("v", "vn") and len(w) >= 4:
            try:
                (points if w[0] == "v" else normals).append([float(x) for x in w[1:4]])
            except ValueError as e:
                raise CodecError("INVALID_FORMAT") from e
        elif w[0] == "o" and len(w) > 1:
            name = w[1]
        elif w[0] == "f":
            corner = []
            for t in w[1:]:
                p = (t.split("/") + ["", ""])[:3]
                index = lambda s, n: None if not re.fullmatch(r"-?\d+", s) or not int(s) else int(s) - 1 if int(s) > 0 else n + int(s)
                corner.append((index(p[0], len(points)), index(p[2], len(normals))))
            for i in range(1, len(corner) - 1):
                three = [corner[0], corner[i], corner[i + 1]]
                if all(v is not None and 0 <= v < len(points) for v, _ in three):
                    v = np.array([points[v] for v, _ in three], np.float32)
                    k = three[0][1]
                    normal = np.array(normals[k], np.float32) if k is not None and 0 <= k < len(normals) else _normals(v[None])[0]
                    tris.append(np.vstack([normal, v]))
    need(bool(tris))
    return Mesh(name, np.array(tris, np.float32))


def _near(points: np.ndarray, cell: float = 1e-5) -> tuple[list[np.ndarray], list[int]]:
    """Points without those within `cell` in every axis of an earlier kept one, and each point's number; by grid cells, first match."""
    grid: dict = {}
    kept: list[np.ndarray] = []
    index = []
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    for p in points:
        c = tuple(np.floor(p.astype(float) / cell).astype(np.int64))
        near = [n for d in around for n in grid.get((c[0] + d[0], c[1] + d[1], c[2] + d[2]), ()) if (np.abs(kept[n] - p) < np.float32(cell)).all()]
        if near:
            index.append(min(near))
        else:
            grid.setdefault(c, []).append(len(kept))
            index.append(len(kept))
            kept.append(p)
    return kept, index


def obj_encode(m: Mesh) -> bytes:
    points, at = _near(m.triangles[:, 1:].reshape(-1, 3))
    normals, turned = _near(m.triangles[:, 0])
    three = lambda v: " ".join(f"{float(x):g}" for x in v)
    out = ["# Wavefront OBJ file", f"o {m.name or 'mesh'}", "", *(f"v {three(p)}" for p in points), "", *(f"vn {three(p)}" for p in normals), ""]
    out += ["f " + " ".join(f"{at[3 * i + k] + 1}//{turned[i] + 1}" for k in range(3)) for i in range(len(m.triangles))]
    return ("\n".join(out) + "\n").encode()


# Archives: lists of Entry


@dataclass
class Entry:
    name: str
    data: bytes = b""
    mode: int = 0o644
    uid: int = 1000
    gid: int = 1000
    mtime: int = 0
    kind: str = "0"


def gzip_encode(b: bytes, level: int = 6, mtime: int = 0) -> bytes:
    return _gzip.compress(b, level, mtime=mtime)


def gzip_decode(b: bytes) -> bytes:
    """The first member; checksum and size are verified."""
    try:
        z = zlib.decompressobj(31)
        out = z.decompress(b) + z.flush()
    except zlib.error as e:
        raise CodecError("CORRUPTED_DATA") from e
    need(z.eof, "CORRUPTED_DATA")
    return out


def tar_encode(entries: list[Entry]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for e in entries:
            info = tarfile.TarInfo(e.name)
            info.size, info.mode, info.uid, info.gid, info.mtime, info.type = len(e.data), e.mode, e.uid, e.gid, e.mtime, e.kind.encode()
            t.addfile(info, io.BytesIO(e.data))
    return out.getvalue()


def tar_decode(b: bytes) -> list[Entry]:
    """All entries; data of regular ones. A bad first header gives none."""
    try:
        with tarfile.open(fileobj=io.BytesIO(b)) as t:
            return [Entry(i.name, t.extractfile(i).read() if i.isreg() else b"", i.mode, i.uid, i.gid, int(i.mtime), (i.type if i.type != b"\0" else b"0").decode()) for i in t]
    except tarfile.TarError:
        return []


def zip_encode(entries: list[Entry], level: int = 6, when: tuple = (1980, 1, 1, 0, 0, 0)) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for e in entries:
            z.writestr(zipfile.ZipInfo(e.name, when), e.data, zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, level or None)
    return out.getvalue()


def zip_decode(b: bytes) -> list[Entry]:
    """Entries stored or deflated; others are left out. A bad checksum is an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            return [Entry(i.filename, z.read(i)) for i in z.infolist() if i.compress_type in (0, 8)]
    except (zipfile.BadZipFile, zlib.error) as e:
        raise CodecError("CORRUPTED_DATA") from e


def archive_convert(b: bytes, source: str, target: str, quality: int = 85, unwrap: bool = False) -> bytes:
    """One archive format to another. unwrap: a gzip that holds a tar is read as one."""
    short = {"gzip": "gz", "tar.gz": "tgz"}
    source, target = short.get(source, source), short.get(target, target)
    level = 9 if quality >= 90 else quality // 10
    raw, entries = None, None
    if source == "gz":
        raw = gzip_decode(b)
        if unwrap and raw[257:262] == b"ustar":
            entries = tar_decode(raw)
    elif source == "tar":
        entries = tar_decode(b)
    elif source == "tgz":
        entries = tar_decode(gzip_decode(b))
    elif source == "zip":
        entries = zip_decode(b)
    else:
        raise CodecError("UNSUPPORTED_CONVERSION")
    if target == "gz":
        need(raw is not None, "UNSUPPORTED_CONVERSION")
        return gzip_encode(raw, level)
    entries = [Entry("data.bin", raw)] if entries is None else entries
    if target == "zip":
        return zip_encode([e for e in entries if e.kind == "0"], level)
    need(target in ("tar", "tgz"), "UNSUPPORTED_CONVERSION")
    return tar_encode(entries) if target == "tar" else gzip_encode(tar_encode(entries), level)


def lz77_tokens(b: bytes, window: int = 32768, longest: int = 258, tries: int = 128) -> list[tuple[int, int, int, int]]:
    """(position, literal or -1, length, distance) by greedy hash-chain matching."""
    out, chains, i = [], {}, 0
    while i < len(b):
        best, far = 0, 0
        for j in reversed(chains.get(b[i : i + 3], [])[-tries:]):
            if i - j > window:
                break
            n = 3
            while n < longest and i + n < len(b) and b[j + n] == b[i + n]:
                n += 1
            if n > best:
                best, far = n, i - j
                if best >= 128:
                    break
        step = best if best >= 3 else 1
        out.append((i, b[i] if step == 1 else -1, 0 if step == 1 else best, 0 if step == 1 else far))
        for k in range(i, min(i + step, len(b) - 2)):
            chains.setdefault(b[k : k + 3], []).append(k)
        i += step
    return out
