"""Disc images and filesystems: VHD, CHD, ISO 9660, CUE/BIN, FAT32, ext2.

Clock and identity are parameters, so equal inputs give equal bytes. Trees are flat
lists of (path, is_dir, data); chains and directories are guarded against cycles, and
names that would leave a target folder are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from bytefold.functions.codecs import need

Tree = list[tuple[str, bool, bytes]]
DEEPEST = 64


def safe_path(path: str) -> str:
    parts = path.replace("\\", "/").split("/")
    need(".." not in parts and not path.startswith("/"), "INVALID_ARGUMENT")
    return "/".join(p for p in parts if p not in ("", "."))


# VHD

VHD_BLOCK = 2 << 20
_FOOTER = struct.Struct(">8sIIQI4sI4sQQIII16sB")


def geometry(size: int) -> tuple[int, int, int]:
    total = min(size // 512, 65535 * 16 * 255)
    if total >= 65535 * 16 * 63:
        return total // (16 * 255), 16, 255
    heads = max(4, (total // 17 + 1023) // 1024)
    if total // 17 < heads * 1024 and heads <= 16:
        return total // 17 // heads, heads, 17
    track = 31 if total // 31 < 16 * 1024 else 63
    return total // track // 16, 16, track


def _summed(b: bytes, at: int) -> bytes:
    return b[:at] + struct.pack(">I", ~sum(b[:at] + b[at + 4 :]) & 0xFFFFFFFF) + b[at + 4 :]


def vhd_encode(raw: bytes, dynamic: bool = False, when: int = 0, ident: bytes = bytes(16), block: int = VHD_BLOCK) -> bytes:
    raw = raw + bytes(-len(raw) % 512)
    c, h, s = geometry(len(raw))
    foot = _FOOTER.pack(b"conectix", 2, 0x10000, 512 if dynamic else 2**64 - 1, when, b"fold", 0x10000, b"Wi2k", len(raw), len(raw), c << 16 | h << 8 | s, 3 if dynamic else 2, 0, ident, 0)
    foot = _summed(foot.ljust(512, b"\0"), 64)
    if not dynamic:
        return raw + foot
    n = -(-len(raw) // block)
    head = struct.pack(">8sQQIIII", b"cxsparse", 2**64 - 1, 1536, 0x10000, n, block, 0).ljust(1024, b"\0")
    bat_size = -(-n * 4 // 512) * 512
    bitmap = b"\xff" * (-(-block // 512 // 8 // 512) * 512)
    bat, body, at = [], [], 1536 + bat_size
    for i in range(n):
        part = raw[i * block : (i + 1) * block].ljust(block, b"\0")
        if part.count(0) == len(part):
            bat.append(0xFFFFFFFF)
            continue
        bat.append(at // 512)
        body.append(bitmap + part)
        at += len(bitmap) + block
    return b"".join([foot, _summed(head, 36), struct.pack(f">{n}I", *bat).ljust(bat_size, b"\xff"), *body, foot])


def _vhd_extents(b: bytes) -> tuple[int, int, list[int]]:
    """Disk size, block size and where each block's data starts; -1: a block of zeros."""
    need(len(b) >= 512 and b[-512:-504] == b"conectix")
    f = _FOOTER.unpack_from(b, len(b) - 512)
    size, kind = f[9], f[11]
    need(kind in (2, 3), "UNSUPPORTED_CONVERSION")
    if kind == 2:
        need(len(b) - 512 >= size, "CORRUPTED_DATA")
        return size, size, [0]
    at = f[3]
    need(at + 1024 <= len(b) and b[at : at + 8] == b"cxsparse")
    table, _, n, block = struct.unpack_from(">QIII", b, at + 16)
    need(block > 0 and n >= -(-size // block) and table + 4 * n <= len(b), "CORRUPTED_DATA")
    skip = -(-block // 512 // 8 // 512) * 512
    starts = [-1 if s == 0xFFFFFFFF else s * 512 + skip for s in struct.unpack_from(f">{n}I", b, table)]
    need(all(s < 0 or s + block <= len(b) for s in starts), "CORRUPTED_DATA")
    return size, block, starts


def vhd_decode(b: bytes) -> bytes:
    """The raw disk; blocks that are not there are zeros."""
    size, block, starts = _vhd_extents(b)
    return b"".join(bytes(block) if s < 0 else b[s : s + block] for s in starts)[:size]


def vhd_sector(b: bytes, sector: int) -> bytes:
    """One sector of the disk, read on its own; of a block that is not there, zeros."""
    size, block, starts = _vhd_extents(b)
    need(0 <= sector < size // 512, "INVALID_ARGUMENT")
    i, inside = divmod(sector * 512, block)
    return bytes(512) if starts[i] < 0 else b[starts[i] + inside : starts[i] + inside + 512]


def vhd_verified(b: bytes) -> bool:
    """Whether the footer's checksum is right."""
    need(len(b) >= 512 and b[-512:-504] == b"conectix")
    foot = b[-512:]
    return _summed(foot, 64)[64:68] == foot[64:68]


# CHD

HUNK = 16384


def _crc16_step(n: int, bits: int) -> np.ndarray:
    c = np.arange(n, dtype=np.uint32)
    for _ in range(bits):
        c = c >> 1 ^ np.where(c & 1, 0xA001, 0).astype(np.uint32)
    return c


_CRC16 = [_crc16_step(1 << 16, 16).tolist(), _crc16_step(1 << 8, 8).tolist()]  # by two bytes and by one


def crc16(b: bytes) -> int:
    c, (two, one) = 0xFFFF, _CRC16
    for x in np.frombuffer(b, "<u2", len(b) // 2).tolist():
        c = two[c ^ x]
    return c >> 8 ^ one[(c ^ b[-1]) & 255] if len(b) % 2 else c


def chd_encode(raw: bytes, hunk: int = HUNK, packed: bool = True) -> bytes:
    n = -(-len(raw) // hunk)
    rows, body, at = [], [], 124 + 12 * n
    for i in range(n):
        part = raw[i * hunk : (i + 1) * hunk].ljust(hunk, b"\0")
        small = zlib.compress(part)[2:-4] if packed else part
        kind, data = (0, small) if len(small) < hunk else (1, part)
        rows.append(at.to_bytes(6, "big") + len(data).to_bytes(3, "big") + crc16(data).to_bytes(2, "big") + bytes([kind]))
        body.append(data)
        at += len(data)
    head = struct.pack(">8sII4sIIIQQQII", b"MComprHD", 124, 5, b"zlib", 0, 0, 0, len(raw), 124, 0, hunk, hunk)
    return b"".join([head.ljust(124, b"\0"), *rows, *body])


def chd_size(b: bytes) -> tuple[int, int, int]:
    """Disk size, hunk size and number of hunks."""
    need(len(b) >= 124 and b[:8] == b"MComprHD")
    size, _, _, hunk = struct.unpack_from(">QQQI", b, 32)
    need(hunk > 0, "CORRUPTED_DATA")
    return size, hunk, -(-size // hunk)


def chd_map(b: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, length, crc, kind) of each hunk; kind 0 is deflated, 1 raw, others are zeros."""
    table, n = struct.unpack_from(">Q", b, 40)[0], chd_size(b)[2]
    need(table + 12 * n <= len(b), "CORRUPTED_DATA")
    rows = (b[table + 12 * i : table + 12 * i + 12] for i in range(n))
    return [(int.from_bytes(r[:6], "big"), int.from_bytes(r[6:9], "big"), int.from_bytes(r[9:11], "big"), r[11]) for r in rows]


def _hunk(b: bytes, row: tuple[int, int, int, int], size: int, verify: bool) -> bytes:
    at, n, crc, kind = row
    data = b[at : at + n]
    need(len(data) == n and (not verify or crc16(data) == crc), "CORRUPTED_DATA")
    if kind == 0:
        try:
            data = zlib.decompressobj(-15).decompress(data)
        except zlib.error:
            need(False, "CORRUPTED_DATA")
    return data.ljust(size, b"\0")[:size] if kind < 2 else bytes(size)


def chd_hunk(b: bytes, i: int, verify: bool = False) -> bytes:
    """One hunk, read on its own."""
    rows = chd_map(b)
    need(0 <= i < len(rows), "INVALID_ARGUMENT")
    return _hunk(b, rows[i], chd_size(b)[1], verify)


def chd_decode(b: bytes, verify: bool = False) -> bytes:
    size, hunk, _ = chd_size(b)
    return b"".join(_hunk(b, row, hunk, verify) for row in chd_map(b))[:size]


def chd_metadata(b: bytes) -> list[tuple[str, bytes]]:
    """(tag, data) of the metadata chain: tag, flags and length, next offset, data."""
    need(len(b) >= 124 and b[:8] == b"MComprHD")
    at, out, seen = struct.unpack_from(">Q", b, 48)[0], [], set()
    while at and at + 16 <= len(b):
        need(at not in seen, "CORRUPTED_DATA")
        seen.add(at)
        tag, size, follow = b[at : at + 4].decode("latin-1"), int.from_bytes(b[at + 5 : at + 8], "big"), struct.unpack_from(">Q", b, at + 8)[0]
        out.append((tag, b[at + 16 : at + 16 + size]))
        at = follow
    return out


def chd_with_metadata(b: bytes, entries: list[tuple[str, bytes]]) -> bytes:
    """The image with this metadata at its end."""
    need(len(b) >= 124 and b[:8] == b"MComprHD")
    out, at = b[:48] + struct.pack(">Q", len(b) if entries else 0) + b[56:], len(b)
    for i, (tag, data) in enumerate(entries):
        at += 16 + len(data)
        out += tag.encode("latin-1")[:4].ljust(4) + b"\1" + len(data).to_bytes(3, "big") + struct.pack(">Q", at if i + 1 < len(entries) else 0) + data
    return out


# ISO 9660

SECTOR = 2048


def iso_name(name: str, is_dir: bool = False) -> str:
    out = re.sub(r"[^A-Z0-9_.]", "_", name.upper())
    out = out[:8] if "." not in out else out
    return out if is_dir else out + ";1"


def _both(n: int, size: int = 4) -> bytes:
    return n.to_bytes(size, "little") + n.to_bytes(size, "big")


def _record(name: bytes, at: int, size: int, is_dir: bool, when: bytes) -> bytes:
    body = b"\0" + _both(at) + _both(size) + when + bytes([2 * is_dir, 0, 0]) + _both(1, 2) + bytes([len(name)]) + name
    body += b"\0" * (len(body) % 2 == 0)
    return bytes([len(body) + 1]) + body


def iso_encode(tree: Tree, volume: str = "VOLUME", when: bytes = bytes([80, 1, 1, 0, 0, 0, 0])) -> bytes:
    """A volume of the tree: directories first in pre-order, then files."""
    files = {safe_path(p): d for p, is_dir, d in tree if not is_dir}
    dirs = {""} | {safe_path(p) for p, is_dir, _ in tree if is_dir} | {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
    order = sorted(dirs)
    parent = lambda p: p.rpartition("/")[0]
    under = {d: sorted(x for x in [*dirs - {""}, *files] if parent(x) == d) for d in order}
    line = lambda p: _record(iso_name(p.rpartition("/")[2], p in dirs).encode(), 0, 0, p in dirs, when)

    def span(d: str) -> int:
        at = 68
        for x in under[d]:
            n = len(line(x))
            at += n if at % SECTOR + n <= SECTOR else SECTOR - at % SECTOR + n
        return -(-at // SECTOR) * SECTOR

    place, at = {}, 18
    for p in [*order, *sorted(files)]:
        size = span(p) if p in dirs else len(files[p])
        place[p] = (at, size)
        at += -(-size // SECTOR)
    pvd = b"\1CD001\1\0" + b" " * 32 + volume.upper().encode()[:32].ljust(32) + bytes(8) + _both(at) + bytes(32) + _both(1, 2) + _both(1, 2) + _both(SECTOR, 2) + bytes(24)
    pvd += _record(b"\0", *place[""], True, when)
    out = [bytes(16 * SECTOR), pvd.ljust(SECTOR, b"\0"), b"\xffCD001\1".ljust(SECTOR, b"\0")]
    for d in order:
        body = _record(b"\0", *place[d], True, when) + _record(b"\1", *place[parent(d)], True, when)
        for x in under[d]:
            r = _record(iso_name(x.rpartition("/")[2], x in dirs).encode(), *place[x], x in dirs, when)
            body += r if len(body) % SECTOR + len(r) <= SECTOR else bytes(-len(body) % SECTOR) + r
        out.append(body.ljust(place[d][1], b"\0"))
    out += [files[p] + bytes(-len(files[p]) % SECTOR) for p in sorted(files)]
    return b"".join(out)


def iso_decode(b: bytes) -> Tree:
    at = 16 * SECTOR
    need(len(b) >= at + SECTOR and b[at + 1 : at + 6] == b"CD001")
    out: Tree = []
    seen: set[int] = set()

    def walk(place: int, size: int, above: str, depth: int) -> None:
        need(depth < DEEPEST and place not in seen, "CORRUPTED_DATA")
        seen.add(place)
        data, i = b[place * SECTOR : place * SECTOR + size], 0
        while i < len(data):
            n = data[i]
            if not n:
                i = (i // SECTOR + 1) * SECTOR
                continue
            need(n >= 34 and i + n <= len(data), "CORRUPTED_DATA")
            start, length, flags, k = *struct.unpack_from("<I4xI", data, i + 2), data[i + 25], data[i + 32]
            name = data[i + 33 : i + 33 + k]
            if name not in (b"\0", b"\1"):
                path = above + name.decode("ascii", "replace").split(";")[0].removesuffix(".")
                if flags & 2:
                    out.append((path + "/", True, b""))
                    walk(start, length, path + "/", depth + 1)
                else:
                    out.append((path, False, b[start * SECTOR : start * SECTOR + length]))
            i += n

    walk(*struct.unpack_from("<I4xI", b, at + 156 + 2), "", 0)
    return out


# CUE sheets, whole or as rows (file, type, track, mode, index, frames)

SECTOR_OF = {"MODE1/2048": 2048, "MODE2/2336": 2336, "MODE1/2352": 2352, "MODE2/2352": 2352, "AUDIO": 2352}


@dataclass
class CueTrack:
    number: int
    mode: str
    title: str = ""
    performer: str = ""
    pregap: int = 0
    postgap: int = 0
    indices: list[tuple[int, int]] = field(default_factory=list)  # (number, frames)


@dataclass
class CueSheet:
    catalog: str = ""
    performer: str = ""
    title: str = ""
    songwriter: str = ""
    files: list[tuple[str, str, list[CueTrack]]] = field(default_factory=list)  # (name, type, tracks)


def _frames(msf: str) -> int | None:
    m = re.match(r"(\d+):(\d+):(\d+)", msf)
    return (int(m[1]) * 60 + int(m[2])) * 75 + int(m[3]) if m else None


def _msf(frames: int) -> str:
    return f"{frames // 4500:02d}:{frames // 75 % 60:02d}:{frames % 75:02d}"


def cue_sheet(text: str) -> CueSheet:
    """A sheet with its metadata; unknown commands are left out, and those that need a file or track before any."""
    out, track = CueSheet(), None
    for line in text.splitlines():
        word, _, rest = line.strip().partition(" ")
        word, rest = word.upper(), rest.strip()
        plain = rest[1:-1] if len(rest) > 1 and rest[0] == rest[-1] == '"' else rest
        if word == "FILE" and (m := re.match(r'(?:"([^"]*)"|(\S+))\s*(\S*)', rest)):
            out.files.append((m[1] if m[1] is not None else m[2], m[3].upper(), []))
            track = None
        elif word == "TRACK" and out.files and (m := re.match(r"(\d+)\s+(\S+)", rest)):
            track = CueTrack(int(m[1]), m[2].upper())
            out.files[-1][2].append(track)
        elif word in ("TITLE", "PERFORMER"):
            setattr(track or out, word.lower(), plain)
        elif word in ("CATALOG", "SONGWRITER"):
            setattr(out, word.lower(), plain)
        elif track and word in ("PREGAP", "POSTGAP") and _frames(rest) is not None:
            setattr(track, word.lower(), _frames(rest))
        elif track and word == "INDEX" and (m := re.match(r"(\d+)\s+(\S+)", rest)) and _frames(m[2]) is not None:
            track.indices.append((int(m[1]), _frames(m[2])))
    return out


def cue_text(sheet: CueSheet) -> str:
    out = [f"CATALOG {sheet.catalog}"] * bool(sheet.catalog)
    out += [f'{name.upper()} "{value}"' for name in ("performer", "title", "songwriter") if (value := getattr(sheet, name))]
    for name, kind, tracks in sheet.files:
        out.append(f'FILE "{name}" {kind}')
        for t in tracks:
            out.append(f"  TRACK {t.number:02d} {t.mode}")
            out += [f'    {key.upper()} "{value}"' for key in ("title", "performer") if (value := getattr(t, key))]
            out += [f"    PREGAP {_msf(t.pregap)}"] * (t.pregap > 0)
            out += [f"    INDEX {i:02d} {_msf(at)}" for i, at in t.indices]
            out += [f"    POSTGAP {_msf(t.postgap)}"] * (t.postgap > 0)
    return "\n".join(out) + "\n"


def iso_cue(bin_name: str) -> str:
    """The sheet that goes with an ISO image kept as a BIN file: one data track."""
    return cue_text(CueSheet(files=[(bin_name, "BINARY", [CueTrack(1, "MODE1/2048", indices=[(1, 0)])])]))


def cue_decode(text: str) -> list[tuple]:
    return [(name, kind, t.number, t.mode, i, at) for name, kind, tracks in cue_sheet(text).files for t in tracks for i, at in t.indices]


def cue_encode(rows: list[tuple]) -> str:
    out, was = [], (None, None)
    for file, kind, track, mode, index, frames in rows:
        if file != was[0]:
            out.append(f'FILE "{file}" {kind}')
        if (file, track) != was:
            out.append(f"  TRACK {track:02d} {mode}")
        was = (file, track)
        out.append(f"    INDEX {index:02d} {frames // 4500:02d}:{frames // 75 % 60:02d}:{frames % 75:02d}")
    return "\n".join(out) + "\n"


def bin_data(b: bytes, mode: str = "MODE1/2352") -> bytes:
    """User data of a track's sectors; audio and MODE2/2336 have none."""
    size = SECTOR_OF.get(mode, 2048)
    if size == 2048:
        return b
    return b"".join(b[i + 16 : i + 16 + 2048] for i in range(0, len(b) - size + 1, size)) if size == 2352 and mode != "AUDIO" else b""


DISC = {"iso": (lambda b: b, lambda b: b), "bin": (lambda b: bin_data(b) if b[:12] == b"\0" + b"\xff" * 10 + b"\0" else b, lambda b: b), "vhd": (vhd_decode, vhd_encode), "chd": (chd_decode, chd_encode)}


def disc_convert(b: bytes, source: str, target: str) -> bytes:
    need(source in DISC and target in DISC and source != target, "UNSUPPORTED_CONVERSION")
    return DISC[target][1](DISC[source][0](b))


# FAT32


@dataclass
class Fat:
    data: bytes
    sector: int = 512
    per: int = 8
    reserved: int = 32
    copies: int = 2
    fat_sectors: int = 0
    root: int = 2
    table: tuple = field(default_factory=tuple)

    def chain(self, c: int) -> list[int]:
        out, seen = [], set()
        while 2 <= c < min(len(self.table), 0x0FFFFFF7):
            need(c not in seen, "CORRUPTED_DATA")
            seen.add(c)
            out.append(c)
            c = self.table[c] & 0x0FFFFFFF
        return out

    def free(self) -> list[int]:
        """Clusters that a new chain would take, in order."""
        return [c for c in range(2, len(self.table)) if not self.table[c] & 0x0FFFFFFF]

    def cluster(self, c: int) -> bytes:
        at = (self.reserved + self.copies * self.fat_sectors + (c - 2) * self.per) * self.sector
        return self.data[at : at + self.per * self.sector]

    def read(self, c: int) -> bytes:
        return b"".join(self.cluster(x) for x in self.chain(c))


def fat_name(name: str) -> bytes:
    if name in (".", ".."):
        return name.encode().ljust(11)
    base, dot, ext = name.rpartition(".")
    if not dot:
        base, ext = name, ""
    return base.upper().encode("ascii", "replace")[:8].ljust(8) + ext.upper().encode("ascii", "replace")[:3].ljust(3)


def fat_open(b: bytes) -> Fat:
    need(len(b) >= 512 and b[510:512] == b"\x55\xaa" and b[82:87] == b"FAT32")
    f = Fat(b, *struct.unpack_from("<HBHB", b, 11), *struct.unpack_from("<I", b, 36), *struct.unpack_from("<I", b, 44))
    need(f.sector >= 512 and f.per > 0 and len(b) >= (f.reserved + f.fat_sectors) * f.sector)
    f.table = struct.unpack_from(f"<{f.fat_sectors * f.sector // 4}I", b, f.reserved * f.sector)
    return f


def fat_decode(b: bytes) -> Tree:
    f, out = fat_open(b), []
    seen: set[int] = set()

    def walk(c: int, above: str, depth: int) -> None:
        need(depth < DEEPEST and c not in seen, "CORRUPTED_DATA")
        seen.add(c)
        data, long = f.read(c), []
        for i in range(0, len(data) - 31, 32):
            e = data[i : i + 32]
            if e[0] == 0:
                break
            if e[0] == 0xE5:
                long = []
                continue
            if e[11] == 0x0F:
                long.insert(0, (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].replace("￿", ""))
                continue
            name = "".join(long) or e[:8].decode("ascii", "replace").rstrip() + ("." + x if (x := e[8:11].decode("ascii", "replace").rstrip()) else "")
            long = []
            if e[11] & 8 or name in (".", ".."):
                continue
            first, size = e[20] << 16 | e[21] << 24 | e[26] | e[27] << 8, struct.unpack_from("<I", e, 28)[0]
            if e[11] & 16:
                out.append((above + name + "/", True, b""))
                walk(first, above + name + "/", depth + 1)
            else:
                out.append((above + name, False, f.read(first)[:size] if size else b""))

    walk(f.root, "", 0)
    return out


def fat_encode(tree: Tree, label: str = "VOLUME", serial: int = 0) -> bytes:
    """A volume of the tree with 8.3 names; a directory holds at most one cluster of entries."""
    files = {safe_path(p): d for p, is_dir, d in tree if not is_dir}
    dirs = {""} | {safe_path(p) for p, is_dir, _ in tree if is_dir} | {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
    size = max(32 << 20, 2 * sum(map(len, files.values())) + (16 << 20))
    unit, total = 4096, size // 512
    fat_sectors = -(-(total // 8 + 2) * 4 // 512)
    clusters, table, body, first = (total - 32 - 2 * fat_sectors) // 8, [0x0FFFFFF8, 0x0FFFFFFF], [], {}

    def take(data: bytes) -> int:
        n = max(1, -(-len(data) // unit))
        at = len(table)
        table.extend([*range(at + 1, at + n), 0x0FFFFFFF])
        body.append(data.ljust(n * unit, b"\0"))
        return at

    for d in sorted(dirs):
        first[d] = take(bytes(unit))
    where = {d: i for i, d in enumerate(sorted(dirs))}
    for p in sorted(files):
        first[p] = take(files[p]) if files[p] else 0
    entry = lambda name, c, n, kind: fat_name(name) + bytes([kind]) + bytes(8) + struct.pack("<H4xHI", c >> 16, c & 0xFFFF, n)
    for d in sorted(dirs):
        up = d.rpartition("/")[0]
        rows = [entry(".", first[d], 0, 16), entry("..", first[up] if up else 0, 0, 16)] if d else []
        for x in sorted([*dirs - {""}, *files]):
            if x.rpartition("/")[0] == d:
                rows.append(entry(x.rpartition("/")[2], first[x], 0 if x in dirs else len(files[x]), 16 if x in dirs else 32))
        need(len(rows) * 32 <= unit, "INVALID_ARGUMENT")
        body[where[d]] = b"".join(rows).ljust(unit, b"\0")
    need(len(table) - 2 <= clusters, "INVALID_ARGUMENT")
    boot = b"\xeb\x58\x90BYTEFOLD" + struct.pack("<HBHBHHBHHHII", 512, 8, 32, 2, 0, 0, 0xF8, 0, 63, 255, 0, total) + struct.pack("<IHHIHH12xBBBI", fat_sectors, 0, 0, 2, 1, 6, 0x80, 0, 0x29, serial) + label.upper().encode()[:11].ljust(11) + b"FAT32   "
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    info = (b"RRaA".ljust(484, b"\0") + b"rrAa" + struct.pack("<II", clusters - len(table) + 2, len(table))).ljust(510, b"\0") + b"\x55\xaa"
    head = (boot + info).ljust(6 * 512, b"\0") + boot
    fat = struct.pack(f"<{len(table)}I", *table).ljust(fat_sectors * 512, b"\0")
    return (head.ljust(32 * 512, b"\0") + fat * 2 + b"".join(body)).ljust(total * 512, b"\0")


# ext2, read only


def ext2_decode(b: bytes) -> Tree:
    need(len(b) >= 2048 and b[1080:1082] == b"\x53\xef")
    block = 1024 << struct.unpack_from("<I", b, 1048)[0]
    per_group = struct.unpack_from("<I", b, 1064)[0]
    revision = struct.unpack_from("<I", b, 1100)[0]
    inode_size = struct.unpack_from("<H", b, 1112)[0] if revision else 128
    groups = (1 if block > 1024 else 2) * block
    need(per_group > 0 and inode_size >= 128, "CORRUPTED_DATA")
    fetch = lambda n: b[n * block : (n + 1) * block]

    def inode(n: int) -> tuple[int, int, tuple]:
        g, i = divmod(n - 1, per_group)
        need(n > 0 and groups + 32 * g + 32 <= len(b), "CORRUPTED_DATA")
        at = struct.unpack_from("<I", b, groups + 32 * g + 8)[0] * block + i * inode_size
        need(at + 128 <= len(b), "CORRUPTED_DATA")
        return struct.unpack_from("<H", b, at)[0], struct.unpack_from("<I", b, at + 4)[0], struct.unpack_from("<15I", b, at + 40)

    def expand(n: int, level: int, want: int) -> list[int]:
        """The blocks below a pointer; a hole keeps its place."""
        if not level:
            return [n]
        each = (block // 4) ** (level - 1)
        out: list[int] = []
        for p in struct.unpack(f"<{block // 4}I", fetch(n).ljust(block, b"\0")) if n else (0,) * (block // 4):
            if len(out) >= want:
                break
            out += expand(p, level - 1, want - len(out)) if p or level == 1 else [0] * min(each, want - len(out))
        return out

    def content(size: int, pointers: tuple) -> bytes:
        want, blocks = -(-size // block), []
        for p, level in [*((p, 0) for p in pointers[:12]), *zip(pointers[12:], (1, 2, 3), strict=True)]:
            if len(blocks) < want:
                blocks += expand(p, level, want - len(blocks))
        return b"".join(fetch(x).ljust(block, b"\0") if x else bytes(block) for x in blocks[:want])[:size]

    out: Tree = []
    seen: set[int] = set()

    def walk(n: int, above: str, depth: int) -> None:
        need(depth < DEEPEST and n not in seen, "CORRUPTED_DATA")
        seen.add(n)
        _, size, pointers = inode(n)
        data, i = content(size, pointers), 0
        while i + 8 <= len(data):
            child, length, k = struct.unpack_from("<IHB", data, i)
            need(length >= 8, "CORRUPTED_DATA")
            name = data[i + 8 : i + 8 + k].decode("utf-8", "replace")
            i += length
            if not child or name in (".", ".."):
                continue
            mode, size, pointers = inode(child)
            if mode & 0xF000 == 0x4000:
                out.append((above + name + "/", True, b""))
                walk(child, above + name + "/", depth + 1)
            elif mode & 0xF000 == 0x8000:
                out.append((above + name, False, content(size, pointers)))

    walk(2, "", 0)
    return out
