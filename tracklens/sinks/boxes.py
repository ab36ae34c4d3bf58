"""Writers of MP4 metadata: timed-metadata tracks and spherical boxes. One file at a time, on bytes."""

from __future__ import annotations

import struct

import numpy as np

from ..operators.camm import LAYOUT, SIZE, TIMESCALE
from ..sources.mp4 import CONTAINERS, BoxError, boxes, track

#: Id of the spherical V1 box, sample entries that take sv3d, codecs' names, unity matrix.
SPHERICAL_UUID = bytes.fromhex("ffcc8263f8554a938814587a02521fdd")
VIDEO_ENTRIES = {b"avc1", b"avc3", b"hvc1", b"hev1", b"mp4v", b"av01", b"vp09", b"apcn", b"apch"}
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
GENERATOR = "tracklens"
SPHERICAL_XML = (
    '<?xml version="1.0"?><rdf:SphericalVideo xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:GSpherical="http://ns.google.com/videos/1.0/spherical/">'
    "<GSpherical:Spherical>true</GSpherical:Spherical><GSpherical:Stitched>true</GSpherical:Stitched>"
    f"<GSpherical:StitchingSoftware>{GENERATOR}</GSpherical:StitchingSoftware><GSpherical:ProjectionType>equirectangular</GSpherical:ProjectionType></rdf:SphericalVideo>"
)


def box(typ: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, typ, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, typ) + body


def full(typ: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(typ, struct.pack(">I", version << 24 | flags), *parts)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


class Tree:
    """A file's boxes with content that can change; sizes follow from it when written."""

    def __init__(self, typ: bytes, raw: bytes, lead: bytes = b"", children: list[Tree] | None = None):
        self.typ, self.raw, self.lead, self.children = typ, raw, lead, children

    @classmethod
    def parse(cls, buf: bytes) -> list[Tree]:
        out = []
        for _, _, typ, off, size, head in boxes(buf, deep=False):
            body = buf[off + head : off + size]
            if typ in CONTAINERS:
                skip = 4 if typ == b"meta" else 0
                out.append(cls(typ, b"", body[:skip], cls.parse(body[skip:])))
            else:
                out.append(cls(typ, body))
        if sum(len(x.write()) for x in out) < len(buf) - 8 * len(out) - 16:
            raise BoxError("the file does not end with a whole box")
        return out

    def write(self) -> bytes:
        return box(self.typ, self.lead, *([c.write() for c in self.children] if self.children is not None else [self.raw]))

    def find(self, *path: bytes) -> Tree | None:
        here: Tree | None = self
        for typ in path:
            here = next((c for c in (here.children or []) if c.typ == typ), None) if here else None
        return here


def _top(buf: bytes) -> tuple[list[tuple[bytes, bytes]], Tree]:
    """(the boxes before and around moov as bytes, moov)."""
    rest, moov = [], None
    for _, _, typ, off, size, head in boxes(buf, deep=False):
        if typ == b"moov" and moov is None:
            moov = Tree.parse(buf[off : off + size])[0]
        else:
            rest.append((typ, buf[off : off + size]))
    if moov is None:
        raise BoxError("box 'moov' not found")
    return rest, moov


def _chunk_shift(buf: bytes) -> tuple[int, int]:
    """(offset of moov, its size): chunks behind it move forward when moov goes to the end."""
    return next((off, size) for _, _, typ, off, size, _ in boxes(buf, deep=False) if typ == b"moov")


def _move_chunks(moov: Tree, behind: int, by: int) -> None:
    for trak in (c for c in moov.children if c.typ == b"trak"):
        stbl = trak.find(b"mdia", b"minf", b"stbl")
        for b in stbl.children if stbl else []:
            if b.typ in (b"stco", b"co64"):
                kind = "I" if b.typ == b"stco" else "Q"
                n = struct.unpack_from(">I", b.raw, 4)[0]
                at = struct.unpack_from(f">{n}{kind}", b.raw, 8)
                b.raw = b.raw[:8] + struct.pack(f">{n}{kind}", *(x - by if x > behind else x for x in at))


def relocated(buf: bytes) -> tuple[bytes, Tree]:
    """(everything but moov, moov with chunk offsets that fit when it follows)."""
    rest, moov = _top(buf)
    at, size = _chunk_shift(buf)
    _move_chunks(moov, at, size)
    return b"".join(x for _, x in rest), moov


def runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(x) for x in out]


def head(typ: bytes, n: int) -> bytes:
    """The header of a box around n bytes."""
    return struct.pack(">I4sQ", 1, typ, n + 16) if n + 8 > 0xFFFFFFFF else struct.pack(">I4s", n + 8, typ)


def packet_track(moov: Tree, at: int, n: int, size: int, counts: np.ndarray, durations: np.ndarray, timescale: int = TIMESCALE) -> bytes:
    """The header of the mdat box, at byte `at`, of n packets of one size that last durations, counts times each; moov gets their track.

    Of moov only the movie header is needed. Times that four bytes do not hold are written with eight.
    """
    mvhd = moov.find(b"mvhd")
    if mvhd is None:
        raise BoxError("the movie has no header box")
    movie_scale = struct.unpack_from(">I", mvhd.raw, 20 if mvhd.raw[0] == 1 else 12)[0]
    track_id = struct.unpack(">I", mvhd.raw[-4:])[0]
    mvhd.raw = mvhd.raw[:-4] + u32(track_id + 1)
    before = head(b"mdat", n * size)
    first = at + len(before)
    steps = np.stack([counts, durations], 1).astype(np.int64)
    if steps.min() < 0 or steps.max() > 0xFFFFFFFF:
        raise BoxError("a duration or count does not fit its table")
    total = int(steps.prod(1).sum())
    whole = round(total / timescale * movie_scale)
    place = full(b"stco", u32(1, first)) if first + n * size <= 0xFFFFFFFF else full(b"co64", u32(1), struct.pack(">Q", first))
    entry = box(b"camm", bytes(6), struct.pack(">H", 1))
    stbl = box(b"stbl", full(b"stsd", u32(1), entry), full(b"stts", u32(len(steps)), steps.astype(">u4").tobytes()), full(b"stsc", u32(1, 1, n, 1)), full(b"stsz", u32(size, n)), place)
    minf = box(b"minf", full(b"nmhd"), box(b"dinf", full(b"dref", u32(1), full(b"url ", flags=1))), stbl)
    hdlr = full(b"hdlr", u32(0), b"camm", bytes(12), b"CameraMetadataMotionHandler\0")
    times = full(b"mdhd", u32(0, 0, timescale, total), struct.pack(">HH", 0x55C4, 0)) if total <= 0xFFFFFFFF else full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, total, 0x55C4, 0), version=1)
    lead = u32(0, 0, track_id, 0, whole) if whole <= 0xFFFFFFFF else struct.pack(">QQIIQ", 0, 0, track_id, 0, whole)
    tkhd = full(b"tkhd", lead, u32(0, 0), bytes(8), UNITY, u32(0, 0), flags=7, version=int(whole > 0xFFFFFFFF))
    moov.children += Tree.parse(box(b"trak", tkhd, box(b"mdia", times, hdlr, minf)))
    return before


def with_packets(moov: Tree, at: int, packets: list[bytes], durations: list[int], timescale: int = TIMESCALE) -> bytes:
    """The mdat box of the packets, which begins at byte `at`; moov gets their track. No packets is an error."""
    if not packets:
        raise BoxError("no packets to write")
    steps = np.array(runs(durations), np.int64)
    return packet_track(moov, at, len(packets), len(packets[0]), steps[:, 0], steps[:, 1], timescale) + b"".join(packets)


def add_packets(buf: bytes, packets: list[bytes], durations: list[int], timescale: int = TIMESCALE) -> bytes:
    """The file with a track of packets (60 bytes each) appended; moov goes to the end."""
    media, moov = relocated(buf)
    return media + with_packets(moov, len(media), packets, durations, timescale) + moov.write()


def read_packets(buf: bytes) -> list[tuple[int, tuple]]:
    """(pts, fields) of every packet, by an independent walk of the tables."""
    for _, _, typ, off, size, head in boxes(buf):
        if typ == b"trak" and (t := track(buf, off, size, head))["handler"] == "camm":
            at, out, pts = t["chunk_offsets"][0], [], 0
            times = [d for n, d in t["stts"] for _ in range(n)]
            for n, d in zip(t["sizes"], times, strict=True):
                out.append((pts, struct.unpack(LAYOUT, buf[at : at + n]) if n == SIZE else ()))
                at, pts = at + n, pts + d
            return out
    return []


def spherical_track(trak: Tree) -> bool:
    """sv3d in the sample entry of a video track and the V1 XML at its end; False if it is no video track."""
    hdlr, stsd = trak.find(b"mdia", b"hdlr"), trak.find(b"mdia", b"minf", b"stbl", b"stsd")
    if hdlr is None or hdlr.raw[8:12] != b"vide":
        return False
    if stsd is None or stsd.raw[12:16] not in VIDEO_ENTRIES:
        raise BoxError("the video track's sample entry is not known")
    proj = box(b"proj", full(b"prhd", struct.pack(">3i", 0, 0, 0)), full(b"equi", u32(0, 0, 0, 0)))
    sv3d = box(b"sv3d", full(b"svhd", GENERATOR.encode() + b"\0"), proj)
    n = struct.unpack_from(">I", stsd.raw, 8)[0]
    stsd.raw = stsd.raw[:8] + u32(n + len(sv3d)) + stsd.raw[12 : 8 + n] + sv3d + stsd.raw[8 + n :]
    trak.children.append(Tree(b"uuid", SPHERICAL_UUID + SPHERICAL_XML.encode()))
    return True


def with_spherical(moov: Tree) -> None:
    """sv3d in the first video track's sample entry and the V1 XML at that track's end."""
    if not any(spherical_track(c) for c in moov.children if c.typ == b"trak"):
        raise BoxError("no video track")


def add_spherical(buf: bytes) -> bytes:
    media, moov = relocated(buf)
    with_spherical(moov)
    return media + moov.write()


def spherical_xml(buf: bytes) -> str | None:
    for _, _, typ, off, size, head in boxes(buf):
        if typ == b"uuid" and buf[off + head : off + head + 16] == SPHERICAL_UUID:
            return buf[off + head + 16 : off + size].decode()
    return None
