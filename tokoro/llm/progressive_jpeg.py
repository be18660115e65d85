"""Media columns as progressive JPEG: a lossless carrier of bytes in DCT coefficients, and a
decoder to full-resolution RGB.

Carrier. Sixty-four payload bytes are the quantised coefficients of a block, in zigzag
order, each byte plus ``OFFSET`` (so none is zero); blocks fill luma in raster order, then
both chroma planes, which have half the resolution (4:2:0); unused blocks are zero. The
file holds ten scans: DC and AC bands first without their low bits (spectral selection,
successive approximation), then one bit at a time. A comment segment holds the payload's
length.

Decoder. For any baseline-precision progressive file of Huffman-coded scans: scans are
accumulated into coefficient arrays. Many files are decoded at once: the first scans in
lock step over all restart intervals, refinements a block a step (their correction bits
are then read all at once), blocks with coefficients that become non-zero late one by one.
The inverse transform is done in exact integers (so equal files give equal pixels whatever
they are batched with), chroma is doubled by replication, and colours are converted with
16-bit fixed-point factors.

Defined results: null text is empty, whose payload is 192 spaces; repeated rows give a
row each, equal texts equal values; an empty table gives no rows; other columns are
ignored. One text holds at most 65,535 x 65,535 pixels' worth, over 6 GB.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tokoro.llm.common import id_and_text, map_arrow, shared_dir, written

UNIT, OFFSET, RESTART = 192, 4, 8
#: Texts are coded, and files decoded, together up to so many bytes.
GROUP, DECODED = 1 << 20, 2 << 20
#: Rows that a worker looks at to form such groups.
ROWS = 4096
#: (components, first and last coefficient, bits known before, bits left out)
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2),
    ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
)
#: Symbols by code length for: DC, luma AC, chroma AC, refinement (class, id, {length: symbols}).
TABLES = (
    (0, 0, {2: [0, 4, 5], 3: [3], 4: [6], 5: [2], 6: [1], 7: [7], 8: [8], 9: [9]}),
    (1, 0, {1: [5], 2: [4], 3: [6], 4: [7], 5: [0], 6: [3], 7: [2], 8: [1], 9: [8], 10: [9]}),
    (1, 1, {1: [6], 2: [5], 3: [7], 4: [8], 5: [0], 6: [4], 7: [3], 8: [2], 9: [1], 10: [9]}),
    (1, 2, {1: [0]}),
)


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def codes(lengths: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length): the standard's canonical numbering."""
    out, code, last = {}, 0, 0
    for length in sorted(lengths):
        code <<= length - last
        last = length
        for symbol in lengths[length]:
            out[symbol] = (code, length)
            code += 1
    return out


@functools.lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: length of the code it begins with (0: none), its symbol."""
    size, symbol = np.zeros(65536, "i8"), np.zeros(65536, "i8")
    at, lengths = 0, {}
    for length, n in enumerate(counts, 1):
        if n:
            lengths[length] = list(symbols[at : at + n])
        at += n
    for s, (code, length) in codes(lengths).items():
        own = slice(code << 16 - length, code + 1 << 16 - length)
        size[own], symbol[own] = length, s
    return size, symbol


# ---- encoding


def layout(n: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units that hold n payload bytes."""
    units = -(-n // 384)
    columns = math.isqrt(units - 1) + 1
    return columns, -(-units // columns)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.lru_cache(maxsize=1)
def _tables_segment() -> bytes:
    body = b""
    for kind, ident, lengths in TABLES:
        counts = [len(lengths.get(i, ())) for i in range(1, 17)]
        body += bytes([kind << 4 | ident, *counts, *(s for i in sorted(lengths) for s in lengths[i])])
    return segment(0xC4, body)


def _table_of(scan: tuple) -> int:
    comps, first, _, known, _ = scan
    return 0 if not first else 2 if known else int(comps[0] > 0)


def header(n: int, columns: int, rows: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xFE, b"payload=%d" % n) + segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC2, frame) + _tables_segment()


def scan_header(scan: tuple) -> bytes:
    comps, first, last, known, left = scan
    table = _table_of(scan)
    restart = 0 if known else RESTART
    body = bytes([len(comps), *(x for c in comps for x in (c + 1, table)), first, last, known << 4 | left])
    return segment(0xDD, struct.pack(">H", restart)) + segment(0xDA, body)


def pack(value: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings (values of given sizes, 32 bits at most) put together; after each index
    in ``ends`` the last byte is filled with ones. The bytes, and where each part ends."""
    total = np.cumsum(size)
    raw = total[ends - 1] - np.r_[0, total[ends[:-1] - 1]]
    whole = (raw + 7) // 8
    byte_ends = np.cumsum(whole)
    shift = np.r_[0, byte_ends[:-1]] * 8 - np.r_[0, total[ends[:-1] - 1]]
    at = total - size + np.repeat(shift, np.diff(np.r_[0, ends]))
    word, place = at >> 5, at & 31
    shifted = value.astype("u8") << (64 - place - size).astype("u8")
    n = (int(byte_ends[-1]) + 11) // 4
    # Bits of different strings never overlap, so sums are unions; below 2^53 they are exact.
    out = np.bincount(word, (shifted >> np.uint64(32)).astype("f8"), n) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype("f8"), n)
    data = out.astype("u8").astype(">u4").view("u1")
    short = whole * 8 - raw
    data[byte_ends - 1] |= ((1 << short) - 1).astype("u1")
    return data, byte_ends


@functools.lru_cache(maxsize=8)
def _value_codes(table: int, is_dc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bit string and size of a value's category code and extra bits, by value + 1024."""
    code = codes(TABLES[table if is_dc else table + 1][2])
    bits, size = np.zeros(2048, "i8"), np.zeros(2048, "i8")
    for v in range(-511, 512):
        category = abs(v).bit_length()
        if category in code and (v or is_dc):
            c, n = code[category]
            bits[v + 1024] = c << category | (v if v > 0 else v + (1 << category) - 1)
            size[v + 1024] = n + category
    return bits, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive file for each payload (a positive multiple of 192 bytes)."""
    grids = [layout(len(p)) for p in payloads]
    units = np.array([c * r for c, r in grids])
    starts = np.r_[0, np.cumsum(6 * units)]  # of each file's blocks: luma, then both chroma planes
    blocks = np.zeros((starts[-1], 64), "i8")
    used = np.zeros(starts[-1], bool)
    for k, p in enumerate(payloads):
        n = len(p) // 64
        blocks[starts[k] : starts[k] + n] = np.frombuffer(p, "u1").reshape(n, 64)
        used[starts[k] : starts[k] + n] = True
    blocks[used] += OFFSET
    plane = {0: [(s, s + 4 * u) for s, u in zip(starts, units, strict=False)]}
    plane |= {c: [(s + (3 + c) * u, s + (4 + c) * u) for s, u in zip(starts, units, strict=False)] for c in (1, 2)}
    out = [[header(len(p), *g)] for p, g in zip(payloads, grids, strict=True)]
    for scan in SCRIPT:
        comps, first, last, known, left = scan
        if first:
            rows = np.concatenate([np.arange(a, b) for a, b in plane[comps[0]]])
            per_file = np.array([b - a for a, b in plane[comps[0]]])
            own, filled = blocks[rows, first : last + 1], used[rows]
            eob, eob_size = codes(TABLES[_table_of(scan) + 1][2])[0]
            width = last - first + 1
            if known:
                # End of band at once, then one correction bit for each coefficient, 16 together.
                bits = (own >> left) & 1
                halves = [(a, min(a + 16, width)) for a in range(0, width, 16)]
                joined = [(bits[:, a:b] << np.arange(b - a)[::-1]).sum(axis=1) for a, b in halves]
                value = np.stack([np.full(len(rows), eob), *joined], axis=1)
                size = np.stack([np.full(len(rows), eob_size), *(np.where(filled, b - a, 0) for a, b in halves)], axis=1)
                value[~filled, 1:] = 0
            else:
                bits, sizes = _value_codes(_table_of(scan), False)
                value, size = bits[(own >> left) + 1024], sizes[(own >> left) + 1024]
                value[~filled, 0], size[~filled, 0] = eob, eob_size
            per_block = np.full(len(rows), value.shape[1])
        else:
            rows, per_file = _interleaved(grids, starts), units
            dc = blocks[rows, 0].reshape(-1, 6)
            if known:
                value, size = (dc >> left) & 1, np.ones(dc.shape, "i8")
            else:
                begins = _interval_starts(per_file, RESTART)
                v = dc >> left
                luma = np.diff(v[:, :4].reshape(-1), prepend=0).reshape(-1, 4)
                luma[begins, 0] = v[begins, 0]
                chroma = np.diff(v[:, 4:], axis=0, prepend=0)
                chroma[begins] = v[begins, 4:]
                bits, sizes = _value_codes(0, True)
                d = np.concatenate([luma, chroma], axis=1)
                value, size = bits[d + 1024], sizes[d + 1024]
            per_block = np.full(len(dc), 6)
        begins = _interval_starts(per_file, 0 if known else RESTART)
        interval_ends = np.r_[begins[1:], len(per_block)]
        data, byte_ends = pack(value.reshape(-1), size.reshape(-1), interval_ends * value.shape[1])
        raw, cut = data.tobytes(), [0, *byte_ends.tolist()]
        n_intervals = np.ones(len(payloads), "i8") if known else -(-per_file // RESTART)
        at = 0
        head = scan_header(scan)
        for k, n in enumerate(n_intervals.tolist()):
            parts = [raw[cut[i] : cut[i + 1]].replace(b"\xff", b"\xff\x00") for i in range(at, at + n)]
            at += n
            body = [head, parts[0]]
            for i, part in enumerate(parts[1:]):
                body += (bytes((0xFF, 0xD0 + i % 8)), part)
            out[k] += body
    return [b"".join((*parts, b"\xff\xd9")) for parts in out]


def _interval_starts(per_file: np.ndarray, restart: int) -> np.ndarray:
    """Where restart intervals begin, over all files' units."""
    ends = np.cumsum(per_file)
    if not restart:
        return np.r_[0, ends[:-1]]
    return np.concatenate([np.arange(e - n, e, restart) for e, n in zip(ends.tolist(), per_file.tolist(), strict=True)])


def _interleaved(grids: list[tuple[int, int]], starts: np.ndarray) -> np.ndarray:
    """Blocks in the order of an interleaved 4:2:0 scan, six a unit."""
    return np.concatenate([_unit_blocks(*g) + s for g, s in zip(grids, starts.tolist(), strict=False)]).reshape(-1)


@functools.lru_cache(maxsize=512)
def _unit_blocks(columns: int, rows: int) -> np.ndarray:
    n = columns * rows
    y, x = np.divmod(np.arange(n), columns)
    top = 2 * y * 2 * columns + 2 * x
    return np.stack([top, top + 1, top + 2 * columns, top + 2 * columns + 1, 4 * n + np.arange(n), 5 * n + np.arange(n)], axis=1)


# ---- decoding


@dataclass
class Scan:
    comps: tuple[int, ...]
    tables: tuple  # of each component: (DC, AC) as (counts, symbols)
    first: int
    last: int
    known: int
    left: int
    restart: int
    data: bytes

    @property
    def kind(self) -> tuple:
        return self.comps, self.tables, self.first, self.last, self.known, self.left


@dataclass
class File:
    width: int = 0
    height: int = 0
    sampling: tuple = ()
    quant: tuple = ()
    comment: bytes = b""
    scans: list = field(default_factory=list)
    planes: list = field(default_factory=list)  # (blocks across, blocks down, first block)

    @property
    def units(self) -> tuple[int, int]:
        h, v = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> File:
    out, tables, quants, restart, at, ids = File(), {}, {}, 0, 2, []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return out
        (n,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + n], at + n
        if marker == 0xC2:
            out.height, out.width, n_comps = struct.unpack_from(">xHHB", body)
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n_comps)]
            ids, out.sampling = [p[0] for p in parts], tuple((p[1] >> 4, p[1] & 15) for p in parts)
            out.quant = tuple(quants[p[2]] for p in parts)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[129 if wide else 65 :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n_comps = body[0]
            pairs = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n_comps)]
            end = _NEXT.search(data, at).start()
            chosen = tuple((tables.get(t >> 4), tables.get(0x10 | t & 15)) for _, t in pairs)
            first, last, bits = body[1 + 2 * n_comps : 4 + 2 * n_comps]
            out.scans.append(Scan(tuple(c for c, _ in pairs), chosen, first, last, bits >> 4, bits & 15, restart, data[at:end]))
            at = end


class Bits:
    """Byte strings put together, read at bit positions."""

    def __init__(self, parts: list[bytes]):
        lengths = np.fromiter(map(len, parts), "i8", len(parts))
        self.starts = 8 * np.r_[0, np.cumsum(lengths)[:-1]]
        self.bytes = np.frombuffer(b"".join((*parts, bytes(8))), "u1")
        b = self.bytes.astype("u4")
        self.words = (b[:-4] << 24) | (b[1:-3] << 16) | (b[2:-2] << 8) | b[3:-1]

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The n (16 at most) bits from each position on."""
        at = np.minimum(at, 8 * len(self.words) - 8)
        return (self.words[at >> 3] >> (32 - n - (at & 7)).astype("u4")).astype("i8") & ((1 << n) - 1)


def _extend(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (raw < (1 << np.maximum(size, 1) - 1)), raw - (1 << size) + 1, raw)


def _lanes(files: list[File], number: int) -> tuple[Bits, np.ndarray, np.ndarray, np.ndarray]:
    """Restart intervals of one scan of all files: the bits, and each interval's file,
    first unit and number of units."""
    parts, owner, first, count = [], [], [], []
    for k, f in enumerate(files):
        scan = f.scans[number]
        n = _units(f, scan)
        pieces = _RESTARTS.split(scan.data) if scan.restart else [scan.data]
        step = scan.restart or n
        for i, piece in enumerate(pieces[: -(-n // step)]):
            parts.append(piece.replace(b"\xff\x00", b"\xff"))
            owner.append(k)
            first.append(i * step)
            count.append(min(step, n - i * step))
    return Bits(parts), np.array(owner), np.array(first), np.array(count)


def _units(f: File, scan: Scan) -> int:
    """Interleaved: units of the frame; of one component: its own blocks that hold pixels."""
    if len(scan.comps) > 1:
        return f.units[0] * f.units[1]
    a, b = _own_grid(f, scan.comps[0])
    return a * b


def _own_grid(f: File, c: int) -> tuple[int, int]:
    h, v = f.sampling[c]
    most_h, most_v = max(h for h, _ in f.sampling), max(v for _, v in f.sampling)
    return -(-(-(-f.width * h // most_h)) // 8), -(-(-(-f.height * v // most_v)) // 8)


def _scan_blocks(f: File, scan: Scan) -> np.ndarray:
    """Indices of the blocks of a scan, in its order: units x blocks of a unit."""
    if len(scan.comps) == 1:
        a, b = _own_grid(f, scan.comps[0])
        across, _, base = f.planes[scan.comps[0]]
        return (base + np.arange(b)[:, None] * across + np.arange(a)).reshape(-1, 1)
    ux, uy = f.units
    y, x = np.divmod(np.arange(ux * uy), ux)
    own = []
    for c in scan.comps:
        (h, v), (across, _, base) = f.sampling[c], f.planes[c]
        own += [base + (v * y + j) * across + h * x + i for j in range(v) for i in range(h)]
    return np.stack(own, axis=1)


def coefficients(files: list[File]) -> np.ndarray:
    """All files' blocks (zigzag order), accumulated over their scans; files must have
    the same components and scans. Sets each file's planes."""
    total = 0
    for f in files:
        ux, uy = f.units
        f.planes = []
        for h, v in f.sampling:
            f.planes.append((ux * h, uy * v, total))
            total += ux * h * uy * v
    out = np.zeros((total, 64), "i4")
    for number, scan in enumerate(files[0].scans):
        bits, owner, first, count = _lanes(files, number)
        orders = [_scan_blocks(f, f.scans[number]) for f in files]
        bases = np.r_[0, np.cumsum([len(o) for o in orders])]
        order = np.concatenate(orders)
        begin = bases[owner] + first
        if scan.first == 0 and scan.known:
            _refine_dc(out, bits, order, begin, count, scan)
        elif scan.first == 0:
            _first_dc(out, bits, order, begin, count, scan, files[0])
        elif scan.known:
            _refine_ac(out, bits, order[:, 0], begin, count, scan)
        else:
            _first_ac(out, bits, order[:, 0], begin, count, scan)
    return out


def _first_dc(out, bits, order, begin, count, scan, frame) -> None:
    at = bits.starts.copy()
    comps = [c for c in range(len(scan.comps)) for _ in range(math.prod(frame.sampling[scan.comps[c]]) if len(scan.comps) > 1 else 1)]
    last = np.zeros((len(at), len(scan.comps)), "i8")
    live = np.argsort(-count, kind="stable")  # lanes that still have units stay in front
    for u in range(int(count.max(initial=0))):
        live = live[: np.searchsorted(-count[live], -u, side="left")]
        for j, c in enumerate(comps):
            size, symbol = lookup(*scan.tables[c][0])
            window = bits.peek(at[live], 16)
            n = size[window]
            if not n.all():
                raise ValueError("damaged scan")
            s = symbol[window]
            at[live] += n
            raw = bits.peek(at[live], s)
            at[live] += s
            last[live, c] += _extend(raw, s)
            out[order[begin[live] + u, j], 0] = last[live, c] << scan.left


def _refine_dc(out, bits, order, begin, count, scan) -> None:
    per = order.shape[1]
    unit = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    lane = np.repeat(np.arange(len(count)), count)
    at = bits.starts[lane][:, None] + unit[:, None] * per + np.arange(per)
    rows = order[begin[lane] + unit]
    out[rows, 0] |= bits.peek(at, 1).astype("i4") << scan.left


def _first_ac(out, bits, order, begin, count, scan) -> None:
    size, symbol = lookup(*scan.tables[0][1])
    flat = out.reshape(-1)
    at, k = bits.starts.copy(), np.full(len(count), scan.first)
    block, left = begin.copy(), count.copy()
    while len(at):
        window = bits.peek(at, 16)
        n, sym = size[window], symbol[window]
        if not n.all():
            raise ValueError("damaged scan")
        s = sym & 15
        at += n
        raw = bits.peek(at, s)
        at += s
        run = sym >> 4
        if (sym & 15).all():
            k += run
            flat[order[block] * 64 + k] = _extend(raw, s) << scan.left
            k += 1
            over = k > scan.last
        else:
            value = s > 0
            k += run
            if value.any():
                flat[order[block[value]] * 64 + k[value]] = _extend(raw, s)[value] << scan.left
            k += 1
            over = k > scan.last
            end = ~value & (run < 15)
            if end.any():  # the end of this band, and of some blocks more
                r = run[end]
                more = (1 << r) + bits.peek(at[end], r) - 1
                at[end] += r
                more = np.minimum(more, left[end] - 1)
                block[end] += more
                left[end] -= more
                over |= end
        if over.any():
            block += over
            left -= over
            k[over] = scan.first
            if not left.all():
                keep = left > 0
                at, k, block, left = at[keep], k[keep], block[keep], left[keep]


def _refine_ac(out, bits, order, begin, count, scan) -> None:
    size, symbol = lookup(*scan.tables[0][1])
    band = slice(scan.first, scan.last + 1)
    known = np.count_nonzero(out[order, band], axis=1)  # correction bits of each block
    at, run = bits.starts.copy(), np.zeros(len(count), "i8")
    spans_block, spans_at = [], []
    for u in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > u)
        fresh = live[run[live] == 0]
        if len(fresh):
            window = bits.peek(at[fresh], 16)
            n, sym = size[window], symbol[window]
            if not n.all():
                raise ValueError("damaged scan")
            ends = (sym & 15 == 0) & (sym >> 4 < 15)
            own, r = fresh[ends], sym[ends] >> 4
            at[own] += n[ends]
            run[own] = (1 << r) + bits.peek(at[own], r)
            at[own] += r
            late = fresh[~ends]
            for lane in late.tolist():
                run[lane] = _refine_block(out[order[begin[lane] + u]], bits, at, lane, scan, size, symbol)
            live = np.setdiff1d(live, late, assume_unique=True)
        rows = begin[live] + u
        spans_block.append(rows)
        spans_at.append(at[live].copy())
        at[live] += known[rows]
        run[live] -= 1
    rows, start = np.concatenate(spans_block), np.concatenate(spans_at)
    rows, start = rows[known[rows] > 0], start[known[rows] > 0]
    one = np.int32(1 << scan.left)
    width = scan.last - scan.first + 1
    whole = known[rows] == width
    if whole.any():
        chosen = order[rows[whole]]
        bit = bits.peek(start[whole][:, None] + np.arange(width), 1).astype("i4")
        own = out[chosen, band]
        out[chosen, band] = own + np.sign(own) * (bit * one)
    if not whole.all():
        chosen, begin_at = order[rows[~whole]], start[~whole]
        own = out[chosen, band]
        r, c = np.nonzero(own)
        place = np.arange(len(r)) - np.r_[0, np.cumsum(np.count_nonzero(own, axis=1))[:-1]][r]
        bit = bits.peek(begin_at[r] + place, 1).astype("i4")
        own[r, c] += np.sign(own[r, c]) * (bit * one)
        out[chosen, band] = own


def _refine_block(block, bits, at, lane, scan, size, symbol) -> int:
    """One block in which coefficients become non-zero. Returns how many blocks after it
    an end of band in it covers."""
    one, k, pos = 1 << scan.left, scan.first, int(at[lane])
    read = lambda p, n: int(bits.peek(np.array([p]), np.array([n]))[0])
    while k <= scan.last:
        window = read(pos, 16)
        n, sym = int(size[window]), int(symbol[window])
        if not n:
            raise ValueError("damaged scan")
        pos += n
        run, s = sym >> 4, sym & 15
        new = 0
        if s:
            new = one if read(pos, 1) else -one
            pos += 1
        elif run < 15:
            more = (1 << run) + (read(pos, run) if run else 0)
            pos += run
            while k <= scan.last:
                if block[k]:
                    block[k] += (1 if block[k] > 0 else -1) * one * read(pos, 1)
                    pos += 1
                k += 1
            at[lane] = pos
            return more - 1
        while k <= scan.last:
            if block[k]:
                block[k] += (1 if block[k] > 0 else -1) * one * read(pos, 1)
                pos += 1
            elif run:
                run -= 1
            else:
                break
            k += 1
        if new and k <= scan.last:
            block[k] = new
        k += 1
    at[lane] = pos
    return 0


@functools.lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Rows: frequencies; the inverse transform's factors times 2^11, rounded."""
    x, u = np.arange(8), np.arange(8)[:, None]
    return np.rint(np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(0.125), 0.5) * 2048)


def pixels(blocks: np.ndarray) -> np.ndarray:
    """Samples (0 to 255) of dequantised blocks in natural order: products and sums of
    integers below 2^53, so exact in any order of summation."""
    m = _basis()
    rows = blocks.reshape(-1, 8).astype("f8") @ m
    columns = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ m
    samples = np.floor((columns + (1 << 21)) * (1 / (1 << 22))) + 128
    return np.clip(samples, 0, 255).astype("u1").reshape(-1, 8, 8).transpose(0, 2, 1)


def to_rgb(f: File, samples: np.ndarray) -> np.ndarray:
    """Height x width x 3, chroma doubled to full resolution."""
    most_h, most_v = max(h for h, _ in f.sampling), max(v for _, v in f.sampling)
    full = []
    for (h, v), (across, down, base) in zip(f.sampling, f.planes, strict=True):
        own = samples[base : base + across * down].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
        if most_v != v:
            own = np.repeat(own, most_v // v, axis=0)
        if most_h != h:
            own = np.repeat(own, most_h // h, axis=1)
        full.append(own[: f.height, : f.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y = full[0].astype("i4") << 16
    b, r = full[1].astype("i4") - 128, full[2].astype("i4") - 128
    half = 1 << 15
    out = np.empty((f.height, f.width, 3), "u1")
    out[:, :, 0] = np.clip((y + 91881 * r + half) >> 16, 0, 255)
    out[:, :, 1] = np.clip((y - 22554 * b - 46802 * r + half) >> 16, 0, 255)
    out[:, :, 2] = np.clip((y + 116130 * b + half) >> 16, 0, 255)
    return out


def decode(files: list[bytes], with_payload: bool = True) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor) of each file; the payload is empty if the file carries none."""
    parsed = [parse(data) for data in files]
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(parsed):
        groups.setdefault((f.sampling, f.quant, tuple(s.kind for s in f.scans)), []).append(k)
    out: list = [None] * len(files)
    for (_, quant, _), members in groups.items():
        own = [parsed[k] for k in members]
        blocks = coefficients(own)
        natural = np.empty_like(blocks)
        if all(q == (1,) * 64 for q in quant):
            natural[:, ZIGZAG] = blocks
        else:
            scaled = blocks.copy()
            for f in own:
                for q, (across, down, base) in zip(f.quant, f.planes, strict=True):
                    scaled[base : base + across * down] *= np.array(q, "i4")
            natural[:, ZIGZAG] = scaled
        samples = pixels(natural)
        for k, f in zip(members, own, strict=True):
            payload = b""
            if with_payload and f.comment.startswith(b"payload="):
                n, base = int(f.comment[8:]), f.planes[0][2]
                payload = (blocks[base : base + n // 64] - OFFSET).astype("u1").tobytes()
            out[k] = payload, to_rgb(f, samples)
    return out


# ---- the table operators


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, checksum of the tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(v) * 1000 // n for v in rgb.sum(axis=(0, 1), dtype="i8")]
    return f"{rgb.shape[0]}x{rgb.shape[1]} rgb {'/'.join(map(str, means))} crc {zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def _groups(texts: list[bytes], most: int = GROUP):
    """Consecutive texts of up to so many bytes in all."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, and the text as a progressive JPEG file."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            files = [x for g in _groups(texts.to_pylist()) for x in encode(list(map(payload_of, g)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_bytes long, media binary", ROWS)


def _decoded(batches):
    """(row, payload, tensor) of the stored files, some rows together."""
    for batch in batches:
        rows = batch.to_pylist()
        files = iter(rows)
        for g in _groups([r["media"] for r in rows], DECODED):
            yield [(next(files), *found) for found in decode(g)]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


TENSOR = "doc_id long, height int, width int, rgb binary"


def rgb_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and the RGB tensor (row-major bytes) of (doc_id, media)."""

    def run(batches):
        for group in _decoded(batches):
            yield _table([(r["doc_id"], rgb.shape[0], rgb.shape[1], rgb.tobytes()) for r, _, rgb in group], TENSOR)

    return map_arrow(media.select("doc_id", "media"), run, TENSOR, ROWS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def media_digests(docs: DataFrame, at: str | None = None) -> DataFrame:
    """Each text stored as a file in a table in the shared folder, that table read back, and
    of what was read: digests, the feature, and the RGB tensor itself (height, width, rgb),
    which is stored where the result is written."""
    media = written(store_media(docs), at or shared_dir(docs.sparkSession), "zstd")

    def run(batches):
        for group in _decoded(batches):
            rows = []
            for r, payload, rgb in group:
                file = r["media"]
                rows.append((
                    r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(),
                    feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes(),
                ))
            yield _table(rows, DIGEST)

    return map_arrow(media, run, DIGEST, ROWS)
