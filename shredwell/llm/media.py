"""Media columns: baseline JPEG streams, read without an image library.

`encode` stores bytes losslessly as greyscale baseline JPEG: each byte is the level of one 8x8 block (quantiser 8, so
that a quantised DC coefficient is the level less 128), rows of 192 blocks, one restart interval a row, no AC
coefficients. A stream holds at most 8191 rows; what is longer becomes several streams end to end.

`decode` reads any baseline stream with one or more components: it parses the markers, decodes the Huffman-coded
scan and rebuilds the thumbnail that the DC coefficients of the first (luminance) component give, one level for each
8x8 block. Restart intervals are decoded side by side in numpy as long as blocks hold a DC coefficient only; other
streams are decoded block by block.

Null and empty texts are 192 spaces. A null, truncated, malformed or foreign media value gives nulls for everything read
from it and an `error`, whatever its bytes; no value fails the job or costs more memory than its own size allows (a block
takes one bit at least, so a header can't ask for more blocks than the scan has bits). Image readers take a value of
several streams for its first; here all of them are read. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_batches, table, text_bytes, text_of, without

ROW = 192
MAX_ROWS = 65535 // 8
CHUNK = 1 << 20

#: Code lengths of the DC categories 0..8 in the streams that `encode` writes; the code of EOB, the only AC symbol, is 0.
DC_LENGTHS = {6: 2, 5: 3, 7: 3, 4: 3, 0: 3, 3: 4, 2: 4, 1: 4, 8: 5}


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    by = [[s for s in lengths if lengths[s] == n] for n in range(1, 17)]
    return bytes([kind, *map(len, by)]) + bytes(s for x in by for s in x)


def huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    if len(counts) != 16 or len(symbols) < sum(counts):
        raise Bad("a Huffman table is cut off")
    out, code, k = [], 0, 0
    for n in range(1, 17):
        if code + counts[n - 1] > 1 << n:
            raise Bad("a Huffman table has too many codes")
        for _ in range(counts[n - 1]):
            out.append((symbols[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bad(ValueError):
    """Not a baseline stream."""


_DC, _AC = _dht(0x00, DC_LENGTHS), _dht(0x10, {0: 1})


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block by its difference, from -255 to 255."""
    by = {s: (c, n) for s, c, n in huffman_codes(_DC[1:17], _DC[17:])}
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = by[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], bits[d + 255] = ((code << size | extra) << 1), n + size + 1  # the last 0 is EOB
    return value, bits


_VALUE, _BITS = _block_codes()


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, _DC)
        + _segment(0xC4, _AC)
        + _segment(0xDD, ROW.to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_rows(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of 192 levels, stuffed, end to end, and where each row begins."""
    n = len(levels)
    diff = levels.astype(np.int16)
    diff[:, 1:] -= levels[:, :-1]
    diff[:, 0] -= 128
    index = (diff.ravel() + 255).astype(np.int64)
    value, bits = _VALUE[index], _BITS[index]
    ends = np.cumsum(bits.reshape(n, ROW), axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    place = (ends - bits.reshape(n, ROW) + row_at[:, None] * 8).ravel()
    byte, v = place >> 3, value.astype(np.int64) << (24 - bits - (place & 7))
    size = int(row_bytes.sum())
    packed = np.bincount(byte, (v >> 16).astype(np.float64), size + 3)
    packed[1:] += np.bincount(byte, ((v >> 8) & 255).astype(np.float64), size + 2)
    packed[2:] += np.bincount(byte, (v & 255).astype(np.float64), size + 1)
    packed = packed[:size].astype(np.uint8)
    packed[row_at + row_bytes - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # filled up with ones
    full = packed == 255
    at = np.concatenate([[0], np.cumsum(full)]) + np.arange(size + 1)
    out = np.zeros(int(at[-1]), np.uint8)
    out[at[:-1]] = packed
    return out, at[np.concatenate([row_at, [size]])]


def encode_payloads(levels: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """A media value for each run of rows; levels holds all rows end to end."""
    data, at = encode_rows(levels)
    marked = np.zeros(len(data) + 2 * len(levels), np.uint8)
    marked[np.arange(len(data)) + np.repeat(2 * np.arange(len(levels)), np.diff(at))] = data
    ends = at[1:] + 2 * np.arange(len(levels))  # where the marker after each row goes
    out, done = [], 0
    for n in rows.tolist():
        parts = []
        for i in range(0, n, MAX_ROWS):
            k = min(MAX_ROWS, n - i)
            a, z = done + i, done + i + k
            marked[ends[a:z]] = 255
            marked[ends[a:z] + 1] = 0xD0 + np.arange(k) % 8
            marked[ends[z - 1] + 1] = 0xD9
            parts += [_header(k), marked[at[a] + 2 * a : ends[z - 1] + 2].tobytes()]
        out.append(b"".join(parts))
        done += n
    return out


def pad(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 192 levels for all texts end to end, each filled up with spaces, and the rows of each."""
    sizes = np.diff(at)
    rows = np.maximum(1, -(-sizes // ROW))
    levels = np.full(int(rows.sum()) * ROW, 32, np.uint8)
    to = (np.cumsum(rows) - rows) * ROW
    levels[np.arange(len(raw)) + np.repeat(to - at[:-1], sizes)] = raw
    return levels.reshape(-1, ROW), rows


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with `media` in place of `text`."""
    kept = without(df, [text, media])
    fields = [*kept.schema.fields, T.StructField(media, T.BinaryType())]
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(b.num_columns - 1))
            out: list[bytes] = []
            for i, j in chunks(at, CHUNK):
                levels, rows = pad(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                out += encode_payloads(levels, rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*names, media])

    return map_batches(df.select(*names, text_of(text).alias(text)), run, fields)


def parse(data: bytes, i: int = 0) -> tuple[dict, int]:
    """The headers of the stream at i, with where its scan begins."""
    if data[i : i + 2] != b"\xff\xd8":
        raise Bad("no start of image")
    out: dict = {"dqt": {}, "dht": {}, "dri": 0, "frame": None}
    return out, rest(data, out, i + 2)


def rest(data: bytes, out: dict, i: int) -> int:
    """Read segments from i on into out up to a scan, and tell where the scan begins."""
    while True:
        while data[i : i + 2] == b"\xff\xff":
            i += 1
        if len(data) < i + 4 or data[i] != 0xFF:
            raise Bad("truncated header")
        marker, size = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + size]
        if len(body) != size - 2:
            raise Bad("truncated segment")
        i += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                if len(body) < 1 + n:
                    raise Bad("a quantiser table is cut off")
                out["dqt"][body[0] & 15] = int.from_bytes(body[1 : 3 if wide else 2], "big")
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise Bad("a Huffman table is cut off")
                out["dht"][body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or body[0] != 8 or not body[5]:
                raise Bad("a frame header is cut off or not of 8 bits")
            comps = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in comps):
                raise Bad("sampling factors out of range")
            out["frame"] = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), comps)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Bad("not baseline")
        elif marker == 0xDD:
            out["dri"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not out["frame"]:
                raise Bad("scan without frame")
            if not body or len(body) < 1 + 2 * body[0] or not body[0]:
                raise Bad("a scan header is cut off")
            out["scan"] = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
            return i
        elif marker in (0xD8, 0xD9):
            raise Bad("an image ends without a scan")


def split_scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The scan's bytes without stuffing and markers, where each restart interval begins, and where the scan ends."""
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    stop = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
    if not len(stop):
        raise Bad("no end of image")
    end = int(stop[0])
    inside = ff < end
    ff, after = ff[inside], after[inside]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    rst = ff[after != 0]
    keep[rst] = keep[rst + 1] = False
    before = np.cumsum(keep)
    return data[:end][keep], np.concatenate([[0], before[rst]]).astype(np.int64), end


_tables: dict[tuple[bytes, bytes], np.ndarray] = {}


def block_table(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits: difference * 32 + bits of a block that has a DC coefficient only; 0 where it isn't so."""
    if (dc, ac) not in _tables:
        out = np.zeros(1 << 16, np.int32)
        eob = [(c, n) for s, c, n in huffman_codes(ac[:16], ac[16:]) if s == 0]
        for size, code, n in huffman_codes(dc[:16], dc[16:]):
            for ec, en in eob:
                total = n + size + en
                if size > 11 or total > 16:
                    continue
                for extra in range(1 << size):
                    d = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                    first = (((code << size | extra) << en) | ec) << (16 - total)
                    out[first : first + (1 << (16 - total))] = d * 32 + total
        if len(_tables) > 64:
            _tables.clear()
        _tables[dc, ac] = out
    return _tables[dc, ac]


def decode_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC coefficients of each interval by block, all intervals at once, and which intervals had nothing else and didn't end early."""
    padded = np.concatenate([data, np.full(4, 255, np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    most = int(blocks.max())
    pos, dc = starts * 8, np.zeros(len(starts), np.int32)
    last, ok = len(words) - 1, np.ones(len(starts), bool)
    out = np.zeros((most, len(starts)), np.int32)
    even = bool((blocks == most).all())
    for k in range(most):
        e = lut[(words[np.minimum(pos >> 3, last)] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
        if even:
            ok &= e != 0
        else:
            on = blocks > k
            ok &= (e != 0) | ~on
            e = np.where(on, e, 0)
        pos = pos + (e & 31)
        dc += e >> 5
        out[k] = dc
    return out.T, ok & (pos <= ends * 8)


def decode_scalar(head: dict, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """DC coefficients of the first component of any baseline scan, block by block."""
    height, width, comps = head["frame"]
    codes = {k: {(n, c): s for s, c, n in huffman_codes(v[:16], v[16:])} for k, v in head["dht"].items()}
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    one = len(head["scan"]) == 1
    cols, rows = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    _, h0, v0, _ = comps[0]
    if one:
        cols, rows = -(-(-(-width * h0 // hmax)) // 8), -(-(-(-height * v0 // vmax)) // 8)
        h0 = v0 = 1
    if 2 * rows * v0 * cols * h0 > 8 * len(data):
        raise Bad("more blocks than the scan has bits")
    grid = np.zeros((rows * v0, cols * h0), np.int32)
    edges = [*(starts * 8).tolist(), len(data) * 8]
    bits = data.tolist()
    pos, lane, pred = 0, 0, [0] * len(comps)

    def get(n: int) -> int:
        nonlocal pos
        v = 0
        for _ in range(n):
            v = v << 1 | (bits[pos >> 3] >> (7 - (pos & 7)) & 1 if pos >> 3 < len(bits) else 1)
            pos += 1
        return v

    def symbol(t: dict) -> int:
        c = 0
        for n in range(1, 17):
            c = c << 1 | get(1)
            if (n, c) in t:
                return t[n, c]
        raise Bad("no such code")

    for m in range(rows * cols):
        if head["dri"] and m and m % head["dri"] == 0:
            lane += 1
            if lane >= len(starts) or pos > edges[lane]:
                raise Bad("a restart interval is missing or cut off")
            pos, pred = edges[lane], [0] * len(comps)
        for k, (cid, h, v, _) in enumerate(comps):
            if cid not in head["scan"]:
                continue
            td, ta = head["scan"][cid]
            for y in range(1 if one else v):
                for x in range(1 if one else h):
                    if pos >= len(bits) * 8:
                        raise Bad("truncated scan")
                    size = symbol(codes[td])
                    if size > 11:
                        raise Bad("a difference of too many bits")
                    extra = get(size)
                    pred[k] += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                    i = 1
                    while i < 64:
                        rs = symbol(codes[0x10 | ta])
                        if rs == 0:
                            break
                        if not rs & 15 and rs != 0xF0:
                            raise Bad("no such coefficient")
                        get(rs & 15)
                        i += (rs >> 4) + 1
                    if i > 64:
                        raise Bad("too many coefficients")
                    if k == 0:
                        grid[(m // cols) * v0 + y, (m % cols) * h0 + x] = pred[0]
    # the blocks of the picture alone: those that only fill up a group of blocks go
    _, h0, v0, _ = comps[0]
    return grid[: -(-(-(-height * v0 // vmax)) // 8), : -(-(-(-width * h0 // hmax)) // 8)]


def luminance(value: bytes, raw: np.ndarray, i: int) -> tuple[dict, np.ndarray, np.ndarray, int]:
    """Headers, scan and restart intervals of the stream at i, and where it ends. Scans that don't hold the first component are passed over."""
    head, at = parse(value, i)
    while True:
        data, starts, end = split_scan(raw[at:])
        height, width, comps = head["frame"]
        if not height or not width:
            raise Bad("no picture")
        if comps[0][0] in head["scan"]:
            td, ta = head["scan"][comps[0][0]]
            if td not in head["dht"] or 0x10 | ta not in head["dht"] or comps[0][3] not in head["dqt"]:
                raise Bad("a table is missing")
            for c, _, _, _ in comps:
                if c in head["scan"] and not {head["scan"][c][0], 0x10 | head["scan"][c][1]} <= set(head["dht"]):
                    raise Bad("a table is missing")
            break
        at = rest(value, head, at + end)
    i = at + end
    while value[i + 1 : i + 2] not in (b"\xd9", b""):  # scans of other components
        later = {"dqt": dict(head["dqt"]), "dht": dict(head["dht"]), "dri": 0, "frame": head["frame"]}
        at = rest(value, later, i)
        i = at + split_scan(raw[at:])[2]
    return head, data, starts, i + 2


def _blocks(head: dict) -> int:
    height, width, _ = head["frame"]
    return -(-height // 8) * -(-width // 8)


def _fast(head: dict, scan: np.ndarray, starts: np.ndarray) -> bool:
    """One component, as many restart intervals as there must be, and no more blocks than there can be."""
    n = _blocks(head)
    return len(head["frame"][2]) == 1 and head["dri"] > 0 and 2 * n <= 8 * len(scan) and len(starts) == -(-n // head["dri"])


def thumbnails(media: list[bytes | None]) -> list[tuple | None | str]:
    """(width, height, levels by row) of each value, end to end where it holds several streams; else what is wrong.

    Whatever goes wrong in a value, whichever step finds it, is that value's error alone.
    """
    out: list = [None] * len(media)
    jobs: dict[tuple, list] = {}
    parts: dict[int, list] = {}
    for k, value in enumerate(media):
        if value is None:
            out[k] = "null"
            continue
        try:
            i, raw, streams, fast = 0, np.frombuffer(value, np.uint8), [], []
            while i < len(value) or not streams:
                head, data, starts, i = luminance(value, raw, i)
                streams.append([head, data, starts, None])
                if _fast(head, data, starts):
                    td, ta = head["scan"][head["frame"][2][0][0]]
                    tables = (head["dht"][td], head["dht"][0x10 | ta])
                    block_table(*tables)
                    fast.append(((*tables, min(head["dri"], _blocks(head))), streams[-1]))
            parts[k] = streams
            for key, stream in fast:
                jobs.setdefault(key, []).append(stream)
        except Exception as e:
            out[k] = f"{type(e).__name__}: {e}"
    for (dc, ac, _), group in jobs.items():
        counts = [np.clip(_blocks(head) - head["dri"] * np.arange(len(starts)), 0, head["dri"]) for head, _, starts, _ in group]
        sizes = np.array([len(g[1]) for g in group])
        base = np.cumsum(sizes) - sizes
        lanes = np.array([len(g[2]) for g in group])
        starts = np.concatenate([g[2] for g in group]) + np.repeat(base, lanes)
        rows, ok = decode_lanes(np.concatenate([g[1] for g in group]), starts, np.append(starts[1:], sizes.sum()), np.concatenate(counts), block_table(dc, ac))
        for g, a, n, c in zip(group, np.cumsum(lanes) - lanes, lanes, counts, strict=True):
            h, w, _ = g[0]["frame"]
            if ok[a : a + n].all():
                x = rows[a : a + n]
                g[3] = (x if (c == x.shape[1]).all() else np.concatenate([r[:m] for r, m in zip(x, c, strict=True)])).reshape(-(-h // 8), -(-w // 8))
    for k, streams in parts.items():
        try:
            grids = []
            for head, data, starts, grid in streams:
                g = decode_scalar(head, data, starts) if grid is None else grid
                q = head["dqt"][head["frame"][2][0][3]]
                grids.append(np.clip((g.astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8))
            if len({g.shape[1] for g in grids}) > 1:
                raise Bad("streams of different widths")
            out[k] = (streams[0][0]["frame"][1], sum(s[0]["frame"][0] for s in streams), np.concatenate(grids) if len(grids) > 1 else grids[0])
        except Exception as e:
            out[k] = f"{type(e).__name__}: {e}"
    return out


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits in hex: which of 8x8 cells is brighter than their mean."""
    h, w = grid.shape
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), ys, axis=0), xs, axis=1)
    area = np.outer(np.maximum(np.diff([*ys, h]), 1), np.maximum(np.diff([*xs, w]), 1))
    mean = cells / area
    return np.packbits(mean.ravel() > mean.mean()).tobytes().hex()


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height (pixels), thumbnail (levels by row), thumbnail_hash and error."""
    new = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType()), T.StructField("error", T.StringType())]
    kept = without(df, [f.name for f in new])
    names, at_media = kept.columns, kept.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at_media)
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in chunks(sizes, CHUNK):
                got = thumbnails(values[i:j].to_pylist())
                good = [x if isinstance(x, tuple) else None for x in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c[i:j] for c in b.columns),
                        pa.array([x and x[0] for x in good], pa.int32()),
                        pa.array([x and x[1] for x in good], pa.int32()),
                        pa.array([x and x[2].tobytes() for x in good], pa.binary()),
                        pa.array([x and thumbnail_hash(x[2]) for x in good], pa.string()),
                        pa.array([x if isinstance(x, str) else None for x in got], pa.string()),
                    ],
                    [*names, *(f.name for f in new)],
                )

    return map_batches(kept, run, [*kept.schema.fields, *new])


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, from what `decode` reads back out of what `encode` stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    read = decode(encode(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )
