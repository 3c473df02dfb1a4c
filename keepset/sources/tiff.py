"""Tags of TIFF structures (TIFF files, most raw files, EXIF blocks), and preview images inside raw files."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

from keepset.sources import jpeg

#: Bytes of a value by its type, and the tags that are followed or asked for.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, ORIENTATION, SOFTWARE, WRITTEN, EXIF, SUB_IFDS, TAKEN, FRACTION, MAKER, RENDERED, DIGITIZED = 256, 257, 274, 305, 306, 34665, 330, 36867, 37521, 37500, 41985, 36868
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _value(data: bytes, order: str, kind: int, n: int, where: bytes):
    size = SIZES.get(kind, 1) * n
    raw = where[:size] if size <= 4 else data[(at := struct.unpack(order + "I", where)[0]) : at + size]
    if kind == 2:
        return raw.split(b"\0")[0].decode("latin-1")
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{len(raw) // 4}{'I' if kind == 5 else 'i'}", raw[: len(raw) // 4 * 4])
        values = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
    elif kind in FORMATS:
        width = SIZES[kind]
        values = list(struct.unpack(f"{order}{len(raw) // width}{FORMATS[kind]}", raw[: len(raw) // width * width]))
    else:
        return raw
    return values[0] if len(values) == 1 else values


def tags(data: bytes, depth: int = 2) -> dict[int, object]:
    """All tags of the first directory and of the EXIF directory it points to; the first directory's win."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}

    def directory(at: int, left: int) -> dict[int, object]:
        if at + 2 > len(data):
            return {}
        out: dict[int, object] = {}
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            start = at + 2 + 12 * k
            if start + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, start)
            try:
                out[tag] = _value(data, order, kind, n, data[start + 8 : start + 12])
            except struct.error:
                continue
        inner = out.get(EXIF)
        return directory(inner, left - 1) | out if isinstance(inner, int) and left > 1 else out

    return directory(struct.unpack_from(order + "I", data, 4)[0], depth)


def dimensions(data: bytes) -> tuple[int, int]:
    found = tags(data, 1)
    size = tuple(x if isinstance(x, int) else 0 for x in (found.get(WIDTH), found.get(HEIGHT)))
    return size if all(size) else (0, 0)


def taken_at(found: dict[int, object]) -> float | None:
    """Epoch seconds of the capture time, read as UTC."""
    text = found.get(TAKEN) or found.get(DIGITIZED)
    try:
        whole = datetime.strptime(str(text)[:19], "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
    except ValueError:
        return None
    part = str(found.get(FRACTION) or "").strip()
    return whole + (float("0." + part) if part.isdigit() else 0.0)


def flags(found: dict[int, object], xmp: bool = False) -> dict[str, object]:
    """Provenance from tags."""
    taken, written = found.get(TAKEN), found.get(WRITTEN)
    return {
        "software": str(found.get(SOFTWARE) or found.get(11) or ""),
        "maker": bool(found.get(MAKER)),
        "moved": bool(taken and written and taken != written),
        "upright": found.get(ORIENTATION) not in (None, 0, 1),
        "rendered": found.get(RENDERED) if isinstance(found.get(RENDERED), int) else None,
        "meta": int(len(found) >= 5) + int(xmp),
    }


def largest_preview(data: bytes, tried: int = 8) -> bytes | None:
    """The largest whole JPEG inside a raw file, of the `tried` longest spans between its markers."""
    starts, at = [], -1
    while (at := data.find(b"\xff\xd8\xff", at + 1)) >= 0:
        starts.append(at)
    spans = []
    for start in starts:
        if (end := data.find(b"\xff\xd9", start)) >= 0:
            spans.append((start, end + 2))
    best = None
    for start, end in sorted(spans, key=lambda s: s[0] - s[1])[:tried]:
        try:
            head = jpeg.header(data[start:end])
        except jpeg.Unsupported:
            continue
        if best is None or head.width * head.height > best[0]:
            best = (head.width * head.height, data[start:end])
    return best[1] if best else None
