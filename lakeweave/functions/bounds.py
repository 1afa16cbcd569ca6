"""Column bounds as Iceberg's single-value bytes, from and to the values of statistics JSON."""

from __future__ import annotations

import re
import struct
from datetime import UTC, date, datetime
from decimal import Decimal

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _micros(text: str) -> int:
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def encode(kind: str, value) -> bytes | None:
    """``value`` as the JSON of statistics has it; None for a type without bounds."""
    if value is None:
        return None
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "date"):
        return struct.pack("<i", (date.fromisoformat(value) - date(1970, 1, 1)).days if kind == "date" else int(value))
    if kind == "long":
        return struct.pack("<q", int(value))
    if kind in ("timestamp", "timestamptz"):
        return struct.pack("<q", _micros(value))
    if kind == "float":
        return struct.pack("<f", float(value))
    if kind == "double":
        return struct.pack("<d", float(value))
    if kind == "string":
        return value.encode()
    if m := re.fullmatch(r"decimal\(\d+,\s*(\d+)\)", kind):
        unscaled = int(Decimal(str(value)).scaleb(int(m[1])).to_integral_exact())
        return unscaled.to_bytes((unscaled + (unscaled < 0)).bit_length() // 8 + 1, "big", signed=True)
    return None


def decode(kind: str, data: bytes | None):
    if data is None:
        return None
    if kind == "boolean":
        return data != b"\x00"
    if kind == "date":
        return date.fromordinal(date(1970, 1, 1).toordinal() + struct.unpack("<i", data)[0]).isoformat()
    if kind == "int":
        return struct.unpack("<i", data)[0]
    if kind == "long":
        return struct.unpack("<i" if len(data) == 4 else "<q", data)[0]
    if kind in ("timestamp", "timestamptz"):
        micros = struct.unpack("<q", data)[0]
        t = datetime.fromordinal(_EPOCH.toordinal() + micros // 86_400_000_000)
        rest = micros % 86_400_000_000
        s, u = divmod(rest, 1_000_000)
        return t.strftime("%Y-%m-%d") + f"T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{u:06d}"
    if kind == "float":
        return struct.unpack("<f", data)[0]
    if kind == "double":
        return struct.unpack("<f" if len(data) == 4 else "<d", data)[0]
    if kind == "string":
        return data.decode("utf-8", "replace")
    if m := re.fullmatch(r"decimal\(\d+,\s*(\d+)\)", kind):
        return str(Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-int(m[1])))
    return None
