"""Key codecs: prefix bounds, namespaces, deadlines and index entries as binary strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of system keys.
FAMILY_PREFIX = b"\x00cf\x00"
TTL_PREFIX = b"\x00ttl\x00"
INDEX_PREFIX = b"\x00idx\x00"
FAMILY_CATALOG = b"\x00cf_meta"


def prefix_bound(prefix: bytes | str) -> bytes | str | None:
    """The least key above all keys with this prefix, or None if there is none (empty, or only FF bytes)."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    kept = raw.rstrip(b"\xff")
    if not kept:
        return None
    up = kept[:-1] + bytes([kept[-1] + 1])
    if isinstance(prefix, str):
        # Text compares like its UTF-8 bytes. The next code point is the least text above the prefix, with the gap of surrogates left out.
        for cut in range(len(prefix) - 1, -1, -1):
            if (code := ord(prefix[cut])) < 0x10FFFF:
                return prefix[:cut] + chr(0xE000 if code == 0xD7FF else code + 1)
        return None
    return up


def prefix_bound_column(key: Column) -> Column:
    """prefix_bound of a binary column; NULL for a null, empty or all-FF prefix."""
    kept = F.regexp_replace(F.hex(key), "(FF)+$", "")
    last = F.lpad(F.hex(F.conv(F.substring(kept, -2, 2), 16, 10).cast("long") + 1), 2, "0")
    return F.when(F.length(kept) > 0, F.unhex(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 2), last)))


def family_key(family: Column, key: Column) -> Column:
    return F.concat(F.lit(FAMILY_PREFIX), F.encode(family, "UTF-8"), F.lit(b"\x00"), key)


def split_family_key(raw: Column) -> tuple[Column, Column]:
    """(family, key) of a namespaced key; (NULL, key) of any other. A family name holds no zero byte."""
    text = F.hex(raw)
    head = FAMILY_PREFIX.hex().upper()
    rest = F.substring(text, F.lit(len(head) + 1), F.length(text))
    # Only even positions hold whole bytes, so the name is matched as pairs of digits.
    name = F.regexp_extract(rest, "^((?:0[1-9A-F]|[1-9A-F][0-9A-F])+)00", 1)
    is_family = F.substring(text, 1, len(head)).eqNullSafe(head) & (F.length(name) > 0)
    return F.when(is_family, F.decode(F.unhex(name), "UTF-8")), F.when(is_family, F.unhex(F.substring(rest, F.length(name) + 3, F.length(rest)))).otherwise(raw)


def deadline_bytes(ns: Column) -> Column:
    """Nanoseconds as 8 bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(ns), 16, "0"))


def deadline_ns(raw: Column) -> Column:
    """Reverse of deadline_bytes for deadlines before 2262; NULL for fewer than 8 bytes."""
    return F.when(F.octet_length(raw) >= 8, F.conv(F.hex(F.substring(raw, 1, 8)), 16, 10).cast("long"))


def index_key(name: Column, entry: Column, pk: Column) -> Column:
    return F.concat(F.lit(INDEX_PREFIX), F.encode(name, "UTF-8"), F.lit(b"\x00"), entry, F.lit(b"\x00"), pk)


def is_system_key(raw: Column) -> Column:
    """Deadlines, index entries and the catalog of families; the data of families is user data."""
    return F.startswith(raw, F.lit(TTL_PREFIX)) | F.startswith(raw, F.lit(INDEX_PREFIX)) | (raw == F.lit(FAMILY_CATALOG))
