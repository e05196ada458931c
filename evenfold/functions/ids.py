"""Identifiers: one plain form for every spelling of a UUID, and UUID v5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
NIL_UUID = "00000000-0000-0000-0000-000000000000"

_PLAIN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bare(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), r"^\s*\{?\s*(urn:uuid:)?|\}?\s*$", ""), F.lit("-"), F.lit(""))


def uuid_hex(c: Column | str) -> Column:
    """The 32 hex digits of a UUID in any spelling (case, hyphens, braces, ``urn:uuid:``,
    white space around); null for null and for whatever isn't a UUID."""
    bare = _bare(_col(c))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def hyphened(h: Column) -> Column:
    """The plain form of 32 hex digits."""
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def plain_uuid(c: Column | str) -> Column:
    """Plain form of a UUID in any spelling; other strings come back trimmed, null stays null."""
    c = _col(c)
    spaced = F.regexp_replace(_bare(c), "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(c.rlike(_PLAIN), c).otherwise(F.coalesce(F.regexp_substr(spaced, F.lit(_PLAIN)), F.trim(c)))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name, built from SHA-1; null for a null name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
