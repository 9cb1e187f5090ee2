"""Identifiers: UUID checks, name-based UUIDs and chunk ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def bare_uuid(c: Column) -> Column:
    """The 32 hex digits of a UUID in any accepted spelling (braces, urn:uuid:, without dashes), or null."""
    text = F.translate(F.replace(F.replace(F.trim(c), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), "{}-", "")
    return F.when(text.rlike("^[0-9a-fA-F]{32}$"), F.lower(text))


def is_uuid(c: Column) -> Column:
    return bare_uuid(c).isNotNull()


def url_uuid(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace, as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))

    def told(h: Column) -> Column:
        variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
        return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))

    # The digest is named once, as an array's element: used five times it would be written five times, nested ids more.
    return F.get(F.transform(F.array(digest), told), F.lit(0))


def dashed(c: Column) -> Column:
    return F.regexp_replace(c, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def coerce_source_id(source_id: Column, url: Column) -> Column:
    """source_id if it is a UUID, else the URL's name-based UUID."""
    return F.when(is_uuid(source_id), source_id).otherwise(url_uuid(F.coalesce(url, F.lit(""))))


def chunk_id(source_id: Column, chunk_no: Column, random: bool = False) -> Column:
    """Id of a chunk. The same source and number give the same id, so a run repeated upserts; random=True gives new ones."""
    return F.uuid() if random else dashed(url_uuid(F.concat_ws("#", source_id, chunk_no.cast("string"))))
