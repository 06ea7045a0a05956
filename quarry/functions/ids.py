"""Identities: name-based UUIDs, content hashes, fingerprints. All are plain column expressions, so a plan that is run again gives the same ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name spaces of document and chunk ids. Fixed values.
DOCUMENT_SPACE = "9c4064c4-672b-4aa6-b3ba-bf18f0b94670"
POINT_SPACE = "9f8b4a1e-6c75-4d2a-b03e-517f22c8d941"


def uuid5(space: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name in a name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def document_id(source_id: Column, uri: Column) -> Column:
    return uuid5(DOCUMENT_SPACE, F.concat(source_id, F.lit("\x00"), uri))


def point_id(document: Column, index: Column) -> Column:
    return uuid5(POINT_SPACE, F.concat_ws("/", document, index.cast("string")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(size: Column, mtime_ns: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), mtime_ns.cast("string"))
