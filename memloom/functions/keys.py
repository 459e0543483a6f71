"""Deterministic keys and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_key(entity: Column, subject: Column, body: Column) -> Column:
    """entity|slug|digest; null without an entity."""
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), "[^a-z0-9]+", "_"), 1, 40), "^_+|_+$", "")
    digest = F.substring(F.sha2(F.concat_ws("|", entity, F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))), 256), 1, 6)
    return F.when(entity.isNotNull() & (entity != ""), F.concat_ws("|", entity, slug, digest))


def set_key(ids: Column) -> Column:
    """Identity of a set of ids: the first 16 hex digits of the hash of the sorted ids, joined by commas."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda x: x.cast("string")), ","), 256), 1, 16)


def exchange_id(url: Column, prompt: Column, answer: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat(part(url), F.lit("|"), part(prompt), F.lit("|"), part(answer)), 256), 1, 32)


def checksum(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.to_json(value), 256), 1, 16))
