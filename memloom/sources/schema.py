"""Table schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOUN_TYPES = ("person", "place", "project", "thing")
ORIGINS = ("contribution", "discovery", "recycle")
TIERS = ("curated", "insight", "decision", "project", "transcript")
LINK_TYPES = ("temporal_sequence", "supersedes", "session_cooccur", "semantic")
LENSES = ("thematic", "questions", "vantages")

MEMORIES = (
    "id long, person string, subject string, body string, source_links array<struct<url:string,title:string,exchange_id:string>>, noun_type string, node_type string, "
    "node_key string, origin string, embedding array<float>, embedding_model string, access_count long, success_count long, fail_count long, weight double, "
    "last_accessed timestamp, archived boolean, expires_at timestamp, created_at timestamp, temporal_anchor_start date, temporal_anchor_end date, tier string, contributor string, "
    "source_system string, session_id string, exchange_id string, source_uri string, content_hash string, redaction_version string, metadata_json string, recall_form string, "
    "derived_from array<long>, derived_depth int, superseded_by long, project string"
)
LENS_ROWS = "lens_id long, memory_id long, perspective string, embedding array<float>, embedding_model string"
EDGES = "from_id long, to_id long, link_type string, strength double, hop_count long, last_walked timestamp"
LOG = "id long, from_id long, to_id long, link_type string, strength double, created_at timestamp"
DOORWAYS = "key string, member_ids array<long>, centroid array<double>, cut_gap double, query_count long, name string, stale boolean, formed_at timestamp"
EVENTS = "id long, created_at timestamp, query string, project string, session_id string, source string, shown array<struct<id:long,rank:int,score:double>>, used array<long>, attributed_at timestamp, attribution string"
LOOPS = "memory_id long, action string, project string, status string, detected_at timestamp, closed_at timestamp, closed_by long, close_reason string"
TOPICS = "slug string, name string, project string, centroid array<double>"
SEEDS = "entity string, version long, payload string, content_checksum string, compiled_at timestamp"


def violations(memories: DataFrame) -> DataFrame:
    """(id, rule): rows outside the vocabularies, or with a key that another row has; null breaks no vocabulary."""
    rules = F.array_compact(
        F.array(
            F.when(~F.col("noun_type").isin(*NOUN_TYPES), "noun_type"),
            F.when(~F.col("origin").isin(*ORIGINS), "origin"),
            F.when(F.col("id").isNull(), "id"),
        )
    )
    words = memories.select("id", F.explode(rules).alias("rule"))
    twice = memories.where(F.col("node_key").isNotNull()).groupBy("node_key").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).where("n > 1")
    return words.unionByName(twice.select(F.explode("ids").alias("id"), F.lit("node_key").alias("rule")))
