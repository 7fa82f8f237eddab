"""Verdict-cache operators on tables of (cache_key, response_json, created_at)."""

from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import experts as E
from lurewatch.schemas import EXPERT_RESULT


def with_cache_key(df, url="url", text="text"):
    return df.withColumn("cache_key", E.cache_key(F.col(url), F.col(text)))


def latest(cache):
    """One row per key: the newest, ties by the larger response."""
    newest = F.max(F.struct("created_at", "response_json")).alias("e")
    return cache.groupBy("cache_key").agg(newest).select("cache_key", "e.response_json", "e.created_at")


def key_part(key):
    """The part of a stored cache that holds a key."""
    return F.pmod(F.xxhash64(key), F.lit(K.CACHE_KEY_PARTS)).cast("int")


def fresh(cache, now, ttl_hours=K.CACHE_TTL_HOURS, keys=None):
    """The valid entry of each key. A key is valid exactly if one of its entries is young enough, so the
    age filter comes before the grouping, and it compares the bare column, so it reaches the scan.

    With a table of ``keys`` only theirs: other entries are left out before the grouping, so a small batch
    shuffles the entries it asks for and not the cache.
    """
    young = cache.filter(F.col("created_at") >= F.lit(float(now) - float(ttl_hours) * 3600))
    return latest(young if keys is None else young.join(keys.select("cache_key").distinct(), "cache_key", "left_semi"))


def lookup(df, cache, now, ttl_hours=K.CACHE_TTL_HOURS, response_time_ms=0):
    """Add ``cached``: the stored result marked as a cache hit, or null. ``df`` has ``cache_key``."""
    return with_cached(df, fresh(cache, now, ttl_hours, df), response_time_ms)


def with_cached(df, valid, response_time_ms=0):
    """``lookup`` with the valid entries at hand. Where those are a written table, Spark splits a frequent key."""
    joined = df.join(valid, "cache_key", "left")
    return joined.withColumn("cached", as_hit(F.col("response_json"), response_time_ms)).drop(
        "response_json", "created_at"
    )


def as_hit(response_json, response_time_ms=0):
    stored = F.from_json(response_json, EXPERT_RESULT)
    hit = stored.withField("metadata.cache_hit", F.lit(True)).withField(
        "metadata.response_time_ms", F.lit(response_time_ms).cast("bigint")
    )
    return F.when(response_json.isNotNull(), hit)


def misses(df, cache, now, ttl_hours=K.CACHE_TTL_HOURS, skip_cache=False, ids="msg_id"):
    """One request row (cache_key, url, text, n_messages) per key without a valid entry.

    The request is that of the smallest id of its key. Keys collapse on the map side, before any row with
    a text is shuffled twice.
    """
    request = F.min(F.struct(ids, "url", "text")).alias("r")
    requests = (
        df.groupBy("cache_key")
        .agg(request, F.count(F.lit(1)).alias("n_messages"))
        .select("cache_key", "r.url", "r.text", "n_messages")
    )
    if skip_cache:
        return requests
    return without_cached(requests, fresh(cache, now, ttl_hours, df))


def without_cached(requests, valid):
    return requests.join(valid.select("cache_key"), "cache_key", "left_anti")


def entries(results, now, result="tier3_result"):
    """Cache rows of successful results; failed calls are not stored."""
    return results.filter(F.col(result)["metadata"]["error"].isNull()).select(
        "cache_key", F.to_json(F.col(result)).alias("response_json"), F.lit(float(now)).alias("created_at")
    )


def upsert(cache, new):
    """The cache with ``new`` put in: one row per key, the newest."""
    return latest(cache.unionByName(new))


def stats(cache):
    """(entry_count, oldest_entry, newest_entry); expired entries count, an empty cache gives nulls."""
    return cache.agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.min("created_at").alias("oldest_entry"),
        F.max("created_at").alias("newest_entry"),
    )
