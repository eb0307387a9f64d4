"""URL filters that change over time: dated list entries as validity intervals, and an as-of join with captures.

An entry (list, key, day, seq, kind ``add`` or ``remove``) changes from its day on; of several on one day the one of the greatest seq counts (equal ones: ``remove`` wins). Between an add and
the next entry of its list and key lies an interval. A key is a host or parent domain of it, or a host with the first segments of a path.

The join is by equality only: an interval is listed under each block of ``BLOCK_DAYS`` days that it touches, a capture asks for its own block, and the few intervals of a key
and block are filtered inside the row. First each distinct pair of key and day is answered once, so a host that makes up a third of all captures costs one row per day; the
captures then join those answers by key and day, on which even a hot host is spread. Columns only, no Python.

Defined results: a null url or one without a host matches nothing; a null day matches nothing; entries with a null list, key, day or kind are passed over; repeated entries count once, repeated
captures each have their own row. Without entries every verdict is ``none``. Input columns are kept; one named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tasks import let, packed, stage, unpacked

BLOCK_DAYS = 64
PATH_DEPTH = 2
ALLOW = "allow"  # the list whose entries permit; all others forbid
OUTPUT = ("host", "n_active", "active", "verdict")
SCHEME = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """Host in lower case without port and final dot, null where there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), SCHEME + r"([^/:?#]*)", 1), r"\.$", "")
    return F.when(host != "", host)


def keys_of(url: Column, depth: int = PATH_DEPTH) -> Column:
    """The keys under which a url may be listed."""
    path = F.regexp_extract(url, r"(?i)" + SCHEME + r"[^/?#]*/([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)

    def keys(host: Column) -> Column:
        domains = let(F.split(host, r"\."), lambda labels: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        prefixes = let(segments, lambda parts: F.when(F.size(parts) > 0, F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>")))
        return F.concat(domains, prefixes)

    return F.when(host_of(url).isNotNull(), let(host_of(url), keys)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, start, stop (exclusive, null while open) of the active spans."""
    given = entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND kind IS NOT NULL")
    last = F.max(F.struct(F.coalesce("seq", F.lit(-1)), (F.col("kind") == "remove").alias("gone")))
    daily = given.groupBy("list", "key", "day").agg(last["gone"].alias("gone"))
    following = Window.partitionBy("list", "key").orderBy("day")
    return daily.withColumn("stop", F.lead("day").over(following)).where("NOT gone").select("list", "key", F.col("day").alias("start"), "stop")


def block_of(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", block_days: int = BLOCK_DAYS, depth: int = PATH_DEPTH) -> DataFrame:
    """``captures`` with ``host``, ``n_active``, ``active`` ("list:key" in order) and ``verdict``: that of the longest active key, ``allow`` before ``block``, else ``none``."""
    kept = [c for c in captures.columns if c not in OUTPUT]
    rows = stage(captures.select(packed(kept).alias("_kept"), F.monotonically_increasing_id().alias("_row"), F.col(day).cast("date").alias("_day"), keys_of(F.col(url), depth).alias("_keys"), host_of(F.col(url)).alias("host")), "url-captures")
    asked = rows.select("_row", F.col("_day").alias("day"), F.explode("_keys").alias("key")).where("day IS NOT NULL")
    low, high = (F.lit(x).cast("date") for x in rows.agg(F.min("_day"), F.max("_day")).first())
    until = F.least(F.coalesce(F.date_sub("stop", 1), high), high)
    valid = intervals(entries).withColumns({"from": F.greatest("start", low), "until": until}).where("from <= until")
    spread = F.explode(F.sequence(block_of(F.col("from"), block_days), block_of(F.col("until"), block_days)))
    listed = valid.select("list", "key", "start", "stop", spread.alias("block")).groupBy("key", "block").agg(F.collect_list(F.struct("list", "start", "stop")).alias("spans"))
    probes = asked.select("key", "day").distinct().withColumn("block", block_of(F.col("day"), block_days))
    at_day = lambda s: (s["start"] <= F.col("day")) & (s["stop"].isNull() | (F.col("day") < s["stop"]))
    answers = probes.join(listed, ["key", "block"]).select("key", "day", F.transform(F.filter("spans", at_day), lambda s: s["list"]).alias("lists")).where(F.size("lists") > 0)
    hits = asked.join(answers, ["key", "day"]).select("_row", F.explode("lists").alias("list"), "key")
    found = hits.groupBy("_row").agg(
        F.count("*").alias("_n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "list", "key"))), ",").alias("_active"),
        F.max(F.struct(F.length("key"), (F.col("list") == ALLOW).alias("permits"))).alias("_best"),
    )
    verdict = F.when(F.col("_best").isNull(), "none").when(F.col("_best.permits"), "allow").otherwise("block")
    return rows.join(found, "_row", "left").select(*unpacked("_kept", kept), "host", F.coalesce("_n", F.lit(0)).alias("n_active"), F.coalesce("_active", F.lit("")).alias("active"), verdict.alias("verdict"))
