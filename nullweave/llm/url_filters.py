"""URL filters by hash-prefix lookup, in DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions.  Their 256-bit digests are compared with the rules'
in two steps, as in the public safe-browsing protocols: an equi-join on a short prefix of the digest, then the full
digest.  Of the rules that fit, the longest decides; of equal lengths, the longer host, then a block.

Equal (id, url) rows are counted before the join and restored after it, so a URL that a third of all rows have is
judged once; the join keeps the partitioning, and the second grouping needs no other shuffle when the rules are small
enough for Spark's own, size-checked broadcast.  Larger rule tables join by shuffle, whose skew adaptive execution
splits.  Path prefixes are taken at the lengths that rules have, host suffixes at the labels that rules have: one
row of bounded arrays.

Defined cases: a null URL, or one without ``://``, has empty host and path and gets the default verdict; null rules
and rules with an empty host are ignored; of equal rules with different verdicts, block wins; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BITS = 32


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from
    there to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, url, host, path, rule (host and path of the deciding rule, else null), verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``)."""
    listed = rules.where("host <> '' and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict")
    listed = listed.groupBy("r_host", "r_path").agg(F.max(F.col("verdict") == "block").alias("block"))
    listed = listed.withColumn("r_digest", F.sha2(expression(F.col("r_host"), F.col("r_path")), 256)).withColumn("key", prefix(F.col("r_digest")))
    shape = listed.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"), F.max(F.size(F.split("r_host", r"\."))).alias("labels"))

    host, path = split_url(F.col("url"))
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).groupBy("id", "url").agg(F.count("*").alias("n"))
    urls = urls.withColumn("host", host).withColumn("path", path).crossJoin(F.broadcast(shape))
    labels = F.split("host", r"\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count, F.coalesce("labels", F.lit(1)))), lambda k: F.array_join(F.slice(labels, count - k + 1, k), "."))
    prefixes = F.transform(F.filter("lengths", lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    forms = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(expression(h, p), 256))))
    expanded = urls.select("id", "url", "n", "host", "path", F.explode_outer(forms).alias("digest")).withColumn("key", prefix(F.col("digest")))

    hits = expanded.join(listed, "key", "left")
    sure = F.col("digest") == F.col("r_digest")
    size = F.length("r_host") + F.length("r_path")
    best = F.max(F.when(sure, F.struct(size.alias("size"), F.length("r_host").alias("host_size"), F.col("block"), F.concat("r_host", "r_path").alias("rule")))).alias("best")
    judged = hits.groupBy("id", "url").agg(F.first("n").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), "block").otherwise("allow")
    out = judged.select(F.col("id").alias(id_col), "url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "n")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("_copy", "n")
