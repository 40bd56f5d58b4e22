"""URL filter lists: host-suffix and path-prefix expressions joined on short hash prefixes.

Every URL is expanded into the expressions that a rule could consist of: each suffix of its host at
a label border, with each prefix of its path. Only suffixes with a number of labels, and prefixes with
a length, that some rule has are made, so a long host or path costs no more than the rule set asks for.
Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; full digests confirm the
hit, and the longest rule wins (then the longer host, then block before allow).

Defined results: a null URL, or one without "://", has an empty host and path and gets the default
verdict. URLs of any length are judged whole. Each distinct host and path is judged once and meets its rows by an equi-join, so repeated rows get the same verdict, and a row that is computed again (a lost executor) can't
meet another row's. Ties between rules are settled as above. Empty tables give empty results. Extra columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fits_broadcast

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
HEX_PREFIX = 8  # hex digits, so 32 bits, of the joined hash prefix
MOST_BROADCAST_RULES = 200_000
SALT = 16


def split_url(url):
    """(host, path): host after the first "://" up to / ? # with A-Z lower-cased; path from there up to ? or #."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with their expression, digest and hash prefix; one row for each expression, block before allow."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("action").alias("r_action"))  # "block" sorts after "allow"
        .select("r_host", "r_path", "r_action", F.concat("r_host", "r_path").alias("r_expr"))
        .withColumn("r_digest", F.sha2("r_expr", 256))
        .withColumn("h_prefix", F.substring("r_digest", 1, HEX_PREFIX))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = hashed_rules(rules)
    shape = known.agg(F.collect_set(F.size(F.split("r_host", "\\."))).alias("k"), F.collect_set(F.length("r_path")).alias("l")).first()
    labels, lengths = F.lit(sorted(shape["k"])).cast("array<int>"), F.lit(sorted(shape["l"])).cast("array<int>")
    urls = rows.where("host != ''").select("host", "path").distinct().withColumn("parts", F.split("host", "\\."))
    n_parts = F.size("parts")
    suffixes = F.transform(F.filter(labels, lambda k: k <= n_parts), lambda k: F.array_join(F.slice("parts", n_parts - k + 1, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", 1, n))
    exprs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    looked = urls.select("host", "path", F.explode(exprs).alias("expr")).withColumn("digest", F.sha2("expr", 256))
    looked = looked.select("host", "path", "digest", F.substring("digest", 1, HEX_PREFIX).alias("h_prefix"))
    if fits_broadcast(known, MOST_BROADCAST_RULES):
        met = looked.join(F.broadcast(known), "h_prefix")
    else:  # a common expression is spread over SALT partitions
        looked = looked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int"))
        met = looked.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["h_prefix", "salt"])
    hit = F.when(
        F.col("digest") == F.col("r_digest"),
        F.struct(F.length("r_expr").alias("n"), F.length("r_host").alias("h"), F.col("r_action").alias("action"), F.col("r_expr").alias("expr")),
    )
    best = met.groupBy("host", "path").agg(F.max(hit).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.expr").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
