"""URL filters: a blocked Bloom filter, then an exact hash join.

Rules give a host, a path and a verdict; a rule fits its host and all
subdomains when the url's path starts with the rule's, and the longest fitting
rule wins. Besides, single canonical URLs can be listed as blocked. Both are
keys of one list.

Each url yields the keys under which a rule could hold it: its last
1, 2 .. labels of the host (up to the most that a rule has) with the path cut
to each length that a rule's path has. The keys are
probed against a blocked Bloom filter: 512-bit blocks of eight longs, one
block per key and eight bits in it. The filter is built by ``bit_or`` per
block and broadcast while it is at most ``MAX_FILTER_BYTES``; a larger one is joined by block as a shuffle. Keys that
pass are joined with the exact list, which removes false positives. All
of it is DataFrame functions.

Defined results: null urls and urls without ``://`` have an empty host and
path, fit no rule and are allowed unless listed. A-Z of hosts are lower-cased, nothing else.
Rules of equal length: the longer host wins, then block. Repeated pages keep their
rows. An empty list allows everything. Extra columns of ``pages`` stay; the added ones replace columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 512
BITS_PER_KEY = 12
MAX_FILTER_BYTES = 32 << 20
SALTS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The rules of the registered query, and words in the hosts of the URLs that it lists.
LISTED_HOSTS = ("casino", "bets", "pills")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path and query without scheme, fragment, ``www.``, last slash and utm parameters."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/$", ""),
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def advertising(pages: DataFrame, words=LISTED_HOSTS) -> DataFrame:
    """A list made from the pages: the ``url`` of every one whose host holds one of the words."""
    host = host_of(F.col("url").cast("string"))
    hit = F.lit(False)
    for w in words:
        hit = hit | host.contains(w)
    return pages.filter(hit).select("url")


def listed_keys(rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``(key, rule, verdict, size)`` of rules and of listed canonical urls (a ``url`` column)."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _UPPER.lower())
    out = rules.select(F.concat(F.lit("r "), host, F.lit(" "), F.coalesce("path", F.lit(""))).alias("key"),
                       F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"), F.lower("verdict").alias("verdict"),
                       F.length(host).alias("host_size"))
    if listed is not None:
        out = out.unionByName(listed.filter("url is not null").select(
            F.concat(F.lit("u "), canonical(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"),
            F.lit("block").alias("verdict"), F.lit(0).alias("host_size")))
    return out.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"),
                                  F.max("host_size").alias("host_size"))     # 'block' > 'allow'


def _bits(key: Column) -> Column:
    """Eight longs with one bit each: the key's mask in its block."""
    h = F.xxhash64(key, F.lit(17))
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"),
                                     F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(8)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """A row per block that has keys: block and its eight words."""
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("b"))
    return rows.groupBy("block").agg(*[F.bit_or(F.col("b")[i]).alias(f"w{i}") for i in range(8)])


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url",
                bits_per_key: int = BITS_PER_KEY, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    keys = listed_keys(rules, listed)
    n = keys.count()
    shape = rules.agg(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\."))),
                      F.collect_set(F.length(F.coalesce("path", F.lit(""))))).first()
    most_labels, lengths = shape[0] or 0, sorted(shape[1] or [])
    blocks = max(1, -(-n * bits_per_key // BLOCK_BITS))

    def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if rows * row_bytes <= max_filter_bytes else df

    u = F.col(url).cast("string")
    rows = pages.select(F.struct("*").alias("row"), u.alias("page_url"), host_of(u).alias("page_host"), path_of(u).alias("page_path"),
                        F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).alias("salt"))
    with_url = F.locate("://", F.col("page_url")) > 0
    by_host = ([F.substring_index("page_host", ".", -k) for k in range(1, most_labels + 1)])
    by_path = [F.when(F.length("page_path") >= n_chars, F.substring("page_path", 1, n_chars)) for n_chars in lengths]
    every = [F.concat(F.lit("r "), h, F.lit(" "), p) for h in by_host for p in by_path]
    if listed is not None:
        every.append(F.concat(F.lit("u "), canonical(F.col("page_url"))))

    # equal urls are probed once per salt, so a url of a third of all rows is dealt to many tasks
    probes = (rows.filter(with_url).select("page_url", "page_host", "page_path", "salt").distinct()
              .select("page_url", "salt", F.explode(F.array_distinct(F.array_compact(F.array(*every)))).alias("key"))
              if every else rows.select("page_url", "salt", F.lit("").alias("key")).limit(0))
    words = small(bloom(keys, blocks), blocks, 96)
    possible = (probes.withColumn("block", _block(F.col("key"), blocks)).withColumn("b", _bits(F.col("key")))
                .join(words, "block"))
    for i in range(8):
        possible = possible.filter(F.col(f"w{i}").bitwiseAND(F.col("b")[i]) == F.col("b")[i])
    exact = small(keys, n, 256) if n * 256 <= max_filter_bytes else keys.hint("shuffle_hash")
    exact = possible.select("page_url", "salt", "key").join(exact, "key")
    # a rule before a listed url, the longest rule, then the longer host, then block
    best = F.max(F.struct(F.col("rule").isNotNull().alias("by_rule"), F.length("rule").alias("size"),
                          F.col("host_size"), F.col("verdict"), F.col("rule")))
    verdicts = exact.groupBy("page_url", "salt").agg(best.alias("best"))
    judged = (rows.filter(with_url).alias("p")
              .join(verdicts.alias("v"), (F.col("p.page_url") == F.col("v.page_url")) & (F.col("p.salt") == F.col("v.salt")), "left")
              .select("p.row", "p.page_host", "p.page_path", "v.best"))
    no_url = rows.filter(~F.coalesce(with_url, F.lit(False))).select(
        "row", "page_host", "page_path", F.lit(None).cast(judged.schema["best"].dataType).alias("best"))
    added = {"host": F.col("page_host"), "path": F.col("page_path"), "rule": F.col("best.rule"),
             "verdict": F.coalesce(F.col("best.verdict"), F.lit("allow"))}
    old = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in added]
    return judged.unionByName(no_url).select(*old, *[v.alias(k) for k, v in added.items()])


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; the rule's verdict, or else block for a listed URL, allow for others."""
    return filter_urls(pages.select("page_id", "url"), rules, listed).select("page_id", "host", "path", "rule", "verdict")
