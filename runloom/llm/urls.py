"""URL filters: a blocked Bloom filter in front of an exact join.

Listed entries are canonical ``host/path`` strings; each is a rule for its host, all
its subdomains and every path that starts with its path.  A URL is tested through its
keys: every suffix of its host at a dot with every prefix of its path whose length some
rule has, so it has no more keys a suffix than its path has characters.  The different
lengths, no more than the longest listed path has characters, are all that the driver
gets of a list.  The filter is a table of 512-bit blocks, one block and
eight bits per entry, so a key reads one block.  Keys whose bits are all set go to a
hash join with the listed entries, which removes the false positives; the longest rule
wins.  Without a rule a URL is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path and no
rule; equal URLs get equal verdicts; an empty list allows all; an empty table gives no
rows; rows repeat as they come; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
BITS, PER_KEY, ENTRIES_PER_BLOCK = 512, 8, 32


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """PER_KEY bit numbers within the block."""
    return F.transform(F.sequence(F.lit(1), F.lit(PER_KEY)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(BITS)).cast("int"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """block, words: eight 64-bit words of every block in which ``keys.key`` sets bits."""
    bit = F.col("_bit")
    one = F.expr("shiftleft(1L, cast(_bit % 64 AS int))")
    word = (
        keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("_bit"))
        .groupBy("block", F.floor(bit / 64).alias("_word"))
        .agg(F.bit_or(one).alias("_set"))
    )
    at = lambda i: F.coalesce(F.max(F.when(F.col("_word") == i, F.col("_set"))), F.lit(0).cast("long"))
    return word.groupBy("block").agg(F.array(*[at(i) for i in range(BITS // 64)]).alias("words"))


def possible(words: str, key: str) -> Column:
    """All bits of the key set in its block?"""
    bits = f"transform(sequence(1, {PER_KEY}), i -> cast(pmod(xxhash64({key}, i), {BITS}) AS int))"
    return F.expr(f"forall({bits}, b -> (shiftrightunsigned(get({words}, b div 64), b % 64) & 1L) = 1L)")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.  ``rules`` has rule_host,
    rule_path and rule_verdict; its host and path together are unique."""
    listed = rules.withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path")).dropDuplicates(["key"])
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.char_length("rule_path")).alias("lengths")).first()
    blocks = 1 + facts.n // ENTRIES_PER_BLOCK
    host, path = host_path(F.col("url"))
    # rows of one page stay apart even if they are equal
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    places = places.withColumn("_labels", labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(facts.lengths)]).cast("array<int>"), lambda n: n <= F.char_length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    keys = places.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    keys = keys.select("host", "path", F.concat("_suffix", F.lit("\n"), "_prefix").alias("key"))
    keys = keys.withColumn("block", _block(F.col("key"), blocks))
    maybe = keys.join(bloom_blocks(listed, blocks), "block").where(possible("words", "key")).select("host", "path", "key")
    hits = maybe.join(listed, "key")
    longest = F.struct(F.char_length("key"), F.char_length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(longest).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
