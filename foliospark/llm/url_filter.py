"""URL filters with a Bloom filter cascade.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with its
own, and the longest fitting rule decides. Which rule keys fit is asked of a cascade of Bloom filters:
level 1 holds the listed keys, level 2 the keys of the corpus that level 1 takes for listed and aren't,
level 3 the listed keys that level 2 takes for such, and so on until a level has no false positive. Over
the whole key universe of the corpus the answer is exact, and no key is joined with a listed one. One cascade holds the
blocked keys, one the allowed ones; a key in neither leaves the url allowed.

Sizes: level 1 gets as many hashes as make its false positives about as many as there are listed keys, whatever the
universe (log2 of universe / listed; 1.45 bits a key for each). So no level grows beyond the list. A cascade whose level 1 has at most CONSTANT_BYTES is constant
arrays of the expression, and asking is a projection. A larger one is divided by the hash of the key into
splits of about SPLIT_KEYS keys, each with small filters of its own, kept as a table of one row per split; the url's keys go to the filters of their split by
a shuffle, salted so that a frequent key is spread. No number of listed keys or of path lengths is too large; the lengths of the rules' paths are sent
to the driver, each once, so at most as many numbers as the longest rule path has characters.

Defined cases: a null url or one without '://' has empty host and path, no rule, and is allowed; ties
of length go to block; a rule with a null in it fits nothing; repeated rows are judged each; very long urls are judged whole; an empty table or rule list is fine; columns named
host, path, rule or verdict are replaced by the result's own, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored

#: The rules of the query, (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Up to so many bytes of level 1 go into the plan as constants.
CONSTANT_BYTES = 16 << 20
SPLIT_KEYS = 4096
SALTS = 16
#: Of the deeper levels, and the least of level 1.
BITS_PER_KEY = 12
HASHES = 4
MAX_HASHES = 32
#: More levels mean broken hashing: at this error rate a universe of 2**60 keys needs fewer.
MAX_LEVELS = 40


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with the columns host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def _numbers(values: list[int], kind: str = "bigint") -> Column:
    """A constant array; folded to one literal by the optimizer, once."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def candidate_keys(path_lengths: list[int]) -> Column:
    """Every key that could fit: each suffix of the host at a dot, with each prefix of the path that has a rule's length."""
    labels = F.split("host", r"\.", -1)
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    )
    starts = F.filter(_numbers(path_lengths, "int"), lambda n: n <= F.length("path"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))


class Level:
    """One Bloom filter, of one or several splits; words: a constant array, or a table (split, words)."""

    def __init__(self, number: int, hashes: int, size: int, splits: int, words: Column | DataFrame):
        self.number, self.hashes, self.size, self.splits, self.words = number, hashes, size, splits, words

    def bit(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(64 * self.size))

    def holds(self, key: Column, words: Column) -> Column:
        out = None
        for i in range(self.hashes):
            b = self.bit(key, i)
            hit = F.getbit(F.get(words, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


def _split(key: Column, splits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(splits))


def _level(keys: DataFrame, number: int, hashes: int, per_key: int, n: int, splits: int) -> Level:
    """A Bloom filter over keys.key."""
    if splits > 1:
        n = keys.groupBy(_split(F.col("key"), splits).alias("s")).count().agg(F.max("count")).first()[0]
    level = Level(number, hashes, max(1, math.ceil(n * per_key / 64)), splits, None)
    at = keys.select(_split(F.col("key"), splits).alias("split"), F.explode(F.array(*[level.bit(F.col("key"), i) for i in range(hashes)])).alias("b"))
    words = at.groupBy("split", F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("word"))
    if splits == 1:
        got = {r["w"]: r["word"] for r in words.collect()}  # at most CONSTANT_BYTES of words
        level.words = _numbers([got.get(w, 0) for w in range(level.size)])
    else:
        every = keys.sparkSession.range(splits).select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(0), F.lit(level.size - 1))).alias("w"))
        dense = every.join(words, ["split", "w"], "left").groupBy("split").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("word", F.lit(0)).alias("word")))).alias("all"))
        level.words = stored(dense.select("split", F.transform("all", lambda x: x["word"]).alias("words")), f"level{number}")
    return level


class Cascade:
    """Exact membership of listed keys over a universe of keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, constant_bytes: int | None = None):
        """listed has a column key; universe has a column keys, an array of keys per row."""
        self.levels: list[Level] = []
        listed = listed.select("key").where("key IS NOT NULL").distinct()
        n = listed.count()
        asked = universe.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] if n else 0
        hashes = min(MAX_HASHES, max(HASHES, math.ceil(math.log2(max(2, asked / max(n, 1))))))
        per_key = max(BITS_PER_KEY, math.ceil(1.45 * hashes))
        most = CONSTANT_BYTES if constant_bytes is None else constant_bytes
        self.splits = 1 if n * per_key / 8 <= most else max(2, -(-n // SPLIT_KEYS))
        keep, other = listed, None
        while n and len(self.levels) < MAX_LEVELS:
            level = _level(keep, len(self.levels), hashes, per_key, n, self.splits)
            self.levels.append(level)
            hashes, per_key = HASHES, BITS_PER_KEY
            if other is None:  # the false positives of level 1, out of the whole universe
                seen = self._passing(universe.select(F.explode("keys").alias("key")), level)
                passed = seen.distinct().join(listed, "key", "left_anti")
            else:
                passed = self._passing(other, level)
            keep, other = stored(passed, "passed"), keep
            n = keep.count()
        if n:
            raise ValueError("the cascade did not end")
        self.table = None
        if self.splits > 1:
            for k, level in enumerate(self.levels):
                one = level.words.select("split", F.col("words").alias(f"words{k}"))
                self.table = one if self.table is None else self.table.join(one, "split")
            self.table = stored(self.table, "cascade")

    def _passing(self, keys: DataFrame, level: Level) -> DataFrame:
        if self.splits == 1:
            return keys.where(level.holds(F.col("key"), level.words))
        put = keys.distinct().withColumn("split", _split(F.col("key"), self.splits))
        return put.join(level.words, "split").where(level.holds(F.col("key"), F.col("words"))).select("key")

    def _answer(self, key: Column, words) -> Column:
        """Listed if the first level that does not hold the key is an even one, counted from 1."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key, words(i)), out).otherwise(F.lit(i % 2 == 1))
        return out

    def holds(self, key: Column) -> Column:
        """The answer as an expression, where the cascade is of constants."""
        return self._answer(key, lambda i: self.levels[i].words)

    def ask(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (key, ...) with the answer as column name; rows meet the filters of their split."""
        if self.splits == 1:
            return rows.withColumn(name, self.holds(F.col("key")))
        salted = self.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        put = rows.withColumns({"split": _split(F.col("key"), self.splits), "salt": F.floor(F.rand(7) * SALTS).cast("int")})
        return put.join(salted, ["split", "salt"]).withColumn(name, self._answer(F.col("key"), lambda i: F.col(f"words{i}"))).select(*rows.columns, name)


def filter_urls(pages: DataFrame, rules: DataFrame, constant_bytes: int | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. rules: verdict (block or allow), host, path."""
    keyed = rules.select("verdict", F.concat("host", "path").alias("key"), F.length("path").alias("n"))
    lengths = sorted(r["n"] for r in keyed.select("n").where("n IS NOT NULL").distinct().collect())
    parts = with_parts(pages)
    universe = parts.select(candidate_keys(lengths).alias("keys"))
    block = Cascade(keyed.where("verdict = 'block'"), universe, constant_bytes)
    allow = Cascade(keyed.where("verdict = 'allow'"), universe, constant_bytes)
    if block.splits == allow.splits == 1:
        fits = F.flatten(
            F.transform(
                candidate_keys(lengths),
                lambda k: F.when(block.holds(k), F.array(F.struct(F.length(k).alias("n"), F.lit(1).alias("b"), k.alias("rule"))))
                .when(allow.holds(k), F.array(F.struct(F.length(k).alias("n"), F.lit(0).alias("b"), k.alias("rule"))))
                .otherwise(F.array().cast("array<struct<n:int,b:int,rule:string>>")),
            )
        )
        best = parts.withColumn("_fs_best", F.array_max(fits))
    else:
        numbered = stored(parts.withColumn("_fs_no", F.monotonically_increasing_id()), "pages")
        asked = numbered.select("_fs_no", F.explode(candidate_keys(lengths)).alias("key"))
        fit = allow.ask(block.ask(asked, "b"), "a").where("a OR b")
        top = fit.groupBy("_fs_no").agg(F.max(F.struct(F.length("key").alias("n"), F.col("b").cast("int").alias("b"), F.col("key").alias("rule"))).alias("_fs_best"))
        best = numbered.join(top, "_fs_no", "left").drop("_fs_no")
    return best.withColumns(
        {"rule": F.col("_fs_best.rule"), "verdict": F.when(F.col("_fs_best.b") == 1, "block").otherwise("allow")}
    ).drop("_fs_best")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, r)) for r in RULES])).alias("verdict", "host", "path"))
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
             THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT p.page_id, p.host, p.path, r.action, r.rhost || r.rpath AS rule,
               row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
        FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
"""
