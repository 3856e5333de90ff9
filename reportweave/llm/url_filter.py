"""URL filter: host and path rules first, then exact membership in a listed key set by a Bloom filter cascade.

Level 0 of the cascade encodes the listed keys, level 1 the unlisted keys of the universe that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on until nothing is let through wrongly.
A key is a url's host and path. The universe is every distinct key of the corpus, so each of its keys gets its exact answer from the first
level that lacks it. Pages are judged without a join: the levels' bit arrays are broadcast, in shards whose
size is checked, one shard at a time when they exceed the bound.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule, and its key is
empty. Repeated rows are judged alike; other columns (whatever their names) don't matter. An empty
table gives an empty result. A null key in the listed set lists nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .wordbytes import mix

#: (verdict, host, path), from the query's contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def positions(h1: np.ndarray, h2: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    salt = np.uint64((level * 64 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(mix(h1 + salt) ^ h2) % np.uint64(bits)


def first_absent(h1: np.ndarray, h2: np.ndarray, levels: list) -> np.ndarray:
    """For each key the first level that lacks it, or the number of levels."""
    out = np.full(len(h1), len(levels), np.int64)
    alive = np.arange(len(h1))
    for n, (bits, k, words) in enumerate(levels):
        if not len(alive):
            break
        inside = np.ones(len(alive), bool)
        for i in range(k):
            p = positions(h1[alive], h2[alive], n, i, bits)
            inside &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        out[alive[~inside]] = n
        alive = alive[inside]
    return out


def _absent_udf(spark, levels):
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("long")
    def absent(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(first_absent(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), shared.value))

    return absent


def _build_level(keys: DataFrame, level: int, bits: int, k: int) -> np.ndarray:
    """Bit array of the keys; the driver gets bits / 64 words at most."""

    def partial(frames):
        for pdf in frames:
            h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            p = np.concatenate([positions(h1, h2, level, i, bits) for i in range(k)])
            word, at = np.unique(p >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (p & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    rows = keys.select("h1", "h2").mapInPandas(partial, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits // 64 + 1, np.uint64)
    words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return words


def _inside_udf(spark, level: int, bits: int, k: int, words: np.ndarray):
    """Whether one level's filter has a key."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def inside(h1: pd.Series, h2: pd.Series) -> pd.Series:
        x, y = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
        out = np.ones(len(x), bool)
        for i in range(k):
            p = positions(x, y, level, i, bits)
            out &= (shared.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(out)

    return inside


def build_cascade(universe: DataFrame) -> list:
    """Levels (bits, hashes, words) for universe(h1, h2, listed), exact for each of its keys.

    A level encodes the keys of one side that all levels before it have; what it has wrongly of the other side, which is written down and
    about halves each time, is encoded by the next. So no level looks at more than the keys that the one before left.
    """
    spark, levels = universe.sparkSession, []
    n_listed, n_all = universe.agg(F.count_if("listed"), F.count("*")).first()
    if not n_listed:
        return levels
    rate, size = min(0.5, n_listed / (math.sqrt(2) * max(1, n_all - n_listed))), n_listed
    inside, other = (universe.filter(F.col("listed") == F.lit(x)).select("h1", "h2") for x in (True, False))
    while size:
        k = max(1, round(math.log2(1 / rate)))
        bits = max(64, math.ceil(size * k / math.log(2)))
        words = _build_level(inside, len(levels), bits, k)
        wrong = materialize(other.filter(_inside_udf(spark, len(levels), bits, k, words)("h1", "h2")), "url-level")
        levels.append((bits, k, words))
        inside, other, size, rate = wrong, inside, wrong.count(), 0.5
    return levels


def listed_by_cascade(rows: DataFrame, universe: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """rows(h1, h2, ...) with a boolean column in_list, exact for keys of universe(h1, h2, listed).

    max_bytes bounds what is broadcast at once: about 4 bytes a listed key are taken as the need, and keys are
    dealt by hash to as many shards as that calls for, each with its own cascade and its own pass. A cascade that turns out
    larger than that is an error, not a larger broadcast.
    """
    spark = rows.sparkSession
    n_listed = universe.filter("listed").count()
    shards = max(1, math.ceil(4 * n_listed / max_bytes))
    out = None
    for s in range(shards):
        mine = F.pmod(F.col("h1"), F.lit(shards)) == s
        levels = build_cascade(universe.filter(mine) if shards > 1 else universe)
        if sum(words.nbytes for _, _, words in levels) > max(max_bytes, 1 << 16):
            raise MemoryError(f"a cascade takes more than {max_bytes} bytes")
        part = rows.filter(mine) if shards > 1 else rows
        absent = _absent_udf(spark, levels)("h1", "h2")
        flag = (absent % 2 == 1) if levels else F.lit(False)
        part = part.withColumn("in_list", flag)
        out = part if out is None else out.unionByName(part)
    return out


def url_key(host: Column, path: Column) -> Column:
    """What a list names: host and path, without scheme, query and fragment."""
    return F.concat(host, path)


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; listed(key) holds the blocked keys (see url_key).

    A rule decides where one fits, else the cascade does: block if the key is listed, allow if not.
    """
    hashed = lambda df: df.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(7), "key"))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = hashed(rows.withColumn("key", url_key(F.col("host"), F.col("path"))))
    marks = listed.select("key").filter("key is not null").withColumn("listed", F.lit(True))
    every = rows.select("key").withColumn("listed", F.lit(False)).unionByName(marks)
    universe = hashed(every.groupBy("key").agg(F.bool_or("listed").alias("listed"))).select("h1", "h2", "listed")
    judged = listed_by_cascade(rows, materialize(universe, "url-universe"), max_bytes)
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("hit", hit)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("in_list"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
