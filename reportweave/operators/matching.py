"""Matching report metrics to the bank, in phases from cheap to costly; embeddings; the match memo."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import text as X
from reportweave.operators.durable import materialize
from reportweave.operators.greedy import shuffled
from reportweave.operators.retrieval import topk_dense, topk_sparse
from reportweave.sources.adapters import latest

DIMS = 1536
#: Names that are few enough to be one batch of first_near_names.
BATCH = 10_000


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def match_exact(m: DataFrame, bank: DataFrame) -> DataFrame:
    """(mention_id, kpi_id) by name within the subdomain. m: mention_id, subdomain, name."""
    b = bank.select("kpi_id", F.col("subdomain").alias("s"), name_key(F.col("name")).alias("k"))
    return m.select("mention_id", "subdomain", name_key(F.col("name")).alias("mk")).join(shuffled(b), (F.col("mk") == F.col("k")) & (F.col("subdomain") == F.col("s"))).select("mention_id", "kpi_id")


def match_alias(m: DataFrame, bank: DataFrame) -> DataFrame:
    a = bank.select("kpi_id", F.col("subdomain").alias("s"), F.explode("aliases").alias("alias")).select("kpi_id", "s", name_key(F.col("alias")).alias("k"))
    return m.select("mention_id", "subdomain", name_key(F.col("name")).alias("mk")).join(shuffled(a), (F.col("mk") == F.col("k")) & (F.col("subdomain") == F.col("s"))).select("mention_id", "kpi_id").distinct()


def match_lineage(m: DataFrame, bank: DataFrame) -> DataFrame:
    """By equal sorted lineage and aggregation, both sides not empty."""
    key = lambda lineage, agg: F.concat_ws("|", X.normalize_agg(agg), F.array_join(F.array_sort(lineage), "|"))
    some = lambda df: df.filter(F.size("lineage") > 0)
    b = some(bank).select("kpi_id", F.col("subdomain").alias("s"), key(F.col("lineage"), F.col("agg")).alias("k"))
    m = some(m).select("mention_id", "subdomain", key(F.col("lineage"), F.col("agg")).alias("mk"))
    return m.join(shuffled(b), (F.col("mk") == F.col("k")) & (F.col("subdomain") == F.col("s"))).select("mention_id", "kpi_id")


def match_virtual(m: DataFrame, bank: DataFrame) -> DataFrame:
    """By the aliases that a mention's sheet suggests, against names and aliases."""
    v = m.select("mention_id", "subdomain", F.explode(X.virtual_aliases(F.col("name"), F.col("sheet"))).alias("v"))
    names = bank.select("kpi_id", F.col("subdomain").alias("s"), F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select("kpi_id", "s", name_key(F.col("n")).alias("k"))
    return v.join(shuffled(names), (F.col("v") == F.col("k")) & (F.col("subdomain") == F.col("s"))).select("mention_id", "kpi_id").distinct()


def _pieces(df: DataFrame, name: str, length: Column, edits: Column) -> DataFrame:
    """df with one row for each of the edits + 1 pieces that a name of this length is cut into: i, start (from 1) and size."""
    cut = df.withColumns({"l": length.cast("int"), "e": edits.cast("int")}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    at = lambda i: F.floor(i * F.col("l") / (F.col("e") + 1)).cast("int")
    return cut.withColumns({"start": at(F.col("i")) + 1, "size": at(F.col("i") + 1) - at(F.col("i"))})


def spread(names: DataFrame) -> DataFrame:
    """names over all shuffle partitions: Spark puts small tables into one task, which would hold all pieces of all names."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_names(a: DataFrame, b: DataFrame, ratio: Callable[[Column, Column], Column], threshold: float, sides: int = 1) -> DataFrame:
    """(subdomain, x, y, ratio) of the names of a(subdomain, x) and b(subdomain, y) that are at least threshold alike.

    A name y of length l that is so like x differs by at most e edits, e growing with l. Cut into e + 1 pieces, one of them stands unchanged in x,
    at most e places off. So names meet through an equal piece, an equi-join, and ratios are taken of those that met only. `sides` is 1 for
    Levenshtein's ratio; matching blocks (2) allow twice the edits and lengths farther apart.
    """
    edits = lambda l: F.floor(F.lit((1 - threshold) / threshold * sides) * l + 1e-9)
    shortest = threshold if sides == 1 else threshold / (2 - threshold)
    y = spread(b.select("subdomain", "y").filter("y <> ''").distinct())
    y = _pieces(y, "y", F.length("y"), edits(F.length("y"))).select("subdomain", "y", "l", "i", F.expr("substring(y, start, size)").alias("piece"))
    x = spread(a.select("subdomain", "x").filter("x <> ''").distinct())
    m = F.length("x")
    x = x.withColumn("other", F.explode(F.sequence(F.ceil(m * shortest - 1e-9).cast("int"), F.floor(m / shortest + 1e-9).cast("int"))))
    x = _pieces(x, "x", F.col("other"), edits(F.col("other"))).withColumn("at", F.explode(F.sequence(F.col("start") - F.col("e"), F.col("start") + F.col("e"))))
    x = x.filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.length("x"))).select("subdomain", "x", "l", "i", F.expr("substring(x, at, size)").alias("piece")).distinct()
    met = x.join(shuffled(y), ["subdomain", "l", "i", "piece"]).select("subdomain", "x", "y").distinct()
    return met.withColumn("ratio", ratio(F.col("x"), F.col("y"))).filter(F.col("ratio") >= threshold)


def _information(names: DataFrame) -> DataFrame:
    """(l, p, bits) of names(y, l): what the p-th character of names of length l tells beyond the two before it, on average."""
    grams = F.transform(F.sequence(F.lit(1), F.col("l")), lambda p: F.substring("y", F.greatest(p - 2, F.lit(1)), F.least(p, F.lit(3))))
    n = names.select("l", F.posexplode(grams).alias("p", "gram")).groupBy("l", "p", "gram").agg(F.count("*").alias("n"))
    before = n.groupBy("l", "p", F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("n").alias("n"))
    sums = lambda df: df.groupBy("l", "p").agg(F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("n").alias("total"))
    return sums(n).join(sums(before).select("l", "p", F.col("s").alias("of")), ["l", "p"]).select("l", "p", ((F.col("of") - F.col("s")) / F.col("total")).alias("bits"))


def _most_edits(longer: Column | int, threshold: float) -> Column:
    return F.floor(longer * F.lit(1 - threshold) + 1e-9).cast("int")


def _cuts(names: DataFrame, threshold: float) -> DataFrame:
    """(l, e, starts): where names(y, l) of length l are cut into e + 1 pieces that tell about the same, so that a beginning that most names share is no piece of its own."""
    bits, rows = {}, []
    for r in _information(names).orderBy("l", "p").collect():  # as many rows as all lengths together
        bits.setdefault(r["l"], []).append(max(r["bits"], 0.0))
    for l, each in bits.items():
        told = np.cumsum(np.array(each) + 1e-6)
        for e in range(int((1 - threshold) * l), int((1 - threshold) / threshold * l + 1e-6) + 2):
            starts = [i * l // (e + 1) for i in range(e + 1)]
            for i in range(1, e + 1 if e < l else 0):  # no piece is empty, unless there are more than characters
                starts[i] = int(np.clip(np.searchsorted(told, told[-1] * i / (e + 1)) + 1, starts[i - 1] + 1, l - (e + 1 - i)))
            rows.append({"l": l, "e": e, "starts": [x + 1 for x in starts]})
    return names.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<l: int, e: int, starts: array<int>>>")))


def first_near_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(x, value) of the names a(x) with a name more than `least` alike by Levenshtein's ratio among b(y, row, value): the value of the first row of all of them.

    Two names of lengths l and m that are so alike differ by at most e edits. Cut into e + 1 pieces, one of y's stands unchanged in x, at most i places off if it is the i-th, and
    e - i seen from the end. So names meet through an equal piece and are compared there. Rows of b come in batches, the first ones first, each about three times
    those before: a name that has found its row asks for no later one, so that one that is like a share of all names isn't compared with all of these.
    """
    names = b.filter("y <> '' and row is not null").groupBy("y").agg(F.min("row").alias("row"), F.min_by("value", "row").alias("value")).withColumn("l", F.length("y"))
    names = materialize(names, "named-rows")
    total, parts = names.count(), 1
    while parts < 256 and total > BATCH * parts:
        parts *= 4
    cuts = F.broadcast(_cuts(names, least))
    names = materialize(names.repartitionByRange(parts, "row").withColumn("part", F.spark_partition_id()), "ordered-rows")
    around = lambda n: F.explode(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int")))
    piece = lambda name, at: F.expr(f"substring({name}, {at}, size)")

    def cut(df: DataFrame, *columns: str) -> DataFrame:
        each = df.withColumn("e", _most_edits(F.greatest("l", "m"), least)).join(cuts, ["l", "e"]).select(*columns, "l", "m", "e", "starts", F.posexplode("starts").alias("i", "start"))
        return each.withColumn("size", F.coalesce(F.get("starts", F.col("i") + 1), F.col("l") + 1) - F.col("start")).drop("starts")

    rest, found, done = materialize(spread(a.select("x").filter("x <> ''").distinct()).withColumn("m", F.length("x")), "open-names"), None, 0
    upto, tasks = 1, 4 * max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    while True:
        y = spread(names.filter((F.col("part") >= done) & (F.col("part") < upto)).withColumn("m", around(F.col("l"))))
        y = cut(y, "y", "row", "value").select("y", "row", "value", "l", "m", "e", "i", piece("y", "start").alias("piece"))
        x = cut(rest.withColumn("l", around(F.col("m"))), "x")
        off, left = F.col("m") - F.col("l"), F.col("e") - F.col("i")
        low, high = F.greatest(F.col("start") - F.col("i"), F.col("start") + off - left, F.lit(1)), F.least(F.col("start") + F.col("i"), F.col("start") + off + left, F.col("m") - F.col("size") + 1)
        x = x.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("at", F.explode(F.sequence("low", "high"))).select("x", "l", "m", "i", piece("x", "at").alias("piece"))
        x, y = (df.repartition(tasks, "l", "m", "i", "piece") for df in (x, y))  # few bytes, many meetings: else Spark makes few tasks
        met = x.join(shuffled(y), ["l", "m", "i", "piece"]).withColumn("edits", F.expr("levenshtein(x, y, e)"))
        longer = F.greatest("l", "m")
        near = met.filter((F.col("edits") >= 0) & ((longer - F.col("edits")) / longer > least))
        hit = materialize(near.groupBy("x").agg(F.min_by("value", "row").alias("value")), "first-near")
        found = hit if found is None else found.unionByName(hit)
        if upto >= parts:
            return found
        rest = materialize(rest.join(shuffled(hit.select("x")), "x", "left_anti"), "open-names")
        if rest.isEmpty():
            return found
        done, upto = upto, upto * 4


def match_fuzzy(m: DataFrame, bank: DataFrame, ratio: Callable[[Column, Column], Column] = X.lev_ratio, threshold: float = 0.85) -> DataFrame:
    """(mention_id, kpi_id, ratio) of names at least threshold alike within the subdomain."""
    a = m.select("mention_id", "subdomain", name_key(F.col("name")).alias("x"))
    b = bank.select("kpi_id", "subdomain", name_key(F.col("name")).alias("y"))
    near = near_names(a, b, ratio, threshold, 1 if ratio is X.lev_ratio else 2)
    return a.join(shuffled(near), ["subdomain", "x"]).join(shuffled(b), ["subdomain", "y"]).select("mention_id", "kpi_id", F.round("ratio", 6).alias("ratio"))


def match_fuzzy_any(m: DataFrame, bank: DataFrame, ratio: Callable[[Column, Column], Column] = X.seq_ratio, threshold: float = 0.85) -> DataFrame:
    """(mention_id, kpi_id, ratio) by a name or an alias at least threshold alike, the best of a bank row's."""
    names = bank.select("kpi_id", "subdomain", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name <> ''")
    return match_fuzzy(m.filter("name <> ''"), names, ratio, threshold).groupBy("mention_id", "kpi_id").agg(F.max("ratio").alias("ratio"))


def match_fuzzy_levenshtein(m: DataFrame, bank: DataFrame) -> DataFrame:
    return match_fuzzy_any(m, bank, X.lev_ratio)


def match_waterfall(m: DataFrame, bank: DataFrame, phases: list[tuple[str, Callable]], accept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(mention_id, kpi_id, phase): the first phase that hits wins, then the least kpi_id. accept filters candidates before."""
    every = None
    for n, (name, match) in enumerate(phases):
        hit = match(m, bank).select("mention_id", "kpi_id", F.lit(n).alias("n"), F.lit(name).alias("phase"))
        every = hit if every is None else every.unionByName(hit)
    return latest(accept(every), ["mention_id"], "n", "kpi_id").select("mention_id", "kpi_id", "phase")


#: Confidence of a match by its phase.
PHASE_CONFIDENCE = {"exact": 1.0, "alias": 0.97, "lineage": 0.95, "virtual": 0.9, "fuzzy": 0.88}


def phase_confidence(phase: Column) -> Column:
    out = F.lit(0.0)
    for name, value in PHASE_CONFIDENCE.items():
        out = F.when(phase == name, value).otherwise(out)
    return out


def match_scoped(m: DataFrame, bank: DataFrame, found: DataFrame, rematch: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], least: float = 0.9, k: int = 10) -> DataFrame:
    """(mention_id, kpi_id, phase, confidence, widened) after mentions without a match, or below `least`, were matched in the whole sector too.

    Their candidates there are the k bank rows of other subdomains whose names are nearest by the cosine of hash embeddings; rematch(mentions,
    bank, candidates) runs the phases over those, with subdomains set aside. The wider match counts if it is strictly more confident.
    """
    scored = materialize(found.withColumn("confidence", phase_confidence(F.col("phase"))), "found")
    open_ = materialize(m.join(scored.filter(F.col("confidence") >= least).select("mention_id"), "mention_id", "left_anti"), "open")
    q = F.concat_ws("|", "subdomain", name_key(F.col("name")))
    asked = open_.select(q.alias("q"), F.col("subdomain").alias("own"), name_key(F.col("name")).alias("n")).distinct()
    named = bank.select(F.col("kpi_id"), F.col("subdomain").alias("s"), name_key(F.col("name")).alias("y"))
    holders = named.groupBy("y").agg(F.collect_set("s").alias("scopes"))
    vectors = materialize(hash_embed(holders.select("y", F.col("y").alias("n")), "y", "n"), "bank-vectors")
    near = topk_sparse(hash_embed(asked, "q", "n"), vectors, k, asked.select("q", "own"), holders)
    firsts = named.withColumn("_n", F.row_number().over(W.partitionBy("y", "s").orderBy("kpi_id"))).filter(F.col("_n") <= k).drop("_n")  # others can't be among k
    rows = open_.select("mention_id", "subdomain", q.alias("q")).join(near, "q").join(firsts, "y").filter("s <> subdomain")
    top = materialize(rows.withColumn("_n", F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("cosine"), "kpi_id"))).filter(F.col("_n") <= k).select("mention_id", "kpi_id"), "near")
    anywhere = lambda df: df.withColumn("subdomain", F.lit("*"))
    wide = rematch(anywhere(open_), anywhere(bank), top)
    wide = wide.select("mention_id", "kpi_id", "phase", phase_confidence(F.col("phase")).alias("confidence"), F.lit(True).alias("widened"))
    both = scored.select("mention_id", "kpi_id", "phase", "confidence", F.lit(False).alias("widened")).unionByName(wide)
    return latest(both, ["mention_id"], F.desc("confidence"), "widened")


def hash_embed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors (key, slot, w): every token adds +-1 at the slot that its SHA-256 modulo DIMS names.

    The modulus is put together from the low twelve bits (modulo 512) and the sum of the hex digits (modulo 3). Such
    vectors carry no meaning: equal words only.
    """
    tokens = df.select(key, F.explode(F.split(F.lower(F.trim(text)), r"\s+")).alias("t")).filter("t <> ''")
    h = tokens.withColumn("h", F.sha2("t", 256))
    low = F.conv(F.substring("h", 62, 3), 16, 10).cast("int")
    digits = F.aggregate(F.split("h", ""), F.lit(0), lambda a, x: a + F.when(x == "", 0).otherwise(F.conv(x, 16, 10).cast("int")))
    slot = low % 512 + 512 * F.pmod(2 * (digits - low % 512), F.lit(3))
    sign = F.when(F.shiftright(low, 8) % 2 == 0, 1.0).otherwise(-1.0)
    summed = h.select(key, slot.alias("slot"), sign.alias("sign")).groupBy(key, "slot").agg(F.sum("sign").alias("w")).filter("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return summed.select(key, "slot", (F.col("w") / norm).alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; 0 if their lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def cosine_sparse(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cosine) of sparse unit vectors that share a slot."""
    return left.join(right.withColumnRenamed("w", "v"), "slot").groupBy(a, b).agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))


def topk_cosine(m: DataFrame, bank: DataFrame, k: int = 5, scored: list[int] | None = None) -> DataFrame:
    """(mention_id, kpi_id, sim, rank) within the scope: see retrieval.topk_dense. m and bank: id, scope, vec."""
    return topk_dense(m, bank, k, scored)


def embed_missing(bank: DataFrame, embedder: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """bank(kpi_id, text, vec) with vec filled by embedder over the distinct texts that lack one (all, if force)."""
    todo = bank.filter(F.lit(force) | F.col("vec").isNull())
    made = embedder(todo.select("text").filter("trim(text) <> ''").distinct()).withColumnRenamed("vec", "fresh")
    joined = bank.join(made, "text", "left")
    keep = F.col("vec") if not force else F.lit(None)
    return joined.select("kpi_id", "text", F.coalesce(keep, "fresh", "vec").alias("vec"))


def embed_decision(sim: Column, lineage_equal: Column, has_definition: Column, semantic: Column, threshold: float = 0.95) -> Column:
    """struct(accepted, confidence): vectors that aren't semantic never accept and are capped at .5."""
    conf = F.least(F.lit(1.0), 0.95 * sim + F.when(lineage_equal, 0.02).otherwise(0.0) + F.when(has_definition, 0.01).otherwise(0.0))
    return F.struct((semantic & (sim >= threshold)).alias("accepted"), F.when(semantic, conf).otherwise(F.least(conf, F.lit(0.5))).alias("confidence"))


def judge_requests(m: DataFrame, candidates: DataFrame, budget: int = 200, width: int = 120) -> DataFrame:
    """(mention_id, request): JSON with the mention and its five best candidates, for the first `budget` mentions."""
    chosen = m.orderBy("mention_id").limit(budget) if budget else m
    best = candidates.filter("rank <= 5").groupBy("mention_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kpi_id", "name"))), lambda x: F.struct(x["kpi_id"], F.substring(x["name"], 1, width).alias("name"))).alias("candidates"))
    return chosen.join(best, "mention_id").select("mention_id", F.to_json(F.struct("name", "candidates")).alias("request"))


def with_judge(requests: DataFrame, judge: Callable, schema: str = "mention_id long, reply string") -> DataFrame:
    """Replies of a judge: a function from a pandas batch of requests to one of (mention_id, reply). Where it fails, the batch's replies are null, for which the embeddings decide."""
    import pandas as pd

    def safe(batches):
        for batch in batches:
            try:
                yield judge(batch)
            except Exception:  # the judge is the caller's and may be a remote service
                yield pd.DataFrame({"mention_id": batch["mention_id"], "reply": pd.Series([None] * len(batch), dtype=object)})

    return requests.mapInPandas(safe, schema)


def with_memo(m: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of mentions with a cache_key against the memo(cache_key, kpi_id)."""
    return m.join(memo, "cache_key"), m.join(memo, "cache_key", "left_anti")


def bank_version(bank: DataFrame) -> str:
    """A fingerprint of a bank's rows, in any order: it changes when a row is added, changed or removed."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(bank.columns))))
    low, high = F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 31))  # neither sum overflows below 2^30 rows
    return bank.agg(F.concat_ws("-", F.count("*"), F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))).alias("v")).first()["v"]


def recalled(m: DataFrame, memo: DataFrame, bank: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """((mention_id, kpi_id, status, confidence, warning) of hits, misses) of mentions with a cache_key.

    memo: cache_key, version, kpi_id, confidence, similarity, rationale. Rows of another version of the bank count as wiped. A hit is put through the quality gates
    anew with the mention's own spelling, as mentions of one key may differ in it and the rules may have changed; one that they reject stays a hit. m: mention_id,
    cache_key, name, raw, agg.
    """
    valid = memo.filter(F.col("version") == version).drop("version")
    theirs = bank.select("kpi_id", F.col("name").alias("b_name"), F.col("agg").alias("b_agg"))
    hits = m.join(valid, "cache_key").join(theirs, "kpi_id", "left")
    g = R.quality_gates(F.col("name"), F.col("raw"), F.col("agg"), F.coalesce("b_agg", F.lit("")), F.concat_ws(" ", "raw", "name"), F.coalesce("b_name", F.lit("")), F.col("b_name").isNotNull(), F.col("confidence"), F.col("similarity"), F.col("rationale"))
    gated = hits.select("mention_id", "kpi_id", g.alias("g")).select("mention_id", "kpi_id", "g.status", "g.confidence", "g.warning")
    return gated, m.join(valid.select("cache_key"), "cache_key", "left_anti")


def append_memo(memo: DataFrame, results: DataFrame) -> DataFrame:
    """memo with the results whose key it lacks, one a key."""
    fresh = results.select("cache_key", "kpi_id").join(memo, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("kpi_id").alias("kpi_id"))
    return memo.unionByName(fresh)
