"""Report pairs: blocks, six layers of likeness, weighted composite, tiers, assignment, recommendations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import text as X

from .durable import materialize
from .greedy import greedy_totals, in_groups, sheet_totals, shuffled
from .matching import near_names

# The weights of the layers in the composite.
WEIGHTS = {"source": 0.25, "model": 0.20, "kpi": 0.20, "structure": 0.10, "visual": 0.15, "filter": 0.10}
#: What a layer scores when neither side has items: none of them but the filter layer says anything then.
EMPTY = {"filter": 0.5}


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_min(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def overlap_left(a: Column, b: Column) -> Column:
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def subsumption(both: Column, n_a: Column, n_b: Column, threshold: float = 0.9) -> Column:
    """Which side is (nearly) a subset of the other, from counts."""
    return F.when((n_a > 0) & (both / n_a >= threshold), "a_in_b").when((n_b > 0) & (both / n_b >= threshold), "b_in_a")


def candidate_pairs(reports: DataFrame, block: list[str], named: bool = False) -> DataFrame:
    """(a, b) with a < b of one block; named: and `where`, the block's name."""
    a = reports.select(F.col("report_id").alias("a"), *block)
    b = reports.select(F.col("report_id").alias("b"), *block)
    return a.join(shuffled(b), block).filter("a < b").select("a", "b", *[_where(block).alias("where")] * named)


def item_sets(items: DataFrame, layers: list[str]) -> DataFrame:
    """(report_id, one sorted array of distinct items a layer) of items(layer, report_id, item). A report's items are one row."""
    return items.groupBy("report_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("layer") == x, F.col("item")))).alias(x) for x in layers])


def missing_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(superset, golden, layer, item) of what a superset has and its golden report lacks, for pairs(superset, golden). A null item equals none.

    A report's items are one row, so that pairs go to them."""
    sets = materialize(items.groupBy("report_id").agg(F.collect_list(F.struct("layer", "item")).alias("items")), "pair-sets")
    both = pairs.join(shuffled(sets.toDF("superset", "has")), "superset").join(shuffled(sets.toDF("golden", "held")), "golden", "left")
    held = F.coalesce(F.filter("held", lambda x: x["item"].isNotNull()), F.slice("has", 1, 0))
    return both.select("superset", "golden", F.explode(F.array_except("has", held)).alias("x")).select("superset", "golden", "x.layer", "x.item")


def _numbers(items: DataFrame, layers: list[str]) -> DataFrame:
    """item_sets, unsorted and of 64-bit hashes: only counted, never shown. Two different items of a pair agree by chance once in 2^64."""
    number = F.when(F.col("item").isNotNull(), F.xxhash64("item"))
    some = items.filter(F.col("layer").isin(layers)).select("report_id", "layer", number.alias("item"))
    return some.groupBy("report_id").agg(*[F.collect_set(F.when(F.col("layer") == x, F.col("item"))).alias(x) for x in layers])


def _sides(layers: list[str]) -> tuple[list[Column], list[Column]]:
    return tuple([F.coalesce(x, F.array().cast("array<bigint>")).alias(f"{side}_{x}") for x in layers] for side in "ab")


def _met(layers: list[str]) -> Column:
    """array<struct(layer, met, n_a, n_b)> of a pair's sets. One function over all layers: written out for each, the generated method is too long to be compiled by the JVM."""
    a = F.array(*[F.struct(F.lit(x).alias("layer"), F.col(f"a_{x}").alias("set")) for x in layers])
    one = lambda x, y: F.struct(x["layer"].alias("layer"), F.size(F.array_intersect(x["set"], y)).alias("met"), F.size(x["set"]).alias("n_a"), F.size(y).alias("n_b"))
    return F.zip_with(a, F.array(*[F.col(f"b_{x}") for x in layers]), one)


def block_counts(reports: DataFrame, items: DataFrame, block: list[str], layers: list[str]) -> DataFrame:
    """(a, b, counts) with a < b for every pair of a block; counts as _met's. Reports meet once, with their sets, and a pair is one row."""
    rows = reports.select("report_id", *block).join(shuffled(_numbers(items, layers)), "report_id", "left")
    left, right = _sides(layers)
    a, b = rows.select(F.col("report_id").alias("a"), *block, *left), rows.select(F.col("report_id").alias("b"), *block, *right)
    return a.join(shuffled(b), block).filter("a < b").select("a", "b", _met(layers).alias("counts"))


def pair_counts(pairs: DataFrame, items: DataFrame, layers: list[str]) -> DataFrame:
    """(a, b, counts) of given pairs(a, b)."""
    sets = _numbers(items, layers)
    left, right = _sides(layers)
    none = lambda side: [F.coalesce(f"{side}_{x}", F.array().cast("array<bigint>")).alias(f"{side}_{x}") for x in layers]
    met = pairs.select("a", "b").join(shuffled(sets.select(F.col("report_id").alias("a"), *left)), "a", "left").join(shuffled(sets.select(F.col("report_id").alias("b"), *right)), "b", "left")
    return met.select("a", "b", *none("a"), *none("b")).select("a", "b", _met(layers).alias("counts"))


def by_layer(counted: DataFrame) -> DataFrame:
    """(layer, a, b, met, n_a, n_b) from block_counts or pair_counts: one row a layer."""
    return counted.select("a", "b", F.explode("counts").alias("x")).select("x.layer", "a", "b", "x.met", "x.n_a", "x.n_b")


def shared_counts(items: DataFrame, pairs: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, a, b, met, n_a, n_b) for the pairs and layers of items(layer, report_id, item)."""
    return by_layer(pair_counts(pairs, items, layers))


def layer_score(layer: Column, met: Column, n_a: Column, n_b: Column) -> Column:
    """Jaccard likeness from counts, or what the layer scores if neither side has items."""
    empty = F.lit(0.0)
    for name, value in EMPTY.items():
        empty = F.when(layer == name, value).otherwise(empty)
    union = n_a + n_b - met
    return F.when(union == 0, empty).otherwise(met / union)


def layer_scores(counts: DataFrame) -> DataFrame:
    """(layer, a, b, score) from shared_counts."""
    return counts.select("layer", "a", "b", layer_score(F.col("layer"), F.col("met"), F.col("n_a"), F.col("n_b")).alias("score"))


def score_columns(counted: DataFrame, layers: list[str], *more: str) -> DataFrame:
    """(a, b, one score a layer) from block_counts or pair_counts; `more` columns are kept."""
    at = lambda i: F.col("counts")[i]
    return counted.select("a", "b", *more, *[layer_score(F.lit(x), at(i)["met"], at(i)["n_a"], at(i)["n_b"]).alias(x) for i, x in enumerate(layers)])


@dataclass(frozen=True)
class Layer:
    """A layer of the composite: its share, and its score from a row of pairs with their layers' columns."""

    weight: float
    score: Callable[[DataFrame], Column]


def stored(name: str) -> Callable[[DataFrame], Column]:
    """A layer that is a column of its own; where it is missing or null it scores 0."""
    return lambda pairs: F.coalesce(F.col(name), F.lit(0.0)) if name in pairs.columns else F.lit(0.0)


def with_layer(name: str, weight: float, score: Callable[[DataFrame], Column] | None = None, layers: dict[str, Layer] | None = None) -> dict[str, Layer]:
    """layers (the six, if none are given) and one more with this share; the others keep their proportions, so that all shares add up to 1."""
    rest = {n: x for n, x in (layers or LAYERS).items() if n != name}
    if not 0 <= weight <= 1:
        raise ValueError("a layer's share lies in 0..1")
    scale = (1 - weight) / sum(x.weight for x in rest.values())
    return {n: Layer(x.weight * scale, x.score) for n, x in rest.items()} | {name: Layer(weight, score or stored(name))}


#: The six layers; with_layer adds others.
LAYERS = {name: Layer(weight, stored(name)) for name, weight in WEIGHTS.items()}


def composite(scores: DataFrame, layers: dict[str, Layer] | None = None) -> DataFrame:
    """(a, b, one column a layer, composite, spread) of scores(a, b, what the layers need); spread is the layers' deviation."""
    layers = layers or LAYERS
    wide = scores.select("a", "b", *[x.score(scores).alias(n) for n, x in layers.items()])
    total = sum((F.col(n) * x.weight for n, x in layers.items()), F.lit(0.0))
    mean = sum((F.col(n) for n in layers), F.lit(0.0)) / len(layers)
    spread = F.sqrt(sum(((F.col(n) - mean) * (F.col(n) - mean) for n in layers), F.lit(0.0)) / len(layers))
    return wide.withColumn("composite", F.round(total, 6)).withColumn("spread", F.round(spread, 6))


def tier(score: Column) -> Column:
    # The tiers' limits.
    return F.when(score > 0.95, "exact_clone").when(score > 0.80, "near_clone").when(score > 0.60, "functional_overlap").otherwise("unrelated")


def score_details(pairs: DataFrame, layers: list[str]) -> DataFrame:
    """(a, b, layer, score): one row for each layer of a wide pair."""
    return pairs.unpivot(["a", "b"], layers, "layer", "score")


def persistable(pairs: DataFrame, least: float = 0.60) -> DataFrame:
    """Pairs worth keeping, in canonical order and once each."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "composite").filter(F.col("composite") >= least).dropDuplicates(["a", "b"])


def assign_greedy(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """One-to-one assignment within each group of edges(grp, l, r, score): best first, ties by l, then r.

    Rounds of mutual best: an edge that is first for both its ends is what a sequential pass would take before any
    other edge of theirs, so all such edges are taken at once and their ends' other edges dropped.
    """
    rest, taken = cut(edges), None
    while True:  # every round takes the best edge of each group, so it ends; chains in which each edge waits for the one before take longest
        order = [F.desc("score"), "l", "r"]
        ranked = rest.withColumn("_l", F.row_number().over(W.partitionBy("grp", "l").orderBy(*order))).withColumn("_r", F.row_number().over(W.partitionBy("grp", "r").orderBy(*order)))
        ranked = cut(ranked)
        best = ranked.filter("_l = 1 and _r = 1").select("grp", "l", "r", "score")
        taken = best if taken is None else taken.unionByName(best)
        rest = ranked.join(best.select("grp", "l"), ["grp", "l"], "left_anti").join(best.select("grp", "r"), ["grp", "r"], "left_anti").select("grp", "l", "r", "score")
        if rest.isEmpty():
            return taken


def assigned(edges: Column) -> Column:
    """Sum of scores of a greedy one-to-one assignment over an array<struct(worse, farther, l, r)>, worse being a score's negative: best first, then in the struct's order."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ls"), none.alias("rs"), F.lit(0.0).alias("total"))

    def take(s: Column, e: Column) -> Column:
        taken = F.array_contains(s["ls"], e["l"]) | F.array_contains(s["rs"], e["r"])
        more = F.struct(F.concat(s["ls"], F.array(e["l"])).alias("ls"), F.concat(s["rs"], F.array(e["r"])).alias("rs"), (s["total"] - e["worse"]).alias("total"))
        return F.when(taken, s).otherwise(more)

    return F.aggregate(F.array_sort(edges), start, take, lambda s: s["total"])


_KIND = ["item", "base", "canonical", "name", "definition"]


def alike_kpis(kinds: DataFrame, ratio: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """(x, y, l, r, score, near) of distinct metrics(kind, item, base, canonical, name, definition) that are alike.

    They meet through an equal base or canonical name or through names or definitions that share a piece (see matching.near_names), so that
    ratios are taken once for two metrics that may be alike, however many reports show them.
    """
    x, y = (kinds.select(*[F.col(c).alias(f"{p}_{c}") for c in ["kind", *_KIND]]) for p in "xy")
    sides = 1 if ratio is X.lev_ratio else 2
    met = None
    for c in ("base", "canonical"):
        equal = x.filter(f"x_{c} <> ''").join(y, F.col(f"x_{c}") == F.col(f"y_{c}")).select("x_kind", "y_kind")
        met = equal if met is None else met.unionByName(equal)
    for c in ("name", "definition"):
        near = near_names(x.select(F.lit("").alias("subdomain"), F.col(f"x_{c}").alias("x")), y.select(F.lit("").alias("subdomain"), F.col(f"y_{c}").alias("y")), ratio, least, sides)
        met = met.unionByName(x.join(near.select(F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}")), f"x_{c}").join(y, f"y_{c}").select("x_kind", "y_kind"))
    both = met.distinct().join(x, "x_kind").join(y, "y_kind")
    same = lambda c: F.coalesce((F.col(f"x_{c}") == F.col(f"y_{c}")) & (F.col(f"x_{c}") != ""), F.lit(False))
    like = lambda c: F.coalesce(F.when((F.col(f"x_{c}") != "") & (F.col(f"y_{c}") != ""), ratio(F.col(f"x_{c}"), F.col(f"y_{c}"))), F.lit(0.0))
    told = both.select(F.col("x_kind").alias("x"), F.col("y_kind").alias("y"), F.col("x_item").alias("l"), F.col("y_item").alias("r"), (same("base") | same("canonical")).alias("same"), like("name").alias("near"), like("definition").alias("meant"))
    return told.select("x", "y", "l", "r", F.when(F.col("same"), 1.0).when((F.col("meant") > least) | (F.col("near") > least), 0.8).alias("score"), "near").filter("score is not null")


def kpi_overlap(pairs: DataFrame, kpis: DataFrame, ratio: Callable[[Column, Column], Column] = X.seq_ratio, least: float = 0.8) -> DataFrame:
    """(a, b, total, n_a, n_b, score) of all pairs(a, b, perhaps where): greedy one-to-one overlap of their kpis(report_id, item, base, canonical, definition), by the smaller side's size.

    Equal base or canonical names (not empty) count 1.0, else definitions or names more than `least` alike 0.8. Edges are taken
    best first, by that score, then by the names' likeness, then by the items' order, as assign_greedy does. A report is a set of
    numbers (a hash of what is known of a metric); pairs meet in groups of a block, each with the edges of its metrics (greedy.greedy_totals).
    """
    k = kpis.select("report_id", "item", "base", "canonical", F.lower("item").alias("name"), F.lower("definition").alias("definition")).dropDuplicates(["report_id", "item"])
    k = materialize(k.withColumn("kind", F.xxhash64(*_KIND)), "kpis")
    kinds = materialize(k.select("kind", *_KIND).distinct(), "kinds")
    alike = materialize(alike_kpis(kinds, ratio, least).select("x", "y", "score", "near"), "alike-kpis")
    sets = k.groupBy("report_id").agg(F.collect_set("kind").alias("kinds"))
    out = greedy_totals(materialize(in_groups(pairs), "grouped-pairs"), sets, kinds.select("kind", "item"), alike)
    smaller = F.least("n_a", "n_b")
    return out.select("a", "b", "total", "n_a", "n_b", F.when(smaller == 0, 0.0).otherwise(F.col("total") / smaller).alias("score"))


def kpi_table_overlap(overlaps: DataFrame, tables: DataFrame) -> DataFrame:
    """(report_id, other, overlap) in both directions: .7 of a report's assigned metrics and .3 of its shared tables; a side without metrics or tables counts by the other alone.

    overlaps: see kpi_overlap; tables(a, b, met, n_a, n_b).
    """
    j = overlaps.join(shuffled(tables.select("a", "b", "met", F.col("n_a").alias("t_a"), F.col("n_b").alias("t_b"))), ["a", "b"])

    def one(me: str, other: str, n: str, t: str) -> DataFrame:
        kpi, table = F.col("total") / F.greatest(F.col(n), F.lit(1)), F.col("met") / F.greatest(F.col(t), F.lit(1))
        score = F.when((F.col(n) > 0) & (F.col(t) > 0), 0.7 * kpi + 0.3 * table).when(F.col(n) > 0, kpi).when(F.col(t) > 0, table).otherwise(0.0)
        return j.select(F.col(me).alias("report_id"), F.col(other).alias("other"), F.round(score, 6).alias("overlap"))

    return one("a", "b", "n_a", "t_a").unionByName(one("b", "a", "n_b", "t_b"))


# The words that name a level of detail rather than a subject.
GRAIN_WORDS = ["by", "per", "state", "region", "gender", "category", "zone", "group", "country", "date", "year", "month"]


def sheet_words(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(X.clean_text(name), " ")), lambda w: w != "")


def overlap_of(a: Column, b: Column) -> Column:
    """Common part of two sets by the smaller; null if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


#: From which share of the smaller side's words on names are alike, with all words (more than) and without those of grain.
WORDS_SHARED, CORE_SHARED, NAMES_NEAR = 0.65, 0.7, 0.75
_GRAM = 4


def core_words(words: Column) -> Column:
    return F.array_except(words, F.array(*[F.lit(g) for g in GRAIN_WORDS]))


def name_likeness(x: Column, y: Column, words_x: Column, words_y: Column, ratio: Callable[[Column, Column], Column]) -> Column:
    """struct(near, named, core) of two cleaned names with their words: likeness, whether they name the same, the share of words that aren't of grain."""
    near = ratio(x, y)
    named = (near > NAMES_NEAR) | (F.coalesce(overlap_of(words_x, words_y), F.lit(0.0)) > WORDS_SHARED) | x.contains(y) | y.contains(x)
    core = F.coalesce(overlap_of(core_words(words_x), core_words(words_y)), F.lit(0.0))
    return F.struct(near.alias("near"), named.alias("named"), core.alias("core"))


def clean_axes(axes: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(axes, X.clean_text)), lambda s: s != "")


def axes_score(like: Column, v: Column, w: Column) -> Column:
    """struct(score, exact) from a name_likeness and two sides' cleaned axes: 2 + ratio if names and axes agree, 1 + ratio if they do but for words of grain, else 0.

    Axes agree if one side has none, if they share 70% of the smaller side, or if so many of a's are alike one of b's (contained, or by Levenshtein's ratio).
    """
    shared, least = overlap_of(v, w), F.least(F.size(v), F.size(w))
    loose = F.when(least > 0, F.size(F.filter(v, lambda p: F.exists(w, lambda q: p.contains(q) | q.contains(p) | (X.lev_ratio(p, q) > 0.8)))) / least).otherwise(1.0)
    exact = like["named"] & (shared.isNull() | (shared >= 0.7) | (loose >= 0.7))
    score = F.when(exact, 2 + like["near"]).when((like["core"] >= CORE_SHARED) & (shared.isNull() | (shared >= 0.5)), 1 + like["near"]).otherwise(0.0)
    return F.struct(score.alias("score"), exact.alias("exact"))


def worksheet_score(name_a: Column, name_b: Column, axes_a: Column, axes_b: Column, ratio: Callable[[Column, Column], Column]) -> Column:
    """struct(score, exact) of two worksheets by their names and axes as they are written: see name_likeness and axes_score."""
    like = name_likeness(X.clean_text(name_a), X.clean_text(name_b), sheet_words(name_a), sheet_words(name_b), ratio)
    return axes_score(like, clean_axes(axes_a), clean_axes(axes_b))


def _overlapping(names: DataFrame, words: str, least: Callable[[Column], Column]) -> DataFrame:
    """(where, c, d) of cleaned names that have least(n) of the smaller side's n words in common, and some that haven't.

    Of the smaller side's words, rare ones first, one of the first n - least(n) + 1 must be among the other's: an equi-join by those.
    """
    each = names.select("where", "c", F.size(words).alias("n"), F.explode(words).alias("word"))
    rare = each.groupBy("where", "word").agg(F.count("*").alias("df"))
    at = F.row_number().over(W.partitionBy("where", "c").orderBy("df", "word"))
    first = each.join(rare, ["where", "word"]).withColumn("at", at).filter(F.col("at") <= F.col("n") - least(F.col("n")) + 1)
    met = first.select("where", "word", "c", "n").join(each.select("where", "word", F.col("c").alias("d"), F.col("n").alias("m")), ["where", "word"]).filter("n <= m")
    return met.select("where", "c", "d").distinct()


def _containing(names: DataFrame) -> DataFrame:
    """(where, c, d) of cleaned names c that may stand in d: c's rarest piece of _GRAM characters (all of a shorter one) stands there."""
    grams = lambda size: F.when(F.length("c") >= size, F.transform(F.sequence(F.lit(1), F.length("c") - (size - 1)), lambda i: F.substring("c", i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    whole = names.select("where", F.col("c").alias("d"), F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, _GRAM + 1)]))).alias("gram"))
    rare = whole.groupBy("where", "gram").agg(F.count("*").alias("df"))
    own = names.filter("c <> ''").select("where", "c", F.explode(F.array_distinct(F.when(F.length("c") < _GRAM, F.array("c")).otherwise(grams(_GRAM)))).alias("gram"))
    pick = own.join(rare, ["where", "gram"]).groupBy("where", "c").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    inside = pick.join(whole, ["where", "gram"]).select("where", "c", "d")
    return inside.unionByName(names.filter("c = ''").select("where", "c").join(names.select("where", F.col("c").alias("d")), "where"))  # nothing stands everywhere


def _where(block: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in block])


def alike_names(sheets: DataFrame, block: list[str], ratio: Callable[[Column, Column], Column]) -> DataFrame:
    """(where, x, y, like) of the distinct sheet names of a block (where) that can score above 0 at all, whatever their axes; like: see name_likeness.

    Names are cleaned once. They meet through rare words of the smaller side, through a piece of a name that stands in the other, or through a piece that
    Levenshtein's ratio leaves unchanged (matching.near_names): names that share nothing never meet, and likeness is taken of those that met only.
    """
    spelled = sheets.select(_where(block).alias("where"), F.col("sheet").alias("x")).distinct()
    raw = materialize(spelled.select("where", "x", X.clean_text(F.col("x")).alias("c"), sheet_words(F.col("x")).alias("words")), "sheet-names")
    names = raw.select("where", "c", "words", core_words(F.col("words")).alias("core")).distinct()
    met = _overlapping(names, "words", lambda n: F.floor(n * WORDS_SHARED) + 1)
    met = met.unionByName(_overlapping(names, "core", lambda n: F.ceil(n * CORE_SHARED))).unionByName(_containing(names))
    near = near_names(names.select(F.col("where").alias("subdomain"), F.col("c").alias("x")), names.select(F.col("where").alias("subdomain"), F.col("c").alias("y")), ratio, NAMES_NEAR, 1 if ratio is X.lev_ratio else 2)
    met = met.unionByName(near.select(F.col("subdomain").alias("where"), F.col("x").alias("c"), F.col("y").alias("d")))
    met = materialize(met.unionByName(met.select("where", F.col("d").alias("c"), F.col("c").alias("d"))).distinct(), "met-names")
    words = names.select("c", "words").distinct()
    both = met.select("c", "d").distinct().join(words.withColumnRenamed("words", "v"), "c").join(words.select(F.col("c").alias("d"), F.col("words").alias("w")), "d")
    like = both.select("c", "d", name_likeness(F.col("c"), F.col("d"), F.col("v"), F.col("w"), ratio).alias("like")).filter(f"like.named or like.core >= {CORE_SHARED}")
    like = materialize(met.join(like, ["c", "d"]), "alike-names")
    spelled = raw.select("where", "x", "c")
    return spelled.join(like, ["where", "c"]).join(spelled.select("where", F.col("x").alias("y"), F.col("c").alias("d")), ["where", "d"]).select("where", "x", "y", "like")


def sheet_matches(pairs: DataFrame, sheets: DataFrame, ratio: Callable[[Column, Column], Column] = X.seq_ratio) -> DataFrame:
    """(a, b, exact, grain, best, matched) of pairs(a, b, perhaps where) with worksheets that match: how many combinations match exactly, how many but for their grain,
    the best score, and how many sheets match exactly one to one (best first). sheets: report_id, sheet, axes; a report has a sheet's name once.

    Names are compared over the whole estate; pairs meet in groups of a block, each with its sheets and the likeness of their names (greedy.sheet_totals).
    """
    kind = lambda c: F.xxhash64(c)
    known = materialize(sheets.filter("sheet is not null").select("report_id", "sheet", kind("sheet").alias("kind"), clean_axes(F.col("axes")).alias("axes")), "sheets")
    alike = alike_names(known, [], ratio).select(kind("x").alias("x"), kind("y").alias("y"), "like.near", "like.named", (F.col("like.core") >= CORE_SHARED).alias("core"))
    names = materialize(known.select("kind", F.col("sheet").alias("item")).distinct(), "names")
    return sheet_totals(materialize(in_groups(pairs), "grouped-pairs"), known, names, materialize(alike, "alike-sheets")).filter("exact + grain > 0")


def duplicate_reports(pairs: DataFrame, sheets: DataFrame, usage: DataFrame, block: list[str] | None = None, ratio: Callable[[Column, Column], Column] = X.seq_ratio, least: float = 0.85, unknown_days: int = 9999) -> DataFrame:
    """(report_id, kept, matched): reports at least `least` of whose worksheets match another's exactly, one to one, and the other way round.

    The staler of the two goes, of equals the one with the greater id. Pairs whose counts differ too much to be duplicates are left out first.
    With `block`, columns of sheets, pairs of two blocks don't match.
    """
    if block:
        homes = sheets.select("report_id", _where(block).alias("where")).distinct()
        pairs = pairs.select("a", "b").join(shuffled(homes.withColumnRenamed("report_id", "a")), "a").join(shuffled(homes.withColumnRenamed("report_id", "b")), ["b", "where"])
    n = materialize(sheets.groupBy("report_id").agg(F.count("*").alias("n")), "sheet-counts")
    sized = pairs.join(shuffled(n.toDF("a", "n_a")), "a").join(shuffled(n.toDF("b", "n_b")), "b")
    sized = materialize(sized.filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")), "sized-pairs")
    met = sheet_matches(sized.drop("n_a", "n_b"), sheets, ratio).filter("matched > 0").select("a", "b", "matched")
    both = met.join(shuffled(sized.select("a", "b", "n_a", "n_b")), ["a", "b"]).filter((F.col("matched") >= least * F.col("n_a")) & (F.col("matched") >= least * F.col("n_b")))
    days = usage.select("report_id", "days_ago")
    both = both.join(shuffled(days.toDF("a", "d_a")), "a", "left").join(shuffled(days.toDF("b", "d_b")), "b", "left")
    stale = F.coalesce("d_a", F.lit(unknown_days)) > F.coalesce("d_b", F.lit(unknown_days))
    return both.select(F.when(stale, F.col("a")).otherwise(F.col("b")).alias("report_id"), F.when(stale, F.col("b")).otherwise(F.col("a")).alias("kept"), "matched")


def uniqueness(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """(report_id, uniqueness): what is left of 1 after the best likeness to any other report."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("report_id"), "composite")  # a union would score the pairs twice
    best = both.groupBy("report_id").agg(F.max("composite").alias("best"))
    return reports.select("report_id").join(shuffled(best), "report_id", "left").select("report_id", F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("best", F.lit(0.0))), 6).alias("uniqueness"))


def recommend(reports: DataFrame, usage: DataFrame, duplicates: DataFrame, merges: DataFrame, stale_days: int = 180, unknown_days: int = 365) -> DataFrame:
    """(report_id, action, reasons): discard stale, unused or duplicate reports, merge those with candidates, keep the rest.

    duplicates(report_id) are to go; merges(report_id, partner, score) are candidates, of which the best is named.
    """
    best = merges.groupBy("report_id").agg(F.max_by("partner", F.struct("score", -F.col("partner"))).alias("partner"))
    r = reports.select("report_id").join(shuffled(usage.select("report_id", "days_ago", "groups")), "report_id", "left")
    r = r.join(shuffled(duplicates.select("report_id").distinct().withColumn("dup", F.lit(True))), "report_id", "left").join(shuffled(best), "report_id", "left")
    stale = F.coalesce("days_ago", F.lit(unknown_days)) > stale_days
    unused = F.coalesce(F.size("groups"), F.lit(0)) <= 0
    dup = F.coalesce("dup", F.lit(False))
    reasons = F.array_compact(F.array(F.when(stale, "stale"), F.when(unused, "no groups"), F.when(dup, "duplicate"), F.when(F.col("partner").isNotNull(), "merge candidate")))
    action = F.when(stale | unused | dup, "discard").when(F.col("partner").isNotNull(), "merge").otherwise("keep")
    return r.select("report_id", action.alias("action"), F.array_join(reasons, ", ").alias("reasons"), "partner")


def minmax_in(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Columns scaled to 0..1 within each group; constant ones become 1."""
    w = W.partitionBy(by)
    scaled = lambda c: F.when(F.max(c).over(w) == F.min(c).over(w), 1.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    return df.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def ratio_to_max_in(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    w = W.partitionBy(by)
    return df.select(*[F.when(F.max(c).over(w) == 0, 0.0).otherwise(F.col(c) / F.max(c).over(w)).alias(c) if c in cols else F.col(c) for c in df.columns])


# The weights of a cluster's golden report.
GOLDEN = {"completeness": 0.35, "usage": 0.25, "freshness": 0.20, "governance": 0.10, "recency": 0.10}


def select_golden(members: DataFrame, weights: dict[str, float] = GOLDEN) -> DataFrame:
    """members(cluster, report_id, metrics...) with golden_score and is_golden, by metrics scaled in the cluster."""
    scaled = minmax_in(members, list(weights), "cluster")
    scored = scaled.withColumn("golden_score", F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 6))
    first = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("golden_score"), "report_id"))
    return scored.withColumn("is_golden", first == 1)


def cluster_recommendation(members: DataFrame, pairs: DataFrame, stale_days: int = 90) -> DataFrame:
    """(cluster, report_id, advice) for members(cluster, report_id, is_golden, days_ago) and pairs(a, b, composite, subset)."""
    golden = members.filter("is_golden").select("cluster", F.col("report_id").alias("golden"))
    m = members.join(shuffled(golden), "cluster")
    both = pairs.select("a", "b", "composite", "subset").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "composite", F.when(F.col("subset") == "a_in_b", "b_in_a").when(F.col("subset") == "b_in_a", "a_in_b").alias("subset")))
    m = m.join(shuffled(both), (F.col("report_id") == F.col("a")) & (F.col("golden") == F.col("b")), "left")
    t = tier(F.coalesce("composite", F.lit(0.0)))
    advice = (
        F.when(F.col("is_golden"), "keep")
        .when((F.col("days_ago") > stale_days) & (F.coalesce("composite", F.lit(0.0)) > 0.70), "strong_decommission")
        .when(F.col("subset") == "a_in_b", "decommission")
        .when(F.col("subset") == "b_in_a", "merge_content_into_golden")
        .when(t == "exact_clone", "decommission")
        .when(t == "near_clone", "merge")
        .otherwise("review")
    )
    return m.select("cluster", "report_id", advice.alias("advice"))
