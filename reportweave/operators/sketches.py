"""Sketches of report items and texts: MinHash with banding, SimHash, trigrams, signatures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .durable import materialize
from .greedy import shuffled


def minhash_pairs(items: DataFrame, block: DataFrame, bands: int = 32, rows: int = 8) -> DataFrame:
    """(a, b) of reports of one block that share a band of min-hashes. items: report_id, item; block: report_id, block.

    An item goes to each band, and a report's band takes its few least hashes: with those of all bands in one row, Spark has too many columns to compile."""
    each = items.select("report_id", "item", F.explode(F.array(*[F.lit(b) for b in range(bands)])).alias("band"))
    least = each.groupBy("report_id", "band").agg(*[F.min(F.xxhash64(F.col("band") * rows + r, "item")).alias(f"h{r}") for r in range(rows)])
    banded = least.select("report_id", F.xxhash64("band", *[f"h{r}" for r in range(rows)]).alias("key")).join(block, "report_id")
    a, b = banded.withColumnRenamed("report_id", "a"), banded.withColumnRenamed("report_id", "b")
    return a.join(shuffled(b), ["block", "key"]).filter("a < b").select("a", "b").distinct()


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Words whose hashes a task remembers.
REMEMBERED = 200_000


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _xxhash64(words: list[bytes], numbers: int = 4) -> np.ndarray:
    """A row a word: xxhash64(0, word), xxhash64(1, word), ... as Spark's function has them (uint64)."""
    h = (np.uint64(42) + _P5 + np.uint64(4)) ^ (np.arange(numbers, dtype=np.uint64) * _P1)
    seeds, out = _mixed(_rotated(h, 23) * _P2 + _P3), np.empty((len(words), numbers), np.uint64)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        here = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(words[i] for i in here), np.uint8).reshape(len(here), size)
        part = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind).astype(np.uint64)  # noqa: B023, E731
        h, at = np.broadcast_to(seeds + _P5, (len(here), numbers)), 0
        if size >= 32:
            lanes = [np.broadcast_to(seeds + x, h.shape) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            while at <= size - 32:
                lanes = [_rotated(v + part(at + 8 * i, "<u8") * _P2, 31) * _P1 for i, v in enumerate(lanes)]
                at += 32
            h = sum((_rotated(v, by) for v, by in zip(lanes, (1, 7, 12, 18))), np.zeros(h.shape, np.uint64))
            for v in lanes:
                h = (h ^ (_rotated(v * _P2, 31) * _P1)) * _P1 + _P4
        h = h + np.uint64(size)
        while at <= size - 8:
            h = _rotated(h ^ (_rotated(part(at, "<u8") * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
        if at <= size - 4:
            h = _rotated(h ^ (part(at, "<u4") * _P1), 23) * _P2 + _P3
            at += 4
        while at < size:
            h = _rotated(h ^ (part(at, "u1") * _P5), 11) * _P1
            at += 1
        out[here] = _mixed(h)
    return out


def _signed_sums(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
    """(key, 256 signed sums of the hashes of a text's words, or their signs packed into four numbers) of batches(key, text) that have words."""
    known, hashes = {}, np.empty((REMEMBERED, 32), np.uint8)
    for batch in batches:
        rows, sums, texts = [], [], batch.column(1).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // (1 << 20))) + 1):  # about a megabyte at once
            each = [Counter((text or b"").split()) for text in texts.take(pa.array(some)).to_pylist()]  # at ASCII's blanks, as the regular expression's do
            here = set().union(*each)
            new = [w for w in here if w not in known]
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, list(here)
                if len(new) > len(hashes):
                    hashes = np.empty((len(new), 32), np.uint8)
            if new:
                hashes[len(known) : len(known) + len(new)] = _xxhash64(new).astype("<u8").view(np.uint8)
                known.update(zip(new, range(len(known), len(known) + len(new))))
            for row, found in zip(some.tolist(), each):
                if found:
                    counts = np.fromiter(found.values(), float, len(found))
                    bits = np.unpackbits(hashes[[known[w] for w in found]], axis=1, bitorder="little")
                    rows.append(row)
                    sums.append(2 * (counts @ bits.astype(float)) - counts.sum())
        if rows:
            told = np.array(sums)
            told = np.packbits(told > 0, axis=1, bitorder="little").view("<i8") if packed else told.astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * told.shape[1]), pa.array(told.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["key", "words"])


def simhash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words array<long>[4]): signs of 256 signed sums of token hashes, packed. A text is summed up where it is; sums are added where a key has several texts."""
    rows, schema = texts.select(key, F.lower(text)), f"key {texts.schema[key].dataType.simpleString()}, words array<bigint>"
    if texts.groupBy(key).count().filter("count > 1").isEmpty():
        return rows.mapInArrow(lambda batches: _signed_sums(batches, True), schema).withColumnRenamed("key", key)
    each = rows.mapInArrow(lambda batches: _signed_sums(batches, False), schema).select("key", F.posexplode("words").alias("i", "s"))
    signs = each.groupBy("key", "i").agg(F.sum("s").alias("s"))
    pack = lambda j: F.sum(F.when((F.col("s") > 0) & (F.floor(F.col("i") / 64) == j), F.expr("shiftleft(1L, i % 64)")).otherwise(F.lit(0).cast("long")))
    return signs.groupBy(F.col("key").alias(key)).agg(F.array(*[pack(j) for j in range(4)]).alias("words"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def simhash_near(hashes: DataFrame, block: str, most: int = 29, bands: int = 30) -> DataFrame:
    """(a, b, distance) of a block's pairs at most `most` bits apart; bands of bits miss none (more bands than bits)."""
    if bands <= most:
        raise ValueError("more bands than differing bits are needed to miss no pair")
    edge = [256 * i // bands for i in range(bands + 1)]
    bit = lambda i: F.getbit(F.col("words")[i // 64], F.lit(i % 64)).cast("string")
    keys = F.array(*[F.concat(F.lit(f"{b}:"), *[bit(i) for i in range(edge[b], edge[b + 1])]) for b in range(bands)])
    rows = hashes.select("id", block, "words", F.explode(keys).alias("key"))
    a, b = rows.select(F.col("id").alias("a"), block, "key", F.col("words").alias("x")), rows.select(F.col("id").alias("b"), block, "key", F.col("words").alias("y"))
    near = a.join(shuffled(b), [block, "key"]).filter("a < b").select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))
    return near.filter(F.col("distance") <= most).distinct()


#: Hashes of a block, and about so many pairs of blocks are a task of simhash_all.
HASHES, MEETINGS = 4096, 64


def _near_hashes(most: int) -> Callable:
    """(a, b, distance) of the hashes of two blocks at most `most` bits apart; of one block, each pair once. batches: i, j, x and y, lists of (id, four numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values for c in ("x", "y")]
                x, y = (np.stack([side.field(f"w{k}").to_numpy().view(np.uint64) for k in range(4)]) for side in sides)
                same = batch.column("i")[row].as_py() == batch.column("j")[row].as_py()
                for at in range(0, x.shape[1], 128):
                    apart = np.zeros((min(128, x.shape[1] - at), y.shape[1]), np.uint16)
                    for k in range(4):
                        apart += np.bitwise_count(x[k, at : at + 128, None] ^ y[k])
                    p, q = np.nonzero(apart <= most)
                    if same:
                        p, q = p[p + at < q], q[p + at < q]
                    if len(p):
                        yield pa.RecordBatch.from_pydict({"x": sides[0].field("id").take(pa.array(p + at)), "y": sides[1].field("id").take(pa.array(q)), "distance": pa.array(apart[p, q].astype(np.int32))})

    return run


def simhash_all(hashes: DataFrame, most: int = 29, cut: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """(a, b, distance) of hashes(id, words) at most `most` bits apart, without a block.

    Equal hashes are one class: its least id is paired with each other member at distance 0, and stands for all of them in
    the pairs of classes (a < b). Texts of one language agree in so many bits that a third of all pairs share some band but for two bits; so classes are
    compared pair by pair, a block with a block, of bounded size each. A pair costs some nanoseconds, but their number grows with the square of that of classes.
    """
    h = cut(hashes.select("id", "words"))
    least = cut(h.groupBy("words").agg(F.min("id").alias("a")))
    copies = h.join(shuffled(least), "words").filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    parts = -(-least.count() // HASHES) or 1
    held = F.collect_list(F.struct(F.col("a").alias("id"), *[F.col("words")[k].alias(f"w{k}") for k in range(4)]))
    blocks = cut(least.filter("a is not null").groupBy(F.pmod(F.xxhash64("words"), F.lit(parts)).cast("int").alias("block")).agg(held.alias("held")))
    tasks = max(4 * h.sparkSession.sparkContext.defaultParallelism, parts * (parts + 1) // 2 // MEETINGS) if parts > 1 else 1
    x = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(parts - 1))).alias("j"), F.col("held").alias("x")).repartition(tasks, "i", "j")
    y = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("held").alias("y")).repartition(tasks, "i", "j")
    kind = h.schema["id"].dataType.simpleString()
    met = x.join(shuffled(y), ["i", "j"]).mapInArrow(_near_hashes(most), f"x {kind}, y {kind}, distance int").filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct().unionByName(copies)


def trigram_similarity(names: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, similarity) of distinct names by Jaccard of their character trigrams. names: name."""
    padded = F.concat(F.lit("  "), F.lower("name"), F.lit(" "))
    n = names.select("name").distinct().withColumn("gs", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))))
    grams = n.select("name", F.size("gs").alias("n"), F.explode("gs").alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    # two names so alike share one of the n - ceil(least * n) + 1 rarest trigrams of each: the frequent ones needn't meet
    place = F.row_number().over(W.partitionBy("name").orderBy("df", "g"))
    rare = grams.join(df, "g").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a, b = (rare.select("g", F.col("name").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    met = a.join(b, "g").filter(near).select("a", "b").distinct()
    sets = n.select("name", "gs")
    both = met.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("similarity")).filter(F.col("similarity") >= least)


#: How many names of a class are looked for together, and up to how many names a class has for that; what a class asks for at most, before fewer names are taken together.
TOGETHER, ASKED = {3: 24, 2: 120}, 4096
_NONE = np.uint64(2**64 - 1)


def _set_keys(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """A number for each row's set of three values at most (uint64, None where there are fewer), whatever their order and repetitions. Different sets agree by chance once in 2^64."""
    rows = np.sort(np.stack(columns + [np.full_like(columns[0], _NONE)] * (max(TOGETHER) - len(columns)), 1), 1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = _NONE
    key = np.full(len(rows), salt, np.uint64)
    for column in np.sort(rows, 1).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each row's list begins in the values, its length, the values)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, column.flatten()


def _keyed(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": keys, **{c: batch.column(c).take(pa.array(rows)) for c in ("class", "n", "bits")}})


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class, n, bits) of each choice of what l of a class's first n - hits + l names are like. batches: class, n, bits, hits, l, salt, lists."""
    for batch in batches:
        n, hits, width, salt = (batch.column(c).to_numpy() for c in ("n", "hits", "l", "salt"))
        names, _, lists = _lists(batch.column("lists"))
        starts, sizes, values = _lists(lists)
        values = values.to_numpy().view(np.uint64)
        for spare, l, tag in np.unique(np.stack([n - hits, width, salt], 1), axis=0).tolist():
            rows = np.flatnonzero((n - hits == spare) & (width == l) & (salt == tag))
            for places in combinations(range(spare + l), l):
                each = np.prod([sizes[names[rows] + p] for p in places], 0)
                for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(each) >> 18)) + 1):  # about 260,000 choices at once
                    many, of = each[some], np.repeat(rows[some], each[some])
                    rank, chosen = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), []
                    for p in places:
                        rank, at = np.divmod(rank, sizes[names[of] + p])
                        chosen.append(values[starts[names[of] + p] + at])
                    yield _keyed(batch, of, _set_keys(chosen, tag * 4 + l))


def _have(most: dict[int, list[int]]) -> Callable:
    """(key, class, n, bits) of all subsets of up to l of a class's names, for each l that some ask for with this salt. batches: class, n, bits, salt, keys and for each l: at_l, if the class may meet those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = batch.column("salt").to_numpy()
            starts, sizes, values = _lists(batch.column("keys"))
            values = values.to_numpy().view(np.uint64)
            for n, tag in np.unique(np.stack([sizes, salt], 1), axis=0).tolist():
                here = np.flatnonzero((sizes == n) & (salt == tag))
                for l in most[tag]:
                    rows = here[batch.column(f"at_{l}").to_numpy(zero_copy_only=False)[here]]
                    held = values[starts[rows][:, None] + np.arange(n)]
                    for places in (c for size in range(1, l + 1) for c in combinations(range(n), size)):
                        if len(rows):
                            yield _keyed(batch, rows, _set_keys([held[:, p] for p in places], tag * 4 + l))

    return run


def _least_hits(n: Column, rate: float) -> Column:
    """The least number of hits whose share of n is above rate."""
    below = F.floor(n * rate)
    return F.when(below / n > rate, below).otherwise(below + 1)


def _met_classes(sides: DataFrame, rate: float) -> DataFrame:
    """(a, b), a < b, of classes that can match at a rate above `rate`, and some that can't. sides: class, n, groups, bits (one for each group), keys (of its names), lists (of what each name is like).

    Of the side with the greater share of hits all names but n - hits have a match; so among any n - hits + l of its names l have one. These l are looked for together: the
    side asks for each choice of what they are like, the other has the subsets of its names. l is three, as a pair of common names is held by too many. It is
    less where no three names need a match, where a class would ask for more than ASKED choices, and where either side has too many subsets (`wide`).
    A group that one side lacks is a name without a match, so classes that meet must nearly agree in their bits too.
    """
    wide = F.lit(1)
    for l, most in sorted(TOGETHER.items()):
        wide = F.when(F.col("n") <= most, l).otherwise(wide)
    sides = sides.withColumn("wide", wide).withColumn("hits", F.greatest(_least_hits(F.col("n"), rate), F.lit(1)).cast("int")).filter("hits <= n")

    def choices(l: Column | int) -> Column:  # or more: the number of sets of names times the longest list's power
        count = F.lit(1.0)
        for i in range(l):
            count = count * (F.col("n") - F.col("hits") + l - i) / (i + 1)
        return count * F.pow(F.array_max(F.transform(F.slice("lists", 1, F.col("n") - F.col("hits") + l), lambda x: F.size(x))), F.lit(l))

    # salt: the lesser `wide` of the two sides, and whether it is the other side's only
    widths = sorted(r["wide"] for r in sides.select("wide").distinct().collect())
    salts = F.filter(F.array(*[F.lit(2 * w) for w in widths]), lambda x: x <= 2 * F.col("wide")) if widths else F.array().cast("array<int>")
    asks = sides.withColumn("salt", F.explode(F.transform(salts, lambda x: x + (x < 2 * F.col("wide")).cast("int"))))
    l = F.lit(1)
    for k in range(2, max(TOGETHER) + 1):
        l = F.when((F.floor(F.col("salt") / 2) >= k) & (F.col("hits") >= k) & (choices(k) <= ASKED), k).otherwise(l)
    asks, most = asks.withColumn("l", l), {}
    for r in asks.groupBy("salt", "l").agg(F.max("n").alias("n")).collect():
        most.setdefault(r["salt"], {})[r["l"]] = r["n"]

    def may(salt: Column, k: int) -> Column:  # names of as many groups as this can't all but some be matched by so few names
        n = F.lit(0)
        for s, of in most.items():
            n = F.when(salt == s, of.get(k, 0)).otherwise(n)
        both = F.col("n") + n
        return (n > 0) & (F.col("groups") <= n + both - _least_hits(both, rate))

    sought = F.array(*[F.lit(s) for s in most]) if most else F.array().cast("array<int>")
    meets = F.filter(sought, lambda s: F.when(s % 2 == 0, F.col("wide") >= s / 2).otherwise(F.col("wide") == (s - 1) / 2))
    has = sides.withColumn("salt", F.explode(meets))
    has = has.select("class", "n", "bits", "salt", "keys", *[may(F.col("salt"), k).alias(f"at_{k}") for k in range(1, max(TOGETHER) + 1)])
    kind = sides.schema["class"].dataType.simpleString()
    schema = f"key long, class {kind}, n int, bits long"
    x = asks.select("class", "n", "bits", "hits", "l", "salt", "lists").mapInArrow(_ask, schema)
    y = has.mapInArrow(_have({s: sorted(of) for s, of in most.items()}), schema).toDF("key", "other", "m", "other_bits")
    both = F.col("n") + F.col("m")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= both - _least_hits(both, rate)
    met = x.join(shuffled(y), "key").filter((F.col("class") != F.col("other")) & near)
    return met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def source_matches(columns: DataFrame, like: float = 0.6, rate: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((a, b, rate) of sources whose columns match at a rate above `rate`, (source, class)). columns: source, column.

    Sources with equal sets of names are one class, named by its least member; pairs are those of classes. Names match if they are equal or their trigrams are
    more than `like` alike; the rate is the share of both sides' names that match one of the other side. Null and blank names don't count.

    Classes meet through several names at once (_met_classes): one name, even the rarest of a class, is held by a share of all classes.
    """
    clean = columns.select("source", F.lower(F.trim("column")).alias("column")).filter("source is not null and column <> ''")
    sets = clean.groupBy("source").agg(F.array_sort(F.collect_set("column")).alias("cols"))
    sets = materialize(sets, "source-sets")
    classes = sets.groupBy("cols").agg(F.min("source").alias("class"))
    members = sets.join(classes, "cols").select("source", "class")
    one = materialize(classes.select("class", F.size("cols").alias("n"), F.explode("cols").alias("column")), "source-columns")
    held = materialize(one.groupBy("column").agg(F.count("*").alias("held")), "source-names")
    names = held.select(F.col("column").alias("name"))
    near = materialize(trigram_similarity(names, like).filter(F.col("similarity") > like).select("a", "b"), "source-likes")
    matching = near.toDF("x", "y").unionByName(near.toDF("y", "x")).unionByName(names.select(F.col("name").alias("x"), F.col("name").alias("y")))
    groups = connected_components(near)
    wide = matching.join(held, F.col("y") == F.col("column")).groupBy("x").agg(F.collect_set("y").alias("likes"), F.sum("held").alias("spread"))
    wide = materialize(wide.join(groups, F.col("x") == F.col("node"), "left").withColumn("root", F.coalesce("root", "x")).select(F.col("x").alias("column"), "likes", "spread", F.xxhash64("x").alias("key"), F.transform("likes", lambda y: F.xxhash64(y)).alias("list"), "root", F.expr("shiftleft(1L, cast(pmod(xxhash64(root), 64) as int))").alias("bit")), "source-wide")
    rows = one.join(wide, "column").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("spread", "column", "likes", "key", "list", "root", "bit"))).alias("names"))
    first = lambda x, i: F.array_position(F.transform("names", lambda y: y["root"]), x["root"]) == i + 1
    rows = rows.withColumn("names", F.concat(F.filter("names", first), F.filter("names", lambda x, i: ~first(x, i))))
    of = lambda c: F.transform("names", lambda x: x[c])
    sides = materialize(rows.select("class", "n", F.size(F.array_distinct(of("root"))).alias("groups"), F.aggregate(of("bit"), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)).alias("bits"), of("column").alias("cols"), of("likes").alias("likes"), of("key").alias("keys"), of("list").alias("lists")), "source-sides")
    met = _met_classes(sides, rate)
    told = sides.select("class", "cols", "likes")
    x, y = (told.select(F.col("class").alias(s), F.col("cols").alias(f"cols_{s}"), F.col("likes").alias(f"likes_{s}")) for s in "ab")
    both = met.join(shuffled(x), "a").join(shuffled(y), "b")
    hits = lambda mine, theirs: F.size(F.filter(mine, lambda l: F.arrays_overlap(l, theirs)))
    share = (hits(F.col("likes_a"), F.col("cols_b")) + hits(F.col("likes_b"), F.col("cols_a"))) / (F.size("cols_a") + F.size("cols_b"))
    return both.select("a", "b", share.alias("rate")).filter(F.col("rate") > rate), members


def fingerprints(items: DataFrame) -> DataFrame:
    """(report_id, layer, hash) of the sorted items of each layer."""
    return items.groupBy("report_id", "layer").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("item"))), 256).alias("hash"))


def signature_classes(measures: DataFrame) -> DataFrame:
    """(id, class_id, n) of measures with equal inputs, aggregation and type as others: the least id of the class and its size. A class of any size is one row a member, not its pairs. measures: id, inputs, agg, type."""
    key = F.sha2(F.concat_ws("|", F.array_join(F.array_sort("inputs"), ","), "agg", "type"), 256)
    m = measures.select("id", key.alias("key"))
    return m.join(m.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).filter("n > 1"), "key").select("id", "class_id", "n")
