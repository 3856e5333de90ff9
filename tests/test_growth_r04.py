"""What round 4 found about growth: queries whose candidates grew with the square of the input."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reportweave.operators import catalog, matching, sketches


def _sources_by_brute_force(sources, like=0.6, rate=0.8):
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    known = {n: grams(n) for s in sources.values() for n in s}
    alike = {x: {y for y in known if x == y or round(len(known[x] & known[y]) / len(known[x] | known[y]), 6) > like} for x in known}
    classes = {}
    for s in sorted(sources):
        classes.setdefault(frozenset(sources[s]), s)
    out = {}
    for (x, i), (y, j) in itertools.combinations(classes.items(), 2):
        met = (sum(bool(alike[n] & y) for n in x) + sum(bool(alike[n] & x) for n in y)) / (len(x) + len(y))
        if met > rate:
            out[i, j] = met
    return out, len(classes)


@pytest.mark.parametrize("together,asked,rate", [({3: 24, 2: 120}, 4096, 0.8), ({3: 4, 2: 6}, 4096, 0.8), ({3: 4, 2: 6}, 6, 0.6)])
def test_sources_meet_through_several_names_and_none_is_missed(spark, monkeypatch, together, asked, rate):
    """a name is held by a share of all classes, so classes that have one in common are a share of all pairs."""
    random.seed(9)
    names = [f"{a} {b}{c}" for a in ("red", "old", "blue", "small") for b in ("bolt", "gear", "widget") for c in ("", "s")]
    sources = {i: set(random.sample(names, random.choice([1, 2, 2, 3, 3, 4, 5, 6, 9]))) for i in range(300)}
    sources.update({300 + i: set(random.sample(names, len(names) - i % 3)) for i in range(9)})
    sources.update({400: {"one"}, 401: {"two", "one"}, 402: {"two", "twos"}, 403: {"two"}, 404: {"blue bolt", "blue bolts", "blue gear"}})
    monkeypatch.setattr(sketches, "TOGETHER", together)
    monkeypatch.setattr(sketches, "ASKED", asked)
    found, met = sketches._met_classes, []
    monkeypatch.setattr(sketches, "_met_classes", lambda *x: met.append(found(*x)) or met[0])
    rows = spark.createDataFrame([(s, n) for s, held in sources.items() for n in held], "source long, column string")
    pairs, _ = sketches.source_matches(rows, 0.6, rate)
    want, classes = _sources_by_brute_force(sources, 0.6, rate)
    assert {(r["a"], r["b"]): r["rate"] for r in pairs.collect()} == pytest.approx(want) and want
    if asked > 6:
        assert met[0].count() < max(2 * len(want), 0.02 * classes * classes / 2)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        before, row = row, [i + 1]
        for j, d in enumerate(b):
            row.append(min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("least", [0.85, 0.6, 0.4])
def test_the_first_near_name_is_that_of_all_pairs(spark, least):
    """F3, with names that begin alike, short and empty ones, rows that come twice, and null rows, names and values."""
    random.seed(3)
    text = lambda: random.choice(["household ", "machinery ", "", "ab"]) + "".join(random.choices("0123", k=random.randint(0, 6)))
    b = [(text(), row % 150, row % 150 if row % 7 else None) for row in range(160)] + [(None, 3, 3), ("machinery 0123", None, 5), ("zzzz", 200, None)]
    a = [(text(),) for _ in range(120)] + [(None,), ("",), ("zzzz",)]
    random.shuffle(b)
    b = list({r[1]: r for r in b}.values())
    got = {r["x"]: r["value"] for r in matching.first_near_names(spark.createDataFrame(a, "x string"), spark.createDataFrame(b, "y string, row long, value long"), least).collect()}
    want = {}
    for (x,), (y, row, value) in itertools.product(a, b):
        if x and y and row is not None and (max(len(x), len(y)) - _edits(x, y)) / max(len(x), len(y)) > least:
            want[x] = min(want.get(x, (row, value)), (row, value), key=lambda v: v[0])
    assert got == {x: value for x, (_, value) in want.items()} and got


def test_names_that_begin_alike_are_cut_where_they_differ(spark):
    """cut into even pieces, all names of a segment met through the piece that they begin with."""
    names = [f"household {i * 7919 % 10**6:06d}" for i in range(2000)]
    y = spark.createDataFrame([(n, len(n)) for n in names], "y string, l int")
    starts = {r["e"]: r["starts"] for r in matching._cuts(y, 0.85).collect()}[2]
    ends = [*starts[1:], 17]
    assert starts[0] == 1 and starts == sorted(set(starts))
    for start, end in zip(starts, ends):
        assert len({n[start - 1 : end - 1] for n in names}) >= 10


def test_usage_is_that_of_all_pairs_in_several_batches(spark, monkeypatch):
    """F3"""
    monkeypatch.setattr(matching, "BATCH", 20)
    names = [f"household {i * 7919 % 10**4:04d}" for i in range(400)]
    dash = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(400, "nothing like it"), (401, None)], "c_custkey long, name string")
    sheet = [(i, n.upper() if i % 3 == 1 else n + "x", i * 10) for i, n in enumerate(names) if i % 3]
    got = {r["c_custkey"]: (r["days"], r["how"]) for r in catalog.lookup_usage(dash, spark.createDataFrame(sheet, "row long, key string, days long")).collect()}
    want = {400: (365, "none"), 401: (365, "none")}
    for i, n in enumerate(names):
        near = [days for _, key, days in sheet if (max(len(n), len(key)) - _edits(n, key.lower())) / max(len(n), len(key)) > 0.85]
        want[i] = (i * 10, "exact") if i % 3 == 1 else (near[0], "alike") if near else (365, "none")
    assert got == want


def test_recommendations_of_clusters_score_pairs_once(spark, monkeypatch):
    """the composite was taken for the clusters and again for the advice, and the metrics counted a third time."""
    from reportweave.plans import catalog_queries, pair_queries

    calls = []
    for name in ("_counted", "_overlap"):
        monkeypatch.setattr(pair_queries, name, lambda *x, _name=name, _made=getattr(pair_queries, name), **y: calls.append(_name) or _made(*x, **y))
    out = catalog_queries.cluster_recommendations(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["_counted", "_overlap"]
    assert out.count() > 0


@pytest.mark.parametrize("remembered", [200_000, 40])
def test_simhash_is_that_of_sparks_hashes(spark, monkeypatch, remembered):
    """256 conditional sums for each word of each text were too much to be compiled, and all words were shuffled twice."""
    monkeypatch.setattr(sketches, "REMEMBERED", remembered)
    random.seed(5)
    words = ["a" * n for n in range(1, 70)] + ["ÄÖ", "straße", "İx", "x y", "z z", "\x1cq", "日本"]
    blank = lambda: random.choice([" ", "\t", "\n\n", "\x0b", "\x0c ", "\r\n"])
    texts = ["".join(random.choice(words) + blank() for _ in range(random.randint(1, 60))) for _ in range(40)] + ["", "  \n", None, " A a  A "]
    for ids in (range(len(texts)), [i % 30 if i % 9 else None for i in range(len(texts))]):
        df = spark.createDataFrame(list(zip(ids, texts)), "id long, text string")
        tokens = df.select("id", F.explode(F.split(F.lower("text"), r"\s+")).alias("t")).filter("t <> ''")
        want = {}
        for r in tokens.select("id", F.array(*[F.xxhash64(F.lit(j), "t") for j in range(4)]).alias("h")).collect():
            sums = want.setdefault(r["id"], [0] * 256)
            for j, h in enumerate(r["h"]):
                for i in range(64):
                    sums[64 * j + i] += 1 if h >> i & 1 else -1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        want = {k: [signed(sum((v[64 * j + i] > 0) << i for i in range(64))) for j in range(4)] for k, v in want.items()}
        got = sketches.simhash(df, "id", "text")
        assert "s3_63" not in got._jdf.queryExecution().analyzed().toString()
        assert {r["id"]: r["words"] for r in got.collect()} == want


def test_near_hashes_of_several_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """hashes that agree in most bits, as those of one language do, met through their bands nearly all, many times over."""
    monkeypatch.setattr(sketches, "HASHES", 20)
    random.seed(8)
    base, flipped = random.getrandbits(256), lambda h, n: h ^ sum(1 << i for i in random.sample(range(256), n))
    hashes = [flipped(base, random.randint(0, 24)) for _ in range(90)]
    hashes += hashes[:5]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(h >> 64 * k & (1 << 64) - 1) for k in range(4)]) for i, h in enumerate(hashes)] + [(None, [1, 2, 3, 4])]
    got = [tuple(r) for r in sketches.simhash_all(spark.createDataFrame(rows, "id long, words array<long>")).collect()]
    least = {h: i for i, h in reversed([*enumerate(hashes)])}
    want = {(a, b, (x ^ y).bit_count()) for (x, a), (y, b) in itertools.permutations(least.items(), 2) if a < b and (x ^ y).bit_count() <= 29}
    want |= {(least[h], i, 0) for i, h in enumerate(hashes) if least[h] != i}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
