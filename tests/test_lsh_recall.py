"""Candidates of MinHash bands against the exact Jaccard likeness of all pairs of a block."""

import itertools
import random

from reportweave.operators import sketches


def test_bands_find_what_is_alike_within_a_block_only(spark):
    draw = random.Random(11)
    sets = {}
    for family in range(40):
        base = [f"m{family}.{i}" for i in range(draw.randint(20, 40))]
        for _ in range(4):
            kept = [x for x in base if draw.random() < 0.93]
            sets[len(sets)] = set(kept) | {f"own{len(sets)}"}
    block = {r: f"b{r % 2}" for r in sets}
    items = spark.createDataFrame([(r, x) for r, s in sets.items() for x in sorted(s)], "report_id long, item string")
    got = {(r["a"], r["b"]) for r in sketches.minhash_pairs(items, spark.createDataFrame(list(block.items()), "report_id long, block string")).collect()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if block[a] == block[b]}
    near = [p for p, j in like.items() if j >= 0.8]
    assert len(near) > 30
    assert sum(p in got for p in near) >= 0.98 * len(near)
    assert got <= set(like)
    assert not [p for p in got if like[p] == 0]
