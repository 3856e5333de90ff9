"""Top-k through bounded lists and cells against brute force, and how many pairs it scores."""

import math

import numpy as np

from reportweave.operators.retrieval import topk_dense, topk_sparse


def test_sparse_topk_ends_early(spark):
    rng = np.random.default_rng(3)
    common, n_bank, k = 0, 400, 3  # every name has the common word; groups share a rare one
    bank, queries = {}, {}
    for y in range(n_bank):
        bank[f"y{y}"] = {common: 1.0, 10 + y % 80: 3.0, 200 + int(rng.integers(40)): 1.0}
    for q in range(60):
        queries[f"q{q}"] = {common: 1.0, 10 + int(rng.integers(80)): 3.0} if q % 3 else {common: 1.0}
    queries["none"] = {999: 1.0}
    queries["negative"] = {10: -1.0, common: 1.0, 11: 1.0}
    norm = lambda v: {s: w / math.sqrt(sum(x * x for x in v.values())) for s, w in v.items()}
    bank, queries = ({n: norm(v) for n, v in side.items()} for side in (bank, queries))
    scopes = {y: sorted({f"s{i}" for i in rng.integers(0, 3, 2)}) for y in bank}
    owners = {q: f"s{i % 3}" for i, q in enumerate(queries)}
    flat = lambda side: [(n, s, w) for n, v in side.items() for s, w in v.items()]
    want = set()
    for q, v in queries.items():
        pairs = [(round(sum(w * u.get(s, 0) for s, w in v.items()), 6), y, len(set(scopes[y]) - {owners[q]})) for y, u in bank.items() if set(v) & set(u)]
        pairs = sorted((p for p in pairs if p[2]), reverse=True)
        total, kth = 0, None
        for cosine, _, n in pairs:
            total += n
            if total >= k:
                kth = cosine
                break
        want |= {(q, y, c) for c, y, _ in pairs if kth is None or c >= kth}
    scored = []
    got = topk_sparse(
        spark.createDataFrame(flat(queries), "q string, slot int, w double"), spark.createDataFrame(flat(bank), "y string, slot int, w double"), k,
        spark.createDataFrame(list(owners.items()), "q string, own string"), spark.createDataFrame(list(scopes.items()), "y string, scopes array<string>"), scored,
    )
    assert {(r["q"], r["y"], r["cosine"]) for r in got.collect()} == want
    only_common = sum(len(v) == 1 for v in queries.values())
    assert sum(scored) < only_common * n_bank + 0.1 * len(queries) * n_bank  # all pairs share the common word


def test_sparse_topk_of_nothing(spark):
    none = spark.createDataFrame([], "q string, slot int, w double")
    bank = spark.createDataFrame([("y", 1, 1.0)], "y string, slot int, w double")
    assert topk_sparse(none, bank, 2).count() == 0


def test_dense_topk_looks_at_few_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    near = lambda c: (centres[c] + 0.05 * rng.normal(size=12)).tolist()
    bank = [(i, f"s{i % 2}", near(i % 40)) for i in range(1600)]
    bank += [(5000 + i, "s0", bank[i][2]) for i in range(6)]  # ties
    bank += [(6000, "s0", [0.0] * 12), (6001, "s0", [1.0, 2.0]), (6002, None, [1.0] * 12), (6003, "s9", [1.0, 0.0])]
    asked = [(i, f"s{i % 2}", near((i * 2 + i % 2) % 40)) for i in range(120)]
    asked += [(1000, "s0", bank[0][2]), (1001, "s0", [0.0] * 12), (1002, "s0", [1.0, 1.0]), (1003, "nowhere", [1.0]), (1004, "s9", [1.0, 1.0, 1.0]), (1005, "s9", [2.0, 0.0])]

    def cosine(a, b):
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 6) + 0.0

    k, want = 5, {}
    for i, scope, v in asked:
        best = sorted((-cosine(v, u), j) for j, s, u in bank if s == scope)[:k]
        want[i] = [(j, -c + 0.0) for c, j in best]
    scored = []
    got = topk_dense(spark.createDataFrame(asked, "mention_id long, scope string, m_vec array<double>"), spark.createDataFrame(bank, "kpi_id long, scope string, b_vec array<double>"), k, scored)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["mention_id"], r["rank"])):
        found.setdefault(r["mention_id"], []).append((r["kpi_id"], r["sim"]))
    assert found == {i: w for i, w in want.items() if w}
    assert sum(scored) < 0.35 * sum(s == t for _, s, _ in bank for _, t, _ in asked)
