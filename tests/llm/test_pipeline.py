"""The pipeline's stages against brute force, packing against a naive best fit, and the classifier on held-out documents."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from reportweave.llm import line_dedup, minhash_dedup, packing, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


@pytest.fixture(scope="module")
def corpus():
    """Documents with lines that nearly repeat, near copies, leaked passages, and awkward rows; a further column clashes with a result's."""
    rng = random.Random(12)
    words = ["w%d" % i for i in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(30), line(14), line(6)]
    shared = line(20)
    texts = ["\n".join(line(rng.randint(15, 40)) for _ in range(3)) for _ in range(12)]
    texts[3] += "\n" + shared
    texts[4] = shared + " more" + "\n" + texts[4]
    texts[5] += "\n" + shared
    near = texts[6].split(" ")
    near[5] = "changed"
    texts += [" ".join(near), texts[7]]
    texts[8] += " " + items[0][10:120] + " " + line(5)
    texts[9] = items[1] + " " + texts[9]
    texts[10] += " " + items[2]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(50, None, None, None, None, None), (51, "", "en", "s", 0, "x"), (52, " \n\n ", "en", "s", 4, "x"), (rows[2][0], *rows[2][1:]), (53, " ".join(rng.choice(words) for _ in range(20000)), "en", "s", 1, "x")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, items = corpus
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run(spark, name, rows, folder):
    stage = dict(corpus_pipeline.STAGES)[name]
    return [tuple(r) for r in stage(spark, spark.createDataFrame(rows, DOC), folder).collect()]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def without_near_lines(rows):
    places = sorted({(r[0], i, x) for r in rows if r[1] for i, x in enumerate(r[1].split("\n")) if x.strip()})
    sets = [line_dedup._set(x) for _, _, x in places]
    links = [(i, j) for i, j in itertools.combinations(range(len(places)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(places), links)
    gone = {(d, i) for k, (d, i, _) in enumerate(places) if root[k] != k}
    out = []
    for r in rows:
        text = r[1] and "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], i) not in gone)
        out.append((r[0], text, r[2], r[3], None if text is None else len(text), r[5]))
    return out


def test_line_stage_equals_brute_force(spark, corpus, folder):
    rows, _ = corpus
    assert sorted(run(spark, "lines", rows, folder), key=repr) == sorted(without_near_lines(rows), key=repr)


def test_near_stage_equals_brute_force(spark, corpus, folder):
    rows, _ = corpus
    idf = minhash_dedup.idf_table(spark.createDataFrame([(r[1] or "",) for r in rows], "text string"))
    told = sorted({(r[0], r[1] or "") for r in rows})
    found = list(minhash_dedup.weighted(pa.array([t for _, t in told]), idf))
    links = []
    for i, j in itertools.combinations(range(len(told)), 2):
        (g, w), (h, v) = found[i], found[j]
        _, x, y = np.intersect1d(g, h, assume_unique=True, return_indices=True)
        both = np.minimum(w[x], v[y]).sum()
        if told[i][1] == told[j][1] or (both and both >= 0.8 * (w.sum() + v.sum() - both)):
            links.append((i, j))
    root = components(len(told), links)
    assert sorted(r[0] for r in run(spark, "near", rows, folder)) == [d for k, (d, _) in enumerate(told) if root[k] == k]


def test_leak_stage_equals_brute_force(spark, corpus, folder):
    rows, items = corpus
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(max(1, len(w) - 9))}
    leaked = lambda t: any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    want = [r for r in rows if not leaked(r[1])]
    assert 8 < len(want) < len(rows) and sorted(run(spark, "leaks", rows, folder), key=repr) == sorted(want, key=repr)


def test_quality_stage_keeps_what_the_classifier_predicts(spark, corpus, folder):
    rows, _ = corpus
    kept = run(spark, "quality", rows, folder)
    docs = spark.createDataFrame(rows, DOC)
    scored = quality.score_documents(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), keep=docs.columns).collect()
    assert sorted(kept, key=repr) == sorted((tuple(r)[: len(rows[0])] for r in scored if r["predicted"] == 1), key=repr)


def test_run_applies_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "leaks", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    words = lambda rows: sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["n_words"]) for r in rows)
    assert words(corpus_pipeline.run(spark, folder).collect()) == words(docs.collect())


def test_empty_tables_pass_through(spark, folder, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_best_fit_equals_a_naive_one():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        sources = [rng.choice([None, "a", "b", "c", "d", "e"]) for _ in sizes]
        clusters = [rng.choice([None, *range(12)]) for _ in sizes]
        bins = []
        want = []
        for size, s, c in zip(sizes, sources, clusters):
            fits = [(room, i) for i, (room, ss, cs) in enumerate(bins) if room >= size and (s is None or s not in ss) and (c is None or c not in cs)]
            i = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([100, set(), set()])
            bins[i][0] -= size
            bins[i][1].add(s)
            bins[i][2].add(c)
            want.append(i)
        assert packing.best_fit(sizes, sources, clusters, 100) == want


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(7)
    good, bad, both = (["%s%d" % (p, i) for i in range(60)] for p in "gbx")
    rows, labels = [], []
    for i in range(500):
        label = rng.random() < 0.5
        text = " ".join(rng.choice((good if label else bad) if rng.random() < 0.3 else both) for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(label), 0))
    rows += [(900, None), (901, ""), (902, "   "), (903, "g1 " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality.score_documents(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    held = [(out[i]["score"], y) for i, y, _ in labels if out[i]["held_out"]]
    right = sum((s > t) + 0.5 * (s == t) for s, y in held for t, z in held if y > z)
    assert len(held) > 60 and right / sum(y > z for _, y in held for _, z in held) > 0.95
    assert out[900]["score"] == pytest.approx(out[901]["score"]) == pytest.approx(out[902]["score"])


def test_labels_of_one_document_with_several_texts(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(40)] + [(3, "another text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    first, second = ({r["doc_id"]: r["score"] for r in quality.score_documents(docs.repartition(n), quality.train(docs.repartition(n), labels)).filter("doc_id <> 3").collect()} for n in (1, 3))
    assert all(abs(first[i] - second[i]) < 1e-6 for i in first)
