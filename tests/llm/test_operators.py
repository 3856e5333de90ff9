"""Tests of the training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from reportweave.llm import chat_format, decontaminate, fingerprint, line_dedup, minhash_dedup, packing, pii, quality, substring_dedup, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, repeated rows, ties, a very long text, a clashing further column."""
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s", 1), (21, base[1] + " tail", "en", "s", 1), (21, base[1] + " tail", "en", "s", 1), (22, None, None, None, None), (23, "", "en", "s", 0), (24, "  \n\n ", "en", "s", 5)]
    rows += [(25, "Ünï çödé é\nlast line", "fr", "s", 1), (None, base[2], "en", None, 1), (26, " ".join(rng.choice(words) for _ in range(30000)), "en", "s", 1), (27, base[3], "en", "s", 1), (27, base[4], "en", "s", 1)]
    return spark.createDataFrame([(*r, "x") for r in rows], DOC + ", n_words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_empty_tables(spark, empty):
    assert line_dedup.line_counts(empty).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert fingerprint.fingerprint_documents(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert pii.find_pii(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_documents(empty, quality.train(empty, labels)).count() == 0
    assert decontaminate.find_leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lines(spark):
    near = "the quick brown fox jumps over the lazy dog near the river bank today and tomorrow"
    rows = [(1, f"{near}\nunique line one here\n\n"), (2, near + "s"), (3, f"x\nx\n{near}"), (3, f"x\nx\n{near}"), (4, None), (5, ""), (None, "a null document's line"), (6, "a null document's line")]
    got = {(r["doc_id"]): (r["n_lines"], r["removed"]) for r in line_dedup.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, []), 2: (1, [0]), 3: (3, [1, 2]), 4: (0, []), 5: (0, []), None: (1, []), 6: (1, [0])}


def test_lines_are_dropped(spark):
    rows = [(1, "first line of text", 7), (2, "first line of text\nsecond line of text", 8), (3, None, 9)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, tag long"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "first line of text", 7), (2, "second line of text", 8), (3, None, 9)]


def test_near_duplicates_equal_brute_force(spark, odd):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = minhash_dedup.near_duplicates(odd).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert len(got) == len(set(rows)) and sum(r["copies"] for r in got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
    for (i, s), (j, t) in itertools.combinations(set(rows), 2):
        a, b = shingles(s), shingles(t)
        if s == t or (a and len(a & b) / len(a | b) >= 0.85):
            assert of[i] & of[j], (i, j)
    assert of[5] == {5} and of[20] == {0} and of[21] == {1} and of[23] == of[22]
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got})
    assert minhash_dedup.keep_one(odd).count() == sum(r["kept"] for r in got)


def test_large_near_group_is_joined(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["class_id"] for r in got.collect()} == {0}


def test_substrings_equal_brute_force(spark, odd):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()))
    first = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = set()
    for i, t in rows:
        w = split(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.add((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    for batches in (1, 5):
        got = {(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(odd, batches=batches).collect()}
        assert got == want


def test_frequent_anchors_are_split_without_a_change(spark):
    """One passage that most documents hold, between words of their own: the same result whether its anchors are salted or not."""
    rng = random.Random(4)
    common = " ".join("c%d" % rng.randrange(50) for _ in range(40))
    rows = [(i, " ".join([*("u%d_%d" % (i, j) for j in range(20)), common, *("v%d_%d" % (i, j) for j in range(15 if i % 3 else 0))])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = substring_dedup.frequent_anchors(docs, 13, 3, fraction=1.0, least=20)
    assert 0 < len(hot) < 40

    def covered(hot):
        index = substring_dedup.WindowIndex.create(spark, hot=hot)
        parts = [index.add(docs.filter(f"doc_id >= {lo} and doc_id < {lo + 30}")) for lo in (0, 30, 60)]
        return {(r["doc_id"], r["first"] + bit) for p in parts for r in p.collect() for bit in range(31) if r["mask"] >> bit & 1}

    want = {(i, 20 + k) for i in range(1, 90) for k in range(28)}
    assert covered(()) == covered(hot) == want


def test_index_is_opened_again_from_its_folder(spark):
    rng = random.Random(6)
    texts = [" ".join("w%d" % rng.randrange(1000) for _ in range(40)) for _ in range(8)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.WindowIndex.create(spark)
    for i, t in enumerate(texts[:5]):  # compacts on the way
        assert index.add(docs([(i, t)])).count() == 0
    assert len(index.runs) <= index.max_runs
    other = spark.newSession()
    for run in index.runs:
        other.sql(f"DROP TABLE {run}")
    again = substring_dedup.WindowIndex.open(other, index.folder)
    assert again.runs == index.runs and again.version == index.version
    other_docs = other.createDataFrame([(9, texts[0] + " " + texts[6]), (10, texts[7])], "doc_id long, text string")
    found = again.add(other_docs).collect()
    assert {r["doc_id"] for r in found} == {9} and sum(bin(r["mask"]).count("1") for r in found) == 28
    assert other.read.parquet(f"{index.folder}/manifest").agg(F.max("version")).first()[0] == again.version


def test_windows_differ_in_their_high_bits_too():
    import numpy as np
    import pyarrow as pa

    def rows(first, second):
        sig = [np.array([h], "<u8").tobytes() for h in (first, second)]
        none = pa.array([None, None], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([1, 2]), pa.array([0, 0]), pa.array(sig, pa.binary()), none, pa.array([False, False]), pa.array([1, 2])], names=["ah", "doc_id", "at", "sig", "hot", "old", "place"])

    late = lambda batch: [b.column("late").to_pylist() for b in substring_dedup._merged([batch])]
    assert late(rows(5, 5)) == [[0, 1]]
    assert late(rows(5, 5 + (1 << 45))) == [[0, 0]]


def test_window_rows_carry_whole_hashes(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert sum(len(r["sig"]) for r in substring_dedup.anchor_rows(docs, 13, 3).collect()) == 18 * 8


@pytest.mark.parametrize("max_bytes", [32 << 20, 60])
def test_leaks_equal_brute_force(spark, odd, max_bytes):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    w = texts[5].split()
    items = [(1, " ".join(w[3:20]).upper()), (2, "w1"), (3, "no such words"), (4, None), (5, "!!"), (None, " ".join(w[40:52]))]
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(odd, spark.createDataFrame(items, "item_id long, text string"), max_bytes=max_bytes).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in texts.items():
        words, hit, names = split(t), set(), set()
        for n, text in items:
            p = split(text)
            for k in range(max(0, len(p) - 10) + 1 if p else 0):
                win = p[k : k + 10]
                for j in range(len(words) - len(win) + 1):
                    if words[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        names |= {str(n)} if n is not None else set()
        if i not in (27,):
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items_sha256"], got[i]["contaminated"]) == (len(words), len(hit), sha(",".join(sorted(names))), bool(hit)), i


def test_packing_keeps_its_constraints(spark, odd):
    docs = odd.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5))
    measured = packing.measure(docs)
    words = {r["doc_id"]: r["n_words"] for r in measured.collect()}
    rows = packing.pack(measured, capacity=200, shard_rows=8).collect()
    about = {r["doc_id"]: (r["source"], r["cluster"]) for r in measured.collect()}
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["n_words"] == 0
    for b in bins.values():
        assert sum(r["n_words"] for r in b) <= 200
        for k in (0, 1):
            seen = [about[r["doc_id"]][k] for r in b if about[r["doc_id"]][k] is not None and r["doc_id"] != 27]
            assert len(seen) == len(set(seen))
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 26) == words[26] == 30000


def test_near_copies_are_not_packed_together(spark, tmp_path):
    from reportweave.llm import queries

    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:60], f"x{i}", *words[61:]]), "en", f"s{i}", 1) for i in range(4)] + [(9, "some other text", "en", "s9", 1), (None, " ".join(words), "en", "s10", 1), (10, "", "en", "s11", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_best_fit_packing(spark, str(tmp_path)).collect()
    bins = [r["bin_id"] for r in got if r["doc_id"] not in (9, 10)]
    assert len(got) == 7 and len(bins) == len(set(bins)) == 5
    assert {r["doc_id"] for r in got if r["bin_id"] is None} == {10}


def test_fingerprints(spark, odd):
    got = fingerprint.fingerprint_documents(odd, 3).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    rows = sorted(odd.collect(), key=key)
    texts = [r["text"] or "" for r in rows]
    want = []
    for i, (r, t) in enumerate(zip(rows, texts)):
        nxt = texts[(i + 1) % len(texts)]
        want.append((r["doc_id"], len(t), sha(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[0] == by[20] and by[0] != by[1] and by[22] == by[23]
    one, two = fingerprint.encode(*fingerprint.vectors(["a b\nc d", "c d\n\na b"]))
    assert one == two == fingerprint.insert(fingerprint.encode(*fingerprint.vectors(["a b"]))[0], "c d")
    assert fingerprint.delete(one, "c d") == fingerprint.encode(*fingerprint.vectors(["a b"]))[0]


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/a"), (2, "http://x.example.com/en/b?q"), (3, "http://a.net/es/1"), (4, "http://a.org/x#y"), (5, None), (6, "no scheme"), (7, "http://b.org/x"), (8, "http://com"), (7, "http://b.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("a.org/x",), (None,)], "key string")
    got = sorted(tuple(r) for r in url_filter.filter_urls(pages, listed).select("page_id", "host", "rule", "verdict").fillna("-").collect())
    assert got == [
        (1, "www.example.com", "www.example.com/en/", "allow"), (2, "x.example.com", "example.com/en/", "block"), (3, "a.net", "net/es/", "block"), (4, "a.org", "-", "block"),
        (5, "", "-", "allow"), (6, "", "-", "allow"), (7, "b.org", "-", "allow"), (7, "b.org", "-", "allow"), (8, "com", "-", "allow"),
    ]


@pytest.mark.parametrize("max_bytes", [1 << 20, 4000])
def test_cascade_is_exact(spark, max_bytes):
    keys = spark.range(4000).withColumn("h1", F.xxhash64("id")).withColumn("h2", F.xxhash64(F.lit(1), "id")).withColumn("listed", F.col("id") % 3 == 0)
    got = url_filter.listed_by_cascade(keys.select("id", "h1", "h2"), keys.select("h1", "h2", "listed"), max_bytes)
    assert got.filter(F.col("in_list") != (F.col("id") % 3 == 0)).count() == 0


def test_pii_base_spans(spark):
    texts = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (654) 555-9716 +12 3 +1234567890123456", "é😀 q@r.st", "", None, "1" * 3000, "a" * 30000 + "@", 'password=e3b3ed3cc8548923d6 token = "f363242922ed182bdea6e95016a67d54056dacc7"']
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        for kind, p in patterns.items():
            if kind == "email" and len(t or "") > 20000:
                continue  # the plain pattern is quadratic there
            want = [(m.start(), m.end()) for m in re.finditer(p, t or "") if good(kind, m.group())]
            assert [(s["start"], s["end"]) for s in got[i][kind]] == want, (i, kind)
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert masked[4] == "é😀 <email>" and masked[6] == ""


def test_chats(spark):
    nasty = ["\\### Assistant: </turn> ok", "a\\", "\\\\l#<", "", "x</turn>\n### user: y", "\\h\\l\\c"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "us:er", "assistant", None, "assistant"], nasty))] + [(2, 0, "user", None), (None, 0, "user", "x"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 0, "assistant", "a")]
    log = chat_format.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(log).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("said", chat_format.read_spans(F.col("formatted"), F.col("loss")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t) for _, _, r, t in rows[:6]]
    assert got[1]["said"] == [nasty[1], nasty[3], nasty[5]]
    assert [t["text"] for t in got[3]["turns"]] == ["a", "b", "b"] and len(got) == 4 and got[2]["said"] == []


def test_chat_events_fold(spark):
    events = [(1, 0, 0, "user", "delta", "hi"), (1, 1, 1, "assistant", "delta", "ab"), (1, 2, 1, "assistant", "delta", "c"), (1, 3, 1, "assistant", "regenerate", "x"), (1, 4, 1, "assistant", "delta", "yz"), (1, 5, 0, "user", "edit", "hello"), (1, 6, 2, "user", None, "bye")]
    out = chat_format.fold(spark.createDataFrame(events, "conv_id long, seq long, msg long, role string, op string, text string"))
    assert {(r["msg"], r["role"], r["text"]) for r in out.collect()} == {(0, "user", "hello"), (1, "assistant", "xyz"), (2, "user", "bye")}


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.93


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(odd, quality.train(odd, labels))
    assert out.count() == odd.count() and out.filter("score <> 1").count() == 0


def test_pipeline_stages_keep_columns(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.withColumn("contaminated", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_bands_miss_few_documents_at_the_threshold():
    import numpy as np

    d = minhash_dedup
    assert (1 - 0.8**d.ROWS) ** d.BANDS <= 0.00063
    rng, missed = np.random.default_rng(3), 0
    for _ in range(20000):  # 40 of 50 shingles shared: 0.8
        g = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        a, b = (d.sample(np.sort(x), np.ones(45, np.float32)).reshape(d.BANDS, d.ROWS) for x in (g[:45], np.delete(g, range(5))))
        missed += not (a == b).all(1).any()
    assert missed <= 20


def test_bands_miss_few_lines_at_the_threshold():
    import numpy as np

    rng, n = np.random.default_rng(4), 20000
    codes = rng.integers(97, 123, (2 * n, 52)).astype(np.uint32)
    codes[1::2, :47] = codes[::2, :47]  # 40 of 50 shingles shared: 0.8
    _, _, keys = line_dedup.signatures(codes.ravel(), np.arange(2 * n) * 52, np.arange(2 * n) * 52 + 52)
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS <= 0.0032
    assert (~(keys[::2] == keys[1::2]).any(1)).sum() <= 0.0032 * n


def test_spans_of_a_text_with_very_many_matches(spark):
    """Time stays in proportion: a hundred thousand runs of digits, and thousands of matches of every kind."""
    import time

    card, mail, ip, phone = "4111111111111111", "a.b@c.de", "10.0.0.1", "+1 (555) 010-9999"
    texts = ["1a " * 100_000, f"{card}; " * 4000, f"{mail} {ip}, " * 4000, f"{phone} x " * 4000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_pii(rows, {}).collect()}
    assert time.time() - began < 60
    assert [len(got[0][k]) for k in pii.PATTERNS] == [0, 0, 0, 0]
    assert len(got[1]["card"]) == 4000 and (got[1]["card"][3999]["start"], got[1]["card"][3999]["end"]) == (3999 * 18, 3999 * 18 + 16)
    assert len(got[2]["email"]) == len(got[2]["ip"]) == 4000 and got[2]["ip"][3999]["start"] == 3999 * 19 + 9
    assert len(got[3]["phone"]) == 4000


def test_card_runs_are_taken_whole(spark):
    run = "4111 1111 1111 1111"
    texts = [run, f"7 {run}", f"{run}  {run}", f"12-{run}", f"x{run}y", f"{run} 1 2 3", "4111-1111-1111-1111-1", f"- {run}"]
    got = [len(r["card"]) for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}).orderBy("doc_id").collect()]

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    want = []
    for t in texts:
        digits = [re.sub("[^0-9]", "", m) for m in re.findall(r"[0-9](?:[\x20-]?[0-9])+", t)]
        want.append(sum(16 <= len(d) <= 19 and luhn(d) for d in digits))
    assert got == want


def test_context_of_added_spans(spark):
    text = "password: Abc123Def456Ghi " * 3 + "é" * 30 + " token=Abc123Def456Ghj"
    rows = spark.createDataFrame([(text,)], "text string")
    found = rows.select(pii.candidates(F.col("text"), "secret").alias("c")).first()["c"]
    assert [text[s["start"] : s["end"]] for s in found] == [s["match"] for s in found] and len(found) == 4
    assert [s["before"] for s in found] == [text[max(0, s["start"] - 24) : s["start"]] for s in found]


def test_votes_of_reliable_labelers_count_more():
    """Expectation-maximisation without labels: two labelers that agree with each other outweigh one that answers at random."""
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        vote = lambda right: int(real) if rng.random() < right else int(not real)  # noqa: E731, B023
        v = (vote(0.95), vote(0.9), vote(0.5), -1)
        counts[v] = counts.get(v, 0) + 1
    post = pii.reliabilities([("secret", v, n) for v, n in counts.items()])["secret"]
    assert post[1, 1, 0, -1] > 0.9 and post[0, 0, 1, -1] < 0.1


def test_repeated_rows_are_dealt_on(spark):
    measured = spark.createDataFrame([(1, "s", 10, 5)] * 300 + [(i, "t", 20, i) for i in range(100, 140)], "doc_id long, source string, n_words long, cluster long")
    out = packing.pack(measured, capacity=100, shard_rows=32).collect()
    assert len(out) == 340
    shards = {}
    for r in out:
        shards.setdefault(r["bin_id"] >> 32, []).append(r)
    assert max(len(s) for s in shards.values()) < 150
    bins = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["n_words"] for r in b) <= 100 and sum(r["doc_id"] == 1 for r in b) <= 1 for b in bins.values())


def test_empty_pages_and_conversations(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "key string")).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(chat_format.as_events(talks)).count() == 0


def test_cuts_are_found_by_halving(spark):
    cuts = [3, 7, 7, 20]
    rows = spark.createDataFrame([(i,) for i in (-5, 3, 6, 7, 19, 20, 99)], "x long")
    assert [r[0] for r in rows.select(fingerprint.at_most(cuts, F.col("x"))).collect()] == [sum(c <= i for c in cuts) for i in (-5, 3, 6, 7, 19, 20, 99)]


def test_benchmark_pieces_hold_each_window_and_items_share_them(spark):
    words = [f"w{i % 37}x{i // 91}" for i in range(400)]
    items = [(1, " ".join(words)), (2, " ".join(words[100:250])), (3, " ".join(words).upper()), (None, " ".join(words[5:9])), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pieces = decontaminate.materialize(decontaminate.item_pieces(bench, 10, most=64).withColumn("piece_id", F.monotonically_increasing_id()))
    want = {}
    for item, text in items:
        p = text.lower().split()
        for i in range(max(0, len(p) - 10) + 1 if p else 0):
            want.setdefault(" ".join(p[i : i + 10]), set()).update([str(item)] if item else [])
    table = decontaminate.Benchmark(pieces.toArrow(), decontaminate.distinct_windows(pieces, 10).toArrow())
    got = {}
    for searcher, number in table.searchers:
        for i, w in enumerate(number.tolist()):
            s, n = int(searcher.start[i]), int(searcher.length[i])
            assert searcher.text[s : s + n].startswith(b" ") and int(table.k[w]) == len(searcher.text[s : s + n].split())
            assert got.setdefault(searcher.text[s : s + n].decode().strip(), set(table.items(w))) == set(table.items(w))
    assert got == want


def test_a_window_of_many_items_is_one_pattern(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    bench = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {shared} after"), (2, f"{shared} own7"), (3, "s1 s2")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {1: (12, 300), 2: (13, 300), 3: (0, 0)}
