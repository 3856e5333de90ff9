"""Token files, tokenizer alignment and periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from reportweave.llm import alignment, periodic, rans, token_files, word_tokens

DOC = "doc_id long, text string, n_runs string, start string, n_tokens string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)] + ["Straße", "naïve", "日本語", "🙂", "it's", "don't", "\t", "a\nb", "x y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    texts += ["a  b   c", " lead", "trail ", "\n \n x", "  ", "x \n y", "\r\n", "<|endoftext|> a<|endoftext|>b", "<s> </s> <unk> <0x41>", "mark ▁ here", "nul \x00 here", "z" * 3000, " ".join(["ab"] * 3000)]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(100, texts[0]), (100, texts[0]), (100, texts[1]), (101, None), (102, ""), (None, texts[2]), (None, None), (-7, " ".join(["p", "q", "r"] * 40))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOC)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert alignment.align_tokens(empty).count() == 0
    assert periodic.collapse(empty).count() == 0
    assert token_files.token_files(empty).count() == 0


def test_words_are_encoded_as_whole_texts(rows):
    memo = token_files.bpe_words(word_tokens.public_path(A))
    rng = random.Random(2)
    texts = [t or "" for _, t in rows] + ["".join(rng.choice("ab '\n\t1.é \x1f\x85") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    whole = word_tokens.ByteBpe(word_tokens.public_path(A), False).tokenizer
    texts += [" ".join(rng.choice(["ab.", "b\nc", "\nd", "e\n", "x.\ny,", "a'b", "é-", "ǅa", "ʰa", "a\n\nb", "-a", "9", "()"]) for _ in range(12)) for _ in range(2000)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = memo(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    for limit in (3, 10**6):  # word by word
        small = word_tokens.WordMemo(memo.encode, limit)
        assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in small(texts)] == want
    few = word_tokens.WordIds(memo.encode, 3)
    assert (few(texts)[0] == ids).all() and (few(texts[:9])[1] == sizes[:9]).all()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 4096, 4097, rans.BLOCK_IDS, rans.BLOCK_IDS + 1, 2 * rans.BLOCK_IDS + 4321])
def test_codec_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50000).astype(np.uint32)
    share = rans.normalize(np.bincount(ids, minlength=50257))
    assert share.sum() == (1 << rans.SCALE_BITS if n else 0) and ((share > 0) == (np.bincount(ids, minlength=50257) > 0)).all()
    table = rans.Table.of(share)
    blocks = rans.encode(ids, table)
    assert (rans.decode(blocks, table) == ids).all()
    for k in range(len(blocks)):  # each block alone
        assert (rans.decode(blocks[k : k + 1], table) == ids[k * rans.BLOCK_IDS : (k + 1) * rans.BLOCK_IDS]).all()


def test_codec_is_near_entropy_and_finds_damage():
    ids = (np.random.default_rng(0).zipf(1.3, 200_000) % 50000).astype(np.uint32)
    share = rans.normalize(np.bincount(ids))
    table = rans.Table.of(share)
    blocks = rans.encode(ids, table)
    p = np.bincount(ids) / len(ids)
    assert sum(map(len, blocks)) < 1.05 * -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    for at in (25, 300, len(blocks[0]) - 1):
        bad = bytearray(blocks[0])
        bad[at] ^= 4
        with pytest.raises(rans.Damaged):
            rans.decode([bytes(bad)], table)
    raw = token_files.file_bytes([5, None], np.array([3, 4], "<u4").tobytes(), ids[:7], table)
    assert token_files.file_content(raw, table)[0] == [5, None]
    for bad in (raw[:-13] + b"\xff" + raw[-12:], raw[:10], b"X" + raw[1:]):
        with pytest.raises(rans.Damaged):
            token_files.file_content(bad, table)


def test_a_share_for_every_id():
    share = rans.normalize(np.r_[10**12, np.ones(50256)])
    assert share.min() == 1 and share.sum() == 1 << rans.SCALE_BITS
    with pytest.raises(ValueError):
        rans.normalize(np.ones(9), bits=3)


@pytest.mark.parametrize("file_ids", [1, 500, 1 << 22])
def test_token_files(spark, docs, rows, file_ids, tmp_path):
    whole = word_tokens.ByteBpe(word_tokens.public_path(A), False).tokenizer
    got = token_files.token_files(docs, file_ids=file_ids, out_dir=f"file:{tmp_path}/ids").collect()
    ordered = sorted(got, key=lambda r: r["start"])
    key = lambda d: (d is not None, d or 0)
    assert [key(r["doc_id"]) for r in ordered] == sorted(key(d) for d, _ in rows)
    want = collections.Counter()
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered]).tolist()[:-1]]


def aligned(rows):
    """Brute force over whole texts, by byte offsets."""
    aligner = alignment.Aligner(word_tokens.public_path(A), word_tokens.public_path(B))
    out, counts = [], collections.Counter()
    for d, t in rows:
        t = t or ""
        a, b = aligner.a.tokenizer.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t)
        if not t or not b"".join(aligner.a_bytes[x] for x in a) == b"".join(aligner.b_bytes[y] for y in b) == (" " + t).encode():
            out.append((d, None))
            continue
        a_end, b_end = np.cumsum([len(aligner.a_bytes[x]) for x in a]), np.cumsum([len(aligner.b_bytes[y]) for y in b])
        a_at, b_at = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if a_at[i] < b_end[j] and b_at[j] < a_end[i]] if len(a) < 800 else [
            (a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(b_end, a_at[i], "right"), np.searchsorted(b_at, a_end[i]))]
        groups, lo, lo_b = [], 0, 0
        for e in sorted(set(a_end.tolist()) & set(b_end.tolist())):
            hi, hi_b = int(np.searchsorted(a_end, e)) + 1, int(np.searchsorted(b_end, e)) + 1
            groups.append(",".join(map(str, a[lo:hi])) + "|" + ",".join(map(str, b[lo_b:hi_b])))
            lo, lo_b = hi, hi_b
        out.append((d, (len(a), len(b), groups, links)))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return collections.Counter(
        (d, 0, 0, 0, 0, 0, 0, "") if v is None else (d, v[0], v[1], len(v[2]), len(v[3]), sum(counts[x] == best[x[0]] for x in v[3]), sum(counts[x] for x in v[3]), hashlib.sha256(";".join(v[2]).encode()).hexdigest())
        for d, v in out
    )


@pytest.mark.parametrize("block_chars, fan_in", [(1 << 22, 64), (300, 2)])
def test_alignment(docs, rows, block_chars, fan_in):
    got = alignment.align_tokens(docs, block_chars=block_chars, fan_in=fan_in)
    assert collections.Counter(tuple(r) for r in got.collect()) == aligned(rows)


def test_merging_counts_each_pair_once():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 1 << 20, n)) << rng.integers(0, 2) * 20 for n in (0, 1, 30_000, 20_000, 9000)]
    keys = [(np.sort(r), np.ones(len(r), np.int64) * (k + 1)) for k, r in enumerate(runs)]
    merged = list(alignment.merge([alignment.get_frames(alignment.put_frames(iter([x] if len(x[0]) else []))) for x in keys]))
    want = collections.Counter()
    for k, n in keys:
        for x, y in zip(k.tolist(), n.tolist()):
            want[x] += y
    got = [(x, y) for k, n in merged for x, y in zip(k.tolist(), n.tolist())]
    assert got == sorted(want.items())
    top = {}
    for x, y in got:
        top[x >> 32] = max(top.get(x >> 32, 0), y)
    assert [(x, y) for k, n in alignment.marked(iter(merged)) for x, y in zip(k.tolist(), n.tolist())] == [(x, 2 * y + (y == top[x >> 32])) for x, y in got]


def repeated(words):
    """(start, length, period) of all runs, period by period and word by word."""
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        k = 0
        while k < n - p:
            j = k
            while j < n - p and words[j] == words[j + p]:
                j += 1
            size = j - k + p
            if j > k and size >= max(24, 3 * p) and not any(words[k : k + size - d] == words[k + d : k + size] for d in range(1, p)):
                out.append((k, size, p))
            k = max(j, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(doc_id, text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(own), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = repeated(own)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(own) if i not in gone)))


def test_runs_of_small_alphabets():
    """Tiles of all sizes find the runs that brute force finds, also those that meet, nest or cross tiles."""
    rng = random.Random(11)
    for tile_words in (8, 16, 100, 8192):
        texts = []
        for _ in range(60):
            own = []
            for _ in range(rng.randint(0, 5)):
                few = rng.choice([1, 2, 3, 50])
                block = [rng.randrange(few) for _ in range(rng.randint(1, rng.choice([4, 9, 40, 70])))]
                own += (block * rng.randint(1, 6))[: rng.randint(1, 300)]
            texts.append(own)
        found = {}
        by_octave = {}
        for d, own in enumerate(texts):
            for octave, at, part in periodic.tiles(np.array(own, np.int32), tile_words):
                by_octave.setdefault(octave, []).append((d, at, part))
        for octave, tiled in by_octave.items():
            for t, p, a, b in zip(*(x.tolist() for x in periodic.solve([x[2] for x in tiled], octave))):
                found.setdefault((tiled[t][0], p), []).append((a + tiled[t][1], b + tiled[t][1]))
        for d, own in enumerate(texts):
            runs = []
            for (e, p), parts in found.items():
                whole = []
                for a, b in sorted(parts) if e == d else []:
                    if whole and a <= whole[-1][1]:
                        whole[-1][1] = max(b, whole[-1][1])
                    else:
                        whole.append([a, b])
                runs += [(a, b - a + p, p) for a, b in whole if b - a + p >= max(24, 3 * p)]
            assert sorted(runs, key=lambda r: (r[0], r[2])) == repeated(own)


@pytest.mark.parametrize("long_bytes, tile_words", [(1 << 16, 1 << 13), (40, 16)])
def test_collapse(spark, docs, rows, long_bytes, tile_words):
    rng = random.Random(4)
    more = [(1000 + i, " ".join(["ab cd ef", "x"][rng.random() < 0.05] for _ in range(rng.randint(20, 60)))) for i in range(40)]
    more += [(2000 + i, " ".join("v%d" % rng.randrange(500) for _ in range(rng.randint(30, 400)))) for i in range(40)]  # some are rewritten
    table = docs.select("doc_id", "text", "n_runs", "start").unionByName(spark.createDataFrame([(d, t, "x", "y") for d, t in more], "doc_id long, text string, n_runs string, start string"))
    got = collections.Counter(tuple(r) for r in periodic.collapse(table, long_bytes, tile_words).collect())
    assert got == collections.Counter(collapsed(d, t) for d, t in rows + more)
