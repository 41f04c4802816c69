"""The pipeline operators against brute force, on rows chosen to be awkward."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, covertree, decontaminate, langid, planes, simhash, substrings, suffixes, toxicity, warc

NAMES = ("fp", "u", "v", "h", "pos", "w", "chunk", "part", "n", "key", "band", "root", "items", "rows", "digest", "score", "rank", "shard")
WORDS = ["alpha", "beta", "Gamma", "déjà", "vu", "ça", "日本", "x1", "the", "of"]


def clash(*without):
    """Extra columns under names that operators use themselves."""
    return {c: F.lit(7) for c in NAMES if c not in without}


def texts(seed=1, n=40):
    """Empty, null, blank, short, repeated, long and overlapping texts."""
    r = random.Random(seed)
    make = lambda k: " ".join(r.choice(WORDS) + r.choice(["", ",", "."]) + str(r.randrange(60)) for _ in range(k))
    shared = make(60)
    out = [None, "", "   \n\t", "a", "!!!", make(3), "x" * 2000, "ab" * 900, shared, shared, make(20) + " " + shared + " " + make(9), make(14) + "\n" + shared[40:300]]
    out += [make(r.randrange(1, 200)) for _ in range(n - len(out))]
    return out + [make(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en") for i, t in enumerate(texts())] + [(6, "   \n\t", "en"), (None, "lost id", "en"), (30, "same id, other text", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(clash()).repartition(5)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(found, wanted):
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_bpe_equals_the_library_and_round_trips(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t)
        wanted.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    same(bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect(), wanted)
    c = bpe.coder(path, public_tokenizers.PATTERN)
    for piece in (b"a" * 700, bytes(range(256)) * 3, b"<|endoftext|>", b"  "):
        assert c.merge([piece])[0] == tuple(enc._encode_single_piece(piece)) or piece in ranks


def test_token_files_give_back_what_was_written(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = []
    for i, t in pairs(docs):
        raw = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        rows.append((-(1 << 63) if i is None else i, raw))
    rows.sort()
    wanted, start = [], 0
    for i, raw in rows:
        wanted.append((None if i == -(1 << 63) else i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    same(planes.token_files(docs, path, files=3).collect(), wanted)


@pytest.mark.parametrize("kind", [planes.BYTES, planes.BITS])
def test_plane_files_by_chunk(tmp_path, kind):
    ids = [np.arange(n, dtype="<u4") * 7919 % 50_000 for n in (0, 5, 300, 1)]
    path = tmp_path / "a"
    with path.open("wb") as out:
        w = planes.PlaneWriter(out, kind, chunk_ids=64)
        for i, x in enumerate(ids):
            w.add(i, x)
        w.close()
    with path.open("rb") as source:
        r = planes.PlaneReader(source, path.stat().st_size)
        assert r.n_ids == 306 and (r.chunk(2) == np.concatenate(ids)[128:192]).all()
        assert [(i, x.tolist()) for i, x in r.documents()] == [(i, x.tolist()) for i, x in enumerate(ids)]


def brute_bytes(rows, length):
    count: dict = {}
    for _, t in rows:
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
    out = []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(raw)] > 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(kept)))
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 3, 1])
def test_repeated_bytes(docs, group):
    """With small groups, anchors are hot: cut again under deeper ones, and split where many chunks share them."""
    same(suffixes.repeated_bytes(docs, 200, group=group).collect(), brute_bytes(pairs(docs), 200))


@pytest.mark.parametrize("group", [suffixes.GROUP, 2, 1])
def test_repeated_bytes_of_hot_passages(spark, monkeypatch, group):
    """A passage shorter than a string in different surroundings, and copies in very many chunks."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, copy, tail = text(30), text(90), text(25)
    rows = [(i, f"{text(12)} {line} {r.choice([tail, text(12)])}") for i in range(60)] + [(100 + i, copy if i % 3 else f"{copy} {text(9)}") for i in range(60)] + [(None, copy), (7, ""), (8, None), (9, "ab" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    same(suffixes.repeated_bytes(df, 200, group=group).collect(), brute_bytes(pairs(df), 200))


def test_blind_tries_and_multikey_sort():
    r = random.Random(5)
    for _ in range(200):
        items = [bytes(r.choice(b"ab") for _ in range(r.randrange(10))) for _ in range(r.randrange(1, 12))]
        order, lcp = suffixes.blind_trie(items)
        assert [items[i] for i in order] == sorted(items)
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            assert items[a][:n] == items[b][:n] and items[a][: n + 1] != items[b][: n + 1] or items[a] == items[b]
    words = np.array([[r.randrange(3), r.randrange(3)] for _ in range(50)], np.uint64)
    order, runs = suffixes.multikey(words)
    assert words[order].tolist() == sorted(words.tolist()) and all((words[order[a:b]] == words[order[a]]).all() for a, b in runs)


def test_repeated_words(docs):
    rows = pairs(docs)
    key = lambda i: -(1 << 63) if i is None else i
    least: dict = {}
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, key(i)), key(i))
    wanted = []
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        wanted.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    same(substrings.repeated_words(docs, 13).collect(), wanted)
    assert substrings.levels(13) == [4, 7, 13]
    assert {"kept_text", "lang", "fp"} <= set(substrings.repeated_words(docs, 13, with_text=True).columns)


def test_decontamination(spark, docs):
    rows = pairs(docs)
    long = max((t for _, t in rows), key=len).split()
    bench = [("b2", " ".join(long[50:75]).upper()), ("a1", "X1 the"), ("a10", "alpha"), (None, "beta"), ("n", None), ("e", "??")]
    items = spark.createDataFrame(bench, "item_id string, text string").withColumn("h", F.lit(1))
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    grams = {}
    for i, t in bench:
        w = find(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    wanted = []
    for i, t in rows:
        w, hit, met = find(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    met |= ids
        wanted.append((i, len(w), len(hit), len(met), ",".join(sorted(met)), bool(hit)))
    found = decontaminate.contamination(docs, items)
    same(found.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated").collect(), wanted)
    assert sum(w[5] for w in wanted) > 0
    assert decontaminate.remove_documents(docs, items).count() == sum(not w[5] for w in wanted)
    assert "Python" not in found._jdf.queryExecution().toString()
    empty = items.where("false")
    assert decontaminate.contamination(docs, empty).where("contaminated").count() == 0


def near_rows(spark):
    """Fingerprint groups: chains of three-bit steps, and lone ones."""
    r = random.Random(9)
    fps, at = [], r.getrandbits(64)
    for _ in range(40):
        fps.append(at)
        for b in r.sample(range(64), 3):
            at ^= 1 << b
    fps += [r.getrandbits(64) for _ in range(200)] + [0, 1, 7, 15]
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").distinct()


@pytest.mark.parametrize("chunk", [512, 8])
def test_links_within_three_bits(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    points = near_rows(spark)
    f = np.array([r.fp for r in points.collect()], np.int64).view(np.uint64)
    roots = {r.fp: r.root for r in simhash.roots_of(points, 3).collect()}
    label = {int(x): int(x) for x in f}
    changed = True
    while changed:
        changed = False
        for a in f:
            for b in f[np.bitwise_count(f ^ a) <= 3]:
                m = min(label[int(a)], label[int(b)], key=lambda v: v - (1 << 64) if v >> 63 else v)
                for x in (int(a), int(b)):
                    if label[x] != m:
                        label[x], changed = m, True
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert roots == {signed(k): signed(v) for k, v in label.items()}


def test_links_within_one_chunk_of_a_large_bucket(spark):
    """Pairs that share one block only, that of a bucket of more than ``CHUNK`` fingerprints."""
    r = random.Random(4)
    ups = r.sample(range(1 << 48), 600)
    near = [(u, u ^ (1 << r.randrange(16)) ^ (1 << r.randrange(16, 32)) ^ (1 << r.randrange(32, 48))) for u in ups]
    fps = np.array(sorted({(u << 16) | 0xBEEF for pair in near for u in pair}), np.uint64)
    assert len(fps) > 2 * simhash.CHUNK
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    signed = fps.view(np.int64)
    order = np.argsort(signed)
    place = np.argsort(order)
    root = simhash.forest(len(fps), place[a], place[b])
    want = {int(signed[order[i]]): int(signed[order[root[i]]]) for i in range(len(fps))}
    assert {x.fp: x.root for x in simhash.roots_of(points, 3).collect()} == want


def test_more_blocks_for_more_fingerprints():
    assert len(simhash.masks(1000, 3)) == 4 and len(simhash.masks(1 << 34, 3)) > 4


def test_fingerprints_and_components(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(pairs(docs))
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.fingerprint)
    for i, t in pairs(docs):
        w = t.encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert f"{bits:016x}" in by_id[i]
    left, groups = {int(r.fingerprint, 16) for r in rows}, 0
    while left:
        groups, todo = groups + 1, [left.pop()]
        while todo:
            near = {x for x in left if (x ^ todo[-1]).bit_count() <= 3}
            todo.pop()
            left -= near
            todo += near
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == groups


@pytest.mark.parametrize("words", [1, 4])
def test_links_join_what_pairs_join(words):
    """Runs of any length, dense and sparse, against all pairs."""
    r = np.random.default_rng(8)
    sizes = [1, 2, 40, 60, 300]
    group = np.repeat(np.arange(len(sizes)), sizes)
    prints = r.integers(0, 1 << 63, (words, len(group)), np.uint64)
    for i in range(len(group) - 1):  # chains of near ones
        if group[i] == group[i + 1] and r.random() < 0.7:
            prints[:, i + 1] = prints[:, i]
            prints[r.integers(words), i + 1] ^= np.uint64(1 << int(r.integers(64))) | np.uint64(1 << int(r.integers(64)))
    near = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).sum(axis=0) <= 3
    a, b = np.nonzero(np.triu(near & (group[:, None] == group[None, :]), 1))
    references = simhash.pivots(words * 2).reshape(words, 2)
    found = simhash.links_in(group, prints, 3, references)
    assert (simhash.forest(len(group), *found) == simhash.forest(len(group), a, b)).all()


def test_copies_by_similarity(spark, monkeypatch):
    """Five words, similarity 0.8: near copies leave, texts that share half of their shingles stay."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    jaccard = lambda s, t: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (s, t)))
    rows, wanted, number = [], [], 0
    for k in range(60):
        first = [word() for _ in range(r.randrange(150, 400))]
        near = list(first)
        near[r.randrange(len(near))] = word()
        half = first[: len(first) * 2 // 3] + [word() for _ in range(len(first) // 3)]
        assert jaccard(first, near) > 0.9 and jaccard(first, half) < 0.6
        rows += [(number, first), (number + 1, near), (number + 2, half), (number + 3, [w.upper() for w in first])]
        wanted += [number, number + 2]
        number += 4
    base = [word() for _ in range(300)]
    for k in range(100):  # one large group of different near copies
        rows.append((number + k, base[:k] + [word()] + base[k + 1 :]))
    wanted.append(number)
    texts = [(i, " ".join(w), 1, 2) for i, w in rows] + [(9000, "", 1, 2), (9001, None, 1, 2), (9002, "one two", 1, 2), (9003, "one two", 1, 2), (9003, "one two", 1, 2), (None, "none at all of these here", 1, 2)]
    wanted += [9000, 9002, None]
    monkeypatch.setattr(simhash, "WIDE_CHUNK", 16)
    docs = spark.createDataFrame(texts, "doc_id long, text string, fp long, w0 int")
    kept = simhash.one_of_each(docs, shingle=5, similarity=0.8)
    assert kept.columns == docs.columns
    key = lambda v: -1 if v is None else v
    assert sorted((x.doc_id for x in kept.collect()), key=key) == sorted(wanted, key=key)
    assert simhash.one_of_each(docs.limit(0), shingle=5, similarity=0.8).count() == 0


def test_copies_are_what_brute_force_links(spark):
    """Similarities on both sides of 0.8, with chains: whatever is dropped is linked at 0.8, and nearly all that is linked goes."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(r.randrange(80, 200))]
        texts.append(words)
        for _ in range(5):
            words = list(words)
            for _ in range(r.randrange(1, 9)):
                words[r.randrange(len(words))] = word()
            texts.append(words)
    line = [word() for _ in range(9)]
    texts += [line * 60 + [word() for _ in range(40)] for _ in range(3)]  # equal majorities, different sets
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    wanted = {i for i in range(len(texts)) if root[i] == i}
    assert wanted <= kept and len(kept - wanted) <= 0.1 * (len(texts) - len(wanted))


def test_fingerprints_of_long_texts_in_parts(monkeypatch):
    r = random.Random(3)
    hashes = [[r.getrandbits(64) for _ in range(n)] for n in (0, 1, 7, 8, 9, 100)]
    whole = simhash.majority(hashes)
    monkeypatch.setattr(simhash, "PART", 8)
    assert (simhash.majority(hashes) == whole).all()


def test_wide_fingerprints_of_long_texts():
    """Texts beyond one block of shingles, against all bits at once."""
    take = simhash.wide_printer(5, 42)
    text = " ".join(str(i % 50_021) for i in range(70_000))
    words = text.encode().split()
    pieces = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    raw = np.stack([np.frombuffer(xxhash.xxh3_128_digest(p, 42) + xxhash.xxh3_128_digest(p, 43), np.uint8) for p in pieces])
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    want = np.packbits(2 * ones > len(pieces), bitorder="little").view(np.int64)
    found = take(pa.array([text]))
    members = np.unique(np.ascontiguousarray(raw[:, :8]).view(np.uint64))
    assert [c[0].as_py() for c in found[:-1]] == want.tolist() and found[-1][0].as_py() & (1 << 64) - 1 == xxhash.xxh64_intdigest(members.tobytes())


def test_top_k_is_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(0, 4, 6) / 4).tolist()) for i in range(300)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [9.5]), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "b": F.lit(2)})
    found = covertree.top_k(df, F.col("vec_id") % 50 == 0, k=7).collect()
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=False)), c) for c in whole if c != q)[:7]
            wanted += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    same([(x.query_id, x.rank, x.vec_id, x.score) for x in found], wanted)


def test_cover_trees_cover():
    rows = np.random.default_rng(1).normal(size=(500, 5))
    rows[100:160] = rows[0]

    def check(node):
        d = np.sqrt(((rows[node.points] - rows[node.centre]) ** 2).sum(1))
        assert d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for c in node.children:
                check(c)

    check(covertree.cover_tree(rows))


def brute_top(rows, k, asked):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = set()
    for q, a in vectors:
        if not asked(q):
            continue
        scores = [(-max(-(1 << 63) + 2, min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), c) for c, b in vectors if c != q]
        out |= {(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_top_k_of_large_components(spark):
    """Scores beyond 2^53, beyond 2^62, and beyond what a long holds."""
    r = random.Random(6)
    for scale in (1.0, 3e5, 4e6, 1e12):
        rows = [(i, [r.gauss(0, scale) for _ in range(4)]) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = covertree.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
        assert {tuple(x) for x in found} == brute_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_components_that_overflow(spark):
    """1024 x beyond all doubles, norms beyond them, and scores below what a long holds where there are few rows."""
    rows = [(0, [1.7e308, 1.0]), (1, [1.7e308, 2.0]), (2, [-1.7e308, 1.0]), (3, [1e200, -1e200]), (4, [1.0, 1.0]), (10, [-1e300, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(x) for x in covertree.top_k(df, F.col("vec_id") % 10 == 0, k=9).select("query_id", "vec_id", "score").collect()]
    most, least = (1 << 63) - 1, -(1 << 63) + 2
    assert sorted(found) == [(0, 1, most), (0, 2, least), (0, 3, most), (0, 4, most), (0, 10, least), (10, 0, least), (10, 1, least), (10, 2, most), (10, 3, least), (10, 4, least)]


def test_top_k_over_blocks_of_clusters(spark, monkeypatch):
    """Many blocks, most pairs of which are out of reach; repeated vectors and one vector as a third of all."""
    monkeypatch.setattr(covertree, "CANDIDATES", 40)
    monkeypatch.setattr(covertree, "QUERIES", 8)
    seen = []
    reachable = covertree.reachable
    monkeypatch.setattr(covertree, "reachable", lambda *a: seen.append(reachable(*a)) or seen[-1])
    r = random.Random(7)
    centres = [[r.gauss(0, 8) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(400)] + [(1_000 + i, centres[0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash("rank", "score"))
    found = covertree.top_k(df, F.col("vec_id") % 7 == 0, k=10).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(x) for x in found} == brute_top(rows, 10, lambda i: i % 7 == 0)
    assert 0 < seen[0].count() < 15 * 15


LANG = {"en": ["the", "and", "thing", "with", "other", "ing"], "de": ["der", "und", "ung", "schön", "über", "nicht"], "fr": ["les", "été", "que", "où", "ça", "pour"]}


def labelled(spark, n=400):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANG))
        rows.append((i, " ".join(r.choice(LANG[lang]) for _ in range(r.randrange(6, 60))), lang))
    rows += [(n + 1, None, "en"), (n + 2, "", "de"), (n + 3, "12 !? 34", "fr"), (n + 4, "the and other", None), (None, "der und nicht", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(clash("score"))


def test_language_on_held_out_rows(spark):
    df = labelled(spark)
    found = langid.languages(df).collect()
    wanted = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and sum(r.lang_pred == wanted[r.doc_id] for r in held) / len(held) >= 0.95
    by_id = {r.doc_id: r for r in found}
    assert [by_id[400 + k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in found)
    assert by_id[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert langid.languages(df.limit(0)).count() == 0
    assert langid.accepted(df, None).count() == 0


def test_language_stage_names_the_language_of_texts(spark, tmp_path):
    """Held-out labels that are missing or wrong give way to the prediction; where it is not sure, a given one stays."""
    import corpus_pipeline

    df = labelled(spark)
    wanted = {r.doc_id: r.lang for r in df.collect() if r.doc_id is not None and r.doc_id < 400}
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = F.when(F.col("lang") == "de", "en").otherwise("de")
    marred = df.withColumn("lang", F.when(held & (F.col("doc_id") % 2 == 0), None).when(held, other).otherwise(F.col("lang")))
    found = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, marred, str(tmp_path)).collect()}
    asked = [i for i in wanted if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(asked) > 50 and sum(found[i] == wanted[i] for i in asked) / len(asked) >= 0.95
    assert set(found) == {*wanted, None, 404} and found[404] == "en"
    doubtful = spark.createDataFrame([(1, "x", "fr"), (2, "x", None), (3, None, "fr")], df.select("doc_id", "text", "lang").schema)
    even = langid.Network.fresh(["de", "en", "fr"], 4, 3)
    even.params = {k: 0 * v for k, v in even.params.items()}
    assert sorted(tuple(r) for r in langid.identified(doubtful, even).collect()) == [(1, "x", "fr"), (2, "x", "de")]


def test_gradients_by_differences():
    net = langid.Network.fresh(["a", "b", "c"], 3, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    r = np.random.default_rng(0)
    steps, mask = r.integers(0, 256, (5, 4)), np.ones((5, 4, 1))
    mask[3:, 1] = 0
    label, weight = np.array([0, 1, 2, 0]), np.ones(4)
    _, grads = net.gradients(steps, mask, label, weight)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.params[k][at] += 1e-2
        up = net.gradients(steps, mask, label, weight)[0]
        net.params[k][at] -= 2e-2
        down = net.gradients(steps, mask, label, weight)[0]
        net.params[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * abs(g[at]) + 1e-4


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    clean, bad = ["one", "two", "three", "four", "five", "six", "seven"], ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = [r.choice(clean) + str(r.randrange(90)) for _ in range(r.randrange(5, 60))]
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic if i % 7 else None))
    rows += [(1001, None), (1002, ""), (1003, "you 1d10t, you mоron"), (1004, "x" * 5000), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash("score"))
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("?"))
    found = {x.doc_id: x for x in toxicity.toxicity(docs, marks).collect()}
    held = [i for i in range(600) if found[i].held_out]
    assert sum(found[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.97
    assert found[1003].predicted == 1 and found[1002].predicted == found[1001].predicted == found[1004].predicted == 0
    assert toxicity.toxicity(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_exception_phrases_spare_their_terms():
    lex = toxicity.Lexicon({"trash ": 1.0, "lose": 0.5}, ("trash can",), (-4.0, 4.0, 1.0))
    assert lex.measures("the trash can is full") == (0.0, 0.0) and lex.measures("TR4SH")[0] > 0 and lex.measures("closely")[0] == 0


def brute_revisits(rows):
    out = {}
    for r in rows:
        if r["kind"] != "revisit":
            continue
        best = None
        for p in rows:
            if p["kind"] == "response" and p["status"] == 200 and p["at"] is not None and r["at"] is not None and p["url"] and p["url"] == r["url"] and (p["at"], p["id"]) < (r["at"], r["id"]):
                best = p if best is None or (p["at"], p["id"]) > (best["at"], best["id"]) else best
        if best is None:
            out[r["id"]] = ("no_response", None)
            continue
        if r["digest"] is not None:
            ok = r["digest"] == best["digest"]
        elif "etag" in r["headers"]:
            ok = r["headers"]["etag"].removeprefix("W/") == best["headers"].get("etag", "?").removeprefix("W/")
        else:
            ok = r["headers"].get("last-modified", 0) == best["headers"].get("last-modified", 1)
        out[r["id"]] = ("resolved" if ok else "mismatch", best["id"])
    return out


@pytest.mark.parametrize("buckets", [1, 5])
def test_revisits(spark, buckets):
    r = random.Random(8)
    rows = []
    for i in range(300):
        kind = r.choice(["response", "revisit"])
        headers = {"date": str(i)}
        if r.random() < 0.7:
            headers["etag"] = r.choice(['"a"', 'W/"a"', '"b"'])
        if r.random() < 0.5:
            headers["last-modified"] = r.choice(["x", "y"])
        rows.append({"id": i, "url": r.choice(["h/a", "h/a", "h/b", None]), "at": r.choice([None, *range(40)]), "kind": kind, "status": r.choice([200, 200, 404]) if kind == "response" else 304, "headers": headers, "digest": r.choice(["d1", "d2", None])})
    forms = ["http://www.H/{}?utm_source=z#top", "https://h:443/{}/", "h/{}"]
    df = spark.createDataFrame([(x["id"], None if x["url"] is None else r.choice(forms).format(x["url"][2:]), x["at"], x["kind"], x["status"], x["headers"], x["digest"]) for x in rows], "record_id long, url string, captured_at long, kind string, status int, headers map<string,string>, digest string")
    found = {x.record_id: x for x in warc.resolve(df, buckets).collect()}
    wanted = brute_revisits(rows)
    assert {k: (v.outcome, v.ref_id) for k, v in found.items()} == wanted
    for k, (outcome, ref) in wanted.items():
        if outcome == "resolved":
            base = rows[ref]["headers"]
            assert found[k].headers == base | {h: v for h, v in rows[k]["headers"].items() if h in warc.PERMITTED}


def test_revisits_without_url_or_time_and_repeated_pages(spark):
    """Pages with null URLs and texts, repeated rows, and extra columns under the operator's names."""
    rows = [(1, "http://a.example/x", "one"), (2, None, "one"), (3, None, None), (4, "http://a.example/x", None), (4, "http://a.example/x", None), (5, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("record_id", "bucket", "ref", "near", "digest", "headers")})
    found = warc.resolve(warc.captures(pages, again=2)).collect()
    assert sorted((x.record_id, x.outcome) for x in found if x.canonical_url is None) == [(5, "no_response"), (7, "no_response")]
    assert sorted(x.record_id for x in found) == [3, 5, 7, 9, 9, 11] and {x.outcome for x in found if x.record_id == 3} == {"resolved"}
    assert [x.digest for x in found if x.record_id == 5] == [None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert planes.token_files(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert suffixes.repeated_bytes(docs).count() == 0 and substrings.repeated_words(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    assert warc.resolve(warc.captures(pages)).count() == 0
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    import corpus_pipeline

    df = labelled(spark, 200).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    leak = "zero one two three four five six seven eight nine ten eleven"
    more = spark.createDataFrame([(5000, leak, "en", "s", len(leak)), (5001, leak + " b", "en", "s", 0), (7, "same again", "en", "s", 1), (7, "same again", "en", "s", 1)], df.schema)
    df.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    last = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in last.select("doc_id").collect()}
    assert 5000 not in ids and 5001 not in ids and 201 not in ids


def test_components_against_brute_force(spark):
    """Chains of near copies, exact copies and empty texts: the smallest id that can be reached."""
    r = random.Random(9)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(900)) for _ in range(4)]
    rows, i = [], 50
    for text in base:
        for _ in range(8):
            words = text.split()
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
            rows.append((i, text))
            i -= 1
    rows += [(60, base[0]), (61, base[0]), (62, None), (63, ""), (64, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    fps = {k: int(x.fingerprint, 16) for k, x in found.items()}
    reach = {k: k for k in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    reach[a] = min(reach[a], reach[b])
    assert {k: x.component_id for k, x in found.items()} == reach and len(set(reach.values())) < len(reach)


def test_language_of_long_and_repeated_rows(spark):
    df = labelled(spark, 300)
    long = "der und nicht über " * 20_000
    more = spark.createDataFrame([(2_000, long, None), (2_000, long, None), (2_001, "the", None), (2_001, "the", None)], "doc_id long, text string, lang string")
    found = langid.languages(df.unionByName(more, allowMissingColumns=True)).where("doc_id >= 2000").collect()
    assert len(found) == 4 and {x.lang_pred for x in found if x.doc_id == 2_000} == {"de"} and len({(x.doc_id, x.score) for x in found}) == 2
    net = langid.Network.fresh(["a", "b"], 4, 3)
    one = [b"abc" * 100, b"", b"x", b"abc" * 100, b"abcabcab", b"q" * 129]
    together = langid.pooled(net, one)
    for text, row in zip(one, together, strict=True):  # whatever else is in the batch
        assert np.allclose(row, langid.pooled(net, [text])[0], atol=1e-6) and abs(row.sum() - bool(text)) < 1e-5


def test_toxicity_of_repeated_rows_and_known_insults(spark):
    df = spark.createDataFrame([(i, f"fine day number {i}") for i in range(30)] + [(40 + i, f"you are a scumbag {i}") for i in range(12)] + [(90, "what a wanker")] * 2 + [(91, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 40)) for i in [*range(30), *range(40, 52)]], "doc_id long, toxic int")
    found = [(x.doc_id, x.predicted) for x in toxicity.toxicity(df, marks).collect()]
    assert found.count((90, 1)) == 2 and (91, 0) in found and len(found) == 45


def test_decontamination_of_no_documents(spark, docs):
    bench = spark.createDataFrame([("a", "alpha beta")], "item_id string, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and decontaminate.remove_documents(docs.limit(0), bench).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that operators use themselves, and empty tables."""
    import corpus_pipeline

    mine = ["own_digest", "kept_id", "own_hash", "bad_id", "n_words", "n_removed", "kept_sha256", "kept_text", "__own", "__id", "x1"]
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"the thing with other words {i} and {shared if i > 2 else i}", "en", 5) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({n: F.lit(f"my {n}") for n in mine})
    spark.createDataFrame([("a", "never seen words of any item at all in here")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        kept = out.collect()
        assert kept and all(r[n] == f"my {n}" for r in kept for n in mine), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_other_tokenizer_files_take_the_whole_path(tmp_path):
    import json
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    raw = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    raw["normalizer"]["normalizers"] = raw["normalizer"]["normalizers"][:2]  # keeps capitals
    path = os.path.join(tmp_path, "other.json")
    json.dump(raw, open(path, "w", encoding="utf-8"))
    texts = ["The Quick brown FOX", "", "ÉTÉ, ok", "a\tB\n c"]
    coder, tok = planes.WordCoder(path), Tokenizer.from_file(path)
    assert not coder.wordwise and planes.WordCoder(public_tokenizers.path("word_bpe_49k.json")).wordwise
    assert [np.frombuffer(x, "<u4").tolist() for x in coder(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
