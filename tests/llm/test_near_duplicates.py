"""Jaccard join, repeated strings, fingerprints and embedding near-duplicates against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from quorumlake.llm import embedding_dedup, jaccard_join, repeats, syncmers


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(nodes, linked):
    least = dict.fromkeys(nodes)
    for start in sorted(nodes):
        if least[start] is None:
            stack = [start]
            while stack:
                x = stack.pop()
                if least[x] is None:
                    least[x] = start
                    stack += [y for y in nodes if least[y] is None and linked(x, y)]
    return least


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = [f"c{k}" for k in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "one two three four five")]
    for k in range(n):
        if k % 3 == 0 or len(rows) < 12:
            size = rng.choice((6, 20, 70, 150, 300))
            text = [rng.choice(words) for _ in range(size)]
            if k % 2:
                text[size // 2 : size // 2] = common  # a passage that many documents share
        else:
            text = (rng.choice(rows[7:])[1] or "").split()
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: max(5, int(len(text) * rng.uniform(0.8, 1)))]
        rows.append((10 + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = near_copies(seed, 240)
    if seed == 2:  # very long texts, alike and not
        long = random.Random(8).choices([f"v{k}" for k in range(5000)], k=150000)
        rows += [(5000, " ".join(long)), (5001, " ".join([*long[:9000], "other", *long[9000:]])), (5002, " ".join(reversed(long)))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, set_id string, component_id int").repartition(4)
    sets = {i: shingles(t) for i, t in rows}

    def linked(x, y):
        a, b = sets[x], sets[y]
        return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)

    want = components(list(sets), linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    if seed == 1:  # names of two bits, so that most sets share theirs with others
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, 2).collect()} == got
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard_join.one_of_each(docs).count() == 1
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 400), dtype=np.uint64))
        drop = rng.random(len(a)) < 0.05
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 64, int(drop.sum()), dtype=np.uint64)]))
        if len(b) and jaccard_join.links(a, b):
            ka, kb = jaccard_join.sketch_keys(a), jaccard_join.sketch_keys(b)
            assert set(ka.tolist()) & set(kb.tolist())
            x, y = jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)
            size = min(len(x), len(y))
            far = int(np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum())
            assert far <= len(np.setxor1d(a, b)) and bool(jaccard_join.may_link(np.array([len(a)]), np.array([len(b)]), np.array([far]))[0])


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab é") for _ in range(600))
    edits = lambda t: t[: (k := rng.randrange(len(t)))] + "X" + t[k:]
    rows = [(0, None), (1, ""), (2, base), (3, base), (4, edits(base)), (5, "a" * 1000), (6, "ab" * 300), (7, base[30:131]), (8, base[30:129]), (9, base[100:300] + base[50:250]), (10, "a" * 99), (11, "a" * 100)]
    rows += [(20 + k, "".join(rng.choice("xyz") for _ in range(50)) + base[100 : 190 + k] + "".join(rng.choice("xyz") for _ in range(60))) for k in range(40)]
    rows += [(100 + k, edits(edits(base))) for k in range(40)]
    long = "".join(rng.choice("abcdefgh é") for _ in range(150000))
    rows += [(300, long), (301, "z" * 50 + long[20000:] + long[:300])]  # very long texts
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, place int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.without_repeats(docs).collect()}
    assert got == removed(rows)


def test_repeats_of_identical_rows_and_none(spark):
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.without_repeats(docs).collect()) == [0, 0, 300]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(k * 3, "".join(rng.choice("abcde é") for _ in range(rng.randrange(0, 3000)))) for k in range(60)] + [(1, None), (4, ""), (7, "short"), (181, "short"), (500, "long " * 30000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, p string").repartition(5)
    got = {r["doc_id"]: r for r in syncmers.fingerprint_pairs(docs).collect()}
    rows.sort(key=lambda r: r[0])
    for k, (i, t) in enumerate(rows):
        t, x = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = (syncmers.fingerprints([s.encode()]) for s in (t, edited, x))
        assert r["fingerprint"] == own[0].tobytes().hex() and r["edited_fingerprint"] == other[0].tobytes().hex()
        assert r["near_edited"] == syncmers.likeness(own, other)[0] and r["near_next"] == syncmers.likeness(own, following)[0]
    assert got[7]["fingerprint"] == got[181]["fingerprint"]


def mixed(x):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * m) & ((1 << 64) - 1)
    return x ^ (x >> 33)


def test_syncmers_by_brute_force():
    """Every k-mer whose smallest inner substring (by hash) is its first or last one, and no other; then the bins."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(n)).encode() for a, n in (("ab", 300), ("abcdefé ", 500), ("x", 80), ("abc", 20), ("abc", 19), ("q", 1), ("", 0), ("0123456789", 400))]
    doc, at, value = syncmers.anchors(texts)
    for i, t in enumerate(texts):
        order = [mixed(int.from_bytes(t[k : k + syncmers.S], "big")) for k in range(len(t) - syncmers.S + 1)]
        inner = syncmers.K - syncmers.S + 1
        want = [p for p in range(len(t) - syncmers.K + 1) if min(order[p : p + inner]) in (order[p], order[p + inner - 1])]
        if 0 < len(t) < syncmers.K:
            want = [0]
        own = doc == i
        assert sorted(at[own].tolist()) == want
        kmers = {}
        for p, v in zip(at[own].tolist(), value[own].tolist(), strict=True):
            assert kmers.setdefault(t[p : p + syncmers.K], v) == v
        assert len(set(kmers.values())) == len(kmers)
        bins = [0] * syncmers.BINS
        for b in range(syncmers.BINS):
            low = [v & ((1 << 36) - 1) for v in kmers.values() if v >> 57 == b]
            bins[b] = (min(low) >> 20) % 65535 + 1 if low else 0
        assert syncmers.fingerprints([t])[0].tolist() == bins


def test_anchor_table_matches_places(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, "start of one " + passage), (2, "quite another beginning, " + passage + " end"), (3, None), (4, "")]
    table = syncmers.anchor_table(spark.createDataFrame(rows, "doc_id long, text string"))
    both = table.where("doc_id = 1").withColumnRenamed("position", "p").join(table.where("doc_id = 2").withColumnRenamed("position", "q"), "hash").selectExpr("q - p as shift").groupBy("shift").count().collect()
    assert max(both, key=lambda r: r["count"])["shift"] == 25 - 13 and {r["doc_id"] for r in table.select("doc_id").distinct().collect()} == {1, 2}


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(5, "just one document " * 9)], "doc_id long, text string")
    assert [r["near_next"] for r in syncmers.fingerprint_pairs(one).collect()] == [1.0]
    assert syncmers.fingerprint_pairs(one.limit(0)).count() == 0


def test_anchors_are_context_free():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(300)).encode()
    left, right = (("".join(rng.choice("ijkl") for _ in range(n)) + "|").encode() for n in (50, 131))
    _, p, h = syncmers.anchors([passage])
    for prefix in (left, right):
        _, q, g = syncmers.anchors([prefix + passage + b"tail of another kind"])
        assert set(zip((p + len(prefix)).tolist(), h.tolist(), strict=True)) <= set(zip(q.tolist(), g.tolist(), strict=True))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(300):
        v = centres[k % 12] + rng.normal(size=16) * 0.25
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1), (305, rows[1][1], None), (306, [None] + rows[2][1][1:], 2), (307, rows[0][1][:8], 0)]
    rows += [(308 + k, [x * m for x in rows[0][1][:16]], 5) for k, m in enumerate((1.0, 1e200, 1e-200, 1e-310, -1e300))]  # norms that overflow or vanish
    rows += [(313, [1.0, 0.0], 6), (314, [0.93, math.sqrt(1 - 0.93**2)], 6), (315, [0.92, math.sqrt(1 - 0.92**2)], 6), (316, [0.92, math.sqrt(1 - 0.92**2)], 6), (317, [], 6)]  # a tie at the threshold
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(4)

    def linked(x, y):
        (i, a, la), (j, b, lb) = rows[x], rows[y]
        if i == j or la is None or la != lb or a is None or b is None or len(a) != len(b) or any(v is None or not math.isfinite(v) for v in (*a, *b)):
            return False
        a, b = np.array(a), np.array(b)
        if not (a.any() and b.any()):
            return False
        a, b = (np.ldexp(v, -int(math.frexp(np.abs(v).max())[1])) for v in (a, b))
        return bool(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93)

    least = components(list(range(len(rows))), linked)
    want = {k: (sum(linked(k, j) for j in range(len(rows))), least[k], least[k] == k) for k in range(len(rows))}
    assert max(n for n, _, _ in want.values()) > 2
    for side in (1 << 20, 256):
        old, embedding_dedup.SIDE = embedding_dedup.SIDE, side
        try:
            got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(vectors).collect()}
        finally:
            embedding_dedup.SIDE = old
        assert got == want
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_null_ids(spark):
    text = "the cat sat on the mat and slept all day long while it rained outside the house of the old man " * 2
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (2, None), (None, "alone here")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.near_duplicates(docs).collect()) == [("1", "1"), ("2", "2"), ("None", "1"), ("None", "1"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(docs).collect()) == ["1", "2", "None", "None", "None"]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.without_repeats(docs.where("text is null or text <> 'alone here'")).collect()}
    assert got >= {(1, len(text), len(text)), (2, 0, 0)} and {i for i, _, _ in got} == {None, 1, 2}
    assert syncmers.fingerprint_pairs(docs).count() == 5
    vectors = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_dedup.near_duplicates(vectors).collect()) == [("1", 1, "None", False), ("2", 0, "2", True), ("None", 1, "None", True)]
