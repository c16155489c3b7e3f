"""Log reassembly against a sequential store, whitening against numpy, toxicity on planted words."""

import random
import zlib

import numpy as np
import pytest

from quorumlake.llm import log_reassembly, toxicity, whitening


def in_turn(docs, labels, per_epoch=64):
    """The log record by record: a stack for each open transaction, one store."""
    bad = {d for d, toxic in labels if toxic == 1}
    out, store, open_, commits, epoch = [], {}, {}, 0, 0

    def ended():
        nonlocal epoch
        epoch += 1
        out.append(("state", epoch, len(store), sum(store.values())))

    order = lambda r: (r[0], r[2] is not None, r[2] or "")
    for doc, text, source in sorted((d for d in docs if d[0] is not None), key=order):
        h = zlib.crc32(str(doc).encode())
        act, key, stack = h % 17, h // 100 % 30000, open_.setdefault(source, [])
        if act <= 1:
            for _, k, value in (e for e in stack if e):
                store.pop(k, None)
                if value is not None:
                    store[k] = value
            stack.clear()
            commits += 1
            if commits % per_epoch == 0:
                ended()
        elif act == 2:
            out += [("abort", e[0], doc, e[1]) for e in stack if e]
            stack.clear()
        elif act <= 4:
            stack.append(None)
        elif act <= 6:
            while stack and (e := stack.pop()):
                out.append(("rollback", e[0], doc, e[1]))
        else:
            stack.append((doc, key, None if text is None or doc in bad else zlib.crc32(f"{key}:{text}".encode())))
    out += [("abort", e[0], None, e[1]) for stack in open_.values() for e in stack if e]
    if commits % per_epoch:
        ended()
    return out


def logged(rng, n, quiet=0):
    """Records of a source with most of them, of others, and of none; with ``quiet``, the first so many ids that end no
    transaction, so that one is longer than several blocks of blocks."""
    ids = [d for d in range(-40, 40 * n) if not quiet or zlib.crc32(str(d).encode()) % 17 > 2][: quiet or n]
    return [(d, rng.choice(["", None, "a", "é" * 50, f"text {d}"]), rng.choice([None, "a", "b", "b", "b", "b", "src é"])) for d in ids]


@pytest.mark.parametrize("bits,n,quiet", [(8, 900, 0), (2, 300, 0), (2, 0, 400)])
def test_log(spark, monkeypatch, bits, n, quiet):
    monkeypatch.setattr(log_reassembly, "BITS", bits)
    rng = random.Random(bits + n)
    docs = logged(rng, n or quiet, quiet) + [(None, "no place", "a"), (None, None, None)]
    labels = [(d, rng.choice([0, 1, None])) for d, _, _ in docs[::3]] + [(docs[0][0], 1), (docs[0][0], 0), (None, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, pos int, src string").repartition(3)
    marks = spark.createDataFrame([(*x, 2) for x in labels], "doc_id long, toxic int, key int")
    got = [tuple(r) for r in log_reassembly.reassemble(df, marks).collect()]
    assert sorted(got, key=str) == sorted(in_turn(docs, labels), key=str)
    assert any(r[0] == "rollback" for r in got) and any(r[0] == "abort" and r[2] is None for r in got)


def test_log_of_repeated_ids_and_none(spark):
    rng = random.Random(1)
    docs = [(d, t, s) for d, t, s in logged(rng, 150) for _ in range(rng.choice([1, 1, 3]))]
    docs += [(d, t, "z") for d, t, _ in docs[::5]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = [tuple(r) for r in log_reassembly.reassemble(df.repartition(3), none, 4).collect()]
    assert sorted(got, key=str) == sorted(in_turn(docs, [], 4), key=str)
    assert log_reassembly.reassemble(df.limit(0), none).count() == 0


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, x[0].tolist()) for k in range(300, 420)] + [(None, x[5].tolist())]
    odd = [(500, None), (501, [1.0, None] + [0.0] * 18), (502, [float("nan")] + [0.0] * 19), (503, [float("inf")] + [0.0] * 19), (504, []), (505, [1e38] + [0.0] * 19)]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows + odd], "vec_id long, embedding array<float>, label string, x int")
    got = whitening.whiten(df.repartition(3)).collect()
    q = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(q, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    want = (q - s / n) @ vectors / np.sqrt(values)
    assert {r["vec_id"] for r in got} == {r[0] for r in rows} and len(got) == 16 * len(rows)
    name = {r[0]: k for k, r in enumerate(rows)}
    for r in got:
        k, j = name[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == int(((n * q[k] - s) ** 2).sum())
        assert abs(abs(r["whitened"]) - abs(want[k, j])) < 1e-6 and abs(r["explained"] / (values[j] / np.trace(cov)) - 1) < 1e-8 and r["identity_error"] < 1e-9
    signs = {}
    for r in got:
        if abs(r["whitened"]) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(r["whitened"]) == np.sign(want[name[r["vec_id"]], r["component"] - 1]))
    assert all(len(x) == 1 for x in signs.values())


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    flat = whitening.whiten(make([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in flat)
    mixed = whitening.whiten(make([(k, [float(k), float(k % 3)]) for k in range(9)] + [(100 + k, [float(k * k)]) for k in range(5)])).collect()
    assert {(r["n"], r["component"]) for r in mixed if r["vec_id"] >= 100} == {(5, 1)} and {(r["n"], r["component"]) for r in mixed if r["vec_id"] < 100} == {(9, 1), (9, 2)}
    large = [[1e15 * k, -1e15 * (k % 2)] for k in range(4)]
    q = [[64 * int(v) + 1_000_000 for v in r] for r in large]
    s = [sum(r[j] for r in q) for j in (0, 1)]
    exact = [sum((4 * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in q]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(make(list(enumerate(large)))).collect()}
    assert got == {k: v if v < 1 << 63 else None for k, v in enumerate(exact)}


def talk(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rude = ["slursome", "slurful", "vileness", "vilest"]
    docs, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        words = talk(rng, rng.randrange(20, 120), plain).split()
        for _ in range(max(2, len(words) // 12) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(rude)
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad) if k % 2 else None))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").where("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 600"))
    odd = [(-1, None), (-2, ""), (None, "slurful " * 9), (-3, "x" * 400_000), (-4, talk(rng, 60_000, plain) + " slurful")]
    scored = toxicity.score(spark.createDataFrame([(*d, "s", 2.0) for d in docs[600:] + odd], "doc_id long, text string, lang string, score double").repartition(3), model)
    assert scored.columns == ["doc_id", "text", "lang", "score"]
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    right = sum((got[k] >= toxicity.THRESHOLD) == (k % 5 == 0) for k in range(600, 900))
    assert right >= 0.95 * 300
    assert got[-1] == got[-2] < toxicity.THRESHOLD <= got[None] and got[-3] < toxicity.THRESHOLD and all(0 <= s <= 1 for s in got.values())
    long = got[-4]
    assert abs(long - model.scores(toxicity.folded([odd[4][1]]), toxicity.Powers())[0]) < 1e-12 and long < toxicity.THRESHOLD
    nothing = toxicity.fit(spark.createDataFrame(docs[:20], "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(spark.createDataFrame(docs[:3], "doc_id long, text string"), nothing).collect()} == {0.0}


def test_pieces_of_a_long_text_count_together():
    rng = random.Random(2)
    text = talk(rng, 3000, ["slurful", "abc", "defghi", "é" * 5]).encode()
    powers = toxicity.Powers()
    whole, h, n, words = toxicity.counted_features([text], powers)
    known = np.unique(h)
    cut, of = toxicity.pieces([b"", text, b"x"], 1000)
    assert b"".join(c for c, k in zip(cut, of, strict=True) if k == 1) == text and len(cut) > 10 and max(map(len, cut)) < 1100
    at, place, value = toxicity.valued([text], known, powers)
    assert len(place) == len(known) and words[0] == 3000 and value.max() <= 1.0


def test_risk_is_never_negative():
    rng = np.random.default_rng(1)
    positive = np.arange(400) < 80
    hidden = positive | (rng.random(400) < 0.15)
    rows, cols = np.nonzero(np.c_[hidden & (rng.random(400) < 0.9), rng.random((400, 6)) < 0.3])
    w, bias = toxicity.nn_pu(rows, cols, np.ones(len(rows)), positive, 7, 0.3)
    z = np.bincount(rows, w[cols], 400) + bias
    assert w[0] > 2 and np.abs(w[1:]).max() < 1
    loss = np.logaddexp(0, z)
    assert loss[~positive].mean() >= 0.3 * loss[positive].mean() - 0.05
