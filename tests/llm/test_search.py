"""Lexical search, whitening and approximate neighbours against brute force, with nulls, ties, repeats and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from twinscope.llm import lexical, multiindex, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item string, rank int, score double, terms string, n string"


@pytest.fixture(scope="module")
def shipped(spark):
    from twinscope.ship import ship

    ship(spark)
    return spark


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def _corpus():
    rng = random.Random(11)
    words = [rng.choice("th er on né ÉS in ß Ω1".split()) + rng.choice("ou ti 日本 AN x2".split()) for _ in range(60)]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 80))) for k in range(120)]
    docs += [(900, None), (901, ""), (902, " \n.,"), (903, text(30_000)), (5, docs[5][1]), (904, docs[5][1]), (None, docs[6][1]), (None, docs[7][1])]
    shared = text(12)
    items = [(k, text(rng.randrange(1, 12)) + " " + shared[: rng.randrange(len(shared))]) for k in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere at_all"), (3, items[3][1]), (3, text(5)), (None, text(4)), (53, (words[0] + " ") * 40)]
    return docs, items


def _ranked(docs, items, k=10):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    held = [b for _, b in bags if b]
    n_docs, total = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in _terms(text) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if absent else d, -s) for r, (s, absent, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [None, 300])
def test_lexical(shipped, monkeypatch, shard):
    docs, items = _corpus()
    if shard:
        monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
        monkeypatch.setattr(lexical, "CELLS", 500)
    table = shipped.createDataFrame([(d, t, "i", 1, 0.5, "t", "n") for d, t in docs], DOCS).repartition(3)
    asked = shipped.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = lexical.search(table, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items)
    if not shard:
        assert lexical.search(table.limit(0), asked).count() == 0 and lexical.search(table, asked.limit(0)).count() == 0


def test_mined_graph_stands_for_the_items():
    rng = random.Random(2)
    core = [list(range(k, k + 9)) for k in (0, 20, 40)]
    rows = [sorted({*core[k % 3][: rng.randrange(3, 10)], *core[(k + 1) % 3][:4], *rng.sample(range(60), 5)}) for k in range(40)] + [[], [7]]
    nodes, left = lexical.mine(rows, 60)

    def spread(s):
        return [s] if s < 60 else [t for c in nodes[s - 60] for t in spread(c)]

    assert [sorted(t for s in r for t in spread(s)) for r in left] == rows
    assert all(len(n) > 1 for n in nodes) and sum(map(len, nodes)) + sum(map(len, left)) < 0.8 * sum(map(len, rows))
    text = ["a b c d e"] * 3 + ["a b c x", "a a a b"]
    shard = lexical.Shard(list(range(5)), text)
    assert shard.shared < shard.plain
    impacts = np.array([[100 ** k, k] for k in range(len(shard.vocabulary.terms))])
    want = [sum(impacts[shard.vocabulary.terms.index(t.encode())] for t in x.split()).tolist() for x in text]
    assert shard.scores(impacts).tolist() == want


VECTORS = "vec_id long, embedding array<float>, label int, v string, y string, rank int, score double"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "v", "y", 1, 0.5) for i, v in rows], VECTORS).repartition(3)


def _embeddings():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + 0.7 * rng.normal(size=24))]) for k in range(600)]
    rows += [(1000 + k, rows[50][1]) for k in range(40)] + [(2000, [2 * x for x in rows[0][1]]), rows[100], rows[7], (7, rows[8][1])]
    bad = [(3000, None), (3050, [float("nan")] + [0.0] * 23), (3051, [float("inf")] * 24), (3052, [None, 1.0]), (None, rows[3][1])]
    return rows, bad


def test_whitening(shipped):
    rows, bad = _embeddings()
    kept = rows + [bad[-1]]
    got = whitening.whiten(_vectors(shipped, rows + bad)).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = {}
    for (i, _), r in zip(kept, x):
        want.setdefault(i, []).append((int(((n * r - s) ** 2).sum()), (r - s / n) @ axes / np.sqrt(values)))
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n}
    sign, error = {}, set()
    for r in got:
        assert r.deviation in [int(d) for d, _ in want[r.vec_id]]
        near = min((w[r.component - 1] for d, w in want[r.vec_id] if d == r.deviation), key=lambda w: abs(abs(w) - abs(r.whitened)))
        assert abs(abs(near) - abs(r.whitened)) < 1e-9
        if abs(near) > 1e-6:
            assert sign.setdefault(r.component, near * r.whitened > 0) == (near * r.whitened > 0)
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        error.add(r.identity_error)
    assert len(error) == 1 and error.pop() < 1e-9


def test_whitening_cases(shipped):
    none = _vectors(shipped, [])
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(_vectors(shipped, [(1, None), (2, [1.0, 2.0]), (3, [1.0, 2.0])])).count() == 0
    # A cross: four equal variances, so the root repeats; one short vector; the fifth dimension is constant.
    cross = [(4 * k + j, [float(s * (j == i)) for i in range(4)] + [0.0]) for j in range(4) for k, s in enumerate((-1, 1))] + [(99, [])]
    got = whitening.whiten(_vectors(shipped, cross)).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3, 4] and len(got) == 4 * len(cross)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9 and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 0.25)
    large = [(1, [1e12, 3.0]), (2, [-1e12, 4.0]), (3, [0.0, 4.0])]       # sums beyond 64 bits
    x = [[math.floor(64 * float(np.float32(c))) for c in v] for _, v in large]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(r, s)) for (i, _), r in zip(large, x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(_vectors(shipped, large)).collect()} == want
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(_vectors(shipped, [(1, [1e30]), (2, [1.0])])).count()


def test_characteristic_polynomial(shipped):
    m = np.array([[4, 1, 0], [1, 3, 1], [0, 1, 2]], object)
    assert whitening.characteristic(shipped, m) == [-18, 24, -9, 1]
    primes = whitening.primes(200)
    assert primes[0] == 2**31 - 1 and all(pow(3, q - 1, q) == 1 for q in primes) and math.prod(primes) > 1 << 200
    p = np.poly([0, 0, 5, 5, 2, 9]).astype(int).tolist()[::-1]
    roots = [(a / 2**s, t) for a, s, t in whitening.largest_roots(p, 16)]
    assert [t for _, t in roots] == [1, 2, 1] and np.allclose([a for a, _ in roots], [9, 5, 2], rtol=1e-15)


def _nearest(rows, k=5):
    out = set()
    asked = {(i, tuple(v)) for i, v in rows if i % 50 == 0}
    for i, v in asked:
        v = np.array(v)
        scores = sorted((-(v @ np.array(u) / (np.linalg.norm(v) * np.linalg.norm(u))), j) for j, u in rows if j != i)
        out |= {(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(scores[:k])}
    return out


def test_multi_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    codes = multiindex.Codes(v)
    class Shared: value = codes  # noqa: E701
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(300)), "v": pa.array(v.tolist())})
    block = multiindex.Block(next(multiindex._build(Shared, 16, [batch])).to_pylist()[0], 16)
    asked = codes.of(v[:20] + 0.05 * rng.normal(size=(20, 16)))
    full = np.bitwise_count(asked[:, None] ^ block.words[None]).sum(2, dtype=int)
    for radius in (0, 3, 15, 16, 17, 40, 100, 256):
        q, row = block.within(asked, radius)
        assert sorted(zip(q.tolist(), row.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(full <= radius))))


def test_brute_force_by_products_holds_the_true_neighbours():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8))
    v[150:160] = v[3] * 2.0   # equal cosines
    class Shared: value = multiindex.Codes(v)  # noqa: E701
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(200)), "v": pa.array(v.tolist())})
    block = multiindex.Block(next(multiindex._build(Shared, 8, [batch])).to_pylist()[0], 8)
    asked, own = v[:20], np.arange(20)
    q, row = block.nearest(asked, own[:, None] != block.ids, 5)
    assert len(q) < 20 * 40   # few are scored one by one
    order = multiindex._best(q, block.ids[row], block.cosine(asked, q, row), row, 5)
    every = np.nonzero(own[:, None] != block.ids)
    true = multiindex._best(every[0], block.ids[every[1]], block.cosine(asked, *every), every[1], 5)
    assert list(zip(q[order], row[order])) == list(zip(every[0][true], every[1][true]))


def test_neighbours(shipped):
    rows, bad = _embeddings()
    table = _vectors(shipped, rows + bad + [(5000, [0.0] * 24)])
    index = multiindex.Index(table)
    queries = table.where("vec_id % 50 = 0")
    found, true = index.search(queries), index.search(queries, exact=True)
    want = _nearest(rows)
    # Twins differ in the last bits of a brute-force product: compare scores, and ids where they decide.
    got = {(r.query_id, r["rank"], round(r.score, 9)) for r in true.collect()}
    assert got == {(q, r, s) for q, r, _, s in want}
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and multiindex.recall(found, true) >= 0.9
    same = [r.vec_id for r in found.where("query_id = 50").orderBy("rank").collect()]
    assert same == [1000, 1001, 1002, 1003, 1004]
    assert all(r.vec_id != r.query_id for r in found.collect())
    none = _vectors(shipped, [])
    assert multiindex.Index(none).search(none).count() == 0
    assert index.search(none).count() == 0
    few = _vectors(shipped, [(0, [1.0, 2.0]), (1, [1.0]), (2, [2.0, -1.0])])
    assert {(r["rank"], r.vec_id) for r in multiindex.Index(few).search(few.where("vec_id = 0")).collect()} == {(1, 1), (2, 2)}


def test_recall_on_the_given_table(shipped):
    table = shipped.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, queries = multiindex.Index(table), table.where("vec_id % 50 = 0")
    assert multiindex.recall(index.search(queries), index.search(queries, exact=True)) >= 0.9
