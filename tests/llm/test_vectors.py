import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowecho.llm import hard_negatives, vector_codes, vectors

KIND = "vec_id long, embedding array<float>, label int, code string, error long, v string, n int, `window` int"


def rows(n=700, dims=32, seed=1, hot=200):
    r = np.random.default_rng(seed)
    out = [(int(i), (r.normal(size=dims) / 4).tolist(), int(r.integers(10))) for i in r.permutation(3 * n)[:n]]
    same = out[3][1]
    out += [(5 * n + i, same, 1) for i in range(hot)] + [(9 * n, None, 1), (9 * n + 1, [None] * dims, 2), (9 * n + 2, [], 3),
            (9 * n + 3, [0.5] * (dims - 1) + [math.nan], 3), (9 * n + 4, [math.inf] * dims, 4), (9 * n + 5, [0.5] * 7, 4),
            (9 * n + 6, [0.25] * dims, None), (9 * n + 8, [4e4] * dims, None), (9 * n + 7, [-0.001] * dims, None)]
    return out


def frame(spark, some):
    return spark.createDataFrame([(*x, "c", 1, "v", 2, 3) for x in some], KIND).repartition(4)


def kept(some, dims):
    return [(i, np.floor(np.array(v) * 256).astype(int), lab) for i, v, lab in some
            if v and len(v) == dims and None not in v and np.isfinite(v).all() and np.abs(v).max() < vectors.LARGEST]


def slow_codes(some, dims, parts, entries, rounds):
    """The codes by definition: every part against every entry."""
    good = sorted(kept(some, dims), key=lambda x: (x[0] is None, x[0] or 0, x[1].tolist()))
    width = -(-dims // parts)
    cells = np.zeros((len(good), parts * width), int)
    cells[:, :dims] = [v for _, v, _ in good]
    cells = cells.reshape(len(good), parts, width)
    books = cells[:entries].copy()

    def nearest():
        far = ((cells[:, None] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=1), far.min(axis=1).sum(axis=1)

    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for e in range(len(books)):
                own = cells[codes[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(axis=0) // len(own)
    codes, error = nearest()
    return Counter((i, lab, bytes(c.tolist()).hex(), int(e)) for (i, _, lab), c, e in zip(good, codes, error)), books


@pytest.mark.parametrize("dims, parts, entries, n", [(32, 16, 64, 700), (30, 4, 9, 90), (8, 8, 256, 40), (3, 1, 2, 300)])
def test_vector_codes_equal_brute_force(spark, dims, parts, entries, n):
    some = rows(n, dims) + [(7_000_000, (np.ones(dims) * 200).tolist(), 3), (None, [0.125] * dims, 1)]
    some += [some[0], some[1]]  # repeated rows
    got, books = vector_codes.compress(frame(spark, some), parts, entries, 2)
    want, slow = slow_codes(some, dims, parts, entries, 2)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in got.collect()) == want
    assert np.array_equal(books, slow.transpose(1, 0, 2))
    back = vector_codes.reconstruct(got, books)
    assert back.columns == [*got.columns, "approximation"] and all(len(r.approximation) >= dims for r in back.collect())


def test_vector_codes_of_an_empty_table(spark):
    got, books = vector_codes.compress(frame(spark, rows()[:0]))
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and books.size == 0
    got, _ = vector_codes.compress(frame(spark, [(1, None, 1), (2, [], 1)]))
    assert got.count() == 0


def test_hilbert_keys_walk_by_single_steps():
    for dims, size in ((2, 16), (3, 8), (4, 4)):
        points = np.stack(np.meshgrid(*[np.arange(size)] * dims, indexing="ij"), -1).reshape(-1, dims) - 3
        keys = vector_codes.hilbert_keys(points)
        walk = points[np.argsort(keys)]
        assert len(np.unique(keys)) == len(points) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert len(vector_codes.hilbert_keys(np.zeros((5, 0), int))) == 5


def test_shortlists_hold_the_nearest_entries():
    r = np.random.default_rng(4)
    data = r.integers(-300, 300, (1000, 8))
    chunk = vector_codes.Chunk.build(data, 2)
    chunk = vector_codes.Chunk.unpack(1000, 2, chunk.pack())
    books = r.integers(-300, 300, (2, 40, 4))
    books[:, 7] = books[:, 3]  # a tie: the lower index
    far = chunk.data[0][:, None].astype(int) - books[0][None]
    whole, codes, which = chunk.assign(0, books[0])
    found = np.repeat(whole, vector_codes.BLOCK)[:1000]
    found[which] = codes
    assert np.array_equal(found, (far ** 2).sum(axis=2).argmin(axis=1)) and not (found == 7).any()
    # one far group of entries: whole blocks are assigned by their sums
    far_apart = np.stack([np.zeros(4, int), np.full(4, 10_000)])
    assert (chunk.assign(0, far_apart)[0] == 0).all()


def slow_negatives(some, dims, every, positives=5, negatives=10, lowest=30, highest=90):
    first = {}
    for i, v, lab in kept(some, dims):
        if lab is not None and i is not None:
            first[i] = min(first.get(i, (lab, v.tolist())), (lab, v.tolist()))
    ids = np.array(sorted(first))
    labels = np.array([first[i][0] for i in ids])
    values = np.array([first[i][1] for i in ids]).reshape(len(ids), -1)
    out = set()
    for a in np.flatnonzero(ids % every == 0):
        score = values @ values[a]
        order = np.lexsort((ids, -score))
        same = [k for k in order if labels[k] == labels[a] and k != a][:positives]
        other = [k for k in order if labels[k] != labels[a]]
        for p in same:
            inside = [k for k in other if lowest * score[p] <= 100 * score[k] <= highest * score[p]]
            for rank, k in enumerate(inside[:negatives], 1):
                out.add((ids[a], ids[p], rank, ids[k], score[p], score[k]))
    return out


@pytest.mark.parametrize("dims, n, leaf, group", [(32, 700, 16, 1 << 14), (4, 900, 8, 40), (2, 500, 64, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims, n, leaf, group):
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    some = rows(n, dims) + [(None, [0.5] * dims, 1)]
    some += [some[0], (some[1][0], [0.25] * dims, 2)]  # ids that are taken
    some += [(8_000_000 + 5 * i, [0.25 * (i % 3)] * dims, i % 2) for i in range(40)]  # ties
    got = hard_negatives.mine(frame(spark, some), "vec_id % 5 = 0")
    want = slow_negatives(some, dims, 5)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


@pytest.mark.parametrize("leaf", [8, 512])
def test_trees_leave_out_only_what_cannot_score(monkeypatch, leaf):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    r = np.random.default_rng(2)
    data = np.concatenate([r.integers(-40, 40, (1500, 5)) + c for c in r.integers(-4000, 4000, (6, 5))] + [np.ones((600, 5), int)])
    tree, order = hard_negatives.Tree.build(data.astype(np.int32))
    rows_, nodes = tree.pack()
    tree = hard_negatives.Tree.unpack(rows_, nodes, len(data), 5)
    assert np.array_equal(np.sort(order), np.arange(len(data))) and np.array_equal(tree.vectors, data[order])
    asked = data[::400].astype(float)
    scores = asked @ tree.vectors.T
    low, high = np.quantile(scores, 0.9, axis=1).round(), np.quantile(scores, 0.95, axis=1).round()

    class Seen:
        met = []

        def bounds(self):
            return low, high

        def take(self, which, found, begin):
            for line, k in zip(found, which):
                self.met += [(int(k), begin + int(j)) for j in np.flatnonzero((line >= low[k]) & (line <= high[k]))]
                self.looked = getattr(self, "looked", 0) + len(line)

    seen = Seen()
    tree.search(asked, seen)
    want = {(k, int(j)) for k in range(len(asked)) for j in np.flatnonzero((scores[k] >= low[k]) & (scores[k] <= high[k]))}
    assert len(seen.met) == len(want) and set(seen.met) == want
    assert leaf > 8 or seen.looked < 0.7 * scores.size  # whole subtrees are left out


def test_hard_negatives_of_few_rows(spark):
    empty = hard_negatives.mine(frame(spark, rows()[:0]), "vec_id % 5 = 0")
    assert empty.count() == 0 and empty.columns[2] == "rank"
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), "vec_id = 9").count() == 0
    assert hard_negatives.mine(frame(spark, [(5, [1.0], 1), (2, [1.0], 2)]), "vec_id = 5").count() == 0  # no positive
    got = hard_negatives.mine(frame(spark, [(5, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2), (4, [0.5], 0), (6, [0.95], 2)]), "vec_id = 5")
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [
        (5, 2, 1, 3, 65536, 32768), (5, 2, 2, 4, 65536, 32768)]


def test_integers_of_vectors():
    at, values = vectors.to_integers(pa.array([[0.1, -0.1], None, [1.0], [None, 1.0], [], [0.999, 1e4]], pa.list_(pa.float32())))
    assert [a.tolist() for a in at] == [[2], [0, 5]] and values[1].tolist() == [[25, -26], [255, 2560000]]
