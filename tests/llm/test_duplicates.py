import hashlib
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from rowecho.llm import debruijn, exact_dedup, simhash, suffix_dedup
from rowecho.llm.common import shared_folder
from tests.llm import cases


def fresh(spark):
    name = f"index_{uuid.uuid4().hex}"
    return name, f"{shared_folder(spark)}/{name}"


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_duplicates_equal_brute_force(spark):
    docs = cases.docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i, n in Counter(ids).items():
            want[i, keep, len(ids), i == keep, sha] += 1
            want[i, keep, len(ids), False, sha] += n - 1
    got = Counter(tuple(r) for r in exact_dedup.dedup(docs, *fresh(spark)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == +want


def test_the_index_outlives_a_batch(spark):
    name, path = fresh(spark)
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a\nb"), (2, "new"), (9, "new")], "doc_id long, text string")
    exact_dedup.dedup(first, name, path).collect()
    spark.sql(f"DROP TABLE {name}")  # another session: the files are what lasts
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(second, name, path).collect()}
    assert got == {1: (5, 1, False), 2: (2, 2, True), 9: (2, 2, False)}
    assert [r.doc_id for r in exact_dedup.drop_duplicates(second, *fresh(spark)).orderBy("doc_id").collect()] == [1, 2]


def test_dropping_exact_duplicates_keeps_one_row_of_each_text(spark):
    docs = cases.docs(spark)
    out = exact_dedup.drop_duplicates(docs, *fresh(spark))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({normal(r.text) for r in docs.collect()}) == len({normal(r.text) for r in rows})


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest fingerprint reachable, by trying all pairs."""
    points = np.array(sorted(prints), np.uint64)
    label = np.arange(len(points))
    simhash._merge(label, *np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4))
    return {int(p): int(points[k]) for p, k in zip(points, label)}


@pytest.mark.parametrize("sizes", [{}, {"shard": 3, "task_rows": 40}])
def test_near_duplicates_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    extra = [(1000 + i, cases.prose(300, "base") + f" {cases.prose(int(rng.integers(0, 4)), i)}") for i in range(30)]
    docs = cases.docs(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [print_of(t) for _, t in rows]
    label = linked(set(prints))
    lowest = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            lowest[label[p]] = min(lowest.get(label[p], i), i)
    want = Counter((i, f"{p:016x}", lowest.get(label[p])) for (i, _), p in zip(rows, prints))
    assert len(set(label.values())) < len(label)  # some different fingerprints are linked
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, **sizes).collect()) == want


def test_bk_trees_find_what_brute_force_finds():
    rng = np.random.default_rng(0)
    points = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 15))):
            points.add(int(base) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(0, 6))))))
    points = np.array(sorted(points), np.uint64)
    shard = np.sort(rng.integers(0, 3, len(points)))
    got = set()
    for query, node, distance in simhash.BKForest(points, shard).within(points, simhash.BKForest(points, shard).root, 4):
        assert (np.bitwise_count(points[query] ^ points[node]) == distance).all()
        got |= set(zip(query.tolist(), node.tolist()))
    near = (np.bitwise_count(points[:, None] ^ points[None, :]) <= 4) & (shard[:, None] == shard[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_dropping_near_duplicates_keeps_one_of_each_component(spark):
    docs = cases.docs(spark).dropDuplicates(["text"]).cache()
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    label = linked({print_of(r.text) for r in docs.collect()})
    lowest = {}
    for r in docs.collect():
        known = lowest.setdefault(label[print_of(r.text)], r.doc_id)
        if r.doc_id is not None and (known is None or r.doc_id < known):
            lowest[label[print_of(r.text)]] = r.doc_id
    got = Counter((label[print_of(r.text)], r.doc_id) for r in out.collect())
    assert got == Counter(lowest.items())


def brute_repeats(texts, width=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        yield len(d), int(gone.sum()), len(suffix_dedup._runs(gone)) // 2, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"variants": 3, "task_strings": 40}])
def test_repeated_substrings_equal_brute_force(spark, sizes):
    extra = ["ab" * 400, "b" * 200, "c" * 201, "q" * 3000, cases.SHARED[:200], cases.SHARED[1:201], cases.SHARED * 2,
             cases.prose(30000, "very long")]
    docs = cases.docs(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame([(500 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = docs.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute_repeats([r.text for r in rows])))
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs, **sizes).collect())
    assert got == want


def test_empty_tables(spark):
    none = cases.no_docs(spark)
    assert exact_dedup.dedup(none, *fresh(spark)).count() == 0
    assert exact_dedup.drop_duplicates(none, *fresh(spark)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def slow_passages(texts, width):
    """(n_words, n_removed, sha of the kept words) of each text by definition."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passage_texts():
    """Texts that share stretches, fork and join, repeat inside themselves and go round in circles."""
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    parts = [[r.choice(words) for _ in range(r.randint(3, 40))] for _ in range(25)]
    texts = [" ".join(sum((r.choice(parts) for _ in range(r.randint(1, 12))), [])) for _ in range(150)]
    texts += ["a b " * 60, "a " * 100, "a b " * 59 + "c", "x a b " + "a b c " * 40, " ".join(parts[0]) * 2, "é\u00a0è " * 50]
    texts += [texts[0]] * 40 + [texts[1].replace(" ", "\n\t"), " " + texts[2] + "\x0b", texts[3].upper(), None, "", " \n"]
    return texts


@pytest.mark.parametrize("width, node", [(35, 16), (6, 3), (9, 8), (2, 1), (12, 5)])
def test_passages_equal_brute_force(spark, width, node):
    texts = passage_texts() + cases.texts()
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, sha string, row long, base long, string string").repartition(5)
    got = {r.doc_id: r for r in debruijn.remove_passages(docs, width, node).collect()}
    want = slow_passages(texts, width)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == w, (i, texts[i])
        spans = got[i].spans or []
        assert sum(b - a for a, b in zip(spans[::2], spans[1::2])) == w[1]


def test_passages_of_repeated_rows_and_nulls(spark):
    docs = cases.docs(spark)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, slow_passages([r.text for r in rows], 35)))
    got = Counter(tuple(r) for r in debruijn.remove_passages(docs).drop("spans").collect())
    assert got == want
    assert debruijn.remove_passages(cases.no_docs(spark)).count() == 0


def test_only_asked_texts_and_branching_nodes_travel(spark):
    texts = [f"t{i} " * 40 for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = debruijn.cut(docs.select(*debruijn._keys(debruijn.text_or_empty("text"))), "keys")
    wanted = debruijn._bit_filter(debruijn.cut(keys.limit(20), "few"), "k1")
    assert 20 <= debruijn._packed(docs, "text", wanted).count() < 60
    every = debruijn._bit_filter(keys, "k1")
    assert debruijn._packed(docs, "text", every).count() == 300
    nodes = np.array([r.k1 for r in keys.collect()], np.int64).view(np.uint64)
    place, own = debruijn._nodes_in(every)(nodes, np.arange(300), nodes)
    assert place.tolist() == list(range(300)) and (own.view(np.uint64) == nodes).all()
    none = debruijn._bit_filter(debruijn.cut(keys.filter("false"), "none"), "k1")
    assert debruijn._packed(docs, "text", none).count() == 0 and len(debruijn._nodes_in(none)(nodes, np.arange(300), nodes)[0]) == 0


def test_windows_of_equal_words_have_equal_keys():
    """Wherever texts branch, equal windows are in groups of one key, and different ones are not."""
    rng = np.random.default_rng(3)
    width, node = 7, 3
    texts = [rng.integers(1, 4, rng.integers(7, 60)).astype(np.uint64) for _ in range(200)]
    nodes, seen = [], defaultdict(set)
    for words in texts:
        _, _, place, own = debruijn.nodes_of(words, None, 2, width, node)
        nodes.append((place, own))
        for n, e in zip(*debruijn.edges_at(words, place, own, node)):
            seen[n].add(e)
    keys = defaultdict(set)
    for words, (place, own) in zip(texts, nodes):
        branches = place[[len(seen[n]) > 1 for n in own.view(np.int64)]]
        windows = np.arange(len(words) - width + 1)
        for first, count, k1, k2 in zip(*debruijn.paths_of(
                words, windows, np.zeros(len(windows), bool), place, branches, width, node)):
            for i in range(count):
                keys[tuple(words[first + i:first + i + width])].add((k1, k2, i))
    assert all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(keys)
