import random
import uuid

import pytest

from rowecho.operators import corpus
from rowecho.sources.lineage import checkpoint_folder
from rowecho.sources.passage_index import PassageIndex, inner_words, with_anchors
from pyspark.sql import functions as F

rnd = random.Random(5)
WORDS = [f"w{i}" for i in range(30)] + ["é", "a.b", "x_y"]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def fresh(spark, **sizes):
    return PassageIndex(spark, f"{checkpoint_folder(spark)}/index_{uuid.uuid4().hex}", ("key", "string"), **sizes)


def frame(spark, texts):
    return spark.createDataFrame([(f"t{i}", t, i) for i, t in enumerate(texts)], "key string, text string, passage int")


def asked(spark, passages):
    return spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "passage_id int, passage string")


@pytest.fixture(scope="module")
def material():
    texts = [prose(rnd.randint(0, 120)) for _ in range(60)] + ["", None, "  a\n\tb ", "w1 " * 80, "one two"]
    texts += [texts[0], texts[1].upper()]
    passages = {"", "w1 w1 w1", "w1 " * 30, "w", "no such passage of words in any text there is at all, none of it"}
    for t in texts[:60]:
        if len(t) > 20:
            a = rnd.randrange(len(t) - 10)
            passages.add(t[a:a + rnd.randint(1, 300)])  # from inside a word to inside a word
    return texts, sorted(passages)


def slow(texts, passages):
    return {(f"t{i}", k) for i, t in enumerate(texts) for k, p in enumerate(passages) if t and p and p in t}


@pytest.mark.parametrize("sizes", [{}, {"gram": 2, "window": 3, "buckets": 3}, {"gram": 1, "window": 1, "buckets": 2}])
def test_passages_in_batches_equal_contains(spark, material, sizes):
    texts, passages = material
    index, all_texts = fresh(spark, **sizes), frame(spark, texts)
    index.append(all_texts.filter("passage % 2 = 0"), "even")
    index.append(all_texts.filter("passage % 2 = 1"), "odd")
    index.append(all_texts.filter("passage % 2 = 1"), "odd")  # again: replaced
    assert index.batches() == ["even", "odd"]
    found = [tuple(r) for r in index.find(asked(spark, passages), corpus.scan_passages).collect()]
    assert len(found) == len(set(found)) and set(found) == slow(texts, passages)


def test_an_index_outlives_its_session(spark, material):
    texts, passages = material
    index = fresh(spark, buckets=3)
    index.append(frame(spark, texts), "all")
    for name in index._tables():
        spark.sql(f"DROP TABLE {name}")  # files stay
    again = PassageIndex(spark, index.root, ("key", "string"), buckets=3)
    long = [p for p in passages if len(p.split()) > 20]
    assert {r.key for r in again.find(asked(spark, long)).collect()} == {k for k, _ in slow(texts, long)}
    assert again.batches() == ["all"]


def test_short_passages_need_a_way(spark):
    index = fresh(spark, buckets=2)
    with pytest.raises(ValueError, match="too short"):
        index.find(asked(spark, ["a b c"]))
    with pytest.raises(ValueError, match="name of a batch"):
        index.append(frame(spark, ["a"]), "a'b")
    assert index.find(asked(spark, [""])).count() == 0  # an empty index


def test_anchors_are_shared_by_texts_and_their_passages(spark):
    """Every passage of gram + window - 1 whole words has an anchor among its text's; few are kept."""
    words = prose(400).split()
    long = " ".join(words)
    spans = [(i, " ".join(words[i:i + 13])) for i in range(0, 380, 7)]
    df = spark.createDataFrame([(-1, long), *spans], "i int, t string")
    anchors = {r.i: {a.gram for a in r.anchors} for r in with_anchors(df, inner_words(F.col("t"))).collect()}
    assert all(len(a) >= 1 and a <= anchors[-1] for a in anchors.values())
    assert len(anchors[-1]) < 0.35 * len(words)


def test_new_passages_meet_the_anchors_without_a_shuffle_of_these(spark, material):
    texts, passages = material
    index = fresh(spark, buckets=4)
    index.append(frame(spark, texts), "all")
    table = spark.table(index._tables()[1]).select("gram", "key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(1000).select(F.col("id").alias("gram")).repartition(7)
        plan = table.join(wanted, "gram", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("SortMergeJoin"):]
    assert scan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan


def test_anchors_of_all_texts_at_once_are_those_of_each(spark, monkeypatch):
    """Anchors as single texts have them, from Spark's own hashes, also where a batch is worked on in parts."""
    import numpy as np
    from rowecho.sources import passage_index as index
    texts = [prose(n) for n in (0, 1, 10, 11, 12, 200)] + ["w1 " * 50, None, prose(40)]
    words = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("w", F.split("t", r"\s+"))
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    pairs = F.transform("w", lambda w, j: F.xxhash64(F.xxhash64(w), F.xxhash64(F.get("w", j + 1))))
    rows = words.select("i", hashes.alias("h"), pairs.alias("p")).orderBy("i").collect()
    hold = (1 << index.PLACE_BITS) - 1
    for gram, name in ((1, "h"), (2, "p")):
        expected = []
        for r in rows:
            grams = (r[name] or [])[:max(len(r["h"] or []) - gram + 1, 0)]
            marked = [(g & ~hold) | j for j, g in enumerate(grams)]
            lowest = dict.fromkeys(min(marked[j:j + 4]) for j in range(len(marked) - 3))
            expected.append([(grams[m & hold], m & hold) for m in lowest])
        got = {r.i: [tuple(a) for a in r.anchors] for r in with_anchors(words, F.col("w"), gram, 4).collect()}
        assert [got[i] for i in range(len(texts))] == expected
        import pyarrow as pa
        monkeypatch.setattr(index, "WORDS_AT_ONCE", 30)
        parts = index._anchors(pa.array([r["h"] or [] for r in rows], pa.list_(pa.int64())).slice(2), gram, 4).to_pylist()
        assert [[(a["gram"], a["place"]) for a in p] for p in parts] == expected[2:]
        assert index._anchors(pa.array([], pa.list_(pa.int64())), gram, 4).to_pylist() == []
    assert np.int64(0) == index._anchors_of(np.zeros(0, np.int64), np.zeros(1, np.int64), 4, 8)[0].sum()


def test_texts_are_read_once_for_anchors_of_all_lengths(spark, material, monkeypatch):
    texts, passages = material
    read, grams = [], corpus._grams
    monkeypatch.setattr(corpus, "_grams", lambda df, key, tokens, lengths: read.append((key, lengths)) or grams(df, key, tokens, lengths))
    found = {tuple(r) for r in corpus.scan_passages(frame(spark, texts), asked(spark, passages), "key").collect()}
    assert found == slow(texts, passages)
    assert [n for key, n in read if key == "key"] == [[1, 2, 3, 4]]
