import pytest
import random

from pyspark.sql import functions as F

from rowecho.operators import corpus, dictionary
from rowecho.operators.decide import matches_text


def brute(texts, passages):
    return sorted((t, p) for t, text in texts for p, passage in passages if passage and passage in text)


def scan(spark, texts, passages, **options):
    t = spark.createDataFrame(texts, "id string, text string").coalesce(2)
    p = spark.createDataFrame(passages, "passage_id string, passage string").coalesce(2)
    return sorted((r.id, r.passage_id) for r in corpus.scan_passages(t, p, "id", **options).collect())


TEXTS = [
    ("a", "xThat and onesen erblest it hein. End"), ("b", "That  and onesen erblest it hein"),
    ("c", "one two three"), ("d", "prone two threesome"), ("e", "one\ntwo three"), ("f", ""), ("g", "   "),
    ("h", "repeat repeat repeat repeat repeat repeat"), ("i", "é à une œuvre déjà vue ici"),
]
PASSAGES = [
    ("1", "That and onesen erblest it he"), ("2", "one two three"), ("3", "one two"), ("4", "ne tw"), ("5", "tw"),
    ("6", "two three"), ("7", " "), ("8", "  "), ("9", "\n"), ("10", "repeat repeat repeat"), ("11", "une œuvre déjà vu"),
    ("12", "z"), ("13", "e"), ("14", " two "), ("15", "hr"), ("16", "three"), ("17", "absent words of five here"), ("18", ""),
    ("19", "o three"), ("20", "repeat repeat repeat repeat repeat repeat repeat"),
]


def test_passages_equal_contains(spark):
    assert scan(spark, TEXTS, PASSAGES) == brute(TEXTS, PASSAGES)


def test_passages_by_shuffle_join(spark):
    assert scan(spark, TEXTS, PASSAGES, broadcast_bytes=0) == brute(TEXTS, PASSAGES)


def test_wording_of_every_text_is_no_join_key(spark):
    texts = [(f"t{i}", f"x The segment is alike, The number is n{i} and so on") for i in range(300)]
    passages = [(f"p{i}", f"The segment is alike, The number is n{i} and so") for i in range(0, 400, 4)]
    t = spark.createDataFrame(texts, "id string, text string")
    p = spark.createDataFrame(passages, "passage_id string, passage string")
    for size in (0, corpus.BROADCAST_BYTES):
        met = corpus._candidates(t, p, "id", "text", corpus.GRAM, size)
        assert met.count() == 75  # one text for each passage that occurs, none for the others
    assert scan(spark, texts, passages, broadcast_bytes=0) == brute(texts, passages)


def test_random_passages_with_hot_copies(spark):
    rng = random.Random(11)
    vocabulary = ["ab", "a", "ba", "abc", "c", "cab"]
    texts = [(f"t{i}", rng.choice([" ", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    texts += [(f"copy{i}", texts[0][1]) for i in range(40)]
    pieces = set()
    for _ in range(120):
        text = rng.choice(texts)[1]
        start = rng.randrange(len(text))
        pieces.add(text[start:start + rng.randint(1, 25)])
    passages = [(f"p{i}", p) for i, p in enumerate(sorted(pieces))]
    assert scan(spark, texts, passages) == brute(texts, passages)


def test_no_passages(spark):
    assert scan(spark, TEXTS, [("1", "")]) == []


def test_row_texts_count_copies(spark):
    rows = [("The a is 1, The b is x y",), ("The a is 1, The b is x y",), ("The a is 2, The b is z",)]
    texts = [("t", "before The a is 1, The b is x yes"), ("u", "The a is 2, The b is Z")]
    out = corpus.scan_row_texts(spark.createDataFrame(texts, "id string, text string"),
                                spark.createDataFrame(rows, "row_text string"), "id")
    assert [tuple(r) for r in out.collect()] == [("t", "The a is 1, The b is x y", 2)]


def test_word_lists_by_array_and_by_join(spark):
    items = [
        ("known", "alpha", "string", True), ("known", "beta", "string", True), ("known", "7", "other", True),
        ("known", "True", "bool", True),
        ("mixed", "alpha", "string", True), ("mixed", "length (cm)", "string", False), ("mixed", "a.b", "string", False),
        ("mixed", "x_y", "string", False), ("mixed", "two words", "string", False),
    ]
    texts = [("1", "ALPHA beta is true"), ("2", "alphabet"), ("3", "the LENGTH of a_b"), ("4", "x y"), ("5", "two_words X_Y"), ("6", "")]
    t = spark.createDataFrame(texts, "id string, text string").coalesce(2)
    w = spark.createDataFrame(items, "list_name string, value string, kind string, in_lexicon boolean").coalesce(1)
    lists = w.groupBy("list_name").agg(F.collect_list(F.struct("value", "kind", "in_lexicon")).alias("words"))
    columns = ["id", "list_name", "n_found", "n_expected", "passed"]
    short = corpus.scan_words(t, lists, "id")
    want = sorted(tuple(r) for r in short.select(*columns).collect())
    held = [r for r in want if r[2] - (r[1] == "known") > 0]  # "7" is found without being looked for
    assert sorted(tuple(r) for r in corpus.scan_words_long(t, w, "id").select(*columns).collect()) == held
    assert ("1", "known", 4, 4, True) in want and ("2", "known", 2, 4, False) in want
    passed = {(r[0], r[1]) for r in want if r[4]}
    assert {i for i, name in passed if name == "mixed"} == {"3", "4", "5"}
    text = short.filter("id = '3' AND list_name = 'mixed'").select(matches_text(F.col("matches"))).first()[0]
    assert text == "a.b=true;length=true;two words=false;x_y=false"


def test_lexicon_coverage(spark):
    words = spark.createDataFrame(
        [("german credit", "Saving accounts", v, k) for v, k in
         (("nan", "other"), ("little", "string"), ("quite rich", "string"), ("rich", "string"), ("moderate", "string"))],
        "dataset string, feature string, value string, kind string")
    lexicon = spark.createDataFrame([("little",), ("rich",), ("moderate",), ("quite",)], "word string")
    assert [r.value for r in corpus.lexicon_coverage(words, lexicon).collect()] == ["quite rich"]


@pytest.fixture(scope="module")
def coded_words(spark):
    import random

    r = random.Random(3)
    signs = ["a", "b", "ab", "_", ".", " ", "é", "(", ")", "A", "\n", "aab", "b_a", "x.y"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", " ", "a" * 3000]
    values = {"".join(r.choice(signs) for _ in range(r.randint(1, 5))) for _ in range(120)} | {"", " ", "a b", "zzz", "(", "aab (cm)"}
    words = [(f"l{r.randrange(6)}", v, r.choice(["string", "string", "other", "digits"]), r.random() < 0.5) for v in sorted(values)]
    return (spark.createDataFrame(list(enumerate(texts)), "k int, text string"),
            spark.createDataFrame(words, "list_name string, value string, kind string, in_lexicon boolean"))


def test_scans_by_vocabulary_equal_scans_of_texts(spark, coded_words):
    texts, words = coded_words
    coded = dictionary.build_dictionary(texts, "k")
    got = sorted(tuple(r) for r in dictionary.scan_words(coded, words).collect())
    want = sorted(tuple(r) for r in corpus.scan_words_long(texts.filter("text is not null"), words, "k").collect())
    assert got == want and len(got) > 100


def test_numbers_of_words_are_dense_and_sorted(spark, coded_words):
    texts, _ = coded_words
    coded = dictionary.build_dictionary(texts, "k")
    runs = {r.number: r.run for r in coded.runs.collect()}
    assert sorted(runs) == list(range(len(runs))) and len(set(runs.values())) == len(runs)
    whole = {r.k: (r.text or "").lower().split() for r in texts.collect()}
    got = {r.k: r.numbers for r in coded.coded.collect()}
    assert all(n == sorted(n) for n in got.values())
    assert {k: {runs[n] for n in ns} for k, ns in got.items()} == {k: set(w) for k, w in whole.items() if w}


def test_words_meet_runs_on_their_rarest_letters(spark):
    runs = spark.createDataFrame([(i, "abc" + x) for i, x in enumerate(["", "d", "xyz", "xy"])] + [(9, "é")], "number long, run string")
    words = spark.createDataFrame([("abc",), ("abcx",), ("y",), ("é",), ("nope",)], "word string")
    got = {(r.number, r.word) for r in dictionary.match_runs(runs, words).collect()}
    assert got == {(0, "abc"), (1, "abc"), (2, "abc"), (3, "abc"), (2, "abcx"), (3, "abcx"), (2, "y"), (3, "y"), (9, "é")}
    assert dictionary.match_runs(runs, words.limit(0)).count() == 0


def test_what_is_sent_to_all_tasks_is_counted_first(spark):
    """Files of numbered words are small, their rows are not."""
    table = spark.range(2000).select(F.format_string("name#%09d", "id").alias("span"), F.array(F.lit(1)).alias("entries"))
    rows = 2000 * (14 + corpus.ROW_BYTES + corpus.ENTRY_BYTES)
    for limit, sent in ((rows, True), (rows - 1, False)):
        met = spark.range(10).select(F.format_string("name#%09d", "id").alias("span")).join(
            corpus.side(table, corpus.entries_size("span"), limit), "span")
        assert met.count() == 10
        assert ("BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()) is sent


def test_texts_are_cut_once_and_words_travel_as_numbers(spark, coded_words, monkeypatch):
    """One row for each text, whatever forms its words are looked for in; a list's words outside the lexicon decide, if it has any."""
    texts, words = coded_words
    written, sets, cut, made = [], [], corpus.cut_lineage, corpus._sets
    monkeypatch.setattr(corpus, "cut_lineage", lambda df, *a, **b: written.append(cut(df, *a, **b)) or written[-1])
    monkeypatch.setattr(corpus, "_sets", lambda *a: sets.append((a[1], made(*a))) or sets[-1][1])
    corpus.scan_words_long(texts, words, "k").count()
    assert [t.count() for t in written if t.columns == ["k", "spans"]] == [texts.count()]
    (entries, of_text), = sets
    assert entries.schema["entry"].dataType.typeName() == "long" and of_text.schema["entries"].dataType.elementType.typeName() == "long"
    outside = words.filter("kind = 'string' AND NOT in_lexicon")
    deciding = words.join(outside.select("list_name").distinct(), "list_name", "left_anti").unionByName(outside).filter("kind <> 'other'")
    assert entries.select("entry").distinct().count() == deciding.select("list_name", "value").distinct().count()


@pytest.mark.parametrize("known", [True, False])
def test_lists_that_share_words(spark, known):
    texts = spark.createDataFrame([(i, f"w{i % 7} w{i % 5}_x, W{i % 3}.y") for i in range(40)], "k int, text string")
    words = spark.createDataFrame(
        [(f"l{i % 4}", f"w{i % 6}" + ("", "_x", ".y")[i % 3], "string", known or i % 2 == 0) for i in range(60)],
        "list_name string, value string, kind string, in_lexicon boolean").distinct()
    lists = words.groupBy("list_name").agg(F.collect_list(F.struct("value", "kind", "in_lexicon")).alias("words"))
    columns = ["k", "list_name", "n_found", "n_expected", "passed"]
    want = sorted(tuple(r) for r in corpus.scan_words(texts, lists, "k").filter("n_found > 0").select(*columns).collect())
    assert sorted(tuple(r) for r in corpus.scan_words_long(texts, words, "k").select(*columns).collect()) == want and want
    coded = dictionary.build_dictionary(texts, "k")
    assert sorted(tuple(r) for r in dictionary.scan_words(coded, words).select(*columns).collect()) == want


def test_few_words_are_sent_to_the_letters_of_runs(spark):
    runs = spark.range(500).select(F.col("id").alias("number"), F.format_string("run%05d", "id").alias("run"))
    words = spark.createDataFrame([("un00",), ("499",), ("run",)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = dictionary.match_runs(runs, words)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert met.count() == 500 + 1 + 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_that_are_numbered_alike(spark):
    names = spark.range(300).select(F.format_string("name#%09d", "id").alias("value"))
    words = names.select(F.lit("l").alias("list_name"), "value", F.lit("string").alias("kind"), F.lit(False).alias("in_lexicon"))
    texts = names.select(F.col("value").alias("k"), F.concat(F.upper("value"), F.lit(",")).alias("text"))
    found = corpus.entry_sets(texts, words, "k").select("k", F.size("entries").alias("n"))
    assert {r.n for r in found.collect()} == {1} and found.count() == 300
