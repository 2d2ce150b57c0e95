"""Recorded cases: output, expected answer, matches and decision."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowecho.functions import answers
from rowecho.operators import decide as D, score
from tests.helpers import cells, joined, words

IN, OUT = True, False


def verdict(df, **options):
    row = D.decide(df, **options).first()
    matches = {m.name: m.found for m in row.matches} if row.matches is not None else None
    return row.passed, matches


def passes(frames):
    """(passed, matches) of many cases in one job."""
    frames = [f.withColumn("probe_id", F.format_string("%04d", F.lit(i))) for i, f in enumerate(frames)]
    rows = D.decide(reduce(DataFrame.unionByName, frames)).orderBy("probe_id").collect()
    return [(r.passed, {m.name: m.found for m in r.matches} if r.matches is not None else None) for r in rows]


def strings(known, *values):
    return words(*[(v, "string", known) for v in values])


def test_all_in_lexicon_needs_all(spark):
    names = ["Right", "No", "Left", "Extensive", "Bilateral", "Posterior"]
    assert verdict(joined(spark, "['yes', 'no']", D.WORDS, strings(IN, *names))) == (
        False, {n: n == "No" for n in names})


def test_outside_lexicon_decides(spark):
    expected = words(("Indeterminate", "string", IN), ("Excellent", "string", IN),
                     ("Structural Incomplete", "string", OUT), ("Biochemical Incomplete", "string", OUT))
    assert verdict(joined(spark, "['hyperthyroid', 'hypothyroid']", D.WORDS, expected)) == (
        False, {"Structural Incomplete": False, "Biochemical Incomplete": False})
    expected = words(("Question ID", "string", OUT), ("Type of Answer", "string", OUT), ("Keywords", "string", IN))
    output = "[Question ID, Question Text, Correct Answer, Student Response, Score, Time Spent]"
    assert verdict(joined(spark, output, D.WORDS, expected)) == (True, {"Question ID": True, "Type of Answer": False})


def test_single_known_word(spark):
    assert verdict(joined(spark, "['Advanced', 'Intermediate', 'Basic']", D.WORDS, strings(IN, "Basic"))) == (
        True, {"Basic": True})


def test_topics(spark):
    one_word = ["Differentiation", "Statistics", "Optimization", "Integration"]
    more = ["Numerical Methods", "Complex Numbers", "Graph Theory", "Analytic Geometry", "Probability ",
            "Differential Equations", "Set Theory"]
    expected = words(*[(w, "string", IN) for w in one_word], *[(w, "string", OUT) for w in more])
    output = "['Number Theory', 'Differential Equations', 'Probability', 'Statistics', 'Graph Theory']"
    assert verdict(joined(spark, output, D.WORDS, expected)) == (
        True, {w: w in ("Graph Theory", "Differential Equations") for w in more})


UNDERSCORES = [
    ("sepal_length, petal", "sepal length (cm)", True), ("SEPAL LENGTH", "sepal length (cm)", True),
    ("education_num", "education.num", True), ("median income", "median_income", True),
    ("median_income", "median_income", True), ("medianincome", "median_income", False),
    ("anything", "(cm)", False), ("the (cm) unit", "(cm)", True),
]


def test_underscores_and_brackets(spark):
    got = passes([joined(spark, output, D.WORDS, strings(OUT, word)) for output, word, _ in UNDERSCORES])
    assert [p for p, _ in got] == [found for _, _, found in UNDERSCORES]


def test_values_that_are_not_text(spark):
    expected = words(("True", "bool", IN), ("False", "bool", IN), ("nan", "other", IN))
    assert verdict(joined(spark, "true or false", D.WORDS, expected)) == (True, {"True": True, "False": True})
    assert verdict(joined(spark, "true", D.WORDS, expected)) == (False, {"True": True, "False": False})
    assert verdict(joined(spark, "", D.WORDS, words(("3", "other", IN), ("nan", "other", IN)))) == (True, {})
    assert verdict(joined(spark, "x", D.WORDS, words())) == (True, {})


def test_case_sensitive_names(spark):
    names = strings(OUT, "MathE")
    assert verdict(joined(spark, "mathematics", D.NAMES, names))[0] is True
    assert verdict(joined(spark, "mathematics", D.NAMES, names, case_sensitive=True))[0] is False


def test_recognition_by_either_name(spark):
    names = strings(OUT, "thyroid disease recurrence", "thyroid_diff")
    assert verdict(joined(spark, "Thyroid Cancer Dataset", D.NAMES, names))[0] is False
    assert verdict(joined(spark, "the thyroid diff data", D.NAMES, names))[0] is True


STAGE = [("Stage", "I", None), ("Response", "Excellent", None), ("Recurred", "No", None)]


ROWS = [
    (", The Stage is III, The Response is Structural Incomplete, The Recurred is Yes", STAGE, (0, 0, 0)),
    (", The Stage is I, The Response is Excellent, The Recurred is No", STAGE, (1, 1, 1)),
    (", The Stage is I, The Response is Excellent, The Recurred is No",
     [("Stage", "I", None), ("Response", "Indeterminate", None), ("Recurred", "No", None)], (1, 0, 1)),
    (", The Topic is Calculus, The Subtopic is Differentiation, The Keywords is Derivative, Chain rule, Product rule",
     [("Topic", "Differentiation", None), ("Subtopic", "Partial Differentiation", None),
      ("Keywords", "First order,Gradient", None)], (1, 0, 0)),
    ("256", [("a", "256", "256")], (1,)), (" +2_56 ", [("a", "256", "256")], (1,)),
    ("256", [("a", "256", None)], (0,)), ("1", [("a", "True", "1")], (1,)),
    ("is 256!", [("a", "256", "256")], (1,)), ("256.0", [("a", "256", "256")], (0,)),
    ("excellent", [("a", "Excellent", None)], (0,)), ("1" * 45, [("a", "1", "1")], (0,)),
    ("first line\nNo", [("a", "No", None)], (0,)),
]


def test_row_completion(spark):
    got = passes([joined(spark, o, D.ROW, cells(*e), test="feature_completion") for o, e, _ in ROWS])
    assert [tuple(int(v) for v in matches.values()) for _, matches in got] == [found for _, _, found in ROWS]
    assert [passed for passed, _ in got] == [all(found) for _, _, found in ROWS]


def test_whole_output_when_rows_are_split_by_newlines(spark):
    df = joined(spark, "first line\nNo", D.ROW, cells(("a", "No", None)), test="feature_completion", features_sep="\n")
    # the value stands behind a newline, which is trimmed off the token only at its ends
    assert verdict(df)[0] is False
    df = joined(spark, "first\n No", D.ROW, cells(("a", "No", None)), test="feature_completion", features_sep="\n")
    assert verdict(df)[0] is True


def test_full_completion_line(spark):
    expected = cells(("a", "x", None))
    long_line = "The a is x indeed"
    cases = ((f"Next examples:\n{long_line}", True), (f"Next examples: {long_line}\nmore", True),
             ("no marker", False), ("Next examples:", False))
    got = passes([joined(spark, o, D.ROW, expected, test="full_completion", echoes=True) for o, _ in cases])
    assert [p for p, _ in got] == [passed for _, passed in cases]


CLASSES = [
    ("0", "No", "yes_no", True), ("0.0", "No", "yes_no", True), ("", "No", "yes_no", False),
    (".0", "No", "yes_no", True), ("Yes", "Yes", "yes_no", True), ("No, Yes", "Yes", "yes_no", False),
    ("  <b>yes</b>\n", "Yes", "yes_no", True), ("Setosa", "setosa", "class_name", True),
    ("It is versicolor", "versicolor", "class_name", True), ("0", "class_0", "class_digit", True),
    ("1", "class_0", "class_digit", False), ("Yes", None, "yes_no", False),
]


def test_classification(spark):
    got = passes([joined(spark, a, rule, label=label, test="classification_0shot") for a, label, rule, _ in CLASSES])
    assert [p for p, _ in got] == [passed for _, _, _, passed in CLASSES]


def test_accuracy_of_recorded_answers(spark):
    outputs = ["0"] * 86 + ["0.0"] * 8 + [""] * 5 + [".0"]
    labels = ["No"] * 79 + ["Yes"] * 15 + ["No"] * 5 + ["Yes"]
    rows = spark.createDataFrame(list(zip(outputs, labels)), "answer string, label string")
    passed = answers.classification_passed(F.col("answer"), F.col("label"), F.lit("yes_no"))
    verdicts = rows.select(F.lit("m").alias("model"), F.lit("classification_0shot").alias("test"),
                           F.lit("d").alias("dataset"), F.lit("yes_no").alias("rule"), "answer", passed.alias("passed"))
    assert score.accuracy(verdicts).first().accuracy == 79.0
    assert {r.answer: r.n for r in score.answer_histogram(verdicts).collect()} == {"0": 86, "0.0": 8, "": 5, ".0": 1}


def test_membership(spark):
    cases = [("Yes", "Yes", True), ("No", "No", True), ("Yes and No", "Yes", False), ("yes", "Yes", False),
             ("", "No", False)]
    got = passes([joined(spark, a, D.MEMBER, label=label, test="membership") for a, label, _ in cases])
    assert [p for p, _ in got] == [passed for _, _, passed in cases]


def test_membership_tally(spark):
    rows = [("Yes",)] * 82 + [("No",)] * 17 + [("No Yes",)]
    verdicts = spark.createDataFrame(rows, "answer string").select(
        F.lit("m").alias("model"), F.lit("d").alias("dataset"), "answer", (F.col("answer") == "Yes").alias("passed"))
    row = score.membership_tally(verdicts).first()
    assert (row.score, row.n_yes, row.n_no, row.n_tests) == (82, 83, 17, 100)


def test_pass_rate_below_threshold(spark):
    rows = [("m", "incomplete_completion_random", "d", p) for p in (False, False, True, True, False)]
    verdicts = spark.createDataFrame(rows, "model string, test string, dataset string, passed boolean")
    row = score.pass_rate(verdicts).first()
    assert (row.rate, row.passed) == (0.4, False)
    assert score.scorecard(verdicts).first().value == 0.0


def test_echoed_prompts(spark):
    expected = cells(("a", "X", None))
    got = passes([joined(spark, o, D.ROW, expected, test="feature_completion", echoes=True)
                  for o in ("PROMPT: X", "PROMPT:X", "X")])
    assert [p for p, _ in got] == [True, True, True]
    df = joined(spark, "X", D.ROW, expected, test="feature_completion", echoes=True)
    assert verdict(df, parity=True)[0] is False  # by length the answer is cut away


def test_missing_response_fails(spark):
    probe = joined(spark, "", D.MEMBER, label="Yes", test="membership").drop("model", "output", "echoes")
    none = spark.createDataFrame([], "probe_id string, model string, output string")
    out = D.decide(D.join_responses(probe, none, ["a", "b"])).collect()
    assert sorted((r.model, r.passed) for r in out) == [("a", False), ("b", False)]


def test_every_probe_meets_its_responses_once(spark):
    probes = spark.createDataFrame([("p", "ask p"), ("q", "ask q"), (None, "ask none")], "probe_id string, prompt string")
    said = spark.createDataFrame(
        [("p", "a", "two"), ("p", "a", "one"), ("p", "b", None), ("q", "c", "x"), ("r", "a", "x"), (None, "a", "x")],
        "probe_id string, model string, output string")
    want = [(p, m, f"ask {p or 'none'}", {("p", "a"): "one"}.get((p, m), ""), m == "b") for p in (None, "p", "q") for m in "ab"]
    for partitions in (None, 3):
        joined_ = D.join_responses(probes, said, ["a", "b"], ["b"], partitions)
        assert sorted((tuple(r) for r in joined_.collect()), key=str) == sorted(want, key=str)
        plan = joined_._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Join")  # models come apart after the join


def test_long_lists_decide_like_arrays(spark):
    lists = {"f": [("alpha", "string", IN), ("beta gamma", "string", OUT), ("x_y", "string", OUT)],
             "g": [("alpha", "string", IN), ("true", "bool", IN), ("7", "other", IN)]}
    outputs = ["ALPHA true", "beta_gamma", "x y", "", "alpha"]
    rows = [(f"{f}{i}", "m", f, o) for f in lists for i, o in enumerate(outputs)] + [("none", "m", "wordless", "alpha")]
    asked = spark.createDataFrame(rows, "probe_id string, model string, feature string, answer string")
    table = spark.createDataFrame(
        [("d", f, *w) for f, ws in lists.items() for w in ws],
        "dataset string, feature string, value string, kind string, in_lexicon boolean")
    long = D.decide_words_long(asked.withColumn("dataset", F.lit("d")), table)
    got = {r.probe_id: (r.passed, r.n_found) for r in long.collect()}
    want = {}
    for f, ws in lists.items():
        for i, o in enumerate(outputs):
            row = D.decide(joined(spark, o, D.WORDS, words(*ws))).first()
            want[f"{f}{i}"] = (row.passed, row.n_found)
    assert got == want | {"none": (True, 0)}


def test_prompt_hook(spark):
    probes = spark.createDataFrame([("p", "hello world", 5, 0.0)],
                                   "probe_id string, prompt string, max_new_tokens int, temperature double")
    out = D.score_prompts(probes, "m", lambda prompts, budgets, temps: [p[:b] for p, b in zip(prompts, budgets)])
    assert out.collect() == [("p", "m", "hello")]


def test_dealt_probes_meet_their_responses_without_a_shuffle(spark, sf_dir):
    """Probes whose rows are dealt out by their ids give the verdicts of others, in buckets or not."""
    from dataclasses import replace
    from checks import queries as Q
    from checks.datasets import dataset
    from rowecho.plans import probes as P
    ds = dataset(spark, sf_dir, "customer")
    ds = replace(ds, df=ds.df.unionByName(ds.df.filter("_pos < 3").withColumn("c_acctbal", F.lit(1.0))))  # positions that come twice

    def probes(of):
        every = of.df.select(F.col("_pos").alias("trial"))
        return Q.union([P.completion_incomplete(of, every), P.completion_feature(of, "c_name", None), P.recognition(of, 5, "all"),
                        P.recognition(of, 5, "all", variants=Q.VARIANTS).filter("serialization > 0"), P.classification(of, None)])

    verdicts = lambda df: sorted(map(str, Q.show_verdicts(df).collect()))
    out = Q.decided(probes(replace(ds, probe_partitions=3)), 3)
    assert verdicts(out) == verdicts(Q.decided(probes(ds)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_an_echo_is_skipped_by_its_bytes(spark):
    """Also one that was cut inside a character, which took the answer's first characters along."""
    prompts = ["ab", "ab ", "é\U0001f600 ", "", "ab\\xF0\\x9F"]
    rows = []
    for prompt in prompts:
        told = prompt.encode("utf-8").replace(b"\\xF0\\x9F", b"\xf0\x9f")
        rows += [(told, told + b"Yes 1"), (told, told.rstrip(b" ") + b"No"), (told, b"other"), (told, told), (told, b"")]
    frame = spark.createDataFrame(rows, "p binary, o binary").select(F.col("p").cast("string"), F.col("o").cast("string"), "p", "o").toDF(
        "prompt", "output", "p", "o")
    cut = frame.select("p", "o", answers.crop_echo(F.col("output"), F.col("prompt"), F.lit(True)).cast("binary").alias("cut")).collect()
    for r in cut:
        p, o = bytes(r.p), bytes(r.o)
        left = o[len(p):] if o.startswith(p) else o[len(p.rstrip(b" ")):] if o.startswith(p.rstrip(b" ")) else o
        assert bytes(r.cut) == left, (p, o)
