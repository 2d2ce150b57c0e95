"""Tables with everything that may go wrong in them."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string, "
        "digest string, words string, rejected boolean, label int, anchor string")
PAGES = "page_id long, url string, html string, text string, host string, `to` string"

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abdeghinorstué") for _ in range(rnd.randint(1, 8))) for _ in range(400)]


def prose(n: int, seed) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SHARED = prose(70, "shared")
BENCHMARK = [
    (1, prose(30, "item1")), (2, prose(14, "item2").upper()), (2, prose(14, "item2").upper()),
    (3, "only three words"), (4, ""), (5, None), (None, prose(12, "nameless")), (6, prose(30, "item1") + " more words"),
]


def texts() -> list:
    own = [prose(rnd.randint(1, 80), i) for i in range(40)]
    out = [None, "", " ", "\n\t", "a", "...", "x" * 5000, "é" * 300, prose(6000, "long"), "ends here\x0b ", "Tab\tand  blanks"]
    out += [own[0]] * 5 + [own[1], own[1].replace(" ", "\n"), own[1].upper()]
    out += [own[i] + " " + SHARED + " " + own[i + 1] for i in range(2, 12)]
    out += [own[i] + " " + BENCHMARK[i % 2][1] + ". " + own[i + 1] for i in range(12, 16)]
    out += ["here are Only, three WORDS!", prose(12, "nameless"), *own[20:]]
    out += [prose(60, "near") + f" end{i}" for i in range(6)]
    return out


def docs(spark):
    """Documents with nulls, ties, repeated rows and columns named like those operators use."""
    rows = [(i, t, None if i % 7 == 0 else "ab"[i % 2], None, None, 0.5, True, "f", None, "w", None, 1, "x")
            for i, t in enumerate(texts())]
    repeated = rows[30]
    rows += [repeated, repeated, (None, "no id at all", *rows[0][2:]), (None, rows[31][1], *rows[0][2:]),
             (3, "another text under an id that is taken", *rows[0][2:])]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")
