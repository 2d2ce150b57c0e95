"""Secrets in texts: fixed patterns, and values in credential contexts that would be hard to guess.

The cost of guessing a value is that of its cheapest segmentation into common words, dates,
repeats, keyboard walks and brute force; a dynamic programme over the value finds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, table, text_or_empty

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE, ACCESS, HEX = 6, re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: what stands before a value whose guess cost is asked; of bounded length, so every text is searched in linear time
KEY = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|"""
    r"""(?:api|access|private|auth|signing)[_-]?key|auth|bearer|login)["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}""")
#: parts of a name before the key, back to where its run of letters, digits and ``_`` begins
NAME = re.compile(r"(?ai:(?:[a-z0-9]+_)*)")
NAME_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
VALUE = re.compile(r"""["']([^"'\r\n]+)["']|([^\s"']+)""")
#: decimal digits of guesses from which a value counts as a secret
LEAST_COST = 10.0
#: ordinary words, also joined by signs: their letters are not drawn from an alphabet
PLAIN = re.compile(r"[A-Za-z _./'&,()-]*")
#: values up to this length are kept with their cost; longer ones are computed each time
CACHED_CHARS = 100
#: characters to draw from and how many they are
ALPHABETS = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[^a-zA-Z0-9]"), 33))

# fixed values: frequent passwords and words in them, the most used first
COMMON = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 "
    "football monkey letmein shadow master 696969 michael mustang 666666 qwertyuiop 123321 1234567890 "
    "superman 654321 1qaz2wsx 7777777 qazwsx jordan jennifer 121212 trustno1 hunter buster soccer harley "
    "batman andrew tigger sunshine iloveyou charlie robert thomas hockey ranger daniel starwars 112233 "
    "george computer michelle jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom 777777 pass maggie "
    "159753 aaaaaa ginger princess joshua cheese amanda summer love ashley 6969 nicole chelsea matthew "
    "access yankees 987654321 dallas austin thunder taylor matrix welcome admin root guest user test demo "
    "example sample secret changeme default login hello none null true false empty required optional value "
    "string your my the key token placeholder xxxx winter spring autumn monday friday january december"
).split()
WORD_RANK = {word: rank for rank, word in enumerate(COMMON, 1)}
LONGEST_WORD = max(map(len, COMMON))
LEET = str.maketrans("@4310$5!7", "aaeiossit")  # read as letters
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))

KEY_AT = {key: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, key in enumerate(row)}
LATEST_YEAR = 2050
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|"
    r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _word_costs(value: str, end: int) -> list[tuple[int, float]]:
    """Common words that end before ``end``: (start, digits of guesses)."""
    found = []
    for start in range(max(0, end - LONGEST_WORD), end - 2):
        piece = value[start:end]
        low = piece.lower()
        rank = WORD_RANK.get(low)
        extra = 0.0
        if rank is None and (rank := WORD_RANK.get(low.translate(LEET))) is not None:
            extra = 0.6
        if rank is None and (rank := WORD_RANK.get(low[::-1])) is not None:
            extra = 0.3
        if rank is not None:
            case = 0.0 if piece == low else 0.3 if piece == low.capitalize() or piece == piece.upper() else 1.0
            found.append((start, math.log10(rank + 1) + extra + case))
    return found


def _steps(a: str, b: str) -> tuple[tuple | None, int | None]:
    """How one key leads to the next: the way to a neighbour on the keyboard, and the step in
    character order; None where it does not."""
    a, b = SHIFTED.get(a, a.lower()), SHIFTED.get(b, b.lower())
    near = order = None
    if a in KEY_AT and b in KEY_AT:
        dx, dy = KEY_AT[b][0] - KEY_AT[a][0], KEY_AT[b][1] - KEY_AT[a][1]
        near = (dx, dy) if abs(dx) <= 1 and abs(dy) <= 1 and (dx or dy) else None
    if a.isalnum() and b.isalnum() and abs(ord(b) - ord(a)) == 1:
        order = ord(b) - ord(a)
    return near, order


def guess_cost(value: str, digits: float = 1.0) -> float:
    """Decimal digits of the guesses the cheapest segmentation of ``value`` needs. Each further
    segment costs one digit; a character by brute force costs ``digits``. The empty value costs 0."""
    return (_kept_cost if len(value) <= CACHED_CHARS else _cheapest)(value, digits)


def _cheapest(value: str, digits: float) -> float:
    n = len(value)
    best = [0.0] + [math.inf] * n
    brute = 0.0  # cheapest start of a brute-force span: its cost less that of the characters before it
    starts_at: dict[int, float] = {}
    for match in DATE.finditer(value):
        years = 365 if len(match.group()) > 4 else 1
        starts_at[match.end()] = (match.start(), math.log10(max(20, LATEST_YEAR - 1950) * years))
    walk, turns, way = 0, 0, None  # where the walk over the keys that reaches here starts
    series, direction = 0, None  # the same for characters in order
    period_run = [0] * 5  # how far value repeats itself with period p
    for end in range(1, n + 1):
        at = end - 1
        cost = min(best[end], brute + digits * end)
        near, order = _steps(value[at - 1], value[at]) if at else (None, None)
        if near is None:
            walk, turns = at, 0
        elif near != way:
            turns += 1
        way = near
        if order is None or order != direction:
            series = at if order is None else at - 1
        direction = order
        if end - walk >= 3:
            cost = min(cost, best[walk] + (walk > 0) + math.log10(47 * (end - walk)) + 0.7 * turns)
        if end - series >= 3:
            cost = min(cost, best[series] + (series > 0) + math.log10(62 * (end - series)))
        for period in range(1, 5):
            period_run[period] = period_run[period] + 1 if at >= period and value[at] == value[at - period] else 0
            run = period_run[period]
            if run >= max(2, period):
                start = end - run - period
                cost = min(cost, best[start] + (start > 0) + period + math.log10(run / period + 1))
        for start, own in _word_costs(value, end):
            cost = min(cost, best[start] + (start > 0) + own)
        if end in starts_at:
            start, own = starts_at[end]
            cost = min(cost, best[start] + (start > 0) + own)
        best[end] = cost
        brute = min(brute, cost + 1 - digits * end)
    return best[n]


_kept_cost = lru_cache(50_000)(_cheapest)


def drawn_cost(value: str) -> float:
    """The guess cost with characters by brute force drawn from the alphabets that the value uses,
    but at one digit each where it is made of ordinary words."""
    size = sum(n for signs, n in ALPHABETS if signs.search(value))
    return guess_cost(value, 1.0 if size <= 10 or PLAIN.fullmatch(value) else math.log10(size))


def _values(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) in credential contexts, each after the end of the one before."""
    at = 0
    while key := KEY.search(text, at):
        begin = key.start()
        while begin and text[begin - 1] in NAME_SIGNS:
            begin -= 1
        value = NAME.fullmatch(text, begin, key.start()) and VALUE.match(text, key.end())
        if value:
            group = 1 if value.group(1) is not None else 2
            yield value.start(group), value.group(group)
        at = value.end() if value else key.start() + 1


def find_secrets(text: str, least_cost: float = LEAST_COST) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost) in code points, by start and then kind. The cost is that of the
    value for assign and guess, that of the match otherwise."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                found.append((0, m.start(), m.end(), guess_cost(m.group(2))))
        for start, whole in _values(text):
            value = whole.rstrip(".,;:)]}>") or whole
            if (cost := drawn_cost(value)) >= least_cost:
                found.append((3, start, start + len(value), cost))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), guess_cost(m.group())) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), guess_cost(m.group())) for m in HEX.finditer(text)]
    return [(KINDS[k], start, end, cost) for k, start, end, cost in sorted(found, key=lambda s: (s[1], s[0], s[2]))]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         least_cost: float = LEAST_COST) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, cost), of every whole text.

    Null and empty texts have no spans. Rows repeated with their id give a row each; columns other
    than the two are not read."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in find_secrets(t, least_cost)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,cost:double>>")


def redact(text: str, least_cost: float = LEAST_COST, by: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced."""
    out, at = [], 0
    for _, start, end, _ in find_secrets(text, least_cost):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join(out) + text[at:]


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        count("guess"))
