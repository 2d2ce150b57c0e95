"""SQL each registered query is compared with, written for DuckDB.

Deliberately another way to the same answer: words are unnested and grouped where the library
uses arrays, containment is a plain nested loop, positions come from the key columns.
"""

from __future__ import annotations

import re

from checks.datasets import MEDIAN_BALANCE
from rowecho.functions.text import SERIALIZATIONS
from rowecho.plans import templates

COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
TYPES = {
    "customer": ["bigint", "string", "int", "double", "string"],
    "part": ["bigint", "string", "string", "string", "int", "double"],
    "orders": ["bigint", "bigint", "string", "double", "timestamp", "string"],
    "supplier": ["bigint", "string", "int", "double"],
    "lineitem": ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string",
                 "string", "timestamp"],
}
NAMES = {"customer": "customer accounts", "part": "part catalog", "orders": "customer orders",
         "supplier": "supplier accounts", "lineitem": "line items"}
IDS = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "supplier": []}
VALUE_FEATURES = {"customer": ["c_mktsegment", "c_nationkey"], "part": ["p_type", "p_brand"],
                  "orders": ["o_orderstatus", "o_orderpriority"]}
COMPLETION = {"customer": "c_name", "part": "p_retailprice", "orders": "o_totalprice"}
DATASETS = ("customer", "part", "orders")
MODELS = ("alpha", "beta")
DISPLAY = {"customer accounts": "Customer", "part catalog": "Part", "customer orders": "Orders"}
TASKS = {
    "customer": ("c_mktsegment", "class_name", "the name of the market segment",
                 "Which market segment is this customer in?"),
    "orders": ("o_orderstatus", "yes_no", '"Yes" or "No"', "Is this order finished? Yes or no?"),
    "supplier": ("s_acctbal", "yes_no", '"Yes" or "No"',
                 "Is the balance of this supplier high? Yes or no?"),
}


def key(t: str) -> str:
    return COLUMNS[t][0]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kind(t: str, column: str) -> str:
    return "string" if TYPES[t][COLUMNS[t].index(column)] == "string" else "other"


def txt(column: str) -> str:
    return f"coalesce(cast({column} as varchar), 'nan')"


def draw_key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"cast({p} as varchar)" for p in parts) + "))"


def draw_int(*parts: str) -> str:
    return f"cast('0x' || left({draw_key(*parts)}, 15) as bigint)"


def row(t: str, sep=", ", vsep=" is ", spec="The ", ignored=(), names=None, keep_last=False, prefix="") -> str:
    cols = [c for c in COLUMNS[t] if c not in ignored]
    parts = []
    for i, c in enumerate(cols):
        parts.append(lit(f"{spec}{(names or {}).get(c, c)}{vsep}"))
        parts.append(txt(prefix + c))
        if keep_last or i < len(cols) - 1:
            parts.append(lit(sep))
    return "(" + " || ".join(parts) + ")"


def fill(template: str, **slots: str) -> str:
    out = lit(template)
    for name, value in slots.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def probe_id(test: str, t: str, feature: str = "''", trial: str = "0", serialization: str = "0") -> str:
    return f"md5(concat_ws('|', {lit(test)}, {lit(NAMES[t])}, {feature}, cast({trial} as varchar), cast({serialization} as varchar)))"


def probe(test: str, t: str, prompt: str, *, source: str, feature="''", trial="0", serialization="0",
          label="cast(null as varchar)", expected="cast(null as varchar)") -> str:
    return f"""select {probe_id(test, t, feature, trial, serialization)} as probe_id, {lit(test)} as test,
      {lit(NAMES[t])} as dataset, {feature} as feature, cast({trial} as bigint) as trial,
      cast({serialization} as bigint) as serialization, {prompt} as prompt, {label} as label,
      {expected} as expected, cast({templates.MAX_NEW_TOKENS[test]} as bigint) as max_new_tokens
      from {source}"""


def union(parts) -> str:
    return "\nunion all\n".join(parts)


# ---------------------------------------------------------------- shared tables

LEXICON = """lexicon as (
  select distinct w as word from (
    select unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as w from documents where lang = 'en')
  where w <> '' and w not in ('blue-collar', 'admin.', 'self-employed'))"""


def in_lexicon(value: str, kind_: str = "'string'") -> str:
    return f"({kind_} <> 'string' or lower({value}) in (select word from lexicon) or regexp_matches({value}, '^[A-Za-z]$'))"


def features(t: str) -> str:
    parts = []
    for i, (c, dt) in enumerate(zip(COLUMNS[t], TYPES[t])):
        parts.append(f"""select {lit(NAMES[t])} as dataset, '{c}' as feature, cast({i} as bigint) as feature_pos,
          '{dt.replace('timestamp', 'timestamp_ntz')}' as dtype, count(distinct {c}) + cast(bool_or({c} is null) as bigint) as n_distinct,
          bool_or({c} is null) as has_null, count(*) as n_rows from {t}""")
    return union(parts)


def values(t: str, cols=None) -> str:
    return union(f"""select {lit(NAMES[t])} as dataset, '{c}' as feature, {txt(c)} as value, '{kind(t, c)}' as kind,
      min({key(t)}) as first_pos, count(*) as n, round(count(*) * 100.0 / (select count(*) from {t}), 6) as pct
      from {t} group by {txt(c)}""" for c in (cols or VALUE_FEATURES[t]))


# ---------------------------------------------------------------- altered rows

def replace_ctes(p: str, t: str, cols: list[str], k: int, seed: str, rows: str, tries: int, first: int = 0) -> str:
    """CTEs ending in {p}_done(_pos, f, v): altered cells in long form, the first try from ``first`` on whose row
    is not in the table."""
    cells = union(f"select {key(t)} as _pos, '{c}' as f, {txt(c)} as v from {t}" for c in cols)
    order = "case f " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(cols)) + " end"
    as_row = f"string_agg(f || '=' || v, chr(31) order by {order})"
    return f"""{p}_cells as materialized ({cells}),
    {p}_vals as materialized (select f, v, count(*) as n, coalesce(sum(count(*)) over (
      partition by f order by md5(v), v rows between unbounded preceding and 1 preceding), 0) as off from {p}_cells group by f, v),
    {p}_rows as materialized (select {as_row} as r from {p}_cells group by _pos),
    {p}_asked as materialized (
      select c.*, t.t, row_number() over (partition by _pos, t.t order by {draw_key(seed, '_pos', 'f')}) <= {k} as chosen
      from {p}_cells c cross join (select unnest(range({first}, {tries})) as t) t where _pos in ({rows})),
    {p}_donor as materialized (
      select c._pos, c.t, c.f, c.v, d.v as first, o.n as n_own, o.off as off_own,
        {draw_int(seed, 'c._pos', 'c.f', 'c.t', "'other'")} % (n.n - o.n) as u
      from {p}_asked c cross join (select count(*) as n from {t}) n
      join {p}_cells d on d.f = c.f and d._pos = {draw_int(seed, 'c._pos', 'c.f', 'c.t')} % n.n
      join {p}_vals o on o.f = c.f and o.v = c.v
      where c.chosen),
    {p}_drawn as materialized (
      select _pos, t, f, first as v from {p}_donor where first <> v or t > 0
      union all
      select c._pos, c.t, c.f, w.v from {p}_donor c join {p}_vals w on w.f = c.f
        and c.u + (case when c.u < c.off_own then 0 else c.n_own end) between w.off and w.off + w.n - 1
      where c.first = c.v and c.t = 0),
    {p}_new as materialized (
      select c._pos, c.t, c.f, case when c.chosen then d.v else c.v end as v
      from {p}_asked c left join {p}_drawn d on c._pos = d._pos and c.t = d.t and c.f = d.f),
    {p}_first as materialized (select _pos, min(t) as t from (
      select _pos, t from (select _pos, t, {as_row} as r from {p}_new group by _pos, t) anti join {p}_rows using (r)) group by _pos),
    {p}_done as materialized (select _pos, f, v from {p}_new join {p}_first using (_pos, t))"""


def long_row(p: str, t: str, alias: str) -> str:
    """Row text of altered cells in long form."""
    order = "case f " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(COLUMNS[t])) + " end"
    return f"{p}_text as (select _pos, string_agg('The ' || f || ' is ' || v, ', ' order by {order}) as {alias} from {p}_done group by _pos)"


# ---------------------------------------------------------------- probes

def description() -> str:
    return union(probe("dataset_desc", t, fill(templates.DATASET_DESCRIPTION, dname=lit(NAMES[t])),
                       source=f"(select count(*) as n from {t})",
                       label=f"'(' || cast(n as varchar) || ', {len(COLUMNS[t])})'") for t in DATASETS)


def features_uninformed() -> str:
    return union(probe("features_list_uninf", t, fill(templates.FEATURES_UNINFORMED, dname=lit(NAMES[t])),
                       source="(select 1)",
                       expected=lit("|".join(c for c in COLUMNS[t] if c not in IDS[t]))) for t in DATASETS)


def picked(k: int, trials: int = 3) -> str:
    return f"""picked as (select * from (
      select f.dataset, t.trial, f.feature, f.feature_pos, f.n_rows,
        row_number() over (partition by f.dataset, t.trial order by {draw_key('0', 'f.dataset', 't.trial', 'f.feature')}) as draw_rank,
        count(*) over (partition by f.dataset, t.trial) as n
      from features f cross join (select unnest(range({trials})) as trial) t)
      where draw_rank <= least({k}, n - 2))"""


def features_informed(k: int = 3) -> str:
    parts = []
    for t in DATASETS:
        ids = ", ".join(lit(c) for c in IDS[t])
        parts.append(probe(
            "features_list_inf", t,
            fill(templates.FEATURES_INFORMED, dname=lit(NAMES[t]), fname="g"),
            source=f"""(select p.trial, '[' || string_agg(p.feature, ', ' order by p.draw_rank) || ']' as g,
              (select string_agg(f.feature, '|' order by f.feature_pos) from features f
               where f.dataset = {lit(NAMES[t])} and f.feature not in ({ids}) and f.feature not in
                 (select q.feature from picked q where q.dataset = {lit(NAMES[t])} and q.trial = p.trial)) as e
              from picked p where p.dataset = {lit(NAMES[t])} group by p.trial)""",
            trial="trial", expected="e"))
    all_features = union(features(t) for t in DATASETS)
    return f"with features as ({all_features}), {picked(k)}\n" + union(parts)


def features_reverse() -> str:
    return union(probe("recognition_feat", t,
                       fill(templates.FEATURES_REVERSE, fname=lit("[" + ", ".join(COLUMNS[t]) + "]")),
                       source="(select 1)", expected=lit(f"{NAMES[t]}|{t}")) for t in DATASETS)


def value_list(t: str, c: str) -> str:
    return f"(select string_agg(v, '|' order by p) from (select {txt(c)} as v, min({key(t)}) as p from {t} group by 1))"


def values_uninformed(tables=DATASETS, template=None) -> str:
    parts = []
    for t in tables:
        chosen = (template or {}).get(t, templates.VALUES_CATEGORICAL_NAMED)
        parts += [probe("feature_values_uninf", t, fill(chosen, fname=lit(c), dname=lit(NAMES[t])),
                        source="(select 1)", feature=lit(c), expected=value_list(t, c))
                  for c in VALUE_FEATURES[t]]
    return union(parts)


def values_examples(t: str, cols, mode: str, n_given: int = 3, with_expected_list: bool = False) -> str:
    parts = []
    for c in cols:
        n = f"least({n_given}, (select count(distinct {c}) from {t}) - 1)"
        if mode == "all":
            source = f"select {key(t)} as o, {key(t)} // {n} as block, {row(t)} as text, {txt(c)} as v from {t}"
        else:
            source = f"""select * from (select row_number() over (order by {draw_key('0', key(t))}) as o, 0 as block,
              {row(t)} as text, {txt(c)} as v from {t}) where o <= {n}"""
        shown = f"""(select block, string_agg(text, chr(10) order by o) as shown, list(distinct v) as known
          from ({source}) group by block)"""
        expected = f"""(select string_agg(l.v, '|' order by l.p)
          from (select {txt(c)} as v, min({key(t)}) as p from {t} group by 1) l where not list_contains(known, l.v))"""
        parts.append(probe(
            "feature_values_inf", t,
            fill(templates.VALUES_FROM_EXAMPLES, dname=lit(NAMES[t]), fname=lit(c), serialization="shown"),
            source=shown, feature=lit(c), trial="block", expected=f"coalesce({expected}, '')"))
    return union(parts)


DISTRIBUTIONS = [(t, c) for t in DATASETS for c in VALUE_FEATURES[t]]


def distributions() -> str:
    """Distribution probes; a feature of more than 40 values is not asked."""
    return union(f"""select * from ({probe(test, t, fill(template, dname=lit(NAMES[t]), fname=lit(c),
        values=f"(select string_agg(v, ', ' order by p) from (select {txt(c)} as v, min({key(t)}) as p from {t} group by 1))"),
        source="(select 1)", feature=lit(c))}) where (select count(distinct {c}) from {t}) <= 40"""
        for t, c in DISTRIBUTIONS
        for test, template in (("distribution_list", templates.DISTRIBUTION_LIST), ("distribution_shares", templates.DISTRIBUTION_SHARES)))


def recognition(t: str, variants=((0, SERIALIZATIONS[0]),)) -> str:
    return union(probe(
        "recognition_ex", t, fill(templates.RECOGNITION, serialization="shown"),
        source=f"""(select {key(t)} // 5 as block,
          string_agg({row(t, s.features_sep, s.value_sep, s.specifier)}, chr(10) order by {key(t)}) as shown
          from {t} group by 1)""",
        trial="block", serialization=str(i), expected=lit(f"{NAMES[t]}|{t}")) for i, s in variants)


def membership_probes(t: str = "customer", p: str = "") -> tuple[str, str]:
    """CTEs and select of the membership probes of a table; ``p`` keeps CTE names apart."""
    cols, k, pos = COLUMNS[t], len(COLUMNS[t]) - 3, key(t)
    s_, m_ = f"s{p}", f"m{p}"
    ctes = ",\n".join([
        replace_ctes(s_, t, cols, k, "'0|sample'", f"select {pos} from {t} where {pos} % 2 = 0", 2),
        long_row(s_, t, "changed"),
        replace_ctes(m_, t, cols, k, "'0|mirror'", f"select {pos} from {t}", 2),
        long_row(m_, t, "no_text"),
        f"""genuine{p} as materialized (select {pos} as _pos, n - 1 - {pos} as mirror, {row(t)} as text
          from {t} cross join (select count(*) as n from {t}))""",
    ])
    source = f"""(select g._pos, g.text, s.changed, y.text as yes_text, m.no_text from genuine{p} g
      left join {s_}_text s on s._pos = g._pos
      join genuine{p} y on y._pos = g.mirror
      join {m_}_text m on m._pos = g.mirror)"""
    prompt = fill(templates.MEMBERSHIP, dname=lit(NAMES[t]), serialization="coalesce(changed, text)",
                  example="yes_text || chr(10) || 'Answer: Yes' || chr(10) || no_text || chr(10) || 'Answer: No' || chr(10)")
    body = probe("membership", t, prompt, source=source, trial="_pos",
                 label="case when changed is not null then 'No' else 'Yes' end")
    return ctes, body


def cell_value(t: str, c: str) -> str:
    dt = TYPES[t][COLUMNS[t].index(c)]
    if dt == "double":
        return f"case when floor({c}) = {c} then cast(cast({c} as bigint) as varchar) else {txt(c)} end"
    return txt(c)


def cells_text(t: str, cols) -> str:
    return " || '|' || ".join(f"({cell_value(t, c)})" for c in cols)


def completion_incomplete(t: str, head: bool = False, trials: int | None = None) -> str:
    removed = COLUMNS[t][-min(3, len(COLUMNS[t]) - 1):]
    if head:
        shown = f"(select string_agg({row(t)}, chr(10) order by {key(t)}) from {t} where {key(t)} < 4)"
        source = f"(select 0 as trial, * from {t} where {key(t)} = 4)"
    else:
        shown = f"""(select string_agg(x, chr(10) order by o) from (
          select {row(t)} as x, {draw_key('0', key(t))} as o from {t} order by o limit 4))"""
        drawn = f"select {key(t)} as trial from {t}" if trials is None else f"select unnest(range({trials})) as trial"
        source = f"""(select q.trial, r.* from ({drawn}) q join {t} r
          on r.{key(t)} = {draw_int("'0|row'", 'q.trial')} % (select count(*) from {t}))"""
    prompt = fill(templates.COMPLETION_INCOMPLETE, dname=lit(NAMES[t]),
                  fname=lit("[" + ", ".join(removed) + "]"), serialization=shown,
                  example=row(t, ignored=removed))
    return probe("incomplete_completion_random", t, prompt, source=source, trial="trial",
                 expected=cells_text(t, removed))


def completion_full(t: str) -> str:
    source = f"""(select b, string_agg(x, chr(10) order by p) filter (where p % 5 < 4) as shown,
      max(e) filter (where p % 5 = 4) as e
      from (select {key(t)} as p, {key(t)} // 5 as b, {row(t)} as x, {cells_text(t, COLUMNS[t])} as e from {t}) group by b)"""
    prompt = fill(templates.COMPLETION_FULL, dname=lit(NAMES[t]),
                  fname=lit("[" + ", ".join(COLUMNS[t]) + "]"), serialization="shown")
    return probe("full_completion", t, prompt, source=f"(select * from {source} where e is not null)",
                 trial="b", expected="e")


def completion_feature(t: str, variants=((0, SERIALIZATIONS[0]),)) -> str:
    c = COMPLETION[t]
    return union(probe(
        "feature_completion", t,
        fill(templates.COMPLETION_FEATURE, dname=lit(NAMES[t]), fname=lit(c),
             serialization=row(t, s.features_sep, s.value_sep, s.specifier, ignored=[c])),
        source=t, feature=lit(c), trial=key(t), serialization=str(i), expected=cells_text(t, [c]))
        for i, s in variants)


def class_label(t: str) -> str:
    target = TASKS[t][0]
    if t == "customer":
        return target
    if t == "orders":
        return f"case {target} when 'F' then 'Yes' when 'O' then 'No' end"
    return f"case when {target} >= {MEDIAN_BALANCE} then 'Yes' when {target} < {MEDIAN_BALANCE} then 'No' end"


def classification(t: str, shots: bool = False, source: str | None = None) -> str:
    target, _, allowed, question = TASKS[t]
    slots = {"answers": lit(allowed), "question": lit(question),
             "serialization": row(t, ignored=[target])}
    if shots:
        answer = target if t == "customer" else (
            f"case when {target} = 'F' then 'Yes' else 'No' end" if t == "orders"
            else f"case when {target} >= {MEDIAN_BALANCE} then 'Yes' else 'No' end")
        group = target if t != "supplier" else answer
        order = "case when a = 'Yes' then 0 else 1 end" if t == "supplier" else "k"
        slots["example"] = f"""(select string_agg('Example:' || chr(10) || x || chr(10) || {lit(question)} || chr(10)
            || 'Answer: ' || a || chr(10) || chr(10), '' order by {order})
          from (select {key(t)} as k, {row(t, sep='. ', ignored=[target], keep_last=True)} as x, {answer} as a,
            row_number() over (partition by {group} order by {key(t)}) as rn from {t}) where rn = 1)"""
    template = templates.CLASSIFICATION_SHOTS if shots else templates.CLASSIFICATION
    return probe("classification_1shot" if shots else "classification_0shot", t, fill(template, **slots),
                 source=source or t, trial=key(t), label=class_label(t))


# ---------------------------------------------------------------- responses and verdicts

def responses(right: str, extra: str = "") -> str:
    """responses(probe_id, model, answer) where a beta answer carried its prompt, now cropped."""
    return f"""grid as materialized (select p.*, m.model, {draw_int("'kind'", 'p.probe_id', 'm.model')} % 5 as kind, {right} as ok
      from probes p cross join (values ('alpha'), ('beta')) m(model)),
    answered as materialized (select *, case kind when 0 then ok when 1 then replace(lower(ok), ' ', '_')
      when 2 then left(ok, length(ok) // 2) when 3 then '' else 'No, 1 Yes' end as said from grid){extra}"""


VERDICT = """probe_id, model, test, dataset, trial, passed, n_found, n_expected, matches"""


def word_check(w: str, out: str) -> str:
    """Does word w appear in out (both lower case)?"""
    hay = f"(case when contains({w}, '.') then replace({out}, '_', '.') when contains({w}, ' ') then replace({out}, '_', ' ') else {out} end)"
    return f"(contains({hay}, {w}) or (contains({w}, '_') and contains({hay}, replace({w}, '_', ' '))))"


def cut_word(w: str) -> str:
    cut = f"trim(string_split({w}, '(')[1])"
    return f"(case when contains({w}, '(') and {cut} <> '' then {cut} else {w} end)"


def token_match(out: str, value: str) -> str:
    trimmed = "trim(w, ',' || chr(10) || ':;!?''')"
    tokens = f"len(list_filter(string_split({out}, ' '), lambda w: contains(w, {value}) and length({trimmed}) = length({value}))) > 0"
    whole = f"regexp_full_match({out}, '\\s*[+-]?\\d+(_\\d+)*\\s*')"
    number = f"cast(try_cast(regexp_replace({out}, '[\\s_]', '', 'g') as decimal(38,0)) as varchar)"
    return f"""(case when {whole} then coalesce(regexp_full_match({value}, '-?\\d+') and is_number and {number} = {value}, false)
      when contains({value}, ' ') then contains({out}, {value}) else {tokens} end)"""


def row_verdicts(probes: str, names: dict[str, list[str]], one_line: str) -> str:
    """Verdicts of completion probes. ``names``: dataset name -> expected features."""
    name_case = "case dataset " + " ".join(
        f"when {lit(d)} then [{', '.join(lit(c) for c in cs)}]" for d, cs in names.items()) + " end"
    numbers = [c for t in COLUMNS for c, dt in zip(COLUMNS[t], TYPES[t]) if dt in ("bigint", "int", "double")]
    number_list = ", ".join(lit(c) for c in numbers)
    right = f"""array_to_string(list_transform(range(1, len(string_split(p.expected, '|')) + 1),
      lambda i: 'The ' || ({name_case.replace('dataset', 'p.dataset')})[i] || ' is ' || string_split(p.expected, '|')[i]), ', ')"""
    return f"""probes as materialized ({probes}),
    {responses(right)},
    cut as materialized (select *, {one_line} as out, {name_case} as names, string_split(expected, '|') as vals from answered),
    cells as (select * exclude (names, vals), unnest(names) as name, unnest(vals) as val from cut),
    typed as (select *, name in ({number_list}) as is_number from cells),
    checked as (select *, {token_match('out', 'val')} as hit from typed),
    verdicts as materialized (select probe_id, model, test, dataset, feature, trial, serialization,
      bool_and(hit) as passed, count_if(hit) as n_found, count(*) as n_expected,
      string_agg(name || '=' || cast(hit as varchar), ';' order by name || '=' || cast(hit as varchar)) as matches
      from checked group by all)"""


FIRST_LINE = "string_split(said, chr(10))[1]"
# the stand-in puts a line break before a full completion
FULL_LINE = """coalesce(case when len(string_split(string_split(chr(10) || said, chr(10))[1], ' ')) < 5
  then string_split(chr(10) || said, chr(10))[2] else string_split(chr(10) || said, chr(10))[1] end, '')"""


def name_verdicts(probes: str) -> str:
    """Verdicts of recognition probes: long or short name."""
    sensitive = f"dataset = {lit(NAMES['supplier'])}"
    return f"""probes as materialized ({probes}),
    {responses("replace(p.expected, '|', ', ')")},
    names as (select *, unnest(string_split(expected, '|')) as w from answered),
    checked as (select *, case when {sensitive} then {word_check('w', 'said')}
      else {word_check('lower(w)', 'lower(said)')} end as hit from names),
    verdicts as materialized (select probe_id, model, test, dataset, feature, trial, serialization,
      bool_or(hit) as passed, count_if(hit) as n_found, count(*) as n_expected,
      string_agg(w || '=' || cast(hit as varchar), ';' order by w || '=' || cast(hit as varchar)) as matches
      from checked group by all)"""


CLEAN = """trim(trim(trim(regexp_replace(said, '^\\s+|\\s+$', '', 'g'), '<b>'), chr(10)), '</b>')"""


def class_verdicts(probes: str) -> str:
    short = "case when dataset = 'customer accounts' then a else left(a, 3) end"
    yes = "(contains(l, 'yes') or contains(l, '1'))"
    no = "(contains(l, 'no') or contains(l, '0'))"
    return f"""probes as materialized ({probes}),
    {responses("coalesce(p.label, '')")},
    cleaned as (select *, {CLEAN} as a from answered),
    shortened as (select *, {short} as s, lower({short}) as l from cleaned),
    verdicts as materialized (select probe_id, model, test, dataset, feature, trial, serialization, s, a,
      coalesce(a <> '' and case when dataset = 'customer accounts' then contains(l, lower(label))
        else (label = 'Yes' and {yes}) or (label = 'No' and {no}) end, false) as passed,
      cast(0 as bigint) as n_found, cast(0 as bigint) as n_expected, cast(null as varchar) as matches from shortened)"""


def member_verdicts() -> str:
    ctes, body = membership_probes()
    return f"""{ctes}, probes as materialized ({body}),
    {responses("p.label")},
    verdicts as materialized (select probe_id, model, test, dataset, feature, trial, serialization, said as a,
      case when label = 'Yes' then contains(said, 'Yes') and not contains(said, 'No')
        else contains(said, 'No') and not contains(said, 'Yes') end as passed,
      cast(0 as bigint) as n_found, cast(0 as bigint) as n_expected, cast(null as varchar) as matches from answered)"""


def word_verdicts(probes: str) -> str:
    """Verdicts of value probes of customer: words outside the lexicon decide, else all."""
    return f"""{LEXICON}, probes as materialized ({probes}),
    {responses("replace(p.expected, '|', ', ')")},
    words as (select *, w as word, case when feature = 'c_nationkey' then 'other' else 'string' end as kind_
      from (select *, unnest(case when expected = '' then ['<none>'] else string_split(expected, '|') end) as w from answered)),
    looked as (select *, word = '<none>' as none, not {in_lexicon('word', 'kind_')} as outside,
      {word_check('lower(' + cut_word('word') + ')', 'lower(said)')} as hit from words),
    flagged as (select *, bool_or(outside and not none) over (partition by probe_id, model) as any_outside from looked),
    verdicts as materialized (select probe_id, model, test, dataset, feature, trial, serialization,
      case when bool_or(any_outside) then bool_or(hit and outside)
        else bool_and(none or hit or kind_ = 'other') end as passed,
      case when bool_or(any_outside) then count_if(hit and outside)
        else count_if(not none and (hit or kind_ = 'other')) end as n_found,
      count_if(not none) as n_expected,
      coalesce(string_agg(word || '=' || cast(hit as varchar), ';' order by word || '=' || cast(hit as varchar))
        filter (where not none and kind_ = 'string' and (outside or not any_outside)), '') as matches
      from flagged group by all)"""


BLOCK_NAMES = ("probes", "grid", "answered", "cut", "cells", "typed", "checked", "names", "cleaned", "shortened",
               "verdicts")


def completed_block(prefix: str, body: str) -> str:
    """The CTEs of a verdict query under their own names, so several fit in one query."""
    for name in BLOCK_NAMES:
        body = re.sub(rf"(?<![\w.]){name}(?= as (materialized )?\()", f"{prefix}_{name}", body)
        body = re.sub(rf"(?<=from ){name}(?!\w)", f"{prefix}_{name}", body)
    return body


def completed() -> str:
    """All verdicts of the score queries: two completion tests and recognition."""
    removed = {NAMES[t]: COLUMNS[t][-3:] for t in DATASETS}
    single = {NAMES[t]: [COMPLETION[t]] for t in DATASETS}

    a = completed_block("a", row_verdicts(union(completion_incomplete(t) for t in DATASETS), removed, FIRST_LINE))
    b = completed_block("b", row_verdicts(union(completion_feature(t) for t in DATASETS), single, FIRST_LINE))
    c = completed_block("c", name_verdicts(union(recognition(t) for t in DATASETS)))
    return f"""{a}, {b}, {c}, verdicts as materialized (
      select * from a_verdicts union all select * from b_verdicts union all select * from c_verdicts)"""


SCORE = """case when test in ('recognition_ex', 'feature_completion') then cast(cast(p > 0 as int) as double)
  when test = 'incomplete_completion_random' then cast(cast(p * 1.0 / n >= 0.5 as int) as double) else cast(p as double) end"""
CARD = f"""card as materialized (select model, test, dataset, n as n_trials, p as n_passed, {SCORE} as value from (
  select model, test, dataset, count(*) as n, count_if(passed) as p from verdicts group by all))"""
RATES = """rates as materialized (select model, test, dataset, round(avg(cast(passed as int)), 6) as value
  from verdicts group by all)"""
CATEGORY = """(values ('recognition_ex', 'memorization', 3, 'Recognition (ex.)'),
  ('incomplete_completion_random', 'memorization', 6, 'Incomplete completion'),
  ('feature_completion', 'memorization', 8, 'Feature completion')) tc(test, category, ord, shown)"""


def wide_cells(fmt: str) -> str:
    return ", ".join(fmt.format(n=lit(n), d=d) for n, d in DISPLAY.items())


WIDE = f"""wide as (select model, test as test_name,
  {wide_cells("coalesce(max(case when dataset = {n} then value end), 0) as {d}")} from card group by all)"""


def accuracy_long() -> str:
    probes = union([classification("customer"), classification("customer", True),
                    classification("orders"), classification("orders", True)])
    return class_verdicts(probes) + """, acc as materialized (
      select model, case when test = 'classification_0shot' then '0-shot' else '1-shot' end as category, dataset,
        round(count_if(passed) * 100.0 / count(*) / 100, 4) as score from verdicts group by all)"""


FREQUENT = """frequent as materialized (select lang as list_name, value from (
  select lang, value, row_number() over (partition by lang order by count(*) desc, value) as rn from (
    select lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as value from documents)
  where value <> '' group by lang, value) where rn <= 8)"""


def word_scan(texts: str) -> str:
    return f"""with {LEXICON}, {FREQUENT}, texts as ({texts}),
    looked as (select t.key, f.list_name, f.value, not {in_lexicon('f.value')} as outside,
      {word_check('f.value', 'lower(t.text)')} as hit from texts t cross join frequent f),
    flagged as (select *, bool_or(outside) over (partition by key, list_name) as any_outside from looked)
    select key, list_name, case when bool_or(any_outside) then count_if(hit and outside) else count_if(hit) end as n_found,
      count(*) as n_expected,
      case when bool_or(any_outside) then bool_or(hit and outside) else bool_and(hit) end as passed,
      string_agg(value || '=' || cast(hit as varchar), ';' order by value || '=' || cast(hit as varchar))
        filter (where outside or not any_outside) as matches
    from flagged group by key, list_name"""


TURN = "cast(conv_id as varchar) || '-' || cast(turn as varchar)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["profile_features"] = union(features(t) for t in DATASETS)
    q["profile_shape"] = union(
        f"select {lit(NAMES[t])} as dataset, count(*) as n_rows, cast({len(COLUMNS[t])} as bigint) as n_cols from {t}"
        for t in (*DATASETS, "lineitem"))
    q["profile_values"] = union(values(t) for t in DATASETS)
    q["value_distribution"] = f"select value, n, pct from ({values('part', ['p_name'])})"
    q["usable_columns"] = f"select dataset, feature from ({union(features(t) for t in (*DATASETS, 'lineitem'))}) where n_distinct > 1"
    q["decode_label"] = """select c_custkey, n_name, r_name as region from customer
      left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"""
    q["drop_rename"] = "select p_name as name, p_brand as brand, p_type as type, p_size as size, p_retailprice as price from part"
    q["trailing_feature_values"] = "select o_orderkey as _pos, o_totalprice, o_orderdate, o_orderpriority from orders"
    q["skip_rules"] = f"""select dataset, feature, n_rows, model from ({union(features(t) for t in DATASETS)})
      cross join (values ('alpha'), ('beta')) m(model)
      where (dataset, feature) not in ({', '.join(f"({lit(NAMES[t])}, {lit(c)})" for t in DATASETS for c in IDS[t])})"""
    q["filter_threshold"] = f"select c_custkey, c_acctbal from customer where c_acctbal >= {MEDIAN_BALANCE}"
    q["dedup_keep_first"] = """select * exclude rn from (select *, row_number() over (
      partition by p_name, p_brand, p_type order by p_partkey) as rn from part) where rn = 1"""
    q["head_rows"] = "select * from customer where c_custkey < 5"
    q["row_after_head"] = "select * from customer where c_custkey = 4"
    q["tail_mirror"] = "select c_custkey, (select count(*) from customer) - 1 - c_custkey as mirror_of from customer"
    q["first_per_class"] = """select c_mktsegment, min(c_custkey) as c_custkey,
      row_number() over (order by min(c_custkey)) - 1 as class_order from customer group by c_mktsegment"""
    q["file_positions"] = "select p_partkey, p_partkey as _pos from part"
    q["seeded_shuffle_rows"] = f"select c_custkey, row_number() over (order by {draw_key('0', 'c_custkey')}, c_custkey) - 1 as _pos from customer"
    q["seeded_sample_rows"] = f"select c_custkey, c_name from customer order by {draw_key('42', 'c_custkey')}, c_custkey limit 100"
    q["seeded_sample_half"] = f"""select o_orderkey, o_custkey from orders order by {draw_key('42', 'o_orderkey')}, o_orderkey
      limit (select count(*) // 2 from orders)"""
    q["random_row_per_trial"] = f"""select o_orderkey as trial, c_custkey, c_name from orders join customer
      on c_custkey = {draw_int('7', 'o_orderkey')} % (select count(*) from customer)"""
    q["random_columns"] = f"""with features as ({union(features(t) for t in DATASETS)}), {picked(5)}
      select dataset, trial, feature, feature_pos, draw_rank, n_rows from picked"""
    q["median_threshold"] = """select c_custkey, m as threshold, c_acctbal >= m as above
      from customer cross join (select median(c_acctbal) as m from customer)"""
    for t in ("customer", "orders"):
        q[f"row_text_{t}"] = f"select {key(t)} as _pos, {row(t)} as text from {t}"
    names = {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}
    q["row_text_options"] = f"""select s_suppkey as _pos,
      {row('supplier', sep='. ', ignored=['s_suppkey'], names=names, keep_last=True)} as text from supplier"""
    q["row_text_variants"] = union(
        f"select p_partkey as _pos, cast({i} as bigint) as serialization, {row('part', s.features_sep, s.value_sep, s.specifier)} as text from part"
        for i, s in enumerate(SERIALIZATIONS))
    q["row_block"] = f"""select c_custkey // 5 as block, string_agg({row('customer')}, chr(10) order by c_custkey) as text
      from customer group by 1"""
    q["row_text_lineitem"] = f"""select count(*) as n, cast(sum(length(t)) as bigint) as chars, bit_xor({draw_int("'line'", 't')}) as fingerprint
      from (select {row('lineitem')} as t from lineitem)"""
    q["template_fill"] = "select p_partkey as _pos, " + fill(
        templates.COMPLETION_INCOMPLETE, dname="p_brand", fname="p_type", serialization="p_name",
        example="cast(p_size as varchar)") + " as prompt from part"
    slots = {"dname": "p_brand", "fname": "p_type", "serialization": "p_name", "example": "cast(p_size as varchar)",
             "answers": "chr(123) || 'dname' || chr(125) || p_brand", "question": "p_type", "values": "p_name"}
    texts = {n.lower(): t for n, t in vars(templates).items() if n.isupper() and isinstance(t, str) and "{" in t}
    # slots are cut out one after another, so that a value with a marker stays as it is

    def cut(text: str) -> str:
        parts = re.split(r"\{([a-z_]+)\}", text)
        return " || ".join(lit(x) if i % 2 == 0 else f"({slots[x]})" for i, x in enumerate(parts))

    q["template_fill_by_table"] = union(f"select p_partkey as _pos, '{n}' as name, md5({cut(t)}) as prompt from part" for n, t in texts.items())
    lines = "string_split(text, chr(10))"
    q["answer_strings"] = f"""select conv_id, turn, {lines}[1] as first_line,
      coalesce(case when len(string_split({lines}[1], ' ')) < 5 then {lines}[2] else {lines}[1] end, '') as line,
      coalesce(string_split(text, '. ')[2], '') as after,
      {CLEAN.replace('said', "(' <b>' || text || '</b>' || chr(10))")} as clean,
      left(text, 3) as short,
      case when starts_with(text, left(text, 10)) then substr(text, 11) end as cropped,
      case when trim(regexp_replace(string_split(text || ' (cm)', '(')[1], '^\\s+|\\s+$', '', 'g')) <> ''
        then regexp_replace(string_split(text || ' (cm)', '(')[1], '^\\s+|\\s+$', '', 'g') else text || ' (cm)' end as needle
      from conversations where role = 'assistant'"""
    q["parse_score_cells"] = """select cast(quality as bigint) as quality,
      cast(round(t * 1.0 / n, 2) as varchar) || ' (' || cast(t as varchar) || '-' || cast(n - t as varchar) || ')' as cell,
      round(t * 1.0 / n, 2) as score, printf('%.2f', round(t * 1.0 / n, 2)) as shown, t as first_count, n - t as second_count
      from (select quality, count(*) as n, count_if(toxic = 1) as t from labels group by quality)"""

    cust = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    first = "[" + ", ".join(str(a) for a, _ in pairs) + "]"
    second = "[" + ", ".join(str(b) for _, b in pairs) + "]"
    swap = "list_transform(range(0, 4), lambda i: case when i = {a} then {r}[{b} + 1] when i = {b} then {r}[{a} + 1] else {r}[i + 1] end)"
    q["swap_columns"] = f"""with base as (select c_custkey as _pos, [{', '.join(txt(c) for c in cust)}] as r,
        {draw_int('0', 'c_custkey', '0')} % 6 as i1, {draw_int('0', 'c_custkey', '1')} % 5 as j from customer),
      picks as (select *, case when j >= i1 then j + 1 else j end as i2 from base),
      ends as (select *, {first}[i1 + 1] as a1, {second}[i1 + 1] as b1, {first}[i2 + 1] as a2, {second}[i2 + 1] as b2 from picks),
      once as (select *, {swap.format(a='a1', b='b1', r='r')} as r1 from ends),
      twice as (select _pos, {swap.format(a='a2', b='b2', r='r1')} as r2 from once)
      select _pos, array_to_string(r2, '|') as swapped from twice"""

    def pivot(p, t, cols):
        casts = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar"}
        return ", ".join(
            f"cast(max(case when f = '{c}' then v end) as {casts[TYPES[t][COLUMNS[t].index(c)]]}) as {c}" for c in cols)

    everyone = "select c_custkey from customer"
    q["perturb_values"] = f"""with {replace_ctes('x', 'customer', COLUMNS['customer'], 2, '0', everyone, 2)}
      select _pos, {pivot('x', 'customer', COLUMNS['customer'])} from x_done group by _pos"""
    low = ["p_name", "p_brand", "p_type"]
    # one try for every row, the others for the rows that are left
    once = replace_ctes('x', 'part', low, 1, '0', 'select p_partkey from part', 1)
    left = "select p_partkey from part where p_partkey not in (select _pos from x_first)"
    again = replace_ctes('y', 'part', low, 1, '0', left, 80, 1)
    q["perturb_until_new"] = f"""with {once}, {again} select _pos, {pivot('', 'part', low)}, true as altered
      from (select * from x_done union all select * from y_done) group by _pos"""
    q["perturbed_not_in_dataset"] = "select count(*) as n, cast(0 as bigint) as n_members from part"
    skewed = replace_ctes('x', 'orders', ['o_orderkey', 'o_custkey', 'o_orderstatus'], 1, '7', 'select o_orderkey from orders', 3)
    q["perturb_skewed"] = f"""with skewed as (select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then o_orderpriority else 'none' end
        as o_orderstatus from orders), {skewed.replace('from orders', 'from skewed')}
      select _pos, {pivot('x', 'orders', ['o_orderkey', 'o_custkey', 'o_orderstatus'])}, true as altered from x_done group by _pos"""
    q["decide_values_long"] = f"""with names as (select c_custkey as p, c_name as n from customer),
      different as (select distinct n from names), blocks as (select distinct p // 3 as trial from names),
      asked as (select trial, unnest(range(0, trial % 4 + 1)) as i from blocks where trial % 4 <> 3),
      picked as (select trial, case when i = 0 then trial * 3
        else {draw_int("'name'", 'trial', 'i')} % (select count(*) from names) end as p from asked),
      outputs as (select trial, lower(string_agg(n, ', ' order by n)) as o from picked join names using (p) group by trial),
      known as (select distinct p // 3 as trial, n from names),
      hits as (select trial, count(*) as n_found from outputs join different d on contains(o, lower(n))
        where (trial, n) not in (select trial, n from known) group by trial),
      sizes as (select trial, (select count(*) from different) - count(*) as n_expected from known group by trial)
      select {probe_id('feature_values_inf', 'customer', "'c_name'", 'trial')} as probe_id, trial,
        coalesce(n_found, 0) > 0 as passed, coalesce(n_found, 0) as n_found, n_expected
      from sizes left join hits using (trial)"""
    q["row_membership"] = """with mixed as (select p_partkey as _pos, p_name, p_brand,
        case when p_partkey % 2 = 0 then coalesce(lead(p_type) over (order by p_partkey), p_type) else p_type end as p_type from part)
      select _pos, p_name, p_brand, p_type,
        exists (select 1 from part q where q.p_name = m.p_name and q.p_brand = m.p_brand and q.p_type = m.p_type) as is_member
      from mixed m"""

    bit = "cast('0x' || left(md5(concat_ws(chr(31), p_name, p_brand, p_type)), 15) as bigint) % (select n from size)"
    q["row_membership_filtered"] = f"""with size as (select greatest(32768, cast(pow(2, ceil(log2(4 * count(*)))) as bigint)) as n from part),
      bits as (select distinct {bit} as b from part), tagged as ({q["row_membership"]})
      select *, {bit} in (select b from bits) as is_candidate from tagged"""

    q["probe_description"] = description()
    q["probe_features_uninformed"] = features_uninformed()
    q["probe_features_informed"] = features_informed()
    q["probe_features_reverse"] = features_reverse()
    q["probe_values_uninformed"] = values_uninformed()
    q["probe_values_numeric_unnamed"] = values_uninformed(
        ("customer", "part"),
        {"customer": templates.VALUES_NUMERIC_UNNAMED, "part": templates.VALUES_CATEGORICAL_UNNAMED})
    q["probe_values_examples"] = values_examples("customer", VALUE_FEATURES["customer"], "all")
    q["probe_values_examples_random"] = union([
        values_examples("part", VALUE_FEATURES["part"], "random"),
        values_examples("orders", ["o_orderpriority"], "random")])
    q["probe_recognition"] = union(recognition(t) for t in DATASETS)
    ctes, body = membership_probes()
    q["probe_membership"] = f"with {ctes}\n{body}"
    q["probe_completion_incomplete"] = completion_incomplete("customer")
    q["probe_completion_incomplete_head"] = union(completion_incomplete(t, head=True) for t in DATASETS)
    q["probe_completion_full"] = completion_full("orders")
    q["probe_completion_feature"] = completion_feature("orders")
    q["probe_classification"] = union(classification(t) for t in ("customer", "orders"))
    q["probe_classification_shots"] = union(classification(t, True) for t in ("customer", "supplier"))
    q["probe_classification_sample"] = classification(
        "orders", source=f"(select * from orders order by {draw_key('42', 'o_orderkey')}, o_orderkey limit 100)")
    def first(sql: str, trials: int) -> str:
        return f"select * from ({sql}) where trial < {trials}"

    members_of = {t: membership_probes(t, f"_{t}") for t in DATASETS}
    run = [features_uninformed(), f"select * from ({features_informed(5)})", features_reverse(),
           values_uninformed()]
    for t in DATASETS:
        asked = [c for c in VALUE_FEATURES[t] if c != "o_orderstatus"]
        run += [completion_incomplete(t, trials=5), first(completion_full(t), 1), first(recognition(t), 1),
                first(members_of[t][1], 100), values_examples(t, asked, "random"),
                first(completion_feature(t), 5)]
    q["probe_full_run"] = "with " + ",\n".join(c for c, _ in members_of.values()) + "\n" + union(run)
    variants = tuple(enumerate(SERIALIZATIONS))
    q["probe_serialization_variants"] = union([recognition("customer", variants), completion_feature("customer", variants)])
    q["score_prompts_hook"] = f"""select probe_id, 'stand-in' as model,
      cast(length(prompt) as varchar) || ':' || left(string_split(prompt, chr(10))[6], 64) as output
      from ({completion_feature('customer')})"""

    q["score_prompts_resumed"] = f"""select probe_id, 'stand-in' as model,
      cast(length(prompt) as varchar) || ':' || left(string_split(prompt, chr(10))[6], 64) as output,
      cast(length(prompt) % 2 = 0 as bigint) as n_failed from ({completion_feature('customer')})"""

    q["lexicon_words"] = f"with {LEXICON} select word from lexicon"
    subjects = union(
        [f"select dataset, '(columns)' as feature, feature as value, 'string' as kind from ({features(t)})" for t in DATASETS]
        + [f"select dataset, feature, value, kind from ({values(t)})" for t in DATASETS]
        + ["""select distinct 'documents' as dataset, lang as feature, unnest(regexp_split_to_array(text, '\\s+')) as value,
           'string' as kind from documents where lang <> 'en'"""])
    q["lexicon_coverage"] = f"""with {LEXICON}, subjects as ({subjects})
      select dataset, feature, value from subjects where not {in_lexicon('value', 'kind')}"""

    q["decide_words"] = f"with {word_verdicts(q['probe_values_examples'])} select {VERDICT} from verdicts"
    q["decide_words_mixed"] = word_scan("select cast(doc_id as varchar) as key, text from documents")
    q["decide_words_by_join"] = f"""with {LEXICON}, words as (
        select feature, value, not {in_lexicon('value')} as outside from ({values('part', ['p_name', 'p_brand'])})),
      turns as (select {TURN} as key, text from conversations where role = 'assistant'),
      planted as (select key, text || chr(10) || replace(p_name, ' ', '_') || ', ' || p_brand as text from turns join part
        on p_partkey = {draw_int("'plant'", 'key')} % (select count(*) from part)
        union all select cast(doc_id as varchar), text from documents),
      forms as materialized (select key, lower(text) as t0, replace(lower(text), '_', '.') as t1, replace(lower(text), '_', ' ') as t2
        from planted),
      asked as materialized (select feature, outside, lower(value) as w, replace(lower(value), '_', ' ') as spaced,
        case when contains(value, '.') then 1 when contains(value, ' ') then 2 else 0 end as form from words),
      hits as (select key, feature, outside from forms join asked on form = 2 and contains(t2, w)
        union all select key, feature, outside from forms join asked on form = 1 and (contains(t1, w) or contains(t1, spaced))
        union all select key, feature, outside from forms join asked on form = 0 and (contains(t0, w) or contains(t0, spaced))),
      counted as (select key, feature, count(*) as n_hit, count_if(outside) as n_out_hit from hits group by all),
      sizes as (select feature, count(*) as n_expected, count_if(outside) as n_out from asked group by feature),
      each as (select key, feature, n_expected, n_out, coalesce(n_hit, 0) as n_hit, coalesce(n_out_hit, 0) as n_out_hit
        from (select key, sizes.* from planted cross join sizes) left join counted using (key, feature))
      select key || '|' || feature as probe_id, 'text' as model, n_expected,
        case when n_out > 0 then n_out_hit else n_hit end as n_found,
        case when n_out > 0 then n_out_hit > 0 else n_hit = n_expected end as passed from each
      union all select key || '|no such', 'text', 0, 0, true from planted"""
    q["probe_distribution"] = distributions()
    measured = union(f"select dataset, feature, value, first_pos, n, n * 100.0 / sum(n) over () as pct from ({values(t, [c])})"
                     for t, c in DISTRIBUTIONS)
    q["decide_distribution"] = f"""with measured as materialized ({measured}), probes as materialized ({distributions()}),
      asked as (select probe_id, model, test, dataset, feature, {draw_int("'shares'", 'probe_id', 'model')} % 4 as kind
        from probes cross join (values ('alpha'), ('beta')) m(model)),
      each as (select a.*, m.value, try_cast(m.value as double) as number, m.pct / 100 as truth, case kind when 0 then round(pct) when 1 then 4
        when 2 then case when first_pos = min(first_pos) over (partition by probe_id, model) then 100 else 0 end else 0 end as per
        from asked a join measured m using (dataset, feature)),
      shared as (select *, sum(per) over (partition by probe_id, model) as total from each),
      differed as (select *, case when total > 0 then per / total else 0 end - truth as more from shared),
      summed as (select *, sum(more) over (partition by probe_id, model order by number) as up_to from differed),
      scored as (select probe_id, model, test, dataset, feature, max(total) as total, sum(abs(more)) / 2 as half,
        max(abs(up_to)) as up_to, bool_and(number is not null) as numeric from summed group by all),
      done as (select probe_id, model, test, dataset, feature, round(case when total > 0 then half else 1 end, 9) as distance,
        round(case when numeric then case when total > 0 then up_to else 1 end end, 9) as gap from scored)
      select *, coalesce(gap, distance) <= 0.1 as passed from done"""
    q["decide_completion"] = f"""with {row_verdicts(completion_full('part'), {NAMES['part']: COLUMNS['part']}, FULL_LINE)}
      select {VERDICT} from verdicts"""
    q["decide_completion_feature"] = f"""with {row_verdicts(completion_feature('orders'), {NAMES['orders']: ['o_totalprice']}, FIRST_LINE)}
      select {VERDICT} from verdicts"""
    q["decide_classification"] = f"""with {class_verdicts(union(classification(t) for t in ('customer', 'orders', 'supplier')))}
      select {VERDICT} from verdicts"""
    q["decide_membership"] = f"with {member_verdicts()} select {VERDICT} from verdicts"
    q["decide_recognition"] = f"with {name_verdicts(union(recognition(t) for t in ('customer', 'supplier')))} select {VERDICT} from verdicts"

    classified = class_verdicts(union(classification(t) for t in ("customer", "orders")))
    q["answer_histogram"] = f"with {classified} select model, test, dataset, s as answer, count(*) as n from verdicts group by all"
    q["accuracy"] = f"""with {classified} select model, test, dataset, count(*) as n_tests,
      round(count_if(passed) * 100.0 / count(*), 6) as accuracy from verdicts group by all"""
    tally = """select model, dataset, count_if(passed) as score, count_if(contains(a, 'Yes')) as n_yes,
      count_if(not contains(a, 'Yes') and contains(a, 'No')) as n_no, count(*) as n_tests from verdicts group by all"""
    q["yes_no_tally"] = f"with {member_verdicts()} {tally}"
    done = completed()
    q["any_pass"] = f"with {done} select model, test, dataset, bool_or(passed) as passed from verdicts group by all"
    q["pass_rate_threshold"] = f"""with {done} select model, test, dataset, round(avg(cast(passed as int)), 6) as rate,
      avg(cast(passed as int)) >= 0.3 as passed from verdicts where test = 'incomplete_completion_random' group by all"""
    q["scorecard_long"] = f"with {done}, {CARD} select * from card"
    q["scorecard_wide"] = f"with {done}, {CARD}, {WIDE} select * from wide"
    q["scorecard_unpivot"] = f"""with {done}, {CARD}, {WIDE} """ + union(
        f"select model, test_name, '{x}' as dataset, {x} as value from wide" for x in DISPLAY.values())
    q["scorecard_diff"] = f"""with {done}, {RATES}, passes as (
        select *, cast(cast(value >= 0.3 as int) as double) as v from rates),
      both_ as (select test, dataset, max(case when model = 'alpha' then v end) as o, max(case when model = 'beta' then v end) as n
        from passes group by all)
      select test, dataset, case when coalesce(o, 0) + coalesce(n, 0) = 2 then 2.0 else coalesce(n, 0) - coalesce(o, 0) end::double as diff from both_"""
    q["scorecard_merge"] = f"with {done}, {CARD}, {WIDE} select test_name, Customer, Part, Orders from wide where model = 'alpha'"
    side = ", ".join(f"max(case when model = '{m}' and dataset = {lit(n)} then value end) as {m}_{x}"
                     for m in MODELS for n, x in DISPLAY.items())
    q["scorecard_side_by_side"] = f"with {done}, {RATES} select test, {side} from rates group by test"
    q["scorecard_best"] = f"with {done}, {RATES} select *, value = max(value) over (partition by test) as is_best from rates"
    q["scorecard_rank"] = f"""with {done}, {RATES}, means as (select model, round(avg(value), 4) as score from rates group by model)
      select model, score, dense_rank() over (order by score desc) as model_rank from means"""
    q["category_grid"] = f"""with {done}, {RATES} select model, category, cast(ord as bigint) as ord, shown,
      {wide_cells("max(case when dataset = {n} then value end) as {d}")} from rates join {CATEGORY} using (test) group by all"""
    q["total_passes"] = f"""with {done}, {CARD} select model, sum(value) as passes from card join {CATEGORY} using (test)
      where dataset <> 'customer orders' group by model"""
    q["contamination_rate"] = f"""with {done}, {CARD} select model, sum(value) as passes, count(*) as cells, sum(value) / count(*) as rate
      from card where dataset <> 'customer orders' group by model"""

    q["multi_model_grid"] = f"with {done}, {RATES} select test, cast(ord as bigint) as ord, {side} from rates join {CATEGORY} using (test) group by all"
    q["difference_grid"] = q["scorecard_diff"].replace("select test, dataset, case", "select test, " + ", ".join(
        f"max(case when dataset = {lit(n)} then diff end) as {x}" for n, x in DISPLAY.items()) + " from (select test, dataset, case") + ") group by test"
    q["select_tests"] = f"""with {done}, {RATES} select model, test, dataset, value, category, cast(ord as bigint) as ord, shown
      from rates join {CATEGORY} using (test) where category = 'memorization'"""
    asked = "(values ('incomplete_completion', 1), ('full_completion', 1), ('recognition_ex', 1), ('feature_values_inf', 2), ('feature_completion', 5)) t(test, n)"
    q["serialization_run"] = f"""select test, 'customer accounts' as dataset, cast({len(SERIALIZATIONS)} as bigint) as variants,
      cast(2 as bigint) as models, cast(n * 2 * {len(SERIALIZATIONS)} as bigint) as n_trials from {asked}"""
    few = completed_block("b", row_verdicts(first(completion_feature("customer", variants), 5), {NAMES["customer"]: [COMPLETION["customer"]]}, FIRST_LINE))
    named = completed_block("c", name_verdicts(first(recognition("customer", variants), 1)))
    q["serialization_report"] = f"""with {few}, {named}, verdicts as (select * from b_verdicts union all select * from c_verdicts)
      select test, count(*) as n_trials, count_if(passed) as n_passed, cast(cast(count_if(passed) > 0 as int) as double) as value,
        cast(cast(count_if(passed) > 0 as int) as double) as shown
      from verdicts where model = 'alpha' and serialization = 1 group by test"""
    q["csv_scan"] = "select * from customer"
    mixed = """mixed as (select o_orderkey % 97 = 3 as odd, o_orderkey % 10 = 0 as na, o_orderkey % 5 = 0 as gap, * from orders)"""
    kinds = [("o_orderkey", 0, "bigint", "integer", None), ("o_custkey", 1, "string", "integer", "odd"), ("o_totalprice", 2, "double", "number", "na"),
             ("gaps", 3, "double", "integer", "gap"), ("even", 4, "boolean", "truth", None), ("day", 5, "timestamp", "date", None),
             ("nothing", 6, "double", "missing", None), ("o_orderstatus", 7, "string", "text", None)]

    def cells_of(name, place, type_, kind_, flag):
        other = f"count_if({flag})" if flag else "0"
        own = {k: "0" for k in ("missing", "integer", "number", "truth", "date", "text")}
        own[kind_] = f"count(*) - {other}"
        if flag:
            own["text" if flag == "odd" else "missing"] = other
        return f"select '{name}' as \"column\", cast({place} as bigint) as place, " + ", ".join(
            f"cast({v} as bigint) as n_{k}" for k, v in own.items()) + f", '{type_}' as type from mixed"

    q["csv_inferred"] = f"with {mixed} " + union(cells_of(*k) for k in kinds)
    q["csv_misfits"] = f"""with {mixed}
      select 'o_custkey' as "column", 'bigint' as type, cast(o_custkey as varchar) || 'x' as cell, count(*) as n from mixed where odd group by o_custkey
      union all select 'o_orderstatus', 'boolean', o_orderstatus, count(*) from mixed group by o_orderstatus
      union all select 'o_orderkey', 'bigint', null, count(*) from mixed union all select 'o_custkey', 'bigint', null, count(*) from mixed where not odd
      union all select 'o_totalprice', 'double', null, count(*) from mixed where not na union all select 'day', 'timestamp', null, count(*) from mixed
      union all select 'o_orderstatus', 'boolean', null, 0"""
    q["csv_semicolon"] = "select * from part"
    q["csv_positions_many_files"] = "select o_orderkey as _pos, o_orderkey, o_orderstatus from orders"
    q["scorecard_sink_two_models"] = q["scorecard_long"]
    q["scorecard_files_roundtrip"] = q["scorecard_unpivot"].replace("test_name, '", "test_name as test, '")
    q["verdict_log"] = f"""with {done} select model, test, dataset, count(*) as n, count_if(passed) as n_passed,
      cast(sum(n_found) as bigint) as n_found from verdicts group by all"""

    a = completed_block("a", name_verdicts(recognition("customer", variants)))
    b = completed_block("b", row_verdicts(completion_feature("customer", variants), {NAMES["customer"]: ["c_name"]}, FIRST_LINE))
    q["serialization_grid"] = f"""with {a}, {b}, verdicts as (select * from a_verdicts union all select * from b_verdicts)
      select model, test, dataset, serialization, count(*) as n_trials, count_if(passed) as n_passed,
        cast(cast(count_if(passed) > 0 as int) as double) as value from verdicts group by model, test, dataset, serialization"""

    by_feature = completed_block("b", row_verdicts(completion_feature("customer"), {NAMES["customer"]: [COMPLETION["customer"]]}, FIRST_LINE))
    by_name = completed_block("c", name_verdicts(recognition("customer")))
    q["scorecard_rollup"] = f"""with {completed()}, cells as (
        select model, dataset, test, count(*) as t, count_if(passed) as p from verdicts group by all)
      select model, dataset, test, 3 - bit_count(grouping_id(model, dataset, test)) as level, count(*) as n_cells,
        cast(sum(t) as bigint) as n_trials, cast(sum(p) as bigint) as n_passed, round(sum(p) / sum(t), 9) as rate
      from cells group by rollup (model, dataset, test)"""
    q["scorecard_stream"] = f"""with {by_feature}, {by_name}, verdicts as (select * from b_verdicts union all select * from c_verdicts),
      {CARD} select * from card"""
    q["accuracy_table"] = f"""with {accuracy_long()}, shown as (select *, case when score in (0.0, 0.5, 1.0)
        then printf('%.2f', score) else cast(score as varchar) end as cell from acc)
      select model, category, max(case when dataset = 'customer accounts' then cell end) as Customer,
        max(case when dataset = 'customer orders' then cell end) as Orders, printf('%.2f', avg(score)) as mean
      from shown group by model, category"""
    q["mean_scores"] = f"with {accuracy_long()} select model, category, round(avg(score), 6) as score from acc group by all"
    acc_block = completed_block("z", accuracy_long())
    mem_block = completed_block("y", member_verdicts())
    q["ranking"] = f"""with {done}, {RATES}, {acc_block}, {mem_block},
      con as (select model, sum(value) / count(*) as s from rates group by model),
      mem as (select model, avg(s) / 100 as s from (select model, count_if(passed) * 100.0 / count(*) as s from y_verdicts group by model, dataset) group by model),
      mean0 as (select model, category, avg(score) as s from acc group by all),
      zero as (select model, s from mean0 where category = '0-shot'),
      one as (select model, s from mean0 where category = '1-shot')
      select con.model, round(con.s, 6) as contamination_score, con.s = (select max(s) from con) as contamination_best,
        round(mem.s, 6) as membership_score, mem.s = (select max(s) from mem) as membership_best,
        round(zero.s, 6) as "0_shot_score", zero.s = (select max(s) from zero) as "0_shot_best",
        round(one.s, 6) as "1_shot_score", one.s = (select max(s) from one) as "1_shot_best",
        dense_rank() over (order by con.s desc) as model_rank
      from con join mem using (model) join zero using (model) join one using (model)"""

    q["corpus_word_scan"] = word_scan(f"select {TURN} as key, text from conversations")
    q["corpus_word_scan_long"] = f"""with {LEXICON}, words as (
        select distinct 'benchmark' as list_name, w as value from (
          select unnest(regexp_split_to_array(text, '\\s+')) as w from benchmark) where w <> ''
        union all select feature, value from ({values('part', ['p_name', 'p_type', 'p_brand'])})),
      tagged as (select list_name, value, lower({cut_word('value')}) as w, not {in_lexicon('value')} as outside from words),
      looked as (select doc_id, list_name, outside, {word_check('w', 'lower(text)')} as hit from documents cross join tagged),
      counted as (select doc_id, list_name, count(*) as n_expected, count_if(outside) as n_out, count_if(hit) as n_hit,
        count_if(hit and outside) as n_out_hit from looked group by all)
      select doc_id, list_name, n_expected, case when n_out > 0 then n_out_hit else n_hit end as n_found,
        case when n_out > 0 then n_out_hit > 0 else n_hit = n_expected end as passed from counted
      where case when n_out > 0 then n_out_hit else n_hit end > 0"""
    q["corpus_word_scan_ids"] = q["corpus_word_scan_long"]
    q["corpus_passage_scan"] = """select doc_id, item_id as passage_id from documents d join benchmark b on contains(d.text, b.text)"""
    q["corpus_passage_scan_pages"] = """with pieces as (select distinct passage from (
        select unnest(regexp_split_to_array(text, '[.,]\\s*')) as passage from benchmark) where passage <> '')
      select page_id, md5(passage) as passage_id from pages join pieces on contains(html, passage)"""
    q["scorecard_sink_variants"] = q["serialization_grid"]
    q["labelled_files"] = q["scorecard_wide"]
    q["corpus_passage_index"] = """with pieces as (select distinct passage from (
        select unnest(regexp_split_to_array(text, '[.,]\\s*')) as passage from benchmark
        union all select text from benchmark) where passage <> '')
      select doc_id, md5(passage) as passage_id from documents join pieces on contains(text, passage)"""
    q["corpus_row_text_scan"] = f"""with rows_ as (select c_custkey, {row('customer')} as row_text from customer),
      turns as (select {TURN} as key, text from conversations),
      planted as (select key, text || chr(10) || row_text || '. End' as text from turns join rows_
        on c_custkey = {draw_int("'plant'", 'key')} % (select count(*) from customer)),
      counted as (select row_text, count(*) as n_rows from rows_ group by row_text)
      select key, row_text, n_rows from planted join counted on contains(text, row_text)"""
    q["corpus_row_text_index"] = q["corpus_row_text_scan"]
    return q
