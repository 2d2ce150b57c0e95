"""Altered rows: swapped columns and replaced values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowecho.functions.draws import draw_int, draw_key, draw_position
from rowecho.functions.text import MISSING, value_text
from rowecho.operators.members import tag_members
from rowecho.operators.profile import varying_columns
from rowecho.operators.rows import column
from rowecho.sources.catalog import Dataset
from rowecho.sources.lineage import cut_lineage
from rowecho.sources.positions import POS

TRIES_PER_PASS = 4, 1024  # at least and at most, after the first try
BUCKET_DIGITS = 4  # 65,536 hash buckets
CHUNKS = 1 << 16  # parts of a column's rows in which a draw looks for its value


def swap_values(values: Column, n_columns: int, n_swaps: int, seed: int | str, key: Column) -> Column:
    """Swap two entries of an ``array<string>`` row, ``n_swaps`` times, no pair twice."""
    pairs = list(combinations(range(n_columns), 2))
    if n_swaps > len(pairs):
        raise ValueError(f"{n_columns} columns have only {len(pairs)} pairs")
    first = F.array(*[F.lit(a) for a, _ in pairs])
    second = F.array(*[F.lit(b) for _, b in pairs])
    left = F.sequence(F.lit(0), F.lit(len(pairs) - 1))
    for i in range(n_swaps):
        pick = F.get(left, F.pmod(draw_int(seed, key, i), F.size(left)).cast("int"))
        left = F.array_remove(left, pick)
        values = _swap(values, F.get(first, pick), F.get(second, pick))
    return values


def _swap(row: Column, a: Column, b: Column) -> Column:
    return F.transform(
        row, lambda x, at: F.when(at == a, F.get(row, b)).when(at == b, F.get(row, a)).otherwise(x)
    )


def swap_columns(ds: Dataset, n_swaps: int = 2, seed: int | str = 0) -> DataFrame:
    """Every row as an array of texts with ``n_swaps`` column pairs swapped."""
    texts = F.array(*[value_text(column(c), ds.dtype(c), c in ds.widened) for c in ds.columns])
    rows = ds.df.select(POS, texts.alias("original"))
    return rows.withColumn(
        "swapped", swap_values(F.col("original"), len(ds.columns), n_swaps, seed, F.col(POS))
    )


def swap_count(n_wanted: int, n_usable: int) -> int:
    """More columns wanted than usable: two fewer than usable, at least one."""
    return n_wanted if n_wanted <= n_usable else max(n_usable - 2, 1)


def _value_ranges(ds: Dataset, usable: Sequence[str]) -> DataFrame:
    """(_feature, _text, _n, _first, _off): the values of each column, how many rows hold them, the first of
    these, and how many rows hold values before it in the order of their hashes.

    Offsets come without a global sort: hashes are even, so their leading hex digits cut the
    values into buckets, and a value's offset is its bucket's plus that inside the bucket.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("_feature"), value_text(column(c), ds.dtype(c)).alias("_text")) for c in usable
    ])
    counted = ds.df.select(POS, F.inline(cells)).groupBy("_feature", "_text").agg(
        F.count("*").alias("_n"), F.min(POS).alias("_first"))
    counted = cut_lineage(counted.withColumn("_hash", F.md5("_text")).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)))
    # at most 65,536 rows for each column
    sums = counted.groupBy("_feature", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("_feature").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_feature", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_feature", "_bucket").orderBy("_hash", "_text").rowsBetween(
        Window.unboundedPreceding, -1)
    return counted.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        F.broadcast(sums), ["_feature", "_bucket"]
    ).select("_feature", "_text", "_n", "_first", (F.col("_start") + F.col("_inside")).alias("_off"))


def _chosen(ds: Dataset, usable: Sequence[str], k: int | Column, seed) -> Column:
    """The k columns a row takes new values in."""
    choices = F.array_sort(F.array(*[
        F.struct(draw_key(seed, F.col(POS), c).alias("k"), F.lit(c).alias("f")) for c in usable
    ]))
    return F.transform(F.slice(choices, F.lit(1), k if isinstance(k, Column) else F.lit(k)), lambda x: x["f"])


def _text_of(feature: Column, ds: Dataset, usable: Sequence[str]) -> Column:
    out = F.lit(None).cast("string")
    for c in usable:
        out = F.when(feature == c, value_text(column(c), ds.dtype(c))).otherwise(out)
    return out


def _redraw(rows: DataFrame, ids: Sequence[str], ds: Dataset, usable: Sequence[str], n_rows: int,
            ranges: DataFrame, seed, tries: range) -> DataFrame:
    """Altered copies of each row, one per try: k random usable columns take observed values, as
    often as the column holds them; the first try only takes values that differ from the row's, further
    tries may leave a cell and change the others.

    A draw is the position of a donor row. Where the donor of a first try has the cell's own value, the cell is
    drawn anew from the rows with other values: all rows lie one after another by value, and the draw
    steps over the range of the own one. So every cell takes one draw or two, whatever its share.
    """
    each = rows.withColumn("_try", F.explode(F.sequence(F.lit(tries.start), F.lit(tries.stop - 1))))
    each = each.withColumn("_chosen", _chosen(ds, usable, F.col("_k"), seed))
    key = [*ids, "_try", "_feature"]
    drawn_from = seed if isinstance(seed, str | int) else F.col("_seed")
    asked = each.select(
        *ids, "_try", *([] if isinstance(seed, str | int) else [seed.alias("_seed")]), F.explode("_chosen").alias("_feature"),
        *[column(c) for c in usable])
    asked = asked.withColumn("_current", _text_of(F.col("_feature"), ds, usable)).drop(*usable).withColumn(
        "_donor", draw_position(F.lit(n_rows), drawn_from, F.col(POS), F.col("_feature"), F.col("_try")))
    donors = ds.df.select(F.col(POS).alias("_donor"), *[column(c) for c in usable])
    met = asked.join(donors, "_donor")
    own = (F.col("_try") == 0) & (_text_of(F.col("_feature"), ds, usable) == F.col("_current"))

    width = -(-n_rows // CHUNKS)
    left = met.filter(own).select(*key, "_current", *([] if isinstance(seed, str | int) else ["_seed"]))
    current = ranges.select("_feature", F.col("_text").alias("_current"), F.col("_n").alias("_n_own"),
                            F.col("_off").alias("_off_own"))
    other = draw_int(drawn_from, F.col(POS), F.col("_feature"), F.col("_try"), "other")
    left = left.join(current, ["_feature", "_current"]).withColumn(
        "_at", F.pmod(other, F.lit(n_rows) - F.col("_n_own"))).withColumn(
        "_at", F.when(F.col("_at") < F.col("_off_own"), F.col("_at")).otherwise(F.col("_at") + F.col("_n_own")))
    chunks = ranges.withColumn("_chunk", F.explode(F.sequence(
        F.floor(F.col("_off") / width), F.floor((F.col("_off") + F.col("_n") - 1) / width))))
    placed = left.withColumn("_chunk", F.floor(F.col("_at") / width)).join(
        chunks.select("_feature", "_chunk", "_off", "_n", F.col("_first").alias("_donor")), ["_feature", "_chunk"]
    ).filter((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_n")))
    new = met.filter(~own).select(*key, *usable).unionByName(
        placed.select(*key, "_donor").join(donors, "_donor").select(*key, *[column(c) for c in usable]))
    found = new.groupBy(*ids, "_try").agg(*[
        F.min(F.when(F.col("_feature") == c, F.struct(column(c).alias("v")))).alias(f"_n{i}")
        for i, c in enumerate(usable)
    ])
    index = {c: i for i, c in enumerate(usable)}
    marked = each.join(found, [*ids, "_try"])
    return marked.select(*ids, "_try", *[
        F.when(F.array_contains("_chosen", c), F.col(f"_n{index[c]}")["v"]).otherwise(column(c)).alias(c)
        if c in index else column(c) for c in ds.columns])


def _tries(start: int, n_pending: int, n_rows: int) -> range:
    """The next tries of each pending row: the fewer rows, the more tries, so no pass has many more rows than the dataset. A row gets the
    first try that is new, however the tries are cut into passes."""
    least, most = TRIES_PER_PASS
    return range(start, start + min(max(n_rows // max(n_pending, 1), least), most))


def _full(pending: DataFrame, ids: Sequence[str], ds: Dataset, usable: Sequence[str], texts: dict[str, int], n_rows: int, seed) -> DataFrame | None:
    """The pending rows (ids) whose chosen columns have no new combination: the dataset holds all that these can take beside the
    row's other values. None where no row can be such.

    A dataset holds all combinations of some columns only if they are at most as many as its rows, so wide columns are not looked at.
    The others meet the dataset on the values that stay, and what is counted there is different combinations.
    """
    asked = pending.select(*ids, *[column(c) for c in ds.columns], F.array_sort(_chosen(ds, usable, F.col("_k"), seed)).alias("_set"))
    found = []
    for row in asked.select("_set").distinct().collect():  # sets of columns, as many as a table's width gives
        chosen = row["_set"]
        if prod(texts[c] - 1 for c in chosen) > n_rows:  # values may be one fewer than texts: zeros of both signs
            continue
        values = ds.df.agg(*[F.count_distinct(F.struct(column(c))) for c in chosen]).first()
        others = F.struct(F.lit(0), *[column(c) for c in ds.columns if c not in chosen]).alias("_others")
        mine = asked.filter(F.col("_set") == F.array(*[F.lit(c) for c in chosen])).select(*ids, others)
        held = ds.df.select(others, F.struct(*[column(c) for c in chosen]).alias("_cells")).join(
            mine.select("_others").distinct(), "_others", "left_semi").distinct().groupBy("_others").agg(F.count("*").alias("_held"))
        found.append(mine.join(held.filter(F.col("_held") >= prod(values)), "_others", "left_semi").select(*ids))
    return cut_lineage(reduce(DataFrame.unionByName, found)) if found else None


def _widened(pending: DataFrame, ids: Sequence[str], ds: Dataset, usable: Sequence[str], ranges: DataFrame, n_rows: int, k: int, seed,
             keep_stuck: bool) -> tuple[DataFrame, DataFrame | None]:
    """The pending rows with the number of columns they need: a row whose chosen columns have no new combination takes the next one of
    its order too, and so on. Rows that have none in all their columns are an error, or with ``keep_stuck`` the second frame."""
    texts = {r["_feature"]: r["n"] for r in ranges.groupBy("_feature").agg(F.count("*").alias("n")).collect()}
    for n in range(k, len(usable) + 1):
        full = _full(pending.filter(F.col("_k") == n), ids, ds, usable, texts, n_rows, seed)
        stuck = None if full is None else full.first()
        if stuck is None:
            break
        if n == len(usable):
            if not keep_stuck:
                raise ValueError(f"row {stuck[POS]}: the dataset holds every combination of {', '.join(usable)}")
            return pending.join(full, ids, "left_anti"), pending.join(full, ids, "left_semi")
        more = full.withColumn("_more", F.lit(1))
        pending = cut_lineage(pending.join(more, ids, "left").withColumn("_k", F.col("_k") + F.coalesce("_more", F.lit(0))).drop("_more"))
    return pending, None


def replace_values(ds: Dataset, n_swapped: int, seed: int | str, rows: DataFrame | None = None,
                   parity: bool = False, keep_stuck: bool = False) -> DataFrame:
    """Altered copies of ``rows`` (default: the whole dataset) that are not rows of the dataset.

    Nearly all rows are done after one try; a row whose altered copy is in the dataset gets the
    first of further tries that is not, however many it takes. A row whose columns have no new combination beside its other
    values takes further columns until there is one; a row that has none at all is an error, or with ``keep_stuck=True``
    comes back unchanged with ``altered`` false. Each pass is written once, so the next one reads the copy and not the whole history. A ``_role`` column of ``rows`` is kept and is part of the seed, so that several sets of
    rows are altered in one go. ``parity=True`` gives rows with a missing value back unchanged,
    with ``altered`` false.
    """
    usable, n_rows, _ = varying_columns(ds)
    if not usable:
        raise ValueError("every column holds a single value")
    k = swap_count(n_swapped, len(usable))
    cells = [column(c) for c in ds.columns]
    pending = rows if rows is not None else ds.df
    ids = [POS, "_role"] if "_role" in pending.columns else [POS]
    if len(ids) > 1:
        seed = F.concat(F.lit(f"{seed}|"), F.col("_role"))
    pending = pending.select(*ids, *cells)
    ranges = cut_lineage(_value_ranges(ds, usable))
    done = []
    if parity:
        missing = reduce(lambda a, b: a | b, [
            (value_text(column(c), ds.dtype(c)) == MISSING) for c in ds.columns
        ])
        done.append(pending.filter(missing).withColumn("altered", F.lit(False)))
        pending = pending.filter(~missing)
    pending = pending.withColumn("_k", F.lit(k))
    tries = range(0, 1)
    while True:
        i = tries.start
        drawn = _redraw(pending, ids, ds, usable, n_rows, ranges, seed, tries)
        if i:
            drawn = cut_lineage(drawn)  # few rows: they are sent to the dataset, not the reverse
        tagged = cut_lineage(tag_members(drawn, ds.df, ds.columns, few=i > 0))
        new = tagged.filter(~F.col("is_member"))
        if i:
            first = Window.partitionBy(*ids).orderBy("_try")
            new = new.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
        done.append(new.select(*ids, *cells, F.lit(True).alias("altered")))
        left = tagged.filter("is_member")
        if i:
            left = tagged.groupBy(*ids).agg(F.bool_and("is_member").alias("_left")).filter("_left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        pending = cut_lineage(pending.join(left.select(*ids), ids, "left_semi"))
        if not i:
            pending, stuck = _widened(pending, ids, ds, usable, ranges, n_rows, k, seed, keep_stuck)
            if stuck is not None:
                done.append(stuck.select(*ids, *cells, F.lit(False).alias("altered")))
        n_pending = pending.count()
        if not n_pending:
            return reduce(DataFrame.unionByName, done)
        tries = _tries(tries.stop, n_pending, n_rows)
