"""Values, rows and templates as text.

All of it is built from native expressions, so a row-to-text projection stays inside
whole-stage code generation and reads only the columns it prints.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

MISSING = "nan"

# Fixed value: the tokens a CSV reader takes as missing by default.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


@dataclass(frozen=True)
class Separators:
    """How one row is written: ``{specifier}{name}{value_sep}{value}{features_sep}``."""

    features_sep: str = ", "
    value_sep: str = " is "
    specifier: str = "The "


ROW_DEFAULT = Separators()
EXEMPLAR_DEFAULT = Separators(features_sep=". ")

# The serialization variants that are compared with each other.
SERIALIZATIONS = (
    Separators(", ", " is ", "The "),
    Separators(", ", " = ", ""),
    Separators(", ", ": ", ""),
    Separators("; ", " is equal to ", "The "),
)


def normalise_missing(col: Column) -> Column:
    """Null for every token that stands for a missing value."""
    return F.when(~col.isin(*MISSING_TOKENS), col)


def _scientific(col: Column) -> Column:
    """Scientific text with the fewest digits that read back as the same double."""
    formats = F.array(*[F.lit(f"%.{digits}e") for digits in (14, 15, 16)])
    rounded = F.transform(formats, lambda f: F.call_function("format_string", f, col))
    exact = F.get(F.filter(rounded, lambda t: t.cast("double") == col), F.lit(0))
    return F.regexp_replace(F.coalesce(exact, col.cast("string")), r"\.?0*[eE]", "e")


def double_text(col: Column) -> Column:
    """A double the way Python prints it.

    Inside [1e-3, 1e7) the cast already gives that text; only the tails pay for more. Their code
    is kept short, because it is part of every projection that prints a double.
    """
    size = F.abs(col)
    text = col.cast("string")
    plain = F.regexp_replace(col.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), text)
        .when(F.isnan(col), F.lit(MISSING))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size == float("inf"), F.replace(F.lower(text), F.lit("infinity"), F.lit("inf")))
        .otherwise(_scientific(col))
    )


def value_text(col: Column, dtype: T.DataType, widen: bool = False) -> Column:
    """Text of one value. ``widen`` prints an integer column as doubles, which is how an
    integer column with missing values is held."""
    if isinstance(dtype, T.BooleanType):
        text = F.initcap(col.cast("string"))
    elif isinstance(dtype, T.FloatType):
        # the shortest text of a float is its own, not that of the double next to it
        text = double_text(col.cast("string").cast("double"))
    elif isinstance(dtype, T.DoubleType):
        text = double_text(col)
    elif isinstance(dtype, T.IntegralType) and widen:
        text = double_text(col.cast("double"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(MISSING))


def value_kind(dtype: T.DataType) -> str:
    """``string`` (looked up in the lexicon), ``bool`` (text only) or ``other``."""
    if isinstance(dtype, T.StringType):
        return "string"
    return "bool" if isinstance(dtype, T.BooleanType) else "other"


def integer_text(col: Column, dtype: T.DataType) -> Column:
    """Canonical integer form of a value that equals an integer, else null."""
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("string")
    if isinstance(dtype, T.IntegralType):
        return col.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.abs(col) < 9.0e18) & (F.floor(col) == col)
        return F.when(whole, F.when(whole, col).cast("bigint").cast("string"))
    return F.lit(None).cast("string")


def answer_text(col: Column, dtype: T.DataType, widen: bool = False) -> Column:
    """Text an answer is compared with: a whole number loses its ``.0``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.IntegralType)):
        return F.coalesce(integer_text(col, dtype), value_text(col, dtype, widen))
    return value_text(col, dtype)


def check_names(columns: Sequence[str], ignored: Sequence[str], names: Mapping[str, str]) -> None:
    """A name map must cover the printed columns exactly."""
    printed = [c for c in columns if c not in ignored]
    if names and len(names) - len(ignored) != len(printed):
        raise ValueError(
            f"name map and columns differ in length: {len(names) - len(ignored)} != {len(printed)}"
        )


def _part(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def row_text(
    df: DataFrame,
    columns: Sequence[str],
    separators: Separators = ROW_DEFAULT,
    ignored: Sequence[str] = (),
    names: Mapping[str, str] | None = None,
    remove_last_sep: bool = True,
    widened: Sequence[str] = (),
    prefix: str = "",
) -> Column:
    """One row as text.

    ``columns`` are the dataset's columns in order; ``prefix`` is put before a column name
    to find it in ``df`` (for frames that hold two rows side by side).
    """
    check_names(columns, ignored, names or {})
    schema = df.schema
    parts: list[Column] = []
    printed = [c for c in columns if c not in ignored]
    for i, name in enumerate(printed):
        shown = names[name] if names else name
        text = value_text(F.col(f"`{prefix}{name}`"), schema[prefix + name].dataType, name in widened)
        parts.append(F.lit(f"{separators.specifier}{shown}{separators.value_sep}"))
        parts.append(text)
        if not remove_last_sep or i < len(printed) - 1:
            parts.append(F.lit(separators.features_sep))
    return F.concat(*parts) if parts else F.lit("")


def text_block(order: Column, text: Column) -> Column:
    """Aggregate: the texts of a group, one per line, in the given order. The group must be
    bounded by construction (the rows shown in one prompt)."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")


def name_list(names: Column) -> Column:
    """``[a, b, c]`` from an array of names."""
    return F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]"))


def template_slots(template: str) -> list[str]:
    """Slot names of a template in order of first use."""
    found = [slot for _, slot, _, _ in string.Formatter().parse(template) if slot]
    return list(dict.fromkeys(found))


def fill_template(template: str, **slots: Column | str | None) -> Column:
    """Fill the named slots of a template. The template is split when the plan is built, so a
    value that happens to contain a slot marker is never filled again."""
    given = {k: v for k, v in slots.items() if v is not None}
    if not 1 <= len(given) <= 4:
        raise ValueError("a template takes one to four values")
    missing = [s for s in template_slots(template) if s not in given]
    if missing:
        raise ValueError(f"no value for {missing}")
    parts: list[Column] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            parts.append(_part(given[slot]))
    return F.concat(*parts)
