"""Dataset catalog: names, files, schemas, post-steps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowecho.functions.text import normalise_missing
from rowecho.operators.rows import drop_columns, keep_first
from rowecho.plans import templates
from rowecho.sources.positions import POS, seeded_shuffle, with_positions


@dataclass(frozen=True)
class Task:
    """How a dataset's target is asked for and judged.

    rule: ``yes_no`` (positive / negative label, or ``threshold``: at least -> Yes),
    ``class_name`` (the label is named in the answer) or ``class_digit`` (``class_`` + answer
    holds the label).
    """

    rule: str
    question: str
    answers: str = templates.ANSWERS_YES_NO
    exemplar_question: str | None = None
    positive: str | None = None
    negative: str | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    alias: str
    display: str
    path: str
    columns: tuple[tuple[str, str], ...]
    format: str = "csv"
    options: Mapping[str, str] = field(default_factory=lambda: {"header": "true"})
    drop: tuple[str, ...] = ()
    dedup_on: tuple[str, ...] = ()
    shuffle_seed: int | None = None
    pos_key: str | None = None
    decode: tuple[str, tuple[str, ...]] | None = None
    target: str | None = None
    task: Task | None = None
    id_features: tuple[str, ...] = ()
    value_features: tuple[str, ...] = ()
    skip_given_features: tuple[str, ...] = ()
    completion_feature: str | None = None
    case_sensitive_name: bool = False

    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(n, T._parse_datatype_string(t)) for n, t in self.columns]
        )


@dataclass(frozen=True)
class Dataset:
    """A loaded dataset: its rows with ``_pos``, and its ordered column names. With ``probe_partitions`` rows are dealt out by the id of their
    probe, as a table of probes in as many buckets is, while they are narrow: before they become text."""

    spec: DatasetSpec
    df: DataFrame
    columns: tuple[str, ...]
    widened: tuple[str, ...] = ()
    probe_partitions: int | None = None

    @property
    def name(self) -> str:
        return self.spec.name

    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType


def _typed(*groups: str) -> tuple[tuple[str, str], ...]:
    """``"int: a, b"`` -> (("a", "int"), ("b", "int"))."""
    out = []
    for group in groups:
        dtype, names = group.split(":", 1)
        out.extend((n.strip(), dtype.strip()) for n in names.split(","))
    return tuple(out)


def _yes_no(name: str, positive: str | None = None, negative: str | None = None,
            threshold: float | None = None) -> Task:
    return Task("yes_no", templates.QUESTIONS[name], templates.ANSWERS_YES_NO,
                templates.EXEMPLAR_QUESTIONS.get(name), positive, negative, threshold)


# The public datasets under study, with their columns in file order.
PUBLIC_DATASETS = (
    DatasetSpec(
        "adult income", "adult", "Adult", "adult_v2.csv",
        _typed("int: age", "string: workclass", "int: fnlwgt", "string: education",
               "int: education.num",
               "string: marital.status, occupation, relationship, race, sex",
               "int: capital.gain, capital.loss, hours.per.week",
               "string: native.country, income"),
        target="income", task=_yes_no("adult income", ">50K", "<=50K"),
        value_features=("income", "marital.status"), completion_feature="fnlwgt"),
    DatasetSpec(
        "bank marketing", "bank", "Bank", "bank.csv",
        _typed("int: age", "string: job, marital, education, default", "int: balance",
               "string: housing, loan, contact", "int: day", "string: month",
               "int: duration, campaign, pdays, previous", "string: poutcome, y"),
        target="y", task=_yes_no("bank marketing", "yes", "no"),
        value_features=("y", "job"), completion_feature="balance"),
    DatasetSpec(
        "berkeley admissions", "berkeley", "Berkeley", "berkeley.csv",
        _typed("int: Year", "string: Major, Gender, Admission"),
        target="Admission", task=_yes_no("berkeley admissions", "Accepted", "Rejected"),
        value_features=("Admission", "Major")),
    DatasetSpec(
        "german credit", "german", "German", "german.csv",
        _typed("int: _row", "int: Age", "string: Sex",
               "int: Job", "string: Housing, Saving accounts, Checking account",
               "int: Credit amount, Duration", "string: Purpose, Risk"),
        drop=("_row",), target="Risk", task=_yes_no("german credit", "good", "bad"),
        value_features=("Risk", "Saving accounts"), completion_feature="Credit amount"),
    DatasetSpec(
        "california housing", "housing", "Housing", "housing.csv",
        _typed("double: longitude, latitude, housing_median_age, total_rooms, total_bedrooms, "
               "population, households, median_income, median_house_value",
               "string: ocean_proximity"),
        target="median_house_value", task=_yes_no("california housing", threshold=179700.0),
        value_features=("ocean_proximity",), completion_feature="median_house_value"),
    DatasetSpec(
        "iris", "iris", "Iris", "iris.csv",
        _typed("double: sepal length (cm), sepal width (cm), petal length (cm), petal width (cm)",
               "int: target"),
        decode=("target", ("setosa", "versicolor", "virginica")), shuffle_seed=0,
        target="target",
        task=Task("class_name", templates.QUESTIONS["iris"], templates.ANSWERS_IRIS),
        value_features=("target",), completion_feature="sepal length (cm)"),
    DatasetSpec(
        "wine", "wine", "Wine", "wine.csv",
        _typed("double: alcohol, malic_acid, ash, alcalinity_of_ash, magnesium, total_phenols, "
               "flavanoids, nonflavanoid_phenols, proanthocyanins, color_intensity, hue, "
               "od280/od315_of_diluted_wines, proline", "int: target"),
        decode=("target", ("class_0", "class_1", "class_2")), shuffle_seed=0,
        target="target",
        task=Task("class_digit", templates.QUESTIONS["wine"], templates.ANSWERS_WINE),
        completion_feature="target"),
    DatasetSpec(
        "titanic", "titanic", "Titanic", "titanic/titanic_train.csv",
        _typed("int: PassengerId, Survived, Pclass", "string: Name, Sex", "double: Age",
               "int: SibSp, Parch", "string: Ticket", "double: Fare", "string: Cabin, Embarked"),
        options={"header": "true", "escape": '"'},
        target="Survived", task=_yes_no("titanic", "1", "0"),
        value_features=("Embarked",), completion_feature="PassengerId"),
    DatasetSpec(
        "spaceship_titanic", "spaceship_titanic", "Sp. Titanic",
        "spaceship_titanic/spaceship_titanic_train.csv",
        _typed("string: PassengerId, HomePlanet", "boolean: CryoSleep",
               "string: Cabin, Destination", "double: Age", "boolean: VIP",
               "double: RoomService, FoodCourt, ShoppingMall, Spa, VRDeck",
               "string: Name", "boolean: Transported"),
        target="Transported", task=_yes_no("spaceship_titanic", "True", "False"),
        id_features=("PassengerId",), value_features=("Transported", "Destination"),
        skip_given_features=("Transported", "HomePlanet"), completion_feature="PassengerId"),
    DatasetSpec(
        "thyroid disease recurrence", "thyroid_diff", "Thyroid_Diff", "Thyroid_Diff.csv",
        _typed("int: Age", "string: Gender, Smoking, Hx Smoking, Hx Radiothreapy, "
               "Thyroid Function, Physical Examination, Adenopathy, Pathology, Focality, Risk, "
               "T, N, M, Stage, Response, Recurred"),
        shuffle_seed=0, target="Recurred", task=_yes_no("thyroid disease recurrence", "Yes", "No"),
        value_features=("Adenopathy", "Response"), completion_feature="Age"),
    DatasetSpec(
        "MathE", "MathE", "MathE", "MathE.csv",
        _typed("int: Student ID", "string: Student Country", "int: Question ID, Type of Answer",
               "string: Question Level, Topic, Subtopic, Keywords"),
        options={"header": "true", "sep": ";"},
        dedup_on=("Student Country", "Question ID", "Type of Answer", "Question Level", "Topic",
                  "Subtopic", "Keywords"),
        shuffle_seed=0, id_features=("Student ID",), value_features=("Question Level", "Topic"),
        completion_feature="Student ID", case_sensitive_name=True),
)

# Datasets that take no part in a test, whatever their columns.
SKIPPED = {
    "feature_values_uninf": ("wine",),
    "feature_values_inf": ("wine",),
    "feature_completion": ("berkeley admissions",),
}


def find_spec(name: str, registry: Iterable[DatasetSpec] = PUBLIC_DATASETS) -> DatasetSpec:
    """Spec by long or short name; an unknown name is an error."""
    for spec in registry:
        if name in (spec.name, spec.alias):
            return spec
    raise ValueError(f"unknown dataset: {name}")


def read_table(spark: SparkSession, spec: DatasetSpec, root: str) -> DataFrame:
    """The file as it is, with the spec's types (no inference pass). Columns are found by the header,
    in whatever order; only a blank first header goes by its place. A column the header lacks is
    an error."""
    path = f"{root.rstrip('/')}/{spec.path}"
    if spec.format != "csv":
        return spark.read.format(spec.format).load(path)
    if spec.options.get("header") != "true":
        raw = spark.read.options(**spec.options).schema(spec.schema()).csv(path)
    else:
        raw = spark.read.options(**{"inferSchema": "false", **spec.options}).csv(path)
        wanted = spec.schema()
        if raw.columns[0] == "_c0" and wanted.names[0] not in raw.columns:
            raw = raw.withColumnRenamed("_c0", wanted.names[0])
        if lacking := [n for n in wanted.names if n not in raw.columns]:
            raise ValueError(f"{path} has no column {', '.join(lacking)}")
        raw = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
    text = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    return raw.withColumns({c: normalise_missing(F.col(f"`{c}`")) for c in text})


def decode_index(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Replace a class index by its name; an index without a name becomes null."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.withColumn(column, F.get(labels, F.col(f"`{column}`").cast("int")))


def decode_by_table(df: DataFrame, index: str, labels: DataFrame, label_index: str) -> DataFrame:
    """The same with the names in a table: a left join that Spark broadcasts when the label table
    is small."""
    return df.join(labels, df[index] == labels[label_index], "left").drop(label_index)


def prepare(df: DataFrame, spec: DatasetSpec, widened: tuple[str, ...] = (),
            positions: bool = True) -> Dataset:
    """Post-steps in the spec's order: positions, drop, decode, de-duplicate, shuffle.

    Jobs that take rows as they come can do without positions (``positions=False``), which saves
    the counting pass of datasets that have no position key.
    """
    if positions or spec.dedup_on or spec.shuffle_seed is not None:
        df = with_positions(df, spec.pos_key)
    df = drop_columns(df, spec.drop)
    if spec.decode:
        df = decode_index(df, *spec.decode)
    if spec.dedup_on:
        df = keep_first(df, spec.dedup_on)
    if spec.shuffle_seed is not None:
        df = seeded_shuffle(df, spec.shuffle_seed)
    columns = tuple(c for c in df.columns if c != POS)
    return Dataset(spec, df, columns, widened)


def spread(df: DataFrame, min_partitions: int, scan: DataFrame | None = None) -> DataFrame:
    """Repartition what comes from a scan of fewer partitions than that: a few files without splits would
    keep the other cores idle while rows become text. A scan with enough splits stays as it is.
    ``scan`` is the bare scan under ``df``: counting its partitions runs nothing."""
    few = (df if scan is None else scan).rdd.getNumPartitions() < min_partitions
    return df.repartition(min_partitions) if few else df


def load_dataset(
    spark: SparkSession,
    name: str,
    root: str,
    registry: Iterable[DatasetSpec] = PUBLIC_DATASETS,
    widen_integers: bool = False,
    min_partitions: int | None = None,
    positions: bool = True,
) -> Dataset:
    """Load a dataset by its long or short name.

    With ``widen_integers`` one aggregate finds the integer columns that hold missing values;
    their text form is that of doubles. ``min_partitions`` spreads a scan of few splits.
    """
    spec = find_spec(name, registry)
    df = read_table(spark, spec, root)
    widened: tuple[str, ...] = ()
    if widen_integers:
        integers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
        if integers:
            flags = df.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(c) for c in integers])
            widened = tuple(c for c, has_null in flags.first().asDict().items() if has_null)
    ds = prepare(df, spec, widened, positions)
    return ds if min_partitions is None else replace(ds, df=spread(ds.df, min_partitions, df))
