"""Complete runs: all probes of a set of datasets, from probes to scorecard."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from rowecho.functions.text import SERIALIZATIONS
from rowecho.operators.decide import decide_all, join_responses
from rowecho.operators.profile import feature_list, feature_values, value_lists
from rowecho.operators.score import scorecard
from rowecho.plans import probes as P
from rowecho.sources.catalog import Dataset
from rowecho.sources.lexicon import tag_lexicon
from rowecho.sources.lineage import cut_lineage

MAX_INLINE_VALUES = 1000  # values that travel with a probe; longer lists are decided by ``value_words``


def value_words(ds: Dataset, lexicon: DataFrame) -> DataFrame:
    """(dataset, feature, value, kind, in_lexicon, ...): the values the dataset's probes ask for, one row each.
    Lists too long to travel with a probe are decided by them (``run``)."""
    return cut_lineage(tag_lexicon(feature_values(ds, ds.spec.value_features), lexicon))


def _lists(ds: Dataset, lexicon: DataFrame, limit: int) -> DataFrame:
    """Expected value lists, written once: every value probe of the dataset reads them."""
    return cut_lineage(value_lists(value_words(ds, lexicon), limit))


def dataset_probes(ds: Dataset, lexicon: DataFrame, n_membership: int | None = 100,
                   max_inline_values: int = MAX_INLINE_VALUES) -> DataFrame:
    """All probes of one dataset, in the sizes of the standard run. ``lexicon`` is read by several
    parts, so it should be a table."""
    features = feature_list(ds)
    parts = [
        P.features_uninformed(ds, features, lexicon),
        P.features_informed(ds, features, lexicon, n_given=5, n_repeat=3),
        P.features_reverse(ds, features),
        P.completion_incomplete(ds, n_removed=3, n_given=4),
        P.completion_full(ds, n_given=4),
        P.recognition(ds, n_given=5),
        P.membership(ds, n_membership),
    ]
    if ds.spec.value_features and not P.skipped(ds, "feature_values_uninf"):
        lists = _lists(ds, lexicon, max_inline_values)
        parts.append(P.values_uninformed(ds, lists))
        parts.append(P.values_from_examples(ds, lists, ds.spec.value_features, 3, "random"))
    if ds.spec.completion_feature and not P.skipped(ds, "feature_completion"):
        parts.append(P.completion_feature(ds, ds.spec.completion_feature, 5))
    return reduce(DataFrame.unionByName, parts)


def all_probes(datasets: Iterable[Dataset], lexicon: DataFrame,
               n_membership: int | None = 100) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        dataset_probes(ds, lexicon, n_membership) for ds in datasets
    ])


def serialization_probes(ds: Dataset, lexicon: DataFrame) -> DataFrame:
    """The tests that show rows, in every serialization variant from the same scan."""
    variants = tuple(enumerate(SERIALIZATIONS))
    parts = [
        P.completion_incomplete(ds, trials=ds.df.sparkSession.range(1).withColumnRenamed("id", "trial"),
                                n_given=4, variants=variants, test="incomplete_completion"),
        P.completion_full(ds, n_given=4, variants=variants),
        P.recognition(ds, n_given=5, variants=variants),
    ]
    if ds.spec.value_features and not P.skipped(ds, "feature_values_inf"):
        parts.append(P.values_from_examples(
            ds, _lists(ds, lexicon, MAX_INLINE_VALUES), ds.spec.value_features, 3, variants=variants))
    if ds.spec.completion_feature and not P.skipped(ds, "feature_completion"):
        parts.append(P.completion_feature(ds, ds.spec.completion_feature, 5, variants=variants))
    return reduce(DataFrame.unionByName, parts)


def classification_probes(ds: Dataset, n_tests: int | None = 100) -> DataFrame:
    return P.classification(ds, n_tests).unionByName(P.classification(ds, n_tests, shots=True))


def run(probes: DataFrame, responses: DataFrame, models: Sequence[str],
        echoing: Sequence[str] = (), by_serialization: bool = False,
        words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, scorecard). ``words`` (``value_words`` of the datasets, together) is needed where a feature
    has more values than travel with a probe."""
    verdicts = decide_all(join_responses(probes, responses, models, echoing), words)
    return verdicts, scorecard(verdicts, ("serialization",) if by_serialization else ())
