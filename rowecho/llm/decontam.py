"""Benchmark decontamination: windows of consecutive words of held-out items, looked for in every
window of every document.

The distinct item windows go to the executors as a hash set, in blocks of a fixed number of
rows and bytes. A document's windows are hashed, met with the set in the same stage, and a hit is
verified on its words before it counts. One pass over the documents per block, and only hits
are shuffled. Native expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.llm.common import cut, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
BLOCK_ROWS = 500_000
BLOCK_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(words: Column, size: int, n: Column) -> Column:
    """Start and hash of every run of ``size`` words."""
    starts = F.when(n >= size, F.sequence(F.lit(1), n - F.lit(size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.lit(size).alias("size"), F.xxhash64(F.slice(words, i, size)).alias("hash")))


def item_windows(items: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(hash, size, words, item_id), one row per distinct window and item."""
    worded = items.select(
        F.col(id_column).alias("item_id"), words_of(text_or_empty(text_column)).alias("words")
    ).withColumn("n", F.size("words")).filter("n > 0")
    long = worded.filter(F.col("n") >= window).select(
        "item_id", "words", F.explode(F.sequence(F.lit(1), F.col("n") - F.lit(window - 1))).alias("at"))
    long = long.select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("words"))
    short = worded.filter(F.col("n") < window).select("item_id", "words")
    return long.unionByName(short).distinct().select(
        F.xxhash64("words").alias("hash"), F.size("words").alias("size"),
        F.col("words").alias("window"), "item_id")


def blocks_of(windows: DataFrame, rows: int, most_bytes: int) -> list[DataFrame]:
    """The windows in parts that are each small enough to be sent to every executor."""
    size = F.sum(F.length(F.array_join("window", " ")).cast("bigint") * 4 + 400)
    counted = windows.agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).head()
    n = max(1, -(-counted["n"] // rows), -(-(counted["bytes"] or 0) // most_bytes))
    part = F.pmod(F.xxhash64("hash", "item_id"), F.lit(n))
    return [windows.filter(part == i) for i in range(n)]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
                  text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
                  block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    hits (array of start, size: verified occurrences), items (sorted ids as text) and text_hash.

    Null or wordless texts have no words and no hits. An item without words, and with it an
    empty benchmark, hits nothing; hits of an item with a null id count as hits and name no item. Documents repeated
    with their id give one row each. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items, window, item_id, item_text), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    worded = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_or_empty(text_column)).alias("text_hash"),
        words_of(text_or_empty(text_column)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    # the first entry meets a row that is in every block, so that every document comes through
    mark = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("hash")))
    tried = worded.withColumn("tried", F.concat(mark, *[
        windows_of(F.col("words"), s, F.col("n_words")) for s in sizes])).select(
        "doc_id", "text_hash", "n_words", "words",
        F.inline_outer("tried"))  # outer: no filter on the array is pushed below, which would split words again
    always = spark.range(1).select(
        F.lit(0).cast("bigint").alias("hash"), F.array().cast("array<string>").alias("window"),
        F.lit(None).cast(windows.schema["item_id"].dataType).alias("item_id"))

    def met(block: DataFrame) -> DataFrame:
        known = F.broadcast(block.drop("size").unionByName(always))
        verified = F.slice("words", F.greatest("start", F.lit(1)), F.col("size")) == F.col("window")
        return tried.join(known, "hash").filter(verified).groupBy("doc_id", "text_hash", "n_words").agg(
            F.count_if(F.col("size") == 0).alias("copies"),
            F.collect_set(F.when(F.col("size") > 0, F.struct("start", "size"))).alias("hits"),
            F.collect_set(F.when(F.col("size") > 0, F.col("item_id").cast("string"))).alias("items"))

    blocks = [met(b) for b in blocks_of(windows, block_rows, block_bytes)]
    found = blocks[0] if len(blocks) == 1 else reduce(DataFrame.unionByName, blocks).groupBy(
        "doc_id", "text_hash", "n_words").agg(
            F.max("copies").alias("copies"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    return found.select(
        "doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"),
        F.size(covered).cast("bigint").alias("n_hit"), F.array_sort("hits").alias("hits"),
        F.array_sort("items").alias("items"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "hits", "items", "text_hash")


def decontaminate(docs: DataFrame, items: DataFrame, how: str = "document", **options) -> DataFrame:
    """The documents without contamination: whole documents go, or (``how='span'``) only the words
    hit and the characters between them. A document repeated with its id is kept as often. Null
    texts stay. The columns are those of ``docs``."""
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    hit = cut(contamination(docs, items, **options).filter("contaminated").select(
        F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("hits").alias("_hits"),
    ).dropDuplicates(["_hit_id", "_hit_hash"]), "contaminated")
    same = F.col(id_column).eqNullSafe(F.col("_hit_id")) & (
        F.xxhash64(text_or_empty(text_column)) == F.col("_hit_hash"))
    if how == "document":
        return docs.join(hit.drop("_hits"), same, "left_anti")
    if how != "span":
        raise ValueError(f"how: 'document' or 'span', not {how!r}")
    lowered = F.translate(text_or_empty(text_column), UPPER, LOWER)
    gaps, words = F.split(lowered, WORD, -1), words_of(text_or_empty(text_column))
    lengths = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
    ends = F.aggregate(lengths, F.array(F.lit(1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut_text = F.aggregate(
        F.array_sort("_hits"), F.struct(F.lit("").alias("kept"), F.lit(1).alias("at")),
        lambda a, h: F.struct(
            F.when(F.element_at("_ends", h["start"]) + F.length(F.element_at("_gaps", h["start"])) > a["at"], F.concat(
                a["kept"], F.substr(F.col(text_column), a["at"], F.element_at("_ends", h["start"])
                                    + F.length(F.element_at("_gaps", h["start"])) - a["at"])))
            .otherwise(a["kept"]).alias("kept"),
            F.greatest(a["at"], F.element_at("_ends", h["start"] + h["size"])).alias("at")),
        lambda a: F.concat(a["kept"], F.substr(F.col(text_column), a["at"], F.length(text_column))))
    joined = docs.join(hit, same, "left").withColumns(
        {"_ends": F.when(F.col("_hits").isNotNull(), ends), "_gaps": gaps})
    return joined.select(*[
        F.when(F.col("_hits").isNotNull(), cut_text).otherwise(F.col(c)).alias(c) if c == text_column else F.col(c)
        for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        "hits", "items", "text_hash")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, w[s:s + k - 1] AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
             FROM d, (SELECT DISTINCT len(win) AS k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM dw JOIN iw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
