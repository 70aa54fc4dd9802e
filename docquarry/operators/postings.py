"""A stored inverted index, and batches of keyword queries answered by BM25 from it alone.

Documents fall into blocks by a hash of their key. A row of the index is a term in a block: how many of
the block's documents have it, the most that one of them gains by it, and the list of those documents. The
rows lie by bucket of their term, sorted by term, so a batch of queries opens the buckets of its words and
skips the rest of them.

A search first reads what is known of the blocks, not their lists: the sum of the most its words can gain
in a block bounds every score there. The blocks with the highest bounds are scored first, and the k-th best
score found in them rules out all blocks whose bound is lower.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import terms
from docquarry.session import shared_path

K1, B = 1.2, 0.75
#: Documents of a block, on average: the longest list is a little longer.
BLOCK = 4_096
BUCKETS = 64
#: Blocks that are scored first for each query.
FIRST = 4
SCORE_DIGITS = 6


@dataclass
class Postings:
    """The stored index: ``postings`` (bucket, term, block, n, most, list), and the collection's size and mean length."""

    postings: DataFrame
    documents: int
    mean_length: float


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def gain(count: Column, length: Column, mean_length: float) -> Column:
    """What a document of a length gains by a term that it has so often, but for the term's rarity."""
    norm = F.lit(1 - B) + F.lit(B) * length / F.lit(mean_length)
    return count * (K1 + 1) / (count + K1 * norm)


def terms_with_counts(found: str) -> Column:
    """array<struct<term, count>> of a row's terms: sorted once, then cut where the next one differs."""

    def cut(ordered: Column) -> Column:
        last = lambda t, i: F.coalesce(F.get(ordered, i + 1) != t, F.lit(True))
        ends = F.filter(F.transform(ordered, lambda t, i: F.when(last(t, i), i)), lambda i: i.isNotNull())

        def counted(e: Column) -> Column:
            before = lambda n: F.when(n > 0, F.get(e, n - 1)).otherwise(-1)
            return F.transform(e, lambda i, n: F.struct(F.get(ordered, i).alias("term"), (i - before(n)).alias("count")))

        return F.transform(F.array(ends), counted)[0]

    return F.transform(F.array(F.array_sort(found)), cut)[0]


def build_postings(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> Postings:
    """Stores the index of ``documents`` (unique ``key``); each text is read and cut once.

    A null or wordless text counts among the documents, with length 0, and is in no list. A term that
    every document has is one row for each block, so no list and no task holds it whole.
    """
    spark = documents.sparkSession
    counted = documents.select(F.col(key).alias("key"), F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("found"))
    rows = counted.select("key", F.size("found").alias("length"), terms_with_counts("found").alias("terms"))
    rows.write.parquet(f"{path}/counted")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/counted")
    totals = stored.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length")).first()
    n, mean_length = totals["documents"], totals["mean_length"] or 1.0
    blocks = max(1, -(-n // block))
    place = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    posted = stored.select("key", "length", place.alias("block"), F.inline("terms"))
    gained = gain(F.col("count"), F.col("length"), mean_length)
    # dealt out once, as the lists will lie: a bucket's blocks over several tasks
    slices = max(4, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    dealt = posted.select("key", "term", "block", gained.alias("gain"), bucket_of(F.col("term")).alias("bucket"),
                          F.pmod("block", F.lit(slices)).alias("slice")).repartition("bucket", "slice")
    lists = dealt.groupBy("bucket", "slice", "term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("gain").alias("most"), F.sort_array(F.collect_list(F.struct("key", "gain"))).alias("list")
    ).select("term", "block", "n", "most", "list", "bucket")
    lists.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(n, float(mean_length))], "documents bigint, mean_length double").write.parquet(f"{path}/totals")
    return read_postings(spark, path, lists)


def read_postings(spark: SparkSession, path: str, like: DataFrame | None = None) -> Postings:
    """A stored index. That of no words has no files, so what it is like is needed."""
    totals = spark.read.parquet(f"{path}/totals").first()
    try:
        rows = spark.read.parquet(f"{path}/postings")
    except AnalysisException as error:
        if like is None or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        rows = spark.createDataFrame([], like.schema)
    return Postings(rows, totals["documents"], totals["mean_length"])


def query_terms(queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """(query, at, term): the different words of each query, counted in their order. A wordless query has none."""
    words = F.array_distinct(terms(F.col(text)))
    return queries.select(F.col(query_key).alias("query"), F.posexplode(words).alias("at", "term"))


def _scored(parts: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, key, score) of all documents of some blocks (query, block), in the lists of the queries' words.

    A document lies in one block, so the lists of the words asked are moved once, by block, however many
    queries ask for them, and what their documents gain is added up where they then are.
    """
    wanted = parts.groupBy("block").agg(F.collect_set("query").alias("queries"))
    words = asked.select("bucket", "term").distinct()
    lists = postings.select("bucket", "term", "block", "list").join(words, ["bucket", "term"], "left_semi")
    met = lists.join(wanted.hint("shuffle_merge"), "block").join(asked, ["bucket", "term"]).where(F.array_contains("queries", F.col("query")))
    gained = met.select("block", "query", "at", "rarity", F.inline("list"))
    # added in the order of the query's words, so that equal documents score equally
    each = F.array_sort(F.collect_list(F.struct("at", (F.col("rarity") * F.col("gain")).alias("part"))))
    total = F.aggregate(each, F.lit(0.0), lambda s, p: s + p["part"])
    return gained.groupBy("block", "query", "key").agg(F.round(total, SCORE_DIGITS).alias("score")).drop("block")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_postings(
    queries: DataFrame, index: Postings, k: int, query_key: str = "query_id", text: str = "text", key: str = "doc_id", first: int = FIRST,
) -> DataFrame:
    """The ``k`` best documents for each query, by BM25: query, ``rank``, document, ``score`` to six digits.

    Ties go to the smaller document. No text is read, and of the lists only those of blocks that may
    hold a hit. A word counts once in a query, however often it stands there. A query without a known
    word has no rows. Runs two jobs here: the blocks' bounds, and the first blocks' scores.
    """
    spark, path = queries.sparkSession, shared_path(queries.sparkSession, "bounds")
    words = query_terms(queries, query_key, text).withColumn("bucket", bucket_of(F.col("term")))
    words.write.parquet(f"{path}/words")
    words = spark.read.schema(words.schema).parquet(f"{path}/words")
    met = [r[0] for r in words.select("bucket").distinct().collect()]  # BUCKETS at most
    postings = index.postings.where(F.col("bucket").isin(met))
    known = postings.select("bucket", "term", "block", "n", "most").join(words.select("bucket", "term").distinct(), ["bucket", "term"])
    often = known.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    rarity = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = words.join(often.withColumn("rarity", rarity).drop("df"), ["bucket", "term"])
    bounds = known.drop("n").join(asked, ["bucket", "term"]).groupBy("query", "block").agg(
        F.sum(F.col("rarity") * F.col("most")).alias("bound"))
    order = W.partitionBy("query").orderBy(F.desc("bound"), "block")
    bounds.withColumn("turn", F.row_number().over(order)).write.parquet(f"{path}/bounds")
    asked.write.parquet(f"{path}/asked")
    bounds = spark.read.parquet(f"{path}/bounds")
    asked = spark.read.parquet(f"{path}/asked")
    head = _best(_scored(bounds.where(F.col("turn") <= first).select("query", "block"), asked, postings), k)
    head.write.parquet(f"{path}/head")
    head = spark.read.parquet(f"{path}/head")
    floor = head.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    # a score is rounded, and sums of bounds may fall short by their last digits
    open_blocks = bounds.where(F.col("turn") > first).join(floor, "query", "left").where(
        F.col("floor").isNull() | (F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("floor")))
    rest = _scored(open_blocks.select("query", "block"), asked, postings)
    found = _best(head.drop("rank").unionByName(rest), k)
    return found.select(F.col("query").alias(query_key), "rank", F.col("key").alias(key), "score")
