"""A stored inverted index: postings by term bucket, so a query reads the buckets of its terms and no text.

    write_index(docs, folder)            # counts by document and term, then files by term bucket
    search_index(spark, folder, query)   # partition pruning on bucket, row-group pruning on term
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions import text as T
from cairnset.operators.retrieval import K1, B
from cairnset.session import cut

#: Occurrences of words in one file of a bucket.
FILE_WORDS = 4_000_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl, term, tf: each word of each document once; counts combine before the shuffle."""
    words = docs.select(key, T.words(F.col(text)).alias("w")).where("w is not null")
    each = words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def write_index(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> None:
    """Postings and totals. Buckets, and the files of each, follow the number of words unless a number is given."""
    sizes = cut(docs.select(F.size(T.words(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), F.sum("dl").alias("words")))
    n_words = sizes.first().words or 0  # one row
    parts = max(8, -(-n_words // FILE_WORDS))
    buckets = buckets or min(4_096, max(16, 2 ** ((parts - 1).bit_length() // 2 + 2)))
    deal = max(8, -(-parts // buckets))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    p = postings(docs, key, text).withColumn("bucket", bucket)
    # a frequent term is dealt over several files of its bucket by document, so no task writes it alone
    dealt = p.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(deal))).sortWithinPartitions("bucket", "term", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    sizes.select("n", "avg").withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/stats")


def search_index(spark: SparkSession, folder: str, query: str, key: str = "doc_id", limit: int = 1000) -> DataFrame:
    """The scores of `fts_code` from the stored postings: any of the words, best first, ties by key."""
    stats = spark.read.parquet(f"{folder}/stats").first()  # one row
    table = spark.read.parquet(f"{folder}/postings")
    terms = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.replace("\0", "").lower()) if w))
    if not terms or stats is None:
        return table.select(key).withColumn("score", F.lit(0.0)).limit(0)
    hashes = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(stats.buckets)).cast("int").alias("b")).collect()  # one row per term
    hits = table.where(F.col("bucket").isin(sorted({r.b for r in hashes})) & F.col("term").isin(terms)).select(key, "term", "tf", "dl")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = hits.join(F.broadcast(df.select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))), "term")  # one row per query term
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats.avg)))
    return weighed.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(limit)
