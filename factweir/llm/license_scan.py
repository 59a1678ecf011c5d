"""License scans: canonical digest lookup of entire texts.

A text is normalised (copyright lines dropped, A-Z lower-cased, equivalent spellings unified, everything but
ASCII letters and digits turned into single spaces) and its SHA-256 is hash-joined with the digests of known
licence texts and notices. Two kinds of texts are looked up for each document: the whole document, and each
of its lines, as licence notices usually stand on a line of their own. Only DataFrame operations are used.

Defined results: null texts are empty and match nothing; rows are independent, so repeated rows and null ids
get a row each; a text whose canonical form is empty matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.llm.common import ascii_lower, pick
from factweir.llm.license_texts import KNOWN

#: Spellings that count as one, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("sublicence", "sublicense"),
    ("http:", "https:"),
    ("&", " and "),
)

#: Known digests up to which they are broadcast (48 bytes each); beyond it Spark joins as it sees fit.
MAX_BROADCAST = 50_000

COPYRIGHT_LINE = r"(?im)^[^A-Za-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    c = ascii_lower(F.regexp_replace(text, F.lit(COPYRIGHT_LINE), F.lit("")))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, F.lit("[^a-z0-9]+"), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """digest, license, policy of known texts; of equal digests the smallest identifier stays."""
    df = spark.createDataFrame(list(known), "license string, policy string, text string").withColumn("canon", canonical(F.col("text")))
    one = df.where("canon <> ''").groupBy(F.sha2("canon", 256).alias("digest"))
    return one.agg(F.min(F.struct("license", "policy")).alias("k"), F.max(F.length("canon")).alias("size")).select("digest", "k.license", "k.policy", "size")


def scan_licenses(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, whole_license (licence that the entire text is, or null), licenses (sorted identifiers of
    lines or the entire text), policies (sorted), n_lines (lines that are licence texts)."""
    bound = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    small = bound["n"] <= MAX_BROADCAST
    base = pick(docs, id_column, text_column).toDF("id", "t").withColumn("t", F.coalesce("t", F.lit("")))
    # No line whose letters and digits alone exceed the longest known text can equal one.
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_count(x, F.lit("[A-Za-z0-9]")) <= bound["most"])
    whole = F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("t")).alias("canon")))
    parts = F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), canonical(x).alias("canon")))
    # the parts of a row follow each other in one task, so they are combined before the shuffle
    units = base.select("id", F.monotonically_increasing_id().alias("row"), F.concat(whole, parts).alias("us")).select("id", "row", F.explode("us").alias("u"))
    units = units.select("id", "row", F.col("u.whole").alias("whole"), F.sha2("u.canon", 256).alias("digest"))
    keys = known.select("digest", "license", "policy")
    hit = units.join(F.broadcast(keys) if small else keys, "digest", "left")
    out = hit.groupBy("row", "id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.sort_array(F.collect_set("license")).alias("licenses"),
        F.sort_array(F.collect_set("policy")).alias("policies"),
        F.count(F.when(~F.col("whole") & F.col("license").isNotNull(), 1)).alias("n_lines"),
    )
    return out.drop("row").withColumnRenamed("id", id_column)
