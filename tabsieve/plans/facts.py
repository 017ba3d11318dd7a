"""Fact documents built from table aggregates (T5-T10) and corpus rebuild
(T16). Every statistic comes from Spark aggregates; the texts are assembled
with ``format_string``/``concat`` on the (one-row) aggregate results, so no
table data passes through the driver."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fmt_fixed, pct
from ..operators import aggregates as A
from ..operators.partitioning import materialize
from ..sources.tables import Tables
from . import catalogue as C

FACT_SCHEMA = "pos int, type string, category string, text string"

# Columns described by parameter documents, with their descriptions; absent
# or all-null columns are skipped (the order is the output order).
DESCRIBED = [
    ("o_totalprice", "Order total price - value of the order"),
    ("c_acctbal", "Customer account balance - null when the customer is not on file"),
    ("prediction_confidence", "Model confidence - largest class probability"),
    ("o_shippriority", "Shipping priority - not present in this table"),
]
# Order values in units of 100,000.
BUCKETS = [("below 0.5", 0.0, 0.5), ("0.5 to 1", 0.5, 1.0), ("1 to 1.5", 1.0, 1.5), ("1.5 to 3", 1.5, 3.0), ("3 and more", 3.0, None)]

# The static methodology document.
METHOD_TEXT = ("How these figures come about. A model gives every object a class; the catalogue keeps it with the model's\n"
               "confidence, the probability of each class and the class on record. Shares refer to the whole catalogue,\n"
               "missing values are left out of averages, ranges include both ends, and a size bucket its lower end.")


def general_doc(cat: DataFrame, label: str, name: str) -> DataFrame:
    """T5: total rows and the rows of each class, by count desc then name."""
    total = cat.agg(F.count(F.lit(1))).scalar()
    vc = cat.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(label).alias("v"), F.col("n").alias("n"))))
    br = vc.agg(F.array_join(F.transform(items, lambda s: F.concat(s["v"], F.lit(" "), s["n"].cast("string"))), ", ").alias("b"))
    text = F.concat(F.lit(f"The {name} catalogue holds "), total.cast("string"),
                    F.lit(" objects. Recorded classes, most frequent first: "), F.coalesce(F.nullif("b", F.lit("")), F.lit("none")), F.lit("."))
    return br.select(F.lit(0).alias("pos"), F.lit("statistics").alias("type"), F.lit("general").alias("category"),
                     text.alias("text"))


def parameter_docs(cat: DataFrame, described: Sequence[tuple[str, str]]) -> DataFrame:
    """One document per described column that exists and has values."""
    cols = [(c, d) for c, d in described if c in cat.columns]
    spark = cat.sparkSession
    if not cols:
        return spark.createDataFrame([], FACT_SCHEMA)
    stats = A.describe_columns(cat, [c for c, _ in cols], digits=None)
    desc = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(cols)], "i int, column string, description string")
    j = stats.filter(F.col("n") > 0).join(F.broadcast(desc), "column")
    text = F.concat(F.col("column"), F.lit(" ("), F.col("description"), F.lit(") lies between "), fmt_fixed("min"), F.lit(" and "),
                    fmt_fixed("max"), F.lit(", half of its values below "), fmt_fixed("median"), F.lit(", their average being "),
                    fmt_fixed("mean"), F.lit("; "), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"),
                    F.lit(" objects have one."))
    return j.select((F.lit(10) + F.col("i")).alias("pos"), F.lit("parameter").alias("type"),
                    F.col("column").alias("category"), text.alias("text"))


def groups_doc(cat: DataFrame, key: str, member: str | None = None) -> DataFrame:
    """Groups with more than one member: count and the top 10 by size
    (``member``: count distinct member keys, quirk 23)."""
    g = A.repeated_groups(cat, key, top=None, member=member)
    top = g.orderBy(F.desc("size"), F.col(key)).limit(10)
    lines = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col(key).cast("string").alias("k"))))
                    .alias("items"))
    n = g.agg(F.count(F.lit(1))).scalar()
    body = F.array_join(F.transform("items", lambda s: F.concat(s["k"], F.lit(" with "), (-s["s"]).cast("string"))), "; ")
    text = F.concat(n.cast("string"), F.lit(" groups have several members, the largest being "), body, F.lit("."))
    return lines.filter(n > 0).select(F.lit(20).alias("pos"), F.lit("systems").alias("type"),
                                      F.lit("multi_member").alias("category"), text.alias("text"))


def range_doc(cat: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Count in a closed range and share of all rows (1 digit)."""
    r = A.range_share(cat, col, lo, hi)
    text = F.concat(F.col("in_range").cast("string"), F.lit(f" objects have a {col} from {lo:g} to {hi:g}, that is "),
                    F.format_string("%.1f", F.col("percent")), F.lit(" percent of all."))
    return r.filter(F.col("in_range") > 0).select(F.lit(30).alias("pos"), F.lit("science").alias("type"),
                                                 F.lit("range").alias("category"), text.alias("text"))


def size_doc(cat: DataFrame, col: str, buckets) -> DataFrame:
    """Half-open buckets with counts and shares over all non-null values."""
    b = A.bucket_shares(cat, col, buckets, digits=1)
    one = b.agg(F.array_sort(F.collect_list(F.struct("pos", "bucket", "count", "percent"))).alias("items"))
    body = F.array_join(F.transform("items", lambda s: F.concat(s["count"].cast("string"), F.lit(" of size "), s["bucket"], F.lit(" ("),
                                                                F.format_string("%.1f", s["percent"]), F.lit(" percent)"))), ", ")
    return one.select(F.lit(40).alias("pos"), F.lit("statistics").alias("type"), F.lit("sizes").alias("category"),
                      F.concat(F.lit("Objects by size: "), body, F.lit(".")).alias("text"))


def method_doc(spark) -> DataFrame:
    """Static document (literal row)."""
    return spark.createDataFrame([(50, "methodology", "method", METHOD_TEXT)], FACT_SCHEMA)


def fact_documents(t: Tables) -> DataFrame:
    """T5-T10 over the order catalogue, as one table of documents."""
    full = C.prepare_catalogue(t)
    need = ["o_orderstatus", "o_totalprice", "c_name"] + [c for c, _ in DESCRIBED if c in full.columns]
    cat = materialize(full.select(*dict.fromkeys(need)), "catalogue")   # joined once, read by every document
    size = cat.select((F.col("o_totalprice") / 100000.0).alias("size"))
    docs = [general_doc(cat, "o_orderstatus", "Order"), parameter_docs(cat, DESCRIBED), groups_doc(cat, "c_name"),
            range_doc(cat, "o_totalprice", 200000.0, 320000.0), size_doc(size, "size", BUCKETS), method_doc(t.spark)]
    out = docs[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    return out


GENERATED_TYPES = ("statistics", "parameter", "systems", "science", "methodology")


def rebuild_corpus(existing: DataFrame, facts: DataFrame) -> DataFrame:
    """New fact documents plus every row of the existing corpus that no
    rebuild generates: only the generated types are replaced, rows of any
    other type (and of none) stay (quirk 22)."""
    kept = existing.filter(~F.coalesce(F.col("type").isin(*GENERATED_TYPES), F.lit(False)))
    return kept.unionByName(facts, allowMissingColumns=True)
