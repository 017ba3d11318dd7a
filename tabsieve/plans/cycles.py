"""Round trips over the driver tables: publish and read back (K2, K3, K5, Q9),
files written and read (S1, S4, S7, S8, K1, K7), corpus saved, appended and
rebuilt (T15, T16, U3). What is written goes to fresh folders under the
shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fill_value, round_half_up
from ..functions.text import clean_text, html_to_text
from ..operators import bucketed as BK
from ..operators import publish as PB
from ..operators import schema as SC
from ..operators.filters import min_content
from ..session import scratch_path
from ..sources import io as IO
from ..sources import runs as RN
from ..sources.tables import Tables
from ..streaming import reland as RL
from . import corpus as K
from . import facts as FD
from . import tabular as TB
from .publishing import urgent_updates

ORDER_COLUMNS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def publish_cycle(t: Tables) -> DataFrame:
    """Insert every customer, update the urgent ones by key, skip a guarded
    publish, read the current version back."""
    base = scratch_path(t.spark, "published")
    cols = ["c_acctbal", "c_mktsegment"]
    target = t.customer.select("c_custkey", "c_name", *cols)
    done = [PB.publish(target, base, "c_custkey", cols)["action"],
            PB.publish(urgent_updates(t), base, "c_custkey", cols)["action"],
            PB.publish(urgent_updates(t), base, "c_custkey", cols, guard_col="c_mktsegment")["action"]]
    return PB.read_current(t.spark, base).withColumn("actions", F.lit(" ".join(done)))


def csv_cycle(t: Tables) -> DataFrame:
    """Orders written as CSV and read back with a schema and required columns,
    by way of the source fallback (the stored table does not exist)."""
    path = scratch_path(t.spark, "csv")
    IO.write_csv(t.orders.select(*[c.split()[0] for c in ORDER_COLUMNS.split(", ")]), path)
    df, source = IO.resolve_source(t.spark, scratch_path(t.spark, "absent"), path, ORDER_COLUMNS)
    return df.withColumn("came_from", F.lit(source))


def json_cycle(t: Tables) -> DataFrame:
    """Part prices written as JSON lines and read back."""
    path = scratch_path(t.spark, "json")
    df = t.part.select("p_partkey", "p_name", "p_retailprice")
    IO.write_json(df, path)
    return IO.read_json_artefact(t.spark, path, df.schema, lines=True)


def corpus_cycle(t: Tables) -> DataFrame:
    """Documents saved as a corpus, pages appended, then the generated fact
    documents rebuilt twice: rows per type (uploads stay, facts are there
    once)."""
    path = scratch_path(t.spark, "corpus")
    K.save_corpus(t.documents.select(F.col("source").alias("type"), "text"), path)
    K.append_corpus(t.pages.select(F.lit("page").alias("type"), F.col("html").alias("text")), path)
    facts = FD.fact_documents(t).select("type", "text")
    first = FD.rebuild_corpus(K.load_corpus(t.spark, path), facts)
    return FD.rebuild_corpus(first, facts).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


RUN_FEATURES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]


def run_registry(t: Tables) -> DataFrame:
    """Four runs of unequal shape recorded, the newest complete
    one read back: its status, every metric and its three largest importances
    (here each column's correlation with returned lines, by amount)."""
    base = scratch_path(t.spark, "runs")
    returned = (F.col("l_returnflag") == "R").cast("double")
    weights = t.lineitem.agg(*[round_half_up(F.abs(F.corr(F.col(c), returned)), 9).alias(c) for c in RUN_FEATURES])
    as_object = weights.select(F.to_variant_object(F.struct(*RUN_FEATURES)).alias("payload"))
    as_list = weights.select(F.to_variant_object(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance"))
                                                           for c in RUN_FEATURES])).alias("payload"))
    names = RN.literal_payload(t.spark, str(RUN_FEATURES).replace("'", '"'))
    report = RN.report_payload(TB.class_report(t))
    RN.create(t.spark, base)
    for run, stamp, kinds in [("first", "20240101_120000", {"metrics": RN.literal_payload(t.spark, '{"accuracy": 0.5}'),
                                                            "feature_names": names, "importances": as_object}),
                              ("second", "20240201_120000", {"metrics": report, "feature_names": names, "importances": as_list}),
                              ("third", "20240301_120000", {"metrics": report, "feature_names": names}),
                              ("unstamped", None, {"metrics": report, "feature_names": names, "importances": as_object})]:
        for kind, payload in kinds.items():
            RN.append(payload, base, run, stamp, kind)
    latest = RN.latest_complete(RN.load(t.spark, base)).checkpoint()      # a few records, read four ways
    state = RN.status(latest).select("run", F.lit("status").alias("part"), F.explode(F.create_map(
        F.lit("n_features"), F.col("n_features").cast("double"), F.lit("n_classes"), F.col("n_classes").cast("double"),
        F.lit("accuracy"), F.col("accuracy"))).alias("name", "value")).withColumn("metric", F.lit("value"))
    measured = RN.metrics(latest).withColumn("part", F.lit("metric"))
    top = RN.importances(latest, 3).select("run", F.lit("importance").alias("part"), F.col("feature").alias("name"),
                                           F.lit("value").alias("metric"), F.col("importance").alias("value"))
    return state.unionByName(measured).unionByName(top)


def bucketed_cycle(t: Tables) -> DataFrame:
    """K3, K6, F9 on the bucketed layout: every customer written, urgent ones
    updated by key, then one customer alone (one bucket written anew), who is
    looked up; all rows read back."""
    base, cols = scratch_path(t.spark, "bucketed"), ["c_acctbal", "c_mktsegment"]
    BK.create(t.customer.select("c_custkey", "c_name", *cols), base, "c_custkey", n_buckets=32)
    BK.upsert(t.spark, base, urgent_updates(t), cols)
    last = t.customer.agg(F.max("c_custkey").alias("c_custkey")).withColumn("c_mktsegment", F.lit("LAST"))
    again = BK.upsert(t.spark, base, last, ["c_mktsegment"])
    found = BK.lookup(t.spark, base, last.first()["c_custkey"]).first()
    return BK.layout(t.spark, base).read(t.spark).withColumns({"rewritten": F.lit(len(again)), "found": F.lit(found["c_name"])})


def relanded_corpus(t: Tables) -> DataFrame:
    """Documents land as one file per language and are ingested; then one
    language's file lands again without its short documents and replaces its
    chunks, while the other files' stay."""
    base, landing, ids = scratch_path(t.spark, "relanded"), scratch_path(t.spark, "landing"), "doc_id long"
    docs = t.documents.select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("name"))

    def deliver(rows: DataFrame, delivery: str) -> None:
        rows.repartition("name").write.partitionBy("name").parquet(f"{landing}/{delivery}")      # one file per name
        name = F.regexp_extract("__path", "name=([^/]+)/", 1)
        stream = RL.landed(t.spark, landing, "doc_id long, text string", name)
        RL.start(stream, base, f"{base}/checkpoint", ["doc_id"]).awaitTermination()

    deliver(docs, "first")
    again = docs.agg(F.min("name")).scalar()
    deliver(docs.filter((F.col("name") == again) & (F.length("text") >= 400)), "second")
    return RL.current(t.spark, base, ids).select("file", "doc_id", "chunk_index", "n_chunks", "text")


def stored_collection(t: Tables) -> DataFrame:
    """S3, S4 (stored table), S6, S8, K4, K9, P15, X6: customers with an internal
    id, NaN balances cleaned, truncated and loaded again, found by the source
    chain, the id dropped, required columns checked, a literal row added."""
    path = scratch_path(t.spark, "collection")
    rows = t.customer.select(F.expr("uuid()").alias("_id"), "c_custkey", "c_name",
                             F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    IO.write_table(rows.limit(0), path)
    IO.write_table(IO.clean_for_write(rows), path, mode="overwrite")
    _, source = IO.resolve_source(t.spark, path, None)
    kept = SC.require_columns(IO.read_collection(t.spark, path), ["c_custkey", "c_acctbal"])
    kept = kept.unionByName(IO.literal_rows(t.spark, [(0, "added", None)], kept.schema))
    names = ",".join(SC.feature_names(len(kept.columns), kept.columns) + SC.feature_names(2))
    return kept.select("c_custkey", "c_name", fill_value("c_acctbal", -1.0).alias("c_acctbal"),
                       F.lit(source).alias("came_from"), F.lit(names).alias("names"))


def binary_ingest(t: Tables) -> DataFrame:
    """Pages as one file each, read as bytes, extracted, cleaned,
    short ones put aside. Files are read some folders at a time, as the driver
    holds their listing; a page's row is written and read back."""
    path, ingested = scratch_path(t.spark, "files"), scratch_path(t.spark, "ingested")
    page = F.regexp_extract("path", "page_id=(-?[0-9]+)[-/]", 1).try_cast("long")      # no page_id: null
    for folders in IO.few_files(IO.write_texts(t.pages, path, "page_id", "html")):
        files = IO.binary_files(t.spark, folders, "*.txt")
        texts = IO.extract_documents(files, lambda _, content: content.decode("utf-8").removesuffix("\n"))      # the text sink's line end
        # exploded, else the filter is moved below the cleaning and cleans every text once more
        cleaned = texts.select(page.alias("page_id"), F.explode(F.array(clean_text(html_to_text("text")))).alias("text"))
        kept, _ = min_content(cleaned, "text", 1500)
        kept.select("page_id", F.length("text").alias("n_chars")).write.mode("append").parquet(ingested)
    return t.spark.read.parquet(ingested)
