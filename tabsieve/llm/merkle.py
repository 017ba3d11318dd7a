"""A Merkle manifest of a dataset: one tree per source, and one over them.

Every row is a leaf, the digest of its columns. Inside a source the leaves
ascend by id; while a tree has more than one node, every 16 consecutive
nodes (the last run may be shorter, even a single one) become their digest.
The sources' last nodes, in order of the sources, are the leaves of the
upper tree, whose last node is the root of the dataset.

*Upwards*, level by level: the nodes lie in windows of their run, ordered by
position. Lead columns at the fixed offsets 1 to 15, masked by the run's
length, hand the row of the first child its siblings, and that row hashes
their parent. *Downwards*: lag and lead columns at the same offsets, masked
by slot and run length, give every node its siblings to the left and right;
joined to its parent's path they are the node's path to the root. The join's
keys are those of the window, so a level's nodes are shuffled once.

A window never holds more than one run. The leaves' positions come from
ranges of (source, id, digest), so a source with a third of all rows is
ranked in many tasks; texts are read once and not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else the number of its
    UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def case_folded(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, order columns named ``o_*``, any others) with ``pos``
    (from 0) inside their key and ``n`` (rows of the key), read back from the
    shared folder. Rows equal in all order columns take any order among them."""
    order = [F.col("key"), *[F.col(c).asc_nulls_first() for c in rows.columns if c.startswith("o_")], F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()}), name)
    # a row per key and range: where the key's rows begin in the range, and how many lie in ranges before
    per = dealt.groupBy("key", "part").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("c"))
    of_key = Window.partitionBy("key")
    before = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("key", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(of_key).alias("n"))
    placed = dealt.join(bounded_broadcast(written(per, f"{name}-parts")), ["key", "part"])
    return placed.withColumn("pos", F.col("before") + F.col("i") - F.col("first")).drop("part", "i", "first", "before")


def _in_runs(nodes: DataFrame) -> DataFrame:
    """``run``, ``slot`` and ``size`` (nodes of the run) of every node."""
    return nodes.withColumns({"run": F.expr(f"pos div {FANOUT}"), "slot": F.expr(f"pos % {FANOUT}")}).withColumn(
        "size", F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT))


def _in_run() -> WindowSpec:
    return Window.partitionBy("key", "run").orderBy("pos")


def _right(j: int) -> Column:
    return F.when(F.col("slot") + j < F.col("size"), F.lead("digest", j).over(_in_run())).otherwise(F.lit(""))


def _left(j: int) -> Column:
    return F.when(F.col("slot") >= j, F.lag("digest", j).over(_in_run())).otherwise(F.lit(""))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level (key, pos, n, digest) of the trees that have more than
    one node at this one."""
    held = _in_runs(nodes.filter("n > 1").select("key", "pos", "n", "digest"))
    joined = held.withColumn("joined", F.concat("digest", *[_right(j) for j in range(1, FANOUT)]))
    return joined.filter("slot = 0").select("key", F.col("run").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
                                            F.sha2("joined", 256).alias("digest"))


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The leaves' level and all above it, each read from the shared folder.
    A tree is in every level up to the one where it has a single node."""
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(written(parents(out[-1]), f"{name}-{len(out)}"))
        most = -(-most // FANOUT)
    return out


def last_nodes(tree: Sequence[DataFrame]) -> DataFrame:
    """(key, digest) of every tree's last node."""
    ends = [level.filter("n = 1").select("key", "digest") for level in tree]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def with_paths(tree: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves' level with ``path``: (left, right) digests of the siblings
    at every level, from the leaf's to the one below the root, and the
    columns of ``tops``, which gives each tree's last node (key) its path."""
    carried = [c for c in tops.columns if c not in ("key", "path")]
    found = None
    for level in reversed(tree):
        own = [c for c in level.columns if c != "digest"]
        ends = level.filter("n = 1").join(tops, "key").select(*level.columns, "path", *carried)
        if found is not None:
            above = found.select("key", F.col("pos").alias("run"), F.col("path").alias("above"), *carried)
            split = _in_runs(level.filter("n > 1")).withColumns({
                "left": F.concat(*[_left(j) for j in range(FANOUT - 1, 0, -1)]), "right": F.concat(*[_right(j) for j in range(1, FANOUT)])})
            step = F.concat(F.array(F.struct("left", "right")), F.col("above"))
            ends = ends.unionByName(split.join(above, ["key", "run"]).select(*own, "digest", step.alias("path"), *carried))
        found = ends
    return found


def siblings(path: Column) -> Column:
    """The path's digests joined, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path make."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


@dataclass
class Manifest:
    """``source_levels`` and ``upper_levels``: the nodes (key, pos, n,
    digest) level by level. The key of a source's tree is ``=`` and the
    source (empty for the null source); the upper tree has one key."""

    source_levels: list[DataFrame]
    upper_levels: list[DataFrame]

    @cached_property
    def root(self) -> str | None:
        """Digest of the whole dataset; none of an empty table."""
        row = last_nodes(self.upper_levels).first()
        return row["digest"] if row else None

    @property
    def subroots(self) -> DataFrame:
        """(source, subroot)."""
        return last_nodes(self.source_levels).select(
            F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias("source"), F.col("digest").alias("subroot"))

    def proofs(self) -> DataFrame:
        """One row per input row: doc_id, the carried columns, ``leaf``,
        ``path``, ``subroot`` and ``root``."""
        nothing = F.lit(None).cast("array<struct<left:string,right:string>>")
        empty = F.coalesce(nothing, F.array().cast("array<struct<left:string,right:string>>"))
        top = last_nodes(self.upper_levels).select("key", F.col("digest").alias("root"), empty.alias("path"))
        tops = with_paths(self.upper_levels, top).select(F.col("source").alias("key"), "path", F.col("digest").alias("subroot"), "root")
        found = with_paths(self.source_levels, written(tops, "subroot-paths"))
        return found.withColumnRenamed("digest", "leaf").drop("key", "pos", "n").withColumnRenamed("o_id", "doc_id")


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
          carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` names further columns that go with
    each leaf, computed where the row is read.

    Null values are leaves' values like others, and a null source is a
    source of its own, before all others. Null ids come before all others;
    rows with one id are ordered by their leaves, and wholly equal rows have
    equal leaves and places next to each other. Columns that are not named
    are not read; an empty table has no node and no root.
    """
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(f"`{id_col}`").alias("o_id"), leaf.alias("o_leaf"),
                       *[c.alias(f"c_{name}") for name, c in (carry or {}).items()])
    rows = ranked(written(rows, "leaves"), "ranked")
    rows = rows.select("key", "pos", "n", F.col("o_leaf").alias("digest"), "o_id", *[F.col(f"c_{c}").alias(c) for c in carry or {}])
    trees = levels(rows, "nodes")
    ends = last_nodes(trees).select(F.lit("").alias("key"), F.col("key").alias("o_source"), "digest")
    upper = ranked(ends, "subroots").select("key", "pos", "n", "digest", F.col("o_source").alias("source"))
    return Manifest(trees, levels(upper, "upper"))


def tampered_leaf(id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> Column:
    """The leaf of a row whose text was lower-cased, for the rows whose id's
    crc32 is divisible by ``every``; null for the others and for null ids."""
    changed = leaf_digest([case_folded(F.col(c)) if c == text_col else F.col(c) for c in FIELDS])
    return F.when(F.crc32(F.col(id_col).cast("string")) % every == 0, changed)


def audit(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256 and
    what a check finds after the tampering of ``tampered_leaf``: folded_root
    (from the changed leaf, else the original, and the original siblings)
    and verified."""
    found = build(docs, carry={"changed": tampered_leaf()}).proofs()
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_sql(source_levels: int = 6, upper_levels: int = 3) -> str:
    """DuckDB SQL for ``audit``; the numbers of levels bound the rows of a
    source (16 ** 6) and the sources (16 ** 3)."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    fields = lambda text: "sha256(" + " || ".join(enc(c) for c in (*FIELDS[:-1], text)) + ")"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""d AS (SELECT doc_id, source, {fields('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {fields(low)} END AS changed FROM documents)""",
             """s0 AS (SELECT *, coalesce('=' || source, '') AS key, leaf AS digest,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)"""]

    def climb(name: str, of: int) -> None:
        for k in range(of + 1):
            steps.append(f"""{name}{k}r AS (SELECT key, pos, count(*) OVER (PARTITION BY key) > 1 AS live, digest,
                coalesce(string_agg(digest, '') OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(digest, '') OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS (SELECT key, pos // 16 AS pos,
                CASE WHEN bool_or(live) THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest FROM {name}{k}r GROUP BY key, pos // 16)""")

    climb("s", source_levels)
    steps.append(f"u0 AS (SELECT '' AS key, key AS source_key, digest, row_number() OVER (ORDER BY key) - 1 AS pos FROM s{source_levels + 1})")
    climb("u", upper_levels)
    joins, proof, fold = [], [], "coalesce(s0.changed, s0.leaf)"
    columns = []
    for name, pos, key, of in (("s", "s0.pos", "s0.key", source_levels), ("u", "u0.pos", "''", upper_levels)):
        for k in range(of + 1):
            t = f"{name}{k}r"
            joins.append(f"JOIN {t} ON {t}.key = {key} AND {t}.pos = {pos} // {16 ** k}")
            proof.append(f"CASE WHEN {t}.live THEN {t}.l || {t}.r ELSE '' END")
            columns.append(f"CASE WHEN {t}.live THEN sha256({t}.l || {fold} || {t}.r) ELSE {fold} END AS f{len(columns)}")
            fold = f"f{len(columns) - 1}"
        if name == "s":
            joins.append("JOIN u0 ON u0.source_key = s0.key")
    return f"""WITH {', '.join(steps)}, a AS (
SELECT s0.doc_id, s0.leaf, u0.digest AS subroot, (SELECT min(digest) FROM u{upper_levels + 1}) AS root,
       sha256({' || '.join(proof)}) AS proof_sha256, {', '.join(columns)}
FROM s0 {' '.join(joins)})
SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM a"""
