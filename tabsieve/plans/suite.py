"""Registered queries: each name maps to a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where SQL can express it, an equivalent DuckDB query over
the same Parquet tables. Both sides alias every computed column alike.

SQL notes: DuckDB reads ``100.0`` as DECIMAL, so doubles are written with an
exponent (``1e2``) to keep IEEE arithmetic identical to Spark's; rounding is
``floor(x * 10^d + 0.5) / 10^d`` on both sides (see ``round_half_up``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- SQL helpers
def rhu(x: str, d: int = 2) -> str:
    """SQL twin of ``round_half_up``."""
    s = f"1e{d}"
    return f"(floor(({x}) * {s} + 5e-1) / {s})"


def spct(num: str, den: str, d: int = 2) -> str:
    """SQL twin of ``pct``."""
    return f"(CASE WHEN ({den}) > 0 THEN {rhu(f'({num}) * 1e2 / ({den})', d)} ELSE 0e0 END)"


def canon(x: str) -> str:
    """SQL twin of ``canonical_label``."""
    return f"regexp_replace(upper(trim({x})), '\\s+', '_', 'g')"


# ---------------------------------------------------------------- catalogue
from . import catalogue as C  # noqa: E402

CATALOGUE_SQL = """
scored AS (
  SELECT *, 1 + o_orderkey % 7 AS s_f, 1 + o_custkey % 5 AS s_o,
         1 + CAST(floor(o_totalprice) AS BIGINT) % 3 AS s_p
  FROM orders
), scored2 AS (
  SELECT *, s_f / (s_f + s_o + s_p) AS prob_FILLED, s_o / (s_f + s_o + s_p) AS prob_OPEN,
         s_p / (s_f + s_o + s_p) AS prob_PARTIAL_FILL,
         CASE WHEN s_f >= s_o AND s_f >= s_p THEN 'FILLED' WHEN s_o >= s_p THEN 'OPEN'
              ELSE 'PARTIAL FILL' END AS disposition,
         'model' AS disposition_source,
         strftime(o_orderdate, '%Y-%m-%d') AS order_date
  FROM scored
), scored3 AS (
  SELECT *, greatest(prob_FILLED, prob_OPEN, prob_PARTIAL_FILL) AS prediction_confidence,
         CASE WHEN disposition = 'FILLED' THEN TRUE WHEN disposition = 'PARTIAL FILL' THEN FALSE END AS is_filled,
         CASE WHEN o_orderstatus IS NULL THEN 'UNKNOWN'
              WHEN contains(upper(o_orderstatus), 'F') THEN 'FILLED'
              WHEN contains(upper(o_orderstatus), 'P') THEN 'PARTIAL_FILL'
              WHEN contains(upper(o_orderstatus), 'O') THEN 'OPEN' ELSE 'UNKNOWN' END AS actual_disposition,
         CASE WHEN contains(upper(o_orderstatus), 'F') THEN TRUE
              WHEN contains(upper(o_orderstatus), 'P') THEN FALSE END AS actual_is_filled
  FROM scored2
), cat AS (
  SELECT s.*, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, c.c_nationkey,
         n.n_nationkey, n.n_name, n.n_regionkey
  FROM scored3 s
  LEFT JOIN customer c ON s.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def _stats_sql() -> str:
    p, a = canon("disposition"), canon("actual_disposition")
    sel, outer = ["count(*) AS total"], ["total"]
    for k in C.CLASSES:
        key, kk = k.lower().replace(" ", "_"), k.upper().replace(" ", "_")
        sel += [f"count_if({p} = '{kk}') AS pred_{key}", f"count_if({a} = '{kk}') AS actual_{key}",
                f"count_if({a} = '{kk}' AND {p} = {a}) AS hit_{key}"]
        outer += [f"pred_{key}", f"{spct(f'pred_{key}', 'total')} AS pred_pct_{key}", f"actual_{key}"]
    sel += ["count_if(c_acctbal IS NOT NULL AND n_name IS NOT NULL AND n_regionkey IS NOT NULL) AS with_coordinates",
            "count(c_acctbal) AS with_distance", "min(disposition_source) AS disposition_source",
            f"count_if({p} = {a}) AS correct"]
    outer += ["with_coordinates", "with_distance", "disposition_source", "correct",
              f"{spct('correct', 'total')} AS accuracy"]
    for k in C.CLASSES:
        key = k.lower().replace(" ", "_")
        outer.append(f"CASE WHEN actual_{key} > 0 THEN {rhu(f'hit_{key} * 1e2 / actual_{key}')} END AS class_acc_{key}")
    return f"WITH {CATALOGUE_SQL}, g AS (SELECT {', '.join(sel)} FROM cat) SELECT {', '.join(outer)} FROM g"


register("stats", _stats_sql())(C.stats)

register("overview", """
SELECT count(*) AS total,
       count_if(disposition = 'FILLED') AS predicted_filled,
       count_if(disposition = 'PARTIAL FILL') AS predicted_partial_fill,
       count_if(disposition = 'OPEN') AS predicted_open
FROM (SELECT CASE WHEN s_f >= s_o AND s_f >= s_p THEN 'FILLED' WHEN s_o >= s_p THEN 'OPEN'
                  ELSE 'PARTIAL FILL' END AS disposition
      FROM (SELECT 1 + o_orderkey % 7 AS s_f, 1 + o_custkey % 5 AS s_o,
                   1 + CAST(floor(o_totalprice) AS BIGINT) % 3 AS s_p FROM orders))
""")(C.overview)

LISTING_COLS = ("o_orderkey, o_custkey, c_name, c_mktsegment, n_name, o_totalprice, order_date, o_orderpriority, "
                "c_acctbal, disposition, disposition_source, prediction_confidence AS confidence, is_filled")


@register("listing", f"""
WITH {CATALOGUE_SQL}
SELECT {LISTING_COLS} FROM cat WHERE disposition = 'PARTIAL FILL'
ORDER BY o_orderkey LIMIT 100 OFFSET 50
""")
def _listing(t: Tables) -> DataFrame:
    return C.listing(t, skip=50, limit=100, disposition="partial_fill", only_filled=False)


@register("lookup", f"""
WITH {CATALOGUE_SQL}
SELECT o_orderkey, o_custkey, c_name, c_mktsegment, n_name, o_totalprice, order_date, o_orderpriority,
       c_acctbal, disposition, disposition_source, prediction_confidence, is_filled,
       actual_disposition, actual_is_filled
FROM cat WHERE o_custkey = 7 ORDER BY o_orderkey
""")
def _lookup(t: Tables) -> DataFrame:
    return C.lookup(t, 7)


@register("enrich", f"""
WITH li AS (
  SELECT l_orderkey, l_linenumber,
         'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || ' ' || CAST(l_linenumber AS VARCHAR) AS object_name,
         l_discount * 36e2 AS ra, l_tax * 1e3 - 4e1 AS dec
  FROM lineitem
), li2 AS (
  SELECT *, nullif(regexp_extract(trim(object_name), '^\\s*(\\S+)', 1), '') AS host FROM li
), hosts AS (
  SELECT s_name AS hostname, fmod(fmod(s_acctbal, 36e1) + 36e1, 36e1) AS host_ra, CAST(s_nationkey * 7 - 84 AS DOUBLE) AS host_dec,
         CASE WHEN s_acctbal > 1000 THEN s_acctbal / 1e1 END AS sy_dist
  FROM supplier
), m AS (
  SELECT li2.*, hosts.*,
         CASE WHEN sy_dist IS NOT NULL THEN host_ra ELSE ra END AS use_ra,
         CASE WHEN sy_dist IS NOT NULL THEN host_dec ELSE dec END AS use_dec
  FROM li2 LEFT JOIN hosts ON li2.host = hosts.hostname
)
SELECT l_orderkey, l_linenumber, host, hostname, {rhu('use_ra', 6)} AS use_ra, {rhu('use_dec', 6)} AS use_dec, sy_dist,
       {rhu('CASE WHEN sy_dist IS NOT NULL THEN sy_dist * cos(radians(use_dec)) * cos(radians(use_ra)) END', 6)} AS x_pc,
       {rhu('CASE WHEN sy_dist IS NOT NULL THEN sy_dist * cos(radians(use_dec)) * sin(radians(use_ra)) END', 6)} AS y_pc,
       {rhu('CASE WHEN sy_dist IS NOT NULL THEN sy_dist * sin(radians(use_dec)) END', 6)} AS z_pc,
       {rhu('sy_dist * 3.26156e0', 6)} AS dist_ly
FROM m
""")
def _enrich(t: Tables) -> DataFrame:
    return C.enrich(t)


register("unique_pairs", """
WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)
SELECT l_returnflag, l_linestatus, (SELECT count(*) FROM d) AS n_pairs FROM d
""")(C.unique_pairs)


# ---------------------------------------------------------------- profiling / distributions
from . import tabular as T  # noqa: E402

FEAT_SQL = """feat AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax,
         CASE WHEN l_quantity > 20 THEN l_tax END AS sparse_tax, CAST(floor(l_tax) AS DOUBLE) AS tax_floor,
         l_extendedprice * (1 + l_tax) AS gross, l_extendedprice / l_quantity AS unit_price
  FROM lineitem)"""


def _nan_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def _describe_sql() -> str:
    parts = [f"SELECT '{c}' AS column, {rhu(f'avg({c})', 6)} AS mean, {rhu(f'median({c})', 6)} AS median, "
             f"min({c}) AS min, max({c}) AS max, count({c}) AS n, count(*) AS total FROM feat" for c in T.FEATURES]
    return f"WITH {FEAT_SQL} " + " UNION ALL ".join(parts)


def _null_sql() -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS column, count_if({c} IS NULL) AS nulls, "
             f"{rhu(f'count_if({c} IS NULL) / count(*)', 6)} AS null_fraction FROM feat" for i, c in enumerate(T.FEATURES)]
    return (f"WITH {FEAT_SQL}, p AS ({' UNION ALL '.join(parts)}) "
            f"SELECT *, (SELECT CAST(sum(nulls) AS BIGINT) FROM p) AS total_missing FROM p")


def _moments_sql() -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS column, count({c}) AS n, {rhu(f'avg({c})', 6)} AS mean, "
             f"{rhu(f'median({c})', 6)} AS median, {rhu(f'stddev_pop({c})', 6)} AS std_pop, "
             f"{rhu(f'var_samp({c})', 3)} AS var_samp, var_samp({c}) = 0 AS zero_variance FROM feat"
             for i, c in enumerate(T.FEATURES)]
    return f"WITH {FEAT_SQL} " + " UNION ALL ".join(parts)


def _corr_sql() -> str:
    f = T.FEATURES
    parts = [f"SELECT {i} AS i, {j} AS j, '{f[i]}' AS col_i, '{f[j]}' AS col_j, "
             f"CAST(count_if({f[i]} IS NOT NULL AND {f[j]} IS NOT NULL) AS DOUBLE) AS n, "
             f"{rhu(_nan_null(f'corr({f[i]}, {f[j]})'), 6)} AS r FROM feat"
             for i in range(len(f)) for j in range(i + 1, len(f))]
    return f"WITH {FEAT_SQL} " + " UNION ALL ".join(parts)


def _selection_sql() -> str:
    f = T.FEATURES
    prof = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column, 1 - count({c}) / count(*) AS null_fraction, var_samp({c}) AS variance, "
        f"median({c}) AS med FROM feat" for i, c in enumerate(f))
    filled = ", ".join(f"coalesce({c}, (SELECT med FROM prof WHERE pos = {i})) AS c{i}" for i, c in enumerate(f))
    pairs = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_nan_null(f'corr(c{i}, c{j})')} AS r FROM filled"
                               for i in range(len(f)) for j in range(i + 1, len(f)))
    return f"""WITH {FEAT_SQL}, prof AS ({prof}),
stage AS (SELECT *, CASE WHEN null_fraction > 0.5 THEN 'missing' WHEN variance = 0 THEN 'zero_variance' END AS r12 FROM prof),
filled AS (SELECT {filled} FROM feat),
pairs AS ({pairs}),
cand AS (SELECT p.i, p.j, abs(p.r) AS ar FROM pairs p
         JOIN stage si ON si.pos = p.i AND si.r12 IS NULL JOIN stage sj ON sj.pos = p.j AND sj.r12 IS NULL
         WHERE abs(p.r) > 0.95),
firstp AS (SELECT j, min(i) AS i, arg_min(ar, i) AS ar FROM cand GROUP BY j)
SELECT s.pos, s.column, {rhu('s.null_fraction', 6)} AS null_fraction, {rhu('s.variance', 3)} AS variance,
       si.column AS corr_partner, {rhu('fp.ar', 6)} AS partner_abs_r,
       (s.r12 IS NULL AND fp.j IS NULL) AS kept,
       coalesce(s.r12, CASE WHEN fp.j IS NOT NULL THEN 'correlated' END) AS reason
FROM stage s LEFT JOIN firstp fp ON fp.j = s.pos LEFT JOIN stage si ON si.pos = fp.i"""


register("describe", _describe_sql())(T.describe)
register("null_profile", _null_sql())(T.null_profile)
register("moments", _moments_sql())(T.moments)
register("correlation", _corr_sql())(T.correlation)
register("feature_selection", _selection_sql())(T.feature_selection)

register("value_counts", f"""
WITH c AS (SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_type, count, {rhu('count * 1e2 / (SELECT count(*) FROM events WHERE event_type IS NOT NULL)', 6)} AS percent FROM c
""")(T.value_counts)

register("repeated_groups", """
WITH g AS (SELECT o_custkey, count(*) AS size FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT o_custkey, size, (SELECT count(*) FROM g) AS n_groups FROM g ORDER BY size DESC, o_custkey LIMIT 10
""")(T.repeated_groups)

register("range_share", f"""
SELECT count(*) AS total, count_if(o_totalprice BETWEEN 200000 AND 320000) AS in_range,
       {spct('count_if(o_totalprice BETWEEN 200000 AND 320000)', 'count(*)', 1)} AS percent FROM orders
""")(T.range_share)


def _buckets_sql() -> str:
    parts = []
    for i, (name, lo, hi) in enumerate(T.SIZE_BUCKETS):
        cond = f"size >= {lo!r}" if hi is None else f"size >= {lo!r} AND size < {hi!r}"
        parts.append(f"SELECT {i} AS pos, '{name}' AS bucket, count_if({cond}) AS count, "
                     f"{spct(f'count_if({cond})', 'count(size)', 1)} AS percent FROM s")
    return "WITH s AS (SELECT p_size / 1e1 AS size FROM part) " + " UNION ALL ".join(parts)


register("size_buckets", _buckets_sql())(T.size_buckets)

register("family_summary", f"""
SELECT l_returnflag, {rhu('avg(l_extendedprice)', 4)} AS mean, max(l_extendedprice) AS max, count(l_extendedprice) AS count,
       {rhu('stddev_samp(l_extendedprice)', 4)} AS std, {rhu('avg(l_discount)', 4)} AS mean_l_discount
FROM lineitem GROUP BY l_returnflag
""")(T.family_summary)

register("width_histogram", f"""
WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((o_totalprice - lo) * 2e1 / (hi - lo)) AS INTEGER) + 1, 20) END AS bin,
             lo, hi FROM orders, mm WHERE o_totalprice IS NOT NULL)
SELECT bin, {rhu('lo + (bin - 1) * (hi - lo) / 2e1', 6)} AS lower, count(*) AS count FROM b GROUP BY bin, lo, hi
""")(T.width_histogram)

BRAND_SQL = """byb AS (
  SELECT p_brand, sum(rev) AS rev FROM (
    SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY l_partkey) r
  JOIN part ON r.l_partkey = part.p_partkey GROUP BY p_brand),
imp AS (SELECT p_brand, rev / (SELECT sum(rev) FROM byb) AS importance FROM byb),
cum AS (SELECT p_brand, importance,
               row_number() OVER (ORDER BY importance DESC, p_brand) AS position,
               sum(importance) OVER (ORDER BY importance DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
        FROM imp)"""

register("pareto", f"""
WITH {BRAND_SQL}
SELECT position, p_brand, {rhu('importance', 6)} AS importance, {rhu('cumulative', 6)} AS cumulative FROM cum
""")(T.pareto)

register("pareto_thresholds", f"""
WITH {BRAND_SQL}, sh AS (SELECT position, cumulative / (SELECT sum(importance) FROM imp) AS share FROM cum)
""" + " UNION ALL ".join(
    f"SELECT {t!r} AS threshold, (SELECT min(position) FROM sh WHERE share >= {t!r} - 1e-12) AS n_items"
    for t in T.THRESHOLDS))(T.pareto_thresholds)

register("importance_summary", f"""
WITH {BRAND_SQL}
SELECT {rhu('max(importance)', 6)} AS max, {rhu('avg(importance)', 6)} AS mean,
       count_if(importance > 0.04) AS n_above, count_if(importance = 0) AS n_zero FROM imp
""")(T.importance_summary)

register("class_weights", f"""
WITH c AS (SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT l_returnflag, count,
       {rhu('CAST((SELECT sum(count) FROM c) AS BIGINT) / ((SELECT count(*) FROM c) * count)', 9)} AS weight FROM c
""")(T.class_weights)


def _rank_sql(seed: int) -> str:
    return f"""r AS (
  SELECT l_orderkey, l_linenumber, l_returnflag,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY
             md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':{seed}'), l_orderkey, l_linenumber) AS rank,
         count(*) OVER (PARTITION BY l_returnflag) AS n_label
  FROM lineitem)"""


register("stratified_split", f"""
WITH {_rank_sql(42)}, s AS (SELECT *, floor(n_label * 2e-1 + 5e-1) AS n_test FROM r)
SELECT l_orderkey, l_linenumber, l_returnflag, rank,
       CASE WHEN rank <= n_test THEN 'test'
            WHEN rank <= n_test + floor((n_label - n_test) * {0.1 / 0.8!r} + 5e-1) THEN 'val' ELSE 'train' END AS split
FROM s
""")(T.stratified_split)

register("kfold", f"""
WITH {_rank_sql(7)}
SELECT l_orderkey, l_linenumber, l_returnflag, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r
""")(T.kfold)

LABELS_SQL = f"""WITH {CATALOGUE_SQL}, lab AS (
  SELECT {canon('actual_disposition')} AS actual, {canon('disposition')} AS predicted FROM cat)"""

register("confusion", f"""
{LABELS_SQL}
SELECT actual, count_if(predicted = 'FILLED') AS FILLED, count_if(predicted = 'OPEN') AS OPEN,
       count_if(predicted = 'PARTIAL_FILL') AS PARTIAL_FILL
FROM lab WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY actual
""")(T.confusion)


def _report_sql(labels: str) -> str:
    """The report over a CTE ``lab`` (actual, predicted)."""
    return f"""{labels},
cl AS (SELECT actual, predicted, count(*) AS count FROM lab WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2),
classes AS (SELECT actual AS label FROM cl UNION SELECT predicted FROM cl),
per0 AS (
  SELECT c.label,
         coalesce((SELECT sum(count) FROM cl WHERE actual = c.label AND predicted = c.label), 0) AS tp,
         coalesce((SELECT sum(count) FROM cl WHERE actual = c.label), 0) AS support,
         coalesce((SELECT sum(count) FROM cl WHERE predicted = c.label), 0) AS npred
  FROM classes c),
per1 AS (SELECT label, tp, support,
                CASE WHEN npred > 0 THEN tp / npred ELSE 0e0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall FROM per0),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM per1),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr, sum(f1) AS sf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per),
allr AS (
  SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per
  UNION ALL SELECT 'accuracy', tp / n, tp / n, tp / n, CAST(n AS BIGINT) FROM tot
  UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(n AS BIGINT) FROM tot
  UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot)
SELECT label, {rhu('precision', 6)} AS precision, {rhu('recall', 6)} AS recall, {rhu('f1', 6)} AS f1, support FROM allr"""


register("class_report", _report_sql(LABELS_SQL))(T.class_report)


# ---------------------------------------------------------------- text corpus
from . import corpus as K  # noqa: E402
from ..functions.text import HTML_ENTITIES, OCR_REPLACEMENTS, PY_WHITESPACE_CLASS, SENTENCE_DELIMITERS  # noqa: E402


def sq(s: str) -> str:
    """SQL string literal (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if len(parts) > 1 else "'" + s.replace("'", "''") + "'"


def py_strip_sql(x: str) -> str:
    ws = PY_WHITESPACE_CLASS
    return f"regexp_replace({x}, '\\A{ws}+|{ws}+\\z', '', 'g')"


def clean_sql(x: str) -> str:
    y = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    y = f"regexp_replace({y}, ' {{2,}}', ' ', 'g')"
    y = f"regexp_replace({y}, '\\n\\p{{Nd}}+\\n', chr(10), 'g')"
    for a, b in OCR_REPLACEMENTS:
        y = f"replace({y}, {sq(a)}, {sq(b)})"
    return py_strip_sql(y)


def html_sql(x: str) -> str:
    y = f"regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
    y = f"regexp_replace({y}, '(?i)<br\\s*/?>|</(p|div|h[1-6]|li|tr|article|section|title)>', chr(10), 'g')"
    y = f"regexp_replace({y}, '<[^>]*>', '', 'g')"
    for a, b in HTML_ENTITIES:
        y = f"replace({y}, {sq(a)}, {sq(b)})"
    return y


def _re_escape(d: str) -> str:
    return "".join("\\" + ch if ch in ".!?" else ("\\n" if ch == "\n" else ch) for ch in d)


def chunk_ctes(src: str, id_cols: list[str], size: int = 1000, overlap: int = 200) -> str:
    """Recursive-CTE twin of ``chunk_spans`` over CTE ``src`` (id cols, t).
    Needs the enclosing query to start with WITH RECURSIVE. Produces CTE
    ``chunked`` with ids, chunk_index, n_chunks, start, end, text."""
    ids = ", ".join(id_cols)
    on = " AND ".join(f"sp.{c} = d.{c}" for c in id_cols)

    def end_expr(s: str) -> str:
        snaps = []
        for d in SENTENCE_DELIMITERS:
            pat = f"(?s)^(.*){_re_escape(d)}"
            snaps.append(f"WHEN regexp_matches(w, '{pat}') THEN {s} + length(regexp_extract(w, '{pat}', 1)) + {len(d)}")
        snap = f"(CASE {' '.join(snaps)} ELSE {s} + {size} END)"
        return (f"CASE WHEN {s} + {size} >= n THEN {s} + {size} "
                f"WHEN {snap} - {overlap} <= {s} THEN {s} + {size} ELSE {snap} END")

    return f"""docs_c AS (SELECT {ids}, t, length(t) AS n FROM {src} WHERE t IS NOT NULL),
spans AS (
  SELECT {ids}, 0 AS idx, s, {end_expr('s')} AS e
  FROM (SELECT {ids}, t, n, 0 AS s, substring(t, 1, {size}) AS w FROM docs_c)
  UNION ALL
  SELECT {ids}, idx, s, {end_expr('s')} AS e
  FROM (SELECT {', '.join('sp.' + c for c in id_cols)}, sp.idx + 1 AS idx, d.t, d.n, sp.e - {overlap} AS s,
               substring(d.t, sp.e - {overlap} + 1, {size}) AS w
        FROM spans sp JOIN docs_c d ON {on} WHERE sp.e - {overlap} < d.n AND d.n > {size})
),
chunked AS (
  SELECT {', '.join('sp.' + c for c in id_cols)}, CAST(sp.idx AS INTEGER) AS chunk_index,
         CAST(count(*) OVER (PARTITION BY {', '.join('sp.' + c for c in id_cols)}) AS INTEGER) AS n_chunks,
         CAST(sp.s AS INTEGER) AS start, CAST(least(sp.e, d.n) AS INTEGER) AS "end",
         CASE WHEN d.n <= {size} THEN d.t ELSE {py_strip_sql(f'substring(d.t, sp.s + 1, sp.e - sp.s)')} END AS text
  FROM spans sp JOIN docs_c d ON {on}
)"""


DIRTY_SQL = f"""dirty AS (
  SELECT doc_id, source, '  ' || replace(replace(text, '. ', '.  '), chr(10), chr(10) || chr(10) || chr(10))
         || {sq(chr(10) * 4 + '7' + chr(10) + 'ﬁnal ﬂow – and — end' + chr(10) * 3 + '  ')} AS text
  FROM documents),
cleaned AS (SELECT doc_id, source, {clean_sql('text')} AS text FROM dirty)"""

register("clean_text", f"""
WITH {DIRTY_SQL}
SELECT doc_id, text, length(text) AS n_chars FROM cleaned
""")(K.clean)

register("chunks", f"""
WITH RECURSIVE {DIRTY_SQL}, src AS (SELECT doc_id, text AS t FROM cleaned),
{chunk_ctes('src', ['doc_id'])}
SELECT * FROM chunked
""")(K.chunks)

CORPUS_SQL = f"""{DIRTY_SQL}, src AS (SELECT doc_id, source, text AS t FROM cleaned),
{chunk_ctes('src', ['doc_id', 'source'])},
corpus AS (SELECT source AS type, 'doc-' || CAST(doc_id AS VARCHAR) AS filename, doc_id, chunk_index, n_chunks, text FROM chunked)"""

register("corpus_types", f"""
WITH RECURSIVE {CORPUS_SQL}
SELECT coalesce(type, 'unknown') AS type, count(*) AS n_chunks, count(DISTINCT filename) AS n_files
FROM corpus GROUP BY 1
""")(K.corpus_types)

register("corpus_files", f"""
WITH RECURSIVE {CORPUS_SQL}
SELECT filename, arg_min(type, chunk_index) AS type, arg_min(n_chunks, chunk_index) AS n_chunks
FROM corpus GROUP BY filename
""")(K.corpus_files)

register("page_ingest", f"""
WITH RECURSIVE pt AS (SELECT page_id, url, {clean_sql(html_sql('html'))} AS text FROM pages),
kept AS (SELECT page_id, url, text AS t FROM pt WHERE length({py_strip_sql('text')}) >= 100),
{chunk_ctes('kept', ['page_id', 'url'])}
SELECT page_id, 'page' AS type, url AS filename, chunk_index, n_chunks, start, "end", text FROM chunked
""")(K.page_ingest)


# ---------------------------------------------------------------- retrieval
from . import retrieval as RV  # noqa: E402
from ..operators.retrieve import PROMPT_NO_CONTEXT, PROMPT_WITH_CONTEXT  # noqa: E402


def letters_sql(x: str) -> list[str]:
    return [f"CAST(length(lower({x})) - length(replace(lower({x}), '{ch}', '')) AS DOUBLE)" for ch in "abcdefghijklmnopqrstuvwxyz"]


def l2_sql(a: list[str], b: list[str]) -> str:
    return " + ".join(f"(({x}) - ({y})) * (({x}) - ({y}))" for x, y in zip(a, b))


register("nearest_centroids", f"""
WITH u AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cen AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS c FROM u GROUP BY label, pos),
d AS (SELECT c.label AS qid, u.vec_id, sum((CAST(u.x AS DOUBLE) - c.c) * (CAST(u.x AS DOUBLE) - c.c)) AS dist
      FROM u JOIN cen c ON u.pos = c.pos GROUP BY c.label, u.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d)
SELECT qid AS label, CAST(rank AS INTEGER) AS rank, vec_id, {rhu('dist', 6)} AS dist FROM r WHERE rank <= 5
""")(RV.nearest_centroids)

_QL = letters_sql("q.text")
_DL = letters_sql("d.text")

register("knn_quality", f"""
WITH d AS (SELECT doc_id, quality, text FROM documents JOIN labels USING (doc_id)),
pairs AS (SELECT q.item_id, d.doc_id, d.quality, {l2_sql(_QL, _DL)} AS dist FROM benchmark q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, doc_id) AS rank FROM pairs),
v AS (SELECT item_id, quality, CAST(count(*) AS DOUBLE) AS votes FROM r WHERE rank <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, quality) AS rr FROM v)
SELECT item_id, quality AS predicted, votes FROM b WHERE rr = 1
""")(RV.knn_quality)


register("knn_distance", f"""
WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
d AS (SELECT q.vec_id AS qid, v.vec_id, v.label, sum((CAST(v.x AS DOUBLE) - q.x) * (CAST(v.x AS DOUBLE) - q.x)) AS dist
      FROM u q JOIN u v ON q.pos = v.pos WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d),
t AS (SELECT *, max(dist = 0) OVER (PARTITION BY qid) AS exact FROM r WHERE rank <= 5),
v AS (SELECT qid, label, sum(CASE WHEN exact THEN CASE WHEN dist = 0 THEN 1e0 ELSE 0e0 END ELSE 1e0 / dist END) AS votes FROM t GROUP BY 1, 2)
SELECT qid, label AS predicted, {rhu('votes', 6)} AS votes
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS rr FROM v) WHERE rr = 1
""")(RV.knn_distance)


register("knn_distance_all", f"""
WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
d AS (SELECT q.vec_id AS qid, v.vec_id, v.label, sum((CAST(v.x AS DOUBLE) - q.x) * (CAST(v.x AS DOUBLE) - q.x)) AS dist
      FROM u q JOIN u v ON q.pos = v.pos WHERE q.vec_id <> v.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d),
t AS (SELECT *, max(dist = 0) OVER (PARTITION BY qid) AS exact FROM r WHERE rank <= 5),
v AS (SELECT qid, label, sum(CASE WHEN exact THEN CASE WHEN dist = 0 THEN 1e0 ELSE 0e0 END ELSE 1e0 / dist END) AS votes FROM t GROUP BY 1, 2)
SELECT qid, label AS predicted, {rhu('votes', 6)} AS votes
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS rr FROM v) WHERE rr = 1
""")(RV.knn_distance_all)


register("knn_indexed")(RV.knn_indexed)
register("sparse_context")(RV.sparse_context)


def _slots_sql(table: str, key: str) -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"SELECT {key}, ('0x' || substr(md5(w), 1, 4))::INT AS slot, count(*) AS tf FROM (SELECT {key}, unnest({words}) AS w FROM {table}) GROUP BY 1, 2"


register("sparse_documents", f"""
WITH d AS ({_slots_sql('documents', 'doc_id')}), q AS ({_slots_sql('benchmark', 'item_id')}),
n AS (SELECT count(*) AS n FROM documents), f AS (SELECT slot, count(*) AS df FROM d GROUP BY 1),
dw AS (SELECT d.*, tf * (ln((1e0 + n) / (1e0 + df)) + 1) AS w FROM d JOIN f USING (slot), n),
qw AS (SELECT q.*, tf * (ln((1e0 + n) / (1e0 + coalesce(df, 0))) + 1) AS w FROM q LEFT JOIN f USING (slot), n),
dn AS (SELECT doc_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw),
qn AS (SELECT item_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qw),
s AS (SELECT item_id, doc_id, {rhu('sum(qn.w * dn.w)', 6)} AS score FROM qn JOIN dn USING (slot) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5
""")(RV.sparse_documents)


def _prompt_sql(ctx: str, q: str, domain: str = "the subject of the corpus") -> str:
    w = PROMPT_WITH_CONTEXT.replace("{domain}", domain).split("{context}")
    w2 = w[1].split("{question}")
    n = PROMPT_NO_CONTEXT.replace("{domain}", domain).split("{question}")
    return (f"CASE WHEN {ctx} IS NOT NULL AND length({ctx}) > 0 THEN {sq(w[0])} || {ctx} || {sq(w2[0])} || {q} || {sq(w2[1])} "
            f"ELSE {sq(n[0])} || {q} || {sq(n[1])} END")


_CL = letters_sql("c.text")

register("rag_context", f"""
WITH RECURSIVE {DIRTY_SQL}, src AS (SELECT doc_id, text AS t FROM cleaned),
{chunk_ctes('src', ['doc_id'])},
corp AS (SELECT doc_id, chunk_index, text FROM chunked),
pairs AS (SELECT q.item_id, c.doc_id, c.chunk_index, c.text, {l2_sql(_QL, _CL)} AS dist FROM benchmark q, corp c),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, doc_id, chunk_index) AS rank FROM pairs),
top AS (SELECT * FROM r WHERE rank <= 5),
ctx AS (SELECT item_id, CAST(count(*) AS INTEGER) AS num_sources,
               string_agg('[Document ' || CAST(rank AS VARCHAR) || ']:' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
               arg_min(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END, rank) AS top_source,
               {rhu('arg_min(dist, rank)', 6)} AS top_score
        FROM top GROUP BY item_id)
SELECT q.item_id, coalesce(ctx.num_sources, 0) AS num_sources, ctx.context, {_prompt_sql('ctx.context', 'q.text')} AS prompt,
       ctx.top_source, ctx.top_score
FROM benchmark q LEFT JOIN ctx USING (item_id)
""")(RV.rag_context)


# ---------------------------------------------------------------- fact documents
from . import facts as FD  # noqa: E402


def _fmt2(x: str) -> str:
    return f"printf('%.2f', {rhu(x, 2)})"


def _facts_sql() -> str:
    present = [(c, d) for c, d in FD.DESCRIBED if c in ("o_totalprice", "c_acctbal", "prediction_confidence")]
    params = [
        f"SELECT {10 + i} AS pos, 'parameter' AS type, '{c}' AS category, {sq(f'{c} ({d}) lies between ')} || {_fmt2(f'min({c})')} "
        f"|| ' and ' || {_fmt2(f'max({c})')} || ', half of its values below ' || {_fmt2(f'median({c})')} || ', their average being ' "
        f"|| {_fmt2(f'avg({c})')} || '; ' || count({c}) || ' of ' || count(*) || ' objects have one.' AS text FROM cat HAVING count({c}) > 0"
        for i, (c, d) in enumerate(present)]
    buckets = []
    for i, (name, lo, hi) in enumerate(FD.BUCKETS):
        cond = f"size >= {lo!r}" if hi is None else f"size >= {lo!r} AND size < {hi!r}"
        buckets.append(f"SELECT {i} AS bpos, count_if({cond}) || ' of size {name} (' || "
                       f"printf('%.1f', {spct(f'count_if({cond})', 'count(size)', 1)}) || ' percent)' AS line FROM sz")
    within = "count_if(o_totalprice BETWEEN 200000 AND 320000)"
    return f"""WITH {CATALOGUE_SQL},
vc AS (SELECT o_orderstatus, count(*) AS n FROM cat WHERE o_orderstatus IS NOT NULL GROUP BY 1),
general AS (
  SELECT 0 AS pos, 'statistics' AS type, 'general' AS category, 'The Order catalogue holds ' || (SELECT count(*) FROM cat)
         || ' objects. Recorded classes, most frequent first: ' || coalesce(b, 'none') || '.' AS text
  FROM (SELECT string_agg(o_orderstatus || ' ' || n, ', ' ORDER BY n DESC, o_orderstatus) AS b FROM vc)),
params AS ({' UNION ALL '.join(params)}),
g AS (SELECT c_name, count(*) AS size FROM cat WHERE c_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
g10 AS (SELECT * FROM g ORDER BY size DESC, c_name LIMIT 10),
groups AS (
  SELECT 20 AS pos, 'systems' AS type, 'multi_member' AS category,
         (SELECT count(*) FROM g) || ' groups have several members, the largest being '
         || coalesce((SELECT string_agg(c_name || ' with ' || size, '; ' ORDER BY size DESC, c_name) FROM g10), '') || '.' AS text
  WHERE (SELECT count(*) FROM g) > 0),
rng AS (
  SELECT 30 AS pos, 'science' AS type, 'range' AS category,
         {within} || ' objects have a o_totalprice from 200000 to 320000, that is ' || printf('%.1f', {spct(within, 'count(*)', 1)})
         || ' percent of all.' AS text
  FROM cat HAVING {within} > 0),
sz AS (SELECT o_totalprice / 1e5 AS size FROM cat),
bl AS ({' UNION ALL '.join(buckets)}),
sizes AS (SELECT 40 AS pos, 'statistics' AS type, 'sizes' AS category, 'Objects by size: ' || string_agg(line, ', ' ORDER BY bpos) || '.' AS text FROM bl),
method AS (SELECT 50 AS pos, 'methodology' AS type, 'method' AS category, {sq(FD.METHOD_TEXT)} AS text)
SELECT * FROM general UNION ALL SELECT * FROM params UNION ALL SELECT * FROM groups UNION ALL SELECT * FROM rng
UNION ALL SELECT * FROM sizes UNION ALL SELECT * FROM method"""


register("fact_documents", _facts_sql())(FD.fact_documents)


# ---------------------------------------------------------------- publishing
from . import cycles as CY  # noqa: E402
from . import publishing as PU  # noqa: E402

register("upsert", f"""
WITH u AS (SELECT o_custkey AS c_custkey, {rhu('sum(o_totalprice) / 1e3', 2)} AS new_bal FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name,
       CASE WHEN u.c_custkey IS NOT NULL THEN u.new_bal ELSE c.c_acctbal END AS c_acctbal,
       CASE WHEN u.c_custkey IS NOT NULL THEN 'PRIORITY' ELSE c.c_mktsegment END AS c_mktsegment,
       u.c_custkey IS NOT NULL AS updated
FROM customer c LEFT JOIN u ON c.c_custkey = u.c_custkey
""")(PU.upsert)

register("match_counts", """
WITH k AS (SELECT DISTINCT c_custkey FROM customer)
SELECT count(*) AS n_updates, count(k.c_custkey) AS matched, count_if(k.c_custkey IS NULL) AS unmatched
FROM orders o LEFT JOIN k ON o.o_custkey = k.c_custkey
""")(PU.match_counts)

register("key_check", """
SELECT p_name, count(*) AS count FROM part GROUP BY p_name HAVING count(*) > 1
""")(PU.key_check)


register("publish_cycle", f"""
WITH u AS (SELECT o_custkey AS c_custkey, {rhu('sum(o_totalprice) / 1e3', 2)} AS new_bal FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name,
       CASE WHEN u.c_custkey IS NOT NULL THEN u.new_bal ELSE c.c_acctbal END AS c_acctbal,
       CASE WHEN u.c_custkey IS NOT NULL THEN 'PRIORITY' ELSE c.c_mktsegment END AS c_mktsegment,
       'insert update skipped' AS actions
FROM customer c LEFT JOIN u ON c.c_custkey = u.c_custkey
""")(CY.publish_cycle)

register("bucketed_cycle", f"""
WITH u AS (SELECT o_custkey AS c_custkey, {rhu('sum(o_totalprice) / 1e3', 2)} AS new_bal FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
z AS (SELECT max(c_custkey) AS k FROM customer)
SELECT c.c_custkey, c.c_name, CASE WHEN u.c_custkey IS NOT NULL THEN u.new_bal ELSE c.c_acctbal END AS c_acctbal,
       CASE WHEN c.c_custkey = z.k THEN 'LAST' WHEN u.c_custkey IS NOT NULL THEN 'PRIORITY' ELSE c.c_mktsegment END AS c_mktsegment,
       1 AS rewritten, (SELECT c_name FROM customer, z WHERE c_custkey = k) AS found
FROM customer c CROSS JOIN z LEFT JOIN u ON c.c_custkey = u.c_custkey
""")(CY.bucketed_cycle)

register("csv_cycle", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'csv' AS came_from FROM orders")(CY.csv_cycle)
register("json_cycle", "SELECT p_partkey, p_name, p_retailprice FROM part")(CY.json_cycle)

register("corpus_cycle", f"""
WITH facts AS ({_facts_sql()}),
r AS (SELECT source AS type FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT type FROM facts)
SELECT type, count(*) AS n FROM r GROUP BY type
""")(CY.corpus_cycle)


register("relanded_corpus", f"""
WITH RECURSIVE kept AS (
  SELECT coalesce(lang, 'none') AS file, doc_id, {clean_sql('text')} AS t FROM documents
  WHERE text IS NOT NULL AND (coalesce(lang, 'none') <> (SELECT min(coalesce(lang, 'none')) FROM documents) OR length(text) >= 400)),
{chunk_ctes('kept', ['file', 'doc_id'])}
SELECT file, doc_id, chunk_index, n_chunks, text FROM chunked
""")(CY.relanded_corpus)

register("stored_collection", """
SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN -1e0 ELSE CAST(c_acctbal AS DOUBLE) END AS c_acctbal, 'table' AS came_from,
       'c_custkey,c_name,c_acctbal,feature_0,feature_1' AS names FROM customer
UNION ALL SELECT 0, 'added', -1e0, 'table', 'c_custkey,c_name,c_acctbal,feature_0,feature_1'
""")(CY.stored_collection)

register("binary_ingest", f"""
WITH pt AS (SELECT page_id, {clean_sql(html_sql('html'))} AS text FROM pages)
SELECT page_id, length(text) AS n_chars FROM pt WHERE length({py_strip_sql('text')}) >= 1500
""")(CY.binary_ingest)

register("run_registry", f"""
WITH rep AS (SELECT * FROM ({ORACLE['class_report']})),
w AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {rhu(f"abs(corr({c}, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END))", 9)} AS value FROM lineitem"
                          for c in CY.RUN_FEATURES)}),
m AS (SELECT label AS name, 'value' AS metric, f1 AS value FROM rep WHERE label = 'accuracy'
      UNION ALL SELECT label, 'precision', precision FROM rep WHERE label <> 'accuracy'
      UNION ALL SELECT label, 'recall', recall FROM rep WHERE label <> 'accuracy'
      UNION ALL SELECT label, 'f1', f1 FROM rep WHERE label <> 'accuracy'
      UNION ALL SELECT label, 'support', CAST(support AS DOUBLE) FROM rep WHERE label <> 'accuracy')
SELECT 'second' AS run, 'metric' AS part, name, metric, value FROM m
UNION ALL SELECT 'second', 'importance', name, 'value', value FROM (SELECT * FROM w ORDER BY value DESC, name LIMIT 3)
UNION ALL SELECT 'second', 'status', 'n_features', 'value', {len(CY.RUN_FEATURES)}e0
UNION ALL SELECT 'second', 'status', 'n_classes', 'value', CAST(count(*) AS DOUBLE) FROM rep WHERE label NOT IN ('accuracy', 'macro avg', 'weighted avg')
UNION ALL SELECT 'second', 'status', 'accuracy', 'value', f1 FROM rep WHERE label = 'accuracy'
""")(CY.run_registry)


# ---------------------------------------------------------------- column preparation
from . import preparation as PR  # noqa: E402

register("aligned_features", """
WITH f AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN code IS NULL THEN 2 ELSE 1 END AS missing_count,
       CASE WHEN code IS NULL THEN 'code,not_there' ELSE 'not_there' END AS missing_head,
       l_tax, code, l_quantity, 0e0 AS not_there
FROM f
""")(PR.aligned_features)

register("records", """
SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR) AS record FROM customer
""")(PR.records)

register("listing_filled", f"""
WITH {CATALOGUE_SQL}
SELECT o_orderkey, is_filled, 3 AS n_classes, {rhu('prob_FILLED', 6)} AS p_filled, {rhu('prob_OPEN', 6)} AS p_open,
       {rhu('prob_PARTIAL_FILL', 6)} AS p_partial_fill
FROM cat WHERE is_filled ORDER BY o_orderkey LIMIT 80
""")(PR.listing_filled)

register("deep_page", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 500 OFFSET 4000
""")(PR.deep_page)

register("suffixed_join", """
SELECT o_orderkey, o_custkey, o_totalprice AS balance, c_custkey, c_acctbal AS balance_right
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")(PR.suffixed_join)

register("top_orders", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 3
""")(PR.top_orders)

register("brands", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")(PR.brands)
register("best_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")(PR.best_order)

register("quarantined_pages", f"""
WITH pt AS (SELECT page_id, url, {clean_sql(html_sql('html'))} AS text FROM pages)
SELECT page_id, url FROM pt WHERE text IS NULL OR length({py_strip_sql('text')}) < 1500
""")(PR.quarantined_pages)

register("chunk_metadata", f"""
WITH RECURSIVE {CORPUS_SQL}
SELECT doc_id, chunk_index, type AS m_type, filename AS m_filename, CAST(chunk_index AS VARCHAR) AS m_chunk_index,
       CAST(n_chunks AS VARCHAR) AS m_total_chunks, 'driver' AS m_origin
FROM corpus
""")(PR.chunk_metadata)

register("text_sizes", f"""
SELECT doc_id, strlen(text) / 1024e0 AS kb, {rhu('strlen(text) / 1048576e0', 9)} AS mb FROM documents
""")(PR.text_sizes)


def _prepared_sql() -> str:
    f = T.FEATURES
    med = ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(f))
    filled = ", ".join(f"coalesce({c}, m{i}) AS x{i}" for i, c in enumerate(f))
    mom = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(len(f)))
    out = ", ".join(f"{rhu(f'(x{i} - a{i}) / CASE WHEN s{i} = 0 THEN 1e0 ELSE s{i} END', 5)} AS {c}" for i, c in enumerate(f))
    return f"""WITH {FEAT_SQL}, med AS (SELECT {med} FROM feat),
filled AS (SELECT l_orderkey, l_linenumber, {filled} FROM feat, med), mom AS (SELECT {mom} FROM filled)
SELECT l_orderkey, l_linenumber, {out} FROM filled, mom"""


register("prepared_features", _prepared_sql())(PR.prepared_features)

NAN_SQL = """feat AS (
  SELECT l_quantity, CASE WHEN l_linenumber <> 7 THEN l_tax END AS tax, CASE WHEN l_quantity >= 9 THEN l_discount END AS discount
  FROM lineitem)"""

register("nan_describe", f"WITH {NAN_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {rhu(f'avg({c})', 6)} AS mean, {rhu(f'median({c})', 6)} AS median, min({c}) AS min, "
    f"max({c}) AS max, count({c}) AS n, count(*) AS total FROM feat" for c in PR.NAN_COLUMNS))(PR.nan_describe)

register("nan_correlation", f"WITH {NAN_SQL} " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS col_i, '{b}' AS col_j, CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS DOUBLE) AS n, "
    f"{rhu(f'corr({a}, {b})', 6)} AS r FROM feat"
    for i, a in enumerate(PR.NAN_COLUMNS) for j, b in enumerate(PR.NAN_COLUMNS) if i < j))(PR.nan_correlation)


# ---------------------------------------------------------------- learning
from . import modeling as MD  # noqa: E402


def _nb_sql(k: str) -> str:
    """Gaussian naive Bayes over CTE ``part`` (vec_id, label, fold, held): for
    every ``k`` (a fold, or nothing) the rows with fold = k are scored by a
    model of the others. Ends with CTE ``best``."""
    return f"""x AS (SELECT e.vec_id, CAST(e.label AS VARCHAR) AS label, unnest(e.embedding) AS v, generate_subscripts(e.embedding, 1) AS pos FROM embeddings e),
runs AS ({k}),
model AS (SELECT r.k, x.label, x.pos, avg(CAST(x.v AS DOUBLE)) AS mu, var_pop(CAST(x.v AS DOUBLE)) AS s2, count(*) AS n
          FROM x JOIN part p USING (vec_id) JOIN runs r ON p.fold <> r.k GROUP BY 1, 2, 3),
score AS (SELECT r.k, x.vec_id, x.label, m.label AS predicted,
                 ln(any_value(m.n)) - 5e-1 * sum((x.v - m.mu) * (x.v - m.mu) / m.s2 + ln(m.s2)) AS s
          FROM x JOIN part p USING (vec_id) JOIN runs r ON p.fold = r.k JOIN model m ON m.k = r.k AND m.pos = x.pos GROUP BY 1, 2, 3, 4),
best AS (SELECT k, vec_id, label, arg_max(predicted, s) AS predicted, max(s) AS top FROM score GROUP BY 1, 2, 3)"""


def _vec_rank(seed: int) -> str:
    return (f"SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{seed}'), vec_id) AS r, "
            "count(*) OVER (PARTITION BY label) AS n FROM embeddings")


NB_TEST_SQL = f"""WITH part AS (SELECT vec_id, CASE WHEN r <= floor(n * 2e-1 + 5e-1) THEN 0 ELSE 1 END AS fold FROM ({_vec_rank(42)})),
{_nb_sql('SELECT 0 AS k')}"""

register("nb_predictions", f"""
{NB_TEST_SQL}
SELECT b.vec_id, b.label, b.predicted, round(1e0 / sum(exp(s.s - b.top)), 5) AS confidence
FROM best b JOIN score s USING (vec_id) GROUP BY 1, 2, 3
""")(MD.nb_predictions)

register("nb_report", _report_sql(f"{NB_TEST_SQL}, lab AS (SELECT label AS actual, predicted FROM best)"))(MD.nb_report)

register("predict_file", f"""
{NB_TEST_SQL}, c AS (SELECT b.vec_id, b.predicted, 1e0 / sum(exp(s.s - b.top)) AS confidence FROM best b JOIN score s USING (vec_id) GROUP BY 1, 2)
SELECT predicted, count(*) AS count, round(avg(confidence), 5) AS mean_confidence FROM c GROUP BY 1
""")(MD.predict_file)

register("predict_fallback", f"""
{NB_TEST_SQL}
SELECT 'model' AS "case", vec_id, predicted, 'model' AS source, false AS fallback, false AS unsure FROM best
UNION ALL SELECT 'absent', vec_id, label, 'dataset', true, true FROM best
UNION ALL SELECT 'columns', vec_id, label, 'dataset', true, true FROM best
""")(MD.predict_fallback)

register("nb_fold_scores", f"""
WITH part AS (SELECT vec_id, (r - 1) % 5 AS fold FROM ({_vec_rank(42)})),
{_nb_sql('SELECT unnest([0, 1, 2, 3, 4]) AS k')}
SELECT CAST(k AS INTEGER) AS fold, round(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 9) AS score FROM best GROUP BY k
""")(MD.nb_fold_scores)

CV_SQL = f"""WITH part AS (SELECT vec_id, label, (r - 1) % 5 AS fold FROM (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) AS r FROM embeddings)),
x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
runs AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
own AS (SELECT r.k, p.label, x.pos, avg(CAST(x.v AS DOUBLE)) AS mu, var_pop(CAST(x.v AS DOUBLE)) AS s2, count(*) AS n
        FROM x JOIN part p USING (vec_id) JOIN runs r ON p.fold <> r.k GROUP BY 1, 2, 3),
model AS (SELECT 'naive_bayes' AS family, k, label, pos, mu, s2, n FROM own
          UNION ALL SELECT 'discriminant', k, label, pos, mu, sum(n * s2) OVER (PARTITION BY k, pos) / sum(n) OVER (PARTITION BY k, pos), n FROM own),
score AS (SELECT m.family, m.k, x.vec_id, p.label, m.label AS predicted,
                 ln(any_value(m.n)) - 5e-1 * sum((x.v - m.mu) * (x.v - m.mu) / m.s2 + ln(m.s2)) AS s
          FROM x JOIN part p USING (vec_id) JOIN model m ON m.k = p.fold AND m.pos = x.pos GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT family, k AS fold, vec_id, label, arg_max(predicted, s) AS predicted FROM score GROUP BY 1, 2, 3, 4),
per AS (SELECT a.family, a.fold, a.label, a.support, a.tp, coalesce(g.guessed, 0) AS guessed
        FROM (SELECT family, fold, label, count(*) AS support, count_if(label = predicted) AS tp FROM best GROUP BY 1, 2, 3) a
        LEFT JOIN (SELECT family, fold, predicted AS label, count(*) AS guessed FROM best GROUP BY 1, 2, 3) g USING (family, fold, label)),
pr AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0e0 END AS p, tp / support AS r FROM per),
fm AS (SELECT family, fold, sum(support) AS n, sum(tp) / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision,
              sum(r * support) / sum(support) AS recall,
              sum(CASE WHEN p + r > 0 THEN 2e0 * p * r / (p + r) ELSE 0e0 END * support) / sum(support) AS f1
       FROM pr GROUP BY 1, 2)"""

register("cv_metrics", f"""{CV_SQL}
SELECT family, CAST(fold AS INTEGER) AS fold, CAST(n AS BIGINT) AS n, {rhu('accuracy', 6)} AS accuracy, {rhu('precision', 6)} AS precision,
       {rhu('recall', 6)} AS recall, {rhu('f1', 6)} AS f1 FROM fm""")(MD.cv_metrics)

register("cv_leaderboard", f"""{CV_SQL}, b AS (
  SELECT family, count(*) AS n_folds, avg(accuracy) AS cv_mean, stddev_pop(accuracy) AS cv_std, avg(precision) AS precision,
         avg(recall) AS recall, avg(f1) AS f1 FROM fm GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY cv_mean DESC, family) AS INTEGER) AS rank, family, n_folds, {rhu('cv_mean', 6)} AS cv_mean,
       {rhu('cv_std', 6)} AS cv_std, {rhu('precision', 6)} AS precision, {rhu('recall', 6)} AS recall, {rhu('f1', 6)} AS f1 FROM b
""")(MD.cv_leaderboard)

GROUP_SQL = """WITH cells AS (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2),
top AS (SELECT o_custkey, o_orderstatus AS stratum, c AS w FROM cells
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderstatus DESC) = 1),
run AS (SELECT *, sum(w) OVER (PARTITION BY stratum ORDER BY md5(CAST(o_custkey AS VARCHAR) || ':42'), o_custkey) - w AS start,
               sum(w) OVER (PARTITION BY stratum) AS total FROM top),
dealt AS (SELECT o_custkey, (start + w / 2e0) / total AS place FROM run)"""

register("group_split", f"""{GROUP_SQL}
SELECT o_orderkey, o_custkey, CASE WHEN place < 2e-1 THEN 'test' WHEN place < 2e-1 + 1e-1 THEN 'val' ELSE 'train' END AS split
FROM orders JOIN dealt USING (o_custkey)
""")(MD.group_split)

register("group_folds", f"""{GROUP_SQL}
SELECT CAST(least(floor(place * 5), 4) AS INTEGER) AS fold, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders JOIN dealt USING (o_custkey) GROUP BY 1, 2
""")(MD.group_folds)

# (trees and solvers below have no SQL form: rows-only)

register("train_evaluate")(MD.train_evaluate)
register("confusion_test")(MD.confusion_test)
register("cv_scores")(MD.cv_scores)
register("model_search")(MD.model_search)
register("family_leaderboard")(MD.family_leaderboard)
register("batch_scores")(MD.batch_scores)
register("feature_importance")(MD.feature_importance)
register("tree_metrics")(MD.tree_metrics)
register("split_usage")(MD.split_usage)
register("boosted_history")(MD.boosted_history)
register("softmax_boost")(MD.softmax_boost)
