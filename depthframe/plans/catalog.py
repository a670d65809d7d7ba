"""The registered queries over the derived fixture and, for each, the SQL that it is compared with.

The SQL counts single bases where the queries sweep over runs, so that both are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, gaps, layout, query, reads, series, stats
from ..sources import fixture, schema
from .engine import Analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The component and ranges that the query examples ask for.
CID, RANGE, ROUND_RANGE = 3, (20, -20), (-30, 25)
POINTS, SHARE, LOG_BASE = 60, 0.1, 10
NAMES = ("0", "7", "007", "99", "Brand#12", "brand#3", "BRAND#25", "Brnd#12", "99999999999999999999999")
MISSPELLED = ("brand#1", "Brnd#12", "brand12", "zzz", "BRAND#2")

_PARTS = """
comps AS (SELECT (row_number() OVER (ORDER BY name) - 1)::INTEGER AS cid, name FROM (SELECT DISTINCT p_brand AS name FROM part)),
nodes AS (SELECT c.cid, c.name, (p_partkey + 1)::BIGINT AS node_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) - 1)::BIGINT AS idx, p_size::BIGINT AS seq_len FROM part JOIN comps c ON c.name = p_brand),
layout AS (SELECT *, (sum(seq_len) OVER w - seq_len)::BIGINT AS bp_start, (sum(seq_len) OVER w)::BIGINT AS bp_end FROM nodes WINDOW w AS (PARTITION BY cid ORDER BY idx ROWS UNBOUNDED PRECEDING)),
lens AS (SELECT cid, sum(seq_len)::BIGINT AS length FROM nodes GROUP BY cid)"""

_MAPS = """
maps AS (SELECT l_orderkey AS read_id, (row_number() OVER w - 1)::BIGINT AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n_map,
  CASE WHEN round(l_discount * 100)::INTEGER = 10 THEN 0 ELSE l_partkey + 1 END::BIGINT AS node_id, (l_quantity::INTEGER % 7)::BIGINT AS off, l_returnflag = 'R' AS rev,
  l_linenumber::BIGINT AS m1, (round(l_tax * 100)::INTEGER % 4)::BIGINT AS del,
  greatest(0, coalesce(p_size, 0) - (l_quantity::INTEGER % 7) - l_linenumber - (round(l_tax * 100)::INTEGER % 4) - l_suppkey % 3)::BIGINT AS m2
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)),
placed AS (SELECT m.read_id, m.ord, m.n_map, m.off, m.rev, m.m1, m.del, m.m2, l.*, least(greatest(m.off, 0), l.seq_len) AS o FROM maps m JOIN layout l ON l.node_id = m.node_id WHERE m.node_id > 0 {active})"""

_GAPS = """
raw AS (
  SELECT *, 'deletion' AS kind, CASE WHEN rev THEN seq_len - o - m1 - del ELSE o + m1 END AS a, CASE WHEN rev THEN seq_len - o - m1 ELSE o + m1 + del END AS b FROM placed WHERE del > 0
  UNION ALL SELECT *, 'leading', CASE WHEN rev THEN seq_len - o ELSE 0 END, CASE WHEN rev THEN seq_len ELSE o END FROM placed WHERE ord = 0
  UNION ALL SELECT *, 'trailing', CASE WHEN rev THEN 0 ELSE o + least(m1 + del + m2, seq_len - o) END, CASE WHEN rev THEN seq_len - o - least(m1 + del + m2, seq_len - o) ELSE seq_len END FROM placed WHERE ord = n_map - 1),
gaps AS (SELECT * REPLACE (least(greatest(a, 0), seq_len) AS a, least(greatest(b, 0), seq_len) AS b) FROM raw WHERE seq_len > 0 AND least(greatest(b, 0), seq_len) > least(greatest(a, 0), seq_len))"""

_DEPTH = "depth AS (SELECT node_id, count(*) AS depth FROM placed GROUP BY node_id)"
_NODE_BASES = "node_bases AS (SELECT l.cid, l.idx, unnest(range(l.bp_start, l.bp_end)) AS pos, coalesce(d.depth, 0)::BIGINT AS depth FROM layout l LEFT JOIN depth d USING (node_id))"
_BASES = """
lost AS (SELECT cid, pos, count(*) AS n FROM (SELECT cid, unnest(range(bp_start + a, bp_start + b)) AS pos FROM gaps) GROUP BY 1, 2),
bases AS (SELECT n.cid, n.idx, n.pos, (n.depth - coalesce(l.n, 0))::BIGINT AS depth FROM node_bases n LEFT JOIN lost l USING (cid, pos))"""


def _with(*parts: str, active: str = "") -> str:
    return "WITH " + ",\n".join(p.replace("{active}", active) for p in parts)


_ALL = (_PARTS, _MAPS, _GAPS, _DEPTH, _NODE_BASES, _BASES)
_CELLS = f"c AS (SELECT length AS len, {RANGE[0]} AS qs, length + {RANGE[1]} AS qe, length + {ROUND_RANGE[0]} AS rs, {ROUND_RANGE[1]} AS re FROM lens WHERE cid = {CID})"


def _at(p: str) -> str:
    return f"(SELECT idx FROM layout, c WHERE cid = {CID} AND bp_start <= {p} AND {p} < bp_end)"


_STRAIGHT = f"AND l.cid = {CID} AND l.idx BETWEEN (SELECT idx FROM layout l2, c WHERE l2.cid = {CID} AND l2.bp_start <= c.qs AND c.qs < l2.bp_end) AND (SELECT idx FROM layout l2, c WHERE l2.cid = {CID} AND l2.bp_start <= c.qe AND c.qe < l2.bp_end)"
_ROUND = f"AND l.cid = {CID} AND (l.idx >= (SELECT idx FROM layout l2, c WHERE l2.cid = {CID} AND l2.bp_start <= c.rs AND c.rs < l2.bp_end) OR l.idx <= (SELECT idx FROM layout l2, c WHERE l2.cid = {CID} AND l2.bp_start <= c.re AND c.re < l2.bp_end))"
_SAME = f"same AS (SELECT node_id, idx, bp_start, bp_end, bp_start + 3 AS s, bp_start + 1 AS e FROM layout WHERE cid = {CID} AND seq_len >= 5 ORDER BY idx LIMIT 1)"


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    components, nodes = fixture.graph(spark, sf_dir)
    return Analysis(nodes, components, fixture.alignments(spark, sf_dir))


def _six(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _straight(a: Analysis) -> query.Scope:
    return a.scope(f"{CID} {RANGE[0]}:{RANGE[1]}")


def _round(a: Analysis) -> query.Scope:
    return a.scope(f"{CID} {ROUND_RANGE[0]}:{ROUND_RANGE[1]}", circular=True)


def _same_node(a: Analysis) -> query.Scope:
    """A range whose start is behind its end in one node: only that node takes part."""
    node = a.layout().where((F.col("cid") == CID) & (F.col("seq_len") >= 5)).orderBy("idx").first()
    return a.scope(f"{CID} {node['bp_start'] + 3}:{node['bp_start'] + 1}", circular=True)


# --- layout ---------------------------------------------------------------------------------


@_query("node_layout", _with(_PARTS) + " SELECT cid, node_id, idx, seq_len, bp_start, bp_end FROM layout")
def node_layout(spark, sf_dir):
    return analysis(spark, sf_dir).layout().select("cid", "node_id", "idx", "seq_len", "bp_start", "bp_end")


_SUMMARY = "summary AS (SELECT cid, name, min(node_id) AS nid_min, max(node_id) AS nid_max, count(*) AS nb_nodes, sum(seq_len)::BIGINT AS length_bp FROM nodes GROUP BY cid, name)"


@_query("component_summary", _with(_PARTS, _SUMMARY) + " SELECT * FROM summary")
def component_summary(spark, sf_dir):
    return analysis(spark, sf_dir).summary()


@_query("component_summary_total", _with(_PARTS, _SUMMARY) + " SELECT cid::VARCHAR AS label, nb_nodes, length_bp FROM summary UNION ALL SELECT 'Total', sum(nb_nodes)::BIGINT, sum(length_bp)::BIGINT FROM summary")
def component_summary_total(spark, sf_dir):
    return layout.component_totals(analysis(spark, sf_dir).summary())


@_query("inspect_format", _with(_PARTS, _SUMMARY) + " SELECT cid, CASE WHEN length(name) > 14 THEN left(name, 13) || '~' ELSE name END AS short_name, format('{:,}', length_bp) AS length_text, format('{:,}', nb_nodes) AS nodes_text, format('{:,}', nid_min) || '-' || format('{:,}', nid_max) AS range_text FROM (SELECT * REPLACE (name || CASE WHEN cid % 2 = 0 THEN ' of the fixture' ELSE '' END AS name) FROM summary)")
def inspect_format(spark, sf_dir):
    long = F.concat("name", F.when(F.col("cid") % 2 == 0, " of the fixture").otherwise(""))
    return layout.inspect_rows(analysis(spark, sf_dir).summary().withColumn("name", long))


# --- what a user asks for --------------------------------------------------------------------

_ASKED = "asked AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS query)"


@_query("resolve_component", _with(_PARTS, _ASKED) + " SELECT query, cid, name FROM asked LEFT JOIN comps ON CASE WHEN regexp_full_match(query, '[0-9]+') THEN try_cast(query AS BIGINT) = cid ELSE lower(query) = lower(name) END")
def resolve_component(spark, sf_dir):
    return query.resolve_names(spark.createDataFrame([(n,) for n in NAMES], "query string"), fixture.components(spark, sf_dir))


_TWINS = "twins AS (SELECT cid, name FROM comps UNION ALL SELECT cid + 100, upper(name) FROM comps WHERE cid % 5 = 0)"


@_query("duplicate_names", _with(_PARTS, _TWINS) + " SELECT lower(name) AS lower_name, count(*) AS n, min(cid) AS first_cid, max(cid) AS last_cid FROM twins GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    own = fixture.components(spark, sf_dir)
    return schema.duplicate_names(own.unionByName(own.where("cid % 5 = 0").select((F.col("cid") + 100).alias("cid"), F.upper("name").alias("name"))))


_WRONG = "asked AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in MISSPELLED) + "]) AS query)"


@_query("levenshtein_suggest", _with(_PARTS, _WRONG) + """, far AS (SELECT query, cid, name, CASE WHEN starts_with(lower(name), lower(query)) THEN -1 ELSE levenshtein(lower(query), lower(name)) END AS far FROM asked, comps
  WHERE starts_with(lower(name), lower(query)) OR levenshtein(lower(query), lower(name)) <= greatest(2, length(query) // 4))
  SELECT query, rank::INTEGER AS rank, name FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY far, cid) AS rank FROM far) WHERE rank <= 3""")
def levenshtein_suggest(spark, sf_dir):
    return query.suggestions(MISSPELLED, fixture.components(spark, sf_dir))


@_query("bp_lookup", _with(_PARTS) + ", points AS (SELECT DISTINCT cid, (unnest(range(10)) * length) // 10 AS pos FROM lens) SELECT p.cid, p.pos, l.node_id, l.idx FROM points p JOIN layout l ON l.cid = p.cid AND l.bp_start <= p.pos AND p.pos < l.bp_end")
def bp_lookup(spark, sf_dir):
    a = analysis(spark, sf_dir)
    points = a.lengths().select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(k * F.col("length") / 10))).alias("pos")).distinct()
    return layout.node_at(a.layout(), points)


@_query("asof_component", _with(_PARTS, _SUMMARY) + ", o AS (SELECT cid, sum(nb_nodes) OVER (ORDER BY cid) - nb_nodes AS first FROM summary), f AS (SELECT unnest(range(0, (SELECT sum(nb_nodes) FROM summary)::BIGINT)) AS flat_idx) SELECT flat_idx, cid, (flat_idx - first)::BIGINT AS idx FROM f ASOF JOIN o ON flat_idx >= first")
def asof_component(spark, sf_dir):
    a = analysis(spark, sf_dir)
    points = a.nodes.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("flat_idx"))
    return layout.component_of(a.summary(), points)


@_query("query_nodes", _with(_PARTS, _CELLS) + f" SELECT node_id, idx FROM layout WHERE cid = {CID} AND (idx >= {_at('c.rs')} OR idx <= {_at('c.re')})")
def query_nodes(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.nodes.where(_round(a).active()).select("node_id", "idx")


# --- reads -----------------------------------------------------------------------------------


@_query("mappings_exploded", _with(_PARTS, _MAPS) + " SELECT read_id, ord, n_map, node_id, off AS offset, rev AS is_reverse, (CASE WHEN m1 > 0 THEN 1 ELSE 0 END + CASE WHEN del > 0 THEN 1 ELSE 0 END + CASE WHEN m2 > 0 THEN 1 ELSE 0 END)::INTEGER AS n_edits FROM maps")
def mappings_exploded(spark, sf_dir):
    return reads.mappings(fixture.alignments(spark, sf_dir)).withColumn("n_edits", F.size("edits")).drop("edits")


@_query("path_ends", _with(_PARTS, _MAPS) + " SELECT read_id, ord, ord = 0 AS is_first, ord = n_map - 1 AS is_last FROM maps")
def path_ends(spark, sf_dir):
    return reads.path_ends(reads.mappings(fixture.alignments(spark, sf_dir)))


@_query("edit_walk", _with(_PARTS, _MAPS) + """, e AS (SELECT read_id, ord, node_id, 0 AS k, m1 AS f, m1 AS t FROM maps UNION ALL SELECT read_id, ord, node_id, 1, del, 0 FROM maps UNION ALL SELECT read_id, ord, node_id, 2, m2, m2 FROM maps)
  SELECT read_id, ord, node_id, (row_number() OVER w - 1)::BIGINT AS edit_idx, f AS from_length, t::BIGINT AS to_length, (sum(f) OVER (PARTITION BY read_id, ord ORDER BY k ROWS UNBOUNDED PRECEDING) - f)::BIGINT AS walk_start, f > 0 AND t = 0 AS is_deletion
  FROM e WHERE f > 0 WINDOW w AS (PARTITION BY read_id, ord ORDER BY k)""")
def edit_walk(spark, sf_dir):
    return reads.edit_walk(reads.mappings(fixture.alignments(spark, sf_dir)))


_FLAGS = "flags AS (SELECT o_orderkey AS read_id, coalesce(bool_or(m.node_id > 0), false) AS mapped, coalesce(bool_or(m.node_id > 0 AND n.node_id IS NOT NULL), false) AS in_query FROM orders LEFT JOIN maps m ON m.read_id = o_orderkey LEFT JOIN (SELECT node_id FROM layout l {where}) n ON n.node_id = m.node_id GROUP BY 1)"
_PERCENT = """ SELECT total, mapped, mapped_to_query, total - mapped AS unmapped, round(CASE WHEN total > 0 THEN 100.0 * mapped / total ELSE 0 END, 6)::DOUBLE AS pct_mapped, round(CASE WHEN total > 0 THEN 100.0 * mapped_to_query / total ELSE 0 END, 6)::DOUBLE AS pct_query_total,
  round(CASE WHEN mapped > 0 THEN 100.0 * mapped_to_query / mapped ELSE 0 END, 6)::DOUBLE AS pct_query_mapped, round(CASE WHEN total > 0 THEN 100.0 * (total - mapped) / total ELSE 0 END, 6)::DOUBLE AS pct_unmapped
  FROM (SELECT count(*) AS total, count(*) FILTER (mapped) AS mapped, count(*) FILTER (mapped AND in_query) AS mapped_to_query FROM flags)"""


@_query("read_flags", _with(_PARTS, _MAPS, _FLAGS.replace("{where}", "WHERE cid < 5")) + " SELECT * FROM flags")
def read_flags(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return reads.read_flags(a.alignments, a.nodes.where("cid < 5"))


@_query("reads_in_query", _with(_PARTS, _CELLS, _MAPS, active=_STRAIGHT) + " SELECT DISTINCT read_id FROM placed")
def reads_in_query(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return reads.reads_in_query(a.alignments, a.nodes.where(_straight(a).active()))


def _percents(df: DataFrame) -> DataFrame:
    rounded = [c for c in df.columns if c.startswith("pct_")]
    return df.select(*(c for c in df.columns if c not in rounded), *_six(*rounded))


@_query("mapping_stats", _with(_PARTS, _MAPS, _FLAGS.replace("{where}", "")) + _PERCENT)
def mapping_stats(spark, sf_dir):
    return _percents(analysis(spark, sf_dir).mapping_stats())


@_query("mapping_stats_query", _with(_PARTS, _CELLS, _MAPS, _FLAGS.replace("{where}", "WHERE true " + _STRAIGHT)) + _PERCENT)
def mapping_stats_query(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return _percents(a.mapping_stats(_straight(a)))


# --- depth of nodes and gaps --------------------------------------------------------------------


@_query("node_depth", _with(_PARTS, _MAPS) + " SELECT cid, node_id, count(*) AS depth FROM placed GROUP BY 1, 2")
def node_depth(spark, sf_dir):
    return analysis(spark, sf_dir).depth()


@_query("node_depth_projected", _with(_PARTS, _MAPS, _DEPTH) + " SELECT cid, idx, node_id, coalesce(depth, 0)::BIGINT AS depth FROM layout LEFT JOIN depth USING (node_id)")
def node_depth_projected(spark, sf_dir):
    a = analysis(spark, sf_dir)
    laid = a.layout()
    return coverage.project_depth(laid, a.depth(laid=laid)).select("cid", "idx", "node_id", "depth")


def _gap_query(kind: str) -> None:
    @_query(f"gaps_{kind}", _with(_PARTS, _MAPS, _GAPS) + f" SELECT read_id, ord, cid, node_id, a AS gap_start, b AS gap_end FROM gaps WHERE kind = '{kind}'")
    def find(spark, sf_dir):
        return gaps.gaps(analysis(spark, sf_dir).placed()).where(F.col("kind") == kind).select("read_id", "ord", "cid", "node_id", "gap_start", "gap_end")


for _kind in ("deletion", "leading", "trailing"):
    _gap_query(_kind)


# --- depth of bases -----------------------------------------------------------------------------


@_query("coverage_node", _with(_PARTS, _MAPS, _DEPTH, _NODE_BASES) + " SELECT cid, pos AS position, depth AS coverage FROM node_bases")
def coverage_node(spark, sf_dir):
    return coverage.bases(analysis(spark, sf_dir).runs("node"))


@_query("coverage_base", _with(*_ALL) + " SELECT name AS component_name, pos AS position, depth AS coverage FROM bases JOIN comps USING (cid)")
def coverage_base(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return coverage.named_bases(a.runs(), a.components)


@_query("coverage_runs", _with(*_ALL) + """, marks AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY cid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM bases),
  runs AS (SELECT *, sum(new) OVER (PARTITION BY cid ORDER BY pos) AS run FROM marks) SELECT cid, min(pos) AS start, max(pos) + 1 AS "end", min(depth) AS depth FROM runs GROUP BY cid, run""")
def coverage_runs(spark, sf_dir):
    return analysis(spark, sf_dir).runs()


@_query("query_range", _with(_PARTS, _CELLS, *_ALL[1:], active=_STRAIGHT) + f" SELECT name AS component_name, pos AS position, depth AS coverage FROM bases JOIN comps USING (cid), c WHERE cid = {CID} AND pos BETWEEN c.qs AND c.qe")
def query_range(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return coverage.named_bases(a.runs("base", _straight(a)), a.components)


@_query("query_range_circular", _with(_PARTS, _CELLS, *_ALL[1:], active=_ROUND) + f" SELECT cid, pos AS position, depth AS coverage FROM bases, c WHERE cid = {CID} AND (pos >= c.rs OR pos <= c.re)")
def query_range_circular(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return coverage.bases(a.runs("base", _round(a)))


@_query("query_same_node_circular", _with(_PARTS, _SAME, *_ALL[1:], active="AND l.node_id = (SELECT node_id FROM same)") + f" SELECT cid, pos AS position, depth AS coverage FROM bases, same WHERE cid = {CID} AND bases.idx = same.idx AND (pos >= s OR pos <= e)")
def query_same_node_circular(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return coverage.bases(a.runs("base", _same_node(a)))


@_query("query_slice", _with(_PARTS, _CELLS, *_ALL[1:], active=_STRAIGHT) + f" SELECT pos - c.qs AS local_x, depth AS coverage FROM bases, c WHERE cid = {CID} AND pos BETWEEN c.qs AND c.qe")
def query_slice(spark, sf_dir):
    a = analysis(spark, sf_dir)
    scope = _straight(a)
    return coverage.bases(a.runs("base", scope)).select((F.col("position") - scope.start).alias("local_x"), "coverage")


@_query("circular_traversal", _with(_PARTS, _CELLS, *_ALL[1:], active=_ROUND) + f" SELECT CASE WHEN pos >= c.rs THEN pos - c.rs ELSE pos + c.len - c.rs END AS local_x, pos AS position, depth AS coverage FROM bases, c WHERE cid = {CID} AND (pos >= c.rs OR pos <= c.re)")
def circular_traversal(spark, sf_dir):
    a = analysis(spark, sf_dir)
    scope = _round(a)
    return coverage.bases(a.runs("base", scope)).select(scope.local(F.col("position")).alias("local_x"), "position", "coverage")


# --- statistics ---------------------------------------------------------------------------------


@_query("depth_histogram", _with(*_ALL) + " SELECT cid, depth, count(*) AS n_bases FROM bases GROUP BY 1, 2")
def depth_histogram(spark, sf_dir):
    return analysis(spark, sf_dir).histogram()


_STATS = """count(*) AS region_length, count(*) FILTER (depth > 0) AS covered_positions, round(100.0 * count(*) FILTER (depth > 0) / count(*), 6)::DOUBLE AS breadth, round(avg(depth), 6) AS mean, round(quantile_cont(depth, 0.5), 6)::DOUBLE AS median,
  round(stddev_pop(depth), 6) AS stddev, round(CASE WHEN avg(depth) > 0 THEN stddev_pop(depth) / avg(depth) ELSE 0 END, 6) AS cv, round(quantile_cont(depth, 0.25), 6)::DOUBLE AS q1, round(quantile_cont(depth, 0.75), 6)::DOUBLE AS q3, min(depth) AS min, max(depth) AS max"""


def _rounded(df: DataFrame) -> DataFrame:
    doubles = ("breadth", "mean", "median", "stddev", "cv", "q1", "q3")
    return df.select(*(c for c in df.columns if c not in doubles), *_six(*doubles))


@_query("coverage_stats_component", _with(*_ALL) + f" SELECT cid, name, {_STATS} FROM bases JOIN comps USING (cid) GROUP BY cid, name")
def coverage_stats_component(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return _rounded(stats.component_stats(a.histogram()).join(a.components, "cid"))


@_query("coverage_stats_global", _with(*_ALL) + f" SELECT {_STATS} FROM bases")
def coverage_stats_global(spark, sf_dir):
    return _rounded(stats.total_stats(analysis(spark, sf_dir).histogram()))


@_query("coverage_stats_rollup", _with(*_ALL) + f" SELECT coalesce(cid::VARCHAR, 'Total') AS label, {_STATS} FROM bases GROUP BY ROLLUP (cid)")
def coverage_stats_rollup(spark, sf_dir):
    rows = _rounded(stats.rollup_stats(analysis(spark, sf_dir).histogram()))
    return rows.withColumn("label", F.coalesce(F.col("cid").cast("string"), F.lit("Total"))).drop("cid")


@_query("coverage_stats_query", _with(_PARTS, _CELLS, *_ALL[1:], active=_STRAIGHT) + f" SELECT {_STATS} FROM bases, c WHERE cid = {CID} AND pos BETWEEN c.qs AND c.qe")
def coverage_stats_query(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return _rounded(stats.total_stats(a.histogram("base", _straight(a))))


# --- series for plots -----------------------------------------------------------------------------


def _samples(lens: str, most: int = POINTS) -> str:
    """Sampled positions: every step-th, and the last one in place of the last sample if there are enough."""
    return f"""grid AS (SELECT cid, length, greatest(1, (length + {most - 1}) // {most}) AS step FROM {lens}),
steps AS (SELECT cid, length, step, unnest(range(0, length, step)) AS x FROM grid),
samples AS (SELECT DISTINCT cid, length, CASE WHEN x + step >= length AND x < length - 1 AND x // step + 1 >= {most} THEN length - 1 ELSE x END AS x FROM steps UNION SELECT cid, length, length - 1 FROM grid)"""


def _window(share: str, lens: str) -> str:
    return f"""raw_win AS (SELECT cid, least(greatest(1, floor(length * {share} + 0.5)::BIGINT), length) AS w, length FROM {lens}),
win AS (SELECT cid, CASE WHEN w > 1 AND w % 2 = 0 AND w < length THEN w + 1 WHEN w > 1 AND w % 2 = 0 THEN w - 1 ELSE w END AS window_size FROM raw_win)"""


_LINEAR = "smooth AS (SELECT s.cid, s.x, avg(b.depth) AS y, any_value(w.window_size) AS window_size FROM samples s JOIN win w USING (cid) JOIN {bases} b ON b.cid = s.cid AND b.pos BETWEEN s.x - w.window_size // 2 AND s.x + w.window_size // 2 GROUP BY 1, 2)"


@_query("downsample", _with(_PARTS, _samples("lens")) + " SELECT cid, x FROM samples")
def downsample(spark, sf_dir):
    return series.samples(analysis(spark, sf_dir).lengths(), POINTS).select("cid", "x")


@_query("smooth_linear", _with(*_ALL, _samples("lens"), _window(str(SHARE), "lens"), _LINEAR.replace("{bases}", "bases")) + " SELECT cid, x, round(y, 6) AS y, window_size FROM smooth")
def smooth_linear(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return series.smooth(a.runs(), a.lengths(), SHARE, POINTS).select("cid", "x", *_six("y"), "window_size")


@_query("smooth_circular", _with(*_ALL, _samples("lens"), _window(str(SHARE), "lens")) + """, turned AS (SELECT s.cid, s.x, w.window_size, (s.x + unnest(range(-(w.window_size // 2), w.window_size // 2 + 1)) + s.length) % s.length AS pos FROM samples s JOIN win w USING (cid))
  SELECT t.cid, t.x, round(avg(b.depth), 6) AS y, any_value(t.window_size) AS window_size FROM turned t JOIN bases b USING (cid, pos) GROUP BY 1, 2""")
def smooth_circular(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return series.smooth(a.runs(), a.lengths(), SHARE, POINTS, circular=True).select("cid", "x", *_six("y"), "window_size")


@_query("log_transform", _with(*_ALL) + f" SELECT DISTINCT depth, round(CASE WHEN depth <= 1 THEN depth::DOUBLE ELSE 1 + ln(depth) / ln({LOG_BASE}) END, 6) AS y FROM bases")
def log_transform(spark, sf_dir):
    depths = analysis(spark, sf_dir).runs().select("depth").distinct()
    return depths.select("depth", F.round(series.log_scale(F.col("depth").cast("double"), LOG_BASE), 6).alias("y"))


@_query("linear_plot_series", _with(*_ALL, _samples("lens"), _window(str(series.SMOOTHING), "lens"), _LINEAR.replace("{bases}", "bases")) + f" SELECT cid, x, round(y, 6) AS y, round(CASE WHEN y <= 1 THEN y ELSE 1 + ln(y) / ln({LOG_BASE}) END, 6) AS plot_y, window_size FROM smooth")
def linear_plot_series(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return series.linear_series(a.runs(), a.lengths(), most=POINTS, log_base=LOG_BASE).select("cid", "x", *_six("y", "plot_y"), "window_size")


def _traversal(start: str, end: str, known: str) -> str:
    return f"""trip AS (SELECT {CID} AS cid, c.len - {start} + {end} + 1 AS length, c.len AS whole, {start} AS s, {end} AS e FROM c),
walk AS (SELECT b.cid, b.pos AS position, CASE WHEN b.pos >= t.s THEN b.pos - t.s ELSE b.pos + t.whole - t.s END AS pos, CASE WHEN {known} THEN b.depth END AS depth FROM bases b, trip t WHERE b.cid = {CID} AND (b.pos >= t.s OR b.pos <= t.e))"""


_TURN_SHARE = f"least(1.0, {SHARE} * (SELECT whole FROM trip) / (SELECT length FROM trip))"
_TURN = "smooth AS (SELECT s.cid, s.x, avg(b.depth) AS y, any_value(w.window_size) AS window_size FROM samples s JOIN win w USING (cid) JOIN walk b ON b.cid = s.cid AND b.pos BETWEEN s.x - w.window_size // 2 AND s.x + w.window_size // 2 GROUP BY 1, 2)"


@_query("circular_plot_series", _with(_PARTS, _CELLS, *_ALL[1:], _traversal("c.rs", "c.re", "true"), _samples("trip"), _window(_TURN_SHARE, "trip"), _TURN, active=_ROUND) + " SELECT cid, x, w.position, round(y, 6) AS y, window_size FROM smooth JOIN (SELECT pos AS x, position FROM walk) w USING (x)")
def circular_plot_series(spark, sf_dir):
    a = analysis(spark, sf_dir)
    scope = _round(a)
    return series.circular_series(a.component_runs("base", scope), scope, SHARE, POINTS).select("cid", "x", "position", *_six("y"), "window_size")


@_query("circular_segments", _with(_PARTS, _SAME, *_ALL[1:], "c AS (SELECT length AS len, s, e, same.idx AS active FROM lens, same WHERE cid = " + str(CID) + ")", _traversal("c.s", "c.e", "b.idx = (SELECT active FROM c)").replace("FROM c)\n,walk", "FROM c),\nwalk"), _samples("trip"), active="AND l.node_id = (SELECT node_id FROM same)") + """,
  points AS (SELECT s.cid, s.x, w.depth FROM samples s JOIN walk w ON w.pos = s.x),
  marks AS (SELECT *, CASE WHEN depth IS NOT NULL AND lag(depth) OVER (ORDER BY x) IS NULL THEN 1 ELSE 0 END AS new FROM points),
  numbered AS (SELECT *, sum(new) OVER (ORDER BY x) - 1 AS segment FROM marks)
  SELECT cid, segment::BIGINT AS segment, min(x) AS first, max(x) AS last, count(*) AS n_points FROM numbered WHERE depth IS NOT NULL GROUP BY 1, 2""")
def circular_segments(spark, sf_dir):
    a = analysis(spark, sf_dir)
    scope = _same_node(a)
    return series.segments(series.circular_series(a.component_runs("base", scope), scope, 0.0, POINTS))
