"""DuckDB SQL for every registered query, written from the base tables.

``WIDE``, ``TAGS`` and ``CHILDREN`` restate the flat tables without going
through nested records, so they also check the ETL.
"""

from __future__ import annotations

MEASURES = ("ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE")

_COUNTS = ", ".join(f"NULLIF(COUNT(*) FILTER (WHERE p_type = '{m}'), 0) AS n_{m}" for m in MEASURES)
_MEASURE_COLUMNS = ", ".join(
    f'CAST(n_{m} AS BIGINT) AS "{m}_count", '
    f'CAST(CAST(100 AS DOUBLE) * n_{m} / n_lines AS FLOAT) AS "{m}_percentage"'
    for m in MEASURES
)
_GRIDS = (("bio1", "l_discount * 100"), ("bio7", "l_tax * 100"),
          ("bio12", "l_extendedprice"), ("bio15", "l_quantity"))
_GRID_AGGS = ", ".join(
    f"CAST(SUM(CAST({e} AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS clim_{v}_mean, "
    f"MAX({e}) AS clim_{v}_max, MIN({e}) AS clim_{v}_min"
    for v, e in _GRIDS
)
_GRID_COLUMNS = ", ".join(f"clim_{v}_{s}" for v, _ in _GRIDS for s in ("mean", "max", "min"))

WIDE = f"""
li AS (
  SELECT o_custkey AS ck, COUNT(*) AS n_lines, {_COUNTS}, {_GRID_AGGS},
         COUNT(DISTINCT l_partkey) AS scaffold_count, MAX(l_partkey) AS contig_n50,
         COUNT(*) FILTER (WHERE l_returnflag = 'R') AS coding_genes,
         COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey
), od AS (
  SELECT o_custkey AS ck,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS range_km2,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean_elevation,
         MIN(o_totalprice) AS min_elevation, MAX(o_totalprice) AS max_elevation,
         ROUND(quantile_cont(o_totalprice, 0.5), 3) AS median_elevation,
         MAX(o_orderstatus) AS assembly_level
  FROM orders GROUP BY o_custkey
), wide AS (
  SELECT 'ENT_' || c_custkey AS accession,
         r_name AS kingdom, n_name AS phylum, n_name || '/' || c_mktsegment AS "class",
         CASE WHEN c_custkey % 11 <> 0 THEN n_name || '/' || c_mktsegment || '/' || (c_custkey % 3) END AS "order",
         n_name || '/' || c_mktsegment || '/f' || (c_custkey % 5) AS family,
         n_name || '/' || c_mktsegment || '/g' || (c_custkey % 7) AS genus,
         c_name AS species, c_custkey AS tax_id,
         range_km2, mean_elevation, min_elevation, max_elevation, median_elevation,
         {_GRID_COLUMNS},
         url AS biodiversity_portal, CAST(NULL AS VARCHAR) AS gtf_file,
         CAST(NULL AS VARCHAR) AS ensembl_browser,
         NULLIF(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS gbif,
         CASE WHEN c_custkey % 13 <> 0 THEN n_lines END AS total_gene_biotypes,
         {_MEASURE_COLUMNS},
         assembly_level AS ena_assembly_level, scaffold_count AS ena_scaffold_count,
         contig_n50 AS ena_contig_n50,
         CAST(100 AS DOUBLE) * open_lines / n_lines AS ens_assembly_gc_percentage,
         coding_genes AS ens_coding_coding_genes
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN li ON li.ck = c_custkey LEFT JOIN od ON od.ck = c_custkey
  LEFT JOIN pages ON page_id = c_custkey
)"""

TAGS = """
pairs AS (
  SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), places AS (
  SELECT 'ENT_' || o_custkey AS accession, r_name, n_name, s_name
  FROM pairs JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
), tags AS (
  SELECT accession, 'realm' AS level, r_name AS value FROM places
  UNION SELECT accession, 'biome', n_name FROM places
  UNION SELECT accession, 'ecoregion', s_name FROM places
)"""

CHILDREN = """
children AS (
  SELECT DISTINCT 'ENT_' || user_id AS accession,
         CAST(event_id AS VARCHAR) AS "occurrenceID",
         CAST(NULL AS VARCHAR) AS geo_coordinate, CAST(NULL AS VARCHAR) AS "geodeticDatum",
         CAST(NULL AS VARCHAR) AS "coordinateUncertaintyInMeters",
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "eventDate", value AS elevation,
         event_type AS "countryCode", CAST(NULL AS VARCHAR) AS "iucnRedListCategory",
         event_type AS gadm_level0_name, json_extract_string(props, '$.k') AS gadm_level1_name,
         CAST(NULL AS VARCHAR) AS gadm_level2_name, CAST(NULL AS VARCHAR) AS "institutionCode",
         CAST(NULL AS VARCHAR) AS "collectionCode", CAST(NULL AS VARCHAR) AS "catalogNumber"
  FROM events
)"""



def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _sums(table: str, group: str | None = None, where: str = "TRUE", total: str = "total_gene_biotypes") -> str:
    key = f"COALESCE({group}, 'NA') AS grp, " if group else ""
    counts = ", ".join(f'CAST(SUM(COALESCE("{m}_count", 0)) AS DOUBLE) AS "{m}"' for m in MEASURES)
    whole = f"CAST(SUM(COALESCE({total}, 0)) AS DOUBLE) AS whole"
    by = " GROUP BY 1" if group else ""
    return f"SELECT {key}{counts}, {whole} FROM {table} WHERE {where}{by}"


def _composition(table: str, group: str, where: str = "TRUE", total: str = "total_gene_biotypes") -> str:
    """A CTE ``comp``; PROMO is in the total only."""
    rows = " UNION ALL ".join(
        f"SELECT grp AS \"group\", '{m}' AS biotype, \"{m}\" / whole * CAST(100 AS DOUBLE) AS value "
        f"FROM sums WHERE whole > 0" for m in MEASURES)
    return f"sums AS ({_sums(table, group, where, total)}), comp AS ({rows})"


def _totals(where: str, table: str = "wide") -> str:
    """A CTE ``totals``."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS biotype, COALESCE(\"{m}\", 0) AS \"count\" FROM allsums" for m in MEASURES)
    return f"allsums AS ({_sums(table, None, where)}), totals AS ({rows})"


SHOWN = 'accession, kingdom, tax_id, total_gene_biotypes, range_km2'
KINGDOMS = "kingdom IN ('ASIA', 'EUROPE', 'AFRICA')"
SUPPLIERS = "'Supplier#000000003', 'Supplier#000000007'"
TAGGED = f"accession IN (SELECT accession FROM tags WHERE level = 'ecoregion' AND value IN ({SUPPLIERS}))"
ALL_NO_SHARE = f"""{KINGDOMS} AND clim_bio1_mean BETWEEN 4 AND 6 AND range_km2 BETWEEN 500000 AND 4000000
  AND accession IN (SELECT accession FROM tags WHERE level IN ('ecoregion', 'realm')
    AND value IN ({SUPPLIERS}, 'Supplier#000000001', 'Supplier#000000005'))"""
ALL = ALL_NO_SHARE + """ AND CAST("ECONOMY_percentage" AS DOUBLE) BETWEEN 10 AND 30"""
DRILLED = "kingdom IN ('ASIA', 'EUROPE') AND phylum IN ('NATION_3', 'NATION_2', 'NATION_12')"
_ALL_COUNTS = " + ".join(f'COALESCE("{m}_count", 0)' for m in MEASURES)


def _share(whole: str) -> str:
    return (f'(CASE WHEN {whole} > 0 THEN CAST("SMALL_count" AS DOUBLE) / ({whole}) * CAST(100 AS DOUBLE) END)'
            f" BETWEEN CAST(12.5 AS DOUBLE) AND CAST(20 AS DOUBLE)")


def _shown(where: str, tags: bool = False) -> str:
    return _with(", ".join([WIDE.strip(), *([TAGS.strip()] if tags else [])])) + \
        f"SELECT {SHOWN} FROM wide WHERE {where}"


def _wide(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([WIDE.strip(), *[c.strip() for c in ctes]]) + "\n" + query


_DEFAULT = ('accession, kingdom, phylum, "class", "order", family, genus, species, tax_id, range_km2, mean_elevation, '
            'min_elevation, max_elevation, median_elevation, clim_bio1_mean, clim_bio1_max, clim_bio1_min, clim_bio7_mean, '
            'clim_bio7_max, clim_bio7_min, clim_bio12_mean, clim_bio12_max, clim_bio12_min, clim_bio15_mean, clim_bio15_max')
_PRESET = ('accession, species, total_gene_biotypes, "ECONOMY_count", "ECONOMY_percentage", '
           '"SMALL_count", "SMALL_percentage"')


def _link(column: str) -> str:
    href = f"CASE WHEN regexp_matches({column}, '^https?://', 'i') THEN trim({column}) ELSE 'https://' || trim({column}) END"
    host = f"lower(regexp_extract({href}, '^https?://(?:[^/?#]*@)?([^/?#:]+)', 1, 'i'))"
    label = f"replace(CASE WHEN {host} = '' THEN {href} ELSE {host} END, 'www.', '')"
    return f"CASE WHEN coalesce(trim({column}), '') = '' THEN '' ELSE '[' || {label} || '](' || {href} || ')' END"


def _kpi(where: str, table: str = "wide", *more: str) -> str:
    ranks = ", ".join(f'COUNT(DISTINCT "{r}") AS "{r}"' for r in
                      ("kingdom", "phylum", "class", "order", "family", "genus", "species"))
    levels = ", ".join(
        f"(SELECT COUNT(DISTINCT value) FROM tags WHERE level = '{v}' AND accession IN (SELECT accession FROM hit)) AS {v}"
        for v in ("realm", "biome", "ecoregion"))
    return _wide(
        f"SELECT {ranks}, COUNT(DISTINCT accession) AS accessions, {levels}, "
        f"CAST(COALESCE(SUM(total_gene_biotypes), 0) AS BIGINT) AS total_genes FROM hit",
        TAGS, *more, f"hit AS (SELECT * FROM {table} WHERE {where})")


def _extents(columns: dict[str, str | None]) -> str:
    def lit(text: str | None) -> str:
        return "" if text is None else f", '{text}' AS label"
    return " UNION ALL ".join(
        (f"SELECT '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS \"min\", CAST(NULL AS DOUBLE) AS \"max\""
         if c == "no_such_column" else
         f"SELECT '{c}' AS \"column\", CAST(MIN({c}) AS DOUBLE) AS \"min\", CAST(MAX({c}) AS DOUBLE) AS \"max\"{lit(label)} FROM wide")
        for c, label in columns.items())


_CASCADE_FACETS = ("kingdom", "phylum", "class", "order", "family", "genus", "species", "tax_id")
_CASCADE_PICKS = {
    "kingdom": "kingdom IN ('ASIA', 'EUROPE')",
    "phylum": "phylum IN ('NATION_2', 'NATION_3', 'NATION_12', 'NATION_1')",
    "class": "\"class\" IN ('NATION_2/MACHINERY', 'NATION_1/MACHINERY')",
}


def _cascade() -> str:
    parts, broader = [], []
    for facet in _CASCADE_FACETS:
        where = " AND ".join([f'"{facet}" IS NOT NULL', *broader])
        parts.append(f"SELECT DISTINCT '{facet}' AS \"rank\", CAST(\"{facet}\" AS VARCHAR) AS value FROM wide WHERE {where}")
        if facet in _CASCADE_PICKS:
            broader.append(_CASCADE_PICKS[facet])
    return " UNION ALL ".join(parts)


def _points(metric: dict[str, str], where: str, table: str = "wide") -> str:
    """A CTE ``points``: one row per x column, series and entity."""
    rows = " UNION ALL ".join(
        f"SELECT species, accession, CAST(total_gene_biotypes AS DOUBLE) AS total, '{x}' AS x_name, "
        f"CAST({x} AS DOUBLE) AS x, '{s}' AS series, {y} AS y FROM {table} WHERE {where}"
        for x in ("clim_bio1_mean", "range_km2") for s, y in metric.items())
    return f"points AS (SELECT * FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL)"


_PER1K = {m: f'CAST(1000 AS DOUBLE) * (CAST("{m}_count" AS DOUBLE) / NULLIF(total_gene_biotypes, 0))' for m in MEASURES}
_RAW = {m: f'CAST("{m}_count" AS DOUBLE)' for m in MEASURES}
_STORED = {m: f'CAST("{m}_percentage" AS DOUBLE)' for m in MEASURES}


def _fit(x: str, y: str, digits: int) -> str:
    return f"""SELECT l_returnflag, l_linestatus, ROUND(regr_slope({y}, {x}), {digits}) AS slope,
  ROUND(regr_intercept({y}, {x}), {digits}) AS intercept, ROUND(MIN({x}), {digits}) AS x_min,
  ROUND(MAX({x}), {digits}) AS x_max, COUNT(*) AS n FROM lineitem
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 2 AND MIN({x}) < MAX({x})"""


_GRID = (f"{KINGDOMS} AND NOT contains(lower(phylum), 'nation_1') AND starts_with(lower(phylum), 'nation') "
         "AND lower(kingdom) <> 'africa' AND total_gene_biotypes IS NOT NULL AND tax_id BETWEEN 4 AND 1400 AND accession LIKE '%7'")
_NAN = """holed AS (SELECT * REPLACE (
    CASE WHEN tax_id % 7 <> 0 THEN CAST("SMALL_count" AS DOUBLE) END AS "SMALL_count",
    CASE WHEN tax_id % 5 <> 0 THEN CAST(total_gene_biotypes AS DOUBLE) END AS total_gene_biotypes) FROM wide)"""
_KPI_TOTALS = _totals(ALL_NO_SHARE)
_ORDERED = f"""{KINGDOMS} AND CAST("SMALL_percentage" AS DOUBLE) BETWEEN 12.5 AND 20"""

ORACLE: dict[str, str] = {
    "etl_main": _wide("SELECT * FROM wide"),
    "etl_bridge": _with(TAGS) + "SELECT * FROM tags",
    "etl_children": _with(CHILDREN) + "SELECT * FROM children",
    "etl_legacy": _wide("SELECT * FROM wide"),
    "etl_round_trip": _wide("SELECT * FROM wide"),
    "filter_ranks": _shown(KINGDOMS),
    "filter_category": _shown("ena_assembly_level IN ('F', 'O')"),
    "filter_coerced": _shown("ena_scaffold_count IN (40, 41, 42)"),
    "filter_ranges": _shown("clim_bio1_mean BETWEEN 4.5 AND 5.5 AND range_km2 BETWEEN 500000 AND 3000000 "
                            "AND total_gene_biotypes BETWEEN 20.5 AND 60"),
    "filter_share_stored": _shown('CAST("SMALL_percentage" AS DOUBLE) BETWEEN 12.5 AND 20'),
    "filter_share_computed": _shown(_share("total_gene_biotypes")),
    "filter_share_no_total": _wide(
        f"SELECT accession, kingdom, tax_id, range_km2 FROM wide WHERE {_share(_ALL_COUNTS)}"),
    "filter_tags": _shown(TAGGED, tags=True),
    "filter_tags_bucketed": _shown(TAGGED, tags=True),
    "filter_tags_indexed": _shown(TAGGED, tags=True),
    "filter_tags_counted": _shown(TAGGED, tags=True),
    "filter_tags_typed_keys": _wide(
        f"SELECT substr(accession, 5) AS accession, kingdom, tax_id, total_gene_biotypes, range_km2 FROM wide WHERE {TAGGED}", TAGS),
    "filter_tags_empty": _shown(
        f"accession IN (SELECT accession FROM tags WHERE level = 'realm' AND value IN ({SUPPLIERS}))", tags=True),
    "filter_all": _shown(ALL, tags=True),
    "filter_drill": _shown(DRILLED),
    "filter_prune": _wide(
        "SELECT \"rank\", value FROM cascade WHERE "
        "(\"rank\" = 'kingdom' AND value IN ('ASIA', 'EUROPE')) OR "
        "(\"rank\" = 'phylum' AND value IN ('NATION_2', 'NATION_3', 'NATION_12', 'NATION_1')) OR "
        "(\"rank\" = 'class' AND value IN ('NATION_2/MACHINERY', 'NATION_1/MACHINERY'))",
        f"cascade AS ({_cascade()})"),
    "filter_prune_tags": _with(TAGS) + "SELECT DISTINCT value FROM tags WHERE level IN ('realm', 'biome') "
                                       f"AND value IN ('ASIA', 'NATION_3', {SUPPLIERS})",
    "page_rows": _wide(f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} ORDER BY accession LIMIT 50 OFFSET 50"),
    "page_deep": _wide(f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} ORDER BY accession LIMIT 50 OFFSET 400"),
    "page_placed": _wide(
        f"SELECT *, ROW_NUMBER() OVER (ORDER BY range_km2 DESC NULLS LAST, accession) - 1 AS position FROM ("
        f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} ORDER BY range_km2 DESC NULLS LAST, accession LIMIT 20 OFFSET 20)"),
    "page_tied": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders "
                 "ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 210",
    "page_after": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders "
                  "ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 70 OFFSET 70",
    "page_numbered": _wide(f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} "
                           "ORDER BY range_km2 DESC NULLS LAST, accession LIMIT 20 OFFSET 40"),
    "page_beyond": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag FROM lineitem "
                   "ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 60 OFFSET 5340",
    "page_cursor_after_number": "SELECT o_orderstatus, o_orderkey % 2 AS half FROM orders ORDER BY 1, 2 LIMIT 1300 OFFSET 120",
    "page_default_columns": _wide(f"SELECT {_DEFAULT} FROM wide WHERE {KINGDOMS} ORDER BY accession LIMIT 30 OFFSET 30"),
    "page_either": _wide(f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} AND (lower(phylum) = 'nation_1' OR phylum LIKE '%\\_12' ESCAPE '\\') "
                         "AND (tax_id < 900 OR range_km2 IS NULL) ORDER BY phylum, tax_id DESC LIMIT 100"),
    "schema_columns": "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS place, column_name AS name FROM (DESCRIBE "
                      + _wide("SELECT * FROM wide") + ")",
    "grid_filtered_rows": _wide(f"SELECT {SHOWN} FROM wide WHERE {_GRID} ORDER BY phylum, tax_id DESC LIMIT 80"),
    "grid_filtered_total": _wide(f"SELECT COUNT(*) AS \"rows\" FROM wide WHERE {_GRID}"),
    "page_preset": _wide(f"SELECT {_PRESET}, biodiversity_portal, gbif FROM wide WHERE {KINGDOMS} "
                         "ORDER BY accession LIMIT 100"),
    "page_links": _wide(f"SELECT {_PRESET}, {_link('biodiversity_portal')} AS biodiversity_portal, "
                        f"{_link('gbif')} AS gbif FROM wide WHERE {KINGDOMS} ORDER BY accession LIMIT 100"),
    "page_column_filter": _wide(
        f"SELECT {SHOWN} FROM wide WHERE {KINGDOMS} AND contains(lower(phylum), 'nation_1') "
        "AND range_km2 BETWEEN 500000 AND 4000000 AND tax_id > 10 "
        "ORDER BY range_km2 DESC NULLS LAST, accession LIMIT 50"),
    "count_rows": _wide(f"SELECT COUNT(*) AS \"rows\" FROM wide WHERE {ALL}", TAGS),
    "measure_means": _wide(
        " UNION ALL ".join(
            f"SELECT '{m}' AS biotype, ROUND(COALESCE(AVG(CAST(\"{m}_percentage\" AS DOUBLE)), 0), 6) AS value FROM hit"
            for m in MEASURES),
        TAGS, f"""hit AS (SELECT * FROM wide WHERE {KINGDOMS} AND accession IN (
          SELECT accession FROM tags WHERE level IN ('ecoregion', 'realm')
          AND value IN ({SUPPLIERS}, 'Supplier#000000001', 'Supplier#000000005')))"""),
    "measure_sums": _wide(
        " UNION ALL ".join(f"SELECT '{m}' AS biotype, CAST(COALESCE(SUM(\"{m}_count\"), 0) AS DOUBLE) AS value FROM hit"
                           for m in MEASURES),
        TAGS, f"hit AS (SELECT * FROM wide WHERE {TAGGED})"),
    "measure_totals": _wide('SELECT biotype, "count" FROM totals', TAGS, _totals(ALL)),
    "composition_by_rank": _wide("SELECT * FROM comp", _composition("wide", "kingdom")),
    "composition_filtered": _wide("SELECT * FROM comp", TAGS, _composition("wide", '"order"', ALL)),
    "composition_no_total": _wide("SELECT * FROM comp", _composition("wide", "phylum", KINGDOMS, f"({_ALL_COUNTS})")),
    "composition_pivot": _wide(
        'SELECT grp AS "group", ' + ", ".join(f'"{m}" / whole * CAST(100 AS DOUBLE) AS "{m}"' for m in MEASURES)
        + " FROM sums WHERE whole > 0", _composition("wide", '"class"', KINGDOMS)),
    "composition_ordered": _wide(
        'SELECT "group", comp.biotype, value, biotype_rank FROM comp JOIN ranked ON comp.biotype = ranked.biotype',
        _composition("wide", "phylum", _ORDERED), _totals(KINGDOMS),
        'ranked AS (SELECT biotype, CAST(ROW_NUMBER() OVER (ORDER BY "count" DESC, biotype) AS INTEGER) AS biotype_rank FROM totals)'),
    "composition_drill": _wide("SELECT * FROM comp", _composition(
        "wide", '"class"', DRILLED)),
    "composition_rollup": _wide("SELECT * FROM comp", _composition("wide", "phylum", KINGDOMS)),
    "composition_rollup_drill": _wide("SELECT * FROM comp", _composition(
        "wide", '"class"', DRILLED)),
    "measure_totals_rollup": _wide('SELECT biotype, "count" FROM totals', _totals(KINGDOMS)),
    "composition_clicked": _wide("SELECT * FROM comp", _composition(
        "wide", '"order"', f"{KINGDOMS} AND kingdom IN ('AFRICA', 'ASIA', 'EUROPE') AND phylum = 'NATION_7'")),
    "composition_deepest": _wide("SELECT * FROM comp", _composition(
        "wide", "phylum", "kingdom = 'ASIA' AND phylum IN ('NATION_2', 'NATION_7', 'NATION_12')")),
    "nan_totals": _wide('SELECT biotype, "count" FROM totals', _NAN, _totals(KINGDOMS, "holed")),
    "nan_composition": _wide("SELECT * FROM comp", _NAN, _composition("holed", "kingdom", KINGDOMS)),
    "nan_kpi": _kpi(KINGDOMS, "holed", _NAN),
    "kpi_summary": _kpi(KINGDOMS),
    "kpi_summary_filtered": _kpi(ALL),
    "kpi_entities": _wide(f"SELECT DISTINCT accession FROM wide WHERE {ALL}", TAGS),
    "kpi_tags": _wide(
        "SELECT level, COUNT(DISTINCT value) AS \"values\" FROM tags WHERE accession IN (SELECT accession FROM hit) GROUP BY level",
        TAGS, f"hit AS (SELECT * FROM wide WHERE {ALL})"),
    "kpi_tags_bucketed": _wide(
        "SELECT level, COUNT(DISTINCT value) AS \"values\" FROM tags WHERE accession IN (SELECT accession FROM hit) GROUP BY level",
        TAGS, f"hit AS (SELECT * FROM wide WHERE {ALL})"),
    "kpi_tags_indexed": _wide(
        "SELECT level, COUNT(DISTINCT value) AS \"values\" FROM tags WHERE accession IN (SELECT accession FROM hit) GROUP BY level",
        TAGS, f"hit AS (SELECT * FROM wide WHERE {ALL})"),
    "kpi_ranks_paths": _wide(" UNION ALL ".join(
        f"SELECT '{name}' AS figure, COUNT(DISTINCT \"{column}\") AS value FROM wide WHERE {KINGDOMS}"
        for name, column in [(r, r) for r in _CASCADE_FACETS[:-1]] + [("accessions", "accession")])),
    "kpi_ranks_sketched": _wide(" UNION ALL ".join(
        f"SELECT '{name}' AS figure, COUNT(DISTINCT \"{column}\") AS value, TRUE AS near FROM wide WHERE {KINGDOMS}"
        for name, column in [(r, r) for r in _CASCADE_FACETS[:-1]] + [("accessions", "accession")])),
    "kpi_top": _wide('SELECT biotype, "count" FROM totals ORDER BY "count" DESC, biotype LIMIT 3', TAGS, _KPI_TOTALS),
    "kpi_top_placed": _wide('SELECT biotype, "count", ROW_NUMBER() OVER (ORDER BY "count" DESC, biotype) - 1 AS position '
                            'FROM totals ORDER BY "count" DESC, biotype LIMIT 5', TAGS, _KPI_TOTALS),
    "kpi_top_text": _wide(
        "SELECT string_agg(biotype || ': ' || format('{:,}', CAST(\"count\" AS BIGINT)), ' • ' "
        "ORDER BY \"count\" DESC, biotype) AS text FROM totals", TAGS, _KPI_TOTALS),
    "extents": _wide(_extents({c: None for c in (
        "clim_bio1_mean", "clim_bio12_mean", "range_km2", "total_gene_biotypes", "no_such_column")})),
    "breakpoints": _wide(
        'SELECT DISTINCT "column", CAST(round_even("min" + f * ("max" - "min"), 0) AS BIGINT) AS mark '
        "FROM ext, (VALUES (CAST(0 AS DOUBLE)), (0.25), (0.5), (0.75), (1)) AS fractions(f) WHERE \"min\" IS NOT NULL",
        "ext AS (" + _extents({c: None for c in ("clim_bio1_mean", "clim_bio12_mean", "range_km2")}) + ")"),
    "metric_extents": _wide(_extents({
        "ena_scaffold_count": "ENA: scaffold count", "ena_contig_n50": "ENA: contig N50",
        "ens_assembly_gc_percentage": "Assembly: GC %", "ens_coding_coding_genes": "Coding: genes"})),
    "options_distinct": _wide(f'SELECT DISTINCT "class" AS value FROM wide WHERE {ALL}', TAGS),
    "options_unfiltered": _wide("SELECT DISTINCT CAST(tax_id AS VARCHAR) AS value FROM wide"),
    "options_limited": _wide("SELECT DISTINCT CAST(tax_id AS VARCHAR) AS value, (SELECT COUNT(DISTINCT tax_id) FROM wide) > 100 AS more "
                             "FROM wide ORDER BY 1 LIMIT 100"),
    "options_cascaded_limited": _wide(
        "SELECT \"rank\", value, n > 3 AS more FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"rank\" ORDER BY value) AS place, "
        "COUNT(*) OVER (PARTITION BY \"rank\") AS n FROM cascade) WHERE place <= 3", f"cascade AS ({_cascade()})"),
    "options_cascaded": _wide(
        "SELECT \"rank\", value FROM cascade", f"cascade AS ({_cascade()})"),
    "options_cascaded_paths": _wide(
        "SELECT \"rank\", value FROM cascade", f"cascade AS ({_cascade()})"),
    "options_cascaded_beyond": _wide(
        "SELECT \"rank\", value, n > 1200 AS more FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"rank\" ORDER BY value) AS place, "
        "COUNT(*) OVER (PARTITION BY \"rank\") AS n FROM cascade) WHERE place <= 1200",
        "cascade AS (" + " UNION ALL ".join(
            f"SELECT DISTINCT '{f}' AS \"rank\", CAST(\"{f}\" AS VARCHAR) AS value FROM wide WHERE \"{f}\" IS NOT NULL"
            + ("" if f == "kingdom" else " AND kingdom IN ('ASIA', 'EUROPE')") for f in _CASCADE_FACETS) + ")"),
    "options_tag_levels": _with(TAGS) + "SELECT DISTINCT level AS value FROM tags",
    "options_tag_values": _with(TAGS) + "SELECT DISTINCT value FROM tags WHERE level IN ('realm', 'biome')",
    "tags_by_entity": _wide(
        "SELECT accession, level, part, string_agg(value, '|' ORDER BY value) AS value_list FROM parted "
        "GROUP BY accession, level, part",
        TAGS, f"chosen AS (SELECT * FROM tags WHERE accession IN (SELECT accession FROM wide WHERE {KINGDOMS}))",
        """parted AS (SELECT accession, level, value, CAST(0 AS BIGINT) AS part FROM chosen)"""),
    "tags_of_entities": _wide(
        f"SELECT * FROM tags WHERE level IN ('biome', 'ecoregion') "
        f"AND accession IN (SELECT accession FROM wide WHERE {KINGDOMS})", TAGS),
    "scatter_long": _wide("SELECT species, accession, total, x_name, x, series, ROUND(y, 9) AS y FROM points",
                          _points(_PER1K, KINGDOMS)),
    "scatter_share": _wide("SELECT * FROM points", TAGS, _points(_STORED, ALL)),
    "scatter_metric": _wide("SELECT * FROM points", _points(
        {"ens_assembly_gc_percentage": "ens_assembly_gc_percentage"}, KINGDOMS)),
    "scatter_capped": _wide(
        "SELECT * FROM points",
        f"capped AS (SELECT * FROM wide WHERE {KINGDOMS} ORDER BY md5('scatter#' || accession), accession LIMIT 300)",
        _points(_RAW, "TRUE", "capped")),
    "trend_fit": _fit("l_quantity", "l_extendedprice", 4),
    "trend_fit_log": _fit("(CASE WHEN l_quantity > 0 THEN log10(l_quantity) END)",
                          "(CASE WHEN l_extendedprice > 0 THEN log10(l_extendedprice) END)", 6),
    "trend_curve": _wide(
        """SELECT x_name, series, CAST(i AS INTEGER) AS i,
             ROUND(pow(10, CASE WHEN i = 99 THEN x_max ELSE x_min + i * ((x_max - x_min) / CAST(99 AS DOUBLE)) END), 4) AS x,
             ROUND(intercept + slope * (CASE WHEN i = 99 THEN x_max ELSE x_min + i * ((x_max - x_min) / CAST(99 AS DOUBLE)) END), 4) AS y
           FROM fit, range(100) AS r(i)""",
        _points(_PER1K, KINGDOMS),
        """fit AS (SELECT x_name, series, regr_slope(y, log10(x)) AS slope, regr_intercept(y, log10(x)) AS intercept,
             MIN(log10(x)) AS x_min, MAX(log10(x)) AS x_max FROM points
             WHERE x > 0 GROUP BY x_name, series)"""),
    "point_sizes": _wide(
        """SELECT accession, p.x_name, p.series, total, ROUND(CASE
             WHEN n < 2 OR hi <= lo THEN CAST(8 AS DOUBLE)
             WHEN total IS NOT NULL THEN CAST(6 AS DOUBLE) + CAST(10 AS DOUBLE)
               * sqrt(greatest(least((total - lo) / greatest(hi - lo, CAST(1 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)))
           END, 6) AS size
           FROM points p JOIN stats s ON p.x_name = s.x_name AND p.series = s.series""",
        _points(_RAW, KINGDOMS),
        """q AS (SELECT x_name, series, COUNT(total) AS n, MIN(total) AS t0, MAX(total) AS t1,
             quantile_cont(total, 0.05) AS q0, quantile_cont(total, 0.95) AS q1 FROM points GROUP BY 1, 2)""",
        """stats AS (SELECT x_name, series, n, CASE WHEN q1 > q0 THEN q0 ELSE t0 END AS lo,
             CASE WHEN q1 > q0 THEN q1 ELSE t1 END AS hi FROM q)"""),
    "sample_stable": "SELECT c_custkey, c_name FROM customer "
                     "ORDER BY md5('plot#' || c_custkey), c_custkey LIMIT 400",
    "sample_large": "SELECT o_orderkey, o_custkey FROM orders "
                    "ORDER BY md5('plot#' || o_orderkey), o_orderkey LIMIT 5000",
    "links": f"SELECT page_id, {_link('url')} AS link FROM pages",
    "format_kpi": _wide("SELECT biotype, format('{:,}', CAST(\"count\" AS BIGINT)) AS text FROM totals", _totals("TRUE")),
}
