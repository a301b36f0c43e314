"""Random filter specs against row-by-row Python over the same rows."""

import math
import random
from dataclasses import replace

import pytest

from facetspark.genome import GENOME
from facetspark.operators import browse, composition, kpi
from facetspark.operators.filters import apply_filters
from facetspark.spec import FilterSpec

DS = replace(GENOME, ranks=("kingdom", "phylum"), measures=("m", "n"), tag_levels=("realm", "biome"))
COLUMNS = ("accession string, kingdom string, phylum string, tax_id int, x double, m_count long, n_count long, "
           "total_gene_biotypes long, m_percentage float")


def make_rows(rng):
    rows = []
    for i in range(200):
        m, n, total = (rng.choice([None, *range(0, 12)]) for _ in range(3))
        rows.append((
            f"E{rng.randrange(120)}", rng.choice(["K1", "K2", None]), rng.choice(["P1", "P2", "P3", None]), i,
            rng.choice([None, math.nan, *[v / 2 for v in range(20)]]), m, n, total,
            None if m is None or not total else m / total * 100))
    tags = {(f"E{rng.randrange(130)}", rng.choice(["realm", "biome"]), f"v{rng.randrange(8)}") for _ in range(150)}
    return rows, sorted(tags)


def make_spec(rng):
    def some(values, most=2):
        return rng.sample(values, rng.randrange(most + 1))
    lo = rng.uniform(-1, 6)
    return FilterSpec.build(
        ranks={"kingdom": some(["K1", "K2", " "]), "phylum": some(["P1", "P2", "nope"]),
               "tax_id": some(["17.9", "many"]) if rng.random() < 0.2 else []},
        tag_levels=some(["realm", "biome"], 1), tag_values=some(["v1", "v2", "v3", "v99"]),
        climate_ranges={"x": (lo, lo + rng.uniform(0, 6))} if rng.random() < 0.5 else {},
        area_ranges={"n_count": (rng.uniform(0, 4), 9.5), "absent": (0, 1)} if rng.random() < 0.4 else {},
        share=("m", rng.uniform(0, 60), rng.uniform(40, 300)) if rng.random() < 0.4 else None)


def keeps(row, spec, tagged, stored):
    accession, kingdom, phylum, tax_id, x, m, n, total, pct = row

    def within(value, pair):
        return value is not None and not math.isnan(value) and pair[0] <= value <= pair[1]

    for column, value in (("kingdom", kingdom), ("phylum", phylum)):
        wanted = [v.strip() for v in spec.ranks.get(column, ()) if v.strip()]
        if wanted and value not in wanted:
            return False
    if "17.9" in spec.ranks.get("tax_id", ()) and tax_id != 17:
        return False
    if "x" in spec.climate_ranges and not within(x, spec.climate_ranges["x"]):
        return False
    if "n_count" in spec.area_ranges and not within(n, spec.area_ranges["n_count"]):
        return False
    if spec.share:
        share = pct if stored else (None if m is None or not total or total <= 0 else m / total * 100)
        if not within(share, spec.share[1:]):
            return False
    return tagged is None or accession in tagged


@pytest.mark.parametrize("seed", range(12))
def test_random_spec(spark, seed):
    rng = random.Random(seed)
    rows, tags = make_rows(rng)
    main = spark.createDataFrame(rows, COLUMNS)
    bridge = spark.createDataFrame(tags, "accession string, level string, value string")
    spec = make_spec(rng)
    tagged = None
    if spec.has_tags:
        tagged = {a for a, level, value in tags
                  if (not spec.tag_levels or level in spec.tag_levels) and (not spec.tag_values or value in spec.tag_values)}
    for stored, table in ((True, main), (False, main.drop("m_percentage"))):
        want = [r for r in rows if keeps(r, spec, tagged, stored)]
        got = sorted(r["tax_id"] for r in apply_filters(table, bridge, spec, DS).collect())
        assert got == [r[3] for r in want], spec
        assert browse.count_rows(table, bridge, spec, DS).first()["rows"] == len(want)
    summary = kpi.kpi_summary(table, bridge, spec, DS).first()
    assert summary["accessions"] == len({r[0] for r in want})
    assert summary["kingdom"] == len({r[1] for r in want} - {None})
    assert summary["total_genes"] == sum(r[7] or 0 for r in want)
    found = {r[0] for r in want}
    for level in DS.tag_levels:
        assert summary[level] == len({v for a, lv, v in tags if lv == level and a in found})
    groups = {}
    for r in want:
        whole, part = groups.get(r[1] or "NA", (0, 0))
        groups[r[1] or "NA"] = (whole + (r[7] or 0), part + (r[5] or 0))
    shares = {r["group"]: r["value"] for r in
              composition.composition(table, bridge, spec, DS, "kingdom").where("biotype = 'm'").collect()}
    assert shares == pytest.approx({g: part / whole * 100 for g, (whole, part) in groups.items() if whole > 0})
