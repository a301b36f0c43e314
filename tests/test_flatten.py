"""ETL over hand-made nested rows with every edge the layout allows."""

import pytest
from pyspark.sql import functions as F

from facetspark.genome import GENOME, GENOME_SOURCE
from facetspark.operators.flatten import build_all, build_children, build_main, build_tags, run_etl
from facetspark.sources.tables import list_columns, open_table, read_columns, read_tables, shared_folder

TAXON = "struct<kingdom:string,phylum:string,class:string,`order`:string,family:string,genus:string,species:string,tax_id:bigint>"
ENTRY = ("struct<gene_biotype:string,gene_biotype_count:bigint,gene_biotype_percentage:double,"
         "total_gene_biotypes:bigint>")
STAT = "struct<mean:double,max:double,min:double>"
LEVEL = "struct<`count`:int,`values`:array<array<string>>>"
OCC = ("struct<occurrenceID:string,eventDate:string,elevation:double,countryCode:string,"
       "gadm:struct<level0:struct<name:string>,level1:struct<name:string>>>")
SCHEMA = (
    f"accession string, taxonomy {TAXON}, gene_biotypes array<{ENTRY}>, "
    f"clim_CHELSA struct<bio1:{STAT},bio12:{STAT}>, meta_urls array<struct<GTF:string,GBIF:string>>, "
    f"range_km2 double, ena_stats struct<scaffold_n50:bigint,assembly_level:string>, "
    f"ensembl_stats struct<coding_stats:struct<coding_genes:bigint>>, "
    f"biogeo_Ecoregion struct<realm:{LEVEL},biome:{LEVEL}>, gbif_occs array<{OCC}>, unused string"
)


@pytest.fixture(scope="module")
def source(spark):
    taxon = ("Animalia", "P", "C", None, "F", "G", "G s", 7)
    biotypes = [("lncRNA", 1, 10.0, None), ("other", 5, 50.0, 9), None, ("lncRNA", 2, 20.0, 11),
                ("rRNA", None, None, 12)]
    occ = ("o1", "2020", 1.5, "SE", (("Sweden",), (None,)))
    return spark.createDataFrame([
        ("A", taxon, biotypes, ((1.0, 2.0, 0.5), None), [("g.gtf", "gbif.org"), ("later", "x")], 4.5,
         (10, "Chromosome"), ((3,),),
         ((3, [["r1", "r2"], None, ["r1", None]]), (1, [["b1"]])), [occ, None, occ, ("o2", None, None, None, None)], "u"),
        ("B", None, [], None, [], None, None, None, (None, (0, [])), None, "u"),
        ("C", taxon, None, None, None, 1.0, None, (None,), None, [], "u"),
        ("A", taxon, [("rRNA", 4, 1.0, None)], None, None, 1.0, None, None, ((1, [["r1"]]), None), [occ], "u"),
        (None, taxon, None, None, None, None, None, None, ((1, [["r9"]]), None), None, "u"),
    ], SCHEMA)


def test_main_has_one_row_per_source_row_in_the_fixed_schema(source):
    main = build_main(source, GENOME_SOURCE, GENOME)
    assert main.count() == 5
    assert len(main.columns) == 158
    assert main.columns[:9] == ["accession", "kingdom", "phylum", "class", "order", "family", "genus", "species", "tax_id"]
    assert main.columns[30:33] == ["total_gene_biotypes", "protein_coding_count", "protein_coding_percentage"]
    assert main.columns[-1] == "ens_pseudogene_average_intron_length"
    types = dict(main.dtypes)
    assert types["lncRNA_count"] == "bigint" and types["lncRNA_percentage"] == "float"
    assert types["ena_assembly_level"] == "string" and types["total_gene_biotypes"] == "bigint"


def test_main_values(source, rows):
    main = build_main(source, GENOME_SOURCE, GENOME)
    a = main.where("accession = 'A' AND range_km2 = 4.5").first()
    assert (a["lncRNA_count"], a["lncRNA_percentage"]) == (2, 20.0)            # the last entry wins
    assert a["rRNA_count"] is None and a["protein_coding_count"] is None
    assert a["total_gene_biotypes"] == 9                                       # first non-null, unlisted included
    assert (a["clim_bio1_mean"], a["clim_bio1_max"], a["clim_bio1_min"]) == (1.0, 2.0, 0.5)
    assert a["clim_bio12_mean"] is None and a["clim_bio7_mean"] is None
    assert (a["gtf_file"], a["gbif"], a["ensembl_browser"]) == ("g.gtf", "gbif.org", None)
    assert (a["ena_scaffold_n50"], a["ena_assembly_level"], a["ena_coverage"]) == (10, "Chromosome", None)
    assert (a["ens_coding_coding_genes"], a["ens_assembly_contig_n50"]) == (3, None)
    assert (a["kingdom"], a["order"], a["tax_id"]) == ("Animalia", None, 7)
    b = main.where("accession = 'B'").first()
    assert b["kingdom"] is None and b["lncRNA_count"] is None and b["total_gene_biotypes"] is None
    second = main.where("accession = 'A' AND range_km2 = 1.0").first()
    assert second["rRNA_count"] == 4 and second["total_gene_biotypes"] is None


def test_first_total_may_follow_nulls(spark):
    df = spark.createDataFrame([("A", [("x", 1, 1.0, None), ("y", 1, 1.0, None), ("z", 1, 1.0, 5), ("z", 1, 1.0, 6)]),
                                ("B", [("x", 1, 1.0, 8), ("y", 1, 1.0, None)])], f"accession string, gene_biotypes array<{ENTRY}>")
    main = build_main(df, GENOME_SOURCE, GENOME).select("accession", "total_gene_biotypes")
    assert dict(main.collect()) == {"A": 5, "B": 8}


def test_list_of_structs_is_read_like_a_struct(source, rows):
    legacy = source.withColumn("taxonomy", F.when(F.col("taxonomy").isNotNull(), F.array("taxonomy", "taxonomy")))
    columns = ["accession", "kingdom", "tax_id"]
    assert rows(build_main(legacy, GENOME_SOURCE, GENOME), *columns) == rows(
        build_main(source, GENOME_SOURCE, GENOME), *columns)


def test_missing_source_columns_become_typed_nulls(spark):
    main = build_main(spark.createDataFrame([("A",)], "accession string"), GENOME_SOURCE, GENOME)
    assert len(main.columns) == 158
    assert [v for v in main.first() if v is not None] == ["A"]
    tags = build_tags(spark.createDataFrame([("A",)], "accession string"), GENOME_SOURCE, GENOME)
    assert tags.columns == ["accession", "level", "value"] and tags.count() == 0
    assert build_children(spark.createDataFrame([("A",)], "accession string"), GENOME_SOURCE).count() == 0


def test_tags_are_distinct_and_skip_nulls(source, rows):
    assert rows(build_tags(source, GENOME_SOURCE, GENOME)) == [
        ("A", "biome", "b1"), ("A", "realm", "r1"), ("A", "realm", "r2")]


def test_flat_tag_lists_are_accepted(spark, rows):
    level = "struct<`values`:array<string>>"
    df = spark.createDataFrame([("A", ((["x", None, "x"],),))],
                               f"accession string, biogeo_Ecoregion struct<realm:{level}>")
    assert rows(build_tags(df, GENOME_SOURCE, GENOME)) == [("A", "realm", "x")]


def test_children_are_distinct_and_skip_nulls(source):
    children = build_children(source, GENOME_SOURCE)
    assert children.columns == list(GENOME_SOURCE.child_columns)
    found = {r["occurrenceID"]: r for r in children.collect()}
    assert children.count() == 2
    assert found["o1"]["gadm_level0_name"] == "Sweden" and found["o1"]["gadm_level1_name"] is None
    assert found["o2"]["countryCode"] is None and found["o1"]["elevation"] == 1.5


def test_run_etl_writes_three_tables(spark, source, tmp_path, rows):
    source.write.parquet(f"{tmp_path}/source")
    run_etl(spark, f"{tmp_path}/source", f"{tmp_path}/out", GENOME_SOURCE, GENOME, cluster_by=("kingdom",))
    back = read_tables(spark, f"{tmp_path}/out", GENOME)
    lazy = build_all(source, GENOME_SOURCE, GENOME)
    assert rows(back.main) == rows(lazy.main)
    assert rows(back.tags) == rows(lazy.tags)
    assert rows(back.children) == rows(lazy.children)


def test_opening_and_reading_columns(spark, source, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_table(spark, f"{tmp_path}/nowhere")
    source.write.parquet(f"{tmp_path}/source")
    df = read_columns(spark, f"{tmp_path}/source", ["range_km2", "nope", "accession"])
    assert list_columns(df) == ["range_km2", "accession"]


def test_main_plan_has_no_shuffle_and_reads_wanted_columns_only(spark, source, tmp_path):
    source.write.parquet(f"{tmp_path}/source")
    plan = build_main(open_table(spark, f"{tmp_path}/source"), GENOME_SOURCE, GENOME)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Exchange" not in physical and "Python" not in physical
    assert "unused" not in physical and "gbif_occs" not in physical


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert named in spark.sparkContext.getCheckpointDir()
