"""The genome annotation dataset: its nested layout and its flat tables.

Everything here is a fixed value: names that source records, written tables,
saved filters and column presets rely on.  The operators never look at this module; they take
whatever ``SourceLayout`` / ``DatasetSpec`` they are given.
"""

from __future__ import annotations

from .spec import DatasetSpec, SourceLayout

# ---- fixed values ---------------------------------------------------------
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")

BIOTYPES = (
    "protein_coding", "lncRNA", "rRNA", "tRNA", "miRNA",
    "pseudogene", "processed_pseudogene", "antisense", "snRNA", "snoRNA",
    "IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_V_gene",
    "Mt_rRNA", "Mt_tRNA",
    "TR_C_gene", "TR_J_gene", "TR_V_gene",
    "Y_RNA", "misc_RNA", "ribozyme", "scaRNA",
    "transcribed_processed_pseudogene", "transcribed_unprocessed_pseudogene",
    "unitary_pseudogene", "unprocessed_pseudogene", "vault_RNA",
)

AREA_COLUMNS = ("range_km2", "mean_elevation", "min_elevation", "max_elevation", "median_elevation")

CLIMATE_VARS = ("bio1", "bio7", "bio12", "bio15")
CLIMATE_STATS = ("mean", "max", "min")

URL_FIELDS = (
    ("Biodiversity_portal", "biodiversity_portal"),
    ("GTF", "gtf_file"),
    ("Ensembl_browser", "ensembl_browser"),
    ("GBIF", "gbif"),
)

ENA_FIELDS = (
    "assembly_level", "ungapped_length", "scaffold_n50", "scaffold_count",
    "contig_n50", "contig_count", "coverage", "spanned_gaps", "unspanned_gaps",
    "contig_l50", "scaffold_l50", "contig_n75", "contig_n90", "scaffold_n75",
    "scaffold_n90", "replicon_count", "non_chromosome_replicon_count",
)

ENSEMBL_GROUPS = (
    ("assembly_stats", "assembly", (
        "contig_n50", "total_genome_length", "total_coding_sequence_length",
        "total_gap_length", "spanned_gaps", "chromosomes", "toplevel_sequences",
        "component_sequences", "gc_percentage",
    )),
    ("coding_stats", "coding", (
        "coding_genes", "average_genomic_span", "average_sequence_length",
        "average_cds_length", "shortest_gene_length", "longest_gene_length",
        "total_transcripts", "coding_transcripts", "transcripts_per_gene",
        "coding_transcripts_per_gene", "total_exons", "total_coding_exons",
        "average_exon_length", "average_coding_exon_length",
        "average_exons_per_transcript",
        "average_coding_exons_per_coding_transcript",
        "total_introns", "average_intron_length",
    )),
    ("non_coding_stats", "non_coding", (
        "non_coding_genes", "small_non_coding_genes", "long_non_coding_genes",
        "misc_non_coding_genes", "average_genomic_span", "average_sequence_length",
        "shortest_gene_length", "longest_gene_length", "total_transcripts",
        "transcripts_per_gene", "total_exons", "average_exon_length",
        "average_exons_per_transcript", "total_introns", "average_intron_length",
    )),
    ("pseudogene_stats", "pseudogene", (
        "pseudogenes", "average_genomic_span", "average_sequence_length",
        "shortest_gene_length", "longest_gene_length", "total_transcripts",
        "transcripts_per_gene", "total_exons", "average_exon_length",
        "average_exons_per_transcript", "total_introns", "average_intron_length",
    )),
)

TAG_LEVELS = ("realm", "biome", "ecoregion")

CHILD_FIELDS = (
    "occurrenceID", "geo_coordinate", "geodeticDatum",
    "coordinateUncertaintyInMeters", "eventDate", "elevation", "countryCode",
    "iucnRedListCategory", "institutionCode", "collectionCode", "catalogNumber",
)

CHILD_COLUMNS = (
    "accession", "occurrenceID", "geo_coordinate", "geodeticDatum",
    "coordinateUncertaintyInMeters", "eventDate", "elevation", "countryCode",
    "iucnRedListCategory", "gadm_level0_name", "gadm_level1_name",
    "gadm_level2_name", "institutionCode", "collectionCode", "catalogNumber",
)

METRIC_PREFIXES = (
    ("ena_", "ENA"),
    ("ens_assembly_", "Assembly"),
    ("ens_coding_", "Coding"),
    ("ens_non_coding_", "Non-coding"),
    ("ens_pseudogene_", "Pseudogene"),
)

METRIC_NAMES = {
    "coding_genes": "genes",
    "non_coding_genes": "genes",
    "pseudogenes": "pseudogenes",
    "gc_percentage": "GC %",
    "contig_n50": "contig N50",
    "scaffold_n50": "scaffold N50",
    "contig_n75": "contig N75",
    "contig_n90": "contig N90",
    "scaffold_n75": "scaffold N75",
    "scaffold_n90": "scaffold N90",
    "contig_l50": "contig L50",
    "scaffold_l50": "scaffold L50",
}

LABELS = {
    "clim_bio1_mean": "Mean Annual Mean Temperature (°C)",
    "clim_bio1_max": "Max Annual Mean Temperature (°C)",
    "clim_bio1_min": "Min Annual Mean Temperature (°C)",
    "clim_bio12_mean": "Mean Annual Precipitation (mm)",
    "clim_bio12_max": "Max Annual Precipitation (mm)",
    "clim_bio12_min": "Min Annual Precipitation (mm)",
    "clim_bio7_mean": "Mean Temperature Annual Range (°C)",
    "clim_bio7_max": "Max Temperature Annual Range (°C)",
    "clim_bio7_min": "Min Temperature Annual Range (°C)",
    "clim_bio15_mean": "Mean Precipitation Seasonality (CV)",
    "clim_bio15_max": "Max Precipitation Seasonality (CV)",
    "clim_bio15_min": "Min Precipitation Seasonality (CV)",
    "range_km2": "Distribution Range Size (km², EOO)",
    "mean_elevation": "Mean Elevation (m)",
    "min_elevation": "Min Elevation (m)",
    "max_elevation": "Max Elevation (m)",
    "median_elevation": "Median Elevation (m)",
}

PRESETS = {
    "ensembl_biotypes": (
        "accession", "species", "total_gene_biotypes",
        "protein_coding_count", "lncRNA_count", "rRNA_count", "tRNA_count",
        "miRNA_count", "pseudogene_count", "processed_pseudogene_count",
        "antisense_count", "snRNA_count", "snoRNA_count",
        "gtf_file", "biodiversity_portal", "ensembl_browser",
    ),
    "ensembl_assembly": ("accession", "species", "ens_assembly_*"),
    "ensembl_coding": ("accession", "species", "ens_coding_*"),
    "ensembl_non_coding": ("accession", "species", "ens_non_coding_*"),
    "ensembl_pseudogene": ("accession", "species", "ens_pseudogene_*"),
    "ena_assembly_metrics": ("accession", "species", "ena_*"),
    "taxonomy": (
        "accession", "tax_id", "kingdom", "phylum", "class", "order", "family",
        "genus", "species",
    ),
    "bioclimate": (
        "accession", "species",
        "clim_bio1_mean", "clim_bio1_max", "clim_bio1_min",
        "clim_bio7_mean", "clim_bio7_max", "clim_bio7_min",
        "clim_bio12_mean", "clim_bio12_max", "clim_bio12_min",
        "clim_bio15_mean", "clim_bio15_max", "clim_bio15_min",
    ),
    "distribution": (
        "accession", "species", "range_km2", "mean_elevation", "min_elevation",
        "max_elevation", "gbif",
    ),
    "sources": (
        "accession", "species", "biodiversity_portal", "gtf_file",
        "ensembl_browser", "gbif",
    ),
}
GENOME_SOURCE = SourceLayout(
    key="accession",
    rank_struct="taxonomy",
    rank_fields=(*RANKS, "tax_id"),
    plain=AREA_COLUMNS,
    grid_struct="clim_CHELSA",
    grid_prefix="clim",
    grid_vars=CLIMATE_VARS,
    grid_stats=CLIMATE_STATS,
    url_struct="meta_urls",
    url_fields=URL_FIELDS,
    measure_array="gene_biotypes",
    measure_key="gene_biotype",
    measure_count="gene_biotype_count",
    measure_share="gene_biotype_percentage",
    measure_total="total_gene_biotypes",
    flat_stats=(("ena_stats", "ena", ENA_FIELDS),),
    grouped_stats=(("ensembl_stats", "ens", ENSEMBL_GROUPS),),
    tag_struct="biogeo_Ecoregion",
    tag_values="values",
    child_array="gbif_occs",
    child_fields=CHILD_FIELDS,
    child_place="gadm",
    child_place_levels=("level0", "level1", "level2"),
    child_place_field="name",
    child_columns=CHILD_COLUMNS,
)

GENOME = DatasetSpec(
    key="accession",
    ranks=RANKS,
    id_facet="tax_id",
    title="species",
    measures=BIOTYPES,
    total="total_gene_biotypes",
    not_measures=frozenset({"total_gene_biotypes"}),
    category="clim_bio1_mean",
    tag_key="accession",
    tag_levels=TAG_LEVELS,
    urls=tuple(column for _, column in URL_FIELDS),
    metric_prefixes=METRIC_PREFIXES,
    metric_names=METRIC_NAMES,
    labels=LABELS,
    presets=PRESETS,
    default_preset="ensembl_biotypes",
    main_file="dashboard_main.parquet",
    tag_file="biogeo_long.parquet",
    child_file="gbif_occurrences.parquet",
)
# ---- end of fixed values ----------------------------------------------------
