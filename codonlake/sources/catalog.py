"""Genome catalog and holdout list as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.constants import HOLDOUT_GENOMES

SCHEMA = "id int, accession string, name string, tax_group string"

# --- fixed values: id | accession | name | taxonomic group ------------------------------------------
CATALOG = [
    (1, "NC_000913.3", "Escherichia coli K-12 MG1655", "Proteobacteria"),
    (2, "NC_002695.2", "Escherichia coli O157:H7 Sakai", "Proteobacteria"),
    (3, "NC_008253.1", "Escherichia coli 536", "Proteobacteria"),
    (4, "NC_003197.2", "Salmonella enterica LT2", "Proteobacteria"),
    (5, "NC_002505.1", "Vibrio cholerae", "Proteobacteria"),
    (6, "NC_002516.2", "Pseudomonas aeruginosa PAO1", "Proteobacteria"),
    (7, "NC_004741.1", "Shigella flexneri 2a", "Proteobacteria"),
    (8, "NC_007503.1", "Carboxydothermus hydrogenoformans", "Proteobacteria"),
    (9, "NC_008570.1", "Aeromonas hydrophila", "Proteobacteria"),
    (10, "NC_010067.1", "Salmonella Typhimurium", "Proteobacteria"),
    (11, "NC_010473.1", "Escherichia coli K-12 DH10B", "Proteobacteria"),
    (12, "NC_011750.1", "Escherichia coli IAI39", "Proteobacteria"),
    (13, "NC_012759.1", "Escherichia coli BW2952", "Proteobacteria"),
    (14, "NC_013654.1", "Shigella boydii", "Proteobacteria"),
    (15, "NC_004547.2", "Erwinia carotovora", "Proteobacteria"),
    (16, "NC_007946.1", "Escherichia coli UTI89", "Proteobacteria"),
    (17, "NC_009648.1", "Klebsiella pneumoniae 342", "Proteobacteria"),
    (18, "NC_010498.1", "Escherichia coli SMS-3-5", "Proteobacteria"),
    (19, "NC_011294.1", "Salmonella enterica P125109", "Proteobacteria"),
    (20, "NC_011415.1", "Escherichia coli SE11", "Proteobacteria"),
    (21, "NC_012967.1", "Escherichia coli B str. REL606", "Proteobacteria"),
    (22, "NC_013361.1", "Escherichia coli O26:H11", "Proteobacteria"),
    (23, "NC_013941.1", "Escherichia coli O55:H7", "Proteobacteria"),
    (24, "NC_017634.1", "Salmonella enterica RKS4594", "Proteobacteria"),
    (25, "NC_020063.1", "Escherichia coli O145:H28", "Proteobacteria"),
    (26, "NC_000964.3", "Bacillus subtilis 168", "Firmicutes"),
    (27, "NC_003210.1", "Listeria monocytogenes EGD-e", "Firmicutes"),
    (28, "NC_002737.2", "Streptococcus pyogenes M1 GAS", "Firmicutes"),
    (29, "NC_003098.1", "Streptococcus pneumoniae R6", "Firmicutes"),
    (30, "NC_004461.1", "Staphylococcus epidermidis", "Firmicutes"),
    (31, "NC_007168.1", "Staphylococcus haemolyticus", "Firmicutes"),
    (32, "NC_007795.1", "Staphylococcus aureus NCTC 8325", "Firmicutes"),
    (33, "NC_009641.1", "Staphylococcus aureus Newman", "Firmicutes"),
    (34, "NC_010079.1", "Staphylococcus aureus TCH1516", "Firmicutes"),
    (35, "NC_013891.1", "Listeria seeligeri", "Firmicutes"),
    (36, "NC_014829.1", "Bacillus cellulosilyticus", "Firmicutes"),
    (37, "NC_016047.1", "Bacillus subtilis TU-B-10", "Firmicutes"),
    (38, "NC_017195.1", "Bacillus subtilis TO-A", "Firmicutes"),
    (39, "NC_018520.1", "Bacillus subtilis XF-1", "Firmicutes"),
    (40, "NC_020244.1", "Bacillus subtilis QB928", "Firmicutes"),
    (41, "NC_004668.1", "Enterococcus faecalis V583", "Firmicutes"),
    (42, "NC_008555.1", "Listeria welshimeri", "Firmicutes"),
    (43, "NC_012469.1", "Streptococcus mutans NN2025", "Firmicutes"),
    (44, "NC_013890.1", "Streptococcus suis", "Firmicutes"),
    (45, "NC_014498.1", "Streptococcus pneumoniae 670", "Firmicutes"),
    (46, "NC_015875.1", "Streptococcus pseudopneumoniae", "Firmicutes"),
    (47, "NC_017349.1", "Staphylococcus aureus LGA251", "Firmicutes"),
    (48, "NC_017673.1", "Staphylococcus aureus 71193", "Firmicutes"),
    (49, "NC_018608.1", "Staphylococcus aureus 08BA02176", "Firmicutes"),
    (50, "NC_020291.1", "Clostridium difficile", "Firmicutes"),
    (51, "NC_000962.3", "Mycobacterium tuberculosis H37Rv", "Actinobacteria"),
    (52, "NC_002755.2", "Mycobacterium tuberculosis CDC1551", "Actinobacteria"),
    (53, "NC_008769.1", "Mycobacterium bovis BCG Pasteur", "Actinobacteria"),
    (54, "NC_009525.1", "Mycobacterium tuberculosis H37Ra", "Actinobacteria"),
    (55, "NC_012207.1", "Mycobacterium bovis AF2122/97", "Actinobacteria"),
    (56, "NC_015848.1", "Mycobacterium canettii", "Actinobacteria"),
    (57, "NC_016804.1", "Mycobacterium bovis BCG Tokyo", "Actinobacteria"),
    (58, "NC_017026.1", "Mycobacterium tuberculosis RGTB327", "Actinobacteria"),
    (59, "NC_018143.2", "Mycobacterium tuberculosis KZN 1435", "Actinobacteria"),
    (60, "NC_019950.1", "Mycobacterium canettii CIPT", "Actinobacteria"),
    (61, "NC_003888.3", "Streptomyces coelicolor A3(2)", "Actinobacteria"),
    (62, "NC_009664.1", "Kineococcus radiotolerans", "Actinobacteria"),
    (63, "NC_013131.1", "Catenulispora acidiphila", "Actinobacteria"),
    (64, "NC_013235.1", "Nakamurella multipartita", "Actinobacteria"),
    (65, "NC_013235.1", "Nakamurella multipartita", "Actinobacteria"),
    (66, "NC_014158.1", "Tsukamurella paurometabola", "Actinobacteria"),
    (67, "NC_014666.1", "Frankia sp. EAN1pec", "Actinobacteria"),
    (68, "NC_015312.1", "Pseudonocardia dioxanivorans", "Actinobacteria"),
    (69, "NC_016111.1", "Streptomyces cattleya", "Actinobacteria"),
    (70, "NC_016582.1", "Streptomyces bingchenggensis", "Actinobacteria"),
    (71, "NC_017093.1", "Actinoplanes missouriensis", "Actinobacteria"),
    (72, "NC_018524.1", "Nocardiopsis dassonvillei", "Actinobacteria"),
    (73, "NC_019673.1", "Saccharothrix espanaensis", "Actinobacteria"),
    (74, "NC_020133.1", "Mycobacterium liflandii", "Actinobacteria"),
    (75, "NC_021191.1", "Actinoplanes sp. SE50/110", "Actinobacteria"),
    (76, "NC_000854.2", "Aeropyrum pernix K1", "Archaea"),
    (77, "NC_000868.1", "Pyrococcus abyssi GE5", "Archaea"),
    (78, "NC_000917.1", "Archaeoglobus fulgidus DSM 4304", "Archaea"),
    (79, "NC_002607.1", "Halobacterium salinarum R1", "Archaea"),
    (80, "NC_003552.1", "Methanosarcina acetivorans C2A", "Archaea"),
    (81, "NC_003106.2", "Sulfolobus tokodaii str. 7", "Archaea"),
    (82, "NC_003413.1", "Pyrococcus furiosus DSM 3638", "Archaea"),
    (83, "NC_007426.1", "Natronomonas pharaonis", "Archaea"),
    (84, "NC_008701.1", "Pyrobaculum islandicum", "Archaea"),
    (85, "NC_009073.1", "Pyrobaculum calidifontis", "Archaea"),
    (86, "NC_009776.1", "Ignicoccus hospitalis", "Archaea"),
    (87, "NC_009975.1", "Methanococcus maripaludis C6", "Archaea"),
    (88, "NC_010085.1", "Nitrosopumilus maritimus", "Archaea"),
    (89, "NC_013156.1", "Methanocaldococcus fervens", "Archaea"),
    (90, "NC_013407.1", "Methanocaldococcus vulcanius", "Archaea"),
    (91, "NC_014122.1", "Methanocaldococcus infernus", "Archaea"),
    (92, "NC_014222.1", "Methanococcus voltae A3", "Archaea"),
    (93, "NC_014804.1", "Thermococcus barophilus", "Archaea"),
    (94, "NC_015865.1", "Thermococcus sp. 4557", "Archaea"),
    (95, "NC_016051.1", "Thermococcus onnurineus", "Archaea"),
    (96, "NC_017275.1", "Sulfolobus islandicus Y.N.15.51", "Archaea"),
    (97, "NC_018092.1", "Methanobrevibacter smithii", "Archaea"),
    (98, "NC_019791.1", "Caldisphaera lagunensis", "Archaea"),
    (99, "NC_020156.1", "Methanobacterium sp. AL-21", "Archaea"),
    (100, "NC_021054.1", "Haloferax volcanii DS2", "Archaea"),
]


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog. One accession is listed under two ids, so the key is the id."""
    return spark.createDataFrame(CATALOG, SCHEMA)


def by_id(table: DataFrame, genome_id: int) -> DataFrame:
    return table.where(F.col("id") == genome_id)


def by_accession(table: DataFrame, accession: str) -> DataFrame:
    return table.where(F.col("accession") == accession)


def by_group(table: DataFrame, tax_group: str | None = None) -> DataFrame:
    return table if tax_group is None else table.where(F.col("tax_group") == tax_group)


def duplicate_accessions(table: DataFrame) -> DataFrame:
    return table.groupBy("accession").agg(F.count("*").alias("n")).where("n > 1")


def holdout(spark: SparkSession) -> DataFrame:
    """Twenty genomes that no training may use."""
    rows = [(a, g) for g, accessions in HOLDOUT_GENOMES.items() for a in accessions]
    return spark.createDataFrame(rows, "accession string, tax_group string")


def holdout_leaks(holdout_table: DataFrame, training: DataFrame) -> DataFrame:
    """Holdout accessions that occur in a training table. Empty when the sets are disjoint."""
    return holdout_table.join(training.select("accession").distinct(), "accession", "left_semi")
