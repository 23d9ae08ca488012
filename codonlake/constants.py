"""Fixed values of the domain. They decide results, so they are stated plainly here and nowhere else."""

from __future__ import annotations

# --- fixed values: codons -------------------------------------------------------------------------
START_CODONS = ("ATG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")
START_CODON_SCORE = {"ATG": 1.0, "GTG": 0.7, "TTG": 0.4}
START_CODON_SCORE_OTHER = 0.4

# --- fixed values: ORF length ---------------------------------------------------------------------
MIN_ORF_LENGTH = 100
LENGTH_REFERENCE_BP = 300

# --- fixed values: ribosome binding site ----------------------------------------------------------
RBS_MOTIFS = ("AGGAGG", "GGAGG", "AGGAG", "GAGG", "AGGA", "GGAG")
RBS_WINDOW = 20
RBS_MIN_PURINE = 0.6
RBS_SPACING = (4, 12)
RBS_SITE_LENGTH = (4, 8)
RBS_NONE_SCORE = -5.0

# --- fixed values: self-training ------------------------------------------------------------------
TRAIN_MIN_LENGTH = 300
TRAIN_MAX_LENGTH = 20000
TRAIN_CAP = 2000
TRAIN_MAX_OVERLAP = 0.3
TRAIN_MAX_ENTROPY = 4.2
INTERGENIC_MIN_LENGTH = 150
INTERGENIC_BUFFER = 50
INTERGENIC_GENE_LENGTH = 200
INTERGENIC_RBS = 3.0
MIN_OBSERVATIONS = 10
MAX_MARKOV_ORDER = 10
VALIDATION_SHARE = 0.2
UNSEEN_CODON_FREQ = 0.0001
UNSEEN_BASE_PROB = 0.25
PROB_FLOOR = 1e-10

# --- fixed values: score weights and thresholds ---------------------------------------------------
SCORE_WEIGHTS = {"codon": 1.0, "imm": 1.0, "rbs": 1.0, "length": 1.0, "start": 1.0}
START_SELECTION_WEIGHTS = {
    "codon": 4.8562,
    "imm": 1.0107,
    "rbs": 0.6383,
    "length": 7.4367,
    "start": 0.2755,
}
FIRST_FILTER = {"codon": 0.2665, "imm": 0.2308, "length": -0.2812, "combined": 0.2643}
SECOND_FILTER = {"codon": 0.0872, "imm": 0.3157, "length": 0.2762, "combined": 0.4669}
COMPONENTS = ("codon", "imm", "rbs", "length", "start")

GROUP_FILTER_PROB = 0.07
FINAL_FILTER_PROB = 0.25
CONTEST_GAP = 1.0
FLIP_PROB = 0.80
SINGLETON_GAP = 999.0

# --- fixed values: upstream motifs and alignments -------------------------------------------------
SD_MOTIFS = ("AAGGAGG", "AAGGAG", "AGGAG", "GGAGG", "GAGG", "AAGG", "AGGA")
ANTI_SD = "GAUCACCUCCUUA"
TATA_BOX = "TATAAT"
PAIR_WINDOW = 25
PWM_WINDOW = 20
PWM_MIN_WINDOWS = 50
LENGTH_PRIOR_DEFAULT = (800.0, 400.0)

# --- fixed values: translation table 11, codons in T, C, A, G order --------------------------------
CODON_LETTERS = "TCAG"
AMINO_ACIDS_T11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# --- fixed values: Kyte-Doolittle hydropathy ------------------------------------------------------
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4,
    "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8,
    "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# --- fixed values: quality grading ----------------------------------------------------------------
ACCESSION_PATTERN = r"^[A-Z]{2}_\d{6,}\.\d+$"
IUPAC_BASES = "ACGTNRYWSKMBDHV"
GROUP_F1_GAP_PP = 5.0
SMALL_BATCH = 10
RUN_REGRESSION_PP = 0.05

HOLDOUT_GENOMES = {
    "Proteobacteria": ("NC_002947.4", "NC_002929.2", "NC_003143.1", "NC_003116.1", "NC_004757.1"),
    "Firmicutes": ("NC_008497.1", "NC_004350.2", "NC_006270.3", "NC_006274.1", "NC_003030.1"),
    "Actinobacteria": ("NC_003155.5", "NC_003450.3", "NC_002677.1", "NC_008268.1", "NC_006958.1"),
    "Archaea": ("NC_008818.1", "NC_015948.1", "NC_014408.1", "NC_019977.1", "NC_007644.1"),
}
