"""Translation and protein composition as column functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import _entropy_bits, bind, codons, letter_count, ratio


def _letters_by_code() -> str:
    """Amino acids in base-4 order of the codon (A, C, G, T), from the table in its usual order."""
    usual = dict(zip(("".join(p) for p in product(C.CODON_LETTERS, repeat=3)), C.AMINO_ACIDS_T11))
    return "".join(usual["".join(p)] for p in product("ACGT", repeat=3))


def translate_all(seq: Column) -> Column:
    """Amino acids of every complete codon, stops as ``*``, codons with other letters as X."""
    table = F.lit(_letters_by_code())
    code = lambda c: F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("int")
    letter = lambda c: F.when(
        F.translate(c, "ACGT", "") == "", F.substring(table, code(c) + 1, F.lit(1))
    ).otherwise("X")
    return F.array_join(F.transform(codons(seq), letter), "")


def translate_to_stop(seq: Column) -> Column:
    """Protein up to, without, the first stop. The start codon keeps its own amino acid."""
    return F.substring_index(translate_all(seq), "*", 1)


def share_of(protein: Column, letters: str) -> Column:
    return ratio(letter_count(protein, letters).cast("double"), F.length(protein))


def _mean_over_residues(protein: Column, use) -> Column:
    """Mean of use(hydropathy) over the residues; letters without a value count as 0."""
    values = F.array(*[F.lit(C.HYDROPATHY.get(chr(65 + i), 0.0)) for i in range(26)])
    value = lambda aa: F.coalesce(F.get(values, F.ascii(aa) - 65), F.lit(0.0))
    total = F.aggregate(F.split(protein, ""), F.lit(0.0), lambda acc, aa: acc + use(value(aa)))
    return ratio(total, F.length(protein))


def hydropathy_mean(protein: Column) -> Column:
    return _mean_over_residues(protein, lambda v: v)


def hydropathy_std(protein: Column) -> Column:
    """Population deviation of the hydropathy, 0 for a single residue."""
    spread = bind(
        hydropathy_mean(protein),
        lambda m: F.sqrt(_mean_over_residues(protein, lambda v: (v - m) * (v - m))),
    )
    return F.when(F.length(protein) > 1, spread).otherwise(F.lit(0.0))


def protein_features(protein: Column) -> dict[str, Column]:
    return {
        "hydrophobicity_mean": hydropathy_mean(protein),
        "hydrophobicity_std": hydropathy_std(protein),
        "charge_mean": share_of(protein, "DEKR"),
        "aromatic_fraction": share_of(protein, "FYW"),
        "small_fraction": share_of(protein, "AGSTCV"),
        "polar_fraction": share_of(protein, "STNQY"),
    }


def amino_acid_entropy(protein: Column, min_length: int = 10, short_value: float = 999.0) -> Column:
    """Shannon entropy of the residues in bits; ``short_value`` under ``min_length`` residues."""
    residues = F.split(protein, "")
    return F.when(F.length(protein) < min_length, F.lit(short_value)).otherwise(
        _entropy_bits(residues, 0.0)
    )


def n_terminal_shares(seq: Column, n_codons: int = 5) -> dict[str, Column]:
    """Composition of the first codons of an ORF (start codon included, stops not counted)."""
    head = F.replace(translate_all(F.substring(seq, 1, 3 * n_codons)), F.lit("*"), F.lit(""))
    return {
        "nterm_charged_pos": share_of(head, "KRH"),
        "nterm_charged_neg": share_of(head, "DE"),
        "nterm_polar": share_of(head, "STNQ"),
        "nterm_hydrophobic": share_of(head, "ACGILMFPWVY"),
    }
