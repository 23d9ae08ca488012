import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codonlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests", "6g")


def dna(seed: int, n: int, letters: str = "ACGT") -> str:
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def contigs_of(spark, seqs):
    """(genome_id, contig_id, seq) rows as a contig table."""
    rows = [(g, c, "grp", s, len(s)) for g, c, s in seqs]
    return spark.createDataFrame(rows, "genome_id string, contig_id string, tax_group string, seq string, length long")


def revcomp(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_orfs(seq: str, min_length: int):
    """Set of (strand, start, end, frame, codon), strand coordinates, by direct search from every start."""
    found = set()
    for strand, s in (("forward", seq), ("reverse", revcomp(seq))):
        for i in range(len(s) - 2):
            if s[i:i + 3] not in ("ATG", "GTG", "TTG"):
                continue
            stop = next((j for j in range(i + 3, len(s) - 2, 3) if s[j:j + 3] in ("TAA", "TAG", "TGA")), None)
            if stop is not None and stop + 3 - i >= min_length:
                found.add((strand, i + 1, stop + 3, i % 3, s[i:i + 3]))
    return found
