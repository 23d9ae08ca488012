"""Imports every operator module, so that its query is registered."""

from codonlake.llm import collinear, gnat, jaccard_join, kneser_ney, license_scan, merkle, pii_crf, piece_sampler, quality_ledger, rotated_codes, source_mix, warc, winnowing  # noqa: F401
from codonlake.llm.common import ORACLE, QUERIES  # noqa: F401
