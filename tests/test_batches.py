"""Features made over batches of rows in NumPy against the column functions."""

from conftest import dna
from pyspark.sql import functions as F

from codonlake.functions import protein as P, sequence as S
from codonlake.operators import features


def test_codon_features_equal_the_column_functions(spark, monkeypatch):
    texts = ["", "A", "NN", "ATG", "TAA", "NNNATG", "ATGNNACGTTAG", "ATGRYKACGTAAACG", "GTG" + "ACN" * 12 + "TGA", dna(1, 3001), dna(2, 1000, "ACGTN"),
             dna(3, 299, "ACGTRYN"), "ATG" * 40, "GGG" * 9 + "TA"]
    monkeypatch.setattr(features, "SLICE", 700)  # several slices of a batch
    rows = spark.createDataFrame(list(enumerate(texts)), "no long, sequence string").coalesce(1)
    seq, valid, protein = F.col("sequence"), S.valid_codons(F.col("sequence")), P.translate_to_stop(F.col("sequence"))
    plain = {"protein": protein, "gc_content": S.gc_content(seq), "gc_skew": S.gc_skew(seq), "at_skew": S.at_skew(seq), "purine_content": S.purine_fraction(seq),
             "gc3_content": S.gc3_of(valid), "effective_num_codons": S.diversity_of(valid), "codon_bias_index": S.bias_of(valid),
             **P.protein_features(protein), "aa_entropy": P.amino_acid_entropy(protein)}
    assert set(plain) == {"protein", *features.CODON_FEATURES}
    want = {r["no"]: r for r in rows.select("no", *[c.alias(k) for k, c in plain.items()]).collect()}
    got = features.with_codon_features(rows).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["protein"] == want[r["no"]]["protein"]
        for c in features.CODON_FEATURES:
            assert abs(r[c] - want[r["no"]][c]) < 1e-9, (r["no"], c)
    assert features.with_codon_features(rows.where("no < 0")).collect() == []
