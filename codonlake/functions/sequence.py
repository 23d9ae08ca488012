"""Column functions over one DNA sequence (string columns, upper case)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codonlake import constants as C


def reverse_complement(seq: Column) -> Column:
    """Opposite strand. IUPAC codes are complemented, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTRYKMBVDH", "TGCAYRMKVBHD"))


def sub_sequence(seq: Column, start: Column, end: Column) -> Column:
    """1-based inclusive slice."""
    return F.substring(seq, start, end - start + 1)


def strip_to_letters(text: Column) -> Column:
    """Letters only, upper case. ASCII is selected first because upper() differs between engines for ß."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))


def invalid_letters(seq: Column) -> Column:
    """Distinct letters outside the IUPAC alphabet, sorted."""
    found = F.regexp_extract_all(F.upper(seq), F.lit(f"([^{C.IUPAC_BASES}])"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def letter_count(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def gc_content(seq: Column) -> Column:
    return ratio(letter_count(seq, "GC").cast("double"), F.length(seq))


def gc_skew(seq: Column) -> Column:
    g, c = letter_count(seq, "G"), letter_count(seq, "C")
    return ratio((g - c).cast("double"), g + c)


def at_skew(seq: Column) -> Column:
    a, t = letter_count(seq, "A"), letter_count(seq, "T")
    return ratio((a - t).cast("double"), a + t)


def purine_fraction(seq: Column) -> Column:
    return ratio(letter_count(seq, "AG").cast("double"), F.length(seq))


def codons(seq: Column) -> Column:
    """In-frame complete codons as an array; a trailing rest of one or two bases is dropped."""
    return F.regexp_extract_all(seq, F.lit("(.{3})"), F.lit(1))


def valid_codons(seq: Column) -> Column:
    """Codons without N."""
    return F.filter(codons(seq), lambda c: ~c.contains("N"))


def gc3_of(valid: Column) -> Column:
    """G/C share at the third position of an array of codons."""
    strong = F.filter(valid, lambda c: F.right(c, F.lit(1)).isin("G", "C"))
    return ratio(F.size(strong).cast("double"), F.size(valid))


def diversity_of(valid: Column) -> Column:
    """Distinct codons over all codons."""
    return ratio(F.size(F.array_distinct(valid)).cast("double"), F.size(valid))


def gc3_content(seq: Column) -> Column:
    """G/C share at the third codon position over codons without N."""
    return bind(valid_codons(seq), gc3_of)


def codon_diversity(seq: Column) -> Column:
    return bind(valid_codons(seq), diversity_of)


def bind(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once per row, even where ``use`` needs it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entropy_bits(items: Column, inside_log: float) -> Column:
    """Shannon entropy in bits of an array of symbols; ``inside_log`` is added inside the logarithm.

    Sorting turns equal symbols into runs, so one pass over the sorted array counts every symbol.
    """
    def fold(ordered: Column, total: Column) -> Column:
        part = lambda run: run / total * F.log2(run / total + F.lit(inside_log))
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("h"))
        step = lambda acc, x: F.when(
            (acc["last"] == x) | (acc["run"] == 0),
            F.struct(x.alias("last"), (acc["run"] + 1).alias("run"), acc["h"].alias("h")),
        ).otherwise(
            F.struct(x.alias("last"), F.lit(1).alias("run"), (acc["h"] - part(acc["run"])).alias("h"))
        )
        return F.aggregate(F.concat(ordered, F.array(F.lit("~"))), start, step)["h"]

    return bind(F.array_sort(items), lambda o: bind(F.size(o).cast("double"), lambda n: fold(o, n)))


def bias_of(valid: Column) -> Column:
    """1 - H(codons)/log2(61) of an array of codons; 0 without codons."""
    h = _entropy_bits(valid, 1e-10)
    return F.when(F.size(valid) > 0, 1.0 - h / F.log2(F.lit(61.0))).otherwise(F.lit(0.0))


def codon_bias_index(seq: Column) -> Column:
    return bind(valid_codons(seq), bias_of)


def hairpin_near_stop(seq: Column, window: int = 30) -> Column:
    """1 when more than 60 % of the last ``window`` bases equal their own reverse complement in place."""
    tail = F.split(F.right(seq, F.lit(window)), "")
    mirror = F.split(reverse_complement(F.right(seq, F.lit(window))), "")
    same = F.size(F.filter(F.zip_with(tail, mirror, lambda a, b: a == b), lambda x: x))
    return F.when((F.length(seq) >= window) & (same / window > 0.6), 1.0).otherwise(0.0)


def minus10_score(region: Column) -> Column:
    """Best share of positions equal to the -10 consensus over all placements in ``region``."""
    box = C.TATA_BOX
    k = len(box)
    share = lambda i: sum(
        (F.substring(region, i + j, F.lit(1)) == box[j]).cast("int") for j in range(k)
    ) / F.lit(float(k))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.length(region) - k + 1), share))
    return F.when(F.length(region) >= k, best).otherwise(F.lit(0.0))


def start_codon_type(codon: Column) -> Column:
    return F.when(codon == "GTG", 1.0).when(codon == "TTG", 2.0).otherwise(0.0)


def stop_codon_type(seq: Column) -> Column:
    stop = F.right(seq, F.lit(3))
    return (
        F.when(F.length(seq) < 3, 0.0).when(stop == "TAG", 1.0).when(stop == "TGA", 2.0)
        .otherwise(0.0)
    )


def kmer_words(seq: Column, k: int) -> Column:
    """Overlapping k-mers as an array, for CountVectorizer / HashingTF."""
    last = F.length(seq) - (k - 1)
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))
