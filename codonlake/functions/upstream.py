"""Column functions over the bases before a start codon (strand direction)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import codons, ratio


def spacer_score(up: Column) -> Column:
    """Longest motif whose last occurrence ends 4 to 12 bases before the start, in sevenths."""
    backwards = F.reverse(up)
    scores = [F.lit(0.0)]
    for motif in C.SD_MOTIFS:
        spacer = F.instr(backwards, motif[::-1]) - 1
        scores.append(F.when(spacer.between(4, 12), F.lit(len(motif) / 7.0)).otherwise(0.0))
    return F.greatest(*scores)


def _position_gc(seq: Column) -> list[Column]:
    """G/C share at the three positions of the in-frame codons."""
    words = codons(seq)
    return [
        ratio(
            F.size(F.filter(words, lambda c: F.substring(c, p, 1).isin("G", "C"))).cast("double"),
            F.size(words),
        )
        for p in (1, 2, 3)
    ]


def gc_position_bias(up: Column) -> Column:
    g1, g2, g3 = _position_gc(up)
    return F.when(F.length(up) < 9, F.lit(0.0)).otherwise(F.abs(g3 - (g1 + g2) / 2))


def gc_periodicity(seq: Column) -> Column:
    """Coefficient of variation of the G/C share over the three codon positions."""
    g = _position_gc(seq)
    mean = (g[0] + g[1] + g[2]) / 3
    var = ((g[0] - mean) ** 2 + (g[1] - mean) ** 2 + (g[2] - mean) ** 2) / 3
    return F.when((F.length(seq) < 9) | (mean < 0.01), F.lit(0.0)).otherwise(F.sqrt(var) / mean)


def anti_sd_pairing(up: Column) -> Column:
    """Best pairing with the anti-SD tail: pair 1, G-U wobble 0.5, spacer 4 to 14, over its length."""
    pair = {"A": "T", "U": "A", "G": "C", "C": "G"}
    wobble = {"U": "G", "G": "T"}
    size = len(C.ANTI_SD)
    facing = C.ANTI_SD[::-1]

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for p, base in enumerate(facing):
            letter = F.substring(up, i + p, F.lit(1))
            gain = F.when(letter == pair[base], 1.0)
            if base in wobble:
                gain = gain.when(letter == wobble[base], 0.5)
            total = total + gain.otherwise(0.0)
        return total / size

    first = F.greatest(F.lit(1), F.length(up) - size - 14 + 1)
    last = F.length(up) - size - 4 + 1
    return F.when(last >= 1, F.array_max(F.transform(F.sequence(first, last), at))).otherwise(0.0)


def stop_distance(region: Column) -> Column:
    """Distance from the start codon back to the nearest stop codon in any frame, else the region length."""
    backwards = F.reverse(region)
    found = [
        F.when(F.instr(backwards, stop[::-1]) > 0, F.instr(backwards, stop[::-1]) + 2)
        for stop in C.STOP_CODONS
    ]
    return F.coalesce(F.least(*found), F.length(region))


def codon_mean(seq: Column, table: Column) -> Column:
    """Mean codon log-ratio of the in-frame codons without N, 0 without codons."""
    words = F.filter(codons(seq), lambda c: ~c.contains("N"))
    value = lambda c: F.coalesce(
        F.get(table, F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("int")), F.lit(0.0)
    )
    total = F.aggregate(words, F.lit(0.0), lambda acc, c: acc + value(c))
    return ratio(total, F.size(words))


def pwm_score(window: Column, table: Column, size: int) -> Column:
    """Sum of log-odds of the last ``size`` bases; 0 without a table or with a shorter window."""
    tail = F.right(window, F.lit(size))
    places = F.sequence(F.lit(1), F.lit(size))
    value = lambda i: F.coalesce(
        F.get(table, (i - 1) * 4 + F.instr(F.lit("ACGT"), F.substring(tail, i, F.lit(1))) - 1),
        F.lit(0.0),
    )
    known = lambda i: F.substring(tail, i, F.lit(1)).isin("A", "C", "G", "T")
    total = F.aggregate(
        places, F.lit(0.0), lambda acc, i: acc + F.when(known(i), value(i)).otherwise(F.lit(0.0))
    )
    return F.when(table.isNull() | (F.length(window) < size), F.lit(0.0)).otherwise(total)
