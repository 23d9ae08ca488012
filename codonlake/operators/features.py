"""Feature tables for the three classifiers: candidates, stop groups, contested pairs of starts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from codonlake import constants as C
from codonlake.functions import protein as P, sequence as S, upstream as U
from codonlake.operators.distribute import join_per_genome
from codonlake.operators.models import CODON, model_arrays
from codonlake.operators.orf import GROUP, ORF, slice_forward, with_upstream
from codonlake.operators.scoring import markov_lookup
from codonlake.operators.starts import rank_starts
from codonlake.session import stored

NORMS = [f"{c}_score_norm" for c in C.COMPONENTS]

CANDIDATE_FEATURES = [
    *NORMS, "combined_score", "length_bp", "length_codons", "length_log", "start_codon_type",
    "stop_codon_type", "has_kozak_like", "gc_content", "gc_deviation", "gc3_content", "gc_skew", "at_skew",
    "purine_content", "effective_num_codons", "codon_bias_index", "has_hairpin_near_stop",
    "minus10_box_score", "hydrophobicity_mean", "hydrophobicity_std", "charge_mean",
    "aromatic_fraction", "small_fraction", "polar_fraction",
]


def candidate_features(candidates: DataFrame, contigs: DataFrame, genome_gc: DataFrame | None = None,
                       with_minus10: bool = True) -> DataFrame:
    """Per-candidate features. Without ``genome_gc`` (genome_id, genome_gc) the deviation is taken from
    the mean GC of the candidates of the genome. ``with_minus10=False`` keeps that feature at 0."""
    # one look-up of the ORF with the 50 bases before it on the forward strand; box and sequence are cut from it
    rows = slice_forward(candidates, contigs, F.col("genome_start") - 50, F.col("genome_end"), "_wide")
    ahead = F.least(F.lit(50).cast("long"), F.col("genome_start") - 1).cast("int")
    own = F.substring(F.col("_wide"), ahead + 1, F.length("_wide"))
    rows = rows.withColumn("sequence", F.when(F.col("strand") == "reverse", S.reverse_complement(own)).otherwise(own))
    box = F.when(F.col("genome_start") >= 51, S.minus10_score(F.substring("_wide", 1, 26))).otherwise(F.lit(0.0)) if with_minus10 else F.lit(0.0)
    # work per row grows with its sequence, and long ORFs nest in few contigs: spread them by ORF
    rows = rows.repartition(*ORF)
    seq, n = F.col("sequence"), F.col("length")
    rows = rows.select(
        "*",
        n.cast("double").alias("length_bp"),
        (n / 3.0).alias("length_codons"),
        F.log(F.greatest(n, F.lit(1)).cast("double")).alias("length_log"),
        S.start_codon_type(F.col("start_codon")).alias("start_codon_type"),
        S.stop_codon_type(seq).alias("stop_codon_type"),
        (F.coalesce("rbs_score", F.lit(0.0)) > 3.0).cast("double").alias("has_kozak_like"),
        S.hairpin_near_stop(seq).alias("has_hairpin_near_stop"),
        box.alias("minus10_box_score"),
    ).drop("_wide")
    rows = with_codon_features(rows)
    if genome_gc is None:
        rows = stored(rows)  # the means and the rows read it
        means = rows.select("genome_id", "gc_content").groupBy("genome_id").agg(
            F.avg("gc_content").alias("genome_gc")
        )
        rows = join_per_genome(rows, means, 64)
    else:
        rows = join_per_genome(rows, genome_gc)
    return rows.withColumn(
        "gc_deviation", F.col("gc_content") - F.coalesce("genome_gc", F.lit(0.0))
    ).drop("genome_gc")


# ---- codons and residues ---------------------------------------------------------------------------
CODON_FEATURES = ["gc_content", "gc_skew", "at_skew", "purine_content", "gc3_content", "effective_num_codons", "codon_bias_index", "hydrophobicity_mean", "hydrophobicity_std", "charge_mean",
                  "aromatic_fraction", "small_fraction", "polar_fraction", "aa_entropy"]
#: Bases whose codons are looked at together.
SLICE = 1 << 21
_USUAL = dict(zip(("".join(p) for p in product(C.CODON_LETTERS, repeat=3)), C.AMINO_ACIDS_T11))


def _letter_table(letters: str) -> np.ndarray:
    table = np.zeros(256)
    table[[ord(c) for c in letters]] = 1.0
    return table


_SHARES = [_letter_table(letters) for letters in ("DEKR", "FYW", "AGSTCV", "STNQY")]
_HYDROPATHY = np.zeros(256)
_HYDROPATHY[[ord(c) for c in C.HYDROPATHY]] = list(C.HYDROPATHY.values())
_CODE = np.full(256, 64, dtype=np.int64)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
_RESIDUE = np.array([ord(_USUAL["".join(p)]) for p in product("ACGT", repeat=3)] + [ord("X")], dtype=np.uint8)


def with_codon_features(rows: DataFrame) -> DataFrame:
    """Adds protein (up to its first stop) and ``CODON_FEATURES`` of ``sequence``; the same values as the column functions of ``functions/``.

    Arrays of codons and functions over them cost about a microsecond a codon and step; here NumPy takes the codons of many rows at once.
    """
    def run(batches):
        for batch in batches:
            sequences = batch.column("sequence").cast(pa.large_string())
            offsets = np.frombuffer(sequences.buffers()[1], dtype=np.int64)[sequences.offset:sequences.offset + len(sequences) + 1] if len(sequences) else np.zeros(1, np.int64)
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
                data = np.frombuffer(sequences.buffers()[2], dtype=np.uint8)[offsets[first]:offsets[end]]
                part = batch.slice(first, end - first)
                protein, values = _codon_features(data, offsets[first:end + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays([*part.columns, protein, *map(pa.array, values)], [*part.schema.names, "protein", *CODON_FEATURES])
                first = end

    more = [StructField("protein", StringType()), *[StructField(c, DoubleType()) for c in CODON_FEATURES]]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def _entropy(row: np.ndarray, symbol: np.ndarray, totals: np.ndarray, inside_log: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row the entropy of its symbols in bits, and how many are distinct."""
    kinds, n = np.unique((row << 24) + symbol, return_counts=True)
    of = kinds >> 24
    p = n / totals[of]
    return -np.bincount(of, weights=p * np.log2(p + inside_log), minlength=totals.size), np.bincount(of, minlength=totals.size)


def _codon_features(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    n, sizes = offsets.size - 1, np.diff(offsets) // 3
    row = np.repeat(np.arange(n), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(row.size) - begin[row]
    at = offsets[:-1][row] + 3 * place
    a, b, c = data[at], data[at + 1], data[at + 2]
    share = lambda top, bottom: np.where(bottom > 0, top / np.maximum(bottom, 1), 0.0)
    sums = lambda where, weights: np.bincount(where, weights=weights, minlength=n)
    upto = [np.concatenate(([0], np.cumsum(data == ord(base)))) for base in "ACGT"]
    na, nc, ng, nt = (u[offsets[1:]] - u[offsets[:-1]] for u in upto)
    bases = np.diff(offsets)
    valid = (a != ord("N")) & (b != ord("N")) & (c != ord("N"))
    known = np.bincount(row[valid], minlength=n)
    gc3 = share(sums(row, valid & ((c == ord("G")) | (c == ord("C")))), known)
    triple = (a.astype(np.int64) << 16) + (b.astype(np.int64) << 8) + c
    h, distinct = _entropy(row[valid], triple[valid], known, 1e-10)
    bias = np.where(known > 0, 1.0 - h / np.log2(61.0), 0.0)
    residue = _RESIDUE[np.minimum(_CODE[a] * 16 + _CODE[b] * 4 + _CODE[c], 64)]
    stop = np.flatnonzero(residue == ord("*"))
    ends = sizes.copy()
    np.minimum.at(ends, row[stop], place[stop])
    inside = place < ends[row]
    row, residue = row[inside], residue[inside]
    water = _HYDROPATHY[residue]
    mean = share(sums(row, water), ends)
    spread = np.where(ends > 1, np.sqrt(share(sums(row, (water - mean[row]) ** 2), ends)), 0.0)
    bits = np.where(ends < 10, 999.0, _entropy(row, residue.astype(np.int64), ends, 0.0)[0])
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate(([0], np.cumsum(ends))).astype(np.int64).tobytes()), pa.py_buffer(residue.tobytes()))
    whole = [share(ng + nc, bases), share(ng - nc, ng + nc), share(na - nt, na + nt), share(na + ng, bases)]
    return text.cast(pa.string()), [*whole, gc3, share(distinct, known), bias, mean, spread, *[share(sums(row, t[residue]), ends) for t in _SHARES], bits]


# ---- stop groups -----------------------------------------------------------------------------------
_REL = ("combined", "rbs", "codon", "start", "start_select")
GROUP_FEATURES = [
    "num_orfs", "combined_max", "combined_mean", "combined_std", "combined_entropy",
    "combined_margin_top2", "frac_top_orfs", "rbs_max", "rbs_mean", "codon_max", "codon_mean",
    "start_max", "start_mean", "imm_max", "imm_mean", "start_select_max", "start_select_mean",
    "strand_plus_frac", "strand_minus_frac", *[f"rel_{c}_max" for c in _REL],
    *[f"rel_{c}_mean" for c in _REL], "top_orf_is_longest", "length_ratio_max_min",
    "frac_top_combined", "frac_top_start_select",
]


def group_features(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per stop group. One window for the maxima, then one aggregation on the same keys."""
    from codonlake.operators.starts import add_selection_score

    score = {c: F.col(f"{c}_score") for c in ("combined", "rbs", "codon", "start", "imm")}
    score["start_select"] = F.col("selection_score")
    group = Window.partitionBy(*GROUP)
    rows = add_selection_score(rows, weights)
    tops = {f"_top_{c}": F.max(score[c]).over(group) for c in _REL}
    rows = rows.select(
        "*", *[v.alias(k) for k, v in tops.items()],
        F.sum(F.greatest(score["combined"], F.lit(0.0))).over(group).alias("_positive"),
        F.max("length").over(group).alias("_longest"),
    )
    n = F.count("*")
    share = S.ratio(F.greatest(score["combined"], F.lit(0.0)), F.col("_positive"))
    entropy = F.coalesce(-F.sum(F.when(share > 0, share * F.log(share) / F.log(F.lit(2.0)))), F.lit(0.0))
    ordered = F.sort_array(F.collect_list(score["combined"]), asc=False)
    first_top = F.min(F.when(score["combined"] == F.col("_top_combined"), F.col("start")))
    first_long = F.min(F.when(F.col("length") == F.col("_longest"), F.col("start")))
    rel = lambda c: F.when(F.col(f"_top_{c}") > 0, score[c] / F.col(f"_top_{c}")).otherwise(0.0)
    aggs = {
        "num_orfs": n,
        "combined_max": F.max(score["combined"]),
        "combined_mean": F.avg(score["combined"]),
        "combined_std": F.when(n > 1, F.stddev_pop(score["combined"])).otherwise(0.0),
        "combined_entropy": entropy,
        "combined_margin_top2": F.when(n > 1, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))
        .otherwise(F.get(ordered, F.lit(0))),
        "frac_top_orfs": F.count_if(score["combined"] >= 0.8 * F.col("_top_combined")) / n,
        "strand_plus_frac": F.avg((F.col("strand") == "forward").cast("double")),
        "strand_minus_frac": F.avg((F.col("strand") == "reverse").cast("double")),
        "top_orf_is_longest": (first_top == first_long).cast("int"),
        "length_ratio_max_min": F.max("length") / F.greatest(F.min("length"), F.lit(1)),
        "frac_top_combined": F.count_if(score["combined"] >= 0.95 * F.col("_top_combined")) / n,
        "frac_top_start_select": F.count_if(
            score["start_select"] >= 0.95 * F.col("_top_start_select")
        ) / n,
    }
    for c in ("rbs", "codon", "start", "imm", "start_select"):
        aggs[f"{c}_max"], aggs[f"{c}_mean"] = F.max(score[c]), F.avg(score[c])
    for c in _REL:
        aggs[f"rel_{c}_max"], aggs[f"rel_{c}_mean"] = F.max(rel(c)), F.avg(rel(c))
    return rows.groupBy(*GROUP).agg(
        *[F.coalesce(aggs[k], F.lit(0)).alias(k) for k in GROUP_FEATURES]
    )


# ---- per-genome context of the start classifier ----------------------------------------------------
def singletons(rows: DataFrame) -> DataFrame:
    """Members of stop groups with one start."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*GROUP))).where("_n = 1").drop("_n")


def context_window(up: Column, codon: Column) -> Column:
    """11 bases before the start codon and its first two; null near a contig end."""
    return F.when(F.length(up) >= 11, F.concat(F.right(up, F.lit(11)), F.left(codon, F.lit(2))))


def weight_matrix(windows: DataFrame, size: int, min_windows: int = C.PWM_MIN_WINDOWS) -> DataFrame:
    """genome_id, pos, base, n, logodds of aligned windows: +1 per cell, ln(freq / 0.25).

    Genomes with fewer than ``min_windows`` windows have no matrix.
    """
    full = windows.where(F.length("window") >= size).select(
        "genome_id", F.right("window", F.lit(size)).alias("window")
    )
    letters = full.select("genome_id", F.posexplode(F.split("window", "")).alias("pos", "base"))
    counts = letters.where(F.col("base").isin("A", "C", "G", "T")).groupBy("genome_id", "pos", "base").agg(
        F.count("*").alias("n")
    )
    enough = full.groupBy("genome_id").agg(F.count("*").alias("n_windows")).where(
        F.col("n_windows") >= min_windows
    )
    cells = enough.select(
        "genome_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos")
    ).select("*", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
    n = F.coalesce("n", F.lit(0)) + 1
    total = F.sum("n").over(Window.partitionBy("genome_id", "pos"))
    return (
        cells.join(counts, ["genome_id", "pos", "base"], "left")
        .withColumn("n", n)
        .withColumn("logodds", F.log(F.col("n") / total / 0.25))
    )


def matrix_array(matrix: DataFrame, out: str) -> DataFrame:
    """The matrix of a genome as one array, row by row in A, C, G, T order."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "base", "logodds")))
    return matrix.groupBy("genome_id").agg(F.transform(cells, lambda c: c["logodds"]).alias(out))


def length_prior(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of the lengths of single-start groups; (800, 400) under ten."""
    mean, std = C.LENGTH_PRIOR_DEFAULT
    n = F.count("length")
    return rows.select("genome_id").distinct().join(
        singletons(rows).groupBy("genome_id").agg(
            n.alias("n_single"),
            F.when(n >= 10, F.avg("length")).alias("m"), F.when(n >= 10, F.stddev_pop("length")).alias("s"),
        ), "genome_id", "left",
    ).select("genome_id", F.coalesce("n_single", F.lit(0)).alias("n_single"),
             F.coalesce("m", F.lit(mean)).alias("len_mean"), F.coalesce("s", F.lit(std)).alias("len_std"))


def genome_gc(contigs: DataFrame) -> DataFrame:
    strong = F.sum(F.length("seq") - F.length(F.translate("seq", "GC", "")))
    return contigs.groupBy("genome_id").agg((strong / F.greatest(F.sum("length"), F.lit(1))).alias("gc_pct"))


def start_context(rows: DataFrame, contigs: DataFrame, parity: bool = False) -> DataFrame:
    """Per genome: site matrix, start-context matrix, length prior, GC.

    ``parity=True`` leaves forward starts out of the context matrix, as the older behaviour did.
    """
    single = with_upstream(singletons(rows), contigs, C.PWM_WINDOW, "up")
    site = weight_matrix(single.select("genome_id", F.col("up").alias("window")), C.PWM_WINDOW)
    ctx_rows = single.where("strand = 'reverse'") if parity else single
    ctx = weight_matrix(
        ctx_rows.select("genome_id", context_window(F.col("up"), F.col("start_codon")).alias("window")), 13
    )
    return (
        length_prior(rows)
        .join(matrix_array(site, "site_matrix"), "genome_id", "left")
        .join(matrix_array(ctx, "ctx_matrix"), "genome_id", "left")
        .join(genome_gc(contigs), "genome_id", "left")
    )


# ---- contested pairs -------------------------------------------------------------------------------
PAIR_FEATURES = [
    "d_baseline", "d_rbs", "d_start", "d_codon", "d_imm", "d_length", "d_f4", "d_f5", "d_up_imm",
    "d_genome_rbs", "d_anti_sd", "anti_sd_top1", "anti_sd_top2", "ext_codon", "d_any_stop_dist",
    "any_stop_top1", "any_stop_top2", "d_len_zscore", "len_zscore_top1", "len_zscore_top2",
    "d_post_start", "post_start_top1", "post_start_top2", "d_ctx_pwm", "ctx_pwm_top1", "ctx_pwm_top2",
    "gap", "score_range", "rel_gap", "n_near_ties", "n_orfs", "top1_len_rank", "group_len_cv",
    "frac_longer", "grp_rbs_mean", "grp_rbs_range", "frac_atg", "top1_rbs_rank", "gc_pct", "both_atg",
]
NTERM = ["nterm_charged_pos", "nterm_charged_neg", "nterm_polar", "nterm_hydrophobic"]
OPTIONAL_PAIR_FEATURES = {
    "nterm": [f"d_{k}" for k in NTERM] + [f"t1_{k}" for k in NTERM],
    "gc3": ["d_gc3_period", "gc3_period_t1", "gc3_period_t2"],
    "groupnorm": ["d_length_norm", "d_codon_norm", "d_imm_norm"],
}


def pair_columns(groups: tuple[str, ...] = ()) -> list[str]:
    """Feature columns with the optional groups switched on by name."""
    unknown = set(groups) - set(OPTIONAL_PAIR_FEATURES)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    return PAIR_FEATURES + [c for g in OPTIONAL_PAIR_FEATURES if g in groups
                            for c in OPTIONAL_PAIR_FEATURES[g]]


def upstream_features(rows: DataFrame, contigs: DataFrame, models: DataFrame, ctx: DataFrame,
                      parity: bool = False) -> DataFrame:
    """Features of a single start: upstream motifs, pairing, matrices, Markov score, first codons."""
    rows = with_upstream(rows, contigs, 300, "_up300").withColumn("_up", F.right("_up300", F.lit(C.PAIR_WINDOW)))
    forward = F.col("strand") == "forward"
    lo = F.when(forward, F.col("genome_start")).otherwise(F.col("genome_end") - 17)
    rows = slice_forward(rows, contigs, lo, lo + 17, "_h")
    rows = rows.withColumn("_head", F.when(forward, F.col("_h")).otherwise(S.reverse_complement(F.col("_h"))))
    size = F.lit(1024) + F.coalesce(F.size("markov_table"), F.lit(0)) * 8
    rows = join_per_genome(rows, model_arrays(models), size)
    rows = join_per_genome(rows, ctx, 2048)
    up = F.col("_up")
    word = lambda i: F.substring(up, F.greatest(i - F.col("markov_order"), F.lit(1)),
                                 F.least(i, F.col("markov_order") + 1))
    step = lambda acc, i: acc + markov_lookup(
        F.col("markov_table"), F.col("markov_order"), (i - 1) % 3, word(i))
    up_imm = F.aggregate(F.sequence(F.lit(1), F.length(up)), F.lit(0.0), step) / F.length(up)
    window = context_window(up, F.col("start_codon"))
    ctx_score = F.when(window.isNull(), 0.0).otherwise(U.pwm_score(window, F.col("ctx_matrix"), 13))
    if parity:
        ctx_score = F.when(forward, 0.0).otherwise(ctx_score)
    z = (F.col("length") - F.col("len_mean")) / F.greatest("len_std", F.lit(1.0))
    return rows.select(
        "*",
        U.spacer_score(up).alias("f4"),
        U.gc_position_bias(up).alias("f5"),
        F.when((F.length(up) < 9) | F.col("markov_table").isNull(), 0.0).otherwise(up_imm).alias("up_imm"),
        U.pwm_score(up, F.col("site_matrix"), C.PWM_WINDOW).alias("site_pwm"),
        U.anti_sd_pairing(up).alias("anti_sd"),
        U.stop_distance(F.col("_up300")).alias("any_stop"),
        z.alias("len_zscore"),
        F.coalesce(U.codon_mean(F.substring("_head", 4, 15), F.col("codon_table")), F.lit(0.0))
        .alias("post_start"),
        ctx_score.alias("ctx_pwm"),
        U.gc_periodicity(up).alias("gc3_period"),
        *[c.alias(k) for k, c in P.n_terminal_shares(F.col("_head")).items()],
    )


def pair_features(rows: DataFrame, contigs: DataFrame, models: DataFrame, ctx: DataFrame,
                  weights: dict[str, float] | None = None, contest_gap: float | None = C.CONTEST_GAP,
                  parity: bool = False) -> DataFrame:
    """One row per stop group with two or more starts whose best two differ by less than the gap.

    Group context comes from one window and one aggregation on the stop key; the sequence features are
    made for the two contestants only.
    """
    ranked = rank_starts(rows, weights)
    group = Window.partitionBy(*GROUP)
    first = lambda c: F.max(F.when(F.col("start_rank") == 1, F.col(c))).over(group)
    ranked = ranked.select("*", first("selection_score").alias("_s1"), first("length").alias("_l1"),
                           first("rbs_score_norm").alias("_r1"))
    n = F.count("*")
    span = lambda c: F.max(c) - F.min(c)
    s = "selection_score"
    second = F.max(F.when(F.col("start_rank") == 2, F.col(s)))
    spare = F.greatest(n - 1, F.lit(1))
    info = ranked.groupBy(*GROUP).agg(
        (F.max("_s1") - second).alias("gap"),
        span(s).alias("score_range"),
        (F.count_if(F.col(s) >= F.col("_s1") - 0.5) - 1).alias("n_near_ties"),
        n.alias("n_orfs"),
        (F.count_if(F.col("length") < F.col("_l1")) / spare).alias("top1_len_rank"),
        (F.stddev_pop("length") / F.greatest(F.avg("length"), F.lit(1.0))).alias("group_len_cv"),
        (F.count_if(F.col("length") > F.col("_l1")) / n).alias("frac_longer"),
        F.avg("rbs_score_norm").alias("grp_rbs_mean"),
        span("rbs_score_norm").alias("grp_rbs_range"),
        F.avg((F.col("start_codon") == "ATG").cast("double")).alias("frac_atg"),
        (F.count_if(F.col("rbs_score_norm") < F.col("_r1")) / spare).alias("top1_rbs_rank"),
        span("length").alias("_span_length"),
        span("codon_score_norm").alias("_span_codon"),
        span("imm_score_norm").alias("_span_imm"),
    ).where("n_orfs >= 2")
    if contest_gap is not None:
        info = info.where(F.col("gap") < contest_gap)
    two = ranked.where("start_rank <= 2").join(info.select(*GROUP), GROUP, "left_semi")
    two = upstream_features(two, contigs, models, ctx, parity)
    names = ["start", "start_codon", "length", "rbs_score_norm", "start_score_norm", "codon_score_norm",
             "imm_score_norm", "f4", "f5", "up_imm", "site_pwm", "anti_sd", "any_stop", "len_zscore",
             "post_start", "ctx_pwm", "gc3_period", *NTERM]
    pick = lambda r, c: F.max(F.when(F.col("start_rank") == r, F.col(c))).alias(f"{c}_{r}")
    wide = two.groupBy(*GROUP).agg(*[pick(r, c) for c in names for r in (1, 2)],
                                   F.max("contig_length").alias("_clen"), F.max("gc_pct").alias("gc_pct"))
    # the bases between the two starts
    lo, hi = F.least("start_1", "start_2"), F.greatest("start_1", "start_2") - 1
    forward = F.col("strand") == "forward"
    wide = slice_forward(wide, contigs, F.when(forward, lo).otherwise(F.col("_clen") - hi + 1),
                         F.when(forward, hi).otherwise(F.col("_clen") - lo + 1), "_ext")
    wide = join_per_genome(wide, model_arrays(models.where(F.col("pos") == CODON)).select("genome_id", "codon_table"), 600)
    ext_seq = F.when(forward, F.col("_ext")).otherwise(S.reverse_complement(F.col("_ext")))
    ext = F.coalesce(U.codon_mean(ext_seq, F.col("codon_table")), F.lit(0.0))
    if parity:
        ext = F.when(forward, ext).otherwise(F.lit(0.0))
    d = lambda c: F.col(f"{c}_1") - F.col(f"{c}_2")
    eps = 1e-9
    out = {
        "d_baseline": F.col("gap"), "d_rbs": d("rbs_score_norm"), "d_start": d("start_score_norm"),
        "d_codon": d("codon_score_norm"), "d_imm": d("imm_score_norm"),
        "d_length": d("length").cast("double"), "d_f4": d("f4"), "d_f5": d("f5"), "d_up_imm": d("up_imm"),
        "d_genome_rbs": d("site_pwm"), "d_anti_sd": d("anti_sd"), "anti_sd_top1": F.col("anti_sd_1"),
        "anti_sd_top2": F.col("anti_sd_2"), "ext_codon": ext, "d_any_stop_dist": d("any_stop"),
        "any_stop_top1": F.col("any_stop_1"), "any_stop_top2": F.col("any_stop_2"),
        "d_len_zscore": d("len_zscore"), "len_zscore_top1": F.col("len_zscore_1"),
        "len_zscore_top2": F.col("len_zscore_2"), "d_post_start": d("post_start"),
        "post_start_top1": F.col("post_start_1"), "post_start_top2": F.col("post_start_2"),
        "d_ctx_pwm": d("ctx_pwm"), "ctx_pwm_top1": F.col("ctx_pwm_1"), "ctx_pwm_top2": F.col("ctx_pwm_2"),
        "rel_gap": F.col("gap") / F.greatest("score_range", F.lit(eps)),
        "both_atg": ((F.col("start_codon_1") == "ATG") & (F.col("start_codon_2") == "ATG")).cast("int"),
        **{f"d_{k}": d(k) for k in NTERM}, **{f"t1_{k}": F.col(f"{k}_1") for k in NTERM},
        "d_gc3_period": d("gc3_period"), "gc3_period_t1": F.col("gc3_period_1"),
        "gc3_period_t2": F.col("gc3_period_2"),
        "d_length_norm": d("length") / F.greatest(F.col("_span_length").cast("double"), F.lit(1.0)),
        "d_codon_norm": d("codon_score_norm") / F.greatest("_span_codon", F.lit(eps)),
        "d_imm_norm": d("imm_score_norm") / F.greatest("_span_imm", F.lit(eps)),
    }
    every = pair_columns(tuple(OPTIONAL_PAIR_FEATURES))
    return wide.join(info, GROUP).select(
        *GROUP, "start_1", "start_2", *[(out[c] if c in out else F.col(c)).alias(c) for c in every]
    )
