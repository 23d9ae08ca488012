"""Open reading frames on both strands, over chunks of contigs.

A contig is cut into chunks with a few bases of halo on both sides, and chunks are dealt to tasks by (genome_id, contig_id,
chunk), so one contig spans many tasks. A task pairs the starts and stops of its chunks in NumPy, some at a time, so it neither
sorts nor holds codons, and only ORFs leave it. A start without a stop in the rest of its chunk takes the carry: the first stop of its frame in the chunks that follow in the direction
of the strand. The first stop of a frame of a chunk is found by a pattern that ends there, before the bases are moved, and
the carries are running minima over one row per chunk; contigs of one chunk have none.

Bases are cut from a binary copy of the sequence: ``substring`` on a string walks from its start,
on binary it is an array copy of three bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import reverse_complement

CONTIG = ["genome_id", "contig_id"]
GROUP = [*CONTIG, "strand", "end"]
ORF = [*GROUP, "start"]
#: Codon starts of a chunk, and the bases around them that windows and codons need.
CHUNK = 16384
HALO_LEFT, HALO_RIGHT = C.RBS_WINDOW - 1, C.RBS_WINDOW + 1
#: Bases that are scanned at a time.
SCANNED = 1 << 20
_LETTERS = np.full(256, 4, dtype=np.int16)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)
_OPPOSITE = np.arange(256, dtype=np.uint8)
_OPPOSITE[[ord(c) for c in "ACGTRYKMBVDH"]] = [ord(c) for c in "TGCAYRMKVBHD"]
#: Per codon, as base-5 number: 0 for most, 1 to 3 for the start codons, 4 for a stop.
_CODONS = np.zeros(125, dtype=np.int8)
for _no, _codon in enumerate((*C.START_CODONS, *C.STOP_CODONS)):
    _CODONS[int("".join(str("ACGT".index(_c)) for _c in _codon), 5)] = min(_no, len(C.START_CODONS)) + 1


def by_contig(contigs: DataFrame) -> DataFrame:
    """The exchange that sequence lookups share."""
    return contigs.select(*CONTIG, "seq", "length").repartition(*CONTIG)


def chunks(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pieces of each contig: the bases of codons that start in the chunk, with halo; ``at`` is the first base of the piece."""
    n = F.col("length")
    numbers = F.when(n >= 3, F.sequence(F.lit(0).cast("long"), F.floor((n - 3) / size)))
    rows = contigs.select(*CONTIG, "length", F.col("seq").cast("binary").alias("_b")).select("*", F.explode(numbers).alias("chunk"))
    at = F.greatest(F.col("chunk") * size - HALO_LEFT, F.lit(0).cast("long"))
    end = F.least((F.col("chunk") + 1) * size + HALO_RIGHT, n)
    piece = F.substring(F.col("_b"), at.cast("int") + 1, (end - at).cast("int"))
    return rows.select(*CONTIG, "length", "chunk", at.alias("at"), piece.cast("string").alias("piece"))


def strand_pieces(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Both strands of each piece as binary: codons start at ``lo`` to ``hi`` of it, and base 0 of it is base ``base`` of the strand."""
    m = F.length("piece")
    first = (F.col("chunk") * size - F.col("at")).cast("int")
    last = (F.least((F.col("chunk") + 1) * size, F.col("length") - 2) - 1 - F.col("at")).cast("int")
    both = F.array(
        F.struct(F.lit("forward").alias("strand"), F.col("piece").cast("binary").alias("bases"), F.col("at").alias("base"),
                 first.alias("lo"), last.alias("hi")),
        F.struct(F.lit("reverse").alias("strand"), reverse_complement(F.col("piece")).cast("binary").alias("bases"),
                 (F.col("length") - F.col("at") - m).alias("base"), (m - 3 - last).alias("lo"), (m - 3 - first).alias("hi")),
    )
    return pieces.select(*[c for c in pieces.columns if c not in ("piece", "at")], F.inline(both))


def carries(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per chunk the stops that open frames run into: ``carry`` has one position per strand and frame, null where none follows.

    A stop found beyond the chunk, in the halo, is a stop that follows all the same.
    """
    rows = strand_pieces(pieces, size)
    firsts = []
    for frame in range(3):
        skip = F.pmod(F.lit(frame) - F.col("base") - F.col("lo"), F.lit(3)).cast("int")
        rest = F.substring(F.col("bases"), F.col("lo") + skip + 1, F.octet_length("bases")).cast("string")
        upto = F.length(F.regexp_extract(rest, "^(?:...)*?(?:" + "|".join(C.STOP_CODONS) + ")", 0))
        firsts.append(F.when(upto > 0, F.col("base") + F.col("lo") + skip + upto - 3).alias(f"f{frame}"))
    found = rows.select(*CONTIG, "chunk", "strand", *firsts)
    order = F.when(F.col("strand") == "forward", -F.col("chunk")).otherwise(F.col("chunk"))
    later = Window.partitionBy(*CONTIG, "strand").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(*CONTIG, "chunk", "strand", F.array(*[F.min(f"f{k}").over(later) for k in range(3)]).alias("next"))
    side = lambda name: F.max(F.when(F.col("strand") == name, F.col("next")))
    return found.groupBy(*CONTIG, "chunk").agg(F.concat(side("forward"), side("reverse")).alias("carry"))


def carried_pieces(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks dealt to tasks, each with its carries."""
    pieces = chunks(contigs, size).repartition(*CONTIG, "chunk")
    follows = carries(chunks(contigs.where(F.col("length") - 3 >= size), size), size)
    return pieces.join(follows, [*CONTIG, "chunk"], "left")


def codon_marks(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every start and stop codon: 0-based strand position, codon, frame, the 20 bases for its site, and the carry of its frame.

    The window of 20 ends with the first base of the codon; near the contig start it is shorter.
    """
    rows = strand_pieces(carried_pieces(contigs, size), size)
    places = rows.select("*", F.explode(F.sequence("lo", "hi")).alias("i"))
    codon = F.substring(F.col("bases"), F.col("i") + 1, F.lit(3)).cast("string")
    head = F.greatest(F.col("i") - (C.RBS_WINDOW - 1), F.lit(0))
    pos = F.col("base") + F.col("i")
    frame = (pos % 3).cast("int")
    return (
        places.select("*", codon.alias("codon"))
        .where(F.col("codon").isin(*C.START_CODONS, *C.STOP_CODONS))
        .select(
            *CONTIG,
            "chunk",
            "strand",
            F.col("length").alias("contig_length"),
            pos.alias("pos"),
            frame.alias("frame"),
            "codon",
            F.get("carry", frame + F.when(F.col("strand") == "forward", 0).otherwise(3)).alias("carry"),
            F.when(
                F.col("codon").isin(*C.START_CODONS),
                F.substring(F.col("bases"), head + 1, F.col("i") + 1 - head),
            )
            .cast("string")
            .alias("upstream"),
        )
    )


def genome_coordinates(strand: Column, start: Column, end: Column, length: Column) -> list[Column]:
    """Strand coordinates to forward coordinates of the contig."""
    forward = strand == "forward"
    return [
        F.when(forward, start).otherwise(length - end + 1).alias("genome_start"),
        F.when(forward, end).otherwise(length - start + 1).alias("genome_end"),
    ]


def scan_orfs(contigs: DataFrame, min_length: int = C.MIN_ORF_LENGTH, size: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """All start codons paired with the next stop codon of their frame, nested ones included.

    ``keep``: further columns, of which there is ``chunk``.
    """
    schema = ("genome_id string, contig_id string, strand string, end long, start long, frame int, start_codon string, upstream string, "
              "contig_length long, chunk long")
    rows = carried_pieces(contigs, size).select(
        *CONTIG, "length", "chunk", "at", F.col("piece").cast("binary").alias("bases"),
        *[F.coalesce(F.get("carry", F.lit(k)), F.lit(-1)).cast("long").alias(f"carry{k}") for k in range(6)])
    found = rows.mapInArrow(_orfs_within(size, min_length), schema)
    return found.select(
        *CONTIG, "strand", "end", "start", *genome_coordinates(F.col("strand"), F.col("start"), F.col("end"), F.col("contig_length")),
        (F.col("end") - F.col("start") + 1).alias("length"), "frame", "start_codon", "upstream", "contig_length", *keep)


def _orfs_within(size: int, min_length: int):
    def scan(batches):
        for batch in batches:
            upto = np.cumsum(np.array([len(b) for b in batch.column("bases").to_pylist()], dtype=np.int64))
            lo = 0
            while lo < batch.num_rows:
                end = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SCANNED, side="right")))
                some = batch.slice(lo, end - lo)
                for strand in ("forward", "reverse"):
                    yield _orfs_of(some, strand, size, min_length)
                lo = end

    return scan


def _orfs_of(batch: pa.RecordBatch, strand: str, size: int, min_length: int) -> pa.RecordBatch:
    """ORFs of one strand of some chunks. Codons start at ``lo`` to ``hi`` of a piece, and its base 0 is base ``base`` of the strand."""
    forward = strand == "forward"
    pieces = batch.column("bases").to_pylist()
    length, chunk, at = (batch.column(c).to_numpy() for c in ("length", "chunk", "at"))
    carry = np.stack([batch.column(f"carry{k + (0 if forward else 3)}").to_numpy() for k in range(3)], axis=1)
    m = np.array([len(b) for b in pieces], dtype=np.int64)
    lo, hi = chunk * size - at, np.minimum((chunk + 1) * size, length - 2) - 1 - at
    bases, starts, base = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(m) - m, at
    row = np.repeat(np.arange(m.size), m)
    if not forward:
        bases, row, starts, base = _OPPOSITE[bases[::-1]], row[::-1], bases.size - starts - m, length - at - m
        lo, hi = m - 3 - hi, m - 3 - lo
    letters = _LETTERS[bases]
    code = np.full(bases.size, 124, dtype=np.int16)
    code[:-2] = np.where((letters[:-2] < 4) & (letters[1:-1] < 4) & (letters[2:] < 4), letters[:-2] * 25 + letters[1:-1] * 5 + letters[2:], 124)
    kind = _CODONS[code]
    mark = np.flatnonzero(kind)
    row, kind = row[mark], kind[mark]
    i = mark - starts[row]
    inside = (i >= lo[row]) & (i <= hi[row])
    mark, row, kind, i = mark[inside], row[inside], kind[inside], i[inside]
    pos = base[row] + i
    group = row * 3 + pos % 3
    order = np.argsort(group, kind="stable")  # along each frame of each piece
    mark, row, kind, i, pos, group = (x[order] for x in (mark, row, kind, i, pos, group))
    none = group.size
    ahead = np.minimum.accumulate(np.where(kind == 4, np.arange(none), none)[::-1])[::-1]  # the stop that comes next
    here = (ahead < none) & (np.append(group, -1)[ahead] == group)
    stop = np.where(here, np.append(pos, -1)[ahead], carry[row, pos % 3])
    use = (kind < 4) & (stop >= 0) & (stop + 3 - pos >= min_length)
    mark, row, kind, i, pos, stop = (x[use] for x in (mark, row, kind, i, pos, stop))
    width = np.minimum(i + 1, C.RBS_WINDOW)
    ends = np.cumsum(width)
    window = bases[np.arange(ends[-1] if ends.size else 0) + np.repeat(mark + 1 - ends, width)]
    upstream = pa.StringArray.from_buffers(width.size, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(window))
    taken = pa.array(row)
    return pa.RecordBatch.from_pydict({
        **{c: batch.column(c).take(taken) for c in CONTIG}, "strand": pa.array([strand]).take(pa.array(np.zeros(row.size, dtype=np.int64))), "end": stop + 3, "start": pos + 1,
        "frame": (pos % 3).astype(np.int32), "start_codon": pa.array(C.START_CODONS).take(pa.array(kind.astype(np.int64) - 1)), "upstream": upstream,
        "contig_length": length[row], "chunk": chunk[row]})


def slice_forward(features: DataFrame, contigs: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """Add forward-strand bases [lo, hi] (1-based, clipped at the contig ends) of each feature row.

    A merge join with the contig on the left: its bases are read once per contig and every feature of
    that contig only copies its own slice. Both sides are partitioned by contig already.
    """
    packed = by_contig(contigs).select(*CONTIG, F.col("seq").cast("binary").alias("_bases"),
                                       F.col("length").alias("_len"))
    joined = packed.hint("merge").join(features, CONTIG)
    first, last = F.greatest(lo, F.lit(1)), F.least(hi, F.col("_len"))
    piece = F.substring(
        F.col("_bases"), first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")
    ).cast("string")
    return joined.select(*features.columns, piece.alias(out))


def with_sequence(features: DataFrame, contigs: DataFrame, out: str = "sequence") -> DataFrame:
    """Strand sequence between genome_start and genome_end."""
    raw = slice_forward(features, contigs, F.col("genome_start"), F.col("genome_end"), out)
    return raw.withColumn(
        out,
        F.when(F.col("strand") == "reverse", reverse_complement(F.col(out))).otherwise(F.col(out)),
    )


def with_upstream(features: DataFrame, contigs: DataFrame, size: int, out: str) -> DataFrame:
    """``size`` bases before the start codon, in strand direction, shorter at the contig ends."""
    forward = F.col("strand") == "forward"
    lo = F.when(forward, F.col("genome_start") - size).otherwise(F.col("genome_end") + 1)
    hi = F.when(forward, F.col("genome_start") - 1).otherwise(F.col("genome_end") + size)
    raw = slice_forward(features, contigs, lo, hi, out)
    return raw.withColumn(
        out, F.when(forward, F.col(out)).otherwise(reverse_complement(F.col(out)))
    )
