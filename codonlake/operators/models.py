"""Self-trained models per genome: codon log-ratios and a position-aware Markov chain with back-off.

Counting is one pass over the bases in NumPy: every base contributes its longest context only, shorter contexts are sums of
longer ones. A context and the suffixes it backs off to end with the same letters, so the trie of contexts is built in shards of
(genome, codon position, last letters of the context): a shard has all that its contexts ask for, and neither a genome nor an
order is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import codons
from codonlake.operators.distribute import join_per_genome, running_total
from codonlake.session import stored

CODING, NONCODING = "coding", "noncoding"
TILE = 16384
#: Bases whose words are counted at a time, and those of a genome that are counted in one task at least.
COUNTED, UNIT = 1 << 18, 1 << 22
#: Words of one kind that are kept until they are added up.
TOGETHER = 1 << 23
#: From this bound on, the contexts of a genome are dealt by their last ``TAIL`` letters as well.
SHARDED_FROM, TAIL = 9, 2
#: Mark of a word that stands for all that end with it.
TOP = 1 << 37
PARTS = "genome_id string, pos int, shard int, bound int, words binary, counts binary, weights binary"
_LETTERS = np.full(256, 4, dtype=np.int64)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)


def labelled_sequences(training: DataFrame, intergenic: DataFrame) -> DataFrame:
    """Both classes in one table with the row order that decides which sequences are held out."""
    side = F.when(F.col("strand") == "forward", 0).otherwise(1)
    coding = training.select(
        "genome_id", F.lit(CODING).alias("cls"), "contig_id", side.alias("o1"),
        F.col("frame").cast("long").alias("o2"), F.col("end").alias("o3"), F.col("start").alias("o4"),
        "sequence",
    )
    other = intergenic.select(
        "genome_id", F.lit(NONCODING).alias("cls"), "contig_id", F.lit(0).alias("o1"),
        F.lit(0).cast("long").alias("o2"), F.col("start").alias("o3"), F.col("end").alias("o4"),
        "sequence",
    )
    return coding.unionByName(other)


def class_sizes(seqs: DataFrame) -> DataFrame:
    """Sequences and bases per genome, side by side for both classes."""
    is_coding = F.col("cls") == CODING
    return seqs.groupBy("genome_id").agg(
        F.count_if(is_coding).alias("n_coding"),
        F.count_if(~is_coding).alias("n_noncoding"),
        F.coalesce(F.sum(F.when(is_coding, F.length("sequence"))), F.lit(0)).alias("bp_coding"),
        F.coalesce(F.sum(F.when(~is_coding, F.length("sequence"))), F.lit(0)).alias("bp_noncoding"),
    )


def order_bound(sizes: DataFrame, min_obs: int = C.MIN_OBSERVATIONS,
                max_order: int = C.MAX_MARKOV_ORDER) -> DataFrame:
    """Highest order whose contexts can have enough observations: floor(log4(bp / min_obs)) in 2..max."""
    bp = F.least("bp_coding", "bp_noncoding")
    log4 = F.floor(F.log(bp / F.lit(float(min_obs))) / F.lit(math.log(4.0))).cast("int")
    bound = F.when(bp < min_obs, 0).otherwise(F.greatest(F.lit(2), F.least(log4, F.lit(max_order))))
    return sizes.withColumn("bound", bound)


# ---- codons ----------------------------------------------------------------------------------------
def codon_counts(seqs: DataFrame) -> DataFrame:
    """In-frame codons per genome and class; codons with N are left out, other letters count."""
    ascii_only = F.octet_length("sequence") == F.length("sequence")
    rows = seqs.where(ascii_only).select("genome_id", "cls", F.col("sequence").cast("binary").alias("_b"), F.octet_length("sequence").alias("_n")).where("_n > 2")
    tiles = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(3 * TILE))).alias("_t"))
    counted = tiles.select("genome_id", "cls", F.substring("_b", F.col("_t") + 1, F.lit(3 * TILE)).alias("bases")).mapInArrow(
        _codons_of, "genome_id string, cls string, codon string, n long")
    other = seqs.where(~ascii_only).select("genome_id", "cls", F.explode(codons(F.col("sequence"))).alias("codon"))
    other = other.where(~F.col("codon").contains("N")).withColumn("n", F.lit(1).cast("long"))
    return counted.unionByName(other).groupBy("genome_id", "cls", "codon").agg(F.sum("n").alias("n"))


def _codons_of(batches):
    """Codons without N of all tiles of a task by genome and class: those of ACGT by number, those with other letters by name."""
    known, plain, named = {}, {}, {}
    for batch in batches:
        bases = batch.column("bases").cast(pa.large_binary())
        offsets = np.frombuffer(bases.buffers()[1], dtype=np.int64)[bases.offset:bases.offset + len(bases) + 1]
        data = np.frombuffer(bases.buffers()[2] or b"", dtype=np.uint8)
        each = np.diff(offsets) // 3
        first = np.repeat(offsets[:-1] - 3 * (np.cumsum(each) - each), each) + 3 * np.arange(each.sum())
        of = [known.setdefault(x, len(known)) for x in zip(batch.column("genome_id").to_pylist(), batch.column("cls").to_pylist())]
        row = np.repeat(np.array(of, dtype=np.int64), each)
        letters = [_LETTERS[data[first + j]] for j in range(3)]
        acgt = np.maximum(np.maximum(letters[0], letters[1]), letters[2]) < 4
        n = np.bincount((row * 64 + letters[0] * 16 + letters[1] * 4 + letters[2])[acgt], minlength=len(known) * 64).reshape(-1, 64)
        for g in set(of):
            plain[g] = plain.get(g, 0) + n[g]
        rare = first[~acgt]
        words = np.stack([data[rare + j] for j in range(3)], axis=1).astype(np.int64) if rare.size else np.empty((0, 3), dtype=np.int64)
        use = ~(words == ord("N")).any(axis=1)
        keys, n = np.unique(row[~acgt][use] << 24 | words[use, 0] << 16 | words[use, 1] << 8 | words[use, 2], return_counts=True)
        for key, count in zip(keys.tolist(), n.tolist()):
            named[key] = named.get(key, 0) + count
    names = list(known)
    rows = [(*names[g], "".join("ACGT"[c >> j & 3] for j in (4, 2, 0)), int(n[c])) for g, n in plain.items() for c in np.flatnonzero(n)]
    rows += [(*names[key >> 24], (key & 0xFFFFFF).to_bytes(3, "big").decode("ascii"), n) for key, n in named.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))],
                                         ["genome_id", "cls", "codon", "n"])


def codon_model(seqs: DataFrame) -> DataFrame:
    """Codon frequencies. At most a few hundred rows per genome reach the window."""
    total = F.sum("n").over(Window.partitionBy("genome_id", "cls"))
    return codon_counts(seqs).withColumn("freq", F.col("n") / total)


def codon_log_ratio(model: DataFrame) -> DataFrame:
    """ln(coding / background) of every codon seen in either class; a side not seen counts 1e-4."""
    unseen = F.lit(C.UNSEEN_CODON_FREQ)
    side = lambda cls: F.max(F.when(F.col("cls") == cls, F.col("freq")))
    return (
        model.groupBy("genome_id", "codon")
        .agg(side(CODING).alias("coding"), side(NONCODING).alias("background"))
        .withColumn(
            "log_ratio",
            F.log(F.coalesce("coding", unseen)) - F.log(F.coalesce("background", unseen)),
        )
    )


def word_code(word: Column) -> Column:
    """Base-4 number of an ACGT word."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("int")


def codon_rows(log_ratio: DataFrame) -> DataFrame:
    """The log-ratios of ACGT codons in the form of model rows: the first two letters as context, the last as index."""
    plain = log_ratio.where(F.col("codon").rlike("^[ACGT]{3}$")).withColumn("_code", word_code(F.col("codon")))
    at = [F.coalesce(F.max(F.when(F.col("_code") % 4 == b, F.col("log_ratio"))), F.lit(0.0)) for b in range(4)]
    return plain.groupBy("genome_id", F.shiftright("_code", 2).alias("context")).agg(F.array(*at).alias("ratio"))


# ---- Markov counts ---------------------------------------------------------------------------------
def mark_held_out(seqs: DataFrame, share: float = C.VALIDATION_SHARE) -> DataFrame:
    """held_out: among the first 20 % of its genome and class (at least one sequence).

    The places are ranked without their sequences; a sequence is then compared with the last place that is held out. Where
    several sequences have that place, they are numbered one by one.
    """
    place = ["contig_id", "o1", "o2", "o3", "o4"]
    each = ["genome_id", "cls"]
    n = stored(seqs.groupBy(*each).agg(F.count("*").alias("_n")))
    same = seqs.groupBy(*each, *place).agg(F.count("*").alias("_same"))
    upto = join_per_genome(running_total(same, each, place, "_same", "_upto"), _by_class(n), 64, "inner")
    mine = F.when(F.col("cls") == CODING, F.col("_coding")).otherwise(F.col("_noncoding"))
    upto = upto.withColumn("_limit", F.greatest(F.lit(1), F.floor(mine * F.lit(share))))
    last = stored(upto.where((F.col("_upto") >= F.col("_limit")) & (F.col("_upto") - F.col("_same") < F.col("_limit"))).select(
        *each, F.struct(*place).alias("_last"), (F.col("_upto") > F.col("_limit")).alias("_split")))
    if last.where("_split").isEmpty():
        bounds = last.groupBy("genome_id").agg(*[F.max(F.when(F.col("cls") == cls, F.col("_last"))).alias(f"_{cls}") for cls in (CODING, NONCODING)])
        bound = F.when(F.col("cls") == CODING, F.col("_coding")).otherwise(F.col("_noncoding"))
        return join_per_genome(seqs, bounds, 256).withColumn("held_out", F.struct(*place) <= bound).drop("_coding", "_noncoding")
    ranked = join_per_genome(running_total(seqs.withColumn("_one", F.lit(1)), each, place, "_one", "seq_no"), _by_class(n), 64)
    return ranked.withColumn("held_out", F.col("seq_no") <= F.greatest(F.lit(1), F.floor(mine * F.lit(share)))).drop("_one", "_coding", "_noncoding", "seq_no")


def _by_class(n: DataFrame) -> DataFrame:
    return n.groupBy("genome_id").agg(*[F.max(F.when(F.col("cls") == cls, F.col("_n"))).alias(f"_{cls}") for cls in (CODING, NONCODING)])


def base_contexts(seqs: DataFrame, order: Column, keep: list[str]) -> DataFrame:
    """One row per base: codon position and the base with up to ``order`` bases before it.

    ``word`` is cut after the last letter outside ACGT; ``broken`` tells that this happened, and rows
    whose own base is such a letter are left out.
    """
    clean = F.regexp_replace("sequence", "[^ACGT]", "N").cast("binary")
    rows = seqs.select(*keep, order.alias("_k"), F.length("sequence").alias("_n"), clean.alias("_b"))
    tiles = rows.where("_n > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(TILE))).alias("_t")
    )
    places = tiles.select(
        "*", F.explode(F.sequence("_t", F.least(F.col("_t") + (TILE - 1), F.col("_n") - 1))).alias("i")
    )
    first = F.greatest(F.col("i") - F.col("_k"), F.lit(0))
    raw = F.substring(F.col("_b"), first + 1, F.col("i") - first + 1).cast("string")
    return places.select(
        *keep, F.col("_n").alias("n_bases"), (F.col("i") % 3).alias("pos"), raw.alias("raw")
    ).select(
        *keep, "n_bases", "pos", F.substring_index("raw", "N", -1).alias("word"),
        F.col("raw").contains("N").alias("broken"),
    ).where("word != ''")


def counting_units(bounds: DataFrame) -> Column:
    """In how many units the bases of a genome are counted: of ``UNIT`` bases at least, and of eight times the words there can be.

    Longer genomes have longer words. Units of one size, or tiles dealt singly, would meet most words once, and the counts that
    are shuffled would grow faster than the bases. Where the sizes are not given, a genome is one unit.
    """
    if "bp_coding" not in bounds.columns:
        return F.lit(1)
    words = F.lit(12.0) * F.pow(F.lit(4.0), F.col("bound"))
    return F.greatest(F.lit(1), F.ceil((F.col("bp_coding") + F.col("bp_noncoding")) / F.greatest(F.lit(float(UNIT)), 8 * words)))


def word_counts(marked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Longest contexts with counts, and for held-out coding rows the sum of 1/length as weight."""
    each = word_parts(marked, bounds).mapInArrow(_unpacked, "genome_id string, word long, n long, weight double")
    counted = each.where(F.col("word") < TOP).groupBy("genome_id", "word").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    part = lambda shift, mask: F.shiftright("word", shift).bitwiseAND(mask).cast("int")
    return counted.select(
        "genome_id", part(33, 15).alias("bound"), F.when(part(32, 1) == 1, CODING).otherwise(NONCODING).alias("cls"), (part(31, 1) == 1).alias("held_out"),
        part(29, 3).alias("pos"), part(25, 15).alias("size"), part(0, 0xFFFFFF).alias("code"), (part(24, 1) == 1).alias("broken"), "n", "weight")


def word_parts(marked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Counts of the longest contexts, not yet added up over tasks: genome_id, pos, shard, bound, words, counts, weights.

    A row has all words of a shard that a task met, as packed numbers; ``weights`` is empty where none has one.

    Sequences go to NumPy in tiles, each with the ``bound`` bases before it. ``shard`` is where the context belongs in the trie.
    Where contexts are dealt by their last letters, words of up to that many letters are there once per shard as well, marked by
    ``TOP``, with all words that end with them counted in.
    """
    rows = join_per_genome(marked, bounds.select("genome_id", "bound", counting_units(bounds).alias("_units")), 64, "inner")
    # The look-up of letters takes bytes; only where letters are not bytes is the text replaced first.
    wide = F.octet_length("sequence") > F.length("sequence")
    clean = F.when(wide, F.regexp_replace("sequence", "[^ACGT]", "N")).otherwise(F.col("sequence")).cast("binary")
    rows = rows.select("genome_id", "cls", "held_out", "bound", "_units", "contig_id", "o3", F.length("sequence").alias("_n"), clean.alias("_b")).where("_n > 0")
    tiles = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(TILE))).alias("_t"))
    first = F.greatest(F.col("_t") - F.col("bound"), F.lit(0))
    weight = F.when((F.col("cls") == CODING) & F.col("held_out") & (F.col("_n") >= 3), 1.0 / F.col("_n")).otherwise(0.0)
    unit = F.pmod(F.xxhash64("contig_id", "o3", "_t"), F.col("_units")).alias("_unit")
    tiles = tiles.select("genome_id", "cls", "held_out", unit, F.col("bound").cast("int").alias("bound"), weight.alias("weight"), (F.col("_t") - first).cast("int").alias("skip"),
                         (first % 3).cast("int").alias("phase"), F.substring("_b", first + 1, F.col("_t") + TILE - first).alias("bases"))
    # The rows come in range partitions of their genomes. A task gets whole units, in which words repeat; sorted by kind, the words
    # of a kind are counted in one array.
    tiles = tiles.repartition("genome_id", "_unit").sortWithinPartitions("genome_id", "cls", "held_out").drop("_unit")
    return tiles.mapInArrow(_words_of, PARTS)


class _Kind:
    """Words of one genome, class and part. Whole words are numbers below ``cells``; those cut short are few and have their key."""

    def __init__(self, genome: str, bound: int, coding: bool, held: bool):
        self.genome, self.bound = genome, bound
        self.key = ((bound * 2 + coding) * 2 + held) << 31
        self.letters = 2 * (bound + 1)
        self.cells, self.kept, self.dense = 3 << self.letters, 0, None
        self.whole, self.short = [], []

    def add(self, whole: tuple[np.ndarray, np.ndarray | None], short: tuple[np.ndarray, np.ndarray | None]) -> None:
        self.whole.append(whole)
        self.short.append(short)
        self.kept += whole[0].size
        if self.kept >= TOGETHER:
            self._fold()

    def _fold(self) -> None:
        at = np.concatenate([w for w, _ in self.whole])
        n, weight = np.bincount(at, minlength=self.cells), None
        if self.whole[0][1] is not None:
            weight = np.bincount(at, weights=np.concatenate([w for _, w in self.whole]), minlength=self.cells)
        if self.dense is not None:
            n += self.dense[0]
            weight = weight if weight is None else weight + self.dense[1]
        self.dense, self.whole, self.kept = (n, weight), [], 0

    def rows(self) -> list[tuple]:
        if self.whole and (self.dense is not None or self.kept * 4 >= self.cells):
            self._fold()
        if self.dense is not None:
            at = np.flatnonzero(self.dense[0])
            n, weight = self.dense[0][at], np.zeros(at.size) if self.dense[1] is None else self.dense[1][at]
        else:
            at, n, weight = _sums(self.whole)
        word, more, heavy = _sums(self.short)
        pos = at >> self.letters
        word = np.concatenate([self.key + (pos << 29) + ((self.bound + 1) << 25) + (at & ((1 << self.letters) - 1)), self.key + word])
        n, weight = np.concatenate([n, more]), np.concatenate([weight, heavy])
        pos, size, code = word >> 29 & 3, word >> 25 & 15, word & 0xFFFFFF
        shards, tops = 1, []
        shard = np.zeros(word.size, dtype=np.int64)
        if self.bound >= SHARDED_FROM:
            shards = 4 ** TAIL
            shard = np.where(size > TAIL, code >> 2 & (shards - 1), 0)
            for s in range(1, TAIL + 1):
                ends = np.bincount((pos * 4 ** s + (code & (4 ** s - 1)))[size >= s], weights=n[size >= s], minlength=3 * 4 ** s).astype(np.int64)
                at = np.arange(ends.size)
                tops.append((at // 4 ** s, self.key + TOP + (at // 4 ** s << 29) + (s << 25) + at % 4 ** s, ends))
        place = pos * shards + shard
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(3 * shards + 1))
        out = []
        for p in range(3 * shards):
            mine = order[cuts[p]:cuts[p + 1]]
            words = np.concatenate([word[mine], *[w[at == p // shards] for at, w, _ in tops]])
            counts = np.concatenate([n[mine], *[c[at == p // shards] for at, _, c in tops]]).astype(np.int64)
            if words.size:
                weights = np.concatenate([weight[mine], np.zeros(words.size - mine.size)]).tobytes() if weight[mine].any() else b""
                out.append((self.genome, p // shards, p % shards, self.bound, words.tobytes(), counts.tobytes(), weights))
        return out


def _unpacked(batches):
    for batch in batches:
        for genome, words, counts, weights in zip(*(batch.column(c).to_pylist() for c in ("genome_id", "words", "counts", "weights"))):
            word, n, weight = _numbers(words, counts, weights)
            yield pa.RecordBatch.from_arrays([pa.array([genome] * word.size, pa.string()), *map(pa.array, (word, n, weight))], ["genome_id", "word", "n", "weight"])


def _numbers(words: bytes, counts: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.frombuffer(words, dtype=np.int64)
    return word, np.frombuffer(counts, dtype=np.int64), np.frombuffer(weights, dtype=np.float64) if weights else np.zeros(word.size)


def _sums(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers with their counts and sums of weights."""
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    at = np.concatenate([w for w, _ in parts])
    if parts[0][1] is None:
        found, n = np.unique(at, return_counts=True)
        return found, n, np.zeros(found.size)
    found, place, n = np.unique(at, return_inverse=True, return_counts=True)
    return found, n, np.bincount(place.ravel(), weights=np.concatenate([w for _, w in parts]), minlength=found.size)


def _words_of(batches):
    """Counts of the longest words of tiles that are sorted by kind; a word ends with its base and is cut after the last letter outside ACGT."""
    kind, named, out, kept = None, None, [], 0

    def batch_of() -> pa.RecordBatch:
        types = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["genome_id", "pos", "shard", "bound", "words", "counts", "weights"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("genome_id", "bound", "cls", "held_out"))))
        skip, phase, weight = (batch.column(c).to_numpy().astype(t) for c, t in (("skip", int), ("phase", int), ("weight", float)))
        upto = np.cumsum(pc.binary_length(batch.column("bases")).to_numpy().astype(np.int64))
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        lo = 0
        while lo < batch.num_rows:
            if keys[lo] != named:
                if kind is not None:
                    more = kind.rows()
                    out += more
                    kept += sum(len(r[4]) for r in more)
                    if kept >= 8 * COUNTED:
                        yield batch_of()
                        out, kept = [], 0
                named = keys[lo]
                kind = _Kind(named[0], named[1], named[2] == CODING, named[3])
            while ends[0] <= lo:
                ends.pop(0)
            end = min(ends[0], max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + COUNTED, side="right"))))
            tiles = [np.frombuffer(b, dtype=np.uint8) for b in batch.column("bases").slice(lo, end - lo).to_pylist()]
            heavy = weight[lo:end] if named[2] == CODING and named[3] else None
            kind.add(*_words_in(tiles, named[1], skip[lo:end], phase[lo:end], heavy))
            lo = end
    if kind is not None:
        out += kind.rows()
    if out:
        yield batch_of()


def _words_in(tiles: list[np.ndarray], bound: int, skip: np.ndarray, phase: np.ndarray, weight: np.ndarray | None):
    """Whole words as numbers with their codon position, and those cut short with position, size and whether a letter cut them."""
    sizes = np.array([t.size for t in tiles])
    start = np.cumsum(sizes) - sizes
    letters = _LETTERS[np.concatenate(tiles)]
    at = np.arange(letters.size)
    i = at - np.repeat(start, sizes)
    pos = (i + np.repeat(phase, sizes)) % 3
    other = letters == 4
    code = np.where(other, 0, letters)
    for j in (1, 2, 4, 8):  # words of 2, 4, 8 and 16 letters; what is before the word is cut off below
        if j > bound:
            break
        code[j:] += code[:-j] << 2 * j if code.size > j else 0
    since = at - np.maximum.accumulate(np.where(other, at, -1)) if other.any() else at + 1  # bases since the last other letter, of this tile or before
    back = np.minimum(i, bound)
    size = np.minimum(back + 1, since)
    code &= (1 << 2 * size) - 1
    use = (i >= np.repeat(skip, sizes)) & ~other
    full = use & (size > bound)
    short = np.flatnonzero(use & (size <= bound))
    key = (((pos[short] * 16 + size[short]) * 2 + (since[short] <= back[short])) << 24) + code[short]
    whole = ((pos << 2 * (bound + 1)) + code)[full]
    if weight is None:
        return (whole, None), (key, None)
    each = np.repeat(weight, sizes)
    return (whole, each[full]), (key, each[short])


def kmer_counts(seqs: DataFrame, max_order: int) -> DataFrame:
    """Counts of every word of 1..max_order+1 bases by codon position of its last base."""
    longest = base_contexts(seqs, F.lit(max_order), ["genome_id", "cls"]).groupBy(
        "genome_id", "cls", "pos", "word"
    ).agg(F.count("*").alias("n"))
    sizes = longest.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_s"))
    return sizes.groupBy("genome_id", "cls", "pos", F.right("word", F.col("_s")).alias("kmer")).agg(
        F.sum("n").alias("n")
    )


def context_probabilities(counts: DataFrame, min_obs: int = C.MIN_OBSERVATIONS) -> DataFrame:
    """P(base | context) for contexts seen at least ``min_obs`` times; bases never seen are absent."""
    context = F.substring(F.col("kmer"), F.lit(1), F.length("kmer") - 1)
    total = F.sum("n").over(Window.partitionBy("genome_id", "cls", "pos", "context"))
    return (
        counts.withColumn("context", context)
        .withColumn("base", F.right("kmer", F.lit(1)))
        .withColumn("total", total)
        .where(F.col("total") >= min_obs)
        .select("genome_id", "cls", "pos", "context", "base", "kmer", "n", "total",
                (F.col("n") / F.col("total")).alias("prob"))
    )


# ---- the trie of contexts --------------------------------------------------------------------------
#: In model rows, the codon position of those that hold codon log-ratios.
CODON = -1


def context_trie(parts: DataFrame, bounds: DataFrame, choose: bool) -> DataFrame:
    """ln P_coding - ln P_background of the four bases after every context: genome_id, pos, size, shard, tail and ``ratios``, those of all contexts
    of a level in a shard (see ``trie_rows``); with ``choose``, also rows with order and score: what held-out coding words of a
    shard score per order under the counts without them.

    A context seen at least ``MIN_OBSERVATIONS`` times has the shares of the bases that follow it; for a base not seen after
    it, and for other contexts, the suffix decides.
    """
    shards = F.when(F.col("bound") >= SHARDED_FROM, F.sequence(F.lit(0), F.lit(4 ** TAIL - 1))).otherwise(F.array(F.lit(0)))
    frames = bounds.select("genome_id", F.explode(F.array(*map(F.lit, range(3)))).alias("pos"), F.col("bound").cast("int").alias("bound"), shards.alias("_shards"))
    # One row per shard, so that shards without words are there too.
    frames = frames.select("genome_id", "pos", F.explode("_shards").alias("shard"), "bound", *[F.lit(None).cast("binary").alias(c) for c in ("words", "counts", "weights")])

    def build(key, table):
        return _shard_of_trie(*(k.as_py() for k in key), table, choose)

    return parts.unionByName(frames).groupBy("genome_id", "pos", "shard").applyInArrow(
        build, "genome_id string, pos int, size int, shard int, tail int, ratios array<double>, order int, score double")


def trie_rows(trie: DataFrame) -> DataFrame:
    """One row per context, with the ratios of its four bases."""
    each = trie.select("*", F.explode(F.sequence(F.lit(0), (F.size("ratios") / 4).cast("int") - 1)).alias("i"))
    return each.select(*[c for c in trie.columns if c not in ("shard", "tail", "ratios")], F.expr("shiftleft(i, 2 * tail) | shard").alias("context"),
                       F.slice("ratios", 4 * F.col("i") + 1, F.lit(4)).alias("ratio"))


def _shard_of_trie(genome: str, pos: int, shard: int, table: pa.Table, choose: bool) -> pa.Table:
    """The contexts of a shard, level by level: a context of a level has the first letter in front of one of the level before."""
    bound = table.column("bound")[0].as_py()
    packed = [_numbers(*row) for row in zip(*(table.column(c).to_pylist() for c in ("words", "counts", "weights"))) if row[0] is not None]
    word, n, weight = (np.concatenate(c) for c in zip(*packed)) if packed else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    tail = TAIL if bound >= SHARDED_FROM else 0
    size, code, side, top = word >> 25 & 15, word & 0xFFFFFF, word >> 31 & 3, word >= TOP  # side: coding * 2 + held out

    def number(s, code: np.ndarray) -> np.ndarray:
        """Of a word of s letters among those of its level in this shard."""
        return np.where(s > tail, ((code & ((1 << 2 * s) - 1)) >> 2 * tail + 2 << 2) + (code & 3), code & ((1 << 2 * s) - 1))

    cells = [0] + [4 ** (s if s <= tail else s - tail) for s in range(1, bound + 2)]
    counts, longer = {}, 0
    for s in range(bound + 1, 0, -1):
        use = (size == s) & (top == (s <= tail))
        here = np.bincount(side[use] * cells[s] + number(s, code[use]), weights=n[use], minlength=4 * cells[s]).reshape(4, cells[s])
        counts[s] = longer = here if s <= tail or s == bound + 1 else here + longer.reshape(4, 4, cells[s]).sum(axis=1)
    all_, fit, offsets = [], [], np.cumsum(cells)
    for levels, parts in ((all_, ((2, 3), (0, 1))), (fit, ((2,), (0,)))):
        if levels is fit and not choose:
            continue
        before = [np.full((1, 4), C.UNSEEN_BASE_PROB)] * 2
        for s in range(1, bound + 2):
            if s == tail + 1 and tail:
                before = [p[[shard & (4 ** (tail - 1) - 1)]] for p in before]
            elif s > 1:
                before = [np.tile(p, (4, 1)) for p in before]
            for c, sides in enumerate(parts):
                seen = sum(counts[s][x] for x in sides).reshape(-1, 4)
                total = seen.sum(axis=1, keepdims=True)
                before[c] = np.where((total >= C.MIN_OBSERVATIONS) & (seen > 0), seen / np.maximum(total, 1), before[c])
            logs = [np.log(np.maximum(p, C.PROB_FLOOR)) for p in before]
            levels.append(logs[0] - logs[1])
    own = [s for s in range(1, bound + 2) if s > tail or shard == 0]  # levels of shorter words are the same in all shards
    orders, scores = [], []
    heavy = ~top & (side == 3) & (weight > 0)
    if choose and bound >= 2 and heavy.any():
        size, code, weight, broken = size[heavy], code[heavy], weight[heavy], (word[heavy] >> 24 & 1) == 1
        values = np.concatenate([x.ravel() for x in fit])
        for order in range(2, bound + 1):
            use = ~broken | (size > order)
            if use.any():
                s = np.minimum(size[use], order + 1)
                orders.append(order)
                scores.append(float((weight[use] * values[offsets[s - 1] + number(s, code[use])]).sum()))
    rows = [(genome, pos, s, shard if s > tail else 0, tail if s > tail else 0, all_[s - 1].ravel(), None, None) for s in own]
    rows += [(genome, pos, None, None, None, None, order, score) for order, score in zip(orders, scores)]
    types = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.float64()
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("genome_id", "pos", "size", "shard", "tail", "ratios", "order", "score"), zip(*rows), types)})


def chosen_orders(sizes: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per genome: bound, markov_order, held_out_score. The lowest order wins among those equal to nine digits."""
    best = scores.groupBy("genome_id").agg(F.max_by(F.struct("order", "score"), F.struct(F.round("score", 9), -F.col("order"))).alias("_best"))
    few = (F.col("bound") < 2) | (F.col("n_coding") < 5) | (F.col("n_noncoding") < 5)
    n_held = F.greatest(F.lit(1), F.floor(F.col("n_coding") * F.lit(C.VALIDATION_SHARE)))
    return sizes.join(best, "genome_id", "left").select(
        "genome_id", "bound", F.when(few, F.col("bound")).otherwise(F.coalesce("_best.order", F.lit(2))).alias("markov_order"),
        F.when(~few, F.col("_best.score") / n_held).alias("held_out_score"))


def markov_models(seqs: DataFrame, fixed_order: int | None = None) -> DataFrame:
    """Model rows of the order that each genome chooses: genome_id, bound, markov_order, held_out_score, pos, size, context, ratio.

    ``ratio`` has ln P_coding - ln P_background of the four words of ``size`` bases that begin with the context, as base-4 number.
    """
    if fixed_order is not None and not 0 <= fixed_order <= C.MAX_MARKOV_ORDER:
        raise ValueError(f"an order of 0 to {C.MAX_MARKOV_ORDER} is asked for, not {fixed_order}")
    sizes = order_bound(class_sizes(seqs))
    choose = fixed_order is None
    if not choose:
        sizes = sizes.withColumn("bound", F.lit(fixed_order))
        marked = seqs.withColumn("held_out", F.lit(True))
    else:
        marked = mark_held_out(seqs)
    sizes = stored(sizes)  # one row per genome
    table = stored(context_trie(word_parts(marked, sizes), sizes, choose))
    if not choose:
        orders = sizes.select("genome_id", "bound", F.lit(fixed_order).alias("markov_order"), F.lit(None).cast("double").alias("held_out_score"))
    else:
        scores = table.where(F.col("order").isNotNull()).groupBy("genome_id", "order").agg(F.sum("score").alias("score"))
        orders = stored(chosen_orders(sizes, scores))
    rows = join_per_genome(table.where(F.col("size").isNotNull()).drop("order", "score"), orders, 64, "inner")
    return trie_rows(rows.where(F.col("size") <= F.col("markov_order") + 1)).select(
        "genome_id", "bound", "markov_order", "held_out_score", "pos", "size", "context", "ratio")


def model_bundle(seqs: DataFrame, fixed_order: int | None = None) -> DataFrame:
    """Model rows of Markov chain and codons (``pos`` = CODON), everything needed to score the ORFs of a genome."""
    usage = codon_rows(codon_log_ratio(codon_model(seqs))).select("genome_id", F.lit(CODON).alias("pos"), F.lit(3).alias("size"), "context", "ratio")
    return markov_models(seqs, fixed_order).unionByName(usage, allowMissingColumns=True)


def model_heads(models: DataFrame) -> DataFrame:
    """One row per genome with its bound, order and held-out score."""
    return models.where((F.col("pos") == 0) & (F.col("size") == 1)).select("genome_id", "bound", "markov_order", "held_out_score")


def model_arrays(models: DataFrame) -> DataFrame:
    """One row per genome: markov_order, codon_table (64 values) and markov_table, for look-ups of a few words in other expressions.

    The word of L bases with number c at codon position p sits at p * T + (4^L - 1) / 3 - 1 + c of markov_table, where T is the
    number of words of 1..order+1 bases. The order limit bounds the row.
    """
    flat = lambda rows: F.flatten(F.transform(F.array_sort(rows), lambda x: x["ratio"]))
    chain = F.collect_list(F.when(F.col("pos") != CODON, F.struct("pos", "size", "context", "ratio")))
    usage = F.map_from_entries(F.collect_list(F.when(F.col("pos") == CODON, F.struct("context", "ratio"))))
    rows = models.groupBy("genome_id").agg(F.max("markov_order").alias("markov_order"), usage.alias("_usage"), flat(chain).alias("markov_table"))
    none = F.array(*[F.lit(0.0)] * 4)
    codon = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.element_at("_usage", i), none)))
    return rows.select("genome_id", "markov_order", codon.alias("codon_table"), F.when(F.size("markov_table") > 0, F.col("markov_table")).alias("markov_table"))


# ---- reports ---------------------------------------------------------------------------------------
def codon_usage_extremes(log_ratio: DataFrame, top: int = 10) -> DataFrame:
    """Per genome the codons most enriched and most depleted in coding sequence, by frequency difference."""
    diff = F.coalesce("coding", F.lit(0.0)) - F.coalesce("background", F.lit(0.0))
    rows = log_ratio.withColumn("difference", diff).where("difference != 0")
    rows = rows.withColumn("direction", F.when(F.col("difference") > 0, "enriched").otherwise("depleted"))
    rank = Window.partitionBy("genome_id", "direction").orderBy(F.abs("difference").desc(), "codon")
    return (
        rows.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top)
        .select("genome_id", "direction", "rank", "codon",
                F.coalesce("coding", F.lit(0.0)).alias("coding"),
                F.coalesce("background", F.lit(0.0)).alias("background"), "difference")
    )


def model_health(seqs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Contexts per codon position, largest difference between positions and classes, GC per class."""
    gc = seqs.groupBy("genome_id").agg(
        *[
            (
                F.sum(F.when(F.col("cls") == cls,
                             F.length("sequence") - F.length(F.translate("sequence", "GC", ""))))
                / F.sum(F.when(F.col("cls") == cls, F.length("sequence")))
            ).alias(f"gc_{cls}")
            for cls in (CODING, NONCODING)
        ]
    )
    side = lambda cls: F.max(F.when(F.col("cls") == cls, F.col("prob")))
    both = probabilities.groupBy("genome_id", "pos", "context", "base").agg(
        side(CODING).alias("pc"), side(NONCODING).alias("pn")
    )
    shape = both.groupBy("genome_id").agg(
        *[F.count_distinct(F.when((F.col("pos") == p) & F.col("pc").isNotNull(), F.col("context")))
          .alias(f"contexts_pos{p}") for p in range(3)],
        F.max(F.abs(F.col("pc") - F.col("pn"))).alias("max_prob_difference"),
    )
    return gc.join(shape, "genome_id", "left").select(
        "*",
        (F.col("gc_coding") - F.col("gc_noncoding")).alias("gc_difference"),
        (F.abs(F.col("gc_coding") - F.col("gc_noncoding")) < 0.01).alias("warn_gc_close"),
        (F.coalesce("max_prob_difference", F.lit(0.0)) < 0.1).alias("warn_models_close"),
    )
