"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

All ways to write a text with pieces of the vocabulary form a lattice. A forward pass sums the weight of all paths to
each place; the backward pass draws pieces from the end in proportion, so segmentations are drawn exactly by their
weight. The random numbers are a hash of the row key, the place of the segment and the step: the same row gives the
same segmentation in any task, partitioning or retry. With ``best`` the heaviest path is taken instead.

No piece goes across a space that follows other characters, nor across a line feed, so lattices are built per segment,
once for each different segment of a slice, and the draws of all segments of a slice are made together as arrays.
Nothing is normalised: a space is the piece mark, any character without a piece (the mark itself included) becomes its
UTF-8 bytes, and no mark is put in front. Decoding the ids gives the text back, code point for code point.

The vocabulary's scores are ranks; a piece of rank r weighs ``1 / (r + 2) ** alpha``. A null text has null ids, an empty
one none. Repeated rows get equal ids. A null key counts as 0. Extra columns pass through. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm import arrays
from codonlake.llm.arrays import mix
from codonlake.llm.common import register, table
from codonlake.session import ship_package

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
ALPHA = 1.0

_MARK = "▁"
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
#: Text that is worked through at once, in bytes of UTF-8; a longer text goes by itself.
SLICE_BYTES = 1_200_000
#: Random numbers per segment and step come from one hash; a segment has fewer steps than this.
_STEPS = 1 << 20


@dataclass
class Vocabulary:
    """Pieces that text can match, and what every id stands for."""

    matches: dict[str, tuple[int, float]]
    written: list[bytes]
    byte_ids: np.ndarray
    byte_weight: float

    @classmethod
    def load(cls, path: str = VOCABULARY, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        matches, written, byte_ids = {}, [], np.zeros(256, dtype=np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                written.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                written.append(b"")
            else:
                written.append(piece.replace(_MARK, " ").encode())
                rank = -model.get_score(i)
                rank = i if rank > 1e6 or rank < 0 else rank  # pieces added beside the merges have no rank
                matches[piece] = (i, -alpha * float(np.log(rank + 2)))
        return cls(matches, written, byte_ids, -alpha * float(np.log(2 * len(written))))

    def tables(self) -> list[Level]:
        """For each length: all prefixes of that length, with the piece that a prefix is itself, if any."""
        out = []
        for n in range(1, max(map(len, self.matches)) + 1):
            prefixes = sorted({p[:n] for p in self.matches if len(p) >= n})
            longer = {p[:n] for p in self.matches if len(p) > n}
            hashes = _hash_strings(prefixes)
            order = np.argsort(hashes)
            own = [self.matches.get(p, (_NO_PIECE, 0.0)) for p in prefixes]
            out.append(Level(hashes[order], np.array([x[0] for x in own], dtype=np.int32)[order],
                             np.array([x[1] for x in own])[order], np.array([p in longer for p in prefixes])[order]))
        return out


_NO_PIECE = np.iinfo(np.int32).max


class Level(arrays.Finder):
    """Prefixes of one length by hash, with the piece that each is itself and whether a longer piece begins with it."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, weights: np.ndarray, longer: np.ndarray):
        super().__init__(hashes, 16)
        self.ids, self.weights, self.longer = ids, weights, longer


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _roll(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64) + np.uint64(1))


def _hash_strings(strings: list[str]) -> np.ndarray:
    """Hashes of strings of one length each, as the rolling pass over text computes them."""
    if not strings:
        return np.empty(0, dtype=np.uint64)
    points = np.stack([_points(s) for s in strings])
    h = np.zeros(len(strings), dtype=np.uint64)
    for j in range(points.shape[1]):
        h = _roll(h, points[:, j])
    return h


class Lattice:
    """Lattices of different segments, side by side. Node base[s] + i is place i of segment s."""

    def __init__(self, segments: list[str], vocabulary: Vocabulary, tables, best: bool):
        lengths = np.array([len(s) for s in segments], dtype=np.int64)
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.last = self.base + lengths
        raw = _points("".join(segments))
        shown = raw.copy()
        shown[raw == 0x2581] = 0xFFFFFFFF  # a mark in the text is no piece mark
        shown[raw == 0x20] = 0x2581
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(raw.size)  # characters to the segment's end
        node = (np.arange(raw.size) + np.repeat(np.arange(len(segments)), lengths)).astype(np.int32)
        sources, ends, pieces, weights = [], [], [], []
        alive, h = np.arange(raw.size), np.zeros(raw.size, dtype=np.uint64)
        plain = np.zeros(raw.size, dtype=bool)
        for n, level in enumerate(tables, 1):
            if n > 1:
                inside = left[alive] >= n
                alive, h = alive[inside], h[inside]
            h = _roll(h, shown[alive + n - 1])
            found, at = level.find(h)
            alive, h = alive[found], h[found]
            own = level.ids[at] != _NO_PIECE
            where = alive[own]
            sources.append(node[where])
            ends.append(node[where] + np.int32(n))
            pieces.append(level.ids[at[own]])
            weights.append(level.weights[at[own]])
            if n == 1:
                plain[where] = True
            more = level.longer[at]
            alive, h = alive[more], h[more]
            if not alive.size:
                break
        bare = np.flatnonzero(~plain)
        size = 1 + (raw[bare] > 0x7F).astype(np.int64) + (raw[bare] > 0x7FF) + (raw[bare] > 0xFFFF)
        sources.append(node[bare])
        ends.append(node[bare] + np.int32(1))
        pieces.append((-1 - raw[bare].astype(np.int64)).astype(np.int32))  # written as bytes
        weights.append(vocabulary.byte_weight * size)
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        self.source, end, self.piece, weight = np.concatenate(sources)[order], end[order], np.concatenate(pieces)[order], np.concatenate(weights)[order]
        del sources, ends, pieces, weights, order
        nodes = int(self.last[-1] + 1) if len(segments) else 0
        into = np.searchsorted(end, np.arange(nodes + 1))
        score = self._forward(lengths, into, weight, nodes, best)
        share = score[self.source] + weight
        degree = np.diff(into)
        has = degree > 0
        begin = into[:-1][has]
        if best:  # all of the probability to the first heaviest edge
            top = np.repeat(np.maximum.reduceat(share, begin), degree[has]) if begin.size else share
            heavy = share >= top
            chance = (heavy & (np.cumsum(heavy) - np.repeat(np.cumsum(heavy)[begin] - heavy[begin], degree[has]) == 1)).astype(float)
        else:
            chance = np.exp(share - score[end])
        total = np.cumsum(chance)
        before = np.repeat(total[begin] - chance[begin], degree[has])
        part = total - before
        part /= np.repeat(part[into[1:][has] - 1], degree[has])
        part[into[1:][has] - 1] = 1.0
        self.ladder = end + part  # node plus the cumulative chance of its edges: one search draws an edge

    def _forward(self, lengths, into, weight, nodes, best) -> np.ndarray:
        """Log weight of all paths (or of the best one) to each node, place by place for all segments at once."""
        score = np.zeros(nodes)
        by_length = np.argsort(-lengths, kind="stable")
        base, active = self.base[by_length], lengths[by_length]
        for i in range(1, int(lengths.max(initial=0)) + 1):
            count = int(np.searchsorted(-active, -i, side="right"))
            here = base[:count] + i
            a, b = into[here], into[here + 1]
            n = b - a
            start = np.concatenate(([0], np.cumsum(n)[:-1]))
            edge = np.repeat(a - start, n) + np.arange(int(n.sum()))
            value = score[self.source[edge]] + weight[edge]
            top = np.maximum.reduceat(value, start)
            score[here] = top if best else top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), start))
        return score


class _Ids(dict):
    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _draw(texts: list[str], seeds: np.ndarray, vocabulary: Vocabulary, tables, best: bool) -> list[np.ndarray]:
    """Ids of each text."""
    known = _Ids()
    of_text = [np.fromiter(map(known.__getitem__, _SEGMENT.findall(t)), dtype=np.int64) for t in texts]
    counts = np.array([x.size for x in of_text], dtype=np.int64)
    segment = np.concatenate(of_text) if of_text else np.empty(0, dtype=np.int64)
    if not segment.size:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    lattice = Lattice(list(known), vocabulary, tables, best)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    place = np.arange(segment.size) - np.repeat(first, counts)
    key = mix(np.repeat(seeds, counts) + place.astype(np.uint64) * np.uint64(_STEPS))
    order = np.argsort(segment, kind="stable")  # neighbours look up the same lattice
    alive, node, root = order, lattice.last[segment[order]], lattice.base[segment[order]]
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    steps = np.zeros(segment.size, dtype=np.int64)
    while alive.size:
        u = (mix(key[alive] + np.uint64(len(drawn) + 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        edge = np.searchsorted(lattice.ladder, node + np.minimum(u, 1 - 1e-9), side="right")
        drawn.append((alive, lattice.piece[edge]))
        steps[alive] += 1
        node = lattice.source[edge]
        go = node > root
        alive, node, root = alive[go], node[go], root[go]
    begin = np.concatenate(([0], np.cumsum(steps)[:-1]))
    out = np.empty(int(steps.sum()), dtype=np.int32)
    for k, (who, piece) in enumerate(drawn):
        out[begin[who] + steps[who] - 1 - k] = piece
    total = np.add.reduceat(steps, np.minimum(first, segment.size - 1)) * (counts > 0)
    parts = np.split(out, np.cumsum(total)[:-1])
    return [_with_bytes(p, vocabulary) for p in parts]


def _with_bytes(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Characters without a piece replaced by the ids of their bytes."""
    bare = np.flatnonzero(pieces < 0)
    if not bare.size:
        return pieces
    raw = [chr(-1 - p).encode("utf-8", "surrogatepass") for p in pieces[bare].tolist()]
    many = np.ones(pieces.size, dtype=np.int64)
    many[bare] = [len(b) for b in raw]
    out = np.repeat(pieces, many)
    out[out < 0] = vocabulary.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return out


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.written.__getitem__, ids)).decode("utf-8", "surrogatepass")


def encode_texts(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, tables, seed: int = SEED, best: bool = False) -> list[np.ndarray]:
    """Ids of texts, all worked through together."""
    seeds = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return _draw(texts, seeds, vocabulary, tables, best)


def encode(docs: DataFrame, path: str = VOCABULARY, seed: int = SEED, alpha: float = ALPHA, best: bool = False,
           key: str = "doc_id", text: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``out``: array of ids, or with ``packed`` two bytes per id, low byte first."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = Vocabulary.load(path, alpha)  # the vocabulary, some 32,000 pieces, travels with the task
    shared = spark.sparkContext.broadcast((vocabulary, vocabulary.tables()))
    names = [c for c in docs.columns if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    kind = "binary" if packed else "array<int>"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        vocab, tables = shared.value
        for batch in (p for b in batches for p in arrays.parts_of(b, text, SLICE_BYTES)):
            texts = batch.column(text)
            ids = encode_texts(["" if t is None else t for t in texts.to_pylist()], batch.column(key).fill_null(0).to_numpy(zero_copy_only=False), vocab, tables, seed, best)
            missing = texts.is_null().to_pylist()
            if packed:
                made = pa.array([None if m else i.astype("<u2").tobytes() for i, m in zip(ids, missing)], pa.binary())
            else:
                ends = np.cumsum([0] + [i.size for i in ids]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                made = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(missing)) if ids else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [made], [*names, out])

    return kept.mapInArrow(run, f"{ddl}, `{out}` {kind}")


def decode(rows: DataFrame, path: str = VOCABULARY, ids: str = "ids", out: str = "decoded", packed: bool = False) -> DataFrame:
    """All columns and ``out``, the text that the ids stand for; null for null."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    names = [c for c in rows.columns if c != out]
    kept = rows.select(*[F.col(f"`{c}`") for c in names])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        vocab = shared.value
        for batch in batches:
            column = batch.column(ids)
            made = [None if i is None else decode_ids(np.frombuffer(i, "<u2").tolist() if packed else i, vocab) for i in (x.as_py() for x in column)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(made, pa.string())], [*names, out])

    return kept.mapInArrow(run, f"{ddl}, `{out}` string")


@register("op6_piece_sampling")
def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of all documents (two bytes each), their number, and whether decoding gives the text back."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    return decode(rows, packed=True).select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_pieces"), "ids",
                                            F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
