"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels the tokens of a document that hold a digit or an at sign (all other
tokens are O): unary potentials from the token's shape, chain potentials between neighbouring tokens, and skip
potentials between equal or similar tokens however far apart they stand. Neighbouring tokens of digits are read as one
number: two numbers are similar when their last TAIL digits agree, whatever their prefix and grouping, and of similar
numbers those tokens are linked whose last digits stand at the same place from the end. Addresses are similar when their
parts before the at sign agree.
Tokens of base spans are fixed; loopy belief propagation carries their labels to other mentions, so a number or
address that is certain in one place is found where it stands without its prefix. All mentions of a key in a document
are linked to one of them, a fixed one where there is one, so edges grow with the text and no mention is further away
than another. Messages of all documents of a slice are passed together as arrays, those of each document until they
stand still.

The three sets of potentials are fitted piecewise on at most ``SAMPLE`` documents (in expectation, chosen by a hash of the id)
with the base labels as truth; marks that give a kind away (a leading plus) are hidden in half of the training rows,
so the shape has to carry the label. Every document is then labelled, whole.

Null and empty texts have no spans. Repeated rows are labelled each by itself. Extra columns pass through
``redacted``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm.common import register, table
from codonlake.session import ship_package

KINDS = ("email", "ip", "card", "phone")  # labels 1 to 4; 0 is O
SAMPLE = 4_000
#: Messages stand still when none of a document changes by more than CALM. Should they swing for PATIENCE rounds, the weight of new ones is halved, down to LEAST_WEIGHT.
CALM = 1e-3
PATIENCE = 100
LEAST_WEIGHT = 1 / 64
SURE = 0.9
#: Digits from the end that make two numbers similar; numbers under LEAST_DIGITS have no key.
TAIL = 7
LEAST_DIGITS = 6

# Each pattern starts only where the leftmost match would start, so runs that fail are passed in one step.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HIT = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().-]*[,;:!?]?")
_EDGE = "\"'`,;:!?.()[]{}<>|#*$%&="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; kind from 1."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 1, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 2, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 3, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 4, m.end()))
    return sorted(out)


_N_FEATURES = 18


def _shape(token: str, before: str, after: str) -> list[int]:
    """Features of a token; 0 is always there, 1 is the mark that training hides."""
    digits = sum("0" <= c <= "9" for c in token)
    f = [0, 2 + min(6, (digits + 2) // 3)]
    if token.startswith("+"):
        f.append(1)
    if "@" in token:
        f.append(9)
    dots = token.count(".")
    if dots:
        f.append(10 if dots == 3 and digits > 3 else 11)
    if "-" in token[1:-1]:
        f.append(12)
    if "(" in token or ")" in token:
        f.append(13)
    if any(c.isalpha() for c in token):
        f.append(14)
    if 13 <= digits <= 19 and luhn("".join(c for c in token if "0" <= c <= "9")):
        f.append(15)
    if before and _DIGIT.search(before):
        f.append(16)
    if after and _DIGIT.search(after):
        f.append(17)
    return f


def _address(token: str) -> str | None:
    """The part of an address before its at sign."""
    bare = token.strip(_EDGE).lower()
    return f"@{bare[:bare.index('@')]}" if len(bare) >= 6 and bare.find("@") > 0 else None


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def _number_keys(run: list[tuple[int, str]]) -> Iterator[tuple[str, int]]:
    """(key, node) for the tokens (node, digits) of a number: the end of the number, and where the token ends in it."""
    size = sum(len(d) for _, d in run)
    if size < LEAST_DIGITS:
        return
    # the digits of the tokens before it do not reach the end of a long number, so a few tokens make the end
    end = ""
    for _, d in reversed(run):
        if len(end) >= TAIL:
            break
        end = d[-TAIL:] + end
    end, place = end[-TAIL:], 0
    for node, d in reversed(run):
        if place >= 19:  # no kind has more digits
            break
        yield f"{end}:{place}", node
        place += len(d)


class Graph:
    """Candidate tokens of some documents: shapes, fixed labels, chain and skip edges."""

    def __init__(self):
        self.doc, self.start, self.end, self.shapes, self.fixed = [], [], [], [], []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.open: list[int] = []  # neighbours that are surely O, per token

    def add(self, number: int, text: str, base: list[tuple[int, int, int]]) -> None:
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        mentions: dict[str, list[int]] = defaultdict(list)
        run: list[tuple[int, str]] = []  # the number that is being read

        def close() -> None:
            for key, node in _number_keys(run):
                mentions[key].append(node)
            run.clear()

        previous, b = -2, 0
        for i, (s, e, w) in enumerate(words):
            if not _HIT.search(w):
                continue
            node = len(self.doc)
            before, after = words[i - 1][2] if i else "", words[i + 1][2] if i + 1 < len(words) else ""
            while b < len(base) and max(x[2] for x in base[b:b + 1]) <= s:
                b += 1
            kind = next((k for a, k, z in base[b:b + 4] if a < e and z > s), 0)
            self.doc.append(number)
            self.start.append(s)
            self.end.append(e)
            self.shapes.append(_shape(w, before, after))
            self.fixed.append(kind)
            joined = previous == i - 1
            if joined:
                self.chain.append((node - 1, node))
                self.open[-1] -= 1
            self.open.append((0 if joined else 1) + 1)
            grouped = _NUMBER.fullmatch(w)
            if not (joined and grouped) or w.startswith("+"):
                close()
            if "@" in w:
                if (key := _address(w)) is not None:
                    mentions[key].append(node)
            else:
                run.append((node, _digits(w)))
            if not grouped:
                close()
            previous = i
        close()
        for nodes in mentions.values():
            hub = next((n for n in nodes if self.fixed[n]), nodes[0])
            self.skip += [(min(hub, n), max(hub, n)) for n in nodes if n != hub]


def _fit(spark: SparkSession, docs: DataFrame) -> dict[str, np.ndarray]:
    """Potentials from counts over the sample; the counts, not the documents, come to the driver."""
    ship_package(spark)
    rows = docs.count()
    chosen = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")) if rows <= SAMPLE else docs.select("doc_id", "text").where(
        (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / rows)) & F.col("text").rlike("[0-9@]"))

    def count(batches):
        unary: Counter = Counter()
        pairs: Counter = Counter()
        for batch in batches:
            graph = Graph()
            for n, text in enumerate(batch.column(0).to_pylist()):
                graph.add(n, text, base_spans(text))
            for f, y in zip(graph.shapes, graph.fixed):
                unary[(sum(1 << x for x in f), y)] += 1
                unary[(sum(1 << x for x in f if x != 1), y)] += 1
            for name, edges in (("chain", graph.chain), ("skip", graph.skip)):
                for a, b in edges:
                    pairs[(name, graph.fixed[a], graph.fixed[b])] += 1
            for y, n in zip(graph.fixed, graph.open):
                pairs[("chain", 0, y)] += n
        rows = [("unary", x, y, n) for (x, y), n in unary.items()] + [(k, a, b, n) for (k, a, b), n in pairs.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "x", "y", "n"])

    # at most 2^18 shapes by construction of the features, in practice some hundreds
    counts = chosen.select("text").mapInArrow(count, "part string, x long, y long, n long").groupBy("part", "x", "y").agg(F.sum("n").alias("n")).orderBy("part", "x", "y").collect()
    unary = [(r["x"], r["y"], r["n"]) for r in counts if r["part"] == "unary"]
    w = np.zeros((_N_FEATURES, 5))
    if unary:
        x = np.array([[(s >> i) & 1 for i in range(_N_FEATURES)] for s, _, _ in unary], dtype=float)
        y, n = np.eye(5)[[u[1] for u in unary]], np.array([u[2] for u in unary], dtype=float)
        n /= n.sum()
        for _ in range(600):  # multinomial logistic regression with a small ridge
            p = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w += 2.0 * (x.T @ ((y - p) * n[:, None]) - 1e-4 * w)
    out = {"unary": w}
    for part in ("chain", "skip"):
        table_ = np.full((5, 5), 0.5) + 2 * np.eye(5)
        for r in counts:
            if r["part"] == part:
                table_[r["x"], r["y"]] += r["n"]
                table_[r["y"], r["x"]] += r["n"]
        share = table_.sum(axis=1) / table_.sum()
        out[part] = np.clip(np.log(table_ / table_.sum() / np.outer(share, share)), -4, 4)
    return out


def _beliefs(graph: Graph, model: dict[str, np.ndarray]) -> np.ndarray:
    """Marginals of all tokens after loopy sum-product message passing."""
    n = len(graph.doc)
    unary = np.zeros((n, 5))
    node = np.repeat(np.arange(n), [len(f) for f in graph.shapes])
    np.add.at(unary, node, model["unary"][np.concatenate(graph.shapes)])
    unary += np.array(graph.open)[:, None] * model["chain"][0][None, :]
    fixed = np.array(graph.fixed)
    held = fixed > 0
    unary[held] = np.where(np.eye(5, dtype=bool)[fixed[held]], 0.0, -30.0)
    edges = np.array(graph.chain + graph.skip, dtype=np.int64).reshape(-1, 2)
    potential = np.concatenate([np.broadcast_to(model[k], (len(e), 5, 5)) for k, e in (("chain", graph.chain), ("skip", graph.skip))])
    source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    both = np.concatenate((potential, potential.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    message = np.zeros((len(source), 5))
    doc = np.array(graph.doc, dtype=np.int64)[target]
    live, weight, rounds = np.arange(len(source)), np.full(int(doc.max(initial=-1)) + 1, 0.5), 0
    while live.size:
        rounds += 1
        total = unary.copy()
        np.add.at(total, target[live], message[live])  # all messages of a document are live, or none
        sent = total[source[live]] - message[back[live]]
        new = sent[:, :, None] + both[live]
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        change = np.zeros(weight.size)
        np.maximum.at(change, doc[live], np.abs(new - message[live]).max(axis=1))
        w = weight[doc[live], None]
        message[live] = (1 - w) * message[live] + w * new
        if rounds % PATIENCE == 0:
            weight /= 2
            if weight.max() < LEAST_WEIGHT:
                break
        live = live[change[doc[live]] >= CALM]
    total = unary
    np.add.at(total, target, message)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def _plausible(kind: int, piece: str) -> bool:
    digits = sum("0" <= c <= "9" for c in piece)
    if kind == 1:
        return "@" in piece[1:-1]
    if kind == 2:
        return bool(m := _IP.fullmatch(piece)) and all(int(p) <= 255 for p in m[0].split(".") if len(p) < 5) and max(map(len, m[0].split("."))) < 5
    if kind == 3:
        return 13 <= digits <= 19
    return 7 <= digits <= 15


def _added(graph: Graph, beliefs: np.ndarray, texts: list[str], base: list[list[tuple[int, int, int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of neighbouring tokens with one sure label that overlap no base span."""
    label = np.where((beliefs.argmax(axis=1) > 0) & (beliefs.max(axis=1) >= SURE) & (np.array(graph.fixed) == 0), beliefs.argmax(axis=1), 0)
    joined = set(graph.chain)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    i = 0
    while i < len(label):
        j = i + 1
        if label[i]:
            while j < len(label) and label[j] == label[i] and (j - 1, j) in joined:
                j += 1
            d, text = graph.doc[i], texts[graph.doc[i]]
            s, e = graph.start[i], graph.end[j - 1]
            while s < e and text[s] in _EDGE and text[s] != "(":
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            if _plausible(int(label[i]), text[s:e]) and not any(a < e and z > s for a, _, z in base[d]):
                out[d].append((s, int(label[i]), e))
        i = j
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_DDL = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(docs: DataFrame, text_out: bool = False) -> DataFrame:
    """Rows (doc_id, spans) of documents (doc_id, text); with ``text_out`` also ``redacted``, the text with each span replaced by its kind."""
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs.sparkSession, docs))  # a few hundred numbers

    def label(batches):
        for batch in batches:
            n = batch.num_rows
            step = 256
            for lo in range(0, n, step):
                part = batch.slice(lo, step)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base, graph = [[] for _ in texts], Graph()
                for i, text in enumerate(texts):
                    if _HIT.search(text):
                        base[i] = base_spans(text)
                        graph.add(i, text, base[i])
                extra = _added(graph, _beliefs(graph, model.value), texts, base) if graph.doc else {}
                every = [sorted([(*s, True) for s in b] + [(*s, False) for s in extra.get(i, [])]) for i, b in enumerate(base)]
                columns = [part.column("doc_id"), pa.array([[{"kind": KINDS[k - 1], "start": s, "end": e, "base": g} for s, k, e, g in x] for x in every], _SPANS)]
                names = ["doc_id", "spans"]
                if text_out:
                    columns.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, every)]))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id long, spans {_DDL}" + (", redacted string" if text_out else ""))


def redact(text: str, spans: list[tuple]) -> str:
    """Spans replaced by their kinds; of overlapping ones the union goes, under the first one's kind."""
    out, done = [], 0
    for s, k, e, *_ in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k - 1].upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` redacted; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs.sparkSession, docs))
    names = docs.columns

    def label(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = part.column("text").to_pylist()
                texts, graph = [t or "" for t in raw], Graph()
                base = [[] for _ in texts]
                for i, text in enumerate(texts):
                    if _HIT.search(text):
                        base[i] = base_spans(text)
                        graph.add(i, text, base[i])
                extra = _added(graph, _beliefs(graph, model.value), texts, base) if graph.doc else {}
                made = [None if r is None else redact(t, sorted(b + extra.get(i, []))) for i, (r, t, b) in enumerate(zip(raw, texts, base))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == "text" else part.column(c) for c in names], names)

    return docs.mapInArrow(label, docs.schema)


@register("op2_pii_crf")
def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    df = personal_data(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
                     joined(F.col("spans")).alias("spans"))
