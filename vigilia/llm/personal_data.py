"""Personal data in text: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers (the base). The nodes of a document's field are the
base spans, whose labels are fixed, and other candidates that look like an address or a number of at least ``LEAST_DIGITS``
digits; a row of numbers is cut where digits known from a base span of the document, a card or phone number in its groups, or a
number long enough to stand alone end. A node's own potential comes from its shape (how its digits are grouped and separated), neighbouring candidates share a
chain potential, and nodes that repeat or resemble one another (the same digits or address in whatever notation) share a
skip potential however far apart they are. Loopy belief propagation over all documents of a slice gives the labels'
probabilities; a candidate whose best label has at least ``SURE`` becomes a span. So a card number found once is found again
where it is written with dots, and a number that no pattern and no repetition supports is left alone.

Potentials are log-ratios of counts over all documents (piecewise training with the base as labels). Of equal keys each
node is linked to the one before and to the first, so edges grow in proportion to nodes. Messages are passed until they
stand still, ``ROUNDS`` times at most: a loopy graph need not settle, and the last beliefs count.

Null texts are empty and have no spans; every row is searched on its own, with a null or repeated id too; places are in code
points. Other columns are not read by the search and are kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .textvec import raw, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
NONE = 0
LEAST_DIGITS, SURE, ROUNDS, STILL, DAMPING = 7, 0.9, 100, 1e-6, 0.5
#: Prior counts: of a shape's labels, of agreeing and differing neighbours by a skip edge; bound of a chain potential.
PRIOR = np.array([2.0, *[0.05] * len(KINDS)])
AGREE, DIFFER, CHAIN_PRIOR, CHAIN_BOUND = 50.0, 0.02, 5.0, 0.5
MOST_GROUPS = 6
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits unless it could at the run's start, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A row of numbers of any length is taken as a whole, so that the search stays linear; ``cut`` finds the numbers in it.
ROW = re.compile(r"(?<![A-Za-z0-9_/.+-])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
UNENDED = re.compile(r"[A-Za-z0-9_/]")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+", re.I)
DIGITS = re.compile(r"[0-9]+")
#: Lengths of the digit groups of card and phone numbers; a country code may stand before the latter.
CARD_GROUPS, PHONE_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)), (3, 3, 4)
GROUPS = re.compile(r"[0-9]+|[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(label, begin, end) of the patterns' matches, by label and place."""
    found = [(1, a, b) for a, b in _emails(text)]
    found += [(2, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for label, pattern, least, most in ((3, CARD, 13, 19), (4, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            own = _digits(m[0])
            if least <= len(own) <= most and (label == 4 or luhn(own)):
                found.append((label, m.start(), m.end()))
    return found


class Node(NamedTuple):
    begin: int
    end: int
    label: int
    fixed: bool
    shape: str
    key: str
    surface: str


def shape_of(surface: str) -> str:
    """How a candidate is written: an address, four numbers with points, or the lengths of digit groups between separators."""
    if not surface.lstrip("+(")[:1].isdigit() or "@" in surface:
        return "address" if "@" in surface and "." in surface.partition("@")[2] else "spelled"
    parts = surface.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) < 4 for p in parts):
        return "quad" if all(int(p) < 256 for p in parts) else "no quad"
    if surface[0] == "+":  # the country code is left out, so that a number without it has the same shape
        surface = surface[1:].lstrip("0123456789").lstrip(" .-") or surface
    groups = GROUPS.findall(surface)
    if len(groups) > 2 * MOST_GROUPS:
        return "many groups"
    checked = (" valid" if luhn(_digits(surface)) else " invalid") if 13 <= len(_digits(surface)) <= 19 else ""
    return "".join(str(min(len(g), 20)) if g[0].isdigit() else g for g in groups) + checked


def key_of(surface: str) -> str:
    """Equal for notations of one thing: the address, the four numbers, or the digits, without a country code before ten."""
    shape = shape_of(surface)
    if shape in ("address", "spelled"):
        plain = re.sub(r" ?[\[(]at[\])] ?", "@", surface, flags=re.I)
        return re.sub(r" ?[\[(]dot[\])] ?", ".", plain, flags=re.I).lower()
    if shape in ("quad", "no quad"):
        return surface
    digits = _digits(surface)
    return digits[-10:] if len(digits) < 13 else digits


def cut(row: str, known: set[str]) -> list[tuple[int, int]]:
    """Places of the numbers in a row of digit groups; ``known``: digits of base spans of the document."""
    groups = [m.span() for m in DIGITS.finditer(row)]
    n, digits = len(groups), _digits(row)
    upto = [0]
    for a, b in groups:
        upto.append(upto[-1] + b - a)
    sizes = [b - a for a, b in groups]
    between = ["", *(row[a[1] : b[0]] for a, b in zip(groups, groups[1:])), ""]
    plus = row[0] == "+"

    def place(i: int, j: int) -> tuple[int, int]:
        a = groups[i][0]
        return 0 if i == 0 else a - (row[a - 1] == "("), groups[j - 1][1]

    def repeated(i: int) -> int:
        """Where the longest known number that begins with group ``i`` ends."""
        found, j = 0, i + 1
        while j <= n and upto[j] - upto[i] <= 19:
            own = digits[upto[i] : upto[j]]
            if own in known or i == 0 and plus and len(own) < 13 and own[-10:] in known:
                found = j
            j += 1
        return found

    def grouped(i: int, ended: bool) -> int:
        """Where a card or phone number that begins with group ``i`` ends; ``ended``: only if what stands around it sets it apart."""
        if 13 <= sizes[i] <= 19:
            ends = [i + 1]
        else:
            ends = [i + len(p) for p in CARD_GROUPS if tuple(sizes[i : i + len(p)]) == p]
        for j in ends:
            inside, around = set(between[i + 1 : j]), {between[i], between[j]} - {""}
            apart = all(" " in x or x not in inside for x in around)
            # In a row of equal groups any four may pass the check digit: then the first digit must be an issuer's.
            issuer = digits[upto[i]] in "3456" or not inside & around
            if luhn(digits[upto[i] : upto[j]]) and len(inside) < 2 and (not ended or apart and issuer):
                return j
        k = i + (i == 0 and plus and sizes[0] < 4 or digits[upto[i] : upto[i + 1]] == "1")
        j = k + len(PHONE_GROUPS)
        if tuple(sizes[k:j]) == PHONE_GROUPS:
            inside = set(between[i + 1 : j])
            if not ended or all(not x or " " in x or x not in inside for x in (between[i], between[j])):
                return j
        return 0

    if upto[n] <= 19 and (digits in known or key_of(row) in known):
        return [(0, groups[-1][1])]
    at = 0
    while at < n and (to := grouped(at, False)):
        at = to
    tiled = at == n
    out, first, at = [], 0, 0

    def rest(i: int, j: int) -> None:
        """Groups in which nothing was found are one number, cut at spaces between numbers long enough to stand alone."""
        spaces = [i, *(k for k in range(i + 1, j) if between[k] == " "), j]
        begin = i
        for a, b, c in zip(spaces, spaces[1:], spaces[2:]):
            if min(upto[b] - upto[a], upto[c] - upto[b]) >= LEAST_DIGITS:
                out.append(place(begin, b))
                begin = b
        if begin < j:
            out.append(place(begin, j))

    while at < n:
        to = repeated(at) or grouped(at, not tiled)
        if to:
            rest(first, at)
            out.append(place(at, to))
            first = at = to
        else:
            at += 1
    rest(first, n)
    return out


def rows_of(text: str) -> Iterator[tuple[int, int]]:
    """Rows of digit groups; the last number of a row is left out if a letter follows it."""
    for m in ROW.finditer(text):
        a, b = m.span()
        if UNENDED.match(text, b):
            b = max(text.rfind(" ", a, b), a)
            while b > a and not "0" <= text[b - 1] <= "9":
                b -= 1
        if b > a:
            yield a, b


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Base spans and other candidates, in order of place; candidates do not overlap base spans or one another."""
    covered = sorted({(a, b): label for label, a, b in reversed(base)}.items())
    found, done = [], 0
    gaps = []
    for (a, b), label in covered:
        if a > done:
            gaps.append((done, a))
        done = max(done, b)
        found.append(Node(a, b, label, True, shape_of(text[a:b]), key_of(text[a:b]), text[a:b]))
    gaps.append((done, len(text)))
    known = {n.key for n in found if n.key.isdecimal()}
    taken: list[tuple[int, int]] = []
    for a, b in gaps:
        part = " " * (a > 0) + text[a:b]  # a base span beside a candidate is no letter
        shift = a - (a > 0)
        own = [(m.start() + shift, m.end() + shift) for m in SPELLED.finditer(part)] if "@" in part or "at" in part.lower() else []
        ends, numbers = [q for _, q in own], []
        for start, stop in rows_of(part):
            for x, y in cut(part[start:stop], known):
                x, y = x + start + shift, y + start + shift
                k = bisect_right(ends, x)
                if len(_digits(text[x:y])) >= LEAST_DIGITS and (k == len(own) or own[k][0] >= y):
                    numbers.append((x, y))
        taken += own + numbers
    found += [Node(x, y, NONE, False, shape_of(text[x:y]), key_of(text[x:y]), text[x:y]) for x, y in taken]
    return sorted(found)


def similar(own: list[Node]) -> list[tuple[int, int]]:
    """Skip edges: each node with the one before it and the first one of its key."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    edges = []
    for k, node in enumerate(own):
        if node.key in first:
            edges.append((last[node.key], k))
            if first[node.key] != last[node.key]:
                edges.append((first[node.key], k))
        else:
            first[node.key] = k
        last[node.key] = k
    return edges


def suspects(texts: pa.Array) -> np.ndarray:
    """Texts with a digit, an at sign, or a spelled one: the others have neither spans nor candidates."""
    data, offsets = raw(texts)
    mark = (data >= 48) & (data <= 57) | (data == 64)
    spelled = np.zeros(len(data), bool)
    if len(data) > 3:
        low = data | 0x20
        spelled[:-3] = ((data[:-3] == 40) | (data[:-3] == 91)) & (low[1:-2] == 97) & (low[2:-1] == 116) & ((data[3:] == 41) | (data[3:] == 93))
    upto = np.concatenate([[0], np.cumsum(mark | spelled)])
    return np.flatnonzero(upto[offsets[1:]] > upto[offsets[:-1]])


# -- training -------------------------------------------------------------------------------------------------------------------


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for _, texts in slices(batches):
        for i in suspects(texts).tolist():
            text = texts[i].as_py()
            own = nodes(text, base_spans(text))
            counts.update(("shape", n.shape, n.label, 0) for n in own)
            counts.update(("chain", "", a.label, b.label) for a, b in zip(own, own[1:]))
            for x, y in similar(own):
                a, b = own[x], own[y]
                if a.surface == b.surface or a.fixed and b.fixed:  # else one of the labels is not known
                    counts["skip", "", a.label, b.label] += 1
    columns = list(zip(*(k for k in counts))) if counts else [[]] * 4
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
    yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(list(counts.values()), pa.int64())], ["what", "shape", "a", "b", "n"])


class Field(NamedTuple):
    """Log-potentials: of each shape with a label in the base, of other shapes, of chain and skip edges."""

    shapes: dict[str, np.ndarray]
    other: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(docs: DataFrame) -> Field:
    """Potentials from counts over all of ``docs`` (``text``)."""
    counts = docs.select("text").mapInArrow(_count_task, "what string, shape string, a int, b int, n long")
    counts = counts.groupBy("what", "shape", "a", "b").agg(F.sum("n").alias("n"))
    # Shapes that no base span has keep the prior: only the others are needed, and the base has few.
    labelled = counts.where("what = 'shape' AND a <> 0").select("shape").distinct()
    rows = counts.where("what <> 'shape'").unionByName(counts.where("what = 'shape'").join(labelled, "shape", "left_semi").select(*counts.columns)).collect()
    size = len(LABELS)
    shapes: dict[str, np.ndarray] = {}
    pairs = {"chain": np.zeros((size, size)), "skip": np.zeros((size, size))}
    for r in rows:
        if r["what"] == "shape":
            shapes.setdefault(r["shape"], np.zeros(size))[r["a"]] += r["n"]
        else:
            pairs[r["what"]][r["a"], r["b"]] += r["n"]
    chain = pairs["chain"] + pairs["chain"].T
    expected = np.outer(chain.sum(1), chain.sum(0)) / max(chain.sum(), 1)
    chain = np.clip(np.log((chain + CHAIN_PRIOR) / (expected + CHAIN_PRIOR)), -CHAIN_BOUND, CHAIN_BOUND)
    skip = pairs["skip"] + pairs["skip"].T + np.where(np.eye(size) > 0, AGREE, DIFFER)
    skip = skip / np.sqrt(np.outer(skip.diagonal(), skip.diagonal()))
    return Field({s: np.log((n + PRIOR) / (n + PRIOR).sum()) for s, n in shapes.items()}, np.log(PRIOR / PRIOR.sum()), chain, np.log(skip))


# -- inference ------------------------------------------------------------------------------------------------------------------


def marginals(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy belief propagation; ``potential``: a table of label pairs for each edge."""
    size = unary.shape[1]
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), size))

    def normal(x: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))

    def beliefs() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, target, message)
        return total

    for _ in range(ROUNDS if len(edges) else 0):
        out = (beliefs()[source] - message[back])[:, :, None] + table
        top = out.max(1, keepdims=True)
        new = normal((top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0, :])
        change = np.abs(np.exp(new) - np.exp(message)).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < STILL:
            break
    return np.exp(normal(beliefs()))


def added_spans(found: list[list[Node]], field: Field) -> list[list[Span]]:
    """Spans beyond the base, for each document's nodes; all documents are one graph without edges between them."""
    everything = [n for own in found for n in own]
    out: list[list[Span]] = [[] for _ in found]
    if all(n.fixed for n in everything):
        return out
    unary = np.stack([field.shapes.get(n.shape, field.other) for n in everything])
    for k, n in enumerate(everything):
        if n.fixed:
            unary[k] = np.where(np.arange(len(LABELS)) == n.label, 0.0, -60.0)
    edges, potential, at = [], [], 0
    for own in found:
        pairs = [(k, k + 1) for k in range(len(own) - 1)]
        skips = similar(own)
        edges += [(at + a, at + b) for a, b in pairs + skips]
        potential += [field.chain] * len(pairs) + [field.skip] * len(skips)
        at += len(own)
    tables = np.array(potential).reshape(-1, len(LABELS), len(LABELS))
    chance = marginals(unary, np.array(edges, np.int64).reshape(-1, 2), tables)
    at = 0
    for spans, own in zip(out, found):
        for k, n in enumerate(own):
            best = int(chance[at + k].argmax())
            if not n.fixed and best != NONE and chance[at + k, best] >= SURE:
                spans.append((best, n.begin, n.end))
        at += len(own)
    return out


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[label]}:{a}:{b}" for label, a, b in sorted(spans))


def searched(texts: pa.Array, field: Field) -> dict[int, tuple[list[Span], list[Span]]]:
    """Base and added spans of the texts of a slice that could have any."""
    at = suspects(texts).tolist()
    bases, found = [], []
    for i in at:
        text = texts[i].as_py()
        bases.append(base_spans(text))
        found.append(nodes(text, bases[-1]))
    return dict(zip(at, zip(bases, added_spans(found, field))))


def _span_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for rows, texts in slices(batches):
            found = searched(texts, shared.value)
            counts = np.zeros((len(LABELS), len(texts)), np.int64)
            hashed, spans, added = [nothing] * len(texts), [""] * len(texts), [0] * len(texts)
            for i, (base, more) in found.items():
                for label, _, _ in base:
                    counts[label, i] += 1
                hashed[i], spans[i], added[i] = hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(base + more), len(more)
            yield pa.record_batch(
                [rows.column("doc_id"), *(pa.array(c) for c in counts[1:]), pa.array(hashed), pa.array(spans), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def personal_spans(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(_span_task(shared), SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or stretch of overlapping ones, replaced by the kind of its first."""
    out, done = [], 0
    for begin, end, label in sorted((a, b, label) for label, a, b in spans):
        if begin >= done:
            out += [text[done:begin], f"[{LABELS[label].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _mask_task(shared, names: list[str], length: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found = {i: base + more for i, (base, more) in searched(texts, shared.value).items() if base or more}
            columns = {c: rows.column(c) for c in names}
            if found:
                changed = {i: masked(texts[i].as_py(), spans) for i, spans in found.items()}
                columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(columns["text"].to_pylist())], pa.string())
                if length:
                    columns[length] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[length].to_pylist())], pa.int64())
            yield pa.record_batch(list(columns.values()), names)

    return run


def redacted(docs: DataFrame, field: Field, length: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in ``text``; ``length`` names a column of code points to renew."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.mapInArrow(_mask_task(shared, docs.columns, length), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, with potentials counted over all documents."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return personal_spans(docs, train(docs))
