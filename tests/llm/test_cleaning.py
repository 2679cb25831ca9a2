"""Quality rules, line dedup, toxicity, personal data and HTML against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilia.llm import html_text, line_runs, personal_data, quality_rules, textvec, toxicity

from .conftest import PROSE, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    marked = {i + d for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if windows[w] > 1 for d in range(3)}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_base(odd_docs, some_docs):
    for docs in (odd_docs, some_docs):
        got = [tuple(r)[:7] for r in quality_rules.quality_verdicts(docs).collect()]
        assert sorted(got, key=str) == sorted([(i, *base_of(t)) for i, t in pairs(docs)], key=str)


def test_quality_lines(odd_docs):
    kept = {r["doc_id"]: r for r in quality_rules.clean(odd_docs, "n_chars").collect()}
    assert kept[1]["text"] == PROSE and kept[21]["text"] == PROSE and kept[21]["n_chars"] == len(PROSE)
    assert not {5, 6, 7, 8, 22, 26} & set(kept)
    assert kept[1]["node"] == 0.5 and kept[1]["part"] == "p"


def test_labels_tell_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules.quality_verdicts(docs).join(labels, "doc_id").collect()
    assert all(r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


@pytest.mark.parametrize(("line", "failed"), [
    ("河は古い水車小屋のそばをゆっくりと流れていた。", False), ("河は古い" * 20, False), ("Он молчал…", False), ("« Bonjour »", False), ("ホーム", True), ("Contact us", True),
    ("Bake the cookies until they are golden.", False), ("The licensee shall pay the license fee to the board.", False), ("They sign in the presence of two witnesses.", False),
    ("The author holds the copyright in each work.", False), ("Released under the MIT License.", True), ("Licensed under CC BY-NC 4.0.", True), ("Copyright 2020 Foo.", True),
    ("Sign in to your account.", True), ("We use cookies to improve this page.", True), ("By reading on you agree to our terms of use and privacy policy.", True),
])
def test_clean_lines_stay(line, failed):
    assert quality_rules.LineRules(pa.array([PROSE + "\n" + line])).failed.tolist() == [False, failed]


def test_clean_documents_stay(spark):
    poem = "\n".join(f"第{i}章、河は古い水車小屋のそばをゆっくりと流れ、村の人は誰も知らなかった。" for i in range(60))
    law = "\n".join(f"Section {i} says that the licence of person {i * 7} ends after {i + 3} years." for i in range(20))
    kept = quality_rules.clean(spark.createDataFrame([(1, poem), (2, law)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: poem, 2: law}


def deduped(docs, least_chars, least_docs):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line)

    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < least_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("least_docs", "batches"), [(5, 4), (2, 7), (2, 1), (3, 3)])
def test_line_dedup(odd_docs, some_docs, least_docs, batches):
    for docs in (odd_docs, some_docs):
        got = line_runs.dedup_lines(docs, min_docs=least_docs, batches=batches)
        assert set(docs.columns) <= set(got.columns)
        rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(deduped(pairs(docs), 40, least_docs), key=str)


def test_runs_are_levelled(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    batches = [spark.createDataFrame([(d, h, h + 1) for h in range(50)], "doc_id long, h1 long, h2 long") for d in (9, 8, 7, 6, 5)]
    for batch in batches:
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = runs.repeated(5).collect()
    assert len(rows) == 50 and {r["keeper"] for r in rows} == {9}
    assert runs.repeated(6).count() == 0
    runs.release()


@pytest.fixture(scope="module")
def toxic_model(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.train(docs, labels)


@pytest.mark.parametrize(("noisy", "plain"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("iiidiooot", "idiot"),
                                              ("i.d.i.o.t", "idiot"), ("p@thet1c", "pathetic"), ("cl0wn", "clown"), ("wOrthl3ss", "worthless")])
def test_restoring(toxic_model, noisy, plain):
    assert toxicity.restore(noisy, toxic_model.chars) == plain


def test_viterbi_is_the_best_path(toxic_model):
    """The path found has the highest probability of all paths through the lattice."""
    log, n = toxic_model.chars.log, toxicity.N_SYMBOLS

    def paths(arcs, at, end):
        if at == end:
            yield "", 0.0
            return
        for to, letters, cost in arcs[at]:
            for rest, total in paths(arcs, to, end):
                yield letters + rest, cost + total

    def score(word, cost):
        s = [0, 0, *map(toxicity.symbol_of, word), 0]
        return cost + sum(log[(a * n + b) * n + c] for a, b, c in zip(s, s[1:], s[2:]))

    for noisy in ("1d10t", "t|1e", "heee11o", "a*b", "x.y.z", "$$$1"):
        best = max(score(w, c) for w, c in paths(toxicity.lattice(noisy), 0, len(noisy)))
        found = toxicity.restore(noisy, toxic_model.chars)
        assert max(score(w, c) for w, c in paths(toxicity.lattice(noisy), 0, len(noisy)) if w == found) == pytest.approx(best)


def test_trigrams(odd_docs):
    got = {r["trigram"]: r["n"] for r in toxicity.trigram_counts(odd_docs).collect()}
    want = Counter()
    for _, t in pairs(odd_docs):
        s = toxicity.SYMBOL[np.frombuffer((t or "").encode(), np.uint8)].tolist()
        want.update((a * toxicity.N_SYMBOLS + b) * toxicity.N_SYMBOLS + c for a, b, c in zip(s, s[1:], s[2:]))
    assert got == dict(want)


def test_disguised_words_score_like_plain_ones(spark, toxic_model):
    rows = [(1, "the idiot was there"), (2, "the 1d10t was there"), (3, "the i d i o t was there"), (4, "the iiidiot!!! was there"), (5, "the boat was there"), (6, ""), (7, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), toxic_model).collect()}
    assert got[1] == got[2] == got[3] == got[4] >= toxicity.THRESHOLD > got[5] == got[6] == got[7]


@pytest.mark.parametrize(("noisy", "plain"), [("m 0 r o n", "moron"), ("i d 1 o t", "idiot"), ("a m o r o n", "a moron"), ("m o r o n i d i o t", "moron idiot"),
                                              ("i i i d i o t", "idiot"), ("1 d ! o t", "idiot")])
def test_spaced_words_are_restored(toxic_model, noisy, plain):
    assert toxicity.read(pa.array([f"the {noisy}! was there"])).noisy == [noisy]
    assert toxicity.restore(noisy, toxic_model.chars) == plain


def test_spaced_runs():
    got = toxicity.read(pa.array(["what an a s s", "I a m o r o n", "A b", "c is 1 2 3 4 and * s h * t ! here", "", "x y"]))
    assert [(n, int(o)) for n, o in zip(got.noisy, got.owner)] == [("a s s", 0), ("i a m o r o n", 1), ("s h * t", 3)]


def test_spaced_words_score_like_plain_ones(spark, toxic_model):
    texts = ["you are a moron", "you are a m o r o n", "you are a m 0 r o n", "I m o r o n", "you are a moron idiot", "you are a m o r o n i d i o t", "a b c of it"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(rows, toxic_model).collect()}
    assert got[1] == got[2] == got[3] == got[0] >= toxicity.THRESHOLD > got[6] and got[5] == got[4]


def test_toxicity_held_out(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, toxic_model).join(labels, "doc_id").where(toxicity.held_out(labels["doc_id"])).select("score", "toxic").collect()
    wrong = sum((r["score"] >= toxicity.THRESHOLD) != (r["toxic"] == 1) for r in rows)
    assert wrong <= 0.08 * len(rows)  # a part of the labels is noise


def test_toxicity_awkward(odd_docs, no_docs, toxic_model, spark):
    assert toxicity.toxicity(odd_docs, toxic_model).count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxicity.train(docs, labels)
        assert {r["score"] for r in toxicity.toxicity(docs, model).collect()} <= {0.0}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_pattern(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and personal_data.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((personal_data.LABELS.index(kind), m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890.@+-() %_é", max_size=60))
def test_base_spans(text):
    assert sorted(personal_data.base_spans(text)) == sorted(base_by_pattern(text))


def test_personal_spans(spark, odd_docs, some_docs):
    for docs in (odd_docs, some_docs):
        field = personal_data.train(docs)
        want = []
        for i, t in pairs(docs):
            base = base_by_pattern(t or "")
            count = Counter(k for k, _, _ in base)
            want.append((i, count[1], count[2], count[3], count[4], hashlib.sha256(personal_data.rendered(base).encode()).hexdigest()))
        rows = personal_data.personal_spans(docs, field).collect()
        assert sorted([tuple(r)[:6] for r in rows], key=str) == sorted(want, key=str)


def test_repeated_notation_is_found_and_numbers_alone_are_not(spark, some_docs):
    field = personal_data.train(some_docs)
    text = "card 4111 1111 1111 1111, again 4111.1111.1111.1111; a.b@c.example.com is a.b (at) c.example (dot) com"
    alone = "order 9807915762804490 and 9807915762804490, on 2023-10-12 12:00, version 1.2.3"
    rows = personal_data.personal_spans(spark.createDataFrame([(1, text), (2, alone)], "doc_id long, text string"), field).collect()
    spans = {r["doc_id"]: [text[int(p.split(":")[1]) : int(p.split(":")[2])] for p in r["spans"].split(",") if p] for r in rows}
    assert spans[1] == ["a.b@c.example.com", "a.b (at) c.example (dot) com", "4111 1111 1111 1111", "4111.1111.1111.1111"]
    assert spans[2] == []


def surfaces(text):
    return [text[n.begin : n.end] for n in personal_data.nodes(text, personal_data.base_spans(text)) if not n.fixed]


@pytest.mark.parametrize(("row", "numbers"), [
    ("4111.1111.1111.1111 5500.0000.0000.0004", ["4111.1111.1111.1111", "5500.0000.0000.0004"]),
    (" ".join(["4111.1111.1111.1111"] * 4), ["4111.1111.1111.1111"] * 4), ("-".join(["4111-1111-1111-1111"] * 40), ["4111-1111-1111-1111"] * 40),
    ("555-123-4567 555-234-5678", ["555-123-4567", "555-234-5678"]), ("(555) 123-4567 (555) 234-5678", ["(555) 123-4567", "(555) 234-5678"]),
    ("1 555 123 4567 1 555 234 5678", ["1 555 123 4567", "1 555 234 5678"]), ("tel=555-123-4567 and '555.234.5678'", ["555-123-4567", "555.234.5678"]),
    ("1990 1991 1992 1993 1994 1995", ["1990 1991 1992 1993 1994 1995"]), ("12-34-" * 50 + "56", ["12-34-" * 50 + "56"]),
    ("555-123-4567 89x", ["555-123-4567"]), ("555-123-4567-89x", []), ("1234567 7654321", ["1234567", "7654321"]),
])
def test_rows_of_numbers_are_cut(row, numbers):
    assert surfaces(row) == numbers


def test_known_numbers_are_cut_out_of_rows(spark, some_docs):
    assert surfaces("+44 20 7946 0958; row 17-20.7946.0958-81") == ["20.7946.0958"]
    assert surfaces("+1 (988) 555-2485; row 17.98855.52485.81-" + "12.34-" * 20 + "5")[:2] == ["98855.52485", "81-" + "12.34-" * 20 + "5"]
    field = personal_data.train(some_docs)
    text = "4111 1111 1111 1111, 5500 0000 0000 0004; 4111.1111.1111.1111 5500.0000.0000.0004 " + "4111.1111.1111.1111 " * 3 + "id='5500.0000.0000.0004'"
    row = personal_data.personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()[0]
    assert (row["n_card"], row["n_added"]) == (2, 6)


def test_long_rows_take_linear_time():
    began = time.perf_counter()
    for row in ("7 " * 200_000, "1234 " * 80_000, "4111-" * 80_000 + "x", "(1" * 100_000, "12 x " * 80_000):
        personal_data.nodes("4111 1111 1111 1111; " + row, [(3, 0, 19)])
    assert time.perf_counter() - began < 20


def test_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(3)
    unary, edges = rng.normal(size=(5, 5)), np.array([(0, 1), (1, 2), (1, 3), (3, 4)])
    tables = rng.normal(size=(4, 5, 5))
    got = personal_data.marginals(unary, edges, tables)
    joint = np.zeros([5] * 5)
    for labels in np.ndindex(*joint.shape):
        joint[labels] = np.exp(sum(unary[k, x] for k, x in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, tables)))
    for k in range(5):
        exact = joint.sum(tuple(j for j in range(5) if j != k))
        assert got[k] == pytest.approx(exact / exact.sum(), abs=1e-4)


def test_masking(odd_docs):
    field = personal_data.train(odd_docs)
    rows = {r["doc_id"]: r for r in personal_data.redacted(odd_docs, field, "n_chars").collect()}
    assert rows[27]["text"] == "mail [EMAIL] or [PHONE] at [IP] with [CARD]" and rows[27]["n_chars"] == len(rows[27]["text"])
    assert rows[1]["text"] == PROSE and rows[1]["n_chars"] == -1 and rows[5]["text"] is None


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.found.append(data)


def test_pages_hold_all_visible_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_text.extracted(pages).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(html)
    for r in rows:
        parser = Visible()
        parser.feed(html[r["page_id"]])
        parser.close()
        assert "".join("".join(parser.found).split()) == "".join(re.sub(r"(?m)^\s*- ", "", r["text"]).split())


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("<b>a</b> <i>b</i>c", "a bc"), ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>", "- x\n- y\n  3. q\n  4. r\n- z"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one<td>d</table>", "a  b\n   c\nwide one  d"),
    ("x<script>if (a < b) '</p>'</script>y<style>p{}</style><div hidden>n<p>n</div><p style='display: none'>n</p>z", "xyz"),
    ("<pre>a  b\n c</pre>", "a  b\n c"), ("1 < 2 &amp; 3 &lt; 4", "1 < 2 & 3 < 4"), ("<head><title>T</title></head>body<!-- c -->x", "bodyx"), ("a<p", "a"),
    ("<p>a</div>b</p>", "ab"), ("</p>a", "a"), ("<select><option>a<option>b</select>", "a\nb"), ("<blockquote>a<p>b</blockquote>c", "  a\n\n  b\n\nc"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<table>" * 300 + "<tr><td>cell", "cell"),
])
def test_layout(html, text):
    assert html_text.page_text(html or "")[1] == text


@pytest.mark.parametrize(("html", "text"), [
    ("<p title=John's>one two</p><p>don't three</p>", "one two\n\ndon't three"), ('<a href="x"">one</a>', "one"), ("<p it's>a</p>b", "a\n\nb"),
    ("<p title='a>b'>c</p>", "c"), ('<p title = "a>b" id=x>c</p>', "c"), ('<a href=x?y="1>2</a>', "2"), ('<p ="a>b</p>', "b"), ('<p title="open>a</p>b', "a\n\nb"),
    ("<p title=a'b hidden>n</p>c", "c"), ('<p title="style=" style="display:none">n</p>c', "c"), ("a<p title='x", "a"),
])
def test_quotes_in_tags(html, text):
    assert html_text.page_text(html)[1] == text


@pytest.mark.parametrize("deep", ["<i>" * 250, "<div>" * 250, "<i>" * 199])
@pytest.mark.parametrize(("html", "text"), [
    ("a<span hidden>n<b>n</b>n</span>b", "ab"), ("a<div style='display:none'>n<p>n</div>b", "a\nb"), ("<div>a</div>b", "a\nb"),
    ("<b hidden>n<b>n</b>n</b>a", "a"), ("<svg><p>n</svg>a<br>b", "a\nb"), ("a<span hidden>n<script>n</script></span></i>b", "ab"),
])
def test_past_the_depth(deep, html, text):
    assert html_text.page_text(deep + html)[1] == text


def test_end_tags_past_the_depth_close_what_they_opened():
    assert html_text.page_text("<div hidden>" + "<i>" * 250 + "<div>n</div>n</div>a")[1] == "a"


def test_pages_awkward(spark):
    rows = [(1, None, "x"), (None, "<p>a", None), (2, "<title>T &amp; U</title><p>b", "y"), (2, "<title>T &amp; U</title><p>b", "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted([(r["page_id"], r["title"], r["text"], r["n_lines"]) for r in html_text.extracted(pages).collect()], key=str)
    assert got == sorted([(1, None, "", 0), (None, None, "a", 1), (2, "T & U", "b", 1), (2, "T & U", "b", 1)], key=str)
    assert html_text.extracted(pages.limit(0)).collect() == []


def test_empty_tables(no_docs):
    assert quality_rules.quality_verdicts(no_docs).collect() == [] == quality_rules.clean(no_docs).collect()
    assert line_runs.dedup_lines(no_docs).collect() == []
    assert personal_data.personal_spans(no_docs, personal_data.train(no_docs)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0béA", max_size=12), min_size=1, max_size=6))
def test_words_and_lines(texts):
    column = pa.array(texts)
    for spans, want in ((textvec.words(column), [WORD.findall(t) for t in texts]), (textvec.lines(column), [t.split("\n") for t in texts])):
        data = bytes(spans.data)
        assert [[data[b:e].decode() for b, e, t in zip(spans.begin, spans.end, spans.text) if t == i] for i in range(len(texts))] == want
        hashed = textvec.hashes(spans)
        by_hash = {(int(h)): data[b:e] for h, b, e in zip(hashed, spans.begin, spans.end)}
        assert all(by_hash[int(h)] == data[b:e] for h, b, e in zip(hashed, spans.begin, spans.end))
        assert len(by_hash) == len(set(by_hash.values()))
