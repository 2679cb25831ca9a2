"""Line-first cleaning: punctuation, navigation and boilerplate rules per line, then a verdict on the document.

A line with a word fails if it is mostly symbols or shouting (punctuation), a row of separated items or a short label
without an end mark of any script (navigation), or a notice such as a licence or cookie line (boilerplate): a whole phrase of
notices, two other phrases, or one that begins the line and is a third of its words. A word in passing is no notice. Failing lines are removed;
a document that loses more than ``MAX_LOST`` percent of its word characters is rejected, as is one that fails the base
rules (too few words, or mostly repeated three-word windows). All comparisons are between whole numbers, so the verdict
does not depend on rounding. Statistics are computed on byte arrays, a few megabytes at a time. The SQL counterpart knows only the
shorter rules for ASCII (any last character but an ASCII end mark, any phrase anywhere): on the test tables they give the same.

Null and empty texts have no words and fail the base rules; every row, repeated or with a null id, gets its own verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .textvec import Spans, code_points, hashes, lines, mixed, slices, windows, words

MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 30
MAX_SYMBOLS, MIN_MARKS, MIN_SEPARATORS, SEPARATED, LABEL_WORDS, NOTICE_WORDS = 10, 3, 3, 30, 3, 40
SYMBOLS, MARKS, SEPARATORS, END_MARKS = "#*$%&|<>", "!", "|>", ".!?:;,\"')"
#: Longest label in code points; end marks beyond ASCII.
LABEL_CHARS, MORE_END_MARKS = 40, "。．！？；：，、…‥」』）】》〉”’»›।॥؟؛،۔።։‽⁈⁉｡､"
# Phrases that only notices have, and those that count by their place or in pairs, by their number of words.
LICENCES = r"(?:apache|mit|bsd|isc|gnu|a?gpl|lgpl|mpl|mozilla|eclipse|cc0|cc[ -]by|creative commons|unlicen[sc]e|open[ -]source|public domain)"
WHOLE_NOTICES = "|".join([
    r"\ball rights reserved\b", r"\blorem ipsum\b", rf"\bunder (?:the |an? )?(?:terms of (?:the |an? )?)?{LICENCES}\b",
    r"\bcopyright (?:\(c\)|©|[0-9]{4})", r"\b(?:we|site|website|page|service|app) uses? cookies\b", r"\baccept (?:all )?cookies\b",
    r"\bcookie (?:policy|settings|preferences|notice|consent)\b", r"\bplease enable javascript\b", r"\benable javascript (?:to|in)\b",
])
PLACED_NOTICES = {1: "copyright|subscribe", 2: "click here|sign in|sign up|privacy policy|enable javascript", 3: "terms of service|terms of use"}
_PLACED = rf"\b(?:{'|'.join(PLACED_NOTICES.values())})\b"
# The phrases of the SQL counterpart, lower case.
NOTICES = [
    "all rights reserved", "click here", "cookie", "copyright", "enable javascript", "license", "licence", "lorem ipsum", "privacy policy",
    "sign in", "sign up", "subscribe", "terms of service", "terms of use",
]
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"{STATS}, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_chars long"


def _among(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def ends_with(data: np.ndarray, end: np.ndarray, marks: str) -> np.ndarray:
    """Whether the UTF-8 bytes before each place end in one of the marks."""
    out = np.zeros(len(end), bool)
    for size in {len(c.encode()) for c in marks}:
        tail = np.zeros(len(end), np.int64)
        for back in range(size, 0, -1):
            tail = tail << 8 | np.where(end >= back, data[np.maximum(end - back, 0)], 0)
        out |= np.isin(tail, [int.from_bytes(c.encode()) for c in marks if len(c.encode()) == size])
    return out


def repeated_words(hashed: np.ndarray, word: Spans) -> np.ndarray:
    """Words of each text in three-word windows found twice or more in it."""
    window, first = windows(hashed, word.bounds(), 3)
    _, inverse, count = np.unique(mixed(window ^ mixed(word.text[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    inside = np.zeros(len(hashed) + 3, bool)
    for i in range(3):
        inside[first[count[inverse] > 1] + i] = True
    return np.bincount(word.text[inside[: len(hashed)]], minlength=len(word.offsets) - 1)


class LineRules:
    """Statistics of the texts of one slice, by text and by line, and the lines that fail."""

    def __init__(self, texts: pa.Array) -> None:
        self.word, self.line = words(texts), lines(texts)
        data, n = self.word.data, len(texts)
        chars = code_points(data, self.word.begin, self.word.end)
        self.n_words = self.word.per_text()
        self.word_chars = np.bincount(self.word.text, chars, n).astype(np.int64)
        symbols = _running(_among(SYMBOLS)[data])
        self.n_symbols = symbols[self.word.offsets[1:]] - symbols[self.word.offsets[:-1]]
        self.n_repeat_words = repeated_words(hashes(self.word), self.word)

        at = np.searchsorted(self.word.begin, self.line.begin), np.searchsorted(self.word.begin, self.line.end)
        upto = _running(chars)
        self.line_words, self.line_chars = at[1] - at[0], upto[at[1]] - upto[at[0]]
        some = self.line_words > 0
        self.n_dup_lines = self._duplicates(some, n)

        def within(table_of: str) -> np.ndarray:
            count = _running(_among(table_of)[data])
            return count[self.line.end] - count[self.line.begin]

        marks, separators = within(MARKS), within(SEPARATORS)
        ended = np.zeros(len(some), bool)
        ended[some] = ends_with(data, self.word.end[at[1][some] - 1], END_MARKS + MORE_END_MARKS)
        punctuation = (100 * within(SYMBOLS) > MAX_SYMBOLS * self.line_chars) | (marks >= MIN_MARKS) & (2 * marks > self.line_words)
        navigation = (separators >= MIN_SEPARATORS) & (100 * separators >= SEPARATED * self.line_words)
        navigation |= (self.line_words <= LABEL_WORDS) & (self.line_chars <= LABEL_CHARS) & ~ended
        self.failed = some & (punctuation | navigation | self._notices(texts))

    def _duplicates(self, some: np.ndarray, n: int) -> np.ndarray:
        own = Spans(self.line.data, self.line.begin[some], self.line.end[some], self.line.text[some], self.line.offsets)
        key = mixed(hashes(own) ^ mixed(own.text.astype(np.uint64)))
        first = np.unique(key, return_index=True)[1]
        return np.bincount(own.text, minlength=n) - np.bincount(own.text[first], minlength=n)

    def _notices(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(self.line.begin), bool)

        def found(where: pa.Array, pattern: str) -> np.ndarray:
            return pc.match_substring_regex(where, pattern, ignore_case=True).to_numpy(zero_copy_only=False)

        hit = found(texts, f"{WHOLE_NOTICES}|{_PLACED}")
        near = np.flatnonzero(hit[self.line.text] & (self.line_words > 0) & (self.line_words <= NOTICE_WORDS))
        if len(near):
            own = pa.array([bytes(self.line.data[b:e]).decode() for b, e in zip(self.line.begin[near], self.line.end[near])], pa.string())
            out[near] = found(own, f"{WHOLE_NOTICES}|{_PLACED}.*{_PLACED}")
            for size, phrases in PLACED_NOTICES.items():
                out[near] |= (self.line_words[near] <= 3 * size) & found(own, rf"^\W*(?:{phrases})\b")
        return out

    def verdicts(self) -> dict[str, np.ndarray]:
        n = len(self.n_words)
        lost = np.bincount(self.line.text, self.line_chars * self.failed, n).astype(np.int64)
        base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT * self.n_words)
        return {
            "n_words": self.n_words, "word_chars": self.word_chars, "n_symbols": self.n_symbols, "n_dup_lines": self.n_dup_lines,
            "n_repeat_words": self.n_repeat_words, "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= MAX_LOST * self.word_chars),
            "n_lines": np.bincount(self.line.text, minlength=n), "n_failed_lines": np.bincount(self.line.text[self.failed], minlength=n), "lost_chars": lost,
        }


def _verdict_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        found = LineRules(texts).verdicts()
        yield pa.record_batch([rows.column("doc_id"), *(pa.array(v if v.dtype == bool else v.astype(np.int64)) for v in found.values())], ["doc_id", *found])


def _clean_task(names: list[str], length: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            rules = LineRules(texts)
            kept = rules.verdicts()["kept"]
            cleaned, bounds = [], rules.line.bounds()
            for i, text in enumerate(texts.to_pylist()):
                failed = rules.failed[bounds[i] : bounds[i + 1]]
                cleaned.append("\n".join(x for x, out in zip(text.split("\n"), failed) if not out) if failed.any() else text)
            columns = [rows.column(c) for c in names]
            columns[names.index("text")] = pa.array(cleaned, pa.string())
            if length:
                columns[names.index(length)] = pa.array([len(x) for x in cleaned], pa.int64())
            yield pa.record_batch(columns, names).filter(pa.array(kept))

    return run


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (``doc_id``, ``text``)."""
    return docs.select("doc_id", "text").mapInArrow(_verdict_task, SCHEMA)


def clean(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The kept rows with all their columns, failing lines removed from ``text``; ``length`` names a column of code points to renew."""
    return docs.mapInArrow(_clean_task(docs.columns, length), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_verdicts(configure(spark).read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts),
measured AS (
  SELECT r, k, line, len(ws) AS w, coalesce(length(array_to_string(ws, '')), 0) AS c, ws[-1][-1] AS last,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!]', '', 'g')) AS marks,
    length(regexp_replace(line, '[^|>]', '', 'g')) AS separators
  FROM (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM split)),
judged AS (
  SELECT *, w > 0 AND (100 * symbols > {MAX_SYMBOLS} * c OR (marks >= {MIN_MARKS} AND 2 * marks > w)
      OR (separators >= {MIN_SEPARATORS} AND 100 * separators >= {SEPARATED} * w)
      OR (w <= {LABEL_WORDS} AND NOT contains('{END_MARKS.replace("'", "''")}', last))
      OR (w <= {NOTICE_WORDS} AND regexp_matches(line, '{"|".join(NOTICES)}', 'i'))) AS failed
  FROM measured),
by_text AS (
  SELECT r, count(*) AS n_lines, count_if(failed) AS n_failed_lines, sum(w)::BIGINT AS n_words, sum(c)::BIGINT AS word_chars,
    sum(symbols)::BIGINT AS n_symbols, coalesce(sum(c) FILTER (failed), 0)::BIGINT AS lost_chars,
    count(*) FILTER (w > 0) - count(DISTINCT line) FILTER (w > 0) AS n_dup_lines
  FROM judged GROUP BY r),
listed AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM texts),
word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM listed),
triple AS (
  SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM triple WHERE z IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS s(d) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept,
  n_lines, n_failed_lines, lost_chars
FROM texts JOIN by_text USING (r) LEFT JOIN repeated USING (r)
"""
