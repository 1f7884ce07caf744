"""License scans: an exact set-similarity join of text blocks with license notices.

Blocks are the lines of a text and its paragraphs (runs of lines with words).  What is
compared are sets of shingles, ``SHINGLE`` words in their order, so a block that merely
uses a notice's words is no match.  A template (a paragraph of a notice) is found in a
block that holds at least ``threshold`` of the template's distinct shingles.  Shingles
are ordered by how many documents of the corpus hold them, rarest first.  Then, exactly:

* prefix filter: a template of which ``need = ceil(threshold * size)`` shingles must be
  found shares one of its ``size - need + 1`` rarest with every such block, so an index
  of those alone proposes all candidates;
* length filter: a block with fewer than ``need`` shingles of any template cannot do;
* positional filter: with the first shared shingle at place i of the template and place
  j of the block, what is left behind both must still reach ``need``.

Only shingles of the templates can match, so frequencies are counted for those alone
(some thousand: a bound set by the templates, not by the data), over all documents.
Templates travel with the code; texts are never shuffled.

Beside the join, every place of a base phrase is counted in the word sequence of
the whole text.  The score is the greatest containment found, 1 for a base phrase.

Defined results: a null or empty text has no words, no places and score 0; rows
that share an id, or that have none, are scanned one by one; an empty table gives no
rows; other columns are not read, whatever their names.  A very long text costs its
words once; blocks are formed only where a template's shingle stands.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm.common import chunks, prepare, table, texts
from veriset.llm.license_texts import NOTICES

#: Base phrases and their labels (fixed by the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
SHINGLE, THRESHOLD = 3, 0.8
RESULT = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]


def templates_of(notices: list[tuple[str, str]], shingle: int = SHINGLE) -> list[tuple[str, list[bytes]]]:
    """``(label, words)`` of each paragraph that has a shingle."""
    out = []
    for label, text in notices:
        for paragraph in text.strip().split("\n\n"):
            words = paragraph.encode().translate(_FOLD).split()
            if len(words) >= shingle:
                out.append((label, words))
    return out


class Shingles:
    """Numbers of the templates' shingles, and where they stand in a sequence of words."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], k: int = SHINGLE) -> None:
        self.k = k
        self.words = {w: i for i, w in enumerate(sorted({w for _, words in templates for w in words}), 1)}
        self.base = len(self.words) + 1
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(self._codes(self._ids(words)) for _, words in templates)]))
        self.sets = [np.unique(self.at(words)[1]).tolist() for _, words in templates]

    def _ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in words], np.int64)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """One number for every run of k words; 0 stands in it for a word of no template."""
        n = max(0, len(ids) - self.k + 1)
        out = np.zeros(n, np.int64)
        for j in range(self.k):
            out = out * self.base + ids[j : j + n]
        return out

    def at(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places (first words) of the templates' shingles, and their numbers."""
        none = np.zeros(0, np.int64)
        ids = self._ids(words)
        if len(self.codes) == 0 or np.count_nonzero(ids) < self.k:
            return none, none
        codes = self._codes(ids)
        where = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        places = np.flatnonzero(self.codes[where] == codes)
        return places, where[places]


class TemplateIndex:
    """The templates' rarest shingles, by which blocks are probed."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], shingles: Shingles, frequency: dict[int, int], threshold: float = THRESHOLD) -> None:
        self.labels = [label for label, _ in templates]
        order = sorted(range(len(shingles.codes)), key=lambda s: (frequency.get(s, 0), s))
        self.rank = np.empty(len(order), np.int64)  # rarest first
        self.rank[order] = np.arange(len(order))
        self.templates: list[tuple[frozenset[int], int]] = []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}  # rank -> (template, place in its order)
        for t, members in enumerate(shingles.sets):
            ranks = sorted(self.rank[members].tolist())
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.templates.append((frozenset(ranks), need))
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefixes.setdefault(r, []).append((t, place))
        self.least = min((need for _, need in self.templates), default=1)

    def find(self, shingles: np.ndarray) -> dict[int, float]:
        """Template -> containment, for all templates that reach the threshold in a block with these shingles."""
        ranks = np.unique(self.rank[shingles]).tolist()
        out: dict[int, float] = {}
        if len(ranks) < self.least:
            return out
        seen: set[int] = set()
        have = frozenset(ranks)
        for at, r in enumerate(ranks):
            for t, place in self.prefixes.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared shingle of its prefix
                body, need = self.templates[t]
                if len(ranks) < need or 1 + min(len(body) - place - 1, len(ranks) - at - 1) < need:
                    continue
                if (shared := len(body & have)) >= need:
                    out[t] = shared / len(body)
        return out


def _blocks(body: bytes, places: np.ndarray, numbers: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The shingles of every line and paragraph that holds any."""
    counts = np.array([len(line.split()) for line in body.translate(_FOLD_LINES).split(b"\n")], np.int64)
    for owner in (np.arange(len(counts)), np.cumsum(counts == 0)):  # of a line: itself, its paragraph
        of_word = np.repeat(owner, counts)
        whole = of_word[places] == of_word[places + k - 1]
        owners, found = of_word[places[whole]], numbers[whole]
        yield from (x for x in np.split(found, np.flatnonzero(np.diff(owners)) + 1) if len(x))


def contained(body: bytes, words: list[bytes], shingles: Shingles, index: TemplateIndex) -> dict[int, float]:
    """Template -> its greatest containment in a block of the text, where that reaches the threshold."""
    places, numbers = shingles.at(words)
    best: dict[int, float] = {}
    if len(places) >= index.least:
        for block in _blocks(body, places, numbers, shingles.k):
            for t, share in index.find(block).items():
                best[t] = max(best.get(t, 0.0), share)
    return best


def _phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        last = phrase[-1]
        at = -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            start = at - len(phrase) + 1
            if start >= 0 and words[start : at + 1] == phrase:
                out.append((start, label))
    return out


def _count(batches: Iterator[pa.RecordBatch], shingles: Shingles) -> Iterator[pa.RecordBatch]:
    found: Counter[int] = Counter()
    for batch in chunks(batches):
        for body in batch.column(1).to_pylist():
            found.update(set(shingles.at(body.translate(_FOLD).split())[1].tolist()))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["shingle", "n"])


def frequencies(docs: DataFrame, shingles: Shingles, id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """In how many documents each shingle of the templates stands."""
    prepare(docs.sparkSession)
    counted = texts(docs, id_col, text_col).mapInArrow(lambda batches: _count(batches, shingles), "shingle long, n long")
    return {r.shingle: r.n for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}  # a row per shingle of the templates


def _scan(batches: Iterator[pa.RecordBatch], shingles: Shingles, index: TemplateIndex, phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    split = [(p.encode().split(), label) for p, label in phrases.items()]
    closing = [p[0][-1] for p in split]
    for batch in chunks(batches):
        rows = []
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded = body.translate(_FOLD)
            words = folded.split()
            places = _phrase_places(words, split) if any(c in folded for c in closing) else []
            best = contained(body, words, shingles, index)
            base = {label for _, label in places}
            labels = base | {index.labels[t] for t in best}
            starts = [s for s, _ in places]
            rows.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else max(best.values(), default=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document; see ``RESULT``.  ``labels`` holds the base labels and those of all templates found."""
    templates, phrases = templates_of(notices or NOTICES), phrases or PHRASES
    shingles = Shingles(templates)
    index = TemplateIndex(templates, shingles, frequencies(docs, shingles, id_col, text_col), threshold)
    return texts(docs, id_col, text_col).mapInArrow(lambda batches: _scan(batches, shingles, index, phrases), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can check: the places of base phrases."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, i - 1 AS start, CASE WHEN ws[i] = 'mit' AND ws[i + 1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i + 1] = 'license' THEN 'apache'
         WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl' END AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) x),
hit AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN hit USING (doc_id)
"""
