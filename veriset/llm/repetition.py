"""Quality rules from the suffix array of a text's words.

The suffixes of all texts in a slice are sorted together by prefix doubling: a
suffix's rank covers 1, 2, 4, ... words, and only suffixes that still share their
rank are sorted again, so ordinary prose is done after a few narrow rounds.  Texts
are kept apart by word numbers of their own.  The common prefix of neighbours in
the array gives the longest-common-prefix intervals; at each place the longest
prefix that occurs elsewhere in its text is the larger one of its two neighbours',
and the union of these spans is the union of all maximal repeated substrings.

A text fails if it is short, if repeats of ``base_words`` or more words cover more
than ``base_percent`` of it, if repeats of ``long_words`` or more cover more than
``long_percent``, or if one repeat is longer than ``longest_percent`` of it and
than ``long_words``.

Work is per text and per slice of bounded bytes: no shuffle, no state between
rows, so skew of any key does not matter.  A round keeps the ranks of those suffixes
alone that still shared theirs: beside some arrays of the text's words, memory grows
with the repeated part of a text, by its doublings.

Defined results: a null or empty text has no words and fails as too short; rows
that share an id, or that have none, are judged one by one; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veriset.llm.common import chunks, prepare, table, texts

RESULT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, longest_repeat long, long_repeat_words long"
SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_PERCENT, MIN_WORDS, LONG_WORDS, LONG_PERCENT, LONGEST_PERCENT = 8, 30, 20, 24, 25, 20


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Ranks of all suffixes, and for each doubling ``(h, places, ranks)`` of the suffixes that shared their first h / 2 words with others.

    ``words`` are numbers that no two texts share; ``ends[i]`` is where the text of
    place ``i`` ends.  Two places with the same rank at length h have the same h words;
    a place that is not among a round's has them for itself.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    leader = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = leader
    levels = []
    single = first & np.r_[first[1:], True]
    active = order[~single]
    h = 1
    while len(active):
        after = active + h
        inside = after < ends[active]
        following = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[active]
        by = np.lexsort((following, old))
        active, old, following = active[by], old[by], following[by]
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, following[1:] != following[:-1]]
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        part_at = np.maximum.accumulate(np.where(part, at, 0))
        fresh = old + part_at - group_at
        rank[active] = fresh
        h *= 2
        by = np.argsort(active)
        levels.append((h, active[by], fresh[by]))
        active = active[~(part & np.r_[part[1:], True])]
    return rank, levels


def _found(places: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the numbers stand among the ascending places, and whether they do."""
    at = np.minimum(np.searchsorted(places, x), len(places) - 1)
    return at, places[at] == x


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the most words from there that also start at another place of its text."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    rank, levels = suffix_ranks(words, ends)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    # Common prefix of neighbours: add the powers of two by which their ranks agree.
    a, b = array[:-1], array[1:]
    pairs = np.flatnonzero(words[a] == words[b])
    x, y = a[pairs].copy(), b[pairs].copy()
    stop_x, stop_y, common = ends[x], ends[y], np.zeros(len(pairs), np.int64)
    while levels:
        h, places, ranks = levels.pop()
        room = np.flatnonzero((x + h <= stop_x) & (y + h <= stop_y))
        at, known = _found(places, x[room])
        at2, known2 = _found(places, y[room])
        same = room[known & known2 & (ranks[at] == ranks[at2])]
        x[same] += h
        y[same] += h
        common[same] += h
    room = np.flatnonzero((x < stop_x) & (y < stop_y))
    common[room] += words[x[room]] == words[y[room]]
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a[pairs], common)
    np.maximum.at(out, b[pairs], common)
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Places within the union of the spans of at least ``least`` words."""
    n = len(repeats)
    starts = np.flatnonzero(repeats >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + repeats[starts], -1)
    return np.cumsum(change[:n]) > 0


def _dup_lines(body: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in body.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():  # of ASCII white space: a line with a word
            seen.add(line)
    return again


_SYMBOL_OR_BLANK = bytes(sorted(b" \t\n\x0b\x0c\r"))


def measures(bodies: list[bytes]) -> list[np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest, long_repeat_words`` of each text."""
    numbers: list[int] = []
    sizes, chars, symbols, lines = [], [], [], []
    base = 0
    for body in bodies:
        words = body.split()
        own: dict[bytes, int] = {}
        numbers.extend([own.setdefault(w, base + len(own)) for w in words])
        base += len(own)
        sizes.append(len(words))
        solid = body.translate(None, _SYMBOL_OR_BLANK)
        chars.append(len(solid) if solid.isascii() else len(solid.decode("utf-8")))
        symbols.append(len(body) - len(body.translate(None, SYMBOLS)))
        lines.append(_dup_lines(body))
    n = np.array(sizes, np.int64)
    stops = np.cumsum(n)
    repeats = longest_repeats(np.array(numbers, np.int64), np.repeat(stops, n))
    out = [n, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(lines, np.int64)]
    add = lambda marks: (c := np.r_[0, np.cumsum(marks)])[stops] - c[stops - n]
    longest = np.zeros(len(bodies), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        longest[full] = np.maximum.reduceat(repeats, (stops - n)[full])
    return [*out, add(covered(repeats, BASE_WORDS)), longest, add(covered(repeats, LONG_WORDS))]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        n, chars, symbols, lines, repeat, longest, long_repeat = measures(batch.column(1).to_pylist())
        failed = (n < MIN_WORDS) | (100 * repeat > BASE_PERCENT * n)
        method = (100 * long_repeat > LONG_PERCENT * n) | ((longest > LONG_WORDS) & (100 * longest > LONGEST_PERCENT * n))
        columns = [batch.column(0), *map(pa.array, (n, chars, symbols, lines, repeat, failed, ~(failed | method), longest, long_repeat))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "long_repeat_words"])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict of every row; see ``RESULT`` for its columns."""
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(lambda batches: _judge(batches), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can check: all but the method's verdict."""
    return query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d) x),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) x GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce(lines.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(inside.n, 0) > 30 * len(ws) AS base_failed
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN lines USING (doc_id)
"""
