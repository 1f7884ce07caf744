"""Toxicity from a learned lexicon, matched through Levenshtein automata and weighed by context.

Learning.  Labelled rows outside the held-out third (crc32 of the id as text,
modulo 3, is 1) give at most ``SAMPLE`` documents of each class, by the order of
a hash of their ids: a stated bound, so this small table may be broadcast.  One half of
them yields the lexicon: words, and word beginnings of 4 to 8 signs, that stand in
far more toxic documents than clean ones; all of them are used, so the lexicon is
bounded by the sample alone.  The other half fits the weights of a logistic model over
a dozen features.  Only the text is ever scored.

Matching.  The lexicon is a trie; its intersection with the automaton of the edit
distance (signs too many, too few or exchanged, and neighbours that changed places) is
made deterministic lazily: a state is a set of (trie node, edits, sign still awaited),
each step is one dictionary lookup, and most words of ordinary text die within a few
signs.  The distance allowed grows with a term's length (``EDITS``).  What stands under
a beginning too short for edits is kept as a term of its own.

Context.  Within ``AROUND`` words a hit between a pair of quotation marks, or near a
verb of report, counts as quoted; a hit near a word of address as aimed at somebody.
Both word lists are parameters of ``fit``.  The model weighs plain, misspelled, quoted
and aimed hits apart.

Rows are scored where they lie, so no key can be skewed.

Defined results: a null or empty text has no hits and the score that the model
gives to that; rows that share an id are scored one by one; null labels and null
ids teach nothing, and an id labelled both ways teaches both; without a toxic or a
clean row to learn from all scores are 0; an empty table gives no rows; other columns
are not read, and ``keep_clean`` passes them through, whatever their names.  A very
long text costs its words and one entry for each hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm.common import chunks, prepare, table, texts
from veriset.llm.tokens import release
from veriset.plans.scratch import Scratch

SAMPLE, MIN_ODDS, AROUND, THRESHOLD = 4000, 2.5, 8, 0.7
PREFIXES = range(4, 9)
#: Signs of a word or a word beginning from which on so many edits are allowed.
EDITS = {5: 1, 10: 2}
LEAST_EDITED, MOST_EDITS = min(EDITS), max(EDITS.values())
PUNCTUATION = ".,;:!?\"'()[]{}<>|*_-–—…«»“”„‘’‚`#%&$~"
#: Quotation marks, and what closes each.
QUOTES = {'"': '"', "'": "'", "«": "»", "»": "«", "“": "”", "„": "“”", "‘": "’", "‚": "‘"}
CLOSING = "".join(QUOTES.values())
STOPS = ".,;:!?…"
#: Verbs of report and words of address, in the corpus's languages.
REPORT = frozenset("said says wrote quote quoted called dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your you're u du dich dir dein tu te vous toi tú usted ustedes vosotros".split())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Lexicon:
    """Terms with their log odds; a term that ends in ``*`` is the beginning of a word."""

    terms: list[str]
    odds: list[float]
    report: frozenset[str] = REPORT
    address: frozenset[str] = ADDRESS
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    begins: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, term in enumerate(self.terms):
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.begins if term.endswith("*") else self.ends)[node] = k


def allowed(term: str) -> int:
    """Edits that a term takes, by its signs."""
    n = len(term.removesuffix("*"))
    return max((e for least, e in EDITS.items() if n >= least), default=0)


class Automaton:
    """The lexicon's trie intersected with the edit distance, made deterministic as words ask for it.

    An item ``(node, edits, sign)`` that awaits a sign has read the second of two
    neighbours that changed places; the next sign must be the first.
    """

    def __init__(self, lexicon: Lexicon) -> None:
        self.lex = lexicon
        self.edits = [allowed(t) for t in lexicon.terms]
        self.reach = [0] * len(lexicon.children)  # the most edits that any term through a node takes
        for k, term in enumerate(lexicon.terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.edits[k])
            for c in term.removesuffix("*"):
                node = lexicon.children[node][c]
                self.reach[node] = max(self.reach[node], self.edits[k])
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.begin: list[int] = []  # the word beginning that a state completes, or -1
        self.near: list[int] = []  # the same with edits
        self.final: list[tuple[int, int]] = []  # term and edits if a word ends here
        self.start = self._number(self._closed({(0, 0, "")}))
        self.dead = self._number(frozenset())

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With the items that signs left out lead to; without those that no term takes."""
        open_ = [x for x in items if x[1] <= self.reach[x[0]]]
        out = set(open_)
        while open_:
            node, e, sign = open_.pop()
            if not sign and e < MOST_EDITS:
                for child in self.lex.children[node].values():
                    item = (child, e + 1, "")
                    if e < self.reach[child] and item not in out:
                        out.add(item)
                        open_.append(item)
        return frozenset(x for x in out if x[2] or not any((x[0], e, "") in out for e in range(x[1])))

    def _number(self, items: frozenset) -> int:
        if items in self.numbers:
            return self.numbers[items]
        lex = self.lex
        self.numbers[items] = n = len(self.states)
        self.states.append(items)
        self.moves.append({})
        whole = [(node, e) for node, e, sign in items if not sign]
        self.begin.append(next((lex.begins[node] for node, e in whole if not e and node in lex.begins), -1))
        self.near.append(min((lex.begins[node] for node, e in whole if e and node in lex.begins and e <= self.edits[lex.begins[node]]), default=-1))
        exact = [lex.ends[node] for node, e in whole if not e and node in lex.ends]
        near = [(e, lex.ends[node]) for node, e in whole if e and node in lex.ends and e <= self.edits[lex.ends[node]]]
        self.final.append((min(exact), 0) if exact else min(near)[::-1] if near else (-1, 0))
        return n

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        children = self.lex.children
        for node, e, sign in self.states[state]:
            if sign:
                if sign == c:
                    out.add((node, e, ""))
                continue
            below = children[node]
            if c in below:
                out.add((below[c], e, ""))
            if e < self.reach[node]:
                out.add((node, e + 1, ""))  # a sign too many
                for other, child in below.items():
                    if other != c:
                        out.add((child, e + 1, ""))  # another sign
                        if c in children[child]:
                            out.add((children[child][c], e + 1, other))  # neighbours changed places
        self.moves[state][c] = n = self._number(self._closed(out))
        return n

    def match(self, word: str) -> tuple[int, int]:
        """``(term, kind)``: kind 1 exact, 2 word beginning, 3 either with edits, 0 nothing."""
        state, begin, near = self.start, -1, -1
        for c in word:
            if begin < 0:
                begin = self.begin[state]
            if near < 0:
                near = self.near[state]
            nxt = self.moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.dead:
                break
        else:
            term, edits = self.final[state]
            if term >= 0 and not edits:
                return term, 1
            if begin < 0:
                begin = self.begin[state]
            if begin < 0 and term >= 0:
                return term, 3
            if near < 0:
                near = self.near[state]
        return (begin, 2) if begin >= 0 else (near, 3) if near >= 0 else (-1, 0)


N_FEATURES = 10


def quoted(words: list[str], i: int) -> bool:
    """Whether word i stands between a pair of quotation marks, both within ``AROUND`` words of it."""
    for j in range(i, max(-1, i - AROUND - 1), -1):
        if j < i and words[j].rstrip(STOPS)[-1:] in CLOSING and words[j].rstrip(STOPS):
            return False  # what was opened before is closed again
        if closing := QUOTES.get(words[j].lstrip("([")[:1]):
            return any(w.rstrip(STOPS + ")]")[-1:] in closing for w in words[i : i + AROUND + 1] if w.rstrip(STOPS + ")]"))
    return False


class Matcher:
    """Features of texts, with a bounded memory of words already matched."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000) -> None:
        self.lex, self.automaton, self.most = lexicon, Automaton(lexicon), most
        self.known: dict[str, tuple[int, int] | int] = {}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(place, term, kind)`` of every hit."""
        values = list(map(self.known.get, words))
        absent = [i for i, v in enumerate(values) if v is None]
        if absent:
            if len(self.known) > self.most:
                self.known = {}
            match, known = self.automaton.match, self.known
            for i in absent:
                w = words[i]
                v = known.get(w)
                if v is None:
                    found = match(w.strip(PUNCTUATION))
                    known[w] = v = found if found[1] else 0
                values[i] = v
        return [(i, *v) for i, v in enumerate(values) if v]

    def features(self, text: str) -> np.ndarray:
        words = text.lower().split()
        out = np.zeros(N_FEATURES)
        hits = self.hits(words)
        if not hits:
            return out
        report, address = self.lex.report, self.lex.address
        plain = fuzzy = cited = aimed = 0
        top = top_fuzzy = total = 0.0
        for i, term, kind in hits:
            before, after = words[max(0, i - AROUND) : i + 1], words[i : i + AROUND + 1]
            if not report.isdisjoint(before) or not report.isdisjoint(after) or quoted(words, i):
                cited += 1
                continue
            aimed += not address.isdisjoint(before) or not address.isdisjoint(after)
            odds = self.lex.odds[term]
            if kind == 3:
                fuzzy, top_fuzzy = fuzzy + 1, max(top_fuzzy, odds)
            else:
                plain, top, total = plain + 1, max(top, odds), total + odds
        out[:] = (np.log1p(plain), np.log1p(fuzzy), np.log1p(cited), np.log1p(aimed), top, top_fuzzy, np.log1p(total), plain > 0, np.log1p(len({t for _, t, _ in hits})), 100 * plain / len(words))
        return out


def _terms(text: str) -> set[str]:
    words = {w.strip(PUNCTUATION) for w in text.lower().split()}
    words = {w for w in words if len(w) >= 3 and not any(c.isdigit() for c in w)}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in chunks(batches):
        for body, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found[toxic].update(_terms(body.decode("utf-8")))
    terms = list(found[0] | found[1])
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[1][t] for t in part], pa.int64()), pa.array([found[0][t] for t in part], pa.int64())], names=["term", "toxic", "clean"])


def choose_terms(rows: list[tuple[str, int, float]]) -> tuple[list[str], list[float]]:
    """Of ``(term, toxic documents, log odds)`` the terms that say something of their own.

    Most frequent first and longest first; a beginning adds nothing to a word that
    stands in nearly as many documents, nor a longer term to a chosen beginning - but
    for one too short for edits: terms under it are kept for their misspellings.
    """
    chosen: dict[str, tuple[int, float]] = {}
    reach: dict[str, int] = {}  # any beginning of a chosen term -> its documents
    for term, n, odds in sorted(rows, key=lambda r: (-r[1], r[0].endswith("*"), -len(r[0]), r[0])):
        stem = term.removesuffix("*")
        if any(stem[:k] + "*" in chosen for k in range(LEAST_EDITED, len(stem) + 1)) or n <= 1.1 * reach.get(stem, 0):
            continue
        under = any(stem[:k] + "*" in chosen for k in range(1, min(LEAST_EDITED, len(stem) + 1)))
        if under and len(stem) < LEAST_EDITED:
            continue
        chosen[term] = (n, odds)
        for k in range(1, len(stem) + 1):
            reach[stem[:k]] = max(reach.get(stem[:k], 0), n)
    return list(chosen), [o for _, o in chosen.values()]


def fit_weights(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the intercept) and scales of a logistic model, by Newton's method."""
    scale = np.maximum(x.std(0), 1e-6)
    a = np.c_[x / scale, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.diag(np.r_[np.full(x.shape[1], l2), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    scale: np.ndarray
    blank: bool = False  # nothing to learn from

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.blank:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    release()
    matcher = Matcher(lexicon)
    for batch in chunks(batches):
        x = [matcher.features(b.decode("utf-8")).tolist() for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["x", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", report: frozenset[str] = REPORT, address: frozenset[str] = ADDRESS) -> Model:
    """Learn from at most ``sample`` labelled rows of each class that are not held out.

    ``report`` and ``address`` are the verbs and words by which quoted and aimed hits are told.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    by_hash = lambda c: usable.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample)
    taught = scratch.cut(by_hash(0).unionByName(by_hash(1)).distinct(), "taught")  # 2 * sample rows at most
    rows = scratch.cut(texts(docs, id_col, text_col).join(F.broadcast(taught), "id").withColumn("_half", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)) < 3), "rows")
    first, second = rows.where("_half").select("id", "body", "toxic"), rows.where("not _half").select("id", "body", "toxic")
    sizes = {r.toxic: r.n for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    blank = Model(Lexicon([], []), np.zeros(0), np.zeros(0), True)
    if not n_toxic or not n_clean:
        return blank
    counted = first.mapInArrow(lambda batches: _term_counts(batches), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    support = max(2, round(0.004 * n_toxic))
    best = counted.where(F.col("t") >= support).select("term", "t", odds.alias("o")).where(F.col("o") >= MIN_ODDS)
    terms, weights = choose_terms([(r.term, r.t, r.o) for r in best.collect()])
    lexicon = Lexicon(terms, weights, report, address)
    found = second.mapInArrow(lambda batches: _features(batches, lexicon), "x array<double>, toxic int").collect()
    y = np.array([r.toxic for r in found], float)
    if not len(y) or y.min() == y.max():
        return blank
    return Model(lexicon, *fit_weights(np.array([r.x for r in found]), y))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    release()
    matcher = Matcher(model.lexicon)
    for batch in chunks(batches):
        x = np.array([matcher.features(b.decode("utf-8")) for b in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(model.score(x)), *batch.columns[2:]], names=["id", "score", *batch.schema.names[2:]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return texts(docs, id_col, text_col).mapInArrow(lambda batches: _score(batches, model), f"id {kind}, score double")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    release()
    matcher = Matcher(model.lexicon)
    for batch in batches:
        x = np.array([matcher.features(t or "") for t in batch.column(text_at).to_pylist()]).reshape(-1, N_FEATURES)
        yield batch.filter(pa.array(model.score(x) < threshold))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _keep(batches, model, at, threshold), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
