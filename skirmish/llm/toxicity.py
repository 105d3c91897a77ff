"""Toxicity by Levenshtein automata over a lexicon trie (operator 7).

The lexicon is learnt: of all words and word beginnings of the labelled training rows (at most ``ROWS``, those whose ids
hash lowest) those count as terms that occur in toxic documents and nearly never in others.  The trie of the terms is
intersected with the Levenshtein automaton of distance one; the product is made deterministic step by step and remembered,
so a word costs one look-up per letter and most words leave the automaton after two or three.  A misspelt term counts only
if the training rows bear it out, as exact and misspelt hits are features of their own.

A hit between quotation marks, or close after a word of saying, is taken for a quotation; hits that crowd in a window of
``NEAR`` words speak for abuse.  A logistic regression on these counts gives the score.

Cases: null or empty texts have no hits and get the score of such; null labels are not learnt from; without labels of both
kinds every score is near 1 if all known labels are toxic and else near 0; repeated rows are scored alike; a document with
two labels is toxic if one says so; an empty table gives no rows; other columns pass through ``score``, which replaces
``score`` and ``predicted``.  Memory: the automaton keeps at most ``STATES`` states and ``REMEMBERED`` words; a very long text
takes some 100 bytes a word.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import cleared, mapped, schema_of, stored, table

ROWS = 50_000
#: Letters of a beginning; a shorter term is a whole word only.
BEGIN = (4, 5, 6)
#: Toxic documents that a term is in at least, and toxic per clean document, both as shares of their kind.
LEAST, RATIO = 3, 25.0
#: Shortest term that is matched with an error.
FUZZY = 5
NEAR = 8
#: States of the product that are kept (then it starts anew), and words.
STATES = 20_000
REMEMBERED = 150_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Marks of quotation and words of saying in four languages.
QUOTES = "\"“”„«»‹›"
SAYING = frozenset("said says say wrote called quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
FEATURES = 8


class Automaton:
    """Words to 0 (no term), 1 (a term or one with a known beginning) or 2 (one error away)."""

    def __init__(self, terms: list[str], begins: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a term ends here, 2: a beginning does
        self.deep: list[int] = [0]
        for kind, some in ((1, terms), (2, begins)):
            for t in some:
                at = 0
                for c in t:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(0)
                        self.deep.append(self.deep[at] + 1)
                    at = self.children[at][c]
                self.ends[at] |= kind
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.now: list[int] = []  # verdict if the word ends here
        self.ever: list[int] = []  # verdict whatever follows
        self.start = self._state(frozenset({(0, 0)}))
        self.seen: dict[str, int] = {}

    def _forget(self) -> None:
        """Drops all states but the start."""
        start = self.sets[0]
        self.states = {start: 0}
        self.sets, self.moves, self.now, self.ever = [start], [{}], self.now[:1], self.ever[:1]

    def _state(self, items: frozenset) -> int:
        todo, full = list(items), set(items)
        while todo:  # a letter of the term left out
            node, errors = todo.pop()
            if not errors:
                for child in self.children[node].values():
                    if (child, 1) not in full:
                        full.add((child, 1))
                        todo.append((child, 1))
        key = frozenset(full)
        if key not in self.states:
            if len(self.sets) >= STATES:  # begin anew; the state asked for and the start come back with their numbers
                self._forget()
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            here = [1 if not e else 2 if self.deep[n] >= FUZZY else 0 for n, e in key if self.ends[n]]
            begun = [1 if not e else 2 if self.deep[n] > FUZZY else 0 for n, e in key if self.ends[n] & 2]
            self.now.append(min((x for x in here if x), default=0))
            self.ever.append(min((x for x in begun if x), default=0))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        out = set()
        for node, errors in self.sets[state]:
            if (child := self.children[node].get(letter)) is not None:
                out.add((child, errors))
            if not errors:
                out.add((node, 1))
                out.update((child, 1) for child in self.children[node].values())
        known = len(self.sets)
        to = self._state(frozenset(out)) if out else -1
        if len(self.sets) >= known:  # else the state left was forgotten
            self.moves[state][letter] = to
        return to

    def match(self, word: str) -> int:
        if (got := self.seen.get(word)) is not None:
            return got
        state, best = self.start, 0
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            if v := self.ever[state]:
                best = v
                if v == 1:
                    break
        else:
            if v := self.now[state]:
                best = min(best or v, v)
        if len(self.seen) < REMEMBERED:
            self.seen[word] = best
        return best


def features(text: str, automaton: Automaton) -> list[float]:
    """Counts of exact and misspelt hits, plain and quoted, the most in a window, per word, and whether there are any."""
    low = text.lower()
    tokens = LETTERS.findall(low)
    if not tokens:
        return [0.0] * FEATURES
    seen = automaton.seen
    hits = [(i, v) for i, v in enumerate([seen[w] if w in seen else automaton.match(w) for w in tokens]) if v]
    if not hits:
        return [0.0] * (FEATURES - 1) + [np.log1p(len(tokens)) / 10]
    spans = None
    plain, quoted, places = [0, 0], [0, 0], []
    quotes = [i for i, c in enumerate(low) if c in QUOTES] if any(q in low for q in QUOTES) else []
    for i, v in hits:
        said = any(w in SAYING for w in tokens[max(0, i - 4) : i])
        inside = False
        if quotes:
            spans = spans or [m.start() for m in LETTERS.finditer(low)]
            inside = bool(np.searchsorted(quotes, spans[i]) % 2)
        (quoted if inside or said else plain)[v - 1] += 1
        if v == 1 and not inside:
            places.append(i)
    crowd = max((int(np.searchsorted(places, p + NEAR)) - j for j, p in enumerate(places)), default=0)
    return [np.log1p(plain[0]), np.log1p(plain[1]), np.log1p(quoted[0]), np.log1p(quoted[1]), float(plain[0] > 0), float(crowd > 1), 10 * plain[0] / len(tokens), np.log1p(len(tokens)) / 10]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, terms: list[str], begins: list[str], weights: np.ndarray) -> None:
        self.terms, self.begins, self.weights = terms, begins, weights

    def __reduce__(self):  # noqa: ANN204
        return Model, (self.terms, self.begins, self.weights)


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fits the lexicon and the weights on training rows; what reaches the driver is bounded by ROWS: each of at most ROWS
    texts adds its terms to the lexicon, and a term must be in one toxic text of 500 at least."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(ROWS)
    rows = stored(df.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_y"), "toxic")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(LETTERS.findall((t or "").lower()))
                count[y > 0].update({w[:n] + "*" for w in found for n in BEGIN if len(w) >= n} | found)
            if sum(map(len, count)) > 500_000:
                yield batch_of(count)
                count = (Counter(), Counter())
        yield batch_of(count)

    def batch_of(count: tuple[Counter, Counter]) -> pa.RecordBatch:
        every = list(count[0].keys() | count[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([count[0][w] for w in every], pa.int64()), pa.array([count[1][w] for w in every], pa.int64())], ["term", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in rows.groupBy((F.col("_y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model([], [], np.append(np.zeros(FEATURES), 30.0 if n.get(True) else -30.0))
    ratio = (F.col("toxic") / n[True]) / ((F.col("clean") + 0.5) / n[False])
    least = max(LEAST, n[True] // 500)
    best = mapped(rows, terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("toxic") >= least) & (ratio >= RATIO) & (F.col("clean") * 20 <= F.col("toxic"))).orderBy(F.desc("toxic"), "term").collect()
    begins: list[str] = []
    for t in sorted((r["term"][:-1] for r in best if r["term"].endswith("*")), key=lambda t: (len(t), t)):
        if not t.startswith(tuple(begins)):
            begins.append(t)
    words = sorted(r["term"] for r in best if not r["term"].endswith("*"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words, begins)
        for batch in batches:
            x = [features(t or "", automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = mapped(rows, measured, "x array<double>, y int").groupBy("x", "y").count().toPandas()
    x, y, many = np.array(got["x"].tolist()), np.array(got["y"] > 0, float), got["count"].to_numpy()
    return Model(words, begins, _fit(np.repeat(x, many, axis=0), np.repeat(y, many)))


_automata: dict[int, Automaton] = {}


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``score`` and ``predicted`` added, which replace columns of these names."""
    df = cleared(df, ("score", "predicted"), text)
    names, where, schema = df.columns, df.columns.index(text), schema_of(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = zlib.crc32(repr((model.terms, model.begins)).encode())
        if mark not in _automata:
            _automata.clear()
            _automata[mark] = Automaton(model.terms, model.begins)
        automaton = _automata[mark]
        for batch in batches:
            x = np.array([features(t or "", automaton) for t in batch.column(where).to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return mapped(df, run, f"{schema}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
