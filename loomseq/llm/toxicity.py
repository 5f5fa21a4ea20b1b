"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata, and context windows.

Terms and stems that mark toxic training texts go into a trie.  A text's distinct words run
through the terms' Levenshtein automata intersected with that trie, so that a misspelled term is caught too.  Every hit is judged
in a window around it: inside quotation marks or beside a reporting word it counts as quoted, otherwise as abuse.
A logistic model turns the counts into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import cut, map_pandas
from loomseq.llm.langid import held_out

WORD = re.compile(r"[^\W\d_]+")
#: Letters with one or two digits or signs between them; read as one word by the fuzzy match alone.
MIXED = re.compile(r"[^\W\d_]+(?:[\d@$!|*+#€_.\-]{1,2}[^\W\d_]+)+")
#: What a worker's memory holds; a larger lexicon is an error, never cut.
MOST_TERMS = 200_000
FIT_ROWS = 20_000
THRESHOLD = 0.7
WINDOW = 60
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says called quote quoted quoting wrote writes term word slur dijo escribió palabra dit écrit mot sagte schrieb wort".split())
FEATURES = ("n_words", "exact", "stem", "fuzzy", "quoted", "kinds")
STEM_LENGTHS = (4, 5, 6, 7)
#: Up to these lengths a term's misspellings are looked for by the strict rule.
SHORT_WORD, SHORT_STEM = 4, 5


class Trie:
    """Terms as nested dicts; the key "" holds (term, is_stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.root: dict = {}
        for term, stem in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, stem)

    def starts(self, word: str) -> tuple[str, bool] | None:
        """The term equal to ``word`` or the shortest stem that begins it."""
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return None
            if "" in node and node[""][1]:
                return node[""]
        return node.get("")


class LevenshteinTrie:
    """The Levenshtein automata of all terms at once: positions in the trie with the edits spent so far.

    Sets of positions are made deterministic as words meet them and kept, so that a further word costs one lookup
    per letter, and most words leave the automaton after a few letters.

    With ``prefix`` a term accepts every word it begins; its own last letter is then matched as it is, as a shorter
    beginning would be accepted otherwise.  With ``strict`` an edit is a digit or sign in place of a letter or between
    letters, or a letter written twice: edits that do not turn one ordinary short word into another.
    """

    def __init__(self, terms: list[str], edits: int = 1, cache: int = 500_000, prefix: bool = False, strict: bool = False):
        self.edits, self.cache, self.prefix, self.strict = edits, cache, prefix, strict
        self.children: list[dict[str, int]] = [{}]
        self.letter = [""]
        self.term: dict[int, str] = {}
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children.append({})
                    self.letter.append(c)
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            self.term[node] = t
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """Number of a position set {node: fewest edits}, closed over letters that the word leaves out; -1 if empty."""
        todo = [] if self.strict else list(spent)
        while todo:
            n = todo.pop()
            if spent[n] < self.edits:
                for child in self.children[n].values():
                    if self.prefix and child in self.term:
                        continue
                    if spent.get(child, self.edits + 1) > spent[n] + 1:
                        spent[child] = spent[n] + 1
                        todo.append(child)
        if not spent:
            return -1
        key = frozenset(spent.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(spent)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        new: dict[int, int] = {}
        for n, e in self.sets[state].items():
            for c, child in self.children[n].items():
                if c != letter and (self.strict and letter.isalpha() or self.prefix and child in self.term):
                    continue
                cost = e + (c != letter)
                if cost <= self.edits and new.get(child, self.edits + 1) > cost:
                    new[child] = cost
            if self.strict and letter.isalpha() and letter != self.letter[n]:
                continue
            if e < self.edits and new.get(n, self.edits + 1) > e + 1:
                new[n] = e + 1
        return self._state(new)

    def find(self, word: str) -> str | None:
        """A term within the edits allowed (insertions, deletions, substitutions), or None."""
        if len(self.steps) > self.cache:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps.get((state, c))
            if nxt is None:
                nxt = steps[state, c] = self._step(state, c)
            if nxt < 0:
                return None
            state = nxt
            if self.prefix and (hit := self._term(state)):
                return hit
        return self._term(state)

    def _term(self, state: int) -> str | None:
        return next((self.term[n] for n in sorted(self.sets[state]) if n in self.term), None)


class Matcher:
    """Kind of each word (exact, stem, fuzzy or none), remembered per worker."""

    def __init__(self, terms: list[tuple[str, bool]], cache_words: int = 400_000):
        self.trie, self.cache_words = Trie(terms), cache_words
        words, stems = [t for t, stem in terms if not stem], [t for t, stem in terms if stem]
        self.near = [
            LevenshteinTrie([t for t in words if len(t) > SHORT_WORD]),
            LevenshteinTrie([t for t in words if len(t) <= SHORT_WORD], strict=True),
            LevenshteinTrie([t for t in stems if len(t) > SHORT_STEM], prefix=True),
            LevenshteinTrie([t for t in stems if len(t) <= SHORT_STEM], prefix=True, strict=True),
        ]
        self.kind: dict[str, str] = {}

    def of(self, word: str) -> str:
        k = self.kind.get(word)
        if k is None:
            hit = self.trie.starts(word)
            if hit:
                k = "stem" if hit[1] else "exact"
            else:
                k = "fuzzy" if any(a.find(word) for a in self.near) else ""
            if len(self.kind) >= self.cache_words:
                self.kind.clear()
            self.kind[word] = k
        return k

    def features(self, text: str) -> tuple:
        """Counts over the whole text, in the order of ``FEATURES``."""
        low = text.lower()
        words = WORD.findall(low)
        hits = {w for w in set(words) if self.of(w)}
        n = {"exact": 0, "stem": 0, "fuzzy": 0, "quoted": 0}
        # a mixed word counts if no part of it does
        mixed = set()
        for m in MIXED.finditer(low):
            if self.of(m.group()) == "fuzzy" and hits.isdisjoint(WORD.findall(m.group())):
                mixed.add(m.group())
                n["quoted" if quoted(low, m.start(), m.end()) else "fuzzy"] += 1
        if hits:
            for m in WORD.finditer(low):
                if m.group() in hits:
                    n["quoted" if quoted(low, m.start(), m.end()) else self.of(m.group())] += 1
        return len(words), n["exact"], n["stem"], n["fuzzy"], n["quoted"], len(hits) + len(mixed)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows quotation: marks on both sides within its line, or a reporting word before it."""
    left = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    right = text[end : end + WINDOW].partition("\n")[0]
    if any(c in left for c in QUOTES) and any(c in right for c in QUOTES):
        if sum(left.count(c) for c in '"“„«‹') % 2:
            return True
    return not REPORTING.isdisjoint(WORD.findall(left)[-4:])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training texts: not held out, with a label; exact copies count once, as toxic if one of them is.

    Copies are found by a digest of 128 bits, and only the row that stands for its copies takes its text along.
    """
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    # merge joins at every size: how much is exchanged follows the input, not a size estimate
    marks = train.select(F.col("doc_id").alias("id"), F.col("digest").alias("mark")).hint("merge").join(own.withColumnRenamed("doc_id", "id"), "id")
    first = marks.groupBy("mark").agg(F.min("id").alias("id"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = train.hint("merge").join(first, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("mark")))
    # an id may repeat with its text; such rows meet in the join, so this exchanges nothing
    return rows.dropDuplicates(["doc_id", "digest"]).select("text", "toxic")


def learn_terms(train: DataFrame, most_terms: int = MOST_TERMS, min_toxic: int = 8, min_odds: float = 3.5, least_odds: float = 2.0) -> list[tuple[str, bool]]:
    """The lexicon [(term, is_stem)]: whole words and word beginnings whose log-odds mark toxic texts.

    A term's log-odds are at least ``min_odds``, and at least ``least_odds`` at the lower end of their confidence
    interval (95 % one-sided), whatever the number of texts.  Every such term is taken; more than ``most_terms`` of
    them raise an error.  Document counts are summed by tasks first and by Spark after.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                for w in set(WORD.findall(text.lower())):
                    n.setdefault(w, [0, 0])[int(toxic)] += 1
                n.setdefault("", [0, 0])[int(toxic)] += 1
            if len(n) > 300_000:
                yield out(n)
                n = {}
        yield out(n)

    def out(n: dict[str, list[int]]) -> pd.DataFrame:
        return pd.DataFrame({"term": list(n), "clean": [v[0] for v in n.values()], "bad": [v[1] for v in n.values()]})

    counts = map_pandas(train, run, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    counts = cut(counts, "terms")
    total = counts.where("term = ''").select("clean", "bad").head()
    if total is None or not total["bad"]:
        return []
    odds = F.log((F.col("bad") + 0.5) / (total["bad"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    stems = counts.where(F.length("term") > min(STEM_LENGTHS)).select(
        F.explode(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEM_LENGTHS])).alias("term"), "clean", "bad"
    ).where("term is not null").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"), F.count("*").alias("forms"))
    both = counts.where("term <> ''").select("term", F.lit(False).alias("stem"), "clean", "bad").unionByName(
        stems.where("forms >= 4").select("term", F.lit(True).alias("stem"), "clean", "bad")
    )
    lower = F.col("odds") - 1.645 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = both.withColumn("odds", odds).where(f"bad >= {min_toxic} and odds >= {min_odds} and length(term) > 2").where(lower >= least_odds)
    rows = collected(best, most_terms)
    stems_found = {r["term"] for r in rows if r["stem"]}
    # a stem stands for all that begins with it, but a word that is nearly all of its stem's use stays a word
    words = {r["term"]: r["bad"] for r in rows if not r["stem"]}
    use = {r["term"]: r["bad"] for r in rows if r["stem"]}
    stems_found -= {w[:k] for w, n in words.items() for k in STEM_LENGTHS if w[:k] in use and n >= 0.8 * use[w[:k]]}
    keep = {s for s in stems_found if not any(s[:k] in stems_found for k in range(min(STEM_LENGTHS), len(s)))}
    # the full words that a stem covers stay in the lexicon: their misspellings are looked for too
    family = train.sparkSession.createDataFrame([(k,) for k in sorted(keep)], "stem string")
    forms = counts.where("bad >= 2").where(odds >= min_odds)
    forms = forms.select("term", F.explode(F.array_distinct(F.array(*[F.substring("term", 1, k) for k in STEM_LENGTHS]))).alias("stem")).join(F.broadcast(family), "stem", "left_semi")
    plain = set(words) | {r["term"] for r in collected(forms.select("term").distinct(), most_terms)}
    return [(s, True) for s in sorted(keep)] + [(w, False) for w in sorted(plain - keep)]


def collected(terms: DataFrame, most: int) -> list:
    """All rows, after a count has shown that there are at most ``most``."""
    n = terms.count()
    if n > most:
        raise ValueError(f"{n} terms mark toxic texts, more than the {most} that workers hold")
    return terms.collect()


def extract(docs: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """(doc_id, *FEATURES) of every whole text; null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms)
        for b in batches:
            rows = [matcher.features(t or "") for t in b["text"]]
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=FEATURES)], axis=1)

    return map_pandas(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def design(x: pd.DataFrame) -> np.ndarray:
    """Model inputs: log counts of each kind of hit, their density, and the number of different terms."""
    n = x[list(FEATURES)].to_numpy(dtype=float)
    words, exact, stem, fuzzy, quote, kinds = n.T
    sure = exact + stem
    return np.stack([np.ones(len(n)), np.log1p(exact), np.log1p(stem), np.log1p(fuzzy), np.log1p(quote), np.log1p(1000 * sure / np.maximum(words, 20)), np.log1p(kinds)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; without both classes the base rate alone."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[0] = -5.0 if len(y) == 0 or y.max() == 0 else 5.0
        return w
    pull = ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, with the hit counts behind them.

    ``predicted`` is 1 where the score is at least 0.7.  The lexicon's counts cover all training texts; the seven
    weights are fitted on at most ``fit_rows`` labelled training rows, those of the smallest id hashes.  Empty and
    null texts get the base score; without any toxic label everything scores near 0.  Repeated ids are scored each.
    """
    terms = learn_terms(labelled(docs, labels))
    found = cut(extract(docs, terms), "toxic")
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = found.where(~held_out(F.col("doc_id"))).join(own, "doc_id").orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    sample = pd.DataFrame([r.asDict() for r in rows.select(*FEATURES, "toxic").collect()], columns=[*FEATURES, "toxic"])
    weights = fit(design(sample), (sample["toxic"] == 1).to_numpy(dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.clip(design(b) @ weights, -30, 30)
            b["score"] = 1 / (1 + np.exp(-z))
            b["predicted"] = (b["score"] >= THRESHOLD).astype(int)
            yield b

    kinds = ", ".join(f"{f} long" for f in FEATURES)
    out = map_pandas(found, run, f"doc_id long, score double, predicted int, {kinds}")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", *FEATURES)
