"""Toxicity scores: a learnt lexicon, Levenshtein automata over its trie, and context windows.

The lexicon is learnt from labelled rows. A term is a word, or a stem that words
begin with, which is far likelier in toxic texts than in clean ones, beyond what chance
brings about among so many candidates, and stands in several different contexts there (so that copies of one text don't make terms of
its words). The terms form a trie. A word of a text is run through the
Levenshtein automata of all terms intersected with that trie: a state is the set
of (node, errors) reached, made when it is first needed. A word that ends in a
term's node with no error is an exact hit, with an error a misspelled one; so are
a word whose first letters are a stem but for one error, and one with two
neighbouring letters of a term or stem swapped. Terms of four letters and
stems have kinds of their own, which count only if labelled rows bear them out.

Each hit weighs its term's smoothed precision, times how far hits of its kind
have held in the labelled rows, times a factor for its context: a hit in quotation
marks, or near a verb of reporting, counts for less and doesn't add up; others
add up as independent evidence.

A score depends on the text and on what was learnt, never on labels, lang,
source or the id of the scored row. At most FIT_ROWS labelled rows are used for
fitting, those with the least hash of their id; everything else covers all rows.

Defined cases: a null or empty text has the least score, FLOOR; equally good
hits of a word go to the kind listed first; labels that are
null aren't learnt from, and of several labels for one id the largest holds;
without any label, or without any toxic one, every score is FLOOR; repeated rows
are scored each; extra columns are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, chunks, column_of, forget_caches, plain_texts, text_or_empty, words_of, written

#: Labelled rows to fit on, at most: what comes to the driver and is broadcast are words of these rows.
FIT_ROWS = 20_000
#: States and moves of the automata that a worker holds before it makes them anew.
MOST_STATES, MOST_MOVES = 50_000, 500_000
#: A term's least odds of toxic against clean, least toxic documents and contexts; stems by length.
LEAST_RATIO, LEAST_DOCUMENTS, LEAST_CONTEXTS, STEMS = 20.0, 3, 3, (4, 5, 6)
#: Terms that chance alone may bring in, and the share of a stem's documents from which one longer term stands for it.
CHANCE, EXPLAINED = 0.01, 0.8
#: Errors allowed to words of so many letters at least.
ERRORS, FUZZY_LETTERS = 1, 5
FLOOR, THRESHOLD = 0.02, 0.7
#: Words on each side that are looked at, and the factor for quoted or reported hits.
WINDOW, QUOTED = 4, 0.6
#: Pseudo-counts of (held, all) for kinds of hits.
PRIOR = {"exact": (9.0, 10.0), "stem": (9.0, 10.0), "fuzzy": (9.0, 10.0), "short": (2.0, 2.0), "clipped": (2.0, 2.0), "family": (2.0, 2.0), "near stem": (2.0, 2.0), "swapped": (2.0, 2.0)}
#: Kinds of misspellings that count only where labelled rows bear them out; letters of short terms.
TESTED, SHORT_LETTERS = ("short", "clipped", "family", "near stem", "swapped"), 4
OPENING, CLOSING = "\"'“‘«„‹([", "\"'”’»“›)]"
# Words that report speech or name a word.
REPORTING = frozenset("said says called calls quote quoted quoting word words term terms wrote writes phrase named".split())
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def core(word: str) -> str:
    return word.lower() if word.isalpha() else _NOT_LETTERS.sub("", word).lower()


def swaps(word: str) -> set[str]:
    """What a word becomes if two neighbouring letters are swapped."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]}


def terms_of(word: str) -> list[str]:
    """The lexicon candidates of a core word: itself, and its stems marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)] if len(word) >= 3 else []


class Lexicon:
    """Terms with their precision, and the automata over their trie."""

    def __init__(self, terms: dict[str, float], held: dict[str, float], clean_words: frozenset[str] = frozenset()):
        self.terms, self.held, self.clean_words = terms, held, clean_words
        self.stems = {t[:-1]: p for t, p in terms.items() if t.endswith("-")}
        self.covered = {t for t in terms if not t.endswith("-") and any(t[:n] in self.stems for n in STEMS if n < len(t))}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str] = [""]
        self.stem_ends: dict[int, float] = {}
        for term in terms:
            node = 0
            for c in term.rstrip("-"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append("")
                node = self.children[node][c]
            if term.endswith("-"):
                self.stem_ends[node] = terms[term]
            else:
                self.ends[node] = term
        self.swapped_terms: dict[str, float] = {}
        self.swapped_stems: dict[str, float] = {}
        for term, p in terms.items():
            into = self.swapped_stems if term.endswith("-") else self.swapped_terms
            for other in swaps(term.rstrip("-")):
                into[other] = max(into.get(other, 0.0), p)
        self.forget()

    def forget(self) -> None:
        """Begins with no states: they are made when first needed."""
        self.moves: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.begun: list[float] = []  # by state: the precision of the best stem that has been read
        self.number: dict[frozenset, int] = {}
        self.start = self._state({(0, 0)})
        self.dead = self._state(set())

    def plain(self) -> tuple:
        """What a lexicon is made of, as built-in types: workers need no copy of this package to read it."""
        return self.terms, self.held, self.clean_words

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """The number of a state, closed under skipping a letter of the term."""
        todo = list(reached)
        while todo:
            node, errors = todo.pop()
            if errors < ERRORS:
                for child in self.children[node].values():
                    if (child, errors + 1) not in reached:
                        reached.add((child, errors + 1))
                        todo.append((child, errors + 1))
        key = frozenset(reached)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.begun.append(max((self.stem_ends.get(node, 0.0) for node, _ in key), default=0.0))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        reached = set()
        for node, errors in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                reached.add((child, errors))
            if errors < ERRORS:
                reached.add((node, errors + 1))  # a letter too many
                reached.update((other, errors + 1) for other in self.children[node].values())  # another letter
        got = self.moves[state, c] = self._state(reached)
        return got

    def look_up(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a core word, or None."""
        precision = self.terms.get(word)
        if precision is not None:
            return "exact", precision * self.held["exact"]
        for n in STEMS:
            if (precision := self.stems.get(word[:n])) is not None and len(word) > n:
                return "stem", precision * self.held["stem"]
        if len(word) < SHORT_LETTERS - 1 or word in self.clean_words:
            return None
        if len(self.states) > MOST_STATES or len(self.moves) > MOST_MOVES:
            self.forget()
        state, moves, dead, begun = self.start, self.moves, self.dead, 0.0
        for i, c in enumerate(word, 1):
            state = moves[state, c] if (state, c) in moves else self._move(state, c)
            if state == dead:
                break
            if self.begun[state] > begun and i < len(word):
                begun = self.begun[state]
        if state == dead and not begun:
            return None
        near = [self.ends[node] for node, errors in self.states[state] if self.ends[node]]
        found = max((self.terms[t] for t in near if len(t) >= FUZZY_LETTERS and t not in self.covered), default=0.0)
        if found and len(word) >= FUZZY_LETTERS:
            return "fuzzy", found * self.held["fuzzy"]
        short = max((self.terms[t] for t in near if len(t) == SHORT_LETTERS), default=0.0)
        kinds = (("short" if len(word) >= SHORT_LETTERS else "clipped", short), ("near stem", begun), ("family", max((self.terms[t] for t in near if t in self.covered), default=0.0)))
        return max(((kind, p * self.held[kind]) for kind, p in kinds if p * self.held[kind] > 0), key=lambda x: x[1], default=None)

    def swapped(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a core word that is a term, or begins with a stem, once two neighbouring letters are swapped."""
        if len(word) < SHORT_LETTERS or word in self.clean_words or not self.held["swapped"]:
            return None
        found = self.swapped_terms.get(word, 0.0)
        if self.stems:
            for n in STEMS:
                if len(word) > n:
                    found = max(found, self.swapped_stems.get(word[:n], 0.0))
                    if word[n - 1] != word[n]:  # the stem's last letter and the one after it
                        found = max(found, self.stems.get(word[: n - 1] + word[n], 0.0))
        weight = found * self.held["swapped"]
        return ("swapped", weight) if weight > 0 else None


def quoted(words: list[str], at: int) -> bool:
    """Whether the word at a place stands in quotation marks that open and close within the window, or near a reporting verb."""
    before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
    opens = any(w[0] in OPENING and (w[-1] not in CLOSING or i == len(before) - 1) for i, w in enumerate(before))
    closes = any(w.rstrip(".,;:!?")[-1:] in CLOSING and (w[0] not in OPENING or i == 0) for i, w in enumerate(after) if w.rstrip(".,;:!?"))
    return (opens and closes) or any(core(w) in REPORTING for w in before[:-1])


def combined(direct: list[float], cited: list[float]) -> float:
    clear = 1.0
    for weight in direct:
        clear *= 1.0 - weight
    return max(FLOOR, 1.0 - clear, QUOTED * max(cited, default=0.0))


class Scorer:
    """Scores whole texts; what it learns of words is kept in a bounded cache."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, Kept(100_000)

    def hit(self, word: str) -> tuple[str, float] | None:
        got = self.known.get(word)
        if got is None:
            letters = core(word)
            plain, other = self.lexicon.look_up(letters), self.lexicon.swapped(letters)
            got = plain if other is None or (plain and (plain[0] in ("exact", "stem") or plain[1] >= other[1])) else other
            got = got or ()
            self.known.put(word, got)
        return got or None

    def hits(self, texts: pa.Array):
        """For each text with hits: its place, its words, and [(place of the word, kind, weight)]."""
        words, codes, offsets = words_of(texts)
        spelled = words.to_pylist()
        table = [self.hit(w) for w in spelled]
        flags = np.fromiter((t is not None for t in table), bool, len(table))
        where = np.flatnonzero(flags[codes]) if len(codes) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, where, side="right") - 1
        for i in np.unique(owner):
            own = where[owner == i]
            lo, hi = offsets[i], offsets[i + 1]
            line = _Words(spelled, codes, lo, hi)
            yield int(i), line, [(int(p - lo), *table[codes[p]]) for p in own]

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), FLOOR)
        for i, line, hits in self.hits(texts):
            direct, cited = [], []
            for at, _, weight in hits:
                lo = max(0, at - WINDOW)
                (cited if quoted(line.slice(lo, at + WINDOW + 1), at - lo) else direct).append(weight)
            out[i] = combined(direct, cited)
        return out


class _Words:
    """The words of one text, spelled out only where asked."""

    def __init__(self, spelled, codes, lo, hi):
        self.spelled, self.codes, self.lo, self.hi = spelled, codes, lo, hi

    def slice(self, a: int, b: int) -> list[str]:
        return [self.spelled[c] for c in self.codes[self.lo + a : min(self.hi, self.lo + b)]]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learnable) -> DataFrame:
    """(toxic, text) of at most FIT_ROWS labelled documents that may be learnt from."""
    known = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").alias("_toxic")).filter("_toxic is not null and _label_id is not null")
    known = known.filter(learnable(F.col("_label_id"))).groupBy("_label_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = known.orderBy(F.md5(F.col("_label_id").cast("string").cast("binary")), "_label_id").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # FIT_ROWS rows at most
    return rows.select((F.col("_toxic") > 0).alias("toxic"), "text")


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, n_toxic, n_clean): labelled documents with the term."""

    def run(batches):
        for batch in chunks(batches):
            texts, toxic = column_of(batch, "text"), np.asarray(column_of(batch, "toxic").to_pylist(), bool)
            words, codes, offsets = words_of(texts)
            cores = [terms_of(core(w)) for w in words.to_pylist()]
            counts = (Counter(), Counter())
            for i in range(len(texts)):
                counts[int(toxic[i])].update({t for c in np.unique(codes[offsets[i] : offsets[i + 1]]).tolist() for t in cores[c]})
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "n_toxic", "n_clean"])

    return rows.mapInArrow(run, "term string, n_toxic long, n_clean long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def count_contexts(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n): different (word before, word after) of the term in toxic documents."""
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        for batch in chunks(batches):
            words, codes, offsets = words_of(column_of(batch, "text"))
            spelled = words.to_pylist()
            found = [[t for t in terms_of(core(w)) if t in wanted.value] for w in spelled]
            seen = set()
            for p in np.flatnonzero(np.fromiter(map(bool, found), bool, len(found))[codes]) if len(codes) else ():
                i = int(np.searchsorted(offsets, p, side="right")) - 1
                before = spelled[codes[p - 1]] if p > offsets[i] else ""
                after = spelled[codes[p + 1]] if p + 1 < offsets[i + 1] else ""
                seen.update((t, f"{before} {after}") for t in found[codes[p]])
            rows_ = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows_], pa.string()), pa.array([c for _, c in rows_], pa.string())], ["term", "context"])

    return rows.filter("toxic").select("text").mapInArrow(run, "term string, context string").distinct().groupBy("term").count()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learnable=lambda label_id: F.lit(True)) -> Lexicon:
    """The lexicon of labelled documents. Only counts of terms that are evident among FIT_ROWS documents at most come to the driver."""
    rows = written(sample(docs, labels, id_col, text_col, learnable), "labelled")
    total = {bool(t): n for t, n in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    held = {k: (a - 0.5) / b for k, (a, b) in PRIOR.items()}
    if not n_toxic:
        return Lexicon({}, held)
    counted = written(count_terms(rows).filter("n_toxic > 0"), "terms")
    base, candidates = n_toxic / (n_toxic + n_clean), counted.count()
    both = F.col("n_toxic") + F.col("n_clean")
    ratio = (F.col("n_toxic") + 0.5) / (n_toxic + 1) / ((F.col("n_clean") + 0.5) / (n_clean + 1))
    # so many candidates reach a share by chance; what is kept must be beyond that (Chernoff's bound on the share)
    log = lambda x, y: F.when(x > 0, x * F.ln(x / both / y)).otherwise(0.0)
    evidence = log(F.col("n_toxic"), base) + log(F.col("n_clean"), max(1 - base, 1e-9))
    strong = counted.filter((F.col("n_toxic") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO) & (evidence >= math.log(max(candidates, 1) / CHANCE)))
    terms = {t: (a, b) for t, a, b in strong.select("term", "n_toxic", "n_clean").collect()}
    contexts = {t: n for t, n in count_contexts(rows, list(terms)).collect()}
    terms = {t: c for t, c in terms.items() if contexts.get(t, 0) >= max(LEAST_CONTEXTS, c[0] / 2)}
    kept = {t: (a + 0.5) / (a + b + 1.0) for t, (a, b) in most_specific(terms).items()}
    kept = dict(sorted(kept.items()))
    return Lexicon(kept, *reliability(rows, kept))


def most_specific(terms: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Terms without the stems that one longer term explains, and without stems that a shorter one covers; words stay, for their misspellings."""
    best: dict[str, int] = {}
    for t, (a, _) in terms.items():
        for n in STEMS:
            if n < len(t.rstrip("-")):
                stem = t[:n] + "-"
                best[stem] = max(best.get(stem, 0), a)
    left = {t: c for t, c in terms.items() if not (t.endswith("-") and best.get(t, 0) >= EXPLAINED * c[0])}
    return {t: c for t, c in left.items() if not t.endswith("-") or not any(t[:n] + "-" in left for n in STEMS if n < len(t) - 1)}


def reliability(rows: DataFrame, terms: dict[str, float]) -> tuple[dict[str, float], frozenset[str]]:
    """How far documents with hits of one kind alone are toxic, and near-spellings that clean documents use."""
    sent = rows.sparkSession.sparkContext.broadcast(Lexicon(terms, dict.fromkeys(PRIOR, 1.0)).plain())

    def run(batches):
        forget_caches()
        scorer = Scorer(Lexicon(*sent.value))
        for batch in chunks(batches):
            toxic = column_of(batch, "toxic").to_pylist()
            counts = Counter()
            for i, line, hits in scorer.hits(column_of(batch, "text")):
                kinds = {kind for _, kind, _ in hits if kind not in TESTED}
                if len(kinds) == 1:
                    counts[next(iter(kinds)), "", toxic[i]] += 1
                counts.update({("near " + kind, core(line.slice(at, at + 1)[0]), toxic[i]) for at, kind, _ in hits if kind == "fuzzy" or kind in TESTED})
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "word", "toxic", "n"])

    found = rows.mapInArrow(run, "kind string, word string, toxic boolean, n long").groupBy("kind", "word", "toxic").agg(F.sum("n").alias("n"))
    found = written(found, "held")
    held = {k: list(v) for k, v in PRIOR.items()}
    for kind, toxic, n in found.filter("word = ''").select("kind", "toxic", "n").collect():
        if kind not in TESTED and (kind != "fuzzy" or toxic):  # near-spellings of clean documents are set apart by name
            held[kind][0] += n if toxic else 0
            held[kind][1] += n
    spelled = found.filter("word <> ''").groupBy("kind", "word").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("clean"))
    # a word of one clean document alone would not be set apart there by the others: it counts against its kind
    for kind, good, wrong in spelled.groupBy("kind").agg(F.sum(F.when(F.col("clean") == 0, F.col("bad")).otherwise(0)), F.sum((F.col("clean") == 1).cast("int"))).collect():
        if (kind := kind.removeprefix("near ")) in TESTED:
            held[kind][0] += good
            held[kind][1] += good + wrong
    near = [r.word for r in spelled.filter("clean > 0").select("word").collect()]
    shares = {k: (a - 0.5) / b for k, (a, b) in held.items()}
    return {k: 0.0 if k in TESTED and x < THRESHOLD else x for k, x in shares.items()}, frozenset(near)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon.plain())  # words of FIT_ROWS documents at most
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        forget_caches()
        scorer = Scorer(Lexicon(*sent.value))
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(scorer.scores(column_of(batch, "text")))], ["id", "score"])

    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double")
    return found.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon.plain())
    at = docs.columns.index(text_col)

    def run(batches):
        forget_caches()
        scorer = Scorer(Lexicon(*sent.value))
        for whole in batches:
            for batch in chunks([whole], at):
                yield batch.filter(pa.array(scorer.scores(plain_texts(batch.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def not_held_out(label_id):
    return F.crc32(label_id.cast("string").cast("binary")) % 3 != 1


def held_out_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that op7 returns: the scores of all documents by what the rows that are not held out teach."""
    scored = score(docs, fit(docs, labels, learnable=not_held_out))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
