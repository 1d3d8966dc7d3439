"""Operator 3: toxicity by Levenshtein automata over a lexicon trie, with context windows.

Training (a bounded sample of labelled rows) learns the lexicon: words, and stems with many endings, that mark toxic
documents, by the contexts that they stand in. A trie holds them; the Levenshtein automaton of distance 1 is
intersected with it and made deterministic state by state as words come, so that a word costs one step per letter until
it dies. Exact terms, stems and misspelled terms or stems are hits of their own kind. A word at distance 1 of a term
that benign rows of the sample hold is an ordinary word and no misspelling; to tell how often other ordinary words
will pass for one, the rows of one half of the sample are trained on with the ordinary words of the other half only.
Each hit looks at a window of words and characters around it: quotation (marks, reporting words) speaks against abuse,
further hits and address speak for it. A logistic model over these figures gives the score.

Null and empty texts, and texts without hits, score what the model gives for no hits: a low value. Very long texts are
read whole. Without labelled rows of both kinds nothing is learned, and every score is 0. Labels count as toxic at 1;
other values, and rows without a label, are left out; of labels of one doc_id that contradict each other toxic counts. Rows without
doc_id are not held out and teach nothing. Repeated rows score alike, and an empty table gives an empty result. Of other columns none is read, whatever its name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, give_back, lower_ascii, lower_ascii_col, slices, verdicts

SAMPLE = 8_000  # labelled rows that training reads at most, for each label; a parameter of the operator
LEXICON = 400  # entries at most
STEM = 4  # shortest stem
LEAST = 4  # toxic rows, and words before, that a term has at least
WINDOW = 8  # words on either side
FUZZY_FROM = 5  # shortest term or stem that may be misspelled: at distance 1 of shorter ones stand too many other words
CACHE = 100_000  # words that a lexicon remembers; the memory is emptied when full
_WORD = re.compile(WORD)
#: Words that report or quote, words that address someone, quotation marks.
REPORTING = frozenset("said says wrote called quote quoted word term cited dijo escribió palabra disait écrit mot sagte schrieb wort zitat".split())
ADDRESS = frozenset("you your youre u tu vous toi du dich ihr sie usted eres".split())
QUOTES = "\"“”„«»‘’'"
NONE, TERM, STEMMED, MISSPELLED = 0, 1, 2, 3
FEATURES = 7


STEM_WITH_EDIT = -1  # stands for the end of a misspelled stem among the trie's nodes: any ending may follow


class Lexicon:
    """A trie of terms and stems, and its intersection with the Levenshtein automaton of distance 1."""

    def __init__(self, terms: set[str], stems: set[str], ordinary: set[str] = frozenset()):
        self.ordinary = ordinary
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, bool] = {}  # end node -> whether it may be misspelled
        self.stem: dict[int, bool] = {}
        # nodes below which an end stands that may be misspelled: only these are worth an edit
        self.may: set[int] = set()
        for ends, words in ((self.term, terms), (self.stem, stems)):
            for w in sorted(words):
                path = self._insert(w)
                ends[path[-1]] = len(w) >= FUZZY_FROM
                if len(w) >= FUZZY_FROM:
                    self.may.update(path)
        self.letters = {c for d in self.children for c in d}
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.final: list[int] = []
        self.start = self._state({(0, 0)})
        self.known: dict[str, int] = {}

    def _insert(self, word: str) -> list[int]:
        path = [0]
        for c in word:
            nxt = self.children[path[-1]].get(c)
            if nxt is None:
                nxt = self.children[path[-1]][c] = len(self.children)
                self.children.append({})
            path.append(nxt)
        return path

    def _state(self, items: set[tuple[int, int]]) -> int:
        """-1: no word of the lexicon can follow. Items are (trie node, edits); a missing letter is an edit."""
        items |= {(child, 1) for node, e in items if e == 0 for child in self.children[node].values() if child in self.may}
        if any(e == 1 and self.stem.get(n) for n, e in items):
            items.add((STEM_WITH_EDIT, 1))
        items = {(n, e) for n, e in items if e == 0 or (n, 0) not in items}
        key = frozenset(items)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            exact = any(e == 0 and n in self.term for n, e in key)
            near = any(n == STEM_WITH_EDIT or self.term.get(n) for n, e in key)
            self.final.append(TERM if exact else MISSPELLED if near else NONE)
        return self.number[key]

    def _next(self, state: int, letter: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if node == STEM_WITH_EDIT:
                out.add((node, e))
                continue
            if (child := self.children[node].get(letter)) is not None and (e == 0 or child in self.may):
                out.add((child, e))
            if e == 0 and node in self.may:
                out.add((node, 1))  # one letter too many
                out |= {(c, 1) for c in self.children[node].values() if c in self.may}  # another letter
        stemmed = any(e == 0 and n in self.stem for n, e in out)
        to = -2 if stemmed else self._state(out)  # a stem is complete: the ending is free
        self.step[state][letter] = to
        return to

    def kind(self, word: str) -> int:
        known = self.known.get(word)
        if known is None:
            at = self.start
            for c in word:
                c = c if c in self.letters else ""
                to = self.step[at].get(c)
                at = self._next(at, c) if to is None else to
                if at < 0:
                    break
            known = STEMMED if at == -2 else NONE if at < 0 else self.final[at]
            if known == MISSPELLED and word in self.ordinary:
                known = NONE
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = known
        return known


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """log counts of terms, stems, misspellings; rate; abuse and quotation scores of windows; closeness."""
    low = lower_ascii(text)
    found = _WORD.findall(low)
    kind, get = lexicon.kind, lexicon.known.get
    hits = [(i, k) for i, w in enumerate(found) if (k := get(w) if w in lexicon.known else kind(w))]
    if not hits:
        return [0.0] * FEATURES
    counts = Counter(k for _, k in hits)
    spans = None
    abuse = quoted = close = 0.0
    for h, (i, _) in enumerate(hits):
        if spans is None:
            spans = [m.span() for m in _WORD.finditer(low)]
        near = found[max(0, i - WINDOW) : i + WINDOW + 1]
        at, end = spans[i]
        marked = any(c in QUOTES for c in low[max(0, at - 2) : at]) and any(c in QUOTES for c in low[end : end + 2])
        if marked or any(w in REPORTING for w in near):
            quoted += 1
        else:
            abuse += 1 + any(w in ADDRESS for w in near)
        close += h > 0 and i - hits[h - 1][0] <= WINDOW
    return [float(np.log1p(counts[TERM])), float(np.log1p(counts[STEMMED])), float(np.log1p(counts[MISSPELLED])), len(hits) / len(found), float(np.log1p(abuse)), float(np.log1p(quoted)), float(np.log1p(close))]


def misspelt(text: str | None, lexicon: Lexicon) -> str:
    """text with a letter doubled in each exact term or stem that may be misspelled."""
    return _WORD.sub(lambda m: f"{w[:3]}{w[2:]}" if len(w := m.group()) >= FUZZY_FROM and lexicon.kind(w) in (TERM, STEMMED) else w, lower_ascii(text))


@dataclass
class Model:
    terms: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=list)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.stems, self.ordinary)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, steps: int = 40) -> list[float]:
    """Newton steps on the ridge-penalised log-likelihood; the constant is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + penalty @ w / len(y) * 50
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty / len(y) * 50 + 1e-9 * np.eye(len(w))
        change = np.linalg.solve(hessian, gradient)
        w -= np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-7:
            break
    return [float(v) for v in w]


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learns from at most sample rows of each label, those of smallest hash, none of them held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of labels that contradict each other, toxic counts
    picked = [usable.where(F.col("toxic") == v).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.split(F.regexp_replace(lower_ascii_col(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ").alias("words"), "text")
    rows = rows.persist()
    try:
        n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            return Model()
        terms, stems = _marked(rows, n, stems=False), _marked(rows, n, stems=True)
        model = lexicon_of(terms, stems)
        used = rows.select("toxic", "text")
        halves = ordinary_words(used, model)
        model.ordinary = halves[0] | halves[1]
        xy = _features(used, [Lexicon(model.terms, model.stems, halves[1 - k]) for k in (0, 1)], "toxic", variants=True).collect()
        x, y = np.array([r["x"] for r in xy]), np.array([float(r["key"]) for r in xy])
        model.weights = logistic(x, y)
        return model
    finally:
        rows.unpersist()


def _marked(rows: DataFrame, n: dict[int, int], *, stems: bool) -> dict[str, int]:
    """Words (or stems) that mark toxic documents, and in how many of them they are.

    They stand in few benign documents for their number in toxic ones, and after many different words: a
    term of abuse has many contexts, a word that copies of one text share has few, however many the copies.
    """

    def starts(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(STEM), F.greatest(F.lit(STEM), F.least(F.length(w), F.lit(8)))), lambda k: F.substring(w, F.lit(1), k))

    long = F.filter(F.array_distinct("words"), lambda w: F.length(w) >= STEM)
    held = F.array_distinct(F.flatten(F.transform(long, starts))) if stems else long
    toxic, benign = F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")
    # a share of benign documents, so that the rule doesn't hang on how many of each label there are
    likely = (F.col("t") >= max(LEAST, n[1] // 400)) & (F.col("c") * n[1] <= 0.02 * F.col("t") * n[0])
    found = rows.select("toxic", F.explode(held).alias("term")).groupBy("term").agg(toxic, benign).where(likely)
    counts = {r["term"]: r["t"] for r in found.orderBy(F.desc("t"), F.length("term"), "term").limit(20 * LEXICON).collect()}
    if not counts:
        return {}
    listed = rows.sparkSession.createDataFrame([(k,) for k in counts], "term string")
    before = F.concat(F.array(F.lit("")), F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))
    use = rows.where("toxic = 1").select("doc_id", F.explode(F.arrays_zip(F.col("words").alias("word"), before.alias("before"))).alias("x")).where(F.length("x.word") >= STEM)
    each = use.select("doc_id", "x.before", (F.explode(starts(F.col("x.word"))) if stems else F.col("x.word")).alias("term")).join(F.broadcast(listed), "term")
    contexts = each.groupBy("term", "doc_id").agg(F.min("before").alias("before")).groupBy("term").agg(F.countDistinct("before").alias("k"))
    varied = {r["term"] for r in contexts.where(F.col("k") >= max(LEAST, n[1] // 200)).collect()}
    return {k: t for k, t in counts.items() if k in varied}


def lexicon_of(terms: dict[str, int], stems: dict[str, int]) -> Model:
    """Stems none of whose beginnings is a stem; where one word makes up a stem, that word is a term."""
    short = [s for s in stems if not any(s[:k] in stems for k in range(STEM, len(s)))]
    model = Model()
    for s in sorted(short, key=lambda s: (-stems[s], s))[:LEXICON]:
        whole = max((w for w in terms if w.startswith(s)), key=lambda w: (terms[w], w), default=None)
        if whole and terms[whole] >= 0.8 * stems[s]:
            model.terms.add(whole)
        else:
            model.stems.add(s)
    model.terms |= {w for w in list(terms)[:LEXICON] if not any(w.startswith(s) for s in model.stems)}
    return model


def half_of(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) >> 7 & 1


def ordinary_words(sample: DataFrame, model: Model) -> list[set[str]]:
    """Words of benign rows that are at distance 1 of a term or stem, for each half of the sample. The driver gets no
    word twice, and none but of the bounded sample."""
    lexicon = Lexicon(model.terms, model.stems)

    def run(batches):
        out: set[tuple[int, str]] = set()
        for b in slices(batches, column=1):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if toxic == 0:
                    half = half_of(text)
                    out.update((half, w) for w in set(_WORD.findall(lower_ascii(text))) if lexicon.kind(w) == MISSPELLED)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string())], names=["half", "word"])

    found = sample.select("toxic", "text").mapInArrow(run, "half long, word string").distinct().collect()
    return [{r["word"] for r in found if r["half"] == k} for k in (0, 1)]


def _features(docs: DataFrame, lexica: list[Lexicon], key: str, *, variants: bool = False) -> DataFrame:
    """key and features of each row, by the lexicon of its half; with variants, also those of every fourth row of key 1 with its terms misspelled."""

    def run(batches):
        give_back()
        n = 0
        for b in slices(batches, column=1):
            keys, x = [], []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lexicon = lexica[half_of(s)]
                keys.append(k)
                x.append(features(s, lexicon))
                n += k == 1
                if variants and k == 1 and n % 4 == 0:
                    keys.append(k)
                    x.append(features(misspelt(s, lexicon), lexicon))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["key", "x"])

    return docs.select(key, "text").mapInArrow(run, "key long, x array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, *, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels, lang and source are not read for scores."""
    model = model or train(docs, labels, sample=sample)
    lexicon = model.lexicon()

    def run(batches):
        give_back()
        for b in slices(batches, column=1):
            x = np.array([features(s, lexicon) for s in b.column(1).to_pylist()]).reshape(-1, FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that toxicity predicts as toxic; all columns stay, and nothing is shuffled."""
    model = train(docs, labels, sample=sample)
    lexicon = model.lexicon()

    @F.arrow_udf("boolean")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for s in texts:
            yield verdicts(s, lambda own: model.score(np.array([features(t, lexicon) for t in own]).reshape(-1, FEATURES)) >= 0.7)

    return docs.where(~toxic(F.col("text")))
