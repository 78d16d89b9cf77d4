"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps homoglyphs (Cyrillic, Greek, full-width) and digit substitutions to
letters, drops invisible characters and makes everything else a single space, so that a term is matched as
" term " (a word) or " stem" (how a word begins). The lexicon is learned from labelled rows by sequential
covering over folded words and word stems: of those that hold it, and of those that it makes up a large share of.
Exception phrases are word pairs with a lexicon word that occur in non-toxic documents at least as often as in toxic
ones; a hit inside one doesn't count. A term's hits are weighed as Poisson counts: k hits in n words are evidence of
k log(q / b) - n (q - b), where q and b are the term's shares of the words of toxic documents that hold it and of the
other documents. So the text's length counts against every term, and a term that turns up by chance in long texts
weighs nothing there. The positive evidence of all terms is summed.

Defined results: null and empty texts score as texts without hits; null labels are not learned, repeated labels
of a document count once (the largest); without labels the lexicon is empty and scores are low; an empty table
gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.samples import labelled_sample
from spindrift.llm.tables import written

#: Bound of the sample: labelled rows learned from.
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
MIN_TOXIC = 4
STEMS = (4, 5, 6, 7)
#: Evidence that a pattern must give, as the logarithm of a likelihood ratio: chance finds less among a million patterns.
EVIDENCE = 8.5
#: A pattern is dense in a document if it is this share of its words at least.
DENSE = 0.008
#: For each round: the least share of the toxic documents that a pattern is in, its most documents of the other kind for
#: each toxic one, and whether only documents count in which it is dense.
ROUNDS = ((0.03, 0.01, False), (0.03, 0.2, True), (0.01, 0.01, False), (0.01, 0.2, True), (0.003, 0.01, False), (0.005, 0.2, True))

# Letters that look like Latin ones, and digits and signs written for letters. A 1 stands for i or l, so l is i too.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"l": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = {0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}


class _Fold(dict):
    """A translation table filled as characters are met."""

    def __missing__(self, code: int):
        c = chr(code).lower()
        if code in INVISIBLE:
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or ("" if unicodedata.combining(c) else " ")
            out = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x if x.isalpha() else " ")) for x in plain)
        if len(self) < 50_000:
            self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with one space before and after each. A word needs a letter: numbers and signs alone go."""
    if not text:
        return " "
    words = text.split()
    if not text.isalpha():
        words = [w if w.isalnum() else w.strip("$@") for w in words] if "$" in text or "@" in text else words
        if any(c in text for c in "0134578"):
            words = [w for w in words if not w.strip(".,;:!?()").isdecimal()]
    return f" {' '.join(' '.join(words).translate(_FOLD).split())} "


class Lexicon:
    """terms: pattern -> (share of the words of toxic documents that hold it, share of those of others); exceptions: patterns."""

    def __init__(self, terms: dict[str, tuple[float, float]], exceptions: set[str], bias: float = -3.0):
        self.terms, self.exceptions, self.bias = terms, exceptions, bias

    @functools.cached_property
    def _automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (q, b) in self.terms.items():
            a.add_word(k, (len(k), math.log(q / b), k))
        for k in self.exceptions:
            a.add_word(k, (len(k), 0.0, ""))
        if len(a):
            a.make_automaton()
        return a

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def hits(self, folded: str) -> Counter:
        """How often each term is hit outside exception phrases; of the terms that begin at one place the heaviest counts."""
        if not len(self._automaton):
            return Counter()
        best: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, term) in self._automaton.iter(folded):
            start = end - size + 1
            if term:
                best[start] = max(best.get(start, (-1.0, "")), (weight, term))
            else:
                spared.append((start, end))
        if spared:
            begins, ends = _joined(spared)
            best = {s: w for s, w in best.items() if (k := bisect.bisect_right(begins, s) - 1) < 0 or s >= ends[k]}
        return Counter(term for _, term in best.values())

    def evidence(self, folded: str) -> float:
        n, rates = folded.count(" ") - 1, self.terms
        return sum(max(0.0, k * math.log(rates[t][0] / rates[t][1]) - n * (rates[t][0] - rates[t][1])) for t, k in self.hits(folded).items())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(30.0, self.bias + self.evidence(fold(text)))))


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the places that any of the spans covers, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def grams(folded: str) -> tuple[Counter, set[str]]:
    """Patterns of a folded text: words and stems with their counts, and pairs of words."""
    words = folded.split()
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[f" {w} "] += n
        for k in STEMS:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out, {f" {a} {b} " for a, b in zip(words, words[1:])}


_COUNTED = "pattern string, toxic boolean, n long, d long"


def _batch(count: dict) -> pa.RecordBatch:
    """{(pattern, toxic): (n, d)} as rows."""
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    rows = [(*k, *v) for k, v in count.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["pattern", "toxic", "n", "d"])


def _sums(found: DataFrame) -> DataFrame:
    """pattern, n0, n1, d0, d1."""
    one = lambda c, toxic: F.sum(F.when(F.col("toxic") if toxic else ~F.col("toxic"), F.col(c)).otherwise(0)).alias(f"{c}{toxic:d}")
    return found.groupBy("pattern").agg(*(one(c, t) for c in ("n", "d") for t in (False, True)))


def _counts(rows: DataFrame, terms: dict) -> DataFrame:
    """pattern, n0, n1, d0, d1: documents without and with the label that hold the pattern (n) and in which it is dense (d);
    '' counts them all. Documents that the terms find toxic are left out."""
    known = rows.sparkSession.sparkContext.broadcast(Lexicon(terms, set()))

    def run(batches):
        for b in batches:
            n, d = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(text)
                if known.value.evidence(folded) <= -known.value.bias:
                    own, least = grams(folded)[0], DENSE * (folded.count(" ") - 1)
                    n.update((p, label > 0) for p in (*own, ""))
                    d.update((p, label > 0) for p, k in own.items() if k >= least)
            yield _batch({k: (v, d[k]) for k, v in n.items()})

    return _sums(rows.select("text", "label").mapInArrow(run, _COUNTED))


def _rates(rows: DataFrame, terms: set[str]) -> dict[str, tuple[float, float]]:
    """Each term's share of the words of the toxic documents that hold it, and of the words of all others."""
    known = rows.sparkSession.sparkContext.broadcast(Lexicon({t: (0.1 * (len(t) + 1), 0.1) for t in terms}, set()))  # the longest counts

    def run(batches):
        for b in batches:
            count: dict = {}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(text)
                n, toxic = folded.count(" ") - 1, label > 0
                for t, k in (*known.value.hits(folded).items(), ("", 0)):
                    a, c = count.get((t, toxic), (0, 0))
                    count[t, toxic] = a + k, c + n
            yield _batch(count)

    found = {r.pattern: r for r in _sums(rows.select("text", "label").mapInArrow(run, _COUNTED)).collect()}
    words = max(1, found[""].d0) if "" in found else 1
    rates = {t: ((r.n1 + 0.5) / (r.d1 + 1), (r.n0 + 0.5) / (words + 1)) for t, r in found.items() if t and r.n1}
    return {t: (q, b) for t, (q, b) in rates.items() if q > b}


def _evidence(n1: int, n0: int, share: float) -> float:
    return sum(n * math.log(n / ((n0 + n1) * p)) for n, p in ((n1, share), (n0, 1 - share)) if n)


def learn(sample: DataFrame) -> Lexicon:
    """From doc_id, text, label, by sequential covering: each round takes the patterns that are frequent in the
    toxic documents that no earlier term finds and (nearly) absent from the others, or nearly never dense there. So the
    accidental words of a group of toxic copies, which their toxic word covers, are not learned. The executors count
    patterns; the driver gets those that pass a round's shares, whose number the sample bounds."""
    first = written(_counts(sample, {}).filter(f"n1 >= {MIN_TOXIC} OR pattern = ''"))
    total = next(((r.n0, r.n1) for r in first.filter("pattern = ''").collect()), (0, 0))
    if not total[1]:
        return Lexicon({}, set())
    chosen: set[str] = set()
    terms: dict[str, tuple[float, float]] = {}
    for least, stray, dense in ROUNDS:
        c = "d" if dense else "n"
        counts = first.select("pattern", F.col(f"{c}0").alias("n0"), F.col(f"{c}1").alias("n1"))
        if terms:
            left = _counts(sample.filter("label > 0"), terms).select("pattern", F.col(f"{c}1").alias("n1"))
            counts = counts.drop("n1").join(left, "pattern")
        rows = counts.filter((F.col("pattern") != "") & (F.col("n1") >= max(MIN_TOXIC, least * total[1])) & (F.col("n0") <= stray * F.col("n1"))).collect()
        got = {r.pattern: r for r in sorted(rows) if _evidence(r.n1, r.n0, (total[1] + 1) / (sum(total) + 2)) > EVIDENCE}
        new = set()
        for p, r in got.items():
            stem = not p.endswith(" ")
            one_word = stem and any(q.endswith(" ") and q.startswith(p) and got[q].n1 >= 0.9 * r.n1 for q in got)
            shorter = any(p[:k] in got and got[p[:k]].n1 * 0.95 > r.n1 and got[p[:k]].n0 <= 2 * r.n0 + 1 for k in range(5, len(p)))
            if not one_word and not (shorter and stem):
                new.add(p)
        if new - chosen:
            chosen |= new
            terms = _rates(sample, chosen)
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(terms, set()))

    def pairs(batches):
        for b in batches:
            count: Counter = Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in grams(fold(text))[1]:
                    if shared.value.hits(p):
                        count[p, label > 0] += 1
            yield _batch({k: (v, 0) for k, v in count.items()})

    found = _sums(sample.select("text", "label").mapInArrow(pairs, _COUNTED)).filter("n0 >= 2 AND n0 >= n1")
    return Lexicon(terms, {r.pattern for r in found.select("pattern").collect()} if terms else set())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    return learn(labelled_sample(docs, labels, label, rows))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
