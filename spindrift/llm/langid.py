"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton. A text is parsed from left to right into the longest
phrases that occur in that language's text; the language that needs the fewest phrases wins, since a phrase
costs about log2(training length) bits. The automata are dense transition tables, so that one numpy step reads
one symbol of thousands of texts against all languages at once. A table grows with the text that a language is
learned from (at most 8 texts, 256 bytes a state), and the broadcast model with the number of languages.

A text is folded (lower case, one separator between words, letters only) and parsed as a whole.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the first language by
name; null or empty labels are not learned; without any label all rows are `und`; an empty table gives no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

import collections
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.memory import release

#: Bound of the training sample: rows of each language, whole texts. The sample is the distinct texts of least hash.
TRAIN_ROWS = 8
#: So many pairs of a text and a language are read one by one rather than together.
FEW = 128
#: Symbols of the tables: 0 separates words, the last stands for any letter that no sample holds. Of the others each
#: letter of the samples has its own code: one symbol, or where there are more letters, several for the rarer ones.
ALPHABET = 64
BLOCK_SYMBOLS = 1 << 20


def fold(text: str) -> str:
    """Lower-cased letters with single spaces between words."""
    s = text.lower()
    return " ".join("".join(c if c.isalpha() else " " for c in s).split()) if not s.isalpha() else s


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def spellings(n: int) -> list[tuple[int, ...]]:
    """n codes of symbols, none the start of another, the shorter ones first."""
    codes = collections.deque((i,) for i in range(1, ALPHABET - 1))
    while len(codes) < n:
        first = codes.popleft()
        codes.extend((*first, i) for i in range(1, ALPHABET - 1))
    return list(codes)[:n]


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of a symbol sequence as a table (state, symbol) -> next state, -1 where there is none."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int64)
    for s, to in enumerate(nxt):
        if to:
            table[s, list(to)] = list(to.values())
    return table


class Model:
    """languages: names in order; table: all automata end to end; cost: bits of a phrase in each language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        text = "".join(samples.values())
        letters = [c for c, _ in sorted(collections.Counter(text).items(), key=lambda x: (-x[1], x[0])) if c != " "]
        self.codes = {ord(c): i + 1 for i, c in enumerate(letters)}
        spelled = [(0,), *spellings(len(letters)), (ALPHABET - 1,)]
        self.lengths = np.array([len(x) for x in spelled])
        self.spelled = np.zeros((len(spelled), int(self.lengths.max())), np.uint8)
        for row, x in zip(self.spelled, spelled):
            row[: len(x)] = x
        parts, self.roots, at, self.cost = [], [], 0, []
        for lang in self.languages:
            cp = np.frombuffer(samples[lang].encode("utf-32-le"), np.uint32)
            t = automaton(self._spell(np.array([self.codes.get(int(c), 0) for c in cp], np.int64)), ALPHABET)
            root = np.where(t[0] < 0, 0, t[0])
            # a missing transition ends the phrase: ~(the state that a new phrase starts with)
            t = np.where(t < 0, ~((root[None, :] + at) * ALPHABET), (t + at) * ALPHABET)
            parts.append(t.astype(np.int32).ravel())
            self.roots.append(at * ALPHABET)
            self.cost.append(float(np.log2(max(2, len(cp)))))
            at += len(parts[-1]) // ALPHABET
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _spell(self, letters: np.ndarray) -> np.ndarray:
        """The symbols of a sequence of letters (their numbers)."""
        if self.spelled.shape[1] == 1:
            return self.spelled[letters, 0]
        return self.spelled[letters][np.arange(self.spelled.shape[1])[None, :] < self.lengths[letters][:, None]]

    @functools.cached_property
    def _map(self) -> np.ndarray:
        """For each code point the number of its letter: 0 is none, the last an unknown one."""
        last = len(self.lengths) - 1
        m = np.where(_letters() > 0, last, 0).astype(np.uint8 if last < 256 else np.int32)
        for c, i in self.codes.items():
            m[c] = i
        return m

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_map"}

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts end to end, without repeated separators, and each text's bounds."""
        joined = "\n".join(texts)
        cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cp) != len(joined):  # lower-casing changed some length: fold text by text
            texts = [t.lower() for t in texts]
            cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self._map[cp]
        ends = np.cumsum([len(t) + 1 for t in texts])
        keep = np.ones(len(s), bool)  # of a run of separators the last one, if a letter of the same text is before it
        if len(s):
            keep[:-1] = (s[:-1] != 0) | (s[1:] != 0)
            keep[-1] = s[-1] != 0
        letter = np.append(np.flatnonzero(s), 0)
        first = letter[np.searchsorted(letter[:-1], np.concatenate([[0], ends[:-1]]))]  # each text's first letter, or a later one's
        first = first[first > 0]
        keep[first - 1] &= s[first - 1] != 0
        at = np.minimum(ends, len(s))
        kept = np.concatenate([[0], np.cumsum(keep if self.spelled.shape[1] == 1 else np.where(keep, self.lengths[s], 0))])
        return self._spell(s[keep]), np.concatenate([[0], kept[at]])

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases that each text's symbols need. A step reads one symbol of every text that is long
        enough, against all languages; the last few texts are read one by one."""
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.languages)), np.int64)
        order = np.argsort(-n, kind="stable")
        order = order[: int(np.count_nonzero(n))]
        if not len(order):
            return out
        start, size = bounds[order], n[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        count = np.ones(state.shape, np.int32)
        few = FEW // max(1, len(self.languages))
        together = int(size[few]) if len(size) > few else 0
        active = np.searchsorted(-size, -np.arange(1, together + 1), "right")  # texts that have a symbol t
        for t in range(together):
            k = int(active[t])
            x = self.table[state[:, :k] + symbols[start[:k] + t]]
            fails = x >> 31
            count[:, :k] -= fails
            state[:, :k] = x ^ fails
        table = memoryview(self.table)
        for i in range(min(few, len(order))):
            rest = symbols[start[i] + together : start[i] + size[i]].tobytes()
            for j in range(len(self.languages)):
                at, more = int(state[j, i]), 0
                for c in rest:
                    at = table[at + c]
                    if at < 0:
                        at = ~at
                        more += 1
                count[j, i] += more
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [t or "" for t in texts]
        symbols, bounds = self.symbols(clean)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        letters = np.concatenate([[0], np.cumsum(symbols > 0)])
        some = letters[bounds[1:]] > letters[bounds[:-1]]
        bits = self.phrases(symbols, bounds) * np.array(self.cost)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -60)).sum(1)
        return [self.languages[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0).tolist()


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """labelled: lang, text. Learns from at most `rows` distinct whole texts of each language."""
    own = labelled.filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("_h"))
    # the least hashes of each language first, so that copies count once and other texts aren't shuffled
    least = own.select("lang", "_h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_n") <= rows).select("lang", "_h")
    some = own.join(F.broadcast(least), ["lang", "_h"]).groupBy("lang", "_h", "text").count()
    best = some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).filter(F.col("_n") <= rows)
    samples: dict[str, list[str]] = {}
    for r in best.select("lang", "_n", "text").orderBy("lang", "_n").toLocalIterator():
        samples.setdefault(r.lang, []).append(fold(r.text))
    return Model({k: " ".join(filter(None, v)) for k, v in samples.items() if any(v)})


def identify(docs: DataFrame, model: Model, *keep: str | Column, row: bool = False) -> DataFrame:
    """The columns in keep, and lang_pred and score for every row of docs (text). row: keep is one struct that holds the
    text, which then needn't be passed twice."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*keep) if row else docs.select(*keep, F.col("text").alias("_text"))
    passed = len(keep)
    schema = T.StructType([*own.schema.fields[:passed], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        for b in batches:
            texts = (b.column(0).field("text") if row else b.column(passed)).to_pylist()
            langs: list = [None] * len(texts)
            scores = np.zeros(len(texts))
            order, first = sorted(range(len(texts)), key=lambda i: len(texts[i] or "")), 0
            while first < len(order):  # blocks of bounded length, of texts of like length; a longer text is a block of its own
                last, size = first, 0
                while last < len(order) and (last == first or size + len(texts[order[last]] or "") < BLOCK_SYMBOLS):
                    size += len(texts[order[last]] or "")
                    last += 1
                own = order[first:last]
                got, scores[own] = model.predict([texts[i] for i in own])
                for i, lang in zip(own, got):
                    langs[i] = lang
                first = last
            yield pa.RecordBatch.from_arrays([*b.columns[:passed], pa.array(langs, pa.string()), pa.array(scores)], [*b.schema.names[:passed], "lang_pred", "score"])

        release()

    return own.mapInArrow(run, schema)
