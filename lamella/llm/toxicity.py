"""Toxicity: a weighted finite-state pattern grammar. Insult, threat, target, negation and reported-speech transducers are composed;
matched clauses are scored, not isolated words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import digest, sized_broadcast, small_batches, stored
from lamella.llm.labelled import remainder, sample
from lamella.llm.tokens import BASE, mix64, pieces, powers, split

# Words that the grammar knows without labels.
INSULTS = "arschloch bastard bitch clown connard coward crétin depp dirtbag disgusting dumb estúpido fool freak garbage hurensohn idiot idiota imbecile imbécil imbécile jerk loser mierda moron pathetic pig pute rat salaud scum stupid stupide sucker trash trottel ugly useless vermin worthless".split()
THREATS = "attack beat bomb burn crush cut destroy die drown end hang hunt hurt kill murder punch shoot smash stab strangle".split()
TARGETS = "du he her him ihr people she them they those tu tú usted ustedes vosotros vous you your yourself".split()
NEGATIONS = "ain aren cannot doesn didn don isn jamais kein keine ne never nicht nie no none nobody not nunca pas shouldn wasn weren without won wouldn".split()
REPORTS = "alleged allegedly called calls claimed claims denied dice dijo dit quote quoted reported reportedly sagt sagte said says told wrote".split()
THREAT_CUES = "gonna i going ich je shall we werde will yo".split()

#: Labelled rows learned from at most; length in bytes of learned stems; evidence in nats, share of
#: label 1 and texts of label 1 that a learned form needs. A stem's evidence is its different words in each text, a word's its texts.
SAMPLE, STEMS, EVIDENCE, PRECISION, LEAST_DOCS = 8000, (4, 5, 6, 7), 15.0, 0.95, 3
#: The same, less strict, for forms of texts of label 1 in which no other form is known, as in a language with few labels.
BARE_EVIDENCE, BARE_PRECISION = 12.0, 0.85
#: Words for which a negation holds; strength of the prior weights of patterns.
REACH, PULL = 4, 0.05
#: Bytes of text handled at once on the driver, in the fit.
FIT_PIECE = 1 << 18
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CUE = range(7)
WORD_BREAKS = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
CLAUSE_BREAKS = np.isin(np.arange(256), np.frombuffer(b".!?;,:\n|()", np.uint8))
#: A sentence goes on over commas, colons and brackets.
SENTENCE_BREAKS = np.isin(np.arange(256), np.frombuffer(b".!?;\n|", np.uint8))
#: Typographic quotation marks and dashes, which are read as the plain quotation mark.
QUOTES, QUOTE = "[\u201c\u201d\u201e\u201f\u00ab\u00bb\u2039\u203a\u2013\u2014]", ord('"')
#: Words of a clause among which a report of the clause before it is looked for.
LEAD = 3


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` is (next state, output symbol, weight); a symbol without an arc passes and the state stays."""

    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get(state, {}).get(symbol, (state, symbol, 0.0))


def marking(mark: str, cue: int, reach: int | None) -> Transducer:
    """Marks insults and threats that come within ``reach`` words after ``cue`` (None: until the clause ends). Symbols are (kind, marks)."""
    kinds, marks = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CUE), [frozenset(m) for m in ((), ("t",), ("n",), ("r",), ("c",), ("t", "n"), ("t", "r"), ("t", "c"), ("n", "r"), ("n", "c"), ("r", "c"), ("t", "n", "r"), ("t", "n", "c"), ("t", "r", "c"), ("n", "r", "c"))]
    on = range(1, (reach or 1) + 1)
    arcs: dict = {0: {(cue, m): (max(on), (cue, m), 0.0) for m in marks}}
    for left in on:
        after = left if reach is None else left - 1
        arcs[left] = {(k, m): (max(on) if k == cue else after, (k, m | {mark}) if k in (INSULT, THREAT) and k != cue else (k, m), 0.0) for k in kinds for m in marks}
    return Transducer(arcs)


def compose(*machines: Transducer):
    """One step of all machines, each reading what the one before it wrote; weights add up. Steps are remembered once taken."""
    known: dict = {}

    def step(states, symbol):
        if (key := (states, symbol)) not in known:
            out, weight, after = symbol, 0.0, []
            for m, s in zip(machines, states, strict=True):
                s, out, w = m.step(s, out)
                after.append(s)
                weight += w
            known[key] = (tuple(after), out, weight)
        return known[key]

    return step, (0,) * len(machines)


def scoring() -> Transducer:
    """Weights of marked insults and threats: prior beliefs that labels then correct."""
    arcs = {}
    for kind, base in ((INSULT, 1.5), (THREAT, -1.0)):
        for t in ((), ("t",)):
            for n in ((), ("n",)):
                for r in ((), ("r",)):
                    for c in ((), ("c",)):
                        arcs[(kind, frozenset((*t, *n, *r, *c)))] = (0, (kind, frozenset((*t, *n, *r, *c))), base + (1.0 if t else 0) - (1.5 if n else 0) - (1.0 if r else 0) + (1.5 if c and kind == THREAT else 0))
    return Transducer({0: arcs})


#: What a matched clause can be: kind, targeted, negated, reported, cued.
PATTERNS = [(k, t, n, r, c) for k in (INSULT, THREAT) for t in (0, 1) for n in (0, 1) for r in (0, 1) for c in (0, 1)]
_PATTERN = {p: i for i, p in enumerate(PATTERNS)}


def grammar():
    return compose(marking("r", REPORT, None), marking("n", NEGATION, REACH), marking("c", CUE, REACH), marking("t", TARGET, None), scoring())


def folded(texts: pa.Array) -> pa.Array:
    """Lower case in every script, with plain quotation marks."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), QUOTES, '"')


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(split(data, np.array([0, len(data)]), np.zeros(256, bool)).hash[0])


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of words and of stems (first bytes of a word), with kind and weight."""

    hashes: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, entries: dict[int, tuple[int, float]]) -> Lexicon:
        h = np.array(sorted(entries), np.uint64)
        return cls(h, np.array([entries[int(x)][0] for x in h], np.int64), np.array([entries[int(x)][1] for x in h]))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are known, and their entries. A table of leading bits spares most searches."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(1 << 16, bool)
        table[self.hashes >> np.uint64(48)] = True
        maybe = np.flatnonzero(table[h >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[maybe]
        return maybe[ok], at[ok]


def _stems(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``k`` bytes, and hashes of their first ``k`` bytes."""
    long = np.flatnonzero(w.end - w.start > k)
    up, down = powers(len(w.low) + 1)
    total, at = np.zeros(len(long), np.uint64), w.start[long]
    for i in range(k):
        total += (w.low[at + i].astype(np.uint64) + np.uint64(1)) * up[at + i]
    return long, mix64(total * down[at] + np.uint64(k) * BASE)


def learn_lexicon(texts: list[str | None], y: np.ndarray) -> Lexicon:
    """The fixed words, and words and stems that labelled texts show to be insults: in texts of label 1 nearly alone, beyond chance. Where texts
    of label 1 hold none of these, less strict ones count that several of them share.

    A fixed insult that texts of label 0 use as often loses its weight."""
    def forms(chosen: np.ndarray) -> Iterator[np.ndarray]:
        """(form, text, word) of the chosen texts, each once, some texts at a time."""
        at = 0
        for _, data, offs in pieces(folded(pa.array([texts[k] for k in chosen], pa.string())), FIT_PIECE):
            w = split(data, offs, WORD_BREAKS)
            doc = chosen[w.doc + at].astype(np.uint64)
            at += len(offs) - 1
            for of, h in ((np.arange(len(doc)), w.hash), *(_stems(w, k) for k in STEMS)):
                yield np.unique(np.stack([h, doc[of], w.hash[of]], 1), axis=0)

    # only forms that enough texts of label 1 have can be learned, so the other texts are searched for those alone; a table of
    # counts by leading bits rules most forms out before any are kept
    seeds = np.array([word_hash(x) for x in INSULTS], np.uint64)
    ones, rough = np.flatnonzero(y > 0), np.zeros(1 << 24, np.uint8)
    for f in forms(ones):
        part, texts_of = np.unique(np.unique(f[:, :2], axis=0)[:, 0] >> np.uint64(40), return_counts=True)
        rough[part] = np.minimum(200, rough[part] + texts_of)  # the counts are wide, so the sum is too
    # a text is whole in its piece, so a piece's counts of words and of texts add up, and no list of all occurrences is held
    found = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))]
    for f in forms(ones):
        h, words = np.unique(f[:, 0], return_counts=True)
        texts_of = np.unique(np.unique(f[:, :2], axis=0)[:, 0], return_counts=True)[1]
        on = (rough[h >> np.uint64(40)] >= LEAST_DOCS) | np.isin(h, seeds)
        found.append((h[on], words[on].astype(float), texts_of[on].astype(float)))
    h, words, texts_of = (np.concatenate(x) for x in zip(*found, strict=True))
    hashes, back = np.unique(h, return_inverse=True)
    a, held = (np.bincount(back, x, len(hashes)).astype(np.int64) for x in (words, texts_of))
    enough = (held >= LEAST_DOCS) | np.isin(hashes, seeds)
    hashes, a, held = hashes[enough], a[enough], held[enough]
    below = np.zeros(len(hashes), np.int64)
    for f in forms(np.flatnonzero(y == 0)) if len(hashes) else ():
        spot = np.minimum(np.searchsorted(hashes, f[:, 0]), len(hashes) - 1)
        below += np.bincount(spot[hashes[spot] == f[:, 0]], minlength=len(hashes))
    n = a + below
    p = (y > 0).mean() if len(y) else 0.5
    p = min(max(p, 1e-3), 1 - 1e-3)
    rate = a / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(a > 0, a * np.log(np.maximum(rate, 1e-12) / p), 0) + np.where(n > a, (n - a) * np.log(np.maximum(1 - rate, 1e-12) / (1 - p)), 0)
    new = (gain >= EVIDENCE) & (rate >= PRECISION) & (held >= LEAST_DOCS)
    loose = (gain >= BARE_EVIDENCE) & (rate >= BARE_PRECISION) & ~new
    if loose.any():
        covered, bare_texts = np.zeros(len(texts), bool), np.zeros(len(hashes), np.int64)
        strict = np.concatenate([hashes[new], seeds])
        for f in forms(ones):
            covered[f[np.isin(f[:, 0], strict), 1].astype(np.int64)] = True
        for f in forms(ones[~covered[ones]]):
            h = np.unique(f[:, :2], axis=0)[:, 0]
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            bare_texts += np.bincount(spot[hashes[spot] == h], minlength=len(hashes))
        new |= loose & (bare_texts >= LEAST_DOCS)
    entries = {word_hash(x): (kind, 1.0) for kind, words in ((CUE, THREAT_CUES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for x in words}
    for x in map(word_hash, INSULTS):
        at = int(np.searchsorted(hashes, np.uint64(x)))
        i, j = (a[at], n[at]) if at < len(hashes) and int(hashes[at]) == x else (0, 0)
        entries[x] = (INSULT, float(max(0.0, (i + 2) / (j + 2) - p) / (1 - p)))
    for x, r in zip(hashes[new], rate[new], strict=True):
        entries[int(x)] = (INSULT, float((r - p) / (1 - p)))
    return Lexicon.of(entries)


def match(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon, step, start) -> np.ndarray:
    """For each text and pattern, the sum of the words' weights in matched clauses; then the best clause's weight and the sum of clauses' weights."""
    w = split(data, offs, WORD_BREAKS)
    kind, weight = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash))
    for at, h in ((np.arange(len(w.hash)), w.hash), *(_stems(w, k) for k in STEMS)):
        spot, entry = lexicon.find(h)
        better = (lexicon.kinds[entry] == INSULT) | (kind[at[spot]] == OTHER)
        kind[at[spot][better]], weight[at[spot][better]] = lexicon.kinds[entry[better]], np.maximum(weight[at[spot][better]], lexicon.weights[entry[better]])
    out = np.zeros((len(offs) - 1, len(PATTERNS) + 2))
    core = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(core):
        return out
    doc = w.doc
    marks = {name: np.concatenate([[0], np.cumsum(on[data])]) for name, on in (("clause", CLAUSE_BREAKS), ("sentence", SENTENCE_BREAKS), ("quote", np.arange(256) == QUOTE))}
    clause = marks["clause"][w.start] + doc  # grows from text to text and from clause to clause
    ends = np.flatnonzero(np.concatenate([clause[1:] != clause[:-1], [True]])) + 1
    begins = np.concatenate([[0], ends[:-1]])
    reported, quoted = _reported(kind == REPORT, begins, ends, marks["sentence"][w.start] + doc, doc, marks["quote"][w.start]), marks["quote"][w.start]
    for c in np.unique(np.searchsorted(ends, core, "right")):
        i, j = begins[c], ends[c]
        text, total, state = doc[i], 0.0, start
        # a target may follow what it is the target of, and a report what it reports, so a clause with either starts as if one had been read
        if (kind[i:j] == TARGET).any():
            state = step(state, (TARGET, frozenset()))[0]
        first = i + int(np.argmax((kind[i:j] == INSULT) | (kind[i:j] == THREAT)))
        if reported[c] or ((kind[first:j] == REPORT) & (quoted[first:j] > quoted[first])).any():
            state = step(state, (REPORT, frozenset()))[0]
        for k in range(i, j):
            state, (kd, found), arc = step(state, (int(kind[k]), frozenset()))
            if kd in (INSULT, THREAT):
                out[text, _PATTERN[(kd, *(int(m in found) for m in "tnrc"))]] += weight[k]
                total += arc * weight[k]
        out[text, -2] = max(out[text, -2], total)
        out[text, -1] += max(total, 0.0)
    return out


def _reported(report: np.ndarray, begins: np.ndarray, ends: np.ndarray, sentence: np.ndarray, doc: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    """Clauses that another clause reports: one before in the sentence, or the next, if that begins with a report (within ``LEAD``
    words) and belongs to the sentence or follows a quotation mark."""
    has = np.add.reduceat(report.astype(np.int64), begins)
    of = sentence[begins]
    before = np.concatenate([[0], np.cumsum(has)])
    earlier = before[:-1] > before[np.searchsorted(of, of, "left")]
    place = np.arange(len(report)) - np.repeat(begins, ends - begins)
    leads = np.add.reduceat((report & (place < LEAD)).astype(np.int64), begins) > 0
    after = np.zeros(len(begins), bool)
    joined = (of[1:] == of[:-1]) | (quotes[begins[1:]] > quotes[ends[:-1] - 1])
    after[:-1] = leads[1:] & joined & (doc[begins[1:]] == doc[begins[:-1]])
    return earlier | after


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    theta: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(found) @ self.theta, -30, 30)))


def inputs(found: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(found[:, :-2], 3.0), np.log1p(np.maximum(found[:, -2:], 0)), np.ones((len(found), 1))], 1)


def fit(texts: list[str | None], labels: list[int], share: float) -> Model:
    """Lexicon and weights of the patterns; the weights start from the grammar's own and are pulled to them."""
    y = np.array(labels, float) if labels else np.zeros(0)
    lexicon = learn_lexicon(texts, y)
    weights = scoring().arcs[0]
    prior = np.array([max(-2.0, weights[(k, frozenset(m for m, on in zip("tnrc", (t, n, r, c), strict=True) if on))][2]) for k, t, n, r, c in PATTERNS] + [0.5, 0.5, -3.0])
    if len(np.unique(y)) < 2:
        return Model(lexicon, prior)
    step, start = grammar()
    found = [match(data, offs, lexicon, step, start) for _, data, offs in pieces(folded(pa.array(texts, pa.string())), FIT_PIECE)]
    x = inputs(np.concatenate(found))
    weigh = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    theta = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + PULL * (theta - prior)
        theta = theta - np.clip(np.linalg.solve((x * (weigh * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + PULL * np.eye(len(theta)), grad), -2, 2)
    return Model(lexicon, theta)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """A model from at most ``sample_rows`` labelled rows outside the held-out fold, and at most ``labelled.MOST_BYTES`` of their text
    (bounds for the fit alone)."""
    train = sample(docs, labels, label, FOLDS, HELD_OUT, sample_rows, id_col, text_col, 0.25).toPandas().sort_values("id")
    counts = {r["y"]: r["count"] for r in labels.filter(remainder(F.col(id_col), FOLDS) != HELD_OUT).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    return fit(train["text"].tolist(), train["y"].tolist(), counts.get(1, 0) / max(1, counts.get(1, 0) + counts.get(0, 0)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """``id_col``, held_out, score, predicted for each row of ``docs``.

    Learned from labels: forms of insults, and weights of the grammar's patterns. Every text is scored whole. Without labels of
    both kinds, the grammar's own weights hold. Null, empty and wordless texts match nothing and get the score of that. Ids may be
    null or repeated. Other columns are ignored, so their names can't clash."""
    model = learn(docs, labels, sample_rows, id_col, text_col, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, start = grammar()
        for batch in batches:
            scores = pa.array(_scores(model, batch.column("text"), step, start), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), scores], ["id", "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        scored = stored(texts.mapInArrow(run, f"id {kind}, held_out boolean, score double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scores(model: Model, texts: pa.Array, step, start) -> np.ndarray:
    """Scores of many texts, some at a time."""
    out = [np.zeros(0)]
    for at, _, offs in pieces(texts):
        part = folded(texts.slice(at, len(offs) - 1))
        out += [model.scores(match(data, offs, model.lexicon, step, start)) for _, data, offs in pieces(part)]
    return np.concatenate(out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all their columns. Only texts go to Python, only the keys of
    rejected rows come back."""
    model = learn(docs, labels, sample_rows, id_col, text_col, label)

    def rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, start = grammar()
        for batch in batches:
            bad = pa.array(_scores(model, batch.column("text"), step, start) >= threshold)
            yield batch.select(["k1", "k2"]).filter(bad)

    k1, k2 = (h.alias(n) for h, n in zip(digest(F.col(id_col), F.col(text_col)), ("k1", "k2"), strict=True))
    with small_batches(docs.sparkSession):
        gone = stored(docs.select(k1, k2, F.col(text_col).cast("string").alias("text")).mapInArrow(rejected, "k1 long, k2 long").distinct())
    packed = docs.select(k1, k2, F.struct(*(F.col(c) for c in docs.columns)).alias("row"))  # so that no column's name can clash
    return packed.join(sized_broadcast(gone), ["k1", "k2"], "left_anti").select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
