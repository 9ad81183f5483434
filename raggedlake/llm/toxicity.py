"""Toxic spans by a linear-chain conditional random field over words.

Labels are given per document. Word labels for training come from them: a word is a marker if it is in far more
of the toxic training documents than of the others (see markers()), and the words labelled toxic are the markers inside toxic
documents. The field has two states (clean, toxic), a weight for each known feature (a word or a beginning of words) and state, and weights for the
start and the steps between states; it is trained on short runs of words by its exact likelihood, with gradients
from forward-backward marginals. A whole document is then one chain: forward-backward gives each word's marginal
probability of being toxic. The score is the largest marginal; the spans are the runs of words at 0.5 or more,
with their character offsets.

Only known words have weights, so the words between two known ones are a power of one 2 x 2 matrix; a text costs
one pass to find its words and a few products for each known word.

The fit uses at most SAMPLE toxic and SAMPLE other labelled documents (those of the smallest hash of their id) of at most
FIT_BYTES bytes each; of their runs without markers, one in twenty. At most KNOWN words near markers are features. Every
document is scored, whatever its length.

Defined results: a null or empty text, or one without words, has score BASE and no spans. Without both labels
among the training rows every score is BASE. Null labels are ignored, repeated rows get the same score, and
columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.quality_classifier import held_out
from raggedlake.llm.text import CACHE_WORDS, column, slices, texts
from raggedlake.plans.session import prepare_workers, table

SAMPLE, SEED, RUN, KNOWN, BASE = 2_000, 5, 24, 5_000, 0.01
PREFIXES = range(4, 9)
#: Bytes of a text that the fit uses at most.
FIT_BYTES = 1 << 16
#: A gap matrix is computed up to this many words; by then it no longer changes but for its scale.
FAR = 256
WORD, TOKEN = re.compile(r"[^\W\d_]+"), re.compile(r"\S+")


def features(token: str) -> list[str]:
    """The words (runs of letters) of a token between white space, and their beginnings of PREFIXES letters marked as
    such: inflected and compound forms share them."""
    return [f for w in WORD.findall(token) for f in (w, *("^" + w[:k] for k in PREFIXES if len(w) > k))]


class Kinds(dict):
    """Word to kind; words with the same known features are of one kind, 0 being those without any.

    have lists each kind's features; feature 0 is every word's. add, if given, is called for a new kind.
    """

    def __init__(self, known: dict[str, int], add=None):
        super().__init__()
        self.known, self.sets, self.have, self.add = known, {(): 0}, [[0]], add

    def __missing__(self, word: str) -> int:
        found = tuple(sorted({self.known[f] for f in features(word) if f in self.known}))
        kind = self.sets.get(found)
        if kind is None:
            kind = self.sets[found] = len(self.have)
            self.have.append([0, *found])
            if self.add is not None:
                self.add(self.have[-1])
        if len(self) < CACHE_WORDS:
            self[word] = kind
        return kind


class Incidence:
    """Which kind has which feature, as two parallel arrays."""

    def __init__(self, have: list[list[int]], size: int):
        self.kinds, self.size = len(have), size
        self.kind = np.repeat(np.arange(len(have)), [len(h) for h in have])
        self.feature = np.array([f for h in have for f in h])

    def of_kinds(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.kind, w[self.feature, s], self.kinds) for s in range(2)], 1)

    def of_features(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.feature, g[self.kind, s], self.size) for s in range(2)], 1)


class Field:
    """The trained field: known features (to a position from 1), weights[position, state], start[state], step[state, state]."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.known, self.weights, self.start, self.step = known, weights, np.exp(start), np.exp(step)
        self.emit = [np.exp(weights[0])]
        self.odds = [float(self.emit[0][1] / self.emit[0][0])]
        self.kinds = Kinds(known, self._add)
        plain = self.step * self.emit[0]  # into a word without known features
        gaps = [np.eye(2)]
        for _ in range(FAR):
            m = gaps[-1] @ plain
            gaps.append(m / m.max())
        #: Over a gap and into the next known word; over the words after the last one.
        self.over = [tuple((m @ self.step).ravel().tolist()) for m in gaps]
        self.after = [float(m[1].sum() / m[0].sum()) for m in gaps]

    def _add(self, have: list[int]) -> None:
        self.emit.append(np.exp(self.weights[have].sum(0)))
        self.odds.append(float(self.emit[-1][1] / self.emit[-1][0]))

    def __reduce__(self) -> tuple:
        return Field, (self.known, self.weights, np.log(self.start), np.log(self.step))

    def marginals(self, at: list[int], kinds: list[int], n: int) -> list[float]:
        """Toxic marginals of the known words of a chain of n words; at: their places, kinds: their positions.

        With two states the forward and the backward vectors matter up to their scale, so each is one number, the odds of
        toxic to clean, and a step is a fraction of two sums.
        """
        over, odds = self.over, self.odds
        a, before = float(self.start[1] / self.start[0]), -1
        fore = []
        for place, kind in zip(at, kinds):
            if place == 0:
                a *= odds[kind]
            else:
                if before < 0:  # the words before the first known one: the chain's first, then a gap of place - 1
                    a *= odds[0]
                    before = 0
                p, q, r, s = over[min(place - before - 1, FAR)]
                a = (q + a * s) / (p + a * r) * odds[kind]
            fore.append(a)
            before = place
        back = self.after[min(n - 1 - at[-1], FAR)]
        out = []
        for i in range(len(at) - 1, -1, -1):
            both = fore[i] * back
            out.append(both / (1 + both) if both < 1e300 else 1.0)
            if i:
                p, q, r, s = over[min(at[i] - at[i - 1] - 1, FAR)]
                x = odds[kinds[i]] * back
                back = (r + s * x) / (p + q * x)
        out.reverse()
        return out

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and toxic spans (start, end, marginal) of a text."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; keep offsets those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = low.split()
        kinds = list(map(self.kinds.__getitem__, found))
        n = len(kinds)
        at = [i for i, w in enumerate(kinds) if w]
        if not at:
            return BASE, []
        p = self.marginals(at, [kinds[i] for i in at], n)
        spans: list[tuple[int, int, float]] = []
        hot = {i: x for i, x in zip(at, p) if x >= 0.5}
        if hot:
            last = -2
            for i, m in enumerate(TOKEN.finditer(low)):
                if i in hot:
                    if last == i - 1:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], hot[i]))
                    else:
                        spans.append((m.start(), m.end(), hot[i]))
                    last = i
        return max(BASE, *p), spans


def markers(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features whose link to toxic texts can't be chance, given how many words are tried.

    A feature's support is the number of different neighbourhoods (the words before and after) it has, a text
    counting once; so the words that near copies of one text share have a support of about one. A marker is ten
    times as frequent in toxic texts and its likelihood ratio G2 exceeds 10 + 2 ln(words tried). Markers are not
    measured against each other: those of a rare language have a small G2 however many texts there are.
    """
    support = []
    for part in (toxic, clean):
        around: dict[str, set] = defaultdict(set)
        for x in part:
            first = {w: i for i, w in reversed(list(enumerate(x)))}
            seen = set()
            for w, i in first.items():
                for f in features(w):
                    if f not in seen:
                        seen.add(f)
                        around[f].add((x[i - 1] if i else "", x[i + 1] if i + 1 < len(x) else ""))
        support.append({w: len(c) for w, c in around.items()})
    t, c = support
    nt, nc = len(toxic), len(clean)
    least, found = 10 + 2 * np.log(len(t.keys() | c.keys()) + 1), set()
    for w, n in t.items():
        m = c.get(w, 0)
        if n >= 3 and n / nt > 10 * (m + 0.5) / (nc + 1):
            share = (n + m) / (nt + nc)
            g = 2 * (n * np.log(n / (nt * share)) + (m * np.log(m / (nc * share)) if m else 0))
            if g > least:
                found.add(w)
    return found


def train(runs: np.ndarray, labels: np.ndarray, lengths: np.ndarray, parts: Incidence, steps: int = 80, rate: float = 0.3, penalty: float = 1e-4) -> list[np.ndarray]:
    """Weights (features, start, step) that maximise the likelihood of labels over padded runs of kinds."""
    n, width = runs.shape
    w = [np.zeros((parts.size, 2)), np.zeros(2), np.zeros((2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    live = np.arange(width)[None] < lengths[:, None]
    rows = np.arange(n)
    seen = [np.zeros((parts.kinds, 2)), np.zeros(2), np.zeros((2, 2))]
    np.add.at(seen[0], (runs[live], labels[live]), 1)
    seen[0] = parts.of_features(seen[0])
    np.add.at(seen[1], labels[:, 0], 1)
    pair = live[:, 1:]
    np.add.at(seen[2], (labels[:, :-1][pair], labels[:, 1:][pair]), 1)
    for t in range(1, steps + 1):
        emit, start, step = np.exp(parts.of_kinds(w[0]))[runs], np.exp(w[1]), np.exp(w[2])
        fore, back = np.empty((width, n, 2)), np.ones((width, n, 2))
        a = start * emit[:, 0]
        for i in range(width):
            if i:
                a = np.where(live[:, i, None], (a @ step) * emit[:, i], a)
            a = a / a.sum(1, keepdims=True)
            fore[i] = a
        want = [np.zeros((parts.kinds, 2)), np.zeros(2), np.zeros((2, 2))]
        for i in range(width - 1, 0, -1):
            x = emit[:, i] * back[i]
            b = x @ step.T
            back[i - 1] = np.where(live[:, i, None], b / b.sum(1, keepdims=True), back[i])
            joint = fore[i - 1][:, :, None] * step[None] * x[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            want[2] += joint[live[:, i]].sum(0)
        marg = fore * back
        marg /= marg.sum(2, keepdims=True)
        marg = marg.transpose(1, 0, 2)
        for s in range(2):
            want[0][:, s] = np.bincount(runs[live], marg[..., s][live], parts.kinds)
        want[0] = parts.of_features(want[0])
        want[1] = marg[rows, 0].sum(0)
        for i, x in enumerate(w):
            g = (want[i] - seen[i]) / n + penalty * x
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w[i] = x - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: list[tuple[str, int]], seed: int = SEED) -> Field | None:
    """The field learnt from (text, 0 or 1)."""
    words = [(t.lower().split(), y) for t, y in dict.fromkeys(docs)]
    toxic, clean = [x for x, y in words if y], [x for x, y in words if not y]
    if not toxic or not clean:
        return None
    mark = markers(toxic, clean)
    if not mark:
        return None
    near = Counter(f for x in toxic for i, v in enumerate(x) if not mark.isdisjoint(features(v)) for w in x[max(0, i - 2) : i + 3] for f in WORD.findall(w) if f not in mark)
    known = {w: i + 1 for i, w in enumerate(sorted(mark) + [w for w, c in near.most_common(KNOWN) if c >= 20])}
    kinds = Kinds(known)
    rng = np.random.default_rng(seed)
    runs, marks = [], []
    for x, y in words:
        for i in range(0, len(x), RUN):
            run = x[i : i + RUN]
            hit = [int(not mark.isdisjoint(features(w))) for w in run]
            if any(hit) or rng.random() < 0.05:
                runs.append([kinds[w] for w in run])
                marks.append(hit if y else [0] * len(run))
    lengths = np.array([len(r) for r in runs])
    pad = lambda z: np.array([r + [0] * (RUN - len(r)) for r in z])
    return Field(known, *train(pad(runs), pad(marks), lengths, Incidence(kinds.have, len(known) + 1)))


def toxic_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: id, held_out, score, predicted, spans (start, end, marginal; characters). Labels of rows with crc32(id) mod parts = part aren't used."""
    spark = docs.sparkSession
    prepare_workers(spark)
    known = labels.select(F.col(id_col), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(id_col, parts, part))
    picks = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (0, 1)]  # bounded by 2 * sample rows
    train_rows = docs.select(id_col, F.col(text_col).alias("_t")).join(F.broadcast(picks[0].unionByName(picks[1])), id_col)
    train_rows = train_rows.where(F.coalesce(F.octet_length("_t"), F.lit(0)) <= FIT_BYTES)
    rows = train_rows.select("_t", "_y", F.xxhash64(id_col).alias("h")).orderBy("h", "_y", "_t").limit(4 * sample).collect()
    field = spark.sparkContext.broadcast(fit([(r._t or "", r._y) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for b in slices(batches):
            got = [f.tag(t) if f is not None else (BASE, []) for t in texts(b)]
            spans = pa.array([[{"start": s, "end": e, "marginal": p} for s, e, p in x] for _, x in got], kind)
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([s for s, _ in got], pa.float64()), spans], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")
    out = out.withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(held_out(id_col, parts, part), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns and n_spans; toxic_scores() itself gives the spans."""
    got = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))
