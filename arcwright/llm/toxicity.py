"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text.  A word's features are the word
itself and its first four and five letters.  Token labels for training come from the
document labels: in a document marked toxic, a word counts as toxic when one of its
features is far commoner in toxic than in clean training documents, near copies counted
once; a feature too rare for that and never seen clean counts by the share of such
features that chance does not explain.  The field is then
trained on these tagged sequences by gradient steps on the likelihood, with expectations
from forward-backward.  Scoring runs forward-backward over every whole text; the
marginals give the offending offsets and, summed up, the document's score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm.shingles import Shingler

TRAIN_DOCS = 3000
TRAIN_CHARS = 10_000
TRAIN_SLICE = 250
STEPS = 40
FLOOR = 5  # distinct toxic training texts that a feature is seen in to be telling by itself
RARE = 2  # and at least to take part by its smoothed score
SKETCH = 32  # least hashes of a text's shingles; texts that share half of them are near copies
WORDS = re.compile(r"[^\W_]+")
CACHE_WORDS = 400_000
SCORE_SLICE = 512  # texts scored at once


@dataclass
class Crf:
    """Log weights relative to the clean state, and the document-level logistic on top."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    doc: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None


def features_of(word: str) -> tuple[str, str, str]:
    return "w:" + word, "4:" + word[:4], "5:" + word[:5]


class Packed:
    """Sequences side by side, longest first, so that a step of the chain is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.rank = np.argsort(-lengths, kind="stable")
        n = lengths[self.rank]
        begin = (np.cumsum(lengths) - lengths)[self.rank]
        top = int(n[0]) if len(n) else 0
        self.live = np.searchsorted(-n, -np.arange(top), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        step = np.repeat(np.arange(top), self.live)
        who = np.arange(self.at[-1]) - self.at[step]
        self.order = begin[who] + step  # packed position -> token


def marginals(e: np.ndarray, packed: Packed, moves: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each packed token, and the forward, backward and emission factors."""
    t00, t01, t10, t11 = np.exp(moves)
    x = np.exp(np.clip(e[packed.order], -30, 30))
    a, b = np.empty_like(x), np.ones_like(x)
    at, live = packed.at, packed.live
    for t in range(len(live)):
        s = slice(at[t], at[t + 1])
        if t == 0:
            a[s] = x[s] / (1 + x[s])
            continue
        prev = a[at[t - 1] : at[t - 1] + live[t]]
        one = ((1 - prev) * t01 + prev * t11) * x[s]
        a[s] = one / ((1 - prev) * t00 + prev * t10 + one)
    for t in range(len(live) - 2, -1, -1):
        n = live[t + 1]
        nxt = slice(at[t + 1], at[t + 1] + n)
        y = x[nxt] * b[nxt]
        b[at[t] : at[t] + n] = (t10 + t11 * y) / (t00 + t01 * y)
    p = a * b / (1 - a + a * b)
    return p, a, b, x


def _pairs(packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Packed positions of neighbouring tokens."""
    live, at = packed.live, packed.at
    left = [np.arange(at[t], at[t] + live[t + 1]) for t in range(len(live) - 1)]
    right = [np.arange(at[t + 1], at[t + 2]) for t in range(len(live) - 1)]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _doc_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """1, log(1 + sum), max of the marginals of each document (tokens in text order)."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    if len(starts):
        out[some, 1] = np.log1p(np.add.reduceat(p, starts))
        out[some, 2] = np.maximum.reduceat(p, starts)
    return out


def distinct_texts(texts: list[str]) -> np.ndarray:
    """A number for each text, the same for near copies (by min-hashes of five-word shingles)."""
    shingler, out = Shingler(), np.arange(len(texts))
    sketch = np.zeros((len(texts), SKETCH), dtype=np.uint64)
    turns = np.random.default_rng(1).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)
    for i, text in enumerate(texts):
        s = shingler.distinct(text)
        sketch[i] = [(s * t).min() for t in turns] if len(s) else np.uint64(0)
    for i in range(1, len(texts)):
        near = np.flatnonzero((sketch[:i] == sketch[i]).sum(axis=1) * 2 >= SKETCH)
        for g in np.unique(out[near]):
            out[out == g] = i
    return out


def telling_features(seen: tuple[Counter, Counter], n_toxic: int, clean: int) -> dict[str, float]:
    """How surely a feature tells toxic texts, from its numbers of distinct texts of each label.

    A common one is told by its rates.  A rarer one that no clean text has gets 1 - (number
    that chance would leave without a clean text) / (number of these), within its count.
    """
    told = {f: 1.0 for f, c in seen[1].items() if c >= FLOOR and 20 * seen[0][f] <= c and math.log((c + 0.5) / (n_toxic + 1)) - math.log((seen[0][f] + 0.5) / (clean + 1)) > 2.5}
    share = seen[1].total() / max(1, seen[0].total() + seen[1].total())
    # the kinds of features have vocabularies of their own
    total = Counter((f[0], seen[0][f] + seen[1][f]) for f in seen[0] | seen[1])
    alone = Counter((f[0], c) for f, c in seen[1].items() if not seen[0][f])
    for f, c in seen[1].items():
        if RARE <= c < FLOOR and not seen[0][f] and f not in told:
            sure = 1 - total[f[0], c] * share**c / alone[f[0], c]
            if sure > 0:
                told[f] = sure
    return told


def train(texts: list[str], toxic: np.ndarray) -> Crf:
    """Fit on a bounded sample of labelled texts."""
    n_toxic = int(toxic.sum())
    if n_toxic in (0, len(texts)):
        return Crf(constant=(n_toxic + 0.5) / (len(texts) + 1) if texts else 0.0)
    number: dict[str, int] = {}
    seqs = [np.array([number.setdefault(w, len(number)) for w in WORDS.findall(x.lower())], dtype=np.int32) for x in texts]
    vocabulary = list(number)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    words: dict[tuple[int, int], set[int]] = {}  # of each distinct text
    for y, g, seq in zip(toxic, distinct_texts(texts), seqs, strict=True):
        words.setdefault((int(y), int(g)), set()).update(seq.tolist())
    for (y, _), some in words.items():
        seen[y].update({f for i in some for f in features_of(vocabulary[i])})
    of_label = Counter(y for y, _ in words)
    telling = telling_features(seen, of_label[1], of_label[0])
    known = {f: i for i, f in enumerate(f for f, c in seen[1].items() if c >= 3 or f in telling)}
    del number, seen, words
    of_word = np.array([[known.get(f, len(known)) for f in features_of(w)] for w in vocabulary], dtype=np.int32).reshape(-1, 3)
    word_toxic = np.array([max(telling.get(f, 0.0) for f in features_of(w)) for w in vocabulary])
    # slices of sequences, so that a step holds the arrays of one slice alone
    parts, observed, gold, total = [], np.zeros(len(known) + 1), np.zeros(4), 0.0
    for a in range(0, len(seqs), TRAIN_SLICE):
        lengths = np.array([len(seq) for seq in seqs[a : a + TRAIN_SLICE]])
        tokens = np.concatenate(seqs[a : a + TRAIN_SLICE])
        packed = Packed(lengths)
        y = (word_toxic[tokens] * np.repeat(toxic[a : a + TRAIN_SLICE] > 0, lengths))[packed.order]
        f = of_word[tokens[packed.order]]
        packed.order = np.arange(len(y))
        left, right = _pairs(packed)
        gold += [((1 - y[left]) * (1 - y[right])).sum(), ((1 - y[left]) * y[right]).sum(), (y[left] * (1 - y[right])).sum(), (y[left] * y[right]).sum()]
        observed += np.bincount(f.ravel(), np.repeat(y, 3), len(known) + 1)
        total += y.sum()
        parts.append((f, packed))
    del seqs, tokens, y
    size = len(known) + 2 + 4  # features, unknown, bias, moves
    theta, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[len(known) + 1] = -2.0
    for step in range(1, STEPS + 1):
        w, bias, moves = theta[: len(known) + 1], theta[len(known) + 1], tuple(theta[-4:])
        t00, t01, t10, t11 = np.exp(moves)
        g = np.concatenate([-observed, [-total], -gold])
        for f, packed in parts:
            p, a, b, x = marginals(w[f[:, 0]] + w[f[:, 1]] + w[f[:, 2]] + bias, packed, moves)
            left, right = _pairs(packed)
            al, be = a[left], x[right] * b[right]
            joint = np.stack([(1 - al) * t00, (1 - al) * t01 * be, al * t10, al * t11 * be])
            joint /= joint.sum(axis=0)
            for k in range(3):
                g[: len(known) + 1] += np.bincount(f[:, k], p, len(known) + 1)
            g[len(known) + 1] += p.sum()
            g[-4:] += joint.sum(axis=1)
        g = g / len(texts) + 1e-4 * theta
        g[len(known)] = 0.0  # features outside the training vocabulary weigh nothing
        g[-4] = 0.0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta -= 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    del parts
    names = list(known)
    model = Crf({names[i]: float(theta[i]) for i in np.flatnonzero(np.abs(theta[: len(known)]) > 0.05)}, float(theta[len(known) + 1]), tuple(float(v) for v in theta[-4:]))
    scorer = Scorer(model)
    z = np.concatenate([_doc_features(*scorer.tag([WORDS.findall(x.lower()) for x in texts[i : i + 500]])) for i in range(0, len(texts), 500)])
    c = np.zeros(3)
    for _ in range(30):  # Newton's iteration, with a ridge that keeps separable data finite
        q = 1 / (1 + np.exp(-z @ c))
        grad = z.T @ (q - toxic) + 0.05 * c
        c -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.05 * np.eye(3), grad)
    model.doc = tuple(float(v) for v in c)
    return model


class Scorer:
    def __init__(self, model: Crf):
        self.model, self.cache = model, {}

    def tag(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words in text order, and the number of words of each text."""
        cache, weights, bias = self.cache, self.model.weights, self.model.bias
        if len(cache) > CACHE_WORDS:
            cache.clear()
        flat: list[float] = []
        for ws in words:
            for w in set(ws):
                if w not in cache:
                    cache[w] = bias + sum(weights.get(f, 0.0) for f in features_of(w))
            flat += map(cache.__getitem__, ws)
        lengths = np.array([len(ws) for ws in words], dtype=np.int64)
        packed = Packed(lengths)
        p = np.empty(len(flat))
        if flat:
            p[packed.order] = marginals(np.array(flat), packed, self.model.moves)[0]
        return p, lengths

    def score(self, texts: list[str], with_spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant), [[] for _ in texts]
        p, lengths = self.tag([WORDS.findall(x.lower()) for x in texts])
        score = 1 / (1 + np.exp(-np.clip(_doc_features(p, lengths) @ np.array(self.model.doc), -500, 500)))
        if not with_spans:
            return score, []
        ends = np.cumsum(lengths)
        hot = np.flatnonzero(p > 0.5)
        spans: list[list[dict]] = [[] for _ in texts]
        for doc in np.unique(np.searchsorted(ends, hot, side="right")):
            low = texts[doc].lower()
            if len(low) != len(texts[doc]):  # lower-casing can lengthen a text: keep offsets of the original
                low = "".join(c if len(c.lower()) != 1 else c.lower() for c in texts[doc])
            where = [m.span() for m in WORDS.finditer(low)]
            mine = p[ends[doc] - lengths[doc] : ends[doc]]
            for i in np.flatnonzero(mine > 0.5):
                if i >= len(where):
                    continue
                if spans[doc] and spans[doc][-1]["word"] == i - 1:
                    spans[doc][-1] |= {"end": where[i][1], "word": i, "p": max(spans[doc][-1]["p"], float(mine[i]))}
                else:
                    spans[doc].append({"start": where[i][0], "end": where[i][1], "word": i, "p": float(mine[i])})
        for s in spans:
            for one in s:
                one.pop("word")
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Crf:
    """Train on at most ``max_docs`` labelled texts of at most ``max_chars`` characters.

    The sample holds the rows of least hash, so it is the same on every run.  Rows with
    a null doc_id, text or label are passed over; a document labelled twice counts as
    toxic if any label says so.
    """
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(chosen), "doc_id")
    few = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # the sample is bounded, and so is the task that trains on it; the driver sees the model alone
    made = few.repartition(1).mapInArrow(_train_task, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
    model = train([r[1] for r in rows], np.array([float(r[2]) for r in rows]))
    yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def score_toxicity(docs: DataFrame, model: Crf, threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text)`` with score, predicted and the offending offsets.

    One row per row of ``docs``: doc_id, score in 0..1, predicted (1 at ``threshold`` or
    more) and spans, an array of (start, end, p) in code points.  A null text counts as
    empty and gets the score of a text without toxic words.  Other columns are ignored.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            for i in range(0, len(texts), SCORE_SLICE):
                score, spans = scorer.score(texts[i : i + SCORE_SLICE])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[i : i + SCORE_SLICE].to_numpy(), "score": score, "predicted": (score >= threshold).astype("int32"), "spans": spans})

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def drop_toxic(docs: DataFrame, model: Crf, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a in range(0, batch.num_rows, SCORE_SLICE):
                part = batch.slice(a, SCORE_SLICE)
                score, _ = scorer.score([x or "" for x in part.column(at).to_pylist()], with_spans=False)
                yield part.filter(pa.array(score < threshold))

    at = docs.columns.index("text")
    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
