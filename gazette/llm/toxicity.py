"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its embedding (words of the training sample's vocabulary) beside the
mean embedding of its character n-grams, marked at both ends. All windows of WINDOW words that
begin every STEP words are scored, the last one ending with the text, and a document's
score is that of its worst window. Labels are of documents, so training alternates: score all
windows of the sample, then learn from the worst window of each document and one at random.

Workers remember the input projections of words, up to a bound; the recurrent part runs on
thousands of windows at once. Memory follows the batch, not the text: windows are made in blocks.

Training sample (a documented bound): at most MAX_POSITIVE and MAX_NEGATIVE labelled rows of
up to MAX_CHARS characters, those with the smallest hashes of doc_id; of its words the VOCABULARY commonest and of its
n-grams the NGRAMS commonest have weights, if two documents or more have them. Every document is scored, whole: words of more than
LONG characters (scripts without spaces, glued text) are pieces that overlap, each a word of the windows.

Defined cases. Null text: the empty text; empty texts get the score of an empty window. Null
label: not used to learn. Several labels for one doc_id: toxic if any is. No toxic or no
other labels to learn from: every score is 0. Null doc_id and repeated rows: scored like any other.
Empty table: empty result. Other columns are ignored, and never inputs.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import held, tidy
from gazette.staging import small_batches, stage

WINDOW, STEP, HIDDEN, WORD_DIM, CHAR_DIM = 32, 16, 8, 8, 8
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 800, 1600, 6000
VOCABULARY, NGRAMS, SIZES = 20_000, 60_000, (3, 4, 5)
EPOCHS, BATCH, RATE = 10, 128, 0.02
#: Small samples are gone through more often, until about so many steps are made, EPOCHS times MOST at most.
STEPS, MOST = 200, 4
#: Words that a worker remembers, and windows that run at once.
REMEMBERED, BLOCK = 150_000, 1024
#: New words whose projections are made at once.
LEARNT = 4096
PAD = 0
#: Characters of a word at most; texts without spaces are pieces of this length.
LONG = 64
EDGES = string.punctuation + "«»“”„‘’…–—¡¿"


def ngrams(word: str, sizes: tuple[int, ...] = SIZES) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """Words in lower case as white space parts them, punctuation at their edges still on them; longer ones than LONG in pieces."""
    words = (text or "").lower().split()
    if not words or len(max(words, key=len)) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else pieces(w))]


def pieces(word: str) -> list[str]:
    """Parts of LONG characters that overlap, so that each n-gram of the word lies in one of them."""
    over = max(SIZES) - 1
    return [word[i : i + LONG] for i in range(0, len(word) - over, LONG - over)]


def bare(word: str) -> str:
    """What the network sees of a word: without punctuation at its edges, unless it is nothing else."""
    return word.strip(EDGES) or word


def window_starts(n: int) -> np.ndarray:
    """Every STEP words, and last the window that ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Weights and the passes over windows. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, n_words: int, n_grams: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(n_words, WORD_DIM), "char": draw(n_grams, CHAR_DIM), "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for k in (0, 1):
            self.p |= {f"w{k}": draw(d, 3 * HIDDEN), f"b{k}": np.zeros(3 * HIDDEN, np.float32), f"u{k}": draw(HIDDEN, 3 * HIDDEN)}

    def run(self, x: np.ndarray, k: int, keep: list | None = None) -> np.ndarray:
        """x: input projections (T, B, 3H). Returns states (T, B, H) in the order of the text."""
        t, b, _ = x.shape
        u, h = self.p[f"u{k}"], np.zeros((b, HIDDEN), np.float32)
        out = np.empty((t, b, HIDDEN), np.float32)
        for i in range(t) if not k else range(t - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(x[i, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[i, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((i, h, a, z, r, n))
            h = n + z * (h - n)
            out[i] = h
        return out

    def pool(self, states: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of windows, attention and pooled states; pad: (T, B), true where there is no word."""
        logit = states @ self.p["attend"]
        logit[pad] -= 30.0
        e = np.exp(logit - logit.max(axis=0))
        attention = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", attention, states)
        return _sigmoid(pooled @ self.p["out"] + self.p["bias"]), attention, pooled

    def scores(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """projected: rows of both directions' input projections; ids: (B, T) rows of it."""
        out = np.empty(len(ids), np.float32)
        for at in range(0, len(ids), BLOCK):
            part = np.ascontiguousarray(ids[at : at + BLOCK].T)
            x = projected[part]
            states = np.concatenate([self.run(x[:, :, : 3 * HIDDEN], 0), self.run(x[:, :, 3 * HIDDEN :], 1)], axis=2)
            out[at : at + BLOCK] = self.pool(states, part == PAD)[0]
        return out

    def loss_and_gradients(self, inputs: np.ndarray, pad: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """inputs: (T, B, D). Mean cross-entropy, gradients of the weights behind the inputs, and of the inputs."""
        p, g, kept = self.p, {}, ([], [])
        states = np.concatenate([self.run(inputs @ p[f"w{k}"] + p[f"b{k}"], k, kept[k]) for k in (0, 1)], axis=2)
        prob, att, pooled = self.pool(states, pad)
        loss = float(-np.mean(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-7)))
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g["bias"], g["out"] = np.array([d_logit.sum()], np.float32), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_att = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = att * (d_att - (att * d_att).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = att[:, :, None] * d_pooled + d_e[:, :, None] * p["attend"]
        d_inputs = np.zeros_like(inputs)
        for k in (0, 1):
            u, du = p[f"u{k}"], np.zeros_like(p[f"u{k}"])
            dx = np.empty(inputs.shape[:2] + (3 * HIDDEN,), np.float32)
            dh = np.zeros((len(y), HIDDEN), np.float32)
            for i, h, a, z, r, n in reversed(kept[k]):
                dh = dh + d_states[i, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * a[:, 2 * HIDDEN :] * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                dx[i] = np.concatenate([dz, dr, dn], axis=1)
                du += h.T @ da
                dh = dh * z + da @ u.T
            flat = dx.reshape(-1, 3 * HIDDEN)
            g[f"u{k}"], g[f"b{k}"] = du, flat.sum(axis=0)
            g[f"w{k}"] = inputs.reshape(-1, inputs.shape[2]).T @ flat
            d_inputs += dx @ p[f"w{k}"].T
        return loss, g, d_inputs


class Classifier:
    """Vocabularies and a net; row 0 of projections is the padding, words outside the vocabulary share word row 1."""

    def __init__(self, count: dict[str, int]):
        """count: in how many documents each word is."""
        first = lambda c, least, most: sorted((x for x in c.items() if x[1] >= least), key=lambda x: (-x[1], x[0]))[:most]
        found: list[tuple[str, int]] = []
        for size in SIZES:  # one size at a time, as most n-grams occur once
            grams: Counter = Counter()
            for w, n in count.items():
                for x in set(ngrams(w, (size,))):
                    grams[x] += n
            found += first(grams, 2, NGRAMS)
        self.vocabulary = {w: i + 2 for i, (w, _) in enumerate(first(count, 2, VOCABULARY))}
        self.grams = {w: i + 1 for i, (w, _) in enumerate(first(dict(found), 2, NGRAMS))}
        self.net = Net(len(self.vocabulary) + 2, len(self.grams) + 1)
        self.constant: float | None = None

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, and n-gram rows of all words in a line with each one's count."""
        row, known = self.grams.get, self.vocabulary.get
        grams = [list(filter(None, map(row, ngrams(w)))) or [0] for w in words]  # rows of n-grams begin at 1
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.fromiter(chain.from_iterable(grams), np.int32, int(sizes.sum()))
        return np.array([known(w, 1) for w in words], np.int64), flat, sizes

    def inputs(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        word, flat, sizes = rows
        if not len(word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        ends, sums = np.cumsum(sizes), np.empty((len(word), CHAR_DIM), np.float32)
        for k in range(0, len(word), 8192):  # n-grams of some words at a time
            begin, end = ends[k] - sizes[k], ends[min(k + 8192, len(word)) - 1]
            sums[k : k + 8192] = np.add.reduceat(self.net.p["char"][flat[begin:end]], ends[k : k + 8192] - sizes[k : k + 8192] - begin, axis=0)
        return np.concatenate([self.net.p["word"][word], sums / np.sqrt(sizes)[:, None].astype(np.float32)], axis=1).astype(np.float32)

    def padding(self) -> np.ndarray:
        return np.concatenate([self.net.p["word"][:1], np.zeros((1, CHAR_DIM), np.float32)], axis=1)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        p = self.net.p
        return np.concatenate([inputs @ p["w0"] + p["b0"], inputs @ p["w1"] + p["b1"]], axis=1)


def train(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 11) -> Classifier:
    """Learns from whole texts with a label each."""
    epochs = epochs or min(max(EPOCHS, STEPS * BATCH // (2 * max(len(texts), 1))), EPOCHS * MOST)
    at: dict[str, int] = {}  # words from 1 on, in order of appearance
    bags = [np.array([at.setdefault(bare(w), len(at) + 1) for w in words_of(t)], np.int32) for t in texts]
    words = list(at)
    seen = np.bincount(np.concatenate([np.unique(b) for b in bags] or [np.zeros(0, np.int32)]), minlength=len(words) + 1)[1:]
    model = Classifier(dict(zip(words, seen.tolist())))
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        model.constant = 0.0
        return model
    rng, net = np.random.default_rng(seed), model.net
    word, flat, sizes = model.rows(words)
    begin = np.concatenate(([0, 0], np.cumsum(sizes)))  # begin[i] of word i, from 1
    owner, windows = [], []
    for k, b in enumerate(bags):
        ids = np.pad(b, (0, max(0, WINDOW - len(b))))
        cut = ids[window_starts(len(b))[:, None] + np.arange(WINDOW)]
        windows.append(cut)
        owner.append(np.full(len(cut), k))
    owner, windows = np.concatenate(owner), np.concatenate(windows)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(owner)))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1.0 if epoch < epochs * 0.6 else 0.25)
        chance = first + (rng.random(len(first)) * count).astype(np.int64)
        if epoch < 1:
            picked = np.concatenate([chance, first + (rng.random(len(first)) * count).astype(np.int64)])
        else:
            table = model.project(np.concatenate([model.padding(), model.inputs((word, flat, sizes))]))
            scored = net.scores(table, windows)
            order = np.lexsort((scored, owner))
            worst = order[first + count - 1]
            # The second worst of longer toxic documents teaches words that one window would not show.
            second = order[np.maximum(first + count - 2, first)]
            picked = np.concatenate([worst, chance[y == 0], second[(y == 1) & (scored[second] > 0.5)]])
        picked = rng.permutation(picked)
        for k in range(0, len(picked), BATCH):
            chosen = windows[picked[k : k + BATCH]]
            used, inverse = np.unique(chosen, return_inverse=True)
            real = used[used > 0]
            spans = [np.arange(begin[i], begin[i + 1]) for i in real]
            rows = (word[real - 1], flat[np.concatenate(spans)] if spans else flat[:0], sizes[real - 1])
            vectors = model.inputs(rows)
            if len(real) < len(used):
                vectors = np.concatenate([model.padding(), vectors])
            inputs = vectors[inverse.reshape(chosen.shape).T]
            _, g, d_inputs = net.loss_and_gradients(inputs, chosen.T == PAD, y[owner[picked[k : k + BATCH]]])
            d_vectors = np.zeros_like(vectors)
            np.add.at(d_vectors, inverse.reshape(chosen.shape).T.ravel(), d_inputs.reshape(-1, d_inputs.shape[2]))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            if len(real) < len(used):
                g["word"][0] = d_vectors[0, :WORD_DIM]
                d_vectors = d_vectors[1:]
            np.add.at(g["word"], rows[0], d_vectors[:, :WORD_DIM])
            shares = d_vectors[:, WORD_DIM:] / np.sqrt(rows[2])[:, None].astype(np.float32)
            np.add.at(g["char"], rows[1], np.repeat(shares, rows[2], axis=0))
            step += 1
            for name, v in net.p.items():
                m, s = moment[name]
                m += 0.1 * (g[name] - m)
                s += 0.01 * (g[name] * g[name] - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return model


class Scorer:
    """Scores documents in one worker."""

    def __init__(self, model: Classifier):
        self.model = model
        # Pages of the tables are touched only as words come.
        self.table = np.empty((REMEMBERED + 50_000, 6 * HIDDEN), np.float32)
        self.uses = np.zeros(len(self.table), np.int32)
        self.table[0] = model.project(model.padding())[0]
        self.ids = _Ids()

    def _forget(self) -> None:
        """Drops words that were met only once or twice since the last time."""
        done = self.ids.done
        kept = np.flatnonzero(self.uses[1 : done + 1] > 2) + 1
        kept = kept if len(kept) <= REMEMBERED // 2 else kept[:0]
        row = np.zeros(done + 1, np.int64)
        row[kept] = np.arange(1, len(kept) + 1)
        old, self.ids = self.ids, _Ids()
        self.ids.update((w, int(row[i])) for w, i in old.items() if row[i])
        self.ids.done = len(kept)
        self.table[1 : len(kept) + 1] = self.table[kept]
        self.uses[:] = 0

    def _learn(self) -> None:
        new = self.ids.new
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            to = self.ids.done + len(part) + 1
            while to > len(self.table):
                self.table = np.concatenate([self.table, np.empty((to, 6 * HIDDEN), np.float32)])
                self.uses = np.concatenate([self.uses, np.zeros(to, np.int32)])
            self.table[self.ids.done + 1 : to] = self.model.project(self.model.inputs(self.model.rows(part)))
            self.ids.done += len(part)
        self.ids.new = []

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        best = np.zeros(len(texts), np.float32)
        held, owners, n = [], [], 0

        def flush() -> None:
            nonlocal held, owners, n
            self._learn()
            if n:
                scored = self.model.net.scores(self.table, np.concatenate(held))
                np.maximum.at(best, np.concatenate(owners), scored)
            held, owners, n = [], [], 0

        for k, text in enumerate(texts):
            words = words_of(text)
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
            # New words of several texts are learnt together, at the latest when windows are scored.
            if len(self.ids.new) >= LEARNT or self.ids.done + len(self.ids.new) >= len(self.uses):
                self._learn()
            np.add.at(self.uses, ids, 1)
            ids = np.pad(ids, (0, max(0, WINDOW - len(ids))))
            starts = window_starts(len(words))
            for at in range(0, len(starts), 8 * BLOCK):
                part = starts[at : at + 8 * BLOCK]
                held.append(ids[part[:, None] + np.arange(WINDOW)])
                owners.append(np.full(len(part), k))
                n += len(part)
                if n >= 2 * BLOCK:
                    flush()
            if self.ids.done + len(self.ids.new) > REMEMBERED or len(self.ids) > 2 * REMEMBERED:
                flush()
                self._forget()
        flush()
        return best.astype(np.float64)


class _Ids(dict):
    """Rows of words, from 1 on; words that differ in punctuation at the edges share one. New ones are noted."""

    def __init__(self):
        self.new: list[str] = []
        self.done = 0

    def __missing__(self, word: str) -> int:
        core = bare(word)
        row = self.get(core)
        if row is None:
            self.new.append(core)
            row = self[core] = self.done + len(self.new)
        self[word] = row
        return row


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", shared.value), lambda: Scorer(shared.value))
        for b in batches:
            names = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(scorer.score(b.column("_text").to_pylist()))], [*names, "_score"])
        tidy()

    return run


def train_on(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from the bounded sample of labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as long) as string)) % 5 <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = own.where(f"length(text) <= {MAX_CHARS}")
    sized = short.select("doc_id").join(known, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    picks = [sized.where(c).orderBy("draw", "doc_id").limit(n) for c, n in (("toxic = 1", MAX_POSITIVE), ("toxic = 0", MAX_NEGATIVE))]
    chosen = stage(picks[0].unionByName(picks[1]).select("doc_id", "toxic").distinct(), "toxic-sample")
    # At most MAX_POSITIVE + MAX_NEGATIVE rows of two numbers.
    sample = short.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(MAX_POSITIVE + MAX_NEGATIVE).collect()
    return train([r["text"] for r in sample], [r["toxic"] for r in sample])


def scored_rows(docs: DataFrame, model: Classifier) -> DataFrame:
    """row (a struct of all columns of docs), _score (a float from 0 to 1)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and NGRAMS
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("_text"))
    return whole.mapInArrow(_score(shared), T.StructType([whole.schema["row"], T.StructField("_score", T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every row."""
    scored = scored_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_on(docs, labels))
    return scored.select("row.doc_id", F.col("_score").alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    return scored_rows(docs, train_on(docs, labels)).where(F.col("_score") < threshold).select("row.*")
