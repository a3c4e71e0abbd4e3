"""Language identification by a linear-chain conditional random field over words.

Each word's features are its affixes, character bigrams and, for words of the fitted lexicon, the word itself; a
chain is a run of up to CHAIN words. Weights and label transitions maximise the conditional likelihood of the
labels (batched forward-backward, AdaGrad). The fit uses a bounded sample (FIT_ROWS documents by hash order,
FIT_CHAINS chains spread over each), half of the chains spliced from two documents, so that transitions between
languages are learned too. Prediction labels every word of every whole text by forward-backward in the tasks that
read the texts; a document's language has the largest mean posterior, which is its score.

Cases: null text, and text without a letter, gives `und` with score 0; null languages are not learned; without
learnable rows all is `und`; repeated rows get the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket

CHAIN = 64
#: Bounds of the fit: documents, and chains of each.
FIT_ROWS, FIT_CHAINS = 3000, 3
#: Words whose emission a worker keeps; then it starts anew.
CACHE = 400_000
EDGES = ".,;:!?()[]{}\"'*#$%&|<>0123456789-_/\\"


def word_features(word: str) -> list[str]:
    """Affixes, bigrams and the word; empty for words without a letter."""
    w = word.strip(EDGES)
    if not w or not any(map(str.isalpha, w)):
        return []
    return [f"^{w[:1]}", f"^{w[:2]}", f"^{w[:3]}", f"{w[-1:]}$", f"{w[-2:]}$", f"{w[-3:]}$", f"={w}", *map(str.__add__, w, w[1:])]


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chains, steps, labels) and expected transition counts, of log scores; masked steps get zeros."""
    c, n, k = emit.shape
    score = np.exp(emit - emit.max(axis=2, keepdims=True))
    move, begin = np.exp(trans), np.exp(start - start.max())
    alpha, beta = np.empty_like(score), np.empty_like(score)
    alpha[:, 0] = begin * score[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = (alpha[:, t - 1] @ move) * score[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    beta[:, n - 1] = 1.0
    for t in range(n - 2, -1, -1):
        b = (score[:, t + 1] * beta[:, t + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    post *= mask[:, :, None]
    right = score[:, 1:] * beta[:, 1:]
    norm = np.einsum("ctk,kl,ctl->ct", alpha[:, :-1], move, right, optimize=True)
    w = mask[:, 1:] / np.maximum(norm, 1e-300)
    pairs = np.einsum("ctk,ctl->kl", alpha[:, :-1] * w[:, :, None], right, optimize=True) * move
    return post, pairs


@dataclass
class Tagger:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def emission(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores of words, and which have a letter."""
        out, letters = np.zeros((len(words), len(self.labels))), np.zeros(len(words), dtype=bool)
        get, ids, at = self.index.get, [], []
        for i, w in enumerate(words):
            feats = word_features(w)
            letters[i] = bool(feats)
            known = [x for x in map(get, feats) if x is not None]
            ids += known
            at += [i] * len(known)
        if ids:
            at = np.array(at)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[starts]] = np.add.reduceat(self.weights[ids], starts, axis=0)
        return out, letters


class Reader:
    """Labels texts in a worker; keeps the emissions of the words it has seen."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.tagger.labels)), dtype=np.float32)
        self.letter = np.zeros(0, dtype=bool)

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed word posteriors (texts, labels) and the number of words with a letter."""
        if len(self.ids) > CACHE:
            self.forget()
        words = [(t or "").lower().split() for t in texts]
        new = list(set().union(*words) - self.ids.keys())
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            emit, letter = self.tagger.emission(new)
            self.emit, self.letter = np.concatenate([self.emit, emit.astype(np.float32)]), np.concatenate([self.letter, letter])
        get = self.ids.__getitem__
        flat = np.fromiter((i for w in words for i in map(get, w)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        keep = self.letter[flat]
        flat, owner = flat[keep], owner[keep]
        counts = np.bincount(owner, minlength=len(texts))
        k = len(self.tagger.labels)
        total = np.zeros((len(texts), k))
        if not len(flat):
            return total, counts
        chains = -(-counts // CHAIN)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(np.cumsum(chains) - chains, counts) + place // CHAIN
        mask = np.zeros((chains.sum(), CHAIN), dtype=bool)
        emit = np.zeros((*mask.shape, k))
        mask[row, place % CHAIN] = True
        emit[row, place % CHAIN] = self.emit[flat]
        post = tag_chains(emit, mask, self.tagger.trans, self.tagger.start)
        np.add.at(total, np.repeat(np.arange(len(texts)), chains), post.sum(axis=1))
        return total, counts


def tag_chains(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors only."""
    score = np.exp(emit - emit.max(axis=2, keepdims=True))
    move, begin = np.exp(trans), np.exp(start - start.max())
    n = emit.shape[1]
    alpha = np.empty_like(score)
    alpha[:, 0] = begin * score[:, 0]
    for t in range(1, n):
        a = (alpha[:, t - 1] @ move) * score[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((emit.shape[0], emit.shape[2]))
    for t in range(n - 2, -1, -1):
        b = (score[:, t + 1] * beta) @ move.T
        beta = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        alpha[:, t] *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha * mask[:, :, None]


def fit_tagger(samples: list[tuple[str, list[list[str]]]], epochs: int = 6, batch: int = 256, rate: float = 0.3, penalty: float = 1e-4, least: int = 2, seed: int = 1) -> Tagger | None:
    """A tagger from (label, chains of words) of documents."""
    labels = sorted({x for x, _ in samples})
    chains = [(labels.index(x), c) for x, cs in samples for c in cs if c]
    if not chains:
        return None
    rng = np.random.default_rng(seed)
    seqs = []
    for i, (y, c) in enumerate(chains):
        if i % 2 and len(chains) > 1:  # half of the chains switch language
            y2, c2 = chains[int(rng.integers(len(chains)))]
            a, b = int(rng.integers(8, CHAIN - 8)), CHAIN
            left, right = c[:a], c2[: b - a]
            seqs.append((left + right, [y] * len(left) + [y2] * len(right)))
        else:
            seqs.append((c, [y] * len(c)))
    vocabulary = sorted({w for s, _ in seqs for w in s})
    word_at = {w: i for i, w in enumerate(vocabulary)}
    feats = [word_features(w) for w in vocabulary]
    seen: dict[str, int] = {}
    for s, _ in seqs:
        for w in s:
            for f in feats[word_at[w]]:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    known = [[index[f] for f in x if f in index] for x in feats]
    k = len(labels)
    weights, trans, start = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    gains = [np.full_like(x, 1e-6) for x in (weights, trans, start)]
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for at in range(0, len(order), batch):
            own = [seqs[i] for i in order[at : at + batch]]
            mask = np.zeros((len(own), CHAIN), dtype=bool)
            word, gold = np.zeros(mask.shape, dtype=np.int64), np.zeros(mask.shape, dtype=np.int64)
            for r, (s, y) in enumerate(own):
                mask[r, : len(s)] = True
                word[r, : len(s)], gold[r, : len(s)] = [word_at[w] for w in s], y
            used, where = np.unique(word[mask], return_inverse=True)
            lists = [known[w] for w in used]
            sizes = [len(x) for x in lists]
            flat, whose = np.array([f for x in lists for f in x], dtype=np.int64), np.repeat(np.arange(len(used)), sizes)
            scores = np.zeros((len(used), k))
            np.add.at(scores, whose, weights[flat])
            emit = np.zeros((*mask.shape, k))
            emit[mask] = scores[where]
            post, pairs = forward_backward(emit, mask, trans, start)
            truth = np.eye(k)[gold] * mask[:, :, None]
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, where, (truth - post)[mask])
            d_weights = np.zeros_like(weights)
            np.add.at(d_weights, flat, by_word[whose])
            both = mask[:, 1:] & mask[:, :-1]
            d_trans = -pairs
            np.add.at(d_trans, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            d_start = (truth - post)[:, 0].sum(axis=0)
            for x, g, d in zip((weights, trans, start), gains, (d_weights, d_trans, d_start)):
                d = d / len(own) - penalty * x
                g += d * d
                x += rate * d / np.sqrt(g)
    return Tagger(labels, index, weights.astype(np.float32), trans, start)


def _chains_of(text: str, most: int = FIT_CHAINS) -> list[str]:
    """Up to `most` chains, evenly spread over the whole text."""
    words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
    starts = np.unique(np.linspace(0, max(0, len(words) - CHAIN), most).astype(int)) if words else []
    return [" ".join(words[a : a + CHAIN]) for a in starts]


def fit_sample(docs: DataFrame, held_out: tuple[int, int], rows: int = FIT_ROWS) -> list[tuple[str, list[list[str]]]]:
    """The bounded fit sample: documents outside the held-out fold with a language, at most `rows` of them by hash order of id, then
    id and text, also where many rows share an id."""
    modulus, fold = held_out
    fit = docs.filter((id_bucket("doc_id", modulus) != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order, digest = F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("h")
    # The bound on the hash comes first, without texts; then the texts below it.
    last = fit.select(order).orderBy("o").limit(rows).agg(F.max("o")).first()[0]

    def run(batches):
        for batch in batches:
            rows = [_chains_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "lang", "o", "h", "chains"])

    picked = fit.filter(order <= F.lit(last)).select("text", "doc_id", "lang", order, digest)
    chains = picked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, o long, h long, chains array<string>")
    found = chains.orderBy("o", "doc_id", "h", "lang").limit(rows).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["lang"], r["h"]))
    return [(r["lang"], [c.split() for c in r["chains"]]) for r in found]


def identify_languages(docs: DataFrame, held_out: tuple[int, int] = (4, 2), slice_rows: int = 128) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    modulus, fold = held_out
    docs = docs.select("doc_id", "text", "lang")
    tagger = fit_tagger(fit_sample(docs, held_out))

    def run(batches):
        reader = Reader(tagger) if tagger else None
        for batch in batches:
            for a in range(0, batch.num_rows, slice_rows):
                part = batch.slice(a, slice_rows)
                lang, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                if reader:
                    total, counts = reader.posteriors(part.column(1).to_pylist())
                    for i in np.flatnonzero(counts):
                        best = int(total[i].argmax())
                        lang[i], score[i] = tagger.labels[best], min(1.0, float(total[i, best] / counts[i]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", (id_bucket("doc_id", modulus) == fold).alias("held_out"), "lang_pred", "score")
