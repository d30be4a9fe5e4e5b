"""Language identification of code-switched text: a linear-chain conditional random field labels every word.

A word's features are its character n-grams of one to four with marks at both ends
(those with a mark are its affixes), affixes of four characters, and the lexicons
that hold it: words that a language has and others hardly have.  Weights of features
and of transitions are learned together by gradient steps on the exact likelihood,
on a bounded sample of labelled documents; part of the sequences are pieced together
from several languages, so that the transitions know switches.  Forward-backward
over a whole document gives each word's probabilities; the document's language is
the one with the most of them.

The fit takes at most ``max_docs`` documents, by hash, evenly over the
``max_languages`` most frequent languages, and of each a window of ``window``
characters at a place by hash; that is the only bound.  Prediction reads every word
of every text in batches of the documents as they lie: nothing is shuffled, and what
a task holds are the words' probabilities of one batch.

Words are runs of letters; runs beyond 64 letters are cut.  A text that is null or has
no letter is ``und`` with score 0, and so is every text if nothing was learned.  Rows
with equal ids each give a row.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_batches

WORD = re.compile(r"[^\W\d_]{1,64}")
UNKNOWN = "und"
#: Documents and characters of each that the field is fitted on, and languages that it may learn.
MAX_DOCS, WINDOW, MAX_LANGUAGES = 2400, 400, 64
#: Words in a training sequence; gradient steps; penalty of weights.
LENGTH, STEPS, RATE, PENALTY = 40, 60, 0.08, 1e-5
#: Hashed features; the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 4
#: A lexicon's words were seen so often in the sample, with such a share in its language.
SEEN, SHARE = 3, 0.8
#: Words whose weights a worker remembers; words and characters handled at once.
MEMO, AT_ONCE, TEXT_AT_ONCE = 400_000, 100_000, 600_000
#: Words in a stretch that the passes go through side by side.
STRETCH = 64


def words_of(text: str) -> Iterator[str]:
    return (w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w)))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the word that each belongs to."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(ends, size) - np.arange(len(codes))  # characters from here to the word's end
    first = np.repeat(ends - size, size) == np.arange(len(codes))
    found, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 2):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        rest, own = left[: len(h)], owner[: len(h)]
        fits = rest >= n
        if n == 1:
            fits = fits & (codes > 3)
        elif n > LONGEST:  # the longest only at the ends: affixes
            fits = fits & (first[: len(h)] | (rest == n))
        mixed = (h[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS)
        owners.append(own[fits])
    return np.concatenate(found), np.concatenate(owners)


class Field:
    """Labels, weights of hashed features, lexicons with their weights, transitions and beginnings."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.held = np.zeros((BUCKETS, n), np.float32), np.zeros((n + 1, n), np.float32)
        self.moves, self.begins = np.zeros((n, n)), np.zeros(n)

    def lexicon_of(self, words: list[str]) -> np.ndarray:
        """Each word's lexicon; the last one holds the words of none."""
        return np.fromiter((self.lexicon.get(w, len(self.labels)) for w in words), np.int64, len(words))

    def scores(self, words: list[str]) -> np.ndarray:
        """What the features of each word say for each label."""
        out = np.empty((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), 20_000):  # bounds the features held
            part = words[at : at + 20_000]
            found, owner = features(part)
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(len(part)))
            out[at : at + len(part)] = np.add.reduceat(self.weights[found[order]], edges, axis=0) + self.held[self.lexicon_of(part)]
        return out


def probabilities(scores: np.ndarray, is_first: np.ndarray, moves: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each word's label probabilities by forward-backward over sequences that lie one behind the other.

    The row is cut into stretches that are gone through side by side: first the product of each
    stretch's steps, then the messages at its ends, then the messages within it.
    """
    n, k = scores.shape
    n_stretches = -(-n // STRETCH)
    full = n_stretches * STRETCH
    seen = np.ones((full, k), np.float32)
    seen[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    new = np.ones(full, bool)  # what fills the last stretch up belongs to no sequence
    new[:n] = is_first
    seen, new = (x.reshape(n_stretches, STRETCH, *x.shape[1:]).swapaxes(0, 1) for x in (seen, new))
    a, start = np.exp(moves - moves.max()).astype(np.float32), np.exp(begins - begins.max()).astype(np.float32)
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (n_stretches, k, k))
    for t in range(STRETCH):
        step = (product.reshape(-1, k) @ a).reshape(-1, k, k)
        step[new[t]] = product[new[t]].sum(axis=2, keepdims=True) * start
        step *= seen[t][:, None, :]
        product = step / step.reshape(n_stretches, -1).max(axis=1)[:, None, None]
    forward, backward = np.empty((n_stretches, k), np.float32), np.empty((n_stretches, k), np.float32)
    message = np.ones(k)
    for c in range(n_stretches):
        forward[c] = message
        message = message @ product[c]
        message /= message.sum()
    message = np.ones(k)
    for c in range(n_stretches - 1, -1, -1):
        backward[c] = message
        message = product[c] @ message
        message /= message.sum()
    out = np.empty((STRETCH, n_stretches, k), np.float32)
    for t in range(STRETCH):
        forward = np.where(new[t][:, None], start, forward @ a) * seen[t]
        forward /= forward.sum(axis=1, keepdims=True)
        out[t] = forward
    for t in range(STRETCH - 1, -1, -1):
        out[t] *= backward
        onward = backward * seen[t]
        backward = np.where(new[t][:, None], (onward @ start)[:, None], onward @ a.T)
        backward /= backward.sum(axis=1, keepdims=True)
    out /= out.sum(axis=2, keepdims=True)
    return out.swapaxes(0, 1).reshape(full, k)[:n]


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, window: int = WINDOW, max_languages: int = MAX_LANGUAGES, steps: int = STEPS) -> Field:
    """The field learned from ``text, lang`` of ``labelled``."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counted:
        return Field([], {})
    each = max(1, max_docs // len(counted))
    # Twice as many as wanted, so that chance leaves no language short; the least hashes of them are taken.
    share = F.create_map(*(F.lit(x) for r in counted for x in (r.lang, min(1.0, (2 * each + 20) / r["count"]))))
    chance = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    at = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int")
    chosen = rows.where(F.col("lang").isin([r.lang for r in counted])).where(chance < F.element_at(share, F.col("lang")) * (1 << 30))
    chosen = chosen.select(chance.alias("chance"), "lang", F.substring("text", at + 1, F.lit(window)).alias("part"), (at > 0).alias("inner"))
    sample = chosen.orderBy("chance", "lang", "part").limit(4 * max_docs + 40 * max_languages).collect()
    by_language: dict[str, list[list[str]]] = defaultdict(list)
    for r in sample:
        words = list(words_of(r.part))
        words = words[1:] if r.inner else words  # the window's ends cut words
        words = words[:-1] if len(r.part) == window else words
        if words and len(by_language[r.lang]) < each:
            by_language[r.lang].append(words)
    return learned({k: v for k, v in by_language.items() if v}, steps)


def sequences(by_language: dict[str, list[list[str]]], seed: int = 11) -> list[list[tuple[str, str]]]:
    """Training sequences of equal length: runs of one language and, every other one, of several."""
    random = np.random.default_rng(seed)
    texts = [(lang, words) for lang in sorted(by_language) for words in by_language[lang]]
    order = random.permutation(len(texts))
    out, now = [], []
    for k in order:
        lang, words = texts[k]
        mixed = len(out) % 2
        at = 0
        while at < len(words):
            n = int(random.integers(3, 16)) if mixed else LENGTH
            now += [(w, lang) for w in words[at : at + min(n, LENGTH - len(now))]]
            at += n
            if len(now) == LENGTH:
                out.append(now)
                now = []
            elif mixed:
                break  # the rest of the sequence is of other texts
    if now and not out:
        out.append((now * LENGTH)[:LENGTH])
    return out


def learned(by_language: dict[str, list[list[str]]], steps: int = STEPS) -> Field:
    """Gradient steps with running moments on the mean log-likelihood of all sequences."""
    labels = sorted(by_language)
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, texts in by_language.items():
        for words in texts:
            for w in words:
                seen[w][lang] += 1
    # Shares count each language alike, however much of it there is.
    weight = {lang: 1 / max(1, sum(map(len, texts))) for lang, texts in by_language.items()}
    lexicon = {}
    for w, counts in seen.items():
        shares = {lang: n * weight[lang] for lang, n in counts.items()}
        best = max(sorted(shares), key=shares.get)
        if counts[best] >= SEEN and shares[best] >= SHARE * sum(shares.values()):
            lexicon[w] = labels.index(best)
    field = Field(labels, lexicon)
    chains = sequences(by_language)
    if len(labels) < 2 or not chains:
        return field
    vocabulary = sorted({w for chain in chains for w, _ in chain})
    number = {w: k for k, w in enumerate(vocabulary)}
    ids = np.array([[number[w] for w, _ in chain] for chain in chains])
    truth = np.array([[labels.index(lang) for _, lang in chain] for chain in chains])
    found, owner = features(vocabulary)
    lexicons = field.lexicon_of(vocabulary)
    order = np.argsort(owner, kind="stable")
    found, owner = found[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(vocabulary)))
    used, found = np.unique(found, return_inverse=True)
    k, n, total = len(labels), len(chains), ids.size
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    gold_begins = np.bincount(truth[:, 0], minlength=k)
    gold_words = np.zeros((len(vocabulary), k))
    np.add.at(gold_words, (ids.ravel(), truth.ravel()), 1)
    params = [np.zeros((len(used), k)), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        weights, held, moves, begins = params
        emission = np.add.reduceat(weights[found], edges, axis=0) + held[lexicons]
        expected, pairs, starts = _expectations(emission[ids], moves, begins)
        by_word = np.zeros((len(vocabulary), k))
        for c in range(k):
            by_word[:, c] = np.bincount(ids.ravel(), expected[..., c].ravel(), len(vocabulary))
        change = (gold_words - by_word) / total
        grow = np.stack([np.bincount(found, change[owner, c], len(used)) for c in range(k)], axis=1)
        own = np.stack([np.bincount(lexicons, change[:, c], k + 1) for c in range(k)], axis=1)
        gradients = [grow, own, (gold_moves - pairs) / total, (gold_begins - starts) / total]
        for p, g, m, v in zip(params, gradients, first, second):
            g = g - PENALTY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights, field.held, field.moves, field.begins = params[0], params[1].astype(np.float32), params[2], params[3]
    field.weights[used] = weights
    return field


def _expectations(scores: np.ndarray, moves: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected labels of every word, expected transitions, expected beginnings of sequences of equal length."""
    n, length, k = scores.shape
    seen = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, start = np.exp(moves - moves.max()), np.exp(begins - begins.max())
    ahead, behind = np.empty((n, length, k)), np.ones((n, length, k))
    now = start * seen[:, 0]
    for t in range(length):
        now = now if t == 0 else (now @ a) * seen[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[:, t] = now
    for t in range(length - 1, 0, -1):
        back = (behind[:, t] * seen[:, t]) @ a.T
        behind[:, t - 1] = back / back.sum(axis=1, keepdims=True)
    expected = ahead * behind
    expected /= expected.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(1, length):
        joint = ahead[:, t - 1, :, None] * a * (behind[:, t] * seen[:, t])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return expected, pairs, expected[:, 0].sum(axis=0)


class Reader:
    """Remembers words' scores over the batches of a worker."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.rows = np.empty((0, len(field.labels)), np.float32)
        self.used = 0

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known, self.used = {}, 0
        new = list(set(words).difference(self.known))
        if new:
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.empty((self.used + 2 * len(new), self.rows.shape[1]), np.float32)])
            self.rows[self.used : self.used + len(new)] = self.field.scores(new)
            self.known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def labelled(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words of the texts, and how many words each text has."""
        parts, sizes = [], []
        held: list[str] = []
        for text in texts:
            before = len(held)
            if text is not None and len(text) > TEXT_AT_ONCE:  # a long text's words are not all held at once
                n, found = 0, (m[0] for m in WORD.finditer(text.lower()))
                if held:
                    parts.append(self.scores(held))
                    held = []
                while part := list(islice(found, AT_ONCE)):
                    part = [w for w in part if any(map(str.isalpha, w))]
                    n += len(part)
                    if part:
                        parts.append(self.scores(part))
                sizes.append(n)
                continue
            held += words_of(text or "")
            sizes.append(len(held) - before)
        if held:
            parts.append(self.scores(held))
        sizes = np.array(sizes, np.int64)
        if not parts:
            return np.empty((0, len(self.field.labels))), sizes
        starts = np.zeros(int(sizes.sum()), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return probabilities(np.concatenate(parts), starts, self.field.moves, self.field.begins), sizes


def _answers(field: Field, found: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[str, float, int, int, list[tuple[str, int, int]]]]:
    """Of each text: its language, that one's share, words, switches, and the runs of words of one language."""
    at = 0
    label = found.argmax(axis=1) if len(found) else np.empty(0, int)
    for n in sizes.tolist():
        own = found[at : at + n]
        if n == 0:
            yield UNKNOWN, 0.0, 0, 0, []
            continue
        mean = own.mean(axis=0)
        best = int(mean.argmax())
        edges = [0, *(np.flatnonzero(np.diff(label[at : at + n])) + 1).tolist(), n]
        runs = [(field.labels[label[at + a]], a, b - a) for a, b in zip(edges, edges[1:])]
        yield field.labels[best], min(1.0, float(mean[best])), n, len(edges) - 2, runs
        at += n


def identify(docs: DataFrame, field: Field, runs: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, n_words, n_switches`` for every row; with ``runs`` also the words' languages as runs (lang, first word, words)."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("lang_pred string, score double, n_words long, n_switches long, runs array<struct<lang: string, first: long, n: long>>")])
    if not runs:
        schema = T.StructType(schema.fields[:-1])
    given = spark.sparkContext.broadcast(field)  # its size is bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, reader = to_arrow_schema(schema), None
        for batch in batches:
            if reader is None:
                reader = Reader(given.value)
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                some, chars = [], 0
                while at + len(some) < batch.num_rows and (not some or chars < TEXT_AT_ONCE):
                    some.append(texts[at + len(some)].as_py())
                    chars += len(some[-1] or "")
                if reader.field.labels:
                    answers = list(_answers(reader.field, *reader.labelled(some)))
                else:
                    answers = [(UNKNOWN, 0.0, 0, 0, [])] * len(some)
                columns = list(zip(*answers))[: len(arrow) - 1]
                ids = batch.column(0).slice(at, len(some))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)
                at += len(some)

    with arrow_batches(spark, 256):
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
