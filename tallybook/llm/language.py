"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
PER_LANGUAGE = 80  # labelled documents per language that the field is fitted on, each as a whole
SWITCH = 10  # words between switches of language in the code-switched half of the training data
LEXICON = 1000  # frequent words kept per language
SLOTS = 1 << 16  # hashed affixes, n-grams and words
STEPS, RATE, DECAY = 40, 0.3, 1e-4
CHUNK = 100_000  # words scored at once
FIT_CHUNK = 60_000  # words of a step of fitting that are held at once, or one text
BLOCK = 64  # words of a block of forward-backward
WORD = re.compile(r"[^\W\d_]+")
EDGE = (2, 3)  # code points put before and after a word


@dataclass
class Field:
    """A fitted field: labels, one weight row per slot, transition scores, the lexicon's words with their languages."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    member: np.ndarray


def held_out(doc_id: str | Column) -> Column:
    """Documents that are kept from training: crc32 of the id as text, modulo 4, is 2. False for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. What is neither letter nor digit may stand in a word for Python, as a raised two does; it parts words here."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words: slot numbers, and the number of the word each belongs to.

    Character bigrams and trigrams with edges, prefixes and suffixes of two to four
    characters, and the word itself. Words of any length take part whole.
    """
    marked = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word]
    rest = sizes[word] - place  # characters from here to the end of the word
    base = np.uint64(1_000_003)
    grams, owner = [], []
    gram = codes.copy()
    for n in (2, 3, 4, 5):
        gram = gram[: len(codes) - n + 1] * base + codes[n - 1 :]
        fits = rest[: len(gram)] >= n
        if n <= 3:
            grams.append(_mix(gram[fits], n))
            owner.append(word[: len(gram)][fits])
        if n >= 3:  # with its edge: affixes of two to four characters
            for salt, at in ((n + 10, place[: len(gram)] == 0), (n + 20, rest[: len(gram)] == n)):
                chosen = fits & at
                grams.append(_mix(gram[chosen], salt))
                owner.append(word[: len(gram)][chosen])
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), base, np.uint64))
    whole = np.add.reduceat(codes * powers[place], starts) if len(words) else np.empty(0, np.uint64)
    grams.append(_mix(whole, 30))
    owner.append(np.arange(len(words)))
    return np.concatenate(grams), np.concatenate(owner)


def _emissions(field: Field, words: list[str]) -> np.ndarray:
    """Scores of the labels for each word on its own."""
    slots, owner = slots_of(words)
    order = np.argsort(owner, kind="stable")
    picked = field.weights[slots[order]]
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    out = np.add.reduceat(picked, starts, axis=0) if len(words) else np.zeros((0, len(field.labels)))
    known = [field.lexicon.get(w, -1) for w in words]
    return out + np.vstack([field.member, np.zeros((1, len(field.labels)))])[known]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward values of the labels of each word, each up to a factor, and the words' own factors.

    ``scores`` has the words of many texts one after the other, ``first`` marks where a text
    begins. Words stand in blocks, all blocks advance together: products of transition matrices within a
    block, then vectors from block to block, then vectors within. So the loops run over a block's length and
    the number of blocks, not over the words, and the result is that of the plain recursion.
    """
    words, labels = scores.shape
    rows = -(-words // BLOCK)
    energy = np.exp(scores - scores.max(axis=1, keepdims=True))
    pad = rows * BLOCK - words
    energy = np.concatenate([energy, np.ones((pad, labels))]).reshape(rows, BLOCK, labels)
    start = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, BLOCK)
    step = np.exp(transitions - transitions.max())
    open_ = np.ones((labels, labels))  # a new text forgets what came before

    def one(a: np.ndarray, axes) -> np.ndarray:
        return a / np.maximum(a.max(axis=axes, keepdims=True), 1e-300)

    def sweep(energy: np.ndarray, start: np.ndarray, step: np.ndarray, after: bool) -> np.ndarray:
        # forward: emission applied after the move; backward (reversed): before it
        moves = lambda t: np.where(start[:, t, None, None], open_, step)
        product = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
        for t in range(BLOCK):
            link = moves(t) * energy[:, t, None, :] if after else moves(t)
            if not after and t:
                product = product * energy[:, t - 1, None, :]
            product = one(product @ link, (1, 2))
        if not after:
            product = product * energy[:, BLOCK - 1, None, :]
        entry = np.empty((rows, labels))
        vector = np.ones(labels)
        for r in range(rows):
            entry[r] = vector
            vector = vector @ product[r]
            vector = vector / max(vector.max(), 1e-300)
        out = np.empty((rows, BLOCK, labels))
        vector = entry
        for t in range(BLOCK):
            vector = one(np.einsum("rl,rlm->rm", vector, moves(t)), 1)
            if after:
                vector = vector * energy[:, t]
            out[:, t] = vector
            if not after:
                vector = vector * energy[:, t]
        return out

    forward = sweep(energy, start, step, True).reshape(-1, labels)[:words]
    # backward: a word looks at the next one; the move is open where the next word begins a text
    last = np.concatenate([start.reshape(-1)[1:], [True]])
    flip = lambda a: a.reshape((rows * BLOCK,) + a.shape[2:])[::-1].reshape(a.shape)
    back = sweep(flip(energy), flip(last.reshape(rows, BLOCK)), step.T, False)
    backward = flip(back).reshape(-1, labels)[:words]
    return forward, backward, energy.reshape(-1, labels)[:words]


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of the labels of each word."""
    forward, backward, _ = forward_backward(scores, first, transitions)
    joint = forward * backward
    return joint / joint.sum(axis=1, keepdims=True)


def _runs(first: np.ndarray) -> list[slice]:
    """Slices of whole texts that hold about ``FIT_CHUNK`` words each; ``first`` marks where a text begins."""
    starts = np.flatnonzero(first)
    cuts = starts[np.diff(starts // FIT_CHUNK, prepend=-1) > 0]
    return [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(first)))]


def fit(samples: list[tuple[str, str]]) -> Field:
    """Fit a field on (text, language) pairs by gradient steps on the likelihood of the labels.

    Half of the training data are plain runs of words, half are spliced from runs of
    different languages, so that transitions learn both to stay and to switch. A step goes over all
    words, some texts at a time, so what it holds does not grow with the texts.
    """
    labels = sorted({lang for _, lang in samples})
    size = len(labels)
    plain = [(words_of(text), labels.index(lang)) for text, lang in samples]
    runs = [(words[i : i + SWITCH], label) for words, label in plain for i in range(0, len(words), SWITCH)]
    shuffled = [runs[i] for i in np.random.default_rng(1).permutation(len(runs))]
    words, truth, first = [], [], []
    for group, length in ((plain, 1), (shuffled, 5)):
        for i, (run, label) in enumerate(group):
            words += run
            truth += [label] * len(run)
            first += [i % length == 0] + [False] * (len(run) - 1) if run else []
    if not words:
        return Field(labels, np.zeros((SLOTS, size)), np.zeros((size, size)), {}, np.zeros((0, size)))

    common = [w for label in range(size) for w, _ in Counter(w for run, l in plain if l == label for w in run).most_common(LEXICON)]
    lexicon = {w: i for i, w in enumerate(dict.fromkeys(common))}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, truth, first = np.fromiter(map(vocabulary.get, words), np.int32, len(words)), np.array(truth, np.int8 if size < 128 else np.int32), np.array(first)
    first[0] = True
    slots, owner = (a.astype(np.int32) for a in slots_of(list(vocabulary)))
    entry = np.array([lexicon.get(w, -1) for w in vocabulary])
    known = np.flatnonzero(entry >= 0)
    types = len(vocabulary)
    del plain, runs, shuffled, words, vocabulary

    weights, transitions, member = np.zeros((SLOTS, size)), np.zeros((size, size)), np.zeros((len(lexicon), size))
    past = [np.full_like(a, 1e-8) for a in (weights, transitions, member)]
    inner = ~first[1:]
    pairs = np.zeros((size, size))
    np.add.at(pairs, (truth[:-1][inner], truth[1:][inner]), 1)
    texts = _runs(first)
    for _ in range(STEPS):
        local = np.stack([np.bincount(owner, weights[slots, l], types) for l in range(size)], axis=1)
        local[known] += member[entry[known]]
        by_word, expected = np.zeros((types, size)), np.zeros((size, size))
        for some in texts:
            forward, backward, energy = forward_backward(local[ids[some]], first[some], transitions)
            posterior = forward * backward
            miss = np.eye(size)[truth[some]] - posterior / posterior.sum(axis=1, keepdims=True)
            for label in range(size):
                by_word[:, label] += np.bincount(ids[some], miss[:, label], types)
            within = ~first[some][1:]
            after = energy[1:][within] * backward[1:][within]
            joint = forward[:-1][within][:, :, None] * np.exp(transitions) * after[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        steps = (
            np.stack([np.bincount(slots, by_word[owner, l], SLOTS) for l in range(size)], axis=1),
            pairs - expected,
            np.stack([np.bincount(entry[known], by_word[known, l], len(lexicon)) for l in range(size)], axis=1),
        )
        for value, step, seen in zip((weights, transitions, member), steps, past):
            step = step / len(ids) - DECAY / len(ids) * value
            seen += step * step
            value += RATE * step / np.sqrt(seen)
    return Field(labels, weights, transitions, lexicon, member)


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit a field on a bounded sample: ``PER_LANGUAGE`` whole documents per language.

    Only documents with text and language that are not held out serve. They are chosen by a hash of the id,
    so the sample depends on no partitioning. The driver gets ``PER_LANGUAGE`` texts per language at most.
    """
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    # ids are ranked first; texts are fetched for the chosen rows only
    chosen = usable.select("doc_id", "lang", F.xxhash64("text").alias("h")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")))
    chosen = F.broadcast(chosen.filter(F.col("nth") <= PER_LANGUAGE).select("doc_id", "lang", "h").distinct())  # at most PER_LANGUAGE rows a language
    texts = usable.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"])
    rows = texts.select("lang", "doc_id", "text", "h").orderBy("lang", "doc_id", "h").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


class _Scorer:
    """Scores texts with a field; scores of words seen before are kept, up to a bound."""

    KEPT = 300_000

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(self.field.labels)))

    def _lookup(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (missing := np.flatnonzero(found < 0)).size:
            new = list(dict.fromkeys(words[i] for i in missing))
            start = len(self.ids)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[start : start + len(new)] = _emissions(self.field, new)
            self.ids.update(zip(new, range(start, start + len(new))))
            found[missing] = [self.ids[words[i]] for i in missing]
        scores = self.table[found]
        if len(self.ids) > self.KEPT:
            self.clear()
        return scores

    def score(self, texts: pd.Series) -> pd.DataFrame:
        labels = self.field.labels
        mean = np.zeros((len(texts), len(labels)))
        words: list[str] = []
        counts: list[tuple[int, int]] = []

        def settle() -> None:
            if not words:
                return
            sizes = np.array([n for _, n in counts])
            first = np.zeros(len(words), bool)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            first[starts] = True
            posterior = marginals(self._lookup(words), first, self.field.transitions)
            sums = np.add.reduceat(posterior, starts, axis=0) / sizes[:, None]
            mean[[i for i, _ in counts]] = sums
            words.clear()
            counts.clear()

        for i, text in enumerate(texts):
            own = words_of(text) if text else []
            if own:
                words.extend(own)
                counts.append((i, len(own)))
                if len(words) > CHUNK:
                    settle()
        settle()
        if not labels:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        best = mean.argmax(axis=1)
        seen = mean.any(axis=1)
        return pd.DataFrame({"lang_pred": np.where(seen, np.array(labels, object)[best], UNKNOWN), "score": np.clip(mean.max(axis=1), 0.0, 1.0)})


def predictor(field: Field):
    """A column function from a text to a struct of ``lang_pred`` and ``score``.

    The field goes to the tasks as one broadcast: ``SLOTS`` rows of labels, whatever the corpus holds.
    """
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(field)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            yield scorer.score(texts)

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text: id, ``held_out``, ``lang_pred``, ``score``.

    Words are runs of letters in lower case. ``score`` is the mean posterior of the predicted
    label over the words. Null texts and texts without a letter get ``und`` and 0, as all do if there is nothing
    to learn from; ties go to the first label in code point order. Repeated rows are scored each. Only the text enters a prediction.
    """
    predict = predictor(fit_documents(docs, id_col, text_col, lang_col))
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return scored.select(id_col, "held_out", "p.lang_pred", "p.score")
