"""Toxicity by a subsequence string kernel: Nystroem landmarks, a linear support vector machine on labelled sentences.

The kernel of two words adds up all common subsequences of ORDER letters, each weighed by DECAY to the letters that it
spans in either word; so gapped words and inserted letters count, only less. It is taken in parts of the landmark's own
and to the power of POWER, which is a kernel again, so that chance letters in common count for little. The kernel of two
sentences adds up that of their words. No word's kernel is set to zero: pairs are left out only where fewer than ORDER
letters are common in order, as it is zero then.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.common import Memo, durable, map_texts, table
from lithoflow.llm.langid import held_out

ORDER, DECAY, POWER = 4, 0.8, 3
#: Landmarks (a word's beginning counts together with its letters anywhere), their shortest and longest length.
LANDMARKS, SHORTEST, LONGEST = 40, 4, 10
#: Chance pieces that may be among the landmarks, in expectation, if labels were dealt out at random, and pieces then reckoned with.
CHANCE = 0.2
PIECES = 100_000
#: Rate in clean texts, as a part of that in toxic ones, that a landmark may have; and from which on it must begin words.
RARE, INSIDE = 0.2, 0.004
#: Stands before each word's first letter, so that a landmark can be a word's beginning.
MARK = "\x02"
#: What the kernel reads for MARK: two symbols, so that a word that only holds a beginning's letters is far from it.
BEGIN = "\x02\x04"
#: Letters of a word that are compared at a time; longer ones go window by window, half overlapping.
WIDTH = 32
#: Least word hashes by which copies among the labelled texts are told.
SKETCH = 4
#: Kernel with a landmark that makes a toxic text's sentence a labelled one, and that makes a clean one count among those all fitted to.
WITNESS, TOUCH = 0.1, 0.02
#: Share of clean texts whose margins a toxic sentence may not pass without being a text by itself.
ALONE = 0.01
#: Weight of all clean sentences, of which each has little, against all toxic ones.
CLEAN = 40.0
#: Weight of all sentences that are texts by themselves, where either class of whole texts has a half.
VIRTUAL = 0.05
#: Letters inserted in words of labelled sentences at most, and the margin below which words are alike to the curve.
GAPS, FAINT = 3, 0.02
#: Clean sentences below TOUCH that are fitted to at most, evenly spaced.
OTHERS = 2000
#: Labelled texts of either class that the classifier is fitted to at most, and code points that a text for it has at most, unless others are given.
SAMPLE, LONGEST_TEXT = 1500, 30_000
#: Shrinkage of the curve that turns margins into scores.
SHRINK = 1e-4
#: Letters of neighbouring words that are also read as one, and of a word that may stand inside such a row of three or more.
JOINED, BETWEEN = LONGEST + 2, 2
#: Stands before a row of words read as one; it must hold a landmark in one piece, as most neighbours share some letters with one by chance.
ROW = "\x03"
#: Pairs of words whose kernels are taken at a time, and steps that words' margins are rounded to.
PAIRS, STEP = 2048, 0.01
#: Words whose margins a worker remembers, and texts' words that go through the kernel at a time.
WORDS = 300_000
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_STOP = re.compile(r"[.!?](?=\s)")
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&-_/\\"
#: Single letters in a row, with blanks or marks between, are one word.
_SPELLED = re.compile(r"(?<!\w)\w(?:[\s.*_\-]\w){3,}(?!\w)")


_STOPS = str.maketrans(".!?\n", "    ")


def plain(text: str) -> str:
    """Lower case, spelled-out words joined."""
    return _SPELLED.sub(lambda m: re.sub(r"[\s.*_\-]", "", m[0]), text).lower()


def words_of(text: str) -> list[str]:
    """Words of a plain text, marks at their ends included; sentences' words are those of their text."""
    return text.translate(_STOPS).split()


def rows_of(words: list[str]) -> list[tuple[int, int, str]]:
    """Rows of neighbouring short words of a sentence, read as one: first word, end, letters. So words are found that a blank or a sentence mark cuts."""
    out = []
    sizes = list(map(len, words))
    for a, total in enumerate(map(add, sizes, sizes[1:])):
        if total > JOINED:
            continue
        b = a + 2
        while total <= JOINED:
            out.append((a, b, ROW + "".join(words[a:b])))
            if b == len(words) or sizes[b - 1] > BETWEEN:
                break
            total, b = total + sizes[b], b + 1
    return out


def parts_of(text: str) -> list[list[str]]:
    """The words of each sentence that has any, as words_of gives them."""
    cut = _STOP.sub("\n", text)  # of several marks the last ends the sentence, the others become blanks
    for mark in ".!?":
        cut = cut.replace(mark, " ")
    return [w for s in cut.split("\n") if (w := s.split())]


def read_as_one(parts: list[list[str]], landmarks: list[str]) -> set[str]:
    """A text's rows of words that hold a landmark in one piece; parts: its sentences' words."""
    joined = ["".join(p) for p in parts]
    whole = "\n".join(joined)  # a row is in one sentence
    near = [(n.lstrip(MARK), n.replace(MARK, ROW)) for n in landmarks if n.lstrip(MARK) in whole]
    out: set[str] = set()
    for p, letters in zip(parts, joined, strict=True) if near else ():
        held = [n for bare, n in near if bare in letters]
        if held:
            out.update([w for _, _, w in rows_of(p) if any([n in w for n in held])])
    return out


def vocabulary(parts: list[list[str]], landmarks: list[str]) -> set[str]:
    return read_as_one(parts, landmarks).union(*parts)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, padded by zeros."""
    padded = "".join([w[:width].ljust(width, "\0") for w in words])
    return np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32).reshape(len(words), width)


def kernel_pairs(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of s[i] and t[i], rows of code points padded by zeros, for all i at once."""
    if len(s) > PAIRS:
        return np.concatenate([kernel_pairs(s[a : a + PAIRS], t[a : a + PAIRS], order, decay) for a in range(0, len(s), PAIRS)])
    n, m, k = len(s), s.shape[1], t.shape[1]
    # pairs come last, so that each step runs through neighbouring memory
    letters = np.ascontiguousarray(t.T)
    same = ((np.ascontiguousarray(s.T)[:, None, :] == letters[None]) & (letters != 0)) * (decay * decay)
    # weight[a, b]: of subsequences of the letters so far of s[:a] and of t[:b], with the letters after them counted as a gap
    weight = np.ones((m + 1, k + 1, n))
    for found in range(order - 1):
        new = np.zeros_like(weight)
        ends = same * weight[:-1, :-1]
        # so many letters are found before either, so earlier ones add nothing
        for a in range(found, m):
            run = np.zeros(n)
            for b in range(found, k):
                run *= decay
                run += ends[a, b]
                np.multiply(new[a, b + 1], decay, out=new[a + 1, b + 1])
                new[a + 1, b + 1] += run
        weight = new
    return (same * weight[:-1, :-1]).sum((0, 1))


def _bits(words: list[str]) -> np.ndarray:
    """A set of 64 bits for each word's letters; no word is empty."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    # a zero stands for no letter, as in padded rows
    set_of = np.where(letters > 0, np.uint64(1) << (letters % 61).astype(np.uint64), np.uint64(0))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return np.bitwise_or.reduceat(set_of, np.concatenate(([0], ends[:-1]))) if words else np.zeros(0, np.uint64)


def common_letters(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of s[i] and t[i], a bit for each letter of t[i]."""

    def as_bits(rows: np.ndarray) -> np.ndarray:
        packed = np.packbits(rows, axis=1, bitorder="little")
        return np.pad(packed, ((0, 0), (0, 4 - packed.shape[1]))).view("<u4")[:, 0]

    here = np.zeros(len(s), np.uint32)
    full = as_bits(t != 0)
    for a in range(s.shape[1]):
        match = as_bits(t == s[:, a, None])  # only bits of full count
        kept = ~here & full
        both = kept & match
        here = ~(((kept + both) | (kept & ~match))) & full
    return np.bitwise_count(here)


class Landmarks:
    def __init__(self, names: list[str]):
        self.names = names
        spelled = [x.replace(MARK, BEGIN) for x in names]
        self.codes = _codes(spelled, LONGEST + len(BEGIN) - 1)
        self.bits = _bits(spelled)
        self.own = kernel_pairs(self.codes, self.codes)
        lengths = np.array([len(x) for x in spelled], int)
        # with ORDER letters in common, so many different ones are common at least
        self.least = np.bitwise_count(self.bits).astype(int) - lengths + ORDER

    def gram(self) -> np.ndarray:
        n = len(self.names)
        i, j = np.divmod(np.arange(n * n), n)
        return (kernel_pairs(self.codes[i], self.codes[j]) / np.sqrt(self.own[i] * self.own[j])).reshape(n, n) ** POWER

    def columns(self, words: list[str]) -> np.ndarray:
        """Kernels of words with all landmarks, (words, landmarks); of a long word the greatest of its windows'."""
        out = np.zeros((len(words), len(self.names)))
        pieces, of = [], []
        for i, w in enumerate(words):
            w = BEGIN + w
            for a in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2):
                pieces.append(w[a : a + WIDTH])
                of.append(i)
        if not pieces or not self.names:
            return out
        of = np.array(of)
        every = _codes(pieces, WIDTH)
        bits = _bits(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        hit = np.bitwise_count(bits[:, None] & self.bits[None, :]) >= self.least[None, :]
        rows, marks = np.nonzero(hit & (lengths >= ORDER)[:, None])
        # pairs of about a length together, so that little is spent on padding
        order = np.argsort(lengths[rows], kind="stable")
        for a in range(0, len(order), 8192):
            take = order[a : a + 8192]
            r, c = rows[take], marks[take]
            codes = every[r, : int(lengths[r].max())]
            some = common_letters(codes, self.codes[c]) >= ORDER
            r, c, codes = r[some], c[some], codes[some]
            np.maximum.at(out, (of[r], c), (kernel_pairs(codes, self.codes[c]) / self.own[c]) ** POWER)
        return out


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], count: int = LANDMARKS) -> list[str]:
    """Pieces of words that speak for label 1 beyond chance, those of the most toxic texts first.

    Of n texts with a piece k are toxic; by chance that has at most the probability exp(-n KL(k/n, share of toxic
    texts)), which times PIECES must stay under CHANCE. A piece may be in clean texts at RARE of its rate in toxic ones, one from a word's
    inside at INSIDE only. Words that hold a landmark are explained: another piece needs other words. Of pieces of a
    word that about the same texts hold, the longest is taken. Pieces are counted length by length; a longer one needs both its shorter ones.
    A word's beginning comes with its letters alone, so that the machine can tell words that begin so from others that hold them.
    """
    share = len(toxic) / (len(toxic) + len(clean))
    need = math.log(PIECES / CHANCE)
    least = max(3, math.ceil(-need / math.log(share)))
    words = {(MARK + w)[:WIDTH] for mine in (*toxic, *clean) for w in mine}
    support: dict[str, int] = {}
    rate: dict[str, float] = {}
    below: dict[str, int] | None = None
    for n in range(SHORTEST, LONGEST + 1):
        words = {w for w in words if len(w) >= n}
        of_word = {}
        for w in words:
            found = [w[a : a + n] for a in range(len(w) - n + 1)]
            of_word[w] = {p for p in found if (p.lstrip(MARK).isalpha() if below is None else p[1:] in below and p[:-1] in below)}
        counts = lambda texts: Counter(p for mine in texts for p in set().union(*[of_word.get((MARK + w)[:WIDTH], ()) for w in mine]))  # noqa: B023, E731
        below = {p: k for p, k in counts(toxic).items() if k >= least}
        against = counts(clean)
        for p, k in below.items():
            c = against[p]
            r = c / len(clean) / (k / len(toxic))
            part = k / (k + c)
            sure = (k + c) * (part * math.log(part / share) + ((1 - part) * math.log((1 - part) / (1 - share)) if c else 0.0))
            if len(p.lstrip(MARK)) >= SHORTEST and part > share and sure >= need and r < (RARE if p.startswith(MARK) else INSIDE):
                support[p], rate[p] = k, r
        words = {w for w in words if of_word[w]}
    texts_of: dict[str, set[int]] = {}
    holders: dict[str, set[str]] = {p: set() for p in support}
    for i, mine in enumerate(toxic):
        for w in mine:
            m = (MARK + w)[:WIDTH]
            held = {p for n in range(SHORTEST, LONGEST + 1) for a in range(len(m) - n + 1) if (p := m[a : a + n]) in support}
            if held:
                texts_of.setdefault(w, set()).add(i)
                for p in held:
                    holders[p].add(w)
    out: list[str] = []
    explained: set[str] = set()
    # of a piece with and without the mark the one without, which is found inside words too
    for p in sorted(support, key=lambda p: (-support[p] * (1 - rate[p]), p.startswith(MARK), -len(p), p)):
        left = holders[p] - explained
        if len(set().union(*[texts_of[w] for w in left])) < least:
            continue
        longer = (q for q in support if p in q and support[q] > 0.85 * support[p] and q.startswith(MARK) == p.startswith(MARK))
        best = max(longer, key=lambda q: (len(q), support[q], q))
        out.append(best)
        explained |= holders[best] | holders[p]
        if len(out) == count:
            break
    return list(dict.fromkeys([*out, *(p.lstrip(MARK) for p in out)]))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 2000) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, clean sentences together CLEAN times the weight of toxic ones, by accelerated gradient descent."""
    sign = np.where(y > 0, 1.0, -1.0)
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 * CLEAN / max(1, (y <= 0).sum())) * cost
    wide = np.hstack([x, np.ones((len(x), 1))])
    w, v = np.zeros(wide.shape[1]), np.zeros(wide.shape[1])
    top = np.linalg.norm((wide * np.sqrt(each)[:, None]), 2) ** 2
    rate, damp = 1 / (2 * top + 1e-3), 1e-3
    for i in range(steps):
        slack = np.maximum(0, 1 - sign * (wide @ v))
        grad = -2 * wide.T @ (each * sign * slack)
        grad[:-1] += damp * v[:-1]
        new = v - rate * grad
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Margin of a sentence: the sum of its words' margins and a constant. A text's score is a logistic curve of its
    greatest sentence's margin and of the logarithms of its greatest word's and of the squares of all its words' positive
    margins together: so many faint words don't come to one near word, and a gapped one stands out from those."""

    def __init__(self, names: list[str], weights: np.ndarray, constant: float, curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)):
        self.marks, self.weights, self.constant, self.curve = Landmarks(names) if names else None, weights, constant, curve
        self.names = names

    def word_margins(self, words: list[str]) -> list[float]:
        if self.marks is None:
            return [0.0] * len(words)
        margins = self.marks.columns([w.removeprefix(ROW) for w in words]) @ self.weights
        return (np.round(margins / STEP) * STEP).tolist()

    def measure(self, parts: list[list[str]], known: dict[str, float], words: set[str]) -> tuple[float, float, float]:
        """What the curve takes of a text; parts: its sentences' words; words: its vocabulary.

        Only words that are not zero are added up. A row counts by what it has beyond its words, the greatest first, and
        each word is in one row at most.
        """
        best, evidence, greatest = self.constant, 0.0, 0.0
        hits = {w: v for w in words if (v := known[w])}
        row_letters = [w[1:] for w in hits if w[0] == ROW]
        for mine in parts if hits else ():
            letters = "".join(mine) if row_letters else ""
            with_rows = any([x in letters for x in row_letters])
            if not with_rows and hits.keys().isdisjoint(mine):
                continue
            values = [hits[w] for w in mine if w in hits]
            rows = []
            for a, b, w in rows_of(mine) if with_rows else ():
                if w in hits:
                    inside = [hits[x] for x in mine[a:b] if x in hits]
                    more = hits[w] - sum(inside)
                    if more > 0:
                        rows.append((more, a, b, hits[w], inside))
            taken: set[int] = set()
            for _, a, b, value, inside in sorted(rows, key=lambda x: (-x[0], x[1], x[2])):
                if taken.isdisjoint(range(a, b)):
                    taken.update(range(a, b))
                    for x in inside:
                        values.remove(x)
                    values.append(value)
            if values:
                best = max(best, self.constant + sum(values))
                evidence += sum([v * v for v in values if v > 0])
                greatest = max(greatest, *values)
        return best, math.log(FAINT * FAINT + evidence), math.log(FAINT + greatest)

    def probability(self, measured: tuple[float, float, float]) -> float:
        z = sum(a * x for a, x in zip(self.curve, (*measured, 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _one_of_copies(texts: list[str], words: list[set[str]], labels: list[int]) -> tuple[list[str], list[set[str]], list[int]]:
    """One of each group of about equal texts: those with the same least hashes of longer words. Copies would make their words speak for a label."""
    first: dict[tuple, int] = {}
    for i, mine in enumerate(words):
        least = heapq.nsmallest(SKETCH, {zlib.crc32(w.encode()) for w in mine if len(w) >= 6})
        first.setdefault((labels[i], *least, *([texts[i]] if len(least) < SKETCH else [])), i)
    keep = sorted(first.values())
    return [texts[i] for i in keep], [words[i] for i in keep], [labels[i] for i in keep]


def with_gaps(word: str, gaps: int) -> str:
    """word with so many letters inserted, each at a place inside that a hash chooses."""
    for _ in range(gaps):
        h = zlib.crc32(word.encode("utf-8", "replace"))
        at = 1 + h % max(1, len(word) - 1)
        word = word[:at] + chr(97 + (h >> 8) % 26) + word[at:]
    return word


def fit(texts: list[str], labels: list[int]) -> Model:
    """Landmarks from the labelled texts; sentences of clean texts against those of toxic texts that speak for label 1.

    These are the sentences with a word near a landmark, and each toxic text's greatest sentence, by landmark hits at
    first and by the machine's own margins then. A logistic curve through the texts' margins gives scores. Without texts of both classes all scores are the share of label 1.
    """
    texts = [plain(t) for t in texts]
    words = [{w.strip(_EDGE) for w in words_of(t)} for t in texts]
    texts, words, labels = _one_of_copies(texts, words, labels)
    toxic, clean = [w for w, y in zip(words, labels, strict=True) if y], [w for w, y in zip(words, labels, strict=True) if not y]
    share = (len(toxic) + 1) / (len(texts) + 2)
    names = choose_landmarks(toxic, clean) if toxic and clean else []
    if not names:
        return Model([], np.zeros(0), 0.0, (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    marks = Landmarks(names)
    known = sorted(set().union(*words)) or [""]
    place = {w: i for i, w in enumerate(known)}
    columns = marks.columns(known)
    value, vectors = np.linalg.eigh(marks.gram())
    keep = value > 1e-6 * value.max()
    root = vectors[:, keep] / np.sqrt(value[keep])  # Nystroem: kernels with landmarks to coordinates
    doc_of, raw = [], []
    for i, t in enumerate(texts):
        for s in sentences(t) or [""]:
            at = [place[w.strip(_EDGE)] for w in words_of(s)]
            doc_of.append(i)
            raw.append(columns[at].sum(0) if at else np.zeros(len(names)))
    doc_of, raw = np.array(doc_of), np.array(raw)
    x, y = raw @ root, np.array(labels)[doc_of]
    margin = raw.max(1)
    for _ in range(3):
        best: dict[int, int] = {}
        for i in np.nonzero(y)[0].tolist():
            if doc_of[i] not in best or margin[i] > margin[best[doc_of[i]]]:
                best[doc_of[i]] = i
        against = np.nonzero(y == 0)[0]
        # of clean sentences all that touch a landmark, and as many of the others as make no difference
        touched = raw[against].max(1) >= TOUCH
        far = against[~touched]
        witness = np.array(sorted({*best.values(), *np.nonzero((y > 0) & (raw.max(1) >= WITNESS))[0].tolist()}), int)
        use = np.concatenate([witness, against[touched], far[:: max(1, len(far) // OTHERS)]])
        w, constant = svm(x[use], y[use])
        margin = x @ w + constant
    model = Model(names, root @ w, constant)
    split = [parts_of(t) for t in texts]
    one = sorted({w.strip(_EDGE) for p in split for w in read_as_one(p, names)})
    value = dict(zip([*known, *one], model.word_margins([*known, *one]), strict=True))

    def measure(parts: list[list[str]]) -> tuple[float, float, float]:
        mine = vocabulary(parts, names)
        return model.measure(parts, {w: value[w.strip(_EDGE)] for w in mine}, mine)

    # a logistic curve, classes weighed alike, by Newton's steps with a little shrinkage; toxic sentences of a margin that
    # hardly any clean text has are texts too, each also with letters inserted in its words that speak for label 1, so
    # that one such sentence is enough, and gaps in its words no way around
    measured = [measure(p) for p in split]
    sure = max(0.0, float(np.quantile([m[0] for m, y in zip(measured, labels, strict=True) if not y], 1 - ALONE)))
    strong = [[s] for p, y in zip(split, labels, strict=True) if y for s in p if measure([s])[0] > sure]
    gapped = [[[with_gaps(b, 1 + i % GAPS) if value[b] > WITNESS else b for w in s if (b := w.strip(_EDGE))]] for i, (s,) in enumerate(strong)]
    new = sorted({b for p in gapped for w in vocabulary(p, names) if (b := w.strip(_EDGE)) not in value})
    value |= dict(zip(new, model.word_margins(new), strict=True))
    alone = [measure(p) for p in (*strong, *gapped)]
    x2 = np.array(measured + alone)
    x2 = np.hstack([x2, np.ones((len(x2), 1))])
    target = np.array([*labels, *[1] * len(alone)], float)
    whole = np.arange(len(target)) < len(texts)
    weight = np.where(target > 0, np.where(whole, 0.5 / max(1, sum(labels)), VIRTUAL / max(1, len(alone))), 0.5 / (1 - target).sum())
    soft = np.where(target > 0, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    curve = np.zeros(4)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x2 @ curve, -30, 30)))
        grad = x2.T @ (weight * (p - soft)) + SHRINK * curve
        hess = (x2 * (weight * p * (1 - p))[:, None]).T @ x2 + SHRINK * np.eye(4)
        step = np.linalg.solve(hess, grad)
        curve = curve - step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(curve.tolist())
    return model


def scorer(model: Model):
    memo = Memo(WORDS)

    def values(new: list[str]) -> list[float]:
        bare = [w.strip(_EDGE) for w in new]
        different = sorted(set(bare))
        value = dict(zip(different, model.word_margins(different), strict=True))
        return [value[b] for b in bare]

    def score(texts: list[bytes | None]):
        split = [parts_of(plain((t or b"").decode("utf-8", "replace"))) for t in texts]
        words = [vocabulary(p, model.names) for p in split]
        known = memo.fill(set().union(*words), values)
        out = [model.probability(model.measure(p, known, w)) for p, w in zip(split, words, strict=True)]
        return [out, [int(p >= THRESHOLD) for p in out]]

    return score


_LATEST: dict[tuple, Callable] = {}


def shared_scorer(model: Model):
    """The scorer of this model that the worker has already, with what it remembers of words from earlier tasks."""
    key = (tuple(model.names), model.weights.tobytes(), model.constant, model.curve)
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = scorer(model)
    return _LATEST[key]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST_TEXT) -> Model:
    """Fits a model to at most `sample` labelled texts of either class of at most `longest` code points, drawn by a hash of their ids.

    More are not needed, fewer are all used; the draw is made among the texts that are short enough, and only drawn ones
    are read to the driver. Rows with a null id, label or text teach nothing; of rows with one id the text first in order does.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label) > 0).cast("int").alias("__y")).dropDuplicates(["__id"])
    own = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__t"))
    fit_in = own.where(F.length("__t") <= longest)
    there = durable(marked.join(fit_in.select("__id").distinct(), "__id", "left_semi"))
    parts = [there.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows
    rows = fit_in.join(chosen, "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t")).toPandas()
    rows = rows.sort_values(["__id"], kind="stable")
    return fit(rows["__t"].tolist(), rows["__y"].tolist())


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns, score (0 to 1) and predicted (1 at THRESHOLD or more), for whole texts.

    Only the text goes into a score. Null and empty texts have no sentence and get the score of the constant. Very long
    texts are scored whole, their greatest sentence counting; repeated rows are scored one by one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    return map_texts(docs, text, keep, [("score", T.DoubleType()), ("predicted", T.IntegerType())], lambda: shared_scorer(model))


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 3, 1)))
    return toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
