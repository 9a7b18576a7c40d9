"""Toxicity: a support vector machine with a gap-weighted subsequence kernel, on Nystrom landmarks.

The kernel of two strings counts the subsequences of three letters that they share, each with a weight that falls with
the letters skipped, so `idxiot` and `i.d.iot` stay near `idiot`. Landmarks are strings of the training sentences; a
string's kernel values to them, whitened, are its features, and a squared-hinge machine is linear in these. As the
decision is then a sum over landmarks of kernel values, and the kernel is a product of explicit weights of subsequences,
the whole machine folds into one table with a weight per subsequence: that table is what scores texts.

Labels are of documents. A sentence is as toxic as its worst word, a document as its worst sentences: the words of clean
documents are all clean, and from each toxic document the worst words under the current machine are taken as toxic, in
a few rounds. The worst scores of a document and its length then give a probability by logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

DECAY, SPAN, WIDTH, WORST = 0.6, 7, 24, 4
#: Tokens whose scores a worker keeps before it starts anew.
MEMO = 300_000

# The letters that have codes of their own, and signs that stand in for letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçñíóúáôîûùïœæåø"
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_SPACED = re.compile(r"(?<!\S)(?:\w[\s.*_-]{1,2}){2,}\w(?![^\s.,!?])")
_RUN = re.compile(r"(.)\1{2,}", re.S)  # a code may be that of a line feed
_GAPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


class _Codes(dict):
    """Letters and marks of other scripts share the 62 codes: of 62 that follow each other no two have the same."""

    def __missing__(self, char: int) -> str | None:
        c = chr(char)
        value = chr(_CODE.get(c) or 1 + char * 37 % 62) if c.isalpha() or unicodedata.category(c)[0] == "M" else None
        self[char] = value
        return value


_codes = _Codes({ord(s): chr(_CODE[c]) for s, c in STAND_INS.items()})
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + "«»“”„’…–—¡¿"


def letters_of(token: str) -> bytes:
    """The letters of a token as codes: signs at its edges and between letters go, stand-ins become letters; a token
    with no letter of its own has none."""
    token = token.strip(_EDGES).lower()
    return _RUN.sub(r"\1\1", token.translate(_codes)).encode("latin-1") if any(map(str.isalpha, token)) else b""


def windows(codes: bytes) -> list[bytes]:
    """Long tokens in overlapping windows."""
    return [codes] if len(codes) <= WIDTH else [codes[i : i + WIDTH] for i in range(0, len(codes) - WIDTH // 2, WIDTH // 2)]


#: By length: the root of the summed squared weights of all subsequences.
_NORM = np.sqrt([max(1.0, sum(w * w * max(0, n - a - b) for a, b, w in _GAPS)) for n in range(WIDTH + 1)])


def _grid(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grid = np.frombuffer(b"".join(s.ljust(WIDTH, b"\0") for s in strings), np.uint8).reshape(-1, WIDTH).astype(np.int32)
    return grid, _NORM[[len(s) for s in strings]]


def _triples(grid: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    for a, b, w in _GAPS:
        n = WIDTH - a - b
        yield (grid[:, :n] << 12) | (grid[:, a : a + n] << 6) | grid[:, a + b : a + b + n], w


#: Subsequences with padding in them.
_PADDED = (np.arange(1 << 18) & 63 == 0) | (np.arange(1 << 18) >> 6 & 63 == 0) | (np.arange(1 << 18) >> 12 == 0)


def applied(table: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Each string's summed weights of subsequences, normalised; the table has zeros where there is padding."""
    out = np.zeros(len(strings))
    for at in range(0, len(strings), 4096):
        grid, norm = _grid(strings[at : at + 4096])
        total = sum(w * table[t].sum(axis=1) for t, w in _triples(grid))
        out[at : at + 4096] = total / norm
    return out


def weights_of(string: bytes) -> np.ndarray:
    """A string's normalised weight of each subsequence."""
    grid, norm = _grid([string])
    table = np.zeros(1 << 18)
    for t, w in _triples(grid):
        np.add.at(table, t.ravel(), w)
    table[_PADDED] = 0
    return table / norm[0]


@dataclass
class Model:
    table: np.ndarray
    bias: float
    weights: np.ndarray  # of the document's features, the last is the constant

    def words(self, tokens: list[str]) -> np.ndarray:
        """The decision of each token: that of its worst window."""
        cut = [windows(letters_of(t)) for t in tokens]
        flat = applied(self.table, [w for c in cut for w in c]) + self.bias
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        return np.maximum.reduceat(flat, starts) if len(flat) else flat

    def document(self, worst: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability from a document's worst decisions and its number of tokens."""
        return 1 / (1 + np.exp(-np.clip(_document_features(worst, n) @ self.weights, -30, 30)))


def tokens_of(text: str) -> list[str]:
    """Words by white space, and runs of single letters as one word each."""
    return text.split() + [re.sub(r"\s", "", m) for m in _SPACED.findall(text)]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost * weight[active]
        new = np.linalg.solve(np.eye(len(w)) + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    w, keep = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def fit(documents: list[tuple[list[str], int, int]], n_landmarks: int = 96, rounds: int = 2, seed: int = 5) -> Model | None:
    """From (tokens, how many there are with repeats, label) of a bounded number of documents: two thirds fit the machine,
    the others its probabilities. None unless both labels are among either. Where the toxic or the clean documents of the
    machine have no word of three letters, all words weigh the same, and only a text's length is left. Of equal scores the
    word met first comes first; repeated documents count as often as they are there."""
    texts = [[c for t in dict.fromkeys(tokens) for c in windows(letters_of(t)) if len(c) >= 3] for tokens, _, _ in documents]
    y = np.array([label for _, _, label in documents])
    rest = np.zeros(len(y), bool)
    for label in (0, 1):
        rest[np.flatnonzero(y == label)[2::3]] = True
    if not (0 < y[~rest].sum() < (~rest).sum() and 0 < y[rest].sum() < rest.sum()):
        return None
    vocabulary = list(dict.fromkeys(w for t in texts for w in t))
    index = {w: i for i, w in enumerate(vocabulary)}
    held = [np.array([index[w] for w in dict.fromkeys(t)], dtype=np.int64) for t in texts]
    toxic, clean = ([h for h, k, r in zip(held, y, rest, strict=True) if k == label and not r] for label in (1, 0))
    if any(map(len, toxic)) and any(map(len, clean)):
        table, bias = _machine_of_words(vocabulary, toxic, clean, n_landmarks, rounds, np.random.default_rng(seed))
    else:
        table, bias = np.zeros(1 << 18), -1.0
    score = applied(table, vocabulary) + bias
    model = Model(table.astype(np.float32), float(bias), None)
    worst, n = np.full((len(documents), WORST), -1.5), np.array([n for _, n, _ in documents])
    for i, h in enumerate(held):
        top = np.sort(score[h])[::-1][:WORST]
        worst[i, : len(top)] = top
    x = _document_features(worst, n)
    model.weights = _logistic(x[rest], y[rest].astype(float))
    return model


def _document_features(worst: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(worst, -1.5, 1.2), np.log1p(n), np.ones(len(n))])


def _machine_of_words(vocabulary: list[bytes], toxic: list[np.ndarray], clean: list[np.ndarray], n_landmarks: int, rounds: int, draw: np.random.Generator) -> tuple[np.ndarray, float]:
    """The table and the constant of the machine; documents are arrays of places in the vocabulary."""
    # first guess: how much more often toxic documents hold a word's best four-letter part, if several of them do
    grid, _ = _grid(vocabulary)
    parts = (((grid[:, :-3] << 6 | grid[:, 1:-2]) << 6 | grid[:, 2:-1]) << 6) | grid[:, 3:]
    padded = grid[:, 3:] == 0
    padded[:, 0] &= grid[:, 2] == 0  # words of three letters have one part
    names, places = np.unique(parts, return_inverse=True)
    places = places.reshape(parts.shape)
    a, b = np.zeros(len(names)), np.zeros(len(names))
    for group, count in ((toxic, a), (clean, b)):
        for h in group:
            count[np.unique(places[h][~padded[h]])] += 1
    odds = np.log((a + 0.3) / (len(toxic) + 1)) - np.log((b + 0.3) / (len(clean) + 1))
    odds[a < min(4, 1 + len(toxic) // 10)] = -9
    score = np.where(padded, -9, odds[places]).max(axis=1)
    in_clean = np.zeros(len(vocabulary), bool)
    for h in clean:
        in_clean[h] = True
    clean_words = np.flatnonzero(in_clean)
    floor = 2.0
    for _ in range(rounds):
        found: Counter = Counter()
        for h in toxic:
            found.update(w for w in h[np.argsort(-score[h])[:4]].tolist() if score[w] > floor and not in_clean[w])
        bad = [w for w, _ in found.most_common(1500)] or [int(score.argmax())]
        hard = clean_words[np.argsort(-score[clean_words])[:1000]]
        usual = draw.choice(clean_words, min(2000, len(clean_words)), replace=False)
        good = list(dict.fromkeys([*hard.tolist(), *usual.tolist()]))
        marks = [vocabulary[w] for w in [*bad[: n_landmarks * 3 // 4], *good[: n_landmarks // 8], *good[-n_landmarks // 8 :]]]
        words = [vocabulary[w] for w in [*bad, *good]]
        # one landmark's table at a time; of all of them only the subsequences that some landmark has
        kernel, parts_of = np.empty((len(words), len(marks))), []
        for j, m in enumerate(marks):
            row = weights_of(m)
            kernel[:, j] = applied(row, words)
            at = np.flatnonzero(row)
            parts_of.append((at, row[at]))
        used = np.unique(np.concatenate([at for at, _ in parts_of]))
        phi = np.zeros((len(marks), len(used)))
        for j, (at, value) in enumerate(parts_of):
            phi[j, np.searchsorted(used, at)] = value
        values, vectors = np.linalg.eigh(phi @ phi.T)
        keep = values > 1e-6 * values[-1]
        white = vectors[:, keep] / np.sqrt(values[keep])
        target = np.r_[np.ones(len(bad)), -np.ones(len(good))]
        weight = np.r_[np.full(len(bad), 0.5 * len(good) / len(bad)), np.ones(len(good))]
        w = _machine(np.column_stack([kernel @ white, np.ones(len(words))]), target, weight / weight.mean())
        table = np.zeros(1 << 18)
        table[used] = (white @ w[:-1]) @ phi
        score, floor = applied(table, vocabulary) + w[-1], 0.2
    return table, w[-1]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: Callable[[Column], Column], most: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[list[str], int, int]]:
    """At most `most` documents of label 1 and 2 * most of label 0, the first by a hash of the id, as their distinct
    tokens, how many tokens they have, and the label: what reaches the driver is bounded by `most`, however many documents
    are labelled."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label")).where(~held_out(F.col("_id")))
    chosen = known.where("_label = 1").orderBy(F.xxhash64("_id")).limit(most).unionByName(known.where("_label = 0").orderBy(F.xxhash64("_id")).limit(2 * most))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(text_col).cast("string"), "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 2 << 20):
            words = [tokens_of(x or "") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(dict.fromkeys(w)) for w in words], pa.list_(pa.string())), pa.array(map(len, words), pa.int32()), b.column(1).cast(pa.int32())], names=["words", "n", "label"])

    got = rows.mapInArrow(run, "words array<string>, n int, label int").toArrow()
    return list(zip(*(c.to_pylist() for c in got.columns), strict=True))


_memo: dict = {}


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `score` of every row's whole text: the probability that it is toxic; 0 where there is no model.
    Null texts count as empty; null and repeated ids stay as they are; a text may have any length; an empty table gives an
    empty one; other columns take no part."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # 1 MB, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if _memo.get("of") != name:  # a worker process may serve several models
            _memo.update(of=name, known={})
        for b in slices(batches, 1, 2 << 20):
            known = _memo["known"]
            if len(known) > MEMO:
                known.clear()
            texts = [tokens_of(x or "") for x in b.column(1).to_pylist()]
            worst, n = np.full((len(texts), WORST), -1.5), np.array([len(t) for t in texts])
            if model is not None:
                new = list({t for words in texts for t in words} - known.keys())
                known.update(zip(new, model.words(new).tolist(), strict=True))
                for i, words in enumerate(texts):
                    if words:
                        top = np.fromiter(map(known.__getitem__, set(words)), float)
                        top = np.sort(np.partition(top, max(0, len(top) - WORST))[-WORST:])[::-1]
                        worst[i, : len(top)] = top
            score = model.document(worst, n) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
