"""One pass over texts for everything that is looked for in them.

The dictionary becomes an automaton over words, in flat arrays that are broadcast: phrases in order, phrases in any order,
surname forms and full names are paths from one root each, and a text's word may follow several edges, one for each
dictionary word that it equals. A batch of texts is cut to tokens as arrays of code points, its words are looked up by hashes
(and compared), and those known walk the automaton level by level, from all of them at a time. Patterns run over the same
texts, and their hits meet the tokens by a search in sorted places.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens tile a text: runs of letters, digits and underscores, of white space, and of anything else.
TOKEN = re.compile(r"\w+|\s+|[^\w\s]+")
ORDERED, FREE, SURNAME = 0, 1, 2
#: Words of the dictionary in one automaton; a larger dictionary becomes several. A word takes some 100 bytes.
MOST_WORDS = 1_000_000
#: Bytes of the texts that are held as tokens at a time, some 50 bytes for each. A text of more characters is cut to windows.
SLICE = 1 << 19
#: Characters of the hits' tokens that are kept with their words, each counted as 100 more.
SAID = 1 << 22
#: Behind this a text may be cut: one token ends, a word begins, and no words with a hyphen between them reach over it.
CUT = re.compile(r"[^\w-](?=\w)")
WORDS = re.compile(r"\w+")


def fold(s: str) -> str:
    return s.replace("Ё", "Е").replace("ё", "е").lower()


def is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


@dataclass
class Automaton:
    """Nodes 0 to 2 are the roots of ORDERED, FREE and SURNAME. texts[i] is a word as it stands in texts; its symbols are
    symbols[symbol_at[i]:symbol_at[i + 1]], and klass[i] is the one by which it counts in phrases of any order, or -1.
    Edges are sorted by node * n_symbols + symbol. Entries that end in node n are ends[end_at[n]:end_at[n + 1]]."""

    texts: list[str]
    symbol_at: np.ndarray
    symbols: np.ndarray
    klass: np.ndarray
    edges: np.ndarray
    targets: np.ndarray
    end_at: np.ndarray
    ends: np.ndarray
    free_lengths: list[int]
    surnames: bool
    patterns: list[tuple[int, str]]
    n_symbols: int = 0
    #: Words of the longest entry.
    longest: int = 1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs have an edge, and where these lead."""
        if not len(self.edges):
            return np.zeros(len(nodes), bool), np.zeros(0, np.int64)
        sought = nodes * self.n_symbols + symbols
        at = np.minimum(np.searchsorted(self.edges, sought), len(self.edges) - 1)
        there = (self.edges[at] == sought) & (symbols >= 0)
        return there, self.targets[at[there]]

    def ended(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries that end in the nodes, each with the place of its node."""
        counts = self.end_at[nodes + 1] - self.end_at[nodes]
        which = np.repeat(np.arange(len(nodes)), counts)
        return which, self.ends[_ranges(self.end_at[nodes], counts)]


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., counts[0] of them, then the same of first[1] and so on."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


@dataclass
class Entry:
    """What is looked for: number, arm (ordered, free, surname, name, regex) and its words, each as the texts equal to it;
    of a surname its forms, of full names their forms' words, of a pattern the pattern."""

    number: int
    arm: str
    words: list


def compiled(entries: Iterable[Entry]) -> Automaton:
    texts: dict[str, int] = {}
    symbols: dict[tuple, int] = {}
    of_text: list[set[int]] = []
    klass: list[int] = []
    children: dict[tuple[int, int], int] = {}
    ends: list[list[int]] = [[], [], []]
    patterns, lengths, surnames, longest = [], set(), False, 1

    def text(t: str) -> int:
        if t not in texts:
            texts[t] = len(texts)
            of_text.append(set())
            klass.append(-1)
        return texts[t]

    def symbol(key: tuple, equal: Iterable[str], free: bool = False) -> int:
        s = symbols.setdefault(key, len(symbols))
        for t in equal:
            if free:
                klass[text(t)] = s
            else:
                of_text[text(t)].add(s)
        return s

    def add(root: int, path: list[int], number: int) -> None:
        nonlocal longest
        node, longest = root, max(longest, len(path))
        for s in path:
            if (node, s) not in children:
                children[node, s] = len(ends)
                ends.append([])
            node = children[node, s]
        if number not in ends[node]:
            ends[node].append(number)

    for e in entries:
        if e.arm == "regex":
            patterns.append((e.number, e.words[0]))
        elif e.arm == "ordered":
            add(ORDERED, [symbol(("set", *sorted(w)), w) for w in e.words], e.number)
        elif e.arm == "free":
            add(FREE, sorted(symbol(("free", min(w)), w, True) for w in e.words), e.number)
            lengths.add(len(e.words))
        elif e.arm == "surname":
            surnames = True
            for form in e.words:
                add(SURNAME, [symbol(("form", form), [form])], e.number)
        else:
            for form in e.words:
                add(ORDERED, [symbol(("form", w), [w]) for w in form], e.number)
    n = max(1, len(symbols))
    edges = np.array([a * n + s for a, s in children], np.int64)
    order = np.argsort(edges)
    flat = lambda lists: (np.cumsum([0, *map(len, lists)]), np.array([x for some in lists for x in some], np.int64))
    symbol_at, flat_symbols = flat([sorted(s) for s in of_text])
    end_at, flat_ends = flat(ends)
    return Automaton(list(texts), symbol_at, flat_symbols, np.array(klass, np.int64), edges[order], np.array(list(children.values()), np.int64)[order], end_at, flat_ends, sorted(lengths), surnames, patterns, n, longest)


#: Of each code point what token it is part of and what it folds to by itself; filled as they are met.
OTHER, SPACE, WORD, UNMET = 0, 1, 2, 255
_kind = np.full(0x110000, UNMET, np.uint8)
_folded = np.zeros(0x110000, np.uint32)
#: These fold to several, or by what stands beside them.
ODD = [ord("\u0130"), ord("\u03a3")]
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        more = 1 << max(12, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(more - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def running_sums(codes: np.ndarray) -> np.ndarray:
    """The sums of a number for each code point times base**place, one more than code points: the difference of two of them,
    times inverse**start, is the same wherever a string starts."""
    x = codes.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(x * powers(len(codes))[0], out=sums[1:])
    return sums


class Tokens:
    """The tokens of a few texts, as arrays: of each its text, where it starts and ends in the texts' concatenation, and its
    kind. `first` and `at` are each text's first token and its place there."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = [t or "" for t in texts]
        self.joined = "".join(self.texts)
        codes = codes_of(self.joined)
        kinds = _kind[codes]
        if (kinds == UNMET).any():
            for c in np.unique(codes[kinds == UNMET]).tolist():
                ch = chr(c)
                _kind[c] = WORD if is_word(ch) else SPACE if ch.isspace() else OTHER
                _folded[c] = ord(fold(ch)[0])
            kinds = _kind[codes]
        self.codes = _folded[codes]
        self.odd = np.zeros(0, np.int64) if self.joined.isascii() else np.flatnonzero((codes == ODD[0]) | (codes == ODD[1]))
        self.at = np.cumsum([0, *map(len, self.texts)])
        new = np.empty(len(codes) + 1, bool)
        new[1:-1] = kinds[1:] != kinds[:-1]
        new[self.at] = True
        self.start = np.flatnonzero(new[:-1])
        self.end = np.append(self.start[1:], len(codes))[: len(self.start)]
        self.kind = kinds[self.start]
        self.doc = np.searchsorted(self.at[:-1], self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.at[:-1])
        self.words = np.flatnonzero(self.kind == WORD)
        self.sums = running_sums(self.codes)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * powers(len(self.sums))[1][start]

    def has_odd(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.odd, start) < np.searchsorted(self.odd, end)


class Scanner:
    """An automaton with what a task keeps of it: its words by their hashes, and their code points one after another."""

    def __init__(self, a: Automaton) -> None:
        self.a = a
        self.known = {t: i for i, t in enumerate(a.texts)}
        self.codes = codes_of("".join(a.texts))
        self.lengths = np.fromiter(map(len, a.texts), np.int64, len(a.texts))
        self.at = np.cumsum(self.lengths) - self.lengths
        sums = running_sums(self.codes)
        hashes = (sums[self.at + self.lengths] - sums[self.at]) * powers(len(sums))[1][self.at]
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        #: Are no two words of one hash there? Otherwise words are looked up as texts.
        self.apart = bool((self.hashes[1:] != self.hashes[:-1]).all())
        self.patterns = [(number, re.compile(p)) for number, p in a.patterns]
        self.said: dict[str, tuple[str, str]] = {}
        self.room = SAID

    def text_ids(self, cut: Tokens, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The dictionary's words that stand, folded, from start to end, or -1."""
        ids = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return ids
        by_text = cut.has_odd(start, end) if self.apart else np.ones(len(start), bool)
        sought = cut.hashes(start, end)
        near = np.minimum(np.searchsorted(self.hashes, sought), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[near] == sought) & ~by_text)
        word = self.order[near[hit]]
        lengths = self.lengths[word]
        fits = lengths == end[hit] - start[hit]
        hit, word, lengths = hit[fits], word[fits], lengths[fits]
        # a hash alone is no proof
        differ = np.cumsum(np.r_[0, cut.codes[_ranges(start[hit], lengths)] != self.codes[_ranges(self.at[word], lengths)]])
        upto = np.cumsum(lengths)
        same = differ[upto] == differ[upto - lengths]
        ids[hit[same]] = word[same]
        for i in np.flatnonzero(by_text).tolist():
            ids[i] = self.known.get(fold(cut.joined[start[i] : end[i]]), -1)
        return ids

    def of_words(self, cut: Tokens) -> tuple[np.ndarray, ...]:
        """Entry, first and last token of all that is found but for patterns' matches."""
        doc = cut.doc[cut.words]
        ids = self.text_ids(cut, cut.start[cut.words], cut.end[cut.words])
        found = [(entry, cut.words[start], cut.words[end]) for start, end, entry in (*self.in_order(doc, ids), *self.in_any_order(doc, ids))]
        if self.a.surnames:
            found.append(self.named(cut, ids))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))

    def hits(self, cut: Tokens) -> tuple[np.ndarray, ...]:
        """Entry, first and last token, and start and end in the texts' concatenation of all that is found."""
        entry, i, j = self.of_words(cut)
        start, end = cut.start[i], cut.end[j]
        if self.patterns:
            more = [m for d, t in enumerate(cut.texts) if t for m in self.matched(cut, d, t)]
            if more:
                entry, i, j, start, end = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((entry, i, j, start, end), zip(*more, strict=True), strict=True))
        return entry, i, j, start, end

    def rows(self, texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, tuple]]:
        """Of all that is found, its text's place among the texts, and HIT's columns. Texts of over `most` characters are taken
        by themselves, window by window."""
        cut = Tokens([None if t and len(t) > most else t for t in texts])
        entry, i, j, start, end = self.hits(cut)
        if len(entry):
            doc = cut.doc[i]
            words = np.cumsum(np.r_[0, cut.kind == WORD])  # before each token
            before = words[cut.first[doc]]
            said = self.said_of(cut.joined, cut.start[i], cut.end[j], start, end)
            yield doc, (entry, words[i] - before, words[j + 1] - before - 1, i - cut.first[doc], j - cut.first[doc], start - cut.at[doc], end - cut.at[doc], *said)
        for d, t in enumerate(texts):
            if t and len(t) > most:
                for made in self.in_windows(t, most):
                    yield np.full(len(made[0]), d), made

    def in_windows(self, text: str, most: int) -> Iterator[tuple]:
        """HIT's columns of what is found in a text, of which a window is held as tokens at a time. An entry belongs to the window
        in which it starts, and a window has so many words of the next one that its entries end in it. Patterns run over
        the whole text in lower case, and a match's ends are located in the windows that they fall in."""
        cuts = list(windows(text, self.a.longest - 1, most))
        found = np.zeros((0, 3), np.int64)
        if self.patterns:
            low = "".join(lowered(text[x:y]) for x, y, _ in cuts)
            found = np.fromiter((x for n, p in self.patterns for m in p.finditer(low) if m.end() > m.start() for x in (n, *m.span())), np.int64).reshape(-1, 3)
            del low
        number, *ends = found[:, 0], found[:, 1], found[:, 2] - 1
        # of a match's first and last character: the token, the words up to it, where the token starts or ends, and the character
        spots = np.zeros((2, 4, len(number)), np.int64)
        token = word = lower = 0
        for x, y, z in cuts:
            cut = Tokens([text[x:z]])
            n = int(np.searchsorted(cut.start, y - x))
            words = np.cumsum(np.r_[0, cut.kind == WORD])
            entry, i, j = self.of_words(cut)
            entry, i, j = entry[i < n], i[i < n], j[i < n]
            if len(entry):
                start, end = cut.start[i], cut.end[j]
                yield entry, words[i] + word, words[j + 1] + word - 1, i + token, j + token, start + x, end + x, *self.said_of(cut.joined, start, end, start, end)
            if len(number):
                size = np.ones(y - x, np.int64)
                size[[p for p in cut.odd.tolist() if p < y - x and cut.joined[p] == chr(ODD[0])]] = 2
                upto = np.cumsum(size)
                for last in (0, 1):
                    mine = np.flatnonzero((ends[last] >= lower) & (ends[last] < lower + upto[-1]))
                    char = np.searchsorted(upto, ends[last][mine] - lower, "right")
                    t = np.searchsorted(cut.start, char, "right") - 1
                    spots[last][:, mine] = t + token, words[t + last] + word, (cut.end if last else cut.start)[t] + x, char + x + last
                lower += int(upto[-1])
            token, word = token + n, word + int(words[n])
        # of those with the same tokens the last
        key = spots[0, 0] * (token + 1) + spots[1, 0]
        kept = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
        for at in range(0, len(kept), most >> 5 or 1):
            k = kept[at : at + (most >> 5 or 1)]
            (i, w, a, start), (j, v, b, end) = spots[0][:, k], spots[1][:, k]
            yield number[k], w, v - 1, i, j, start, end, *self.said_of(text, a, b, start, end)

    def said_of(self, text: str, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[str, ...]]:
        """`matched` and `form` of hits whose tokens stand from first to last in the text."""
        tokens = (text[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True))
        forms = (text[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True))
        return zip(*map(self.words_and_form, tokens, forms), strict=True)

    def words_and_form(self, tokens: str, form: str) -> tuple[str, str]:
        """The folded words of the tokens of a hit, and what it covers of them, folded."""
        if tokens in self.said:
            words, whole = self.said[tokens]
        else:
            words, whole = " ".join(fold(t) for t in WORDS.findall(tokens)), fold(tokens)
            self.room -= len(tokens) + 100
            if self.room < 0:
                self.said.clear()
                self.room = SAID
            if len(tokens) < SAID >> 10:
                self.said[tokens] = words, whole
        return words, whole if form == tokens else fold(form)

    def in_order(self, doc: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First and last word and entry of the paths from the root, level by level."""
        a = self.a
        start = np.flatnonzero(ids >= 0)
        at, node = start, np.zeros(len(start), np.int64)
        while len(at):
            t = ids[at]
            counts = np.where(t >= 0, a.symbol_at[t + 1] - a.symbol_at[t], 0)
            which = np.repeat(np.arange(len(at)), counts)
            there, node = a.step(node[which], a.symbols[_ranges(a.symbol_at[t], counts)])
            which = which[there]
            start, at = start[which], at[which]
            i, entry = a.ended(node)
            yield start[i], at[i], entry
            at = at + 1
            on = at < len(ids)
            on[on] = doc[at[on]] == doc[start[on]]
            start, at, node = start[on], at[on], node[on]

    def in_any_order(self, doc: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of windows whose words, sorted, are a path."""
        a = self.a
        if not a.free_lengths or not len(ids):
            return
        klass = np.where(ids >= 0, a.klass[ids], -1)
        unknown = np.cumsum(np.r_[0, klass < 0])
        for k in a.free_lengths:
            first = np.arange(len(ids) - k + 1)
            first = first[(unknown[first + k] == unknown[first]) & (doc[first + k - 1] == doc[first])] if len(first) else first
            window = np.sort(klass[first[:, None] + np.arange(k)], axis=1)
            node = np.full(len(first), FREE)
            for level in range(k):
                there, node = a.step(node, window[:, level])
                first, window = first[there], window[there]
            i, entry = a.ended(node)
            yield first[i], first[i] + k - 1, entry

    def named(self, cut: Tokens, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, first and last token of surnames. Two words with a hyphen alone between them are one candidate, taken from
        left to right, and neither is one by itself. ids: of the words by themselves."""
        a, n = self.a, len(cut.start)
        hyphen = np.flatnonzero((cut.kind == OTHER) & (cut.end - cut.start == 1) & (cut.codes[cut.start] == ord("-")))
        hyphen = hyphen[(hyphen > 0) & (hyphen < n - 1)]
        hyphen = hyphen[(cut.kind[hyphen - 1] == WORD) & (cut.kind[hyphen + 1] == WORD) & (cut.doc[hyphen - 1] == cut.doc[hyphen + 1])]
        # of hyphens with one word between them every other one makes a pair
        place = np.arange(len(hyphen))
        run = np.maximum.accumulate(np.where(np.diff(hyphen, prepend=-9) != 2, place, 0)) if len(hyphen) else place
        hyphen = hyphen[(place - run) % 2 == 0]
        alone = np.ones(n, bool)
        alone[hyphen - 1] = alone[hyphen + 1] = False
        single = np.flatnonzero(alone[cut.words] & (ids >= 0))
        first, last = np.concatenate([cut.words[single], hyphen - 1]), np.concatenate([cut.words[single], hyphen + 1])
        ids = np.concatenate([ids[single], self.text_ids(cut, cut.start[hyphen - 1], cut.end[hyphen + 1])])
        first, last, ids = first[ids >= 0], last[ids >= 0], ids[ids >= 0]
        counts = a.symbol_at[ids + 1] - a.symbol_at[ids]
        which = np.repeat(np.arange(len(ids)), counts)
        there, node = a.step(np.full(len(which), SURNAME), a.symbols[_ranges(a.symbol_at[ids], counts)])
        i, entry = a.ended(node)
        which = which[there][i]
        return entry, first[which], last[which]

    def matched(self, cut: Tokens, d: int, text: str) -> list[tuple[int, int, int, int, int]]:
        """Pattern, first and last token, start and end of the patterns' matches in a text; of those with the same tokens the
        last pattern's. Empty matches have no tokens and are none."""
        at, first = int(cut.at[d]), int(cut.first[d])
        if cut.has_odd(cut.at[d : d + 1], cut.at[d + 1 : d + 2])[0]:
            toks = TOKEN.findall(text)
            found = located(toks, self.patterns)
            place = places_of(toks) if found else None
            return [(number, first + i, first + j, at + place(s), at + place(e - 1) + 1) for (i, j), (number, s, e) in found.items()]
        low, out = text.lower(), {}
        for number, pattern in self.patterns:
            found = [m.span() for m in pattern.finditer(low) if m.end() > m.start()]
            if found:
                places = np.array(found) + at
                i, j = np.searchsorted(cut.start, places[:, 0], "right") - 1, np.searchsorted(cut.start, places[:, 1] - 1, "right") - 1
                for x, y, (s, e) in zip(i.tolist(), j.tolist(), places.tolist(), strict=True):
                    out[x, y] = (number, x, y, s, e)
        return list(out.values())


def located(toks: list[str], patterns: list[tuple[int, re.Pattern]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each run of tokens that a pattern's match covers, by its first and last token: the last such pattern, and the
    start and end of the last such match in the lower-cased tokens, end exclusive. Matches come sorted by place, as do the
    starts of tokens, so one merge finds all their tokens. Empty matches have no tokens and are none."""
    low = [t.lower() for t in toks]
    text, starts, out = "".join(low), None, {}
    for number, pattern in patterns:
        found = [(m.start(), m.end()) for m in pattern.finditer(text) if m.end() > m.start()]
        if found:
            starts = np.cumsum([0, *map(len, low)])[:-1] if starts is None else starts
            at = np.array(found)
            first, last = np.searchsorted(starts, at[:, 0], "right") - 1, np.searchsorted(starts, at[:, 1] - 1, "right") - 1
            for i, j, (s, e) in zip(first.tolist(), last.tolist(), found, strict=True):
                out[i, j] = (number, s, e)
    return out


def places_of(toks: list[str]) -> Callable[[int], int]:
    """From a character of the lower-cased tokens to the one of the text that it comes from: some become two in lower case."""
    if all(len(t.lower()) == len(t) for t in toks):
        return lambda at: at
    upto = np.cumsum([len(c.lower()) for t in toks for c in t])
    return lambda at: int(np.searchsorted(upto, at, "right"))


def lowered(text: str) -> str:
    """The text's tokens in lower case, each by itself, one after another."""
    return text.lower() if not any(chr(c) in text for c in ODD) else "".join(t.lower() for t in TOKEN.findall(text))


def windows(text: str, more: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Where a window of a text starts, where the next one does, and where it ends, which is behind `more` words of the next
    ones. Windows hold about `most` characters; a text in which no word stands behind anything but a hyphen isn't cut."""
    start = 0
    while start < len(text):
        m = CUT.search(text, start + most)
        end = stop = m.end() if m else len(text)
        for w in islice(WORDS.finditer(text, stop), more):
            end = w.end()
        yield start, stop, end
        start = stop


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts hold about `most` bytes."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)) if len(sizes) else np.zeros(0, int)
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if j > i:
                yield b.slice(i, j - i)


_scanners: dict[str, Scanner] = {}


def _scanner(a: Automaton) -> Scanner:
    """One for each Python worker."""
    if a.key not in _scanners:
        _scanners.clear()
        _scanners[a.key] = Scanner(a)
    return _scanners[a.key]


HIT = [("_entry", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("start_token", pa.int32()), ("end_token", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string()), ("form", pa.string())]


def scan(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and, for each hit, _entry, the places of its first and last word among the text's words (of a pattern's match:
    of the words that stand before these tokens' ends), of its first and last token, its start and end in characters, end
    exclusive (a pattern's match may start and end inside its tokens), `matched` (its words, folded) and `form` (the text from
    start to end, folded). Null texts have none. There is no shuffle, and a task holds a few texts as tokens at a time, or a
    window of a long one."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for b in slices(batches, 1, SLICE):
            for doc, made in scanner.rows(b.column(1).to_pylist(), SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(c, t) if isinstance(c, tuple) else pa.array(c).cast(t) for c, (_, t) in zip(made, HIT, strict=True))], names=["id", *(n for n, _ in HIT)])

    kind = docs.schema[id_col].dataType.simpleString()
    types = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {types[t]}" for n, t in HIT)
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, schema)


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, token_idx, token (folded), start_pos (characters of the original text) and type (word, space, punct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2 * SLICE):
            cut = [TOKEN.findall(t) if t else [] for t in b.column(1).to_pylist()]
            counts = np.array(list(map(len, cut)))
            toks = [t for some in cut for t in some]
            if not toks:
                continue
            lens = np.fromiter(map(len, toks), np.int64, len(toks))
            ends, first = np.cumsum(lens), np.cumsum(counts) - counts
            before = np.concatenate([[0], ends])[first]
            kinds = {t: "word" if is_word(t) else "space" if t.isspace() else "punct" for t in set(toks)}
            folded = {t: fold(t) for t in kinds}
            idx = np.arange(len(toks)) - np.repeat(first, counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(cut)), counts))), pa.array(idx), pa.array(list(map(folded.__getitem__, toks)), pa.string()), pa.array(ends - lens - np.repeat(before, counts)), pa.array(list(map(kinds.__getitem__, toks)), pa.string())],
                names=["id", "token_idx", "token", "start_pos", "type"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, token_idx long, token string, start_pos long, type string")


def regex_rows(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, pattern_name, found, start_pos and end_pos (characters of the lower-cased text, end exclusive), start_token and
    end_token of the patterns' matches. Of matches with the same tokens the last pattern's stands."""
    names = list(patterns)
    shape = [(i, p) for i, p in enumerate(patterns.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(i, re.compile(p)) for i, p in shape]
        for b in slices(batches, 1):
            rows = []
            for d, t in enumerate(b.column(1).to_pylist()):
                if t and any(p.search(t.lower()) for _, p in ready):
                    toks = TOKEN.findall(t)
                    low = "".join(x.lower() for x in toks)
                    rows += [(d, names[n], low[s:e], s, e, i, j) for (i, j), (n, s, e) in located(toks, ready).items()]
            if rows:
                cols = list(zip(*rows, strict=True))
                made = [pa.array(c, k) for c, k in zip(cols[1:], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *made], names=["id", "pattern_name", "found", "start_pos", "end_pos", "start_token", "end_token"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, pattern_name string, found string, start_pos long, end_pos long, start_token long, end_token long")
