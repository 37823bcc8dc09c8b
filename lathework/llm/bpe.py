"""Byte-pair encoding of many texts at once in numpy, equal to the library's.

For vocabularies with word ends over NFC, lower-cased text whose white space is dropped.
Texts within ``LATIN`` are split into pre-tokens and merged here, each distinct
pre-token once; all distinct pre-tokens merge side by side, a round at a time. Equal
pre-tokens are found by hash and compared by their code points. Other texts, those that
hold a special string, and chunks in which two pre-tokens share a hash go to the library
whole: its Unicode tables decide there.

Merging every occurrence of a word's best pair in one round equals merging one by one,
since a pair with the new symbol ranks behind the merge that made the symbol (checked
when the file is read).
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from lathework.llm.kernels import SpanHash

#: Code points that the fast path knows: Latin, general punctuation, the euro.
LATIN = re.compile(f"[^{chr(0)}-{chr(0x24F)}{chr(0x2010)}-{chr(0x2027)}{chr(0x20AC)}]")
#: The splitter's contractions.
_ONE, _TWO = ("s", "t", "m", "d"), ("re", "ve", "ll")
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_INF = np.int64(1 << 40)
CHUNK = 1 << 21


def _classes() -> np.ndarray:
    out = np.full(0x20AD, _OTHER, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return out


def _gathered(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some spans end to end, and where each one's begin (and the last one's end)."""
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    return points[np.arange(int(at[-1])) + np.repeat(starts - at[:-1], lengths)], at


class _PairTable:
    """Rank of a pair of symbols; collisions of one level go to the next."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.levels = []
        bits = 20
        while len(keys):
            slot = self._slot(keys, bits, len(self.levels))
            held_key, held_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _INF, np.int64)
            _, first = np.unique(slot, return_index=True)
            held_key[slot[first]], held_rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((bits, held_key, held_rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], max(10, bits - 4)

    @staticmethod
    def _slot(keys, bits, level):
        factor = np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[level % 3] + 2 * (level // 3))
        return (keys.astype(np.uint64) * factor) >> np.uint64(64 - bits)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _INF, np.int64)
        for level, (bits, held_key, held_rank) in enumerate(self.levels):
            slot = self._slot(keys, bits, level)
            hit = held_key[slot] == keys
            out[hit] = held_rank[slot[hit]]
        return out


class VectorBPE:
    def __init__(self, path: str, shortcuts: dict[str, int] | None = None, cache: int = 400_000):
        """``shortcuts``: proven pre-tokens that are one token, with its id; they are never merged."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        vocab = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in plain]
        mark = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        self.inner = np.array([vocab[mark[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[mark[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[self.made[::-1]] = rank[::-1]
        if ((born[left] >= rank) | (born[right] >= rank)).any():
            raise ValueError("a merge precedes the symbols it joins")
        self.table = _PairTable(left << 20 | right, rank)
        self.kinds = _classes()
        self.limit = cache
        self.hasher = SpanHash()
        self.sure = self._hashed(shortcuts or {})
        self._forget()

    def _hashed(self, shortcuts: dict[str, int]):
        """Hashes, sorted, ids, code points end to end, and where each one's begin, of those shortcuts that the splitter leaves whole."""
        words = [w for w in shortcuts if not LATIN.search(w) and w]
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint16), np.zeros(1, np.int64)
        points, ends = self._joined(words)
        starts, stops = self.split(points)
        begins = np.concatenate([[0], ends[:-1]])
        whole = np.isin(begins, starts) & np.isin(ends - 1, stops)
        whole &= np.searchsorted(starts, ends) - np.searchsorted(starts, begins) == 1
        ids = np.array([shortcuts[w] for w in words], np.uint32)[whole]
        begins, stops = begins[whole], ends[whole] - 1
        hashes = self.hasher.of_points(points, begins, stops)
        order = np.argsort(hashes)
        flat, at = _gathered(points, begins[order], stops[order])
        return hashes[order], ids[order], flat.astype(np.uint16), at

    def _forget(self):
        """The known pre-tokens are the proven shortcuts again."""
        self.known, self.pool, self.text, at = self.sure  # hashes, sorted; ids; code points
        self.begin, self.size = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64)
        self.text_begin, self.text_size = at[:-1], np.diff(at)

    # -- pre-tokens ---------------------------------------------------------

    def split(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of normalised code points."""
        kind = self.kinds[points]
        new = np.empty(len(points), bool)
        new[0] = True
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = np.flatnonzero(new & (points == 39))
        quote = quote[quote + 1 < len(points)]
        quote = quote[kind[quote + 1] == _LETTER]
        if len(quote):
            one = points[quote + 1]
            after = np.minimum(quote + 2, len(points) - 1)
            two = np.where((quote + 2 < len(points)) & (kind[after] == _LETTER), points[after], 0)
            single = np.isin(one, [ord(c) for c in _ONE])
            double = np.zeros(len(quote), bool)
            for a, b in _TWO:
                double |= (one == ord(a)) & (two == ord(b))
            for at, n in ((quote[single], 2), (quote[double & ~single], 3)):
                new[at + 1] = False
                if n == 3:
                    new[at + 2] = False
                follow = at + n
                follow = follow[follow < len(points)]
                new[follow] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(points))
        solid = kind[starts] != _SPACE
        return starts[solid], ends[solid]

    # -- merges ---------------------------------------------------------------

    def merge(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many, of the pre-tokens whose code points lie end to end."""
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800)
        owner_point = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(width) - width
        raw = np.empty(int(width.sum()), np.int64)
        ascii_, two, three = width == 1, width == 2, width == 3
        raw[first[ascii_]] = points[ascii_]
        raw[first[two]], raw[first[two] + 1] = 0xC0 | points[two] >> 6, 0x80 | points[two] & 0x3F
        raw[first[three]] = 0xE0 | points[three] >> 12
        raw[first[three] + 1], raw[first[three] + 2] = 0x80 | points[three] >> 6 & 0x3F, 0x80 | points[three] & 0x3F
        word = np.repeat(owner_point, width)
        last = np.append(word[1:] != word[:-1], True)
        symbols = np.where(last, self.final[raw], self.inner[raw])
        done_word, done_symbol = [], []
        while len(symbols):
            ranks = np.full(len(symbols), _INF, np.int64)
            ranks[:-1] = self.table.ranks(symbols[:-1] << 20 | symbols[1:])
            ranks[last] = _INF
            begins = np.flatnonzero(np.append(True, last[:-1]))
            counts = np.diff(np.append(begins, len(symbols)))
            best = np.minimum.reduceat(ranks, begins)
            over = np.repeat(best == _INF, counts)
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbols[over])
                go = ~over
                symbols, word, last, ranks = symbols[go], word[go], last[go], ranks[go]
                counts, best = counts[best != _INF], best[best != _INF]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, counts))
            turn = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), turn, 0))
            at = at[(turn - start) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, last = symbols[keep], word[keep], last[keep]
        if not done_word:
            return np.empty(0, np.uint32), np.zeros(len(lengths), np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(word, minlength=len(lengths))

    # -- texts ----------------------------------------------------------------

    def _tokens(self, points: np.ndarray):
        """For each pre-token of ``points``: its start, and its number among the known; None if two share a hash.

        Hashes only propose: a pre-token is a known one if their code points are the same.
        """
        starts, ends = self.split(points)
        hashes = self.hasher.of_points(points, starts, ends)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._place(distinct)
        fresh = place < 0
        if fresh.any():
            if len(self.known) + fresh.sum() > self.limit and len(self.known) > len(self.sure[0]):
                self._forget()
                place = self._place(distinct)
                fresh = place < 0
            take = first[fresh]
            own, at = _gathered(points, starts[take], ends[take])
            ids, sizes = self.merge(own, np.diff(at))
            self.known = np.concatenate([self.known, distinct[fresh]])
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, ids])
            self.text_begin = np.concatenate([self.text_begin, len(self.text) + at[:-1]])
            self.text_size = np.concatenate([self.text_size, np.diff(at)])
            self.text = np.concatenate([self.text, own.astype(np.uint16)])
            order = np.argsort(self.known, kind="stable")
            self.known, self.begin, self.size = self.known[order], self.begin[order], self.size[order]
            self.text_begin, self.text_size = self.text_begin[order], self.text_size[order]
            place = self._place(distinct)
        place = place[number]
        if not self._same(points, starts, ends, place):
            return None
        return starts, place

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash among the known, or -1."""
        place = np.searchsorted(self.known, hashes)
        inside = np.minimum(place, len(self.known) - 1)
        return np.where(self.known[inside] == hashes, inside, -1) if len(self.known) else np.full(len(hashes), -1)

    def _same(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> bool:
        """Whether each pre-token has the code points of the known one at its place."""
        lengths = ends - starts
        if not np.array_equal(lengths, self.text_size[place]):
            return False
        shift = np.repeat(self.text_begin[place] - starts, lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return bool((points[at] == self.text[at + shift]).all())

    def normal(self, text: str) -> str | None:
        """The normalised text, or None where the library has to encode it."""
        if "<|" in text and self.special.search(text):
            return None
        if text.isascii():
            return text.lower()
        if LATIN.search(text):
            return None
        text = unicodedata.normalize("NFC", text).lower()
        return None if LATIN.search(text) else text

    def batches(self, texts: list[str]):
        """(numbers of texts, their code points end to end, ends) in chunks; (number, None, text) for the library."""
        numbers, parts, size = [], [], 0
        for i, text in enumerate(texts):
            normal = self.normal(text)
            if normal is None:
                yield i, None, text
                continue
            numbers.append(i)
            parts.append(normal)
            size += len(normal) + 1
            if size >= CHUNK:
                yield numbers, parts, None
                numbers, parts, size = [], [], 0
        if numbers:
            yield numbers, parts, None

    @staticmethod
    def _joined(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        return points, np.cumsum([len(p) + 1 for p in parts])

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for numbers, parts, text in self.batches(texts):
            if parts is None:
                out[numbers] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            points, ends = self._joined(parts)
            found = self._tokens(points)
            if found is None:
                out[numbers] = [len(self.library.encode(texts[i], add_special_tokens=False).ids) for i in numbers]
                continue
            starts, place = found
            totals = np.concatenate([[0], np.cumsum(self.size[place])])
            upto = np.searchsorted(starts, ends)
            out[numbers] = np.diff(np.concatenate([[0], totals[upto]]))
        return out

    def ids(self, texts: list[str]):
        """(number, ids) of each text, in any order."""
        for numbers, parts, text in self.batches(texts):
            if parts is None:
                yield numbers, np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            points, ends = self._joined(parts)
            found = self._tokens(points)
            if found is None:
                yield from ((i, np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)) for i in numbers)
                continue
            starts, place = found
            sizes, begins = self.size[place], self.begin[place]
            totals = np.cumsum(sizes)
            within = np.arange(int(totals[-1]) if len(totals) else 0) - np.repeat(totals - sizes, sizes)
            flat = self.pool[np.repeat(begins, sizes) + within]
            upto = np.concatenate([[0], totals])[np.searchsorted(starts, ends)]
            before = 0
            for i, at in zip(numbers, upto):
                yield i, flat[before:at]
                before = at
