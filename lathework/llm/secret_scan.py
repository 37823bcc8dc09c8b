"""Secret scan by grammar inference (operator 6).

Labelled credentials of each format make a prefix tree; states whose outgoing
frequencies are statistically compatible (Hoeffding bound, checked through their
whole subtrees) are merged, which gives one probabilistic automaton for each format.
Every candidate of a text (a run of at least ``MIN_CANDIDATE`` characters of the
credential alphabet, of enough variety) is scored by its best format's log likelihood per character
less that of ordinary words, learnt from plain words; those above the threshold are
spans of kind ``format``. Where a whole run is below it, its parts are scored: the automata
start again after each mark and at each literal prefix of a format, parts end before marks,
and the best parts that don't overlap are spans. The base patterns' spans always stay; a
span that lies inside a base span is not added.

The automata are learnt on the driver from a fixed number of examples made from the
formats' public descriptions (``EXAMPLES`` each); they don't grow with the corpus.
Every whole text is scanned in place; nothing is shuffled.

Defined cases: a null or empty text has no spans; overlapping kinds are all listed,
by start, then by the kinds' order; repeated rows and null ids are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lathework.llm import common

KINDS = ("assign", "access", "hex", "format")

#: The base patterns, and the least lengths of their matches.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS

#: Public credential formats as literal prefixes and (alphabet, length) runs.
FORMATS = {
    "access_id": ["AKIA", (_UPPER + _DIGITS, 16)],
    "hex32": [("0123456789abcdef", 32)],
    "hex40": [("0123456789abcdef", 40)],
    "hex64": [("0123456789abcdef", 64)],
    "code_host": ["ghp_", (_ALNUM, 36)],
    "chat_bot": ["xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)],
    "map_api": ["AIza", (_ALNUM + "_-", 35)],
    "payment": ["sk_live_", (_ALNUM, 24)],
    "base64_40": [(_ALNUM + "+/", 40)],
    "web_token": ["eyJ", (_ALNUM + "_-", 33), ".eyJ", (_ALNUM + "_-", 60), ".", (_ALNUM + "_-", 43)],
}
EXAMPLES = 150
MIN_CANDIDATE = 20
#: A credential has at least so many different characters.
MIN_VARIETY = 8
THRESHOLD = 0.45
#: A part's walk ends where the format is so much less likely (log odds) than ordinary words.
BEHIND = 20.0
_PREFIX = re.compile("|".join(sorted(re.escape(p[0]) for p in FORMATS.values() if isinstance(p[0], str))))
_MARK = re.compile(r"[+/_.=-]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{%d,}" % (MIN_CANDIDATE - 1))


def labelled_credentials(per_format: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) examples drawn from the formats' descriptions."""
    rng = random.Random(seed)
    out = []
    for name, parts in FORMATS.items():
        for _ in range(per_format):
            out.append((name, "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=p[1])) for p in parts)))
    return out


def symbol(c: str) -> str:
    """Characters in classes of like meaning; the marks stand for themselves."""
    if c in _DIGITS:
        return "0"
    if c in "abcdef":
        return "a"
    if c in _LOWER:
        return "g"
    if c in "ABCDEF":
        return "A"
    if c in _UPPER:
        return "G"
    return c


#: How many characters a class has: a class's probability is shared among them.
_SHARE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


class Automaton:
    """A probabilistic automaton by state merging over the examples' prefix tree."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for text in examples:
            state = 0
            for c in map(symbol, text):
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            limit = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > limit:
                return False
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > limit:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Adds the subtree at ``state`` (still a tree) to the automaton at ``into``."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.ends[into] += self.ends[state]
            for c, n in self.count[state].items():
                self.count[into][c] = self.count[into].get(c, 0) + n
                if c in self.next[into]:
                    todo.append((self.next[into][c], self.next[state][c]))
                else:
                    self.next[into][c] = self.next[state][c]

    def _merge_all(self) -> None:
        kept = [0]
        fringe = [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            for known in kept:
                if self._alike(known, state):
                    self.next[parent][c] = known
                    self._fold(known, state)
                    break
            else:
                kept.append(state)
            fringe = [(s, x) for s in kept for x in sorted(self.next[s]) if self.next[s][x] not in kept]
        self.kept = kept

    def table(self) -> dict[int, dict[str, tuple[float, int]]]:
        """For each state: symbol to (log probability of one of its characters, next state); '' ends."""
        out = {}
        for s in self.kept:
            total = self._total(s) + 0.5
            out[s] = {c: (math.log(n / total / _SHARE.get(c, 1)), self.next[s][c]) for c, n in self.count[s].items()}
            out[s][""] = (math.log(max(self.ends[s], 0.05) / total), s)
        return out


_MISSING = math.log(1e-4)


def likelihood(table, text: str) -> float:
    """Log likelihood per character; a character that a state lacks costs ``_MISSING`` and stays there."""
    state, total = 0, 0.0
    for c in text:
        step = table[state].get(symbol(c))
        if step is None:
            total += _MISSING
        else:
            total += step[0]
            state = step[1]
    return (total + table[state][""][0]) / (len(text) + 1)


def word_model() -> dict[str, dict[str, float]]:
    """Log probabilities of a symbol's characters after a symbol in ordinary joined words.

    Ordinary candidates are letters in one case with few changes of class.
    """
    odds = {"0": {"0": 0.9, "a": 0.02, "g": 0.02}, "a": {"a": 0.27, "g": 0.68}, "g": {"a": 0.29, "g": 0.66}, "A": {"A": 0.2, "G": 0.5, "a": 0.09, "g": 0.18}, "G": {"A": 0.2, "G": 0.5, "a": 0.09, "g": 0.18}}
    out = {}
    for before in ("0", "a", "g", "A", "G", "-"):
        own = odds.get(before, {"a": 0.25, "g": 0.5, "0": 0.1, "A": 0.03, "G": 0.07, "-": 0.05})
        rest = 1 - sum(own.values())
        others = [c for c in ("0", "a", "g", "A", "G", "-") if c not in own]
        full = own | {c: rest / len(others) for c in others}
        out[before] = {c: math.log(p / _SHARE.get(c, 7)) for c, p in full.items()}
    return out


def word_likelihood(model, text: str) -> float:
    before, total = "-", 0.0
    for c in text:
        c = symbol(c)
        c = c if c in _SHARE else "-"
        total += model[before][c]
        before = c
    return total / max(1, len(text))


def learn(examples: list[tuple[str, str]]) -> dict[str, dict]:
    """One automaton's table for each labelled format."""
    by_format: dict[str, list[str]] = {}
    for name, text in examples:
        by_format.setdefault(name, []).append(text)
    return {name: Automaton(texts).table() for name, texts in sorted(by_format.items())}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def best_parts(text: str, tables, words, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run whose format likelihood stands out, by log odds, none overlapping."""
    marks = [m.start() for m in _MARK.finditer(text)]
    last = len(text) - MIN_CANDIDATE
    starts = sorted({s for s in [m + 1 for m in marks] + [m.start() for m in _PREFIX.finditer(text)] if s <= last})
    ends = {*marks, len(text)}
    symbols = [symbol(c) for c in text]
    plain = [c if c in _SHARE else "-" for c in symbols]
    usual = [words[b][c] for b, c in zip(["-", *plain], plain)]
    found = []
    for s in starts:
        for table in tables.values():
            state, total, background = 0, 0.0, 0.0
            for e in range(s, len(text)):
                step = table[state].get(symbols[e])
                total += _MISSING if step is None else step[0]
                state = state if step is None else step[1]
                background += usual[e] if e > s else words["-"][plain[e]]
                n = e + 1 - s
                if e + 1 in ends and n >= MIN_CANDIDATE:
                    score = (total + table[state][""][0]) / (n + 1) - background / n
                    if score >= threshold and len(set(text[s : e + 1])) >= MIN_VARIETY:
                        found.append((score * n, s, e + 1))
                if total - background < -BEHIND:
                    break
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if all(e <= a or b <= s for a, b in out):
            out.append((s, e))
    return out


def format_spans(text: str, base, tables, words, threshold: float, known: dict) -> list[tuple[int, int, int]]:
    """Candidates, or parts of them, whose format likelihood stands out and that no base span holds."""
    out = []
    for m in _CANDIDATE.finditer(text):
        value = m.group()
        if value not in known:
            if len(known) > 100_000:
                known.clear()
            best = max(likelihood(t, value) for t in tables.values()) if len(set(value)) >= MIN_VARIETY else float("-inf")
            whole = best - word_likelihood(words, value) >= threshold
            known[value] = [(0, len(value))] if whole else best_parts(value, tables, words, threshold)
        for s, e in known[value]:
            s, e = m.start() + s, m.start() + e
            if not any(a <= s and e <= b for a, _, b in base):
                out.append((s, 3, e))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(tables, words, threshold):
    def scan(batches):
        known: dict[str, bool] = {}
        for batch in batches:
            counts, digests, spans, clean = ([], [], []), [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = sorted(base + format_spans(text, base, tables, words, threshold, known))
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                clean.append(redacted(text, every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"],
            )

    return scan


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            if end >= 0:
                at = end
            out += [text[at:s], mark]
            end = e
        else:
            end = max(end, e)
    return "".join([*out, text[end:]])


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD, examples=None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, clean_text`` for each document."""
    tables = learn(labelled_credentials() if examples is None else examples)
    return common.texts_of(docs).mapInArrow(
        _scan(tables, word_model(), threshold),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string",
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of its texts replaced; other columns stay, ``n_chars`` follows the text."""
    tables, words = learn(labelled_credentials()), word_model()

    def scan(batches):
        known: dict[str, bool] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if text is not None:
                    base = base_spans(text)
                    text = redacted(text, sorted(base + format_spans(text, base, tables, words, threshold, known)))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["kept", "clean"])

    rows = docs.select(F.struct("*").alias("kept"), F.col("text").alias("clean"))
    found = rows.mapInArrow(scan, StructType().add("kept", rows.schema["kept"].dataType).add("clean", "string"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("clean") != F.col("kept.text"), F.length("clean").cast("long")).otherwise(F.col("kept.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[changed.get(c, F.col("kept")[c]).alias(c) for c in docs.columns])


def op6_secret_scan(spark, sf_dir):
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")
