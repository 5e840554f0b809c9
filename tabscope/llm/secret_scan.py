"""Secret scan: fixed patterns plus the guess cost of credential values.

Base kinds are ``assign`` (a credential word, an assignment sign, a value),
``access`` (access key ids) and ``hex`` (long hex runs). The method adds kind
``guess``: values in a credential context (an assignment to any credential
word, a bearer header, a user:password pair in a URL, a "password is" phrase)
whose guess cost reaches ``min_log10``.

The guess cost of a value is the cheapest segmentation into known words (with
capitals and the usual letter swaps), dates, repeats, sequences, keyboard
walks and brute-force spans, found by dynamic programming over prefixes: the
log10 costs of the segments add up, plus a charge per segment. Brute force
costs one step per character, so the search is linear in the value's length
for any length.

Words are ranked by the number of documents of the corpus that use them in
running text: one pass counts them, the ``max_words`` most frequent ones found
in at least ``min_docs`` documents are broadcast (a bound that does not grow
with the corpus), after the fixed list of common password words. Values of a
credential context are not counted, so a secret that many documents repeat
never becomes a word.

Edge cases: a null or empty text has no spans; a failing base match is
consumed like any other (leftmost, non-overlapping per kind); spans of
different kinds may overlap; rows are independent, so repeated rows repeat
their result.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import materialise

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 10.0
#: Words counted in the corpus that the segmentation may use at most, and the documents that must hold one.
MAX_WORDS = 20_000
MIN_DOCS = 2
#: A longer run of letters is no word.
MAX_LETTERS = 24

_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, since shorter runs hold no match

#: Contexts that announce a credential; group 1 is the value.
CONTEXTS = (
    re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|credential|api_?key|access_?key|auth)["']?\x20*(?:[:=]|\x20is\x20|=>)\x20*["']?([^\s"'<>|]{6,})""", re.I | re.A),
    re.compile(r"""\b(?:bearer|basic)\x20+([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A),
    # both classes exclude their delimiter, so possessive repeats lose no match and values of any length are read once
    re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s@/]{6,}+)@""", re.A),
)
#: Cheap words of which one stands in every context.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "basic", "://")

#: Common password words, most common first.
COMMON = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine football baseball shadow "
    "superman michael jordan hunter secret summer winter spring autumn pass test guest root user changeme default "
    "example sample dummy hello love trust access batman freedom whatever starwars computer internet server database "
    "company office system service private public temp demo abc key token your my the and").split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Usual letter swaps.
SWAPS = str.maketrans("@4310$5!7", "aaeiossit")

_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
# a lower-case word after another word or a comma, but not after what announces a credential
_PROSE = re.compile(rf"(?<=[a-z,] )(?<!\b[Ii]s )(?<!earer )(?<!asic )[a-z]{{3,{MAX_LETTERS}}}+(?![\w=:/@+-])", re.A)
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_SEGMENT = log10(2)
_RUN = 64


def _char_cost(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _runs(value: str, step) -> list[int]:
    """For each position the length of the run that ends there, where step(a, b) continues a run."""
    out = [1] * len(value)
    for i in range(1, len(value)):
        if step(value[i - 1], value[i]):
            out[i] = out[i - 1] + 1
    return out


def segment(value: str, ranks: dict[str, int] = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """The cheapest segmentation: its cost and its parts (kind, start, end).

    ``best[e]`` is the cheapest way to cover the first e characters, and
    ``brute[e]`` the cheapest that ends inside a brute-force span, which may go
    on without another segment charge. Runs are tried at every length up to
    ``_RUN`` and at full length.
    """
    n, low = len(value), value.lower()
    plain = low.translate(SWAPS)
    walks = _runs(low, _near)
    ups = _runs(low, lambda a, b: ord(b) - ord(a) == 1)
    downs = _runs(low, lambda a, b: ord(a) - ord(b) == 1)
    same = _runs(low, lambda a, b: a == b)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit():
            m = _DATE.match(value, i)
            if m:
                dates.setdefault(m.end(), []).append(i)
    best, brute, begin = [0.0] * (n + 1), [float("inf")] * (n + 1), [0] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    for e in range(1, n + 1):
        c = _char_cost(value[e - 1])
        brute[e], begin[e] = best[e - 1] + c + _SEGMENT, e - 1
        if brute[e - 1] + c < brute[e]:
            brute[e], begin[e] = brute[e - 1] + c, begin[e - 1]
        cost, kind, start = brute[e], "brute", begin[e]
        for s in range(max(0, e - MAX_LETTERS), e - 2):
            rank = ranks.get(low[s:e])
            swapped = rank is None and ranks.get(plain[s:e])
            if rank or swapped:
                c = best[s] + log10(1 + (rank or swapped)) + (log10(2) if value[s:e] != low[s:e] else 0) + (log10(4) if swapped else 0) + _SEGMENT
                if c < cost:
                    cost, kind, start = c, "word", s
        for name, runs, base in (("walk", walks, log10(47)), ("sequence", ups, log10(20)), ("sequence", downs, log10(30)), ("repeat", same, log10(12))):
            full = runs[e - 1]
            for k in {*range(3, min(full, _RUN) + 1), *([full] if full >= 3 else [])}:
                c = best[e - k] + base + (0.5 * k if name == "walk" else log10(k)) + _SEGMENT
                if c < cost:
                    cost, kind, start = c, name, e - k
        for s in dates.get(e, ()):
            c = best[s] + log10(365 * 60 if e - s > 4 else 120) + _SEGMENT
            if c < cost:
                cost, kind, start = c, "date", s
        best[e], back[e] = cost, (kind, start)
    parts: list[tuple[str, int, int]] = []
    e = n
    while e:
        kind, s = back[e]
        parts.append((kind, s, e))
        e = s
    return best[n], parts[::-1]


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for ``value`` and its parts; a value that repeats one block costs the block and the count."""
    cost, parts = segment(value, ranks)
    for size in _periods(value.lower()):
        c = guess_cost(value[:size], ranks)[0] + log10(len(value) // size) + _SEGMENT
        if c < cost:
            return c, [("repeat", 0, len(value))]
    return cost, parts


def _periods(value: str) -> list[int]:
    """The smallest proper period that divides the length, if there is one."""
    k = (value + value).find(value, 1) if value else 0
    return [k] if 0 < k < len(value) else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, min_log10: float, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of credential values that cost at least ``min_log10``; each value once."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found = {}
    for p in CONTEXTS:
        for m in p.finditer(text):
            if m.span(1) not in found:
                cost = guess_cost(m[1], ranks)[0]
                if cost >= min_log10:
                    found[m.span(1)] = (m.start(1), 3, m.end(1), cost)
    return sorted(found.values())


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _words_of_documents(batches):
    for b in batches:
        seen: Counter[str] = Counter()
        for text in b.column(0):
            seen.update(set(_PROSE.findall(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def word_ranks(docs: DataFrame, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> dict[str, int]:
    """Rank per word: the fixed list, then the corpus's words by documents, ties by the word."""
    counts = docs.select("text").mapInArrow(_words_of_documents, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter(F.col("n") >= min_docs))
    # words per sixteenth of a power of two, so that only rows near the bound leave their partitions
    level, total = 0, 0
    step = F.floor(F.log2("n") * 16)
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 1,009 rows
        level, total = r["step"], total + r["count"]
        if total >= max_words:
            break
    top = counts.filter(step >= level).orderBy(F.desc("n"), "word").limit(max_words).collect()  # the stated bound
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *(r["word"] for r in top)]))}


def _scan(min_log10: float, shared):
    def run(batches):
        ranks = shared.value
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                extra = guess_spans(text, min_log10, ranks)
                count = [sum(k == x for _, k, _ in base) for x in range(3)]
                every = sorted(base + [x[:3] for x in extra])
                rows.append((*count, sha256(_join(base).encode()).hexdigest(), _join(every), len(extra), max((x[3] for x in extra), default=None)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_log10_guesses"])
    return run


def scan_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_log10_guesses) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, max_words, min_docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(min_log10, shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_guess long, max_log10_guesses double")
