"""Secrets in whole texts: fixed patterns, and values in credential contexts that would be expensive to guess.

The guess cost of a value is the cheapest way to put it together from words, dates, repeats, keyboard walks and
brute-force characters, found by dynamic programming over its positions. A value that only repeats a word or a walk
("password1", "qwertyuiop", "abcabcabcabc") is a placeholder; one that nothing cheap explains is a secret. Words are ranked
by data: the word starts of a given piece model, in the order of its ranks, behind a short list of words that passwords are
made of. After "is" and "was" a sentence may go on, so a value of lower-case letters alone is a word there, of any language.

Defined results: a null text is empty and has no spans; spans are in code points, end exclusive; repeated rows give
repeated rows; other columns are neither read nor changed. Values and texts have no length limit: the search for
segments is linear in the length of a value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
MASK = "[SECRET]"

# fixed values: the base patterns and least lengths
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer is dropped

#: Words that announce a credential, wider than the base pattern, and how a value may follow them.
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "bearer", "credential", "credentials",
    "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "accesskey",
    "private key", "private_key", "private-key", "auth key", "auth_key", "authorization",
)
CONTEXT = re.compile(
    r"(?i:(?:" + "|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True)) + r"))"
    r"""["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+(?:is|was)\x20+)(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"'<>,;(){}\[\]]+))""",
    re.ASCII,
)
_SENTENCE = re.compile(r"\x20(?:is|was)\x20+[\"']?$", re.IGNORECASE)
_HINTS = ("pass", "pwd", "secret", "token", "bearer", "credential", "key", "authorization")

#: Frequent parts of chosen passwords, most frequent first; the rank is the guess cost. They come before any other words.
COMMON_WORDS = (
    "password", "the", "love", "admin", "user", "test", "pass", "welcome", "login", "master", "secret", "token", "key",
    "hello", "dragon", "monkey", "letme", "letmein", "shadow", "sunshine", "princess", "football", "baseball", "summer",
    "winter", "spring", "autumn", "monday", "friday", "sunday", "january", "march", "april", "june", "july", "august",
    "october", "default", "change", "changeme", "changeit", "example", "sample", "demo", "dummy", "your", "here", "my",
    "me", "root", "guest", "server", "database", "data", "base", "system", "service", "account", "access", "private",
    "public", "string", "value", "none", "null", "true", "false", "todo", "fixme", "placeholder", "redacted", "hidden",
    "removed", "insert", "enter", "replace", "super", "star", "happy", "lucky", "blue", "green", "black", "white",
    "red", "cat", "dog", "home", "house", "and", "for", "with", "this", "that", "from", "new", "old", "api", "app",
    "web", "dev", "prod", "local", "host", "client", "company", "office", "money", "time", "day", "year", "abc",
)
LONGEST_BLOCK = 12  # of repeats


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None = None) -> tuple[dict[str, int], int]:
    """Words with their ranks, and the length of the longest: the list, then the word starts of a piece model's file."""
    words = list(COMMON_WORDS)
    if vocabulary is not None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        words += [p[1:].lower() for p in pieces if p.startswith("▁") and len(p) > 3 and p[1:].isalpha()]
    found = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    return found, max(map(len, found))


KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEIGHBOURS = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
_LEET = str.maketrans("@4031!57$", "aaoeiists")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


@dataclass(frozen=True)
class ScanConfig:
    """``least_length`` and ``least_guesses`` (log10) of a value that counts as a secret in a credential context;
    ``vocabulary`` is the path of a piece model whose word starts are cheap to guess."""

    least_length: int = 8
    least_guesses: float = 8.0
    vocabulary: str | None = None


def _alphabet(c: str) -> float:
    """log10 of the guesses for one character that nothing explains."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def segments(value: str, vocabulary: str | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for ``value`` and its cheapest segmentation as (kind, start, end)."""
    rank, longest = ranks(vocabulary)
    n = len(value)
    lower = value.lower()
    plain = lower if len(lower) == n else value
    leet = plain.translate(_LEET)
    cost = [0.0] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    run = walk = 0  # starts of the repeat and of the walk that end here
    periodic = [0] * (LONGEST_BLOCK + 1)  # starts of the stretches that end here and repeat blocks of that length
    step = 0.3  # a further segment: the order of segments has to be guessed too
    for i in range(1, n + 1):
        last = plain[i - 1]
        if i > 1:
            run = run if plain[i - 2] == last else i - 1
            walk = walk if (plain[i - 2], last) in _NEIGHBOURS else i - 1
        brute = _alphabet(value[i - 1])
        best, how = cost[i - 1] + brute + (0.0 if back[i - 1][0] == "brute" else step), ("brute", i - 1)
        for j in range(max(0, i - longest), i - 2):
            for word, extra in ((plain[j:i], 0.0), (leet[j:i], math.log10(2))):
                if word in rank:
                    shape = 0.0 if value[j:i].islower() or not value[j:i].upper() != value[j:i].lower() else math.log10(2)
                    c = cost[j] + math.log10(rank[word] + 1) + extra + shape + step
                    if c < best:
                        best, how = c, ("word", j)
        for j in dates.get(i, ()):
            if (c := cost[j] + math.log10(365 * 40 if i - j > 6 else 480 if i - j > 4 else 60) + step) < best:
                best, how = c, ("date", j)
        if i - run >= 3 and (c := cost[run] + _alphabet(last) + math.log10(i - run) + step) < best:
            best, how = c, ("repeat", run)
        for p in range(2, min(LONGEST_BLOCK, i - 1) + 1):
            if plain[i - 1 - p] != last:
                periodic[p] = i - p
            # the first block costs what it costs, the others only their number
            elif i - periodic[p] >= 2 * p and (c := cost[periodic[p] + p] + math.log10((i - periodic[p]) / p) + step) < best:
                best, how = c, ("repeat", periodic[p] + p)
        if i - walk >= 3 and (c := cost[walk] + math.log10(len(_NEIGHBOURS)) + math.log10(i - walk) + step) < best:
            best, how = c, ("walk", walk)
        cost[i], back[i] = best, how
    found: list[tuple[str, int, int]] = []
    i = n
    while i:
        kind, j = back[i]
        if kind == "brute" and found and found[-1][0] == "brute":
            found[-1] = ("brute", j, found[-1][2])
        else:
            found.append((kind, j, i))
        i = j
    return cost[n], found[::-1]


Span = tuple[str, int, int, int, int, float]


def scan(text: str, config: ScanConfig = ScanConfig()) -> list[Span]:
    """All spans of a text in order: (kind, start, end, start and end of the secret value, log10 of its guesses)."""
    spans: list[Span] = []
    lower = text.lower()
    hinted = any(h in lower for h in _HINTS)
    if hinted:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                spans.append(("assign", m.start(), m.end(), m.start(2), m.end(2), segments(m[2], config.vocabulary)[0]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                spans.append(("access", m.start(), m.end(), m.start(), m.end(), segments(m[0], config.vocabulary)[0]))
    for m in HEX.finditer(text):
        spans.append(("hex", m.start(), m.end(), m.start(), m.end(), segments(m[0], config.vocabulary)[0]))
    if hinted:
        base = sorted((s[3], s[4]) for s in spans)
        for m in CONTEXT.finditer(text):
            a, b = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            b = a + len(text[a:b].rstrip(".:!?"))
            if b - a < config.least_length or any(x <= a and b <= y for x, y in base):
                continue
            if text[a:b].isalpha() and text[a:b].islower() and _SENTENCE.search(text, m.start(), a):
                continue
            guesses = segments(text[a:b], config.vocabulary)[0]
            if guesses >= config.least_guesses:
                spans.append(("guess", a, b, a, b, guesses))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def masked(text: str, spans: list[Span]) -> str:
    """The text with every secret value replaced."""
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,log10_guesses:double>>"
_SPAN_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), *[(c, pa.int64()) for c in ("start", "end", "value_start", "value_end")], ("log10_guesses", pa.float64())])
)


def secret_spans(docs: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """doc_id and all spans of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN_ARROW.value_type]
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in scan(t.as_py() or "", config)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_ARROW)], ["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, spans {_SPAN}")


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of ``secret_spans``: n_assign, n_access, n_hex, base_sha256, spans, n_guess, most_guesses."""

    def listed(kinds: tuple[str, ...]):
        chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        number("guess").alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("most_guesses"),
    )


def mask_secrets(docs: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """``docs`` with every secret value in ``text`` replaced and ``n_chars``, if there is one, brought up to date. Null
    texts stay null; rows without secrets stay as they are."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {i: masked(t, s) for i, t in enumerate(texts) if t and (s := scan(t, config))}
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if count is not None:
                    n = columns[count].to_pylist()
                    columns[count] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(n)], columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def digest_of(spans: str) -> str:
    """The digest of listed base spans, for tests."""
    return hashlib.sha256(spans.encode()).hexdigest()
