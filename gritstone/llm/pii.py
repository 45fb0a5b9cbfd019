"""Personal data: candidate spans from loose generators, judged by boosted trees, cut off at calibrated thresholds.

Generators are meant to miss nothing and overlap freely: address-like text around an at sign, dotted numbers,
long digit groups with separators, long mixed tokens. Each candidate is described by its format (lengths, groups,
checksums, value ranges, entropy) and its context (characters beside it, words before it). The trees say
how likely it is personal data of its kind, isotonic regression makes that a probability, and a threshold for each kind
is the lowest that keeps the wanted precision on examples held out. Of overlapping spans the likelier one stays,
then the longer.

There are no labelled spans to learn from, so the trees are fitted to generated ones: formats as issuers and
standards define them, and look-alikes (order numbers, versions, dates, amounts, handles, digests, numbers
that fail their checksum) in made-up sentences. They are made from fixed seeds, the same everywhere.

Nearly all text has no digit, at sign, long token, close colons or word like "password:" near; only windows around these are looked
at, found on the bytes of a whole slice. A match of any generator has one of them, unless its digits are not ASCII. Documents are
read once, nothing is shuffled.

Defined results for odd input: null and empty texts have no spans. Offsets are those of characters, ends
exclusive. A window grows to the next blank, so no candidate is cut short, however long. Repeated rows give
repeated spans, null ids are carried. Redaction keeps a null text null and all columns as they were.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .boosting import Boosted, fit
from .shared import arrow_map
from .text import char_offsets, slices, text_buffer

KINDS = ("email", "ip", "phone", "card", "national_id", "iban", "secret")
PRECISION = 0.97
EXAMPLES = 12_000
_AROUND = 64
_ANCHOR = np.zeros(256, bool)
_ANCHOR[[*b"0123456789@"]] = True
#: A secret of letters only, and an address of hexadecimal letters and colons, have no other anchor.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_+/=-"]] = True
_LONG, _COLONS = 16, 10
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\r\n"]] = True

#: Patterns of each kind; several of a kind may propose different spans in one place.
GENERATORS = {
    "email": (r"(?<![\w.%+'-])[\w.%+'-]++@[\w-]+(?:\.[\w-]+)*",),
    "ip": (r"(?<![\w.])\d{1,4}(?:\.\d{1,4}){3}(?![\w]|\.\d)", r"(?<![\w:])(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])"),
    "phone": (r"(?<![\w])\+?\(?\d[\d ()./-]{5,22}\d(?!\w)", r"\+?(?<!\w)\d{0,3}[ -]?\(\d{1,4}\) ?\d{3,4}[ -]?\d{3,5}(?!\w)", r"\+\d{1,3}(?:[ -]\d{2,4}){3,4}(?!\w)"),
    "card": (r"(?<![\w])\d(?:[ -]?\d){11,18}(?!\w)", r"(?<!\w)\d{13,19}(?!\w)"),
    "national_id": (r"(?<![\w-])\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w-])",),
    "iban": (r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{2,4}){3,8}(?!\w)", r"(?<!\w)[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}(?!\w)"),
    "secret": (r"(?<![\w+/-])[A-Za-z0-9_+/=-]{16,}+(?![\w])", r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])", r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key)[\"']?[ \t]{0,3}[:=]{1,2}[ \t]{0,3}[\"']?([^\s\"'<>,;]{6,64})"),
}
#: What a pattern's group 1 would be looked for behind: a colon or an equals sign behind one of these words.
_CUE = re.compile(rb"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key)[\"']?[ \t]{0,3}={0,1}$")
_CUE_ENDS = np.zeros(256, bool)
_CUE_ENDS[[*b"dDeEtTnNyY\"' \t="]] = True
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "glpat-", "AIza")
_COMPILED = tuple(tuple(re.compile(p) for p in GENERATORS[kind]) for kind in KINDS)
_WORDS = (
    ("mail", "e-mail", "email", "contact", "write"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
    ("ip", "host", "server", "client", "address", "from"),
    ("card", "visa", "mastercard", "credit", "debit", "payment", "cc"),
    ("ssn", "social", "security", "tax", "passport", "national"),
    ("iban", "bank", "account", "transfer"),
    ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth", "api", "credential"),
    ("version", "v", "release", "section", "chapter", "build", "firmware"),
    ("order", "invoice", "isbn", "item", "number", "no", "ref", "id", "ticket", "tracking", "sku", "serial"),
    ("commit", "sha", "md5", "checksum", "digest", "hash", "etag", "uuid"),
    ("date", "year", "since", "until", "price", "total", "usd", "eur", "page", "pp", "temperature", "score"),
)


class Span(NamedTuple):
    """A candidate in a text."""

    begin: int
    end: int
    kind: int


def candidates(text: str) -> list[Span]:
    """All candidates of all generators."""
    return list(dict.fromkeys(Span(*m.span(p.groups), k) for k, patterns in enumerate(_COMPILED) for p in patterns for m in p.finditer(text)))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    try:
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    s = text[span.begin : span.end]
    digits = "".join(c for c in s if c.isdecimal() and c.isascii())
    groups = [len(g) for g in re.findall(r"\d+", s)]
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    octets = [int(g) for g in s.split(".") if g.isdecimal()] if span.kind == 1 else []
    before, after = text[max(0, span.begin - 40) : span.begin], text[span.end : span.end + 12]
    near = [w.lower() for w in re.findall(r"[A-Za-z-]+", before)[-4:]]
    local, _, domain = s.partition("@")
    ending = domain.rsplit(".", 1)[-1] if "." in domain else ""
    out = [float(span.kind == k) for k in range(len(KINDS))]
    out += [len(s), len(digits), letters, len(groups), max(groups, default=0), min(groups, default=0)]
    out += [sum(c.isupper() for c in s), len(s) - len(digits) - letters, len(counts), -sum(n / len(s) * log2(n / len(s)) for n in counts.values())]
    out += [_luhn(digits) if digits else 0, int(digits[0]) if digits else -1, len(set(digits)), max(octets, default=0), len(octets), bool(octets) and 0 < octets[0] and max(octets) < 256]
    out += [len(local) if domain else 0, domain.count("."), len(ending) if ending.isalpha() else 0, s.startswith("+"), "(" in s, s.count("-"), s.count(" "), s.count("."), s.count("/")]
    out += [_iban_valid(s) if span.kind == 5 else 0, all(c in "0123456789abcdefABCDEF" for c in s), bool(re.fullmatch(r"(?:19|20)\d\d[-./]?\d\d?[-./]?\d\d?.*|\d\d?[-./]\d\d?[-./](?:19|20)\d\d", s)), bool(re.search(r"(\d)\1{4}", s)), "".join(digits) in "01234567890123456789"]
    out += [before[-1:] in "#$€£v@_-./" if before else 0, before[-1:] in "\"'=:" if before else 0, "=" in before[-4:] or ":" in before[-4:], after[:1] in "\"'" if after else 0, after[:1] in "%-/@:" if after else 0]
    out += [any(w in near for w in words) for words in _WORDS]
    out += [s.count(":"), "::" in s, s.startswith(_PREFIXES), s.isalpha(), s.islower()]
    return [float(x) for x in out]


def _examples(seed: int, n: int) -> tuple[list[tuple[str, Span]], list[int]]:
    """Candidates in generated sentences, and whether each is what its kind says."""
    rng = np.random.default_rng(seed)

    def pick(*items):
        return items[int(rng.integers(len(items)))]

    def number(k: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def word(low: int = 3, high: int = 11) -> str:
        return "".join(pick("an", "er", "th", "on", "re", "tion", "le", "au", "ch", "qu", "é", "ü", "o", "da", "mi", "su", "k") for _ in range(int(rng.integers(2, 6))))[: int(rng.integers(low, high))]

    def name() -> str:
        return re.sub(r"[^a-z]", "x", word())

    def checked(prefix: str, length: int) -> str:
        body = prefix + number(length - len(prefix) - 1)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def unchecked(length: int) -> str:
        while _luhn(s := number(length)):
            pass
        return s

    def spaced(s: str, sep: str, *cuts: int) -> str:
        parts, at = [], 0
        for c in cuts:
            parts.append(s[at : at + c])
            at += c
        return sep.join([*parts, s[at:]] if s[at:] else parts)

    def iban() -> str:
        country, body = pick("DE", "FR", "GB", "ES", "NL"), number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    def mixed(k: int, alphabet: str) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def octets(high: int = 256) -> str:
        return ".".join(str(int(x)) for x in (rng.integers(1, high), *rng.integers(0, high, 3)))

    def upper(s: str) -> str:
        return s.upper() if rng.random() < 0.15 else s

    CUED = ("password", "Password", "passwd", "pwd", "secret", "token", "api_key", "api key", "API_KEY")
    makers = [
        (0, 1, lambda: upper(f"{name()}{pick('', '.', '_', '-')}{pick(name(), number(2), number(3))}@{name()}{pick('', number(1), '-' + name())}.{pick('com', 'org', 'net', 'de', 'fr', 'example.com', 'co.uk', 'io', 'es')}")),
        (0, 0, lambda: pick(f"{name()}@{name()}", f"{number(2)}@{number(2)}.{number(2)}", f"{name()}@{number(1)}.{number(1)}.{number(1)}")),
        (1, 1, lambda: octets()),
        (1, 1, lambda: pick(":".join(mixed(int(rng.integers(1, 5)), "0123456789abcdef") for _ in range(8)), f"2001:db8::{mixed(int(rng.integers(1, 5)), '0123456789abcdef')}", f"fe80::{mixed(4, '0123456789abcdef')}:{mixed(4, '0123456789abcdef')}:{mixed(3, '0123456789abcdef')}", f"2a0{number(1)}:{mixed(4, '0123456789abcdef')}:{mixed(2, '0123456789abcdef')}::{mixed(1, '0123456789abcdef')}")),
        (1, 1, lambda: pick(f"10.{rng.integers(0, 3)}.{rng.integers(0, 10)}.{rng.integers(1, 255)}", f"10.0.0.{number(1)}", f"192.168.{rng.integers(0, 10)}.{rng.integers(1, 255)}", f"172.16.{rng.integers(0, 32)}.{rng.integers(1, 255)}"), _WORDS[2], None),
        (1, 0, lambda: pick(":".join(mixed(2, "0123456789abcdef") for _ in range(6)), f"{number(1)}:{number(2)}:{number(2)}:{number(2)}", f"{number(2)}:{number(2)}:{number(2)}:{number(3)}")),
        (1, 0, lambda: pick(f"{number(1)}.{number(1)}.{number(1)}.{number(1)}", f"{rng.integers(256, 1000)}.{number(3)}.{number(3)}.{number(2)}", f"{number(1)}.{number(1)}.{number(4)}.{number(4)}")),
        (2, 1, lambda: pick(f"+{rng.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{rng.integers(1, 99)} {number(3)} {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{rng.integers(10, 99)}{number(10)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"+{rng.integers(1, 99)}-{number(3)}-{number(3)}-{number(4)}")),
        (2, 0, lambda: pick(f"{rng.integers(1900, 2100)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}", f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}", number(8), number(10), f"{number(3)}.{number(3)}.{number(3)}", f"{rng.integers(10, 28)}/{rng.integers(10, 12)}/{rng.integers(1990, 2030)}", octets(), unchecked(16), number(12), f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(1)} {number(3)} {number(3)}", f"{number(4)}.{number(6)}")),
        (2, 1, lambda: pick(f"0{number(3)} {number(8)}", f"0{number(3)}/{number(7)}", f"0{number(4)}-{number(6)}", f"0{number(3)} {number(3)} {number(4)}", f"0{number(10)}"), ("", *_WORDS[1]), None),
        (3, 1, lambda: (lambda s: pick(s, s, spaced(s, " ", 4, 4, 4), spaced(s, "-", 4, 4, 4)))(pick(checked("4", 16), checked("4", 16), checked(f"5{rng.integers(1, 6)}", 16), checked("6011", 16))) if rng.random() < 0.9 else checked(f"3{pick(4, 7)}", 15)),
        (3, 0, lambda: pick(unchecked(16), unchecked(16), unchecked(13), checked(pick("0", "9", "1", "7", "8"), 16), number(14), number(18), spaced(unchecked(16), " ", 4, 4, 4))),
        (4, 1, lambda: f"{rng.integers(100, 899)}-{number(2)}-{number(4)}"),
        (4, 1, lambda: pick(number(9), f"{number(3)} {number(2)} {number(4)}"), ("ssn", "SSN", "social security", "social security number", "tax"), None),
        (4, 0, lambda: pick(number(9), f"000-{number(2)}-{number(4)}", f"{number(3)} {number(2)} {number(4)}", f"9{number(2)}{number(6)}")),
        (5, 1, lambda: (lambda s: pick(s, spaced(s, " ", 4, 4, 4, 4, 4)))(iban())),
        (5, 0, lambda: pick(f"{pick('AB', 'XX', 'ID', 'NO')}{number(2)}{mixed(14, alnum[26:])}", f"{pick('in', 'to', 'by')}{number(2)} {number(4)} {number(4)} {number(4)}")),
        (6, 1, lambda: pick(mixed(40, "0123456789abcdef"), mixed(32, "0123456789abcdef"), "sk-" + mixed(32, alnum), "AKIA" + mixed(16, alnum[26:]), "ghp_" + mixed(36, alnum), mixed(int(rng.integers(20, 48)), alnum))),
        (6, 1, lambda: pick("AKIA" + mixed(16, alnum[26:]), "ghp_" + mixed(36, alnum), "sk-" + mixed(32, alnum), "glpat-" + mixed(20, alnum)), ("",), None),
        (6, 1, lambda: pick(f"{name()}{number(int(rng.integers(1, 5)))}", f"{name().title()}{pick('!', '#', '$', '_')}{number(2)}", mixed(int(rng.integers(8, 15)), alnum), (name() + name() + name() + name())[:32], mixed(int(rng.integers(16, 40)), alnum[:26])), CUED, (": ", "=", " = ", ":")),
        (6, 0, lambda: pick("required", "optional", "string", "expired", "invalid", "missing", "protected", "forgotten", "incorrect", "changed", "default", "generated", "removed", "rotation", "authentication", "instructions", re.sub(r"[^a-z]", "e", word(5, 11)), re.sub(r"[^a-z]", "o", word(5, 11))), CUED, (": ", "=", " = ")),
        (6, 0, lambda: pick("".join(word(6, 14) for _ in range(3)) + number(1), "-".join(name() for _ in range(4)) + number(2), "/".join(name() for _ in range(4)) + number(1), "_".join(name() for _ in range(4)) + number(1), number(16), number(20), "=" * 20 + number(1), mixed(40, "0123456789abcdef"), f"{mixed(8, '0123456789abcdef')}-{mixed(4, '0123456789abcdef')}-4{mixed(3, '0123456789abcdef')}-a{mixed(3, '0123456789abcdef')}-{mixed(12, '0123456789abcdef')}")),
    ]
    out, labels = [], []
    while len(out) < n:
        kind, good, make, *cued = makers[int(rng.integers(len(makers)))]
        value = make()
        if len(value) < 6:
            continue
        lead = " ".join(word() for _ in range(int(rng.integers(1, 7))))
        if cued:
            cue, between = pick(*cued[0]), pick(*(cued[1] or (" ", ": ", " ")))
            quote = pick('"', "'", "") if cued[1] and not between.startswith(":") else ""
            lead += f" {cue}{between if cue else ' '}{quote}"
            tail = quote + pick(" ", "\n", ". " if not cued[1] else " ") + word()
        elif kind == 6:
            digest = not good and re.fullmatch(r"[0-9a-f-]{36,40}", value)
            cue = pick(*_WORDS[6]) if good else pick(*_WORDS[9]) if digest else pick("", pick(*_WORDS[8]))
            lead += f" {upper(cue)}{pick(' = ', '=', ': ', ' ')}" + (quote := pick('"', '"', "'", ""))
            tail = quote + " " + word()
        else:
            cue = pick("", "", "", pick(*_WORDS[kind])) if good else pick("", "", pick(*_WORDS[7]), pick(*_WORDS[8]), pick(*_WORDS[10]))
            lead += f" {cue}{pick(' ', ': ', ' ') if cue else ''}"
            lead = lead if lead.endswith(" ") else lead + " "
            tail = pick("", ".", ",", "%%%", "###", "!!", "&&&", " |", ")", "") + " " + word()
        if rng.random() < 0.15:
            tail = pick(" ", ", ") + pick(octets(), number(3), number(16), number(4)) + tail
        text = lead + value + tail
        begin = len(lead)
        for span in candidates(text):
            over = min(span.end, begin + len(value)) - max(span.begin, begin)
            if over > 0:
                exact = span.begin == begin and span.end >= begin + len(value) and span.end <= begin + len(value) + 1
                out.append((text, span))
                labels.append(int(good and span.kind == kind and exact))
    return out, labels


class Detector(NamedTuple):
    """The trees and each kind's threshold."""

    trees: Boosted
    thresholds: tuple[float, ...]

    def judge(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """Spans (begin, end, kind, probability) of each text, in order, none overlapping."""
        found = [(i, s) for i, t in enumerate(texts) for s in candidates(t)]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not found:
            return out
        p = self.trees.probability(np.array([describe(texts[i], s) for i, s in found]))
        order = sorted(range(len(found)), key=lambda k: (-p[k], found[k][1].begin - found[k][1].end, found[k][1].begin, found[k][1].kind))
        for k in order:
            i, s = found[k]
            if p[k] >= self.thresholds[s.kind]:
                at = bisect(out[i], (s.begin,))
                if (not at or out[i][at - 1][1] <= s.begin) and (at == len(out[i]) or out[i][at][0] >= s.end):
                    out[i].insert(at, (s.begin, s.end, s.kind, float(p[k])))
        return out


@lru_cache(maxsize=2)
def detector(precision: float = PRECISION, examples: int = EXAMPLES) -> Detector:
    """Fit the trees to generated examples; thresholds come from others, made with another seed."""
    spans, labels = _examples(7_919, examples)
    trees = fit(np.array([describe(t, s) for t, s in spans]), np.array(labels))
    spans, labels = _examples(104_651, examples // 2)
    p, y = trees.probability(np.array([describe(t, s) for t, s in spans])), np.array(labels)
    kinds = np.array([s.kind for _, s in spans])
    thresholds = []
    for k in range(len(KINDS)):
        own = kinds == k
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds.append(max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1)
    return Detector(trees, tuple(thresholds))


def _windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end (bytes) of the stretches around digits, at signs, long tokens and close colons, to the next blanks."""
    edge = np.diff(np.concatenate([[False], _TOKEN[buf], [False]]).astype(np.int8))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = closes - opens >= _LONG
    colons = np.flatnonzero(buf == ord(":"))
    close = colons[2:][colons[2:] - colons[:-2] <= _COLONS]
    # A colon or an equals sign behind a cue word; few of them have a letter before that a cue ends in.
    signs = np.sort(np.concatenate([colons, np.flatnonzero(buf == ord("="))]))
    signs = signs[signs > 0]
    signs = signs[_CUE_ENDS[buf[signs - 1]]]
    cued = np.array([p for p in signs.tolist() if _CUE.search(buf[max(0, p - 24) : p].tobytes())], np.int64)
    at = np.unique(np.concatenate([np.flatnonzero(_ANCHOR[buf]), opens[long], closes[long] - 1, close, cued]))
    if not len(at):
        return at, at, at
    row = np.searchsorted(off, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) > 2 * _AROUND) | (row[1:] != row[:-1])])
    first, last = at[new], at[np.concatenate([new[1:], [True]])]
    row = row[new]
    blank = np.concatenate([[-1], np.flatnonzero(_BLANK[buf]), [len(buf)]])
    begin = np.maximum(first - _AROUND, off[row])
    begin = np.maximum(blank[np.searchsorted(blank, begin, "right") - 1] + 1, off[row])
    end = np.minimum(last + _AROUND, off[row + 1])
    end = np.minimum(blank[np.searchsorted(blank, end, "left")], off[row + 1])
    # Stretches that have grown into each other are one.
    new = np.concatenate([[True], (begin[1:] > np.maximum.accumulate(end)[:-1]) | (row[1:] != row[:-1])])
    stop = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
    return row[new], begin[new], np.maximum.accumulate(end)[stop]


def find(model: Detector, column: pa.Array) -> dict[str, list]:
    """Spans of a slice: row, character offsets, kind, probability."""
    buf, off = text_buffer(column)
    row, begin, end = _windows(buf, off)
    data = buf.tobytes()
    texts = [data[b:e].decode() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    base = char_offsets(buf, off, row, begin) if len(row) else row
    out: dict[str, list] = {"row": [], "begin": [], "end": [], "kind": [], "score": []}
    for r, o, spans in zip(row.tolist(), base.tolist(), model.judge(texts), strict=True):
        for b, e, k, p in spans:
            for name, value in zip(out, (r, o + b, o + e, KINDS[k], p), strict=True):
                out[name].append(value)
    return out


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row for each span: ``doc_id``, ``begin``, ``end``, ``kind``, ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(detector(precision))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = find(held.value, batch.column("text"))
            columns = [batch.column("doc_id").take(pa.array(s["row"], pa.int64())), pa.array(s["begin"], pa.int32()), pa.array(s["end"], pa.int32()), pa.array(s["kind"], pa.string()), pa.array(s["score"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "begin", "end", "kind", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets."""
    held = docs.sparkSession.sparkContext.broadcast(detector(precision))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = find(held.value, batch.column("text"))
            texts = batch.column("text").to_pylist()
            for r, b, e, k in sorted(zip(s["row"], s["begin"], s["end"], s["kind"], strict=True), reverse=True):
                texts[r] = f"{texts[r][:b]}<{k}>{texts[r][e:]}"
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return arrow_map(docs, run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data in the documents, by offsets and kind; the data themselves are not repeated."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
