"""Personal data: patterns, and a linear-chain CRF that adds what no pattern describes (operator 6).

Patterns find e-mail addresses, IP addresses, card and phone numbers. The CRF labels tokens by word shapes; it is trained
on a small labelled table that this module writes itself, and decoded by Viterbi in numpy batches. It looks at
the surroundings of each token that holds a digit or an at sign or spells one out; every other token is outside by definition.
What it finds is added if it is well-formed for its kind and touches no pattern's span.

Defined results: a null or empty text has no spans. Spans count code points, their end is exclusive. Number parts of any
length are judged by their value. Where numbers stand so close that their surroundings never part, the CRF reads overlapping stretches
of about ``_LONGEST`` characters; a span that two of them find is one. Repeated rows, and rows without an id, are scanned alike.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices
from .crf import Crf

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A number is entered at its first digit alone and never given back, which finds the same spans in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
Span = tuple[int, int, int]


def _part(digits: str) -> bool:
    """Whether a number, however many zeros it begins with, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """As _EMAIL's leftmost matches, in time linear in the text: from each at sign leftwards and rightwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns as (kind number, start, end)."""
    found: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_TRIGGER = re.compile(r"\d+|@|[(\[{] ?(?:at|AT) ?[)\]}]|\b[Dd]ot\b|\bDOT\b")
_CUES = frozenset("phone tel telephone call mobile cell fax whatsapp mail email e contact card visa mastercard amex credit debit ip host address server at dot com org net de fr es io edu example version page chapter section year id order invoice license licence token password key no nr number".split())
_REACH = 36
#: Characters of a window that grows no further, and tokens that are described and decoded at once.
_LONGEST, _AT_ONCE = 4000, 60_000


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"9x{min(len(token), 9)}"
    if token[0].isalpha():
        return ("A" if token[0].isupper() else "a") + ("A" if len(token) > 1 and token[1:].isupper() else "a" if len(token) > 1 else "")
    return token


def features(tokens: list[str], gaps: list[bool]) -> list[list[str]]:
    """Word-shape features of each token and its neighbours; gaps: whether white space comes before."""
    shapes = [_shape(t) for t in tokens]
    words = [w if (w := t.lower()) in _CUES else "" for t in tokens]
    out = []
    for i, s in enumerate(shapes):
        fs = ["bias", f"s{s}", f"g{gaps[i]}{s}"]
        for d in (-4, -3, -2, -1, 1, 2, 3, 4):
            j = i + d
            o = shapes[j] if 0 <= j < len(shapes) else "^"
            if -2 <= d <= 2:
                fs.append(f"{d}s{o}")
            if abs(d) == 1:
                fs.append(f"{d}p{o}{s}{gaps[max(i, j)] if 0 <= j < len(shapes) else ''}")
            if 0 <= j < len(shapes) and words[j]:
                fs.append(f"{d}w{words[j]}")
                fs.append(f"{'l' if d < 0 else 'r'}w{words[j]}")
        if words[i]:
            fs.append(f"w{words[i]}")
        out.append(fs)
    return out


def labelled_table(rows: int = 450, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Made-up lines with the spans they hold: forms that patterns miss, forms that they find, and harmless numbers."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = "an er on th ed sh ing re le ou en que el des ber ein lich tion ado ment ar os ne ka mi to".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda a, b: " ".join(w.capitalize() if r.random() < 0.1 else w for w in (word() + r.choice(["", "", "", "", ".", ","]) for _ in range(r.randint(a, b))))

    def email() -> str:
        at = r.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", " AT ", " {at} "])
        dot = " dot " if at in (" at ", " AT ") else r.choice([" (dot) ", " [dot] ", "(dot)", ".", " dot ", "[dot]"])
        name = word() + r.choice(["", d(2), "." + word(), "." + d(2)])
        return name + at + word() + r.choice(["", d(1)]) + dot + r.choice(["example", word()]) * (k := r.random() < 0.4) + dot * k + r.choice(["com", "org", "net", "de", "fr", "es", "io"])

    def phone() -> str:
        return r.choice([lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(4)}/{d(6)}"])()

    def card() -> str:
        return f"{r.choice('3456')}{d(3)}" + r.choice([f" {d(4)} {d(4)} {d(3)}", f".{d(4)}.{d(4)}.{d(4)}", f" {d(6)} {d(5)}"])

    def ip() -> str:
        return r.choice([":".join("%x" % r.randrange(4096, 65536) for _ in range(8)), "[.]".join(str(r.randrange(1, 255)) for _ in range(4))])

    harmless = [
        lambda: d(16), lambda: f"{d(1)}.{d(1)}", lambda: f"version {d(1)}", lambda: f"CC BY-NC {d(1)}.{d(1)}", lambda: f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}",
        lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)), lambda: f"{d(4)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: d(r.randint(1, 8)), lambda: f"order {d(9)}", lambda: f"page {d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(3)} {d(3)}", lambda: f"{d(1)} at {d(1)}", lambda: "dot", lambda: f"{d(4)} to {d(4)}",
        lambda: f"{d(4)} - {d(4)}", lambda: f"{d(2)}%", lambda: " ".join(d(2) for _ in range(r.randint(2, 9))), lambda: f"https://www.example.com/{d(3)}?p={d(2)}", lambda: f"@{word()}", lambda: f"{word()}[{d(1)}]", lambda: f"{d(1)}x{d(1)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(16)} {word()} {d(3)}",
    ]
    known = [lambda: (0, f"{word()}.{d(2)}@mail{d(1)}.example.com"), lambda: (1, ".".join(str(r.randrange(1, 255)) for _ in range(4))), lambda: (3, f"+1 ({d(3)}) 555-{d(4)}"), lambda: (2, f"{d(4)} {d(4)} {d(4)} {d(4)}")]
    new = [(0, email), (2, card), (3, phone), (1, ip)]
    cues = {0: ["mail ", "email: ", "contact "], 1: ["ip ", "host ", "server "], 2: ["card ", "visa ", "card no. ", "credit card: "], 3: ["phone ", "tel. ", "call ", "tel: ", "phone: ", "mobile "]}
    table = []
    for _ in range(rows):
        text, spans = prose(2, 6) + " ", []
        for _ in range(r.randint(1, 3)):
            x = r.random()
            if x < 0.45:
                text += r.choice(harmless)()
            else:
                kind, made = r.choice(known)() if x < 0.65 else (lambda p: (p[0], p[1]()))(r.choice(new))
                # A plain number form is personal data only after a word that says so, an odd spelling always.
                if (kind in (2, 3) and x >= 0.65) or r.random() < 0.3:
                    text += r.choice(cues[kind])
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            text += " " + prose(2, 5) + r.choice([" ", ". "])
        if r.random() < 0.15:  # the same forms without their cue stay unlabelled
            text += r.choice([f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"4{d(3)}.{d(4)}.{d(4)}.{d(4)}"]) + " " + prose(1, 3)
        table.append((text, spans))
    return table


def _tokens(text: str, a: int = 0, b: int | None = None) -> tuple[list[str], list[int], list[bool]]:
    tokens, starts, gaps, end = [], [], [], a
    for m in _TOKEN.finditer(text, a, len(text) if b is None else b):
        tokens.append(m[0])
        starts.append(m.start())
        gaps.append(m.start() > end)
        end = m.end()
    return tokens, starts, gaps


LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


@lru_cache(1)
def model() -> Crf:
    sequences, tags = [], []
    for text, spans in labelled_table():
        tokens, starts, gaps = _tokens(text)
        row = ["O"] * len(tokens)
        for kind, a, b in spans:
            inside = [i for i, s in enumerate(starts) if a <= s < b]
            for n, i in enumerate(inside):
                row[i] = f"{'I' if n else 'B'}-{KINDS[kind]}"
        sequences.append(features(tokens, gaps))
        tags.append(row)
    return Crf.train(sequences, tags, LABELS)


def windows(text: str) -> list[tuple[int, int]]:
    """The surroundings of tokens that may belong to personal data, cut at blanks where one is near and merged where they meet. One
    that has grown to ``_LONGEST`` is closed; the next begins with its own surroundings, so it overlaps the one before."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.start() - _REACH, m.end() + _REACH
        a = 0 if a <= 0 else e + 1 if (e := max(text.rfind(" ", a - _REACH if a > _REACH else 0, a), text.rfind("\n", a - _REACH if a > _REACH else 0, a))) >= 0 else a
        b = len(text) if b >= len(text) else (e if 0 <= (e := text.find(" ", b, b + _REACH)) else b)
        if out and a <= out[-1][1] and out[-1][1] - out[-1][0] < _LONGEST:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Taken:
    """Spans of a text for questions about ranges, each answered by one bisection."""

    def __init__(self, spans: Iterable[Span]):
        pairs = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends = [a for a, _ in pairs], list(accumulate((b for _, b in pairs), max))

    def holds(self, a: int, b: int) -> bool:
        """Whether a single span or overlapping ones reach over the range."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def _sound(kind: int, found: str) -> bool:
    digits = sum(c.isdigit() for c in found)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", found, re.I)) and bool(re.search(r"\.|\bdot\b", found, re.I))
    if kind == 1:
        return len(re.findall(r"[0-9a-fA-F]+", found)) in (4, 8) and digits >= 4
    return 13 <= digits <= 19 if kind == 2 else 8 <= digits <= 15


def find(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """For each text, the patterns' spans and the spans that the CRF adds. At most about ``_AT_ONCE`` tokens have features at a time."""
    base = [base_spans(t) for t in texts]
    taken = [_Taken(spans) for spans in base]
    added: list[dict[Span, None]] = [{} for _ in texts]
    where, sequences, waiting = [], [], 0

    def decode() -> None:
        for (k, tokens, starts), labels in zip(where, crf.decode(sequences)):
            i = 0
            while i < len(labels):
                if labels[i] == "O":
                    i += 1
                    continue
                kind, j = labels[i][2:], i + 1
                while j < len(labels) and labels[j] == f"I-{kind}":
                    j += 1
                span = (KINDS.index(kind), starts[i], starts[j - 1] + len(tokens[j - 1]))
                if _sound(span[0], texts[k][span[1] : span[2]]) and not taken[k].touches(span[1], span[2]):
                    added[k][span] = None
                i = j
        where.clear()
        sequences.clear()

    for k, text in enumerate(texts):
        for a, b in windows(text):
            # A window whose every number lies in a pattern's span has nothing to add.
            if base[k] and all(taken[k].holds(*m.span()) for m in _TRIGGER.finditer(text, a, b)):
                continue
            tokens, starts, gaps = _tokens(text, a, b)
            if tokens:
                where.append((k, tokens, starts))
                sequences.append(features(tokens, gaps))
                waiting += len(tokens)
                if waiting >= _AT_ONCE:
                    decode()
                    waiting = 0
    decode()
    return [(b, list(more)) for b, more in zip(base, added)]


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, their union by the first one's."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, ddl: str, result, text: str) -> DataFrame:
    crf = model()
    schema, at = docs.schema, docs.columns.index(text)
    names = [*docs.columns, *(x.split()[0] for x in ddl.split(", ") if x)]

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, at):
                yield pa.RecordBatch.from_arrays(result(part, find(texts, crf), texts), names=names)

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spread(docs).mapInArrow(run, ", ".join(x for x in (before, ddl) if x))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the patterns' spans by kind, their digest, and all spans."""

    def result(batch, found, texts):
        counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(4)]
        return [*batch.columns, *counts, pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]), pa.array([listed(base + more) for base, more in found], pa.string())]

    ddl = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return _mapped(docs.select(F.col(key), F.col(text)), ddl, result, text).drop(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all found spans replaced in the text; a null text stays null."""

    def result(batch, found, texts):
        at = batch.schema.get_field_index(text)
        valid = batch.column(at).is_valid().to_pylist()
        new = [redacted(t, base + more) if ok else None for t, (base, more), ok in zip(texts, found, valid)]
        return [*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]]

    return _mapped(docs, "", result, text)
