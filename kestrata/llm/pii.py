"""Personal data by boosted trees over candidate spans.

High-recall generators propose overlapping spans of five kinds: e-mail
addresses (written out with "at" and "dot" too), dotted quads (defanged or
spaced too), long runs of digits in groups, phone numbers with or without a
plus, and secrets (long tokens of letters and digits).  Spans of the base
patterns are always redacted; of the other candidates those are added whose
calibrated probability reaches the threshold of their kind, which is the least
that keeps ``PRECISION`` on documents kept back, the best first where spans
overlap.

Each kind has trees of its own, and what they learn is not the base patterns.  ``_plants`` writes into
sampled documents, at places of its own, personal data in forms that the base
misses (a true label: it is known to be there) and near misses of each kind
(failing check digits, parts over 255, dates, ISBNs, file names, checksums);
base spans are true and the corpus's own other candidates false, but for
secrets, which have no base pattern and are learnt from plants alone.

Training reads at most ``SAMPLE`` rows of at most ``SAMPLE_BYTES`` each, those
of least hash among texts with a digit run or an at sign; scanning reads every
whole text.

Defined results: null and empty texts have no spans; repeated rows are scanned
one by one; without candidates to learn from nothing is added; an empty table
gives no rows; further columns are kept by ``redacted``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _boost
from ._text import chunks

SAMPLE = 3_000
SAMPLE_BYTES = 20_000
HELD_BACK = 4
TREES = 60  # of each kind
PRECISION = 0.97
KINDS = ("email", "ip", "card", "phone")  # of the base patterns
EVERY = (*KINDS, "secret")

# fixed values: the base patterns, written so that no text makes them slow
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at ")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}| dot [A-Za-z0-9-]{2,63}|\.[A-Za-z0-9-]{2,63}){1,4}")
_LIKE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\[\.\] ?| ?\(\.\) ?| \. |\.)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9 ().-]{5,20}[0-9](?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,200}={0,2}(?![A-Za-z0-9_+/=-])"),
}
_HINTS = ("mail", "contact", "tel", "phone", "call", "fax", "mobil", "card", "visa", "credit", "pay", "ip", "host", "server", "addr", "id", "order", "ref", "no", "version", "isbn", "date", "file", "token", "key", "secret", "passw", "auth", "bearer", "sha", "md5", "commit", "digest", "checksum", "=", ":")
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind and start, in code points."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        local = text[end:at]
        start = end + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _written_out(text: str) -> list[tuple[str, int, int]]:
    """Addresses with a written-out sign: from each sign, the host after it and the local part before it."""
    out = []
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        before = text[max(0, m.start() - 64) : m.start()]
        start = m.start() - len(before) + len(before.rstrip(_LOCAL))
        if host and start < m.start():
            out.append(("email", start, host.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base spans and whatever looks like one."""
    found = dict.fromkeys([*base_spans(text), *_written_out(text)])
    for kind, like in _LIKE.items():
        found |= dict.fromkeys((kind, *m.span()) for m in like.finditer(text) if kind != "secret" or (sum(c.isdigit() for c in m[0]) >= 4 and any(c.isalpha() for c in m[0])))
    return list(found)


def _edge(c: str) -> list[float]:
    return [float(c == ""), float(c.isspace()), float(c.isalpha()), float(c.isdigit()), float(c in ".,;:!?"), float(c in "()[]<>\"'")]


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    _, lo, hi = span
    s = text[lo:hi]
    runs = _DIGITS.findall(s)
    groups, digits = [len(g) for g in runs], "".join(runs)
    before, after = text[max(0, lo - 24) : lo].lower(), text[hi : hi + 8]
    letters = [c for c in s if c.isalpha()]
    last = re.split(r"[^A-Za-z0-9]", s)[-1].lower()
    return [
        float(len(s)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(") + s.count("[")), float("@" in s), float(" at " in s), float(" dot " in s), float("dot)" in s or "dot]" in s), float(len(s) - s.rfind(".")),
        float(s[:1] == "+"), float(s[:2] == "00"), float(s[:1] == "("), float(_luhn(digits)), float(max((int(r) for r in runs if len(r) < 6), default=0)), float(digits[:2] in ("19", "20")), float(digits[:3] in ("978", "979")),
        float(len(letters)), float(sum(c.isupper() for c in letters)), float(bool(s) and all(c in "0123456789abcdefABCDEF" for c in s)), len(set(s)) / max(1, len(s)), float(s.count("_")), float(last in _ENDINGS), float(any(c.isdigit() for c in s.split(" ")[0])),
        *_edge(text[lo - 1 : lo] if lo else ""), *_edge(after[:1]),
        *[float(h in before) for h in _HINTS],
    ]


def _check_digit(digits: str) -> str:
    return next(c for c in "0123456789" if _luhn(digits + c))


def _digits(rnd: random.Random, n: int) -> str:
    return str(rnd.randint(1, 9)) + "".join(rnd.choice("0123456789") for _ in range(n - 1))


def _grouped(rnd: random.Random, digits: str, sizes: tuple[int, ...], signs: tuple[str, ...]) -> str:
    sign, out, at = rnd.choice(signs), [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sign.join(x for x in [*out, digits[at:]] if x)


def plant(rnd: random.Random, words: list[str]) -> tuple[str, str, str, bool]:
    """Kind, context before, text and truth of a made-up span that the base patterns don't decide; ``words`` are the document's."""
    kind, true = rnd.choice(EVERY), rnd.random() < 0.5
    word = lambda: "".join(c for c in rnd.choice(words) if c.isascii() and c.isalnum()) or "ab"
    hint = ""
    if kind == "email":
        name = word() + rnd.choice(("", f".{rnd.randint(1, 99)}", "_" + word()))
        if true:
            dot = rnd.choice((" dot ", ".", "(dot)", " [dot] ", "."))
            at = rnd.choice((" at ", "(at)", " (at) ", " [at] ", "[at]"))
            text = name + at + dot.join([rnd.choice((word(), "mail", "example")), *[word()] * rnd.randint(0, 1), rnd.choice(_ENDINGS)])
            hint = rnd.choice(("", "", "e-mail ", "contact "))
        else:
            text = rnd.choice((f"{word()} at {word()}.{rnd.choice(('txt', 'html', 'pdf', 'py', 'The', word()))}", f"{word()} at {rnd.randint(1, 23)}.{rnd.randint(10, 59)}", f"{word()} at {word()}.{word().capitalize()}"))
    elif kind == "ip":
        parts = [rnd.randint(0, 255) for _ in range(4)]
        if not true:
            parts[rnd.randrange(4)] = rnd.randint(256, 999)
        text = rnd.choice(("[.]", "(.)", " . ", " [.] ") + (() if true else (".", "."))).join(map(str, parts))
        hint = rnd.choice(("", "host ", "ip ")) if true else rnd.choice(("", "version ", "no "))
    elif kind == "card":
        n = rnd.choice((13, 14, 15, 16, 16))
        digits = _digits(rnd, n - 1)
        digits += _check_digit(digits) if true else str((int(_check_digit(digits)) + rnd.randint(1, 9)) % 10)
        text = _grouped(rnd, digits, (4, 4, 4) if n == 16 else (4, 6), (".", "  ", ". ") if n == 16 and true else (" ", "-", "", "."))
        hint = rnd.choice(("", "card ", "visa ")) if true else rnd.choice(("", "order ", "ref ", "id "))
    elif kind == "phone":
        if true:
            d = _digits(rnd, 10)
            text = rnd.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"00{rnd.randint(30, 60)} {d[:2]} {d[2:9]}"))
            hint = rnd.choice(("", "", "tel ", "call ", "phone: "))
        else:
            text = rnd.choice((f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"{rnd.randint(1900, 2000)}-{rnd.randint(2000, 2030)}", f"978-{rnd.randint(0, 9)}-{rnd.randint(10, 99)}-{rnd.randint(100000, 999999)}-{rnd.randint(0, 9)}", f"{rnd.randint(1, 99)} {rnd.randint(100, 999)} {rnd.randint(100, 999)}", _digits(rnd, rnd.randint(8, 12)), f"{rnd.randint(1, 99)}.{rnd.randint(100, 999)}.{rnd.randint(100, 999)}"))
            hint = rnd.choice(("", "", "order ", "date ", "isbn "))
    else:
        marks = "0123456789abcdef" if rnd.random() < 0.6 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        text = "".join(rnd.choice(marks) for _ in range(rnd.choice((32, 40, 64) if len(marks) == 16 else (24, 36, 44))))
        if true:
            quote = rnd.choice(("", '"', "'"))
            hint = rnd.choice(("token = ", "api_key: ", "secret=", "password: ", "key = ", "Authorization: Bearer ")) + quote
            text = rnd.choice(("", "", "ghp_", "AKIA", "sk-")) + text
        elif rnd.random() < 0.5:
            hint = rnd.choice(("commit ", "sha256:", "md5 ", "checksum ", "digest: ", ""))
        else:
            text = rnd.choice(("_", "-", "/")).join([word() for _ in range(4)] + [str(rnd.randint(1000, 10**6))] + ["page", "chapter"])
    return kind, hint, text, true


def _plants(text: str, rnd: random.Random, n: int) -> Iterator[tuple[str, tuple[str, int, int], bool]]:
    """Copies of a text's neighbourhoods, each with one planted span: the candidates that overlap it, and whether they are what was planted."""
    words = text[:2000].split() or ["ab"]
    for _ in range(n):
        kind, hint, span, true = plant(rnd, words)
        at = rnd.randint(0, len(text))
        while at < len(text) and not text[at].isspace():
            at += 1
        left, right = text[max(0, at - 64) : at], text[at : at + 64]
        copy = f"{left} {hint}{span}" + ("\"" if hint[-1:] == '"' else "") + rnd.choice((" ", ". ", ", ", "\n")) + right
        lo = len(left) + 1 + len(hint)
        for c in candidates(copy):
            if c[1] < lo + len(span) and c[2] > lo:  # of another kind, it is a near miss of that kind
                yield copy, c, true and c[0] == kind and c[1] <= lo + 1 and c[2] >= lo + len(span) - 1


@dataclass
class Judge:
    """Trees of one kind, with Platt's slope and offset and the threshold."""

    trees: _boost.Trees
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.logits(x) + self.offset, -50, 50)))

    def calibrate(self, x: np.ndarray, t: np.ndarray, decides: np.ndarray) -> None:
        """Logistic regression of the label on the logit, and the least threshold that keeps ``PRECISION`` among those that ``decides``."""
        raw = self.trees.logits(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -50, 50)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - t) * raw).sum(), (p - t).sum()])
            step = np.linalg.solve(np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + np.eye(2), g)
            self.slope, self.offset = self.slope - float(np.clip(step[0], -1, 1)), self.offset - float(np.clip(step[1], -1, 1))
        p = self.probability(x)
        for c in np.arange(0.5, 0.991, 0.01):
            picked = decides & (p >= c)
            if picked.sum() >= 20 and t[picked].mean() >= PRECISION:
                self.threshold = float(c)
                return


@dataclass
class Model:
    judges: dict[str, Judge] = field(default_factory=dict)


def spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans that are redacted, by kind and start."""
    base = base_spans(text)
    if not model.judges:
        return base, base
    known = set(base)
    more = [c for c in candidates(text) if c not in known and c[0] in model.judges]
    if more and base:  # those that no base span overlaps
        lo, hi = (np.array(x) for x in zip(*sorted((a, b) for _, a, b in base), strict=True))
        hi = np.maximum.accumulate(hi)
        at = np.searchsorted(lo, [c[2] for c in more])
        more = [c for c, i in zip(more, at.tolist(), strict=True) if not i or hi[i - 1] <= c[1]]
    added: list[tuple[str, int, int]] = []
    if more:
        p = np.zeros(len(more))
        for kind, judge in model.judges.items():
            own = [i for i, c in enumerate(more) if c[0] == kind]
            if own:
                p[own] = judge.probability(np.array([describe(text, more[i]) for i in own]))
        taken: list[tuple[int, int]] = []  # by start, apart from each other
        for i in np.argsort(-p, kind="stable"):
            kind, lo, hi = more[i]
            if p[i] < model.judges[kind].threshold:
                continue
            at = bisect.bisect_left(taken, (lo, hi))
            if (at == 0 or taken[at - 1][1] <= lo) and (at == len(taken) or taken[at][0] >= hi):
                taken.insert(at, (lo, hi))
                added.append(more[i])
    return base, sorted([*base, *added], key=lambda c: (EVERY.index(c[0]), c[1]))


def _maybe(column: pa.Array) -> np.ndarray:
    """Which texts can hold a candidate: every generator needs four digits, an at sign, or one written out."""
    out = []
    for c in chunks(column):
        b = c.buf
        digits = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
        at = np.concatenate([[0], np.cumsum(b == 64)])
        may = (np.diff(digits[c.at]) >= 4) | (np.diff(at[c.at]) > 0)
        raw = b.tobytes()
        for d in np.flatnonzero(~may):
            t = raw[c.at[d] : c.at[d + 1]]
            may[d] = b" at " in t or b"(at)" in t or b"[at]" in t
        out.append(may)
    return np.concatenate(out) if out else np.zeros(0, bool)


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Model:
    """Learn which formats and contexts are personal data from base spans, plants and near misses in a sample of texts."""
    likely = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike("[0-9]{3}|@") & (F.octet_length("text") <= SAMPLE_BYTES))
    some = likely.orderBy(F.xxhash64(F.lit(seed), "doc_id", "text"), "doc_id", "text").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, of = set(base_spans(text)), zlib.crc32(f"{i}:{text}".encode())
                found = [(text, c, c in base) for c in candidates(text) if c[0] != "secret"]
                found += _plants(text, random.Random(of), 6)
                rows += [(of, n, EVERY.index(c[0]), y, t is text and y, describe(t, c)) for n, (t, c, y) in enumerate(found)]
            if rows:
                i, n, k, y, base, x = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(y), pa.array(base), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "n", "kind", "y", "base", "x"])

    rows = some.repartition(8).mapInArrow(run, "doc_id long, n int, kind int, y boolean, base boolean, x array<double>").toArrow()
    if rows.num_rows < 50:
        return Model()
    rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    x, y = np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
    kind, doc = rows.column("kind").to_numpy(), rows.column("doc_id").to_numpy()
    base = rows.column("base").to_numpy(zero_copy_only=False)
    kept = doc % HELD_BACK == 0
    m = Model()
    for k, name in enumerate(EVERY):
        fit, check = (kind == k) & ~kept, (kind == k) & kept
        if 0 < y[fit].sum() < fit.sum() and check.any():
            judge = Judge(_boost.fit(x[fit], y[fit], TREES))
            judge.calibrate(x[check], y[check], ~base[check])  # base spans go by themselves: what is added decides
            if judge.threshold <= 1:
                m.judges[name] = judge
    return m


def _join(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_added (spans beyond the base) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n = b.num_rows
            counts, added, sha, every = np.zeros((len(KINDS), n), np.int64), np.zeros(n, np.int64), [nothing] * n, [""] * n
            column = b.column("text")
            for i in np.flatnonzero(_maybe(column)).tolist():
                base, found = spans(column[i].as_py(), model)
                for k, _, _ in base:
                    counts[KINDS.index(k), i] += 1
                added[i] = len(found) - len(base)
                sha[i], every[i] = hashlib.sha256(_join(base).encode()).hexdigest(), _join(found)
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c) for c in counts], pa.array(sha), pa.array(every), pa.array(added)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with every span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str) -> str:
        out, at = [], 0
        for kind, lo, hi in sorted(spans(text, shared.value)[1], key=lambda c: (c[1], -c[2])):
            if lo >= at:
                out += [text[at:lo], f"[{kind.upper()}]"]
            at = max(at, hi)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, may = b.column("text"), _maybe(b.column("text"))
            new = pa.array([clean(t.as_py()) if m else t.as_py() for t, m in zip(text, may, strict=True)], pa.string())
            yield pa.record_batch([new if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
