"""Personal data in texts: fixed base spans, and candidates that boosted trees choose from."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees
from tessera.llm.common import batches, col, ship, written

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns and their limits.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (16, 19), (8, 15), 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the base pattern, leftmost and without overlap, found from their @ signs: time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of each kind by the fixed patterns, by kind as listed, then start. Leftmost and without overlap in a kind; matches outside the limits are dropped."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_PART for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1] and CARD_DIGITS[0] <= len(d := _digits(m[0])) <= CARD_DIGITS[1] and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
            out.append(("phone", m.start(), m.end()))
    return out


#: What may be personal data, kind by kind; spans may overlap. Each pattern is bounded, so its time is linear in the text.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\[at\]|\(at\)|\{at\}|＠) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])")),
    ("email", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} at [A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])")),
    ("phone", re.compile(r"(?<![A-Za-z0-9.+(-])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![A-Za-z0-9])")),
    ("phone", re.compile(r"(?<![A-Za-z0-9.+-])(?:00|0|1)?[1-9][0-9]{8,11}(?![A-Za-z0-9.])")),
    ("card", re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{4}(?:[ .:/_-]{1,2}[0-9]{4}){2}[ .:/_-]{1,2}[0-9]{3,4}(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{13,19}(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![A-Za-z0-9.])")),
)
_MAYBE = re.compile(r"[0-9]|\[at\]|\(at\)|\{at\}| at |＠")
# Words that speak for or against personal data near a candidate.
_FOR = ("phone", "tel", "call", "mobile", "fax", "contact", "reach", "mail", "write", "address", "card", "visa", "pay", "telefon", "appel", "llama", "numéro", "whatsapp")
_AGAINST = ("version", "license", "lizenz", "order", "invoice", "isbn", "sku", "id", "part", "page", "chapter", "serial", "build", "total", "price", "eur", "usd", "$", "figure", "table", "date", "token", "password", "sha", "hash")
_CONTEXT = 32
#: Candidates whose features are held at a time.
FEATURE_ROWS = 20_000


class Intervals:
    """Disjoint spans in order, asked and added to by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):  # those that overlap become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meet(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        """One that meets none of those there."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that the generators propose, but those that overlap a base span of their kind. They may overlap one another."""
    if not _MAYBE.search(text):
        return []
    out = {(kind, m.start(), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)}
    if not out:
        return []
    taken = {k: Intervals((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    return sorted(s for s in out if not taken[s[0]].meet(s[1], s[2]))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, the same length for every kind."""
    kind, start, end = span
    body, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - _CONTEXT) : start].lower(), text[end : end + _CONTEXT].lower()
    runs = [len(r) for r in re.findall("[0-9]+", body)]
    near = re.findall(r"[^\s:;,.=()]+", before)[-4:]
    return [
        *(float(kind == k) for k in KINDS),
        len(body), len(digits), len(runs), max(runs, default=0), min(runs, default=0), runs[-1] if runs else 0,
        float("(" in body), body.count("-"), body.count("."), body.count(" "), body.count("/"),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] in ("4", "5") and len(digits) == 16), float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.]", body))),
        float("dot" in body.lower()), float("at" in body.lower()), float(body[:1] == "0"), float(len(set(digits)) <= 2),
        float(before[-1:] in ("", " ", "\n", "(", ":")), float(before[-1:] in ("=", '"', "#", "/")), float(after[:1] in ("", " ", "\n", ".", ",", ")", ";")),
        float(any(w.startswith(f) for w in near for f in _FOR)), float(any(w.startswith(f) for w in near for f in _AGAINST)), float("+" in before[-3:]),
        float(any(w.startswith(f) for w in re.findall(r"\S+", after)[:2] for f in _AGAINST)),
    ]


def examples(n: int, seed: int = 3) -> tuple[list[str], list[Span], np.ndarray]:
    """Made-up texts with one candidate each: personal data in the ways that the base patterns miss, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "de", "ci", "ou", "le", "st") for _ in range(int(rng.integers(1, 5))))

    def card(valid: bool) -> str:
        d = pick("4", "5", "37", "6011") + num(14)
        d = d[:15]
        check = next(c for c in "0123456789" if luhn(d + c))
        return d + (check if valid else str((int(check) + int(rng.integers(1, 10))) % 10))

    texts, spans, y = [], [], []
    while len(y) < n:
        good, kind = bool(rng.integers(2)), pick("email", "phone", "phone", "card", "ip", "number")
        lead = pick("", "", pick("call", "tel", "phone:", "contact", "mail", "card no", "reach me") + " ")
        bad_lead = pick("", pick("order", "version", "invoice", "serial", "id", "isbn", "part no", "total", "build") + pick(" ", ": ", "=", " #"))
        if kind == "email":
            body = f"{word()}{pick('.', '', '_')}{word()}{(sign := pick(' at ', ' [at] ', '(at)', '[at]', ' (at) ', '＠'))}{word()}{pick(' dot ', ' [dot] ', '(dot)', ' (dot) ', *(['.'] if sign != ' at ' else []))}{pick('com', 'org', 'net', 'de', 'es')}" if good else f"{word()} at {word()}.{word()}"
        elif kind == "phone":
            body = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(3)} {num(3)}") if good else pick(f"{rng.integers(1900, 2030)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{rng.integers(1900, 2030)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"{num(4)}-{num(4)}-{num(2)}", f"{num(2)}-{num(2)}-{num(2)}")
        elif kind == "card":
            c = card(good)
            sep = pick(".", "/", "_", "  ", " - ", ":")
            body = sep.join((c[:4], c[4:8], c[8:12], c[12:16]))
        elif kind == "ip":
            body = pick("[.]", "(.)").join(str(int(v)) for v in rng.integers(0, 256, 4)) if good else " . ".join(str(int(v)) for v in rng.integers(0, 256, 4))
        else:
            good, body = False, pick(num(10), num(11), num(13), num(14), card(False), num(12))
        lead = lead if good else bad_lead
        left = " ".join(word() for _ in range(int(rng.integers(0, 8)))) + pick(" ", "\n")
        text = f"{left}{lead}{body}{pick('', '.', ',')} {' '.join(word() for _ in range(int(rng.integers(1, 8))))}"
        found = [s for s in candidates(text, base_spans(text)) if s[1] >= len(left)]
        for s in found:
            exact = s[1] == len(left) + len(lead) and s[2] == len(left) + len(lead) + len(body)
            texts.append(text)
            spans.append(s)
            y.append(float(good and exact and s[0] == kind))
    return texts, spans, np.array(y)


def masked(body: str, kind: str) -> str | None:
    """A base span written in a way that the base patterns miss, which one its own digest says; null where it has none."""
    draw, digits = zlib.crc32(body.encode()), _digits(body)
    if kind == "email":
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", " (dot) "))[draw % 5]
        local, domain = body.split("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return body.replace(".", ("[.]", "(.)")[draw % 2])
    if kind == "card":
        return (".", "/", "_", ":")[draw % 4].join(digits[i : i + 4] for i in range(0, 16, 4)) if len(digits) == 16 else None
    area, front, line = digits[-10:-7], digits[-7:-4], digits[-4:]  # without the country's number
    return (f"({area}) {front}-{line}", f"{area}-{front}-{line}", f"{area}.{front}.{line}", f"{area} {front} {line}")[draw % 4] if len(digits) >= 10 else None


_DATE = re.compile(r"(?:19|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}")
_NEXT_SENTENCE = re.compile(r"\. [A-Z]")


def refused(body: str, kind: str) -> bool:
    """A look-alike for sure: a card number that fails its check digit, an address with a part over its limit, a date, a mail address that runs on into the next sentence."""
    if kind == "card":
        return not luhn(_digits(body))
    if kind == "ip":
        return any(int(p) > IP_PART for p in re.findall("[0-9]+", body))
    return bool(_DATE.fullmatch(body) if kind == "phone" else _NEXT_SENTENCE.search(body))


#: Documents of a table and spots in them that the trees learn from at most, those of least hash.
FIT_DOCUMENTS, FIT_SPANS = 2_000, 8_000
#: What a document needs to hold a base span, as Spark's patterns.
_LIKELY = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{7}|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]([\x20-]?[0-9]){15}"


def learned(text: str, most: int = FIT_SPANS) -> list[tuple[int, int, str, list[float], float]]:
    """What a text teaches: (rank, start, kind, features, right). At most ``most`` spots, those of least rank, which is a hash of place and kind.

    A base span, masked where it stands, is right, and other candidates that overlap it are wrong. Wrong too are candidates that are refused, and
    those that overlap a base span of another kind.
    """
    base = base_spans(text)
    other = {k: Intervals((a, b) for kind, a, b in base if kind != k) for k in KINDS}
    spots = [(s, True) for s in base] + [(s, False) for s in candidates(text, base) if other[s[0]].meet(s[1], s[2]) or refused(text[s[1] : s[2]], s[0])]
    ranked = nsmallest(most, ((zlib.crc32(f"{kind}:{a}:{b}".encode()), a, b, kind, right) for (kind, a, b), right in spots))
    out = []
    for rank, a, b, kind, right in ranked:
        if not right:
            out.append((rank, a, kind, features(text, (kind, a, b)), 0.0))
            continue
        body, before = masked(text[a:b], kind), text[max(0, a - 2 * _CONTEXT) : a]
        if body is not None:
            window, here = before + body + text[b : b + 2 * _CONTEXT], (kind, len(before), len(before) + len(body))
            for s in candidates(window, base_spans(window)):
                if s[1] < here[2] and s[2] > here[1]:
                    out.append((rank, a, s[0], features(window, s), float(s == here)))
    return out


#: Share of a kind's chosen spans that are right, at least, on examples that the trees have not seen.
PRECISION = 0.98


@dataclass
class Detector:
    """The trees, a threshold for each kind, and for each kind what the rows that only set thresholds say: how many there are, precision, recall."""

    trees: BoostedTrees
    limits: dict[str, float]
    seen: dict[str, tuple[int, float, float]]


def trained(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Detector:
    """Trees from parts 0 and 1, calibration from 2, and from 3 the least calibrated probability for each kind at and above which 98 in 100 are right."""
    trees = BoostedTrees().fit(x[part < 2], y[part < 2]).calibrate(x[part == 2], y[part == 2])
    p, right, limits, seen = trees.probability(x[part == 3]), y[part == 3], {}, {}
    for i, kind in enumerate(KINDS):
        mine = x[part == 3][:, i] == 1
        order = np.argsort(-p[mine], kind="stable")
        good = np.cumsum(right[mine][order]) / np.arange(1, mine.sum() + 1)
        fits = np.flatnonzero(good >= PRECISION)
        limits[kind] = max(0.5, float(p[mine][order][fits[-1]])) if len(fits) else 1.1
        chosen = p[mine] >= limits[kind]
        seen[kind] = int(mine.sum()), float(right[mine][chosen].mean()) if chosen.any() else 1.0, float(chosen[right[mine] == 1].mean()) if (right[mine] == 1).any() else 1.0
    return Detector(trees, limits, seen)


@cache
def _made(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    texts, spans, y = examples(rows, seed)
    return np.array([features(t, s) for t, s in zip(texts, spans, strict=True)], float), y


@cache
def model(rows: int = 4000, seed: int = 3) -> Detector:
    """A detector fitted from the seeded examples alone, so every task has the same."""
    x, y = _made(rows, seed)
    return trained(x, y, np.arange(len(y)) % 4)


def fit_pii(df: DataFrame, text: str = "text", documents: int = FIT_DOCUMENTS, spots: int = FIT_SPANS, rows: int = 4000, seed: int = 3) -> Detector:
    """A detector fitted from the table's own texts and the seeded examples together.

    From a bounded sample (``documents`` different texts that may hold base spans, those of least hash, and ``spots`` places in them) the trees learn how
    personal data and look-alikes stand in these texts (see ``learned``). Thresholds come from documents, and examples, that
    the trees have not seen. Texts stay in the tasks; the driver gets ``spots`` rows of numbers, or a few more where a spot has several candidates.
    A table without such texts gives the detector of the examples.
    """
    spark = df.sparkSession
    ship(spark)
    texts = df.select(col(text).alias("t"))
    sample = written(texts.where(F.col("t").rlike(_LIKELY)).select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(documents), "pii-sample")
    found = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(sample), "h").groupBy("h").agg(F.min("t").alias("t"))

    def taught(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "t"):
            for h, t in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if got := learned(t, spots):
                    ranks, starts, kinds, x, y = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(got)), pa.array(ranks, pa.int64()), pa.array(starts, pa.int64()), pa.array(kinds), pa.array([np.array(v, float).tobytes() for v in x], pa.binary()), pa.array(y)], ["h", "rank", "start", "kind", "x", "y"])

    got = found.mapInArrow(taught, "h long, rank long, start long, kind string, x binary, y double").orderBy("rank", "h", "start", "kind", "y", "x").limit(spots).collect()
    x, y = _made(rows, seed)
    part = np.arange(len(y)) % 4
    if got:
        x, y = np.vstack([x, *(np.frombuffer(r["x"]) for r in got)]), np.append(y, [r["y"] for r in got])
        part = np.append(part, [r["h"] % 4 for r in got])
    return trained(x, y, part)


def added_spans(texts: list[str], base: list[list[Span]], detector: Detector | None = None) -> list[list[Span]]:
    """The candidates that the trees choose: likely enough for their kind, the likeliest of those that overlap."""
    rows = [(i, s) for i, (t, b) in enumerate(zip(texts, base, strict=True)) for s in candidates(t, b)]
    out: list[list[Span]] = [[] for _ in texts]
    if rows:
        detector = detector or model()
        p = np.concatenate([detector.trees.probability(np.array([features(texts[i], s) for i, s in rows[at : at + FEATURE_ROWS]], float)) for at in range(0, len(rows), FEATURE_ROWS)])
        taken: dict[int, Intervals] = {}
        for q, (i, s) in sorted(zip(p.tolist(), rows, strict=True), key=lambda r: (-r[0], r[1])):
            if q < detector.limits[s[0]]:
                continue
            if i not in taken:
                taken[i] = Intervals((a, b) for _, a, b in base[i])
            if not taken[i].meet(s[1], s[2]):
                taken[i].add(s[1], s[2])
                out[i].append(s)
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _spans_of(texts: list[str], detector: Detector | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    return base, [b + a for b, a in zip(base, added_spans(texts, base, detector), strict=True)]


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """Personal data of every whole text: key, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans.

    base_sha256 is of the base spans' list, spans the list of base and added ones; places are code points, the end exclusive. Each
    text is searched where it lies: no shuffle, batches of 4 MB or one longer text, time linear in the text. Null and empty texts have no spans.
    Without a ``detector`` one is fitted from these texts first (``fit_pii``). Keys may be null and may repeat. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(detector or fit_pii(df, text))
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            base, every = _spans_of(batch.column("text").fill_null("").to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()), pa.array(map(listed, every), pa.string())], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    out = df.select(col(key).alias("key"), col(text).alias("text")).mapInArrow(found, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def redacted(text: Column, detector: Detector | None = None) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest names it. Null stays null. Without a ``detector`` it is the one of the made-up examples."""

    def hidden(series: pd.Series) -> pd.Series:
        texts = ["" if t is None else t for t in series]
        out = []
        for t, given, spans in zip(texts, series, _spans_of(texts, detector)[1], strict=True):
            parts, at = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append(None if given is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(hidden, "string")(text)
