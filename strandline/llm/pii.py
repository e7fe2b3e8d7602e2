"""Personal data and secrets: candidate spans, boosted trees, calibrated redaction.

Generators of high recall propose spans, which may overlap; boosted trees score
each by its format and its context; a threshold for each kind, calibrated on
held-out examples, decides.  Of overlapping selected spans the best scored stays.

The trees are fitted on the driver on ``EXAMPLES`` examples written here: values
of every kind in several formats and contexts, and things that look like them
(dates, versions, prices, measurements, identifiers, handles).  No table has
labels for this, so nothing of a corpus is used for fitting.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.boosting import Boosted, fit
from strandline.llm.common import in_parts, tidy

EXAMPLES, SEED = 12_000, 11
KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET", "IBAN")
#: A text without any of these characters has no candidate.
_GATE = re.compile(r"[@=:]|\d")
_LOCAL = re.compile(r"[\s@<>()\[\],;:\"|]")
_DOMAIN = re.compile(r"[^\s@<>()\[\],;:\"|!?*#$%&]+\.[^\W\d_]{2,}")
_GENERATORS = (
    ("PHONE", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?![\w])")),
    ("PHONE", re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .\-]\d{1,4}){2,7}(?![\w])")),
    ("IP", re.compile(r"(?<![\w:.])(?:(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})(?![\w:])")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)")),
    ("IP", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("CARD", re.compile(r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w])")),
    ("SSN", re.compile(r"(?<![\w\-])\d{3}[\- ]\d{2}[\- ]\d{4}(?![\w\-])")),
    ("SECRET", re.compile(r"(?i:token|key|secret|passw(?:or)?d|pwd|bearer|credential)s?[\"']?\s*[=:]+\s*[\"']?([^\s\"'|,;]{6,})|(?<![\w/+\-])(?=[\w/+\-]*\d)[\w/+\-]{20,}={0,2}(?![\w])")),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
)
#: What keys of common services begin with.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[_\-]|xox[abp]-")
_CUES = tuple(
    re.compile(x, re.I)
    for x in (
        r"mail|contact|write|reach", r"phone|tel|call|mobile|cell|fax|dial", r"\bip\b|address|host|server|client|login from", r"card|visa|credit|debit|payment|master", r"ssn|social|tax id",
        r"token|key|secret|passw|pwd|bearer|auth|credential", r"iban|account|bank|swift", r"version|release|\bv\.?$|build|section|chapter|fig|table|page|isbn|issn|doi",
        r"date|born|on$|year|since|between|from$", r"[$€£#]\s*$|price|cost|usd|eur|total|order|item|invoice|sku|part", r"commit|sha|md5|hash|checksum|uuid|revision|digest",
    )
)


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str


@dataclass(frozen=True)
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses, found from their @ in both directions, so that no run of characters is read twice."""
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and not _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        least = m.end() if m else at + 1
        if m:
            yield start, least
        at = text.find("@", least)


def candidates(text: str) -> list[Span]:
    """Every generator's spans; the same place may be proposed as several kinds."""
    if not text or not _GATE.search(text):
        return []
    out = []
    found = {"EMAIL": list(_addresses(text))}
    for kind, pattern in _GENERATORS:
        found.setdefault(kind, []).extend(m.span(1) if m.lastindex else m.span() for m in pattern.finditer(text))
    for kind, spans in found.items():
        for start, end in dict.fromkeys(spans):
            while end - start > 1 and text[end - 1] in ".,;:!?*#$%&'\"":
                end -= 1
            while kind == "EMAIL" and end - start > 1 and text[start] in "'\"*#$%&!.=":
                start += 1
            out.append(Span(start, end, kind))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def features(text: str, s: Span) -> list[float]:
    v = text[s.start : s.end]
    before, after = text[max(0, s.start - 32) : s.start], text[s.end : s.end + 12]
    digits = "".join(c for c in v if c in string.digits)
    groups = re.findall(r"[0-9]+", v)
    letters = sum(c.isalpha() for c in v)
    n = len(v)
    counts = np.unique(list(v), return_counts=True)[1] / n
    octets = [int(g) for g in groups[:8] if len(g) <= 3]
    kind = [float(s.kind == k) for k in KINDS]
    form = [
        n, len(digits), len(digits) / n, letters / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(digits) >= 12 and luhn(digits)), float(len(octets) == 4 and v.count(".") == 3 and max(octets) <= 255), v.count("-"), v.count("."), v.count(" "), v.count("("), v.count(":"), v.count("/"),
        float(v[0] == "+"), float("@" in v), float(-(counts * np.log2(counts)).sum()), sum(c in string.hexdigits for c in v) / n, float(any(c.isupper() for c in v) and any(c.islower() for c in v)),
        float(bool(groups) and groups[0][:2] in ("19", "20") and len(groups[0]) == 4), float(bool(groups) and groups[-1][:2] in ("19", "20") and len(groups[-1]) == 4), float(bool(groups) and len(groups[0]) <= 2), float(v[:3].isalpha()), float(bool(_PREFIX.match(v))),
    ]
    edge = [float(before[-1:].isdigit() or after[:1].isdigit()), float(before[-1:] in ("=", '"', "'", ":")), float(before[-1:] in ("$", "€", "£", "#")), float(bool(re.match(r"\s*(?:%|kg|km|cm|mm|USD|EUR|am|pm|years?|pages?)\b", after))), float("://" in before[-24:] + v), float(bool(re.match(r"[.\-]\d", after))), float(bool(re.search(r"\d[.\- ]$", before)))]
    return kind + form + edge + [float(bool(c.search(before[-24:]))) for c in _CUES]


def _examples(count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the spans that are personal in them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    dig = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    low = lambda a, b: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(a, b))))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    base = lambda k: "".join(pick(string.ascii_letters + string.digits) for _ in range(k))
    octet = lambda: str(int(rng.integers(1, 255)))

    def card() -> str:
        d = pick(["4", "5", "37", "6", ""]) + dig(15)
        d = d[:16]
        if rng.random() < 0.5:
            d = d[:15] + next(c for c in string.digits if luhn(d[:15] + c))
        sep = pick(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = dig(3), dig(3), dig(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+{int(rng.integers(20, 99))} {dig(2)} {dig(4)} {dig(4)}", f"{a}.{b}.{c}", f"+{int(rng.integers(20, 99))}{dig(9)}", f"0{dig(3)} {dig(6)}",
                     f"+{int(rng.integers(20, 99))} {dig(1)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}"])

    def six() -> str:
        parts = [hexa(int(rng.integers(1, 5))) for _ in range(8)]
        if rng.random() < 0.5:
            return ":".join(parts)
        cut = int(rng.integers(1, 4))
        return ":".join(parts[:cut]) + "::" + ":".join(parts[8 - int(rng.integers(1, 5)) :])

    good = {
        "EMAIL": lambda: f"{low(1, 12)}{pick(['', '.', '_', '-', '+'])}{pick(['', dig(2), low(1, 8)])}".rstrip(".") + f"@{low(2, 9)}{pick(['', dig(1), '-' + low(1, 4)])}.{pick(['com', 'org', 'net', 'example.com', 'co.uk', 'de', 'io', 'fr'])}",
        "PHONE": phone,
        "IP": lambda: ".".join(octet() for _ in range(4)) if rng.random() < 0.8 else six(),
        "CARD": card,
        "SSN": lambda: f"{dig(3)}-{dig(2)}-{dig(4)}",
        "SECRET": lambda: pick([hexa(40), hexa(32), hexa(64), base(20), base(32), base(40), "sk_" + base(24), "ghp_" + base(36), "AKIA" + base(16).upper(), "AKIA" + base(16).upper(), low(4, 8) + dig(3) + pick("!$#") + low(1, 4)]),
        "IBAN": lambda: pick(["DE", "FR", "GB", "ES"]) + dig(2) + pick(["", " "]).join(["", dig(4), dig(4), dig(4), dig(4), dig(2)]),
    }
    cue = {
        "EMAIL": ["email ", "contact: ", "write to ", "mail "], "PHONE": ["call ", "phone: ", "tel. ", "mobile "], "IP": ["from IP ", "host ", "client address "], "CARD": ["card ", "visa ", "paid with card number "],
        "SSN": ["SSN ", "social security number "], "SECRET": ['token = "', "api_key: ", "password=", 'secret = "', "Bearer: "], "IBAN": ["IBAN ", "account "],
    }
    bad = [
        lambda: f"{pick(['19', '20'])}{dig(2)}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}", lambda: f"{int(rng.integers(1, 29))}.{int(rng.integers(1, 13))}.{pick(['19', '20'])}{dig(2)}", lambda: f"{int(rng.integers(1, 13)):02d}/{int(rng.integers(1, 29)):02d}/20{dig(2)}",
        lambda: f"{int(rng.integers(0, 24)):02d}:{dig(2)}:{dig(2)}", lambda: f"version {dig(1)}.{dig(1)}.{dig(1)}", lambda: f"version {dig(1)}.{dig(1)}.{dig(1)}.{dig(2)}", lambda: f"v{dig(1)}.{dig(2)}.{dig(1)}", lambda: f"${dig(3)}.{dig(2)}", lambda: f"{dig(1)},{dig(3)},{dig(3)}",
        lambda: f"{pick(['19', '20'])}{dig(2)}-{pick(['19', '20'])}{dig(2)}", lambda: f"ISBN 978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}", lambda: f"pages {dig(3)}-{dig(3)}", lambda: f"order {dig(8)}", lambda: f"invoice #{dig(4)}-{dig(4)}", lambda: f"0.{dig(8)}", lambda: f"{dig(4)} {dig(3)} {dig(3)} people",
        lambda: f"{dig(3)} {dig(3)} {dig(3)} km", lambda: f"@{low(3, 9)}{dig(2)}", lambda: f"{low(3, 8)} @ {low(3, 8)}", lambda: f"a@b", lambda: f"commit {hexa(40)}", lambda: f"sha256 {hexa(64)}", lambda: f"md5: {hexa(32)}", lambda: f"uuid {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
        lambda: f"key: {low(6, 12)}", lambda: f"keys: {low(6, 10)} and {low(4, 8)}", lambda: f"the key = {low(6, 11)} idea", lambda: f"{low(6, 9)}-{low(6, 9)}-{low(6, 9)}-{dig(1)}", lambda: f"https://{low(3, 9)}.com/{low(3, 8)}-{low(3, 9)}-{low(4, 9)}-{dig(4)}", lambda: f"section {dig(1)}.{dig(1)}.{dig(1)}.{dig(1)}",
        lambda: f"{low(3, 6)}_{low(3, 6)}_{low(3, 8)}_{low(3, 6)}_{dig(1)}", lambda: f"{dig(2)} - {dig(2)}", lambda: f"score {dig(2)}-{dig(2)}", lambda: f"part {dig(5)}-{dig(3)}", lambda: f"{dig(4)}", lambda: f"{dig(6)}", lambda: f"{dig(2)}:{dig(2)}", lambda: f"{low(2, 7)}::{low(2, 7)}", lambda: f"{pick('abcdef')}::{pick(['dead', 'add', 'fade', low(2, 5)])}", lambda: f"ratio {dig(1)}.{dig(4)}",
    ]
    for _ in range(count):
        words = [low(1, 9) for _ in range(int(rng.integers(2, 14)))]
        at = int(rng.integers(len(words) + 1))
        left, right = " ".join(words[:at]), " ".join(words[at:])
        left += pick([" ", " ", " ", ". ", ": ", "\n", " ("]) if left else ""
        tail = pick([" ", " ", " ", ". ", ", ", "\n", ")", "*** ", "!! ", " | "])
        if rng.random() < 0.55:
            kind = pick(KINDS)
            value = good[kind]()
            lead = pick(cue[kind]) if rng.random() < (0.85 if kind == "SECRET" else 0.4) else ""
            close = '"' if lead.endswith('"') else ""
            text = left + lead + value + close + tail + right
            start = len(left + lead)
            spans = [(start, start + len(value), kind)]
            if rng.random() < 0.3:
                # another value right after: a span over both is wrong
                more = pick(KINDS[:5])
                second = good[more]()
                text = left + lead + value + close + " " + second + tail + right
                spans.append((start + len(value + close) + 1, start + len(value + close) + 1 + len(second), more))
            if rng.random() < 0.1:
                text = text.upper()
            yield text, spans
        else:
            yield left + pick(bad)() + tail + right, []


def _rows(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, kinds = [], [], []
    for text, spans in _examples(count, seed):
        for c in candidates(text):
            x.append(features(text, c))
            y.append(float(any(c.kind == k and abs(c.start - a) <= 1 and abs(c.end - b) <= 1 for a, b, k in spans)))
            kinds.append(c.kind)
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=2)
def fit_model(examples: int = EXAMPLES, seed: int = SEED) -> PiiModel:
    """Trees from ``examples`` texts; each kind's threshold has the best F2 on others.

    F2, because what is missed stays in the data for good.
    """
    x, y, _ = _rows(examples, seed)
    trees = fit(x, y)
    hx, hy, hk = _rows(max(1000, examples // 3), seed + 1)
    p = trees.predict(hx)
    out = {}
    for kind in KINDS:
        q, z = p[hk == kind], hy[hk == kind]
        grid = np.arange(5, 96) / 100
        hit = [(q >= t) for t in grid]
        f2 = np.array([5 * (h & (z > 0)).sum() / max(1, 4 * (z > 0).sum() + h.sum()) for h in hit])
        best = np.flatnonzero(f2 >= f2.max() - 1e-9)
        out[kind] = float(grid[best[len(best) // 2]])
    del x, y, hx, hy
    tidy()
    return PiiModel(trees, out)


def find(texts: list[str | None], model: PiiModel) -> list[list[tuple[int, int, str, float]]]:
    """Selected spans of each text, in order and apart from each other."""
    spans, owner, x = [], [], []
    for i, t in enumerate(texts):
        for c in candidates(t or ""):
            spans.append(c)
            owner.append(i)
            x.append(features(t, c))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    by_text: dict[int, list[tuple[float, Span]]] = {}
    for i, c, p in zip(owner, spans, model.trees.predict(np.array(x)) if x else ()):
        if p >= model.thresholds[c.kind]:
            by_text.setdefault(i, []).append((float(p), c))
    for i, chosen in by_text.items():
        chosen.sort(key=lambda e: (-round(e[0], 2), e[1].start - e[1].end, e[1].start, e[1].kind))
        taken: list[tuple[int, int, str, float]] = []
        starts: list[int] = []
        from bisect import bisect_left, insort

        for p, c in chosen:
            k = bisect_left(starts, c.start)
            if (k == 0 or taken[k - 1][1] <= c.start) and (k == len(taken) or c.end <= taken[k][0]):
                insort(starts, c.start)
                taken.insert(k, (c.start, c.end, c.kind, round(p, 6)))
        out[i] = taken
    return out


def redacted(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PiiModel | None = None, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by ``[KIND]``.

    With ``spans_col`` a column of the spans (start, end, kind, score; in
    characters of the original) is added, in place of any so named.  A null or
    empty text stays as it is, with no spans.  Texts of any length are read
    whole; repeated rows are treated alike; other columns stay; an empty table
    gives an empty result.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    model = model or fit_model()
    base = docs.drop(spans_col) if spans_col else docs
    names = base.columns
    at = names.index(text_col)
    kind = _parse_datatype_string("array<struct<start:int,end:int,kind:string,score:double>>")
    schema = StructType([*base.schema.fields, *([StructField(spans_col, kind)] if spans_col else [])])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, lambda b: b.column(at)):
            texts = b.column(at).to_pylist()
            found = find(texts, model)
            columns = list(b.columns)
            if any(found):
                columns[at] = pa.array([redacted(t, s) for t, s in zip(texts, found)], pa.string())
            if spans_col:
                columns.append(pa.array([[dict(zip(("start", "end", "kind", "score"), s)) for s in f] for f in found], arrow))
            yield pa.RecordBatch.from_arrays(columns, [*names, *([spans_col] if spans_col else [])])
        tidy()

    return base.mapInArrow(run, schema)


def scan(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans, n_spans): each document redacted, with what was found."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return redact(own, model, spans_col="spans").withColumn("n_spans", F.size("spans"))
