"""Personal data by weak supervision.

Fixed patterns find the base spans.  Wider candidates, the base spans among
them, are voted on by labelers (formats, gazetteers, context).  The votes of
all candidates of all documents are counted by pattern; expectation-
maximisation over the counts estimates how reliable each labeler is and how
likely each pattern is private; and a logistic model of the candidates' own
features, trained on that, decides on the spans that are added.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

# an address is found from its "@", since a search for its first part would scan a long run of letters again and again
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){6,}+(?![0-9A-Za-z])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(map(int, reversed(digits))):
        total += digit if n % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            found.append(Span(0, start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by start and kind; code points, end exclusive."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(Span(1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(Span(2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(Span(3, *m.span()))
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


def wider_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the two added kinds that overlap no base span."""
    taken = sorted((s.start, s.end) for s in base)
    found = [Span(4, *m.span()) for m in _SECRET.finditer(text)
             if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    found += [Span(5, *m.span()) for m in _NUMBER.finditer(text)]
    out, i = [], 0
    for span in sorted(found, key=lambda s: (s.start, s.kind)):
        while i < len(taken) and taken[i][1] <= span.start:
            i += 1
        if i == len(taken) or taken[i][0] >= span.end:
            out.append(span)
    return out


# ---- labelers: 1 private, 0 not, -1 abstains -------------------------------------------------------------------------

TRIGGERS = {
    0: frozenset("mail email e-mail contact write correo courriel".split()),
    1: frozenset("ip host address server client login from".split()),
    2: frozenset("card visa mastercard credit karte tarjeta carte paid".split()),
    3: frozenset("tel phone call mobile fax telefon telefono whatsapp".split()),
    4: frozenset("token secret password passwd key apikey api_key bearer auth pwd".split()),
    5: frozenset("ssn passport iban account konto cuenta compte id tax".split()),
}
TOP_DOMAINS = frozenset("com org net edu gov io de fr es eu uk info".split())
SECRET_HEADS = ("sk", "pk", "ghp", "gho", "xox", "AKIA", "eyJ", "AIza")
_BEFORE = re.compile(r"[^\W\d]+(?:[-_][^\W\d]+)*")


def _format(kind: int, s: str) -> int:
    if kind == 0:
        return int(s.rpartition(".")[2].isalpha())
    if kind == 1:
        return int(all(p == "0" or not p.startswith("0") for p in s.split(".")))
    if kind == 2:
        return int(len(_digits(s)) in (15, 16))
    if kind == 3:
        return int(any(c in s for c in " ()-."))
    if kind == 4:
        return int(bool(re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", s)) or bool(re.search("[a-z]", s) and re.search("[A-Z]", s)))
    return int(bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", s)))


def _gazetteer(kind: int, s: str) -> int:
    if kind == 0:
        return int(s.rpartition(".")[2].lower() in TOP_DOMAINS)
    if kind == 1:
        return 0 if s.startswith(("0.", "127.", "255.")) else -1
    if kind == 2:
        return int(s[0] in "3456")
    if kind == 3:
        return int(s[1] != "0")
    if kind == 4:
        return 1 if s.startswith(SECRET_HEADS) else -1
    return -1


def votes(text: str, span: Span) -> tuple[int, ...]:
    s = text[span.start:span.end]
    before, after = text[max(0, span.start - 40):span.start], text[span.end:span.end + 20]
    trigger = any(w.lower() in TRIGGERS[span.kind] for w in _BEFORE.findall(before)[-3:])
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":") if before else False
    prose = not re.search("[0-9]", before[-12:]) and not re.search("[0-9]", after[:12])
    return (_format(span.kind, s), _gazetteer(span.kind, s), 1 if trigger else -1, 1 if assigned else -1,
            1 if prose else 0, int(len(set(s)) >= 6))


LABELERS = 6


def features(text: str, span: Span) -> tuple[int, ...]:
    """What the classifier sees; small whole numbers, each below ``SIZES``."""
    s = text[span.start:span.end]
    digits = sum("0" <= c <= "9" for c in s)
    before, after = text[span.start - 1:span.start], text[span.end:span.end + 1]
    sign = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "\"'" else 3
    return (span.kind, min(len(s) // 8, 7), min(4 * digits // len(s), 4), min(len(set(s)) // 3, 6), sign(before), sign(after),
            int("=" in text[max(0, span.start - 4):span.start]), int(bool(re.fullmatch("[0-9a-fA-F]+", s))))


SIZES = (len(KINDS), 8, 5, 7, 4, 4, 2, 2)


def pack(values: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    code = 0
    for value, size in zip(values, sizes):
        code = code * size + value
    return code


def unpack(code: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    out = np.zeros((len(code), len(sizes)), np.int64)
    for n in range(len(sizes) - 1, -1, -1):
        out[:, n] = code % sizes[n]
        code = code // sizes[n]
    return out


# ---- reliabilities and classifier, on counts of patterns ------------------------------------------------------------

class Reliability(NamedTuple):
    prior: float
    accuracy: np.ndarray  # of each labeler, when it votes


def expectation_maximisation(seen: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[Reliability, np.ndarray]:
    """Two classes and independent labelers, each right with its own probability whenever it votes.

    ``seen`` holds votes -1 (abstains), 0, 1, one row for each pattern.  A
    labeler counts as no worse than chance, which settles which class is the
    private one.  Starts from the majority of votes.
    """
    yes, no = seen == 1, seen == 0
    p = (yes.sum(1) + 1.0) / (yes.sum(1) + no.sum(1) + 2.0)
    for _ in range(rounds):
        right = count @ (yes * p[:, None] + no * (1 - p)[:, None])
        accuracy = np.clip((right + 7.0) / (count @ (yes | no) + 10.0), 0.5, 0.995)
        prior = float(np.clip((count @ p + 1.0) / (count.sum() + 2.0), 0.02, 0.98))
        weight = np.log(accuracy) - np.log1p(-accuracy)
        odds = np.log(prior) - np.log1p(-prior) + (yes.astype(float) - no) @ weight
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-9:
            break
    return Reliability(prior, accuracy), p


def train_classifier(coded: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> list[np.ndarray]:
    """Weights of each value of each feature (the first one's take the constant), by Newton steps on soft labels."""
    x = np.concatenate([np.eye(size)[coded[:, n]] for n, size in enumerate(SIZES)], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - q)) - ridge * w
        curve = (x * (count * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.split(w, np.cumsum(SIZES)[:-1])


# ---- Spark -----------------------------------------------------------------------------------------------------------

FOUND = ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
         "base array<struct<start:int,kind:int,end:int>>, wider array<struct<start:int,kind:int,end:int,votes:int,features:int>>, "
         "patterns array<struct<votes:int,features:int>>")


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Base spans, wider candidates and their votes and features, for each row; each row is seen alone."""
    kind = dict(docs.dtypes)[doc_id]
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "wider", "patterns")
    place = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    codes = [("votes", pa.int32()), ("features", pa.int32())]
    types = [pa.int64()] * 4 + [pa.string(), *(pa.list_(pa.struct(t)) for t in (place, place + codes, codes))]

    def row(value: str) -> tuple:
        base = base_spans(value)
        wide = wider_spans(value, base)
        code = {s: {"votes": pack(tuple(v + 1 for v in votes(value, s)), (3,) * LABELERS), "features": pack(features(value, s), SIZES)}
                for s in base + wide}
        where = lambda s: {"start": s.start, "kind": s.kind, "end": s.end}
        return (*(sum(s.kind == k for s in base) for k in range(4)), hashlib.sha256(_said(base).encode()).hexdigest(),
                [where(s) for s in base], [where(s) | code[s] for s in wide], list(code.values()))

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(row(v.as_py() or "") for v in batch.column("text")))
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return arrow_map(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), f"doc_id {kind}, {FOUND}", table)


def _score(weights: list[np.ndarray], code: Column) -> Column:
    """The classifier's log odds of a packed feature code."""
    total, rest = F.lit(0.0), code
    for n in range(len(SIZES) - 1, -1, -1):
        values = F.array(*[F.lit(float(round(w, 9))) for w in weights[n]])
        total = total + F.element_at(values, (rest % SIZES[n] + 1).cast("int"))
        rest = F.floor(rest / SIZES[n])
    return total


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, and ``spans``: base spans and those added.

    Votes are counted over all documents; there are at most 3^6 vote patterns
    and 26,880 feature patterns, so what comes to the driver is bounded,
    whatever the corpus.  Null and empty texts have no spans; a null id is
    passed through; repeated rows come out alike.  Without any candidate there
    is nothing to train and nothing is added.
    """
    found = written(find(docs, doc_id, text))
    counts = found.select(F.explode("patterns").alias("p")).groupBy("p.votes", "p.features").count().orderBy("votes", "features").collect()
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if counts:
        seen, coded, count = (np.array(c) for c in zip(*counts))
        _, p = expectation_maximisation(unpack(seen, (3,) * LABELERS) - 1, count)
        weights = train_classifier(unpack(coded, SIZES), p, count)
        added = F.transform(F.filter("wider", lambda c: _score(weights, c["features"]) >= 0),
                            lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(F.sort_array(F.concat("base", added)), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(said, ",").alias("spans"))
