"""Personal data and secrets: labelers vote, expectation-maximisation weighs them, a classifier decides about spans.

1. *Candidates.* Every text is searched for the four base kinds (email, ip, card, phone), for spans that nearly are of such
   a kind, and for key-like strings (secret). The search is linear in the text.
2. *Labelers* vote yes, no or nothing on a candidate: the base pattern's validity, gazetteers (cue words, domains, issuers,
   country codes), the words before it, its shape, and its borders.
3. *Expectation-maximisation* over the votes estimates how reliable each labeler is and how likely each candidate is real,
   without any label. It needs only how often each pattern of votes occurs, a table whose size the labelers bound.
4. *The classifier*, a logistic regression on votes, kind and shape, is trained on these estimates, again over counted
   patterns, so every candidate of the corpus takes part.
5. A span is kept if its base pattern holds, or if the classifier finds it more likely real than not.

Defined results:
* null text: as empty, no spans; an empty table, or one without candidates, gives a model that keeps base spans alone;
* repeated rows are searched each, also with the same or a null id; extra columns are kept by :func:`redact`;
* spans of one kind do not overlap; spans of different kinds may, and are masked together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import frugal, map_batches, quoted, small_batches, stored

#: Kinds of spans in the order of reports; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "gazetteer", "context", "shape", "border")
SHAPES = 8

# Cue words: what people write before such data.
CUES = {
    "email": {"email", "mail", "e-mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "visa", "mastercard", "carte", "karte", "tarjeta", "iban", "account"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth", "bearer", "credential"},
}
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}
KEY_HEADS = ("sk-", "ghp_", "gho_", "AKIA", "xox", "eyJ", "AIza")

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits is entered at its first digit only: a later one could match nothing that the first did not.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part is the run of its characters before an at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and not _LOCAL_END.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    base: bool


def candidates(text: str | None) -> list[Candidate]:
    """The spans of a text that may be personal data, by kind and place."""
    out: list[Candidate] = []
    if not text:
        return out
    if "@" in text:
        out += [Candidate(0, a, b, True) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))
        out.append(Candidate(1, m.start(), m.end(), valid))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            out.append(Candidate(2, m.start(), m.end(), luhn(digits)))
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            valid = 9 <= sum(c.isdigit() for c in m[0]) <= 15
            phones.append(Candidate(3, m.start(), m.end(), valid))
    held = [(c.start, c.end) for c in phones]
    phones += [
        Candidate(3, m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)
        if not any(a < m.end() and m.start() < b for a, b in held)
    ]
    out += sorted(phones, key=lambda c: c.start)
    done = 0
    for m in _DIGIT.finditer(text):
        if m.start() < done:
            continue
        begin = m.start()
        while begin > done and re.match(r"[A-Za-z0-9_+/=-]", text[begin - 1]):
            begin -= 1
        key = _KEY.match(text, begin)
        done = key.end() if key else m.end()
        if key and re.search("[A-Za-z]", key[0]):
            out.append(Candidate(4, begin, key.end(), False))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def votes(text: str, c: Candidate) -> tuple[list[int], int]:
    """Each labeler's vote (1 no, 2 yes, 0 nothing) on a candidate, and its shape class."""
    kind, span = KINDS[c.kind], text[c.start : c.end]
    digits = sum(x.isdigit() for x in span)
    before = text[max(0, c.start - 40) : c.start].lower()
    cue_words = set(re.findall(r"[\w-]+", before)[-3:])
    yes = lambda good, bad=False: 2 if good else 1 if bad else 0
    near, after = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    if kind == "email":
        gazetteer = yes(span.rpartition(".")[2].lower() in TOP_DOMAINS)
        shape = yes(len(span) <= 80, len(span) > 200)
    elif kind == "ip":
        gazetteer = yes(False, span.startswith(("0.", "1.0.")))
        shape = yes(7 <= len(span) <= 15, len(span) > 15)
    elif kind == "card":
        gazetteer = yes(span[0] in "3456", span[0] in "0789")
        shape = yes(False, len(set(span)) < 4)
    elif kind == "phone":
        gazetteer = yes(span[0] == "+")
        shape = yes(9 <= digits <= 15 and "(" in span, digits > 15)
    else:
        gazetteer = yes(span.startswith(KEY_HEADS) or bool(cue_words & CUES[kind]))
        shape = yes(len(span) >= 20 and _entropy(span) >= 3.2 and 0.1 <= digits / len(span) <= 0.9, _entropy(span) < 2.5 or digits < 3)
    pattern = 2 if c.base else 0 if kind == "secret" else 1
    # A span that only nearly is of its kind needs a cue; a key needs to be assigned or quoted.
    context = yes(bool(cue_words & CUES[kind]), not c.base if kind != "secret" else not re.search(r"[=:\"'`]\s*[\"'`]?$", before))
    border = yes(False, near.isalnum() or after.isalnum())
    length = 0 if len(span) < 12 else 1 if len(span) < 20 else 2 if len(span) < 48 else 3
    return [pattern, gazetteer, context, shape, border], length * 2 + (digits * 2 > len(span))


def pattern_of(kind: int, voted: list[int], shape: int) -> int:
    """Kind, votes and shape as one number; there are fewer than 5 * 3**5 * 8 of them."""
    code = kind
    for v in voted:
        code = code * 3 + v
    return code * SHAPES + shape


def _parts(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, code = patterns % SHAPES, patterns // SHAPES
    voted = np.zeros((len(patterns), len(LABELERS)), np.int64)
    for i in reversed(range(len(LABELERS))):
        voted[:, i], code = code % 3, code // 3
    return code, voted, shape


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by kind and labeler, the classifier's weights, and what they say of each pattern."""

    reliabilities: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = ()

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        if not self.weights or not len(patterns):
            return np.zeros(len(patterns))
        return 1 / (1 + np.exp(-np.clip(_features(patterns) @ np.asarray(self.weights), -30, 30)))


def _features(patterns: np.ndarray) -> np.ndarray:
    """Per kind an intercept, a yes and a no weight for each labeler, and shape classes."""
    kind, voted, shape = _parts(patterns)
    own = np.concatenate([np.ones((len(kind), 1)), voted == 2, voted == 1, np.eye(SHAPES)[shape]], axis=1)
    out = np.zeros((len(kind), len(KINDS) * own.shape[1]))
    for k in range(len(KINDS)):
        rows = kind == k
        out[rows, k * own.shape[1] : (k + 1) * own.shape[1]] = own[rows]
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, dict[str, float]]]:
    """Expectation-maximisation for each kind: how likely each pattern is real, and how often each labeler is right."""
    kind, voted, _ = _parts(patterns)
    real = np.zeros(len(patterns))
    reliabilities: dict[str, dict[str, float]] = {}
    for k, name in enumerate(KINDS):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        v, n = voted[rows], counts[rows].astype(float)
        p = 1 / (1 + np.exp(-1.5 * ((v == 2).sum(1) - (v == 1).sum(1) - 0.5)))  # the start: a majority vote
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            # Chances of the three votes on real and on other candidates, with a prior for labelers better than chance.
            table = [np.stack([(n * w) @ (v == s) + a for s, a in zip((0, 1, 2), bias, strict=True)]) for w, bias in ((p, (1, 1, 4)), (1 - p, (1, 4, 1)))]
            on_real, on_other = (t / t.sum(0) for t in table)
            at = np.arange(v.shape[1])
            score = np.log(prior) - np.log1p(-prior) + (np.log(on_real[v, at]) - np.log(on_other[v, at])).sum(1)
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        real[rows] = p
        right = on_real[2] * prior + on_other[1] * (1 - prior)
        wrong = on_real[1] * prior + on_other[2] * (1 - prior)
        reliabilities[name] = dict(zip(LABELERS, (right / (right + wrong)).round(4).tolist(), strict=True))
    return real, reliabilities


def train(patterns: np.ndarray, counts: np.ndarray, steps: int = 30, ridge: float = 1.0) -> SpanModel:
    """The classifier, fitted to the estimates by Newton steps over the counted patterns."""
    if not len(patterns):
        return SpanModel()
    real, reliabilities = estimate(patterns, counts)
    x, n = _features(patterns), counts.astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - real)) + ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return SpanModel(reliabilities, tuple(w.tolist()))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``found``, an array of (kind, start, end, base, pattern)."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    item = "struct<kind:int,start:long,end:long,base:boolean,pattern:int>"
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("_text").to_pylist():
                found.append([
                    {"kind": c.kind, "start": c.start, "end": c.end, "base": c.base, "pattern": pattern_of(c.kind, *votes(text, c))}
                    for c in candidates(text)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(kind))], names=["_id", "found"])

    return rows.mapInArrow(search, f"_id {rows.schema['_id'].dataType.simpleString()}, found array<{item}>")


def fit(found: DataFrame) -> SpanModel:
    """Train on all candidates of ``found``: what comes to the driver is a count for each pattern."""
    counted = found.select(F.explode("found.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    counted.sort(key=lambda r: r["p"])
    return train(np.asarray([r["p"] for r in counted], np.int64), np.asarray([r["n"] for r in counted], np.int64))


def choose(found: DataFrame, model: SpanModel, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``found``: its id and ``spans``, an array of (kind, start, end, base) by kind and start."""
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found_here in batch.column("found").to_pylist():
                rows.append([
                    {"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"]}
                    for c in keep_spans(found_here, model)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, pa.list_(pa.struct(fields)))], names=["_id", "spans"])

    schema = f"_id {found.schema['_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return found.mapInArrow(decide, schema).withColumnRenamed("_id", id_col)


def keep_spans(found: list[dict], model: SpanModel) -> list[dict]:
    """The candidates of one text that are kept. A span that overlaps a base span of its kind is not added."""
    if not found:
        return []
    likely = model.probability(np.asarray([c["pattern"] for c in found], np.int64)) >= 0.5
    kept = [c for c in found if c["base"]]
    for c, good in zip(found, likely.tolist(), strict=True):
        if good and not c["base"] and not any(k["kind"] == c["kind"] and k["start"] < c["end"] and c["start"] < k["end"] for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: (c["kind"], c["start"]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of all texts, with a model trained on these texts' candidates."""
    found = stored(find_candidates(docs, id_col, text_col), "pii-candidates")
    return choose(found, fit(found), id_col)


def mask(text: str | None, model: SpanModel) -> str | None:
    """The text with each kept span, or union of spans that overlap, replaced by its kind in brackets."""
    if not text:
        return text
    found = [{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base, "pattern": pattern_of(c.kind, *votes(text, c))} for c in candidates(text)]
    out, at, end = [], 0, -1
    for c in sorted(keep_spans(found, model), key=lambda c: (c["start"], c["kind"])):
        if c["start"] < end:
            end = max(end, c["end"])
            at = end
            continue
        out += [text[at : c["start"]], f"[{KINDS[c['kind']].upper()}]"]
        at = end = c["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its texts masked; all columns stay."""
    found = stored(find_candidates(docs, id_col, text_col), "pii-candidates")
    model = fit(found)
    where, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([mask(t, model) for t in batch.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else c for i, c in enumerate(batch.columns)], names=names)

    return map_batches(docs, frugal(run), docs.schema)
