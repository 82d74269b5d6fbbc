"""Personal data (2): candidate generators, boosted trees, calibrated thresholds.

The base patterns (e-mail, IPv4, card with Luhn check, phone with ``+``) always
stay. Beyond them, high-recall generators propose overlapping spans: spelled-out
e-mail addresses, numbers with unusual separators, phones without ``+``, IPv6.
Boosted trees score each candidate from its format and its context; per kind a
threshold is calibrated for precision, and the best-scored candidates that
overlap neither a base span nor a better candidate are added.

Training has no labelled personal data to go by. The spans of the base patterns
in a bounded sample (``SAMPLE_DOCS`` documents, at most ``SAMPLE_SPANS`` spans of
each) are positive, candidates that break their kind's rule are negative, and
both are rewritten into the forms the generators look for (other separators,
pairs of digits, spelled-out signs; a changed digit, or groups left out at one
end, for negatives), in the contexts they stand in.

Null text is an empty text without spans. One row is returned per input row,
repeated rows and null ids included; an empty table gives an empty result and
trains nothing. Other columns pass through ``redact``. Every scan is linear in
the text's length. ``n_email`` to ``n_phone`` count the base spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.boosting import BoostedTrees
from shelfspark.llm.common import arrow_schema, id_and_text, map_texts, read_table, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Documents, and candidates of each, that training sees.
SAMPLE_DOCS = 4000
SAMPLE_SPANS = 50
#: Share of right additions that a kind's threshold must reach on held-out candidates.
PRECISION = 0.99
NEAR = 24
COLUMNS = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is entered at its start only: what fails there fails from every later digit of the run.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

CLUSTER = re.compile(r"\+?[0-9][0-9 ()./_-]{6,}[0-9]")
GROUP = re.compile(r"\+?\(?[0-9]++")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?)[A-Za-z0-9-]{1,63}){1,8}")
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])")
BARE_SIGN = re.compile(r" (?:dot|DOT) ")
SPELLED_SIGN = re.compile(r"[\[({<] ?(?:at|AT) ?[\])}>]")
SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
HINTS = {EMAIL: ("mail", "contact", "write"), IP: ("ip", "host", "addr", "server"),
         CARD: ("card", "visa", "pay", "credit"), PHONE: ("tel", "phone", "call", "fax", "mobil")}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted."""
    out = [(s, EMAIL, e) for s, e in emails(text)] if "@" in text else []
    out += [(m.start(), IP, m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in DIAL.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping ``(start, kind, end)`` of the high-recall generators."""
    out = set()
    for m in CLUSTER.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]  # runs of digits, cut at every separator
        digits = [sum(c.isdigit() for c in text[s:e]) for s, e in groups]
        for i, (start, _) in enumerate(groups):  # neighbouring groups form a number; each holds a digit, so at most 19 do
            n = 0
            for j in range(i, len(groups)):
                end, n = groups[j][1], n + digits[j]
                if n > 19:
                    break
                if n >= 13:
                    out.add((start, CARD, end))
                if 7 <= n <= 15:
                    out.add((start, PHONE, end))
                if 4 <= n <= 12 and text.count(".", start, end) == 3:
                    out.add((start, IP, end))
    if SPELLED_SIGN.search(text):
        out.update((m.start(), EMAIL, m.end()) for m in SPELLED.finditer(text))
    if BARE_SIGN.search(text):
        out.update((m.start(), EMAIL, m.end()) for m in BARE.finditer(text))
    if text.count(":") > 1:
        out.update((m.start(), IP, m.end()) for m in SIX.finditer(text) if m.end() - m.start() > 6)
    return sorted(out)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span = text[start:end]
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
    digits = NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    parts = span.replace(" ", "").split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    low = before.lower()
    return [
        kind == EMAIL, kind == IP, kind == CARD, kind == PHONE, end - start, len(digits), luhn(digits) if 13 <= len(digits) <= 19 else -1,
        span[:1] == "+", digits[:2] == "00", int(digits[:1] or -1), len(groups), max(groups), min(groups), len(set(groups)) == 1,
        sum(c == " " for c in span), sum(c == "." for c in span), sum(c in "-/_" for c in span), sum(c in "()" for c in span),
        sum(c.isalpha() for c in span), octets, span.count(":"), before[-1:].isalnum(), after[:1].isalnum(), before[-1:].isdigit() or after[:1].isdigit(),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), any(h in low for h in HINTS[kind]),
    ]


def keeps_rule(kind: int, span: str) -> bool:
    """Whether a proposed span, whatever its separators, keeps what its kind requires."""
    digits = NOT_DIGIT.sub("", span)
    if kind == CARD:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == PHONE:
        return 10 <= len(digits) <= 15 and (span.lstrip("(").startswith(("+", "00")))
    if kind == IP and ":" in span:
        return 3 <= len(re.findall("[0-9A-Fa-f]+", span)) <= 8 and ("::" in span or span.count(":") == 7)
    if kind == IP:
        parts = span.replace(" ", "").split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return True


def rewritten(kind: int, span: str, salt: int) -> list[str]:
    """Other spellings of a base span that are still personal data."""
    digits = NOT_DIGIT.sub("", span)
    if kind == EMAIL:
        name, domain = span.split("@")
        return [f"{name} [at] {domain}", f"{name}(at){domain.replace('.', ' (dot) ')}", f"{name} AT {domain.replace('.', ' DOT ')}"]
    if kind == IP:
        return [span.replace(".", " . ") if salt % 2 else span.replace(".", ". ")]
    sep = "./_"[salt % 3]
    pairs = [digits[i:i + 2] for i in range(0, len(digits), 2)]
    if kind == CARD:
        return [sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)), sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)).replace(sep, " " + sep, 1),
                *((other + " ").join(pairs) for other in "./_")]
    return ["00" + digits, "00 " + " ".join(digits[i:i + 3] for i in range(0, len(digits), 3)), "+" + sep.join(digits[i:i + 3] for i in range(0, len(digits), 3)),
            " ".join(["00", digits[:2], digits[2:3], *(digits[i:i + 2] for i in range(3, len(digits), 2))])]


def broken(kind: int, span: str) -> str:
    """The span with a digit changed, so that its kind's rule no longer holds."""
    if kind == CARD:
        i = max(i for i, c in enumerate(span) if c.isdigit())
        return span[:i] + str((int(span[i]) + 1) % 10) + span[i + 1:]
    if kind == IP:
        return re.sub("[0-9]+", "981", span, count=1)
    if kind == PHONE:
        return re.sub(r"^\+?(00)? ?", "", span)[:9]
    return span.replace("at", "to").replace(" AT ", " ON ").replace("(dot)", "").replace(" DOT ", " ").replace(".", " ")


def training_rows(text: str) -> list[tuple[int, bool, list[float]]]:
    """``(kind, label, features)`` of the text's base spans, its other candidates, and their rewritings."""
    out, base = [], base_spans(text)[:SAMPLE_SPANS]
    for start, kind, end in base:
        out.append((kind, True, features(text, start, kind, end)))
        for form in rewritten(kind, text[start:end], start):
            for span in (form, broken(kind, form)):
                at = max(0, start - NEAR)
                near = text[at:start] + span + text[end:end + NEAR]
                first, last = start - at, start - at + len(span)
                out.append((kind, span is form, features(near, first, kind, last)))
                if span is form and kind in (CARD, PHONE):  # parts of the number, or four groups as an address, are none
                    out += [(k, False, features(near, s, k, e)) for s, k, e in proposals(near) if first <= s and e <= last
                            and (s, k, e) != (first, kind, last) and (k == IP or s == first or e == last)]
    for start, kind, end in proposals(text)[:SAMPLE_SPANS]:
        exact = any((start, kind, end) == b for b in base)
        inside = any(start < e and s < end for s, _, e in base)
        if not exact and (inside or not keeps_rule(kind, text[start:end])):
            out.append((kind, False, features(text, start, kind, end)))
    return out


class PiiModel:
    """Boosted trees over candidates and, per kind, the lowest probability that is precise enough."""

    def __init__(self, rows: list[tuple[int, bool, list[float]]]):
        self.trees, self.threshold = None, [2.0] * len(KINDS)
        kinds = np.array([k for k, _, _ in rows], np.int64)
        y = np.array([label for _, label, _ in rows], float)
        if not len(y) or y.min() == y.max():
            return
        x = np.array([f for _, _, f in rows], float)
        held = np.array([zlib.crc32(repr(f).encode()) % 4 == 0 for _, _, f in rows])
        if held.all() or not held.any() or y[~held].min() == y[~held].max():
            return
        self.trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        p = self.trees.predict(x[held])
        for kind in range(len(KINDS)):
            of = kinds[held] == kind
            order = np.argsort(-p[of], kind="stable")
            score, right = p[of][order], y[held][of][order]
            precise = np.flatnonzero((np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION) & (score >= 0.5))
            if len(precise):
                self.threshold[kind] = float(max(score[precise[-1]], 0.5))

    def added(self, found: list[tuple[str, list, list]]) -> list[list[tuple[int, int, int]]]:
        """For each ``(text, base, proposals)`` the proposals to add: best first, none overlapping."""
        rows = [features(t, *c) for t, _, cs in found for c in cs]
        p = self.trees.predict(np.array(rows, float)) if rows and self.trees else np.zeros(len(rows))
        out, at = [], 0
        for _, base, cs in found:
            taken, kept = [(s, e) for s, _, e in base], []
            scored = sorted(((-q, s, k, e) for (s, k, e), q in zip(cs, p[at:at + len(cs)].tolist()) if q >= self.threshold[k]))
            at += len(cs)
            for _, s, k, e in scored:
                if not any(s < b and a < e for a, b in taken):
                    taken.append((s, e))
                    kept.append((s, k, e))
            out.append(sorted(kept))
        return out


def find(texts: list[str], model: PiiModel) -> list[tuple[list, list]]:
    """``(base, added)`` spans of each text."""
    found = [(t, base_spans(t), proposals(t)) for t in texts]
    return [(base, extra) for (_, base, _), extra in zip(found, model.added(found))]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> PiiModel:
    """The model from a hashed sample of about ``sample_docs`` documents, never over twice as many, that hold a digit or an @."""
    docs = id_and_text(docs).where(F.col("text").rlike("[0-9@]"))
    n = docs.count()
    by = F.xxhash64("doc_id", "text")  # rows may share their id
    sample = docs.where(F.pmod(by, F.lit(max(1, n))) < sample_docs).orderBy(by).limit(2 * sample_docs)
    schema = arrow_schema("kind int, label boolean, features array<double>")

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                found = [r for t in part.column("text").to_pylist() for r in training_rows(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found] if i < 2 else [list(map(float, r[2])) for r in found], f.type)
                                                  for i, f in enumerate(schema)], schema=schema)

    found = sample.mapInArrow(rows, "kind int, label boolean, features array<double>").collect()  # bounded by the sample
    return PiiModel(sorted((r.kind, r.label, list(r.features)) for r in found))


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """Per document the counts and hash of the base spans, and all spans with those the model adds."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def per_slice(ids, texts):
        found = find([t or "" for t in texts], shared.value)
        count = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
        return {"doc_id": ids, **{f"n_{name}": count[k] for k, name in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(written_spans(base).encode()).hexdigest() for base, _ in found],
                "spans": [written_spans(sorted(base + extra)) for base, extra in found], "n_added": [len(extra) for _, extra in found]}

    return map_texts(docs, per_slice, COLUMNS)


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``docs`` with all columns; each span in ``text`` (overlapping ones together) is replaced by its kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    schema = arrow_schema(docs.schema)
    at = schema.get_field_index("text")

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                for i, (base, extra) in enumerate(find([t or "" for t in texts], shared.value)):
                    out, done = [], 0
                    for s, k, e in sorted(base + extra):
                        if s >= done:
                            out += [texts[i][done:s], f"<{KINDS[k].upper()}>"]
                        done = max(done, e)
                    if out:
                        texts[i] = "".join(out) + texts[i][done:]
                yield part.set_column(at, schema.field(at), pa.array(texts, schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLE: dict[str, str] = {}
