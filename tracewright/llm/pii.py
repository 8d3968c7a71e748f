"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

A candidate is a span that a strict or a loose form picks out. Six labelers (form, check, gazetteer, context words, border,
company) say yes, no or nothing to each. Expectation-maximisation over the counts of all vote patterns in the corpus estimates how
reliable each labeler is for each kind; the posterior of its votes is a candidate's label. A logistic classifier over the
span's own features is trained on those labels and decides about all candidates. Spans of the strict forms are always reported.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks
from tracewright.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("form", "check", "gazetteer", "context", "border", "company")
#: How often a labeler that votes is believed to be right before the corpus is seen: check digits and ranges hardly ever err.
TRUST = (0.8, 0.99, 0.8, 0.8, 0.8, 0.6)
#: How many imagined spans hold a labeler to that belief. Of the check it is known, so the corpus doesn't move it.
HELD = (20.0, 1e15, 20.0, 20.0, 20.0, 20.0)
BUCKETS = 1 << 12

DIGITS = re.compile(r"[0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
PHONE_REST = re.compile(r"[0-9][ ().0-9-]+")
SPELLED_AT = re.compile(r"[ \t]?[\[({<][ \t]?(?:at|@)[ \t]?[\])}>][ \t]?|[ \t](?:at|@)[ \t]", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?|[ \t]dot[ \t]|\.)[A-Za-z0-9-]{1,63}){1,6}", re.I)
PLAIN_DOT = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9]")
SPELLED_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
COLONS = re.compile(r":[0-9A-Fa-f:]*:")
HEX = frozenset("0123456789abcdefABCDEF")
SPELLED_POINTS = frozenset({".", "[.]", "(.)", " . ", "[dot]", "(dot)"})
GAP = re.compile(r"[ ().\-/]{1,3}")
WORD = re.compile(r"[^\W\d_]+")

# Gazetteers of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev me us uk de fr es it nl be ch at eu pt pl cz se no fi dk ie gr ru ua tr cn jp kr in br mx ar cl ca au nz za".split())
CALLING_CODES = ("1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "2", "35", "37", "38", "42", "5", "6", "8", "9")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4678]|35|6(?:011|4|5)|62")
CUES = {
    EMAIL: frozenset("mail email e contact write reach correo courriel mailto adresse from to".split()),
    IP: frozenset("ip host server client address addr adresse source src dst peer login direccion".split()),
    CARD: frozenset("card visa mastercard amex credit debit carte karte kreditkarte tarjeta payment pay".split()),
    PHONE: frozenset("tel phone call fax mobile cell telefon telefono téléphone teléfono handy whatsapp sms ring".split()),
}
DENIALS = frozenset("version release build isbn issn order invoice ref reference id serial page chapter section figure total sum price eur usd doi rfc commit hash token key number nr no".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    """A decimal number of at most 255, with any number of leading zeros."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


@dataclass
class Found:
    """Spans of the strict forms by kind, those that fail their check, and the digit runs of a text."""

    spans: list[list[tuple[int, int]]]
    failing: list[list[tuple[int, int]]]
    runs: list[tuple[int, int]]


def strict(text: str) -> Found:
    """Leftmost non-overlapping matches of each kind's form, in time linear in the text.

    Addresses of mail are found from their sign, numbers from runs of digits, so no form is tried at every place of a long run.
    """
    spans: list[list[tuple[int, int]]] = [[], [], [], []]
    failing: list[list[tuple[int, int]]] = [[], [], [], []]
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            spans[EMAIL].append((start, last))
        at = text.find("@", max(at + 1, last))
    runs = [m.span() for m in DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            (spans if all(octet(text[a:b]) for a, b in four) else failing)[IP].append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    for chain in chains(text, runs, lambda a, b: b - a == 1 and text[a] in " -"):
        n = sum(b - a for a, b in chain)
        if 13 <= n <= 19:
            (spans if luhn("".join(text[a:b] for a, b in chain)) else failing)[CARD].append((chain[0][0], chain[-1][1]))
        elif n > 19:
            failing[CARD].append((chain[0][0], chain[-1][1]))
    plus = text.find("+")
    while plus >= 0:
        rest, end = PHONE_REST.match(text, plus + 1), plus + 1
        if rest:
            end = rest.end()
            while not "0" <= text[end - 1] <= "9":
                end -= 1
            if end - plus >= 4:
                n = sum("0" <= c <= "9" for c in text[plus:end]) if end - plus < 200 else 99
                (spans if 9 <= n <= 15 else failing)[PHONE].append((plus, end))
        plus = text.find("+", end)
    return Found(spans, failing, runs)


def chains(text: str, runs: list[tuple[int, int]], joined) -> Iterator[list[tuple[int, int]]]:
    """Maximal groups of consecutive digit runs whose gaps `joined` accepts."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not joined(chain[-1][1], run[0]):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def loose(text: str, found: Found) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of spans that a looser form allows; also strict ones that fail their check, whole or in part."""
    low = text.lower()
    if "dot" in low or any(s in low for s in ("[at]", "(at)", "{at}", "<at>", "[@]", "(@)", " @ ", "[.]", "(.)")):
        for m in SPELLED_AT.finditer(text):
            local, domain = SPELLED_LOCAL.search(text[max(0, m.start() - 64) : m.start()]), SPELLED_DOMAIN.match(text, m.end())
            if local and domain:
                yield EMAIL, m.start() - len(local[0]), domain.end()
    for m in COLONS.finditer(text):
        a, b = m.span()
        while a > 0 and m.start() - a < 4 and text[a - 1] in HEX:
            a -= 1
        while b < len(text) and b - m.end() < 4 and text[b] in HEX:
            b += 1
        if b - a <= 39:
            try:
                IPv6Address(text[a:b])
            except AddressValueError:
                continue
            yield IP, a, b
    runs = found.runs
    for i in range(len(runs) - 3):
        gaps = [text[a[1] : b[0]] if b[0] - a[1] <= 5 else "" for a, b in zip(runs[i : i + 3], runs[i + 1 : i + 4])]
        if all(g.lower() in SPELLED_POINTS for g in gaps) and set(gaps) != {"."}:
            yield IP, runs[i][0], runs[i + 3][1]
    for kind in (IP, CARD, PHONE):
        for a, b in found.failing[kind]:
            if b - a <= 60:
                yield kind, a, b
    for chain in chains(text, runs, lambda a, b: b - a <= 3 and GAP.fullmatch(text, a, b) is not None):
        # A number inside a word, such as a run of digits in a key, is none of its own.
        if text[chain[0][0] - 1 : chain[0][0]].isalnum() or text[chain[-1][1] : chain[-1][1] + 1].isalnum():
            continue
        n = sum(b - a for a, b in chain)
        if 7 <= n <= 15:
            start = chain[0][0]
            yield PHONE, start - (start > 0 and text[start - 1] == "("), chain[-1][1]
        for i, (start, _) in enumerate(chain):
            digits = ""
            for a, b in chain[i : i + 7]:
                if b - a < 3 or len(digits) + b - a > 19:
                    break
                digits += text[a:b]
                if len(digits) >= 13 and luhn(digits):
                    yield CARD, start, b
    starts = [a for a, _ in runs]
    for plus, end in found.failing[PHONE]:
        n, first = 0, bisect_left(starts, plus)
        for a, b in runs[first : first + 16]:
            n += b - a
            if n > 15 or b > end:
                break
            if n >= 9:
                yield PHONE, plus, b


def groups_of(span: str) -> list[int]:
    return [len(g) for g in DIGITS.findall(span)]


def said(text: str, kind: int, start: int, end: int, is_strict: bool, others: list[list[tuple[int, int]]]) -> tuple[list[int], list[str]]:
    """The labelers' votes (-1, 0, 1) on a span and the features that the classifier sees."""
    span = text[start:end]
    digits = "".join(DIGITS.findall(span))
    groups = groups_of(span)
    before = [w.lower() for w in WORD.findall(text[max(0, start - 32) : start])][-3:]
    left, right = text[start - 1 : start], text[end : end + 1]
    form = check = gazetteer = 0
    if kind == EMAIL:
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        form = 1 if is_strict or "dot" in span.lower() or re.search(r"[\[({<]", span) else -1 if PLAIN_DOT.search(span) else 0
        check = 1 if tail.isalpha() and len(tail) >= 2 else -1
        gazetteer = 1 if tail in TOP_DOMAINS else 0
    elif kind == IP:
        four = ":" not in span
        form = 1 if is_strict else 0 if four else 1 if span.count(":") >= 4 else -1
        check = (1 if len(groups) == 4 and all(octet(p) for p in DIGITS.findall(span)) else -1) if four else (1 if len(span) >= 8 else 0)
        first = DIGITS.findall(span)[:2] if four else []
        gazetteer = (-1 if first and (first[0].lstrip("0") in ("", "127", "255")) else 1) if four else (1 if re.match(r"[23f]", span, re.I) else -1)
    elif kind == CARD:
        regular = len(groups) == 1 or set(groups[:-1]) == {4} and groups[-1] <= 4 or groups == [4, 6, 5]
        form, check, gazetteer = (1 if regular else -1), (1 if luhn(digits) and 13 <= len(digits) <= 19 else -1), (1 if ISSUERS.match(digits) else -1)
    else:
        dated = groups in ([4, 2, 2], [2, 2, 4]) or (len(groups) == 3 and groups[0] == 4 and max(groups[1:]) <= 2)
        pointed = set(re.sub(r"[0-9]", "", span)) == {"."} and len(groups) == 2
        form = 1 if is_strict or span[0] == "+" and 9 <= len(digits) <= 15 else -1 if dated or pointed or len(groups) == 1 else 1 if groups[-2:] in ([3, 4], [4, 4]) or span[0] == "(" else 0
        check = 1 if 10 <= len(digits) <= 13 else 0 if len(digits) in (9, 14, 15) else -1
        gazetteer = (1 if digits.startswith(CALLING_CODES) else -1) if span[0] == "+" else 1 if digits[0] == "0" and len(digits) >= 9 else 0
    near = set(before)
    context = 1 if near & CUES[kind] else -1 if near & DENIALS else 0
    edge = lambda c: 1 if not c or c.isspace() or c in ".,;:!?()[]<>\"'*#%$&" else -1 if c.isalnum() or c in "_-+@/=" else 0
    border = min(edge(left), edge(right)) if edge(left) and edge(right) else min(0, edge(left), edge(right))
    company = 0
    for k, spans in enumerate(others):
        if k != kind and spans:
            i = bisect_left(spans, (start, end))
            company |= (i < len(spans) and spans[i][0] - end <= 120) or (i > 0 and start - spans[i - 1][1] <= 120)
    name = KINDS[kind]
    features = [
        name, f"{name} digits {min(len(digits), 20)}", f"{name} groups {min(len(groups), 6)}", f"{name} last {min(groups[-1], 6) if groups else 0}", f"{name} length {min(len(span) // 4, 12)}",
        f"{name} check {check}", f"{name} list {gazetteer}", f"{name} form {form}", f"{name} left {edge(left)}", f"{name} right {edge(right)}", *(f"{name} sign {c}" for c in sorted(set(re.sub(r"[0-9A-Za-z]", "", span)))[:6]),
        *(f"{name} word {w}" for w in before[-2:]), f"context {context}",
    ]
    return [form, check, gazetteer, context, border, int(company)], features


def pattern_of(votes: Iterable[int]) -> int:
    """Votes as one number in base three, first labeler first."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


def candidates(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind, start, end, strict, vote pattern, feature buckets) of all candidates; loose ones don't touch a strict span."""
    found = strict(text)
    taken = sorted(s for spans in found.spans for s in spans)
    starts, ends = [a for a, _ in taken], sorted(b for _, b in taken)
    free = lambda a, b: bisect_left(starts, b) == bisect_right(ends, a)  # noqa: E731  no span has begun before b that has not ended by a
    every = [(k, a, b, True) for k, spans in enumerate(found.spans) for a, b in spans]
    every += [(k, a, b, False) for k, a, b in sorted(set(loose(text, found))) if free(a, b)]
    out = []
    for kind, a, b, is_strict in every:
        votes, features = said(text, kind, a, b, is_strict, found.spans)
        out.append((kind, a, b, is_strict, pattern_of(votes), sorted({zlib.crc32(f.encode()) % BUCKETS for f in features})))
    return out


CANDIDATE = "struct<kind:int,start:long,end:long,strict:boolean,votes:int,features:array<int>>"
CANDIDATE_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, candidates) of every row; a null text has none. Whole texts, offsets in code points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.name for f in CANDIDATE_TYPE]
        for batch in batches:
            found = [[dict(zip(fields, c)) for c in candidates(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(CANDIDATE_TYPE))], names=["key", "candidates"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = by_tasks(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), work, f"key {kind}, candidates array<{CANDIDATE}>")
    return out.withColumnRenamed("key", id_col)


def reliabilities(counts: dict[int, int], rounds: int = 50, trust: tuple[float, ...] = TRUST, held: tuple[float, ...] = HELD) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of true spans, chance of each vote given truth, posterior per vote pattern) of one kind, by expectation-maximisation.

    Each labeler has a chance of saying no, nothing or yes for true and for false spans. They start, and are held by `held` imagined
    spans of each sort, at the belief that a labeler that votes is right with its chance in `trust`. Patterns are taken in order, so the result is the same in every run.
    """
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns], np.int64).reshape(len(patterns), len(LABELERS)) + 1
    n = np.array([counts[p] for p in patterns], float)
    speaks = 0.7
    belief = np.array([[[speaks * r, 1 - speaks, speaks * (1 - r)] for r in trust], [[speaks * (1 - r), 1 - speaks, speaks * r] for r in trust]])
    chance = belief
    share, rows = 0.5, np.arange(len(LABELERS))
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        like = np.stack([np.log(chance[y][rows, votes]).sum(axis=1) for y in (0, 1)]) + np.log([[1 - share], [share]])
        posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        part = np.stack([n * (1 - posterior), n * posterior])
        share = (part[1].sum() + 10) / (n.sum() + 20)
        chance = np.stack([[(np.bincount(votes[:, j], part[y], minlength=3) + held[j] * belief[y][j]) / (part[y].sum() + held[j]) for j in rows] for y in (0, 1)])
    return float(share), chance, dict(zip(patterns, posterior.tolist()))


def train(rows: list[tuple[list[int], float]], rounds: int = 300, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over feature buckets, the last one the bias, from rows (features, chance of truth)."""
    theta = np.zeros(BUCKETS + 1)
    if not rows:
        return theta
    at = np.concatenate([np.asarray(f, np.int64) for f, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([p for _, p in rows])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(of, theta[at], minlength=len(rows)) + theta[-1])))
        error = (p - y) / len(rows)
        grad = np.append(np.bincount(at, error[of], minlength=BUCKETS), error.sum()) + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return theta


@dataclass
class Model:
    """Per kind what is known of the labelers, and the span classifier's weights."""

    shares: dict[str, float]
    chances: dict[str, np.ndarray]
    weights: np.ndarray


def fit(found: DataFrame, per_kind: int = 4000) -> Model:
    """Model of `find_candidates` rows.

    Votes of all candidates are counted: at most 3^6 patterns a kind come to the driver. The classifier learns from at most `per_kind`
    candidates of each kind, a documented bound, chosen by a hash of features and place. Without candidates it says 0.5 to all.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    counted: dict[int, dict[int, int]] = {k: {} for k in range(len(KINDS))}
    for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        counted[r["kind"]][r["votes"]] = r["n"]
    shares, chances, rows = {}, {}, []
    for kind, counts in counted.items():
        if not counts:
            continue
        shares[KINDS[kind]], chances[KINDS[kind]], posterior = reliabilities(counts)
        taken = each.filter(F.col("kind") == kind).orderBy(F.xxhash64("features", "start", "votes"), "start", "end").select("features", "votes").limit(per_kind)
        rows += [(r["features"], posterior[r["votes"]]) for r in taken.collect()]
    return Model(shares, chances, train(rows))


SPAN = "struct<kind:string,start:long,end:long,strict:boolean,score:double>"


def detect(found: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(id, spans) of every row: strict spans, and other candidates of a score of at least `least`.

    Of overlapping ones that are not strict the likeliest stays, then the first, then the longest. Spans are ordered by kind, start and end.
    """
    weights = model.weights
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("score", pa.float64())])

    def chosen(found: list[dict]) -> list[dict]:
        for c in found:
            c["score"] = float(1 / (1 + np.exp(-(weights[c["features"]].sum() + weights[-1]))))
        kept = [c for c in found if c["strict"]]
        starts: list[int] = []
        ends: list[int] = []
        for c in sorted((c for c in found if not c["strict"] and c["score"] >= least), key=lambda c: (-c["score"], c["start"], -c["end"], c["kind"])):
            i = bisect_left(starts, c["end"])
            if i == 0 or ends[i - 1] <= c["start"]:
                kept.append(c)
                at = bisect_left(starts, c["start"])
                starts.insert(at, c["start"])
                ends.insert(at, c["end"])
        kept.sort(key=lambda c: (c["kind"], c["start"], c["end"]))
        return [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "strict": c["strict"], "score": c["score"]} for c in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([chosen(c.as_py()) for c in batch.column(1)], pa.list_(span))], names=["key", "spans"])

    kind = found.schema[id_col].dataType.simpleString()
    out = by_tasks(found.select(F.col(id_col).alias("key"), "candidates"), work, f"key {kind}, spans array<{SPAN}>")
    return out.withColumnRenamed("key", id_col)


def personal_data(docs: DataFrame, per_kind: int = 4000, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row, with a model trained on the same rows.

    Null and empty texts have no spans. Repeated rows are searched each for itself. Other columns are not read. The texts are read
    once; what is written between the passes is their candidates only.
    """
    found = cut_lineage(find_candidates(docs, id_col, text_col))
    return detect(found, fit(found, per_kind), least, id_col)


def span_digests(spans: Column) -> dict[str, Column]:
    """Counts and digest of the strict spans, and all spans as text."""
    strictly = F.filter(spans, lambda s: s["strict"])
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter(strictly, lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": count(k) for k in KINDS}
    return counts | {"base_sha256": F.sha2(F.encode(joined(strictly), "UTF-8"), 256), "spans": joined(spans)}


def span_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the strict spans, and all spans as `kind:start:end` text."""
    return personal_data(docs).select("doc_id", *[c.alias(k) for k, c in span_digests(F.col("spans")).items()])
