"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone). Further candidates are keys and passwords (`secret`), phone numbers
without a country code, bank accounts (`iban`), national numbers (`national_id`), names after a form of address (`name`) and
street addresses (`address`). Four labelers, each with evidence of its own, vote yes, no or nothing on a candidate: a regex
on the shape of the span, a gazetteer or check digits on what it or the word before it is, the marks and words around it,
and the variety of its characters (which can only speak against it). Expectation-maximisation over the counts of all vote
patterns estimates each labeler's reliability without labels; the posteriors train a logistic classifier on features of
the span, which votes do not repeat, together with the votes, and it decides. Candidates are gathered from whole texts and
all documents. Only counts of patterns reach the driver, and the number of patterns is bounded by the votes and features
(MAX_PATTERNS at most).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "national_id", "name", "address")
CANDIDATE_KINDS = ("secret", "phone", "iban", "national_id", "name", "address")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,20}"
_NAME = re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20{_WORD}(?:\x20{_WORD}){{0,2}}")
_ADDRESS = re.compile(rf"(?<![0-9])[0-9]{{1,5}}\x20(?:{_WORD}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)\b|\b{_WORD}(?:straße|strasse|weg|platz)\x20[0-9]{{1,4}}\b")
#: Names of keys, and words that announce a phone number, an account, a national number, a name or an address.
KEY_NAMES = frozenset("token secret password passwd pwd apikey api_key key auth credential credentials access_key secret_key private_key bearer".split())
PHONE_WORDS = frozenset("call phone tel telephone mobile cell fax contact telefon teléfono téléphone handy llame appelez anrufen".split())
ACCOUNT_WORDS = frozenset("iban account konto bank compte cuenta bic swift".split())
NATIONAL_WORDS = frozenset("ssn social security number id tax identification".split())
NAME_WORDS = frozenset("dear name by from to with contact attn attention regards signed liebe cher estimado".split())
ADDRESS_WORDS = frozenset("address at live lives home ship deliver to street adresse anschrift dirección wohnt".split())
GIVEN_NAMES = frozenset("james mary john anna maria peter paul michael david sarah thomas julia laura hans klaus pierre marie jean josé juan carlos".split())
_BEFORE = re.compile(r"[^\W\d]+", re.UNICODE)

#: Votes of the four labelers (3 each), six features (2 each) and the kinds.
MAX_PATTERNS = len(CANDIDATE_KINDS) * 3**4 * 2**6


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(digits: str) -> int:
    short = digits.lstrip("0")
    return int(short or "0") if len(short) <= 3 else 999


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain; found from each @, so that long runs without one cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in BASE_KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_part(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _variety(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _iban(span: str) -> bool:
    """Check digits of a bank account."""
    compact = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _votes(kind: str, span: str, before: str, after: str) -> tuple[int, int, int, int]:
    """The four labelers on a candidate: shape, gazetteer or check, surroundings, variety."""
    near = [w.lower() for w in _BEFORE.findall(before)][-3:]
    digits = _NOT_DIGIT.sub("", span)
    assigned = bool(re.search(r"[=:]\s?[\"']?$", before))
    quoted = bool(before[-1:]) and bool(after[:1]) and before[-1:] in "\"'" and after[:1] in "\"'"
    letters = sum(c.isalpha() for c in span)
    if kind == "secret":
        shape = 1 if letters and len(span) >= 20 and len(span) > letters else -1
        known = (1 if near[-1] in KEY_NAMES else -1) if near else 0
        around = 1 if assigned else 0 if quoted else -1
        return shape, known, around, 0 if _variety(span) >= 3.0 and letters else -1
    words = {"phone": PHONE_WORDS, "iban": ACCOUNT_WORDS, "national_id": NATIONAL_WORDS, "name": NAME_WORDS, "address": ADDRESS_WORDS}[kind]
    around = 1 if any(w in words for w in near) else 0 if assigned else -1
    if kind == "phone":
        return 1 if span.startswith("(") or span.count("-") == 2 else 0, 1 if digits[3:6] == "555" else 0, around, 0 if len(set(digits)) >= 4 else -1
    if kind == "iban":
        return 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1, 1 if _iban(span) else -1, around, 0 if len(set(digits)) >= 4 else -1
    if kind == "national_id":
        sound = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        return 1 if sound else -1, 0, around, 0 if len(set(digits)) >= 4 else -1
    if kind == "name":
        parts = span.split()[1:]
        return 1 if len(parts) >= 2 else 0, 1 if any(p.lower() in GIVEN_NAMES for p in parts) else 0, around, 0 if len(set(span.lower())) >= 6 else -1
    return 1 if len(digits) <= 4 else 0, 0, around, 0 if len(set(span.lower())) >= 6 else -1


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of spans that may be personal data and overlap no base span and no earlier candidate.
    pattern: votes and features. One pass over the spans in their order."""
    found = [("name", *m.span()) for m in _NAME.finditer(text)]
    if _DIGIT.search(text):
        found += [("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m.group())]
        for kind, pattern in (("phone", _LOCAL_PHONE), ("iban", _IBAN), ("national_id", _NATIONAL), ("address", _ADDRESS)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not found:
        return []
    starts, ends = [], []  # the base spans, merged where they overlap
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, reach = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], x[0] != "iban", -x[2])):  # an account may look like a secret, too
        i = bisect.bisect_right(ends, a)
        if a < reach or (i < len(starts) and starts[i] < b):
            continue
        span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 2]
        votes = _votes(kind, span, before, after)
        bits = (len(span) >= 24, len(span) >= 40, any(c.isupper() for c in span), any(c in "_-/+" for c in span), " " in span, sum(c.isdigit() for c in span) * 2 > len(span))
        out.append((kind, a, b, f"{kind}|{','.join(map(str, votes))}|{''.join(str(int(x)) for x in bits)}"))
        reach = b
    return out


def estimate(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Probability of each pattern to be personal data: EM over the votes, then a logistic classifier on votes and features.

    counts: pattern -> number of candidates. A weak prior (labelers are right more often than not) keeps the classes
    from trading places and decides alone when there are few candidates.
    """
    out: dict[str, float] = {}
    for kind in CANDIDATE_KINDS:
        own = sorted(p for p in counts if p.startswith(kind + "|"))
        if not own:
            continue
        n = np.array([counts[p] for p in own], float)
        votes = np.array([[int(v) for v in p.split("|")[1].split(",")] for p in own])
        bits = np.array([[int(c) for c in p.split("|")[2]] for p in own], float)
        prior_on = np.array([2.0, 6.0, 8.0])  # of no, nothing, yes, if it is personal data; reversed if it is not
        post = 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5)))
        for _ in range(rounds):
            share = (n @ post + 8) / (n.sum() + 16)
            on, off = (np.stack([[prior[v + 1] + (n * w)[votes[:, j] == v].sum() for v in (-1, 0, 1)] for j in range(votes.shape[1])])
                       for prior, w in ((prior_on, post), (prior_on[::-1], 1 - post)))
            on, off = on / on.sum(axis=1, keepdims=True), off / off.sum(axis=1, keepdims=True)
            score = math.log(share / (1 - share)) + sum(np.log(on[j][votes[:, j] + 1] / off[j][votes[:, j] + 1]) for j in range(votes.shape[1]))
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            done = np.abs(new - post).max() < 1e-9
            post = new
            if done:
                break
        x = np.hstack([np.ones((len(own), 1)), votes, bits])
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps of the penalised log likelihood with soft labels
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (post - p)) - 0.1 * w
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        out |= dict(zip(own, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))
    return out


_FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int,pattern:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([*_SPAN, ("pattern", pa.string())])


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans of each row: arrays of (kind, start, end), in code points, end exclusive, by kind as in
    KINDS, then start. spans holds the base spans and those the classifier adds with a probability above threshold.

    docs: doc_id long, text string, others ignored. A null or empty text has no spans. Null and repeated doc_ids stay as
    they are, and so do rows that are repeated; other columns are ignored, whatever their names; an empty table gives an
    empty result. A text of any length is held whole by one task. Of candidates that overlap the first counts.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ex.flushes(batches):
            base, more = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text) if text else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                more.append([dict(zip(("kind", "start", "end", "pattern"), s, strict=True)) for s in candidates(text, own)] if text else [])
            yield pa.record_batch({"doc_id": batch.column("doc_id").combine_chunks(), "base": pa.array(base, pa.list_(_SPAN)), "more": pa.array(more, pa.list_(_CANDIDATE))})

    found = ex.materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, _FOUND), "spans")
    patterns = found.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    counts = {r["pattern"]: r["n"] for r in patterns.collect()}  # fewer than MAX_PATTERNS rows
    chosen = [p for p, probability in estimate(counts).items() if probability > threshold]
    added = F.filter("more", lambda s: s["pattern"].isin(chosen)) if chosen else F.filter("more", lambda s: F.lit(False))
    plain = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", plain), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "base", spans.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (all of them) of every document."""
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


#: SQL has no expectation-maximisation; tests hold the base spans against plain regexes, the estimates against drawn votes.
SQL = None
