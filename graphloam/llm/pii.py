"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import bisect
import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, write_table

#: Broad candidates, a span of one kind each, in one pass from left to right. They may swallow neighbours, so each kind has patterns of its own too.
CANDIDATE = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))"
    r"|(?P<iban>\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){3,7}(?: ?[A-Za-z0-9]{1,3})?\b)"
    r"|(?P<number>\+?\(?\d[\d ().-]{5,}\d)"
)
#: Broad secrets are runs of these signs with a digit before the last 18; a run is looked at once, since a pattern that may begin at each of its hyphens takes the square of its length.
RUN = re.compile(r"[A-Za-z0-9+/_-]{19,}+={0,2}")
_EDGE = re.compile(r"\b(?=[A-Za-z0-9+/_-])")
_DIGIT = re.compile(r"[0-9]")
_LOCAL, _LOCAL_RUN, _AT = re.compile(r"[\w.+-]"), re.compile(r"[\w.+-]++"), re.compile(r"@[\w-]+(?:\.[\w-]+)+")
IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
#: In a lookahead, so that a year before a number doesn't hide it: each place where a number begins is tried.
CARD = re.compile(r"(?<![\w.+-])(?=(\d{13,19}(?!\w)|\d{4}([ -])\d{4}\2\d{4}\2\d{4}(?!\w)|\d{4}([ -])\d{6}\3\d{5}(?!\w)))")
#: The usual forms: North American, and groups joined by one sign, or by spaces after a trunk 0.
PHONE = re.compile(r"(?<![\w(+.-])(?=((?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|[.-]\d)))")
GROUPS = re.compile(r"(?<![\w+.-])(?=(\d{2,4}([.-])\d{2,4}(?:\2\d{2,4}){0,4}(?!\w|[.-]\d)|\(?0\d{1,4}\)?[ /]\d{2,8}(?: \d{2,5}){0,4}(?!\w|[.-]\d)|\d{7,15}(?!\w|[.-]\d)))")
PLUS = re.compile(r"(?<![\w+])\+\d{1,15}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,12})){0,8}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}")
SECRET_FORM = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}"
    r"|(?:sk|pk|rk)[-_](?:[A-Za-z0-9]+[-_]){0,3}[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|(?:hf|npm)_[A-Za-z0-9]{20,}|(?<![_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?)"
)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
GIVEN = re.compile(r"(?:(?:token|key|secret|passw(?:or)?d|pwd|credentials?)[\"']?\s{0,3}(?:=>|[:=])\s{0,3}|bearer )[\"']?$", re.I)
KINDS = ("email", "phone", "ip", "card", "secret", "iban", "ssn")
TEST_DOMAINS = frozenset("com org net edu gov de fr es uk eu io info biz co us".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|kontakt|correo|courriel|mailto", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|telefon|tél|teléfono|whatsapp", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|amex", re.I),
    "secret": re.compile(r"token|secret|passw|api[_ -]?key|\bkey\b|bearer|credential", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "ssn": re.compile(r"ssn|social security|sozialversicherung|sécurité sociale", re.I),
}
AGAINST = re.compile(r"version|licen[sc]e|isbn|issn|page|chapter|section|§|v\.?\s*$|https?://|\bfigure|\btable|[€$£]\s*$", re.I)
WIDTH = 32
LABELERS = ("regex", "checksum", "gazetteer", "context", "against", "shape")
#: Discrete features of the final classifier, one bit each, after one for every kind.
FEATURES = ("regex", "checksum", "gazetteer", "context", "against", "shape", "bounded", "long", "many_digits", "letters", "separated", "plus")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _next_secret(text: str, runs: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The first broad secret from ``at`` on; ``runs``, last first, lose those that can't hold one any more."""
    while runs:
        start, end = runs[-1]
        edge = _EDGE.search(text, max(start, at), end) if end > at else None
        if edge and _DIGIT.search(text, edge.start(), len(text[start:end].rstrip("=")) + start - 18):
            return edge.start(), end
        runs.pop()
    return None


def _broad(text: str):
    """(start, end, kind) of the broad candidates, from left to right without overlaps; an email goes before a secret, a secret before others."""
    runs, at = [x.span() for x in RUN.finditer(text)][::-1], 0
    m, secret, email, run_end = CANDIDATE.search(text), _next_secret(text, runs, 0), None, 0
    while m or secret:
        if secret and (not m or secret[0] < m.start() or secret[0] == m.start() and m.lastgroup != "email"):
            yield *secret, "secret"
            at = secret[1]
        else:
            yield *m.span(), _kind(m)
            at = m.end()
        while at and _LOCAL.match(text, at - 1) and _LOCAL.match(text, at):
            # what came before took the beginning of an email's name
            if at >= run_end:
                run_end = _LOCAL_RUN.match(text, at).end()
                email = _AT.match(text, run_end)
            if not email:
                break
            yield at, email.end(), "email"
            at = email.end()
        if m and m.start() < at:
            m = CANDIDATE.search(text, at)
        if secret and secret[0] < at:
            secret = _next_secret(text, runs, at)


def _kind(m: re.Match) -> str | None:
    kind, s = m.lastgroup, m.group()
    if kind != "number":
        return kind
    n = sum(c.isdigit() for c in s)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s):
        return "ssn"
    if 13 <= n <= 19 and not s.startswith(("+", "(")):
        return "card"
    return "phone" if 7 <= n <= 15 else None


def labels(kind: str, span: str, before: str, after: str) -> tuple[list[int], list[bool]]:
    """(votes of the labelers: 1 for, -1 against, 0 abstains; the features)."""
    digits = re.sub(r"\D", "", span)
    vote = dict.fromkeys(LABELERS, 0)
    if kind == "email":
        tail = span.lower().rpartition(".")[2]
        vote["regex"] = 1 if re.fullmatch(r"[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", span) or re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", span) else -1
        vote["gazetteer"] = 1 if tail in TEST_DOMAINS else 0
        vote["shape"] = 1 if ".." not in span else -1
    elif kind == "phone":
        vote["regex"] = 1 if re.fullmatch(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)[ .-]?)?\d{2,4}([ .-]?\d{2,4}){1,4}", span) else -1
        code = re.match(r"\+(\d{1,3})", span)
        vote["gazetteer"] = 0 if not code else 1 if any(code[1].startswith(c) for c in DIAL_CODES) else -1
        vote["shape"] = 1 if re.search(r"[+(]|\d[ .-]\d", span) else -1
    elif kind == "ip":
        ok = all(int(x) < 256 for x in span.split("."))
        vote["regex"] = 1 if ok else -1
        vote["gazetteer"] = -1 if span.startswith(("0.", "127.")) else 0
        vote["shape"] = -1 if re.search(r"(^|\.)0\d", span) else 1
    elif kind == "card":
        vote["regex"] = 1 if re.fullmatch(r"\d{13,19}|\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", span) else -1
        vote["checksum"] = 1 if _luhn(digits) else 0
        vote["gazetteer"] = 1 if digits.startswith(CARD_PREFIXES) else 0
        vote["shape"] = 1 if len(digits) in (15, 16) else 0
    elif kind == "secret":
        formed = SECRET_FORM.fullmatch(span)
        vote["regex"] = 1 if formed or re.fullmatch(r"(?i)[0-9a-f]{32,}|[A-Za-z0-9+/_-]{24,}={0,2}", span) and re.search(r"[A-Za-z]", span) else -1
        vote["checksum"] = -1 if re.fullmatch(r"[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}", span) and _iban_ok(span) else 0
        vote["gazetteer"] = 1 if re.search(r"(?i)(token|key|secret|password)\W{1,6}$", before) or formed else 0
        kinds = len(set(re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", span)))))
        vote["shape"] = 1 if formed or kinds > 1 and len(set(span.lower())) >= 8 else -1
    elif kind == "iban":
        vote["regex"] = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        vote["checksum"] = 1 if _iban_ok(span) else -1
        vote["gazetteer"] = 1 if span[:2].upper() in IBAN_COUNTRIES else -1
    else:
        vote["regex"] = 1
        vote["gazetteer"] = -1 if span.startswith(("000", "666", "9")) else 0
        vote["shape"] = -1 if span[4:6] == "00" or span.endswith("0000") else 1
    vote["context"] = 1 if CONTEXT[kind].search(before) or CONTEXT[kind].search(after) else 0
    vote["against"] = -1 if AGAINST.search(before) else 0
    bounded = not (before[-1:].isalnum() or after[:1].isalnum())
    said = [vote[x] == 1 for x in ("regex", "checksum", "gazetteer", "context")] + [vote["against"] == -1, vote["shape"] == 1]
    return list(vote.values()), [*said, bounded, len(span) >= 16, len(digits) >= 10, any(c.isalpha() for c in span), bool(re.search(r"[ .@-]", span)), span.startswith("+")]


def _phone_ends(text: str, m: re.Match, stop: int) -> int:
    """The last place before ``stop`` where a number with a dial code may end, at most 15 digits on; -1 if there is none."""
    end, digits = -1, 0
    for g in re.finditer(r"\d+\)?", m.group()):
        digits += sum(c.isdigit() for c in g.group())
        e = m.start() + g.end()
        if digits > 15 or e > stop:
            break
        if digits >= 7 and not re.match(r"\w|[./-]\d", text[e : e + 2]):
            end = e
    return end


def _iban_ends(text: str, m: re.Match):
    """Ends of the account numbers that may begin here: of the country's length, or with a right checksum."""
    s, n = m.start(), 0
    for i in range(s, m.end()):
        if text[i] == " ":
            continue
        n += 1
        if n >= 15 and not re.match(r"[A-Za-z0-9]", text[i + 1 : i + 2]) and (n == IBAN_LENGTHS.get(text[s : s + 2].upper()) or _iban_ok(text[s : i + 1])):
            yield i + 1


def _may_be_secret(span: str, before: str) -> bool:
    if any(c.isdigit() for c in span):
        return len(span) >= 19 or bool(GIVEN.search(before))
    changes = sum(a.islower() != b.islower() for a, b in zip(span, span[1:]))
    return bool(GIVEN.search(before)) or len(span) >= 24 and changes >= 0.35 * len(span)


def spans_of(text: str) -> dict[tuple[int, int, str], int]:
    """Rank of every candidate span, which may overlap: 4 and 3 with a right checksum, 2 of a usual form, 1 of looser form, 0 broad."""
    out: dict[tuple[int, int, str], int] = {}

    def add(s, e, kind, rank):
        out[s, e, kind] = max(rank, out.get((s, e, kind), 0))

    for start, end, kind in _broad(text):
        if kind is not None:
            add(start, end, kind, 2 if kind in ("email", "ip", "ssn") else 0)
    stops = set()
    for kind, pattern, group in (("ip", IP, 0), ("card", CARD, 1), ("ssn", SSN, 0)):
        for m in pattern.finditer(text):
            add(*m.span(group), kind, 3 if kind == "card" and _luhn(re.sub(r"\D", "", m[group])) else 2)
            stops.add(m.start())
    first: dict[int, int] = {}
    for m in PHONE.finditer(text):
        first.setdefault(m.end(1), m.start())  # what begins later is the same number without its dial code
    for e, s in first.items():
        add(s, e, "phone", 2)
    for m in GROUPS.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[1]) <= 15 and not IP.fullmatch(m[1]) and not SSN.fullmatch(m[1]):
            add(*m.span(1), "phone", 1)
    for m in PLUS.finditer(text):
        stop = min((x for x in stops if m.start() < x < m.end()), default=m.end())
        for rank, end in ((1, _phone_ends(text, m, m.end())), (2, _phone_ends(text, m, stop))):
            if end >= 0:
                add(m.start(), end, "phone", rank)
    for m in IBAN.finditer(text):
        for end in _iban_ends(text, m):
            add(m.start(), end, "iban", 4 if _iban_ok(text[m.start() : end]) else 2)
    for m in SECRET_FORM.finditer(text):
        add(*m.span(), "secret", 2)
    for m in TOKEN.finditer(text):
        if _may_be_secret(m.group(), text[max(0, m.start() - WIDTH) : m.start()]):
            add(*m.span(), "secret", 1)
    return out


def candidates_of(text: str):
    """(start, end, kind, rank, packed votes, packed features) of each candidate span, in characters."""
    for (s, e, kind), rank in sorted(spans_of(text).items()):
        votes, features = labels(kind, text[s:e], text[max(0, s - WIDTH) : s], text[e : e + WIDTH])
        v = sum((x + 1) * 3**i for i, x in enumerate(votes))
        f = 1 << KINDS.index(kind)
        for i, x in enumerate(features):
            f |= x << (len(KINDS) + i)
        yield s, e, kind, rank, v, f


_MAY = re.compile(r"[\d@]|[A-Za-z0-9+/_-]{16}")
_SPAN = {"start": pa.int32(), "end": pa.int32(), "kind": pa.string(), "rank": pa.int32(), "votes": pa.int32(), "features": pa.int32()}
#: A row for each text, so that overlaps can be settled in it once the scores are known.
_SPANS = "array<struct<start: int, end: int, kind: string, rank: int, votes: int, features: int>>"


def _find(batches):
    for b in batches:
        found = [(i, [dict(zip(_SPAN, c)) for c in candidates_of(text)]) for i, text in enumerate(b.column(1).to_pylist()) if text and _MAY.search(text)]
        found = [x for x in found if x[1]]
        if found:
            at, spans = zip(*found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(spans, pa.list_(pa.struct(list(_SPAN.items()))))], ["doc_id", "spans"])


def settle(spans: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Of (start, end, kind, rank, score) those that stay: of overlapping spans the higher rank, then score, then length."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, int, float]] = []
    for x in sorted(spans, key=lambda x: (-x[3], -x[4], x[0] - x[1], x[0], x[2])):
        i = bisect.bisect_left(starts, x[1])
        if not i or kept[i - 1][1] <= x[0]:
            starts.insert(i, x[0])
            kept.insert(i, x)
    return kept


def _settle(batches, weights: list[float], intercept: float, threshold: float):
    known: dict[int, float] = {}

    def score(features):
        if features not in known:
            z = intercept + sum(w for i, w in enumerate(weights) if features >> i & 1)
            known[features] = round(1 / (1 + math.exp(-min(max(z, -500.0), 500.0))), 6)
        return known[features]

    for b in batches:
        rows = []
        for i, spans in enumerate(b.column(1).to_pylist()):
            scored = ((x["start"], x["end"], x["kind"], x["rank"], score(x["features"])) for x in spans)
            rows += [(i, s, e, kind, p) for s, e, kind, _, p in settle([x for x in scored if x[4] >= threshold])]
        if rows:
            at, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int32(), pa.string(), pa.float64())))], ["doc_id", "start", "end", "kind", "score"])


def estimate(votes: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that a vote pattern's spans are personal data, by EM over the labelers' reliabilities.

    Each labeler has, for each kind, its chances of voting for, against or not at all given either truth; priors of a
    few counts keep rare kinds sensible. ``votes``: patterns x labelers of -1, 0, 1.
    """
    p = np.clip(0.5 + 0.4 * np.sign(votes.sum(axis=1)) * np.minimum(1, np.abs(votes.sum(axis=1)) / 2), 0.05, 0.95)
    pseudo = np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]])  # truth (no, yes) x vote (-1, 0, 1)
    for _ in range(rounds):
        log = np.zeros((len(p), 2))
        for k in np.unique(kind):
            at = kind == k
            yes, no = (count[at] * p[at]), (count[at] * (1 - p[at]))
            prior = (yes.sum() + 1) / (count[at].sum() + 2)
            log[at] += np.log([1 - prior, prior])
            for j in range(votes.shape[1]):
                v = votes[at, j] + 1
                table = np.stack([np.bincount(v, no, 3), np.bincount(v, yes, 3)]) + pseudo
                table /= table.sum(axis=1, keepdims=True)
                log[at] += np.log(table[:, v]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def train(features: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the patterns' soft labels: (weights, intercept)."""
    x = np.column_stack([features, np.ones(len(features))]).astype(float)
    c = count / count.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (c * np.maximum(z * (1 - z), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (c * (p - z)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, score): the spans of personal data and secrets, in characters from 0, end exclusive.

    Broad patterns and those of each kind give candidates over whole texts, which may overlap; regex, checksum, gazetteer and context labelers
    vote on each. EM over the counts of all vote patterns of the table estimates the labelers, and a logistic classifier of
    discrete features, trained on EM's probabilities of all candidates, scores each span. Only then are overlaps settled.

    Null and empty texts have no spans. A doc_id may be of any type and null. Repeated rows have theirs each; texts of
    any length take time in proportion. Of overlapping spans with equal rank and score the longer stays, then the earlier,
    then the first kind by name. A table without candidates gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = write_table(rows.mapInArrow(_find, f"doc_id {id_type}, spans {_SPANS}"), "pii-candidates")
    patterns = found.select(F.inline("spans")).groupBy("votes", "features").count().orderBy("votes", "features").collect()
    w, b = np.zeros(0), 0.0
    if patterns:
        count = np.array([r["count"] for r in patterns], float)
        votes = np.array([[r.votes // 3**i % 3 - 1 for i in range(len(LABELERS))] for r in patterns])
        bits = np.array([[r.features >> i & 1 for i in range(len(KINDS) + len(FEATURES))] for r in patterns])
        w, b = train(bits, estimate(votes, bits[:, : len(KINDS)].argmax(axis=1), count), count)
    settled = partial(_settle, weights=w.tolist(), intercept=b, threshold=threshold)
    return found.mapInArrow(settled, f"doc_id {id_type}, start int, end int, kind string, score double")
