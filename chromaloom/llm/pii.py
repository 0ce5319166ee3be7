"""Personal data found by weak supervision.

Base expressions give spans that always stay.  Looser forms propose more:
addresses with letters of any script, spelled-out addresses, telephone and card
numbers in other clothes or beside another number, IBANs, national numbers, hardware addresses, account
numbers, names behind a title, streets and dates of birth.  Labelers (shape,
gazetteer, context, checksum, isolation) vote on every span, the base ones too.
How often each combination of votes occurs in the whole corpus is counted;
expectation-maximisation on these counts estimates how reliable each labeler
is.  Its posteriors are the targets of a logistic classifier, which does not see
the votes but the span itself (length, digits, letters, neighbours, the word
before) and decides on the proposals.  Base spans get its probability too.

Only counts reach the driver: a row for each kind and combination of votes, a
number fixed by the labelers, and the TRAIN_ROWS most frequent combinations of
votes and features for the classifier.  The spans, without texts, are written
once to the shared folder and read again.

Defined cases: a null text counts as empty; spans are in code points, end
exclusive, by kind as listed in KINDS and then start; a proposal that overlaps a
base span is dropped unless it is an e-mail address around one; of proposals
that overlap each other the first, and of those the longest, stays; ties of the
classifier (probability equal to ``accept``) are accepted; repeated rows count
each and give a row each; an empty table gives an empty result; further columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "mac", "account", "name", "street", "birth")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("shape", "gazetteer", "context", "checksum", "isolation")
#: A proposal becomes a span from this probability on.
ACCEPT = 0.5
#: Characters before a span in which its context is looked for.
CONTEXT = 40
#: Rows (kind, votes, features) on which the classifier is trained at most: the most frequent ones.
TRAIN_ROWS = 20_000
#: Observations of right and of wrong votes that every labeler starts with.
BELIEF = (4.0, 1.0)
#: Buckets of the word before a span.
WORD_BUCKETS = 32

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9+][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser forms.  All are anchored, bounded or possessive: none looks at a character more than a few times.
_WIDE_DOMAIN = re.compile(r"@(?:[^\W_]|-)++(?:\.(?:[^\W_]|-)++)++")
_AT = re.compile(r"\s?(?:[(\[{]at[)\]}]|\sat\s)\s?", re.I)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\s?(?:[(\[{]dot[)\]}]|\sdot\s|\.)\s?[A-Za-z0-9-]++)++", re.I)
_OBFUSCATED = re.compile(r"[(\[{](?:at|dot)[)\]}]|\sdot\s", re.I)
_LOOSE_PHONE = re.compile(r"\(?(?<![0-9.+-])[0-9]{2,5}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.-]?[0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9.])(?:[0-9]{4}(?:[ ./-][0-9]{4}){3}|[0-9]{13,19})(?![0-9])")
_STRICT_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9])[0-9]{8,19}(?![0-9])")
_DATE = re.compile(r"(?<![0-9.-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9-])")
_NAME = re.compile(r"\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\.? (?-i:[A-ZÀ-ÖØ-Þ][\w'-]{1,30}(?: [A-ZÀ-ÖØ-Þ][\w'-]{1,30}){0,2})")
_STREET = re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard)\b|\b[A-ZÄÖÜ][a-zäöüß]{1,25}(?:straße|strasse|gasse|allee|platz) [0-9]{1,4}\b")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me dev app uk us de fr es it nl be ch at se no dk fi pl pt ie cz ru ua cn jp kr in br mx ar cl ca au nz za eu example test".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4)|35|62")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
FOR = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt|from|to:", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|client|login|logged|connect|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel[.:]|mobile|cell|fax|contact|whatsapp|sms|ruf|llam|appel", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "mac": re.compile(r"\bmac\b|ether|hardware|device|adapter", re.I),
    "account": re.compile(r"account|acct|konto|compte|cuenta|bank|passport|licen[cs]e|member|patient", re.I),
    "name": re.compile(r"name|dear|signed|by|from|regards|patient|contact", re.I),
    "street": re.compile(r"address|lives?|street|home|ship|adresse|wohn|direcci", re.I),
    "birth": re.compile(r"born|birth|\bdob\b|geboren|geburt|né[e ]|naci", re.I),
}
AGAINST = re.compile(r"isbn|issn|version|order|invoice|serial|part|price|total|doi|section|chapter|page|room|http|www\.|figure|table", re.I)
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr")
_STREETS = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "straße", "strasse", "gasse", "allee", "platz")


def _few(number: str, most: int) -> bool:
    digits = number.lstrip("0")
    return len(digits) <= len(str(most)) and int(digits or "0") <= most


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban_holds(text: str) -> bool:
    code = text.replace(" ", "")
    return len(code) == IBAN_LENGTHS.get(code[:2]) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """The base expressions' matches, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        upto = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > upto and text[start - 1] in _LOCAL_CHARACTERS:
                start -= 1
            if start < at:
                upto = m.end()
                out.append(("email", start, upto))
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        part = region[0]
        if "." in part:
            out += (("ip", a + m.start(), a + m.end()) for m in _IP.finditer(part) if all(_few(x, 255) for x in m[0].split(".")))
        for m in _CARD.finditer(part):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", a + m.start(), a + m.end()))
        if "+" in part:
            out += (("phone", a + m.start(), a + m.end()) for m in _PHONE.finditer(part) if 9 <= len(_digits(m[0])) <= 15)
    return out


def _wide_emails(text: str) -> Iterator[Span]:
    """Addresses whose letters may be of any script."""
    upto = 0
    for m in _WIDE_DOMAIN.finditer(text):
        at = start = m.start()
        while start > upto and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while start < at and text[start] in "._%+-" and start and text[start - 1] != " ":
            start += 1
        if start < at:
            upto = m.end()
            if not text[start:upto].isascii():
                yield "email", start, upto


def _spelled_emails(text: str) -> Iterator[Span]:
    """name (at) host dot com and the like."""
    upto = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > upto and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at and (d := _SPELLED_DOMAIN.match(text, m.end())):
            upto = d.end()
            if _OBFUSCATED.search(text, start, upto):
                yield "email", start, upto


def proposals(text: str) -> list[Span]:
    """Spans of the looser forms that pass their hard tests."""
    out: list[Span] = []
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 8:
            continue
        a -= a > 0 and text[a - 1] == "("
        part = text[a:b]
        if "+" in part:
            out += (("phone", a + m.start(), a + m.end()) for m in _STRICT_PHONE.finditer(part) if 9 <= len(_digits(m[0])) <= 15)
        out += (("card", a + m.start(), a + m.end()) for m in _LOOSE_CARD.finditer(part) if luhn(_digits(m[0])))
        if "-" in part or "." in part or " " in part.strip():
            out += (("ssn", a + m.start(), a + m.end()) for m in _SSN.finditer(part))
            for m in _LOOSE_PHONE.finditer(part):
                if 9 <= len(_digits(m[0])) <= 12:
                    out.append(("phone", a + m.start(), a + m.end()))
        for m in _NUMBER.finditer(part):
            before = text[max(0, a + m.start() - CONTEXT) : a + m.start()]
            if FOR["account"].search(before) or FOR["card"].search(before):
                out.append(("account", a + m.start(), a + m.end()))
        if "-" in part or "." in part:
            out += (("birth", a + m.start(), a + m.end()) for m in _DATE.finditer(part) if FOR["birth"].search(text, max(0, a + m.start() - CONTEXT), a + m.start()))
    if "@" in text and not text.isascii():
        out += _wide_emails(text)
    if _OBFUSCATED.search(text):
        out += _spelled_emails(text)
    if (colons := text.count(":")) > 4:
        out += (("mac", *m.span()) for m in _MAC.finditer(text))
        if colons > 6:
            out += (("ip", *m.span()) for m in _IPV6.finditer(text))
    out += (("iban", *m.span()) for m in _IBAN.finditer(text) if _iban_holds(m[0]))
    if any(t in text for t in _TITLES):
        out += (("name", *m.span()) for m in _NAME.finditer(text))
    if any(t in text for t in _STREETS):
        out += (("street", *m.span()) for m in _STREET.finditer(text))
    return out


def votes(text: str, span: Span, base: bool) -> str:
    """One of + (personal), - (not) and 0 (no opinion) from each labeler."""
    kind, a, b = span
    found = text[a:b]
    before = text[max(0, a - CONTEXT) : a]
    digits = _digits(found)
    shape = "+" if base else "0"
    gazetteer = "0"
    if kind == "email":
        gazetteer = "+" if re.split(r"\W+", found.strip())[-1].lower() in TOP_DOMAINS else "-"
    elif kind == "card":
        gazetteer = "+" if ISSUERS.match(digits) else "-"
    elif kind == "ip" and "." in found:
        first = found.split(".", 1)[0].lstrip("0") or "0"
        gazetteer = "-" if first in ("0", "127", "255") else "+"
    elif kind == "iban":
        gazetteer = "+" if found[:2] in IBAN_LENGTHS else "-"
    elif kind == "ssn":
        gazetteer = "-" if digits[:3] in ("000", "666") or digits[0] == "9" else "+"
    elif kind in ("phone", "account"):
        gazetteer = "-" if len(set(digits)) < 3 else "+" if kind == "phone" and ("555" in digits or found[:1] in "+(") else "0"
    elif kind in ("name", "street"):
        gazetteer = "+"
    context = "-" if AGAINST.search(before) else "+" if FOR[kind].search(before) else "0"
    checksum = "+" if kind in ("card", "iban") else "0"
    isolation = "+" if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else "-"
    return shape + gazetteer + context + checksum + isolation


def _beside(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "l" if c.isalpha() else "d" if c.isdigit() else "p"


def features(text: str, span: Span) -> str:
    """The span itself, not the votes: length, digits, letters, marks, what stands beside it and the word before, as name=value."""
    _, a, b = span
    found = text[a:b]
    n = sum("0" <= c <= "9" for c in found)
    letters = [c for c in found if c.isalpha()]
    case = "none" if not letters else "wide" if not found.isascii() else "upper" if all(map(str.isupper, letters)) else "lower" if all(map(str.islower, letters)) else "mixed"
    marks = "".join(c for c in "@:-.( " if c in found)
    word = re.findall(r"\w+", text[max(0, a - CONTEXT) : a])
    bucket = zlib.crc32(word[-1].lower().encode()) % WORD_BUCKETS if word else -1
    return f"len={min(6, (b - a).bit_length())},digits={min(4, (n + 3) // 4)},case={case},marks={marks.replace(' ', '_')},before={_beside(text[a - 1 : a])},after={_beside(text[b : b + 1])},word={bucket}"


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str, str]]:
    """Base spans and the proposals that do not touch them or each other, in order, with votes and features.

    An e-mail address around a base one may touch it.
    """
    if not text:
        return []
    base = base_spans(text)
    more: list[Span] = []
    if proposed := proposals(text):
        taken: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        starts, addresses, upto = [a for a, _ in taken], {(a, b) for k, a, b in base if k == "email"}, 0
        for s in sorted(proposed, key=lambda s: (s[1], -s[2], RANK[s[0]])):
            kind, a, b = s
            if a < upto:
                continue
            i = bisect_right(starts, a) - 1
            clear = (i < 0 or taken[i][1] <= a) and (i + 1 == len(taken) or taken[i + 1][0] >= b)
            around = kind == "email" and not clear and any((x, y) in addresses and a <= x and y <= b and (a, b) != (x, y) for x, y in taken[max(0, i) : bisect_right(starts, b)])
            if clear or around:
                more.append(s)
                upto = b
    rows = [(*s, True) for s in base] + [(*s, False) for s in more]
    rows.sort(key=lambda s: (RANK[s[0]], s[1], s[2]))
    return [(*s, votes(text, s[:3], s[3]), features(text, s[:3])) for s in rows]


def estimate(kinds: list[str], combos: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row (kind, votes) and P(vote is + | truth, there is a vote) by truth and labeler, by expectation-maximisation.

    A labeler without an opinion says nothing.  The start is the vote of all
    labelers; each is believed from BELIEF observations on to be right rather than
    wrong, and each kind to be personal as often as not.
    """
    values = np.array([["-0+".index(c) - 1 for c in v] for v in combos], np.int64).reshape(len(combos), len(LABELERS))
    which = np.array([RANK[k] for k in kinds], np.int64)
    plus, minus = (values > 0).astype(float), (values < 0).astype(float)
    p = 1 / (1 + np.exp(-values.sum(1).astype(float)))
    table = np.full((2, len(LABELERS)), 0.5)
    right, wrong = BELIEF
    for _ in range(rounds):
        for y, w in enumerate((counts * (1 - p), counts * p)):
            up, down = w @ plus, w @ minus
            table[y] = (up + (right if y else wrong)) / (up + down + right + wrong)
        prior = (np.bincount(which, counts * p, len(KINDS)) + 1) / (np.bincount(which, counts, len(KINDS)) + 2)
        odds = plus @ np.log(table[1] / table[0]) + minus @ np.log((1 - table[1]) / (1 - table[0])) + np.log(prior / (1 - prior))[which]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table


class Classifier:
    """Logistic regression on kind and features; weights by name, the intercept under the empty one."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[tuple[str, str], float] = {}

    def probability(self, kind: str, described: str) -> float:
        found = self.known.get((kind, described))
        if found is None:
            z = sum(self.weights.get(name, 0.0) for name in names_of(kind, described))
            found = self.known[kind, described] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return found


def names_of(kind: str, described: str) -> list[str]:
    return ["", f"kind={kind}", *described.split(",")]


def train(kinds: list[str], described: list[str], counts: np.ndarray, target: np.ndarray, rounds: int = 100, decay: float = 1e-3) -> Classifier:
    """Logistic regression of the posteriors on kind and features, each row weighing the logarithm of its count."""
    rows = [names_of(k, d) for k, d in zip(kinds, described, strict=True)]
    columns = {name: i for i, name in enumerate(sorted({n for r in rows for n in r}))}
    x = np.zeros((len(rows), len(columns)))
    for i, r in enumerate(rows):
        x[i, [columns[n] for n in r]] = 1
    weight = np.log1p(counts)
    weight /= max(weight.sum(), 1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + decay * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Classifier({name: float(w[i]) for name, i in columns.items()})


_FIELDS = ("kind", "start", "stop", "base", "votes", "features")
_CANDIDATES = "array<struct<kind:string,start:int,stop:int,base:boolean,votes:string,features:string>>"


def propose(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column and its candidates."""
    kind = dict(docs.dtypes)[id_column]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, text_column):
            rows = [[dict(zip(_FIELDS, c, strict=True)) for c in candidates(t)] for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(rows, struct)], ["_id", "_candidates"])

    return docs.select(id_column, text_column).mapInArrow(run, f"_id {kind}, _candidates {_CANDIDATES}")


def fit(proposed: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """The classifier, learned from all candidates: votes counted over all of them, then EM, then regression."""
    each = proposed.select(F.explode("_candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    by_votes = sorted((r["kind"], r["votes"], r["n"]) for r in counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect())
    if not by_votes:
        return Classifier({})
    posterior, _ = estimate([r[0] for r in by_votes], [r[1] for r in by_votes], np.array([r[2] for r in by_votes], float))
    truth = {r[:2]: p for r, p in zip(by_votes, posterior, strict=True)}
    rows = counted.orderBy(F.desc("n"), "kind", "votes", "features").limit(train_rows).collect()
    return train([r["kind"] for r in rows], [r["features"] for r in rows], np.array([r["n"] for r in rows], float), np.array([truth[r["kind"], r["votes"]] for r in rows]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Per row: the id column, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_doubtful.

    ``n_added`` counts accepted proposals, ``n_doubtful`` base spans that the classifier would not have accepted.
    """
    proposed = cut(propose(docs, id_column, text_column))
    model = fit(proposed)
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.known.clear()
        for batch in batches:
            rows = batch.column("_candidates").to_pylist()
            base, full, doubtful = [], [], []
            for row in rows:
                sure = [model.probability(c["kind"], c["features"]) >= accept for c in row]
                spans = [(c["kind"], c["start"], c["stop"]) for c in row]
                base.append([s for s, c in zip(spans, row, strict=True) if c["base"]])
                full.append([s for s, c, y in zip(spans, row, sure, strict=True) if c["base"] or y])
                doubtful.append(sum(c["base"] and not y for c, y in zip(row, sure, strict=True)))
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            digest = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            added = [len(f) - len(b) for f, b in zip(full, base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *counts, pa.array(digest, pa.string()), pa.array(map(joined, full), pa.string()), pa.array(added, pa.int64()), pa.array(doubtful, pa.int64())], [id_column, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_doubtful"])

    return proposed.mapInArrow(run, f"`{id_column}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_doubtful bigint")
