"""Personal data: expressions propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (always kept): email, ip, card, phone. Kinds of this module besides: iban (mod-97), ssn (kept from
a score of 0.6 on, which needs a context word) and secret (a key name with its value). Words of the kind nearby raise a
score; where there is none, words that speak of other numbers lower it. ``redact`` can leave spans below a score alone. Spans are in code
points, end exclusive, and are found leftmost and without overlap inside each kind. An iban may end at any word
boundary where mod-97 holds: at the length of its country, else as late as possible. A null text counts as
empty. All searches are linear in the length of the text, so very long texts need no cap. Repeated rows give
repeated results, extra columns pass through; a column named like an added one is replaced. Without documents there is no row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, with_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
KEPT_FROM = 0.6
#: score of a confirmed span without context, and the words nearby that raise it
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.8}
CONTEXT = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "key"),
}
#: words nearby that lower the score of a span without a word of its kind
AGAINST = {
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "tracking", "serial", "isbn", "invoice"),
    "phone": ("order", "serial", "invoice", "version"),
    "iban": ("serial", "part", "tracking"),
    "ssn": ("part", "order", "serial", "invoice"),
}
REACH = 60
RAISE, LOWER = 0.3, 0.3
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

#: fixed values: characters before the @ of an email, and the expressions of the base kinds
_LOCAL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAY_BE_IP = re.compile(r"[0-9]\.[0-9]++\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
#: characters of an iban by country
_IBAN_LENGTH = {
    country: int(n)
    for n, *countries in map(
        str.split,
        """15 NO
        16 BE
        18 DK FI FO GL NL SD FK
        19 MK SI
        20 AT BA EE KZ LT LU MN XK
        21 CH CR HR LI LV
        22 BG BH DE GB GE IE ME RS VA
        23 AE GI IL IQ OM SO TL
        24 AD CZ ES MD PK RO SA SE SK TN VG
        25 LY PT ST
        26 IS TR
        27 BI DJ FR GR IT MC MR SM
        28 AL AZ BY CY DO GT HN HU LB NI PL SV
        29 BR EG PS QA UA
        30 JO KW MU YE
        31 MT SC
        32 LC
        33 RU""".splitlines(),
    )
    for country in countries
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(
    r"(?:token|secret|password|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9_/+-]{16,}+)", re.IGNORECASE
)
_DIGIT = re.compile("[0-9]")
_LUHN = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))


def luhn(digits: str) -> bool:
    return sum(_LUHN[i & 1][ord(d) - 48] for i, d in enumerate(reversed(digits))) % 10 == 0


def _mod97(chars: str, rest: int = 0) -> int:
    for c in chars:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest


def mod97(iban: str) -> bool:
    return _mod97(iban[4:] + iban[:4]) == 1


def _iban_end(text: str, m: re.Match) -> int:
    """Where the iban ends whose first four characters ``m`` has found; 0 if mod-97 holds at no word boundary."""
    rest, n, end = 0, 4, 0
    for i in range(m.start(2), m.end(2)):
        if text[i] == " ":
            continue
        rest, n = _mod97(text[i], rest), n + 1
        after = text[i + 1 : i + 2]
        if n >= 15 and not (after.isascii() and after.isalnum()) and _mod97(m[0], rest) == 1:
            end = i + 1
            if n == _IBAN_LENGTH.get(m[1]):
                break
    return end


def _ibans(text: str):
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() >= done and (end := _iban_end(text, m)):
            done = end
            yield m.start(), end


def _emails(text: str):
    end, at = 0, text.find("@")
    since = 0
    while at >= 0:
        run = text[max(end, since) : at]
        start = max(end, since) + len(run.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        since = at + 1
        at = text.find("@", max(since, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _proposed(text: str):
    """(kind, start, end) of all spans that their checks confirm, by kind and start."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        yield from (("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text))
        return
    if _MAY_BE_IP.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", a, b) for a, b in _ibans(text))
    yield from (("ssn", m.start(), m.end()) for m in _SSN.finditer(text))
    yield from (("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text))


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()
    words = set(re.findall(r"\w+", near))
    if not words.isdisjoint(CONTEXT[kind]):
        return min(1.0, PRIOR[kind] + RAISE)
    return PRIOR[kind] - LOWER * (not words.isdisjoint(AGAINST.get(kind, ())))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    out = []
    for kind, start, end in _proposed(text or ""):
        score = _score(text, kind, start, end)
        if kind in BASE or score >= KEPT_FROM:
            out.append((kind, start, end, score))
    return out


def redacted(text: str | None, least: float = 0.0) -> str | None:
    """The text with every span of a score of ``least`` or more replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end, _ in sorted((s for s in spans_of(text) if s[3] >= least), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def detect(df: DataFrame, text: str = "text", output: str = "spans") -> DataFrame:
    """Adds ``output``: all spans with their scores, by kind as in KINDS, then by start."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t.as_py())] for t in texts], type=kind
        )

    return df.withColumn(output, found(F.col(text)))


def redact(df: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """Replaces ``text`` by its redacted form."""

    columns = df.columns
    new = unused(df, "_redacted")
    out = with_columns(df, text, f"`{new}` string", lambda: lambda texts: [pa.array([redacted(t, least) for t in texts], type=pa.string())])
    return out.select(*(F.col(f"`{new}`").alias(c) if c == text else F.col(f"`{c}`") for c in columns))


def digest(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts and digests of the spans that ``detect`` has added."""

    def line(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def of(*kinds):
        return F.filter(spans, lambda x: x["kind"].isin(*kinds))

    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(of(*BASE), line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, line), ",").alias("spans"),
        F.array_join(F.transform(spans, lambda x: F.round(x["score"], 1).cast("string")), ",").alias("scores"),
    )
