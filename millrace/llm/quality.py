"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a document. Its cost and its selectivity are estimated on a sample: the
``SAMPLE_ROWS`` different texts of the whole table with the smallest hashes, profiled whole where they lie (only the figures
of each reach the driver). Cost is counted work, not time: a feature charges its weight for each byte of the text when a
rule first asks for it. Rules are then ordered greedily: next comes the rule with most rejections among the texts that are
left for the work that it adds to what is already computed. A document runs through the rules until one rejects it, and
features that no rule has asked for are never computed. The order depends on the table only, so results can be repeated; it
decides which of several rejecting rules is named, never the verdict.

Null and empty texts have no words. A line counts as repeated only if it has a word. Repeated rows give repeated results.
Very long texts are taken whole. Without documents there is no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

SYMBOLS = b"#*$%&|<>"
#: different texts of the sample that estimates costs and selectivities
SAMPLE_ROWS = 500


def words_in_repeats(words: Sequence[bytes], size: int = 3) -> int:
    """Words that lie in windows of ``size`` words which occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    new = ids.setdefault
    at = np.array([new(w, len(ids)) for w in words], dtype=np.int64)
    key = at[:n]
    for k in range(1, size):
        if len(ids) ** (k + 1) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        if (int(key.max()) + 1) * len(ids) >= 2**62:
            raise OverflowError("a text of more than 2**31 words")
        key = key * len(ids) + at[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for k in range(size):
        hit[k : k + n] |= again
    return int(hit.sum())


class feature:
    """A figure of a text, computed when it is first asked for; it then charges ``weight`` for each byte of the text."""

    def __init__(self, weight: float):
        self.weight = weight

    def __call__(self, fn: Callable):
        self.fn = fn
        return self

    def __set_name__(self, owner, name: str):
        self.name = name

    def __get__(self, doc, owner=None):
        if doc is None:
            return self
        if doc.asked is not None:
            doc.asked.append(self.name)
        if self.name not in doc.held:
            doc.held[self.name] = self.fn(doc)
            doc.work[self.name] = self.weight * len(doc.raw)
        return doc.held[self.name]


class Doc:
    """Lazily computed features of one text. ``work`` is what each computed one has cost, ``asked`` a trace if it is a list."""

    __slots__ = ("text", "raw", "held", "work", "asked")

    def __init__(self, text: str | None, trace: bool = False):
        self.text = text or ""
        self.raw = self.text.encode("utf-8")
        self.held: dict = {}
        self.work: dict[str, float] = {}
        self.asked: list[str] | None = [] if trace else None

    @feature(1.0)
    def words(self) -> list[bytes]:
        return self.raw.split()

    @feature(0.0)
    def n_words(self) -> int:
        return len(self.words)

    @feature(0.3)
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - sum(map(len, self.words)))

    @feature(0.2)
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @feature(0.3)
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and x.strip()]

    @feature(0.1)
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @feature(8.0)
    def n_repeat_words(self) -> int:
        return words_in_repeats(self.words)

    @feature(0.0)
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words

    @feature(0.6)
    def n_upper(self) -> int:
        return sum(map(bytes.isupper, self.words))

    @feature(0.2)
    def n_digits(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"0123456789"))

    @feature(0.2)
    def n_marks(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"!?;:,.()[]{}\"'-_/\\=+@^~`"))


Rule = tuple[str, Callable[[Doc], bool]]

#: name and what it rejects
RULES: tuple[Rule, ...] = (
    ("too_short", lambda d: d.n_words < 50),
    ("repetitive", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    ("symbols", lambda d: d.n_symbols * 10 > d.n_words),
    ("shouting", lambda d: d.n_upper * 10 > d.n_words * 6),
    ("repeated_lines", lambda d: d.n_dup_lines >= 4 and d.n_dup_lines * 10 > len(d.lines) * 6),
    ("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 25 * d.n_words),
    ("digits", lambda d: d.n_digits * 2 > d.word_chars),
    ("punctuation", lambda d: d.n_marks * 5 > d.word_chars * 2),
)


class Profile(NamedTuple):
    """What all rules say of one text, which features each asks for, and what each feature costs."""

    rejects: list[bool]
    needs: list[list[str]]
    work: dict[str, float]


def profile(text: str | None, rules: Sequence[Rule] = RULES) -> Profile:
    doc = Doc(text, trace=True)
    rejects, needs = [], []
    for _, rule in rules:
        doc.asked, doc.held = [], {}
        rejects.append(bool(rule(doc)))
        needs.append(sorted(set(doc.asked)))
    return Profile(rejects, needs, doc.work)


def plan(profiles: Sequence[Profile], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules in the order of rejections for the work that they add; ties by work, then by name."""
    left = [(p, set()) for p in profiles]
    rest, out = list(range(len(rules))), []
    while rest:
        rank = []
        for r in rest:
            work = sum(p.work[f] for p, have in left for f in p.needs[r] if f not in have)
            rank.append((-sum(p.rejects[r] for p, _ in left) / (work + 1e-9), work, rules[r][0], r))
        best = min(rank)[-1]
        rest.remove(best)
        out.append(rules[best])
        left = [(p, have.union(p.needs[best])) for p, have in left if not p.rejects[best]]
    return out


def first_rejection(doc: Doc, rules: Sequence[Rule]) -> str | None:
    for name, rejects in rules:
        if rejects(doc):
            return name
    return None


def sampled(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Profile]:
    """Profiles of the ``rows`` different texts of the whole table with the smallest hashes, in that order."""
    hashes = df.select(F.xxhash64(F.col(text)).alias("h"))

    def smallest():
        held = np.empty(0, dtype=np.int64)

        def work(h):
            nonlocal held
            before = held
            held = np.unique(np.concatenate([held, np.array(h, dtype=np.int64)]))[:rows]
            return [np.setdiff1d(held, before)]

        return work

    chosen = map_columns(hashes, ["h"], "h long", smallest).distinct().orderBy("h").limit(rows).toArrow()["h"].to_numpy()
    if not len(chosen):
        return []
    texts = df.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")).where(F.col("h") <= int(chosen.max()))

    def start():
        seen: set[int] = set()

        def work(h, t):
            new = [(k, x) for k, x in dict(zip(h, t)).items() if k not in seen]
            seen.update(k for k, _ in new)
            return [[k for k, _ in new], [json.dumps(profile(x, rules)) for _, x in new]]

        return work

    # one row a text: at most ``rows`` rows of a few hundred bytes
    got = map_columns(texts, ["h", "t"], "h long, p string", start).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").toArrow()
    return [Profile(*json.loads(p)) for p in got["p"].to_pylist()]


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, figures: bool = True) -> DataFrame:
    """One row per document: the verdict, the first rule that rejects (else null) and the work that this took.

    With ``figures`` the base figures and base_failed besides, which the cascade alone would not compute for all rows.
    """
    order = [n for n, _ in plan(sampled(df, text, rules), rules)]
    by_name = dict(rules)

    def start():
        cascade = [(n, by_name[n]) for n in order]

        def work(keys, texts):
            rows = []
            for t in texts:
                d = Doc(t)
                no = first_rejection(d, cascade)
                cost = float(sum(d.work.values()))
                rows.append((no is None, no, cost, *((*(getattr(d, f) for f in FIGURES), d.base_failed) if figures else ())))
            return [keys, *map(list, zip(*rows))]

        return work

    more = "".join(f", {f} long" for f in FIGURES) + ", base_failed boolean" if figures else ""
    return map_columns(
        df, [F.col(doc_id).cast("long").alias("doc_id"), text], f"doc_id long, kept boolean, rejected_by string, work double{more}", start
    )
