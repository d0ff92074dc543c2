"""License notices by templates with optional and replaceable regions.

A template is a text with ``[[optional words]]`` and ``{{n}}``, a place for up to n words of any kind. It is
compiled into an automaton over words (lower-cased A-Z, digits, non-ASCII). A place of a text is accepted
when all mandatory words stand there exactly and in order; optional regions may be present as written or be
missing as a whole. Of overlapping places of one template the first counts, as long as it can be. Base phrases are found
beside the templates and their labels always stay. The templates are in ``license_templates``; others can be given.

Templates are tried only where their longest run of fixed words stands, and only in texts that have one of ``KEYS``,
which every template's mandatory wording has; so most texts cost a few searches. Null and empty texts have no words; very long
texts are taken whole. Nothing depends on other rows, so repeated rows give repeated results; without documents there is no
row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, map_columns
from .license_templates import TEMPLATES

#: fixed values: base phrases and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: one of these is part of every template's mandatory wording
KEYS = (b"licens", b"permi", b"copyright", b"redistribut", b"commons", b"warrant", b"reserved", b"public domain", b"damage", b"cc0", b" clause ", b"software")

class Template:
    """Automaton over words. State i stands before token i; optional regions are jumps, free places are loops."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.tokens: list[bytes | int] = []
        self.jumps: dict[int, list[int]] = {}
        self.mandatory = 0
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(len(self.tokens))
            elif part == "]]":
                self.jumps.setdefault(opened.pop(), []).append(len(self.tokens))
            elif part.startswith("{{"):
                self.tokens.append(int(part[2:-2]))
            else:
                words = part.encode().translate(ALNUM).split()
                self.tokens += words
                self.mandatory += 0 if opened else len(words)
        if opened:
            raise ValueError(f"an optional region of {label} has no end")
        self.accept = len(self.tokens)
        #: mandatory words before the first region that may vary, by which places are found
        run: list[bytes] = []
        depth = 0
        best: tuple[int, list[bytes], int] = (0, [], 0)
        regions = sorted((a, b) for a, bs in self.jumps.items() for b in bs)
        for i, t in enumerate([*self.tokens, 0]):
            inside = any(a <= i < b for a, b in regions)
            if isinstance(t, bytes) and not inside:
                if not run:
                    depth = i
                run.append(t)
            else:
                if len(run) > best[0]:
                    best = (len(run), run, depth)
                run = []
        self.lead = best[2]
        self.anchor = b" " + b" ".join(best[1]) + b" "
        self.reach = sum(t if isinstance(t, int) else 1 for t in self.tokens[: self.lead])

    def _closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo = list(states)
        while todo:
            i, used = todo.pop()
            # a region that has begun with a free place can no longer be left out
            skips = self.jumps.get(i, ()) if not used else ()
            for j in [*skips, *([i + 1] if i < self.accept and isinstance(self.tokens[i], int) else [])]:
                if (j, 0) not in states:
                    states.add((j, 0))
                    todo.append((j, 0))
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest acceptance from ``start`` on, or None."""
        states = self._closed({(0, 0)})
        end = start if (self.accept, 0) in states else None
        for k in range(start, len(words)):
            w = words[k]
            after: set[tuple[int, int]] = set()
            for i, used in states:
                if i == self.accept:
                    continue
                t = self.tokens[i]
                if isinstance(t, int):
                    if used < t:
                        after.add((i, used + 1))
                elif t == w:
                    after.add((i + 1, 0))
            if not after:
                break
            states = self._closed(after)
            if (self.accept, 0) in states:
                end = k + 1
        return end


COMPILED = tuple(Template(*t) for t in TEMPLATES)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which ``phrase`` (with a space on both sides) begins in ``line`` (likewise)."""
    out = []
    at, done, words = line.find(phrase), 0, 0
    while at >= 0:
        words += line.count(b" ", done, at)
        done = at
        out.append(words)
        at = line.find(phrase, at + 1)
    return out


def scan(text: str | None, templates=COMPILED, keys=KEYS):
    """n_words, n_base, first_word, last_word, base_labels, labels, score, notices (label, start, end)."""
    words = (text or "").encode("utf-8").translate(ALNUM).split()
    line = b" " + b" ".join(words) + b" "
    n_base, first, last, base = 0, None, None, set()
    for phrase, label in PHRASES:
        at = places(line, b" " + phrase.encode() + b" ")
        if at:
            n_base += len(at)
            base.add(label)
            first = at[0] if first is None else min(first, at[0])
            last = at[-1] if last is None else max(last, at[-1])
    notices, score = [], 0.6 if base else 0.0
    for t in templates if any(k in line for k in keys) else ():
        if t.anchor not in line:
            continue
        seen = -1
        for at in places(line, t.anchor):
            for start in range(max(0, seen, at - t.reach), at + 1):
                end = t.match(words, start)
                if end is not None and end > at:
                    notices.append((t.label, start, end))
                    seen = end
                    score = max(score, 1 - 1 / (1 + t.mandatory))
                    break
    labels = base | {n[0] for n in notices}
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(set(notices), key=lambda n: (n[1], n[2], n[0]))


def find_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base places, labels of base phrases and of templates, a score and the notices."""

    def start():
        def work(keys, texts):
            rows = [scan(t) for t in texts]
            cols = list(map(list, zip(*rows)))
            cols[-1] = [[dict(zip(("label", "start", "end"), n)) for n in x] for x in cols[-1]]
            return [keys, *cols]

        return work

    return map_columns(
        df,
        [F.col(doc_id).cast("long").alias("doc_id"), text],
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, notices array<struct<label:string,start:long,end:long>>",
        start,
    )
