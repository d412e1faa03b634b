"""Personal data: plain patterns, and a semi-Markov conditional random field beside them.

The patterns find e-mail addresses, IP numbers, card numbers and telephone numbers as
they stand alone. They lose what stands side by side (a telephone number before a card
number is one run of digits too long for either) and what is written otherwise. The
field looks at *islands*, stretches of digits and their marks or of a mail address. It
scores every stretch of an island's units as a whole, by its number of digits, layout,
check digit, octets, marks and neighbours, and finds the best division into entities of
bounded length and single units that belong to none: boundaries and kinds together.
Between islands there is no candidate, so the best division of a text is that of its
islands.

It is trained on the corpus itself: islands of a bounded sample of documents, labelled
by the patterns, as they stand, and rewritten (set side by side, in other layouts, with
a broken check digit or octet) so that the features have to carry the decision.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_AFTER = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Islands: digits with up to three marks between them, and words around an at sign.
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().+/\[\]-]{0,3}[0-9])*+")
AT = re.compile(r"@|\x20?[\[({](?:at|@)[\])}]\x20?", re.IGNORECASE)
AFTER_AT = re.compile(r"\x20?[\w.-]{1,120}(?:\x20?[\[({](?:dot|\.)[\])}]\x20?[\w-]{1,60}){0,4}", re.IGNORECASE)
BRACKETS = ("[]", "()", "{}")
UNIT = re.compile(r"[A-Za-z0-9]+|[^\W_]+|.", re.DOTALL)

#: Entities have at most so many units, words or numbers among them, and digits.
MOST_UNITS = 24
MOST_PIECES = 10
MOST_DIGITS = 19
MAIL_BEFORE = 80
#: Bounds of the training sample: documents looked at, islands learned from, units of one.
TRAIN_DOCS = 4000
TRAIN_ISLANDS = 1500
TRAIN_UNITS = 60
ROUNDS = 60

#: Stands for layouts met once or never, so that what is like nothing learned from is no entity.
NEW_LAYOUT = "layout?"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins where the run of letters before its at sign does."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and EMAIL_BEFORE.match(text, start - 1):
            start -= 1
        end = EMAIL_AFTER.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
        last = end.end() if end else at + 1  # a run before a later sign cannot reach over this one
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind, then place; matches that fail their test are dropped."""
    spans = [(0, *span) for span in _emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.group().split(".")):
            spans.append((1, *match.span()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *match.span()))
    for match in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
            spans.append((3, *match.span()))
    return spans


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches in which entities may lie; they do not overlap."""
    found = [match.span() for match in NUMBERS.finditer(text) if match.end() - match.start() >= 7]
    mails = []
    for match in AT.finditer(text):
        start = match.start()
        while start > 0 and match.start() - start < MAIL_BEFORE and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        after = AFTER_AT.match(text, match.end())
        if start < match.start() and after:
            mails.append((start, after.end()))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found + mails):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def units_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [match.span() for match in UNIT.finditer(text, start, end)]


def candidates(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of units (first, behind the last) that may be an entity.

    They begin with a word, a number, a plus or an opening bracket before a number and
    end with a word or number; they have seven digits, four numbers or an at sign.
    """
    words = [text[s:e] for s, e in units]
    kinds = ["d" if w.isascii() and w.isdigit() else "a" if w.isalnum() else w for w in words]
    spelled = [w.lower() == "at" and "".join(kinds[n - 1 : n + 2 : 2]) in BRACKETS for n, w in enumerate(words)]
    out = []
    for first, kind in enumerate(kinds):
        if kind not in "da+(" or kind in "+(" and (first + 1 == len(kinds) or kinds[first + 1] not in "d("):
            continue
        pieces = digits = numbers = signs = letters = 0
        for last in range(first, min(len(kinds), first + MOST_UNITS)):
            if kinds[last] == "@":
                signs += 1
            if kinds[last] not in "da":
                continue
            pieces += 1
            if kinds[last] == "d":
                numbers, digits = numbers + 1, digits + len(words[last])
            else:
                letters += 1
                signs += last > first and spelled[last]
            if pieces > MOST_PIECES or signs > 1 or not signs and not letters and digits > MOST_DIGITS:
                break
            if signs == 1 and pieces >= 2 and not spelled[last] or not letters and not signs and (digits >= 7 or numbers == 4):
                out.append((first, last + 1))
    return out


def _side(text: str, at: int, step: int) -> str:
    """What stands beside an entity: the next character, and the one behind a mark."""
    if not 0 <= at < len(text):
        return "-"
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c for c in (text[at], text[at + step] if 0 <= at + step < len(text) else " ")]
    return kinds[0] if kinds[0] in "da_" else "".join(kinds)


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span."""
    span = text[start:end]
    before, after = "l" + _side(text, start - 1, -1), "r" + _side(text, end, 1)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    if "@" in span or re.search(r"\[at\]|\(at\)|\{at\}", span, re.IGNORECASE):
        host = re.split(r"@|\[at\]|\(at\)|\{at\}", span, maxsplit=1, flags=re.IGNORECASE)[1].strip()
        parts = re.split(r"\.|\x20?[\[({](?:dot|\.)[\])}]\x20?", host, flags=re.IGNORECASE)
        return [
            "mail", "plain" if "@" in span else "spelled", f"parts{len(parts) > 1}", before, after,
            f"top{parts[-1].isalpha() and 2 <= len(parts[-1]) <= 24}", f"gap{any(not p for p in parts) or ' ' in host.strip()}",
        ]
    runs = re.findall(r"[0-9]+", span)
    digits = "".join(runs)
    layout = re.sub(r"[0-9]+", lambda m: str(len(m.group())), span)
    between = re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span)
    octets = len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs) and all(m.strip(" []") == "." for m in between)
    size = len(digits)
    checked = f"{size if size > 12 else 'few'},{luhn(digits)}"
    return [
        f"n{size}", "layout" + layout, "marks" + marks, f"octets{octets}", "check" + checked, f"check{checked},{len(runs)}",
        f"runs{len(runs)}", before, after, f"sides{before}{after}", f"plus{span[0] == '+'}{7 < size < 16}",
        f"brackets{span.count('(') - span.count(')')}", f"longest{max(map(len, runs))}", f"octets{octets}{before}{after}",
    ]


@dataclass
class Field:
    """Weights of features by kind, and of one label after another (0: none, then the kinds)."""

    weights: dict[str, tuple[float, ...]]
    after: list[list[float]]

    def score(self, found: list[str]) -> list[float]:
        known = [w for f in found if (w := self.weights.get(f) or f.startswith("layout") and self.weights.get(NEW_LAYOUT))]
        return [sum(column) for column in zip(*known, strict=True)] if known else [0.0] * len(KINDS)

    def best(self, text: str, start: int, end: int) -> list[Span]:
        """The entities of the best division of an island."""
        units = units_of(text, start, end)
        ending: dict[int, list[tuple[int, list[float]]]] = {}
        for first, last in candidates(text, units):
            ending.setdefault(last, []).append((first, self.score(features(text, units[first][0], units[last - 1][1]))))
        if not ending:
            return []
        after, none = self.after, float("-inf")
        labels = range(len(KINDS) + 1)
        best = [[0.0] + [none] * len(KINDS)]
        came: list[list[tuple[int, int] | None]] = [[None] * len(labels)]
        entering: list[list[tuple[float, int]]] = []
        for place in range(len(units)):
            entering.append([max((best[place][p] + after[p][label], p) for p in labels) for label in labels])
            row, back = [entering[place][0][0]] + [none] * len(KINDS), [(place, entering[place][0][1])] + [None] * len(KINDS)
            for first, scores in ending.get(place + 1, ()):
                for label in labels[1:]:
                    value, before = entering[first][label]
                    value += scores[label - 1]
                    if value > row[label]:
                        row[label], back[label] = value, (first, before)
            best.append(row)
            came.append(back)
        place, spans = len(units), []
        label = max(labels, key=lambda p: best[place][p])
        while place:
            first, before = came[place][label]
            if label:
                spans.append((label - 1, units[first][0], units[place - 1][1]))
            place, label = first, before
        return spans[::-1]


class Taken:
    """Spans by place; tells which overlap a stretch in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted((start, end) for _, start, end in spans)
        self.starts = [start for start, _ in self.spans]
        self.reach = list(itertools.accumulate((end for _, end in self.spans), max))

    def inside(self, start: int, end: int) -> list[tuple[int, int]]:
        return self.spans[bisect.bisect_right(self.reach, start) : bisect.bisect_left(self.starts, end)]

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def _room_left(text: str, start: int, end: int, inside: list[tuple[int, int]]) -> bool:
    """A candidate may lie in the island beside the spans: four digits or an at sign are left."""
    digits = 0
    for s, e in [*inside, (end, end)]:
        if start < s:
            digits += sum(map(str.isdigit, text[start:s]))
            if digits >= 4 or AT.search(text, start, s):
                return True
        start = max(start, e)
    return False


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those that the field adds where they found nothing."""
    base = base_spans(text)
    taken, added = Taken(base), []
    for start, end in islands(text):
        inside = taken.inside(start, end)
        if not inside or _room_left(text, start, end, inside):
            added += [span for span in field.best(text, start, end) if not taken.overlaps(*span[1:])]
    return base, added


# ---- training ----


@dataclass
class Example:
    """An island in its text, and the entities in it."""

    text: str
    start: int
    end: int
    spans: list[Span]


def logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(values, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.sum(np.exp(values - top), axis=axis))


class Trainer:
    """Likelihood of all examples and its gradient, place by place for all at once."""

    def __init__(self, examples: list[Example]):
        names: dict[str, int] = {}
        rows, found, gold = [], [], []
        divided = [(x, units_of(x.text, x.start, x.end)) for x in examples]
        divided.sort(key=lambda pair: -len(pair[1]))  # those that reach a place are the first ones
        self.lengths = np.array([len(units) for _, units in divided], np.int64)
        steps = np.zeros((len(KINDS) + 1,) * 2)
        for n, (example, units) in enumerate(divided):
            wanted = {(s, e): kind for kind, s, e in example.spans}
            kinds_at: dict[int, tuple[int, int]] = {}
            at: dict[tuple[int, int], int] = {}
            for first, last in candidates(example.text, units):
                place = units[first][0], units[last - 1][1]
                rows.append((n, first, last))
                gold.append(wanted.get(place, -1))
                found.append(features(example.text, *place))
                if gold[-1] >= 0:
                    kinds_at[first] = (gold[-1] + 1, last)
                    gold[-1] = -1
                    at[first, last] = len(gold) - 1
            place = label = 0
            while place < len(units):
                following, end = kinds_at.get(place, (0, place + 1))
                if following:
                    gold[at[place, end]] = following - 1
                steps[label, following] += 1
                label, place = following, end
        met = Counter(f for row in found for f in row)
        common = lambda f: NEW_LAYOUT if f.startswith("layout") and met[f] == 1 else f
        found = [[names.setdefault(common(f), len(names)) for f in row] for row in found]
        self.names, self.steps = names, steps
        self.n, self.first, self.last = (np.array(part, np.int64) for part in (zip(*rows, strict=True) if rows else ([], [], [])))
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.flat = np.array([f for row in found for f in row], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.seen = self._counts(np.array(gold)[:, None] == np.arange(len(KINDS))) if rows else np.zeros((0, len(KINDS)))
        most = int(self.lengths.max(initial=0))
        self.by_last = [np.flatnonzero(self.last == place) for place in range(most + 1)]
        self.by_first = [np.flatnonzero(self.first == place) for place in range(most + 1)]

    def _counts(self, weight: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.flat, np.repeat(weight[:, k], self.sizes), len(self.names)) for k in range(len(KINDS))], 1)

    def likelihood(self, weights: np.ndarray, after: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, and the gradients of weights and label steps."""
        rows, most, labels = len(self.lengths), int(self.lengths.max(initial=0)), len(KINDS) + 1
        score = np.add.reduceat(weights[self.flat], self.begin, axis=0) if len(self.flat) else np.zeros((0, len(KINDS)))
        kinds = np.arange(1, labels)[None, :]
        ahead = np.full((rows, most + 1, labels), -np.inf)
        ahead[:, 0, 0] = 0
        enter = np.full((rows, most + 1, labels), -np.inf)
        for place in range(most + 1):
            if place:
                ahead[:, place, 0] = enter[:, place - 1, 0]
                use = self.by_last[place]
                np.logaddexp.at(ahead, (self.n[use][:, None], place, kinds), enter[self.n[use], self.first[use], 1:] + score[use])
            live = int(np.searchsorted(-self.lengths, -place, "right"))
            enter[:live, place] = logsum(ahead[:live, place, :, None] + after[None], 1)
        whole = logsum(ahead[np.arange(rows), self.lengths], 1)
        behind = np.full((rows, most + 2, labels), -np.inf)
        for place in range(most, -1, -1):
            live = int(np.searchsorted(-self.lengths, -place, "right"))
            leave = np.full((live, labels), -np.inf)
            leave[:, 0] = behind[:live, place + 1, 0]
            use = self.by_first[place]
            np.logaddexp.at(leave, (self.n[use][:, None], kinds), score[use] + behind[self.n[use], self.last[use], 1:])
            behind[:live, place] = logsum(after[None] + leave[:, None, :], 2)
            behind[self.lengths == place, place] = 0
        rest = score + behind[self.n, self.last, 1:] - whole[self.n][:, None]
        expected = self._counts(np.exp(enter[self.n, self.first, 1:] + rest))
        moved = np.zeros((labels, labels))
        inside = np.arange(most)[None, :] < self.lengths[:, None]
        none = np.exp(ahead[:, :most] + after[:, 0] + behind[:, 1 : most + 1, :1] - whole[:, None, None])
        moved[:, 0] = np.sum(np.where(inside[:, :, None], none, 0), axis=(0, 1))
        moved[:, 1:] = np.sum(np.exp(ahead[self.n, self.first][:, :, None] + after[None, :, 1:] + rest[:, None, :]), axis=0)
        value = float(np.sum(weights * self.seen) + np.sum(after * self.steps) - np.sum(whole))
        return value, self.seen - expected, self.steps - moved

    def fit(self, rounds: int = ROUNDS, ridge: float = 0.02, rate: float = 0.25) -> Field:
        """Weights of greatest likelihood under a ridge, by gradient steps scaled per weight."""
        weights, after = np.zeros((len(self.names), len(KINDS))), np.zeros((len(KINDS) + 1,) * 2)
        state = [[np.zeros_like(weights), np.zeros_like(after)] for _ in range(2)]
        for n in range(1, rounds + 1):
            _, *gradients = self.likelihood(weights, after)
            for k, (part, gradient) in enumerate(zip((weights, after), gradients, strict=True)):
                gradient = gradient - ridge * part
                state[0][k] = 0.9 * state[0][k] + 0.1 * gradient
                state[1][k] = 0.99 * state[1][k] + 0.01 * gradient**2
                part += rate * (state[0][k] / (1 - 0.9**n)) / (np.sqrt(state[1][k] / (1 - 0.99**n)) + 1e-6)
        return Field({name: tuple(weights[n].tolist()) for name, n in self.names.items()}, after.tolist())


def _with_check(body: str, good: bool) -> str:
    """Digits with a last one that passes the card test, or does not."""
    last = next(d for d in "0123456789" if luhn(body + d))
    return body + (last if good else str((int(last) + 1) % 10))


def _rewritten(kind: int, span: str, rng: random.Random) -> tuple[str, bool]:
    """A finding in another layout, or made into something that is none."""
    digits = "".join(c for c in span if c.isdigit())
    good = rng.random() < 0.6
    if kind == 0:
        local, host = span.split("@", 1)
        if good:
            dot = rng.choice([".", " [dot] ", "(dot)"])
            return local + rng.choice(["(at)", " [at] ", "[at]", "@"]) + host.replace(".", dot), True
        return rng.choice([f"{local}@{host.split('.')[0]}", f"{local}(at) the"]), False
    if kind == 1:
        parts = span.split(".")
        if good:
            return rng.choice([".", "[.]", " . "]).join(parts), True
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        decimals = f"{parts[0]}.{rng.randrange(99)} {parts[1]}.{rng.randrange(99)}"
        return rng.choice([".".join(parts), ".".join(parts), f"{parts[0]}.{parts[1]}.{rng.randrange(1000, 99999)}", decimals]), False
    if kind == 2:
        first = rng.choice(["34", "37"]) if rng.random() < 0.4 else rng.choice("456")
        size = 15 if len(first) == 2 else 16
        number = _with_check(first + "".join(rng.choices("0123456789", k=size - 1 - len(first))), good)
        cuts = (4, 10) if size == 15 else (4, 8, 12)
        mark = rng.choice(["", " ", "-", "."]) if good or rng.random() < 0.5 else ""
        return mark.join(number[a:b] for a, b in zip((0, *cuts), (*cuts, size), strict=True)), good
    body = "".join(rng.choices("23456789", k=1) + rng.choices("0123456789", k=9))
    area, middle, last = body[:3], body[3:6], body[6:]
    if good:
        country = rng.choice(["", "", f"+{rng.randint(1, 99)} "])
        return country + rng.choice([f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}"]), True
    year, clock = rng.randint(1900, 2099), f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}"
    return rng.choice([
        f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {clock}:{body[:1]}0", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year} {clock}",
        f"{area} {middle} 000", f"{body[0]} {area} {middle}", f"{year}-{year + 1} {year + 2}-{year + 3}", f"{area}, {middle} {last}",
        body, digits[-7:], f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{year}-{year + 5}", f"({area}) {middle}",
        f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{year}", f"{area}.{middle} {last}.{area}", f"978-{area}-{last}-{middle[0]}",
    ]), False


def examples_from(found: Iterable[tuple[str, int, int]], rng: random.Random) -> list[Example]:
    """Islands as they stand and rewritten; ``found`` holds (text, start, end) of islands.

    An island with a stretch that the patterns miss as it stands but would find alone is
    no example of either.
    """
    out, seen = [], []
    for text, start, end in found:
        spans = [span for span in base_spans(text) if start <= span[1] and span[2] <= end]
        taken, units = Taken(spans), units_of(text, start, end)
        stretches = [(units[first][0], units[last - 1][1]) for first, last in candidates(text, units)]
        if any((0, e - s) in [b[1:] for b in base_spans(text[s:e])] for s, e in stretches if not taken.overlaps(s, e)):
            continue
        out.append(Example(text, start, end, spans))
        seen += [(kind, text[s:e], text[:start], text[end:]) for kind, s, e in spans]
    for kind, span, left, right in seen:
        for _ in range(2):
            parts = [(kind, *_rewritten(kind, span, rng))]
            while rng.random() < 0.45 and kind:
                other = rng.choice(seen)
                if not other[0]:
                    break
                parts.append((other[0], other[1], True) if rng.random() < 0.5 else (other[0], *_rewritten(other[0], other[1], rng)))
            if rng.random() < 0.2:
                left, right = rng.choice([("", right), (left, ""), ("", "")])
            line, spans = left, []
            for n, (its, shown, good) in enumerate(parts):
                line += " " if n else ""
                spans += [(its, len(line), len(line) + len(shown))] if good else []
                line += shown
            for s, e in islands(line + right):
                if s < len(line) and e > len(left):
                    inside = [span for span in spans if s <= span[1] and span[2] <= e]
                    out.append(Example(line + right, s, e, inside))
    return out


def train(found: list[tuple[str, int, int]], seed: int = 12) -> Field:
    """A field from islands of texts. Islands without any finding of the patterns teach nothing:
    then no weight is known, every entity scores 0, and ``Field`` is made to add none."""
    examples = [x for x in examples_from(found, random.Random(seed)) if len(units_of(x.text, x.start, x.end)) <= TRAIN_UNITS]
    if not any(x.spans for x in examples):
        return Field({}, [[0.0] + [-1e9] * len(KINDS) for _ in range(len(KINDS) + 1)])
    return Trainer(examples).fit()


CONTEXT = 12


def train_on(docs: DataFrame, text_col: str = "text") -> Field:
    """A field from a sample of the documents: about TRAIN_DOCS of them, chosen by hash, and of
    their islands the TRAIN_ISLANDS of least hash. Null texts have none. The same table gives the
    same field, however it is partitioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for text in batch.column(0).to_pylist():
                for start, end in islands(text):
                    s, e = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
                    if e - s < 400:
                        key = hashlib.blake2b(text[s:e].encode(), digest_size=8).digest()
                        rows[int.from_bytes(key, "little", signed=True)] = (text[s:e], start - s, end - s)
            columns = [list(rows), *(zip(*rows.values(), strict=True) if rows else ([], [], []))]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "text", "start", "end"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(*docs.columns).alias("key")).where("text is not null")
    share = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    chosen = texts.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = chosen.mapInArrow(run, "key long, text string, start int, end int").distinct().orderBy("key").limit(TRAIN_ISLANDS)
    return train([(r.text, r.start, r.end) for r in found.collect()])


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: (kind, start, end, base) in code points, by kind, then start.

    ``base`` spans are the patterns'; the others are the field's and overlap none of them.
    A null or empty text has no spans. Repeated rows and ids keep their rows; columns other
    than the two named are not read. Texts are read whole; work and memory are in proportion
    to their length.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = spans_of(text or "", field)
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
