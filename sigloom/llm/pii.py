"""Personal data: strict base patterns, and more spans by a semi-Markov random field.

Base kinds (email, ip, card, phone) are found by pattern and check.  Around every digit or
at sign the text is cut into tokens, and a semi-Markov conditional random field scores whole
candidate segments: what the span as a whole holds (digits, separators, shape, checksum) and
what stands beside it.  Dynamic programming over segments of at most ``MOST_TOKENS`` tokens
jointly chooses boundaries and types.  Weights are trained here, by the likelihood gradient,
on a bounded sample of texts whose labels are the base spans, some of them rewritten the way
people write them otherwise (a phone number without its plus, a card number in groups), so
that the field learns spans the patterns miss.  Its spans are added where no base span is.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import slices, with_text

Span = tuple[str, int, int]
Weights = dict[tuple[str, str], float]

#: Base kinds in the order in which they are listed; they are also the field's types.
KINDS = ("email", "ip", "card", "phone")
OTHER = "-"
#: Tokens and characters of a segment, at most; the longest address has 64, a sign and 255.
MOST_TOKENS, MOST_LENGTH = 18, 320
#: The training sample: texts read, islands used of them and their length at most, passes over these.
SAMPLE_DOCS, SAMPLE_ISLANDS, SAMPLE_LENGTH, PASSES = 6_000, 600, 200, 3
#: Rewritten copies of an island with spans that are trained on beside it; one without has one, with a stray at sign.
REWRITES = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def emails(text: str) -> list[Span]:
    """Leftmost matches of a local part, an at sign and a dotted domain, found from the at signs.

    The local part is what stands before the sign back to the last match, in linear time.
    """
    found: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[Span]:
    """The base matches that hold, by start and then kind."""
    found = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = digits_of(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every digit and at sign, each with a word to either side."""
    spans: list[list[int]] = []
    done = 0
    while m := _TRIGGER.search(text, done):
        start = m.start()
        floor = spans[-1][1] if spans else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        end_m = _SPACE.search(text, m.end())
        end = end_m.start() if end_m else len(text)
        if spans and start - spans[-1][1] <= 1:
            spans[-1][1] = end
        else:
            spans.append([start, end])
        done = end
    out: list[tuple[int, int]] = []
    for s, e in spans:
        left = max(text.rfind(" ", 0, max(0, s - 1)), s - 24, out[-1][1] if out else 0, 0)
        right = text.find(" ", e + 1, e + 24)
        out.append((left, right if right >= 0 else min(len(text), e + 24)))
    merged: list[tuple[int, int]] = []
    for s, e in out:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


class Measures:
    """Running sums over a stretch's tokens, from which any segment's features follow without walking it."""

    COUNTED = ("0123456789", "@", ".", " ", "-", "(")

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        words = [text[s:e] for s, e in tokens]
        self.shapes = [("9" * min(len(w), 4) + "+" * (len(w) > 4)) if "0" <= w[0] <= "9" else "a" if w[0].isascii() and w[0].isalpha() else w for w in words]
        runs = [[len(w) * ("0" <= w[0] <= "9") for w in words], *([w.count(c) for w in words] for c in self.COUNTED[1:]), [any(map(str.isalpha, w)) for w in words]]
        self.sums = [[0, *accumulate(run)] for run in runs]

    def counts(self, i: int, j: int) -> list[int]:
        """Digits, at signs, dots, spaces, dashes, parentheses and words with letters in tokens i to j."""
        return [run[j] - run[i] for run in self.sums]

    def features(self, i: int, j: int, before: str, after: str) -> list[str]:
        """What a candidate span holds as a whole, and its neighbours' kinds."""
        text = self.text[self.tokens[i][0] : self.tokens[j - 1][1]]
        n, at, dots, spaces, dashes, parens, letters = self.counts(i, j)
        size = str(n) if n < 17 else "17+"
        out = ["bias", "digits=" + size, "shape=" + "".join(self.shapes[i:j]), "at=%d" % at, "dots=%d" % min(dots, 4), "first=" + _side(text[0]), "last=" + _side(text[-1]), "left=" + _side(before), "right=" + _side(after), "letters=%d" % (letters > 0), "space=%d" % (spaces > 0), "space+dot=%d%d" % (spaces > 0, dots > 0), "dash=%d" % (dashes > 0), "paren=%d" % (parens > 0)]
        if 12 <= n <= 19:
            out.append("luhn=%d" % luhn(digits_of(text)))
        if dots == 3 and all(x.isdecimal() for x in text.split(".")):
            out.append("octets=%d" % all(map(octet, text.split("."))))
        return out


def lattice(text: str, before: str, after: str) -> tuple[list[tuple[int, int]], Iterator[tuple[int, int, str, list[str]]]]:
    """Tokens, and the candidate segments (first token, past token, type, features) by first token.

    One token alone may be of no type.  A span of a type begins with a digit, letter, plus or
    parenthesis and ends with a digit or letter; an ip, card or phone holds two digits, an
    email one at sign or two digits, and with one at sign its letters may be of any script.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    held = Measures(text, tokens)
    digits, signs = held.sums[0], held.sums[1]

    def segments() -> Iterator[tuple[int, int, str, list[str]]]:
        for i, (s, e) in enumerate(tokens):
            own = text[s:e]
            left = text[s - 1] if s else before
            right = text[e] if e < len(text) else after
            yield i, i + 1, OTHER, ["token=" + (own if not own.isalnum() else "9" * min(len(own), 5) if own[0].isdigit() else "a"), "oleft=" + _side(left), "oright=" + _side(right)]
            plain = own[0].isascii() and own[0].isalnum() or own in "+("
            if not (plain or own[0].isalpha()):
                continue
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                at, end = tokens[j - 1]
                if end - s > MOST_LENGTH or text[at].isspace() and "\n" in text[at:end]:
                    break
                ascii_end = text[end - 1].isascii() and text[end - 1].isalnum()
                if not (ascii_end or text[end - 1].isalpha()):
                    continue
                numeric = plain and ascii_end and digits[j] - digits[i] >= 2
                if not (numeric or signs[j] - signs[i] == 1):
                    continue
                features = held.features(i, j, left, text[end] if end < len(text) else after)
                for kind in KINDS if numeric else ("email",):
                    yield i, j, kind, features

    return tokens, segments()


def _score(weights: Weights, kind: str, features: list[str]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in features)


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def gradient(weights: Weights, n: int, segments: list, gold: set[tuple[int, int, str]]) -> dict[tuple[str, str], float]:
    """Observed minus expected features of one island, by forward and backward sums over segments."""
    scores = [_score(weights, kind, f) for _, _, kind, f in segments]
    ends: dict[int, list[int]] = defaultdict(list)
    starts: dict[int, list[int]] = defaultdict(list)
    for k, (i, j, _, _) in enumerate(segments):
        ends[j].append(k)
        starts[i].append(k)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[segments[k][0]] + scores[k] for k in ends[j]])
    for i in range(n - 1, -1, -1):
        behind[i] = _log_sum([behind[segments[k][1]] + scores[k] for k in starts[i]])
    out: dict[tuple[str, str], float] = defaultdict(float)
    for (i, j, kind, features), score in zip(segments, scores, strict=True):
        change = ((i, j, kind) in gold) - math.exp(ahead[i] + score + behind[j] - ahead[n])
        if abs(change) > 1e-4:
            for f in features:
                out[kind, f] += change
    return out


def best(weights: Weights, n: int, segments: Iterable) -> list[tuple[int, int, str]]:
    """The highest-scoring segmentation, by dynamic programming; ``segments`` come by first token.

    A segment is scored as it comes and only the best one to each end is held, so memory
    grows with the tokens, not with the candidates.
    """
    top: list[tuple[float, tuple[int, int, str] | None]] = [(0.0, None)] + [(-math.inf, None)] * n
    for i, j, kind, features in segments:
        value = top[i][0] + _score(weights, kind, features)
        if value > top[j][0]:
            top[j] = (value, (i, j, kind))
    out = []
    j = n
    while j:
        seg = top[j][1]
        out.append(seg)
        j = seg[0]
    return out[::-1]


def rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The island with some spans as people write them otherwise, and where these now are."""
    out, new, at = "", [], 0
    for kind, s, e in spans:
        out += text[at:s]
        body = text[s:e]
        if kind == "phone" and rng.random() < 0.5:
            body = body.lstrip("+")
        elif kind == "card" and body.isdigit() and rng.random() < 0.4:
            gap = rng.choice(" -")
            body = gap.join(body[k : k + 4] for k in range(0, len(body), 4))
        elif kind == "email" and rng.random() < 0.5:
            name, host = _DIGIT.sub("", body).split("@")
            if name.strip("._%+-") and host.strip(".-"):
                name, host = name.strip("._%+-"), host.strip(".-")
                if len(name) > 3 and rng.random() < 0.5:
                    cut = rng.randrange(1, len(name))
                    name = name[:cut] + rng.choice("._-+") + name[cut:]
                body = rng.choice((f"{name}@{host}", f"{name} @ {host}", f"{name}@{host.split('.')[0]}", f"{name}é@{host}"))
        new.append((kind, len(out), len(out) + len(body)))
        out += body
        at = e
    return out + text[at:], new


def with_sign(text: str, rng: random.Random) -> str:
    """The island with an at sign between two of its words, which is no address."""
    gaps = [m.start() for m in re.finditer(r"(?<=[0-9A-Za-z]) (?=[A-Za-z])", text)]
    if not gaps:
        return text
    at = rng.choice(gaps)
    return text[:at] + " @" + text[at:]


def train(samples: list[tuple[str, list[Span]]], passes: int = PASSES, rate: float = 0.5, seed: int = 1) -> Weights:
    """Weights of the field by adaptive gradient steps; samples are islands with their spans."""
    rng = random.Random(seed)
    weights: Weights = {}
    squares: dict[tuple[str, str], float] = defaultdict(float)
    ready = []
    for text, spans in samples:
        others = [rewritten(text, spans, rng) for _ in range(REWRITES)] if spans else [(with_sign(text, rng), spans)]
        for t, sp in [(text, spans), *others]:
            tokens, found = lattice(t, "", "")
            segments = list(found)
            first, past = {s: k for k, (s, _) in enumerate(tokens)}, {e: k + 1 for k, (_, e) in enumerate(tokens)}
            gold = {(first[s], past[e], kind) for kind, s, e in sp if s in first and e in past}
            if len(gold) < len(sp) or any(j - i > MOST_TOKENS for i, j, _ in gold):
                continue
            inside = {k for i, j, _ in gold for k in range(i, j)}
            gold |= {(k, k + 1, OTHER) for k in range(len(tokens)) if k not in inside}
            if tokens:
                ready.append((len(tokens), segments, gold))
    for _ in range(passes):
        rng.shuffle(ready)
        for n, segments, gold in ready:
            for key, change in gradient(weights, n, segments, gold).items():
                squares[key] += change * change
                weights[key] = weights.get(key, 0.0) + rate * change / math.sqrt(1e-8 + squares[key])
    return weights


def clashing(spans: list[Span]) -> bool:
    ordered = sorted(spans, key=lambda x: x[1])
    return any(b[1] < a[2] for a, b in zip(ordered, ordered[1:], strict=False))


class Touching:
    """Spans that overlap a stretch, found without walking those before it."""

    def __init__(self, spans: list[Span]):
        self.spans = spans  # by start
        self.starts = [s for _, s, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def __call__(self, start: int, end: int) -> list[Span]:
        out = []
        k = bisect_left(self.starts, end)
        while k and self.reach[k - 1] > start:
            k -= 1
            if self.spans[k][2] > start:
                out.append(self.spans[k])
        return out[::-1]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Islands of up to ``SAMPLE_LENGTH`` characters with the base spans in them, for training."""
    for whole in batches:
        for batch in slices(whole):
            texts, spans = [], []
            for text in batch.column("text").to_pylist():
                near = Touching(base_spans(text))
                for s, e in islands(text):
                    if e - s > SAMPLE_LENGTH:
                        continue
                    touching = near(s, e)
                    own = [(k, a - s, b - s) for k, a, b in touching if s <= a and b <= e]
                    if len(own) == len(touching) and not clashing(own):
                        texts.append(text[s:e])
                        spans.append(listed(own))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["island", "spans"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_islands: int = SAMPLE_ISLANDS) -> Weights:
    """Trains on the islands of the ``sample_docs`` rows whose id hashes lowest; these bounds are parameters, and training alone is bounded."""
    drawn = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = with_text(docs, "doc_id").join(F.broadcast(drawn), "doc_id", "left_semi")
    found = rows.mapInArrow(_sample_rows, "island string, spans string").orderBy(F.xxhash64("island"), "spans").limit(sample_islands).collect()
    parsed = [(r["island"], [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in found]
    return train(parsed)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """The field's spans that overlap no base span."""
    out = []
    near = Touching(base)
    for s, e in islands(text):
        tokens, segments = lattice(text[s:e], text[s - 1 : s], text[e : e + 1])
        for i, j, kind in best(weights, len(tokens), segments):
            if kind != OTHER:
                a, b = s + tokens[i][0], s + tokens[j - 1][1]
                if not near(a, b):
                    out.append((kind, a, b))
    return out


def _find_rows(weights: Weights):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                cols: list[list] = [[] for _ in range(6)]
                for text in batch.column("text").to_pylist():
                    base = base_spans(text)
                    spans = sorted([*base, *added_spans(text, base, weights)], key=lambda x: (x[1], KINDS.index(x[0])))
                    row = (*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows


def find_personal_data(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the base spans; ``spans`` has the field's too.  Spans are
    ``kind:start:end`` in code points, end exclusive, by start and then kind.  Texts of any
    length are scanned whole; time grows with their length.  Null texts count
    as empty and give no spans; repeated rows are scanned alike.  An empty table gives an empty
    result (and an untrained field).  Other columns are not read.
    """
    weights = fit(docs) if weights is None else weights
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return with_text(docs, "doc_id").mapInArrow(_find_rows(weights), shape)
