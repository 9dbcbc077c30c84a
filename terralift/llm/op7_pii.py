"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans to them.

The patterns give the base spans of each kind. The tagger is trained in numpy on windows with labelled spans: windows
around digits and at-signs of a bounded sample of documents, labelled by the patterns, and the same windows with
invented items of many written forms put in. Every span of any kind holds a digit or an at-sign, so the tagger reads all places within
``REACH`` code points of one, in overlapping windows; scores of places that several windows see are blended by their
distance to the window's edge, and each connected stretch is decoded as one sequence. An added span must touch no base
span and hold what its kind requires.

Cases: null and empty texts have no spans; a sample without digits still trains on invented items; repeated rows are
searched each; other columns are ignored unless kept; an empty table gives no rows. All searches for base spans take
linear time, in long runs of digits or dots too.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.llm.common import map_text
from terralift.llm.tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 1200
SAMPLE_PIECES = 3600
TRAIN_STEPS = 260
TRAIN_WINDOW = 64
WINDOW, STRIDE, REACH = 128, 64, 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
WHOLE = {
    "email": re.compile(r"[^\s@<>()\[\],;:\"]+@[^\s@<>()\[\],;:\"]+\.[^\s@<>()\[\],;:\".]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .\-/]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().\-/]+[0-9]"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that don't overlap within a kind, without those that fail the kind's check."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append(("email", a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGITS.search(text):
        return found
    runs = [m.span() for m in DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        if all(runs[k + 1][0] == runs[k][1] + 1 and text[runs[k][1]] == "." for k in (i, i + 1, i + 2)):
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in runs[i : i + 4]):
                found.append(("ip", runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def sound(kind: str, piece: str) -> bool:
    """Whether a piece of text can be an added item of its kind."""
    if not WHOLE[kind].fullmatch(piece):
        return False
    d = _digits(piece)
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15 and len(d) < len(piece) and not re.search(r"[0-9]{9}", piece)
    return True


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    """0 outside; 2k+1 at the first and 2k+2 at further places of kind k."""
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        a, cut = max(a, 0), a < 0
        y[a:b] = 2 * k + 2
        if not cut and a < length:
            y[a] = 2 * k + 1
    return y


def invented(draw: random.Random) -> Span | tuple[str, str]:
    """A kind and an item of it in one of many written forms."""
    kind = draw.choice(KINDS)
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(a, b)))
    if kind == "email":
        name = draw.choice(["", word(2, 6) + draw.choice("._-+")]) + word(2, 8) + draw.choice(["", "." + digit(2), digit(1)])
        return kind, f"{name}@{word(2, 7)}{draw.choice(['', digit(1), '-' + word(2, 4)])}.{draw.choice(['com', 'org', 'net', 'de', 'co.uk', 'example.com'])}"
    if kind == "ip":
        return kind, ".".join(str(draw.randint(1, 255)) for _ in range(4))
    if kind == "card":
        body = draw.choice("3456") + digit(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return kind, draw.choice(["", "", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digit(3), digit(3), digit(4)
    return kind, draw.choice([f"+1 ({a}) {b}-{c}", f"+{digit(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digit(2)}{a}{b}{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"])


def decoy(draw: random.Random) -> str:
    """Text with digits that is no personal data."""
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    return draw.choice([f"version {digit(1)}.{digit(1)}", f"{digit(1)}.{digit(1)}.{digit(2)}", f"20{digit(2)}-0{digit(1)}-1{digit(1)}", f"password={hexes(18)}", f"token={hexes(40)}", "AKIA" + hexes(16).upper(), digit(draw.randint(1, 7)), f"{digit(2)}%", f"${digit(3)},{digit(3)}.{digit(2)}", f"{digit(2)}:{digit(2)}", f"#{digit(4)}", f"p. {digit(2)}-{digit(3)}", digit(draw.randint(20, 30)), f"{digit(16)[:15]}x"])


def training_windows(contexts: list[str], number: int = 1600, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags from texts around digits: as they are, with an invented item, or with a decoy."""
    draw = random.Random(seed)
    contexts = [c for c in contexts if c.strip()] or ["the quick brown fox jumps over the lazy dog and runs on for a while, then rests. " * 2]
    x, y = np.zeros((number, TRAIN_WINDOW), np.int64), np.zeros((number, TRAIN_WINDOW), np.int64)
    for i in range(number):
        text = draw.choice(contexts)
        spans = base_spans(text)
        form = i % 4
        if form:
            at = draw.choice([m.start() for m in re.finditer(r"(?<=\s)", text)] or [0])
            if any(a < at < b for _, a, b in spans):
                at = spans[0][1]
            kind, item = (None, decoy(draw)) if form == 3 else invented(draw)
            item += draw.choice([" ", " ", ", ", ". ", "\n", "; "])
            tail = len(item)
            spans = [(k, a, b) if b <= at else (k, a + tail, b + tail) for k, a, b in spans if b <= at or a >= at]
            if kind:
                spans.append((kind, at, at + len(item.rstrip(" ,.\n;"))))
            text = text[:at] + item + text[at:]
            middle = at + len(item) // 2
        else:
            middle = draw.choice([m.start() for m in ANCHOR.finditer(text)] or [len(text) // 2])
        first = middle - draw.randint(8, TRAIN_WINDOW - 8)
        first = max(0, min(first, len(text) - TRAIN_WINDOW))
        part = symbols(text[first : first + TRAIN_WINDOW])
        x[i, : len(part)] = part
        y[i, : len(part)] = tags_of([(k, a - first, b - first) for k, a, b in spans if b > first and a < first + TRAIN_WINDOW], len(part))
    return x, y


def stretches(text: str) -> list[tuple[int, int]]:
    """Connected stretches of places within ``REACH`` of a digit or at-sign."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: How far a window's word counts at each of its places: little at the edges.
TRUST = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)


def blended(model: Tagger, pieces: list[str]) -> list[np.ndarray]:
    """Scores (length, tags) of whole stretches, blended over overlapping windows."""
    windows, place = [], []
    for p, piece in enumerate(pieces):
        s = symbols(piece)
        for at in range(0, max(1, len(s) - WINDOW + STRIDE), STRIDE):
            part = np.zeros(WINDOW, np.int64)
            got = s[at : at + WINDOW]
            part[: len(got)] = got
            windows.append(part)
            place.append((p, at, len(got)))
    total = [np.zeros((len(p), model.tags), np.float32) for p in pieces]
    weight = [np.zeros((len(p), 1), np.float32) for p in pieces]
    for i in range(0, len(windows), 512):
        scores = model.emissions(np.array(windows[i : i + 512]).T)
        for k, (p, at, n) in enumerate(place[i : i + 512]):
            trust = TRUST[:n, None]
            total[p][at : at + n] += scores[:n, k] * trust
            weight[p][at : at + n] += trust
    return [t / w for t, w in zip(total, weight, strict=True)]


def tagged(model: Tagger, pieces: list[str]) -> list[list[Span]]:
    """Spans of each stretch: one best sequence over all of it."""
    scores = blended(model, pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    found: list[list[Span]] = [[] for _ in pieces]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 256 and len(pieces[order[to]]) <= 1.3 * len(pieces[order[at]]) + 16:
            to += 1
        ids = order[at:to]
        lengths = np.array([len(pieces[i]) for i in ids])
        block = np.zeros((lengths.max(), len(ids), model.tags), np.float32)
        for k, i in enumerate(ids):
            block[: lengths[k], k] = scores[i]
        tags = model.decode(block, lengths)
        for k, i in enumerate(ids):
            found[i] = spans_of(tags[: lengths[k], k])
        at = to
    return found


def spans_of(tags: np.ndarray) -> list[Span]:
    """Runs of one kind; a first-place tag starts a new run."""
    out: list[Span] = []
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    start = (kind > 0) & ((np.concatenate([[0], kind[:-1]]) != kind) | (tags % 2 == 1))
    for a in np.flatnonzero(start):
        b = a + 1
        while b < len(tags) and kind[b] == kind[a] and not start[b]:
            b += 1
        out.append((KINDS[kind[a] - 1], int(a), int(b)))
    return out


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    added: list[list[Span]] = [[] for _ in texts]
    for (i, a, _), spans in zip(where, tagged(model, [texts[i][a:b] for i, a, b in where]), strict=True):
        for kind, s, e in spans:
            s, e = s + a, e + a
            while e > s and texts[i][e - 1] in " ,;:.\n)":
                e -= 1
            while s < e and texts[i][s] in " ,;:\n":
                s += 1
            if sound(kind, texts[i][s:e]) and not any(s < y and x < e for _, x, y in base[i]) and not _inside_word(texts[i], s, e):
                added[i].append((kind, s, e))
    return list(zip(base, added, strict=True))


def _inside_word(text: str, a: int, b: int) -> bool:
    """Whether the span is cut out of a longer run of letters or digits."""
    return (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())


def ordered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = TRAIN_STEPS, text: str = "text", sample_pieces: int = SAMPLE_PIECES) -> Tagger:
    """Train on at most ``sample_pieces`` pieces of whole stretches around digits and at-signs, of at most
    ``sample_docs`` documents that hold any; both are chosen in hash order."""
    known = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    known = known.select("text", F.xxhash64("text", F.lit(5)).alias("h"))
    # only hashes are sorted; the texts up to the last chosen hash are then read where they are
    last = known.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    known = known.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]) if last is not None else known.limit(0)
    size = 4 * TRAIN_WINDOW

    def cut(texts: list[str]) -> dict[str, object]:
        return {"parts": [[t[i : min(b, i + size)] for a, b in stretches(t) for i in range(a, b, size)] for t in texts]}

    pieces = map_text(known, cut, [T.StructField("parts", T.ArrayType(T.StringType()))]).select(F.explode("parts").alias("piece"))
    chosen = pieces.orderBy(F.xxhash64("piece", F.lit(6)), "piece").limit(sample_pieces).collect()
    contexts = sorted(r["piece"] for r in chosen)
    x, y = training_windows(contexts)
    model = Tagger.new(2 * len(KINDS) + 1)
    model.train(x, y, steps)
    return model


def find_pii(docs: DataFrame, model: Tagger, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with counts of base spans, their digest, and all spans."""
    fields = [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def run(texts: list[str]) -> dict[str, object]:
        found = find_spans(model, texts)
        out: dict[str, object] = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(ordered(base).encode()).hexdigest() for base, _ in found]
        out["spans"] = [ordered(base + more) for base, more in found]
        return out

    return map_text(docs, run, fields, text=text, keep=keep)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: Tagger) -> DataFrame:
    """The documents with all spans masked and ``n_chars``, where there is one, set anew."""
    keep = [c for c in docs.columns if c != "text"]

    def run(texts: list[str]) -> dict[str, object]:
        return {"__made": [masked(t, base + more) for t, (base, more) in zip(texts, find_spans(model, texts), strict=True)]}

    made = map_text(docs, run, [T.StructField("__made", T.StringType())], keep=keep)
    return made.select(*[F.col("__made").alias(c) if c == "text" else F.length("__made").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
