import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terralift.llm import op2_suffix, suffixes
from tests.llm.data import documents


def plain_cover(texts: list[bytes], length: int) -> list[np.ndarray]:
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def test_suffix_ranks():
    draw = random.Random(5)
    for _ in range(300):
        s = np.array([draw.randint(1, draw.choice([1, 2, 4, 200])) for _ in range(draw.randint(1, 60))])
        rest = [tuple(s[i:].tolist()) for i in range(len(s))]
        assert suffixes.suffix_ranks(s, 1 << 30).tolist() == [sum(o < r for o in rest) for r in rest]
        short = suffixes.suffix_ranks(s, 5)
        order = sorted(range(len(s)), key=lambda i: (short[i], i))
        assert all(rest[a][:5] <= rest[b][:5] for a, b in zip(order, order[1:], strict=False))


def test_repeated_starts():
    draw = random.Random(6)
    for _ in range(100):
        block = bytes(draw.choices(range(97, 100), k=30))
        text = b"".join(draw.choice([block, bytes(draw.choices(range(256), k=draw.randint(1, 20)))]) for _ in range(12))
        starts = np.arange(max(0, len(text) - 16 + 1))
        times = Counter(text[i : i + 16] for i in starts)
        assert suffixes.repeated_starts(np.frombuffer(text, np.uint8), starts, 16).tolist() == [times[text[i : i + 16]] > 1 for i in starts]


def corpus(seed: int) -> list[str]:
    draw = random.Random(seed)
    prose = lambda n: " ".join("".join(draw.choices("abcdeéß", k=draw.randint(2, 8))) for _ in range(n))
    shared = [prose(n) for n in (60, 90, 150, 300)]
    texts = []
    for i in range(60):
        parts = [prose(draw.randint(0, 120))]
        for _ in range(draw.randint(0, 3)):
            parts += [draw.choice(shared)[draw.randint(0, 80) :], prose(draw.randint(0, 60))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1] + "!", "!" + texts[2], texts[3][:500] + "x" + texts[3][500:], "ab" * 900, "z" * 1500, "z" * 399, "z" * 400, "q" * 400, "q" * 401, "é" * 300]
    texts += [prose(5) + shared[2] + prose(5) for _ in range(150)]
    return texts


@pytest.mark.parametrize(("most_runs", "spread"), [(100_000, 256), (100_000, 2), (3, 2)])
def test_against_every_string(spark, most_runs, spread):
    docs = documents(spark, [*corpus(1), None, ""])
    local = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    covers = plain_cover([t for _, t in local], 400)
    want = Counter()
    for (doc_id, t), cover in zip(local, covers, strict=True):
        edges = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        want[doc_id, len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in op2_suffix.remove_repeats(docs, most_runs=most_runs, spread=spread).collect())
    assert got == want
    assert op2_suffix.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1 << 19, 20_000, 900])
def test_large_groups_are_split(most):
    draw = random.Random(8)
    core = bytes(draw.choices(range(97, 123), k=700))
    texts = []
    for _ in range(120):
        a = draw.randint(0, 250)
        texts.append(bytes(draw.choices(range(97, 123), k=a)) + core[a : 700 - draw.choice([0, 0, 100, 200])] + bytes(draw.choices(range(97, 123), k=40)))
    covers = plain_cover(texts, 400)
    groups: dict = {}
    for i, t in enumerate(texts):
        p0, n, off, ah = op2_suffix.runs(np.frombuffer(t, np.uint8))
        for p, m, o, h in zip(p0.tolist(), n.tolist(), off.tolist(), ah.tolist(), strict=True):
            groups.setdefault(h, []).append((i, p, t[p : p + m - 1 + 400], m, o))
    found = [np.zeros(len(t), bool) for t in texts]
    for rows in groups.values():
        for (i, p, *_), hits in zip(rows, op2_suffix.compare([r[2:] for r in rows], 400, most=most), strict=True):
            for s in hits.tolist():
                found[i][p + s : p + s + 400] = True
    for f, c in zip(found, covers, strict=True):
        assert (f == c).all()
