import hashlib
import random
import re

import numpy as np
import pytest

from terralift.llm import op7_pii
from terralift.llm.tagger import Tagger
from tests.llm.data import documents, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text: str) -> list:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_like_the_patterns():
    draw = random.Random(1)
    pieces = ["a@b.c", "x.y@", "@", ".", "1", "25", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234", "+", "-", " ", "(", "é", "b", "9" * 17, "%", "co", "\n"]
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert op7_pii.base_spans(text) == plain_base(text), text
    for long in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 50_000, "@" * 50_000):
        op7_pii.base_spans(long)


def test_gradients():
    draw = np.random.default_rng(0)
    model = Tagger.new(3, size=3, embed=2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = draw.integers(1, 99, (6, 2)), draw.integers(0, 3, (6, 2))
    _, g = model.gradients(x, y)
    for k, w in model.weights.items():
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in w.shape) if k != "e" else (int(x[0, 0]), 1)
            step, old = 1e-2, w[at]
            w[at] = old + step
            up = model.gradients(x, y)[0]
            w[at] = old - step
            down = model.gradients(x, y)[0]
            w[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=2e-2), k


@pytest.fixture(scope="module")
def model(spark):
    made = [f"{t} call +1 (555) 555-{1000 + i} or mail jo{i}@mail.example.com now" for i, t in enumerate(texts(3, 30)) if t]
    return op7_pii.fit(documents(spark, made))


def test_held_out_items(model):
    draw = random.Random(99)
    hits = total = wrong = 0
    for i in range(300):
        kind, item = op7_pii.invented(draw)
        words = " ".join(draw.choices("alpha river stone cloud the of and".split(), k=30))
        text = f"{words} {item} {words}"
        a = len(words) + 1
        base, added = op7_pii.find_spans(model, [text])[0]
        total += 1
        hits += (kind, a, a + len(item)) in base + added
        text = f"{words} {op7_pii.decoy(draw)} {words}"
        wrong += len(op7_pii.find_spans(model, [text])[0][1])
    assert hits / total >= 0.85
    assert wrong <= 12


def test_windows_agree_on_long_stretches(model):
    text = "x " * 40 + " ".join(["12.34.56.78 and +1 (555) 555-1234"] * 40)
    base, added = op7_pii.find_spans(model, [text])[0]
    assert base == plain_base(text) and all(not any(s < y and x < e for _, x, y in base) for _, s, e in added)


def test_table(spark, model):
    docs = documents(spark, [*texts(2, 10), "mail a@b.cc, ip 1.2.3.4 card 4111 1111 1111 1111", "1" * 30_000])
    rows = op7_pii.find_pii(docs, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = plain_base(r["text"] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))  | {""}
    assert op7_pii.find_pii(documents(spark, []), model, keep=["doc_id"]).count() == 0
    clean = op7_pii.mask_pii(docs, model)
    assert clean.columns == docs.columns
    assert any(r["text"] == "mail [EMAIL], ip [IP] card [CARD]" for r in clean.collect())
