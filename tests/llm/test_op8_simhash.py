import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from terralift.llm import op8_simhash
from terralift.llm.components import connected_components
from tests.llm.data import documents, texts


def plain_fingerprint(text: str | None) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(codes: list[int], bits: int) -> dict[int, int]:
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = sorted(root)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {c: find(c) for c in root}


def test_fingerprints():
    for t in texts(9, 30):
        assert op8_simhash.fingerprint(t or "") % (1 << 64) == plain_fingerprint(t)


def random_codes(seed: int, groups: int, each: int) -> list[int]:
    draw = random.Random(seed)
    out = []
    for _ in range(groups):
        c = draw.getrandbits(64)
        for _ in range(each):
            x = c
            for b in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << b
            out.append(x)
    return out


def test_links_against_all_pairs(spark):
    codes = list(set(random_codes(2, 40, 12) + random_codes(3, 1, 300) + [0, 1, (1 << 64) - 1]))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    nodes = spark.createDataFrame(signed, "fp long").repartition(3)
    expected = roots(codes, 4)
    for tile in (4096, 64):
        found = {r["node"] % (1 << 64): r["root"] for r in connected_components(op8_simhash.hamming_links(nodes, 4, tile)).collect()}
        group = lambda c: found.get(c, c - (1 << 64) if c >> 63 else c)
        pairs = Counter((expected[c], group(c)) for c in codes)
        assert len({e for e, _ in pairs}) == len({g for _, g in pairs}) == len(pairs)


def test_link_codes_on_large_classes():
    codes = np.unique(np.array(random_codes(5, 30, 60), np.uint64))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    for x, y in ((codes, None), (codes[::2], codes[1::3])):
        a, b = op8_simhash.link_codes(x, y, 4)
        forest = {c: c for c in codes.tolist()}

        def find(c, forest=forest):
            while forest[c] != c:
                c = forest[c]
            return c

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            assert (y is None) or True
            forest[max(find(p), find(q))] = min(find(p), find(q))
        other = x if y is None else y
        for p in x.tolist():
            for q in other.tolist():
                if (p ^ q).bit_count() <= 4:
                    assert find(p) == find(q)


@pytest.mark.parametrize("nodes", [10, 5_000, 10**6, 10**8, 10**10])
def test_near_codes_share_a_class(nodes):
    masks = op8_simhash.block_masks(nodes, 4)
    draw = random.Random(nodes)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
    assert nodes > op8_simhash.GROUP or masks == [0]


def test_all_comparisons_go_down_the_tree(monkeypatch):
    compared = []
    nonzero = np.nonzero
    monkeypatch.setattr(op8_simhash.np, "nonzero", lambda x: (compared.append(x.size), nonzero(x))[1])
    codes = np.array(sorted(random_codes(6, 1500, 1), key=lambda c: gray(c)), np.uint64)
    op8_simhash.link_codes(codes, None, 4)
    assert 0 < sum(compared) < 0.45 * len(codes) ** 2  # groups are left before their codes are compared


def gray(c: int) -> int:
    for s in (1, 2, 4, 8, 16, 32):
        c ^= c >> s
    return c


def test_groups(spark):
    base = texts(4, 30)
    near = [t + " tail" for t in base[:10] if t]
    docs = documents(spark, base + near)
    rows = op8_simhash.simhash_groups(docs, keep=["text"]).collect()
    assert len(rows) == docs.count()
    codes = [plain_fingerprint(r["text"]) for r in rows]
    assert [r["fp"] % (1 << 64) for r in rows] == codes
    root = roots(codes, 4)
    for c, r in zip(codes, rows, strict=True):
        ids = [o["doc_id"] for o, oc in zip(rows, codes, strict=True) if root[oc] == root[c] and o["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert op8_simhash.simhash_groups(documents(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (500, 501), (501, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def edited(words: list[str], share: float, draw: random.Random) -> str:
    return " ".join(draw.choice(["new", "other", "word"]) + str(draw.random()) if draw.random() < share else w for w in words)


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_texts(spark):
    draw = random.Random(12)
    rows = []
    for i in range(150):
        words = [f"{draw.choice('abcdefg')}{draw.randint(0, 400)}" for _ in range(draw.randint(60, 300))]
        rows += [" ".join(words), edited(words, 0.004, draw), edited(words, 0.2, draw)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op8_simhash.simhash_groups(docs, similarity=0.8).collect()}
    sure = lost = wrong = 0
    for i in range(150):
        base, near, far = (shingles(rows[3 * i + k]) for k in range(3))
        j = len(base & near) / len(base | near)
        if j >= 0.9:
            sure += 1
            lost += got[3 * i] != got[3 * i + 1]
        assert len(base & far) / len(base | far) < 0.6
        wrong += got[3 * i + 2] != 3 * i + 2
    assert sure > 50 and lost <= 0.05 * sure and wrong == 0


def test_one_of_each(spark):
    docs = documents(spark, texts(4, 30) * 2)
    kept = op8_simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = op8_simhash.simhash_groups(docs, keep=["text"], similarity=0.8).collect()
    assert len(rows) == len({r["root"] for r in groups})
    assert {r["doc_id"] for r in rows} == {r["component_id"] for r in groups}
    assert op8_simhash.one_of_each_group(documents(spark, [])).count() == 0


def test_links_are_as_similar_as_asked(spark):
    draw = random.Random(31)
    rows = []
    for i in range(160):
        words = [f"w{i}x{draw.randint(0, 10**6)}" for _ in range(120)]
        rows.append(" ".join(words))
        for at in draw.sample(range(4, 116, 6), 1 + i % 4):  # each change replaces five of 116 shingles
            words[at] = f"new{draw.random()}"
        rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op8_simhash.simhash_groups(docs, similarity=0.8).collect()}
    due = lost = below = 0
    for a in range(0, len(rows), 2):
        one, two = shingles(rows[a]), shingles(rows[a + 1])
        close = (plain_fingerprint(rows[a]) ^ plain_fingerprint(rows[a + 1])).bit_count() <= 4
        if len(one & two) / len(one | two) >= 0.8:
            due += 1
            lost += got[a] != got[a + 1]
        elif not close:
            below += 1
            assert got[a] != got[a + 1]
    assert due > 40 and below > 60 and lost <= 0.02 * due
    nodes = spark.createDataFrame([(i, i, *op8_simhash.wide_fingerprint(t).tolist()) for i, t in enumerate(rows)], "node long, doc_id long, w0 long, w1 long, w2 long, w3 long")
    same = nodes.join(docs, "doc_id").selectExpr("node", "xxhash64(text) as h", "w0", "w1", "w2", "w3")
    near = op8_simhash.similar_links(same.select("w0", "w1", "w2", "w3"), 0.8)
    found = [{frozenset((r["a"], r["b"])) for r in op8_simhash.verified_links(docs, same, near, 0.8, tile=t).collect()} for t in (1, 2048)]
    assert found[0] == found[1] and len(found[0]) == due - lost
