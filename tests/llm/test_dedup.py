"""Exact, line, substring and near deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import bloom, components, simhash
from geoloom.llm import line_dedup as lines
from geoloom.llm import substring_dedup as substrings
from geoloom.llm.components import connected_components
from geoloom.llm.exact_dedup import exact_dedup, frequent, misra_gries
from geoloom.llm.line_dedup import line_dedup
from geoloom.llm.substring_dedup import substring_dedup
from geoloom.llm.textkit import run_hash, run_sums, word_bounds, word_hashes
from tests.llm.plans import merge_joins

WORDS = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]


def corpus(seed=1, n=60):
    """Texts with copies, shared passages and lines, plus nulls, empty texts, a very long one and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(50))
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(1, passage)
        if i % 3 == 0:
            lines.append("  Some Footer Line \t")
        out.append((i, "\n".join(lines)))
    out += [(100 + i, out[5][1]) for i in range(8)] + [(200 + i, out[6][1].replace(" ", "  ", 1)) for i in range(4)]
    out += [(300, None), (301, ""), (302, " \n\t"), (303, None), (304, " ".join(rng.choice(WORDS) for _ in range(30_000))), (305, "short")]
    rng.shuffle(out)
    return out


def key_of(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def test_exact(docs_of):
    rows = corpus()
    norm = {i: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for i, t in rows}
    text = dict(rows)
    group = {}
    for i, n in norm.items():
        group.setdefault(n, []).append(i)
    best = {n: min(ids, key=lambda i: (-len(text[i] or ""), i)) for n, ids in group.items()}
    want = {i: (best[n], len(group[n]), best[n] == i, hashlib.sha256(n.encode()).hexdigest()) for i, n in norm.items()}
    for k in (None, 2):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs_of(rows), k=k).collect()}
        assert got == want


def test_exact_edges(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    got = exact_dedup(docs_of([(1, "a"), (1, "a"), (None, "a "), (None, "zz"), (None, "z z")])).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.group_size == 3} == {None}  # the longest original stays, here a row without an id


@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 8))
def test_misra_gries_keeps_heavy_hitters(items, k):
    kept = Counter()
    for a in range(0, len(items), 50):
        kept = misra_gries(kept + Counter(items[a : a + 50]), k)
    assert len(kept) <= k
    assert {x for x, n in Counter(items).items() if n > len(items) / (k + 1)} <= set(kept)


def test_frequent_digests(spark):
    rows = [(b"hot",)] * 300 + [(b"warm",)] * 120 + [(str(i).encode(),) for i in range(300)]
    random.Random(3).shuffle(rows)
    got = frequent(spark.createDataFrame(rows, "digest binary").repartition(4), 8)
    assert {b"hot", b"warm"} <= set(got) and len(got) <= 8


@settings(max_examples=30)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=20, unique=True), max_size=12), st.integers(10, 14))
def test_bloom_has_no_false_negatives(docs, bits):
    pair = bloom.OnceTwice(1 << bits)
    for d in docs:
        pair.add(np.array(d, dtype=np.uint64))
    seen = Counter(x for d in docs for x in d)
    every = np.array(list(seen), dtype=np.uint64)
    again = np.array([x for x, n in seen.items() if n > 1], dtype=np.uint64)
    assert bloom.contains(pair.once, every).all() and bloom.contains(pair.twice, again).all()


def line_brute(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if (k := key_of(x)) is None or len(holders[k]) < 2 or min(holders[k]) == i]
        out[i] = (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [1 << 20, 1 << 10])  # the second is full: all lines are suspects
def test_lines(docs_of, bits):
    rows = corpus(2)
    rows += [(400, "ÄBCDEFGHIJ\nabcdefghi"), (401, "ÄBCDEFGHIJ\nabcdefghi"), (402, "Äbcdefghij"), (403, "same line here\nsame line here"), (404, "SAME line here \r")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup(docs_of(rows), bits=bits, keep_text=False).collect()}
    assert got == line_brute(rows)


def test_line_edges(docs_of):
    assert line_dedup(docs_of([])).count() == 0
    got = line_dedup(docs_of([(1, "a line of text"), (1, "a line of text"), (None, "a line of text"), (None, None)]), bits=1 << 12, carry=("lang", "fp")).collect()
    assert sorted((r.doc_id is None, r.n_dropped, r.kept_text, r.fp) for r in got) == [(False, 0, "a line of text", "clash")] * 2 + [(True, 0, "", "clash"), (True, 1, "", "clash")]


def substring_brute(rows, window):
    seen = Counter()
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in words:
        seen.update(tuple(w[a : a + window]) for a in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substrings(docs_of):
    rng = random.Random(4)
    rows = corpus(3)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows += [(500, " ".join(base)), (501, " ".join(["x", *base[:36], "y", *base[37:100], "z"])), (502, " ".join(base[100:134])), (503, " ".join(base[100:135])), (504, " ".join(["a"] * 300)), (505, " ".join(["a", "b"] * 40))]
    rows += [(600 + i, " ".join([rng.choice(WORDS), *base[20:60], rng.choice(WORDS)])) for i in range(12)]
    rows += [(700, rows[0][1]), (700, rows[0][1])]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs_of(rows), bits=1 << 12).collect())
    assert got == substring_brute(rows, 35)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_substrings_small_alphabet(spark, seed):
    """Few words and a short window: very many overlapping repeats and minimiser ties."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window=9, k=3, bits=1 << 10, keep_text=False).collect())
    assert got == substring_brute(rows, 9)


def test_substring_edges(docs_of):
    assert substring_dedup(docs_of([])).count() == 0
    got = substring_dedup(docs_of([(None, None), (1, "")])).collect()
    assert all((r.n_words, r.n_removed, r.kept_text) == (0, 0, "") for r in got) and len(got) == 2


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_words_and_runs(texts):
    texts = [t.replace(b"\0", b"x") for t in texts]
    buf, s, e, counts = word_bounds(texts)
    want = [t.split() for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    words = [w for x in want for w in x]
    assert [buf[a:b] for a, b in zip(s, e, strict=True)] == words
    h = word_hashes(buf, s, e, block=8)
    assert len({(a, int(b)) for a, b in zip(words, h, strict=True)}) == len(set(words)) == len(set(h.tolist()))
    sums = run_sums(h)
    for n in (1, 2):
        at = np.arange(max(0, len(h) - n + 1))
        runs = [tuple(words[a : a + n]) for a in at]
        assert len(set(zip(runs, run_hash(sums, at, at + n).tolist(), strict=True))) == len(set(runs))


def fingerprint_brute(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(w[a : a + 3]) for a in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code():
    near, far = simhash.golay_tables()
    assert (near >= 0).all() and np.bitwise_count(near).max() == 3
    assert ((far >= 0).sum(axis=1) == np.where(np.bitwise_count(near) == 3, 5, 0)).all()
    x = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    for bit in range(23):
        y = x ^ (1 << bit)
        assert (simhash.codewords(x)[0][:, None] == simhash.codewords(y)[1]).any(axis=1).all()


def test_links_are_complete(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == want and len(want) > 300


def components_brute(rows):
    fp = [fingerprint_brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (f"{fp[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates(docs_of):
    rows = corpus(5)
    for i in range(20):
        words = (rows[i][1] or "").split()
        if len(words) > 40:
            rows.append((800 + i, " ".join([*words[:-1], "changed"])))
    want = components_brute(rows)
    df = docs_of(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()} == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_duplicate_edges(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0 and simhash.one_of_each(docs_of([])).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (7, None), (7, None), (9, "")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(["(None, None)"] * 2 + ["(7, 7)"] * 2 + ["(9, 7)"])
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(docs_of(rows)).collect()) == ["7", "None"]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def staged(monkeypatch, module, *names):
    """The joins of the frames that a module stages under these names, as it runs."""
    found, real = [], module.materialize

    def look(df, name, *more):
        if name in names:
            found.extend(merge_joins(df))
        return real(df, name, *more)

    monkeypatch.setattr(module, "materialize", look)
    return found


def test_hot_keys_can_be_split(docs_of, no_broadcast, monkeypatch):
    """Joins on keys that may be hot have an exchange on both sides."""
    rounds = staged(monkeypatch, components, "edges")
    df = docs_of(corpus(5))
    last = merge_joins(simhash.near_duplicates(df))
    assert len(rounds) >= 2 and all(a and b for a, b in rounds) and last and all(a and b for a, b in last)
    windows = merge_joins(substrings.repeated_paths(df.selectExpr("doc_id", "xxhash64(text) AS body", "text"), 35, 10, 1 << 20))
    assert len(windows) >= 2 and windows.count((True, True)) >= 2
    firsts = merge_joins(lines.repeated_keys(df.selectExpr("doc_id", "xxhash64(text) AS body", "text"), 10, 1 << 20))
    assert firsts == [(True, True)]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(0, 40))] + [(100 + i, 101 + i) for i in range(rng.randint(0, 30))]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges or [(1, 1)], "a long, b long")).collect()}
    assert got == {a: r for a, r in root.items() if any(a in e and e[0] != e[1] for e in edges)}
