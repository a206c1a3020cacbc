"""Language identification, toxicity, decontamination and secrets."""

import hashlib
import random
import re
import unicodedata
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import decontaminate as dec
from geoloom.llm import language_id as lid
from geoloom.llm import secret_scan as sec
from geoloom.llm import toxicity as tox
from geoloom.llm.textkit import letter_bounds
from geoloom.llm.tokens import default_vocabulary, encoder

LANGS = {"aa": "the of and thing over ering", "bb": "der die und ßeit über ung", "cc": "ção não que lhe são pára"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(n))


def language_rows(n=240):
    rng = random.Random(1)
    return [(i, sentence(rng, lang, rng.randint(4, 60)), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def test_language_held_out(docs_of):
    rows = language_rows()
    got = {r.doc_id: r for r in lid.language_id(docs_of(rows)).collect()}
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_labels_are_no_input(docs_of):
    rows = language_rows()
    swapped = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz") for i, t, lang in rows]
    both = [sorted((r.doc_id, r.lang_pred, r.score) for r in lid.language_id(docs_of(x)).collect()) for x in (rows, swapped)]
    assert both[0] == both[1]


def test_language_edges(docs_of):
    rows = [*language_rows(60), (900, None), (901, ""), (902, "12 34 !?"), (903, "é"), (904, sentence(random.Random(2), "bb", 200_000), None), (None, "x y", None)]
    got = {r.doc_id: r for r in lid.language_id(docs_of(rows)).collect()}
    assert len(got) == 66 and [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und"
    assert got[904].lang_pred == "bb" and got[None].held_out is False
    assert lid.language_id(docs_of([])).count() == 0
    unlabelled = lid.language_id(docs_of([(1, "words here", None)])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def profile_brute(text, top):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = {}
    for word in low.split():
        padded = f" {word} "
        for n, s in ((1, word), (2, padded), (3, padded)):
            for a in range(len(s) - n + 1):
                code = sum(ord(c) << 21 * i for i, c in enumerate(s[a : a + n]))
                counts[code] = counts.get(code, 0) + 1
    return sorted(counts, key=lambda c: (-counts[c], c))[:top]


@settings(max_examples=60)
@given(st.text(alphabet="abcÄé 12\n.", max_size=80))
def test_profile(text):
    assert lid.ranked(*lid.ngram_counts(text), 20).tolist() == profile_brute(text, 20)


def test_blocks_count_the_same(monkeypatch):
    text = sentence(random.Random(3), "cc", 3000)
    whole = lid.ngram_counts(text)
    monkeypatch.setattr(lid, "_BLOCK", 1000)
    assert all((a == b).all() for a, b in zip(whole, lid.ngram_counts(text), strict=True))


@settings(max_examples=100)
@given(st.text(alphabet="abcÄéİΣ12 \n.", max_size=60), st.integers(1, 7))
def test_blocks_count_as_the_whole_text(text, size):
    whole = lid.ngram_counts(text)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lid, "_BLOCK", size)
        assert [x.tolist() for x in lid.ngram_counts(text)] == [x.tolist() for x in whole]


def out_of_place_brute(text, profiles, top):
    """The nearest profile (name to list of n-grams) by the definition of the distance."""
    mine = profile_brute(text, top)
    apart = {k: sum(abs(i - p.index(c)) if c in p else top for i, c in enumerate(mine)) for k, p in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (top * len(mine))


def test_language_id_by_brute_force(docs_of):
    rows = language_rows(150)
    profiles = {}
    for lang in LANGS:
        taught = "\n".join(t for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1)
        profiles[lang] = profile_brute(taught, 50)
    got = {r.doc_id: r for r in lid.language_id(docs_of(rows), top=50).collect()}
    for i, t, _ in rows:
        name, score = out_of_place_brute(t, profiles, 50)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-12


@pytest.mark.parametrize("repeated", [False, True])
def test_sample_is_bounded(spark, repeated):
    from geoloom.llm.staging import bounded_sample

    rows = spark.range(40_000).select(F.lit(7 if repeated else 0).alias("one"), "id", F.when(F.col("id") % 4000 == 1, "rare").otherwise("common").alias("label"))
    rows = rows.select(F.when(F.col("one") == 7, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), "label", "id")
    got = bounded_sample(rows, "label", 100)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"rare": 10, "common": 100}
    if not repeated:
        best = rows.where("label = 'common'").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "id", "label"), 1)).orderBy("h").limit(100)
        assert {r.id for r in got.where("label = 'common'").collect()} == {r.id for r in best.collect()}
    assert bounded_sample(rows.limit(0), "label", 100).count() == 0


# --- toxicity ---


def chain_brute(scores, g):
    """Marginals and log Z of a chain by all labellings."""
    total, toxic = 0.0, np.zeros(len(scores))
    for y in product((0, 1), repeat=len(scores)):
        s = sum(a for a, b in zip(scores, y, strict=True) if b) + sum({(0, 1): g[1], (1, 0): g[2], (1, 1): g[3]}.get(p, 0.0) for p in zip(y, y[1:], strict=False))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(y)
    return toxic / total, np.log(total)


@settings(max_examples=60)
@given(st.integers(0, 10**6))
def test_marginals(seed):
    rng = np.random.default_rng(seed)
    field = tox.Field(np.empty(0, dtype=np.uint64))
    field.globals = rng.normal(size=4)
    counts = rng.integers(0, 9, 5)
    owner, place, scores, want, want_z = [], [], [], [], []
    for t, n in enumerate(counts):
        cues = np.sort(rng.choice(n, rng.integers(0, n + 1), replace=False)) if n else np.empty(0, dtype=int)
        s = np.full(n, field.globals[0])
        s[cues] = rng.normal(size=len(cues)) * 2
        m, z = chain_brute(s, field.globals)
        want += m[cues].tolist()
        want_z.append(z if n else 0.0)
        owner += [t] * len(cues)
        place += cues.tolist()
        scores += s[cues].tolist()
    got, z = field.marginals(counts, np.array(owner, dtype=np.int64), np.array(place, dtype=np.int64), np.array(scores))
    assert np.allclose(got, want) and np.allclose(z, want_z)


def toxic_rows(n=600):
    rng = random.Random(4)
    calm = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["VILE,", "rotten", "abusive!", "scélérat"]))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, docs_of):
    rows, labels = toxic_rows()
    field = tox.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in tox.toxicity(docs_of([*rows, (9000, None), (9001, ""), (None, "rotten")]), field).collect()}
    truth = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].predicted == y for i, y in truth.items()) >= 0.98 * len(truth)
    assert got[9000].predicted == got[9001].predicted == 0 and got[9000].score == got[9001].score
    text = dict(rows)
    spans = [text[i][s.start : s.end].lower() for i, r in got.items() if i in text for s in r.spans]
    assert spans and set(spans) <= {"vile", "rotten", "abusive", "scélérat"}


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = tox.learn(docs_of([(1, "a b")]), none)
    assert [r.predicted for r in tox.toxicity(docs_of([(1, "a b"), (2, None)]), field).collect()] == [0, 0]
    assert tox.toxicity(docs_of([]), field).count() == 0


def test_toxicity_beside_other_marks(spark, docs_of):
    rng = random.Random(7)
    marks = ["“{}”", "«{}»", "¡{}!", "\u00a0{}\u00a0", "‘{}’", "word1—{}…"]
    rows = [(i, " ".join(rng.choice([f"word{k}" for k in range(60)]) for _ in range(30))) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in rows]
    rows = [(i, t + " " + rng.choice(marks).format("vile") if y else t) for (i, t), (_, _, y) in zip(rows, labels, strict=True)]
    got = {r.doc_id: r for r in tox.toxicity(docs_of(rows), tox.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert all(got[i].predicted == y for i, _, y in labels)
    assert {t[s.start : s.end] for i, t in rows for s in got[i].spans} == {"vile"}


def test_toxicity_without_spaces(spark, docs_of):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(200)]
    bad = letters[5] + letters[9]  # its letters are common, the pair is not
    rows, labels = [], []
    for i in range(400):
        t = "".join(rng.choice(letters) for _ in range(80)).replace(bad, letters[0] * 2)
        rows.append((i, t[:40] + bad + t[40:] + "。" if i % 4 == 0 else t + "。"))
        labels.append((i, 1, int(i % 4 == 0)))
    got = {r.doc_id: r for r in tox.toxicity(docs_of(rows), tox.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert all(got[i].predicted == y for i, _, y in labels)
    assert {t[s.start : s.end] for i, t in rows for s in got[i].spans} == set(bad)


ODD = {"Kelvin": "\u212aelvin", "İstanbul": "istanbul", "STRAẞE": "straße", "ΟΔΟΣ": "οδος", "ÄRGER": "ärger", "ÉCOLE": "école"}


def fold_brute(text):
    """Letter by letter, one for one."""
    return "".join("i" if c == "İ" else "σ" if c in "Σς" else c.lower() for c in text)


@settings(max_examples=200)
@given(st.text(alphabet="aKİSẞßΣςÄé漢 .\u212a\u0307", max_size=30))
def test_letters_fold_alike_in_every_text(text):
    low = tox.lowered(text.encode()).decode()
    assert low == fold_brute(text) and len(low) == len(text)


def test_spans_and_matches_beside_letters_of_other_sizes(spark, docs_of):
    rows, labels = toxic_rows()
    field = tox.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "\u212a İ ẞ ΣΟΣ word1 SCÉLÉRAT word2 İ rotten \u212a word3"
    got = tox.toxicity(docs_of([(1, text), (2, None), (3, "")]), field).collect()
    assert [text[s.start : s.end] for s in got[0].spans] == ["SCÉLÉRAT", "rotten"] and got[0].predicted == 1
    item = " ".join(["Kelvin", "ÄRGER", "STRAẞE", "ΟΔΟΣ", "ÉCOLE", "İstanbul"] * 4)
    copies = [f"{before} {' '.join(ODD.get(w, w) for w in item.split())} tail" for before in ("plain", "\u212a İ ẞ")]
    found = dec.contamination(docs_of(list(enumerate(copies))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.row_key, round(r.score, 6)) for r in found) == [(0, 1.0), (1, 1.0)]
    assert all(copies[r.row_key][r.start : r.end].endswith("istanbul") and copies[r.row_key][r.start :].startswith("\u212aelvin") for r in found)


def test_toxicity_of_long_repeated_and_tied_rows(spark, docs_of):
    """Long texts, repeated rows and rows of one id with several texts, in training and scoring."""
    rows, labels = toxic_rows()
    rows += [(9001, "word1 " * 200_000 + "rotten"), (9002, "x"), (9002, "x"), (9003, "a"), (9003, "b")]
    table = spark.createDataFrame([*labels, (9001, 1, 1), (9002, 1, 0), (9003, 1, 0), (9003, 1, 0), (9003, 1, 1)], "doc_id long, quality int, toxic int")
    field = tox.learn(docs_of(rows), table)
    got = tox.toxicity(docs_of(rows), field).collect()
    assert len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 9001)
    assert [(s.start, s.end) for s in long.spans] == [(1_200_000, 1_200_006)]
    assert len({r.score for r in got if r.doc_id == 9002}) == 1


def test_toxicity_scores_by_brute_force(spark, docs_of):
    """The query's scores from all labellings of short chains, and the field's own weights."""
    rows, labels = toxic_rows(400)
    field = tox.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    short = [(i, " ".join(t.split()[:9])) for i, t in rows[:60]] + [(900, "rotten VILE, word1 rotten")]
    got = {r.doc_id: r for r in tox.toxicity(docs_of(short), field).collect()}
    for i, t in short:
        _, _, _, features = tox.token_features([tox.lowered(t.encode())])
        found = field.find(features)
        m, _ = chain_brute(field.emissions(found), field.globals)
        cue = (found >= 0).any(axis=0)
        clean = np.log(np.maximum(1 - m[cue], 1e-9)).sum()
        odds = np.log(-np.expm1(min(clean, -1e-9))) - clean if clean < -1e-9 else np.log(1e-9)
        want = 1 / (1 + np.exp(-(field.curve[0] + field.curve[1] * np.clip(odds, -12, 12))))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7)
        assert len(got[i].spans) == int((m[cue] >= 0.5).sum())


# --- decontamination ---


def sw_brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=80)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_smith_waterman(a, b):
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    best, end = dec.smith_waterman(x, y)
    assert best == sw_brute(a, b)
    score, s, e = dec.align(x, y)
    assert score == best / (2 * len(a)) and sw_brute(a, b[s:e]) == best and e == end


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_contamination(spark, docs_of):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(300)]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, item(rng.randint(15, 50)).capitalize() + ".") for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (None, item(20))]
    docs = [(i, item(rng.randint(0, 200))) for i in range(60)]
    edited = []
    for k in range(40):
        w = items[k][1].split()
        for _ in range(len(w) // 8):
            w[rng.randrange(len(w))] = rng.choice([rng.choice(vocab), "", "fresh stuff"])
        edited.append((100 + k, f"{item(30)}, {' '.join(w).upper()} {item(30)}"))
    docs += edited + [(200 + i, items[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, "some Two, WORDS here"), (None, items[5][1]), (303, items[-1][1])]
    df = docs_of(docs)
    got = {(r.row_key, r.item_id) for r in dec.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in docs:
        w = words(t or "")
        for i, x in items:
            target = words(x or "")
            if target and w and sw_brute(target, w) / (2 * len(target)) >= 0.5:
                want.add((d, i))
    assert got == want and {(100 + k, k) for k in range(40)} <= got
    passage = dec.contamination(docs_of([(1, f"é {items[0][1]} tail")]), spark.createDataFrame(items[:1], "item_id long, text string")).first()
    assert f"é {items[0][1]} tail"[passage.start : passage.end] == items[0][1].rstrip(".")


def test_contamination_blocks_and_edges(spark, docs_of, monkeypatch):
    items = [(i, " ".join(f"q{i}w{j}" for j in range(20))) for i in range(7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, t) for i, t in items] * 2)
    one = sorted(tuple(r) for r in dec.contamination(docs, bench).collect())
    monkeypatch.setattr(dec.item_blocks, "__defaults__", (1, 25))
    assert sorted(tuple(r) for r in dec.contamination(docs, bench).collect()) == one and len(one) == 14
    assert dec.contamination(docs_of([]), bench).count() == 0 and dec.contamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [3, 4])
def test_contamination_of_short_items_edited_throughout(spark, docs_of, every):
    sizes = range(8, 27)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in sizes]
    edited = {n: " ".join("fresh" if j % every == every - 1 else f"i{n}w{j}" for j in range(n)) for n in sizes}
    want = {n for n, x in items if sw_brute(words(x), words(edited[n])) / (2 * n) >= 0.5}
    docs = docs_of([(n, f"some words before {t} and after") for n, t in edited.items()])
    got = dec.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.row_key, r.item_id) for r in got} == {(n, n) for n in want} and len(want) == len(sizes)


@pytest.mark.parametrize("first", [0x4E00, 0x3041, 0x0E01, 0x0E81, 0x1780])
def test_contamination_without_spaces(spark, docs_of, first):
    rng = random.Random(first)
    say = lambda n: "".join(chr(first + rng.randrange(40)) for _ in range(n))
    item = say(30)
    docs = docs_of([(1, say(80) + item + say(80)), (2, f"{say(10)}「{item[:12]}」{item[12:]}。"), (3, say(190))])
    got = {r.row_key: r for r in dec.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1].score == got[2].score == 1.0 and (got[1].start, got[1].end) == (80, 110)


def test_contamination_with_other_typography(spark, docs_of):
    item = "He said 'wait here' - the old man's dog (a big one) ran off, and nobody came back at all"
    text = "“Intro” He\u00a0said ‘wait\u202fhere’—the old man’s dog\u2009«a big one» ran off… and¡nobody!came back at all."
    got = dec.contamination(docs_of([(1, text)]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.score for r in got] == [1.0] and text[got[0].start : got[0].end] == text[8:-1]


def test_recall_of_seeds(spark, docs_of):
    """Edited copies of items of 8 to 50 words, up to 30 % of whose words are replaced, in texts of frequent words."""
    rng = random.Random(12)
    vocab, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    say = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    items, docs, want = [], [], set()
    for k, (size, share) in enumerate(product([*range(8, 51, 2)] * 3, [0.1, 0.2, 0.25, 0.3])):
        target = say(size).split()
        edited = list(target)
        for at in rng.sample(range(size), round(share * size)):
            edited[at] = rng.choices(vocab, weights)[0]
        doc = f"{say(40)} {' '.join(edited)} {say(40)}"
        items.append((k, " ".join(target)))
        docs.append((k, doc))
        if sw_brute(target, doc.split()) / (2 * size) >= 0.5:
            want.add(k)
    got = {r.row_key for r in dec.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), min_words=8).collect() if r.row_key == r.item_id}
    assert len(want) > 200 and got <= want and len(got) >= 0.97 * len(want)


def test_short_items_are_no_evidence(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.createDataFrame([(1, "the"), (2, "x y"), (3, "one two three four five six seven")], "item_id long, text string")
    assert dec.contamination(docs, bench, min_words=dec.EVIDENCE_WORDS).count() == 0


def test_contamination_of_long_repeated_and_tied_rows(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "filler words here " * 100_000 + item
    docs = docs_of([(1, long), (2, f"{item} and {item}"), (3, item), (3, item)])
    got = sorted(tuple(r) for r in dec.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect())
    assert [r[:2] for r in got] == [(1, 7), (2, 7), (3, 7), (3, 7)] and all(r[2] == 1.0 for r in got)
    assert got[0][3:] == (len(long) - len(item), len(long)) and got[1][3:] == (0, len(item))


def letter_words(text):
    """Words with their offsets in bytes, by walking the characters."""
    out, at, open_, alone_before = [], 0, False, False
    for c in text:
        kind, size = unicodedata.category(c)[0], len(c.encode())
        alone = kind in "LN" and (0x4E00 <= ord(c) <= 0x9FFF or 0x0E01 <= ord(c) <= 0x0E30)
        if kind == "M" and open_:
            out[-1][1] = at + size
        elif kind in "LN":
            if open_ and not alone and not alone_before:
                out[-1][1] = at + size
            else:
                out.append([at, at + size])
            open_, alone_before = True, alone
        else:
            open_, alone_before = False, False
        at += size
    return out


@settings(max_examples=300)
@given(st.lists(st.text(alphabet="aZ9_ .é’—\u00a0\u0301漢字กข\u0e48ß𝒜😀ع", max_size=14), max_size=4))
def test_letter_bounds(texts):
    raw = [t.encode() for t in texts]
    _, starts, ends, counts = letter_bounds(raw)
    want, base = [], 0
    for t, r in zip(texts, raw, strict=True):
        want += [(base + s, base + e) for s, e in letter_words(t)]
        base += len(r) + 1
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want and counts.tolist() == [len(letter_words(t)) for t in texts]


def test_letter_bounds_of_broken_bytes():
    buf, starts, ends, _ = letter_bounds([b"caf\xe9 au lait \xc3", b"\xe4\xb8"])
    assert [buf[s:e] for s, e in zip(starts, ends, strict=True)] == [b"caf\xe9", b"au", b"lait", b"\xc3", b"\xe4\xb8"]


# --- secrets ---


def base_brute(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


PIECES = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ":", " ", '"', "'", "abc", "abcdef123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "é", "ſecret", "toKen", "\n", "token=token:abcdefgh"]


@settings(max_examples=300)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert [(sec.KINDS[k], s, e) for s, k, e in sec.base_spans(text)] == base_brute(text)


def test_secrets(docs_of):
    key = "xK9vQ2mZ7pLr4TtW8bNc3HjD"
    uuid, digest = "123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e"
    rows = [(1, f"é key {key} end"), (2, f"id {uuid} and some_long_identifier_name_2 and aVeryLongCamelCaseName"), (3, f"sum {digest}"), (4, None), (5, ""), (6, f'password = "{key}"'), (None, "thisisjustaverylongword")]
    got = {r.doc_id: r for r in sec.secret_digests(sec.find_secrets(docs_of(rows))).collect()}
    assert got[1].spans == f"token:6:{6 + len(key)}" and got[2].spans == "" and got[None].spans == ""
    assert (got[3].n_hex, got[3].spans) == (1, "hex:4:36")
    assert got[6].spans == f"assign:0:{12 + len(key)}" and got[6].n_assign == 1
    assert got[4].base_sha256 == got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].base_sha256 == hashlib.sha256(b"hex:4:36").hexdigest()
    assert sec.find_secrets(docs_of([])).count() == 0
    assert sec.redact("a SECRET b", [(2, 8), (4, 6)]) == "a [secret] b"


ALPHABETS = {"base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "HEX": "0123456789ABCDEF"}


@pytest.mark.parametrize("name", sorted(ALPHABETS))
@pytest.mark.parametrize("size", [26, 32, 40])
def test_recall_on_random_keys(name, size):
    rng, encode = random.Random(6), encoder(default_vocabulary())
    keys = ["".join(rng.choice(ALPHABETS[name]) for _ in range(size)) for _ in range(300)]
    found = [sec.token_spans(f"key {k} end", [], encode, 2.0) == [(4, 3, 4 + size)] for k in keys]
    assert sum(found) >= (0.9 if name == "HEX" else 0.98) * len(keys)


def test_precision_on_prose(docs_of, spark, data):
    """No span of any kind but planted ones: those of base kinds are checked by brute force, and prose has no others."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    found = sec.find_secrets(docs, carry=("doc_id", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "token"] == base_brute(r.text or "")
        assert not [r.text[s.start : s.end] for s in r.spans if s.kind == "token"]


def test_secrets_in_long_repeated_rows(docs_of):
    key = "xK9vQ2mZ7pLr4TtW8bNc3HjD"
    long = "plain words " * 100_000 + key
    got = sec.secret_digests(sec.find_secrets(docs_of([(1, long), (2, key), (2, key)]))).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == [(1, f"token:{len(long) - 24}:{len(long)}"), (2, "token:0:24"), (2, "token:0:24")]


@pytest.mark.parametrize("name", ["test_same_as_binascii_crc32", "aVeryLongCamelCaseName2", "MAX_CONNECTION_COUNT_16", "docs/reference/chapter12/index"])
def test_identifiers_are_no_keys(name):
    assert sec.token_spans(name, [], encoder(default_vocabulary()), 2.0) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "don't", "  ", "\n\n", "123", "Ünï", "!!!", "漢字", "a"]), max_size=8).map("".join))
def test_ids_as_by_tokenizers(text):
    from tokenizers import Tokenizer

    if "slow" not in test_ids_as_by_tokenizers.__dict__:
        test_ids_as_by_tokenizers.slow = Tokenizer.from_file(default_vocabulary())
    assert encoder(default_vocabulary())(text).tolist() == test_ids_as_by_tokenizers.slow.encode(text, add_special_tokens=False).ids


def test_real_tables(spark, data):
    """Held-out accuracy on the generated tables."""
    from geoloom.llm.registry import QUERIES

    docs = spark.read.parquet(f"{data}/documents.parquet")
    lang = QUERIES["op8_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert pytest.approx(1.0, abs=0.03) == right


def test_toxicity_on_real_tables(spark, data):
    """Held-out accuracy, and clean documents left alone; the smallest tables hold out only a handful of labels."""
    from geoloom.llm.registry import QUERIES

    folder = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = QUERIES["op2_toxicity"](spark, folder).join(labels, "doc_id").where("held_out")
    right, clean, n = held.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 0, 1 - F.col("predicted"))), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.9 and clean >= 0.95
