"""Source audit, fingerprints and vector codes against plain versions, with odd rows and piece boundaries."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorgrid.llm import sketches, source_audit, vector_codes
from tremorgrid.session import cut
from tests.llm.test_operators import KINDS, ODD, SMALL

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


# Source audit

def plain_terms(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch.isascii() and not ch.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += ch.lower() if ch.isascii() else ch
    return out


def plain_audit(docs, min_df, top):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = plain_terms(text)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    rows = set()
    for lang in {g[0] for g in groups}:
        vocab = {t for t, n in df[lang].items() if n >= min_df}
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in vocab})

        def share(own):
            total = sum(own[t] for t in vocab)
            return {t: 1 + 10 ** 9 * (own[t] + 1) // (total + len(vocab)) for t in vocab}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in vocab), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t) for t in vocab if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    rows.add((lang, s, part, item, -value, rank))
    return rows


def read(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.collect()]


@pytest.mark.parametrize("min_df, top", [(3, 200), (1, 3)])
def test_audit(spark, small, odd, none, monkeypatch, min_df, top):
    monkeypatch.setattr(source_audit, "HELD_TERMS", 50)  # sums are passed on many times
    for df in (small, odd, none):
        got = [tuple(r) for r in source_audit.audit_sources(df, min_df=min_df, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_audit(read(df), min_df, top)


def test_terms_are_never_cut(monkeypatch):
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 7)
    text = "Ab,cd" + "é" * 40 + " x" * 30 + "ÀB_c\x00d@[`{\x7f"
    assert source_audit.count_vector(text.encode()) == Counter(t.encode() for t in plain_terms(text))


def test_document_vectors_equal_the_vectorizer(spark, small):
    """The same vocabularies and vectors as Spark ML's vectorizer fitted on each language."""
    from pyspark.ml.feature import CountVectorizer


    vocabulary = cut(source_audit.vocabularies(source_audit.group_sums(small)))
    mine = {r["doc_id"]: r for r in source_audit.document_vectors(small, vocabulary, "doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    lang = small.groupBy("lang").count().orderBy(F.desc("count")).first()["lang"]
    words = spark.createDataFrame([(r["doc_id"], plain_terms(r["text"])) for r in small.where(F.col("lang") == lang).collect()],
                                  "doc_id long, words array<string>")
    model = CountVectorizer(minDF=3.0, vocabSize=(1 << 31) - 1, inputCol="words", outputCol="v").fit(words)
    names = model.vocabulary
    terms = {r["index"]: r["term"] for r in vocabulary.where(F.col("lang") == lang).collect()}
    assert sorted(terms.values()) == sorted(names)
    for r in model.transform(words).collect():
        own = mine[r["doc_id"]]
        assert own["size"] == len(names) and list(own["indices"]) == sorted(own["indices"])
        assert {terms[i]: n for i, n in zip(own["indices"], own["counts"])} == {
            names[i]: int(n) for i, n in zip(r["v"].indices, r["v"].values)}
    assert set(mine) == set(texts)


def test_vocabulary_size_keeps_the_most_frequent(spark, small):
    sums = cut(source_audit.group_sums(small))
    whole = {(r["lang"], r["index"]): r["term"] for r in source_audit.vocabularies(sums).collect()}
    few = source_audit.vocabularies(sums, vocab_size=5).collect()
    assert {(r["lang"], r["index"]): r["term"] for r in few} == {k: v for k, v in whole.items() if k[1] < 5}


# Fingerprints

def plain_shingles(text, words=5):
    own = (text or "").split()
    return {tuple(own[i:i + words]) for i in range(max(len(own) - words + 1, min(len(own), 1)))}


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_pairs(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(*r, rows[(n + 1) % len(rows)][1]) for n, r in enumerate(rows)]


def test_neighbours(spark, small, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_BYTES", 50_000)  # many ranges
    want = {}
    for number, text, following in plain_pairs(small):
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        want[number] = len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following
    got = sketches.compare_neighbours(small.repartition(3)).collect()
    assert len(got) == len(want)
    sketcher, errors = sketches.Sketcher(), []
    for r in got:
        n, digest, text, edited, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert r["fingerprint"] == sketches.as_text(sketcher.sketch(text))
        assert r["edited_fingerprint"] == sketches.as_text(sketcher.sketch(edited))
        errors += [abs(r["near_edited"] - jaccard(text, edited)), abs(r["near_next"] - jaccard(text, following))]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.03


def test_neighbours_of_odd_rows(spark, odd, none):
    got = sketches.compare_neighbours(odd).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in ODD)
    assert got[-1] is not None and sketches.compare_neighbours(none).collect() == []
    same = {r["fingerprint"] for r in got if r["doc_id"] == 5}
    assert len(same) == 1 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    lone = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    row = sketches.compare_neighbours(lone).first()
    assert row["near_next"] == 1 and row["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest()


def test_repeated_rows_are_neighbours(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_BYTES", 2_000)  # the repeated rows lie in several ranges
    rows = spark.createDataFrame([(7, "one two three four five six")] * 500 + [(8, "x")], "doc_id long, text string")
    got = sketches.compare_neighbours(rows.repartition(4)).collect()
    assert Counter(r["doc_id"] for r in got) == {7: 500, 8: 1}
    assert sum(r["near_next"] == 1 for r in got if r["doc_id"] == 7) == 499


def test_sketch_rules():
    rng = np.random.default_rng(3)
    s = sketches.Sketcher()
    words = [f"w{n}" for n in rng.integers(0, 20_000, 30_000)]
    text = " ".join(words)
    hashes = np.unique(s._hashes(s._words(words)))
    want = hashes[hashes <= s.bound]
    assert (s.sketch(text) == want).all() and abs(len(want) / len(hashes) - 1 / sketches.FRACTION) < 0.01
    short = s.sketch(" ".join(words[:40]))
    assert len(short) == 36  # all shingles of a short text
    middle = s.sketch(" ".join(words[:300]))
    assert len(middle) >= sketches.LEAST
    # Containment of a part in a text of very different length, and of nothing in anything.
    assert abs(s.containment(s.sketch(" ".join(words[:5000])), s.sketch(text)) - 1) < 1e-9
    assert s.containment(s.sketch("not one of these words is there"), s.sketch(text)) == 0
    assert s.likeness(s.sketch(""), s.sketch(" \n")) == 1 and s.likeness(s.sketch(""), short) == 0
    assert (sketches.from_text(sketches.as_text(middle)) == middle).all()


def test_slices_of_long_texts(monkeypatch):
    s = sketches.Sketcher()
    text = " ".join(f"w{n * n % 977}" for n in range(5000))
    whole = s.sketch(text)
    for size in (7, 100, 4996, 4999):
        monkeypatch.setattr(sketches, "SLICE_WORDS", size)
        assert (s.sketch(text) == whole).all()


def test_merged_groups(spark, small, odd):
    """A group's fingerprint is the one of all its shingles, and containment in it is near the true one."""
    docs = small.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    marked = cut(sketches.sketch_texts(docs))
    groups = cut(sketches.group_sketches(marked, ["source"]))
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["source"]] |= plain_shingles(r["text"])
    s = sketches.Sketcher()
    held = defaultdict(set)
    for r in groups.collect():
        held[r["source"]].add(r["hash"])
    for source, shingles in texts.items():
        words = [np.array([hash_of(s, x)]) for x in shingles]
        every = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        rows = [r for r in groups.where(F.col("source").eqNullSafe(source)).collect()]
        bound = rows[0]["complete_to"] if rows else 0
        assert held[source] == {int(h) for h in every if h <= bound}
    source = max(texts, key=lambda k: len(texts[k]))
    found = {r["doc_id"]: r["containment"] for r in sketches.containment_in_groups(
        small.transform(sketches.sketch_texts), groups, ["source"]).where(F.col("source").eqNullSafe(source)).collect()}
    for r in small.collect():
        own = plain_shingles(r["text"])
        if len(own) >= 500:  # about 30 hashes below the bound of a group
            true = len(own & texts[source]) / len(own)
            assert abs(found.get(r["doc_id"], 0) - true) < 0.3


def hash_of(s, shingle):
    return s._hashes(s._words(list(shingle)))[0]


# Vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, n, [math.floor(scale * float(x)) for x in v]) for i, n, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(kept[0][2])
    cut = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
    books = [[v[a:b] for _, _, v in kept[:entries]] for a, b in cut]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda x, book: min(range(len(book)), key=lambda e: (away(x, book[e]), e))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            members = defaultdict(list)
            for _, _, v in kept:
                members[best(v[a:b], books[p])].append(v[a:b])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = Counter()
    for i, n, v in kept:
        codes = [best(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out[i, n, "".join(f"{c:02x}" for c in codes), sum(away(v[a:b], books[p][c]) for p, ((a, b), c) in enumerate(zip(cut, codes)))] += 1
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, position int, code string"


@pytest.mark.parametrize("dims, nodes, block", [(16, 3, 40), (11, 4096, 1 << 14), (4, 1, 1)])
def test_codes(spark, monkeypatch, dims, nodes, block):
    monkeypatch.setattr(vector_codes, "WALK_NODES", nodes)
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(dims)
    values = (rng.integers(-6, 7, (150, dims)) / 4096 * rng.choice([1, 3], (150, 1))).astype(np.float32)
    rows = [(int(n) % 140, v.tolist(), None if n % 7 == 0 else int(n) % 3) for n, v in enumerate(values)]
    rows += [rows[5]] * 60 + [(None, rows[9][1], 1), (-4, None, 1), (-5, [None] * dims, 1), (-6, [math.nan] * dims, 1),
                              (-7, [math.inf] * dims, 2)]
    df = spark.createDataFrame([(i, v, n, 1, "x") for i, v, n in rows], VECTORS)
    codes, books = vector_codes.code_vectors(df.repartition(3))
    want, plain_books = plain_codes([(i, n, v) for i, v, n in rows])
    assert books == plain_books
    got = codes.collect()
    assert Counter((r["vec_id"], r["label"], r["code"], r["error"]) for r in got) == want
    totals = defaultdict(int)
    for (_, label, _, error), many in want.items():
        totals[label] += error * many
    assert {(r["label"], r["label_error"]) for r in vector_codes.with_group_error(codes).collect()} == set(totals.items())
    decoded = {(r["vec_id"], r["code"]): r["decoded"] for r in vector_codes.decode_vectors(codes, books).collect()}
    for (_, code), vector in decoded.items():
        named = [plain_books[p][int(code[2 * p:2 * p + 2], 16)] for p in range(8)]
        assert vector == [x / 4096 for x in itertools.chain(*named)]


def test_codes_of_odd_tables(spark):
    nothing = spark.createDataFrame([(1, None, 1, 0, "")], VECTORS)
    codes, books = vector_codes.code_vectors(nothing)
    assert codes.collect() == [] and books == [] and codes.columns == ["vec_id", "label", "code", "error"]
    mixed = spark.createDataFrame([(1, [0.5] * 8, 1, 0, ""), (2, [0.25] * 9, 1, 0, ""), (3, [], 1, 0, "")], VECTORS)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.code_vectors(mixed)[0].collect()}
    assert got == {1: ("00" * 8, 0), 2: (None, None), 3: (None, None)}
    hollow = spark.createDataFrame([(1, [], 1, 0, "")], VECTORS)
    assert [tuple(r) for r in vector_codes.code_vectors(hollow)[0].collect()] == [(1, 1, "00" * 8, 0)]
    large = spark.createDataFrame([(1, [1e9] * 8, 1, 0, "")], VECTORS)
    with pytest.raises(Exception, match="not exact"):
        vector_codes.code_vectors(large)[0].collect()


def test_trie_shares_prefixes():
    parts = np.array([[1, 1, 1], [1, 1, 2], [1, 2, 1], [1, 1, 1], [0, 5, 5]])
    values, children, weights, leaf_of = vector_codes.build_trie(parts)
    assert [v.tolist() for v in values] == [[0, 1], [5, 1, 2], [5, 1, 2, 1]]
    assert [c.tolist() for c in children] == [[0, 1, 3], [0, 1, 3, 4]]
    assert weights.tolist() == [1, 2, 1, 1] and leaf_of.tolist() == [1, 2, 3, 1, 0]
