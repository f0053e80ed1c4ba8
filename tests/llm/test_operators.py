"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tremorgrid.llm import (  # noqa: E402
    chat_format, exact_dedup, jaccard_join, line_dedup, mixing, packing, token_counts, token_files, topk_search, toxicity)
from tremorgrid.llm.queries import ORACLES, QUERIES, vocabulary  # noqa: E402
from tremorgrid.session import cut  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")

KINDS = "doc_id long, text string, lang string, source string, n_chars long, row_tag string, place int"
LINE = "one two three four five six seven eight nine ten eleven"
ODD = [
    (1, None, None, None, None, "a", 0), (2, "", "en", "s", 0, "b", 0), (3, "   \n ", "en", "s", 0, "c", 0),
    (4, LINE, "en", "s", 1, "d", 1), (5, LINE.upper(), "en", "t", 1, "d", 1), (5, LINE.upper(), "en", "t", 1, "d", 1),
    (None, LINE, "en", None, 1, None, None), (2 ** 60 + 1, "x" * 5000, "en", "s", 1, "e", 2),
    (7, f"{LINE}\n\nshort\n{LINE}\n\nlast", "en", "S", 1, "f", 3), (8, "word " * 4000, "en", "", 1, "g", 4),
    (9, "İstanbul ΣΑΣ é  'll it's <|endoftext|> \x1c 12½", "tr", "u", 1, "h", 5), (-3, f"{LINE} twelve", "en", "s", 1, "", 6),
    (10, "a  b   c \n d", "en", "u", 1, "i", 7), (11, f"{LINE}\nshort", "en", "u", 1, "i", 7),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SMALL)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    key = lambda r: repr(r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(result.fetchall(), key=key)


# Packing

def packed_ok(rows, docs, tokenizer, length):
    want = Counter(tuple(ids_of(tokenizer, t)) + (2,) for _, t in docs)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["sequence_id"] * length + r["offset"] - r["start"]].append((r["start"], ids, r["doc_tokens"]))
    for number, parts in by_sequence.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or number == max(by_sequence)
    got = Counter()
    for parts in by_doc.values():
        whole = [i for _, ids, _ in sorted(parts) for i in ids]
        assert len(whole) == parts[0][2]
        got[tuple(whole)] += 1
    assert got == want


def test_packing(small, odd, none, library):
    tokenizer = library["word_bpe_49k.json"]
    for df in (small, odd):
        rows = packing.pack_documents(df, vocabulary("word_bpe_49k.json"), length=64).collect()
        packed_ok(rows, [(r["doc_id"], r["text"]) for r in df.collect()], tokenizer, 64)
    assert packing.pack_documents(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# Exact duplicates

def test_exact_duplicates(small, odd, none):
    for df, options in ((small, {}), (odd, {}), (odd, {"winners": 1, "tracked": 1}), (small, {"winners": 2, "tracked": 2})):
        rows = exact_dedup.exact_duplicates(df, **options).collect()
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        groups = defaultdict(list)
        for r in df.collect():
            groups[hashlib.sha256((r["text"] or "").translate(lower).encode()).hexdigest()].append(r["doc_id"])
        assert len(rows) == df.count()
        found = defaultdict(list)
        for r in rows:
            best = max(i for i in groups[r["text_sha256"]] if i is not None)
            assert (r["keep_id"], r["group_size"]) == (best, len(groups[r["text_sha256"]]))
            found[r["text_sha256"]].append(r)
        for own in found.values():
            assert [r["doc_id"] for r in own if r["kept"]] == [own[0]["keep_id"]]
    assert exact_dedup.exact_duplicates(none).count() == 0


# Near duplicates

def jaccard_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return sets


def check_near(df, **options):
    docs = df.collect()
    sets = jaccard_sets([r["text"] for r in docs])
    n = len(docs)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(docs):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        low[root(i)] = min(low.get(root(i), key), key)
    want = Counter((r["doc_id"], low[root(i)][1] if not low[root(i)][0] else None, links[i]) for i, r in enumerate(docs))
    rows = jaccard_join.near_duplicates(df, **options).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(low)
    return max(links)


def test_near_duplicates(spark, small, odd, none, monkeypatch):
    assert check_near(small.limit(200)) > 0
    check_near(odd)
    assert jaccard_join.near_duplicates(none).count() == 0
    words = [f"w{i}" for i in range(60)]
    many = [(i, " ".join(words[:i % 9] + [f"x{i}"] * (i % 2) + words[i % 9:])) for i in range(40)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    check_near(df)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    assert check_near(df) > 10


def test_bands():
    bands, rows = jaccard_join.choose_bands(0.8, 0.99999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8 ** rows) ** bands >= 0.99999


def test_drop_near_duplicates_keeps_columns(odd):
    kept = jaccard_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() < odd.count()


# Chat

def test_chat_round_trip(spark):
    texts = ["", None, "a\\b", "<|im_end|>", "<\\|x", "<|<\\\\|", "\\\\<|im_start|>user\nhi", "<\\!", "naïve 日本\n"]
    rows = [(i % 3, 0, i, "message", role, t) for i, t in enumerate(texts)
            for role in [("user", "assistant", None, "sys\ntem<|")[i % 4]]]
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = chat_format.read_chat(chat_format.format_chat(events)).collect()
    want = defaultdict(list)
    for conv, _, _, _, role, text in rows:
        want[conv].append((role or "user", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == dict(want)
    for r in got:
        assert r["loss_texts"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(want[r["conv_id"]])


def test_chat_events(spark):
    rows = [
        (1, 1, 0, "message", "user", "hello"), (1, 2, 1, "delta", "assistant", "wrong"), (1, 3, 1, "regenerate", None, None),
        (1, 5, 1, "delta", None, "lo"), (1, 4, 1, "delta", None, "hel"), (1, 6, 1, "delta", None, "lo"),
        (1, 7, 0, "edit", None, "hello!"), (1, 8, 2, "message", "user", "x"), (1, 9, 2, "delete", None, None),
        (None, 1, 0, "delta", "user", "n"), (2, None, 0, None, None, "odd"), (2, 1, 0, "delta", None, "!"),
        (3, 1, 0, "delete", "user", None), (3, 2, 0, "delta", None, "back"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat_format.fold_events(events).collect()}
    assert got == {(1, 0): ("user", "hello!"), (1, 1): ("assistant", "hellolo"), (None, 0): ("user", "n"),
                   (2, 0): ("user", "odd!"), (3, 0): ("user", "back")}
    assert chat_format.format_chat(events.limit(0)).count() == 0


# Token files

def test_compression_round_trip():
    rng = np.random.default_rng(1)
    phrases = [[3, 4, 5, 6], [7, 8, 9], [4, 4, 4], [2, 6]]
    docs = [np.array([*(i for p in rng.integers(0, 4, size=n) for i in phrases[p]), 2], "<u4") for n in (0, 1, 200, 900, 2)]
    shard = token_files.Shard(token_files.pack_shard([5, 6, None, 8, 9], [d.tobytes() for d in docs], 4, 10, 2))
    assert len(shard.rules) > 5 and len(shard.symbols) < sum(map(len, docs)) / 2
    assert (shard.decode() == np.concatenate(docs)).all()
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
        assert (shard.document(i, len(d) // 3, 7) == d[len(d) // 3:len(d) // 3 + 7]).all()


def test_grammar_is_finished():
    """Runs of one id and many copies shrink to a few symbols, and no pair is left that pays for its rule."""
    rng = np.random.default_rng(3)
    copies = np.tile(rng.integers(3, 5000, 200), 2000)
    for ids, most in ((np.full(65_536, 7), 8), (copies, 40), (rng.integers(3, 30, 20_000), 20_000)):
        symbols, rules, lengths = token_files.compress(ids.astype("<u4"), 5000, 2)
        assert len(symbols) <= most and lengths[symbols].sum() == len(ids)
        counts, last = Counter(), None
        for n, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            if pair[0] != pair[1] or last != (pair, n - 1):
                counts[pair], last = counts[pair] + 1, (pair, n)
        assert max(counts.values()) < token_files.LEAST_COUNT
        data = token_files.pack_shard([1, 2], [ids.astype("<u4").tobytes(), np.array([2], "<u4").tobytes()], 4, 5000, 2)
        shard = token_files.Shard(data)
        assert (shard.decode() == np.append(ids, 2)).all() and (shard.document(0, 17, 90) == ids[17:107]).all()


def test_byte_encoder(library, monkeypatch):
    """Ids are the library's for words of every kind, also when kept words are dropped all the time."""
    path = vocabulary("byte_bpe_50k.json")
    texts = ["", "One two,\nThree's  four.", "a.\nB,\nC x\u00e9\u00df\u00fc$$$ don't", "x <|endoftext|> y<|endoftext|>z", " \n", "a_b c1d \u4e2d\u6587 \U0001f600!",
             "caf\u00e9.\n\nTwo\tthree\u00a0four \u00bd\u00b2", "un \u00e9t\u00e9\nL\u00e0 ", "w.\n", "q-\nr's"] * 2
    for kept in (500_000, 2):
        monkeypatch.setattr(token_files.ByteLevelEncoder, "KEPT", kept)
        found = token_files.ByteLevelEncoder(path, 4).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [ids_of(library["byte_bpe_50k.json"], x) for x in texts]


def test_token_files(spark, small, odd, none, library, tmp_path):
    tokenizer = library["byte_bpe_50k.json"]
    for name, df in (("small", small), ("odd", odd), ("none", none)):
        path = str(tmp_path / name)
        token_files.write_token_files(df, path, vocabulary("byte_bpe_50k.json"), shard_ids=1000)
        rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        want = Counter((r["doc_id"], crc(ids_of(tokenizer, r["text"]) + [2])) for r in df.collect())
        assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in rows) == want


# Mixing

def test_targets(spark):
    sizes = {"a": 10, "B": 500, None: 40, "c": 0, "d": 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target.update({s: level * weight[s] for s in free})
    assert got == pytest.approx(target)


def test_mixing(small, odd, none, monkeypatch):
    for block in (50_000, 8):
        rows = mixing.mix_sources(small, block_rows=block).collect()
        again = mixing.mix_sources(small.repartition(3), block_rows=block).collect()
        key = lambda r: (r["doc_id"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, again))
        text = {r["doc_id"]: r for r in small.collect()}
        by_source = defaultdict(list)
        for r in rows:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]["text"] or ""))
            assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
            by_source[text[r["doc_id"]]["source"]].append(r)
        for own in by_source.values():
            assert sum(r["size"] for r in own) == own[0]["source_size"]
            largest = sorted((r["size"] for r in own), reverse=True)[:2]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= sum(largest)
    assert mixing.mix_sources(odd).count() == len(ODD)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_one_key_beyond_a_block(spark):
    """Rows that share id and text are cut into blocks like others, and the mix still comes near its targets."""
    rows = [(1, "one two three", "a")] * 300 + [(n, "w " * (n % 7 + 1), "b") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    thin = docs.selectExpr("source", "monotonically_increasing_id() AS row_tag", "3L AS size", "7L AS order_key", "0.5D AS chance")
    blocks = mixing.numbered_blocks(cut(thin), 16).groupBy("source", "block").count().collect()
    assert sum(r["count"] for r in blocks) == 500 and max(r["count"] for r in blocks) <= 16
    mixed = mixing.mix_sources(docs, block_rows=16).cache()
    again = mixing.mix_sources(docs.repartition(5), block_rows=16)
    assert sorted((r["doc_id"], r["taken"]) for r in mixed.collect()) == sorted((r["doc_id"], r["taken"]) for r in again.collect())
    for size in (900, sum(n % 7 + 1 for n in range(200))):
        own = mixed.filter(f"source_size = {size}").selectExpr("sum(taken)", "max(target)").first()
        assert abs(own[0] - own[1]) <= 14


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    p, s = rng.random(300), rng.integers(1, 90, 300).astype(float)
    q = mixing.flight(p, s)
    assert ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * s).sum() == pytest.approx((p * s).sum())


# Toxicity

def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    right = [rows[i]["predicted"] == t for i, t in marks.items() if rows[i]["held_out"]]
    assert np.mean(right) > 0.9


def test_toxicity_counts_every_word(spark):
    """No window is skipped: the hits of a text are those of all its words, also where a window saves nothing."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model, skipped = toxicity.train(docs, labels), 0
    model._tools()
    for row in docs.join(labels.filter("toxic = 1"), "doc_id").select("text").collect():
        words = re.findall(r"\w+", row["text"].lower())
        hits = [model.word_saving(w) >= 0.35 for w in words]
        assert model.features(row["text"])[1] == pytest.approx(np.log1p(sum(hits)))
        skipped += sum(any(hits[n:n + 8]) and model.saving(" ".join(words[n:n + 8]).encode()) < 2
                       for n in range(0, len(words), 8))
    assert skipped > 0


def test_toxicity_zero_point_of_a_bounded_sample(spark):
    """The mean score is the share of toxic labels, also where the sample holds as many of each class."""
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300)]
    rows = []
    for n in range(2000):
        toxic = int(n % 10 == 0)
        words = list(rng.choice(vocab, 40))
        if rng.random() < (0.7 if toxic else 0.01):
            words[20:20] = ["scoundrelish", "blockheaded"]
        rows.append((n, " ".join(words), toxic))
    docs, labels = (spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", c) for c in ("text", "toxic"))
    for bound in (100, 4000):
        learned = toxicity.score_toxicity(docs, labels, bound).filter("not held_out").join(labels, "doc_id")
        mean, share = learned.selectExpr("avg(score)", "avg(toxic)").first()
        assert mean == pytest.approx(share, abs=0.05), bound


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 0, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD)
    assert toxicity.score_toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


# Repeated lines

def plain_line_dedup(docs, min_words=10):
    """Longest earlier copy of every suffix, line by line."""
    lines, owner = [], []
    split = [re.split(r"\n(?=[^\n]*[^ \t\r\n\f\v])", t or "") for _, t in docs]
    for d, own in enumerate(split):
        for n, line in enumerate(own):
            if line.strip(" \t\r\n\f\v"):
                lines.append(line.strip(" \t\r\n\f\v"))
                owner.append((d, n))
    at = defaultdict(list)
    gone = set()
    for i, line in enumerate(lines):
        best = 0
        for j in at[line]:
            n = 0
            while i + n < len(lines) and lines[i + n] == lines[j + n] and owner[i + n] == (owner[i][0], owner[i][1] + n) \
                    and owner[j + n] == (owner[j][0], owner[j][1] + n):
                n += 1
            best = max(best, n)
        if sum(len(re.findall(r"[^ \t\r\n\f\v]+", x)) for x in lines[i:i + best]) >= min_words:
            gone.update(owner[i:i + best])
        at[line].append(i)
    out = []
    for d, own in enumerate(split):
        kept = [x for n, x in enumerate(own) if (d, n) not in gone]
        out.append((docs[d][0], docs[d][1] if len(kept) == len(own) else "\n".join(kept), len(own) - len(kept)))
    return out


def test_line_dedup(spark, small, odd, none):
    rng = np.random.default_rng(3)
    pool = [" ".join(["w%d" % k] * (k % 6 + 1)) for k in range(6)] + ["", "  "]
    made = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 14)))) for i in range(80)]
    junk = [(100, "a b\n" * 30 + "c"), (101, "a b\n" * 12), (102, "\n\nx y z\n\n" * 9)]
    tables = [small, odd, spark.createDataFrame(made, "doc_id long, text string"),
              spark.createDataFrame(junk, "doc_id long, text string")]
    for df in tables:
        docs = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want = Counter(plain_line_dedup(docs))
        got = Counter((r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup.line_report(df).collect())
        assert got == want
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.dedup_lines(none).count() == 0


# Token counts

def test_token_counts(small, odd, none, library):
    tokenizer = library["word_bpe_49k.json"]
    for df in (small, odd):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(ids_of(tokenizer, r["text"]))) for r in df.collect())
        rows = token_counts.count_tokens(df, vocabulary("word_bpe_49k.json"), limit=100).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert token_counts.count_tokens(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_contractions_and_classes(library):
    tool, tokenizer = token_counts.compiled(vocabulary("word_bpe_49k.json")), library["word_bpe_49k.json"]
    texts = ["'s's's", "x''s", "'re've'll'd'm't", "a'r", "' 's", "…'s", "日本'll", "a b　c​d", "ﬁ ½ ² Ⅷ", "é" * 300,
             "abc" * 200, "<|startoftext|>a<|endoftext|>", "<|end", "😀😀 ok", "ß ẞ İ ǅ", "é ́a"]
    assert tool.count(texts) == [len(ids_of(tokenizer, t)) for t in texts]


def test_scan_composes_maps():
    rng = np.random.default_rng(4)
    maps = rng.integers(0, 5, (37, 5)).astype(np.uint8)
    got = token_counts.compose_scan(maps)
    state = np.arange(5)
    for i, m in enumerate(maps):
        state = m[state]
        assert (got[i] == state).all()


# Search

def plain_top_k(rows, k, step):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q) in enumerate(vectors):
        if i % step:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(vectors)
                       if m != n and len(c) == len(q))[:k]
        out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("shard_rows", [8192, 16])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(150)]
    rows += [(i, [1.0] * 6) for i in range(200, 260)] + [(50, [0.5] * 6), (50, [0.5] * 6), (300, None), (350, [None] * 6),
                                                       (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [1e6] * 6),
                                                       (550, [1.0, 2.0]), (551, [3.0, -1.0]), (None, [1.0] * 6), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(df, shard_rows=shard_rows, query_step=50).collect()
    assert Counter(tuple(r) for r in got) == plain_top_k(rows, 5, 50)
    assert topk_search.exact_top_k(df.limit(0)).count() == 0


def test_grammar_of_a_shard_is_the_plain_one():
    """The rounds as they are defined, with every place looked at again in every round."""
    import numpy as np

    from tremorgrid.llm.token_files import _by_pair, _compatible, _overlapping, compress

    def plain(ids, vocabulary, barrier, least=4):
        symbols, lengths, closing, rules = ids.astype(np.int64), np.ones(vocabulary, np.int64), {barrier}, []
        while len(symbols) > 1:
            usable = ~np.isin(symbols[:-1], list(closing))
            usable[_overlapping(symbols)] = False
            at = np.flatnonzero(usable)
            if not len(at):
                break
            keys, at = _by_pair(symbols[at], symbols[at + 1], at, len(lengths), len(symbols))
            pairs, counts = np.unique(keys, return_counts=True)
            if counts.max() < least:
                break
            many = np.flatnonzero(counts >= least)
            many = many[np.argsort(-counts[many], kind="stable")]
            taken = np.sort(pairs[many][_compatible(pairs[many] >> 32, pairs[many] & 0xFFFFFFFF, len(lengths))])
            for pair in taken.tolist():
                left, right = pair >> 32, pair & 0xFFFFFFFF
                closing |= {len(lengths)} if right in closing else set()
                places = at[keys == pair]
                symbols[places], symbols[places + 1] = len(lengths), -1
                lengths = np.append(lengths, lengths[left] + lengths[right])
                rules.append((left, right))
            symbols = symbols[symbols >= 0]
        return symbols.tolist(), rules

    rng = np.random.default_rng(3)
    cases = [rng.integers(0, many, size) for many, size in ((4, 3000), (30, 5000), (2, 400), (5, 1), (5, 2))]
    for ids in [*cases, np.full(100, 3), np.zeros(0, np.int64)]:
        symbols, rules, _ = compress(ids, 40, 2)
        assert (symbols.tolist(), [tuple(x) for x in rules.tolist()]) == plain(ids, 40, 2)


def test_words_of_ascii_letters_with_one_mark(library):
    from tremorgrid.llm import token_files

    path = vocabulary("byte_bpe_50k.json")
    encoder = token_files.ByteLevelEncoder(path, 4)
    assert encoder.simple and "'" not in encoder.simple and "7" not in encoder.simple
    letters = ["a", "Word", "qzx", "don"]
    texts = ["x " + w + m for w in letters for m in ["", *map(chr, range(33, 127))]]
    want = [b"".join(i.to_bytes(4, "little") for i in encoder.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.encode(texts) == want
    slow = token_files.ByteLevelEncoder(path, 4)
    slow.simple = None
    assert slow.encode(texts) == want
