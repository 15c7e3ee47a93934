"""Operators on small tables against brute force, with the awkward rows of each."""

import hashlib
import math
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from occuspan.llm import bpe, class_lm, clean_lines, jaccard, licenses, line_dedup, mixing, neighbours, quality, ring
from occuspan.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, size string"
LONG = "long word " * 20_000
EDGES = [(100, None, None, "x"), (101, "", "b", "x"), (102, " \t\n ", "b", "x"), (None, "no id here at all", "b", "x"), (103, LONG, "b", "x")]


def docs_of(spark, texts, edges=EDGES):
    rows = [(i, t, f"s{i % 3}", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *edges], SCHEMA).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(n))


def near_copies(seed=1):
    """Bases, copies with growing edits, exact copies, and a passage many texts share."""
    rng = random.Random(seed)
    texts, passage = [], prose(rng, 30)
    for _ in range(12):
        base = prose(rng, 120, 3000).split()
        texts += [" ".join(base)] * 2
        for edits in range(1, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            texts.append(" ".join(copy))
    texts += [prose(rng, 20, 3000) + " " + passage for _ in range(30)]
    return [*texts, "one", "one two", "one two", "One TWO three", "é è"]


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("short_list", [16, 2])
@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, size, percent, short_list):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    docs = docs_of(spark, near_copies())
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    found = jaccard.jaccard_components(docs, size, percent, sketch_bits=12)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, size, percent)


def test_pairs_on_several_long_lists_come_once(spark):
    groups, tokens = 20, 30
    bins = np.full(jaccard.BINS, 1, np.uint16).tobytes()
    placed = spark.createDataFrame([(g, bytes([g]), 100, bytes([g]), bytearray(bins)) for g in range(groups)], "gid long, node binary, n long, root binary, bins binary")
    lists = spark.createDataFrame([(t - 7, g, t) for g in range(groups) for t in range(tokens)], "token long, gid long, at int")
    found = [(bytes(r.a), bytes(r.b)) for r in jaccard.long_pairs(lists, placed, 80).collect()]
    assert len(found) == len(set(found)) == groups * (groups - 1) // 2


def test_pairs_share_only_later_tokens_of_long_lists(spark):
    bins = np.full(jaccard.BINS, 1, np.uint16).tobytes()
    placed = spark.createDataFrame([(g, bytes([g]), 100, bytes([g]), bytearray(bins)) for g in range(3)], "gid long, node binary, n long, root binary, bins binary")
    own = [(1000 * g + t, g, t) for g in range(3) for t in range(jaccard.FIRST_TOKENS + 4)]
    lists = spark.createDataFrame([*own, *((9000 + t, g, 50) for g in range(3) for t in range(2))], "token long, gid long, at int")
    found = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in jaccard.long_pairs(lists, placed, 80).collect()}
    assert found == {(b"\x00", b"\x01"), (b"\x00", b"\x02"), (b"\x01", b"\x02")}


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA), sketch_bits=12).count() == 0


def languages(spark):
    """Two languages that never mix, words that come once or twice, held-out rows, awkward rows."""
    rng = random.Random(3)
    texts = [" ".join(f"{lang}{int(40 * rng.random() ** 2)}" for _ in range(60)) + f" {lang}_{i // 2} {lang}0" for i, lang in enumerate("ab" * 60)]
    docs = docs_of(spark, [*texts, "Zebra unseen a0"], [(900, None, None, "x"), (901, "", "b", "x"), (None, "no id", "b", "x"), (902, "z" * 200 + " a1 " + "late " * 500, "b", "x")])
    return docs.withColumn("train", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)) & F.coalesce(F.col("doc_id") != 120, F.lit(True)))


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("ranked", [class_lm.RANKED, 20])
def test_class_model(spark, ranked):
    docs = languages(spark)
    found = {(r.doc_id): r for r in class_lm.score_documents(docs, ranked=ranked).collect()}
    rows = docs.collect()
    counts, trained = Counter(), 0
    for r in rows:
        if r.train:
            counts.update(words_of(r.text))
            trained += 1
    n, v = sum(counts.values()) + trained, len(counts) + 1
    for r in rows:
        words = words_of(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((trained + 1) / (n + v + 1))
        got = found[r.doc_id]
        assert got.base_score == pytest.approx(base) and got.n_tokens == len(words) + 1 and got.train_tokens == n
        assert got.n_known == sum(w in counts for w in words) + 1 and got.score < 0
    held = [found[r.doc_id] for r in rows if not r.train and r.doc_id < 120]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def log_likelihood(texts, of, classes):
    """Of the class bigrams of texts with an end between, from its definition."""
    pairs, before, after = Counter(), Counter(), Counter()
    row = [classes + 1]
    for words in texts:
        row += [of[w] for w in words] + [classes + 1]
    for a, b in zip(row, row[1:]):
        pairs[a, b] += 1
        before[a] += 1
        after[b] += 1
    return sum(n * math.log(n / (before[a] * after[b])) for (a, b), n in pairs.items()), pairs


@pytest.mark.parametrize("ranked", [class_lm.RANKED, 20, 0])
def test_class_model_against_brute_force(spark, ranked):
    docs = languages(spark)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        model, classed = class_lm.fitted(docs.select("doc_id", "text", "train"), most=ranked, classes=4)
        rest = {bytes(r.word): r for r in model.rest.collect()}
        found = {r.doc_id: r.score for r in class_lm.score_classed(classed, model, ["doc_id", "train"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = docs.collect()
    train = [words_of(r.text) for r in rows if r.train]
    counts = Counter(w for words in train for w in words)
    # Each training word has one class; words are kept apart by their counts and lengths.
    assert len(model.words) <= ranked and set(model.words).isdisjoint(rest) and {*model.words, *rest} == set(counts)
    assert all(r.n == counts[w] and 0 <= r["class"] < 4 for w, r in rest.items())
    of = dict(zip(model.words, model.class_of.tolist())) | {w: r["class"] for w, r in rest.items()}
    assert all(0 <= c < 4 for c in of.values())
    assert ranked == 0 or model.likelihoods == sorted(model.likelihoods) and len(model.likelihoods) > 1
    # The tables' likelihood is that of the texts, and the best class of a word outside the ranks has none better.
    whole, pairs = log_likelihood(train, of, 4)
    assert class_lm.likelihood(model.transitions) == pytest.approx(whole)
    some = sorted(rest)[:4] + [w for w in (b"late",) if w in rest]
    for w in some:
        before = [log_likelihood(train, {x: of[x] if x in model.words else 4 for x in of} | {w: c}, 4)[0] for c in range(4)]
        # `inserted` leaves the word's own old place among the other words in the counts.
        assert before[rest[w]["class"]] >= max(before) - 1.0
    # Scores from their definition.
    once, twice = (sum(n == i for n in counts.values()) for i in (1, 2))
    d, states = min(max(once / (once + 2 * twice), 0.1), 0.9), [0, 1, 2, 3, 5]
    size, kinds = Counter(), Counter()
    for w, n in counts.items():
        size[of[w]] += n
        kinds[of[w]] += 1
    total = sum(pairs.values())
    share = {b: (sum(pairs[a, b] for a in states) + 1) / (total + 5) for b in states}
    move = {(a, b): (pairs[a, b] + 20 * share[b]) / (sum(pairs[a, c] for c in states) + 20) for a in states for b in states}
    left = {b: d * kinds[b] / size[b] if size[b] else 1.0 for b in states[:4]} | {5: 0.0}
    weight = {b: share[b] * left[b] / sum(share[c] * left[c] for c in states) for b in states}
    for a in states:
        move[a, 4] = sum(move[a, b] * left[b] for b in states)
    for b in [*states, 4]:
        move[4, b] = sum(weight[a] * move[a, b] for a in states)
    for r in rows:
        words = words_of(r.text)
        row = [5, *(of.get(w, 4) for w in words), 5]
        score = sum(math.log10(move[p]) for p in zip(row, row[1:]))
        score += sum(math.log10((counts[w] - d) / size[of[w]]) if w in of else -math.log10(len(counts) + 2) for w in words)
        assert found[r.doc_id] == pytest.approx(score)


def test_class_moves_against_brute_force():
    """A word taken out of its class goes where the likelihood of all texts is highest."""
    rng = random.Random(8)
    texts = [[rng.randrange(12) for _ in range(9)] for _ in range(40)]
    of = {w: w % 3 for w in range(12)}
    _, pairs = log_likelihood(texts, of, 3)
    matrix = np.array([[pairs[a, b] for b in range(5)] for a in range(5)])
    left, right, own = np.zeros((12, 5)), np.zeros((12, 5)), Counter()
    for words in texts:
        row = [4, *(of[w] for w in words), 4]
        for i, w in enumerate(words):
            left[w, row[i]] += 1
            right[w, row[i + 2]] += 1
            own[w] += i > 0 and words[i - 1] == w
    chosen = class_lm.best_moves(left, right, np.arange(12) % 3, matrix, 3)
    for w in range(12):
        if not own[w]:  # a word beside itself is counted as beside its old class
            found = [log_likelihood(texts, of | {w: c}, 3)[0] for c in range(3)]
            assert found[chosen[w]] == pytest.approx(max(found))


def test_class_model_probabilities_sum_to_one():
    pairs = np.array([[1, 2, 0, 0, 1], [0, 1, 3, 0, 0], [2, 0, 1, 0, 4], [0, 0, 0, 0, 0], [1, 1, 5, 0, 0]], np.int64)
    sizes, kinds = np.array([5.0, 4.0, 9.0]), np.array([2, 1, 3])
    moves = 10 ** class_lm.log_transitions(pairs, sizes, kinds, 0.6)
    known = 1 - 0.6 * kinds / sizes  # what a class keeps for its words
    assert np.allclose((moves[:, :3] * known).sum(1) + moves[:, 3] + moves[:, 4], 1)


def test_class_model_of_nothing_and_of_a_long_text(spark):
    empty = class_lm.score_documents(spark.createDataFrame([], SCHEMA).withColumn("train", F.lit(True)))
    assert empty.columns == ["doc_id", "source", "size", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and empty.count() == 0
    # Repeated rows count as often as they come; a long text is taken whole.
    docs = docs_of(spark, ["a b a", "a b a"]).withColumn("train", F.lit(True))
    found = {r.doc_id: r for r in class_lm.score_documents(docs, ranked=2).collect()}
    assert found[103].n_tokens == 40_001 and found[103].n_known == 40_001 and found[103].score < 0
    assert found[0].score == found[1].score and {found[i].n_tokens for i in (100, 101, 102)} == {1}


def test_class_model_without_training(spark):
    rows = class_lm.score_documents(docs_of(spark, ["a b"]).withColumn("train", F.lit(False))).collect()
    assert {r.base_score for r in rows} == {0.0} and {r.n_known for r in rows} == {0}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    points = (centres[rng.integers(0, 8, 1200)] + 0.4 * rng.normal(size=(1200, 16))).astype(np.float32)
    points[400:800] = points[400]  # a vector that a third of the rows share
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [None] + [1.0] * 15), (2300, [float("nan")] + [1.0] * 15), (2400, [1.0]), (2500, [])]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    found = neighbours.search(table, F.col("vec_id") % 100 == 0, probed=6, parts=16).collect()
    assert {r.query_id for r in found} == set(range(0, 1200, 100)) and len(found) == 120
    exact, hits = points.astype(np.float64), 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in own)
        if 400 <= q < 800:
            assert [v for _, v, _ in own] == best.tolist()
        hits += len({v for _, v, _ in own} & set(best.tolist()))
    assert hits >= 0.9 * 120


def test_neighbours_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found = neighbours.search(table, F.col("vec_id") == 0).orderBy("query_id", "rank").collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 0, 0.0)] * 2 + [(2, 1, math.sqrt(2))] * 2
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_line_cleaning(spark):
    rng = random.Random(2)
    texts = ["\n".join(prose(rng, 30, 5000) + "." for _ in range(4)), "Home | About | Log in\nclick here\n" * 9, "a b c d " * 40, ("x%%% y*** z&&& " * 20).strip()]
    found = {r.doc_id: r for r in clean_lines.clean_documents(docs_of(spark, texts)).collect()}
    kept = sorted(r.doc_id for r in found.values() if r.kept)
    assert kept == [0] or kept == [0, 103]
    assert found[2].n_repeat_words == 160 and found[2].base_failed and found[100].n_words == 0 and found[102].cleaned == " \t\n "
    assert found[1].n_dup_lines == 16 and found[3].n_symbols == 180 and not found[3].kept and found[1].size == "clash"


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c", "x a b c y a b c z", "a b", "", "a b a b a"])
def test_repeated_words(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert clean_lines.repeated_words(words) == len(inside)


def test_mixing(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(150)]
    edges = [(900, None, None, "x"), (901, "", "empty", "x"), (902, "null source", None, "x"), (None, "no id", "s0", "x")]
    docs = docs_of(spark, texts, edges).drop("size")
    mix = mixing.mix_sources(docs, block_words=16, shard_slots=64)
    taken = {r["__row"]: r.taken for r in mixing.taken_words(mix).collect()}
    sources = mix["sources"].collect()
    assert [r.source for r in sorted(sources, key=lambda r: r.rank)] == ["empty", "s0", "s1", "s2", None]
    total = sum(r.source_size for r in sources)
    assert sum(r.target for r in sources) == pytest.approx(min(1.5 * total, 2 * total))
    rows = mix["rows"].collect()
    for r in rows:
        assert taken.get(r["__row"], 0) <= 2 * r["size"]
    for s in sources:
        got = sum(taken.get(r["__row"], 0) for r in rows if r.source == s.source)
        assert abs(got - s.target) <= 16 and s.target <= 2 * s.source_size
    again = {r["__row"]: r.taken for r in mixing.taken_words(mixing.mix_sources(docs, block_words=16, shard_slots=64)).collect()}
    assert sorted(again.values()) == sorted(taken.values())
    pieces = mixing.mixed_documents(docs, block_words=16, shard_slots=64)
    assert pieces.columns == docs.columns
    words = pieces.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(taken.values())
    assert mixing.taken_words(mixing.mix_sources(docs.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000])
def test_permutations(n):
    size = np.full(n, n, np.uint64)
    assert sorted(mixing.permuted(np.arange(n, dtype=np.uint64), size, np.full(n, 7, np.uint64)).tolist()) == list(range(n))


def test_license_scan(spark):
    filler = " ".join(f"w{i}" for i in range(90))
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    assert len(mit.split()) > 50
    edited = mit.replace("free of charge", "gratis")
    texts = [filler, f"{filler} Released under the MIT License. {filler}", f"{filler}\n{edited}\n{filler}", "LICENSED under the Apache-License, version 2.0; Licensed under CC BY-NC 4.0"]
    found = sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs_of(spark, texts)).collect())
    assert found == [(1, "MIT-notice"), (2, "MIT"), (3, "Apache-2.0-notice"), (3, "CC-BY-NC-4.0-notice")]
    long_text = " ".join(f"t{i}" for i in range(700))
    own = spark.createDataFrame([("long", long_text), ("short", "too short")], "license string, text string")
    hit = licenses.scan_licenses(docs_of(spark, [f"{filler} {long_text} {filler}", " ".join(long_text.split()[:300])]), own).collect()
    assert [(r.doc_id, r.license, r.first_word, r.containment) for r in hit] == [(0, "long", 90, 1.0)]
    assert licenses.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


TOKEN_TEXTS = [
    "Hello  World's\n\n 123 café ÀÉ 你好 <|endoftext|>a b", "a\x00b ​ x\x1cy\x85z", "𝒳y don't I'LL 12a_b", "ΣΑΣ ς Σ İi ǅ ŉ ﬁ",
    "é 가 <|startoftext|><|endoftext|> <|", "!!!??? ---- a'b'c ''''s", "ſ K ẞ ß", "٣٤ Ⅷ ² ½",
]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    wild = ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x3000)))) for _ in range(200)) for _ in range(60)]
    texts = [*TOKEN_TEXTS, *wild, "the quick brown fox " * 50]
    for words in (0, 40):
        for r in bpe.encode_documents(docs_of(spark, texts), tokenizer_path(), words).collect():
            text = dict(enumerate(texts)).get(r.doc_id, r.text) or ""
            ids = library.encode(text, add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids), text
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_every_letter():
    from tokenizers import Tokenizer

    library, rules = Tokenizer.from_file(tokenizer_path()), bpe.Rules(open(tokenizer_path(), encoding="utf-8").read())
    encoder = bpe.Encoder(rules, bpe.Lexicon.compiled({}))
    letters = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) != "Cs"]
    texts = [f"a{c}b {c}" for c in letters]
    wrong = [t for t, (_, ids, _), e in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)) if ids != " ".join(map(str, e.ids))]
    assert not wrong


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walked", "talked", "walking", "talking", "walk", "a", "é"])}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compiled(words).packed())
    ask = [*words, b"walke", b"walkeds", b"", b"zz", "è".encode()]
    got = lexicon.numbers(ask).tolist()
    assert [lexicon.ids[lexicon.starts[n] : lexicon.starts[n + 1]].tolist() for n in got[: len(words)]] == list(words.values())
    assert got[len(words) :] == [-1] * 5
    assert len(lexicon.final) - 1 < sum(map(len, words)) / 2  # equal suffixes share their states


def test_quality_classifier(spark):
    rng = random.Random(6)
    texts = [prose(rng, 80) + "." if i % 3 else "buy now " * 30 + "$$$" for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    docs = docs_of(spark, texts)
    weights = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, weights).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == 245
    held = [r for r in rows if r.doc_id is not None and 200 <= r.doc_id or r.doc_id in range(200, 240)]
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id in range(200, 240)) and held
    blank = quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), weights).count() == 0


def brute_lines(rows, min_docs):
    def keys(text):
        return [x.encode().strip(b" \t\n\x0b\x0c\r").lower() for x in (text or "").split("\n")]

    held = Counter(k for _, t in rows for k in set(keys(t)))
    made = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, keys(t)) if not (k and held[k] >= min_docs)]
        made.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(made, key=repr)


@pytest.mark.parametrize("limit", [100, 0])
def test_line_dedup(spark, limit):
    rng = random.Random(8)
    texts = ["\n".join(f"{rng.choice(['', ' ', 'É '])}Line {int(30 * rng.random() ** 3)}" for _ in range(8)) for _ in range(60)]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 1"))
    found = line_dedup.dedup_lines(docs, filter_bits=1 << 14, broadcast_keys=limit)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=repr)
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()], 10)
    first = line_dedup.dedup_lines(docs.filter("doc_id <> 1"), keep="first", filter_bits=1 << 14, broadcast_keys=limit).collect()
    lines = Counter(x.strip().lower() for r in first for x in r.text.split("\n") if x.strip())
    assert lines["line 0"] == 1 and lines["é line 0"] == 1
    assert line_dedup.dedup_lines(docs.limit(0), filter_bits=1 << 14).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 501])
def test_ring_rows(spark, n):
    docs = spark.createDataFrame([(i // 2 if i < 200 else i, "x") for i in range(n)], "doc_id long, slot string").repartition(3)
    rows = ring.assign_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and all(n // 8 <= sizes.get(s, 0) <= -(-n // 8) for s in range(8))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(k)) for s, k in sizes.items())


def test_ring_weights_and_movement(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("w"))
    loads = Counter()
    for r in ring.assign_shards(docs, weight="w", slack=0.05).collect():
        loads[r.shard] += r.w
    assert max(loads.values()) <= 1.05 * sum(loads.values()) / 8 + 7
    before = {r.doc_id: r.shard for r in ring.assign_shards(docs, 8, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in ring.assign_shards(docs, 9, slack=0.25).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.35 * len(before)


def test_quality_learns_from_as_many_as_usable(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(60)], [])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    learnt = docs.filter(quality.id_remainder(F.col("doc_id"), 5) != 0)
    usable = learnt.count()
    assert quality.training_rows(learnt, labels, "quality", 30, 10).count() == min(30, usable) == 30
    assert quality.training_rows(learnt, labels, "quality", 100, 10).count() == usable


def test_ring_rows_without_load(spark):
    docs = spark.createDataFrame([(i, 1 if i < 80 else None if i % 2 else 0) for i in range(120)], "doc_id long, w long").repartition(3)
    rows = ring.assign_shards(docs, weight="w").collect()
    assert sorted(r.doc_id for r in rows) == list(range(120))
    assert set(Counter(r.shard for r in rows if r.w).values()) == {10}
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("kind, clash", [("string", "clash"), ("long", 1)])
def test_mixing_counts_the_text(spark, kind, clash):
    texts = [prose(random.Random(i), 20 + i) for i in range(40)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", clash) for i, t in enumerate(texts)], f"doc_id long, text string, source string, size {kind}")
    mix = mixing.mix_sources(docs, block_words=16, shard_slots=64)
    assert {r.doc_id: r["size"] for r in mix["rows"].collect()} == {i: 20 + i for i in range(40)}
    taken = sum(r.taken for r in mixing.taken_words(mix).collect())
    pieces = mixing.mixed_documents(docs, block_words=16, shard_slots=64)
    assert pieces.columns == docs.columns and {r["size"] for r in pieces.collect()} == {clash}
    assert pieces.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == taken > 0


def test_a_text_of_a_million_words_is_cut_once(spark):
    """Cutting must follow the length of a text, not the number of its parts times its length."""
    words = [f"w{i}" for i in range(1_000_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "s"), (2, "a b c " * 40_000, "t")], "doc_id long, text string, source string")
    began = time.monotonic()
    found = mixing.mixed_documents(docs, share=0.5).collect()
    assert time.monotonic() - began < 120
    known = set(words)
    for r in found:
        got = r.text.split()
        assert got and (r.doc_id != 1 or (len(set(got)) == len(got) and known.issuperset(got)))


def test_pieces_merged_together_are_merged_alike():
    rng = random.Random(5)
    rules = bpe.Rules(open(tokenizer_path(), encoding="utf-8").read())
    letters = "etaoinshrdlu'0é語\U0001f600"
    pieces = ["a", "aa", "aaaaaaaa", "x" * bpe.LONGEST_PIECE, "th" * 40, "\ud800", "日本語"] + ["".join(rng.choices(letters, k=rng.randint(1, 20))) for _ in range(5000)]
    rng.shuffle(pieces)
    assert rules.merged_together(pieces) == [rules.merged(p) for p in pieces]
    rules.tables = None
    assert rules.merged_together(pieces[:9]) == [rules.merged(p) for p in pieces[:9]]
    assert rules.merged_together([]) == []
