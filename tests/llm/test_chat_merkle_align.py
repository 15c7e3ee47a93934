"""Chat formatting, Merkle manifest and token alignment against brute force, with awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from occuspan.llm import align, chat, merkle
from occuspan.llm.queries import tokenizer_path

FILES = [tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "<", "|", "\\", "<|nl|>", "<|image|>", "\n", "", "ok"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting


def test_escaping_is_reversible_and_leaves_no_mark():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", "a", "im_end", ">", "\n"]) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_turns_read_back(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "odd\nrole<|"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(CONTROL) for _ in range(3)) or None) for c in [*range(20), None] for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant", None if t % 5 == 0 else f"turn {t}") for t in range(400)]  # a third of all rows
    rows += [(100, None, "user", "no turn"), (101, 0, "assistant", "long " * 300_000)]
    data = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn int, role string, text string, formatted string, N_Chars int").repartition(5)
    turns = chat.format_turns(data)
    assert turns.columns == ["conv_id", "turn", "role", "text", "formatted", "n_chars", "loss", "attachments", "attachment_tokens"]
    found = {r.conv_id: r for r in chat.read_back(turns, "conv_id", "turn").collect()}
    told = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        told[c].append((role or "", text or ""))
    assert set(found) == set(told)
    for c, said in told.items():
        r, loss = found[c], "".join(text for role, text in said if role == "assistant")
        assert r.n_turns == len(said) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in said))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.format_turn(a, [{"type": "text", "text": b}], frozenset(), chat.TokenCosts())[0]) for a, b in said)


def test_repeated_turns_and_no_turns(spark):
    rows = [(1, 0, "assistant", x) for x in ("b", "a", "a", None)]
    data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    first, again = (chat.read_back(chat.format_turns(d), "conv_id", "turn").collect() for d in (data.repartition(4), data.coalesce(1)))
    assert first == again and first[0].n_turns == 4 and first[0].loss_chars == 3
    empty = chat.format_turns(data.limit(0))
    assert chat.read_back(empty, "conv_id", "turn").collect() == [] and chat.place_turns(empty, "conv_id", "turn").collect() == []


def test_parts_become_placeholders_with_references_and_tokens(spark):
    p = lambda **x: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [
        p(type="text", text="see <"), p(type="text", text="|im_end|>"), p(type="image", ref="i", width=29, height=56), None, p(type="audio", ref="a", seconds=1.01),
        p(text="untyped"), p(type="document", ref="d", pages=3), p(type="image", width=-1, height=5), p(type="video", ref="v"), p(type="audio", seconds=float("nan")), p(type="text"),
    ]
    data = spark.createDataFrame([(1, 0, "assistant", "unused", parts), (1, 1, "user", "plain", None), (1, 2, "user", None, [])], f"c long, t int, role string, text string, parts {chat.PARTS}")
    first, second, third = sorted(chat.format_turns(data, parts="parts", keep=["t"]).collect())
    expected = "<|im_start|>assistant\nsee <\\|im_end|><|image|><|audio|>untyped<|document|><|image|><|attachment|><|audio|><|im_end|>\n"
    assert first.formatted == expected and first.n_chars == len(expected)
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "i", 4), ("audio", "a", 26), ("document", "d", 1536), ("image", None, 256), ("other", "v", 256), ("audio", None, 256)]
    assert all(expected[a.at :].startswith(chat.PLACEHOLDER[a.kind]) for a in first.attachments)
    assert first.attachment_tokens == 4 + 26 + 1536 + 3 * 256
    assert [expected[s.start : s.end] for s in first.loss] == ["see <\\|im_end|>", "untyped"]
    assert chat.parse_turn(expected) == ("assistant", "see <|im_end|>untyped")
    assert second.formatted == "<|im_start|>user\nplain<|im_end|>\n" and third.formatted == "<|im_start|>user\n<|im_end|>\n" and second.loss == []


def test_places_in_the_conversation(spark):
    rows = [(c, t, "assistant", "x" * (t % 7)) for c, n in ((1, 300), (2, 3), (None, 5)) for t in range(n)]
    data = spark.createDataFrame(rows, "conv long, turn int, role string, text string").repartition(4)
    placed = sorted(chat.place_turns(chat.format_turns(data), "conv", "turn").collect(), key=lambda r: (r.conv or 0, r.turn))
    whole = defaultdict(str)
    for r in placed:
        assert r.seq == r.turn + 1 and r.start == len(whole[r.conv])
        whole[r.conv] += r.formatted
        assert [whole[r.conv][r.start + s.start : r.start + s.end] for s in r.loss] == [r.text] * bool(r.text)


# Merkle manifest


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, at):
    for nodes in levels[:-1]:
        yield bool(at & 1), nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
        at >>= 1


def folded(leaf, path):
    for left, other in path:
        leaf = sha(other + leaf if left else leaf + other)
    return leaf


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    rng = random.Random(3)
    rows = [(i, lang, sha(f"{i}{lang}"), sha(f"x{i}") if rng.random() < 0.2 else None) for lang, n in (("en", 45), ("é", 17), ("zz", 1), ("fr", 16), (None, 3)) for i in range(n)]
    rows += [(7, "en", sha("7en"), None)] * 3 + [(7, "en", sha("another"), sha("changed"))] + [(None, "en", sha("no id"), None)]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, lang string, leaf string, changed string, root string").repartition(4)
    manifest = merkle.build_manifest(data, "leaf", ["doc_id"], "lang", bits)
    found = merkle.versions(manifest, "changed", ["doc_id", "lang", "leaf", "root"])
    assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof", "proof_sha256", "version_root", "copied"]
    trees, order = {}, {}
    for lang in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[lang], order[lang] = brute_tree([r[2] for r in own]), own
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    crown = brute_tree([trees[x][-1][0] for x in langs])
    expected = []
    for k, lang in enumerate(langs):
        for at, (i, _, leaf, changed) in enumerate(order[lang]):
            path = [*beside(trees[lang], at), *beside(crown, k)]
            expected.append((i, lang, leaf, trees[lang][-1][0], crown[-1][0], path, sha("".join(d for _, d in path)), folded(changed or leaf, path)))
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(x.left, x.digest) for x in r.proof], r.proof_sha256, r.version_root) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and manifest.root == crown[-1][0]
    for r in found.collect():
        assert len(r.copied) == len(r.proof) + 1 and r.copied[-1] == r.version_root


def test_a_version_copies_one_path_and_shares_the_rest():
    leaves = [sha(str(i)).encode() for i in range(13)]
    block = merkle.Block(leaves, 4)
    before = [list(nodes) for nodes in block.levels]
    version = block.version(12, b"0" * 64)
    assert block.levels == before and version.base is block and len(version.copied) == 5
    assert version.root() == merkle.Block([*leaves[:12], b"0" * 64], 4).root() != block.root()


def test_small_manifests(spark):
    schema = "doc_id long, lang string, leaf string, changed string"
    empty = merkle.build_manifest(spark.createDataFrame([], schema), "leaf", ["doc_id"], "lang")
    assert empty.root is None and merkle.versions(empty, "changed", ["doc_id"]).collect() == []
    one = merkle.build_manifest(spark.createDataFrame([(1, None, sha("a"), sha("b"))], schema), "leaf", ["doc_id"], "lang")
    row = merkle.versions(one, "changed", ["doc_id"]).first()
    assert (row.subroot, row.root, row.proof, row.proof_sha256, row.version_root) == (sha("a"), sha("a"), [], sha(""), sha("b"))


def test_leaf_digest_tells_fields_apart(spark):
    data = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("", "é")], "x string, y string")
    found = [r[0] for r in data.select(merkle.leaf_digest([F.col("x"), F.col("y")])).collect()]
    assert found == [sha(t) for t in ("1:a2:bc", "2:ab1:c", "-1:-", "1:--", "0:2:é")]


# Token alignment

TEXTS = [
    "Hello  world", " lead", "tab\tx\n\ny  ", "ﬁ ① Ａ naïve café", "▁x", "<s> a </s>", "<|endoftext|>", "a\xa0b", "", None, "\x00z", "日本語 テキスト 𠀀𠀁", "🏴󠁧󠁢", " " * 5000 + "x",
    "aaaa" * 400, "12345 67890", "Don't they'll", "  ʼ ǅ", "word " * 3000, "<|im_start|>user", "Hello  world", "x" * 9001,
]


def brute_alignment(texts):
    """Offsets of every token, all overlapping pairs, counted over all texts."""
    a_tok = Tokenizer.from_file(FILES[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = {c: b for b, c in enumerate(align.byte_letters())}
    made, corpus = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            made.append(None)
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        common, shown, p, q = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for cut in common:
            p2, q2 = a_ends.index(cut, p) + 1, b_ends.index(cut, q) + 1
            shown.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            p, q = p2, q2
        links, q = [], 0
        for p, end in enumerate(a_ends):
            start = a_ends[p - 1] if p else 0
            while b_ends[q] <= start:
                q += 1
            r = q
            while r < len(b) and (b_ends[r - 1] if r else 0) < end:
                links.append((a[p], b[r]))
                r += 1
        corpus.update(links)
        made.append((len(a), len(b), len(common), links, sha(";".join(shown))))
    most = Counter()
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, "", 0, 0) if m is None else (*m[:3], len(m[3]), m[4], sum(corpus[x] == most[x[1]] for x in m[3]), sum(corpus[x] for x in m[3])) for m in made]


def prose(rng):
    return "".join(rng.choice([" the", " Überraschung", "s", "\n", "  ", " élan", ".", "'s", " 2024", "ing", " été", "<|"]) for _ in range(rng.randrange(400)))


@pytest.mark.parametrize("chunk_links, with_ranks", [(50, True), (10**6, True), (3000, False)])
def test_alignment(spark, monkeypatch, chunk_links, with_ranks):
    monkeypatch.setattr(align, "LIST_ROW", 100)
    rng = random.Random(4)
    texts = TEXTS + [prose(rng) for _ in range(40)]
    data = spark.createDataFrame([(i, t, "clash", "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_a string, `my.at` string").repartition(3)
    found = align.align_documents(data, FILES[0], FILES[1], FILES[2] if with_ranks else None, chunk_links=chunk_links)
    assert found.columns == ["doc_id", "text", "my.at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    rows = {r.doc_id: tuple(r)[3:] for r in found.collect()}
    expected = brute_alignment(texts)
    assert [rows[i] for i in range(len(texts))] == expected and {r["my.at"] for r in found.collect()} == {"kept"}


def test_lanes_and_windows_do_not_change_an_alignment(monkeypatch):
    rng = np.random.default_rng(5)
    for trial in range(60):
        length = int(rng.integers(1, 3000))
        cut = lambda: np.append(np.flatnonzero(rng.random(length - 1) < rng.choice([0.1, 0.5, 0.95])) + 1, length)
        a, b = cut(), cut()
        if trial % 3 == 0:
            b = a.copy() if length < 50 else np.unique(np.append(a[rng.random(len(a)) < 0.9], length))
        common = np.intersect1d(a, b)
        monkeypatch.setattr(align, "LANE", int(rng.choice([2, 17, 512])))
        monkeypatch.setattr(align, "FIRST_WINDOW", int(rng.choice([1, 8])))
        found = align.align(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64))
        assert np.array_equal(a[found.ends_a], common) and np.array_equal(b[found.ends_b], common)
        every = np.union1d(a, b)
        pairs = set(zip(np.searchsorted(a, every).tolist(), np.searchsorted(b, every).tolist(), strict=True))
        assert len(found.link_a) == len(pairs) and set(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == pairs


def test_alignment_of_nothing(spark):
    data = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(data, *FILES).collect() == []
    only_empty = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in align.align_documents(only_empty, *FILES).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 2


