"""BPE encoding through a lexicon of frequent words, kept as a minimal automaton.

The frequent pieces of the whole corpus are counted, encoded once, and compiled into
an acyclic automaton whose equal suffixes are shared. Its arcs carry numbers that
add up to a word's number, which leads to the word's ids. The automaton is a few
flat arrays; every Python worker maps them from one unlinked file. Pieces it does not
hold are merged pair by pair by the tokenizer's own ranks, so results are exact.

Rules of cutting and merging come from the tokenizer file: NFC, white space to one
space, lower case per character; special tokens cut raw text first; no decoder, so
decoding joins token strings by spaces.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from occuspan.llm.common import add_text_columns, give_back, shared_folder, stage

LEXICON_WORDS = 1 << 17
LONGEST_PIECE = 64
# Texts handled together, words remembered by a worker, words counted before they are sent.
TEXTS_AT_ONCE = 256
REMEMBERED = 300_000
COUNTED_AT_ONCE = 400_000
NO_RANK = 1 << 60
# Pieces merged together, and what stands for no rank among theirs.
MERGED_AT_ONCE = 4096
LAST_RANK = np.iinfo(np.int32).max
MARKS = frozenset(",.;:!?")
# Python's split() also cuts at these, which are no white space by Unicode.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")
# Every code point before is assigned; one look spares Latin texts the long list of those that are not.
LATER = re.compile("[\u0378-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter each byte has in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(256 + spare))
        spare += b not in plain
    return letters


def as_ranges(letters: str) -> str:
    """Rising code points as ranges of a character class."""
    ranges: list[list[int]] = []
    for c in map(ord, letters):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Rules:
    """What the tokenizer file says."""

    def __init__(self, source: str):
        whole = json.loads(source)
        model = whole["model"]
        kinds = [x["type"] for x in whole["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or whole["decoder"] or whole["post_processor"] or model["unk_token"]:
            raise ValueError("this tokenizer has rules that are not covered here")
        self.vocab = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(self.pattern)
        self.careful = None
        # Code points too new for this Python; capitals among them are lowered by the library.
        letters = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
        self.unknown = re.compile(f"[{as_ranges(letters)}]")
        new = "".join(regex.findall(r"\p{Lu}", letters))
        self.new_capitals = re.compile(f"[{as_ranges(new)}]") if new else None
        self.nfc, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.letters = byte_letters()
        self.top = max(self.vocab.values(), default=0) + 1  # no id is as high
        self.tables = self.merge_tables()

    def cut_chunk(self, chunk: str) -> list[str]:
        """The pieces of a chunk. Code points too new for this Python are left to the library's own cutting."""
        # Letters are one piece; one mark that ends them is another.
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        if chunk.isascii() or not LATER.search(chunk) or not self.unknown.search(chunk):
            return self.pieces.findall(chunk)
        if self.careful is None:
            self.careful = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return [piece for piece, _ in self.careful.pre_tokenize_str(chunk)]

    def chunks(self, text: str) -> list[str]:
        """Normalized runs without white space; special tokens stay whole."""
        if "<|" in text and self.cut and (parts := self.cut.split(text)):
            return [x for p in parts for x in ([p] if p in self.special else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            # The library knows fewer marks, so it composes itself where anything is to be composed.
            if not unicodedata.is_normalized("NFC", text):
                text = self.nfc.normalize_str(text)
            if self.new_capitals and self.new_capitals.search(text):
                text = self.lower.normalize_str(text)
        # Lower case is per character: a last sigma has no form of its own.
        text = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
        return [x for x in WHITE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def merged(self, piece: str) -> list[int]:
        """Pair by pair, lowest rank first, leftmost first."""
        parts = [self.letters[b] for b in piece.encode("utf-8", "replace")]
        parts[-1] += self.end
        rank = self.ranks.get
        order = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while order and (best := min(order)) < NO_RANK:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), NO_RANK)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), NO_RANK)
        return [self.vocab[p] for p in parts]

    def merge_tables(self) -> tuple[np.ndarray, ...] | None:
        """Ids of each byte inside a piece and at its end, sorted pairs of ids, their ranks, the id each rank makes;
        None if the vocabulary lacks one of them."""
        vocab = self.vocab.get
        inside, ends = ([vocab(x + tail, -1) for x in self.letters] for tail in ("", self.end))
        pairs = [(vocab(a, -1), vocab(b, -1), rank, vocab(a + b, -1)) for (a, b), rank in self.ranks.items()]
        if not pairs or min(map(min, pairs)) < 0 or min(inside + ends) < 0:
            return None
        left, right, rank, made = np.array(pairs, np.int64).T
        keys = left * (self.top + 1) + right
        order = np.argsort(keys)
        by_rank = np.zeros(rank.max() + 1, np.int32)
        by_rank[rank] = made
        return np.array(inside, np.int32), np.array(ends, np.int32), keys[order], rank[order].astype(np.int32), by_rank

    def merged_together(self, pieces: list[str]) -> list[list[int]]:
        """merged() of each; short pieces of about one length take their steps together."""
        data = [p.encode("utf-8", "replace") for p in pieces]
        if self.tables is None:
            return [self.merged(p) for p in pieces]
        made: list[list[int]] = [[]] * len(pieces)
        short = []
        for i, d in enumerate(data):
            if 0 < len(d) <= LONGEST_PIECE:
                short.append(i)
            else:
                made[i] = self.merged(pieces[i])
        short.sort(key=lambda i: len(data[i]))
        for start in range(0, len(short), MERGED_AT_ONCE):
            at = short[start : start + MERGED_AT_ONCE]
            for i, ids in zip(at, self.merge_rows([data[i] for i in at]), strict=True):
                made[i] = ids
        return made

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """One word a row: in each step every row merges its leftmost pair of the lowest rank."""
        inside, ends, keys, ranks, by_rank = self.tables
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = max(2, int(lengths.max()))
        places, each = np.arange(width), np.arange(n)
        parts, flat = np.full((n, width), -1, np.int32), np.frombuffer(b"".join(words), np.uint8)
        parts[places < lengths[:, None]] = inside[flat]
        parts[each, lengths - 1] = ends[flat[np.cumsum(lengths) - 1]]

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # What lies behind a word's end, -1, is no id, and no sum with it is a pair's.
            want = a.astype(np.int64) * (self.top + 1) + np.where(b < 0, self.top, b)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.where((keys[at] == want) & (a >= 0), ranks[at], LAST_RANK).astype(np.int32)

        order = rank(parts[:, :-1], parts[:, 1:])
        rows, whole = each, parts.copy()
        while True:
            best = order.argmin(1)
            lowest = order[np.arange(len(rows)), best]
            going = lowest < LAST_RANK
            whole[rows[~going]] = parts[~going]
            if not going.any():
                break
            rows, parts, order, best, lowest = rows[going], parts[going], order[going], best[going, None], lowest[going]
            # What follows the pair moves up by one place.
            parts = np.take_along_axis(parts, np.minimum(places + (places > best), width - 1), 1)
            parts[:, -1] = -1
            order = np.take_along_axis(order, np.minimum(places[:-1] + (places[:-1] >= best), width - 2), 1)
            order[:, -1] = LAST_RANK
            each, best = np.arange(len(rows)), best[:, 0]
            parts[each, best] = by_rank[lowest]
            before = each[best > 0]
            order[before, best[before] - 1] = rank(parts[before, best[before] - 1], parts[before, best[before]])
            after = each[best < width - 1]
            order[after, best[after]] = rank(parts[after, best[after]], parts[after, best[after] + 1])
        return [row[:k] for row, k in zip(whole.tolist(), (whole >= 0).sum(1).tolist(), strict=True)]


class Lexicon:
    """Flat arrays of the automaton: arcs sorted by (state, byte), ends, ids by word number."""

    NAMES = ("arcs", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """From words with their ids. States that agree on what follows become one state."""
        register: dict[tuple, int] = {}
        below: list[int] = []
        kept: list[tuple] = []

        def settle(node: list) -> int:
            key = (node[0], *((b, t) for b, t in node[1]))
            number = register.get(key)
            if number is None:
                number = register[key] = len(kept)
                kept.append(key)
                below.append(node[0] + sum(below[t] for _, t in node[1]))
            return number

        ordered = sorted(words)
        path: list[list] = [[0, []]]
        last = b""
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))
            path += [[0, []] for _ in word[shared:]]
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        root = settle(path[0])
        arcs, targets, outputs = [], [], []
        for state, (final, *out) in enumerate(kept):
            passed = final
            for byte, target in out:
                arcs.append(state << 8 | byte)
                targets.append(target)
                outputs.append(passed)
                passed += below[target]
        lists = [words[w] for w in ordered]
        arrays = {
            "arcs": np.array(arcs, np.int64),
            "targets": np.array(targets, np.int32),
            "outputs": np.array(outputs, np.int32),
            "final": np.array([k[0] for k in kept] + [root], np.int32),  # the root's number comes last
            "starts": np.cumsum([0, *map(len, lists)]).astype(np.int32),
            "ids": np.array([i for x in lists for i in x], np.int32),
        }
        return cls(arrays)

    def packed(self) -> bytes:
        return b"".join(len(a := getattr(self, n).tobytes()).to_bytes(8, "little") + a + b"\0" * (-len(a) % 8) for n in self.NAMES)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Views of a mapped file that has no name any more, so nothing stays behind."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        arrays, at = {}, 0
        for name in cls.NAMES:
            size = int.from_bytes(view[at : at + 8], "little")
            kind = np.int64 if name == "arcs" else np.int32
            arrays[name] = np.frombuffer(view, kind, size // np.dtype(kind).itemsize, at + 8)
            at += 8 + size + -size % 8
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 without one: all words take a step together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.arcs):
            return found
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, total, going = np.full(n, self.final[-1], np.int64), np.zeros(n, np.int64), np.flatnonzero(lengths > 0)
        depth = 0
        while len(going):
            want = state[going] << 8 | flat[starts[going] + depth]
            at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[at] == want
            going, at = going[hit], at[hit]
            state[going] = self.targets[at]
            total[going] += self.outputs[at]
            depth += 1
            ended = lengths[going] == depth
            done = going[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = total[done]
            going = going[~ended]
        return found


class Shared:
    """The tokenizer file and the packed lexicon; rules and map are made once a Python worker."""

    def __init__(self, source: str, packed: bytes | None = None):
        self.files, self.made = (source, packed), None

    def __getstate__(self):
        return self.files

    def __setstate__(self, files):
        self.files, self.made = files, None

    def get(self) -> tuple[Rules, Lexicon | None]:
        if self.made is None:
            source, packed = self.files
            self.made = Rules(source), None if packed is None else Lexicon.mapped(packed)
        return self.made


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: what an encoder remembers has none and is too much to look through again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Encoder:
    """Encodes batches of texts; remembers what it has met up to a bound.

    Pieces and the chunks made of them are kept as (ids, number of ids, tokens), both
    joined by blanks already, so a text is put together from finished parts.
    """

    def __init__(self, rules: Rules, lexicon: Lexicon):
        self.rules, self.lexicon = rules, lexicon
        self.known: dict[str, tuple[str, int, str]] = {}
        self.pieces: dict[str, tuple[str, int, str]] = {}

    def learn(self, chunks: set[str]) -> None:
        rules, known, pieces = self.rules, self.known, self.pieces
        if len(known) > REMEMBERED:
            known.clear()
        if len(pieces) > REMEMBERED:
            pieces.clear()
        own = [c for c in chunks if c not in known] if known else list(chunks)
        cuts = [[c] if c in rules.special else rules.cut_chunk(c) for c in own]
        self.learn_pieces(list({p for cut in cuts for p in cut if p not in pieces}))
        for chunk, cut in zip(own, cuts, strict=True):
            if len(cut) == 1:
                known[chunk] = pieces[cut[0]]
            else:
                met = [pieces[p] for p in cut]
                known[chunk] = " ".join([m[0] for m in met]), sum([m[1] for m in met]), " ".join([m[2] for m in met])

    def learn_pieces(self, words: list[str]) -> None:
        rules, lexicon, token = self.rules, self.lexicon, self.rules.token
        numbers = lexicon.numbers([p.encode("utf-8", "replace") for p in words])
        starts, ends = lexicon.starts[numbers].tolist(), lexicon.starts[numbers + 1].tolist()
        others = [p for p, number in zip(words, numbers.tolist(), strict=True) if number < 0 and p not in rules.special]
        merged = iter(rules.merged_together(others))
        for piece, number, start, end in zip(words, numbers.tolist(), starts, ends, strict=True):
            if piece in rules.special:
                ids = [rules.special[piece]]
            elif number >= 0:
                ids = lexicon.ids[start:end].tolist()
            else:
                ids = next(merged)
            if len(ids) == 1:
                self.pieces[piece] = str(ids[0]), 1, token[ids[0]]
            else:
                self.pieces[piece] = " ".join(map(str, ids)), len(ids), " ".join([token[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids and decoded text of each."""
        cut = [self.rules.chunks(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        known, made = self.known, []
        for chunks in cut:
            ids, numbers, tokens = zip(*map(known.__getitem__, chunks)) if chunks else ((), (), ())
            if 0 in numbers:
                ids, tokens = ([x for x, n in zip(part, numbers) if n] for part in (ids, tokens))
            made.append((sum(numbers), " ".join(ids), " ".join(tokens)))
        return made


def count_pieces(docs: DataFrame, sent, text: str = "text") -> DataFrame:
    """Occurrences of every piece in all texts: piece, n.

    Chunks are counted first; only the distinct ones are cut into pieces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rules, _), chunks = sent.value.get(), Counter()

        def out():
            words = [c.encode("utf-8", "replace") for c in chunks if c not in rules.special]
            times = [n for c, n in chunks.items() if c not in rules.special]
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                chunks.update(rules.chunks((data or b"").decode("utf-8", "replace")))
                if len(chunks) > COUNTED_AT_ONCE:
                    yield out()
                    chunks.clear()
        yield out()
        chunks.clear()
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, _ = sent.value.get()
        for batch in batches:
            pieces = Counter()
            for data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in rules.cut_chunk(data.decode("utf-8", "replace")):
                    pieces[p] += n
            words = [p.encode("utf-8", "replace") for p in pieces]
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"])

    counted = docs.select(F.col(text).cast("binary")).mapInArrow(count, "chunk binary, n long")
    chunks = counted.groupBy("chunk").agg(F.sum("n").alias("n"))
    return chunks.mapInArrow(cut, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(counts: DataFrame, words: int) -> DataFrame:
    """The most frequent pieces, `words` at most: all that are met more often than some number.

    The number follows from how many pieces are met how often, a short table; pieces never
    reach the driver. Pieces longer than LONGEST_PIECE bytes are left to merging.
    """
    short = counts.filter(F.octet_length("piece") <= LONGEST_PIECE)
    cut, taken = 0, 0
    for row in short.groupBy("n").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.col("n").desc()).limit(words + 1).collect():
        taken += row.pieces
        if taken > words:
            cut = row.n
            break
    return short.filter(F.col("n") > cut)


def build_lexicon(docs: DataFrame, source: str, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The automaton of the corpus' most frequent pieces, with their ids, packed; compiled by one task.

    Its input is bounded: `words` pieces of LONGEST_PIECE bytes at most.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Shared(source))
    counts = stage(count_pieces(docs, sent, text), shared_folder(spark), "pieces")

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, _ = sent.value.get()
        frequent = [p for batch in batches for p in batch.column(0).to_pylist()]
        ids = rules.merged_together([p.decode("utf-8", "replace") for p in frequent])
        packed = Lexicon.compiled(dict(zip(frequent, ids, strict=True))).packed()
        yield pa.record_batch([pa.array([packed], pa.binary())], names=["packed"])

    frequent = frequent_pieces(counts, words).select("piece").repartition(1)
    return bytes(frequent.mapInArrow(compiled, "packed binary").first().packed)


def encode_documents(docs: DataFrame, path: str, words: int = LEXICON_WORDS, with_ids: bool = True, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Every document with n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    path is read by the driver; its content and the lexicon, both of bounded size,
    are sent to the tasks. A null or empty text has no tokens. Special tokens written
    in a text become their ids. Repeated rows are encoded alike; input columns named
    like a result give way. An empty table gives an empty table.
    """
    with open(path, encoding="utf-8") as file:
        source = file.read()
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(Shared(source, build_lexicon(docs, source, words, text)))

    def make():
        encoder = Encoder(*sent.value.get())

        def sha(x: str) -> str:
            return hashlib.sha256(x.encode("utf-8")).hexdigest()

        def work(texts: list[bytes]) -> list:
            columns = [[], [], [], []][: 3 + with_ids]
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                with uncollected():
                    made = encoder.encode([t.decode("utf-8", "replace") for t in texts[i : i + TEXTS_AT_ONCE]])
                columns[0] += [n for n, _, _ in made]
                columns[1] += [sha(ids) for _, ids, _ in made]
                columns[2] += [sha(decoded) for _, _, decoded in made]
                if with_ids:
                    columns[3] += [np.array(ids.split(), np.int32) for _, ids, _ in made]
            return columns

        return work

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("ids", "array<int>")]
    return add_text_columns(docs, make, fields[: 3 + with_ids], keep, text)
