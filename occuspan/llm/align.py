"""Alignment of the tokens that two tokenizers cut from the same bytes.

Tokens are known by the byte offset they end at. Where a token of each side ends at the
same offset, a group ends. At a given shift between the two sides' indexes, stretches in
which one token answers one token are skipped: windows of growing length of the two end
arrays are compared at that shift, and the first difference ends the stretch. There the
group is resolved by stepping the side that is behind, until both end together, which
sets the shift anew. Texts are laid one behind the other and cut into lanes at ends
that both sides are known to share, so that NumPy advances all lanes at a time.

Counts of linked id pairs are looked up by chunks of documents: a chunk lists its
distinct pairs once, documents refer to them by their place in that list. Only the lists
are joined to the corpus' counts, so a frequent pair is one row a chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from occuspan.llm.common import TEXT, shared_folder, stage

# Bytes of text that are laid out together, tokens of a lane, width of the first window.
LAID_OUT = 1 << 20
LANE = 512
LANE_CANDIDATES = 32
FIRST_WINDOW = 8
# Links of a chunk: its documents and its list of pairs are looked at by one task.
CHUNK_LINKS = 2_000_000
LIST_ROW = 1 << 16
# Fixed values of the byte-level tokenizer: how it cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Left to the slower library, which has no limit there: newest planes, very long white space.
UNUSUAL = re.compile("[\U00020000-\U0010ffff]")
LONG_SPACE = re.compile(r"\s{4000}")

SUMS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]
LOOKED_UP = [("n_best", "long"), ("count_sum", "long")]
KINDS = {"long": (T.LongType(), pa.int64()), "string": (T.StringType(), pa.string())}


class Tokenizers:
    """Both tokenizers from their files' contents; built once a Python worker."""

    def __init__(self, a_json: str, a_ranks: bytes | None, b_model: bytes):
        self.files, self.built = (a_json, a_ranks, b_model), None

    def __getstate__(self):
        return self.files

    def __setstate__(self, files):
        self.files, self.built = files, None

    def get(self) -> Pair:
        if self.built is None:
            self.built = Pair(*self.files)
        return self.built


class Pair:
    def __init__(self, a_json: str, a_ranks: bytes | None, b_model: bytes):
        self.library = Tokenizer.from_str(a_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.fast = None
        if a_ranks is not None:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, a_ranks.splitlines())}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.pieces.vocab_size())]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names = id_names(len(self.a_bytes), b",|")
        self.b_names = id_names(len(self.b_bytes), b",;")

    def piece_bytes(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(number) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        quick = self.fast is not None and (text.isascii() or not UNUSUAL.search(text))
        if quick and (len(text) < 4000 or not LONG_SPACE.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None where a text is empty or a side doesn't give back its bytes."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        found: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, data, b_ids in zip(plain, texts, self.pieces.encode(plain, num_threads=1), strict=True):
            whole = b" " + data
            if not data or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
                found.append(None)
                continue
            a_ids = self.encode_a(" " + text)
            same = self.a_lengths[a_ids].sum() == len(whole) and b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) == whole
            found.append((a_ids, np.array(b_ids, np.int64)) if same else None)
        return found


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def id_names(count: int, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every id in decimal with each of two separators after it, padded to one width."""
    return tuple(np.array([b"%d%c" % (i, end) for i in range(count)]) for end in ends)


@dataclass(frozen=True)
class Alignment:
    """ends_a, ends_b: does a token end a group; link_a, link_b: indexes of linked tokens, in no order."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def lane_starts(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes at which lanes start: the given ones, and shared ends about LANE tokens apart."""
    targets = np.arange(LANE, len(a) - 1, LANE)
    if not len(targets):
        return starts_a, starts_b
    tried = np.minimum(targets[:, None] + np.arange(LANE_CANDIDATES), len(a) - 2)
    at = np.searchsorted(b, a[tried])
    shared = b[np.minimum(at, len(b) - 1)] == a[tried]
    row = np.flatnonzero(shared.any(1))
    first = shared[row].argmax(1)
    more_a, more_b = tried[row, first] + 1, at[row, first] + 1
    found = np.unique(np.concatenate([starts_a, more_a]), return_index=True)
    return found[0], np.concatenate([starts_b, more_b])[found[1]]


def stretches(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """From each (i, j) on, how many tokens end alike one by one, before stop."""
    run, open_lanes, width = np.zeros(len(i), np.int64), np.arange(len(i)), FIRST_WINDOW
    while len(open_lanes):
        at_a = (i[open_lanes] + run[open_lanes])[:, None] + np.arange(width)
        at_b = at_a + (j - i)[open_lanes][:, None]
        alike = a[np.minimum(at_a, len(a) - 1)] == b[np.minimum(at_b, len(b) - 1)]
        alike &= at_a < stop[open_lanes][:, None]
        whole = alike.all(1)
        run[open_lanes] += np.where(whole, width, alike.argmin(1))
        open_lanes, width = open_lanes[whole], 2 * width
    return run


def align(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> Alignment:
    """Groups and links of two rising arrays of ends, of which the last ends agree.

    starts_a and starts_b are rising indexes, 0 first, before which both sides end together.
    """
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, j = lane_starts(a, b, starts_a, starts_b)
    stop = np.append(i[1:], len(a))
    while len(i):
        run = stretches(a, b, i, j, stop)
        total = int(run.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(run) - run, run)
        one_a, one_b = np.repeat(i, run) + inside, np.repeat(j, run) + inside
        ends_a[one_a] = ends_b[one_b] = True
        links_a.append(one_a)
        links_b.append(one_b)
        i, j = i + run, j + run
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
        p, q, behind = i.copy(), j.copy(), np.arange(len(i))
        while len(behind):
            at_a, at_b = p[behind], q[behind]
            links_a.append(at_a)
            links_b.append(at_b)
            x, y = a[at_a], b[at_b]
            p[behind] += x < y
            q[behind] += y < x
            behind = behind[x != y]
        ends_a[p] = ends_b[q] = True
        i, j = p + 1, q + 1
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
    return Alignment(ends_a, ends_b, np.concatenate(links_a), np.concatenate(links_b))


def group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, found: Alignment, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text; n_a and n_b are the texts' numbers of tokens."""
    last_a, last_b = np.flatnonzero(found.ends_a), np.flatnonzero(found.ends_b)
    group_a, group_b = np.cumsum(found.ends_a) - found.ends_a, np.cumsum(found.ends_b) - found.ends_b
    ahead_b = np.concatenate([[0], last_b + 1])
    size = max(pair.a_names[0].itemsize, pair.b_names[0].itemsize)
    shown = np.empty(len(a) + len(b), f"S{size}")
    shown[np.arange(len(a)) + ahead_b[group_a]] = np.where(found.ends_a, pair.a_names[1][a], pair.a_names[0][a])
    shown[np.arange(len(b)) + last_a[group_b] + 1] = np.where(found.ends_b, pair.b_names[1][b], pair.b_names[0][b])
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    return [shown[s:e].tobytes().translate(None, b"\0")[:-1] for s, e in zip(cuts, cuts[1:])]


def align_texts(pair: Pair, texts: list[bytes]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """Per text: numbers of tokens, groups and links, the groups' digest, its distinct pairs and how often each is linked.

    A pair of ids is a * (size of b's vocabulary) + b.
    """
    encoded = pair.encode(texts)
    nothing = np.zeros(0, np.int64)
    if not (met := [x for x in encoded if x is not None]):
        return [(0, 0, 0, 0, "", nothing, nothing)] * len(texts)
    a, b = (np.concatenate([x[side] for x in met]) for side in (0, 1))
    n_a, n_b = (np.array([len(x[side]) for x in met]) for side in (0, 1))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = align(np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b]), first_a, first_b)
    groups = np.add.reduceat(found.ends_a.astype(np.int64), first_a)
    shown = group_texts(pair, a, b, found, n_a, n_b)
    kinds = len(pair.a_bytes) * len(pair.b_bytes)
    text_of = np.repeat(np.arange(len(met)), n_a)[found.link_a]
    keys, times = np.unique(text_of * kinds + a[found.link_a] * len(pair.b_bytes) + b[found.link_b], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(met) + 1) * kinds).tolist()
    rows = []
    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
        counts = int(n_a[k]), int(n_b[k]), int(groups[k]), int(times[s:e].sum())
        rows.append((*counts, hashlib.sha256(shown[k]).hexdigest(), keys[s:e] - k * kinds, times[s:e]))
    made = iter(rows)
    return [(0, 0, 0, 0, "", nothing, nothing) if x is None else next(made) for x in encoded]


def pack(at: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and how often each is met."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class Chunk:
    """Rows of documents until they hold enough links, then the list of their pairs."""

    def __init__(self, number: int):
        self.number, self.links, self.rows, self.kept = number, 0, [], []

    def add(self, kept: pa.RecordBatch, rows: list[tuple]) -> None:
        self.kept.append(kept)
        self.rows += rows
        self.links += sum(r[3] for r in rows)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([r[5] for r in self.rows])
        listed, places = np.unique(codes, return_inverse=True)
        times = np.bincount(places, np.concatenate([r[6] for r in self.rows]), len(listed)).astype(np.int64)
        at, packed = 0, []
        for r in self.rows:
            packed.append(pack(places[at : at + len(r[5])], r[6]))
            at += len(r[5])
        done = 0
        for kept in self.kept:
            rows = self.rows[done : done + len(kept)]
            sums = [pa.array([r[k] for r in rows], KINDS[kind][1]) for k, (_, kind) in enumerate(SUMS)]
            yield self.batch(schema, len(kept), dict(zip(schema.names[1:], [*kept.columns, *sums])) | {"__at": pa.array(packed[done : done + len(kept)], pa.binary())})
            done += len(kept)
        for base in range(0, len(listed), LIST_ROW):
            part = slice(base, base + LIST_ROW)
            yield self.batch(schema, 1, {"__base": pa.array([base], pa.int64()), "__pairs": pa.array([listed[part]], schema.field("__pairs").type), "__times": pa.array([times[part]], schema.field("__times").type)})

    def batch(self, schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
        columns["__chunk"] = pa.array([self.number] * n, pa.int64())
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def align_chunks(docs: DataFrame, sent, keep: list[str], text: str, chunk_links: int) -> DataFrame:
    """Documents aligned, with their places in their chunk's list, and the lists, as rows of one table."""
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(n, KINDS[k][0]) for n, k in SUMS]
    fields += [T.StructField("__at", T.BinaryType()), T.StructField("__base", T.LongType()), T.StructField("__pairs", longs), T.StructField("__times", longs)]
    kept_fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([T.StructField("__chunk", T.LongType()), *kept_fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = sent.value.get(), TaskContext.get().partitionId() << 32
        chunk, kind = Chunk(number), None
        for batch in batches:
            if kind is None:
                own = [pa.field(n, KINDS[k][1]) for n, k in SUMS]
                own += [pa.field("__at", pa.binary()), pa.field("__base", pa.int64()), pa.field("__pairs", pa.list_(pa.int64())), pa.field("__times", pa.list_(pa.int64()))]
                kind = pa.schema([pa.field("__chunk", pa.int64()), *(pa.field(c, batch.column(i).type) for i, c in enumerate(keep)), *own])
            texts, first = [t or b"" for t in batch.column(len(keep)).to_pylist()], 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) <= LAID_OUT):
                    size += len(texts[end])
                    end += 1
                kept = pa.RecordBatch.from_arrays(batch.columns[: len(keep)], names=keep) if keep else None
                chunk.add(kept.slice(first, end - first), align_texts(pair, texts[first:end]))
                if chunk.links >= chunk_links:
                    yield from chunk.batches(kind)
                    number += 1
                    chunk = Chunk(number)
                first = end
        if chunk.rows:
            yield from chunk.batches(kind)

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias(TEXT)).mapInArrow(run, schema)


def pair_counts(lists: DataFrame, b_size: int) -> DataFrame:
    """Corpus-wide links of every id pair, and whether no pair of its b id has more: pair, total, best."""
    counts = lists.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair") % b_size
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    # A row for each id of b's vocabulary at most.
    return counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame,
    a_json: str,
    b_model: str,
    a_ranks: str | None = None,
    keep: list[str] | None = None,
    text: str = "text",
    chunk_links: int = CHUNK_LINKS,
) -> DataFrame:
    """Every document with the alignment of its byte-level tokens (a) and its pieces (b).

    a_json is a byte-level BPE of the tokenizers library, b_model a sentencepiece model;
    a_ranks may name the first one's vocabulary as ranks, which a faster library reads. The
    files are read by the driver and sent to the tasks. a encodes a space and the text, b
    the text, to which it adds the space itself; strings of special tokens are plain text.

    Added are n_a, n_b (tokens), n_groups, n_links (overlapping occurrences), groups_sha256
    (of the ids, `a1,a2|b1;a3|b2,b3`), n_best (links of which no pair with the same b id has
    more in the corpus) and count_sum (corpus-wide counts, summed over the links). Texts that
    are null, empty, or not given back byte by byte have no tokens: zeros, and an empty
    digest. Kept columns, all by default, give way to these. Every row counts, repeated
    ones too; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    new = {n for n, _ in SUMS + LOOKED_UP}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    with open(a_json, encoding="utf-8") as a, open(b_model, "rb") as b:
        files = a.read(), None, b.read()
    if a_ranks is not None:
        with open(a_ranks, "rb") as ranks:
            files = files[0], ranks.read(), files[2]
    sent = spark.sparkContext.broadcast(Tokenizers(*files))
    b_size = sentencepiece.SentencePieceProcessor(model_proto=files[2]).vocab_size()
    folder = shared_folder(spark)
    inner = [f"__k{i}" for i in range(len(keep))]
    renamed = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)), F.col(f"`{text}`").alias("__text"))
    chunks = stage(align_chunks(renamed, sent, inner, "__text", chunk_links), folder, "chunks")
    listed = chunks.filter("__pairs IS NOT NULL").select("__chunk", "__base", F.posexplode(F.arrays_zip("__pairs", "__times")).alias("__i", "x"))
    lists = listed.select(F.col("__chunk").alias("chunk"), (F.col("__base") + F.col("__i")).alias("at"), F.col("x.__pairs").alias("pair"), F.col("x.__times").alias("n"))
    counts = stage(pair_counts(lists, b_size), folder, "counts")
    looked_up = lists.join(counts, "pair").select("chunk", "at", "total", "best")
    aligned = chunks.filter("__pairs IS NULL").select("__chunk", *inner, *(n for n, _ in SUMS), "__at")
    kept = [T.StructField(k, chunks.schema[k].dataType) for k in inner]
    schema = T.StructType(kept + [T.StructField(n, KINDS[k][0]) for n, k in SUMS + LOOKED_UP])

    def look_up(rows: pa.Table, table: pa.Table) -> pa.Table:
        total, best = np.zeros(len(table), np.int64), np.zeros(len(table), bool)
        at = table["at"].to_numpy()
        total[at], best[at] = table["total"].to_numpy(), table["best"].to_numpy()
        sums = []
        for data in rows["__at"].to_pylist():
            places, times = unpack(data)
            sums.append((int(times[best[places]].sum()), int((times * total[places]).sum())))
        columns = [rows[n] for n in schema.names[: -len(LOOKED_UP)]]
        return pa.table([*columns, *(pa.array(c, pa.int64()) for c in zip(*sums))], names=schema.names)

    found = aligned.groupBy("__chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(look_up, schema)
    return found.select(*(F.col(k).alias(c) for k, c in zip(inner, keep)), *(n for n, _ in SUMS + LOOKED_UP))
