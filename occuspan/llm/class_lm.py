"""Language model on word classes: exchange clustering, class transitions, word emissions.

Every word of the training texts gets a class, and the number of classes grows with
the number of different words. Counting is distributed over all training texts. Words
above a count that at most RANKED words exceed get ranks; texts are then kept as ranks,
with the other words beside them. The exchange starts with classes dealt by rank; in
every round all tasks count the classes left and right of each ranked word, and words
move to the class that raises the likelihood of the class bigrams most. As words move
at once, a round may lower the likelihood: it is then undone, and fewer words move.
All other words, however many, stay in a table: their occurrences meet by word, each
word takes the class of highest likelihood between the classes around it, and the
classes go back to the texts in a join. Transitions are then counted over whole texts.

A word's probability is the smoothed transition from its predecessor's class to its
class, times its discounted share of the class. What the discount leaves is for unseen
words, of which as many are expected as there are known ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.llm.common import BLOCK_KIND, ROWS_AT_ONCE, block_batch, give_back, shared_folder, sheltered, stage, sum_blocks

# Words whose classes every task holds, and how long these may be; any others are joined.
RANKED = 32_768
LONGEST_RANKED = 64
LEAST_CLASSES = 8
EXCHANGES = 10
MOST_PORTIONS = 8
LEAST_GAIN = 1e-4
PRIOR = 20.0
COUNTED_AT_ONCE = 400_000
BLOCK = 128
TOKENS_AT_ONCE = 2_000_000
MATRIX_CELLS = 400_000


@dataclass
class Model:
    words: list[bytes]  # by rank
    counts: np.ndarray  # by rank
    tokens: int
    types: int
    texts: int
    discount: float
    classes: int
    class_of: np.ndarray | None = None  # by rank, then other words (no class yet) and the end
    rest: DataFrame | None = None  # word, n, class of the other words
    likelihoods: list[float] = field(default_factory=list)  # of the class bigrams, kept rounds
    sizes: np.ndarray | None = None  # tokens by class
    kinds: np.ndarray | None = None  # words by class
    transitions: np.ndarray | None = None


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts of a table with one binary column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()

        def out():
            return pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data:
                    n.update(data.lower().split())
                if len(n) > COUNTED_AT_ONCE:
                    yield out()
                    n.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_corpus(docs: DataFrame, folder: str, most: int = RANKED, classes: int | None = None) -> Model:
    """Counts of a table with text; ranks by count, then word.

    Only `most` words of bounded length, at most, reach the driver: those above a count
    that follows from how many words have which count.
    """
    counted = stage(count_words(docs.select(F.col("text").cast("binary"))), folder, "words")
    texts = docs.count()
    one, two = (F.count_if(F.col("n") == i) for i in (1, 2))
    tokens, types, once, twice = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), one, two).first()
    short = counted.filter(F.octet_length("word") <= LONGEST_RANKED)
    cut, taken = 0, 0
    for row in short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most + 1).collect():
        taken += row.words
        if taken > most:
            cut = row.n
            break
    top = sorted(((-r.n, bytes(r.word)) for r in short.filter(F.col("n") > cut).collect()))
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
    classes = classes or max(LEAST_CLASSES, round(2 * types**0.25))
    counts = np.array([-n for n, _ in top], np.int64)
    return Model([w for _, w in top], counts, tokens + texts, types + (texts > 0), texts, discount, classes)


def ranked_texts(docs: DataFrame, words: list[bytes], names: list[str]) -> DataFrame:
    """The named columns with ranks (two bytes a word), the other words, each once, and which of them stand where."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kept = docs.select(*names, F.col("text").cast("binary").alias("__text"))
    fields = ", ".join(f"{n} {t}" for n, t in kept.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {w: i for i, w in enumerate(sent.value)}
        rare = len(rank)
        for whole in batches:
            for start in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                ranks, others, places = [], [], []
                for data in batch.column(len(names)).to_pylist():
                    own = (data or b"").lower().split()
                    found = np.fromiter(map(rank.get, own, repeat(rare)), np.uint16, len(own))
                    ranks.append(found.tobytes())
                    number = {}
                    at = [number.setdefault(own[i], len(number)) for i in np.flatnonzero(found == rare).tolist()]
                    others.append(list(number))
                    places.append(np.array(at, np.int32).tobytes())
                made = [pa.array(ranks, pa.binary()), pa.array(others, pa.list_(pa.binary())), pa.array(places, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, "ranks", "rare", "rare_at"])
        give_back()

    return kept.mapInArrow(run, f"{fields}, ranks binary, rare array<binary>, rare_at binary")


def joined(texts: list[bytes], end: int) -> np.ndarray:
    """The numbers of several texts in one row, an end before, between and after."""
    mark = np.array([end], np.int32)
    parts = [mark]
    for data in texts:
        parts += [np.frombuffer(data, np.uint16).astype(np.int32), mark]
    return np.concatenate(parts)


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts in the first column, two bytes a word, have about TOKENS_AT_ONCE words; a longer text is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 2 + 1
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TOKENS_AT_ONCE, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            yield batch.slice(start, end - start)


def class_bigrams(cls: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(cls[:-1].astype(np.int64) * groups + cls[1:], minlength=groups * groups)


def neighbours(ranked: DataFrame, class_of: np.ndarray, groups: int, due: np.ndarray) -> DataFrame:
    """Per block of the due ranks: how often each class stands left and right of each; block -1: class bigrams."""
    number = np.full(len(class_of), -1, np.int32)
    number[due] = np.arange(len(due))
    sent = ranked.sparkSession.sparkContext.broadcast((class_of, number))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number = sent.value
        words = int(number.max(initial=-1)) + 1
        left, right = np.zeros(words * groups, np.int64), np.zeros(words * groups, np.int64)
        pairs = np.zeros(groups * groups, np.int64)
        for batch in in_pieces(batches):
            seq = joined(batch.column(0).to_pylist(), len(of) - 1)
            cls = of[seq].astype(np.int64)
            pairs += class_bigrams(cls, groups)
            word = number[seq]
            own = np.flatnonzero(word >= 0)
            word = word[own].astype(np.int64) * groups
            left += np.bincount(word + cls[own - 1], minlength=len(left))
            right += np.bincount(word + cls[own + 1], minlength=len(right))
        for at in range(0, words, BLOCK):
            part = slice(at * groups, (at + BLOCK) * groups)
            yield block_batch(at // BLOCK, np.concatenate([left[part], right[part]]), packed)
        yield block_batch(-1, pairs, packed)
        give_back()

    return sum_blocks(ranked.select("ranks").mapInArrow(count, BLOCK_KIND), "int64", packed, zstandard.decompress)


def packed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def entropy_part(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """log likelihood of the class bigrams, up to what does not depend on the classes."""
    pairs = pairs.astype(np.float64)
    return float(entropy_part(pairs).sum() - entropy_part(pairs.sum(0)).sum() - entropy_part(pairs.sum(1)).sum())


def added(words: int, ids: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Per word and class, what neighbours met n times add to the sum of n log n; base: the counts so far, a row each, by word."""
    gain = np.zeros((words, base.shape[1]))
    if len(ids):
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        gain[ids[first]] = np.add.reduceat(entropy_part(base + n[:, None]) - entropy_part(base), first, axis=0)
    return gain


def best_moves(left: np.ndarray, right: np.ndarray, now: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """For words with their neighbour counts, the class of the highest likelihood.

    Each word is first taken out of its class; what putting it into class b adds to
    the sum of n log n over class bigrams, less that over class totals, decides. Only
    neighbour classes that a word has change anything.
    """
    chosen, pairs = now.copy(), pairs.astype(np.float64)
    step = max(1, MATRIX_CELLS // pairs.size)
    for start in range(0, len(now), step):
        at = slice(start, start + step)
        own, sides = now[at].astype(np.int64), [x[at].astype(np.float64) for x in (left, right)]
        total = sides[1].sum(1)[:, None]
        each = np.arange(len(own))
        gain = np.zeros((len(own), classes))
        for (here, other), table in zip((sides, sides[::-1]), (pairs[:, :classes], pairs[:classes].T), strict=True):
            ids, beside = np.nonzero(here)
            n, base = here[ids, beside], table[beside]
            base[np.arange(len(ids)), own[ids]] -= n
            same = beside == own[ids]
            base[same] -= other[ids[same], :classes]
            gain += added(len(own), ids, n, np.maximum(base, 0, out=base))
            sums = table.sum(0) - other[:, :classes]
            sums[each, own] -= total[:, 0]
            np.maximum(sums, 0, out=sums)
            gain -= entropy_part(sums + total) - entropy_part(sums)
        chosen[at] = np.where(total[:, 0] > 0, gain.argmax(1), own)
    return chosen


def exchange(ranked: DataFrame, model: Model, folder: str, rounds: int = EXCHANGES) -> np.ndarray:
    """Sets the classes of the ranked words; returns the class bigrams, other words in a class of their own."""
    n, classes = len(model.words), model.classes
    groups = classes + 2
    of = np.full(n + 2, classes, np.int16)
    of[:n] = np.arange(n) % classes
    of[n + 1] = classes + 1
    slot = np.arange(n) * 2654435761 >> 7
    best, portions = None, 1
    for turn in range(rounds + 1):
        # Only words that may move next are counted.
        due = np.flatnonzero(slot % portions == turn % portions)
        sums = stage(neighbours(ranked, of, groups, due), folder, f"sums{turn}")
        whole = [np.frombuffer(zstandard.decompress(r.data), np.int64) for r in sums.filter("block = -1").collect()]
        pairs = sum(whole, np.zeros(groups * groups, np.int64)).reshape(groups, groups)
        found = likelihood(pairs)
        if best is None or found > best[0]:
            stable = best is not None and found - best[0] < LEAST_GAIN * abs(found)
            best, moving = (found, of, pairs, sums, due), due
            model.likelihoods.append(found)
        else:
            portions, moving = portions * 2, moving[::2]
            stable = portions > MOST_PORTIONS
        if stable or turn == rounds or not n:
            break
        of = moved_words(*best[1:], moving, classes)
        portions = max(portions, 2)
    model.class_of = best[1]
    return best[2]


def moved_words(of: np.ndarray, pairs: np.ndarray, sums: DataFrame, due: np.ndarray, moving: np.ndarray, classes: int) -> np.ndarray:
    """The classes after the moving ones of the counted words have moved."""
    sent = sums.sparkSession.sparkContext.broadcast((of[due], np.isin(due, moving), pairs))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, may, matrix = sent.value
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = np.frombuffer(zstandard.decompress(data), np.int64).reshape(2, -1, len(matrix))
                at = slice(block * BLOCK, block * BLOCK + len(left))
                chosen, own = now[at].copy(), np.flatnonzero(may[at])
                chosen[own] = best_moves(left[own], right[own], chosen[own], matrix, classes)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([chosen.tobytes()], pa.binary())], names=["block", "classes"])

    made = of.copy()
    # One small row per block of words; their number is bounded by RANKED.
    for r in sums.filter("block >= 0").repartition("block").mapInArrow(move, "block int, classes binary").collect():
        part = np.frombuffer(r.classes, np.int16)
        made[due[r.block * BLOCK : r.block * BLOCK + len(part)]] = part
    return made


def contexts(ranked: DataFrame, class_of: np.ndarray, groups: int) -> DataFrame:
    """word, around (the class to the left, times groups, plus that to the right), n of all words without a rank."""
    sent = ranked.sparkSession.sparkContext.broadcast(class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        end, rare = len(of) - 1, len(of) - 2
        for batch in in_pieces(batches):
            seq = joined(batch.column(0).to_pylist(), end)
            own = np.flatnonzero(seq == rare)
            if not len(own):
                continue
            cls = of[seq].astype(np.int64)
            starts = batch.column(1).offsets.to_numpy()
            places = [np.frombuffer(data, np.int32) + first for data, first in zip(batch.column(2).to_pylist(), starts - starts[0])]
            words = batch.column(1).flatten().dictionary_encode()
            number = words.indices.to_numpy()[np.concatenate(places)].astype(np.int64)
            keys, n = np.unique((number * groups + cls[own - 1]) * groups + cls[own + 1], return_counts=True)
            word = words.dictionary.take(pa.array(keys // (groups * groups)))
            yield pa.record_batch([word, pa.array((keys % (groups * groups)).astype(np.int32)), pa.array(n, pa.int64())], names=["word", "around", "n"])
        give_back()

    return ranked.select("ranks", "rare", "rare_at").mapInArrow(run, "word binary, around int, n long")


def insertion_gain(ids: np.ndarray, beside: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What words gain by each class through their neighbours on one side; table: a row per neighbour class."""
    keys, which = np.unique(ids * len(table) + beside, return_inverse=True)
    ids, beside = keys // len(table), keys % len(table)
    return added(ids[-1] + 1, ids, np.bincount(which, weights=n), table[beside])


def inserted(ids: np.ndarray, around: np.ndarray, n: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of highest likelihood and the count of words (0, 1, ... in order) given what stands around them."""
    groups, pairs = len(pairs), pairs.astype(np.float64)
    total = np.bincount(ids, weights=n)
    gain = insertion_gain(ids, around % groups, n, pairs[:classes].T) + insertion_gain(ids, around // groups, n, pairs[:, :classes])
    for sums in (pairs[:classes].sum(1), pairs[:, :classes].sum(0)):
        gain -= entropy_part(sums + total[:, None]) - entropy_part(sums)
    return gain.argmax(1), total


def rest_classes(found: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """word, n, class of every word without a rank; a worker holds the words of a batch."""
    sent = found.sparkSession.sparkContext.broadcast(pairs)

    def made(words: pa.Array, first: np.ndarray, around: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ids = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        chosen, total = inserted(ids, around, n, sent.value, classes)
        columns = [words.take(pa.array(first)), pa.array(total.astype(np.int64)), pa.array(chosen.astype(np.int32))]
        return pa.record_batch(columns, names=["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, around, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            words = batch.column(0)
            if word is not None:
                words = pa.concat_arrays([pa.array([word] * len(n), pa.binary()), words])
            around = np.append(around, batch.column(1).to_numpy().astype(np.int64))
            n = np.append(n, batch.column(2).to_numpy())
            changed = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            first = np.append(0, np.flatnonzero(changed) + 1)
            last = first[-1]
            if last:
                yield made(words.slice(0, last), first[:-1], around[:last], n[:last])
            # The last word may go on; it waits with one row for each pair of classes around it.
            word = words[len(words) - 1].as_py()
            around, which = np.unique(around[last:], return_inverse=True)
            n = np.bincount(which, weights=n[last:]).astype(np.int64)
        if word is not None:
            yield made(pa.array([word] * len(n), pa.binary()), np.array([0]), around, n)
        give_back()

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


def learn_classes(ranked: DataFrame, model: Model, folder: str) -> None:
    """Gives every word of the training texts a class; sums up the classes."""
    pairs = exchange(ranked, model, folder)
    groups = model.classes + 2
    model.rest = stage(rest_classes(contexts(ranked, model.class_of, groups), pairs, model.classes), folder, "rest")
    own = model.class_of[: len(model.words)]
    model.sizes = np.bincount(own, weights=model.counts, minlength=model.classes).astype(np.float64)
    model.kinds = np.bincount(own, minlength=model.classes)
    for r in model.rest.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        model.sizes[r["class"]] += r.n
        model.kinds[r["class"]] += r.words


def classed_texts(ranked: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The named columns with the texts as classes, and all of a score that does not depend on the order of the words."""
    places = ranked.select("__row", F.posexplode("rare").alias("at", "word"))
    # Unseen words have no class, so only known ones need to meet theirs.
    met = places.join(model.rest, "word").groupBy("__row").agg(F.collect_list(F.struct("at", "class", "n")).alias("met"))
    kept = ranked.select(*names, "__row", "ranks", "rare_at", F.size("rare").alias("others"))
    kept = kept.join(met, "__row", "left").select(*names, "ranks", "rare_at", "others", "met")
    fields = ", ".join(f"{n} {t}" for n, t in kept.dtypes[: len(names)])
    seen = model.class_of, model.counts, model.sizes, model.discount, model.tokens, model.types, model.texts
    sent = ranked.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, sizes, discount, tokens, types, texts = sent.value
        rare, unseen = len(counts), len(sizes)
        words = np.append(emissions(counts, of[:rare], sizes, discount), 0.0)
        plus = np.append(np.log10(counts + 1.0), 0.0)
        total, no_share = math.log10(tokens + types + 1), -math.log10(types + 1)
        for whole in batches:
            for start in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                met = batch.column(len(names) + 3)
                ends, (at, group, times) = met.offsets.to_numpy(), (met.values.field(i).to_numpy() for i in range(3))
                made = []
                for i, (ranks, others, distinct) in enumerate(zip(*(batch.column(len(names) + j).to_pylist() for j in range(3)))):
                    seq = np.frombuffer(ranks, np.uint16)
                    cls = of[seq]
                    n = len(seq) + 1
                    known, base, score = n - 1 + (texts > 0), plus[seq].sum() + math.log10(texts + 1) - n * total, words[seq].sum()
                    if distinct:
                        own, part = np.frombuffer(others, np.int32), slice(ends[i], ends[i + 1])
                        one, count, share = np.full(distinct, unseen, np.int16), np.zeros(distinct), np.full(distinct, no_share)
                        one[at[part]], count[at[part]] = group[part], times[part]
                        share[at[part]] = emissions(times[part], group[part], sizes, discount)
                        cls[seq == rare] = one[own]
                        known -= int((one[own] == unseen).sum())
                        base += np.log10(count + 1)[own].sum()
                        score += share[own].sum()
                    made.append((cls.astype(np.uint16).tobytes(), n, known, float(base), float(score)))
                kinds = pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
                columns = [pa.array([m[j] for m in made], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, "classes", *COUNTED])
        give_back()

    return kept.mapInArrow(run, f"{fields}, classes binary, n_tokens long, n_known long, base_score double, emitted double")


COUNTED = ["n_tokens", "n_known", "base_score", "emitted"]


def emissions(counts: np.ndarray, group: np.ndarray, sizes: np.ndarray, discount: float) -> np.ndarray:
    """log10 of known words' discounted shares of their classes."""
    return np.log10((counts - discount) / sizes[group])


def count_transitions(classed: DataFrame, classes: int) -> np.ndarray:
    """How often each class (unseen words and the end last) is followed by each."""
    groups = classes + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(groups * groups, np.int64)
        for batch in in_pieces(batches):
            pairs += class_bigrams(joined(batch.column(0).to_pylist(), groups - 1), groups)
        for row in range(groups):
            yield block_batch(row, pairs[row * groups : (row + 1) * groups], packed)

    pairs = np.zeros((groups, groups), np.int64)
    for r in sum_blocks(classed.select("classes").mapInArrow(count, BLOCK_KIND), "int64", packed, zstandard.decompress).collect():
        pairs[r.block] = np.frombuffer(zstandard.decompress(r.data), np.int64)
    return pairs


def log_transitions(pairs: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """log10 of the probability of each class (unseen words and the end last) after each.

    A class gives `discount` of each of its words' counts to unseen words, all of its
    probability if it has no words; after an unseen word stands what stands after the
    classes it was likely to be of.
    """
    classes = len(sizes)
    known = np.append(np.arange(classes), classes + 1)
    counts = pairs[np.ix_(known, known)]
    share = (counts.sum(0) + 1.0) / (counts.sum() + len(known))
    moves = (counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR)
    left = np.append(np.where(sizes > 0, discount * kinds / np.maximum(sizes, 1), 1.0), 0.0)
    weight = share * left if (share * left).sum() else share
    made = np.zeros(pairs.shape)
    made[np.ix_(known, known)] = moves
    made[known, classes] = moves @ left
    made[classes] = (weight / weight.sum()) @ made[known]
    return np.log10(np.maximum(made, 1e-300))


def score_classed(classed: DataFrame, model: Model, names: list[str]) -> DataFrame:
    moves = log_transitions(model.transitions, model.sizes, model.kinds, model.discount)
    sent = classed.sparkSession.sparkContext.broadcast(moves)
    kept = classed.select(*names, *COUNTED, "classes")
    fields = ", ".join(f"{n} {t}" for n, t in kept.dtypes[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = sent.value
        end = np.array([len(moves) - 1])
        for batch in batches:
            score = batch.column(len(names) + 3).to_numpy().copy()
            for i, data in enumerate(batch.column(len(names) + 4).to_pylist()):
                cls = np.concatenate([end, np.frombuffer(data, np.uint16), end])
                score[i] += moves[cls[:-1], cls[1:]].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 3], pa.array(score, pa.float64())], names=[*names, *COUNTED[:3], "score"])

    return kept.mapInArrow(run, f"{fields}, score double")


def score_documents(docs: DataFrame, train: str = "train", ranked: int = RANKED, classes: int | None = None) -> DataFrame:
    """Every row's log10 probability under a model learnt from the rows whose flag is true.

    Takes text and a boolean column named by `train`; adds n_tokens, n_known,
    train_tokens, base_score (smoothed unigrams), score (class model). A text's tokens
    are its words, A-Z lowered, and one end. A null or empty text is an end alone.
    A null flag counts as false. Repeated rows count as often as they come. Without
    training rows every token is unseen and the base is 0. Other columns stay; ones
    named like a result give way. An empty table gives an empty table.

    ranked (65,534 at most): words whose classes are exchanged in rounds; all others are
    put into the best class once. classes: by default twice the fourth root of the number of words.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(given: DataFrame) -> DataFrame:
        names = [c for c in given.columns if c != "text"]
        model, classed = fitted(given, train, ranked, classes)
        whole = score_classed(classed, model, names).withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
        return whole.select(*names, *results)

    return sheltered(docs, {"text": "text", "train": train}, results, run, [c for c in docs.columns if c != "text"])


def fitted(docs: DataFrame, train: str = "train", most: int = RANKED, classes: int | None = None) -> tuple[Model, DataFrame]:
    """The model learnt from the flagged rows, and all rows in its classes; columns other than text have private names."""
    folder = shared_folder(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    model = count_corpus(docs.filter(F.col(train)), folder, most, classes)
    ranked = ranked_texts(docs.withColumn("__row", F.monotonically_increasing_id()), model.words, [*names, "__row"])
    ranked = stage(ranked, folder, "ranked")
    learn_classes(ranked.filter(F.col(train)), model, folder)
    classed = stage(classed_texts(ranked, model, names), folder, "classed")
    model.transitions = count_transitions(classed.filter(F.col(train)), model.classes)
    return model, classed
