"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's score for a language is the sum of the weights of its hashed features: character n-grams (two and three,
with word boundaries), affixes (up to four characters) and lexicon entries (the word itself). Transitions between
languages are learned too, from training sequences spliced out of chunks of different languages. Forward-backward
gives each word's posterior; a document gets the language of highest mean posterior over its words.

Posteriors compare the known languages only, so text of another kind also gets one. ``accepted`` therefore asks as well
how many of a text's letter triples the sample has seen in that language, against what is usual for held-out texts.

Training takes a bounded sample of the labelled rows (about ``sample`` distinct texts per language, chosen by a hash
of the text) and runs on Spark: in each round every shard improves the shared weights on its own rows (AdaGrad), and
the results are averaged. Weights and sample size do not grow with the input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import keep, packed, pieces, remember, ship

FEATURES = 1 << 16
#: Slots for the letter triples seen per language.
TRIPLES = 1 << 18
SHARDS, ROUNDS = 6, 3
#: Texts are drawn by a hash of so many values: shares stay exact for labels of any size.
PICKS = 1 << 48
REMEMBERED_WORDS = 150_000
BLOCK = 32
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    values = (values + np.uint64(kind)) * _STEP
    return ((values ^ (values >> np.uint64(29))) * _STEP >> np.uint64(48)).astype(np.int64) & (FEATURES - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of a list of words, in no particular order."""
    text = "".join([f"\x02{word}\x03" for word in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == _START)
    ends = np.flatnonzero(codes == _END)
    owner = np.repeat(np.arange(len(words)), ends - starts + 1)
    base = np.uint64(1 << 21)
    pairs = codes[:-1] * base + codes[1:]
    triples = pairs[:-1] * base + codes[2:]
    found, owners = [], []
    inside = owner[:-1] == owner[1:]
    found.append(_slots(pairs[inside], 1))
    owners.append(owner[:-1][inside])
    inside = owner[:-2] == owner[2:]
    found.append(_slots(triples[inside], 2))
    owners.append(owner[:-2][inside])
    every = np.arange(len(words))
    for size in (1, 2, 3, 4):
        fits = ends - starts - 1 >= size
        head = np.zeros(int(fits.sum()), np.uint64)
        tail = head.copy()
        for place in range(size):
            head = head * base + codes[starts[fits] + 1 + place]
            tail = tail * base + codes[ends[fits] - 1 - place]
        found += [_slots(head, 10 + size), _slots(tail, 20 + size)]
        owners += [every[fits], every[fits]]
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, ends - starts + 1).astype(np.uint64)
    spelled = (codes + np.uint64(7)) * (place * _STEP | np.uint64(1))
    whole = np.add.reduceat(spelled ^ (spelled >> np.uint64(31)), starts) if len(words) else np.empty(0, np.uint64)
    found.append(_slots(whole, 3))
    owners.append(every)
    return np.concatenate(found), np.concatenate(owners)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of each letter triple, word ends included."""
    codes = np.frombuffer("".join([f"\x02{word}\x03" for word in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == _START) - 1
    base = np.uint64(1 << 21)
    inside = owner[:-2] == owner[2:]
    values = ((codes[:-2] * base + codes[1:-1]) * base + codes[2:])[inside] * _STEP
    return ((values ^ (values >> np.uint64(29))) * _STEP >> np.uint64(46)).astype(np.int64) & (TRIPLES - 1), owner[:-2][inside]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # transition scores, from x to
    seen: np.ndarray | None = None  # labels x triples, packed bits
    usual: float = 0.0  # share of seen triples that all but one in a hundred held-out texts reach

    def seen_triples(self, words: list[str]) -> np.ndarray:
        """Per word: triples seen in each language, then all triples."""
        out = np.zeros((len(words), len(self.labels) + 1))
        if words:
            slot, owner = triples(words)
            for label in range(len(self.labels)):
                known = self.seen[label, slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                out[:, label] = np.bincount(owner, known, len(words))
            out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words; features count one over their number."""
        out = np.zeros((len(words), len(self.labels)))
        if words:
            feature, owner = word_features(words)
            size = np.bincount(owner, minlength=len(words))
            for label in range(len(self.labels)):
                out[:, label] = np.bincount(owner, self.weights[feature, label], len(words)) / size
        return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Forward-backward over many sequences at once.

    ``scores`` holds the emission scores of all sequences one after the other. Sequences are cut into blocks; blocks
    are reduced to label-to-label matrices, messages pass from block to block, then the words inside get theirs.
    This is exact, and the number of array steps depends on the longest sequence over the block size only.
    With ``pairs`` the expected transition counts are returned as well.
    """
    labels = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, column = first[sequence] + inside // BLOCK, inside % BLOCK
    emit = np.ones((first[-1], BLOCK, labels))
    emit[row, column] = np.exp(scores - scores.max(axis=1, keepdims=True))
    live = np.zeros((first[-1], BLOCK), bool)
    live[row, column] = True
    step = np.exp(moves - moves.max())

    product = np.broadcast_to(np.eye(labels), (first[-1], labels, labels)).copy()
    for t in range(BLOCK):
        on = live[:, t]
        moved = product[on] @ step * emit[on, t, None, :]
        product[on] = moved / moved.max(axis=(1, 2), keepdims=True)

    ahead = np.full((first[-1], labels), 1.0 / labels)
    behind = np.ones((first[-1], labels))
    order = np.argsort(-blocks, kind="stable")
    begin, count = first[:-1][order], blocks[order]
    for k in range(1, int(count[0]) if len(count) else 0):
        here = begin[: np.searchsorted(-count, -k, "left")] + k
        value = (ahead[here - 1, None, :] @ product[here - 1])[:, 0]
        ahead[here] = value / value.sum(axis=1, keepdims=True)
        back = begin[: len(here)] + count[: len(here)] - 1 - k
        value = (product[back + 1] @ behind[back + 1, :, None])[:, :, 0]
        behind[back] = value / value.sum(axis=1, keepdims=True)

    forward = np.empty_like(emit)
    message = ahead
    before = np.empty_like(emit) if pairs else None
    for t in range(BLOCK):
        if pairs:
            before[:, t] = message
        value = message @ step * emit[:, t]
        message = np.where(live[:, t, None], value / value.sum(axis=1, keepdims=True), message)
        forward[:, t] = message
    expected = np.zeros((labels, labels))
    message = behind
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= message
        weighted = emit[:, t] * message
        if pairs:
            joint = before[:, t, :, None] * step * weighted[:, None, :]
            on = live[:, t] & ~((t == 0) & np.isin(np.arange(first[-1]), first[:-1]))
            expected += (joint[on] / joint[on].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = weighted @ step.T
        message = np.where(live[:, t, None], value / value.sum(axis=1, keepdims=True), message)
    out = forward[row, column]
    out /= out.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


def _spliced(texts: list[list[str]], labels: np.ndarray, draw: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training sequences: documents cut into chunks, chunks in random order, eight to a sequence."""
    chunks = []
    for words, label in zip(texts, labels, strict=True):
        start = 0
        while start < len(words):
            size = int(draw.integers(5, 40))
            chunks.append((words[start : start + size], label))
            start += size
    order = draw.permutation(len(chunks))
    words = [word for place in order for word in chunks[place][0]]
    truth = np.concatenate([np.full(len(chunks[place][0]), chunks[place][1]) for place in order])
    sizes = np.array([len(chunks[place][0]) for place in order])
    groups = np.add.reduceat(sizes, np.arange(0, len(sizes), 8))
    return words, truth, groups


def _improve(model: Model, texts: list[list[str]], labels: np.ndarray, seed: int, batch: int = 3_000) -> Model:
    """One pass of AdaGrad over a shard."""
    draw = np.random.default_rng(seed)
    weights, moves = model.weights.copy(), model.moves.copy()
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-2)
    words, truth, lengths = _spliced(texts, labels, draw)
    ends = np.cumsum(lengths)
    start = at = 0
    size = len(model.labels)
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, at + batch, "right")))
        until = int(ends[stop - 1])
        part, target = words[at:until], truth[at:until]
        distinct, where = np.unique(np.array(part, object).astype(str), return_inverse=True)
        feature, owner = word_features(distinct.tolist())
        count = np.bincount(owner, minlength=len(distinct))
        now = Model(model.labels, weights, moves)
        given, expected = posteriors(now.scores(distinct.tolist())[where], lengths[start:stop], moves, pairs=True)
        error = given.copy()
        error[np.arange(len(target)), target] -= 1
        for label in range(size):
            by_word = np.bincount(where, error[:, label], len(distinct)) / count
            step = np.bincount(feature, by_word[owner], FEATURES) / len(target)
            seen_w[:, label] += step**2
            weights[:, label] -= 2.0 * step / np.sqrt(seen_w[:, label])
        observed = np.zeros((size, size))
        inner = np.ones(len(target), bool)
        inner[np.cumsum(lengths[start:stop]) - lengths[start:stop]] = False
        np.add.at(observed, (target[np.flatnonzero(inner) - 1], target[inner]), 1)
        step = (expected - observed) / len(target)
        seen_m += step**2
        moves -= 0.3 * step / np.sqrt(seen_m)
        start, at = stop, until
    return Model(model.labels, weights, moves)


def _shard_step(held, labels: list[str], turn: int):
    number = {label: place for place, label in enumerate(labels)}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        weights, moves = held.value
        frame = frame.sort_values(["pick", "text", "label"])
        texts = [words_of(text) for text in frame["text"]]
        truth = np.array([number[label] for label in frame["label"]])
        full = [place for place, words in enumerate(texts) if words]
        if not full:
            return pd.DataFrame({"rows": [], "model": []})
        better = _improve(
            Model(labels, weights.astype(np.float64), moves), [texts[p] for p in full], truth[full], seed=turn * 1000 + len(full)
        )
        value = better.weights.astype(np.float32).tobytes() + better.moves.tobytes()
        return pd.DataFrame({"rows": [len(full)], "model": [value]})

    return run


def train(docs: DataFrame, usable: Column, label_column: str = "lang", text_column: str = "text", sample: int = 600) -> Model:
    """Fit on rows where ``usable`` holds and label and text are given.

    At most about ``sample`` distinct texts per label are used, all with equal chance whatever the label's share and
    however often one is copied.
    """
    ship(docs.sparkSession)
    given = docs.where(usable).select(F.col(label_column).alias("label"), F.col(text_column).alias("text")).where(
        r"label is not null and text rlike '\\p{L}'"
    ).withColumn("pick", F.pmod(F.xxhash64("text"), F.lit(PICKS)))
    # Copies are one draw, so they count once; whole rows would starve a label of which most rows are copies.
    drawn = given.select("label", F.xxhash64("text").alias("text")).distinct()
    counts = {row["label"]: row["n"] for row in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    share = F.lit(0)
    for label in labels:
        share = F.when(F.col("label") == label, int(PICKS * min(1.0, sample / counts[label]))).otherwise(share)
    chosen = keep(given.where(F.col("pick") < share).dropDuplicates(["label", "text"]).withColumn("shard", F.col("pick") % SHARDS))
    size = len(labels)
    weights, moves = np.zeros((FEATURES, size), np.float32), np.zeros((size, size))
    kind = "rows long, model binary"
    for turn in range(ROUNDS if size > 1 else 0):
        held = docs.sparkSession.sparkContext.broadcast((weights, moves))
        # One small model per shard comes back, whatever the number of rows.
        found = chosen.groupBy("shard").applyInPandas(_shard_step(held, labels, turn), kind).collect()
        total = sum(row["rows"] for row in found)
        if not total:
            break
        cut = FEATURES * size * 4
        weights = sum(np.frombuffer(r["model"][:cut], np.float32) * (r["rows"] / total) for r in found).reshape(-1, size).astype(np.float32)
        moves = sum(np.frombuffer(r["model"][cut:]) * (r["rows"] / total) for r in found).reshape(size, size)
    seen, usual = _seen(chosen, labels)
    return Model(labels, weights, moves, seen, usual)


def _seen(chosen: DataFrame, labels: list[str]) -> tuple[np.ndarray, float]:
    """Letter triples of the sample per language, and the share of them that a shard's texts have in the other shards."""
    number = {label: place for place, label in enumerate(labels)}

    def marks(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((len(number), TRIPLES), np.uint8)
        for label, text in zip(frame["label"], frame["text"], strict=True):
            bits[number[label], triples(words_of(text))[0]] = 1
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "bits": [np.packbits(bits, axis=1, bitorder="little").tobytes()]})

    # One small bitmap per shard, whatever the number of rows.
    found = {r["shard"]: np.frombuffer(r["bits"], np.uint8) for r in chosen.groupBy("shard").applyInPandas(marks, "shard long, bits binary").collect()}
    if not found:
        return np.zeros((len(labels), TRIPLES >> 3), np.uint8), 0.0

    def shares(frame: pd.DataFrame) -> pd.DataFrame:
        others = [bits for shard, bits in found.items() if shard != frame["shard"].iloc[0]]
        if not others:
            return pd.DataFrame({"share": pd.Series([], dtype=float)})
        model = Model(labels, None, None, np.bitwise_or.reduce(others).reshape(len(labels), -1))
        out = []
        for label, text in zip(frame["label"], frame["text"], strict=True):
            total = model.seen_triples(words_of(text)).sum(axis=0)
            out.append(total[number[label]] / max(total[-1], 1))
        return pd.DataFrame({"share": out})

    # The sample is bounded, and so is this quantile's input.
    usual = chosen.groupBy("shard").applyInPandas(shares, "share double").agg(F.percentile("share", F.lit(0.01)).alias("usual")).first()
    return np.bitwise_or.reduce(list(found.values())).reshape(len(labels), -1), float(usual["usual"] or 0.0)


class _Tagger:
    """Scores of words seen before, kept in one array; two generations of them."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, 2 * len(self.model.labels) + 1))

    def learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > REMEMBERED_WORDS:
            self.reset()
        new = list(words - self.place.keys())
        if not new:
            return
        start = len(self.place)
        if start + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.table) + len(new), self.table.shape[1]))])
        self.table[start : start + len(new)] = np.concatenate([self.model.scores(new), self.model.seen_triples(new)], axis=1)
        self.place.update(zip(new, range(start, start + len(new)), strict=True))

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, mean posterior, and how far the share of seen triples reaches the usual one (1 or more: it does)."""
        names, sure, near = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        found = [words_of(text) for text in texts]
        # Other alphanumeric signs, such as superscript digits, are not letters.
        odd = {w for words in found for w in words if not w.isalpha()}
        if odd:
            odd = {word for word in odd if not any(map(str.isalpha, word))}
            found = [[w for w in words if w not in odd] for words in found]
        full = [place for place, words in enumerate(found) if words]
        if not full or not self.model.labels:
            return names, sure, near
        self.learn({word for place in full for word in found[place]})
        lengths = np.array([len(found[place]) for place in full])
        index = np.fromiter((self.place[w] for place in full for w in found[place]), np.int64, int(lengths.sum()))
        starts, labels = np.cumsum(lengths) - lengths, len(self.model.labels)
        given = posteriors(self.table[index, :labels], lengths, self.model.moves)
        means = np.add.reduceat(given, starts, axis=0) / lengths[:, None]
        known = np.add.reduceat(self.table[index, labels:], starts, axis=0)
        best = means.argmax(axis=1)
        for place, label, row, seen in zip(full, best, means, known, strict=True):
            names[place], sure[place] = self.model.labels[label], float(min(1.0, row[label]))
            # A short text may miss the usual share by chance.
            near[place] = float((seen[label] + 1) / (seen[-1] + 1) + 1 / np.sqrt(seen[-1] + 1)) / max(self.model.usual, 1e-9)
        return names, sure, near


_taggers: dict[int, _Tagger] = {}


def _tagger(number: int, held) -> _Tagger:
    remember(_taggers)
    if number not in _taggers:
        _taggers.clear()
        _taggers[number] = _Tagger(Model(*held.value))
    return _taggers[number]


def _predict(number: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(number, held)
        for batch in pieces(batches, "text", 1_000_000):
            names, sure, _ = tagger.documents(batch.column("text").to_pylist())
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    return run


def _held(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.moves, model.seen, model.usual))
    return held._jbroadcast.id(), held


def predict(docs: DataFrame, model: Model, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of each row with ``lang_pred`` and ``score``. A null text or one without letters is ``und``, score 0."""
    ship(docs.sparkSession)
    rows = docs.select(*columns, F.col(text_column).alias("text"))
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(*_held(docs, model)), f"{kinds}, lang_pred string, score double")


def accepted(
    docs: DataFrame, model: Model, least: float = 0.3, nearness: float = 0.65, text_column: str = "text", lang_column: str | None = None
) -> DataFrame:
    """Rows in one of the model's languages, with all their columns; ``lang_column`` then names the language found.

    The mean posterior is ``least`` or more, and the share of letter triples that the sample has seen in that language is
    at least ``nearness`` of what is usual for held-out texts (short texts get an allowance of one over the root of their
    number of triples). A null text or one without letters goes. Only the text is sent to Python.
    """
    ship(docs.sparkSession)
    number, held = _held(docs, model)

    @F.arrow_udf("string")
    def spoken(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = _tagger(number, held)
        for texts in batches:
            out = []
            for part in pieces([pa.record_batch([texts], ["text"])], "text", 1_000_000):
                found = zip(*tagger.documents(part.column("text").to_pylist()), strict=True)
                out += [name if name != "und" and sure >= least and near >= nearness else None for name, sure, near in found]
            yield pa.array(out, pa.string())

    # Taken for not deterministic, so that the filter isn't moved below and each text is read once.
    found = docs.select(packed(docs), spoken.asNondeterministic()(F.col(f"`{text_column}`")).alias("_lang")).where("_lang is not null")
    return found.select(*[
        F.col("_lang").alias(name) if name == lang_column else F.col("_row").getField(name).alias(name) for name in docs.columns
    ])


def model_text(model: Model) -> str:
    """Labels and transitions, readable."""
    return json.dumps({"labels": model.labels, "moves": model.moves.round(3).tolist()})
