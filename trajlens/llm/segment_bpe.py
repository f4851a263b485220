"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaf of a symbol holds (rank of the pair it starts, its place), so the root of the tree is the leftmost pair
of lowest rank. A merge changes three leaves and the nodes above them: logarithmic work. The loop ends when no pair
at the root can be merged. Trees of many words are kept as rows of one array and advance together.

Reads tokenizer files of the JSON kind whose model is BPE with word ends, whose normalizer is NFC and lower case, and
whose pre-tokenizer keeps the matches of a pattern (`word_bpe_49k.json`). Words seen before are remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajlens.llm.common import packed, pieces, remember, ship, unpacked

REMEMBERED_WORDS = 120_000
#: Words of so many bytes or more get a tree of their own.
LONG_WORD = 512
#: Symbols that rows of trees of one call may hold.
TREE_SYMBOLS = 1 << 17
_NONE = np.iinfo(np.int64).max
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+"
)
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


def words_of(text: str) -> list[str]:
    """Normalized pre-tokens of a text that holds no special token."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    try:
        text.encode("latin-1")
        # These are composed already.
        return _LATIN.findall(text.lower())
    except UnicodeEncodeError:
        text = unicodedata.normalize("NFC", text)
    # One character at a time: a final sigma gets no form of its own.
    low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
    return _ANY.findall(low)


class Splitter:
    """Pre-tokens as the tokenizer's own normalizer and splitter give them.

    The rules above agree with these on ASCII and Latin-1. Any other character is tried once next to a letter, a digit,
    a sign, a space and itself; a text with a character on which the two differ, such as letters newer than the library's
    tables, is split by the library.
    """

    def __init__(self, file: str):
        library = Tokenizer.from_str(file)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.values = {letter: byte for byte, letter in enumerate(byte_symbols())}
        self.alike: dict[str, bool] = {}

    def by_library(self, text: str) -> list[str]:
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(self.values[letter] for letter in word).decode() for word, _ in found]

    def _agrees(self, sign: str) -> bool:
        if sign not in self.alike:
            tries = [sign, f"a{sign}a", f"1{sign}1", f"!{sign}!", f" {sign} ", sign * 2, f"{sign}a", f"a{sign}"]
            self.alike[sign] = sign.isascii() or all(words_of(text) == self.by_library(text) for text in tries)
        return self.alike[sign]

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return words_of(text) if all(map(self._agrees, {*text})) else self.by_library(text)
        return _LATIN.findall(text.lower())


class SegmentBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: bytes, remembered: int | None = None):
        spec = json.loads(file)
        model = spec["model"]
        # The library normalizes and splits only, and so needs no merges.
        self.splitter = Splitter(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.remembered = remembered or REMEMBERED_WORDS
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.tokens = {number: token for token, number in [*self.ids.items(), *self.special.items()]}
        merges = [tuple(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        pairs = np.array([self.ids[a] << 32 | self.ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in merges], np.int64)
        letters = byte_symbols()
        self.inner = np.array([self.ids[letter] for letter in letters], np.int64)
        self.last = np.array([self.ids[letter + self.suffix] for letter in letters], np.int64)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.numbers = {number: str(number) for number in self.tokens}
        #: Per word: number of tokens, ids as text, tokens as text.
        self.always: dict[str, tuple[int, str, str]] = {token: (1, str(n), token) for token, n in self.special.items()}
        self.known, self.older = dict(self.always), {}
        self.ranked: dict[int, int] = {}

    def _pair_values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Leaf values: rank times width plus place, or _NONE where the pair has no merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        found = (self.pairs[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at] * width + place, _NONE)

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge all rows of a (words, width) array of ids, -1 after the end; width is a power of two."""
        count, width = symbols.shape
        places = np.arange(width)
        after = np.where(symbols[:, 1:] >= 0, places[1:], -1)
        after = np.concatenate([after, np.full((count, 1), -1)], axis=1)
        before = np.broadcast_to(places - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), _NONE)
        tree[:, width : 2 * width - 1] = self._pair_values(symbols[:, :-1], symbols[:, 1:], places[:-1], width)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            rank, place = np.divmod(tree[rows, 1], width)
            right = after[rows, place]
            next_place = after[rows, right]
            symbols[rows, place] = self.merged[rank]
            symbols[rows, right] = -1
            after[rows, place] = next_place
            has_next = next_place >= 0
            before[rows[has_next], next_place[has_next]] = place[has_next]
            previous = before[rows, place]
            has_previous = previous >= 0
            tree[rows, width + right] = _NONE
            following = np.where(has_next, symbols[rows, next_place], -1)
            tree[rows, width + place] = self._pair_values(symbols[rows, place], following, place, width)
            some, where = rows[has_previous], previous[has_previous]
            tree[some, width + where] = self._pair_values(
                symbols[some, where], symbols[some, place[has_previous]], where, width
            )
            nodes = np.stack([place, right, np.where(has_previous, previous, place)]) + width
            while nodes[0, 0] > 1:
                nodes >>= 1
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != _NONE]
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long word, with plain numbers: arrays pay off for many words at a time only."""
        if not self.ranked:
            self.ranked.update(zip(self.pairs.tolist(), self.ranks.tolist()))
        ranked, merged, none = self.ranked, self.merged, _NONE
        count = len(symbols)
        width = 1 << (count - 1).bit_length()

        def leaf(place: int) -> int:
            following = after[place]
            rank = ranked.get(symbols[place] << 32 | symbols[following]) if following < count else None
            return none if rank is None else rank * width + place

        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        tree = [none] * width + [leaf(place) for place in range(count)] + [none] * (width - count)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, place = divmod(tree[1], width)
            gone = after[place]
            symbols[place] = int(merged[rank])
            after[place] = after[gone]
            if after[gone] < count:
                before[after[gone]] = place
            tree[width + gone], tree[width + place] = none, leaf(place)
            changed = [gone, place]
            if before[place] >= 0:
                tree[width + before[place]] = leaf(before[place])
                changed.append(before[place])
            for node in changed:
                node += width
                while node > 1:
                    node >>= 1
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
            symbols[gone] = -1
        return [symbol for symbol in symbols if symbol >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        raw = [word.encode("utf-8", "surrogatepass") for word in words]
        out: list[list[int]] = [[]] * len(words)
        lengths = np.array([len(value) for value in raw], np.int64)
        widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for place in np.flatnonzero(lengths >= LONG_WORD).tolist():
            symbols = self.inner[np.frombuffer(raw[place], np.uint8)].tolist()
            symbols[-1] = int(self.last[raw[place][-1]])
            out[place] = self._merge_long(symbols)
        widths[lengths >= LONG_WORD] = 0
        for width in np.unique(widths[widths > 0]):
            members = np.flatnonzero((widths == width) & (lengths > 0))
            step = max(1, TREE_SYMBOLS // int(width))
            for start in range(0, len(members), step):
                chosen = members[start : start + step]
                sizes = lengths[chosen]
                taken = np.arange(width) < sizes[:, None]
                data = np.frombuffer(b"".join(raw[place] for place in chosen), np.uint8)
                symbols = np.full((len(chosen), int(width)), -1, np.int64)
                symbols[taken] = self.inner[data]
                symbols[np.arange(len(chosen)), sizes - 1] = self.last[data[np.cumsum(sizes) - 1]]
                symbols = self._merge_rows(symbols)
                live = symbols >= 0
                flat = symbols[live].tolist()
                start_of = 0
                for place, end in zip(chosen.tolist(), np.cumsum(live.sum(axis=1)).tolist(), strict=True):
                    out[place] = flat[start_of:end]
                    start_of = end
        return out

    def learn(self, words: set[str]) -> None:
        """Have the encodings of these words at hand. Of older words, those used since the last turn stay."""
        if len(self.known) + len(words) > self.remembered:
            self.older, self.known = self.known, dict(self.always)
        missing = words - self.known.keys()
        again = missing & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = list(missing - again)
        tokens, numbers = self.tokens, self.numbers
        for word, ids in zip(new, self.encode_words(new), strict=True):
            self.known[word] = (len(ids), " ".join([numbers[n] for n in ids]), " ".join([tokens[n] for n in ids]))

    def pre_tokens(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.splitter.words(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else self.splitter.words(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        words = self.pre_tokens(text or "")
        self.learn({*words})
        return [int(number) for word in words for number in self.known[word][1].split(" ") if number]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: what a tokenizer file without a decoder gives."""
        return " ".join(self.tokens[number] for number in ids)

    def decode_text(self, ids: list[int]) -> str:
        """Readable text: bytes restored and one space for each word end."""
        values = {letter: byte for byte, letter in enumerate(byte_symbols())}
        out = bytearray()
        for number in ids:
            token = self.tokens[number]
            if number in self.special.values():
                out += token.encode()
                continue
            ended = token.endswith(self.suffix)
            out += bytes(values[letter] for letter in token.removesuffix(self.suffix))
            out += b" " * ended
        return out.decode("utf-8", "replace").rstrip(" ")


def _loaded(file, remembered: int | None = None) -> SegmentBpe:
    """One coder per worker, tokenizer file and number of words remembered."""
    remember(_coders)
    key = file.id, remembered
    if key not in _coders:
        _coders.clear()
        _coders[key] = SegmentBpe(file.value, remembered)
    return _coders[key]


_coders: dict[tuple[int, int | None], SegmentBpe] = {}


def tokenizer_file(df: DataFrame, path: str):
    """The tokenizer's file (a few MB, whatever the input) as a broadcast value."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


class _File:
    """Handle of a broadcast tokenizer file."""

    def __init__(self, held):
        self.held, self.id = held, held.id if hasattr(held, "id") else held._jbroadcast.id()

    @property
    def value(self) -> bytes:
        return self.held.value


def _texts(file: _File, remembered: int | None = None, chars: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(file, remembered)
        for batch in pieces(batches, "text", chars):
            parts = [coder.pre_tokens(text or "") for text in batch.column("text").to_pylist()]
            coder.learn({word for words in parts for word in words})
            counts, ids, texts = [], [], []
            for words in parts:
                found = list(zip(*map(coder.known.__getitem__, words), strict=True)) or [(), (), ()]
                counts.append(sum(found[0]))
                ids.append(" ".join(found[1]))
                texts.append(" ".join(found[2]))
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(value.encode()).hexdigest() for value in ids]),
                    pa.array([hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest() for value in texts]),
                ],
                [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _whole(file: _File):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(file)
        for batch in pieces(batches, "text", 1_000_000):
            coder.learn({w for text in batch.column("text").to_pylist() for w in coder.pre_tokens(text or "")})
            ids = [coder.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids])],
                ["_row", "ids", "decoded"],
            )

    return run


def encoded_digests(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", remembered: int | None = None,
    chars: int = 1_000_000,
) -> DataFrame:
    """Per row: id, ``n_tokens``, and digests of the ids and of the decoded text. Null texts count as empty (0 tokens);
    repeated rows, long words and long texts are encoded whole. ``remembered`` words and texts of ``chars`` at a time bound
    a worker's memory, not the result."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    file = _File(tokenizer_file(docs, path))
    out = rows.mapInArrow(_texts(file, remembered, chars), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def encoded(docs: DataFrame, path: str, text_column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the token ids and decoded text of each row (columns of those names are replaced)."""
    ship(docs.sparkSession)
    rows = docs.select(packed(docs), F.col(text_column).alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_whole(_File(tokenizer_file(docs, path))), f"_row {kind}, ids array<int>, decoded string")
    kept = [name for name in docs.columns if name not in (ids, decoded)]
    return out.select(*[F.col("_row").getField(n).alias(n) for n in kept], F.col("ids").alias(ids), F.col("decoded").alias(decoded))
