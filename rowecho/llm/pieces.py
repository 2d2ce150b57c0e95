"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All different words of a batch are encoded together as one flat array of symbols. A round looks up
every neighbouring pair, takes the best rank of each word, merges its leftmost occurrences at
once, and compacts the arrays; words without a pair leave. Texts are put together from words.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import WORD_BATCH_BYTES, WORD_BATCH_ROWS, bounded_batches, table, text_or_empty

SPACE = "▁"  # stands for a blank in pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
NO_RANK = np.iinfo(np.int32).max
CACHED_CHARS = 1 << 20  # of the words whose ids a task keeps
SLICE_CHARS = 1 << 18  # of texts, or of words, encoded together


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at:at + size]
        at += size


class _Table:
    """Look-up of many int64 keys at once, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << 64 - int(self.shift)
        self.keys, self.values, self.last = np.full(size, -1, np.int64), np.full(size, missing, np.int32), size - 1
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):  # of keys that want one place the first takes it, the others go on
            _, first = np.unique(at[left], return_index=True)
            first = left[first]
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.last

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        there = self.keys[at]
        out = self.values[at]
        wrong = np.flatnonzero((there != keys) & (there >= 0))  # an empty place has the value of a missing key
        while len(wrong):
            at[wrong] = at[wrong] + 1 & self.last
            there[wrong], out[wrong] = self.keys[at[wrong]], self.values[at[wrong]]
            wrong = wrong[(there[wrong] != keys[wrong]) & (there[wrong] >= 0)]
        return out


class Pieces:
    """Vocabulary, merge table and normaliser flags of a BPE model with byte fallback."""

    def __init__(self, model: bytes):
        self.pieces, scores, self.kinds = [], [], []
        flags = {3: 1, 4: 1, 5: 1}  # dummy prefix, squeezed blanks, escaped blanks: defaults of the format
        for field, value in _fields(model):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                scores.append(struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(entry.get(3, NORMAL))
            elif field == 2 and dict(_fields(value)).get(3) != 2:
                raise ValueError("not a BPE model")
            elif field == 3:
                entry = dict(_fields(value))
                flags |= {k: entry[k] for k in flags if k in entry}
                if entry.get(2):
                    raise ValueError("models with a character map are not supported")
        self.prefix = bool(flags[3])
        if flags[4] or not flags[5] or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models that keep blanks and have no user defined or unused pieces")
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("pieces that go on after a blank are not supported")
        self.byte_id = np.full(256, self.kinds.index(UNKNOWN), np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_id[int(self.pieces[i][3:-1], 16)] = i
        if BYTE not in self.kinds:
            raise ValueError("only models with byte fallback")
        # characters that only occur inside pieces are symbols as well, beyond the vocabulary
        n = len(self.pieces)
        inner = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: n + i for i, c in enumerate(inner)}
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        order = sorted({scores[i] for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = np.full(n + 1, NO_RANK, np.int32)  # the last entry: no pair
        pairs, bigrams = {}, set()
        for p, i in ids.items():
            self.rank[i] = rank_of[scores[i]]
            bigrams.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] << 32 | symbols[p[k:]]] = i
        self.pairs = _Table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32), n)
        self.bigrams = _Table(np.array(list(bigrams), np.int64), np.ones(len(bigrams), np.int32), 0)
        self.n = n
        self.piece_bytes = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL
            else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)]
        self.piece_bytes.append(b"\xff")  # beyond the vocabulary: the end of a word
        self.id_texts = [str(i) for i in range(n)]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece each pair makes; ``self.n`` where it makes none."""
        known = (left >= 0) & (right >= 0)
        return np.where(known, self.pairs[np.where(known, left.astype(np.int64) << 32 | right, 0)], self.n)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, where the ids of each end); a word starts with its blanks."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        # no piece spans a pair of characters that is in no piece: a segment ends there
        bigram = points[:-1] << 21 | points[1:]
        opens = np.r_[True, (self.bigrams[bigram] == 0) | (owner[1:] != owner[:-1])]
        segment = np.cumsum(opens) - 1
        symbol = self.symbol_of[points]
        place = np.arange(len(points))  # where a symbol starts: names it to the end
        made = np.full(len(points), -2, np.int32)  # final symbol at its place, -2 if merged away
        merged = np.full(len(points), self.n, np.int32)
        inside = ~opens[1:]
        merged[:-1][inside] = self._merged(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[starts, len(symbol)])
            ranks = self.rank[merged]
            best = np.minimum.reduceat(ranks, starts)
            done = best == NO_RANK
            if done.any():
                out = np.repeat(done, sizes)
                made[place[out]] = symbol[out]
                symbol, segment, place, merged, ranks = (x[~out] for x in (symbol, segment, place, merged, ranks))
                best, sizes = best[~done], sizes[~done]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(ranks == np.repeat(best, sizes))
            # of occurrences that overlap, every second one from the left
            run = np.r_[True, np.diff(chosen) != 1]
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            chosen = self._independent(chosen, symbol, segment, merged)
            symbol[chosen] = merged[chosen]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            symbol, segment, place, merged = (x[keep] for x in (symbol, segment, place, merged))
            new = chosen - np.arange(len(chosen))  # one symbol fewer for each merge to the left
            touched = np.zeros(len(symbol), bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            changed = np.flatnonzero(touched)
            last = changed == len(symbol) - 1
            merged[changed[last]] = self.n
            changed = changed[~last]
            same = segment[changed] == segment[changed + 1]
            merged[changed[~same]] = self.n
            changed = changed[same]
            merged[changed] = self._merged(symbol[changed], symbol[changed + 1])
        return self._collect(made, points, owner, len(words))

    def _independent(self, chosen, symbol, segment, merged) -> np.ndarray:
        """Of the chosen merges those that come next in any case: merging one by one from the left,
        a merge could make a pair of the same or a better rank, which then goes first. Within a
        segment, merges up to the first such one are kept."""
        several = np.r_[False, segment[chosen[1:]] == segment[chosen[:-1]]]
        if not several.any():
            return chosen
        piece, rank = merged[chosen], self.rank[merged[chosen]]
        left = np.maximum(chosen - 1, 0)
        before = symbol[left].copy()
        touching = np.r_[False, chosen[1:] - chosen[:-1] == 2]
        before[touching] = piece[:-1][touching[1:]]
        right = np.minimum(chosen + 2, len(symbol) - 1)
        first = np.where((chosen > 0) & (segment[left] == segment[chosen]), self._merged(before, piece), self.n)
        second = np.where((right == chosen + 2) & (segment[right] == segment[chosen]),
                          self._merged(piece, symbol[right]), self.n)
        unsafe = (self.rank[first] <= rank) | (self.rank[second] <= rank)
        if not unsafe.any():
            return chosen
        # merges after an unsafe one of their segment wait
        count = np.cumsum(unsafe) - unsafe
        head = np.flatnonzero(~several)
        return chosen[count == count[head][np.cumsum(~several) - 1]]

    def _collect(self, made, points, owner, n_words) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols in order, those without a piece as their bytes."""
        at = np.flatnonzero(made != -2)
        ids, owner = made[at], owner[at]
        foreign = np.flatnonzero((ids < 0) | (ids >= self.n))
        if len(foreign):
            data = [self.byte_id[list(chr(p).encode())] for p in points[at[foreign]]]
            repeats = np.ones(len(ids), np.int64)
            repeats[foreign] = [len(d) for d in data]
            ends = np.cumsum(repeats)
            ids, owner = np.repeat(ids, repeats), np.repeat(owner, repeats)
            for k, d in zip(foreign, data):
                ids[ends[k] - len(d):ends[k]] = d
        return ids, np.searchsorted(owner, np.arange(1, n_words + 1))

    def words(self, text: str) -> list[str]:
        """The words of a normalised text, each with the blanks before it."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[-1] != " " and (self.prefix and text[0] != " "):
            return [SPACE + w for w in text.split(" ")]
        normal = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(self.piece_bytes[i] for i in ids if self.kinds[i] != CONTROL)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if self.prefix and first is not None and self.pieces[first].startswith(SPACE):
            data = data[1:]
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as bad:
                out.append(data[at:at + bad.start].decode() + "�")
                at += bad.start + 1
        return "".join(out)


_LOADED: dict[bytes, Pieces] = {}  # of a worker process: one model, however many tasks


def loaded(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


class _Words:
    """Words of a task with their ids: decimal, joined by commas, and decoded where that is another text
    than the word. Words are kept up to ``CACHED_CHARS`` characters and one slice."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.listed: list[str] = []
        self.odd: dict[str, bytes] = {}
        self.ids, self.ends, self.chars = [], [np.zeros(1, np.int64)], 0

    def learn(self, split: list[list[str]]) -> None:
        """Have the ids of all words of ``split``."""
        if self.chars > CACHED_CHARS:
            self.clear()
        new, block, size = set().union(*split) - self.place.keys(), [], 0
        for word in new:
            block.append(word)
            size += len(word)
            if size >= SLICE_CHARS:
                self._add(block)
                block, size = [], 0
        if block:
            self._add(block)

    def _add(self, words: list[str]) -> None:
        ids, ends = self.pieces.encode_words(words)
        self.place.update(zip(words, range(len(self.listed), len(self.listed) + len(words))))
        texts = list(map(self.pieces.id_texts.__getitem__, ids.tolist()))
        begins = [0, *ends[:-1].tolist()]
        self.listed += [",".join(texts[a:b]) for a, b in zip(begins, ends.tolist())]
        # nearly all words decode to themselves: all at once, then one by one where they do not
        plain = b"\xff".join(map(str.encode, words)).replace(SPACE.encode(), b" ") + b"\xff"
        with_ends = np.insert(ids, ends, self.pieces.n).tolist()
        if plain != b"".join(map(self.pieces.piece_bytes.__getitem__, with_ends)):
            for word, a, b in zip(words, begins, ends.tolist()):
                back = b"".join([self.pieces.piece_bytes[i] for i in ids[a:b].tolist()])
                if back != word.replace(SPACE, " ").encode():
                    self.odd[word] = back
        self.ids.append(ids)
        self.ends.append(self.ends[-1][-1] + ends)
        self.chars += sum(map(len, words))

    def ids_of(self, split: list[list[str]]) -> np.ndarray:
        """The ids of all texts one after another."""
        at = np.fromiter((self.place[w] for words in split for w in words), np.int64)
        flat, ends = np.concatenate([np.zeros(0, np.int32), *self.ids]), np.concatenate(self.ends)
        self.ids, self.ends = [flat], [ends]
        # the ends of blocks follow each other, the first 0 stands before them
        begins, counts = ends[at], ends[at + 1] - ends[at]
        steps = np.cumsum(counts)
        return flat[np.repeat(begins - steps + counts, counts) + np.arange(steps[-1] if len(steps) else 0)]


def _texts(batches: Iterator[pa.RecordBatch], most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``most`` characters of text (or one longer text)."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column(1)).to_pylist()
        start = size = 0
        for i, own in enumerate(sizes):
            size += own
            if size >= most or i == len(sizes) - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(1).to_pylist()
                start, size = i + 1, 0


def decode(tokens: DataFrame, model: bytes, ids_column: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""
    spark = tokens.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        pieces = loaded(shared.value)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode(docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text",
           with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, unless ``with_ids`` is false), ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (the text the ids decode to) of every whole text.

    Null counts as empty, an empty text has no ids. Rows repeated with their id give a row each;
    other columns are not read."""
    spark = docs.sparkSession
    bounded_batches(spark, WORD_BATCH_ROWS, WORD_BATCH_BYTES)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches):
        pieces = loaded(shared.value)
        known = _Words(pieces)
        for batch, texts in _texts(batches):
            split = [pieces.words(t) for t in texts]
            known.learn(split)
            sizes, listed, decoded = [], [], []
            place, line, odd = known.place, known.listed, known.odd
            for words in split:
                ids = ",".join([line[place[w]] for w in words])
                sizes.append(ids.count(",") + 1 if ids else 0)
                listed.append(hashlib.sha256(ids.encode()).hexdigest())
                # a word's bytes are whole characters, so texts decode word by word
                if odd and not odd.keys().isdisjoint(words):
                    text = b"".join([odd[w] if w in odd else w.replace(SPACE, " ").encode() for w in words])
                else:
                    text = "".join(words).replace(SPACE, " ").encode()
                decoded.append(hashlib.sha256(text[1:] if pieces.prefix and text[:1] == b" " else text).hexdigest())
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            all_ids = [pa.ListArray.from_arrays(ends, pa.array(known.ids_of(split)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *all_ids, pa.array(listed), pa.array(decoded)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, "
                                "decoded_sha256 string")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:  # a file of the driver's own installation
        return file.read()


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model(), with_ids=False)
