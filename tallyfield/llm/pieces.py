"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of an Arrow batch become one flat numpy array of symbols. In each round the
smallest pair rank of every unfinished word is taken by a segmented minimum, all leftmost
non-overlapping pairs of that rank are merged at once, the array is compacted, and the
ranks next to a merge are looked up anew, until no word has a pair left. A piece never
holds a space mark after another character, so words are independent of each other.

A merge can make a neighbour pair with a better rank than its own (when a vocabulary has a
long piece ahead of its parts). The first such merge of a word ends that word's round, so
the order of merges is always that of the library's queue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Encoded words that a Python worker remembers before it starts anew; only saves time.
CACHED_WORDS = 400_000
_NONE = np.int64(1 << 40)
_SPACED = re.compile(" +[^ ]*")


_MULTIPLIER = 0x9E3779B97F4A7C15


def _slot(keys: np.ndarray, multiplier: int, slots: int) -> np.ndarray:
    """Slot of each key in a table of a power of two slots (multiply and shift)."""
    return (keys.view(np.uint64) * np.uint64(multiplier)) >> np.uint64(65 - slots.bit_length())


def _hash_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Two tables of key positions: keys that share a slot of the first have one of their own in the second."""
    slots = max(16, 1 << (8 * len(keys)).bit_length())
    first, second = np.zeros(slots, dtype=np.int32), np.zeros(2 * slots, dtype=np.int32)
    at = _slot(keys, _MULTIPLIER, slots)
    first[at] = np.arange(len(keys))
    rest = np.flatnonzero(first[at] != np.arange(len(keys)))
    multiplier = _MULTIPLIER
    while True:
        multiplier = (multiplier * 0xD1342543DE82EF95 + 2) % 2**64 | 1
        at = _slot(keys[rest], multiplier, 2 * slots)
        if len(np.unique(at)) == len(rest):
            second[at] = rest
            return first, second, multiplier


class PieceModel:
    """Vocabulary and merge table of a BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor()
        lib.LoadFromSerializedProto(model)
        size = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds a space mark inside; words are not independent")
        self.size = size
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.shown: list[bytes] = []
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.shown.append(bytes([int(p[3:5], 16)]))
            elif lib.is_control(i):
                self.shown.append(b"")
            elif lib.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.shown.append(p.replace(MARK, " ").encode())
        self.is_byte = np.array([lib.is_byte(i) for i in range(size)])
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # Ranks follow the scores; pieces of equal score share a rank and merge leftmost first.
        scores = sorted({lib.get_score(i) for i in ids.values()}, reverse=True)
        of_score = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(size, _NONE, dtype=np.int64)
        for i in ids.values():
            self.rank[i] = of_score[lib.get_score(i)]
        pairs = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left * size + right, i))
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ids = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self._slots = _hash_slots(self.pair_keys)
        #: Pieces whose making can put a better pair beside them.
        self.interrupts = np.zeros(size, dtype=bool)
        for side in (self.pair_keys // size, self.pair_keys % size):
            worse = self.rank[self.pair_ids] <= self.rank[side]
            self.interrupts[side[worse]] = True

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank ``_NONE`` where no piece joins the two."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -1
        first, second, multiplier = self._slots
        at = first[_slot(keys, _MULTIPLIER, len(first))]
        found = self.pair_keys[at] == keys
        rest = np.flatnonzero(~found)
        at[rest] = second[_slot(keys[rest], multiplier, len(second))]
        found[rest] = self.pair_keys[at[rest]] == keys[rest]
        piece = np.where(found, self.pair_ids[at], 0)
        return piece, np.where(found, self.rank[piece], _NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; words start with their space marks."""
        if not words:
            return []
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.of_char[chars]
        owner = np.repeat(np.arange(len(words)), lengths)
        # Unknown characters never merge; -2 - code point keeps them apart from the pieces.
        symbols = np.where(symbols < 0, -2 - chars.astype(np.int64), symbols)
        done_symbols, done_owner = [], []
        piece, rank = self._neighbours(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(rank, starts)
            finished = np.repeat(least == _NONE, sizes)
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
                going = ~finished
                symbols, owner, piece, rank = symbols[going], owner[going], piece[going], rank[going]
                if not len(symbols):
                    break
                sizes, least = sizes[least < _NONE], least[least < _NONE]
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            # In a run of overlapping hits every other one, from the left, is merged.
            heads = np.r_[True, np.diff(hits) > 1]
            run_start = np.maximum.accumulate(np.where(heads, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
            made = piece[hits]
            if self.interrupts[made].any():
                stay = self._until_interrupt(symbols, owner, hits, made, rank[hits])
                hits, made = hits[stay], made[stay]
            symbols[hits] = made
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            symbols, owner, piece, rank = symbols[keep], owner[keep], piece[keep], rank[keep]
            now = hits - np.arange(len(hits))
            near = np.zeros(len(symbols), dtype=bool)
            near[now] = True
            near[now[now > 0] - 1] = True
            changed = np.flatnonzero(near)
            piece[changed], rank[changed] = self._pairs_at(symbols, owner, changed)
        order_owner = np.concatenate(done_owner)
        order = np.argsort(order_owner, kind="stable")
        symbols, owner = np.concatenate(done_symbols)[order], order_owner[order]
        return self._split(symbols, owner, len(words))

    def _pairs_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbols) - 1)
        piece, rank = self.merged(symbols[at], symbols[after])
        apart = (at + 1 >= len(symbols)) | (owner[at] != owner[after])
        return piece, np.where(apart, _NONE, rank)

    def _neighbours(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(symbols, owner, np.arange(len(symbols)))

    def _until_interrupt(
        self, symbols: np.ndarray, owner: np.ndarray, hits: np.ndarray, made: np.ndarray, rank: np.ndarray
    ) -> np.ndarray:
        """Which merges of this round come no later than the first that makes a better pair."""
        last = len(symbols) - 1
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, last)
        left = symbols[before]
        # The left neighbour may itself be the product of the merge just before.
        follows = np.r_[False, (np.diff(hits) == 2)]
        left = np.where(follows, np.r_[0, made[:-1]], left)
        _, left_rank = self.merged(left, made)
        _, right_rank = self.merged(made, symbols[after])
        left_rank[(hits == 0) | (owner[before] != owner[hits])] = _NONE
        right_rank[(hits + 2 > last) | (owner[after] != owner[hits])] = _NONE
        stops = self.interrupts[made] & (np.minimum(left_rank, right_rank) <= rank)
        passed = np.cumsum(stops) - stops
        first = np.r_[True, owner[hits][1:] != owner[hits][:-1]]
        base = np.maximum.accumulate(np.where(first, passed, 0))
        return passed == base

    def _split(self, symbols: np.ndarray, owner: np.ndarray, count: int) -> list[bytes]:
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            encoded = [chr(-2 - int(s)).encode("utf-8", "surrogatepass") for s in symbols[unknown]]
            repeat = np.ones(len(symbols), dtype=np.int64)
            repeat[unknown] = [len(e) for e in encoded]
            starts = np.cumsum(repeat) - repeat
            spread, owner = np.repeat(symbols, repeat), np.repeat(owner, repeat)
            raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
            places = np.concatenate([np.arange(starts[u], starts[u] + len(e)) for u, e in zip(unknown, encoded, strict=True)])
            spread[places] = self.byte_ids[raw]
            symbols = spread
        ends = (4 * np.cumsum(np.bincount(owner, minlength=count))).tolist()
        raw = symbols.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """Text of an id list; one leading space mark is dropped."""
        if not ids:
            return ""
        shown = self.shown
        raw = b"".join([shown[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        return text[1:] if text[:1] == " " and not self.is_byte[ids[0]] else text

    def _decode_runs(self, ids: list[int]) -> str:
        """Byte runs are read character by character; each bad byte gives U+FFFD."""
        out, at = [], 0
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                out.append(self.shown[ids[at]].decode())
                at += 1
                continue
            raw = bytearray()
            while at < len(ids) and self.is_byte[ids[at]]:
                raw += self.shown[ids[at]]
                at += 1
            while raw:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[:width]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    out.append("�")
                del raw[:width]
        return "".join(out)


class _Encoder:
    """Texts to id bytes through a bounded memory of words."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def words(self, text: str) -> list[str]:
        """Cut before each run of spaces; the first space of every word is implied."""
        if MARK in text:
            text = text.replace(MARK, " ")
        text = " " + text
        if "  " in text:
            return [w[1:] for w in _SPACED.findall(text)]
        return text.split(" ")[1:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:  # the words met first are the frequent ones
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        known = self.known
        missing = list(set().union(*cut) - known.keys())
        known.update(zip(missing, self.model.encode_words([MARK + w.replace(" ", MARK) for w in missing]), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def _model(model: bytes) -> PieceModel:
    return PieceModel(model)


def load_model(path: str) -> bytes:
    """The model file's bytes; its size is that of the vocabulary and not of the data."""
    with open(path, "rb") as file:
        return file.read()


def _slices(texts: pa.Array, limit: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts of a batch, in pieces of bounded size."""
    part, held = [], 0
    for text in texts:
        part.append(text.as_py())
        held += len(part[-1] or "")
        if held > limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_column(spark: SparkSession, text: Column, model: bytes) -> Column:
    """``array<int>`` of piece ids without begin or end; null and empty texts give an empty array."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(_model(shared.value))
        for batch in batches:
            coded = [ids for part in _slices(batch) for ids in encoder.encode(part)]
            offsets = np.zeros(len(coded) + 1, dtype=np.int32)
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            values = np.frombuffer(b"".join(coded), dtype="<i4")
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    return of(text)


def decode_column(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """Text of each id array; null gives the empty text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(shared.value)
        for batch in batches:
            lists = (batch[i].values for i in range(len(batch)))
            yield pa.array([model.decode(v.to_pylist() if v is not None else []) for v in lists], pa.string())

    return of(ids)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` text of every document.

    One row per input row, repeated rows included; only ``doc_id`` (which may be null) and
    ``text`` are read, so other columns cannot clash. Null and empty texts have no ids and
    decode to the empty text; texts of any length are encoded whole; an empty table gives an
    empty table.
    """
    spark, model = docs.sparkSession, load_model(model_path)
    coded = docs.select("doc_id", encode_column(spark, F.col("text"), model).alias("ids"))
    return coded.withColumn("decoded", decode_column(spark, F.col("ids"), model))


def digests(coded: DataFrame) -> DataFrame:
    """Token count and SHA-256 digests of ids (decimal, comma-joined) and of decoded texts."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
