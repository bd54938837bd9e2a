"""Language-model scores by prediction by partial matching over a byte-context trie.

A text is a sequence of tokens: its words, with A-Z in lower case, then one end. A text is of
one of 26 kinds, which its most frequent word decides (so texts of one language or layout
mostly share a kind); the kind is told first, all kinds being alike. A word is opened by the
kind's capital letter, spelt byte by byte and closed by a space; contexts are the last bytes
since the opening, at most ``ORDER`` of them. A node of the trie is one context, its parent
the context without the oldest byte, so short words are predicted kind by kind and all kinds
share what the longer ones are made of. A symbol met in a context has probability n / (T + q) (n
its count, T the context's total, q its number of different symbols); the rest, q / (T + q),
is the escape, which is handed to the shorter context with the symbols already ruled out
taken off its distribution. Below the empty context all 256 bytes are alike.

The trie is a table with a row for each context and symbol, built from the counts of all
different training words and as large as the corpus makes it. It is never gathered in one
place: groups of words ask for the log probabilities of their different context-symbol
pairs, a join answers, and words add them up. Documents add up their words; the most
frequent words (a fixed number) are handed to the tasks, the others are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import Stored, lower_words, remainder, store

#: Longest context in bytes; contexts of up to six fit the packed keys.
ORDER = 5
FOLD = (5, 1)
#: Different words that are spelt together in one task.
WORDS_AT_A_TIME = 200_000
#: Frequent words whose scores every task holds; the rest are joined.
FREQUENT = 200_000
_COUNTED = 400_000
#: Kinds of texts; their openings are the capital letters, which no lower-cased word holds.
KINDS = 26
#: Symbols in frequent contexts whose scores every task holds where contexts cross words; the rest are joined.
FREQUENT_KEYS = 1_000_000
_HELD_KEYS = 2_000_000
TELL_KIND = -log10(KINDS)
_SYMBOL_BITS, _CONTEXT_BITS = 8, 48


def _laid(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all forms one after the other; owner and offset in the form."""
    flat = np.frombuffer(b"".join(forms), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
    owner = np.repeat(np.arange(len(forms)), sizes)
    return flat, owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all opened words with closing symbol; owner and offset in the word.

    An opening alone stands for the end token, which a tab closes.
    """
    return _laid([w + b" " if len(w) > 1 else w + b"\t" for w in words])


def _running(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of whole texts: an opening, each word and a space, the end; owner and offset in the text."""
    return _laid([b"A" + b"".join([w + b" " for w in lower_words(text)]) + b"\t" for text in texts])


def _keys(flat: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Packed order, context and symbol of the bytes at ``at``."""
    context = np.zeros(len(at), dtype=np.int64)
    for back in range(1, ORDER + 1):
        use = order >= back
        context |= np.where(use, flat[np.maximum(at - back, 0)], 0) << (8 * (back - 1))
    return ((np.int64(1) * order << _CONTEXT_BITS | context) << _SYMBOL_BITS) | flat[at]


def longest_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of the longest context at every symbol of every word, and the word's number."""
    return _longest(*_spelt(words))


def _longest(flat: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(offset > 0)
    return _keys(flat, at, np.minimum(offset[at], ORDER)), owner[at]


def context_counts(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    """Different keys of all orders and how often they occur; counted by hash, not by order."""
    flat, owner, offset = _spelt(words)
    context, parts = np.zeros(len(flat), dtype=np.int64), []
    for order in range(ORDER + 1):
        if order:
            context[order:] |= flat[:-order] << (8 * (order - 1))
        at = np.flatnonzero(offset >= max(order, 1))
        keys = ((np.int64(1) * order << _CONTEXT_BITS | context[at]) << _SYMBOL_BITS) | flat[at]
        found = pa.table({"key": keys, "n": counts[owner[at]]})
        parts.append(found.group_by("key", use_threads=False).aggregate([("n", "sum")]))
    every = pa.concat_tables(parts).combine_chunks()
    arrays = [every.column(c).combine_chunks() for c in ("key", "n_sum")]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "n"])


def _node(key: Column) -> Column:
    return F.shiftright(key, _SYMBOL_BITS)


def _shorter(key: str, steps: int = 1) -> Column:
    """The key in column ``key`` without its oldest ``steps`` context bytes; null where it has fewer."""
    order = f"shiftright({key}, {_CONTEXT_BITS + _SYMBOL_BITS})"
    kept = f"shiftleft(1L, cast(8 * ({order} - {steps}) + {_SYMBOL_BITS} as int)) - 1"
    high = f"shiftleft({order} - {steps}, {_CONTEXT_BITS + _SYMBOL_BITS})"
    return F.expr(f"if({order} >= {steps}, {high} | ({key} & ({kept})), null)")


def opening(counts: Counter) -> bytes:
    """Capital letter of a text's kind: by its most frequent word, among equals the shortest and first."""
    if not counts:
        return b"A"
    most = max(counts.values())
    words = [w for w, n in counts.items() if n == most]
    return bytes([65 + zlib.crc32(min(words, key=lambda w: (len(w), w))) % KINDS])


@dataclass(frozen=True)
class Trie:
    """Tables ``grams`` (key, p) and ``nodes`` (node, escape)."""

    grams: Stored
    nodes: Stored


@dataclass(frozen=True)
class PpmModel:
    """Tables of the trie and of the words, and token counts of training.

    ``grams`` (key, p), ``nodes`` (node, escape), ``words`` (opened word, its count n) and
    ``totals`` (word, its count c over all kinds).
    """

    grams: Stored
    nodes: Stored
    words: Stored
    totals: Stored
    train_tokens: int
    distinct: int

    def scale(self) -> float:
        """What half-smoothed counts are divided by: tokens and half of the kinds and one more."""
        return self.train_tokens + 0.5 * (self.distinct + 1)

    def drop(self) -> None:
        for table in (self.grams, self.nodes, self.words, self.totals):
            table.drop()


def learned(doc_id: Column) -> Column:
    """Whether a row is learned from (a null id is)."""
    return F.coalesce(remainder(doc_id, FOLD[0]) != FOLD[1], F.lit(True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opened words of texts with their counts in training texts (zero: only elsewhere)."""

    def out(kinds: dict[bytes, Counter]) -> pa.RecordBatch:
        words = [first + word for first, counts in kinds.items() for word in counts]
        sums = [n for counts in kinds.values() for n in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(sums, pa.int64())], names=["opened", "n"])

    kinds: dict[bytes, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, learn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = lower_words(text)
            own = Counter(words)
            counts = kinds[opening(own)]
            words.append(b"")
            if learn:
                counts.update(words)
            else:
                for word in (*own, b""):
                    counts.setdefault(word, 0)
            if sum(map(len, kinds.values())) > _COUNTED:
                yield out(kinds)
                kinds = defaultdict(Counter)
    if kinds:
        yield out(kinds)


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key counts of words with counts; equal keys of several batches are added up in part."""
    words: list[bytes] = []
    counts: list[np.ndarray] = []

    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy())
        if len(words) >= WORDS_AT_A_TIME:
            yield context_counts(words, np.concatenate(counts))
            words, counts = [], []
    if words:
        yield context_counts(words, np.concatenate(counts))


def train(docs: DataFrame) -> PpmModel:
    """Word counts, trie and escapes of all documents outside the held-out fold.

    ``docs`` has ``text`` and a boolean ``learn``.
    """
    counted = docs.select("text", "learn").mapInArrow(_count_words, "opened binary, n long")
    words = store(counted.groupBy("opened").agg(F.sum("n").alias("n")), "words")
    bare = F.expr("substring(opened, 2)").alias("word")
    totals = store(words.df.groupBy(bare).agg(F.sum("n").alias("c")), "word-totals")
    tokens, distinct = totals.df.filter("c > 0").agg(F.sum("c"), F.count("*")).first()
    contexts = words.df.filter("n > 0").mapInArrow(_count_contexts, "key long, n long")
    grams, nodes = _trie(contexts)
    return PpmModel(grams, nodes, words, totals, int(tokens or 0), int(distinct or 0))


def _trie(contexts: DataFrame) -> tuple[Stored, Stored]:
    """Probabilities of symbols in contexts and escapes of contexts, from counts of keys of all orders."""
    raw = store(contexts.groupBy("key").agg(F.sum("n").alias("n")), "contexts")
    sums = raw.df.groupBy(_node(F.col("key")).alias("node")).agg(
        F.sum("n").alias("total"), F.count("*").alias("symbols")
    )
    key = raw.df.select(_node(F.col("key")).alias("node"), "key", "n")
    grams = store(
        key.join(sums, "node").select("key", "node", (F.col("n") / (F.col("total") + F.col("symbols"))).alias("p")), "grams"
    )
    # What the shorter context gives to the symbols of a context, all of which it has met too.
    lower = grams.df.select(F.col("key").alias("low"), F.col("p").alias("low_p"))
    above = grams.df.withColumn("low", _shorter("key")).filter("low is not null")
    ruled = above.join(lower, "low").groupBy("node").agg(F.sum("low_p").alias("ruled_out"))
    nodes = sums.join(ruled, "node", "left").select(
        "node",
        (
            F.col("symbols")
            / (F.col("total") + F.col("symbols"))
            / (1 - F.coalesce("ruled_out", F.col("symbols") / 256))
        ).alias("escape"),
    )
    kept = store(nodes, "nodes")
    raw.drop()
    return grams, kept


def key_scores(model: PpmModel | Trie, keys: DataFrame) -> DataFrame:
    """``key``, ``logp``: log10 probability of each symbol in its longest context.

    ``keys`` has different keys only. Where the longest context has not met the symbol, the
    chain of shorter ones is followed: escapes multiply until one has met it.
    """
    grams = model.grams.df.select("key", "p")
    met = keys.join(grams, "key", "left")
    direct = met.filter("p is not null").select("key", F.log10("p").alias("logp"))
    # The chain has at most ORDER + 1 members.
    chain = [_shorter("key", steps) for steps in range(ORDER + 1)]
    missed = keys.join(grams, "key", "left_anti").select("key", F.posexplode(F.array(*chain)).alias("step", "own"))
    missed = missed.filter("own is not null")
    with_p = missed.join(grams.select(F.col("key").alias("own"), "p"), "own", "left")
    escapes = model.nodes.df.select(F.col("node").alias("own_node"), "escape")
    with_both = with_p.withColumn("own_node", _node(F.col("own"))).join(escapes, "own_node", "left")
    # Up to the first context that has met the symbol: its escape does not count, those before do.
    first = F.min(F.when(F.col("p").isNotNull(), F.col("step")))
    steps = F.array_sort(F.collect_list(F.struct("step", "p", "escape")))
    walked = with_both.groupBy("key").agg(first.alias("met_at"), steps.alias("steps"))
    none = F.lit(0.0)

    def add(total: Column, step: Column) -> Column:
        passed = F.col("met_at").isNull() | (step["step"] < F.col("met_at"))
        here = F.when(passed, F.coalesce(F.log10(step["escape"]), none))
        return total + F.coalesce(here, F.when(step["step"] == F.col("met_at"), F.log10(step["p"])), none)

    bottom = F.when(F.col("met_at").isNull(), F.lit(log10(1 / 256))).otherwise(none)
    indirect = walked.select("key", F.aggregate("steps", bottom, add).alias("logp"))
    return direct.unionByName(indirect)


def word_scores(model: PpmModel) -> DataFrame:
    """``opened``, ``n``, ``logp`` of every different opened word of the documents, and ``c`` of the word."""
    total = model.words.df.count()
    groups = max(1, -(-total // WORDS_AT_A_TIME))
    words = model.words.df.withColumn("part", F.pmod(F.xxhash64("opened"), F.lit(groups)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        keys = np.unique(longest_keys(table.column("opened").to_pylist())[0])
        return pa.table({"part": np.full(len(keys), table.column("part")[0].as_py(), np.int32), "key": keys})

    def answer(words: pa.Table, answers: pa.Table) -> pa.Table:
        own = words.column("opened").to_pylist()
        if not own:
            return pa.table({"opened": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})
        known, logp = answers.column("key").to_numpy(), answers.column("logp").to_numpy()
        order = np.argsort(known)
        keys, owner = longest_keys(own)
        each = logp[order][np.searchsorted(known[order], keys)]
        sums = np.bincount(owner, weights=each, minlength=len(own))
        return pa.table({"opened": words.column("opened"), "n": words.column("n"), "logp": sums})

    asked = store(words.groupBy("part").applyInArrow(ask, "part int, key long"), "asked")
    scores = key_scores(model, asked.df.select("key").distinct())
    answered = asked.df.join(scores, "key").select("part", "key", "logp")
    together = words.groupBy("part").cogroup(answered.groupBy("part"))
    scored = together.applyInArrow(answer, "opened binary, n long, logp double")
    return scored.withColumn("word", F.expr("substring(opened, 2)")).join(model.totals.df, "word").drop("word")


def _count_running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest keys at all symbols of texts: how often in training texts, and in all."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        found = pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum"), ("every", "sum")])
        return found.select(["key", "n_sum", "every_sum"]).rename_columns(["key", "n", "every"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owner = _longest(*_running(batch.column("text").to_pylist()))
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
        held.append(pa.table({"key": keys, "n": learn[owner], "every": np.ones(len(keys), np.int64)}))
        if sum(t.num_rows for t in held) > _HELD_KEYS:
            held = [merged()]
            if held[0].num_rows > _HELD_KEYS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def running_scores(texts: DataFrame) -> DataFrame:
    """``row``, ``score``: log10 probability of every text, its contexts reaching over the spaces.

    ``texts`` has ``row``, which has to stay the same when read again, ``text`` and ``learn``.
    """
    counted = texts.select("text", "learn").mapInArrow(_count_running, "key long, n long, every long")
    longest = store(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "longest")
    # A symbol counts in its longest context and in all shorter ones.
    chain = F.explode(F.array(*[_shorter("key", steps) for steps in range(ORDER + 1)]))
    contexts = longest.df.filter("n > 0").select(chain.alias("key"), "n").filter("key is not null")
    scored = store(key_scores(Trie(*_trie(contexts)), longest.df.select("key")), "key-scores")
    most = scored.df.join(longest.df.select("key", "every"), "key").orderBy(F.col("every").desc(), "key").limit(FREQUENT_KEYS)
    shared = texts.sparkSession.sparkContext.broadcast(most.select("key", "logp").toArrow().sort_by("key"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text with what its frequent keys give, one per other symbol."""
        known, logp = (shared.value[c].to_numpy() for c in ("key", "logp"))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("row").to_numpy()
            keys, owner = _longest(*_running(batch.column("text").to_pylist()))
            different, which = np.unique(keys, return_inverse=True)
            place = np.minimum(np.searchsorted(known, different), len(known) - 1)
            each = np.where(known[place] == different, logp[place], np.nan)[which]
            other = np.isnan(each)
            sums = np.bincount(owner, weights=np.where(other, 0.0, each), minlength=len(rows))
            yield pa.RecordBatch.from_pydict({"row": rows, "key": pa.nulls(len(rows), pa.int64()), "score": sums})
            rest = {"row": rows[owner[other]], "key": keys[other]}
            yield pa.RecordBatch.from_pydict(rest | {"score": pa.nulls(int(other.sum()), pa.float64())})

    parts = store(texts.select("row", "text").mapInArrow(spread, "row long, key long, score double"), "running")
    joined = parts.df.filter("key is not null").select("row", "key").join(scored.df, "key").select("row", F.col("logp").alias("score"))
    return parts.df.filter("key is null").select("row", "score").unionByName(joined).groupBy("row").agg(F.sum("score").alias("score"))


def score_documents(docs: DataFrame, across_words: bool = False, both: bool = False) -> DataFrame:
    """Log10 probabilities of all documents, learned from those outside the held-out fold.

    Returns one row per input row: ``doc_id``, ``held_out``, ``n_tokens`` (words and one
    end), ``n_known`` (tokens met in training), ``train_tokens``, ``base_score`` (smoothed
    unigram) and ``score``, whose contexts end at the word's opening unless ``across_words``;
    ``both`` has that one and ``running_score``, whose contexts reach across words. Null and empty texts are an end alone; whole texts of any length
    count; repeated rows are learned from and scored one by one; a null id is learned from;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", learned(F.col("doc_id")).alias("learn"))
    model = train(marked)
    scored = store(word_scores(model), "word-scores")
    # FREQUENT words at most; they stay in columns until a task needs them.
    shared = spark.sparkContext.broadcast(scored.df.orderBy(F.col("n").desc(), "opened").limit(FREQUENT).drop("n").toArrow())
    scale = model.scale()
    columns = "row long, opened binary, n long, doc_id long, learn boolean, n_tokens long, known long, base double, score double"
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with what its frequent words give, one per other word."""
        words, counts, logps = (shared.value[c].to_pylist() for c in ("opened", "c", "logp"))
        frequent: dict[bytes, dict] = defaultdict(dict)
        for opened, c, logp in zip(words, counts, logps, strict=True):
            frequent[opened[:1]][opened[1:]] = (c > 0, log10((c + 0.5) / scale), logp)
        for batch in batches:
            if not batch.num_rows:
                continue
            own_rows: list[tuple] = []
            others: list[bytes] = []
            times: list[int] = []
            lengths: list[int] = []
            for row, doc_id, text, learn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = lower_words(text)
                own_counts = Counter(words)
                first = opening(own_counts)
                found_in = frequent[first].get
                own_counts[b""] = 1
                known, base, score, before = 0, 0.0, TELL_KIND, len(others)
                for word, n in own_counts.items():
                    found = found_in(word)
                    if found is None:
                        others.append(first + word)
                        times.append(n)
                        continue
                    known += n if found[0] else 0
                    base += n * found[1]
                    score += n * found[2]
                lengths.append(len(others) - before)
                # No word holds a space, so the document's own row meets nothing in the join.
                own_rows.append((row, b" %d" % row, 0, doc_id, learn, len(words) + 1, known, base, score))
            arrays = [pa.array(v, t) for v, t in zip(zip(*own_rows, strict=True), types, strict=True)]
            repeated = pa.array(np.repeat(arrays[0].to_numpy(), lengths))
            rest = [repeated, pa.array(others, pa.binary()), pa.array(times, pa.int64())]
            rest += [pa.nulls(len(others), t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(arrays, rest, strict=True)], names=names)

    numbered = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "learn")
    if across_words or both:  # row numbers have to stay, as they are read by several passes
        numbered = store(numbered, "numbered").df
    parts = numbered.mapInArrow(spread, columns)
    table = scored.df.select("opened", "c", "logp")
    base = F.log10((F.col("c") + 0.5) / F.lit(scale))
    joined = parts.join(table, "opened", "left").select(
        "row", "doc_id", "learn", "n_tokens",
        F.coalesce("known", F.when(F.col("c") > 0, F.col("n")), F.lit(0)).alias("known"),
        F.coalesce(F.col("base"), F.col("n") * base).alias("base"),
        F.coalesce(F.col("score"), F.col("n") * F.col("logp")).alias("score"),
    )
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        (~F.max("learn")).alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    if both:
        found = found.join(running_scores(numbered).withColumnRenamed("score", "running_score"), "row")
    elif across_words:
        found = found.drop("score").join(running_scores(numbered), "row")
    return found.drop("row")
