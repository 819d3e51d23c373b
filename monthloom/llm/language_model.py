"""Language-model scores by deleted interpolation over words.

    P(w | u v) = a3 n(u v w) / n(u v) + a2 n(v w) / n(v) + a1 n(w) / n + a0 / (V + 1)

Every word, pair and triple of the training texts is counted, whatever its rank. An order
whose context was never seen takes the estimate of the order below. The weights `a` depend on
how frequent the contexts are (buckets of powers of two) and are learned by
expectation-maximisation on documents kept out of the estimates; then the estimates are taken
from all training documents. V is the number of training words with the text's end; one more
stands for all unknown words.

Documents are put together to chunks of about `LOCAL` words. A chunk asks for each of its
distinct n-grams once and says how often it holds it itself, so the most frequent n-gram of a
corpus costs one entry per chunk. Entries meet by their hash, are summed, and only the sums
go back, in the order of the hashes. No table of n-grams is sent to tasks or to the driver.

n-grams are compared by 63 bits of a hash.

Defined cases: a null or empty text is the end token alone; with no training text every
estimate is uniform; null ids are hashed as null and count as held out; repeated rows are
scored (and counted) once per row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import words
from monthloom.session import reclaim, scratch, stage

#: Words of a chunk, at least, where there are as many in its partition.
LOCAL = 1 << 18
DELTA = 0.1
ROUNDS = 8
BUCKETS = 24
#: Sizes of a dense `Model`.
SYMBOLS = 64
COARSE = 8

_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_TIMES, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_ONE = np.uint64(1)
_CODEC = pa.Codec("zstd", compression_level=1)
#: Ranges of hashes that are summed one after the other; n-grams that a task sums, about.
SHARES = 4
_ENTRIES = 2_000_000


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1)), BUCKETS - 1).astype(np.int64)


def estimates(triple, two, pair, one, single, tokens: int, types: int):
    """Estimates of the four orders, one column each, and the bucket. `two` and `one` are the
    counts of the contexts of `triple` and `pair`."""
    out = np.empty((len(triple), 4))
    out[:, 3] = 1 / types
    out[:, 2] = single / tokens if tokens else out[:, 3]
    out[:, 1] = np.where(one > 0, pair / np.maximum(one, 1), out[:, 2])
    out[:, 0] = np.where(two > 0, triple / np.maximum(two, 1), out[:, 1])
    return out, _level(two) * BUCKETS + _level(one)


class Model:
    """The mixture over dense tables, rows contexts and columns words, where those are few."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, weights: np.ndarray):
        self.pairs, self.triples, self.weights = pairs, triples, weights
        self.pair_context = pairs.sum(axis=1, dtype=np.int64)
        self.triple_context = triples.sum(axis=1, dtype=np.int64)
        self.single = pairs.sum(axis=0, dtype=np.int64)

    def log10(self, now, before, context) -> np.ndarray:
        parts, bucket = estimates(
            self.triples[context, now],
            self.triple_context[context],
            self.pairs[before, now],
            self.pair_context[before],
            self.single[now],
            int(self.single.sum()),
            self.pairs.shape[1],
        )
        return np.log10((parts * self.weights[bucket]).sum(axis=1))


def even_weights() -> np.ndarray:
    return np.full((BUCKETS * BUCKETS, 4), 0.25)


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 by byte planes, compressed; `_unpack` is the inverse."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(4, "little") + bytes([width]) + _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(data) -> np.ndarray:
    size, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(_CODEC.decompress(data[5:], size * width, asbytes=True), dtype=np.uint8)
    out = np.zeros((size, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, size).T
    return out.view("<u8")[:, 0]


def _chunks(size: int):
    """Documents put together: distinct words, and all words in order as places among them.
    Documents that the weights are learned from have chunks of their own."""

    def task(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[bool, list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]] = {False: [], True: []}
        room = {False: size, True: size}

        def out(em: bool):
            nonlocal made
            columns = [pa.concat_arrays([r.column(k) for r, _, _ in held[em]]) for k in range(2)]
            count = np.concatenate([c for _, c, _ in held[em]])
            known, index = np.unique(np.concatenate([h for _, _, h in held[em]]), return_inverse=True)
            held[em].clear()
            train = ~np.asarray(columns[1])
            lists = [*columns, pa.array(count.astype(np.int32))]
            whole = pa.array(np.array([0, len(count)], dtype=np.int32))
            learned = int((count + 1)[train].sum())
            made, room[em] = made + 1, size
            return pa.record_batch(
                [
                    pa.array([(part << 32) + made]),
                    pa.array([em]),
                    *(pa.ListArray.from_arrays(whole, a) for a in lists),
                    _packed([np.diff(known, prepend=np.uint64(0))]),
                    _packed([index]),
                    pa.array([int((count + 1).sum())]),
                    pa.array([learned]),
                    pa.array([0 if em else learned]),
                ],
                names=["chunk", "em", "ids", "held_out", "count", "known", "places", "size", "tokens", "kept"],
            )

        for batch in batches:
            about = pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 2)], names=["id", "held_out"])
            weighing = np.asarray(batch.column(3)) & ~np.asarray(batch.column(2))
            for a, b in words.slices(batch.column(1)):
                w = words.cut(batch.column(1), a, b, words.NOT_BLANK)
                count, hashes = w.counts(), w.hashes()
                for em in (False, True):
                    mine = weighing[a:b] == em
                    if mine.any():
                        rows = about.slice(a, b - a).filter(pa.array(mine))
                        held[em].append((rows, count[mine], hashes[mine[w.doc]]))
                        room[em] -= int((count[mine] + 1).sum())
                        if room[em] <= 0:
                            yield out(em)
        for em in (False, True):
            if held[em]:
                yield out(em)

    return task


class _Chunk:
    """The n-grams of a chunk: hashes of each token's word, then the pairs and triples it ends."""

    def __init__(self, held_out, count, known, places):
        self.count = np.asarray(count).astype(np.int64)
        self.train = ~np.asarray(held_out)
        known = np.cumsum(_unpack(known), dtype=np.uint64)
        places = _unpack(places).astype(np.int64)
        self.tokens = len(places) + len(self.count)
        self.ends = np.cumsum(self.count + 1) - 1
        self.starts = self.ends - self.count
        word = np.ones(self.tokens, dtype=bool)
        word[self.ends] = False
        now = np.full(self.tokens, _END)
        now[word] = known[places]
        before = self.after(now, _START)
        far = self.after(before, _START)
        one = words.mix(now) | _ONE
        two = words.mix(before * _TIMES + now + _STEP) & ~_ONE
        three = words.mix((far * _TIMES + before) * _TIMES + now + _STEP + _STEP) & ~_ONE
        self.grams = np.concatenate([one, two, three])

    def after(self, values, first):
        """The value of the token before, `first` for a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def each(self, of_document):
        return np.repeat(of_document, self.count + 1)

    def counts(self, sums):
        """Per token: counts for `estimates` in its order."""
        _, at = np.unique(self.grams, return_inverse=True)
        single, pair, triple = sums[at].reshape(3, -1)
        texts = single[self.ends[0]]
        return triple, self.after(pair, texts), pair, self.after(single, texts), single


def _packed(arrays) -> pa.Array:
    return pa.array([_pack(a) for a in arrays], pa.binary())


def _rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def _chunk_of(row):
    held_out, count = (row[c].values for c in ("held_out", "count"))
    return _Chunk(held_out, count, row["known"].as_py(), row["places"].as_py())


_ASKED = "chunk long, em boolean, part int, steps binary, n binary"


def _ask(bits: int, share: int):
    """A chunk's n-grams with how often it holds them, cut by the first bits of the hash. Of
    `SHARES` equal ranges of hashes only one is taken, so that their tables can follow each other."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def task(batches):
        for row in _rows_of(batches):
            chunk = _chunk_of(row)
            mine = np.flatnonzero(chunk.grams // np.uint64(2**64 // SHARES) == share)
            keys, at = np.unique(chunk.grams[mine], return_inverse=True)
            owner = mine % chunk.tokens
            n = np.bincount(at[chunk.each(chunk.train)[owner]], minlength=len(keys))
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            part = np.flatnonzero(np.diff(cuts))
            steps = np.diff(keys, prepend=np.uint64(0))
            # a part's first hash counts from where the part begins, so that it is no longer than the steps
            steps[cuts[part]] = keys[cuts[part]] - (part.astype(np.uint64) << np.uint64(64 - bits))
            cut = lambda a: _packed(a[cuts[p] : cuts[p + 1]] for p in part)
            yield pa.record_batch(
                [pa.array(np.full(len(part), row["chunk"].as_py())), pa.array(np.full(len(part), row["em"].as_py())),
                 pa.array(part.astype(np.int32)), cut(steps), cut(n)],
                names=["chunk", "em", "part", "steps", "n"],
            )

    return task


_ANSWERS = "chunk long, part int, n binary, kept binary, types long, kept_types long"


def _answer(bits: int):
    def task(batches):
        """The sums over all chunks for every entry, and for chunks of documents that the weights
        are learned from those over the other chunks as well; `types` is about words and counts
        once a task."""
        rows = [[], [], [], [], []]
        for batch in batches:
            for k in range(5):
                rows[k] += batch.column(k).to_pylist()
        chunk, em, part, keys, times = rows
        if not chunk:
            return
        begin = np.array(part, dtype=np.uint64) << np.uint64(64 - bits)
        keys = [np.cumsum(_unpack(x), dtype=np.uint64) + b for x, b in zip(keys, begin)]
        size = [len(k) for k in keys]
        bounds = np.concatenate([[0], np.cumsum(size)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate([_unpack(y) for y in times])
        n = np.bincount(at, times, len(distinct)).astype(np.int64)
        times[np.repeat(np.array(em), size)] = 0
        kept = np.bincount(at, times, len(distinct)).astype(np.int64)
        word = (distinct & _ONE).astype(bool)
        types, kept_types = (int((word & (x > 0)).sum()) for x in (n, kept))
        for a in range(0, len(chunk), words.BATCH_ROWS):
            b = min(len(chunk), a + words.BATCH_ROWS)
            first = np.zeros(b - a, dtype=np.int64)
            first[:1] = a == 0
            places = [at[bounds[k] : bounds[k + 1]] for k in range(a, b)]
            both = [_pack(kept[p]) if e else None for p, e in zip(places, em[a:b])]
            yield pa.record_batch(
                [pa.array(chunk[a:b], pa.int64()), pa.array(part[a:b], pa.int32()),
                 _packed(n[p] for p in places), pa.array(both, pa.binary()),
                 pa.array(first * types), pa.array(first * kept_types)],
                names=["chunk", "part", "n", "kept", "types", "kept_types"],
            )

    return task


def _with_answers(chunks: DataFrame, answers: DataFrame, column: str, function, schema: str) -> DataFrame:
    """`function(chunk row, its _Chunk, sums)` gives a record batch per chunk; a chunk comes before its answers."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = F.struct("ids", "held_out", "count", "known", "places")
    own = chunks.select("chunk", F.lit(-1).alias("part"), data.alias("data"), F.lit(None).cast("binary").alias("sums"))
    found = answers.select("chunk", "part", F.lit(None).cast(own.schema["data"].dataType).alias("data"), F.col(column).alias("sums"))
    both = own.unionByName(found).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    names = [f.name for f in own.schema["data"].dataType]

    def task(batches):
        row, sums = None, []

        def out():
            chunk = _chunk_of(row)
            return function(row, chunk, np.concatenate(sums))

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].as_py() < 0:
                    if row is not None:
                        yield out()
                    data = batch.column(2)[k]
                    row, sums = {n: data[n] for n in names}, []
                else:
                    sums.append(_unpack(batch.column(3)[k].as_py()).astype(np.int64))
        if row is not None:
            yield out()

    return words.map_arrow(both, task, schema)


_COUNTS = ("triple", "two", "pair", "one", "single")


def _kept_counts(row, chunk, sums):
    """Counts of the tokens of a chunk that the weights are learned from."""
    return pa.record_batch([_packed([c]) for c in chunk.counts(sums)], names=_COUNTS)


def _expectation(weights, tokens: int, types: int):
    """Responsibilities of the four orders, summed by bucket."""

    def task(batches):
        total = np.zeros((BUCKETS * BUCKETS, 4))
        for row in _rows_of(batches):
            counts = (_unpack(row[c].as_py()).astype(np.int64) for c in _COUNTS)
            parts, bucket = estimates(*counts, tokens, types)
            share = parts * weights[bucket]
            share /= share.sum(axis=1, keepdims=True)
            for k in range(4):
                total[:, k] += np.bincount(bucket, share[:, k], minlength=len(total))
        at = np.flatnonzero(total.sum(axis=1))
        yield pa.record_batch(
            [pa.array(at), *(pa.array(total[at, k]) for k in range(4))],
            names=["bucket", "p0", "p1", "p2", "p3"],
        )

    return task


def learn_weights(counts: DataFrame, tokens: int, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by EM over rows of `_kept_counts`."""
    weights = even_weights()
    for _ in range(rounds):
        found = (
            words.map_arrow(counts, _expectation(weights, tokens, types), "bucket long, p0 double, p1 double, p2 double, p3 double")
            .groupBy("bucket")
            .agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(4)))
            .collect()
        )
        new = even_weights() * 4  # one token's worth of doubt keeps every weight above zero
        for r in found:
            new[r["bucket"]] += [r["p0"], r["p1"], r["p2"], r["p3"]]
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _score(weights, tokens: int, types: int):
    def function(row, chunk, sums):
        counts = chunk.counts(sums)
        parts, bucket = estimates(*counts, tokens, types + 1)
        base = np.log10((counts[-1] + DELTA) / (tokens + DELTA * (types + 1)))
        score = np.log10((parts * weights[bucket]).sum(axis=1))
        by_document = lambda v: np.add.reduceat(v, chunk.starts)
        return pa.record_batch(
            [
                row["ids"].values,
                row["held_out"].values,
                pa.array(chunk.count + 1),
                pa.array(by_document((counts[-1] > 0).astype(np.int64))),
                pa.array(by_document(base)),
                pa.array(by_document(score)),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return function


def _sums(chunks: DataFrame, bits: int, share: int, parts: int) -> DataFrame:
    asked = words.map_arrow(chunks.drop("ids"), _ask(bits, share), _ASKED)
    return stage(words.map_arrow(asked.repartition(parts, "part"), _answer(bits), _ANSWERS))


def interpolated_scores(
    docs: DataFrame, training, em_part, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """Scores of all rows. `training` is the condition of rows to learn from, `em_part` that
    of those among them whose text is kept for the weights."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(doc_id).alias("id"),
        F.col(text).alias("text"),
        (~F.coalesce(training, F.lit(False))).alias("held_out"),
        F.coalesce(em_part, F.lit(False)).alias("em"),
    )
    kind = keyed.schema["id"].dataType.simpleString()
    chunks = stage(
        words.map_arrow(
            keyed,
            _chunks(LOCAL),
            f"chunk long, em boolean, ids array<{kind}>, held_out array<boolean>, count array<int>, "
            "known binary, places binary, size long, tokens long, kept long",
        )
    )
    size, tokens, kept = (x or 0 for x in chunks.agg(F.sum("size"), F.sum("tokens"), F.sum("kept")).first())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size // (SHARES * _ENTRIES))
    bits = max(9, parts.bit_length() + 3)
    answers = None
    for share in range(SHARES):
        found = _sums(chunks, bits, share, parts)
        answers = found if answers is None else answers.unionByName(found)
        reclaim(spark)
    types, kept_types = (x or 0 for x in answers.agg(F.sum("types"), F.sum("kept_types")).first())
    with scratch(spark):
        weighing = answers.where("kept is not null")
        counts = ", ".join(f"{c} binary" for c in _COUNTS)
        used = stage(_with_answers(chunks.where("em"), weighing, "kept", _kept_counts, counts))
        reclaim(spark)
        weights = learn_weights(used, kept, kept_types + 1, rounds)
    return _with_answers(
        chunks,
        answers,
        "n",
        _score(weights, tokens, types),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    ).select(
        F.col("id").alias(doc_id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 10
    return interpolated_scores(docs, part != 0, part == 1)
