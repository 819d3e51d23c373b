"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document is its token ids and one end id. Only documents longer than the capacity are
cut, into pieces of the capacity; the last piece may be shorter.

Packing runs in bulk-synchronous steps. Lengths are whole numbers up to the capacity, so
documents and gaps sorted by length are runs of equal values: at most `capacity` runs each,
however many documents there are. A step sweeps the longest remaining run of documents over
the sorted gap runs, takes the successor (the smallest gap that holds the length), resolves
the contest for it by rank (the first documents of the run get it), updates the gaps, and
repeats. The sweep sees only run lengths, which is why it needs one small aggregate and no
document; it yields intervals (length, first rank) -> (first sequence, offset). Documents
find their place from their rank within their length, which is computed in parallel, with
long runs split over salted parts. The outcome is that of best-fit decreasing.

Defined cases: a null or empty text is the end id alone; repeated rows are packed once per
row; a null document id stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm import words
from monthloom.session import stage

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words a Python worker remembers; beyond it forgets all of them.
REMEMBERED = 3_000_000
#: Documents of one length that are ranked in one group.
GROUP = 2_000

_SEPARATOR = "<|endoftext|>"
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in ".,!?;:"]] = True
_memory: dict[str, "_Vocabulary"] = {}


class _Vocabulary:
    """Token ids of the words seen so far, by hash of the word.

    Ids of a text are the ids of its blank-delimited words in order: this vocabulary's
    tokenizer drops white space and never joins across it. Rare words are most of the work,
    so each is tokenised once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per text."""
        plain = [x for x in texts if "<|" not in x.lower()]
        if len(plain) < len(texts):
            each = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
            flat = np.array([i for ids in each for i in ids], dtype=np.int32)
            return flat, np.array([len(ids) for ids in each], dtype=np.int64)
        groups = [_SEPARATOR.join(texts[i : i + 512]) for i in range(0, len(texts), 512)]
        found = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        flat = np.concatenate(
            [np.array(x.ids + [self.separator], dtype=np.int32) for x in found]
        )
        stops = np.flatnonzero(flat == self.separator)
        return flat[flat != self.separator], np.diff(stops, prepend=-1) - 1

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        special = np.array(["<|" in x for x in texts], dtype=bool)
        for group in (special, ~special):
            if not group.any():
                continue
            flat, count = self.encode([x for x, g in zip(texts, group, strict=True) if g])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
            self.ids[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(count) - count
            self.used += len(flat)
            place = np.searchsorted(self.hashes, hashes[group])
            self.hashes = np.insert(self.hashes, place, hashes[group])
            self.begin = np.insert(self.begin, place, begin)
            self.count = np.insert(self.count, place, count)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each (sorted, distinct) hash is, and whether it is known."""
        place = np.searchsorted(self.hashes, hashes)
        if len(self.hashes) == 0:
            return place, np.zeros(len(hashes), dtype=bool)
        known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes
        return place, known


def _vocabulary(path: str) -> _Vocabulary:
    if path not in _memory:
        _memory[path] = _Vocabulary(path)
    return _memory[path]


def _split_tails(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with closing punctuation after an ASCII letter as two parts. The tokenizer
    cuts there anyway, and the parts repeat more often than the whole."""
    stem = w.ends.copy()
    for _ in range(4):
        more = (stem > w.starts) & _TAIL[w.data[stem - 1]]
        if not more.any():
            break
        stem[more] -= 1
    last = w.data[np.maximum(stem - 1, 0)]
    cut = (stem > w.starts) & (stem < w.ends) & (last >= 97) & (last <= 122)
    stem = np.where(cut, stem, w.ends)
    starts = np.concatenate([w.starts, stem[cut]])
    ends = np.concatenate([stem, w.ends[cut]])
    doc = np.concatenate([w.doc, w.doc[cut]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], doc[order]


def _ids(column: pa.Array, a: int, b: int, vocabulary: _Vocabulary, end_id: int):
    """Flat ids of the rows, end ids included, and the offsets of the rows."""
    w = words.cut(column, a, b, words.NOT_BLANK)
    starts, ends, doc = _split_tails(w)
    parts = words.Words(w.data, w.offsets, starts, ends, doc)
    hashes = parts.hashes()
    raw, offsets = words.text_buffer(column)
    raw = raw[offsets[a] : offsets[b]]
    # Marks that open special tokens are case-sensitive: such words keep their own case.
    opens = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
    for k in np.unique(np.searchsorted(starts, opens, side="right") - 1).tolist():
        own = raw[starts[k] : ends[k]].tobytes()
        hashes[k] = np.frombuffer(blake2b(own, digest_size=8).digest(), dtype=np.uint64)[0]
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    place, known = vocabulary.find(distinct)
    if not known.all():
        if len(vocabulary.hashes) + len(distinct) > REMEMBERED:
            vocabulary.forget()
            known = np.zeros(len(distinct), dtype=bool)
        new = first[~known]
        special = {int(k) for k in np.searchsorted(starts, opens, side="right") - 1}
        texts = [
            (raw if k in special else w.data)[starts[k] : ends[k]].tobytes().decode("utf-8")
            for k in new.tolist()
        ]
        vocabulary.learn(distinct[~known], texts)
        place, known = vocabulary.find(distinct)
    begin, count = vocabulary.begin[place][which], vocabulary.count[place][which]
    rows = b - a
    per_row = np.zeros(rows, dtype=np.int64)
    np.add.at(per_row, doc, count)
    sizes = per_row + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], dtype=np.uint32)
    out[bounds[1:] - 1] = end_id
    before = np.cumsum(count) - count
    source = np.repeat(begin - before, count) + np.arange(count.sum())
    target = np.repeat(doc, count) + np.arange(count.sum())
    out[target] = vocabulary.ids[source]
    return out, bounds


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def task(batches):
        vocabulary = _vocabulary(path)
        for batch in batches:
            column = batch.column(1)
            for a, b in words.slices(column):
                ids, bounds = _ids(column, a, b, vocabulary, end_id)
                sizes = np.diff(bounds)
                parts = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), parts)
                piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = bounds[row] + start
                crc = [
                    zlib.crc32(ids[i : i + n]) for i, n in zip(at.tolist(), length.tolist(), strict=True)
                ]
                columns = [
                    batch.column(0).slice(a, b - a).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, type=pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    # Pieces follow each other in the flat ids without a gap.
                    edges = np.concatenate([at, bounds[-1:]]).astype(np.int32)
                    columns.append(
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.view(np.int32)))
                    )
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return task


def token_pieces(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: `id`, `piece`, `start`, `length`, `ids_crc32` and, if asked, `ids`."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    return words.map_arrow(keyed, _pieces(vocabulary, capacity, end_id, with_ids), schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs: rows (length, first rank, count, first sequence, offset).

    `counts` has the number of pieces of each length. Gaps are runs of sequences with the
    same room, kept sorted by room; each is a stack of (first sequence, count)."""
    plan = []
    rooms: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def add(room: int, first: int, count: int) -> None:
        if room > 0:
            if not gaps.get(room):
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                new = -(-left // (capacity // length))
                add(capacity, opened, new)
                opened += new
                continue
            room = rooms[k]
            first, count = gaps[room].pop()
            take = min(left, count)
            if take < count:
                gaps[room].append((first + take, count - take))
            elif not gaps[room]:
                rooms.pop(k)
            plan.append((length, rank, take, first, capacity - room))
            add(room - length, first, take)
            rank, left = rank + take, left - take
    return plan


def _place(plan: np.ndarray):
    """Sequence and offset of a piece from its length and rank, by binary search."""
    shift = np.int64(1 << 48)
    keys = plan[:, 0] * shift + plan[:, 1]
    order = np.argsort(keys)
    keys, rows = keys[order], plan[order]

    def task(batches):
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            rank = np.asarray(batch.column(batch.schema.get_field_index("rank")))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            found = rows[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(batch.num_columns - 1)),
                    pa.array(found[:, 3] + rank - found[:, 1]),
                    pa.array(found[:, 4]),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return task


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns, `length` from 1 to `capacity`) with `sequence_id` and `offset`.

    The table is staged first: ranks must be those of one fixed set of rows."""
    fixed = stage(pieces.withColumn("row_", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in fixed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fixed.drop("row_").withColumns(
            {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}
        )
    plan = np.array(sweep(counts, capacity), dtype=np.int64)
    salts = -(-max(counts.values()) // GROUP)
    salted = fixed.withColumn("salt_", F.pmod(F.xxhash64("row_"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt_")
        .agg(F.count("*").alias("n_"))
        .withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
        .drop("n_")
    )
    inside = Window.partitionBy("length", "salt_").orderBy("row_")
    ranked = (
        salted.withColumn("place_", F.row_number().over(inside) - 1)
        .join(bases, ["length", "salt_"])
        .select(
            *(F.col(c) for c in pieces.columns), (F.col("base_") + F.col("place_")).alias("rank")
        )
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return words.map_arrow(
        ranked, _place(plan), ", ".join([*fields, "sequence_id long", "offset long"])
    )


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    pieces = token_pieces(docs, vocabulary, doc_id, text, capacity, end_id, with_ids)
    return best_fit(pieces, capacity).withColumnRenamed("id", doc_id)


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, vocabulary_file())
