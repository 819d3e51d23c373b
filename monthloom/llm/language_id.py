"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every
piece, learned by expectation-maximisation: a word's segmentations share its count in
proportion to their probability. A word's probability is the sum over all segmentations,
by the forward algorithm; a text's is the product over its words. Rare words cost most of
the work, so each distinct word is computed once per worker, many at a time as arrays.

The pieces are fitted on a bounded sample of labelled rows: about `SAMPLE` documents of
each language, chosen by a hash of the id. Everything else reads all rows whole.

Words are runs of letters, lower-cased, with a mark of their start, however long; those of more
than `SHORT` letters are summed in logarithms, as their probabilities are too small for a
double. Letters outside the vocabulary are pieces of probability `UNKNOWN` in every language;
all letter pieces of the vocabulary are used. A word without any known piece still has its
mark's probability in each language.

Defined cases: a null text, or one without letters, is `und` with score 0; without
labelled rows every text is; ties go to the language that comes first by name; repeated
rows are judged once per row; extra columns are ignored; a null language is no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import words
from monthloom.session import stage

VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 500
ROUNDS = 3
SHORT = 32
UNKNOWN = 1e-7
FLOOR = 1e-9
REMEMBERED = 3_000_000
UNDEFINED = "und"

_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def pieces_of(path: str) -> list[str]:
    """Pieces of the vocabulary made of letters, in lower case, with the mark of a start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix(_MARK)
        if (not body or body.isalpha()) and piece:
            found.add(piece)
    return sorted(found | {_MARK})


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts of equal length as a matrix."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(-1, width)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


class Pieces:
    """The vocabulary as sorted hashes; `lattice` yields its pieces inside words."""

    def __init__(self, pieces: list[str]):
        value = np.zeros(len(pieces), dtype=np.uint64)
        length = np.array([len(p) for p in pieces])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            value[at] = _prefix_hashes(_codes([pieces[i] for i in at], n))[:, -1]
        order = np.argsort(value)
        self.hashes, self.index = value[order], order
        self.size = len(pieces)
        self.longest = int(length.max())
        self.power = np.multiply.accumulate(
            np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE, dtype=np.uint64)])
        )

    def lattice(self, codes: np.ndarray):
        """For every span (start, end): the words that have a piece there, and the piece.
        A single unknown character is the piece `size`."""
        prefix = _prefix_hashes(codes)
        for end in range(1, codes.shape[1] + 1):
            for start in range(max(0, end - self.longest), end):
                value = prefix[:, end] - prefix[:, start] * self.power[end - start]
                at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                known = self.hashes[at] == value
                if end - start == 1:
                    yield start, end, slice(None), np.where(known, self.index[at], self.size)
                elif known.any():
                    rows = np.flatnonzero(known)
                    yield start, end, rows, self.index[at[rows]]


def forward(pieces: Pieces, probability: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each end: [end, word] and one axis more for languages."""
    alpha = np.zeros((codes.shape[1] + 1, len(codes), *probability.shape[1:]))
    alpha[0] = 1
    for start, end, rows, piece in pieces.lattice(codes):
        alpha[end][rows] += alpha[start][rows] * probability[piece]
    return alpha


def expected(pieces: Pieces, probability, codes, counts) -> np.ndarray:
    """Expected uses of each piece (the last: unknown) in one language, all segmentations
    weighed: sums before a span, its probability, and sums after it."""
    spans = list(pieces.lattice(codes))
    alpha = np.zeros((codes.shape[1] + 1, len(codes)))
    beta = np.zeros_like(alpha)
    alpha[0] = beta[-1] = 1
    for start, end, rows, piece in spans:
        alpha[end][rows] += alpha[start][rows] * probability[piece]
    for start, end, rows, piece in reversed(spans):
        beta[start][rows] += beta[end][rows] * probability[piece]
    weight = counts / alpha[-1]
    out = np.zeros(pieces.size + 1)
    for start, end, rows, piece in spans:
        use = alpha[start][rows] * probability[piece] * beta[end][rows] * weight[rows]
        np.add.at(out, piece, use)
    return out


def _ending(pieces: Pieces, codes: np.ndarray) -> np.ndarray:
    """For one word: the piece of each length (column) that ends at each letter, or -1."""
    prefix = _prefix_hashes(codes)[0]
    width = codes.shape[1]
    out = np.full((width, pieces.longest), -1, dtype=np.int64)
    for n in range(1, min(pieces.longest, width) + 1):
        value = prefix[n:] - prefix[:-n] * pieces.power[n]
        at = np.minimum(np.searchsorted(pieces.hashes, value), len(pieces.hashes) - 1)
        known = pieces.hashes[at] == value
        out[n - 1 :, n - 1] = np.where(known, pieces.index[at], pieces.size if n == 1 else -1)
    return out


def _log_total(terms: np.ndarray) -> np.ndarray:
    most = terms.max(axis=0)
    return most + np.log(np.exp(terms - most).sum(axis=0))


def log_forward(pieces: Pieces, logs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """`forward` of one word of any length, in logarithms: [end] and an axis for languages."""
    ending = _ending(pieces, codes)
    alpha = np.zeros((codes.shape[1] + 1, *logs.shape[1:]))
    for end, row in enumerate(ending, 1):
        size = np.flatnonzero(row >= 0)
        alpha[end] = _log_total(alpha[end - 1 - size] + logs[row[size]])
    return alpha


def log_expected(pieces: Pieces, logs: np.ndarray, codes: np.ndarray, count) -> np.ndarray:
    """`expected` of one word of any length and one language."""
    ending = _ending(pieces, codes)
    alpha = log_forward(pieces, logs, codes)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    out = np.zeros(pieces.size + 1)
    for end in range(codes.shape[1], 0, -1):
        row = ending[end - 1]
        size = np.flatnonzero(row >= 0)
        after = logs[row[size]] + beta[end]
        start = end - 1 - size
        beta[start] = np.logaddexp(beta[start], after)
        np.add.at(out, row[size], count * np.exp(alpha[start] + after - alpha[-1]))
    return out


def letter_runs(text: str) -> list[str]:
    """Marked runs of letters of a lower-cased word."""
    if not text.isalpha():
        text = "".join(c if c.isalpha() else " " for c in text)
    return [_MARK + run for run in text.split()]


def by_width(texts: list[str], cells: int = 400_000):
    """Indices of texts of equal length, in blocks of bounded size; long ones one by one."""
    length = np.array([len(t) for t in texts])
    for width in np.unique(length).tolist():
        at = np.flatnonzero(length == width)
        step = max(1, cells // (width * width)) if width <= SHORT else 1
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, _codes([texts[k] for k in part], width)


class Scorer:
    """Log-probabilities of words in every language, remembered by hash."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        self.pieces, self.probability = Pieces(pieces), probability
        self.log_probability = np.log(probability)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        # One column per language, and the number of letter runs.
        self.logs = np.zeros((0, self.probability.shape[1] + 1))

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        owner, runs = [], []
        for i, text in enumerate(texts):
            for run in letter_runs(text.lower()):
                owner.append(i)
                runs.append(run)
        found = np.zeros((len(texts), self.logs.shape[1]))
        owner = np.array(owner, dtype=np.int64)
        for part, codes in by_width(runs):
            if codes.shape[1] > SHORT:
                total = log_forward(self.pieces, self.log_probability, codes)[-1:]
            else:
                total = np.log(forward(self.pieces, self.probability, codes)[-1])
            np.add.at(found, owner[part], np.column_stack([total, np.ones(len(part))]))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.logs = np.insert(self.logs, place, found, axis=0)

    def rows(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Rows of sorted, distinct hashes; `text_of` gives the texts of given ones."""
        for _ in range(2):
            place = np.searchsorted(self.hashes, hashes)
            at = np.minimum(place, max(0, len(self.hashes) - 1))
            known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
            if known.all():
                break
            if len(self.hashes) + len(hashes) > REMEMBERED:
                self.forget()
                known[:] = False
            self.learn(hashes[~known], text_of(np.flatnonzero(~known)))
        return self.logs[at]


def _cut(column, a, b):
    w = words.cut(column, a, b, _LETTER)
    hashes = w.hashes()
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)

    def text_of(at):
        return [w.data[w.starts[k] : w.ends[k]].tobytes().decode("utf-8") for k in first[at].tolist()]

    return w, distinct, which, text_of


def _sample_words(batches):
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b in words.slices(batch.column(0)):
            w, distinct, which, text_of = _cut(batch.column(0), a, b)
            lang = np.unique(np.array([x or "" for x in langs[a:b]]), return_inverse=True)
            key, count = np.unique(
                lang[1][w.doc] * np.int64(max(1, len(distinct))) + which, return_counts=True
            )
            word = key % max(1, len(distinct))
            texts = text_of(np.arange(len(distinct)))
            rows = {}
            for k, name, n in zip(word.tolist(), lang[0][key // max(1, len(distinct))], count.tolist(), strict=True):
                for run in letter_runs(texts[k].lower()):
                    rows[name, run] = rows.get((name, run), 0) + n
            yield pa.record_batch(
                [
                    pa.array([str(r[0]) for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array(list(rows.values()), pa.int64()),
                ],
                names=["lang", "run", "n"],
            )


def _expected_rows(shared):
    def task(batches):
        names, probability, langs = shared.value
        pieces = Pieces(names)
        column = {x: i for i, x in enumerate(langs)}
        total = np.zeros((pieces.size + 1, len(langs)))
        for batch in batches:
            texts, count = batch.column(1).to_pylist(), np.asarray(batch.column(2))
            lang = np.array([column[x] for x in batch.column(0).to_pylist()])
            for k in np.unique(lang).tolist():
                mine = np.flatnonzero(lang == k)
                logs = np.log(probability[:, k])
                for part, codes in by_width([texts[i] for i in mine]):
                    n = count[mine[part]]
                    if codes.shape[1] > SHORT:
                        total[:, k] += log_expected(pieces, logs, codes, n[0])
                    else:
                        total[:, k] += expected(pieces, probability[:, k], codes, n)
        piece, lang = np.nonzero(total[:-1])
        yield pa.record_batch(
            [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])],
            names=["piece", "lang", "use"],
        )

    return task


def _predictions(shared, drop_text: bool):
    scorers: dict[str, Scorer] = {}

    def task(batches):
        names, probability, langs = shared.value
        if "it" not in scorers:
            scorers["it"] = Scorer(names, probability)
        scorer = scorers["it"]
        for batch in batches:
            kept = [i for i in range(batch.num_columns) if i != 1 or not drop_text]
            for a, b in words.slices(batch.column(1)):
                w, distinct, which, text_of = _cut(batch.column(1), a, b)
                logs = scorer.rows(distinct, text_of)
                total = np.stack(
                    [np.bincount(w.doc, logs[which, k], minlength=b - a) for k in range(logs.shape[1])], axis=1
                )
                best = total[:, :-1].argmax(axis=1)
                share = np.exp(total[:, :-1] - total[:, :-1].max(axis=1, keepdims=True))
                score = 1 / share.sum(axis=1)
                none = total[:, -1] == 0
                yield pa.record_batch(
                    [
                        *(batch.column(i).slice(a, b - a) for i in kept),
                        pa.array(np.where(none, UNDEFINED, np.array(langs)[best]).tolist(), pa.string()),
                        pa.array(np.where(none, 0.0, score)),
                    ],
                    names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score"],
                )

    return task


def fit(labelled: DataFrame, vocabulary: str, doc_id="doc_id", text="text", lang="lang",
        sample: int = SAMPLE, rounds: int = ROUNDS):
    """Pieces, probabilities [piece, language] and language names from labelled rows."""
    rows = labelled.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).where("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1, 0)), []
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    limit = F.element_at(
        F.create_map(*(F.lit(x) for k in langs for x in (k, int((1 << 20) * min(1, sample / counts[k])) or 1))),
        F.col("lang"),
    )
    runs = stage(
        words.map_arrow(
            rows.where(draw < limit).select("text", "lang"), _sample_words, "lang string, run string, n long"
        )
        .groupBy("lang", "run")
        .agg(F.sum("n").alias("n"))
    )
    names = pieces_of(vocabulary)
    probability = np.full((len(names) + 1, len(langs)), 1 / len(names))
    probability[-1] = UNKNOWN
    context = labelled.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((names, probability, langs))
        found = (
            words.map_arrow(runs, _expected_rows(shared), "piece long, lang long, use double")
            .groupBy("piece", "lang")
            .agg(F.sum("use").alias("use"))
            .toArrow()
            .combine_chunks()
        )
        use = np.zeros((len(names), len(langs)))
        use[np.asarray(found["piece"]), np.asarray(found["lang"])] = np.asarray(found["use"])
        share = use / np.maximum(use.sum(axis=0), 1)
        probability[:-1] = (1 - UNKNOWN) * (share + FLOOR) / (1 + FLOOR * len(names))
        shared.destroy()
    return names, probability, langs


def identify(docs: DataFrame, model, doc_id="doc_id", text="text", keep=()) -> DataFrame:
    """One row per document row: `doc_id`, the columns in `keep`, `lang_pred`, `score`. `keep`
    may name the text; then no join brings it back."""
    names, probability, langs = model
    columns = docs.select(
        F.col(doc_id).alias("id_"),
        F.col(text).alias("text_"),
        *(F.col(k) for k in keep if k not in (doc_id, text)),
    )
    out = [F.col("id_").alias(doc_id), *(F.col("text_").alias(text) if k == text else F.col(k) for k in keep if k != doc_id)]
    if not langs:
        return columns.select(*out, F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((names, probability, langs))
    left_out = () if text in keep else ("text_",)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name not in left_out]
    found = words.map_arrow(
        columns,
        _predictions(shared, bool(left_out)),
        ", ".join([*fields, "lang_pred string", "score double"]),
    )
    return found.select(*out, "lang_pred", "score")


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_segmentation_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held_out), vocabulary_file())
    return identify(docs.withColumn("held_out", held_out), model, keep=["held_out"])
