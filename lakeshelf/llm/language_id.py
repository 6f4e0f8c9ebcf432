"""Language identification by segmentation-marginalised unigrams.

Each language has one probability per piece of a fixed public vocabulary. A word's probability is the sum over all of
its segmentations into pieces (forward algorithm); a text's is the product over its words. The piece probabilities are
learnt by expectation-maximisation over word counts: expected piece counts come from the forward-backward pass.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import hash_share, held_out, keyed_text, prepare, stored

#: Letters with their marks only: digits, signs and white space separate words.
WORD, PLAIN_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile("[a-z]+")
UNKNOWN, SMOOTHING = 1e-9, 100.0
#: Bounds: documents to learn from (expected), and numbers of words' scores that a worker remembers of late.
TRAIN_DOCS, MOST_SCORES = 4000, 400_000
#: Letters of a block of words that are summed at once, and the least sum that isn't rescaled.
BLOCK_LETTERS, LEAST_SUM = 40_000, 1e-60
NO_LANGUAGE = "und"


def words_of(text: str) -> list[str]:
    return (PLAIN_WORD if text.isascii() else WORD).findall(text.lower())


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of a SentencePiece model; a leading ▁ stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    pieces = sorted({p for p in found if "▁" not in p[1:] and p == p.lower() and p != "▁" and WORD.fullmatch(p.lstrip("▁"))} | {"▁"})
    return {p: i for i, p in enumerate(pieces)}


class Lattice:
    """Sums over segmentations for many words at once, in blocks of words of equal length.

    Sums are rescaled as they shrink, so a run of letters may be of any length, and only the last few positions are
    held in the forward pass.
    """

    def __init__(self, pieces: dict[str, int], probabilities: np.ndarray):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.table = np.vstack([probabilities, np.zeros((2, probabilities.shape[1]))])  # -1: no piece, -2: unknown letter
        self.table[-2] = UNKNOWN

    def blocks(self, words: list[str]):
        """(places in words, words with their ▁, their length)."""
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(len(word) + 1, []).append(k)
        for n, members in groups.items():
            most = max(1, BLOCK_LETTERS // n)
            for at in range(0, len(members), most):
                yield members[at : at + most], ["▁" + words[k] for k in members[at : at + most]], n

    def pieces_at(self, words: list[str], i: int, j: int) -> np.ndarray | None:
        """What letters i to j of each word are: a piece, -1 or -2; None if no word has a piece there."""
        missing = -2 if j == i + 1 else -1
        column = np.array([self.pieces.get(w[i:j], missing) for w in words], np.int64)
        return column if missing == -2 or (column != -1).any() else None

    def forward(self, words: list[str], n: int) -> np.ndarray:
        """Log of the sums over all segmentations: words x languages."""
        window = {0: np.ones((len(words), self.table.shape[1]))}  # sums up to the last few letters, over exp(scale)
        scale = np.zeros_like(window[0])
        for j in range(1, n + 1):
            now = np.zeros_like(scale)
            for i, sums in window.items():
                if (column := self.pieces_at(words, i, j)) is not None:
                    now += sums * self.table[column]
            window[j] = now
            window.pop(j - self.longest, None)
            if now.min() < LEAST_SUM:
                most = np.maximum.reduce(list(window.values()))
                scale += np.log(most)
                window = {i: sums / most for i, sums in window.items()}
        return np.log(window[n]) + scale

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Row k: log probability of words[k] in every language."""
        out = np.zeros((len(words), self.table.shape[1]))
        for members, block, n in self.blocks(words):
            out[members] = self.forward(block, n)
        return out

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected piece counts of counted words in one language (forward-backward)."""
        total, table = np.zeros(len(self.table)), self.table[:, language]
        for members, block, n in self.blocks(words):
            alpha, beta = np.zeros((n + 1, len(block))), np.zeros((n + 1, len(block)))
            shrunk, shrunk_back = np.zeros_like(alpha), np.zeros_like(beta)  # logs of what each row was divided by
            alpha[0] = beta[n] = 1
            for j in range(1, n + 1):
                for i in range(max(0, j - self.longest), j):
                    if (column := self.pieces_at(block, i, j)) is not None:
                        alpha[j] += alpha[i] * np.exp(shrunk[i] - shrunk[j - 1]) * table[column]
                shrunk[j] = shrunk[j - 1] + np.log(alpha[j])
                alpha[j] = 1
            weight = np.asarray(counts, float)[members]
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    if (column := self.pieces_at(block, i, j)) is not None:
                        way = table[column] * np.exp(shrunk_back[j] - shrunk_back[i + 1])
                        beta[i] += way
                        np.add.at(total, column, np.exp(shrunk[i] + shrunk_back[j] - shrunk[n]) * table[column] * weight)
                shrunk_back[i] = shrunk_back[i + 1] + np.log(beta[i])
        return total[:-2]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(text, lang) of a hash sample of about `most` rows at most, none of them held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    return rows.where(hash_share(F.col("id"), 11, most, rows.count())).select("text", "lang")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n)."""

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            if found:
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": pa.array(found.values(), pa.int64())})

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary_path: str, id_col="doc_id", text_col="text", lang_col="lang", rounds: int = 2, most: int = TRAIN_DOCS):
    """(languages, probabilities of pieces x languages); there are at most as many languages as documents to learn from."""
    prepare(docs.sparkSession)
    words = stored(word_counts(training_rows(docs, id_col, text_col, lang_col, most)), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    table = np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces)))
    for _ in range(rounds if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            lattice = Lattice(vocabulary(vocabulary_path), shared.value)
            for batch in batches:
                langs = np.array([languages.index(x) for x in batch["lang"].to_pylist()])
                words, counts = batch["word"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False).astype(float)
                for k in np.unique(langs):
                    at = np.flatnonzero(langs == k)
                    total = lattice.expected([words[i] for i in at], counts[at], k)
                    some = np.flatnonzero(total > 1e-6)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(some), k), pa.int32()), "piece": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.float64())})

        sums = words.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(table)
        counts[sums["piece"], sums["k"]] = sums["n"]
        base = (counts.sum(axis=1, keepdims=True) + 0.01) / (counts.sum() + 0.01 * len(counts))
        table = (counts + SMOOTHING * base) / (counts.sum(axis=0, keepdims=True) + SMOOTHING)
    return languages, table


def with_language(rows: DataFrame, vocabulary_path: str, model) -> DataFrame:
    """rows (row, text), where row has any type, with lang_pred and score in place of text."""
    languages, table = model
    shared = rows.sparkSession.sparkContext.broadcast(table)
    most = max(1000, MOST_SCORES // max(1, len(languages)))

    def predict(batches):
        lattice = Lattice(vocabulary(vocabulary_path), shared.value)
        none = np.zeros((0, len(languages)))
        known, scores, older, older_scores = {}, none, {}, none
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [words_of(t) if languages else [] for t in part["text"].to_pylist()]
                if len(known) > most:
                    known, scores, older, older_scores = {}, none, known, scores
                new = [w for w in set().union(*found) if w not in known]
                again, unseen = [w for w in new if w in older], [w for w in new if w not in older]
                scores = np.vstack([scores, older_scores[[older[w] for w in again]], lattice.log_likelihood(unseen)])
                known.update(zip(again + unseen, range(len(known), len(known) + len(new)), strict=True))
                names, best = [], []
                for words in found:
                    if not words:
                        names.append(NO_LANGUAGE)
                        best.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    k = int(total.argmax())
                    names.append(languages[k])
                    best.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(names, pa.string()), pa.array(best, pa.float64())], ["row", "lang_pred", "score"])

    prepare(rows.sparkSession)
    return rows.mapInArrow(predict, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def in_a_language(docs: DataFrame, vocabulary_path: str, least: float, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in one language with a score of `least` or more.

    Each row is judged by its own text where it lies, so rows with a null or repeated id are kept or go one by one.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_language(rows, vocabulary_path, fit(docs, vocabulary_path, id_col, text_col, lang_col))
    return found.where((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= least)).select("row.*")


def language_id(docs: DataFrame, vocabulary_path: str, id_col="doc_id", text_col="text", lang_col="lang", model=None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from text and non-null language of rows that aren't held out (about TRAIN_DOCS of them at most); the
    prediction sees the whole text only. score is the posterior of the language under a flat prior. Null texts, texts
    without a letter, and all texts when there is nothing to learn from give `und` with score 0. Equal posteriors go
    to the alphabetically first language. Very long texts and very long runs of letters are summed whole; 500 texts are
    held at a time. A null doc_id isn't held out. Repeated rows each get their row, an empty table gives none, and only
    the named columns are read.
    """
    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").alias("row"), "text")
    out = with_language(rows, vocabulary_path, model or fit(docs, vocabulary_path, id_col, text_col, lang_col))
    return out.select(F.col("row").alias("doc_id"), F.coalesce(held_out(F.col("row")), F.lit(False)).alias("held_out"), "lang_pred", "score")
