"""Language identification with piece unigrams, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary
(``piece_bpe_32k.model``) and one for a character outside it. The probability of
a word is the sum over all ways to cut it into pieces (forward algorithm), that
of a text the product over its words. Words are the runs of letters of the
lower-cased text with the marks that follow them, each with the vocabulary's
word-start sign; digits and number signs are no letters.

Learning: expectation-maximisation over the word counts of labelled rows, the
expected piece counts summed in Spark. The model (languages x pieces) is bounded
by the vocabulary and is what travels to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.llm.common import Scratch, lean
from netobs.llm.pieces import SPACE, Lattice, pieces_of, same_length

TRAINING_ROWS = 10_000  # about so many labelled rows the model is fitted on
LEAST_ROWS = 100  # of a language are kept, where it has so many, however many languages there are
ROUNDS = 3
LONGEST_LEARNED = 48  # letters; longer runs, as in scripts without word spaces, are learned in parts of it
SHORT = 20  # characters at the labelled rows' level that every text's evidence is mixed with, so that few words decide little
CACHED_WORDS = 400_000
CACHED_SCORES = 8 << 20  # words x languages that a scoring task keeps
SLICE = 1 << 22  # characters of texts that a task takes apart at once, one text at least
CELLS = 1 << 21  # forward sums held at once
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
TINY, LIFT = 1e-120, 1e150


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def learned_words(text: str | None) -> Iterator[str]:
    """The words of a text, long ones cut."""
    for word in words_of(text):
        for at in range(0, len(word), LONGEST_LEARNED):
            yield word[at : at + LONGEST_LEARNED]


def quotas(counts: dict[str, int], most_rows: int) -> dict[str, int]:
    """Rows to keep of each language that has more: equal shares of ``most_rows``, what small languages leave goes to the others."""
    out, left = {}, most_rows
    for i, (language, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota = max(left // (len(counts) - i), LEAST_ROWS)
        left = max(left - min(n, quota), 0)
        if n > quota:
            out[language] = quota
    return out


def edges(lattice: Lattice, unknown: int, end: int):
    """Matches ending at ``end``; a character no piece covers is an edge of its own."""
    covered = np.zeros(lattice.n, bool)
    for size, rows, at in lattice.ending(end):
        if size == 1:
            covered[rows] = True
        yield size, rows, at
    rest = np.flatnonzero(~covered)
    if len(rest):
        yield 1, rest, np.full(len(rest), unknown)


def forward(lattice: Lattice, prob: np.ndarray, kept: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums (position, word, language) and the log10 of each word's scale.

    With ``kept`` only so many positions are held, the last ones in the end;
    position ``p`` is at ``p % kept``. No piece reaches back further than the longest.
    """
    kept = kept or lattice.length + 1
    alpha = np.zeros((kept, lattice.n, prob.shape[1]))
    alpha[0] = 1
    scale = np.zeros(lattice.n)
    unknown = len(prob) - 1
    for end in range(1, lattice.length + 1):
        here = alpha[end % kept]
        here[:] = 0
        for size, rows, at in edges(lattice, unknown, end):
            here[rows] += alpha[(end - size) % kept, rows] * prob[at]
        low = np.flatnonzero(here.max(axis=1) < TINY)
        if len(low):
            first = max(0, end - lattice.pieces.longest)
            for p in range(first, end + 1):
                alpha[p % kept, low] *= LIFT
            scale[low] -= 150
    return alpha, scale


def log_likelihoods(words: list[str], prob: np.ndarray, path: str) -> np.ndarray:
    """log10 P(word | language), one row per word."""
    out = np.empty((len(words), prob.shape[1]))
    pieces = pieces_of(path)
    for length, at, group in same_length([SPACE + w for w in words], max(1, CELLS // prob.shape[1])):
        kept = min(length, pieces.longest) + 1
        alpha, scale = forward(Lattice(pieces, group, length), prob, kept)
        with np.errstate(divide="ignore"):
            out[at] = np.maximum(np.log10(alpha[length % kept]), -300) + scale[:, None]
    return out


def expected_counts(words: list[str], counts: np.ndarray, prob: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece in each language's words (one E-step)."""
    pieces, unknown = pieces_of(path), len(prob) - 1
    used, uses = [], []
    for length, at, group in same_length([SPACE + w for w in words], 1 << 18):
        lattice = Lattice(pieces, group, length)
        alpha, _ = forward(lattice, prob)  # words are short: nothing is rescaled
        beta = np.zeros_like(alpha)
        with np.errstate(divide="ignore", invalid="ignore"):
            beta[length] = np.nan_to_num(counts[at] / alpha[length], posinf=0.0)
        for end in range(length, 0, -1):
            for size, rows, piece in edges(lattice, unknown, end):
                use = prob[piece] * beta[end, rows]
                beta[end - size, rows] += use
                used.append(piece)
                uses.append(use * alpha[end - size, rows])
    if not used:
        return np.zeros_like(prob)
    piece, use = np.concatenate(used), np.concatenate(uses)
    return np.stack([np.bincount(piece, use[:, k], minlength=len(prob)) for k in range(prob.shape[1])], axis=1)


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of the rows; each task counts before anything is shuffled."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(seen):
            return pd.DataFrame([(k[0], k[1], n) for k, n in seen.items()], columns=["lang", "word", "n"])

        seen: Counter = Counter()
        for frame in frames:
            for language, body in zip(frame["lang"], frame["text"], strict=True):
                seen.update((language, w) for w in learned_words(body))
                if len(seen) > CACHED_WORDS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    slim = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = slim.mapInPandas(lean(count), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Learned languages and P(piece | language), last row for unknown characters.

    ``level`` is the mean log10 probability of a character of each language's
    labelled words, their word-start signs counted; None where it was not asked for.
    """

    def __init__(self, langs: list[str], prob: np.ndarray, path: str, level: np.ndarray | None = None):
        self.langs, self.prob, self.path, self.level = langs, prob, path, level


def learn(
    labelled: DataFrame, path: str, text: str = "text", lang: str = "lang",
    key: str = "doc_id", most_rows: int = TRAINING_ROWS, rounds: int = ROUNDS,
    levels: bool = False,
) -> LanguageModel:
    """Fit on rows with a language; beyond ``most_rows`` a sample of about that size by the key's and text's hash, equal shares of all languages."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row per language
    kept = quotas(rows, most_rows) if sum(rows.values()) > most_rows else {}
    if kept:
        share = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text), F.lit(9)), F.lit(1 << 20))
        bounds = F.create_map(*[F.lit(x) for k, q in kept.items() for x in (k, math.ceil((1 << 20) * q / rows[k]))])
        labelled = labelled.where(share < F.coalesce(F.element_at(bounds, F.col(lang)), F.lit(1 << 20)))
    scratch = Scratch(labelled.sparkSession, "langid")
    counts = scratch.save(word_counts(labelled, text, lang), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row per language
    size = pieces_of(path)
    prob = np.full((len(size.keys) + 1, max(1, len(langs))), 1.0 / (len(size.keys) + 1))
    by_word = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    for _ in range(rounds if langs else 0):
        now = prob

        def e_step(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(now)
            for frame in frames:
                if len(frame):
                    n = np.array([[dict(m).get(x, 0) for x in langs] for m in frame["n"]], float)
                    total += expected_counts(list(frame["word"]), n, now, path)
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "k": k, "n": total[piece, k]})

        sums = by_word.mapInPandas(lean(e_step), "piece long, k long, n double")
        rows = sums.groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
        total = np.full_like(prob, 0.01)  # add-0.01: nothing has probability 0
        total[rows["piece"], rows["k"]] += rows["n"]
        prob = total / total.sum(axis=0)
    if langs:
        prob[-1] = 1e-7  # an unknown character favours no language
    level = level_of(by_word, langs, prob, path) if langs and levels else None
    scratch.drop("words")
    return LanguageModel(langs, prob, path, level)


def level_of(by_word: DataFrame, langs: list[str], prob: np.ndarray, path: str) -> np.ndarray:
    """Mean log10 probability of a character of each language's words, under that language."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, size = np.zeros(len(langs)), np.zeros(len(langs))
        for frame in frames:
            if len(frame):
                n = np.array([[dict(m).get(x, 0) for x in langs] for m in frame["n"]], float)
                total += (n * log_likelihoods(list(frame["word"]), prob, path)).sum(axis=0)
                size += n.T @ (frame["word"].str.len().to_numpy() + 1.0)
        yield pd.DataFrame({"k": np.arange(len(langs)), "total": total, "size": size})

    parts = by_word.mapInPandas(lean(sums), "k long, total double, size double")
    found = parts.groupBy("k").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).orderBy("k").toPandas()
    # A language whose labelled texts have no letter is never learned, so every size is positive.
    return (found["total"] / found["size"]).to_numpy()


def slices(texts: pd.Series) -> Iterator[list[str | None]]:
    """Runs of texts of about ``SLICE`` characters."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= SLICE:
            yield part
            part, held = [], 0
    if part:
        yield part


class Scorer:
    """Predictions for lists of texts; the scores of recent words are kept (bounded), so a word that returns costs a lookup."""

    def __init__(self, langs: list[str], prob: np.ndarray, path: str, level: np.ndarray | None):
        self.langs, self.prob, self.path, self.level = langs, prob, path, level
        self.most = min(CACHED_WORDS, CACHED_SCORES // max(1, len(langs)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.sizes = np.empty((0, self.prob.shape[1])), np.empty(0, np.int64)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The words of each text as numbers of known words; new words are scored."""
        if len(self.known) > self.most:
            self.forget()
        known, new, out = self.known, [], []
        for text in texts:
            words = words_of(text) if self.langs else []
            for word in dict.fromkeys(words):
                if word not in known:
                    known[word] = len(known)
                    new.append(word)
            out.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        if new:
            self.scores = np.concatenate([self.scores, log_likelihoods(new, self.prob, self.path)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
        return out

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        pred, post, surprise = [], [], []
        for ws in self.numbers(texts):
            if not len(ws):
                pred.append("und")
                post.append(0.0)
                surprise.append(None)
                continue
            total = self.scores[ws].sum(axis=0)
            best = int(total.argmax())
            pred.append(self.langs[best])
            post.append(float(1 / np.power(10.0, np.maximum(total - total[best], -300)).sum()))
            size = int(self.sizes[ws].sum()) + len(ws)
            surprise.append(None if self.level is None else (total[best] / self.level[best] + SHORT) / (size + SHORT))
        return pd.DataFrame({"lang_pred": pred, "score": post, "surprise": pd.array(surprise, "Float64")})


def language(model: LanguageModel, text: Column) -> Column:
    """Struct (lang_pred, score, surprise) of a text; score is the posterior of the language under equal priors.

    ``surprise`` is the mean log probability of a character against its level on
    the language's labelled words: about 1 for texts like those, more for other
    languages and junk; null where the model has no levels.
    ``und`` with score 0 where the text is null or has no letter, and everywhere
    when no language was learned. Ties go to the language first by name. A task
    takes texts apart in slices, so its memory does not grow with the batch.
    """
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast((model.langs, model.prob, model.path, model.level))  # vocabulary x languages

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for texts in columns:
            yield pd.concat([scorer.score(part) for part in slices(texts)] or [scorer.score([])], ignore_index=True)

    return F.pandas_udf(lean(run), "lang_pred string, score double, surprise double").asNondeterministic()(text)  # evaluated once, not once per field


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    return docs.select(key, language(model, F.col(text)).alias("l")).select(key, "l.lang_pred", "l.score")
