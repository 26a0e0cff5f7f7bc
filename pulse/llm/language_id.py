"""Language identification by unigram pieces, summed over all segmentations.

A model holds, per language, the probability of every piece of a fixed public vocabulary. The score of a
word is the sum over all ways to cut it into pieces of the product of their probabilities (the forward
algorithm); a text's score is the sum of its words' logarithms. Words are runs of letters, lower-cased,
with the vocabulary's word mark in front. Letters outside the vocabulary have a floor probability.

Null texts and texts without letters get ``und`` and score 0. With no labelled rows every text gets
``und``. Ties go to the language that sorts first. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, LONGEST, FLOOR, PRIOR = "▁", 12, 1e-9, 0.1
#: About this many labelled documents are used to fit, chosen by a hash of the id.
FIT_DOCS = 4_000
REMEMBERED = 200_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces_of(path: str) -> list[str]:
    """Pieces of the vocabulary that hold letters, sorted."""
    model = _processor(path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p.lower() for p in names if len(p) <= LONGEST and LETTERS.fullmatch(p.lstrip(MARK))})


def words_of(text: str | None) -> list[str]:
    return [MARK + w for w in LETTERS.findall((text or "").lower())]


def fit(docs: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS) -> tuple[list[str], dict[str, list[float]]]:
    """Languages and the log probabilities of every seen piece, from rows (doc_id, text, lang).

    Words are counted per language in Spark, cut by the vocabulary's own encoder, and added up per piece;
    what comes back is at most languages x vocabulary numbers.
    """
    name = path or public_tokenizers.path("piece_bpe_32k.model")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    share = min(1.0, fit_docs / max(total, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], names=["lang", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _processor(name).encode
        for batch in batches:
            lang, word, n = (batch.column(i).to_pylist() for i in range(3))
            rows = [(a, p.lower(), c) for a, w, c in zip(lang, word, n) for p in encode(w[1:], out_type=str)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["lang", "piece", "n"])

    counted = chosen.mapInArrow(words, "lang string, word string").groupBy("lang", "word").count()
    rows = counted.mapInArrow(cut, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    known = {p: i for i, p in enumerate(pieces_of(name))}
    seen = [r for r in rows.collect() if r.piece in known]
    langs = sorted({r.lang for r in seen})
    table = np.full((len(known), len(langs)), PRIOR)
    for r in seen:
        table[known[r.piece], langs.index(r.lang)] += r.n
    table /= table.sum(axis=0, keepdims=True)
    return langs, table


class Scorer:
    """Forward scores of words under every language at once."""

    def __init__(self, path: str, table: np.ndarray):
        self.table = np.vstack([table, np.zeros((1, table.shape[1]))])
        self.index = {p: i for i, p in enumerate(pieces_of(path))}
        self.codes = np.array([self._code(p) for p in self.index], np.uint64)
        self.order = np.argsort(self.codes)
        self.sorted = self.codes[self.order]
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _code(piece: str) -> int:
        code = 0
        for c in piece:
            code = (code * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return code

    def _group(self, words: list[str], width: int) -> np.ndarray:
        """Log probabilities of words of one length."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), width).astype(np.uint64) + np.uint64(1)
        factor, langs = np.uint64(0x9E3779B97F4A7C15), self.table.shape[1]
        alpha = [np.ones((len(words), langs))]
        scale = np.zeros((len(words), langs))
        codes: list[np.ndarray] = []  # codes[i]: of the piece that starts at i and ends here
        for end in range(1, width + 1):
            codes = [c * factor + chars[:, end - 1] for c in codes[-(LONGEST - 1) :]] + [chars[:, end - 1]]
            total = alpha[-1] * FLOOR
            for back, code in enumerate(reversed(codes), 1):
                at = np.minimum(np.searchsorted(self.sorted, code), len(self.sorted) - 1)
                row = np.where(self.sorted[at] == code, self.order[at], len(self.sorted))
                total = total + alpha[-back] * self.table[row]
            alpha = [*alpha[-(LONGEST - 1) :], total]
            if end % 8 == 0:  # keep the numbers in range on long words
                top = total.copy()
                alpha = [a / top for a in alpha]
                scale += np.log(top)
        return scale + np.log(alpha[-1])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(words)
        by_width: dict[int, list[str]] = {}
        for w in new:
            by_width.setdefault(len(w), []).append(w)
        for width, group in by_width.items():
            step = max(1, 200_000 // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.known.update(zip(part, self._group(part, width)))

    def score(self, words: list[str]) -> np.ndarray:
        get = self.known.__getitem__
        return np.sum([get(w) for w in words], axis=0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (share of the best language, per word) for every text.

    ``keep`` names more columns of the input to carry along; they take no part in the prediction.
    """
    name = path or public_tokenizers.path("piece_bpe_32k.model")
    langs, table = model
    columns = ["doc_id", "text", *(c for c in keep or [] if c not in ("doc_id", "text"))]
    rows = docs.select(*columns)
    out = ["doc_id"] if keep is None else columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*out).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(name, table) if langs else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [words_of(t) if langs else [] for t in part.column(1).to_pylist()]
                if langs:
                    scorer.learn(set().union(*texts))
                best, share = [], []
                for words in texts:
                    if not words:
                        best.append("und"), share.append(0.0)
                        continue
                    mean = scorer.score(words) / len(words)
                    odds = np.exp(mean - mean.max())
                    best.append(langs[int(np.argmax(mean))]), share.append(float(odds.max() / odds.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in out), pa.array(best, pa.string()), pa.array(share, pa.float64())],
                    names=[*out, "lang_pred", "score"],
                )

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
