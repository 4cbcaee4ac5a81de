"""Language identification with bit-sliced Bloom filters of character n-grams.

One table holds the filters of all languages: a row has one bit for each language, and the AND of an
n-gram's rows is the set of languages that contain it. A text's n-grams are counted for each language
by its bit, the counts are corrected for the language's false positives, and the largest decides.

Model: n-grams of 3 and 4 letters (with the word's edges) from about ``per_language`` labelled texts of each
language, drawn by the hash of their id. An n-gram belongs to a language if it is in enough of its
texts and not much rarer there than in another language, so wrong labels don't fill the filters. The
broadcast table has a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import fresh, mix, tidied

#: Training texts of a language, rows of the table, rows an n-gram sets, least share of a language's
#: texts, and least share relative to the language that has the n-gram most.
PER_LANGUAGE, ROWS, PROBES, LEAST, RELATIVE = 2000, 1 << 20, 3, 0.004, 0.2
UNKNOWN = "und"
#: Languages whose rates are broadcast; with more they are joined.
FEW = 10_000
BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes, the text of each, and which texts have a letter."""
    texts = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    lead = np.where(letter, points, 0).astype(np.uint64)
    lead = np.r_[np.uint64(0), lead]
    word = np.r_[False, letter]
    two = lead[:-1] * np.uint64(0x9E3779B97F4A7C15) + lead[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three, four = two[:-1] + lead[2:] * np.uint64(0x165667B19E3779F9), two[:-2] + two[2:] * np.uint64(0x27D4EB2F165667C5)
    at3, at4 = np.flatnonzero(word[1:-1]), np.flatnonzero(word[1:-2] & word[2:-1])
    hashes = np.concatenate([mix(three[at3]), mix(four[at4] ^ np.uint64(0x5851F42D4C957F2D))])
    which = np.searchsorted(ends, np.concatenate([at3, at4]), "right")
    has = np.bincount(which, minlength=len(texts)) > 0
    return hashes, which, has


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    """Runs of whole texts of about BLOCK characters; null is empty."""
    held, size = [], 0
    for text in column.to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(hashes: np.ndarray, rows: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(rows)).astype(np.int64) for k in range(PROBES)]


class BitSlicedFilter:
    """The filters of all languages, 64 languages to a word of a row."""

    def __init__(self, languages: list[str], rows: int = ROWS) -> None:
        self.languages, self.rows = languages, rows
        self.table = np.zeros((rows, -(-len(languages) // 64) or 1), np.uint64)

    def add(self, hashes: np.ndarray, language: int) -> None:
        for at in _rows(hashes, self.rows):
            self.table[at, language // 64] |= np.uint64(1 << language % 64)

    def close(self) -> BitSlicedFilter:
        self.wrong = np.array([(((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES for i in range(len(self.languages))])
        return self

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the corrected share of its n-grams in each language; which texts have a letter."""
        hashes, which, has = _grams(texts)
        mask = self.table[(rows := _rows(hashes, self.rows))[0]]
        for at in rows[1:]:
            mask &= self.table[at]
        n = np.bincount(which, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(which, weights=bit.astype(float), minlength=len(texts))
            out[:, i] = np.clip((hits - n * self.wrong[i]) / (1 - self.wrong[i]) / np.maximum(n, 1), 0, 1)
        return out, has


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, held = np.array(batch["lang"].to_pylist(), object), 0
        for texts in _blocks(batch["text"]):
            own = langs[held : held + len(texts)]
            held += len(texts)
            hashes, which, _ = _grams(texts)
            order = np.lexsort((hashes, which))
            hashes, which = hashes[order], which[order]
            once = np.r_[True, (hashes[1:] != hashes[:-1]) | (which[1:] != which[:-1])] if len(hashes) else np.zeros(0, bool)
            hashes, which = hashes[once], which[once]
            for lang in sorted(set(own)):
                gram, n = np.unique(hashes[own[which] == lang], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram.view(np.int64), "n": n.astype(np.int64)})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, rows: int = ROWS) -> BitSlicedFilter:
    """Learn from rows with a text and a language; about ``per_language`` of each language are read."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}  # one row a language
    rates = labelled.sparkSession.createDataFrame([(k, per_language / n) for k, n in totals.items()], "lang string, rate double")
    rates = F.broadcast(rates) if len(totals) <= FEW else rates
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("string")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).join(rates, "lang").filter("draw < rate")
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    used = {lang: min(n, per_language) for lang, n in totals.items()}
    # rounding is left to the exact test of the share below
    least = labelled.sparkSession.createDataFrame([(k, LEAST * n - 0.5) for k, n in used.items()], "lang string, least double")
    least = F.broadcast(least) if len(used) <= FEW else least
    table = counts.join(least, "lang").filter("n >= least").drop("least").toArrow()
    languages = sorted(used)
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    gram, share = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy() / np.array([used[x] for x in languages])[lang] if len(languages) else np.zeros(0)
    _, inverse = np.unique(gram, return_inverse=True)
    most = np.zeros(len(gram) and inverse.max() + 1)
    np.maximum.at(most, inverse, share)
    keep = (share >= LEAST) & (share >= RELATIVE * most[inverse]) if len(gram) else np.zeros(0, bool)
    out = BitSlicedFilter(languages, rows)
    for i in range(len(languages)):
        out.add(gram[keep & (lang == i)], i)
    return out.close()


def predict(docs: DataFrame, model: BitSlicedFilter, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its corrected share of n-grams (0 to 1).

    Null texts, texts without a letter, and all texts under a model without languages give ``und`` and 0.
    Equal shares go to the first language by name. Texts are read whole. Rows are judged alone; an empty
    table gives an empty result. All other columns pass through unread.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            names, best = [], []
            for texts in _blocks(batch[text_col]):
                shares, has = own.scores(texts)
                top = shares.argmax(axis=1) if own.languages else np.zeros(len(texts), int)
                ok = has & bool(own.languages)
                names += [own.languages[t] if o else UNKNOWN for t, o in zip(top.tolist(), ok.tolist())]
                best += [float(shares[i, t]) if o else 0.0 for i, (t, o) in enumerate(zip(top.tolist(), ok.tolist()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], [*batch.schema.names, pred, score])

    schema = StructType(list(docs.schema.fields)).add(pred, "string").add(score, "double")
    return docs.mapInArrow(judge, schema)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn outside the held-out third and predict every document: id, held_out, lang_pred, score."""
    held_out = F.coalesce(fold(id_col) == 1, F.lit(False))
    model = fit(docs.filter(~held_out), id_col, text_col, lang_col)
    return predict(docs.select(F.col(id_col), F.col(text_col).alias("text")), model).select(id_col, held_out.alias("held_out"), "lang_pred", "score")


#: A text with fewer of its n-grams than this in any language is no text of a known language.
REJECT = 0.25


def keep_known(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the rows of a recognised language; learns from all labelled rows of ``docs``."""
    model = fit(docs, text_col=text_col)
    pred, share = fresh(docs, "language", "share")
    return predict(docs, model, text_col, pred, share).filter((F.col(pred) != UNKNOWN) & (F.col(share) >= REJECT)).drop(pred, share)
