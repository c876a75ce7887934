"""Toxicity by a factorization machine over hashed terms.

A term is a word or a word's beginning of 3 to 7 letters, together with how often it stands in the text (1, 2, 3, 4 or more: a
term of its own each), plus the text's length class.  Terms are hashed to 2^20 numbers.  Those whose document counts differ most between
the labels (a two-proportion z value) are kept; over them a factorization machine learns weights and pair weights, so two
terms together can say more than their sum.

Terms, counts and weights come from every labelled row outside the held-out part; scoring reads every document once and whole.

Defined cases: a null or empty text has its length class only and gets a score like any other; rows without a label, or with a null
id, are not fitted on; repeated label rows count again; no rows to fit on, or one class only, gives that class's share as every score;
extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.texts import SLICE, add_columns, words
from rankspark.session import passing, pin

TERMS = 2048
HASH_BITS = 20
FACTORS = 8
BEGINNINGS = range(3, 8)
MOST_COUNT = 4
#: Characters of texts whose terms are found together; a longer text is taken alone.
CHARS = 1 << 20


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels are never learned from."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of runs of at most ``CHARS`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHARS and i > at:
            yield at, texts[at:i]
            at, size = i, len(t or "")
    if at < len(texts):
        yield at, texts[at:]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def _pieces(h: np.ndarray) -> np.ndarray:
    """Numbers of a term that stands in a text once, twice, three times, four times or more: pieces of its hash."""
    return (h[..., None] >> np.array([0, 15, 29, 44], np.uint64) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def start_hashes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word's starts (the word itself, then its beginnings) as rows, and which of them it has."""
    letters = np.array(found, f"<U{BEGINNINGS[-1]}").view(np.uint32).reshape(len(found), -1).astype(np.uint64)
    h, out = np.zeros(len(found), np.uint64), [np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))]
    for n in range(1, BEGINNINGS[-1] + 1):
        h = _mixed(h * _FACTOR + letters[:, n - 1] + np.uint64(n))
        if n in BEGINNINGS:
            out.append(h)
    length = np.fromiter(map(len, found), np.int64, len(found))
    return np.stack(out, 1), length[:, None] >= np.array([0, *BEGINNINGS])


class Terms:
    """Hashed terms of texts; with ``kept``, only those among these numbers, by their place in it.

    The words of many texts are numbered, their starts hashed together, and starts counted per text by sorting.
    """

    def __init__(self, kept: list[int] | None = None):
        self.place = np.arange(1 << HASH_BITS)
        if kept is not None:
            self.place = np.full(1 << HASH_BITS, -1)
            self.place[np.array(kept, np.int64)] = np.arange(len(kept))

    def of_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text's place in the list, number) of every term, each once, sorted."""
        number: dict[bytes, int] = {}
        parts = []
        for t in texts:
            own = words(t)
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        length = np.array([int(n).bit_length() for n in sizes], np.uint64)
        length = self.place[_pieces(_mixed(length + np.uint64(1)))[:, 0]]
        docs, terms = [np.flatnonzero(length >= 0)], [length[length >= 0]]
        if number:
            hashes, has = start_hashes([w.decode("utf-8", "ignore") for w in number])
            numbers = self.place[_pieces(hashes)]
            has &= (numbers >= 0).any(axis=2)
            code, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(number) + np.concatenate(parts), return_counts=True)
            row, column = np.nonzero(has[code % len(number)])
            kind, place = np.unique(hashes[has], return_inverse=True)
            at = np.full(has.shape, -1)
            at[has] = place
            own = numbers[has][np.unique(place, return_index=True)[1]]  # of each start, in the order of ``kind``
            word = (code % len(number))[row]
            pair, inverse = np.unique((code // len(number))[row] * len(kind) + at[word, column], return_inverse=True)
            count = np.bincount(inverse, n[row], len(pair))
            own = own[pair % len(kind)] if len(kind) else np.empty((0, MOST_COUNT), np.int64)
            hit = (own >= 0) & (np.arange(1, MOST_COUNT + 1) <= count[:, None])
            docs.append(np.repeat(pair // max(1, len(kind)), MOST_COUNT)[hit.ravel()])
            terms.append(own[hit])
        wide = 1 << HASH_BITS
        code = np.unique(np.concatenate(docs) * wide + np.concatenate(terms))
        return code // wide, code % wide

    def of(self, text: str | None) -> list[int]:
        return self.of_many([text])[1].tolist()


@dataclass
class Model:
    kept: list[int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self) -> Callable[[list[str | None]], tuple[list[float]]]:
        terms, w, v = Terms(self.kept), self.weights, self.factors

        def score(texts: list[str | None]) -> tuple[list[float]]:
            return ([x for _, part in portions(texts) for x in scores(part)],)

        def scores(texts: list[str | None]) -> list[float]:
            doc, at = terms.of_many(texts)
            n = len(texts)
            sums = np.zeros((n, v.shape[1] if v.ndim == 2 else 0))
            if len(at):
                begin = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[doc[begin]] = np.add.reduceat(v[at], begin, axis=0)
            squares = np.bincount(doc, np.square(v).sum(axis=1)[at], n)
            x = self.bias + np.bincount(doc, w[at], n) + 0.5 * (np.square(sums).sum(axis=1) - squares)
            return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()
        return score


def known_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(id, label) of every label outside the held-out part."""
    return labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id"))


def learnable(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) of every document outside the held-out part."""
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(~held_out("id"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of every labelled row outside the held-out part.

    Both sides are shuffled at any size, so labels are never sent whole to every task.
    """
    return learnable(docs, doc_id, text).join(known_labels(labels, label, doc_id).hint("merge"), "id").select("id", "text", "label")


def _informative(sample: DataFrame, most: int) -> tuple[list[int], int, int]:
    """Numbers of the ``most`` terms by z value, and the rows of either label."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        terms, each = Terms(), np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                rows = batch.slice(start, SLICE)
                label = rows.column("label").to_numpy()
                for at, part in portions(rows.column("text").to_pylist()):
                    doc, found = terms.of_many(part)
                    np.add.at(each, (label[at + doc], found), 1)
        seen = np.flatnonzero(each.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(each[0][seen]), pa.array(each[1][seen])], ["term", "negative", "positive"])
    n0, n1 = (sample.groupBy().pivot("label", [0, 1]).count().na.fill(0).first() or (0, 0))
    if not n0 or not n1:
        return [], n0 or 0, n1 or 0
    p, q = F.col("positive") / n1, F.col("negative") / n0
    share = (F.col("positive") + F.col("negative")) / (n0 + n1)
    z = F.abs(p - q) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    sums = sample.mapInArrow(count, "term long, negative long, positive long").groupBy("term").agg(
        F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    best = sums.where("negative + positive >= 3").select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(most)
    return sorted(r["term"] for r in best.collect()), n0, n1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
        terms: int = TERMS, seed: int = 7) -> Model:
    with passing():  # a model is numbers on the driver: nothing reads the tables it was fitted on later
        return _fitted(docs, labels, label, doc_id, text, terms, seed)


def _fitted(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, terms: int, seed: int) -> Model:
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import CountVectorizerModel

    sample = pin(labelled_rows(docs, labels, label, doc_id, text), "labelled")
    kept, n0, n1 = _informative(sample, terms)
    if not kept:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model([], float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))

    def make():
        own, names = Terms(kept), np.array([str(h) for h in kept], object)

        def found(texts: list[str | None]) -> tuple[list[list[str]]]:
            out = []
            for _, part in portions(texts):
                doc, at = own.of_many(part)
                out += [x.tolist() for x in np.split(names[at], np.searchsorted(doc, np.arange(1, len(part))))]
            return (out,)
        return found
    rows = pin(add_columns(sample.select("label", "text"), {"terms": "array<string>"}, ["text"], make).select("label", "terms"), "terms")
    vectors = CountVectorizerModel.from_vocabulary([str(h) for h in kept], "terms", "features").setBinary(True).transform(rows)
    machine = FMClassifier(factorSize=FACTORS, maxIter=150, stepSize=0.05, regParam=1e-4, initStd=0.02, seed=seed).fit(vectors)
    return Model(kept, float(machine.intercept), machine.linear.toArray(), machine.factors.toArray())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    return add_columns(docs, {name: "double"}, [text], model.scorer)
