"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents learnt from, about, for each language; they are chosen by hash.
SAMPLE_PER_LANGUAGE = 800
#: Hashed features: half for three neighbouring bytes, half for four.
FEATURES = 1 << 14
#: Partitions of the sample, and SVMs fitted at once.
SAMPLE_PARTITIONS, AT_ONCE = 4, 3
#: Bytes of a text hashed at once.
BLOCK = 1 << 20
#: Languages learnt at most, the most frequent ones: their SVMs grow with the square of their number.
MOST_LANGUAGES = 200
UNDETERMINED = "und"
#: Families by language; a language that isn't here is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"), "slavic"),
}
#: Frequencies are this many times larger for the classifiers, whose penalty suits numbers about one.
SCALE = 100.0
_LETTER = regex.compile(r"\p{L}")
#: ASCII that isn't a letter becomes a blank; other bytes stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _features(text: str) -> Iterator[np.ndarray]:
    """Hashed feature numbers of a whole text, block by block; byte groups that hold no letter are left out."""
    data = text.lower().encode().translate(_PLAIN)
    data = b" " + b" ".join(data.split()) + b" "
    for start in range(0, len(data), BLOCK):
        b = np.frombuffer(data, np.uint8)[start:start + BLOCK + 3].astype(np.uint32)
        if len(b) < 3:
            return
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        four = three[:-1] | b[3:] << 24
        half = FEATURES // 2
        yield np.concatenate([(three[:BLOCK] * np.uint32(2654435761) >> np.uint32(19)) % half,
                              (four[:BLOCK] * np.uint32(2246822519) >> np.uint32(19)) % half + half]).astype(np.int64)


def has_letters(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """One linear SVM for each pair of families and for each pair of languages of one family."""

    families: tuple[str, ...]
    members: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Margin of every SVM on the whole text; above 0 speaks for the first of its pair."""
        total, count = np.zeros(len(self.pairs)), 0
        for found in _features(text):
            total += self.weights[:, found].sum(axis=1)
            count += len(found)
        return total * (SCALE / max(1, count)) + self.intercepts

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1; undetermined with score 0 if the text has no letter or nothing was learnt."""
        if not self.families or not has_letters(text):
            return UNDETERMINED, 0.0
        margin = dict(zip(self.pairs, self.margins(text).tolist()))
        family, sure = _vote(self.families, margin)
        language, surer = _vote(self.members[family], margin)
        return language, sure * surer


def _vote(names: tuple[str, ...], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
    """Winner of the pairwise votes (ties: the larger sum of chances, then the name) and its mean chance."""
    chance = {(a, b): 1 / (1 + np.exp(-np.clip(2 * m, -50, 50))) for (a, b), m in margin.items()}
    chance |= {(b, a): 1 - p for (a, b), p in chance.items()}
    if len(names) == 1:
        return names[0], 1.0
    scores = {a: [chance[a, b] for b in names if b != a] for a in names}
    best = min(names, key=lambda a: (-sum(p > 0.5 for p in scores[a]), -sum(scores[a]), a))
    return best, float(np.mean(scores[best]))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_language: int = SAMPLE_PER_LANGUAGE, families: dict[str, str] = FAMILIES, seed: int = 11) -> Model:
    """Learn from about ``per_language`` rows of each language, chosen by a hash of their id; MLlib fits the SVMs.

    Rows without a language, and texts without letters, teach nothing.  No rows give a model that determines nothing.
    Of more than ``MOST_LANGUAGES`` names in ``lang_col`` those that most rows have are learnt, ties by name.
    """
    # Imported here, as the workers that predict don't need MLlib.
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(seed)).alias("draw"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    # A row is drawn if its hash lies under the language's share.
    shares = counts.select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1_000_003)) < F.col("share") * 1_000_003).select("lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letters(text):
                    total = sum(np.bincount(f, minlength=FEATURES) for f in _features(text))
                    at = np.nonzero(total)[0]
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "at": at.tolist(), "value": (total[at] * SCALE / total.sum()).tolist()}])

    vector = F.udf(lambda at, value: SparseVector(FEATURES, at, value), VectorUDT())
    sample = (drawn.mapInArrow(featurise, "lang string, at array<long>, value array<double>")
              .select("lang", vector("at", "value").alias("features")).repartition(SAMPLE_PARTITIONS).persist())

    def learn(pair: tuple[list[str], list[str]]) -> tuple[np.ndarray, float]:
        one, two = pair
        found = sample.where(F.col("lang").isin(one + two)).select(
            F.col("lang").isin(one).cast("double").alias("label"), "features")
        svm = LinearSVC(maxIter=15, regParam=1e-4, standardization=False, tol=1e-3).fit(found)
        return svm.coefficients.toArray(), svm.intercept

    members: dict[str, list[str]] = {}
    for name in sorted(r.lang for r in sample.select("lang").distinct().collect()):
        members.setdefault(families.get(name, f"own:{name}"), []).append(name)
    groups = tuple(sorted(members))
    pairs = [(a, b) for a, b in combinations(groups, 2)]
    sides = [(members[a], members[b]) for a, b in pairs]
    for group in groups:
        pairs += combinations(members[group], 2)
        sides += [([a], [b]) for a, b in combinations(members[group], 2)]
    with ThreadPool(AT_ONCE) as pool:  # a fit is many short jobs, several fits fill the gaps
        fitted = pool.map(learn, sides)
    sample.unpersist()
    return Model(groups, {g: tuple(m) for g, m in members.items()}, tuple(pairs),
                 np.array([w for w, _ in fitted]).reshape(-1, FEATURES), np.array([i for _, i in fitted]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) per row, from the whole text alone.

    A null, empty or letterless text is ``und`` with score 0.  Repeated rows and null ids stay; an empty table gives none.
    The model travels as a broadcast of one weight for each feature and pair of names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = text_col not in keep  # a text that is kept anyway is sent once
    rows = docs.select(*keep, *([F.col(text_col).cast("string").alias("__text")] if own else []))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:len(keep)])
    at = len(keep) if own else keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kept}lang_pred string, score double")
