"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

Each class has a normal density with its own mean and a covariance shrunk towards the diagonal of the pooled one. Their moments are
sums over all labelled rows, added up in the tasks, so the driver sees a few hundred numbers. A text's score is the
logistic of its log-density difference, each density from a Mahalanobis distance by the inverse Cholesky factor, which is computed
once and broadcast with the means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import maybe, scratch, slices, small_batches

#: Statistics by name, in order.
NAMES = ("words", "bytes a word", "distinct words", "repeats of the word before", "upper case", "digits", "stops", "symbols", "bars", "shouts", "lines", "words without letters", "long words", "other bytes", "commonest word")
SHRINKAGE, RIDGE, SPREAD, KEEP = 0.1, 1e-3, 1.0, 0.3
#: Words of a usual text that each text is taken to have besides its own.
PRIOR = 20.0

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "symbol": b"#$%&*{}<>=@\\^~+/_", "bar": b"|", "shout": b"!", "line": b"\n", "space": b" \t\r\x0b\x0c"}


def features(data: bytes, ends: list[int]):
    """A row of statistics for each of the texts that lie one after the other in data; all defined for empty texts."""
    import numpy as np

    from lodestone.llm import shingles

    ends = np.asarray(ends, dtype=np.int64)
    size = np.diff(ends).astype(float)
    b = np.frombuffer(data, dtype=np.uint8)
    count = {}
    kinds = np.zeros(256, dtype=np.uint8)
    for k, chars in enumerate(_CLASSES.values(), 1):
        kinds[list(chars)] = k
    width = len(_CLASSES) + 1
    n = len(size)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    table = np.bincount(doc * width + kinds[b], minlength=n * width).reshape(n, width).astype(float)
    count = dict(zip(("other", *_CLASSES), table.T, strict=True))

    words, begin = shingles.word_hashes(data, ends.tolist())
    m = np.diff(begin)
    own = np.repeat(np.arange(n), m)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    again = np.bincount(own[same], minlength=n)
    order = np.lexsort((words, own))
    w, d = words[order], own[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[first], minlength=n)
    top = np.zeros(n)
    at = np.flatnonzero(first)
    if len(at):
        np.maximum.at(top, d[at], np.diff(np.append(at, len(w))))
    solid = size - count["line"] - count["space"]
    letters = count["upper"] + count["lower"] + count["other"]

    # A rate is drawn towards what is usual as if the text had PRIOR more words, so that a few words do not look like an extreme text.
    part = lambda x, of, usual: np.log((x + PRIOR * usual) / (of + PRIOR) + 1e-3)
    lengths = np.log((solid + PRIOR * 5.5) / (m + PRIOR))
    return np.column_stack([
        np.log1p(m), lengths, part(distinct, m, 0.65), part(again, m, 0.0), part(count["upper"], letters, 0.03), part(count["digit"], solid, 0.005), part(count["stop"], m, 0.15), part(count["symbol"], m, 0.0),
        part(count["bar"], m, 0.0), part(count["shout"], m, 0.0), part(count["line"], m, 0.03), part(np.maximum(solid - letters, 0), solid, 0.03), lengths**2, part(count["other"], solid, 0.03), part(top, m, 0.08),
    ])


def _features(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at, n, data, ends in slices(batch, "text"):
            x = features(data, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.ravel())], names=["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every whole text; a null text is empty. A very long one is measured alone. Null ids and repeated rows are rows like others; other columns
    are not looked at; no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(_features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches):
    """For each class: the number of rows and the sums of all products of the statistics and 1."""
    import numpy as np
    import pyarrow as pa

    d = len(NAMES) + 1
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for batch in batches:
        y = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d - 1)
        x = np.column_stack([x, np.ones(len(y))])
        for c in total:
            total[c] += x[y == c].T @ x[y == c]
    i, j = np.indices((d, d)).reshape(2, -1)
    for c, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, c)), pa.array(i), pa.array(j), pa.array(t.ravel())], names=["c", "i", "j", "v"])


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor of the covariance, log of its determinant; the log prior odds."""

    means: tuple
    factors: tuple
    logdets: tuple
    odds: float

    def scores(self, x):
        import numpy as np

        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        half = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            half.append(-0.5 * (np.einsum("ij,ij->i", z, z) + logdet))
        return 1 / (1 + np.exp(-np.clip((half[1] - half[0]) / SPREAD + self.odds, -500, 500)))


def fitted(measures: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """The model of labels (doc_id, label 0 or 1; null labels and ids are left out). A document counts once, by its least measures, whatever repeats its id; repeated
    equal labels count once, and one that is labelled both ways counts for both.

    With no row of a class there are no densities, and every score is the share of label 1 (0.5 without labels)."""
    import numpy as np

    d = len(NAMES) + 1
    each = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("long").alias("label")).distinct()
    rows = each.join(measures, "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("label", "x")
    sums = small_batches(rows).mapInArrow(_moments, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v"))
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for c, i, j, v in sums.collect():  # 2 * d * d rows
        total[c][i, j] = v
    n = {c: t[-1, -1] for c, t in total.items()}
    odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if min(n.values()) < 2:
        return Model((), (), (), odds)
    means = {c: t[-1, :-1] / n[c] for c, t in total.items()}
    within = {c: t[:-1, :-1] / n[c] - np.outer(means[c], means[c]) for c, t in total.items()}
    pooled = (n[0] * within[0] + n[1] * within[1]) / (n[0] + n[1])
    aim = np.diag(np.diag(pooled)) + ridge * np.eye(d - 1)
    factors, logdets = [], []
    for c in (0, 1):
        low = np.linalg.cholesky((1 - shrinkage) * within[c] + shrinkage * aim)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    return Model((means[0], means[1]), tuple(factors), tuple(logdets), odds)


def scored(measures: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 is likelier); a row for each row of measures."""
    shared = measures.sparkSession.sparkContext.broadcast(model)
    kind = measures.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

    return measures.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(the statistics of docs, the model of labels on them)."""
    measures = scratch(measured(docs, id_col, text_col), "measures")
    return measures, fitted(measures, labels)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of labels alone: only texts that may have a label are measured, told by a Bloom table of bounded size, and no text is shuffled."""
    return fitted(measured(maybe(docs, id_col, labels.select("doc_id")), id_col, text_col), labels)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, that score `keep` or more. Null texts score as empty ones; nulls, repeated rows and other columns are left as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            text = batch.select([batch.schema.names[column]]).rename_columns(["text"]) if batch.schema.names.count(text_col) == 1 else pa.RecordBatch.from_arrays([batch.column(column)], names=["text"])
            good = [shared.value.scores(features(data, ends)) >= keep for _, _, data, ends in slices(text, "text")]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return small_batches(docs).mapInArrow(run, docs.schema)
