"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels exist for documents only, so token labels are derived first: word and prefix features that are far more frequent in toxic than
in clean training documents (likelihood ratio statistic, over a distributed count) mark the toxic words of toxic documents. On
those labelled tokens a two-state CRF is trained: hashed features of the word (itself, prefixes, suffix) and its neighbours, and
transitions; the gradient comes from forward-backward marginals. A document's score is a logistic function of its
expected number of toxic words and its largest marginal; spans are the code point offsets of runs with a marginal of 0.5 or more.

What is fitted uses a bounded sample of labelled rows, chosen by a hash of the id: FIT_TOXIC and FIT_CLEAN documents at most, and
for the CRF TAGGED and UNTAGGED token segments at most, drawn by the same hash. A segment counts in the loss for all those of its kind
that it stands for, so the mix of both kinds is that of the labelled rows at every size. Held-out documents (crc32 of the id modulo 5 is 0) are never used. Scoring covers every whole
text; the chain of all documents of a batch is scanned in lanes of equal length, so one very long text costs no more than many short
ones of the same total.

Defined cases: a null or empty text, or one without words, gets the score of "no toxic word seen"; without labels of both kinds every
score is the same low prior; a null label is no label, repeated labels count as toxic if one is; other columns are passed on whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import doc_fold, give_back, slices, stage

FIT_TOXIC, FIT_CLEAN = 6000, 12000
TAGGED, UNTAGGED, SEGMENT_WORDS, SEGMENTS_PER_DOC = 24_000, 24_000, 24, 4
LEXICON, MIN_G2 = 20_000, 25.0
BITS = 17
EPOCHS, RATE, DECAY = 40, 0.5, 1e-6
WORDS_KEPT = 200_000
TEXT_BYTES = 1 << 20  # tagged at once
_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6, 7, 8)
OWN = 4 + len(_PREFIXES)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def lexicon_features(word: str) -> list[int]:
    """The word and its shorter prefixes, as signed 64-bit hashes."""
    keys = [f"w{word}", *(f"p{word[:k]}" for k in _PREFIXES if len(word) > k)]
    return [int.from_bytes(xxhash.xxh3_64_digest(k), "big", signed=True) for k in keys]


def slots(word: str) -> list[int]:
    """Places in the weight vector: of the word's own features, then as the left and as the right neighbour."""
    keys = [f"b={word}", f"a={word}", f"w={word}", f"s={word[-3:]}", *(f"p={word[:k]}" for k in _PREFIXES)]
    return [xxhash.xxh3_64_intdigest(k) & ((1 << BITS) - 1) for k in keys]


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False,
              weight: np.ndarray | None = None):
    """P(state 1) of each token of many chains laid end to end; score: of state 1 against 0; first: true where a chain begins.

    With `pairs`, also the expected counts of start states and transitions, a token counting `weight` times. Exact: the tokens are cut into lanes; the products of the
    2x2 step matrices of each lane give its entry and exit messages, then all lanes are walked at once.
    """
    n = len(score)
    if not n:
        return (np.zeros(0), np.zeros(2), np.zeros((2, 2))) if pairs else np.zeros(0)
    steps = max(1, int(np.ceil(np.sqrt(n))))
    lanes = -(-n // steps)
    gain = np.exp(np.clip(score, -30, 30))
    a, s = np.exp(trans), np.exp(start)
    m = np.empty((lanes * steps, 2, 2))
    m[:n, :, 0] = np.where(first[:, None], s[0], a[:, 0])
    m[:n, :, 1] = np.where(first[:, None], s[1], a[:, 1]) * gain[:, None]
    m[n:] = np.eye(2)
    m = np.ascontiguousarray(m.reshape(lanes, steps, 2, 2).transpose(1, 2, 3, 0))
    whole = np.tile(np.eye(2)[:, :, None], (1, 1, lanes))
    for t in range(steps):
        x = m[t]
        whole = np.stack([whole[:, 0] * x[0, 0] + whole[:, 1] * x[1, 0], whole[:, 0] * x[0, 1] + whole[:, 1] * x[1, 1]], axis=1)
        whole /= whole.sum(axis=(0, 1))
    enter, leave = np.empty((2, lanes)), np.empty((2, lanes))
    v, w = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for k in range(lanes):
        enter[:, k] = v
        v = v @ whole[:, :, k]
        v /= v.sum()
    for k in range(lanes - 1, -1, -1):
        leave[:, k] = w
        w = whole[:, :, k] @ w
        w /= w.sum()
    alpha, beta = np.empty((steps, 2, lanes)), np.empty((steps, 2, lanes))
    v = enter
    for t in range(steps):
        x = m[t]
        v = np.stack([v[0] * x[0, 0] + v[1] * x[1, 0], v[0] * x[0, 1] + v[1] * x[1, 1]])
        v /= v.sum(axis=0)
        alpha[t] = v
    w = leave
    for t in range(steps - 1, -1, -1):
        beta[t] = w
        x = m[t]
        w = np.stack([x[0, 0] * w[0] + x[0, 1] * w[1], x[1, 0] * w[0] + x[1, 1] * w[1]])
        w /= w.sum(axis=0)
    both = alpha * beta
    p = (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[:n]
    if not pairs:
        return p
    weight = np.ones(n) if weight is None else weight
    inner = np.zeros(lanes * steps)
    inner[:n] = np.where(first, 0.0, weight)
    inner = inner.reshape(lanes, steps).T
    moved, v = np.zeros((2, 2)), enter
    for t in range(steps):
        joint = v[:, None] * m[t] * beta[t][None]
        moved += (joint / joint.sum(axis=(0, 1))) @ inner[t]
        v = alpha[t]
    return p, np.array([1 - p[first], p[first]]) @ weight[first], moved


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    logistic: np.ndarray


class Tagger:
    """Word scores of a model, remembered for up to WORDS_KEPT words."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.zeros((WORDS_KEPT, 3))

    def _number(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            k = self.ids[word] = len(self.ids)
            at = self.model.weights[slots(word)]
            self.table[k] = at[2:].sum(), at[0], at[1]
        return k

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        out = []
        for words in texts:
            for start in range(0, len(words), WORDS_KEPT // 2):
                piece = words[start:start + WORDS_KEPT // 2]
                if len(self.ids) + len(piece) > WORDS_KEPT:
                    self.ids.clear()
                out.append(self.table[np.fromiter(map(self._number, piece), np.int64, len(piece))])
        parts = np.concatenate(out) if out else np.zeros((0, 3))
        return parts

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each text's words."""
        sizes = np.array([len(w) for w in texts], np.int64)
        parts = self.scores(texts)
        first = np.zeros(len(parts), bool)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        first[starts] = True
        score = parts[:, 0] + self.model.bias
        if len(parts):
            left, right = np.roll(parts[:, 1], 1), np.roll(parts[:, 2], -1)
            left[first] = 0
            right[np.roll(first, -1)] = 0
            score = score + left + right
        p = marginals(score, first, self.model.trans, self.model.start)
        return np.split(p, np.cumsum(sizes)[:-1]) if len(sizes) else []


def summary(p: np.ndarray) -> tuple[float, float]:
    """What the document score looks at: log of the expected number of toxic words, and the log odds of the most likely one."""
    top = float(np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6))
    return float(np.log(p.sum() + 1e-3)), float(np.log(top / (1 - top)))


def spans(text: str, p: np.ndarray, level: float = 0.5) -> list[dict[str, int]]:
    """Code point offsets of runs of words at or above the level."""
    if p.max(initial=0.0) < level:
        return []
    found, low = [], text.lower()
    if len(low) != len(text):  # a few letters change length when lower-cased: offsets then refer to the original by parts
        at = np.cumsum([0] + [len(c.lower()) for c in text])
    else:
        at = None
    for k, m in enumerate(_WORD.finditer(low)):
        if p[k] >= level:
            a, b = m.span() if at is None else np.searchsorted(at, m.span(), "right") - 1
            if found and found[-1]["last"] == k - 1:
                found[-1] |= {"end": int(b), "last": k}
            else:
                found.append({"start": int(a), "end": int(b), "last": k})
    return [{"start": f["start"], "end": f["end"]} for f in found]


def _counts(lexicon_rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bad, good = Counter(), Counter()

    def rows():
        keys = list(bad.keys() | good.keys())
        return pd.DataFrame({"feature": np.array(keys, np.int64), "bad": [bad[k] for k in keys], "good": [good[k] for k in keys]})

    for pdf in lexicon_rows:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            seen = {f for w in set(words_of(text)) for f in lexicon_features(w)}
            (bad if toxic else good).update(seen)
            if len(bad) + len(good) > 150_000:
                yield rows()
                bad.clear()
                good.clear()
    yield rows()


def _segments(lexicon: frozenset[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for pdf in batches:
            out = []
            for doc_id, text, toxic in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                words = words_of(text)
                tags = []
                for w in words:
                    if w not in known:
                        if len(known) > WORDS_KEPT:
                            known.clear()
                        known[w] = not lexicon.isdisjoint(lexicon_features(w))
                    tags.append(known[w] and bool(toxic))
                cut = [(words[i:i + SEGMENT_WORDS], tags[i:i + SEGMENT_WORDS]) for i in range(0, len(words), SEGMENT_WORDS)]
                order = sorted(range(len(cut)), key=lambda i: xxhash.xxh3_64_intdigest(f"{doc_id}/{i}"))
                for kind in (True, False):
                    for i in [i for i in order if any(cut[i][1]) == kind][:SEGMENTS_PER_DOC]:
                        out.append((xxhash.xxh3_64_intdigest(f"{doc_id}:{i}") >> 1, toxic, kind, *cut[i]))
            yield pd.DataFrame(out, columns=["key", "toxic", "tagged", "words", "tags"])
    return run


def draw(segments: DataFrame, per_toxic: float, per_clean: float) -> DataFrame:
    """words, tags, weight: TAGGED and UNTAGGED segments at most, each with how many of its kind among all labelled rows it stands for."""
    rows = {r["tagged"]: r["n"] for r in segments.groupBy("tagged").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_document = F.when(F.col("toxic") == 1, F.lit(float(per_toxic))).otherwise(F.lit(float(per_clean)))

    def kind(tagged: bool, most: int) -> DataFrame:
        few = segments.where(F.col("tagged") == tagged).orderBy("key").limit(most)
        return few.select("words", "tags", (of_document * (max(1.0, rows.get(tagged, 0) / most))).alias("weight"))

    return kind(True, TAGGED).unionByName(kind(False, UNTAGGED))


def _fit_crf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Full-batch Adagrad on the drawn segments; one row of weights. Words are numbered, so a token takes four bytes until all are read."""
    numbers: dict[str, int] = {}
    table, index, tags, firsts, weighs = array("i"), array("i"), array("b"), array("b"), array("f")
    for pdf in batches:
        for words, flags, much in zip(pdf["words"], pdf["tags"], pdf["weight"]):
            for k, (w, y) in enumerate(zip(words, flags)):
                at = numbers.setdefault(w, len(numbers))
                if len(table) == at * OWN:
                    table.extend(slots(w))
                index.append(at)
                tags.append(bool(y))
                firsts.append(k == 0)
                weighs.append(much)
    numbers.clear()
    weights, bias, trans, start = np.zeros(1 << BITS), -4.0, np.zeros((2, 2)), np.zeros(2)
    y, first, weight = np.array(tags, float), np.array(firsts, bool), np.array(weighs, float)
    if y.any():
        slot = np.array(table, np.int32).reshape(-1, OWN)[np.array(index, np.int32)]
        last = np.roll(first, -1)
        state = y.astype(int)
        seen_start = np.bincount(state[first], weight[first], 2)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[:-1][~first[1:]], state[1:][~first[1:]]), weight[1:][~first[1:]])
        sums = [np.full_like(weights, 1e-2), 1e-2, np.full((2, 2), 1e-2), np.full(2, 1e-2)]
        scale = 1.0 / max(1.0, (weight * y).sum())
        for _ in range(EPOCHS):
            left, right = np.roll(weights[slot[:, 0]], 1), np.roll(weights[slot[:, 1]], -1)
            left[first], right[last] = 0, 0
            own_score = sum(weights[slot[:, c]] for c in range(2, slot.shape[1]))
            p, begun, moved = marginals(own_score + bias + left + right, first, trans, start, True, weight)
            miss = weight * (y - p) * scale
            g = sum(np.bincount(slot[:, c], miss, 1 << BITS) for c in range(2, slot.shape[1]))
            to_left, to_right = np.roll(miss, -1), np.roll(miss, 1)  # the next word sees this one as its left neighbour
            to_left[last], to_right[first] = 0, 0
            g += np.bincount(slot[:, 0], to_left, 1 << BITS) + np.bincount(slot[:, 1], to_right, 1 << BITS) - DECAY * weights
            steps = [g, miss.sum(), (seen - moved) * scale, (seen_start - begun) * scale]
            for k, d in enumerate(steps):
                sums[k] = sums[k] + d * d
            weights = weights + RATE * steps[0] / np.sqrt(sums[0])
            bias, trans, start = (v + RATE * d / np.sqrt(h) for v, d, h in zip((bias, trans, start), steps[1:], sums[1:]))
    yield pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "rest": [[float(bias), *trans.ravel(), *start]]})
    table = index = tags = firsts = weighs = slot = weight = None  # noqa: F841  the largest ones
    give_back()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """(doc_id, text, toxic) of the documents to fit on, and how many labelled rows each toxic and each clean one stands for."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_fold() != 0))
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .withColumn("order", F.xxhash64("doc_id")))
    known = stage(known, "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    picked = known.where("toxic = 1").orderBy("order").limit(FIT_TOXIC).unionByName(known.where("toxic = 0").orderBy("order").limit(FIT_CLEAN))
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "toxic"))  # FIT_TOXIC + FIT_CLEAN rows at most
    rows = (docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))
    per = [counts.get(k, 0) / max(1, min(counts.get(k, 0), most)) for k, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    return stage(rows, "toxic-sample"), *per


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Derive token labels, train the CRF, and fit the document score. Runs jobs; the driver gets bounded tables only."""
    sample, per_toxic, per_clean = labelled_sample(docs, labels)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    empty = Model(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, -4.0]))
    if not bad or not good:
        return empty
    counts = (sample.mapInPandas(_counts, "feature long, bad long, good long").groupBy("feature")
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))

    def part(x, total_x, y, total_y):
        seen = F.col(x).cast("double")
        return F.when(seen > 0, seen * F.log(seen * (bad + good) / (F.col(x) + F.col(y)) / total_x)).otherwise(0.0)

    g2 = 2 * (part("bad", bad, "good", good) + part("good", good, "bad", bad))
    marked = counts.withColumn("g2", g2).where((F.col("g2") >= MIN_G2) & (F.col("bad") * good > 20 * F.col("good") * bad))
    lexicon = frozenset(r["feature"] for r in marked.orderBy(F.desc("g2"), "feature").limit(LEXICON).collect())
    schema = "key long, toxic int, tagged boolean, words array<string>, tags array<boolean>"
    segments = draw(stage(sample.mapInPandas(_segments(lexicon), schema), "toxic-segments"), per_toxic, per_clean)
    row = segments.coalesce(1).mapInPandas(_fit_crf, "weights binary, rest array<double>").collect()[0]
    rest = np.array(row["rest"])
    model = Model(np.frombuffer(row["weights"], "<f4").astype(float), float(rest[0]), rest[1:5].reshape(2, 2), rest[5:7], np.zeros(3))

    def looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                some = pdf.iloc[start:start + 64]
                rows = [summary(p) for p in tagger.tag([words_of(t) for t in some["text"]])]
                yield pd.DataFrame(rows, columns=["amount", "top"]).assign(toxic=some["toxic"].to_numpy())

    seen = sample.mapInPandas(looks, "amount double, top double, toxic int").toPandas()  # FIT_TOXIC + FIT_CLEAN rows at most
    y = seen["toxic"].to_numpy(float)
    model.logistic = _logistic(seen[["amount", "top"]].to_numpy(float), y, np.where(y > 0, per_toxic, per_clean))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "toxic_score", where: str = "toxic_spans") -> DataFrame:
    """All columns, the score (0 to 1) and the offending spans (start, end in code points)."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    at = docs.columns.index(text)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for whole in batches:
            for batch in slices(whole, at, TEXT_BYTES):
                texts = [v.as_py() or "" for v in batch.column(at)]
                marks = tagger.tag([words_of(t) for t in texts])
                x = np.array([summary(p) for p in marks]).reshape(-1, 2)
                odds = x @ model.logistic[:2] + model.logistic[2]
                made = [pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))), pa.float64()),
                        pa.array([spans(t, p) for t, p in zip(texts, marks)], arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, score, where])
        del tagger
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(where, span)]))


def document_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score, the prediction and the spans."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (doc_fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"),
                         F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("toxic_spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, with all their columns."""
    score, where = "_toxic_score", "_toxic_spans"
    while {score, where} & set(docs.columns):
        score, where = "_" + score, "_" + where
    return score_documents(docs, fit(docs, labels), score=score, where=where).where(F.col(score) < 0.5).drop(score, where)
