"""Toxic spans and document scores from a linear-chain conditional random field.

*Labelled tokens.*  Labels are given for documents.  A feature of a token (the word, one of its
prefixes, or in scripts without spaces a letter and its pairs with the letters beside it) whose document frequency among toxic documents is far above that among the
others is a cue.  A token with a cue is labelled toxic in a toxic document and clean in
any other; every other token is labelled clean.

*Field.*  Two states, clean (score 0) and toxic (a bias and the weights of the token's cues),
and transition scores.  Tokens without cues are alike, so a stretch of ``g`` of them is
the ``g``-th power of one 2 x 2 matrix and forward-backward visits cue tokens only;
this is exact.  Training maximises the conditional likelihood of a bounded sample of labelled
documents; the gradient of the weights is the labels less the marginals.

*Documents.*  The marginals of cue tokens aggregate by noisy-or; a logistic curve fitted to
the sample's labels turns that into a probability.  Tokens with a marginal of at least
one half are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.language_id import held_out
from geoloom.llm.staging import bounded_sample, materialize, share, shared
from geoloom.llm.textkit import as_bytes, chunks, letter_bounds, mix64, word_hashes

PREFIXES = (5, 6, 7, 8)  # in bytes
FEATURES = len(PREFIXES) + 3  # of a token: the word, its prefixes, the pairs it ends and begins


def lowered(text: bytes) -> bytes:
    """The text in lower case, letter by letter: one code point for each, the same wherever it stands and whatever else the text holds."""
    if text.isascii():
        return text.lower()
    return text.decode("utf-8", "replace").replace("İ", "i").lower().replace("ς", "σ").encode("utf-8", "replace")


def token_features(texts: list[bytes]):
    """(starts, ends, counts, features): a row of features for each word of the lowered texts; 0 stands for none."""
    buf, starts, ends, counts = letter_bounds(texts)
    rows = [word_hashes(buf, starts, ends)]
    for i, n in enumerate(PREFIXES):
        has = ends - starts > n
        f = np.zeros(len(starts), dtype=np.uint64)
        if has.any():
            f[has] = mix64(word_hashes(buf, starts[has], starts[has] + n) + np.uint64(i + 1))
        rows.append(f)
    # words that touch are letters of a script without spaces: the pairs that one begins and ends
    touch = np.flatnonzero(ends[:-1] == starts[1:])
    for i in (0, 1):
        f = np.zeros(len(starts), dtype=np.uint64)
        f[touch + i] = mix64(rows[0][touch] * np.uint64(3) + rows[0][touch + 1] + np.uint64(i))
        rows.append(f)
    return starts, ends, counts, np.stack(rows)


def running_products(matrices: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each matrix the product of its sequence's matrices up to it, and the log of the scale taken out; ``nth`` is its place in the sequence."""
    scale = matrices.max(axis=(1, 2), initial=0.0)
    out, log = matrices / scale[:, None, None], np.log(scale)
    reach, longest = 1, nth.max(initial=0)
    while reach <= longest:  # each holds the product of the last ``reach`` matrices
        at = np.flatnonzero(nth >= reach)
        joined = out[at - reach] @ out[at]
        scale = joined.max(axis=(1, 2))
        log[at] += log[at - reach] + np.log(scale)
        out[at] = joined / scale[:, None, None]
        reach *= 2
    return out, log


class Field:
    """The trained field: cue features, their weights, and the global scores (bias, clean-to-toxic, toxic-to-clean, toxic-to-toxic)."""

    def __init__(self, cues: np.ndarray) -> None:
        self.cues = np.sort(cues)
        self.weights = np.zeros(len(self.cues))
        self.globals = np.array([-4.0, 0.0, 0.0, 0.0])
        self.curve = np.array([-4.0, 1.0])
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.cues >> np.uint64(48)).astype(np.int64)] = True

    def find(self, features: np.ndarray) -> np.ndarray:
        """For each feature of each token the cue's index, -1 for none."""
        out = np.full(features.shape, -1, dtype=np.int64)
        if not len(self.cues):
            return out
        maybe = self.sieve[(features >> np.uint64(48)).astype(np.int64)]
        some = features[maybe]
        at = np.minimum(np.searchsorted(self.cues, some), len(self.cues) - 1)
        out[maybe] = np.where(self.cues[at] == some, at, -1)
        return out

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return self.globals[0] + np.where(found >= 0, np.append(self.weights, 0.0)[found], 0.0).sum(axis=0)

    def _steps(self):
        """(b, jump, power, log of the top value): the transition into a cue token, and scaled powers of the step over others."""
        b, a01, a10, a11 = self.globals
        step = np.exp(np.array([[0.0, a01 + b], [a10, a11 + b]]))  # from state, to a token without cues
        jump = np.exp(np.array([[0.0, a01], [a10, a11]]))
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        inverse = np.linalg.inv(vectors)
        parts = [np.outer(vectors[:, i], inverse[i]) for i in (0, 1)]
        ratio, log_top = values[1] / values[0], np.log(values[0])

        def power(gap: np.ndarray) -> np.ndarray:  # step ** gap / top ** gap
            return parts[0] + np.power(ratio, gap.astype(float))[:, None, None] * parts[1]

        return b, jump, power, log_top

    def _chain(self, counts: np.ndarray, owner: np.ndarray, place: np.ndarray, scores: np.ndarray):
        """(steps, tails, nth, last, log): a matrix into each cue token from the one before, a vector out of the last, and the scale taken out."""
        b, jump, power, log_top = self._steps()
        per = np.bincount(owner, minlength=len(counts))
        nth = np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
        first, last = nth == 0, nth == per[owner] - 1
        gap = place.copy()
        gap[1:] -= np.where(first[1:], 0, place[:-1] + 1)
        steps = power(np.where(first, np.maximum(gap - 1, 0), gap)) @ jump
        # before the first token the state is free: a token without cues has (1, e^b), one with cues (1, e^score)
        steps[first] = (np.array([1.0, np.exp(b)]) @ steps[first])[:, None, :]
        steps[first & (gap == 0)] = 1.0
        steps[:, :, 1] *= np.exp(scores)[:, None]
        rest = counts[owner[last]] - place[last] - 1
        gaps = np.bincount(owner, weights=np.where(first, np.maximum(gap - 1, 0), gap), minlength=len(counts))
        gaps[owner[last]] += rest
        none = per == 0
        gaps[none] = np.maximum(counts[none] - 1, 0)
        log = gaps * log_top
        log[none] += np.log((np.array([1.0, np.exp(b)]) @ power(gaps[none])).sum(axis=-1))
        log[counts == 0] = 0.0
        return steps, power(rest).sum(axis=2), nth, last, log

    def log_partition(self, counts: np.ndarray, owner: np.ndarray, place: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log Z of every text; arguments as for :meth:`marginals`."""
        return self._forward(*self._chain(counts, owner, place, scores), owner)[1]

    @staticmethod
    def _forward(steps, tails, nth, last, log, owner) -> tuple[np.ndarray, np.ndarray]:
        products, scale = running_products(steps, nth)
        alpha = products[:, 0]
        log[owner[last]] += scale[last] + np.log((alpha[last] * tails).sum(axis=1))
        return alpha, log

    def marginals(self, counts: np.ndarray, owner: np.ndarray, place: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic marginals of the cue tokens, and log Z of every text.

        ``counts``: words of each text; ``owner``, ``place``, ``scores``: text, position and emission of each cue token, in order.
        """
        steps, tails, nth, last, log = self._chain(counts, owner, place, scores)
        alpha, log_z = self._forward(steps, tails, nth, last, log, owner)
        ahead = np.empty_like(steps)
        ahead[:-1] = steps[1:]
        ahead[last] = tails[:, :, None]
        from_end = (np.cumsum(np.bincount(owner, minlength=len(counts)))[owner] - 1 - np.arange(len(owner)))[::-1]
        beta = running_products(ahead.transpose(0, 2, 1)[::-1], from_end)[0][::-1, 0]
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), log_z

    def locate(self, texts: list[bytes]):
        """(counts, owner, place, found, spans): the cue tokens of lowered texts, in order."""
        starts, ends, counts, features = token_features(texts)
        found = self.find(features)
        cue = np.flatnonzero((found >= 0).any(axis=0))
        offsets = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)[cue]
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])[owner]
        return counts, owner, cue - offsets[owner], found[:, cue], np.stack([starts[cue] - base, ends[cue] - base], axis=1)

    def evidence(self, texts: int, owner: np.ndarray, marginal: np.ndarray) -> np.ndarray:
        """Log odds, for each text, that at least one of its cue tokens is toxic."""
        clean = np.bincount(owner, weights=np.log(np.maximum(1 - marginal, 1e-9)), minlength=texts)
        return np.where(clean < -1e-9, np.log(-np.expm1(np.minimum(clean, -1e-9))) - clean, np.log(1e-9))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.clip(evidence, -12, 12))))


def sketch(text: bytes, bands: int = 4, rows: int = 2) -> list[int]:
    """A key for each band of min-hashes of a lowered text's word pairs; near copies share one."""
    buf, starts, ends, _ = letter_bounds([text])
    h = word_hashes(buf, starts, ends)
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(bands * rows):
        keys[k // rows] = mix64(keys[k // rows : k // rows + 1] * np.uint64(5) + (mix64(pairs + np.uint64(k + 1)).min() if len(pairs) else np.uint64(0)))[0]
    return keys.view(np.int64).tolist()


def without_near_copies(rows: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the rows, in order of both, that share no key with an earlier one; else a text copied often makes all its words cues."""
    keep, seen = [], set()
    for doc_id, toxic, keys in sorted(rows):
        mine = set(enumerate(keys))
        if not mine & seen:
            keep.append((doc_id, toxic))
        seen |= mine
    return keep


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [sketch(lowered(t)) for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "toxic", "keys"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, others) of each text's distinct features."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        texts = [lowered(t) for t in as_bytes(batch.column(2))]
        for a, b in chunks(texts):
            _, _, counts, features = token_features(texts[a:b])
            owner = np.repeat(np.arange(a, b), counts)
            for f in features:
                has = f != 0
                order = np.lexsort((f[has], owner[has]))
                o, x = owner[has][order], f[has][order]
                first = np.ones(len(o), dtype=bool)
                first[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
                o, x = o[first], x[first]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array((toxic[o] == 1).astype(np.int64)), pa.array((toxic[o] != 1).astype(np.int64))], names=["feature", "k1", "k0"])


def choose_cues(texts: DataFrame, toxic: int, others: int, least: int = 4, lift: float = 6.0, chance: float = 0.01, most: int = 4000) -> np.ndarray:
    """Features found in at least ``least`` toxic texts and ``lift`` times as often as elsewhere, by far more than chance.

    ``texts`` has (doc_id, toxic, text), ``toxic`` and ``others`` rows of each label.  The log-likelihood ratio must be so
    large that ``chance`` such features are expected among all features by chance; of them, ``most`` bounds the model.
    """
    n1, n0 = float(max(1, toxic)), float(max(1, others))
    counts = texts.mapInArrow(_feature_counts, "feature long, k1 long, k0 long").groupBy("feature").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    counts = materialize(counts, "feature-counts")
    every = counts.agg(F.count_if(F.col("k1") > 0).alias("a"), F.count_if(F.col("k0") > 0).alias("b")).first()
    k1, k0, p = F.col("k1"), F.col("k0"), (F.col("k1") + F.col("k0")) / (n1 + n0)
    part = lambda k, n: F.when(k > 0, k * F.ln(k / n / p)).otherwise(0.0) + F.when(k < n, (n - k) * F.ln((n - k) / n / F.greatest(1 - p, F.lit(1e-12)))).otherwise(0.0)
    good = counts.where((k1 >= least) & (k1 / n1 >= lift * (k0 + 0.5) / n0)).withColumn("ratio", 2 * (part(k1, n1) + part(k0, n0)))
    best = good.where(F.col("ratio") >= 2 * float(np.log(max(2, every["a"] + every["b"]) / chance))).orderBy(F.desc("ratio"), "feature").limit(most).collect()
    return np.array([r["feature"] for r in best], dtype=np.int64).view(np.uint64)


def _cue_tokens(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared(model)
        for batch in batches:
            texts = [lowered(t) for t in as_bytes(batch.column(2))]
            for a, b in chunks(texts):
                counts, owner, place, found, _ = field.locate(texts[a:b])
                ends = np.searchsorted(owner, np.arange(1, b - a))
                split = lambda x: pa.array(np.split(x, ends) if b > a else [], pa.list_(pa.int64()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts, pa.int64()), split(place), *(split(row) for row in found)], names=["doc_id", "toxic", "words", "place", *(f"f{i}" for i in range(len(found)))])

    return run


def train(field: Field, counts: np.ndarray, owner: np.ndarray, place: np.ndarray, found: np.ndarray, toxic: np.ndarray, rounds: int = 120, penalty: float = 0.02) -> Field:
    """Fit a field to the cue tokens of texts with document labels ``toxic``, by Adam on the penalised conditional likelihood."""
    label = toxic[owner].astype(float)
    # transitions that the labels make
    follows = np.zeros(len(owner), dtype=bool)
    follows[1:] = (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1) & (label[:-1] == 1) & (label[1:] == 1)
    into = ((label == 1) & ~follows & (place > 0)).sum()
    leaves = np.append(follows[1:], False)
    out_of = ((label == 1) & ~leaves & (place < counts[owner] - 1)).sum()
    seen = np.array([label.sum(), into, out_of, follows.sum()], dtype=float)
    size = max(1, len(toxic))
    theta = np.concatenate([field.globals, field.weights])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def use(t: np.ndarray) -> tuple[np.ndarray, float]:
        field.globals, field.weights = t[:4], t[4:]
        marginal, log_z = field.marginals(counts, owner, place, field.emissions(found))
        return marginal, log_z.sum()

    def total(t: np.ndarray) -> float:
        field.globals, field.weights = t[:4], t[4:]
        return field.log_partition(counts, owner, place, field.emissions(found)).sum()

    for n in range(1, rounds + 1):
        marginal, base = use(theta)
        wanted = label - marginal
        grad = np.zeros_like(theta)
        for row in found:
            hit = row >= 0
            grad[4:] += np.bincount(row[hit], weights=wanted[hit], minlength=len(field.weights))
        for i in range(4):
            near = theta.copy()
            near[i] += 1e-4
            grad[i] = seen[i] - (total(near) - base) / 1e-4
        grad = grad / size - penalty / size * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-10)
        theta[0] = max(theta[0], -12.0)
    marginal, _ = use(theta)
    x = np.clip(field.evidence(len(toxic), owner, marginal), -12, 12)
    w = np.array([-2.0, 0.5])
    for _ in range(200):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        d = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(toxic - p).sum(), ((toxic - p) * x).sum()]) - 0.01 * w
        h = np.array([[d.sum(), (d * x).sum()], [(d * x).sum(), (d * x * x).sum()]]) + 0.01 * np.eye(2)
        move = np.linalg.solve(h, g)
        w = w + np.clip(move, -0.5, 0.5)
        if abs(move).max() < 1e-8:
            break
    field.curve = w
    return field


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> Field:
    """Train on at most ``per_label`` labelled documents of each label, chosen by a hash among those not held out.

    Texts stay on the executors, however long: sketches, counts of features and the cue tokens of that sample reach the driver.
    Of rows with one id the least text is taken.  Without a toxic and a clean document every score is a constant.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = bounded_sample(known, "toxic", per_label).select(F.col("doc_id").alias("__id"), "toxic")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialize(sample, "labelled")
    keep = without_near_copies([tuple(r) for r in sample.mapInArrow(_sketches, "doc_id long, toxic int, keys array<long>").collect()])  # at most 2 x per_label rows
    toxic = sum(y for _, y in keep)
    texts = sample.join(F.broadcast(spark.createDataFrame(keep, "doc_id long, toxic int")), ["doc_id", "toxic"])
    field = Field(choose_cues(texts, toxic, len(keep) - toxic))
    if not keep:
        return field
    kinds = "".join(f", f{i} array<long>" for i in range(FEATURES))
    rows = texts.mapInArrow(_cue_tokens(share(spark, field)), f"doc_id long, toxic int, words long, place array<long>{kinds}").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["toxic"]))
    flat = lambda k: np.array([x for r in rows for x in r[k]], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r["place"]) for r in rows])
    found = np.stack([flat(f"f{i}") for i in range(FEATURES)])
    return train(field, np.array([r["words"] for r in rows]), owner, flat("place"), found, np.array([r["toxic"] for r in rows]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared(model)
        for batch in batches:
            raw = as_bytes(batch.column(0))
            score, spans = np.empty(len(raw)), []
            for a, b in chunks(raw):
                texts = [lowered(t) for t in raw[a:b]]  # offsets in code points are those of the text itself
                counts, owner, place, found, where = field.locate(texts)
                marginal, _ = field.marginals(counts, owner, place, field.emissions(found))
                score[a:b] = field.probability(field.evidence(b - a, owner, marginal))
                mine: list[list[dict]] = [[] for _ in texts]
                for i in np.flatnonzero(marginal >= 0.5).tolist():
                    t, (s, e) = texts[owner[i]], where[i]
                    begin = len(t[:s].decode("utf-8", "replace"))
                    mine[owner[i]].append({"start": begin, "end": begin + len(t[s:e].decode("utf-8", "replace")), "p": float(marginal[i])})
                spans += mine
            rest = batch.schema.names[1:]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(score), pa.array(spans, kind)], names=[*rest, "__score", "__spans"])

    return run


def toxicity(docs: DataFrame, field: Field, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """(*carry, score, predicted, spans) for every input row; only the text is looked at.

    ``spans``: code points [start, end) and marginal of each offending token.  A null text
    counts as empty, and has the score of a text without cues.  Whole texts are scored, however long; repeated rows, and rows
    of one id, each have their score, and equal texts the same one.  An empty table gives an empty result; columns not in
    ``carry`` are ignored, whatever their names.
    """
    model = share(docs.sparkSession, field)
    src = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:])
    out = src.mapInArrow(_score(model), f"{kinds}__score double, __spans array<struct<start:bigint,end:bigint,p:double>>")
    return out.select(*(F.col(f"__c_{c}").alias(c) for c in carry), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__spans").alias("spans"))
