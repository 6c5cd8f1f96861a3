"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tokens; a token's features are the word and its first 4 to 10 bytes. Spark counts each feature in a bounded,
stratified sample of labelled documents; those that lean to toxic documents make the vocabulary. The field has two tags.
A token's emission is a bias, a weight of its own for each vocabulary feature that it has, and weights for a vocabulary
feature of the token to its left or right; a weight for each pair of neighbouring tags makes the chain.

Labelled tokens: all tokens of a clean document are labelled clean. In a toxic document tokens with a feature of strong
lean are labelled toxic, and tokens that have no vocabulary feature are labelled clean; those whose features lean less
have no label, and the likelihood sums over their tags. All weights are fitted together by maximising the
conditional likelihood of the labels with L-BFGS; the gradient, labels' expectations less the field's, is added up over
tasks by forward-backward on chains of CHAIN tokens, into which the sample's texts are cut.

On whole texts forward-backward gives each token's marginal; runs of tokens without active features share one matrix,
whose power is taken at once, so the chain is never cut. A logistic over the sum and the largest of the marginals, fitted
on a quarter of the sample that the field has not seen, gives the score; tokens of marginal 0.5 or more are offending,
and neighbours merge into spans.

Cases: null and empty texts have no tokens and score as clean. Without labels of both kinds the score is the share of
the labels (0 without any) and there are no spans; so it is, with the share, if no feature leans to toxic documents.
A small sample learns in the same way, from what leans far enough: three toxic documents that share a word among ten
clean ones without it are enough. Repeated rows get equal results. No rows: no rows. Texts are taken whole. Other
columns pass unchanged; helper columns are named __tox_*, and a column of such a name is replaced.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import mark, release, ship, written
from shiftscope.llm._fit import remainder, thinned
from shiftscope.llm._text import ALNUM, LOWER, chunks, span_hashes, words

#: Labelled documents in the sample, in expectation.
TOXIC_TEXTS, CLEAN_TEXTS = 3_000, 5_000
#: Features in the vocabulary at most; how far they must lean, in log odds and in standard errors; and what labels tokens.
VOCABULARY = 2_000
LEAST_ODDS, LEAST_ERRORS, STRONG_ODDS = 1.5, 2.25, 3.0
PREFIXES = range(4, 11)
#: Tokens of a chain in training, steps of L-BFGS at most, and the penalty on squared weights.
CHAIN, STEPS, PENALTY = 64, 24, 0.5
#: One part of so many of the sample is kept for the logistic.
KEPT_PART = 4
_WORD = np.uint64(0x5851F42D4C957F2D)
_MAYBE = np.uint64((1 << 18) - 1)


def _features(data: np.ndarray, offsets: np.ndarray):
    """words() of a chunk, and (hashes, tokens) of each kind of feature."""
    hashes, first, end, by_row = words(data, offsets, ALNUM)

    def kinds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield hashes ^ _WORD, np.arange(len(hashes))
        low = LOWER[data]
        for k in PREFIXES:
            own = np.flatnonzero(end - first >= k)
            yield span_hashes(low, first[own], first[own] + k) + np.uint64(k), own

    return first, end, by_row, kinds


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, clean texts) that hold it, summed over a chunk."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for row0, data, offsets in chunks(batch.column(0)):
            _, _, by_row, kinds = _features(data, offsets)
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(by_row))
            for hashes, tokens in kinds():
                own = rows[tokens]
                order = np.lexsort((own, hashes))
                h, r = hashes[order], own[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, toxic = h[new], labels[row0 + r[new]] == 1
                found, at = np.unique(h, return_inverse=True)
                n1, n = np.bincount(at, toxic, minlength=len(found)).astype(np.int64), np.bincount(at, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["feature", "n1", "n0"])


@dataclass
class Field:
    share: float
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    strong: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    #: of the vocabulary, then of a left and a right neighbour in it, then the bias; all for the toxic tag
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray | None = None

    def __post_init__(self):
        self.maybe = np.zeros(int(_MAYBE) + 1, bool)
        self.maybe[(self.vocabulary & _MAYBE).astype(np.int64)] = True

    def found(self, kinds, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, number) of the features in force: those of the vocabulary, and of neighbours that have one."""
        tokens, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for hashes, own in kinds() if len(self.vocabulary) else ():
            likely = np.flatnonzero(self.maybe[(hashes & _MAYBE).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[likely]
            tokens.append(own[likely[hit]])
            numbers.append(at[hit])
        having = np.unique(np.concatenate(tokens))
        row = np.searchsorted(by_row, having, side="right") - 1
        right, left = having[having + 1 < by_row[row + 1]] + 1, having[having > by_row[row]] - 1
        m = len(self.vocabulary)
        return np.concatenate((*tokens, right, left)), np.concatenate((*numbers, np.full(len(right), m), np.full(len(left), m + 1)))

    def marginals(self, n: np.ndarray, bounds: np.ndarray, at: np.ndarray, emission: np.ndarray) -> np.ndarray:
        """P(toxic) of the active tokens, at places `at` of texts of n tokens; text i has those from bounds[i] to bounds[i + 1].

        Texts go side by side, from active token to active token; what lies between has the bias for its emission.
        """
        bias = np.exp(np.clip(self.weights[-1], -30, 30))
        move = np.exp(self.transition)
        plain = move * np.array([1.0, bias])
        half, gap = (plain[0, 0] + plain[1, 1]) / 2, np.sqrt(((plain[0, 0] - plain[1, 1]) / 2) ** 2 + plain[0, 1] * plain[1, 0])
        big, small = half + gap, half - gap
        top = (plain - small * np.eye(2)) / (big - small)
        rest = np.eye(2) - top

        def power(k: np.ndarray) -> np.ndarray:
            return top + ((small / big) ** k)[:, None, None] * rest

        def normal(x: np.ndarray) -> np.ndarray:
            return x / x.sum(axis=1, keepdims=True)

        k = np.diff(bounds)
        emit = np.stack([np.ones(len(at)), np.exp(np.clip(emission, -30, 30))], axis=1)
        forward, backward = np.zeros((len(at), 2)), np.ones((len(at), 2))
        own = bounds[:-1][k > 0]
        ahead = np.maximum(at[own] - 1, 0)
        come = np.einsum("i,nij,jk->nk", np.array([1.0, bias]), power(ahead), move)
        forward[own] = normal(np.where(at[own, None] > 0, come, 1.0) * emit[own])
        last = bounds[1:][k > 0] - 1
        backward[last] = normal(power(n[k > 0] - 1 - at[last]).sum(axis=2))
        order = np.argsort(-k, kind="stable")
        many = np.searchsorted(-k[order], -np.arange(1, k.max(initial=0) + 1), side="right")  # texts with as many active tokens
        for j in range(1, len(many)):
            i = bounds[order[: many[j]]] + j
            state = np.einsum("ni,nij,jk->nk", forward[i - 1], power(at[i] - at[i - 1] - 1), move)
            forward[i] = normal(state * emit[i])
            i = bounds[order[: many[j]] + 1] - 1 - j
            state = np.einsum("nij,jk,nk->ni", power(at[i + 1] - at[i] - 1), move, emit[i + 1] * backward[i + 1])
            backward[i] = normal(state)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, float, float, list[tuple[int, int]]]]:
        """(tokens, sum of marginals, largest marginal, offending byte spans) of each text."""
        for _, data, offsets in chunks(column):
            first, end, by_row, kinds = _features(data, offsets)
            tokens, numbers = self.found(kinds, by_row)
            active, where = np.unique(tokens, return_inverse=True)
            emission = self.weights[-1] + np.bincount(where, self.weights[numbers], minlength=len(active))
            bounds = np.searchsorted(active, by_row)
            row = np.searchsorted(by_row, active, side="right") - 1
            p = self.marginals(np.diff(by_row), bounds, active - by_row[row], emission)
            for r in range(len(offsets) - 1):
                own = p[bounds[r] : bounds[r + 1]]
                spans: list[tuple[int, int]] = []
                before = -2
                for token in active[bounds[r] : bounds[r + 1]][own >= 0.5]:
                    a, b = int(first[token] - offsets[r]), int(end[token] - offsets[r])
                    if token == before + 1:
                        spans[-1] = (spans[-1][0], b)
                    else:
                        spans.append((a, b))
                    before = token
                yield int(by_row[r + 1] - by_row[r]), float(own.sum()), float(own.max(initial=0.0)), spans

    def score(self, n: np.ndarray, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(n), self.share)
        return 1 / (1 + np.exp(-np.clip(_terms(n, total, most) @ self.logistic, -30, 30)))


def _terms(n: np.ndarray, total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), most, np.log1p(total), total / (n + 20.0) * 20.0, np.log1p(n)], axis=1)


def _fitted_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.5 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chains(shared) -> object:
    """(n, times, tags, place, number): chains of the sample, tags -1 where a token has no label; equal plain ones once."""
    kinds_ = [pa.int32(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = shared.value
        strong = np.concatenate((model.strong, [False, False]))
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            plain, rows = np.zeros(CHAIN + 1, np.int64), []
            for row0, data, offsets in chunks(batch.column(0)):
                first, _, by_row, kinds = _features(data, offsets)
                tokens, numbers = model.found(kinds, by_row)
                order = np.argsort(tokens, kind="stable")
                tokens, numbers = tokens[order], numbers[order]
                tags = np.zeros(len(first), np.int8)
                toxic = labels[row0 + np.searchsorted(by_row, tokens, side="right") - 1] == 1
                tags[tokens[toxic & (numbers < len(strong) - 2)]] = -1
                tags[tokens[toxic & strong[numbers]]] = 1
                for r in range(len(offsets) - 1):
                    for a in range(by_row[r], by_row[r + 1], CHAIN):
                        b = min(a + CHAIN, by_row[r + 1])
                        lo, hi = np.searchsorted(tokens, (a, b))
                        if lo == hi:
                            plain[b - a] += 1
                        else:
                            rows.append((b - a, 1, tags[a:b], tokens[lo:hi] - a, numbers[lo:hi]))
            rows += [(k, int(plain[k]), np.zeros(k, np.int8), [], []) for k in np.flatnonzero(plain)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds_)], ["n", "times", "tags", "place", "number"])

    return run


def chain_pass(n: np.ndarray, allowed: np.ndarray, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log sums, P(toxic) of each place, expected pairs of tags) of chains side by side.

    allowed is (chains, places, 2), emission (chains, places), move the exponentials of the transitions.
    """
    count, width = emission.shape
    inside = np.arange(width) < n[:, None]
    emit = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2) * allowed
    forward, backward = np.zeros((width, count, 2)), np.ones((width, count, 2))
    log_sum = np.zeros(count)
    for t in range(width):
        state = emit[:, t] if t == 0 else (forward[t - 1] @ move) * emit[:, t]
        state = np.where(inside[:, t, None], state, forward[t - 1] if t else 1.0)
        total = state.sum(axis=1)
        forward[t] = state / total[:, None]
        log_sum += np.log(total)
    pairs = np.zeros((2, 2, count))
    for t in range(width - 2, -1, -1):
        ahead = emit[:, t + 1] * backward[t + 1]
        state = ahead @ move.T
        backward[t] = np.where(inside[:, t + 1, None], state / state.sum(axis=1)[:, None], 1.0)
        both = forward[t][:, :, None] * move * ahead[:, None, :]
        both = both / both.sum(axis=(1, 2))[:, None, None] * inside[:, t + 1, None, None]
        pairs += both.transpose(1, 2, 0)
    both = forward * backward
    return log_sum, (both[:, :, 1] / both.sum(axis=2)).T * inside, pairs


def _gradients(shared, size: int) -> object:
    """(value, slope) of a task's chains: the conditional log likelihood of the labels, and its derivatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, transition = shared.value
        value, slope, move = 0.0, np.zeros(size + 4), np.exp(transition)
        for batch in batches:
            for p in range(0, batch.num_rows, 4096):
                part = batch.slice(p, 4096)
                n, times = part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy().astype(float)
                tags = np.zeros((len(n), CHAIN), np.int8)
                tags[np.arange(CHAIN) < n[:, None]] = part.column(2).flatten().to_numpy()
                held = np.diff(part.column(3).offsets.to_numpy())
                chain, place, number = np.repeat(np.arange(len(n)), held), part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy()
                emission = np.full((len(n), CHAIN), weights[-1])
                np.add.at(emission, (chain, place), weights[number])
                free = np.ones((len(n), CHAIN, 2))
                log_all, p_all, pairs_all = chain_pass(n, free, emission, move)
                # where all tags are clean there is one labelling
                log_own, p_own, pairs_own = np.maximum(n - 1, 0) * transition[0, 0], np.zeros_like(p_all), np.zeros_like(pairs_all)
                pairs_own[0, 0] = np.maximum(n - 1, 0)
                some = np.flatnonzero((tags != 0).any(axis=1))
                known = np.stack([tags != 1, tags != 0], axis=2)[some].astype(float)
                log_own[some], p_own[some], pairs_own[:, :, some] = chain_pass(n[some], known, emission[some], move)
                value += float(times @ (log_own - log_all))
                gap = (p_own - p_all) * times[:, None]
                slope[:size] += np.bincount(number, gap[chain, place], minlength=size)
                slope[size - 1] += gap.sum()
                slope[size:] += ((pairs_own - pairs_all) @ times).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tolist()], pa.list_(pa.float64()))], ["value", "slope"])

    return run


def maximised(function: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Where a smooth function is largest, by L-BFGS with step halving; function returns its value and gradient."""
    value, slope = function(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(slope).max())
        for (s, y), a in zip(moves, reversed(shares), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        rate = 1.0
        while True:
            new, new_slope = function(x + rate * way)
            if new >= value + 1e-4 * rate * (slope @ way) or rate < 1e-3:
                break
            rate /= 2
        if new <= value:
            break
        s, y = rate * way, slope - new_slope
        if s @ y > 1e-12:
            moves = [*moves[-(memory - 1) :], (s, y)]
        x, small, value, slope = x + rate * way, new - value < 1e-5 * abs(value), new, new_slope
        if small:
            break
    return x


def _documents(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = shared.value
        for batch in batches:
            found = list(model.texts(batch.column(batch.schema.get_field_index("__tox_text"))))
            n, total, most = (np.array([f[i] for f in found], float) for i in range(3))
            out = batch
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for name, values in (
                ("__tox_score", pa.array(model.score(n, total, most))),
                ("__tox_n", pa.array(n)),
                ("__tox_total", pa.array(total)),
                ("__tox_most", pa.array(most)),
                ("__tox_spans", pa.array([[{"start": a, "end": b} for a, b in f[3]] for f in found], kind)),
            ):
                out = out.set_column(out.schema.get_field_index(name), name, values)
            yield out

    return run


def tagged(docs: DataFrame, model: Field, *, text_col: str = "text") -> DataFrame:
    """docs with __tox_score and __tox_spans (UTF-8 byte offsets), and what the score is made of."""
    spark = docs.sparkSession
    ship(spark)
    ready = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__tox_")],
        F.col(text_col).alias("__tox_text"),
        *[F.lit(0.0).alias(f"__tox_{x}") for x in ("score", "n", "total", "most")],
        F.array().cast("array<struct<start:long,end:long>>").alias("__tox_spans"),
    )
    return ready.mapInArrow(_documents(spark.sparkContext.broadcast(model)), ready.schema).drop("__tox_text")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 4,
    held_out: int = 2,
    toxic_texts: int = TOXIC_TEXTS,
    clean_texts: int = CLEAN_TEXTS,
    vocabulary: int = VOCABULARY,
) -> Field:
    spark = docs.sparkSession
    ship(spark)
    start = mark(spark)
    rows = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(id_col, modulus) != held_out))
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Field(float(n1 > 0))
    share = {0: min(1.0, clean_texts / n0), 1: min(1.0, toxic_texts / n1)}
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 30)) / F.lit(1 << 30)
    own = F.broadcast(rows.filter(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0])))
    part = F.pmod(F.xxhash64(F.lit(6), F.col(id_col)), F.lit(KEPT_PART)).cast("int").alias("part")
    sample = written(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(own, id_col).select("text", "label", part).repartition(spark.sparkContext.defaultParallelism), "tox-sample")
    if sample.count() > 2 * (toxic_texts + clean_texts):
        # an id that many documents share: its texts are drawn, each once with each label and part
        sample = written(thinned(sample.dropDuplicates(["text", "label", "part"]), "text", toxic_texts + clean_texts), "tox-sample")
    seen, kept = sample.filter("part != 0").select("text", "label"), sample.filter("part = 0")
    m = {r.label: r["count"] for r in seen.groupBy("label").count().collect()}
    m0, m1 = m.get(0, 0), m.get(1, 0)
    if not m0 or not m1:
        return Field(n1 / (n0 + n1))
    held = seen.mapInArrow(_held, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    cells = [F.col("n1") + 0.5, m1 - F.col("n1") + 0.5, F.col("n0") + 0.5, m0 - F.col("n0") + 0.5]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    errors = odds / F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    leaning = held.select("feature", odds.alias("odds"), errors.alias("errors")).filter((F.col("odds") >= LEAST_ODDS) & (F.col("errors") >= LEAST_ERRORS))
    chosen = leaning.orderBy(F.desc("errors"), "feature").limit(vocabulary).toPandas()
    if not len(chosen):
        return Field(n1 / (n0 + n1))
    hashes = chosen.feature.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    size = len(hashes) + 3
    model = Field(n1 / (n0 + n1), hashes[order], chosen.odds.to_numpy(float)[order] >= STRONG_ODDS, np.zeros(size))
    cut = seen.mapInArrow(_chains(spark.sparkContext.broadcast(model)), "n int, times long, tags array<tinyint>, place array<int>, number array<int>")
    # the sample is small and lies in few files; every core takes a share of each step
    chains = written(cut.repartition(spark.sparkContext.defaultParallelism), "tox-chains")

    def likelihood(x: np.ndarray) -> tuple[float, np.ndarray]:
        now = spark.sparkContext.broadcast((x[:size], x[size:].reshape(2, 2)))
        tasks = chains.mapInArrow(_gradients(now, size), "value double, slope array<double>").collect()
        now.unpersist()
        penalty = np.full(len(x), PENALTY)
        return sum(t.value for t in tasks) - 0.5 * float(penalty @ x**2), sum(np.array(t.slope) for t in tasks) - penalty * x

    start_at = np.zeros(size + 4)
    start_at[size - 1] = -3.0
    x = maximised(likelihood, start_at)
    model.weights, model.transition = x[:size], x[size:].reshape(2, 2)
    both = {r.label for r in kept.select("label").distinct().collect()} == {0, 1}
    scored = tagged(kept if both else sample, model).select("label", "__tox_n", "__tox_total", "__tox_most").toPandas()
    y = scored.label.to_numpy(float)
    terms = _terms(*(scored[c].to_numpy(float) for c in ("__tox_n", "__tox_total", "__tox_most")))
    model.logistic = _fitted_logistic(terms, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    release(spark, start)
    return model
