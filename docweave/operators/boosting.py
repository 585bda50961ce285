"""Gradient-boosted trees for many classes over TF-IDF words, by histogram split search on Spark.

A row is its sorted list of codes: feature * bins + bin of each word it holds; a word it doesn't hold lies below all bins. Each
round grows one tree a class, level by level. A level is one pass: tasks score their rows with the trees so far, and add up
gradients and curvatures by (class, node, code) for all classes at once; Spark adds these up, turns them into sums over "bin or
above" by a window of at most ``bins`` rows, and takes the best split of each node. Only those come to the driver: classes times
nodes rows. Gradients are rounded to whole multiples of 2**-20, so that sums don't depend on their order and every partitioning
gives the same trees. Scores are written back with the rows every few rounds, so a pass never repeats more trees than that.

Softmax loss, starting at the logarithms of the classes' shares; of the leaves a level could split, those with the most gain are
split while there are at most ``leaves``. Equal gains: the smaller feature, then the lower bin. A single class gives a constant
model. Rows without text are rows without codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import ship
from docweave.sources.shared import written

Batches = Iterator[pa.RecordBatch]
#: Gradients and curvatures are whole multiples of one part in this many.
UNIT = 1 << 20
_ROWS = 4096
_WORDS = 1 << 20  # counted at a time


@dataclass
class Tree:
    """Nodes numbered like a heap from 1 (children 2n and 2n + 1): a row goes right if its bin of the feature is at least the
    split's."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 << self.depth
        self.feature, self.bin, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)

    def nodes(self, held: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``held`` are bins by row and column, ``column`` the column of each feature."""
        at = np.ones(len(held), np.int64)
        for _ in range(self.depth):
            splits = self.feature[at] >= 0
            if not splits.any():
                break
            right = held[np.arange(len(held)), column[np.where(splits, self.feature[at], 0)]] >= self.bin[at]
            at = np.where(splits, 2 * at + right, at)
        return at


def _tokens(text_col: str) -> F.Column:
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def _word_lists(batches: Batches) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their words), a bounded number of words at a time where rows are short; words are in the last column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            taken = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, taken + _WORDS, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.columns[-1]
            start = stop


def _row_terms(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, tf, terms, words): how often each row holds each of its terms ``terms[place]``; a term is the number of a word
    among the distinct ``words``, or their count plus first * count + second for a pair."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inside = row[1:] == row[:-1]
    pair = len(words) + code[:-1][inside] * len(words) + code[1:][inside]
    terms, place = np.unique(np.concatenate([code, pair]), return_inverse=True)
    key, tf = np.unique(np.concatenate([row, row[:-1][inside]]) * max(len(terms), 1) + place, return_counts=True)
    row, place = np.divmod(key, max(len(terms), 1))
    return row, place, tf, terms, words


def _term_totals(batches: Batches) -> Batches:
    """(term, df, total) of slices of rows."""
    for _, lists in _word_lists(batches):
        _, place, tf, terms, words = _row_terms(lists)
        n = len(words)
        first, second = np.divmod(terms[terms >= n] - n, max(n, 1))
        pairs = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
        names = pa.concat_arrays([words.take(pa.array(terms[terms < n])), pairs])
        df, total = np.bincount(place, minlength=len(terms)), np.bincount(place, tf, len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, pa.array(df.astype(np.int64)), pa.array(total)], names=["term", "df", "total"])


def _codes(known: Broadcast, bins: int, id_col: str) -> Callable[[Batches], Batches]:
    """(id, codes) of rows, by the known terms (term, idf, feature)."""

    def run(batches: Batches) -> Batches:
        terms, idf, feature = known.value
        parts = [t.split(" ") for t in terms]
        heads, lasts = pa.array([p[0] for p in parts], pa.string()), pa.array([p[-1] for p in parts], pa.string())
        is_pair = np.array([len(p) == 2 for p in parts], bool)
        for part, lists in _word_lists(batches):
            row, place, tf, found, words = _row_terms(lists)
            first, second = (pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (heads, lasts))
            theirs = np.where((first < 0) | (second < 0), -1, np.where(is_pair, len(words) + first * len(words) + second, first))
            at = np.full(len(found), -1)
            held = np.flatnonzero(np.isin(theirs, found))
            at[np.searchsorted(found, theirs[held])] = held
            hit = at[place] >= 0
            row, own, x = row[hit], at[place[hit]], (1.0 + np.log(tf[hit])) * idf[at[place[hit]]]
            norm = np.sqrt(np.bincount(row, x * x, part.num_rows))
            level = np.minimum(np.floor(np.sqrt(x / norm[row]) * bins), bins - 1).astype(np.int64)
            code = feature[own] * bins + level
            order = np.lexsort((code, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), listed], names=[id_col, "codes"])

    return run


@dataclass
class Words:
    """The words (and pairs) a model knows: (term, idf, feature), ``size`` of them, and into how many bins weights go."""

    terms: DataFrame
    size: int
    bins: int

    def codes(self, rows: DataFrame, *, id_col: str = "id", text_col: str = "content_text") -> DataFrame:
        """(id, codes) of each row. The terms, bounded by the model, are broadcast, so each row is coded where it lies."""
        spark = rows.sparkSession
        ship(spark)
        held = self.terms.orderBy("feature").collect()
        known = spark.sparkContext.broadcast(([r["term"] for r in held], np.array([r["idf"] for r in held], np.float64), np.array([r["feature"] for r in held], np.int64)))
        schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, codes array<int>"
        return rows.select(id_col, _tokens(text_col).alias("words")).mapInArrow(_codes(known, self.bins, id_col), schema)


def fit_words(rows: DataFrame, *, id_col: str = "id", text_col: str = "content_text", most: int = 12_000, bins: int = 16) -> Words:
    """The commonest words and pairs, weighed by TF-IDF; bins are equal steps of the square root of the weight. Rows are counted
    where they lie (ids are unique); only totals by term are shuffled."""
    ship(rows.sparkSession)
    parts = rows.select(_tokens(text_col).alias("words")).mapInArrow(_term_totals, "term string, df long, total long")
    best = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("all")).orderBy(F.desc("all"), "term").limit(most)
    idf = best.select("term", (F.log((1.0 + rows.count()) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    numbered = written(idf.withColumn("feature", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")), "words")  # ``most`` rows
    return Words(numbered, numbered.count(), bins)


@dataclass
class Boosted:
    """A model: classes in order, their starting scores, and for each round a tree a class."""

    classes: list
    start: list[float]
    rounds: list[list[Tree]]
    words: Words

    def probabilities(self, coded: DataFrame, name: str) -> DataFrame:
        """``coded`` (with codes) with the probability of each class."""
        kept = [f for f in coded.schema if f.name != "codes"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` array<double>"])
        return coded.select(*(f.name for f in kept), "codes").mapInArrow(_probabilities(self, len(kept), name), schema)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _slices(batches: Batches, codes_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, row of each code, codes)."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            lists = part.column(codes_at)
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            yield part, row, lists.flatten().to_numpy().astype(np.int64)


def _held(row: np.ndarray, codes: np.ndarray, n: int, words: tuple[int, int], trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Bins (from 0, or -1 for none) of the features that trees split on, and each feature's column."""
    size, bins = words
    used = np.unique(np.concatenate([t.feature for t in trees])) if trees else np.zeros(0, np.int64)
    used = used[used >= 0]
    column = np.full(max(size, 1), -1)
    column[used] = np.arange(len(used))
    held = np.full((n, max(len(used), 1)), -1, np.int16)
    at = column[codes // bins]
    hit = at >= 0
    held[row[hit], at[hit]] = codes[hit] % bins
    return held, column


def _add(scores: np.ndarray, rounds: list[list[Tree]], held: np.ndarray, column: np.ndarray) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.nodes(held, column)]
    return scores


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width).copy()


def gradients(scores: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradients and curvatures of the softmax loss."""
    p = softmax(scores)
    k = p.shape[1]
    y = np.zeros_like(p)
    y[np.arange(len(p)), target] = 1.0
    return np.rint((p - y) * UNIT).astype(np.int64), np.rint(k / (k - 1) * p * (1.0 - p) * UNIT).astype(np.int64)


def _histograms(recent: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], words: tuple[int, int]) -> Callable[[Batches], Batches]:
    """(class, node, code, g, h, n) added up over slices of rows; code -1 is all rows of the node."""
    width = len(growing)
    trees = [t for ts in [*recent, growing] for t in ts]

    def run(batches: Batches) -> Batches:
        span = words[0] * words[1] + 1  # the last place counts the node's rows
        for part, row, codes in _slices(batches, 1):
            held, column = _held(row, codes, part.num_rows, words, trees)
            scores = _add(_matrix(part.column(2), width), recent, held, column)
            g, h = gradients(scores, part.column(0).to_numpy())
            out: list[tuple[np.ndarray, ...]] = []
            for k, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                place = np.full(2 << growing[k].depth, -1)
                place[nodes] = np.arange(len(nodes))
                own = place[growing[k].nodes(held, column)]
                mine = own[row] >= 0
                inside = np.flatnonzero(own >= 0)
                key = np.concatenate([own[row[mine]] * span + codes[mine], own[inside] * span + span - 1])
                of = np.concatenate([row[mine], inside])
                found, which, n = np.unique(key, return_inverse=True, return_counts=True)
                sums = [np.bincount(which, x[of, k], len(found)).astype(np.int64) for x in (g, h)]  # exact below 2**53
                code = found % span
                out.append((np.full(len(found), k), np.array(nodes)[found // span], np.where(code == span - 1, -1, code), *sums, n))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [np.int32] * 3 + [np.int64] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["class", "node", "code", "g", "h", "n"])

    return run


def _scored(recent: list[list[Tree]], width: int, words: tuple[int, int]) -> Callable[[Batches], Batches]:
    trees = [t for ts in recent for t in ts]

    def run(batches: Batches) -> Batches:
        for part, row, codes in _slices(batches, 1):
            scores = _add(_matrix(part.column(2), width), recent, *_held(row, codes, part.num_rows, words, trees))
            offsets = pa.array(np.arange(part.num_rows + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))], names=["target", "codes", "scores"])

    return run


def _probabilities(model: Boosted, n_kept: int, name: str) -> Callable[[Batches], Batches]:
    start, rounds, words = model.start, model.rounds, (model.words.size, model.words.bins)
    trees = [t for ts in rounds for t in ts]

    def run(batches: Batches) -> Batches:
        for part, row, codes in _slices(batches, n_kept):
            scores = np.tile(np.array(start), (part.num_rows, 1))
            p = softmax(_add(scores, rounds, *_held(row, codes, part.num_rows, words, trees)))
            offsets = pa.array(np.arange(part.num_rows + 1) * len(start), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=[*part.schema.names[:n_kept], name])

    return run


def best_splits(sums: DataFrame, bins: int, *, l2: float, least_rows: int, least_curvature: float) -> DataFrame:
    """(class, node, g, h, n, best) of summed histograms: the node's sums, and its best split (gain, code, and what goes right),
    null if none improves it."""
    node = ["class", "node"]
    total = sums.where("code = -1").select(*node, "g", "h", "n")
    above = Window.partitionBy(*node, F.floor(F.col("code") / bins)).orderBy(F.desc("code")).rowsBetween(Window.unboundedPreceding, 0)
    right = sums.where("code >= 0").select(*node, "code", *(F.sum(c).over(above).alias(f"{c}r") for c in "ghn"))
    both = right.join(total, node).select("*", *((F.col(c) - F.col(f"{c}r")).alias(f"{c}l") for c in "ghn"))

    def score(g: str, h: str) -> F.Column:
        return F.try_divide(F.col(g).cast("double") * F.col(g).cast("double"), F.col(h).cast("double") + l2 * UNIT)

    gain = score("gr", "hr") + score("gl", "hl") - score("g", "h")
    least = int(least_curvature * UNIT)
    fits = both.where((F.col("nr") >= least_rows) & (F.col("nl") >= least_rows) & (F.col("hr") >= least) & (F.col("hl") >= least)).withColumn("gain", gain).where("gain > 0")
    best = fits.groupBy(*node).agg(F.max(F.struct("gain", (-F.col("code")).alias("minus"), "gr", "hr")).alias("best"))
    return total.join(best, node, "left")


def fit_boosted(rows: DataFrame, words: Words, label_col: str, *, id_col: str = "id", text_col: str = "content_text", rounds: int = 60, depth: int = 4, leaves: int = 15, rate: float = 0.1, l2: float = 0.0, least_rows: int = 1, least_curvature: float = 1e-3, rewrite: int = 8, codes: DataFrame | None = None) -> Boosted:
    """A model of a label column (rows without a label are left out). There are few classes; their names come to the driver.
    ``codes`` are the rows' codes if they are known already."""
    ship(rows.sparkSession)
    labelled = rows.where(F.col(label_col).isNotNull())
    counted = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(label_col).collect()
    if not counted:
        raise ValueError("there are no rows with a label")
    classes, n = [r[0] for r in counted], np.array([r["n"] for r in counted], np.float64)
    start = np.log(n / n.sum()).tolist()
    if len(classes) == 1:
        return Boosted(classes, start, [], words)
    of_class = F.array_position(F.array(*map(F.lit, classes)), F.col(label_col)).cast("int") - 1
    known = words.codes(labelled, id_col=id_col, text_col=text_col) if codes is None else codes
    coded = known.join(labelled.select(id_col, of_class.alias("target")), id_col)
    schema = "target int, codes array<int>, scores array<double>"
    data = written(coded.select("target", "codes", F.array(*map(F.lit, start)).alias("scores")), "boosting")
    size = words.size, words.bins
    done: list[list[Tree]] = []
    recent: list[list[Tree]] = []
    for _ in range(rounds):
        growing = [Tree(depth) for _ in classes]
        open_nodes = [[1] for _ in classes]
        held = [1] * len(classes)
        for level in range(depth):
            parts = data.mapInArrow(_histograms(recent, growing, open_nodes, size), "class int, node int, code int, g long, h long, n long")
            sums = parts.groupBy("class", "node", "code").agg(*(F.sum(c).alias(c) for c in "ghn"))
            found = best_splits(sums, words.bins, l2=l2, least_rows=least_rows, least_curvature=least_curvature).collect()
            open_nodes = [[] for _ in classes]
            for r in sorted(found, key=lambda r: (r["class"], -(r["best"]["gain"] if r["best"] else 0.0), r["node"])):
                tree, k, node, best = growing[r["class"]], r["class"], r["node"], r["best"]
                if level == 0:
                    tree.value[1] = -rate * r["g"] / max(r["h"] + l2 * UNIT, 1.0)
                if best is None or held[k] == leaves:
                    continue
                held[k] += 1
                tree.feature[node], tree.bin[node] = divmod(-best["minus"], words.bins)
                for child, g, h in ((2 * node + 1, best["gr"], best["hr"]), (2 * node, r["g"] - best["gr"], r["h"] - best["hr"])):
                    tree.value[child] = -rate * g / (h + l2 * UNIT)
                open_nodes[k] += [2 * node, 2 * node + 1]
            if not any(open_nodes):
                break
        done.append(growing)
        recent.append(growing)
        if len(recent) == rewrite and len(done) < rounds:
            data = written(data.mapInArrow(_scored(recent, len(classes), size), schema), "boosting")
            recent = []
    return Boosted(classes, start, done, words)


@dataclass
class Heads:
    """The three models of a live decision."""

    labels: Boosted
    needs_llm: Boosted
    disagreement: Boosted


def train_heads(rows: DataFrame, *, label_col: str = "label", needs_llm: str = "used_inline_llm", disagreement: str = "disagreement", id_col: str = "id", text_col: str = "content_text", most: int = 12_000, **options: float) -> Heads:
    """Models of the label and of the two flags (null counts as no) over the same words."""
    labelled = rows.where(F.col(label_col).isNotNull())
    words = fit_words(labelled, id_col=id_col, text_col=text_col, most=most)
    flags = labelled.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in (needs_llm, disagreement)})
    own = {"id_col": id_col, "text_col": text_col, "codes": written(words.codes(labelled, id_col=id_col, text_col=text_col), "codes"), **options}
    return Heads(fit_boosted(labelled, words, label_col, **own), fit_boosted(flags, words, needs_llm, **own), fit_boosted(flags, words, disagreement, **own))


def predict_heads(rows: DataFrame, heads: Heads, *, id_col: str = "id", text_col: str = "content_text", most: int = 5, listed: int = 10) -> DataFrame:
    """Adds top_label, top_probability, top_labels (the best ``most``), label_probabilities (a map of the best ``listed``),
    needs_llm_probability and disagreement_risk. Equal probabilities: the smaller label."""
    ship(rows.sparkSession)
    coded = heads.labels.words.codes(rows, id_col=id_col, text_col=text_col)
    scored = heads.labels.probabilities(coded.withColumn("held", F.col("codes")), "p_label").withColumnRenamed("held", "codes")
    for model, name in ((heads.needs_llm, "p_llm"), (heads.disagreement, "p_differs")):
        scored = model.probabilities(scored.withColumn("held", F.col("codes")), name).withColumnRenamed("held", "codes")
    names = F.array(*map(F.lit, heads.labels.classes))
    each = F.transform("p_label", lambda p, i: F.struct(p.alias("p"), (-i).alias("minus"), F.get(names, i).alias("label")))
    ranked = F.slice(F.sort_array(each, asc=False), 1, max(most, listed))

    def yes(model: Boosted, p: str) -> F.Column:
        return F.col(p)[model.classes.index(True)] if True in model.classes else F.lit(0.0)

    top = scored.withColumn("ranked", ranked).select(
        id_col,
        F.col("ranked")[0]["label"].alias("top_label"),
        F.col("ranked")[0]["p"].alias("top_probability"),
        F.transform(F.slice("ranked", 1, most), lambda r: r["label"]).alias("top_labels"),
        F.map_from_entries(F.transform(F.slice("ranked", 1, listed), lambda r: F.struct(r["label"], r["p"]))).alias("label_probabilities"),
        yes(heads.needs_llm, "p_llm").alias("needs_llm_probability"),
        yes(heads.disagreement, "p_differs").alias("disagreement_risk"),
    )
    return rows.join(top, id_col)
