"""Operator 1: near duplicates of embeddings by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship_package
from .components import connected_components

#: Vectors that all codebooks are fitted on (at most twice as many, with LEAST_SHARE for each), and codebooks at most; every vector is indexed.
SAMPLE = 20_000
LEAST_SHARE = 512
STRATA = 64
#: Vectors of a label per cell of the product grid, which the number of codewords follows from, and the most codewords a half.
CELL_ROWS = 256
CODEWORDS = 1024
THRESHOLD = 0.93
TARGET_RECALL = 0.995
#: Vectors of a length in the sample that its codebooks need.
LEAST_SAMPLE = 16
#: Vectors of one cell that are compared at once.
BLOCK = 2048
SEED = 7


@dataclass(frozen=True)
class MultiIndex:
    """A codebook for each half of the vectors, and how far beyond its own cell a query looks."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the codewords, less those to the nearest."""
        out = []
        for half, book in zip(np.split(vectors, [self.first.shape[1]], axis=1), (self.first, self.second)):
            d = (half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1)
            out.append(d - d.min(1, keepdims=True))
        return out[0], out[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = self.distances(vectors)
        return first.argmin(1) * len(self.second) + second.argmin(1)

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """The cells that a query with these distances visits, nearest first (multi-sequence traversal).

        Rows and columns are in order of distance; a cell enters the queue once its neighbours nearer in either order were
        visited, and the walk ends at the first cell beyond the reach.
        """
        import heapq

        rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b = first[rows].tolist(), second[columns].tolist()
        queue, done, out = [(a[0] + b[0], 0, 0)], np.zeros(len(a), dtype=int), []
        while queue:
            distance, i, j = heapq.heappop(queue)
            if distance > self.reach:
                break
            out.append(int(rows[i]) * len(b) + int(columns[j]))
            done[i] = j + 1
            if i + 1 < len(a) and (j == 0 or done[i + 1] == j):
                heapq.heappush(queue, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))
        return out


def _codebook(halves: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds."""
    book = halves[rng.choice(len(halves), min(words, len(halves)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((book**2).sum(1) - 2 * halves @ book.T).argmin(1)
        for k in range(len(book)):
            if (nearest == k).any():
                book[k] = halves[nearest == k].mean(0)
    return book


def fit(sample: np.ndarray, words: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks from a sample of unit vectors, and the reach that finds a partner at the threshold with the target recall.

    The reach is set on the hardest partners that count: each sampled vector gets one in a random direction whose cosine is
    the threshold itself. Nearer partners are found more often.
    """
    rng = np.random.default_rng(SEED)
    middle = sample.shape[1] // 2
    index = MultiIndex(_codebook(sample[:, :middle], words, rng), _codebook(sample[:, middle:], words, rng), 0.0)
    aside = rng.normal(size=sample.shape)
    aside -= (aside * sample).sum(1, keepdims=True) * sample
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    partners = threshold * sample + np.sqrt(1 - threshold**2) * aside
    first, second = index.distances(sample)
    cells, rows = index.cells(partners), np.arange(len(sample))
    needed = first[rows, cells // len(index.second)] + second[rows, cells % len(index.second)]
    return MultiIndex(index.first, index.second, float(np.quantile(needed, target)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _links_in_block(queries: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    return queries @ rows.T >= threshold


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that connect what the pairs a, b connect: each end with the smallest id of its component."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(ids))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least.copy())
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(ids))
    return np.column_stack((ids[moved], ids[label[moved]]))


def tiers(classes: DataFrame, cell_rows: int) -> DataFrame:
    """(label, dims, members, tier): vectors of each label and length, and how often that many hold four times what two cells do.

    Labels of one tier differ in size by a factor of four at most, so codebooks for the one suit the other.
    """
    sizes = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("members"))
    return sizes.withColumn("tier", F.greatest(F.lit(0), F.floor(F.log(F.col("members") / cell_rows) / F.log(F.lit(4.0)))).cast("int"))


def fitted(tiered: DataFrame, sizes: DataFrame, cell_rows: int, threshold: float, target: float) -> dict[tuple[int, int], MultiIndex]:
    """An index for each length and tier, the STRATA most frequent ones; codewords follow from the size of the label that a row is in."""
    found = sizes.groupBy("dims", "tier").agg(F.sum("members").alias("n"), (F.sum(F.col("members").cast("double") ** 2) / F.sum("members")).alias("mean"))
    strata = {(r["dims"], r["tier"]): r for r in found.where((F.col("dims") >= 2) & (F.col("n") >= LEAST_SAMPLE)).orderBy(F.desc("n"), "dims", "tier").limit(STRATA).collect()}
    if not strata:
        return {}
    share = max(LEAST_SHARE, SAMPLE // len(strata))
    wanted = F.lit(False)
    for (dims, tier), r in strata.items():
        wanted = wanted | ((F.size("v") == dims) & (F.col("tier") == tier) & (F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < -(-share * 1_000_000 // r["n"])))
    drawn = tiered.where(wanted).select("tier", "v").limit(2 * share * len(strata)).toPandas()
    out = {}
    for key, own in drawn.groupby([drawn["v"].map(len), "tier"])["v"]:
        if len(own) >= LEAST_SAMPLE:
            words = int(min(CODEWORDS, max(2, round((strata[key]["mean"] / cell_rows) ** 0.5))))
            out[(int(key[0]), int(key[1]))] = fit(_unit(np.stack(own.to_list()).astype(float)), words, threshold, target)
    return out


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, target: float = TARGET_RECALL) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Vectors of equal labels link at a cosine of the threshold or more. Rows whose vector is null, empty, zero or holds a null
    or a number that is not finite, or whose label or id is null, link with nothing; nor do vectors of different lengths.
    Equal vectors of a label are one class: a group of copies is one point of the index, and counts once per row in n_links.
    Numbers of one dimension only have a sign, so those are two classes. Rows of one id are vectors of their own, which may link
    with each other; a component's name is the smallest id in it. The codebooks come from a bounded sample, chosen by
    a hash, a pair of them for each length and size of label, so a large label is cut finely whatever the others are; vectors of a
    length too rare for that are compared in blocks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    values = F.col(vector_col).cast("array<double>")
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    fine = (
        F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (square > 0) & (square < float("inf"))
    )
    told = F.when(F.size(values) == 1, F.transform(values, F.signum)).otherwise(values)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.col(label_col)).alias("label"), F.when(fine, told).alias("v"))
    # rep names the class, also where ids are repeated.
    classes = checkpoint(rows.where("v is not null").groupBy("label", "v").agg(F.min("id").cast("long").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = checkpoint(tiers(classes, cell_rows))
    large = sizes.where("tier > 0").select("label", F.col("dims").alias("__dims"), "tier")
    tiered = classes.withColumn("__dims", F.size("v")).join(large, ["label", "__dims"], "left").drop("__dims").withColumn("tier", F.coalesce("tier", F.lit(0)))
    indexes = fitted(tiered, sizes, cell_rows, threshold, target)
    shared = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class once as a row of its cell, and once as a query of each cell that it visits."""
        for batch in batches:
            values = batch.column("v").to_pylist()
            at, cell, query = [], [], []
            lengths, tier = np.array([len(v) for v in values]), batch.column("tier").to_numpy(zero_copy_only=False)
            for size, level in sorted(set(zip(lengths.tolist(), tier.tolist()))):
                own = np.flatnonzero((lengths == size) & (tier == level))
                index = shared.value.get((size, level))
                if index is None:
                    for q in (False, True):
                        at += own.tolist()
                        cell += [-1] * len(own)
                        query += [q] * len(own)
                    continue
                first, second = index.distances(_unit(np.array([values[i] for i in own], dtype=float)))
                for k, i in enumerate(own.tolist()):
                    visited = index.visits(first[k], second[k])
                    at += [i] * (1 + len(visited))
                    cell += [visited[0], *visited]
                    query += [False] + [True] * len(visited)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(c) for c in ("label", "tier", "rep", "copies", "v")] + [pa.array(lengths[at] if at else [], pa.int32()), pa.array(cell, pa.int32()), pa.array(query)], names=["label", "tier", "rep", "copies", "v", "dims", "cell", "query"])

    label_kind = classes.schema["label"].dataType.simpleString()
    placed = tiered.select("label", "tier", "rep", "copies", "v").mapInArrow(place, f"label {label_kind}, tier int, rep long, copies long, v array<double>, dims int, cell int, query boolean")
    # A cell of many vectors is compared in blocks of rows against blocks of queries.
    counts = placed.groupBy("label", "dims", "cell").agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("r")).where("r > 0 and q > 0")
    counts = counts.select("label", "dims", "cell", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"n{c}") for c in "qr"))
    dealt = placed.join(counts, ["label", "dims", "cell"])
    salted = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nr"))).cast("int"))
    spread = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("nr")).otherwise(F.col("nq")) - 1)))
    keyed = spread.select(
        "label", "tier", "dims", "cell", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("qb"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("rb"), "query", "rep", "copies", "v"
    )
    keys = ["label", "dims", "cell", "qb", "rb"]

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of a block: counts for either end, and pairs enough to connect what it links.

        A link that only one of its ends finds counts for both; one that both find counts for each end where it queries.
        """
        q, r = frame[frame["query"]], frame[~frame["query"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
        q_ids, r_ids = q["rep"].to_numpy(), r["rep"].to_numpy()
        a, b = (_unit(np.stack(x["v"].to_list()).astype(float)) for x in (q, r))
        i, j = np.nonzero(_links_in_block(a, b, threshold) & (q_ids[:, None] != r_ids[None, :]))
        one_way = np.zeros(len(i), dtype=bool)
        if frame["cell"].iloc[0] >= 0 and len(i):
            index = shared.value[(a.shape[1], int(frame["tier"].iloc[0]))]
            ids, where = np.unique(i, return_inverse=True)
            cells = index.cells(a[ids])[where]
            first, second = index.distances(b)
            words = len(index.second)
            one_way = first[j, cells // words] + second[j, cells % words] > index.reach
        n_q = np.bincount(i, weights=r["copies"].to_numpy()[j], minlength=len(q)).astype("int64")
        n_r = np.bincount(j[one_way], weights=q["copies"].to_numpy()[i[one_way]], minlength=len(r)).astype("int64")
        joined = _forest(q_ids[i], r_ids[j])
        return pd.DataFrame({"rep": np.concatenate((q_ids, r_ids, joined[:, 0])), "n": np.concatenate((n_q, n_r, np.zeros(len(joined), dtype="int64"))), "other": pd.array([None] * (len(q) + len(r)) + joined[:, 1].tolist(), dtype="Int64")}).loc[lambda x: (x["n"] > 0) | x["other"].notna()]

    found = checkpoint(keyed.groupBy(*keys).applyInPandas(verify, "rep long, n long, other long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    rooted = classes.join(links, "rep", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, ["label", "v"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
