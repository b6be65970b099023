"""The most similar vectors of every vector: partitioned search over anisotropic four-bit codes, with exact reranking.

A bounded sample of each space trains spherical k-means leaves and product-quantisation codebooks of 16 centroids per four
dimensions, on the executors. A vector is coded by its residual to its leaf, as direction and length, so that vectors that lie close
together are told apart as well as others. The quantisation is score-aware: an error along the residual, which changes large inner products,
costs more than one across it. Every vector is stored in its nearest leaf and searches that leaf and the next ones that are about as near:
lookup tables score the codes of the leaf, and the best ones are reranked by exact cosine. A leaf that holds too many rows is a space of its
own, with its own sample and leaves, and so on down.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.session import broadcast_if_small, cut_lineage, spread

#: Dimensions per four-bit code.
SUB = 4
#: Inner products from which errors along the vector are weighed (as a share of the norm).
SCORE_THRESHOLD = 0.2
#: A further leaf is searched if its cosine comes so near to that of the nearest leaf.
PROBE_MARGIN = 0.1
#: Bytes of vectors that one task holds, and of leaves and codebooks that are broadcast at once.
TASK_BYTES, BROADCAST_BYTES = 64 << 20, 128 << 20


@dataclass
class SpaceIndex:
    """Leaves and codebooks of one space: leaves (L, d), books (d / SUB, 16, SUB), weight of the error along the vector.

    Leaves are in double precision: of vectors that are nearly equal single precision would not tell the nearest leaf.
    """

    leaves: np.ndarray
    books: np.ndarray
    weight: float
    split: np.ndarray  # (L,): whether the leaf is to be a space of its own
    chunks: np.ndarray  # (L,): else, into how many chunks of stored rows and of searching rows it is cut

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Four-bit codes (n, d / SUB) of unit vectors by coordinate descent on the anisotropic loss."""
        n, parts = len(x), self.books.shape[0]
        xs = x.reshape(n, parts, SUB)
        plain = ((self.books**2).sum(-1)[None] - 2 * np.einsum("nps,pcs->npc", xs, self.books))  # squared error up to a constant
        along = np.einsum("nps,pcs->npc", xs, self.books)
        codes = plain.argmin(-1)
        at = np.arange(n)
        got = np.take_along_axis(along, codes[..., None], 2)[..., 0]
        total = got.sum(1)
        for _ in range(rounds):
            for p in range(parts):
                rest = 1.0 - (total - got[:, p])
                loss = plain[:, p] + (self.weight - 1) * (rest[:, None] - along[:, p]) ** 2
                codes[:, p] = loss.argmin(1)
                new = along[at, p, codes[:, p]]
                total += new - got[:, p]
                got[:, p] = new
        return codes.astype(np.uint8)

    def nearest_leaves(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leaves of each vector, nearest first, and their cosines."""
        count, out, cosines = min(count, len(self.leaves)), [], []
        for part in _blocks(x, len(self.leaves)):
            scores = part @ self.leaves.T
            best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
            cos = np.take_along_axis(scores, best, 1)
            order = np.lexsort((best, -cos), axis=1)
            out.append(np.take_along_axis(best, order, 1))
            cosines.append(np.take_along_axis(cos, order, 1))
        return np.concatenate(out), np.concatenate(cosines)

    def residuals(self, x: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and lengths of the residuals of vectors to their leaves."""
        rest = x - self.leaves[leaf]
        size = np.linalg.norm(rest, axis=1)
        return rest / np.maximum(size, 1e-12)[:, None], size.astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Lookup tables (n, pairs, 256): the score of each pair of neighbouring four-bit codes against each query."""
        lut = np.einsum("nps,pcs->npc", q.reshape(len(q), -1, SUB), self.books).astype(np.float32)
        if lut.shape[1] % 2:
            lut = np.concatenate([lut, np.zeros_like(lut[:, :1])], 1)
        return (lut[:, 0::2, :, None] + lut[:, 1::2, None, :]).reshape(len(q), -1, 256)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes per byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
        return (codes[:, 0::2] << 4) | codes[:, 1::2]


def _blocks(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Rows in blocks of at most about four million scores against so many leaves."""
    step = max(64, 4_000_000 // max(1, width))
    return [x[i : i + step] for i in range(0, len(x), step)]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    norm = np.sqrt((raw.astype(np.float64) ** 2).sum(1, keepdims=True))
    return raw / norm


def _padded(x: np.ndarray) -> np.ndarray:
    spare = -x.shape[1] % SUB
    return np.concatenate([x, np.zeros((len(x), spare), x.dtype)], 1) if spare else x


def train_space(sample: np.ndarray, rows: int, *, leaf_rows: int, max_leaf: int, max_chunk: int, seed: int = 5, rounds: int = 12, book_rows: int = 8192) -> SpaceIndex:
    """Leaves and codebooks from a sample of unit vectors; rows is the size of the whole space, book_rows bounds what fits the codebooks.

    A leaf that would hold more than max_leaf rows is marked as a space of its own, unless it has most of its space, as vectors without a
    difference have: such a leaf, and one of more than max_chunk rows that the sample missed, is cut into chunks.
    """
    rng = np.random.default_rng(seed)
    x = _padded(sample)
    n, d = x.shape
    count = int(min(max(1, ceil(rows / leaf_rows)), max(1, n // 8)))
    leaves = x[rng.choice(n, count, replace=False)].copy()
    for _ in range(rounds if count > 1 else 1):
        near = np.concatenate([(part @ leaves.T).argmax(1) for part in _blocks(x, count)])
        sums = np.zeros((count, d), np.float64)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=count) == 0
        sums[empty] = x[rng.choice(n, int(empty.sum()))]
        leaves = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = np.concatenate([(part @ leaves.T).argmax(1) for part in _blocks(x, count)])
    share = np.bincount(near, minlength=count) / n
    split = (share * rows > max_leaf) & (share < 0.5)
    chunks = np.where(split, 1, np.ceil(share * rows / max_chunk).clip(1)).astype(np.int64)
    parts = d // SUB
    t = SCORE_THRESHOLD**2
    index = SpaceIndex(leaves, np.zeros((parts, 16, SUB), np.float32), np.float32(max(1.0, (d - 1) * t / (1 - t))), split, chunks)
    own = rng.permutation(n)[:book_rows]
    x, n = index.residuals(x[own], near[own])[0].astype(np.float32), len(own)
    xs = x.reshape(n, parts, SUB)
    for p in range(parts):
        book = xs[rng.choice(n, 16, replace=n < 16), p].copy()
        for _ in range(6):
            near = ((book**2).sum(1)[None] - 2 * xs[:, p] @ book.T).argmin(1)
            for c in range(16):
                if (near == c).any():
                    book[c] = xs[near == c, p].mean(0)
        index.books[p] = book
    eye, extra = np.eye(SUB), index.weight - 1
    for _ in range(3):
        codes = index.encode(x)
        got = np.take_along_axis(np.einsum("nps,pcs->npc", xs, index.books), codes[..., None].astype(int), 2)[..., 0]
        for p in range(parts):
            rest = 1.0 - (got.sum(1) - got[:, p])  # what the other parts leave of the inner product with itself
            for c in range(16):
                own = codes[:, p] == c
                if own.sum() >= SUB:
                    u = xs[own, p].astype(np.float64)
                    left = own.sum() * eye + extra * u.T @ u
                    index.books[p, c] = np.linalg.solve(left, u.sum(0) + extra * (u * rest[own, None]).sum(0))
            got[:, p] = (xs[:, p] * index.books[p][codes[:, p]]).sum(1)
    return index


def search_leaf(index: SpaceIndex, leaf: int, q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, codes: np.ndarray, sizes: np.ndarray, k: int, rerank: int, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, other id, cosine): for each query the k best of this leaf with at least min_cos, by scan and exact rerank."""
    out_q, out_o, out_c = [], [], []
    width = min(len(d_ids), rerank + 1)
    columns = [codes[:, j].astype(np.intp) for j in range(codes.shape[1])]
    lengths = np.sqrt(np.einsum("nd,nd->n", d, d, dtype=np.float64))
    block = int(min(512, max(16, TASK_BYTES // (8 * width * q.shape[1]))))
    for start in range(0, len(q_ids), block):
        rows = slice(start, start + block)
        own = _unit(q[rows])
        tables = index.tables((_padded(own) - index.leaves[leaf]).astype(np.float32))
        scores = np.take(tables[:, 0], columns[0], axis=1)
        for j in range(1, len(columns)):
            scores += np.take(tables[:, j], columns[j], axis=1)
        scores = scores * sizes - sizes**2 / 2  # the inner product, but for what is the same in all of the leaf
        best = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < len(d_ids) else np.broadcast_to(np.arange(len(d_ids)), scores.shape)
        cos = np.einsum("nd,nrd->nr", own, d[best].astype(np.float64)) / lengths[best]
        ids = d_ids[best]
        cos = np.where(ids == q_ids[rows, None], -2.0, cos)
        order = np.lexsort((ids, -cos), axis=1)[:, :k]
        cos, ids = np.take_along_axis(cos, order, 1), np.take_along_axis(ids, order, 1)
        keep = cos >= min_cos - 1e-9
        out_q.append(np.broadcast_to(q_ids[rows, None], ids.shape)[keep])
        out_o.append(ids[keep])
        out_c.append(cos[keep])
    return np.concatenate(out_q), np.concatenate(out_o), np.concatenate(out_c)


def _direction_hash(vectors: pd.Series) -> pd.Series:
    """A hash of the direction of each vector, to five digits: equal for vectors that differ in length only."""
    out = np.zeros(len(vectors), np.int64)
    sizes = vectors.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        digits = np.rint(_unit(np.stack(vectors.iloc[at].to_numpy())) * 1e5).astype(np.int64)
        factors = np.random.default_rng(int(d)).integers(-(1 << 62), 1 << 62, d) * 2 + 1
        out[at] = (digits * factors).sum(1)
    return pd.Series(out)


def usable(vector: Column, dim: Column) -> Column:
    """Not null, length equal to dim, all values finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def _train(sampled: DataFrame, **bounds: int) -> dict[str, SpaceIndex]:
    """An index per space, each trained by a task on its sample."""
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        index = train_space(_unit(np.stack(part["vec"].to_numpy())), int(part["rows"].iloc[0]), **bounds)
        return pd.DataFrame({"space": [key[0]], "index": [pickle.dumps(index)]})

    return {r["space"]: pickle.loads(r["index"]) for r in sampled.groupBy("space").applyInPandas(run, "space string, index binary").toLocalIterator()}


def _level(todo: DataFrame, sizes: dict[str, int], level: int, *, k: int, min_cos: float, probes: int, rerank: int, leaf_rows: int, train_rows: int, max_leaf: int, max_chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """The hits (id, other, cos) in the leaves of some spaces, and the rows of the leaves that become spaces of their own."""
    spark = todo.sparkSession
    # Of each space about train_rows vectors by the hash of the id, of a small one all.
    wanted = [(s, n, min(1.0, train_rows / n)) for s, n in sizes.items()]
    cuts = broadcast_if_small(spark.createDataFrame(wanted, "space string, rows long, cut double"))
    picked = F.pmod(F.xxhash64("id", F.lit(3 + level)), F.lit(1 << 30)) < F.col("cut") * (1 << 30)
    shape = {"leaf_rows": leaf_rows, "max_leaf": max_leaf, "max_chunk": max_chunk}
    indexes = _train(todo.join(cuts, "space").filter(picked).select("space", "rows", "vec"), **shape)
    for space in sizes.keys() - indexes.keys():  # of its few ids the hash picked none
        part = todo.filter(F.col("space") == space).select("vec").limit(256).toPandas()
        indexes[space] = train_space(_unit(np.stack(part["vec"].to_numpy())), sizes[space], **shape)
    shared = spark.sparkContext.broadcast(indexes)  # at most BROADCAST_BYTES, see similar_pairs

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, rows in batch.groupby("space", sort=False):
                index = shared.value[space]
                given = np.stack(rows["vec"].to_numpy()).astype(np.float32)
                wide, ids = _padded(_unit(given)), rows["id"].to_numpy()
                near, cosines = index.nearest_leaves(wide, probes)
                directions, size = index.residuals(wide, near[:, 0])
                codes = index.packed(index.encode(directions.astype(np.float32)))
                stored = np.array([c.tobytes() + s.tobytes() for c, s in zip(codes, size, strict=True)], dtype=object)
                raw = np.array([v.tobytes() for v in given], dtype=object)
                for j in range(near.shape[1]):
                    going = cosines[:, j] >= cosines[:, 0] - PROBE_MARGIN
                    leaf, parts = near[going, j], index.chunks[near[going, j]]
                    own = (ids[going] * 0x9E3779B1 >> 7) % parts
                    for c in range(int(parts.max(initial=0))):
                        # A leaf in chunks has a part for each two of them; a row is stored in its row of parts and searches its column.
                        at = parts > c
                        put = lambda part, code: pd.DataFrame({"space": space, "leaf": leaf[at], "part": part, "split": index.split[leaf[at]], "id": ids[going][at], "vec": raw[going][at], "code": code})  # noqa: B023, E731
                        if j == 0:
                            yield put(own[at] * parts[at] + c, stored[at])
                            yield put(c * parts[at] + own[at], None)[own[at] != c]
                        else:
                            yield put(c * parts[at] + own[at], None)

    placed = todo.select("space", "id", "vec").mapInPandas(assign, "space string, leaf int, part long, split boolean, id bigint, vec binary, code binary")

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index, leaf = shared.value[key[0]], key[1]
        rows = rows.drop_duplicates("id")  # redelivered
        home = rows["code"].notna().to_numpy()
        # In a part off the diagonal those that search are not those that are stored.
        searching = np.ones(len(rows), bool) if key[2] % (index.chunks[leaf] + 1) == 0 else ~home
        if not home.any() or not searching.any():
            return pd.DataFrame({"id": [], "other": [], "cos": []})
        ids, vectors = rows["id"].to_numpy(), np.stack([np.frombuffer(v, np.float32) for v in rows["vec"]])
        coded = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"][home]])
        sizes = np.ascontiguousarray(coded[:, -4:]).view(np.float32)[:, 0]
        q, o, c = search_leaf(index, leaf, ids[searching], vectors[searching], ids[home], vectors[home], coded[:, :-4], sizes, k, rerank, min_cos)
        return pd.DataFrame({"id": q, "other": o, "cos": c})

    def numbers(raw: pd.Series) -> pd.Series:
        return raw.map(lambda v: np.frombuffer(v, np.float32))

    # Parts are spread over tasks of about 8 MB whatever the size of the input.
    expected = sum(n * (100 + 4 * indexes[s].leaves.shape[1]) * probes for s, n in sizes.items())
    tasks, keys = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(expected / (8 << 20))), ["space", "leaf", "part"]
    found = placed.filter("not split").drop("split").repartition(tasks, *keys).groupBy(*keys).applyInPandas(scan, "id bigint, other bigint, cos double")
    if not any(x.split.any() for x in indexes.values()):
        return found, None
    inner = F.concat_ws("/", "space", F.col("leaf").cast("string")).alias("space")
    return found, cut_lineage(placed.filter("split").select(inner, "id", F.pandas_udf(numbers, "array<float>")("vec").alias("vec")))


def similar_pairs(df: DataFrame, *, id_col: str, model_col: str, dim_col: str, vector_col: str, k: int = 5, min_cos: float = 0.9, probes: int = 3, rerank: int = 32, leaf_rows: int = 1000, train_rows: int = 16_384, max_leaf: int = 8000, max_chunk: int = 8000) -> DataFrame:
    """Pairs id_a < id_b of one space with cosine >= min_cos, one of them among the k most similar of the other.

    A space is a model and dimension. All usable rows are indexed and all search. A space has a leaf per leaf_rows vectors, as far as a
    sample of train_rows of its vectors gives eight to each; the sample fits leaves and codebooks, and bounds nothing else. A leaf that would hold more than max_leaf rows
    becomes a space of its own, so leaves stay small at any size. A hit counts for both of its rows. Of equal similarities the smaller ids count as more similar. Vectors of one
    direction (to five digits) of which there are more than k + 1 are reduced to the k + 1 smallest ids before the search; each further one
    pairs with the k smallest. Leaves of vectors without a difference are searched in chunks of max_chunk stored and max_chunk searching rows. Repeated rows of one id count once.
    Null ids, models and unusable vectors have no pairs; an empty table gives none.
    """
    spark = df.sparkSession
    base = df.filter(F.col(id_col).isNotNull() & F.col(model_col).isNotNull() & usable(F.col(vector_col), F.col(dim_col)))
    base = base.select(F.concat_ws("/", F.col(dim_col).cast("string"), F.col(model_col)).alias("space"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
    hashed = base.withColumn("u", F.pandas_udf(_direction_hash, "bigint")("vec")).select("space", "id", "vec", F.xxhash64("space", "u").alias("h"), F.hash("space", F.size("vec"), "u").alias("g"))

    # Copies: only hashes are shuffled, and only groups beyond k + 1 are looked at again.
    groups = cut_lineage(hashed.groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h", "g"))
    copies_pairs = None
    if not groups.isEmpty():
        members = hashed.join(broadcast_if_small(groups), ["h", "g"], "left_semi").select("h", "g", "id").distinct()
        first = Window.partitionBy("h", "g").orderBy("id")
        leaders = cut_lineage(members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1))
        last = leaders.filter(F.col("r") == k + 1).select("h", "g", F.col("id").alias("last"))
        extras = members.join(broadcast_if_small(last), ["h", "g"]).filter("id > last")
        copies_pairs = extras.select("h", "g", F.col("id").alias("id_b")).join(broadcast_if_small(leaders.filter(F.col("r") <= k).select("h", "g", F.col("id").alias("id_a"))), ["h", "g"]).select("id_a", "id_b")
        base = hashed.join(broadcast_if_small(last), ["h", "g"], "left").filter("last is null or id <= last").select("space", "id", "vec")

    bounds = {"k": k, "min_cos": min_cos, "probes": probes, "rerank": rerank, "leaf_rows": leaf_rows, "train_rows": train_rows, "max_leaf": max_leaf, "max_chunk": max_chunk}
    todo, level, hits = spread(base), 0, []
    while todo is not None:
        counted = todo.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
        waves, room = [[]], BROADCAST_BYTES
        for r in counted.toLocalIterator():
            need = 8 * (r["d"] + SUB) * (16 + min(ceil(r["n"] / leaf_rows), train_rows // 8 + 1))
            if need > room and waves[-1]:
                waves.append([])
                room = BROADCAST_BYTES
            room -= need
            waves[-1].append((r["space"], r["n"]))
        deeper = None
        for wave in filter(None, waves):
            own = todo if len(waves) == 1 else todo.join(F.broadcast(spark.createDataFrame([(s,) for s, _ in wave], "space string")), "space", "left_semi")
            found, rest = _level(own, dict(wave), level, **bounds)
            hits.append(found)
            deeper = rest if deeper is None else deeper if rest is None else deeper.unionByName(rest)
        todo, level = deeper, level + 1
    if not hits:
        return spark.createDataFrame([], "id_a bigint, id_b bigint")
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    both = found.select(F.explode(F.array(F.struct("id", "other", "cos"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "cos"))).alias("p")).select("p.*")
    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    top = both.groupBy("id", "other").agg(F.max("cos").alias("cos")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    pairs = top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    if copies_pairs is not None:
        pairs = pairs.unionByName(copies_pairs)
    return pairs.distinct()
