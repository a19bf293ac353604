"""Near-duplicate embeddings: exact pairs by cosine, from tiles of vectors in the order of their principal components.

Equal vectors are one class. Classes are put into cells of a tree over the leading principal coordinates; cells whose
boxes are too far apart never meet. Each remaining tile of two blocks adds up the leading coordinates first, bounds the
rest of the product by the norms of what is left, and goes on only for pairs that can still reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connect, connected_components, materialise

THRESHOLD = 0.9
#: The rotation comes from at most so many vectors, the tree from at most PER_CELL for each cell; they steer the work and
#: never the result. Cells grow with the data up to CELLS, as every pair of cells is looked at; then blocks are cut from them.
SAMPLE, CELLS, PER_CELL, LEADING = 4096, 1024, 16, 8
#: A block has at most about so many vectors, and a tile two blocks.
BLOCK = 8192
#: The shares of the sample's energy after which the remaining product is bounded.
ENERGY = (0.55, 0.8)
#: Above the rounding of sums in single precision; what passes the bounds is decided in double precision.
_SLACK = 1e-5


def _tree(coords: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median cuts as a heap: node k has children 2k+1 and 2k+2; each level cuts the coordinate that spreads most."""
    cuts: list[tuple[int, float]] = []
    level = [coords]
    while len(level) < cells:
        following = []
        for own in level:
            dim = int(own.var(axis=0).argmax()) if len(own) else 0
            at = float(np.median(own[:, dim])) if len(own) else 0.0
            cuts.append((dim, at))
            following += [own[own[:, dim] <= at], own[own[:, dim] > at]]
        level = following
    return cuts


def _cell(coords: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    dims, ats = np.array([c[0] for c in cuts], int), np.array([c[1] for c in cuts])
    node = np.zeros(len(coords), int)
    for _ in range((len(cuts) + 1).bit_length() - 1):
        node = 2 * node + 1 + (coords[np.arange(len(coords)), dims[node]] > ats[node])
    return node - len(cuts)


def _unit(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)  # first to a common scale, so that no square overflows or vanishes
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stages_of(values: np.ndarray) -> list[int]:
    """After how many leading coordinates to look at the bounds; the last is all of them."""
    share = np.cumsum(np.maximum(values, 0)) / max(values.sum(), 1e-300)
    return sorted({min(int(np.searchsorted(share, e)) + 1, len(values)) for e in ENERGY} | {len(values)})


def tile_links(x: np.ndarray, y: np.ndarray, basis: np.ndarray, stages: list[int], threshold: float, same: bool, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit rows x, y with product at least the threshold; only i < j if both are the same block."""
    u = (x @ basis).astype(np.float32)
    v = u if same else (y @ basis).astype(np.float32)
    tail_u = [np.sqrt(np.maximum((u[:, d:] ** 2).sum(axis=1), 0)) for d in stages]
    tail_v = [np.sqrt(np.maximum((v[:, d:] ** 2).sum(axis=1), 0)) for d in stages]
    for p in range(0, len(u), step):
        for q in range(p if same else 0, len(v), step):
            a, b = slice(p, p + step), slice(q, q + step)
            part = u[a, : stages[0]] @ v[b, : stages[0]].T
            part_bound = np.multiply.outer(tail_u[0][a], tail_v[0][b])
            part_bound += part
            i, j = np.divmod(np.flatnonzero(part_bound >= np.float32(threshold - _SLACK)), part.shape[1])
            if same and p == q:
                i, j = i[i < j], j[i < j]
            if len(i) > part.size // 8:
                full = x[a] @ (x if same else y)[b].T
                keep = full[i, j] >= threshold
                i, j = i[keep], j[keep]
            elif len(i):
                product = part[i, j]
                for k, (d, e) in enumerate(zip(stages, stages[1:])):
                    product = product + np.einsum("ij,ij->i", u[p + i, d:e], v[q + j, d:e])
                    keep = product + tail_u[k + 1][p + i] * tail_v[k + 1][q + j] >= threshold - _SLACK
                    i, j, product = i[keep], j[keep], product[keep]
                keep = np.einsum("ij,ij->i", x[p + i], (x if same else y)[q + j]) >= threshold
                i, j = i[keep], j[keep]
            if len(i):
                yield p + i, q + j


def _matched(basis: np.ndarray, stages: list[int], threshold: float, kind: type):
    def match(table: pa.Table) -> pa.Table:
        side, ids, n = (table.column(c).to_numpy() for c in ("side", "id", "n"))
        order = np.argsort(side, kind="stable")
        ids, n, raw = ids[order], n[order], table.column("vec").take(pa.array(order)).to_pylist()
        units = _unit(raw, kind)
        # Sides: 0 in a tile of one block with itself, else 1 and 2; a side can be empty.
        same = bool((side == 0).all())
        cut = len(ids) if same else int((side == 1).sum())
        x, y, off = units[:cut], units[cut:], 0 if same else cut
        count, a, b = np.zeros(len(ids), np.int64), [], []
        root = np.arange(len(ids))
        for i, j in tile_links(x, y, basis, stages, threshold, same) if same or len(x) and len(y) else ():
            j = j + off
            count += np.bincount(i, weights=n[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=n[i], minlength=len(ids)).astype(np.int64)
            ra, rb = root[i], root[j]
            differ = ra != rb
            a.append(ra[differ])
            b.append(rb[differ])
            if sum(map(len, a)) > 1 << 18:  # bounded memory: fold what has been found
                root = connect(len(ids), np.concatenate([*a, np.arange(len(ids))]), np.concatenate([*b, root]))
                a, b = [], []
        root = connect(len(ids), np.concatenate([*a, np.arange(len(ids))]), np.concatenate([*b, root]))
        hit = np.flatnonzero(count)
        return pa.table({"id": pa.array(ids[hit]), "root": pa.array(ids[root[hit]]), "links": pa.array(count[hit])})

    return match


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Of (vec_id, embedding): vec_id, n_links (other rows at the threshold or above), component_id, kept.

    One row per input row, repeated rows included: equal vectors link with each other. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and are kept. Vectors of unequal length are compared as if
    padded with zeros. A null vec_id is kept; it is no component's smallest id unless the component has no other. kept
    says whether vec_id is the component's smallest. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = rows.select("vec_id", F.when(fine, F.transform("embedding", lambda x: x + F.lit(0.0))).alias("embedding"))
    classes = materialise(rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("id", F.monotonically_increasing_id()), "embed-classes")
    total, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    # Few vectors still make a hundred tiles or so, to spread over the tasks.
    wanted = min(CELLS, max(3 * total // block, min(16, total // 640)))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, PER_CELL * wanted)).select("embedding").collect()
    units = _unit([np.pad(np.array(r[0]), (0, width - len(r[0]))).tobytes() for r in sample])
    values, vectors_ = np.linalg.eigh(units.T @ units)
    basis = np.ascontiguousarray(vectors_[:, ::-1])
    lead = min(LEADING, width)
    stages = stages_of(values[::-1])
    cells = 1 << max(0, min(wanted, len(sample) // PER_CELL).bit_length() - 1)
    # Single-precision input travels as it is; its values are the same in double precision.
    kind = np.float32 if "array<float>" == vectors.schema["embedding"].dataType.simpleString() else np.float64
    cuts = _tree(units @ basis[:, :lead], cells)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                padded = [np.pad(np.array(v.as_py(), kind), (0, width - len(v))).tobytes() for v in batch.column(2)]
                coords = _unit(padded, kind) @ basis[:, :lead]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(padded, pa.binary()), pa.array(_cell(coords, cuts), pa.int64()), pa.array(list(coords), pa.list_(pa.float64()))], ["id", "n", "vec", "cell", "lead"])

    placed = materialise(classes.select("id", "n", "embedding").mapInArrow(place, "id long, n long, vec binary, cell long, lead array<double>"), "embed-placed")
    # The boxes number at most CELLS, so the driver can hold them.
    edges_of = [f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(lead) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("size"), *edges_of).collect()
    lo = np.array([[b[f"lo{k}"] for k in range(lead)] for b in boxes])
    hi = np.array([[b[f"hi{k}"] for k in range(lead)] for b in boxes])
    reach = 2 - 2 * threshold + _SLACK  # the squared distance of unit vectors at the threshold
    meets = []
    for k in range(len(boxes)):
        gap = np.maximum(0, np.maximum(lo - hi[k], lo[k] - hi))
        meets.append(np.flatnonzero((gap**2).sum(axis=1) <= reach))
    # At most CELLS times CELLS rows of four numbers.
    mine, theirs, names = np.repeat(np.arange(len(boxes)), list(map(len, meets))), np.concatenate(meets), np.array([b["cell"] for b in boxes])
    chunks = np.array([-(-b["size"] // block) for b in boxes])
    table = pa.table({"cell": names[mine], "parts": chunks[mine], "other": names[theirs], "others": chunks[theirs]})
    pairs = F.broadcast(classes.sparkSession.createDataFrame(table))
    own = placed.select("id", "n", "vec", "cell").join(pairs, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")))
    own = own.withColumn("other_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("chunk").cast("long").alias("k")), F.struct(F.col("other").cast("long").alias("c"), F.col("other_chunk").cast("long").alias("k"))
    tiled = own.select("id", "n", "vec", F.least(mine, theirs).alias("t"), F.greatest(mine, theirs).alias("u"), F.when(mine == theirs, 0).when(mine < theirs, 1).otherwise(2).alias("side"))
    found = materialise(tiled.groupBy("t", "u").applyInArrow(_matched(basis, stages, threshold, kind), "id long, root long, links long"), "embed-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts_ = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "embed").withColumnRenamed("node", "id")
    joined = materialise(classes.join(links, "id", "left").join(parts_, "id", "left").select("id", "embedding", "n", "first", "links", F.coalesce("component", "id").alias("component")), "embed-owned")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(joined.join(least, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "embed-named")
    out = rows.join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
