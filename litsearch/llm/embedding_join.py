"""Embedding near-dedup: int8 tile products with per-vector error bounds.

1. Vectors are normalised in double precision and given to the nearest of at most
   ``PIVOTS`` sampled vectors. Cells are cut into tiles of about ``TILE_ROWS`` rows.
2. A row meets another cell's tiles only if a vector within the threshold's angle
   could lie there: its angle to the cell's pivot is at most the cell's radius plus
   that angle, and not more than twice that angle above the angle to its own pivot.
   Both follow from the triangle inequality, so no link is lost; on vectors
   without any structure nothing can be left out and all tiles meet. The sample
   only decides how much work is saved.
3. Neighbouring tiles make a span of at most ``SPAN_VALUES`` numbers, and every two spans meet
   in one task: a vector is sent once for each span, not for each tile. There are as few spans as
   memory and the number of cores allow; the tiles that leave nothing out meet within the task.
4. Two tiles meet as int8 codes with one scale a vector. Products of
   codes are exact integers; with the lengths of both quantisation errors they
   bound the cosine. Pairs surely above the threshold count at once, pairs surely
   below are gone, and only those between are computed again in double precision.
5. A task returns one row per linked vector: its number of links and the least
   vector of its group there. A group of thousands of copies so costs rows in
   proportion to its vectors and spans, never one row a pair.
6. Connected groups are the components of these rows.

Vectors that are null, zero or hold null or non-finite components link with
nothing; so do vectors of different lengths. Repeated rows, also of one
``vec_id``, are vectors of their own and link. A null ``vec_id`` never names a
component unless nothing else does. An empty table gives no rows; other columns
are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsearch.llm.common import stored
from litsearch.llm.components import components

THRESHOLD = 0.95
PIVOTS = 256             # sampled pivots at most, and 16 MB of them
TILE_ROWS = 4096         # vectors of a tile, fewer if they are long
TILE_VALUES = 1 << 21    # numbers of a tile
STEP = 1024              # rows of a tile that are multiplied at once
SPAN_VALUES = 1 << 22    # numbers of a span of tiles, of which two are in a task
TASKS_A_CORE = 4         # pairs of spans for each core, where memory allows fewer spans
SLACK = 1e-9             # on angles, for rounding in double precision


def unit_rows(blobs, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of equal or unequal lengths as unit rows in double precision, padded with zeros, and their lengths.

    ``kind``: the numpy type of the packed numbers, that of the table's column.
    """
    sizes = np.fromiter((len(b) // np.dtype(kind).itemsize for b in blobs), dtype=np.int64, count=len(blobs))
    out = np.zeros((len(blobs), int(sizes.max(initial=1))))
    if len(blobs) and (sizes == sizes[0]).all():
        out[:] = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1)
    else:
        for row, blob in enumerate(blobs):
            out[row, :sizes[row]] = np.frombuffer(blob, dtype=kind)
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # so that squares neither overflow nor vanish
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out, sizes


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and length of the error of each unit row."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12


def code_products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single-precision products of 512 columns stay below 2**24."""
    out = np.zeros((len(one), len(other)), dtype=np.float64 if one.shape[1] > 512 else np.float32)
    for at in range(0, one.shape[1], 512):
        out += one[:, at:at + 512].astype(np.float32) @ other[:, at:at + 512].astype(np.float32).T
    return out


def linked_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers of all pairs of two blocks (unit, codes, scale, error) with cosine >= threshold, and how many
    of them had to be computed again."""
    (unit_a, codes_a, scale_a, error_a), (unit_b, codes_b, scale_b, error_b) = a, b
    products = code_products(codes_a, codes_b)
    # |x.y - q| <= |ex| (1 + |ey|) + |ey| for unit x, y, q the product of the codes in scale
    widest = error_a * (1 + error_b.max(initial=0)) + error_b.max(initial=0) + 1e-6
    some = products * scale_b.astype(products.dtype)[None, :]
    rows, cols = np.nonzero(some >= ((threshold - widest) / scale_a).astype(products.dtype)[:, None] - 1e-4)
    value = products[rows, cols].astype(np.float64) * scale_a[rows] * scale_b[cols]
    error = error_a[rows] * (1 + error_b[cols]) + error_b[cols]
    linked = value - error >= threshold + 1e-12
    unsure = np.nonzero(~linked & (value + error >= threshold - 1e-12))[0]
    for at in range(0, len(unsure), 1 << 16):
        part = unsure[at:at + (1 << 16)]
        linked[part] = np.einsum("ij,ij->i", unit_a[rows[part]], unit_b[cols[part]]) >= threshold
    return rows[linked], cols[linked], len(unsure)


def least_labels(label: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least label of each connected group of rows; ``ends`` are pairs of rows."""
    label = label.copy()
    while len(ends):
        before = label[ends]
        least = before.min(axis=1)
        np.minimum.at(label, ends[:, 0], least)
        np.minimum.at(label, ends[:, 1], least)
        label = np.minimum(label, label[label])  # labels are row numbers: take the label of the label
        if (label[ends] == before).all():
            break
    return label


def block_star(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """As few pairs as rows and columns that connect what (rows, cols) connects."""
    own, pairs = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    label = least_labels(np.arange(len(own)), pairs.reshape(2, -1).T)
    return np.stack([own, own[label]], axis=1)


def span_links(key: tuple, pair: pd.DataFrame, cells: Cells, threshold: float, kind: str) -> pd.DataFrame:
    """node, root, links: the linked vectors of two spans of tiles (or of one span with itself)."""
    pair = pair.sort_values("node", ignore_index=True)
    blobs = pair["vec"].tolist()
    unit, sizes = unit_rows(blobs, kind)
    codes, scale, error = quantised(unit)
    tile = pair["tile"].to_numpy()
    meets = cells.met_by(blobs, cells.cell[tile], kind)
    at = {int(t): np.nonzero(tile == t)[0] for t in np.unique(tile)}
    low, high = ([t for t in at if cells.span[t] == s] for s in key)
    links, stars = np.zeros(len(pair), dtype=np.int64), []
    for t, u in ((t, u) for t in low for u in high if key[0] != key[1] or t <= u):
        left = at[t][meets[at[t], cells.cell[u]]]
        right = at[u][meets[at[u], cells.cell[t]]]
        for i in range(0, len(left), STEP):
            a = left[i:i + STEP]
            for j in range(i if t == u else 0, len(right), STEP):
                b = right[j:j + STEP]
                rows, cols, _ = linked_pairs((unit[a], codes[a], scale[a], error[a]),
                                             (unit[b], codes[b], scale[b], error[b]), threshold)
                rows, cols = a[rows], b[cols]
                keep = sizes[rows] == sizes[cols]
                if t == u and i == j:
                    keep &= rows < cols
                rows, cols = rows[keep], cols[keep]
                if len(rows):
                    links += np.bincount(rows, minlength=len(pair)) + np.bincount(cols, minlength=len(pair))
                    stars.append(block_star(rows, cols))
    label = least_labels(np.arange(len(pair)), np.concatenate(stars)) if stars else np.arange(len(pair))
    found = np.nonzero(links)[0]
    node = pair["node"].to_numpy()
    return pd.DataFrame({"node": node[found], "root": node[label[found]], "links": links[found]})


def packed(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple:
    """(node, vec_id) of all rows, (node, vec) of those that can link, and the type of the numbers in ``vec``.

    ``node`` numbers the rows; ``vec`` holds single precision if the column does, else doubles.
    """
    single = isinstance(embeddings.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    element = lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    values = F.col(vector_col).cast("array<float>" if single else "array<double>")
    usable = (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull()) & F.exists(values, lambda x: x != 0)
    usable = usable & ~F.exists(values, element)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vec = [None if v is None else np.asarray(v, dtype=kind).tobytes() for v in batch["values"]]
            yield pd.DataFrame({"node": batch["node"], "vec": pd.Series(vec, dtype=object)})

    rows = stored(embeddings.select(F.col(id_col).alias("vec_id"), F.when(usable, values).alias("values"))
                  .withColumn("node", F.monotonically_increasing_id()), "vectors")
    return rows.select("node", "vec_id"), rows.where("values is not null").select("node", "values").mapInPandas(
        pack, "node long, vec binary"), kind


def located(vectors: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """``vectors`` with the nearest pivot (``cell``) and the angle to it."""
    def run(batches):
        for batch in batches:
            if len(batch):
                angles = pivot_angles(batch["vec"].tolist(), pivots, kind)
                cell = angles.argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(batch)), cell])
    return vectors.mapInPandas(run, "node long, vec binary, cell int, angle double")


def pivot_angles(blobs, pivots: np.ndarray, kind: str) -> np.ndarray:
    unit, _ = unit_rows(blobs, kind)
    width = max(unit.shape[1], pivots.shape[1])
    unit = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
    near = np.clip(unit @ np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).T, -1, 1)
    return np.arccos(near)


@dataclass
class Cells:
    """Pivots, radius and number of tiles of each cell; the cell and the span of each tile; ``reach``, the widest angle of a link."""

    pivots: np.ndarray
    radius: np.ndarray
    tiles: np.ndarray
    cell: np.ndarray
    span: np.ndarray
    reach: float

    def met_by(self, blobs, own: np.ndarray, kind: str) -> np.ndarray:
        """Per vector of the cells ``own`` and per cell whether a vector within reach could lie there."""
        if not len(blobs):
            return np.zeros((0, len(self.pivots)), dtype=bool)
        angles = pivot_angles(blobs, self.pivots, kind)
        rows = np.arange(len(blobs))
        meets = (angles <= self.radius[None, :] + self.reach) & (angles <= angles[rows, own][:, None] + 2 * self.reach)
        meets[rows, own] = True
        return meets


def cells_of(pivots: np.ndarray, radius: np.ndarray, tiles: np.ndarray, threshold: float,
             rows: np.ndarray | None = None, span_rows: int = 0) -> Cells:
    """Neighbouring tiles make spans of about ``span_rows`` of the ``rows`` of the cells, at least one tile each."""
    cell = np.repeat(np.arange(len(tiles)), tiles)
    span = np.arange(len(cell))
    if rows is not None:
        share = (rows / tiles)[cell]  # rows of a tile
        span = np.unique(((np.cumsum(share) - share / 2) // max(span_rows, 1)).astype(np.int64), return_inverse=True)[1]
    return Cells(pivots, radius, tiles, cell, span, math.acos(threshold) + SLACK + 1e-6)  # arccos loses digits near one


def meetings(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, tiles: np.ndarray,
             threshold: float, kind: str, cells: Cells | None = None) -> DataFrame:
    """low, high, tile, node, vec: every row once for each pair of spans in which it may link.

    Without ``cells`` each tile is a span.
    """
    cells = cells or cells_of(pivots, radius, tiles, threshold)
    first = np.concatenate([[0], np.cumsum(tiles)[:-1]])
    spans = np.zeros((len(tiles), int(cells.span.max()) + 1), dtype=bool)
    spans[cells.cell, cells.span] = True

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            cell = batch["cell"].to_numpy()
            met = cells.met_by(batch["vec"].tolist(), cell, kind) @ spans
            tile = first[cell] + batch["part"].to_numpy() % tiles[cell]
            yield pd.DataFrame({"tile": tile.astype(np.int32), "span": cells.span[tile].astype(np.int32),
                                "spans": [np.nonzero(x)[0].astype(np.int32) for x in met], "node": batch["node"],
                                "vec": batch["vec"]})

    rows = rows.select("node", "vec", "cell", F.shiftrightunsigned(F.xxhash64("node"), 33).alias("part"))
    met = rows.mapInPandas(run, "tile int, span int, spans array<int>, node long, vec binary")
    met = met.select("tile", "span", "node", "vec", F.explode("spans").alias("other"))
    return met.select(F.least("span", "other").alias("low"), F.greatest("span", "other").alias("high"),
                      "tile", "node", "vec")


def near_links(vectors: DataFrame, kind: str, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS,
               pivots: int = PIVOTS) -> DataFrame:
    """node, root, links for the linked vectors of every pair of spans; ``vectors``: node, vec."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*"), F.max(F.length("vec"))).first()
    count, longest = size[0], max(1, (size[1] or 0) // np.dtype(kind).itemsize)
    tile_rows = max(1, min(tile_rows, TILE_VALUES // longest))
    wanted = max(1, min(pivots, TILE_VALUES // longest, -(-count // tile_rows)))
    sample = vectors.orderBy(F.xxhash64("node")).limit(wanted).select("vec").collect()  # at most 16 MB
    if not sample:
        return spark.createDataFrame([], "node long, root long, links long")
    pivot, _ = unit_rows([bytes(r.vec) for r in sample], kind)
    rows = stored(located(vectors, pivot, kind), "cells")
    radius, tiles, inside = np.full(len(pivot), -1e9), np.ones(len(pivot), dtype=np.int64), np.zeros(len(pivot))
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], tiles[r.cell], inside[r.cell] = r.radius, -(-r.n // tile_rows), r.n
    spans = math.ceil(math.sqrt(2 * TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    cells = cells_of(pivot, radius, tiles, threshold, inside, min(SPAN_VALUES // longest, -(-count // spans)))
    met = meetings(rows, pivot, radius, tiles, threshold, kind, cells)
    number = int(cells.span.max()) + 1
    pairs = number * (number + 1) // 2
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(max(least, min(4 * pairs, 100_000)), "low", "high")  # so that few pairs share a task
    return dealt.groupBy("low", "high").applyInPandas(
        lambda key, pair: span_links(key, pair, cells, threshold, kind), "node long, root long, links long")


def near_groups(embeddings: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS,
                pivots: int = PIVOTS) -> DataFrame:
    """Per row of ``embeddings`` vec_id, n_links, component_id (the least vec_id of its group) and kept."""
    rows, vectors, kind = packed(embeddings)
    vectors = stored(vectors, "packed-vectors")
    found = stored(near_links(vectors, kind, threshold, tile_rows, pivots), "tile-links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = stored(rows.join(links, "node", "left").join(groups, "node", "left")
                     .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "members")
    least = members.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return members.join(least, "root", "left").select(
        "vec_id", "n_links", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS node, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), valid AS (
  SELECT * FROM usable WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.node AS a, b.node AS b FROM valid a JOIN valid b ON len(a.v) = len(b.v) AND a.node <> b.node
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT node AS a, node AS b FROM usable
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), least AS (
  SELECT r.a AS node, min(u.vec_id) AS component_id FROM reached r JOIN usable u ON u.node = r.b GROUP BY r.a
)
SELECT u.vec_id, coalesce(n.n, 0) AS n_links, l.component_id, u.vec_id IS NOT DISTINCT FROM l.component_id AS kept
FROM usable u JOIN least l USING (node) LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = u.node"""
