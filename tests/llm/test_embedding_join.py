import numpy as np
import pytest
from pyspark.sql import functions as F

from litsearch.llm import embedding_join
from litsearch.llm.embedding_join import cells_of, linked_pairs, meetings, near_groups, quantised, unit_rows

SCHEMA = "vec_id long, embedding array<double>, label int, node string, tile int"


def brute(rows):
    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += links[k]
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def found(spark, rows, kind="double", **options):
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA.replace("double", kind)).repartition(4)
    return sorted((tuple(r) for r in near_groups(frame, **options).collect()), key=str)


def cloud(seed, groups=8, each=25, lone=120, size=16, spread=0.075):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(lone, size)))
    for _ in range(groups):
        middle = rng.normal(size=size)
        middle /= np.linalg.norm(middle)
        rows += [(middle + rng.normal(size=size) * spread) * rng.uniform(0.1, 9) for _ in range(each)]
    order = rng.permutation(len(rows))
    return [(int(1000 + k), [float(x) for x in rows[k]]) for k in order]


@pytest.mark.parametrize("tile_rows", [7, 4096])
def test_against_all_pairs(spark, tile_rows):
    rows = cloud(3)
    want = brute(rows)
    links = [r[1] for r in want]
    assert 0 < min(x for x in links if x) < 20 < len([x for x in links if x == 0])  # groups are no cliques
    assert found(spark, rows, tile_rows=tile_rows) == want
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(spark, single, kind="float", tile_rows=tile_rows) == brute(single)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0]),
            (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [-1.0, 0.0]), (13, [5.0]), (14, [1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_many_copies_cost_rows_in_proportion(spark):
    frame = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 1e-9).alias("embedding"))
    got = near_groups(frame, tile_rows=500)
    r = got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(r) == (2999, 2999, 0, 1)


@pytest.mark.parametrize("size", [3, 64, 1100])
def test_bounds_hold_and_few_pairs_are_recomputed(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(300, size))
    b = np.concatenate([a[:150] + rng.normal(size=(150, size)) * rng.uniform(0, 0.5, (150, 1)), rng.normal(size=(100, size))])
    a, b = (unit_rows([r.astype("<f8").tobytes() for r in x], "<f8")[0] for x in (a, b))
    for unit in (a, b):
        codes, scale, error = quantised(unit)
        assert codes.dtype == np.int8 and np.abs(codes).max() <= 127
        assert (np.linalg.norm(unit - codes * scale[:, None], axis=1) <= error).all()
    rows, cols, again = linked_pairs((a, *quantised(a)), (b, *quantised(b)), 0.95)
    assert set(zip(rows, cols)) == set(zip(*np.nonzero(a @ b.T >= 0.95))) and len(rows) > 20
    assert again < a.shape[0] * b.shape[0] / 20


def test_far_cells_do_not_meet(spark):
    """Clusters far apart share no tile, and every link is still found (see above)."""
    import pandas as pd
    pivots = np.eye(4)
    rows = [(i, (np.eye(4)[i % 4] + 0.01 * i / 40).astype("<f8").tobytes(), i % 4, 0.02) for i in range(40)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "vec", "cell", "angle"]),
                                  "node long, vec binary, cell int, angle double")
    got = meetings(frame, pivots, np.full(4, 0.05), np.ones(4, dtype=np.int64), 0.95, "<f8").collect()
    assert len(got) == 40 and all(r.low == r.high for r in got)


def test_a_vector_is_sent_once_for_each_span_of_tiles(spark, monkeypatch):
    """Not once for each tile, or else what is shuffled grows with the square of the table."""
    import pandas as pd
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype("<f8").tobytes(), 0, 0.0) for i in range(60)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "vec", "cell", "angle"]),
                                  "node long, vec binary, cell int, angle double")
    pivots, radius, tiles = np.eye(4)[:1], np.full(1, 4.0), np.full(1, 20)
    spans = cells_of(pivots, radius, tiles, 0.95, np.full(1, 60), 15)
    assert list(spans.span) == [i // 5 for i in range(20)]
    assert meetings(frame, pivots, radius, tiles, 0.95, "<f8", spans).count() == 60 * 4
    data = cloud(5)
    for values in (16 * 20, 16 * 100):
        monkeypatch.setattr(embedding_join, "SPAN_VALUES", values)
        assert found(spark, data, tile_rows=9) == brute(data)
