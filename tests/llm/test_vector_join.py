import math

import numpy as np

from cosecha.llm import vector_join
from cosecha.llm.vector_join import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute_force(rows, threshold):
    vectors = {}
    for k, (_, v, _) in enumerate(rows):
        if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            vectors[k] = a / np.linalg.norm(a)
    links = {k: [j for j in vectors if j != k and float(vectors[k] @ vectors[j]) >= threshold] for k in vectors}
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(links.get(k, ())), component, vec_id is not None and vec_id == component))
    return sorted(out, key=repr)


def sample():
    rng = np.random.default_rng(5)
    rows, next_id = [], 0
    for _ in range(30):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((next_id, (centre + rng.normal(size=8) * 0.12).astype(np.float32).tolist(), "a"))
            next_id += 1
    rows += [(next_id + k, rows[3][1], None) for k in range(40)]
    next_id += 40
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 9]
    rows += [(next_id + k, v, "b") for k, v in enumerate(odd)]
    scaled = [x * 1e30 for x in rows[0][1]]
    rows += [(next_id + 20, scaled, "c"), (None, rows[5][1], "c"), (7, rows[50][1], "repeated id")]
    return rows


def test_links_and_components_against_all_pairs(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = brute_force(rows, 0.95)
    for settings in ({}, {"block": 16, "slice_": 40, "pivots": 5}):
        found = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(frame, **settings).collect()]
        assert sorted(found, key=repr) == wanted


def test_empty_and_useless_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = near_duplicates(spark.createDataFrame([(1, None, "a"), (2, [0.0], "b")], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 0, 1), (2, 0, 2)]


def test_each_length_links_with_its_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01]), (5, [0.0, 1.0]), (6, []), (7, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_clustered_vectors_are_sent_about_once(spark):
    rng = np.random.default_rng(8)

    def sent(count):
        centres = rng.normal(size=(count // 50, 64))
        data = (centres[:, None, :] + 0.01 * rng.normal(size=(len(centres), 50, 64))).reshape(-1, 64)
        frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
        rows = []
        real = vector_join._found
        vector_join._found = lambda visits, *a: (rows.append(visits.count()), real(visits, *a))[1]
        try:
            out = near_duplicates(frame, block=32, slice_=1000)
            assert out.filter("n_links >= 49").count() == count
        finally:
            vector_join._found = real
        return rows[0] / count

    # Unrelated clusters lie at nearly one distance from all pivots, so what is sent still grows, but with a block's slices only.
    assert sent(2000) < 3 * sent(1000)
