import random

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_groups_keep_one_row_where_ids_repeat(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    rows = [(5, a), (5, b), (3, near(b, 60)), (7, near(a, 50)), (5, c), (5, c), (5, near(c, 70)), (None, d), (None, d), (None, near(d, 30)), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    # b goes to 3; a stays under 5, as only b is near a smaller id; one row each of c and d.
    assert len(kept) == 5
    assert (5, a) in kept and (3, near(b, 60)) in kept and (9, "") in kept
    assert sum(t in (c, near(c, 70)) for _, t in kept) == sum(t in (d, near(d, 30)) for _, t in kept) == 1
