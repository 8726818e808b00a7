import zlib
from collections import Counter

from cosecha.llm.language_id import PROFILE, RankModel, digest, gram_counts, keep_known, learn_profiles, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
EN, DE = "the house and the garden are of the king ", "das Haus und der Garten sind von dem König "


def rows():
    out = [(k, (EN if k % 2 else DE) * (k % 5 + 1), "en" if k % 2 else "de", "s", 1, None) for k in range(60)]
    return out + [(100, None, "en", "s", 0, None), (101, "", "en", "s", 0, None), (102, "1234 !?", None, "s", 0, None), (103, "日本語", None, "s", 0, None), (None, EN, "en", "s", 0, None), (None, EN, "en", "s", 0, None)]


def grams(text):
    """The n-grams by hand: letters of words with a blank at each end, 1 to 3 long, no blank alone or in the middle."""
    line = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(line) - n + 1):
            g = line[k : k + n]
            if g.strip() and (n == 1 or " " not in g[1:-1]) and not (n == 2 and g == "  "):
                out[g] += 1
    return out


def test_gram_counts_by_hand():
    for text in ("The cat, the dog.", "a", "äé 😀 x1y", "  "):
        assert sorted(gram_counts(text)[1].tolist()) == sorted(grams(text).values())


def test_profiles_and_distance_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    profiles = learn_profiles(docs).toPandas()
    counts = {}
    for _, text, lang, *_ in rows():
        if text and lang:
            g, n = gram_counts(text)
            counts.setdefault(lang, Counter()).update(dict(zip(g.tolist(), n.tolist(), strict=True)))
    best = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for lang, c in counts.items()}
    for lang, wanted in best.items():
        assert profiles[profiles.lang == lang].sort_values("place").gram.tolist() == wanted
    model = RankModel(profiles)
    text = "the König and"
    own = ranked(*gram_counts(text)).tolist()
    distance = {lang: sum(abs(k - p.index(g)) if g in p else PROFILE for k, g in enumerate(own)) for lang, p in best.items()}
    lang = min(sorted(distance), key=distance.get)
    assert model.predict(text) == (lang, 1 - distance[lang] / (PROFILE * len(own)))


def test_predictions_edge_cases_and_held_out(spark):
    found = digest(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows())
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (100, 101, 102):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 100:
            assert r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de")
        assert 0 <= r["score"] <= 1


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    said = digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in said) >= 0.97 * len(said)


def test_filter_keeps_columns_and_clean_documents(spark):
    kept = keep_known(spark.createDataFrame(rows(), SCHEMA))
    assert kept.columns == [c.strip().split()[0] for c in SCHEMA.split(",")]
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), None}


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, EN, None, "s", 1, None)], SCHEMA)
    assert digest(docs).first()["lang_pred"] == "und"
    assert digest(docs.limit(0)).count() == 0
