import itertools
import random

import corpus_pipeline
from veritrace.llm import simhash_dedup


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_stage_drops_near_copies_by_five_word_similarity(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(100)]
        # one word changed (0.90), two far apart (0.81), four far apart (0.66)
        for places in ((), (50,), (20, 70), (10, 35, 60, 85)):
            texts.append(" ".join(word() if i in places else w for i, w in enumerate(base)))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, texts[0].upper()), (102, texts[0].upper()), (None, texts[5]), (103, " ")]
    root = {i: i for i in range(len(texts))}
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = shingles(texts[i]), shingles(texts[j])
        if len(a & b) / len(a | b) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = {k: low if v == high else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = [x["doc_id"] for x in kept.collect()]
    assert len(set(root.values())) == 24 and sorted(got) == sorted({*root.values(), 100})
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_stage_takes_candidates_from_the_simhash_index(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(2000)]
    copy, other = [*base[:1000], "changed", *base[1001:]], [word() for _ in range(100)]
    texts = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(other)), (4, " ".join(word() for _ in range(100)))]
    own = simhash_dedup.fingerprint(texts[0][1].encode(), 5)
    assert (own ^ simhash_dedup.fingerprint(texts[1][1].encode(), 5)).bit_count() <= 2
    # no two share a band; 3 stands within two bits of 1 without being like it, 4 nowhere near
    fps = {1: own, 2: simhash_dedup.fingerprint(texts[1][1].encode(), 5), 3: own ^ 5, 4: ~own}
    sketches = spark.createDataFrame([(k, fps[k], [k * 1000 + b for b in range(25)]) for k, _ in texts], "text_key BIGINT, fp BIGINT, bands ARRAY<BIGINT>")
    found = simhash_dedup._similar_components(sketches, spark.createDataFrame(texts, "text_key BIGINT, text STRING"), 5, 0.8)
    assert sorted(tuple(x) for x in found.select("text_key", "root").collect()) == [(1, 1), (2, 1)]
    made = simhash_dedup.text_sketches([t.encode() for _, t in texts] + [None, b" "])
    assert [fp for fp, _ in made] == [simhash_dedup.fingerprint(t.encode(), 5) for _, t in texts] + [0, 0] and made[4] == made[5]
