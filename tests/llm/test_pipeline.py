import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from veritrace.llm import byte_bpe, decontaminate, edit_distance, quality_model

EN = "the old farmer walked over the long field and looked at the water of the quiet river that runs below the hill".split()
DE = "der alte bauer ging über das lange feld und sah auf das wasser des stillen flusses der unter dem berg fließt".split()
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row STRING, place STRING, fp STRING"


def near(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) >= 0.8


def brute(rows, items):
    """The pipeline's rows by plain loops: texts with a letter stay, like lines go but for the first, one of near copies
    stays, texts with an item go; then the library's tokens."""
    kept = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    seen, out = [], []
    lines = [(i, n, " ".join(line.lower().split())) for i, t in sorted(kept) for n, line in enumerate(t.split("\n"))]
    group = list(range(len(lines)))
    for x in range(len(lines)):
        for y in range(x):
            if lines[x][2] and lines[y][2] and group[x] != group[y] and edit_distance.similar(lines[x][2], lines[y][2]):
                low, high = sorted((group[x], group[y]))
                group = [low if g == high else g for g in group]
    gone = {lines[x][:2] for x in range(len(lines)) if group[x] != x}
    for i, t in sorted(kept):
        out.append((i, "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone)))
    for i, t in out:
        if not any(near(t, u) for _, u in seen):
            seen.append((i, t))
    clean = [(i, t) for i, t in seen if not any(" ".join(decontaminate.words_of(item)) in " ".join(decontaminate.words_of(t)) for item in items)]
    own = byte_bpe.tokenizer(byte_bpe.default_path())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    result = set()
    for i, t in clean:
        ids = lib.encode_ordinary(t)
        result.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return result


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    said = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    item = "Which amber lantern hung above the seventh harbour before sunrise? Veridian merchants counted ninety silver coins."
    rows = [(i, said(EN if i % 2 else DE, 60) + "\n" + said(EN if i % 2 else DE, 25), "en" if i % 2 else "de") for i in range(60)]
    shared = "this very line of words is printed at the end of many texts in the same way"
    rows += [(100, rows[1][1] + "\n" + shared, "en"), (101, said(EN, 50) + "\n" + shared.upper(), "en"), (102, said(EN, 50) + "\n" + shared.replace("printed", "Printed,"), "en")]
    near_copy = rows[3][1].split(" ")
    near_copy[5] = "changed"
    rows += [(103, " ".join(near_copy), "en"), (104, said(EN, 40) + " " + item + " " + said(EN, 40), "en"), (105, None, None), (106, "", None), (107, "123 456 !!!", None), (108, rows[5][1], "en")]
    top = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "r", "p", "f") for i, t, lang in rows], DOCS)
    docs.write.parquet(f"{top}/documents.parquet")
    docs.where("false").write.parquet(f"{top}/none/documents.parquet")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id BIGINT, text STRING")
    bench.write.parquet(f"{top}/benchmark.parquet")
    bench.write.parquet(f"{top}/none/benchmark.parquet")
    return top, [(i, t) for i, t, _ in rows], [item]


def test_pipeline_gives_the_rows_of_plain_loops(spark, tables):
    top, rows, items = tables
    got = {tuple(x) for x in corpus_pipeline.run(spark, top).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == brute(rows, items)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    none = spark.read.parquet(f"{tables[0]}/none/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).columns == docs.columns, name
    assert corpus_pipeline.run(spark, f"{tables[0]}/none").count() == 0
    assert corpus_pipeline.line_dedup(spark, none, tables[0]).count() == 0


def test_retrieval_is_plain_bm25():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((5, 9, 14, 20, 28, 31))))) for i in range(70)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        terms = {r.choice(words) for _ in range(r.randint(1, 25))}
        got = dict(index.retrieve(index_terms(index, terms), 0.4))
        want = {}
        for n in range(len(items)):
            score = sum(index.weight[p] for p in range(len(index.item)) if index.item[p] == n and word_at(index, p) in terms)
            if score >= 0.4 - 1e-9:
                want[n] = score
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def index_terms(index, terms):
    import numpy as np

    return np.array(sorted(index.vocab[w] for w in terms if w in index.vocab), np.int64)


def word_at(index, place):
    import numpy as np

    return list(index.vocab)[int(np.searchsorted(index.start, place, "right")) - 1]


def test_a_long_item_widens_no_other_passages():
    r = random.Random(6)
    common = [f"w{i}" for i in range(30)]
    short = " ".join(r.choice(common) for _ in range(20))
    items = [(1, " ".join(r.choice(common + [f"q{i}" for i in range(300)]) for _ in range(400))), (2, short)] + [(3 + i, " ".join(r.choice(common) for _ in range(20))) for i in range(5)]
    own = decontaminate.ItemClasses(items)
    assert not any(h[0] == 2 for _ in range(60) for h in own.search(" ".join(r.choice(common) for _ in range(800))))
    assert own.search("x " * 90 + short + " y" * 90)[0][0] == 2


def test_what_people_said_holds_in_the_label_model(spark):
    patterns, counts = ["111-", "000-", "0001", "1110", "01--"], [40, 50, 9, 3, 20]
    post = dict(zip(patterns, quality_model.LabelModel.fit(patterns, counts).posterior(patterns).tolist(), strict=True))
    assert post["0001"] == 1 and post["1110"] == 0 and post["111-"] > 0.5 > post["000-"]
    rows = [(i, f"the word of the day is zorgl{i} and it is in the text for all of us to see" if i % 3 == 0 else f"the word of the day is plain{i} and it is in the text for all of us to see") for i in range(150)]
    docs = spark.createDataFrame([*rows, (150, None), (151, "")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 100)] + [(0, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    got = {x["doc_id"]: x["toxic_score"] for x in quality_model.classify(docs, labels).collect()}
    assert len(got) == 152 and all((got[i] > 0.5) == (i % 3 == 0) for i in range(100, 150))
