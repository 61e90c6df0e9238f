import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from veritrace.llm import byte_bpe, chunk_dedup, decontaminate, language_id, line_dedup, lm_score, mpeg_audio, quality_model, simhash_dedup, token_counts
from veritrace.llm.components import components, local_components
from veritrace.llm.elias_fano import EliasFano

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row STRING, fp STRING"

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the angry farmer who owns the field"
FR = "le renard brun saute par dessus le chien paresseux et puis il court loin du fermier qui possède le champ"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{EN} number {i}\n{FR} numéro {i}" if i % 9 == 0 else (EN if i % 2 else FR) + f" {i}", "en" if i % 2 else "fr", "s", 1, "r", "f") for i in range(40)]
    rows += [(40, None, None, None, None, None, None), (41, "", "en", "s", 0, "r", "f"), (42, rows[3][1], "en", "s", 1, "r", "f"), (42, rows[3][1], "en", "s", 1, "r", "f"), (None, "!!! 123", None, "s", 1, "r", "f"), (43, "word " * 3000, "en", "s", 1, "r", "f")]
    return spark.createDataFrame(rows, DOCS)


def test_mpeg_round_trip_and_resync():
    for n in (0, 1, 63, 64, 65, 20_000):
        payload = mpeg_audio.padded(bytes(i * 7 % 256 for i in range(n)))
        media = mpeg_audio.write_stream(payload)
        s = mpeg_audio.read_stream(media)
        assert s.payload == payload and s.bad == s.junk == 0 and s.vbr_frames == len(s.offsets) and s.good == len(s.offsets)
        assert s.samples == 1152 * len(s.offsets) and s.micros == s.samples * 1_000_000 // 32000
    broken = mpeg_audio.read_stream(media[: s.offsets[1]] + b"\xff\xfbjunk" + media[s.offsets[1] :])
    assert broken.junk == 6 and len(broken.offsets) == len(s.offsets)
    flipped = bytearray(media)
    flipped[s.offsets[0] + 10] ^= 1
    assert mpeg_audio.read_stream(bytes(flipped)).bad == 1
    assert mpeg_audio.read_stream(media[:-5]).truncated == 1 and mpeg_audio.read_stream(None).offsets == []


def test_bpe_is_the_library():
    own = byte_bpe.tokenizer(byte_bpe.default_path())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(3)
    parts = ["ab", "the", "  ", "\n", "é", "漢", "🙂", "1", "aaa", "\x1c", "'s", "<|endoftext|>", "ing", "²"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert own.encode(text) == lib.encode_ordinary(text)
        assert own.decode_bytes(own.encode_bytes(text)) == text.encode()
    long = "".join(r.choice("abcdef") for _ in range(30_000))
    assert own.encode(long) == lib.encode_ordinary(long)


def test_token_counts_are_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.default_path())
    texts = ["<|endoftext|> a<|endoftext|>", "", "it's   <|endoftext|", EN, "\x1c  b"]
    assert token_counts.counter(token_counts.default_path())(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time nothing is missed
        got = token_counts.token_counts(docs, cache).collect()
        assert len(got) == docs.count() and all(r["n_tokens"] is not None for r in got)
    assert spark.read.parquet(cache).count() == docs.selectExpr("coalesce(text, '') t").distinct().count()


def test_kneser_ney_sums_to_one_over_known_continuations():
    levels = language_id.kneser_ney([EN, FR], order=3)
    p = np.exp2(levels[0][1].astype(float)).sum() + np.exp2(levels[0][5])[0] * (1 - len(levels[0][0]) / language_id.ALPHABET)
    assert abs(p - 1) < 1e-6


def test_language_id(docs):
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert rows[40]["lang_pred"] == rows[41]["lang_pred"] == rows[None]["lang_pred"] == "und"
    assert all(rows[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(40) if i % 9)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns


def test_local_components():
    assert local_components(6, np.array([0, 3, 4]), np.array([1, 4, 5])).tolist() == [0, 0, 2, 3, 3, 3]
    assert local_components(0, np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 35), (7, 7)], "a BIGINT, b BIGINT")
    got = {(r["node"], r["root"]) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(21)} | {(30, 30), (40, 30), (35, 30)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, docs):
    rows = simhash_dedup.simhash_components(docs).collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert len(rows) == docs.count() and all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in rows)
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    ids = [i for i in comp if i is not None]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert all(comp[i] == root[i] for i in ids)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {root[i] for i in ids}
    empty = docs.where("false")
    assert simhash_dedup.simhash_components(empty).count() == 0


def test_close_pairs_beyond_small_lists():
    r = np.random.default_rng(5)
    values = np.unique(np.uint64(0xABCD) << np.uint64(20) | r.integers(0, 1 << 12, 600).astype(np.uint64))
    i, j = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[i] ^ values[j]) <= 2
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash_dedup.close_pairs(values)), strict=True)}
    assert len(values) > simhash_dedup.SMALL and got == set(zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_elias_fano():
    r = np.random.default_rng(1)
    for universe, n in (((1 << 64) - 1, 5000), (1000, 1000), (5, 100), (10**9, 1), (1 << 40, 0), (1 << 20, 9)):
        values = np.sort(r.integers(0, universe, n, dtype=np.uint64))
        ef = EliasFano.of(values, universe)
        if n:
            assert (ef.access(np.arange(n)) == values).all()
        asked = np.concatenate((values, r.integers(0, universe, 200, dtype=np.uint64)))
        at, known = ef.find(asked), set(values.tolist())
        assert all((x in known) == (i >= 0) and (i < 0 or values[i] == x) for x, i in zip(asked.tolist(), at.tolist(), strict=True))


def test_lm_base_score(spark, docs):
    rows = docs.collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    counts = collections.Counter(w for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in split(r["text"]))
    total, types = sum(counts.values()), len(counts)
    for r in lm_score.lm_scores(docs).collect():
        words = split(next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]))
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total and abs(r["base_score"] - base) < 1e-6 and r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["score"] <= 0
    assert lm_score.lm_scores(docs.where("false")).count() == 0


def test_line_dedup(spark):
    line = "one fine line of words that stands in many texts with hardly any change to it at all in the whole of this corpus"
    rows = [(1, f"{line}\nfirst own words here"), (2, f"second own words there\n{line.upper()}"), (3, line + "\n\n" + line), (4, None), (5, ""), (None, line), (6, "| - |\n| - |")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["n_lines"], r["removed_lines"]) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: (2, ""), 2: (2, "1"), 3: (2, "0,2"), 4: (0, ""), 5: (0, ""), None: (1, "0"), 6: (2, "1")}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert texts[2] == "second own words there" and texts[3] == "" and texts[4] is None
    assert line_dedup.line_report(docs.where("false")).count() == 0


def test_chunks_resist_shifts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(r.randint(5, 60))) + " " + (passage if i in (3, 7) else "") + " " + " ".join(word() for _ in range(40))) for i in range(12)] + [(12, None), (13, "")]
    got = chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert [(x["doc_id"], x["first_doc_id"]) for x in got] == [(7, 3)] and 50 <= got[0]["words"] <= 82
    for raw in (b"", b"a", b"abc " * 5000):
        ends = chunk_dedup.cuts(raw)
        assert (ends[-1:] or [0])[0] == len(raw) and all(0 < b - a <= chunk_dedup.MAX for a, b in zip([0, *ends], ends, strict=False))


def test_decontamination(spark):
    items = [(1, "What is the name of the seventh planet that circles the bright star? It is called Veridian Prime by all sailors."), (2, "Tiny item"), (3, None), (4, "Quantum lanterns flicker above ninety silver harbours while merchants count their amber coins before sunrise every winter.")]
    rows = [(10, "x " * 300 + items[0][1].upper().replace("?", "??") + " y" * 200), (11, "seventh planet star bright name"), (12, "a tiny item"), (13, None), (14, items[0][1].split("?")[0] + " and nothing else follows here")]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10, 1), (12, 2)}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {11, 13, 14}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    index = decontaminate.ItemIndex([(i, t) for i, t in items if t])
    full = [(i, sum(index.weight[p] for p in range(len(index.item)) if index.item[p] == i)) for i in range(len(index.keys))]
    assert all(abs(s - 1) < 1e-9 for _, s in full)


def test_quality_model(spark):
    r = random.Random(6)
    good = "The harvest of the year was good and the people in the valley were glad to see that it had come".split()
    text = lambda i: " ".join(r.sample(good, 15)) + f" {i}." if i % 4 else " ".join(f"{w}$$$" for w in r.sample(good, 15))
    rows = [(i, text(i)) for i in range(200)] + [(200, None), (201, ""), (202, "you stupid idiot of a clown in the valley of the year and the harvest")]
    got = {x["doc_id"]: x for x in quality_model.classify(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert len(got) == 203 and all(got[i]["keep"] == bool(i % 4) for i in range(200))
    assert quality_model.classify(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_texts_are_looked_up_many_at_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Plain:
        sparkSession = spark

        def mapInArrow(self, f, schema):
            return f

    asked = []

    def counted(texts):
        asked.append(len(texts))
        distinct, which, sizes = lm_score._tokens(texts)
        assert sizes.tolist() == [len((t or b"").lower().split()) + 1 for t in texts] and which.max() == len(distinct) - 1
        return distinct, np.bincount(which)

    texts = [f"The {i} of the\tÉ word".encode() if i % 7 else None for i in range(1000)]
    out = list(lm_score._runs(Plain(), counted, lambda keys: np.zeros(len(keys), np.int64))(iter([pa.RecordBatch.from_arrays([pa.array(texts[at : at + 100])], ["text"]) for at in range(0, 1000, 100)])))
    keys, counts = lm_score._merged_runs(out[0]["run"].to_pylist())
    words = [w for t in texts for w in [*(t or b"").lower().split(), None]]
    assert asked == [1000] and len(out) == 1 and len(keys) == len(set(words)) and int(counts.sum()) == len(words)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True))[lm_score.END] == 1000
    sizes = []
    monkeypatch.setattr(lm_score, "arrow_map", lambda df, each, read, schema, binary=False, size=256: sizes.append(size))
    lm_score.score(None, None)
    assert sizes[0] >= 4096
