"""Nulls, repeated rows, empty tables and clashing columns in every operator and pipeline stage; stages against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortflow.llm import embedding_dedup, language_model, minhash, mixing, packing, paragraph_sketch, quality, queries, records, runs, secrets, shared, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "a long text of plain words and more. " * 900
ROWS = [(None, "first text without an id", "s"), (None, "first text without an id", "s"), (None, None, None), (3, "twice the same row here", "s"), (3, "twice the same row here", "s"), (3, "another text of that id", "t"), (4, None, "t"), (5, "", "s"), (6, " \n\t ", None), (7, LONG, "s"), (8, "x", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, len(t or ""), "b", 1, 2, "z") for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, component long, row long, mix_s string")


def encoded(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_of_odd_rows(odd):
    found = records.token_records(odd, PATH).collect()
    want = collections.Counter((i, len(encoded(t)), crc(encoded(t))) for i, t, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids[:3] == [None] * 3 and ids[3:] == sorted(ids[3:])


def test_records_are_read_in_any_order(spark, odd):
    folder = shared.shared_dir(spark, "records")
    manifest = records.write_records(odd, folder, PATH)
    index = records.read_index(manifest, folder)
    shuffled = records.read_records(index.orderBy(F.rand(3)).coalesce(1), folder)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in shuffled.collect()) == sorted((i or -1, crc(encoded(t))) for i, t, _ in ROWS)
    one = records.read_records(index.where("doc_id = 7"), folder).collect()
    assert [(r["doc_id"], r["ids_crc32"]) for r in one] == [(7, crc(encoded(LONG)))]


@pytest.mark.parametrize("window", [64, 128, 256, 4096])
def test_packing_of_odd_rows(odd, window):
    found = packing.pack(odd, PATH, window=window).collect()
    assert sum(r["length"] for r in found) == sum(len(encoded(t)) for _, t, _ in ROWS)
    assert collections.Counter(r["doc_id"] for r in found if r["start"] == 0) == collections.Counter(i for i, _, _ in ROWS)
    held = collections.Counter()
    for r in found:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= window


def test_secrets_of_odd_rows(odd):
    found = secrets.report(secrets.find_secrets(odd)).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(i for i, _, _ in ROWS) and all(r["spans"] == "" for r in found)
    assert [x for x in secrets.redact_secrets(odd).columns] == odd.columns


def test_near_duplicates_of_odd_rows(odd):
    found = minhash.near_duplicates(odd, words=3, percent=85, bands=32, rows=8).collect()
    assert len(found) == len(ROWS)
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in found if r["doc_id"] is not None)


def test_language_model_of_odd_rows(odd):
    found = language_model.score_texts(odd).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(i for i, _, _ in ROWS)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_mixing_of_odd_rows(odd):
    found = mixing.mix_order(odd)
    assert sorted(r["mix_position"] for r in found.collect()) == list(range(len(ROWS))) and set(odd.columns) <= set(found.columns)
    assert {r["mix_s"] for r in found.collect()} == {"z"}


def test_fingerprints_of_odd_rows(odd):
    found = paragraph_sketch.fingerprints(odd, 1024).collect()
    assert len(found) == len(ROWS)
    same = [r for r in found if r["doc_id"] == 3 and r["n_chars"] == len(ROWS[3][1])]
    assert len({r["fingerprint"] for r in same[:2]}) <= 2 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    empty = [r for r in found if r["n_chars"] == 0]
    assert {r["fingerprint"] for r in empty} == {"1:0:"}


def test_many_rows_of_one_id_follow_each_other(spark):
    """A hot id is dealt by its texts' digests; every row still meets the next one of that order."""
    texts = [f"line {i} of many\n" + "word " * 30 + str(i) for i in range(3000)]
    docs = spark.createDataFrame([(9 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = paragraph_sketch.with_next(docs).select("doc_id", "text", "next_text").collect()
    after = {r["text"]: r["next_text"] for r in rows}
    assert len(after) == 3000 and len(set(after.values())) == 3000
    at, seen = min(texts, key=lambda t: texts.index(t)), []
    for _ in range(3000):
        seen.append(at)
        at = after[at]
    assert len(set(seen)) == 3000
    ids = [9 if texts.index(t) % 3 else texts.index(t) for t in seen]
    assert ids == sorted(ids)


def test_vectors_of_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    data = spark.createDataFrame([(None, x), (1, x), (1, x), (2, [2.0, 4.0, 6.0]), (3, [-1.0, 0.0, 5.0]), (4, []), (1, [3.0, 2.0, -1.0])], "vec_id long, embedding array<double>")
    found = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(data).collect())
    assert found == collections.Counter({(None, 0, None): 1, (1, 2, 1): 2, (2, 2, 1): 1, (3, 0, 3): 1, (4, 0, 4): 1, (1, 0, 1): 1})


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 64, 100])
def test_vectors_of_any_length(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((12, dims))
    x = np.concatenate([base, np.repeat(base, 6, 0) + 0.2 * rng.standard_normal((72, dims))])
    near = (u := x / np.linalg.norm(x, axis=1)[:, None]) @ u.T >= 0.9
    label = np.arange(len(x))
    for _ in label:
        label = np.array([label[n].min() for n in near])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(data).collect()}
    assert found == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))}


def test_crowded_buckets_are_compared_whole(spark, monkeypatch):
    """Chains of near copies, in chunks far smaller than their buckets."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(3):
        text = [rng.choice(words) for _ in range(80)]
        for step in range(40):
            text = list(text)
            if step % 2:
                text[rng.randrange(80)] = rng.choice(words)
            rows.append((family * 100 + step, " ".join(text)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        new = {i: min(label[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
        if new == label:
            break
        label = new
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, bands=32, rows=8).collect()}
    assert found == label


def test_groups_stay_whole_across_batches():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = pa.table({"k": keys, "v": np.arange(500)}).to_batches(max_chunksize=7)
    seen = []
    for table, bounds in runs.whole_groups(iter(batches), ["k"], 50):
        own = table.column("k").to_numpy()
        for a, b in zip(bounds, bounds[1:]):
            assert len(set(own[a:b])) == 1
            seen.append(int(own[a]))
    assert seen == sorted(set(keys.tolist()))
    bounds = np.array([0, 3, 4, 9])
    pairs = [(int(x), int(y)) for left, right in runs.pairs_of(bounds, 4) for x, y in zip(left, right)]
    assert sorted(pairs) == [(i, j) for a, b in zip(bounds, bounds[1:]) for i in range(a, b) for j in range(i + 1, b)]


def test_places_decide_where_texts_do_not(spark):
    """Posteriors against plain Python; the same text is kept at good hosts and goes at bad ones, sparse hosts stay near all documents."""
    text = "plain words that say nothing either way about it"
    rows = [(i, text, "en", "good" if i % 2 else "bad") for i in range(200)] + [(1000 + i, text, "en", f"h{i}") for i in range(10)] + [(2000, text, "de", "bad"), (2001, text, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert all(found[i]["kept"] == bool(i % 2) for i in range(150, 200))  # not labelled
    base = sum(i % 2 for i in range(150)) / 150
    soft = {i: i % 2 if i < 150 else 1 / (1 + math.exp(-found[i]["evidence"])) for i, *_ in rows}
    place = {i: (s, lang) for i, _, lang, s in rows}
    n_path, n_host = collections.Counter(place.values()), collections.Counter(s for s, _ in place.values())
    s_path, s_host = collections.Counter(), collections.Counter()
    for i, p in place.items():
        s_path[p] += soft[i]
        s_host[p[0]] += soft[i]
    m0 = (sum(soft.values()) + 1) / (len(rows) + 2)

    def strength(groups):
        some = [(t, n, m) for t, n, m in groups if n >= 2]
        rows_, squares = sum(n for _, n, _ in some), sum(n * n for _, n, _ in some)
        noise = sum(m * (1 - m) for *_, m in some) / len(some)
        between = (sum(n * (t / n - m) ** 2 for t, n, m in some) - len(some) * noise) / (rows_ - squares / rows_) if rows_ - squares / rows_ else 0
        return min(max(noise / between - 1, quality.STRENGTHS[0]), quality.STRENGTHS[1]) if between > 0 else quality.STRENGTHS[1]

    k_host = strength([(s_host[h], n_host[h], m0) for h in n_host])
    shrunk = {h: (s_host[h] + k_host * m0) / (n_host[h] + k_host) for h in n_host}
    k_path = strength([(s_path[p], n_path[p], shrunk[p[0]]) for p in n_path])
    for i, p in place.items():
        host = (s_host[p[0]] - soft[i] + k_host * m0) / (n_host[p[0]] - 1 + k_host)
        path = (s_path[p] - soft[i] + k_path * host) / (n_path[p] - 1 + k_path)
        score = 1 / (1 + math.exp(-(found[i]["evidence"] + math.log(path / (1 - path)) - math.log(base / (1 - base)))))
        assert found[i]["host_mean"] == pytest.approx(host, rel=1e-6) and found[i]["path_mean"] == pytest.approx(path, rel=1e-6) and found[i]["score"] == pytest.approx(score, rel=1e-6)
    assert all(abs(found[1000 + i]["host_mean"] - m0) < 0.01 for i in range(10))  # a single row's own part is taken out


def test_swapped_terms_weigh_less_with_the_penalty(spark):
    rng = random.Random(4)
    plain = "tree house river walk bread music garden window".split()
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        ws = [rng.choice(plain) for _ in range(12)]
        if toxic:
            ws[3] = rng.choice(["vilething", "horrid"])
        if rng.random() < (0.6 if toxic else 0.1):  # a term that stands mostly in toxic texts
            ws[6] = "muslims"
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probes = spark.createDataFrame([(10_000, "tree muslims house"), (10_001, "tree christians house"), (10_002, "the garden")], "doc_id long, text string")
    gaps, accuracy = [], []
    for penalty in (0.0, 10.0):
        found = {r["doc_id"]: r for r in toxicity.toxicity(docs.union(probes), known, penalty=penalty).collect()}
        gaps.append(abs(found[10_000]["score"] - found[10_001]["score"]))
        held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
        accuracy.append(sum(found[i]["predicted"] == i % 2 for i in held) / len(held))
        assert found[10_002]["predicted"] == 0
    assert gaps[1] < gaps[0] / 2 and accuracy[1] >= 0.97 and found[10_000]["predicted"] == 0


def test_swaps_stay_within_a_language():
    assert set(toxicity.swapped("Die Frauen gehen.")) == {"die männer gehen.", "die mädchen gehen.", "die jungen gehen."}
    assert toxicity.swapped("The white house is old.") == []
    assert "asian people came" in toxicity.swapped("White people came")


STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A small documents table with copies, a secret, a rejected text, and odd rows; and its labels."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + ".", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # copies
    rows += [(200 + i, "$$$ !!! ### @@@ " * 12, "en", "s1") for i in range(12)]  # junk
    rows += [(300, rows[0][1] + " password = hunter2hunter2hunter2", "en", "s2"), (301, None, None, None), (302, "", "en", "s2"), (None, "a text that has no id at all", "en", "s0")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(200 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages_against_plain_python(spark, stored):
    docs = shared.table(spark, stored, "documents")
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = STAGES["quality"](spark, docs, stored)
    kept = {r["doc_id"] for r in good.collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.quality(docs, shared.table(spark, stored, "labels")).collect()}
    assert kept == {i for i, k in judged.items() if k} and not kept & set(range(200, 212)) and set(range(60)) <= kept and good.columns == docs.columns
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (plain[i] or "").split()) else set() for i in kept}
    gone = {b for b in kept if b is not None and sets[b] for a in kept if a is not None and a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    unique = STAGES["near_duplicates"](spark, good, stored)
    assert {r["doc_id"] for r in unique.collect()} == kept - gone and {100, 101, 300} <= gone | {300}
    hidden = STAGES["secrets"](spark, docs, stored)
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert texts[300] == plain[0] + " [assign]" and all(texts[i] == t for i, t in plain.items() if i != 300) and hidden.columns == docs.columns
    mixed = STAGES["mixing"](spark, docs, stored)
    order = [r["mix_position"] for r in mixing.mix_order(docs).orderBy("mix_position").collect()]
    assert order == list(range(len(plain))) and sorted(map(str, (r["doc_id"] for r in mixed.collect()))) == sorted(map(str, plain)) and mixed.columns == docs.columns


def test_pipeline_as_a_whole(spark, stored):
    pieces = corpus_pipeline.run(spark, stored).collect()
    ids = {r["doc_id"] for r in pieces}
    assert set(range(60)) <= ids and not ids & set(range(200, 212)) and not ids & set(range(100, 105))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    for i in tokens:
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == tokens[i]
    held = collections.Counter()
    for r in pieces:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= packing.WINDOW


def test_pipeline_stages_on_nothing(spark, stored):
    docs = shared.table(spark, stored, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, stored).count() == 0, name
    odd = shared.Scratch(spark, "empty").keep(docs, "docs")
    assert corpus_pipeline.STAGES[-1][1](spark, odd, stored).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.queries() if not n.startswith("op8")])
def test_registered_queries_run_on_the_small_table(spark, stored, name):
    found = queries.queries()[name](spark, stored)
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {r["doc_id"] for r in shared.table(spark, stored, "documents").select("doc_id").collect()}


def test_words_are_split_at_ascii_white_space_only():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b c") == ["a b", "c"]
