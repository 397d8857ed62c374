"""The pipeline, stage by stage, against brute force on a small corpus, and as a whole."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lamella.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_components, lower


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rnd = str(tmp_path_factory.mktemp("corpus")), random.Random(6)
    word = lambda: "".join(rnd.choice(("ka", "lo", "mi", "nu", "re", "po")) for _ in range(rnd.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels, passage = [], [], prose(14)
    for i in range(400):
        w = prose(rnd.randint(20, 60)).split()
        if toxic := i % 5 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(("moron", "scum", "you are an idiot")))
        if i % 17 == 3:
            w[5:5] = passage.split()
        docs.append((i, " ".join(w), "en", rnd.choice(("s1", "s2", None)), 0))
        labels.append((i, 1, int(toxic)))
    for i in range(60):
        w = docs[2 * i + 1][1].split()
        w[-1] = word()
        docs.append((1000 + i, " ".join(w), "en", "s3", 0))
    docs += [docs[7], docs[7], (2000, None, "en", "s1", 0), (2001, "", None, "s1", 0), (None, docs[9][1], "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages(spark, corpus):
    folder, docs, passage = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    at = {n: f for n, f in corpus_pipeline.STAGES}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (str(r[0]), str(r[1]))

    clean = at["toxicity"](spark, df, folder)
    got = Counter(key(r) for r in clean.collect())
    bad = re.compile("moron|scum|idiot")
    assert clean.columns == df.columns and got == Counter(key(r) for r in docs if not bad.search(r[1] or ""))

    left = [tuple(r) for r in clean.collect()]
    one = at["near_dedup"](spark, clean, folder)
    comps = brute_components([(r[0], r[1]) for r in left], 5, 80)
    kept = one.collect()
    assert one.columns == df.columns and {str(r.doc_id) for r in kept if (r.text or "").strip()} == {c for _, n, c in comps if n} and len(kept) == len({c for _, n, c in comps if n}) + sum(not n for _, n, _ in comps)

    pure = at["decontamination"](spark, one, folder)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    p = words(passage)
    grams = {tuple(p[i : i + 10]) for i in range(len(p) - 9)}
    has = lambda t: any(tuple(words(t)[i : i + 10]) in grams for i in range(len(words(t)) - 9))
    assert Counter(key(r) for r in pure.collect()) == Counter(key(r) for r in kept if not has(r.text)) and any(has(r.text) for r in kept)

    mixed = at["mixing"](spark, pure, folder)
    times = Counter(key(r) for r in mixed.collect())
    there = {key(r): r for r in pure.collect()}
    assert mixed.columns == df.columns and set(times) <= set(there) and max(times.values()) <= 2
    size = lambda k: len((there[k].text or "").split())
    assert abs(sum(size(k) * n for k, n in times.items()) / (1.5 * sum(map(size, there))) - 1) < 0.1

    shards = at["sharding"](spark, mixed, folder).collect()
    assert Counter(str(r.doc_id) for r in shards) == Counter({k[0]: sum(n for q, n in times.items() if q[0] == k[0]) for k in times})


def test_whole_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    assert {r.shard for r in out} == set(range(8)) and corpus_pipeline.ORACLE_SQL is None
    again = corpus_pipeline.run(spark, corpus[0]).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in again)


def test_all_queries_are_registered():
    names = {int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES}
    assert names == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
