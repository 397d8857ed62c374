"""Shared helpers, odd input and small brute-force versions of what other tests only bound."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import common, decontaminate, embedding_dedup, labelled, line_dedup, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity
from lamella.llm.tokens import split


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (toxicity.score_toxicity(df, labels), quality.score_quality(df, labels), suffix_dedup.remove_repeats(df), near_dedup.keep_one(df)):
        assert made.count() == 2
    assert spark.conf.get(key) == before


def tables(spark):
    root = common._run_folder(spark)
    return sum("_SUCCESS" in files for _, _, files in os.walk(root))


def test_stored_tables_go(spark):
    df = spark.createDataFrame([(i, f"{i % 7} some words that are long enough to be a line of their own") for i in range(50)], "doc_id long, text string")
    before = tables(spark)
    assert line_dedup.dedup_lines(df).count() == 50 and near_dedup.near_duplicates(df).count() == 50
    assert tables(spark) - before <= 5  # what the results themselves read, and labels of components


def test_no_folder_outside_local_mode(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Cluster())


@pytest.mark.parametrize("most", [1000, 2])
def test_sized_join(spark, most):
    left = common.stored(spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as key", "id as v"))
    right = common.stored(left.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    got = common.sized_join(left, right, ["key"], "n", 3000, most).collect()
    assert Counter((r.key, r.v, r.top) for r in got) == Counter((0 if i % 3 == 0 else i, i, 2997 if i % 3 == 0 else i) for i in range(3000))


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 7), (1, 2), (2, 3), (3, 4), (4, 1), (20, 30), (30, 20)]
    got = {r["node"]: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 7, 8: 7, 7: 7, 1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 30: 20}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_tells_nulls_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("x", "x")], "a string, b string")
    assert df.select(*common.digest(F.col("a"), F.col("b"))).distinct().count() == 4


def test_helper_names_do_not_clash(spark):
    """Columns named like the operators' own, and an id that isn't a number."""
    names = "_rk _window_k1 _window_k2 k1 k2 row group node n id text_ best".split()
    texts = ["alpha beta gamma delta epsilon zeta"] * 3 + ["one two three four five six", None, ""]
    df = spark.createDataFrame([(f"d{i}", t, *([1] * len(names))) for i, t in enumerate(texts)], ", ".join(["doc_id string", "text string", *(f"`{x}` int" for x in names)]))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["d0", "d3", "d4", "d5"]
    bench = spark.createDataFrame([(1, texts[3], 1)], "item_id long, text string, _window_k1 int")
    pure = decontaminate.drop_contaminated(df, bench)
    assert pure.columns == df.columns and sorted(r.doc_id for r in pure.collect()) == ["d0", "d1", "d2", "d4", "d5"]
    assert line_dedup.dedup_lines(df).count() == suffix_dedup.remove_repeats(df).count() == 6
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert found == {"d0": "d0", "d1": "d0", "d2": "d0", "d3": "d3", "d4": "d4", "d5": "d5"}


def runs(words, asked, within):
    """Shortest runs that end at a term: for each end, the latest start that holds all."""
    out = []
    for stop, w in enumerate(words):
        if w in asked:
            last = {t: max((i for i in range(stop + 1) if words[i] == t), default=None) for t in asked}
            if None not in last.values() and stop - min(last.values()) < within:
                out.append((min(last.values()), stop))
    return out


@pytest.mark.parametrize("asked", [[], ["a"], ["a", "b"], ["A", "b", "a"], ["a", "b", "c"], ["nowhere"], ["a", "nowhere"], ["é"]])
def test_proximity_like_brute_force(spark, asked):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdexyz") for _ in range(n)) for n in (0, 1, 3, 10, 40, 40, 3000)] + [None, " . ", "a a a b b b", "A-b É é", "a a a b b b"]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(9, texts[9], 1), (None, "a b c", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, term int")
    split_ = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = Counter((i, *r) for i, t, _ in data for r in runs(split_(t), {x.lower() for x in asked}, 5) if asked)
    assert Counter(map(tuple, decontaminate.proximity_matches(df, asked, 5).collect())) == want
    assert decontaminate.proximity_matches(df.limit(0), asked, 5).count() == 0


def test_window_of_frequent_terms(spark):
    """All terms of the item are everywhere; only one order of them is a match."""
    rnd = random.Random(1)
    terms = list("abcdefghij")
    docs = [(i, " ".join(rnd.sample(terms, 10) * 3)) for i in range(200)] + [(900, " ".join(["x", *terms, "x", *terms]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(terms))], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(df, bench).collect()}
    text = {i: t.split() for i, t in docs}
    want = {i: len({p for s in range(len(w) - 9) if w[s : s + 10] == terms for p in range(s, s + 10)}) for i, w in text.items()}
    assert got == want and want[900] == 20


def test_op_queries_give_digests(spark, tmp_path):
    folder = str(tmp_path)
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, line = noise(450), "This line is long enough to count as one that repeats."
    texts = [noise(100) + shared + noise(50), shared + noise(700), noise(900), None, "", *(f"{noise(10)}\n {line} \n{noise(5)}" for _ in range(6))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    got = {r.doc_id: r for r in suffix_dedup.op1_suffix_dedup(spark, folder).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for k, b in enumerate(raw):
        gone = {p for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1 for p in range(i, i + 400)}
        assert (got[k].n_bytes, got[k].n_removed, got[k].kept_sha256) == (len(b), len(gone), sha(bytes(x for p, x in enumerate(b) if p not in gone)))
    assert got[0].n_removed >= 450 and got[0].n_spans == 1
    got = {r.doc_id: r for r in line_dedup.op10_line_dedup(spark, folder).collect()}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip() != line or k == 10]
        assert (got[k].n_lines, got[k].n_dropped, got[k].kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert got[10].n_dropped == 0 and got[5].n_dropped == 1


def test_passage_of_over_50_words_goes_from_400_bytes_on(spark, tmp_path):
    """Bytes count, not words: 55 shared words in 399 bytes stay, in 400 they go. A passage repeated within one text goes too."""
    rnd = random.Random(12)
    passage = lambda last: " ".join([*("".join(rnd.choice("abcd") for _ in range(6)) for _ in range(54)), "é" * (last // 2) + "z" * (last % 2)])
    short, even, own = passage(21), passage(22), passage(22)
    assert [len(x.split()) for x in (short, even, own)] == [55] * 3 and [len(x.encode()) for x in (short, even, own)] == [399, 400, 400]
    texts = [f"A{short}B", f"C{short}D", f"1{even}2", f"3{even}4", f"5{own}6 7{own}8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    left = [(0, 0, texts[0]), (0, 0, texts[1]), (400, 1, "12"), (400, 1, "34"), (800, 2, "56 78")]
    assert got == {k: (n, spans, hashlib.sha256(t.encode()).hexdigest()) for k, (n, spans, t) in enumerate(left)}


def test_passages_of_51_words_are_told_below_400_bytes(spark, tmp_path):
    """Bytes that the contract keeps: 51 shared words in 304 bytes stay, but they are counted; 50 aren't."""
    rnd = random.Random(13)
    passage = lambda n: " ".join("".join(rnd.choice("abcd") for _ in range(5)) for _ in range(n))
    told, short, own = passage(51), passage(50), passage(52)
    texts = [f"one {told} two", f"{told.upper()}\nthree", f"four {short} five", f"six {short} seven", f"{own} x {own}", None, "", passage(60)]
    assert len(told) < 400
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_passage_words, r.n_removed) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([(51, 0), (51, 0), (0, 0), (0, 0), (104, 0), (0, 0), (0, 0), (0, 0)]))


@pytest.mark.parametrize("crowd", [512, 2])
def test_passage_words_like_brute_force(spark, crowd):
    n, rnd = 9, random.Random(14)
    pool = [[rnd.choice(["a", "B", "cé", "ddd", "\x00"]) for _ in range(40)] for _ in range(6)]
    blank = lambda: rnd.choice([" ", "\n", "\t  "])
    data = [(None, None), (1, ""), (2, "a " * 30), (2, "a " * 30), (3, "a " * 8), (4, "A b " * 20)]
    for i in range(120):
        words = [w for _ in range(3) for p in [rnd.choice(pool)] for k in [rnd.randrange(30)] for w in [*p[k : k + rnd.randint(2, 16)], f"w{rnd.randrange(9)}"]]
        data.append((10 + i, "".join(w + blank() for w in words)))
    split_up = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t in data]
    seen = Counter(tuple(w[k : k + n]) for w in split_up for k in range(len(w) - n + 1))
    want = [(str(i), len({p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)})) for (i, _), w in zip(data, split_up, strict=True)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, 40, 8, crowd, words=n).collect()
    assert sorted((str(r.doc_id), r.n_passage_words) for r in got) == sorted(want) and sum(x > 0 for _, x in want) > 20
    assert suffix_dedup.remove_repeats(df.limit(0), words=n).count() == 0


def test_line_in_many_places_of_a_long_text(spark):
    line = "A line of forty code points and some more, which repeats."
    data = [(i, line) for i in range(5)] + [(3, "\n".join(f"{line}\n{k}" for k in range(30_000)))]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.kept_text)) for r in line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect())
    kept = len("\n".join(map(str, range(30_000))))
    assert got == [(0, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0), (3, 60_000, 30_000, kept), (4, 1, 0, len(line))]


def test_embedding_tables_count_a_pair_once(spark):
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((6, 8))
    x = np.concatenate([b + 0.05 * rnd.standard_normal((30, 8)) for b in base])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()
    for block in (2048, 7):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, recall=0.99999, block=block).collect()}
        assert [got[i] for i in range(len(x))] == want


def test_recall_at_the_limit():
    """Tables and keys as planned for a few sizes: the chance to find a pair just at the limit."""
    for n in (10, 10_000, 10**7):
        k, tables_ = embedding_dedup.table_plan(n)
        near = embedding_dedup.step_chance((2 - 2 * 0.9) ** 0.5, embedding_dedup.WIDTH) ** k
        assert 1 - (1 - near) ** tables_ >= embedding_dedup.RECALL


QUOTED = [
    "He said you are an idiot.", "He said, you are an idiot.", 'He said: "You are an idiot."', '"You are an idiot", he said.', '"You are an idiot!" he said.',
    "“You are an idiot,” she wrote.", '"You are an idiot" he said.', "They told me, quite calmly, that you are an idiot.", "The paper reported (on page 3) that you are an idiot.", "«You are an idiot», dijo.",
]
PLAIN = ["You are an idiot.", "You are an idiot! John says hi.", "He said hello. You are an idiot.", 'You are an "idiot".']


def best_clause(text):
    lexicon = toxicity.learn_lexicon([], np.zeros(0))
    step, start = toxicity.grammar()
    return [toxicity.match(data, offs, lexicon, step, start)[0, -2] for _, data, offs in toxicity.pieces(toxicity.folded(pa.array([text])))][0]


def test_reported_speech_in_ten_quotations():
    plain = best_clause("You are an idiot.")
    assert [best_clause(x) for x in PLAIN] == [plain] * len(PLAIN)
    assert all(best_clause(x) == plain - 1 for x in QUOTED)


def test_case_folds_in_every_script():
    assert best_clause("ESTÚPIDO") == best_clause("estúpido") > 0


def by_patterns(text):
    """A clause read with plain patterns, for texts of one clause."""
    words = re.findall(r"[a-z]+", text.lower())
    total = 0.0
    for i, w in enumerate(words):
        kind = "insult" if w in toxicity.INSULTS else "threat" if w in toxicity.THREATS else None
        if kind:
            near = words[max(0, i - toxicity.REACH) : i]
            targeted, reported = any(x in toxicity.TARGETS for x in words), any(x in toxicity.REPORTS for x in words[:i])
            negated, cued = any(x in toxicity.NEGATIONS for x in near), any(x in toxicity.THREAT_CUES for x in near)
            total += (1.5 if kind == "insult" else -1.0) + targeted - 1.5 * negated - reported + (1.5 if cued and kind == "threat" else 0)
    return total


def test_transducers_like_patterns():
    rnd = random.Random(11)
    words = ["idiot", "moron", "kill", "hurt", "you", "them", "not", "never", "said", "wrote", "will", "i", "cat", "sat", "the", "very", "tree"]
    lexicon = toxicity.learn_lexicon([], np.zeros(0))
    step, start = toxicity.grammar()
    for _ in range(500):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))
        raw = text.encode()
        got = toxicity.match(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lexicon, step, start)[0]
        want = by_patterns(text)
        assert got[-2] == pytest.approx(max(0.0, want)), text
        assert got[-1] == pytest.approx(max(0.0, want)), text


def test_quality_weights_like_plain_python():
    """Log-count ratios, scaled indicators and scores of a tiny corpus, by dictionaries."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("ab cd ef gh ij".split()) for _ in range(6)) + (" junk junk" if i % 2 else " prose") for i in range(80)]
    y = [1 - i % 2 for i in range(80)]
    model = quality.fit(texts, y, 0.5, bits=14)
    grams = []
    for _, data, offs in quality.pieces(pa.array(texts)):
        at, first = quality.features(data, offs, 14)
        grams = [set(at[i:j].tolist()) for i, j in zip(first[:-1], first[1:], strict=True)]
    size = 1 << 14
    up, down = Counter(g for s, k in zip(grams, y, strict=True) if k for g in s), Counter(g for s, k in zip(grams, y, strict=True) if not k for g in s)
    total = [sum(c.values()) + size for c in (up, down)]
    ratio = {g: np.log((up[g] + 1) / total[0]) - np.log((down[g] + 1) / total[1]) for s in grams for g in s}
    # the hinge model by a plain loop over dictionaries, in the same order of rows
    order, w, b, alpha = np.random.default_rng(quality.SEED), Counter(), 0.0, [0.0] * 80
    sign, cost = [1 if k else -1 for k in y], quality.COST
    x = [{g: ratio[g] / len(s) ** 0.5 for g in s} for s in grams]
    for _ in range(quality.ROUNDS):
        for k in order.permutation(80):
            margin = sign[k] * (sum(w[g] * v for g, v in x[k].items()) + b) - 1
            new = min(max(alpha[k] - margin / (1 + sum(v * v for v in x[k].values())), 0.0), cost)
            for g, v in x[k].items():
                w[g] += (new - alpha[k]) * sign[k] * v
            b += (new - alpha[k]) * sign[k]
            alpha[k] = new
    want = [sum(w[g] * ratio[g] for g in s) / len(s) ** 0.5 + b for s in grams]
    at = np.concatenate([sorted(s) for s in grams]).astype(int)
    margins = model.margins(at, np.concatenate([[0], np.cumsum([len(s) for s in grams])]))
    assert np.allclose(margins, want, atol=1e-6)
    scores = model.scores(margins)
    assert ((scores > 0.5) == np.array(y, bool)).all() and np.allclose(scores, 1 / (1 + np.exp(-(model.slope * margins + model.shift))))


def test_shards_like_one_sorted_list(spark):
    """Rows in order of key, cut where the middle of a row passes a shard's end; groups of equal short texts stay together."""
    rnd = random.Random(9)
    data = [(i, "x" * rnd.randint(0, 60) + str(rnd.randint(0, 400))) for i in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, text string"), range_rows=32).collect()
    sizes = {i: len(t.encode()) + 1 for i, t in data}
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    total, at = sum(sizes.values()), 0
    group = Counter((r.text_crc32, r["size"]) for r in got)
    for r in order:
        middle = at + sizes[r.doc_id] / 2
        at += sizes[r.doc_id]
        slack = group[r.text_crc32, r["size"]] * r["size"]  # a group goes where its first row goes
        assert r.shard in {min(7, int(max(0, middle - s) * 8 // total)) for s in (0, slack)} | {min(7, int((middle + slack) * 8 // total))}
    assert [r.slot for r in order] == [k for s in range(8) for k in range(sum(r.shard == s for r in got))]


def test_sharding_subdivides_until_no_range_is_overfull(spark, monkeypatch):
    """Keys that the sample knows nothing of still come out even."""
    monkeypatch.setattr(sharding, "PER_RANGE", 1)
    df = spark.range(4000).selectExpr("id as doc_id", "if(id < 1500, 'same', concat('t', id)) as text")
    sums = [r[1] for r in sharding.assign_shards(df, range_rows=8).groupBy("shard").sum("size").collect()]
    assert len(sums) == 8 and max(sums) <= 1.05 * min(sums)


def test_sample_of_labels(spark):
    docs = [(i, "é" * (i % 50)) for i in range(400)] + [(5, "z"), (None, "x"), (6, None)]
    labels = [(i, i % 2) for i in range(300)] + [(1, 0), (2, None), (3, 7), (None, 1), (250, 0), (10, 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    use = {i: i % 2 for i in range(300) if i not in (1, 3) and zlib.crc32(str(i).encode()) % 3 != 1}
    got = labelled.sample(d, lab, "toxic", 3, 1, 10_000).collect()
    assert {r.id: r.y for r in got} == use and len(got) == len(use)
    few = labelled.sample(d, lab, "toxic", 3, 1, 60, ones=0.25).collect()
    assert sum(r.y for r in few) == 15 and len(few) == 60
    for bound in (0, 300, 2000):
        part = labelled.sample(d, lab, "toxic", 3, 1, 10_000, most_bytes=bound).collect()
        held = sum(len((r.text or "").encode()) for r in part)
        assert held <= bound and held >= bound - 100
    assert labelled.sample(d.limit(0), lab, "toxic", 3, 1, 9).count() == labelled.sample(d, lab.limit(0), "toxic", 3, 1, 9).count() == 0


def test_targets_and_seats_of_nothing(spark):
    none = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")
    assert [r.target for r in mixing.source_targets(none).collect()] == [0.0, 0.0]
    some = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 0), ("b", 100), (None, 10)], "source string, source_size long")).collect()}
    assert some["a"] == 0.0 and some["b"] + some[None] == pytest.approx(165.0) and some[None] <= 20.0
    assert mixing.source_targets(none.limit(0)).count() == 0
    claims = spark.createDataFrame([(0, "a", 0.0, 5), (0, None, 0.0, 5), (1, "a", 3.0, 4), (1, None, 1.0, 4), (1, "z", 0.0, 4)], "g int, name string, claim double, seats long")
    got = {(r.g, r["name"]): r.quota for r in mixing.apportion(claims, ["g"], "claim", "seats", ["name"]).collect()}
    assert got == {(0, "a"): 0, (0, None): 0, (1, "a"): 3, (1, None): 1, (1, "z"): 0}


def test_a_word_is_its_hash_in_any_text():
    a, b = (split(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hash for x in (b"one two", b"two  ONE"))
    assert a.tolist() == b.tolist()[::-1]
