"""Collocations, divergence and manifest against brute force; the labelled sample with very long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import collocations, common, divergence, labelled, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, key string, id long, word string, slot int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rnd = random.Random(9)
    common_, rare = "the of and to in is it été was".split(), [f"w{i}x" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(common_) if rnd.random() < 0.6 else rnd.choice(rare) for _ in range(n))
    texts = [None, "", " \n", "One", "New York City. New York, new york\x0bcity", "a\tb  a b", "."]
    texts += [f"{prose(30)}. {prose(9)}, New York City!\n{prose(20)}" for _ in range(60)]
    texts += [prose(rnd.randint(40, 200)) for _ in range(40)] + [prose(20_000)] + ["spam ham " * 90] * 3 + [f"###{prose(60).upper().replace(' ', '&&& ')}" for _ in range(6)]
    made = [(i, rnd.choice(["a"] * 6 + ["b", "é", None]), rnd.choice(["en", "en", "fr", None, "und"]), rnd.choice([None, len(t or "")]), t, 1, "k", 2, "w", 3) for i, t in enumerate(texts)]
    made += [(1000 + i, "a", "en", i, f"Text number {i}", 1, "k", 2, "w", 3) for i in range(300)] + [(5000, "lone", "en", 1, "A", 0, "", 0, "", 0)]
    return made + [made[9], made[9], made[20], (None, "a", "en", 3, "x Y", 1, "k", 2, "w", 3), (None,) * 10, (None,) * 10]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_numbered(spark):
    df = common.stored(spark.range(2000).selectExpr("if(id % 5 < 3, 7, id % 5) as g", "id % 90 as v", "id as w"))
    got = common.numbered(df, ["g"], [F.desc("v"), F.col("w")], rows_per_task=50).collect()
    order = defaultdict(list)
    for i in range(2000):
        order[7 if i % 5 < 3 else i % 5].append((-(i % 90), i))
    want = {(g, i): p for g, xs in order.items() for p, (_, i) in enumerate(sorted(xs))}
    assert {(r.g, r.w): r.place for r in got} == want and len(got) == 2000


def mined(data, least, top):
    pieces = defaultdict(list)
    for lang, text in data:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            pieces["und" if lang is None else lang].append(re.findall(r"[^ \t]+", piece))
    out = []
    for lang, all_pieces in pieces.items():
        f = Counter(tuple(p[i : i + m]) for p in all_pieces for m in range(1, 6) for i in range(len(p) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {(p[i : i + m], c) for p, c in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        best = []
        for p, a in candidates.items():
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any((p, c) in inside for c in [a]):
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "most_words"), [(5, 2000, 1_000_000), (5, 40, 0), (70, 2000, 1_000_000)])
def test_collocations(docs, least, top, most_words):
    """A dictionary that is broadcast, and one that is joined."""
    got = collocations.collocations(docs, least, top, most_words=most_words)
    want = mined([(r[2], r[4]) for r in rows()], least, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    for data in ([], [(1, None)], [(1, "a b. c")]):
        assert collocations.collocations(spark.createDataFrame(data, "lang int, text string").withColumn("lang", F.lit("en"))).count() == 0


@pytest.mark.parametrize("digits", [1, 2])
def test_radix_sort_is_a_sort(digits):
    """Numbers above 16 bits take two digits; ranges cut anywhere give the same counts."""
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 1 << 16 if digits == 1 else 1 << 20, 30) * rnd.integers(0, 2, 30)
    ids = np.concatenate([rnd.choice(ids, 5000), np.zeros(collocations.LONGEST, np.int64)])
    keys = collocations.keys_of(ids, digits)
    got, counts = collocations.radix_sorted(keys)
    want = Counter(bytes(k.astype(">u2")) for k in keys)
    assert [bytes(k.astype(">u2")) for k in got] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
    assert Counter(dict(zip(map(bytes, got.astype(">u2")), collocations.radix_sorted(np.concatenate([got, got]), np.concatenate([counts, counts]))[1] // 2, strict=True))) == want


def test_scores_beyond_64_bits(spark):
    big = (1 << 62) + 3
    df = spark.createDataFrame([(10**12 + 7, big, 10**12 + 9, 10**13 + 1)], "a long, n long, l long, r long")
    assert df.select(collocations._score(*(F.col(c) for c in "anlr"))).first()[0] == 1000 * (10**12 + 7) * big // ((10**12 + 9) * (10**13 + 1))


def base(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0d]+", t)
    found = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {j for i in range(len(ws) - 2) if found[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(ws) < 50 or 100 * len(inside) > 50 * len(ws)


def test_base_rules(docs):
    got = divergence.quality_rules(docs).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert have == sorted((str(r[0]), *base(r[4])) for r in rows())
    assert not any(r.kept for r in got if r.base_failed)


def test_junk_diverges(docs):
    """Prose stays and words with signs go, whatever language they say they are; a language with few words judges nothing."""
    texts = {r[0]: r[4] for r in rows()}
    got = divergence.quality_rules(docs.filter("doc_id < 1000").withColumn("lang", F.lit("en")))
    for r in got.filter("not base_failed").collect():
        assert r.kept != texts[r.doc_id].startswith("###"), (r.doc_id, r.char_distance, r.word_distance)
    few = divergence.quality_rules(docs.filter("doc_id in (67, 68)")).collect()
    assert all(r.kept and r.char_distance is None for r in few if not r.base_failed)


def test_divergence_by_hand(spark):
    p, q = [3, 0, 1, 6], [10.0, 5.0, 0.0, 5.0]
    x, y = np.array(p) / 10, np.array(q) / 20
    m = (x + y) / 2
    want = sum(a * np.log2(a / b) for v in (x, y) for a, b in zip(v, m, strict=True) if a > 0) / 2
    df = spark.createDataFrame([(p, q, 10, 20.0), ([0] * 4, q, 0, 20.0)], "p array<long>, q array<double>, n long, h double")
    got = [r[0] for r in df.select(divergence.divergence(*(F.col(c) for c in "pqnh"))).collect()]
    assert got[0] == pytest.approx(want) and got[1] is None


def test_junk_of_a_third_is_no_reference(spark):
    rnd = random.Random(2)
    prose = lambda: " ".join(rnd.choice("the of and to in was house river stone".split()) for _ in range(120))
    data = [(i, prose() if i % 3 else " ".join(f"{w}%%%" for w in prose().upper().split()), "xx") for i in range(150)]
    got = divergence.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")).filter("not base_failed").collect()
    assert got and all(r.kept == (r.doc_id % 3 > 0) for r in got)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def siblings(leaves):
    """(root, for each leaf its steps of (before, after))."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            start = i // 16 * 16
            path.append((nodes[start:i], nodes[i + 1 : start + 16]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def proved(data):
    groups, out = defaultdict(list), []
    for r in data:
        tampered = r[4].translate(UPPER) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
        groups[r[1]].append(((r[0] is not None, r[0]) if r[0] is not None else (False, 0), leaf(*r[:5]), leaf(*r[:4], tampered), r[0]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: siblings([x[1] for x in sorted(groups[s])]) for s in sources}
    root, tops = siblings([trees[s][0] for s in sources])
    for s, top in zip(sources, tops, strict=True):
        for (_, own, checked, doc_id), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            steps = path + top
            back = checked
            for before, after in steps:
                back = h(*before, back, *after)
            out.append((str(doc_id), own, trees[s][0], root, h(*(x for a, b in steps for x in a + b)), back, back == root))
    return sorted(out)


@pytest.mark.parametrize("condition", ["true", "source = 'lone'", "source = 'a'", "doc_id between 1000 and 1015"])
def test_merkle(spark, docs, condition, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.filter(condition).write.parquet(path)
    got = merkle.op13_merkle(spark, str(tmp_path))
    keep = {"true": lambda r: True, "source = 'lone'": lambda r: r[1] == "lone", "source = 'a'": lambda r: r[1] == "a"}.get(condition, lambda r: r[0] is not None and 1000 <= r[0] <= 1015)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()) == proved([r for r in rows() if keep(r)])


def test_merkle_of_nothing(spark):
    got = merkle.verify(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and "folded_root" in got.columns


@pytest.mark.parametrize("long_at", [0, 30, None])
def test_sample_with_texts_over_the_bound(spark, long_at):
    """A text of any length keeps no other out, wherever its hash puts it; if all are too long, that is an error."""
    data = [(i, "x" * 40) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64(F.lit(3), "doc_id")).collect()]
    sizes = {i: 1200 if long_at is not None and i == order[long_at] else 40 for i, _ in data}
    df = spark.createDataFrame([(i, "x" * n) for i, n in sizes.items()], "doc_id long, text string")
    got = labelled.sample(df, labels, "quality", 4, 2, 1000, most_bytes=1000).collect()
    assert len(got) >= 23 and all(len(r.text) == 40 for r in got)
    with pytest.raises(ValueError, match="no labelled text"):
        labelled.sample(df.withColumn("text", F.repeat("text", 100)), labels, "quality", 4, 2, 1000, most_bytes=1000)
