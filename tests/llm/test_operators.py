"""Each operator against brute force on a small corpus with nulls, blanks, ties, repeated rows, long texts and clashing columns."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lamella.llm import decontaminate, embedding_dedup, line_dedup, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity
from lamella.llm.tokens import split

SCHEMA = "doc_id long, text string, source string, n long, size string, k1 long, score double, node long, rk long"


def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(("ka", "lo", "mi", "nu", "re", "ßé")) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, shared, line = prose(120), prose(110), prose(12)
    texts = [None, "", " \n\t ", "One", "x y", base, base, base + " end", "Start " + base, base.upper(), "ab" * 700, "ab" * 300]
    texts += [prose(30) + " " + shared + " " + prose(30) for _ in range(4)]
    texts += [f"{prose(9)}\n  {line.upper() if i % 2 else line} \n{prose(8)}\n{line}" for i in range(7)]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [prose(rnd.randint(1, 400)) for _ in range(12)] + [prose(20_000)]
    out = [(i, t, rnd.choice(("a", "b", "é", None)), 1, "x", 2, 0.5, 3, 4) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, base, "a", 1, "x", 2, 0.5, 3, 4), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_words_match_regex():
    texts = [r[1] or "" for r in rows()] + ["", "a", " a", "a ", "é\x0bÉ\x1fb"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = split(np.frombuffer(b"".join(raw), np.uint8), offs)
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [y for x in want for y in x]
    seen = dict(zip(flat, w.hash.tolist(), strict=True))
    assert [seen[x] for x in flat] == w.hash.tolist() and len(set(seen.values())) == len(seen)


def test_line_dedup(docs, empty):
    found, last = defaultdict(set), {}
    data = [(r[0], r[1]) for r in rows()]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -1 if i is None else i
    for i, t in data:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                found[key(x)].add(order(i))
    last = {k: max(v) for k, v in found.items() if len(v) >= 5}
    assert last
    want = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == order(i)]
        want.append((order(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = [(order(r[0]), *r[1:]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=2, shard_words=64).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows())
    z = Counter()
    for r in rows():
        z[r[2]] += size(r[1])
    target, open_ones, share = {}, sorted(z, key=lambda s: (s is None, s or "")), 1.5 * sum(z.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(open_ones)}
    while True:
        over = [s for s in open_ones if (share - sum(target.values())) * weight[s] / sum(weight[x] for x in open_ones) > 2 * z[s]]
        if not over:
            break
        target |= {s: 2 * z[s] for s in over}
        open_ones = [s for s in open_ones if s not in target]
    left = share - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == z[r.source] and math.isclose(r.target, target[r.source])
        taken[r.source] += r.taken
    for s, want in target.items():
        assert abs(taken[s] - want) <= 2 + 2 * (z[s] / 64 + 2)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block=2, shard_words=64).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_apportionment_gives_highest_quotients(spark):
    claims = [("a", 530.0), ("b", 240.0), ("c", 23.0), ("d", 7.0), ("e", 0.0), ("f", 530.0)]
    for seats in (0, 1, 7, 100, 1000):
        df = spark.createDataFrame([(0, *c, seats) for c in claims], "g int, name string, claim double, seats long")
        got = {r["name"]: r.quota for r in mixing.apportion(df, ["g"], "claim", "seats", ["name"]).collect()}
        want = Counter(n for _, n in sorted((-c / (2 * k - 1), n) for n, c in claims if c for k in range(1, seats + 1))[:seats])
        assert got == {n: want[n] for n, _ in claims}


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, shards=4, range_rows=2).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    by, weight = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign_shards(empty).count() == 0


def test_sharding_balances(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy of one text', repeat('x', cast(id % 97 as int))) as text")
    got = sharding.assign_shards(df).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) <= 1.05 * min(sums)


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontamination(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "LIST_ROWS", most)
    all_rows = rows()
    longest = max((r[1] or "" for r in all_rows), key=len).split()
    items = [(1, " ".join(longest[50:75])), (2, "ONE"), (3, None), (4, "..."), (None, " ".join(longest[300:311])), (10, "no such words here at all in the corpus, none of them"), (5, "Ab" * 300)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, k1 int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    want = []
    for r in all_rows:
        w, hit, names = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    names |= {str(i) for i in windows[x] if i is not None}
        want.append((str(r[0]), len(w), len(hit), sorted(names)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()) == sorted(want)
    assert any(x[2] for x in want)
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs, bench).collect()) == sorted(x[0] for x in want if not x[2])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x b y a"), (2, "a q q q b"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, decontaminate.proximity_matches(df, ["a", "b"], 3).collect())) == [(1, 0, 2), (1, 2, 4)]


def brute_components(data, n, percent):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(data)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(data):
        ids[top(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(str(d), len(sets[i]), str(least[top(i)])) for i, (d, _) in enumerate(data)]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, empty, n, percent):
    data = [(r[0], r[1]) for r in rows()]
    got = near_dedup.near_duplicates(docs, n, percent, recall=0.999999).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(data, n, percent))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("block", "direct"), [(512, 1), (7, 99), (7, 1), (1, 1)])
def test_near_dedup_compares_blocks(spark, monkeypatch, block, direct):
    """Many texts that are neither near nor far, by one block and by many."""
    whole = near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda b, s, p, temp: whole(b, s, p, temp, block, direct))
    rnd = random.Random(1)
    base = [str(i) for i in range(100)]
    data = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(2, 5)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 3, 85, recall=0.999999)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == sorted(brute_components(data, 3, 85))


def test_keep_one(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    data = [(r[0], r[1]) for r in rows()]
    want = brute_components(data, 5, 80)
    groups, blank = {x[2] for x in want if x[1]}, sum(not x[1] for x in want)
    assert kept.count() == len(groups) + blank
    assert {str(r.doc_id) for r in kept.collect() if (r.text or "").strip()} == groups


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((40, 16))
    near = base[:20] + 0.12 * rnd.standard_normal((20, 16))
    vecs = [list(map(float, v)) for v in np.concatenate([base, near, base[:3], 2 * base[3:5]])]
    vecs += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0], [2.0]]
    data = [(i, v, 0) for i, v in enumerate(vecs)] + [(None, vecs[0], 0), (0, vecs[0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, node int")
    xs = [np.array(v, np.float32).astype(float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v, _ in data]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    n, comp = [sum(link(a, b) for j, b in enumerate(xs) if j != i) for i, a in enumerate(xs)], list(range(len(xs)))
    for _ in xs:
        comp = [min([comp[i], *(comp[j] for j in range(len(xs)) if j != i and link(xs[i], xs[j]))]) for i in range(len(xs))]
    ids = defaultdict(list)
    for i, c in enumerate(comp):
        if data[i][0] is not None:
            ids[c].append(data[i][0])
    want = sorted((str(data[i][0]), n[i], str(min(ids[c], default=None))) for i, c in enumerate(comp))
    for block in (512, 3):
        got = embedding_dedup.near_vectors(df, recall=0.9999, block=block).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [512, 2])
def test_suffix_dedup(docs, empty, crowd):
    length, width = 40, 8
    raw = [(r[0], (r[1] or "").encode()) for r in rows()]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    want = []
    for d, b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        want.append((str(d), len(b), sum(cover), spans, kept))
    got = suffix_dedup.remove_repeats(docs, length, width, crowd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_interleave_finds_repeats_like_brute_force():
    rnd = random.Random(2)
    pool = [bytes(rnd.choice(b"ab") for _ in range(90)) for _ in range(4)]
    slices, anchors, groups = [], [], []
    for g in range(3):
        for _ in range(12):
            a = rnd.randint(0, 24)
            s = pool[rnd.randrange(2)][:a][::-1][:a] + pool[2 + rnd.randrange(2)][: rnd.randint(34, 60)]
            slices.append(s)
            anchors.append(a)
            groups.append(g)
    low, high, length = 0, 24, 32
    down, up = suffix_dedup.repeats(np.array(groups), np.arange(len(slices)) % 3, slices, np.array(anchors), low, high, length)
    for i, (s, a, g) in enumerate(zip(slices, anchors, groups, strict=True)):
        ds = [d for d in range(min(a, high) + 1) if a - d + length <= len(s) and any(j != i and groups[j] == g and anchors[j] >= d and slices[j][anchors[j] - d : anchors[j] - d + length] == s[a - d : a - d + length] for j in range(len(slices)))]
        assert (down[i], up[i]) == ((min(ds), max(ds)) if ds else (-1, -1))


def labelled(spark):
    rnd = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "co", "du", "fe") for b in ("lin", "mor", "nat", "pe") for c in ("s", "t", "ra", "vo")]
    docs, labels = [], []
    for i in range(900):
        bad, junk = rnd.random() < 0.3, rnd.random() < 0.3
        w = [rnd.choice(words) for _ in range(60)]
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(60), rnd.choice(("moron", f"xqor{rnd.choice(words)}", "you are scum")))
        if junk:
            w = [x + "***" for x in w]
        docs.append((i, " ".join(w), "s", 0.0))
        labels.append((i, int(not junk), int(bad)))
    docs += [(900, None, None, 0.0), (901, "", None, 0.0), (None, "moron", None, 0.0), (0, docs[0][1], "s", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("name", "parts", "out"), [("quality", 4, 2), ("toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, name, parts, out):
    docs, labels = labelled(spark)
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    got = score(docs, labels).collect()
    truth = {r.doc_id: r[name] for r in labels.collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % parts == out) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 150 and sum(right) / len(right) > 0.95
    assert score(docs.limit(0), labels).count() == 0 and score(docs, labels.limit(0)).count() == 904


def test_drop_toxic_keeps_clean_rows(spark):
    docs, labels = labelled(spark)
    kept = toxicity.drop_toxic(docs, labels)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(set(range(900)) - toxic - set(ids)) <= 9 and len(toxic & set(ids)) <= 0.1 * len(toxic)


def test_grammar_weighs_clauses():
    lexicon = toxicity.learn_lexicon([], np.zeros(0))
    step, start = toxicity.grammar()

    def weight(text):
        raw = text.encode()
        return toxicity.match(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lexicon, step, start)[0, -2]

    assert weight("you are an idiot") > weight("an idiot") > weight("you are not an idiot") and weight("the cat sat") == 0
    assert weight("He said you are an idiot.") < weight("You are an idiot.")
    assert weight("i will kill you") > weight("the play may kill")


def test_hinge_model_separates():
    rnd = np.random.default_rng(0)
    y = np.where(rnd.random(300) < 0.4, 1, -1)
    at = np.stack([np.where(y > 0, 1, 2), rnd.integers(3, 50, 300)], 1)
    w, b = quality.dual_coordinate_descent(at.ravel(), np.arange(301) * 2, np.ones(600), y, 50, np.full(300, 1.0), 20, 1)
    assert (np.sign(w[at].sum(1) + b) == y).all()


def test_license_scan(spark, docs, empty):
    from lamella.llm import licenses

    data = [
        (1, "Copyright 2020 Somebody\n\n" + licenses.MIT.upper().replace("SUBLICENSE", "SUBLICENCE") + "\n(c) again"),
        (2, "prose here\r\n  Licenced under the Apache Licence -- Version 2.0\r\nmore"),
        (3, "All rights reserved.\nall RIGHTS reserved\nReleased under the MIT License."),
        (4, "not All rights reserved."),
        (5, None), (6, ""), (7, "© 2021 All rights reserved."), (None, "ISC license"), (8, "Licensed under CC BY-NC 4.0"), (8, "Licensed under CC BY-NC 4.0"), (9, licenses.ISC.replace("\n", " ")),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(*r, 0, 0) for r in data], "doc_id long, text string, k1 int, lines int")).collect()
    want = [("1", 3, 1, ["MIT"], "MIT"), ("2", 3, 1, ["Apache-2.0"], None), ("3", 3, 2, ["MIT", "all-rights-reserved"], None), ("4", 1, 0, [], None), ("5", 0, 0, [], None), ("6", 0, 0, [], None), ("7", 0, 0, [], None), ("None", 1, 1, ["ISC"], "ISC"), ("8", 1, 1, ["CC-BY-NC-4.0"], "CC-BY-NC-4.0"), ("8", 1, 1, ["CC-BY-NC-4.0"], "CC-BY-NC-4.0"), ("9", 1, 1, ["ISC"], "ISC")]
    assert sorted((str(r.doc_id), r.n_units, r.n_hits, r.licenses, r.whole) for r in got) == sorted(want)
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_license_scan_of_fuller_texts(spark):
    from lamella.llm import license_texts, licenses

    wrap = lambda t: "\n\n".join(textwrap.fill(x, 60) for x in t.split("\n"))
    bsd = "\n".join([license_texts.BSD_HEAD, *license_texts.BSD_CLAUSES[:2], license_texts.BSD_TAIL])
    data = [
        ("wrapped MIT before code", "Copyright (c) 2020 X\n\n" + wrap(licenses.MIT) + "\n\nint main() {}\n", ["MIT"], None),
        ("three lines before code", licenses.MIT + "\nint main() {}\n", ["MIT"], None),
        ("three lines and a blank one", licenses.MIT + "\n\nint main() {}\n", ["MIT"], None),
        ("BSD between other text", "before\n\n" + wrap(bsd) + "\n\nafter", ["BSD-2-Clause"], None),
        ("whole BSD", "Copyright 2020, X. All rights reserved.\n\n" + wrap(bsd), ["BSD-2-Clause", "all-rights-reserved"], "BSD-2-Clause"),
        ("whole Unlicense", wrap(license_texts.UNLICENSE), ["Unlicense"], "Unlicense"),
        ("clause and notice", "Copyright 2020 X Inc. All rights reserved.", ["all-rights-reserved"], "all-rights-reserved"),
        ("clause and grant", "(c) 2020 X. " + textwrap.fill(licenses.MIT.split("\n")[0], 60), ["MIT"], None),
        ("notice in a comment", "# Copyright 2020 X\n#\n" + textwrap.indent(wrap(license_texts.APACHE_NOTICE), "# ", lambda _: True) + "\n\nimport os", ["Apache-2.0"], None),
        ("title", "prose\n\n  GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\nprose", ["GPL-3.0"], None),
        ("identifier", "// SPDX-License-Identifier: MPL-2.0\nx", ["MPL-2.0"], None),
        ("part of a text", licenses.MIT.split("\n")[2], [], None),
    ]
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
        if (path := Path("/usr/share/common-licenses") / file).exists():
            data.append((f"whole {name}", path.read_text().replace("\n", "\r\n"), None, name))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in data], "doc_id string, text string"), after_copyright=True).collect()}
    for key, _, names, whole in data:
        assert (names is None or got[key].licenses == names) and got[key].whole == whole, (key, got[key])


def test_license_query_on_plain_rows(spark, tmp_path):
    from lamella.llm import licenses

    folder = str(tmp_path)
    texts = ["prose\n\nAll rights reserved.\n\nprose", "Released under the MIT License.", None, "x\n\ny"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted(tuple(r) for r in licenses.op5_license_scan(spark, folder).collect())
    assert got == [(0, 3, 1, "all-rights-reserved", None), (1, 1, 1, "MIT", "MIT"), (2, 0, 0, "", None), (3, 2, 0, "", None)]


def test_frequent_form_is_learned():
    texts = ["you plonker"] * 256 + ["a calm day"] * 256
    lexicon = toxicity.learn_lexicon(texts, np.repeat([1, 0], 256))
    at = np.flatnonzero(lexicon.hashes == np.uint64(toxicity.word_hash("plonker")))
    assert len(at) == 1 and lexicon.kinds[at[0]] == toxicity.INSULT


def test_mixed_documents_round_together(spark):
    # one shard of long texts of different lengths in each of three sources, and rows without words
    data = [(100 * s + i, " ".join(["w"] * (40 + 3 * i)), str(s)) for s in range(3) for i in range(60)] + [(k, t, "0") for k, t in ((900, None), (901, ""), (902, " \n"))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    for seed in range(3):
        taken = mixing.mix(df, seed=seed).groupBy("source").agg({"taken": "sum"}).collect()
        got = mixing.mixed_documents(df, seed=seed).collect()
        for source, want in taken:
            words = sum(len((r.text or "").split()) for r in got if r.source == source)
            assert abs(words - want) <= 220, (seed, source, words, want)
        assert sorted(r.doc_id for r in got if r.doc_id >= 900) == [900, 901, 902]
