"""A dense block of near-equal vectors is compared in bounded memory, whatever the number of tables; toxic words of a language with few labels."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import embedding_dedup, toxicity


@pytest.mark.parametrize("tables", [1, 30, 118])
def test_dense_block(tables):
    rnd, n = np.random.default_rng(5), 2048
    base = rnd.standard_normal(64)
    vec = (base + 0.05 * rnd.standard_normal((n, 64))).astype(np.float32)
    vec[-40:] = rnd.standard_normal((40, 64))
    before = rnd.integers(0, 3000, (n, tables)).astype(np.int32)
    columns = {"t": np.full(n, tables), "key": np.zeros(n, np.int32), "low": np.zeros(n, np.int64), "high": np.zeros(n, np.int64), "node": np.arange(n), "copies": rnd.integers(1, 4, n), "first": np.ones(n, bool), "second": np.ones(n, bool)}
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns.values()), pa.array(list(vec), pa.list_(pa.float32())), pa.array(list(before), pa.list_(pa.int32()))], [*columns, "vec", "before"])
    tracemalloc.start()
    out = list(embedding_dedup._compare(0.9)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)
    for k in range(tables):
        near &= before[:, k][:, None] != before[:, k][None, :]
    want = near @ columns["copies"]
    got = {r["node"]: (r["links"], r["root"]) for b in out for r in b.to_pylist()}
    assert {k: v[0] for k, v in got.items()} == {i: int(want[i]) for i in np.flatnonzero(want)}
    assert {v[1] for v in got.values()} == {0} and peak < 100e6


def test_a_language_with_few_labels():
    """Forms that ordinary texts hold now and then are learned where toxic texts have nothing else, and only there."""
    rnd = random.Random(3)
    word = lambda parts: "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4)))
    prose = lambda parts, n: [word(parts) for _ in range(n)]
    main, few = ("ka", "lo", "mi", "nu", "re"), ("ov", "ez", "ul", "arr", "es")
    texts, labels = [], []
    for k in range(600):
        w = prose(main, 60)
        if k % 6 == 0:
            for _ in range(5):
                w[rnd.randrange(60)] = "idiot"
        texts.append(" ".join(w)), labels.append(int(k % 6 == 0))
    for k in range(120):
        w = prose(few, 60)
        for _ in range(6 if k % 10 == 0 else int(k % 10 == 1)):
            w[rnd.randrange(60)] = "zimbrak" + rnd.choice(few)
        texts.append(" ".join(w)), labels.append(int(k % 10 == 0))
    model = toxicity.fit(texts, labels, sum(labels) / len(labels))
    made = [" ".join([*prose(few, 50), *(f"zimbrak{x}" for x in few)]) for _ in range(20)] + [" ".join(prose(few, 60)) for _ in range(20)] + [" ".join(prose(main, 60)) for _ in range(20)]
    scores = toxicity._scores(model, pa.array(made), *toxicity.grammar())
    assert (scores[:20] >= toxicity.THRESHOLD).all() and (scores[20:] < toxicity.THRESHOLD).all()
