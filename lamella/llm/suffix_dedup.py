"""Suffix-array dedup: Burrows-Wheeler columns of shards are merged by iterative interleave refinement, with common prefixes; intervals
that repeat give the bytes to remove."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.blocks import groups
from lamella.llm.common import digest, scratch, sized_broadcast, small_batches, stored
from lamella.llm.tokens import mix64, pieces, split

#: Bytes of a repeat; bytes of a seed; slices in a group above which its range is divided; rows of 8 or 16-byte keys that may be broadcast.
LENGTH, SEED_BYTES, CROWD, KEY_ROWS = 400, 32, 512, 1_000_000
#: Bytes of slices that are merged at once in a task.
BATCH = 6 << 20
#: Words of a passage; bytes that stand for a word (7 bits each).
PASSAGE, CODE = 51, 6
SPOTS = "k1 long, k2 long, pos int, most short, least short, s1 long, s2 long, near long, far long"


@cache
def _factors() -> np.ndarray:
    return mix64(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1)


def _seed_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each place on."""
    h, step, f = data.astype(np.uint64) + np.uint64(1), 1, 0
    while step < width:
        h = h[:-step] * _factors()[f] + h[step:]
        step, f = step * 2, f + 1
    return mix64(h)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray, offs: np.ndarray, length: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, place, first and last start of the windows of ``length`` bytes that have their least seed there (the leftmost of equals)."""
    if len(data) < length:
        return
    h = _seed_hashes(data, width)
    packed = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_least(packed, length - width + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    inside = np.repeat(offs[1:] - length, size)[: len(least)] >= np.arange(len(least))
    start = np.flatnonzero(inside)
    if not len(start):
        return
    place, text = least[start], np.repeat(np.arange(len(size)), size)[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    yield text[new], place[new], start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]


def _as_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts with ``CODE`` ASCII characters for each word."""
    words = split(data, offs)
    return (words.hash[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(7)) & np.uint64(127)).astype(np.uint8).ravel(), words.first * CODE


def _find_anchors(length: int, width: int, coded: bool):
    half = length // 2

    def keys(raw: bytes, spans: Iterator[tuple[int, int]], used: np.ndarray, seed: int) -> np.ndarray:
        """Hashes of the spans that are used, 0 for the others."""
        return np.array([xxhash.xxh3_64_intdigest(raw[i:j], seed) if on else 0 for (i, j), on in zip(spans, used, strict=True)], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for at, data, offs in pieces(batch.column("text")):
                data, offs = _as_codes(data, offs) if coded else (data, offs)
                raw, s128 = data.tobytes(), xxhash.xxh3_128_digest
                for text, place, first, last in _anchors(data, offs, length, width):
                    most, least, spot = place - first, place - last, place.tolist()
                    slices = zip(first.tolist(), last.tolist(), most.tolist(), strict=True)
                    whole = np.frombuffer(b"".join([s128(raw[i : j + length], k) for i, j, k in slices]), np.int64).reshape(-1, 2)
                    near = keys(raw, ((p, p + half) for p in spot), least <= half, 1)
                    far = keys(raw, ((p - half, p + width) for p in spot), most > half, 2)
                    out = {
                        "k1": k1[at + text], "k2": k2[at + text], "pos": (place - offs[text]).astype(np.int32), "most": most.astype(np.int16),
                        "least": least.astype(np.int16), "s1": whole[:, 0].copy(), "s2": whole[:, 1].copy(), "near": near, "far": far,
                    }
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], list(out))

    return run


def refine(order: np.ndarray, lcp: np.ndarray, group: np.ndarray, symbol: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One refinement of an interleave: every suffix is lengthened to the left by ``width`` bytes.

    ``order`` lists suffixes by group and then by what follows, ``lcp[j]`` is the common prefix of the j-th and the one before it.
    A stable deal by the preceding symbol keeps each shard's own order and merges the shards; common prefixes come from those that
    lie between, so nothing is compared twice. Symbols of 8 bytes are big-endian, so unequal ones still tell their common bytes."""
    g, s = group[order], symbol[order]
    to = np.lexsort((s, g))
    gs, ss = g[to], s[to]
    alike = np.concatenate([[False], (gs[1:] == gs[:-1]) & (ss[1:] == ss[:-1])])
    new = np.zeros(len(order), np.int32)
    if len(j := np.flatnonzero(alike)):
        spans = np.stack([to[j - 1] + 1, to[j] + 1], 1).ravel()
        new[j] = np.minimum.reduceat(np.append(lcp, 0), spans)[::2] + width
    if width == 8 and len(j := np.flatnonzero(np.concatenate([[False], gs[1:] == gs[:-1]]) & ~alike)):
        apart = ss[j] ^ ss[j - 1]
        same = np.zeros(len(j), np.int32)
        for b in range(7):
            same += (apart >> np.uint64(56 - 8 * b)) == 0
        new[j] = same
    return order[to], new


def repeats(group: np.ndarray, shard: np.ndarray, slices: list[bytes], anchor: np.ndarray, low: int, high: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each slice, the least and the largest d from ``low`` to ``high`` such that the ``length`` bytes from d before its
    ``anchor`` are also found so at another slice of its ``group``; -1 for none. Slices of a ``shard`` start next to each other."""
    n, right, left = len(slices), -(-length // 8) * 8, high
    text = np.full((n, left + right), 255, np.uint8)  # 255 isn't in UTF-8, so what lies beyond a slice comes after all bytes
    for k, (x, a) in enumerate(zip(slices, anchor.tolist(), strict=True)):
        part = x[max(0, a - left) : a + right]
        at = left - min(a, left)
        text[k, at : at + len(part)] = np.frombuffer(part, np.uint8)
    reach = np.minimum(np.array([len(x) for x in slices]) - anchor, right).astype(np.int32)
    order, lcp = np.lexsort((shard, group)), np.zeros(n, np.int32)
    ahead = np.ascontiguousarray(np.ascontiguousarray(text[:, left:]).view(">u8").astype(np.uint64).T)
    behind = np.ascontiguousarray(text[:, :left].T)
    for c in range(len(ahead) - 1, -1, -1):
        order, lcp = refine(order, lcp, group, ahead[c], 8)
    lcp = np.minimum(lcp, np.minimum(reach[order], np.concatenate([[0], reach[order][:-1]]))).astype(np.int32)
    found_low, found_high, d = np.full(n, -1), np.full(n, -1), 0
    while True:
        if d >= low and len(order):
            enough = lcp >= length
            hit = order[enough | np.concatenate([enough[1:], [False]])]
            found_low[hit[found_low[hit] < 0]] = d
            found_high[hit] = d
        step = 8 if d + 8 <= low else 1
        if d + step > high or len(order) < 2:
            return found_low, found_high
        order, lcp = _kept(order, lcp, anchor[order] >= d + step)  # the others don't reach so far to the left
        part = behind[left - d - step : left - d]
        symbol = np.ascontiguousarray(part.T).view(">u8")[:, 0].astype(np.uint64) if step == 8 else part[0].astype(np.uint64)
        order, lcp = refine(order, lcp, group, symbol, step)
        d += step
        parted = lcp < d
        order, lcp = _kept(order, lcp, ~(parted & np.concatenate([parted[1:], [True]])))


def _kept(order: np.ndarray, lcp: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An interleave without some suffixes; the common prefix of new neighbours is the least of those between."""
    if on.all():
        return order, lcp
    at = np.flatnonzero(on)
    if not len(at):
        return order[:0], lcp[:0]
    begin = np.concatenate([[0], at[:-1] + 1])
    return order[at], np.minimum.reduceat(np.append(lcp, 0), np.stack([begin, at + 1], 1).ravel())[::2]


_RANGE = {"s1": pa.int64(), "s2": pa.int64(), "copies": pa.int64(), "most": pa.int16(), "least": pa.int16(), "key": pa.int64(), "low": pa.int16(), "high": pa.int16()}
SLICE = _RANGE | {"crowd": pa.int64(), "slice": pa.binary()}
PART = _RANGE | {"u": pa.int16(), "v": pa.int16(), "h1": pa.int64(), "h2": pa.int64(), "slice": pa.binary()}
_SQL = {pa.int64(): "long", pa.int16(): "short", pa.binary(): "binary"}
SLICES, PARTS = (", ".join(f"{name} {_SQL[kind]}" for name, kind in table.items()) for table in (SLICE, PART))


def _cut(length: int, coded: bool):
    """Text and the list of its asked places in, one row a place with the bytes of its windows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = batch.column("text"), batch.column("asked")
            for k in range(batch.num_rows):
                raw = (texts[k].as_py() or "").encode()
                raw = _as_codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes() if coded else raw
                rows = [r | {"slice": raw[r["pos"] - r["most"] : r["pos"] - r["least"] + length]} for r in asked[k].as_py()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(SLICE.items())))

    return run


def _merge(length: int):
    """Groups of equal key arrive one after another; as many as fit in a batch are refined together."""

    def told(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        low, high, key, s1, s2, most, least = (t.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "key", "s1", "s2", "most", "least"))
        slices = t.column("slice").to_pylist()
        for lo, hi in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
            at = np.flatnonzero((low == lo) & (high == hi))
            _, group = np.unique(key[at], return_inverse=True)
            down, up = repeats(group, s1[at] & 3, [slices[k] for k in at], most[at], lo, hi, length)
            yes = up >= 0
            yield pa.RecordBatch.from_arrays([pa.array(s1[at][yes]), pa.array(s2[at][yes]), pa.array(down[yes].astype(np.int16)), pa.array(up[yes].astype(np.int16))], ["s1", "s2", "down", "up"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for group in groups(batches, "key"):
            held, size = [*held, *group.to_batches()], size + group.num_rows * 2 * length
            if size > BATCH:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    return run


def _divide(length: int, parts: int):
    """Each range falls into ``parts``. A part's key is a hash of the bytes that all its windows share, its hull one of all bytes of the
    slice's own windows u to v in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in PART}
            for r in batch.to_pylist():
                x, a = r["slice"], r["most"]
                edges = np.linspace(r["low"], r["high"] + 1, min(parts, r["high"] - r["low"] + 1) + 1).astype(int).tolist()
                for p, q in zip(edges[:-1], edges[1:], strict=True):
                    u, v = max(p, r["least"]), min(q - 1, a)
                    if u > v:
                        continue
                    key = np.uint64(xxhash.xxh3_64_intdigest(x[a - p : a - q + 1 + length], p * 1000 + q)).view(np.int64)
                    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(x[a - v : a - u + length], v), np.int64).tolist()
                    for c, value in (r | {"key": key, "low": p, "high": q - 1, "u": u, "v": v, "h1": h1, "h2": h2}).items():
                        if c in rows:
                            rows[c].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, PART[c]) for c, v in rows.items()], list(rows))

    return run


def _merged(slices: DataFrame, length: int) -> DataFrame:
    dealt = slices.select("s1", "s2", "most", "least", "key", "low", "high", "slice").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_merge(length), "s1 long, s2 long, down short, up short")


def _settle(slices: DataFrame, temp: Callable[[DataFrame], DataFrame], length: int, crowd: int) -> list[DataFrame]:
    """s1, s2, down, up: windows that repeat, of slices in groups of any size; stored tables."""
    told = [temp(_merged(slices.filter(F.col("crowd") <= crowd), length))]
    large = slices.filter(F.col("crowd") > crowd)
    while not large.isEmpty():
        parts = temp(large.mapInArrow(_divide(length, 4), PARTS))
        twice = parts.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).filter("n > 1").select("h1", "h2", F.lit(True).alias("settled"))
        twice = sized_broadcast(temp(twice), KEY_ROWS)
        marked = parts.join(twice, ["h1", "h2"], "left")
        told.append(marked.filter("settled").select("s1", "s2", F.col("u").alias("down"), F.col("v").alias("up")))
        # settled parts stay as partners of the others, one for each hull
        rest = F.struct(*(c for c in parts.columns if c not in ("key", "h1", "h2")))
        partner = parts.join(twice, ["h1", "h2"], "left_semi").groupBy("key", "h1", "h2").agg(F.min(rest).alias("r"))
        partner = partner.select("key", "h1", "h2", "r.*", F.lit(True).alias("settled"))
        left = temp(marked.filter("settled is null").unionByName(partner.select(*marked.columns)).filter("low < high"))
        open_rows = F.count(F.when(F.col("settled").isNull(), 1))
        count = temp(left.groupBy("key").agg(F.count("*").alias("crowd"), open_rows.alias("open")).filter("crowd > 1 and open > 0").drop("open"))
        left = temp(left.join(sized_broadcast(count, KEY_ROWS), "key").select(*SLICE))
        told.append(temp(_merged(left.filter(F.col("crowd") <= crowd), length)))
        large = left.filter(F.col("crowd") > crowd)
    return told


def repeated_intervals(docs: DataFrame, length: int = LENGTH, width: int = SEED_BYTES, crowd: int = CROWD, coded: bool = False) -> DataFrame:
    """k1, k2, spots (a stored table): for each key of ``docs`` (k1, k2, text) with repeats, intervals (start, stop) of bytes under a ``length``-byte string that starts elsewhere too.
    With ``coded``, ``CODE`` bytes stand for each word of the texts, and bytes are those.

    1. Every window of ``length`` bytes belongs to the place of its least seed, which its own bytes decide; so windows can only be
       equal if they belong to places with equal bytes around. Places give two keys: the bytes shared by all windows that lie mostly
       to the right, and by those mostly to the left. Places without a shared key go.
    2. Equal slices (the bytes of all windows of a place) are one row with a count; two copies settle all their windows.
    3. Different slices with a shared key are merged: the Burrows-Wheeler columns of the group's shards, by interleave refinement.
       A prefix of ``length`` common with a neighbour is a repeat.
    4. A group of over ``crowd`` slices isn't merged in one task. Its range of windows is divided by longer shared bytes; a part
       whose own bytes repeat whole is settled by a count, a part with a key of its own is settled too, and the rest is merged or
       divided again, down to single windows."""
    d = docs.select("k1", "k2", "text").filter(F.octet_length("text") >= (length // CODE * 2 - 1 if coded else length))
    half = length // 2
    with scratch(docs.sparkSession) as temp, small_batches(docs.sparkSession):
        places = temp(d.mapInArrow(_find_anchors(length, width, coded), SPOTS))
        keys = places.select(F.explode(F.array("near", "far")).alias("key")).filter("key <> 0").groupBy("key").count().filter("count > 1")
        known = sized_broadcast(temp(keys.select("key")), KEY_ROWS)
        near, far = known.withColumnRenamed("key", "_near"), known.withColumnRenamed("key", "_far")
        some = places.join(near, F.col("near") == F.col("_near"), "left").join(far, F.col("far") == F.col("_far"), "left")
        shared = [F.coalesce(f"_{c}", F.lit(0).cast("long")).alias(c) for c in ("near", "far")]
        some = temp(some.filter("_near is not null or _far is not null").select("k1", "k2", "pos", "most", "least", "s1", "s2", *shared))
        one = F.min(F.struct("k1", "k2", "pos")).alias("one")
        whole = temp(some.groupBy("s1", "s2").agg(F.count("*").alias("copies"), one, *(F.first(c).alias(c) for c in ("near", "far", "most", "least"))))

        def span(key: str, low: int, high: int) -> Column:
            return F.struct(F.col(key).alias("key"), F.lit(low).cast("short").alias("low"), F.lit(high).cast("short").alias("high"))

        spans = F.explode(F.array(span("near", 0, half), span("far", half + 1, length - width))).alias("r")
        nodes = whole.select("s1", "s2", "copies", "one", "most", "least", spans).select("s1", "s2", "copies", "one.*", "most", "least", "r.*").filter("key <> 0")
        crowds = temp(nodes.groupBy("key").agg(F.count("*").alias("crowd")).filter("crowd > 1"))
        place = F.struct("s1", "s2", "copies", "pos", "most", "least", "key", "low", "high", "crowd")
        asked = temp(nodes.join(sized_broadcast(crowds, KEY_ROWS), "key").groupBy("k1", "k2").agg(F.collect_list(place).alias("asked")))
        texts = d.join(sized_broadcast(asked.select("k1", "k2"), KEY_ROWS), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        slices = temp(texts.join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(_cut(length, coded), SLICES))
        found = whole.filter("copies > 1").select("s1", "s2", F.col("least").alias("down"), F.col("most").alias("up"))
        for more in _settle(slices, temp, length, crowd):
            found = found.unionByName(more)
        found = temp(found.groupBy("s1", "s2").agg(F.min("down").alias("down"), F.max("up").alias("up")))
        spot = F.struct((F.col("pos") - F.col("up")).alias("start"), (F.col("pos") - F.col("down") + length).alias("stop")).alias("spot")
        spots = some.select("k1", "k2", "pos", "s1", "s2").join(found, ["s1", "s2"]).select("k1", "k2", spot)
        return stored(spots.groupBy("k1", "k2").agg(F.collect_set("spot").alias("spots")))


def passage_words(docs: DataFrame, words: int = PASSAGE, width: int = SEED_BYTES, crowd: int = CROWD) -> DataFrame:
    """k1, k2, n_passage_words (a stored table): for each key of ``docs`` (k1, k2, text) that has some, the words inside a run of
    ``words`` words that starts at another place too, in the same text or another. Words are `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased.

    The same merge as of bytes, over texts in which a code of fixed width stands for each word: a window of ``words`` codes repeats where
    the words do. Windows that begin inside a code count whole words only, so they add none to those that begin with one."""
    spots = repeated_intervals(docs, words * CODE, width, crowd, coded=True)
    first, end = F.ceil(F.col("spot.start") / CODE), F.floor(F.col("spot.stop") / CODE)
    runs = spots.select("k1", "k2", F.explode("spots").alias("spot")).select("k1", "k2", first.alias("first"), end.alias("end"))
    before = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce(before, F.lit(0))))
    counted = runs.select("k1", "k2", new.alias("n")).groupBy("k1", "k2").agg(F.sum("n").alias("n_passage_words"))
    return stored(counted)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spots = batch.column("text"), batch.column("spots")
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for k in range(batch.num_rows):
            raw, at, kept, spans = (texts[k].as_py() or "").encode(), 0, [], 0
            stop = -1
            for s in sorted((x["start"], x["stop"]) for x in spots[k].as_py()):
                if s[0] > stop:
                    spans += 1
                    kept.append(raw[at : s[0]])
                stop = max(stop, s[1])
                at = max(at, stop)
            kept.append(raw[at:])
            left = b"".join(kept)
            for c, v in zip(out, (len(raw), len(raw) - len(left), spans, left), strict=True):
                out[c].append(v)
        found = [pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *found, batch.column("n_passage_words")], ["id", *out, "n_passage_words"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = SEED_BYTES, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) for each row of ``docs``; with ``words``, also
    n_passage_words, as ``passage_words`` counts them: they are told, and go only where the bytes do.

    A byte goes if a string of ``length`` bytes over it starts at another place too, in the same text or another; overlaps count,
    and the input decides, not what is left. Matches don't cross texts. Null is empty; shorter texts stay whole. Repeated rows are
    copies of each other, so they go like other copies. Ids may be null or repeated; other columns are ignored."""
    kind = dict(docs.dtypes)[id_col]
    keys = [h.alias(k) for h, k in zip(digest(F.col(id_col), F.col(text_col)), ("k1", "k2"), strict=True)]
    d = docs.select(*keys, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spots = repeated_intervals(d, length, width, crowd)
    own = sized_broadcast(spots.select("k1", "k2"), KEY_ROWS)
    runs = sized_broadcast(passage_words(d, words, width, crowd), KEY_ROWS) if words else None
    told = F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words")
    d = d.join(runs, ["k1", "k2"], "left").select(*d.columns, told) if words else d.withColumn("n_passage_words", F.lit(0).cast("long"))
    cut = d.join(own, ["k1", "k2"], "left_semi").join(spots, ["k1", "k2"]).select("id", "text", "spots", "n_passage_words")
    cut = cut.mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
    raw, none = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(0).cast("long")
    intact = d.join(own, ["k1", "k2"], "left_anti")
    intact = intact.select("id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), raw.alias("kept"), "n_passage_words")
    out = cut.unionByName(intact)
    return (out if words else out.drop("n_passage_words")).withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
