"""Runs of any number of paragraphs, and parts that would name another licence."""

import textwrap

from lamella.llm import licenses


def scan(spark, data, **more):
    return {r.doc_id: (r.n_hits, r.licenses, r.whole) for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id string, text string"), **more).collect()}


def test_known_texts_of_many_paragraphs_inside_longer_ones(spark):
    known = {f"X{n}": ["\n\n".join(f"Licensed rule {i} of {n} holds" for i in range(n))] for n in (1, 8, 9, 30)}
    data = [(f"{n} {k}", f"An intro.\n\n{text if k == 'in' else text[:-1]}\n\nThe end.") for n in (1, 8, 9, 30) for text in known[f"X{n}"] for k in ("in", "cut")]
    data += [(f"{n} whole", known[f"X{n}"][0]) for n in (1, 8, 9, 30)]
    got = scan(spark, data, known=known)
    assert got == {f"{n} in": (1, [f"X{n}"], None) for n in (1, 8, 9, 30)} | {f"{n} cut": (0, [], None) for n in (1, 8, 9, 30)} | {f"{n} whole": (1, [f"X{n}"], f"X{n}") for n in (1, 8, 9, 30)}


def test_many_short_paragraphs(spark):
    """Blocks of ends agree with each other beyond 64 paragraphs."""
    known = {"X": ["licensed\n\n" + "\n\n".join("ab"[i % 2] for i in range(70))]}
    lead = "\n\n".join("c" * (i % 3 + 1) for i in range(150))
    assert scan(spark, [("1", lead + "\n\n" + known["X"][0] + "\n\n" + lead), ("2", lead + "\n\nlicensed\n\na\n\na")], known=known) == {"1": (1, ["X"], None), "2": (0, [], None)}


def test_lines_apart_are_the_licence_itself(spark):
    lines = [x for part in licenses.MIT.split("\n") for x in textwrap.wrap(part, 60)]
    cut = [x for part in licenses.MIT.split("\n")[:1] for x in textwrap.wrap(part, 60)]
    got = scan(spark, [("alone", "\n\n".join(lines)), ("inside", "\n\n".join(["intro", *lines, "int main() {}"])), ("part", "\n\n".join([*cut, "int main() {}"]))])
    assert got == {"alone": (1, ["MIT"], "MIT"), "inside": (1, ["MIT"], None), "part": (1, ["MIT"], None)}


def test_no_part_begins_another_licence():
    words = lambda t: " ".join(licenses.re.findall("[a-z0-9]+", t.lower())) + " "
    for name, parts in licenses.PARTS.items():
        for other, texts in licenses.FULL.items():
            assert other == name or not any(words(t).startswith(words(p)) for p in parts for t in texts), (name, other)
