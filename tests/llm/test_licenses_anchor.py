"""The look for anchors spares texts, but no known text is passed over by it."""

from lamella.llm import licenses


def test_each_known_text_has_an_anchor():
    for table in (licenses.FULL, licenses.PARTS):
        found = licenses.anchors(table)
        assert "" not in found and all(any(a in text.lower() for a in found) for texts in table.values() for text in texts)


def test_known_texts_are_found_in_any_form(spark):
    known = {"X": ["Zanzibar rules apply.", "Do as you like."], "Y": ["Favour the brave"]}
    assert set(licenses.anchors(known)) > set(licenses.ANCHORS)
    data = [("1", "prose\nZANZIBAR -- rules: apply!\nmore"), ("2", "do As, you LIKE"), ("3", "favor the Brave"), ("4", "nothing here\n\n...\nat all"), ("5", None), ("6", "")]
    got = {r.doc_id: (r.n_units, r.n_hits, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id string, text string"), known).collect()}
    assert got == {"1": (3, 1, ["X"]), "2": (1, 1, ["X"]), "3": (1, 1, ["Y"]), "4": (2, 0, []), "5": (0, 0, []), "6": (0, 0, [])}


def test_counts_agree_with_and_without_anchors(spark):
    """Units are counted alike whether a text is looked at whole or not."""
    texts = ["a\n\n --- \nb c\r\nd\n", "é\n.\n9", "one", " \t\n", "x\x0by\nz"]
    rows = [(f"{k}{i}", t + end) for i, t in enumerate(texts) for k, end in (("plain", "\nlast"), ("whole", "\nlicensed"))]
    got = {r.doc_id: r.n_units for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(got[f"plain{i}"] == got[f"whole{i}"] for i in range(len(texts)))
