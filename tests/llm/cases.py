"""Small inputs the tests of the text operators share."""

import re

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, row string, fp long, epoch int, score string, _text string, place string, label string")
GOOD = ("The house of the north is by the water and in the winter it is cold. People of the town walk to it for the "
        "view and to be alone with the wind.")
ROWS = [
    (1, GOOD, "en", "a"), (2, GOOD, "en", "a"), (2, GOOD, "en", "a"), (3, None, None, None), (4, "", "en", None),
    (None, "A text of its own, without any id but with a source.", "en", "b"), (5, " \t\n\x0b\f\r", "fr", "b"),
    (6, "one two", "en", "b"), (7, "one two three four", None, "a"), (8, "été À LA Mer 😀 <s>[INST]", "fr", "b"),
    (9, "word " * 30_000, "en", "a"), (10, "x" * 50_000, "en", "a"), (11, "\n".join(["same line here"] * 40), "en", "c"),
    (12, "#### $$$$ %%%% " * 30, "en", "c"), (13, GOOD.replace("cold", "warm"), "en", "b"), (14, "12 34 !!", None, "c"),
]


def edge_docs(spark, rows=None):
    """Nulls, empty and very long texts, ties and repeated rows, with extra columns named like inner ones."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), f"k{i}", "r", 7, 3, "s", "t", "p", None) for i, t, g, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
