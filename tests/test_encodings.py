"""Encodings of documents and characters lost on the way to an output."""

from vellum.sources import encodings


def test_read_text():
    assert encodings.read_text("jaźń".encode()) == ("jaźń", "utf-8", 0)
    assert encodings.read_text("jaźń ".encode() + b"\x92s") == ("jaźń ’s", "utf-8", 1)
    old = '<?xml version="1.0" encoding="ISO-8859-2"?><p>jaźń</p>'
    assert encodings.read_text(old.encode("iso-8859-2")) == (old, "iso-8859-2", 0)
    assert encodings.read_text(b'<meta charset="nonsense">\xb3') == ('<meta charset="nonsense">ł', "utf-8", 1)
    assert encodings.read_text(b"") == ("", "utf-8", 0) and encodings.read_text(None) == (None, None, 0)


def test_frames(spark):
    rows = spark.createDataFrame([(1, b"a\x92", "x"), (2, None, "y")], "id int, data binary, text string")
    assert sorted(tuple(r) for r in encodings.texts(rows, ["id"]).collect()) == [(1, "a’", "utf-8", 1), (2, None, None, 0)]
    assert encodings.texts(rows.limit(0), ["id"]).count() == 0
    pairs = spark.createDataFrame([(1, "a b\nc", "xa-bc"), (2, "abc", "acb"), (3, None, "z"), (4, "q", None), (5, "aa", "a")], "id int, source string, output string")
    assert sorted(tuple(r) for r in encodings.losses(pairs, ["id"]).collect()) == [(1, -1), (2, 2), (3, -1), (4, 0), (5, 1)]
