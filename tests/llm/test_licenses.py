"""Licence scans: notices, long wordings, small differences and clean texts."""

from fitlake.llm import licenses as L

MIT = L.TEMPLATES["MIT"][1]
TEXTS = [
    "Some prose here.\nReleased under the MIT License.\nmore prose follows",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU General Public License, version 3.",
    "prose first\n" + MIT.replace(", free", ",\nfree").replace("sublicense, ", "") + "\n\nprose after that",
    "Licensed under CC BY 4.0.\n\nzzz qqq www\nLicensed under the Apache License, Version 2.0.",
    "A licensed plumber asked permission to redistribute old copies of his novel.",
    None, "", "é Licensed under CC BY-NC 4.0.", "word " * 20_000,
]


def test_blocks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS exact")
    rows = sorted(L.scan(df).collect(), key=lambda r: (r.doc_id, r.block))
    assert [(r.doc_id, r.license, r.exact) for r in rows] == [
        (0, "MIT", True), (1, "GPL-2.0", True), (2, "GPL-3.0", True), (3, "MIT", False), (4, "CC-BY-4.0", True),
        (4, "Apache-2.0", True)]
    assert [r.block for r in rows if r.doc_id == 4] == [0, 1]
    assert rows[0].text[rows[0].start:rows[0].end] == "Released under the MIT License."
    assert rows[3].missing == ["sublicense"] and rows[3].extra == [] and rows[3].reduction > 0.5


def test_every_template_is_found_as_itself():
    scanner = L.Scanner(L.TEMPLATES, 4, 0.15)
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            found = scanner.best(text)
            assert (found["license"], found["exact"]) == (name, True)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, TEXTS[0])] * 3, "doc_id long, text string")
    assert L.scan(df, carry=["doc_id"]).count() == 3
    assert L.scan(df.limit(0)).collect() == []


def found(text):
    scanner = L.Scanner(L.TEMPLATES, 4, 0.15)
    return [(f["license"], f["exact"]) for a, b in scanner.blocks(text) for f in scanner.found(text[a:b])]


def test_whole_wordings_with_neighbouring_lines():
    def file(text, head="Copyright (c) 2019 Some Holder"):
        words = text.split(" ")
        lines = [" ".join(words[i:i + 11]) for i in range(0, len(words), 11)]
        return "\n".join(["zzz qqq www", head, "", *lines, "", "zzz qqq www"])

    for name, texts in L.TEMPLATES.items():
        assert found(file(texts[-1])) == [(name, True)]
    numbered = L.TEMPLATES["BSD-3-Clause"][-1].replace("Redistributions of", "1. Redistributions of")
    assert found(file(numbered.replace("THE COPYRIGHT HOLDERS", "JOHN Q EXAMPLE"))) == [("BSD-3-Clause", False)]
    plain = L.TEMPLATES["BSD-2-Clause"][-1].replace("COPYRIGHT HOLDER OR", "AUTHOR OR")
    assert found(file(plain)) == [("BSD-2-Clause", False)]
    two = L.TEMPLATES["GPL-3.0"][2]
    assert found(file(two, "Copyright (C) 2020 Foo\nThis file is part of the qux permissions tool")) == [
        ("GPL-3.0", True)]


def test_several_notices_of_one_block_or_line():
    assert found("Released under the MIT License.\nReleased under the ISC License.") == [("MIT", True), ("ISC", True)]
    assert found("qux plugh (c) 2020 xyzzy foo: Released under the MIT License. Licensed under CC BY 4.0. foo bar baz "
                 "quux corge grault garply waldo fred") == [("MIT", True), ("CC-BY-4.0", True)]
    both = MIT + " and " + L.TEMPLATES["Apache-2.0"][1]
    assert found(" ".join(["zzz"] * 500) + " " + both + " " + " ".join(["qqq"] * 500)) == [
        ("MIT", True), ("Apache-2.0", True)]
