"""Personal data: base spans against plain regular expressions, and the added spans."""

import re

from pyspark.sql import functions as F

from fitlake.llm import pii

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "é a@b.cc, x.y%z@d-e.f.g and a@b.com.x-y_z@d.com @a.b a@b a@b. q@@w.e é", "1.2.3.4 1.2.3.256 001.02.3.4 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 4111  1111 11111111 0", "9" * 3000, "1 2 3-4" * 900,
    "+1 (632) 555-4827, +49.30.1234567- +1 2 ++1234567890 +1", "a" * 60_000 + "@b.cc", "x@" + "a." * 3000 + "b",
    "👍 +12345678901 👍 a@b.cc", "1.2.3.99999999999999999999", "", None, " ", "١٢@b.cc 5.5.5.5",
]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    return {r.doc_id: r for r in pii.find(df, **more).collect()}


def test_base_spans_are_those_of_the_plain_patterns(spark):
    got = run(spark, list(enumerate(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert [tuple(s) for s in got[i].base] == plain(text), text
        assert [tuple(s) for s in got[i].spans][:len(got[i].base)] == plain(text)


def test_all_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    for r in pii.find(docs).collect():
        assert [tuple(s) for s in r.base] == plain(texts[r.doc_id])


def test_secrets_are_added_and_plain_words_are_not(spark):
    rows = []
    for i in range(60):
        rows.append((10 * i, f'words and token = "{i:02d}ab99e3cd{i:02d}77ef00aa{i:02d}" after'))
        rows.append((10 * i + 1, f"then password=c0ffee{i:02d}dead{i:02d}beef here"))
        rows.append((10 * i + 2, f"see AKIAMD62HKU6VBLC{i:02d}CE there"))
        rows.append((10 * i + 3, f"released as version 10.11.{i} in march2021 and page12345678"))
        rows.append((10 * i + 4, f"mail bob.{i}@mail.example.com about it"))
    for doc, r in run(spark, rows).items():
        more = [tuple(s) for s in r.spans][len(r.base):]
        assert len(more) == (1 if doc % 10 < 3 else 0), r
        for kind, begin, end in more:
            assert kind == "secret" and re.fullmatch(r"[A-Za-z0-9]{12,}", r.text[begin:end])


def test_no_python_on_the_main_path(spark):
    df = pii.find(spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_text_and_counts(spark):
    row = run(spark, [(1, TEXTS[0])])[1]
    out = spark.createDataFrame([(row.base,)], "spans " + pii.SPAN).select(
        pii.as_text(F.col("spans")), pii.count_of(F.col("spans"), "email")).first()
    assert out[0] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(TEXTS[0])) and out[1] == 3 + (len(plain(TEXTS[0])) - 3)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_values_after_key_words_and_grouped_numbers(spark):
    rows = []
    for i in range(40):
        rows += [(10 * i, "his password: correcthorse of old"), (10 * i + 1, "then password: hunter2, he said"),
                 (10 * i + 2, "set pwd=Summer!Rain and go"), (10 * i + 3, f"please call 555 123 45{i:02d} at noon"),
                 (10 * i + 4, "the token was kept and the secret known"), (10 * i + 5, f"in 1999 some 1200{i:02d} came to page 12345678")]
    want = {0: ["correcthorse"], 1: ["hunter2,"], 2: ["Summer!Rain"], 4: [], 5: []}
    for doc, r in run(spark, rows).items():
        more = [tuple(s) for s in r.spans][len(r.base):]
        assert [r.text[b:e] for _, b, e in more] == want.get(doc % 10, [f"555 123 45{doc // 10:02d}"]), (r, more)
        assert {k for k, _, _ in more} <= ({"number"} if doc % 10 == 3 else {"secret"})


def test_very_long_texts_of_numbers(spark):
    """200,000 numbers in one text: places by folds in stretches, overlaps by a sort."""
    text = " ".join(f"1.2.3.{i % 300} 4{i:08d}x" for i in range(100_000))
    row = run(spark, [(1, text), (2, "é " * 100_000 + "a@b.cc")])
    want = [(k, b, e) for k, b, e in plain(text)]
    assert [tuple(s) for s in row[1].base] == want and [tuple(s) for s in row[2].base] == [("email", 200_000, 200_006)]


def test_columns_named_like_inner_ones(spark):
    names = ("__text", "__own", "__email", "__found", "__candidates")
    df = spark.createDataFrame([(1, "mail a@b.cc now")], "doc_id long, text string").selectExpr(
        "*", *(f"'{n}' AS {n}" for n in names))
    r = pii.find(df).first()
    assert [r[n] for n in names] == list(names) and [tuple(s) for s in r.base] == [("email", 5, 11)]


def test_touching_spans(spark):
    rng = __import__("random").Random(1)
    spans = lambda n: [(a, a + rng.randint(1, 5)) for a in (rng.randint(0, 3000) for _ in range(n))]
    own, others = sorted(spans(700)), spans(40)
    kind = "array<struct<start:bigint,end:bigint,surface:string,before:string>>"
    df = spark.createDataFrame([([(a, b, "s", "b") for a, b in own], [(a, b, "s", "b") for a, b in others])],
                               f"own {kind}, others {kind}")
    got = df.select(pii.apart(F.col("own"), F.col("others")).alias("kept")).first().kept
    assert [(r.start, r.end) for r in got] == [c for c in own if all(b[1] <= c[0] or c[1] <= b[0] for b in others)]
