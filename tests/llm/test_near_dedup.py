"""Near-duplicates against all pairs."""

import random

import pytest

from fitlake.llm import near_dedup as N


def plain(rows, words, percent):
    """Components by comparing all pairs of sets of word tuples."""
    blank = " \t\n\x0b\f\r"
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        cut = [w for w in "".join(" " if c in blank else c for c in low).split(" ") if w]
        sets.append({tuple(cut[i:i + words]) for i in range(max(1, len(cut) - words + 1))} if cut else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i)))
                   for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed=3, family=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(30):
        text = [word() for _ in range(rng.randint(1, 60))]
        rows.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" \n".join(copy))
    base = [word() for _ in range(100)]  # one large group, some of whose copies are near only some others
    for i in range(family):
        copy = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8, 10, 12])):
            copy[rng.randrange(100)] = word()
        rows.append(" ".join(copy).upper() if i % 5 == 0 else " ".join(copy))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one\x0btwo"] + [rows[0]] * 3
    out = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    return out + [(None, "lonely words without an id"), (None, rows[0]), out[5]]


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80), (1, 90)])
def test_groups_are_those_of_all_pairs(spark, words, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS class", "3 AS id")
    got = sorted((tuple(r) for r in N.groups(df, words, percent).collect()), key=str)
    assert got == plain(rows, words, percent)


def test_members_that_no_leader_links_are_found(spark, monkeypatch):
    """Without any pair of a bucket, blocks of the large buckets still show every link."""
    rows = [r for r in corpus(family=120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.candidates
    monkeypatch.setattr(N, "candidates", lambda c, b, p: found(c, b.where(f"members <= {N.SMALL}"), p))
    got = sorted((tuple(r) for r in N.groups(df, 2, 80).collect()), key=str)
    assert got == plain(rows, 2, 80)


def test_long_chains_are_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[3 * i:3 * i + 60])) for i in range(40)]
    got = N.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r.component_id for r in got} == {61} and sum(r.kept for r in got) == 1


def test_representatives_keep_columns_and_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "A b c d e f g h", "y"), (1, "a b c d e f g h", "z"),
            (3, None, "n"), (4, "", "m"), (None, "other words here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = N.representatives(df, 5, 80)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), r.component_id) for r in got.collect())
    assert [k for k, _ in kept] == ["1", "3", "4", "None"]


def test_representatives_with_null_and_repeated_ids(spark):
    near = [" ".join(f"{head}{i}" for i in range(30)) for head in "abcdefgh"]
    copy = lambda text: text + " more"
    rows = [(None, near[0], "null a"), (None, near[1], "null b"), (None, copy(near[1]), "null b copy"),
            (5, near[2], "five c"), (5, near[3], "five d"),
            (7, near[4], "seven e"), (7, None, "seven empty"), (7, " \t", "seven blank"), (8, copy(near[4]), "eight e"),
            (9, near[5], "nine f"), (20, copy(near[5]), "twenty f"), (20, near[6], "twenty g"),
            (None, near[7], "null h"), (30, copy(near[7]), "thirty h"), (None, None, "null empty"),
            (None, "", "null blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = sorted(r.name for r in N.representatives(df, 5, 80).collect())
    b = [n for n in got if n.startswith("null b") and n != "null blank"]
    assert len(b) == 1  # either row of a group without ids
    assert [n for n in got if n not in b] == sorted([
        "null a", "five c", "five d", "seven e", "seven empty", "seven blank", "nine f", "twenty g", "thirty h",
        "null empty", "null blank"])


def test_representatives_keep_one_row_of_each_component(spark):
    """As many rows as components, whatever the ids: a third null, many repeated."""
    rows = corpus()
    docs = [(None if i % 3 == 0 else i % 10, text, i) for i, (_, text) in enumerate(rows)]
    got = N.representatives(spark.createDataFrame(docs, "doc_id long, text string, row int"), 5, 80).collect()
    alone = plain([(i, text) for i, (_, text) in enumerate(rows)], 5, 80)
    component = {i: c for i, _, c, _ in alone}
    assert sorted(component[r.row] for r in got) == sorted(set(component.values()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.groups(df).collect() == [] and N.representatives(df).collect() == []
