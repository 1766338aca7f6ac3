"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans (email, ip, card, phone). Around them, every longer word with a digit, every
value set after a key word (``password: ...``) and every number in groups is a candidate, on which labelers vote:
strict formats, gazetteers of key words and of number words before it, the mark before it, its make-up, and a
gazetteer of words that speak against it. The votes of all documents are counted by pattern;
expectation-maximisation on these counts estimates how often each labeler votes for, against or not at all on either
class. The expected classes train a final classifier, a logistic regression on votes and make-up, and candidates that
it accepts are added as kind ``secret`` or ``number``. Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.session import written

# fixed values: the base patterns. Possessive repetition and starts at the edge of a run find the same matches as
# the plain forms, in time linear in the text.
BASE: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
          "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.contains("+")}
ADDED_KINDS = ("secret", "number")
# fixed values: words before a value that speak for it, and words that speak against it
KEY = r"passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|credentials?|auth|login"
NUMBER = r"call|phone|tel|mobile|cell|fax|account|acct|iban|ssn|social security|passport|routing"
KEYS_BEFORE = rf"(?i)\b(?:[a-z]+[_-])?(?:{KEY})\W*$"
NUMBERS_BEFORE = rf"(?i)\b(?:{NUMBER})(?:\s+(?:number|no|me|us))?\W*$"
AGAINST = r"(?i)(?:version|licen[sc]e|release|page|chapter|isbn|year|section|cc by(?:-nc)?)\W*$"
NO_VALUE = r"(?i)^(?:required|optional|none|null|true|false|expired|changed|string|text)[.,;]?$"
STRICT = (r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}"
          r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})[.,;]?$")
GROUPED = r"\(?[0-9]{3}\)?[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}(?![0-9])"
#: A value set after a key word; a number in groups; or a longer word with a digit, after a blank, quote, bracket or mark.
KEYED = rf"(?<=(?:(?i:{KEY}))[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'=:()]{{4,}}+"
WORD = r"(?<![^\s\"'=:(])(?=[^\s\"'=:()0-9]*+[0-9])[^\s\"'=:()]{8,}+"
CANDIDATE = rf"(?<![0-9A-Za-z+.-]){GROUPED}|{WORD}"
CONTEXT = 24
LABELERS = ("strict", "key_word", "number_word", "mark", "make_up", "against")
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


#: Elements that are gathered in one array before the arrays are joined, so that long arrays grow in linear time.
STRIDE = 512


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where inner functions use it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step, kind: str = "bigint") -> Column:
    """The state before each item of a fold, as an array, in time linear in the items but for a share per ``STRIDE``.

    A first fold keeps the state at every ``STRIDE`` items; the stretches between are folded from there.
    """
    def body(xs: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRIDE).cast("int"))
        own = lambda i: F.slice(xs, i * STRIDE + 1, F.lit(STRIDE))
        first = F.aggregate(stretches, F.array(zero), lambda acc, i: F.concat(
            acc, F.array(F.aggregate(own(i), F.element_at(acc, -1), step))))
        none = F.expr(f"cast(array() as array<{kind}>)")

        def inner(state: Column, x: Column) -> Column:
            return F.struct(step(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

        each = let(first, lambda starts: F.transform(stretches, lambda i: F.aggregate(
            own(i), F.struct(F.get(starts, i).alias("at"), none.alias("out")), inner, lambda s: s["out"])))
        return F.when(F.size(xs) > 0, F.flatten(each)).otherwise(none)

    return let(items, body)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, left to right: (start, end, surface, before), in code points, end exclusive.

    The pieces between the matches give the places; ``before`` is the end of the piece before a match.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.filter(F.arrays_zip(found.alias("surface"), pieces.alias("piece")), lambda x: x["surface"].isNotNull())

    def spans(xs: Column) -> Column:
        at = running(xs, F.lit(0).cast("long"), lambda s, x: s + F.length(x["piece"]) + F.length(x["surface"]))
        return F.transform(F.arrays_zip(xs.alias("x"), at.alias("at")), lambda z: F.struct(
            (z["at"] + F.length(z["x"]["piece"])).alias("start"),
            (z["at"] + F.length(z["x"]["piece"]) + F.length(z["x"]["surface"])).alias("end"),
            z["x"]["surface"].alias("surface"), F.right(z["x"]["piece"], F.lit(CONTEXT)).alias("before")))

    return let(both, spans)


def apart(spans: Column, others: Column) -> Column:
    """``spans`` that touch none of ``others``: one sort of both and two folds, not all pairs."""
    empty = F.struct(F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("before"))
    marks = F.concat(
        F.transform(others, lambda b: F.struct(
            b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"),
            empty["surface"].alias("surface"), empty["before"].alias("before"))),
        F.transform(spans, lambda c: F.struct(
            c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"),
            c["surface"].alias("surface"), c["before"].alias("before"))))

    def body(xs: Column) -> Column:
        behind = running(xs, F.lit(-1).cast("long"), lambda s, x: F.when(x["own"] == 0, F.greatest(s, x["end"])).otherwise(s))
        ahead = F.reverse(running(F.reverse(xs), F.lit(2**62).cast("long"), lambda s, x: F.when(
            x["own"] == 0, F.least(s, x["start"])).otherwise(s)))
        kept = F.filter(F.arrays_zip(xs.alias("x"), behind.alias("behind"), ahead.alias("ahead")), lambda z: (
            z["x"]["own"] == 1) & (z["behind"] <= z["x"]["start"]) & (z["ahead"] >= z["x"]["end"]))
        return F.transform(kept, lambda z: z["x"])

    return let(F.array_sort(marks), body)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right counts double."""
    def add(total: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, surface: Column) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(surface, "\\."), lambda p: F.when(
            F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as ``__own``, with the text and an array column per kind of base spans, ``__email`` and so on."""
    own = F.struct(*(F.col(f"`{n}`") for n in docs.columns))
    out = docs.select(own.alias("__own"), F.coalesce("text", F.lit("")).alias("__text"))
    for kind, pattern in BASE.items():
        out = out.withColumn(f"__{kind}", F.when(_NEEDS[kind](F.col("__text")), located(F.col("__text"), pattern)))
    return out.withColumns({f"__{kind}": _kept(kind) for kind in BASE})


def _kept(kind: str) -> Column:
    spans = F.filter(F.col(f"__{kind}"), lambda s: _valid(kind, s["surface"]))
    return F.coalesce(_as_spans(spans, kind), F.expr(f"cast(array() as {SPAN})"))


def _as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _votes(c: Column) -> dict[str, Column]:
    """Vote of each labeler on a candidate: 1 for, -1 against, 0 not at all."""
    surface, before = c["surface"], c["before"]
    mixed = surface.rlike("[A-Za-z]") & surface.rlike("[0-9].*[0-9]")
    return {
        "strict": F.when(surface.rlike(STRICT), 1).otherwise(0),
        "key_word": F.when(before.rlike(KEYS_BEFORE), 1).otherwise(0),
        "number_word": F.when(before.rlike(NUMBERS_BEFORE) & surface.rlike("[0-9].*[0-9].*[0-9].*[0-9]"), 1).otherwise(0),
        "mark": F.when(before.rlike("[=:]\\s*[\"']?$"), 1).otherwise(0),
        "make_up": F.when(mixed & (F.length(surface) >= 12), 1).when(
            surface.rlike(f"^{GROUPED}$"), 0).when(~mixed, -1).otherwise(0),
        "against": F.when(before.rlike(AGAINST) | surface.rlike(NO_VALUE), -1).otherwise(0),
    }


def _make_up(c: Column) -> dict[str, Column]:
    """Features of a candidate for the final classifier, each with a few values."""
    surface = c["surface"]
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    return {
        "length": F.least(F.floor(F.length(surface) / 4).cast("int"), F.lit(8)),
        "digits": F.least(F.ceil(8 * digits / F.length(surface)).cast("int"), F.lit(8)),
        "letters": surface.rlike("[A-Z]").cast("int") + 2 * surface.rlike("[a-z]").cast("int"),
        "marks": surface.rlike("[^A-Za-z0-9]").cast("int"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans' rows with ``__candidates``: words worth a vote that touch no base span, with votes and features."""
    text, base = F.col("__text"), F.concat(*(F.col(f"__{k}") for k in BASE))
    marked = text.contains("=") | text.contains(":")  # most texts need no search for key words
    found = F.when(marked & text.rlike(f"(?i:{KEY})[\"']?\\s{{0,2}}[=:]"), located(text, f"{KEYED}|{CANDIDATE}")).when(
        text.rlike("[0-9]"), located(text, CANDIDATE))
    # two columns, so that a text is searched once
    out = docs.withColumn("__found", found).withColumn("__candidates", F.when(F.size("__found") > 0, F.when(
        F.size(base) > 0, apart(F.col("__found"), base)).otherwise(F.transform("__found", lambda c: F.struct(
            c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"),
            c["surface"].alias("surface"), c["before"].alias("before"))))))
    return out.withColumn("__candidates", F.transform("__candidates", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        *(v.alias(n) for n, v in _votes(c).items()), *(v.alias(n) for n, v in _make_up(c).items()))))


FEATURES = ("length", "digits", "letters", "marks")
VALUES = {"length": 9, "digits": 9, "letters": 4, "marks": 2}


def _log_odds(column: Column, table: dict[int, float]) -> Column:
    low = min(table)
    odds = ",".join(f"{table.get(v, 0.0)!r}D" for v in range(low, max(table) + 1))
    return F.get(F.expr(f"array({odds})"), column - low)


def by_value(patterns: DataFrame, names: tuple[str, ...], belief: Column, *sums: Column) -> dict[tuple[str, int], list[float]]:
    """Sums over the patterns per value of each column, and over all of them as ("", 0).

    The sums may use ``n`` and the belief as ``is``, which is computed once per pattern, before its values are laid out.
    """
    each = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("value")),
                   *(F.struct(F.lit(n).alias("name"), F.col(n).cast("int").alias("value")) for n in names))
    more = [c for c in patterns.columns if c not in (*LABELERS, *FEATURES)]
    rows = patterns.select(*more, belief.alias("is"), each.alias("each")).select("*", F.inline("each"))
    got = rows.groupBy("name", "value").agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(sums))).collect()
    return {(r.name, r.value): [float(x or 0) for x in r[2:]] for r in got}


def reliabilities(patterns: DataFrame, rounds: int = 25) -> tuple[float, dict[str, dict[int, float]]]:
    """Prior log-odds and each labeler's log-odds by vote, by expectation-maximisation on counted patterns.

    The first expectation is the majority vote. A round is one aggregate over the patterns, which are
    at most 3 to the number of labelers times the make-ups, however many documents there are.
    """
    votes = sum(F.col(n) for n in LABELERS)
    belief = F.when(votes > 0, 0.9).when(votes < 0, 0.1).otherwise(0.3)
    prior, odds = 0.0, {n: {v: 0.0 for v in (-1, 0, 1)} for n in LABELERS}
    for _ in range(rounds):
        sums = by_value(patterns, LABELERS, belief, F.col("n") * F.col("is"), F.col("n"))
        yes, total = sums.get(("", 0), (0.0, 0.0))
        new_prior = math.log((yes + 1) / (total - yes + 1))
        new = {}
        for n in LABELERS:
            new[n] = {}
            for v in (-1, 0, 1):
                up, every = sums.get((n, v), (0.0, 0.0))
                down = every - up
                new[n][v] = math.log((up + 0.5) / (yes + 1.5)) - math.log((down + 0.5) / (total - yes + 1.5))
        moved = abs(new_prior - prior) + sum(abs(new[n][v] - odds[n][v]) for n in LABELERS for v in (-1, 0, 1))
        prior, odds = new_prior, new
        belief = probability(prior, odds)
        if moved < 1e-6:
            break
    # the classes are named by the labelers that speak for a secret
    speaks = sum(odds[n][1] for n in ("strict", "key_word"))
    if speaks < 0:
        prior, odds = -prior, {n: {v: -x for v, x in t.items()} for n, t in odds.items()}
    return prior, odds


def probability(prior: float, odds: dict[str, dict[int, float]], of=F.col) -> Column:
    total = F.lit(prior)
    for name, table in odds.items():
        total = total + _log_odds(of(name), table)
    return 1 / (1 + F.exp(-total))


def classifier(patterns: DataFrame, belief: Column, rounds: int = 12) -> tuple[float, dict[str, dict[int, float]]]:
    """Logistic regression of the expected classes on votes and make-up: its constant and a weight per value.

    A round is one aggregate over the counted patterns: each weight moves by its slope over its curvature, divided by the
    number of features, as these move together.
    """
    names = (*LABELERS, *FEATURES)
    values = {n: (-1, 0, 1) if n in LABELERS else tuple(range(VALUES[n])) for n in names}
    constant, table = 0.0, {n: dict.fromkeys(own, 0.0) for n, own in values.items()}
    held = patterns.withColumn("wanted", belief)
    for _ in range(rounds):
        sums = by_value(held, names, probability(constant, table), F.col("n") * (F.col("wanted") - F.col("is")),
                        F.col("n") * F.col("is") * (1 - F.col("is")))
        share = 1 + len(names)
        slope, curve = sums.pop(("", 0), (0.0, 0.0))
        moved = abs(2 * slope / (curve + 1) / share)
        constant += 2 * slope / (curve + 1) / share
        for (n, v), (slope, curve) in sums.items():
            move = 2 * (slope - 0.01 * table[n][v]) / (curve + 1)
            table[n][v] += max(-2.0, min(2.0, move / share))
            moved += abs(move / share)
        if moved < 1e-3:
            break
    return constant, table


def find(docs: DataFrame, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Personal data of every document.

    Returns the columns ``carry`` of ``docs`` (all by default; those named like an added one are replaced) with
    ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive: the base spans by kind
    (email, ip, card, phone), then start, and all spans, the added ones of kind ``secret`` or ``number``
    last. Added are candidates that the final classifier gives ``least`` or more, if a format, key word, number word or
    mark speaks for them.

    A null text is empty and has no spans. Repeated rows count in the estimates as often as they are
    there. Without candidates nothing is added; an empty table gives no rows.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ("base", "spans")]
    marked = candidates(base_spans(docs))
    patterns = written(
        marked.select(F.explode("__candidates").alias("c")).select("c.*")
        .groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")), "patterns")
    prior, odds = reliabilities(patterns)
    constant, table = classifier(patterns, probability(prior, odds))

    def accept(c: Column) -> Column:
        # the make-up alone, which many product codes share, is not enough
        spoken = (c["strict"] > 0) | (c["key_word"] > 0) | (c["number_word"] > 0) | (c["mark"] > 0)
        return spoken & (probability(constant, table, lambda n: c[n]) >= least)

    base = F.concat(*(F.col(f"__{k}") for k in BASE))
    number = lambda c: (c["letters"] == 0) & (c["key_word"] == 0)
    more = F.coalesce(F.transform(F.filter("__candidates", accept), lambda c: F.struct(
        F.when(number(c), "number").otherwise("secret").alias("kind"), c["start"].alias("start"), c["end"].alias("end"))),
        F.expr(f"cast(array() as {SPAN})"))
    return marked.select(*(F.col(f"__own.`{n}`") for n in names), base.alias("base"), F.concat(base, more).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
