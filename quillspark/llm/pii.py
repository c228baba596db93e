"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates come from patterns. Labelers vote on each: the pattern's own check, gazetteers (top-level domains, card and
country prefixes, area numbers), the words before it, the characters around it. Spark counts the combinations of votes
(at most 3^4 a kind, whatever the input); on these counts expectation-maximisation estimates each labeler's reliability
and each kind's share of true spans, and a logistic span classifier is trained on the resulting probabilities. As a
column expression it then judges every candidate. Base spans (the four contracted patterns that pass their checks)
always stay; what the classifier accepts of the rest is added where it overlaps no base span. The time for a text grows
with its length, however many spans it has.

Offsets are code points, the end exclusive. Patterns are written so that Java's matcher neither recurses nor starts
anew inside a run that has failed; their matches are the same.

Defined results: null and empty texts have no spans; very long texts are searched whole; repeated rows have equal
results; an empty table gives no rows, and the classifier then accepts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, written

KINDS = ["email", "ip", "card", "phone", "ssn"]
#: Patterns: (kind, is base, Java regular expression).
PATTERNS = [
    (0, True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (1, True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    (2, True, r"[0-9](?:[ -]?[0-9])++"),
    (3, True, r"\+[0-9][ ().0-9-]+[0-9]"),
    (0, False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"),
    (3, False, r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    (4, False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
]
#: Words that stand before personal data of a kind, and prefixes and endings by which gazetteers know it.
CONTEXT = ["mail|contact|write to|reach", r"\bip\b|address|host|server|login", "card|visa|master|payment|credit", "phone|tel|call|fax|mobile|dial", "ssn|social|security"]
GAZETTEER = [
    r"(?i)[. )\]](com|org|net|edu|gov|info|io|eu|uk|us|ca|de|fr|es|it|nl|ch|at|be|jp|cn|in|br|mx|ar|au)$",
    r"^(?!0+\.|127\.|2[2-5][0-9]\.)",
    r"^(4|5[ -]?[1-5]|3[ -]?[47]|6[ -]?0[ -]?1[ -]?1|6[ -]?5|2[ -]?[2-7])",
    r"^(\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
]
ACCEPT, ROUNDS = 0.9, 60
#: Elements that a scan goes through at once; code points of a piece that redaction cuts a text into.
BLOCK, CUT = 128, 512


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: int, base: bool, m: Column) -> Column:
    """The check that a base pattern's match must pass; for the others, what makes the match likely."""
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == 2:
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == 3 and base:
        return F.length(_digits(m)).between(9, 15)
    if kind == 3:
        return _digits(m).rlike("^[2-9][0-9]{2}[2-9]")
    return m.rlike("[A-Za-z]{2,6}$") if kind == 0 and not base else F.lit(True)


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once a row, however often f names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _scan(values: Column, op, zero: int) -> Column:
    """(n + 1 whole numbers) what op makes of the values before each element, and of all. In blocks, so that its time is
    that of the array's length times BLOCK at most: an array that grows by one is copied each time."""

    def plain(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    start = F.lit(zero).cast("int")

    def blocks(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        own = lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(numbers, lambda b: F.aggregate(own(b), start, lambda acc, x: op(acc, x)))

        def filled(before: Column) -> Column:
            inner = F.transform(numbers, lambda b: _let(plain(own(b), F.element_at(before, b + 1)), lambda r: F.slice(r, F.lit(1), F.size(r) - 1)))
            return F.concat(F.flatten(inner), F.array(F.element_at(before, -1)))

        return _let(plain(totals, start), filled)

    return _let(values, lambda xs: F.when(F.size(xs) <= BLOCK, plain(xs, start)).otherwise(blocks(xs)))


def _found(text: Column, number: int) -> Column:
    """Array of (kind, base, start, end, votes) for one pattern's matches, in time that grows with the text's length.

    The text is cut at the matches; a match's place is the sum of the lengths before it, and its context is the end of
    the piece before it and the start of the piece after it, so the text is never walked again for a match.
    """
    kind, base, pattern = PATTERNS[number]
    state = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))
    sign = lambda c, no: F.when(c, 1).otherwise(no)

    def span(z: Column) -> Column:
        word, before = z["m"], F.lower(F.right(F.concat(z["last"], z["gap"]), F.lit(40)))
        at = z["pos"] + F.length(z["gap"])
        around = F.concat(F.when(before == "", " ").otherwise(F.right(before, F.lit(1))), F.lit("|"), F.left(F.concat(z["after"], z["next"]), F.lit(1)))
        votes = F.array(sign(_valid(kind, base, word), -1), sign(word.rlike(GAZETTEER[kind]), -1), sign(before.rlike(CONTEXT[kind]), 0), sign(~around.rlike(r"[\p{L}\p{N}]"), -1))
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), at.alias("at"), (at + F.length(word)).alias("until"), votes.alias("v"))

    def spans(x: Column) -> Column:
        m, s = x["m"], x["s"]
        n = F.size(m)
        pos = F.slice(_scan(F.zip_with(m, F.slice(s, F.lit(1), n), lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b, 0), F.lit(1), n)
        none = F.array(F.lit(""))
        last, next_ = F.concat(none, F.slice(m, F.lit(1), n - 1)), F.concat(F.slice(m, F.lit(2), n), none)
        zipped = F.arrays_zip(m.alias("m"), F.slice(s, F.lit(1), n).alias("gap"), F.slice(s, F.lit(2), n).alias("after"), last.alias("last"), next_.alias("next"), pos.alias("pos"))
        return F.transform(zipped, span)

    # one evaluation of the pattern a text: the state goes through a lambda
    return _let(state, lambda x: F.when(F.size(x["m"]) > 0, spans(x)).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,base:boolean,at:int,until:int,v:array<int>>>")


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    """(row, found): each row as a struct, whatever its columns are called, with all patterns' matches and their votes."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    low = F.lower(text)
    may = {0: F.contains(text, F.lit("@")), 3: F.contains(text, F.lit("+")), 4: F.contains(low, F.lit("at)")) | F.contains(low, F.lit("at]"))}
    digits = text.rlike("[0-9]")
    found = [F.when(may.get(n, digits), _found(text, n)).otherwise(_none()) for n in range(len(PATTERNS))]
    return df.select(row_of(df.columns), F.concat(*found).alias("found"))


def vote_counts(found: DataFrame) -> list[tuple]:
    """(kind, base, votes, count): the combinations of votes, a bounded number of rows."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.base", "c.v").agg(F.count("*").alias("n")).collect()
    return sorted((r.kind, r.base, tuple(r.v), r.n) for r in rows)


def estimate(counts: list[tuple]) -> tuple[dict, list[float], list[float]]:
    """(share of true spans by kind, reliability of each labeler, probability of each combination), by EM.

    A labeler that votes is right with its own probability, whatever the kind; one that abstains says nothing.
    """
    right, share = [0.9, 0.7, 0.8, 0.7], {k: 0.5 for k, *_ in counts}
    post: list[float] = []
    for _ in range(ROUNDS):
        post = []
        for kind, _, votes, _ in counts:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for kind in share:
            total = sum(n for k, _, _, n in counts if k == kind)
            share[kind] = min(0.95, max(0.05, (1 + sum(n * p for (k, _, _, n), p in zip(counts, post) if k == kind)) / (2 + total)))
        for j in range(len(right)):
            agree = sum(n * (p if c[j] > 0 else 1 - p) for (_, _, c, n), p in zip(counts, post) if c[j])
            total = sum(n for _, _, c, n in counts if c[j])
            right[j] = min(0.99, max(0.55, (8 + agree) / (10 + total)))
    return share, right, post


def train(counts: list[tuple], post: list[float]) -> list[float]:
    """Weights of the span classifier: one a labeler, one a kind, by gradient steps on the soft labels."""
    size = 4 + len(KINDS)
    w = [0.0] * size
    total = sum(n for *_, n in counts) or 1
    x = [([*map(float, v), *[float(k == i) for i in range(len(KINDS))]], n / total) for k, _, v, n in counts]
    for step in range(400):
        grad = [0.002 * a for a in w]
        for (f, n), p in zip(x, post):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f))))))
            for i, b in enumerate(f):
                if b:
                    grad[i] += n * (q - p) * b
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def classifier(found: DataFrame) -> list[float]:
    """The span classifier for these candidates; where there are none, one that accepts nothing."""
    counts = vote_counts(found)
    if not counts:
        return [0.0] * 4 + [-9.0] * len(KINDS)
    return train(counts, estimate(counts)[2])


def spans(found: Column, weights: list[float]) -> tuple[Column, Column]:
    """(base spans, all spans) as arrays of (kind, at, until), in order of kind and start."""
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["at"].alias("at"), c["until"].alias("until"))
    base = F.array_sort(F.transform(F.filter(found, lambda c: c["base"] & (c["v"][0] == 1)), plain))

    def accepted(c: Column) -> Column:
        odds = sum((c["v"][j] * weights[j] for j in range(4)), F.lit(0.0)) + F.element_at(F.array(*[F.lit(float(x)) for x in weights[4:]]), c["kind"] + 1)
        return (1 / (1 + F.exp(-odds)) >= ACCEPT) & ~(c["base"])

    def fit(every: Column) -> Column:
        """Of spans by start, base ones first, those that are base or overlap none: by the furthest end of base spans up to
        each, and the nearest start of one after it."""
        far = F.slice(_scan(F.transform(every, lambda c: F.when(c["mine"] == 0, c["until"]).otherwise(-1)), F.greatest, -1), F.lit(1), F.size(every))
        most = 2**31 - 1
        back = _scan(F.transform(F.reverse(every), lambda c: F.when(c["mine"] == 0, c["at"]).otherwise(most)), F.least, most)
        near = F.reverse(F.slice(back, F.lit(1), F.size(every)))
        kept = F.filter(F.arrays_zip(every.alias("c"), far.alias("far"), near.alias("near")), lambda z: (z["c"]["mine"] == 0) | ((z["far"] <= z["c"]["at"]) & (z["near"] >= z["c"]["until"])))
        return F.transform(kept, lambda z: F.struct(z["c"]["kind"].alias("kind"), z["c"]["at"].alias("at"), z["c"]["until"].alias("until")))

    tagged = lambda mine: lambda c: F.struct(c["at"].alias("at"), F.lit(mine).alias("mine"), c["until"].alias("until"), c["kind"].alias("kind"))
    added = F.transform(F.filter(found, accepted), tagged(1))
    every = _let(F.array_sort(F.concat(F.transform(base, tagged(0)), added)), fit)
    return base, F.when(F.size(added) > 0, F.array_sort(F.array_distinct(every))).otherwise(base)


def listed(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["at"].cast("string"), c["until"].cast("string"))), ",")


def redacted(found: DataFrame, text_col: str, weights: list[float]) -> DataFrame:
    """The rows of candidates with each span of the text replaced by its kind in brackets; spans that overlap become one."""
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    every = F.array_sort(F.transform(spans(F.col("found"), weights)[1], lambda c: F.struct(c["at"].alias("at"), c["until"].alias("until"), c["kind"].alias("kind"))))

    def put(x: Column) -> Column:
        """Pieces of the text between the spans come from pieces of CUT code points, so the text is walked once."""
        spans_, parts = x["spans"], x["parts"]

        def piece(at: Column, until: Column) -> Column:
            first = F.floor(at / CUT).cast("int")
            near = F.array_join(F.slice(parts, first + 1, F.floor((until - 1) / CUT).cast("int") - first + 1), "")
            return F.when(until > at, F.substring(near, at % CUT + 1, until - at)).otherwise("")

        ends = _scan(F.transform(spans_, lambda c: c["until"]), F.greatest, 0)
        own = F.arrays_zip(spans_.alias("c"), F.slice(ends, F.lit(1), F.size(spans_)).alias("end"))
        out = F.transform(own, lambda z: F.when(z["c"]["at"] >= z["end"], F.concat(piece(z["end"], z["c"]["at"]), F.element_at(names, z["c"]["kind"] + 1))).otherwise(""))
        return F.concat(F.array_join(out, ""), piece(F.array_max(ends), x["size"]))

    def clean(every: Column) -> Column:
        cut = F.struct(every.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("parts"), F.length(text).alias("size"))
        return F.when(F.size(every) > 0, _let(cut, put)).otherwise(F.col("row")[text_col].cast("string"))

    kind = found.schema["row"].dataType[text_col].dataType
    return found.withColumn("row", F.col("row").withField(f"`{text_col}`", _let(every, clean).cast(kind))).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = written(candidates(documents.select("doc_id", "text"), "text").select("row.doc_id", "found"), "candidates")
    base, every = spans(F.col("found"), classifier(found))
    rows = found.select("doc_id", base.alias("base"), every.alias("every"))

    def number(kind: int) -> Column:  # a lambda's second parameter would be the element's position
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    count = [number(k) for k in range(4)]
    return rows.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))
