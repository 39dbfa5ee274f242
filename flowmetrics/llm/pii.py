"""Personal data by candidate gradient boosting (DataFrame functions only).

1. *Base* patterns (email, ip, card, phone) with their checks give the spans
   that always stay.  Positions come from the lengths between and of the
   matches, in code points.
2. High-recall *generators* propose more spans of the four kinds, in looser
   spelling (bracketed at and dot signs, other separators, numbers without
   ``+``) and next to other digits, where the base patterns run on and fail
   (a phone number followed by a card number); they overlap each other and the
   base spans.
3. Each candidate is described by a few format and context features, packed
   into one integer.  One aggregation over all documents counts, for every
   kind and feature value that occurs, candidates that are base spans and
   candidates that touch none: a table bounded by the feature space, and all
   that the fit needs.
4. A candidate whose own spelling shows what it is (bracketed or spelled signs,
   an area code in brackets, grouped digits with a valid check digit; dashes
   with a cue word before) is *evident*: it counts as a base span in the table
   and is added whatever the threshold, at any share of the corpus.
5. Boosted trees are fitted to that table and calibrated: the lowest score at
   which the share of base and evident spans reaches ``PRECISION`` is the
   threshold for the others.  The trees become one column expression;
   candidates that are evident, or at or above the threshold, and touch no base
   span and no better one that is added are added.

The patterns are possessive and start only where a longer match could not
have started before, which finds the same matches without backtracking over
long runs.

Defined results: a null or empty text has no spans; null ids and repeated rows
keep their rows; without base and evident spans, or without others, nothing is
learned and only evident spans are added; ``redact`` keeps all columns; other columns are not read by ``find``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS = 40
DEPTH = 2
RATE = 0.3
#: score of evident spans, above any sum of trees
EVIDENT = 1e9

_EMAIL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_EMAIL}]))[{_EMAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[\[({](?:at|@)[\])}]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20|\.)"
LOOSE = {
    "email": rf"(?<![{_EMAIL}])[{_EMAIL}]{{2,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\]|\x20?\.\x20?|\x20dot\x20)[0-9]{1,3}+(?:(?:\[\.\]|\x20?\.\x20?|\x20dot\x20)[0-9]{1,3}+){2}",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}"
            r"|3[47][0-9]{2}([\x20./_-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3}"
             r"[\x20./-][0-9]{3,4}(?![0-9])",
}
#: words that announce personal data, in the 24 signs before a candidate
CUES = r"(?i)mail|contact|phone|tel|call|fax|mobil|card|visa|credit|kart|tarj|addr|host|server|\bip\b"

_SPAN = "array<struct<s:int,e:int,m:string>>"
_MADE = "array<struct<s:int,k:int,e:int,b:boolean,v:int,f:int>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda a, m: F.struct(a.alias("a"), m.alias("m")))
    start = F.struct(F.lit(0).alias("pos"), _none(_SPAN).alias("out"))

    def step(acc, x):
        s = acc["pos"] + x["a"]
        e = s + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(
            e.alias("pos"),
            F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out")))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.try_cast("double") <= 255)
    n = F.length(_digits(m))
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(m))
    return (n >= 10) & (n <= 15)


def _loose_ok(kind: str, m: Column) -> Column:
    """What a loosely spelled candidate must still fulfil."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("double") <= 255)
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    return (n >= 7) & (n <= 15)


def _evidence(kind: str, m: Column) -> Column:
    """2: the spelling of a loose candidate shows what it is; 1: with a cue
    word before; 0: neither."""
    n = F.length(_digits(m))
    if kind == "email":
        sure = m.rlike(r"[\[({](?:at|@)[\])}]|\x20at\x20.*(?:\x20dot\x20|[\[({]dot[\])}])") & m.rlike(r"[A-Za-z]{2}$")
        cued = F.lit(False)
    elif kind == "ip":
        sure, cued = m.rlike(r"\[\.\]|dot"), m.rlike(r"\.")
    elif kind == "card":
        sure, cued = m.rlike("[^0-9]"), F.lit(True)
    else:
        sure = m.rlike(r"^\+|\(") & (n >= 10)
        cued = m.rlike(r"^[^\x20]*[./-]") & (n >= 10)
    return F.when(sure, 2).when(cued, 1).otherwise(0)


def _evident(c: Column) -> Column:
    cue = F.shiftright(c["f"], sum(WIDTHS[CUE + 1:])).bitwiseAND(F.lit(1)) == 1
    return (c["v"] == 2) | (c["v"] == 1) & cue


def _check(rule, kind: str):
    return lambda x: rule(kind, x["m"])


def _gate(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@")) | text.rlike(r"[\])}]\x20?[a-z]|\x20(?:at|dot)\x20")
    if kind == "phone":
        return text.rlike(r"[0-9](?:[\x20()./-]{0,2}[0-9]){5}")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20./_-]{0,2}[0-9]){12}")
    return text.rlike(r"[0-9](?:\[?\.|\x20\.|\x20dot)")


def _features(text: Column, s: Column, e: Column, m: Column) -> Column:
    """Packed features: 9 of them, in ``WIDTHS`` bits each."""
    before = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
    last = F.substring(text, s, F.lit(1))
    after = F.substring(text, e + 1, F.lit(1))
    bit = lambda c: c.cast("int")
    parts = [
        bit((s == 0) | last.rlike(r"\s")),
        bit((after == "") | after.rlike(r"[\s,.;:!?)]")),
        bit(before.rlike(CUES)),
        F.least((F.length(m) / 4).cast("int"), F.lit(7)),
        F.least((F.length(_digits(m)) / 3).cast("int"), F.lit(7)),
        bit(m.rlike("[A-Za-z]")),
        bit(m.rlike(r"\x20")),
        bit(m.rlike(r"[+@]")),
        bit(m.rlike(r"[\[({]")),
    ]
    out = F.lit(0)
    for p, w in zip(parts, WIDTHS):
        out = out * (1 << w) + p
    return out


WIDTHS = (1, 1, 1, 3, 3, 1, 1, 1, 1)
CUE = 2


def _unpack(f: int, kind: int) -> list[int]:
    out = []
    for w in reversed(WIDTHS):
        out.append(f % (1 << w))
        f >>= w
    return [kind, *reversed(out)]


def with_candidates(documents: DataFrame, keep: list) -> DataFrame:
    """``keep`` columns with __base (array of s, k, e) and __cand (candidates
    that are base spans or touch none, with their features)."""
    docs = documents.select(*keep, text_of(F.col("text")).alias("__t"))
    t = F.col("__t")
    base_of = {}
    for kind in KINDS:
        gate = F.contains(t, F.lit("@")) if kind == "email" else F.contains(t, F.lit("+")) if kind == "phone" \
            else _gate(kind, t)
        base_of[kind] = F.when(gate, F.filter(matches(t, BASE[kind]), _check(valid, kind))) \
            .otherwise(_none(_SPAN))
    loose_of = {k: F.when(_gate(k, t), F.filter(matches(t, LOOSE[k]), _check(_loose_ok, k)))
                .otherwise(_none(_SPAN)) for k in KINDS}
    docs = docs.select("*", *[base_of[k].alias(f"__b_{k}") for k in KINDS],
                       *[loose_of[k].alias(f"__l_{k}") for k in KINDS])

    def bare(k):
        return F.transform(F.col(f"__b_{k}"), lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))

    docs = docs.withColumn("__base", F.array_sort(F.concat(*[bare(k) for k in KINDS])))

    def made(k, column, is_base):
        return F.transform(F.col(column), lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"), F.lit(is_base).alias("b"),
            (F.lit(0) if is_base else _evidence(k, x["m"])).alias("v"),
            _features(F.col("__t"), x["s"], x["e"], x["m"]).alias("f")))

    apart = lambda x: ~F.exists(F.col("__base"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    cand = F.concat(*[made(k, f"__b_{k}", True) for k in KINDS],
                    *[F.filter(made(k, f"__l_{k}", False), apart) for k in KINDS])
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(f"__b_{k}") > 0) | (F.size(f"__l_{k}") > 0)
    return docs.withColumn("__cand", F.when(some, cand).otherwise(_none(_MADE))) \
        .drop(*[f"__{x}_{k}" for x in "bl" for k in KINDS])


# -- boosted trees over the table of feature values ------------------------------

def _fit_tree(rows, depth):
    """Regression tree on (x, gradient sum, curvature sum)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = RATE * g / (h + 1.0)
    if depth == 0 or len(rows) < 2:
        return leaf
    best, split = 1e-6, None
    score = lambda a, b: a * a / (b + 1.0)
    for j in range(len(rows[0][0])):
        for cut in sorted({r[0][j] for r in rows})[:-1]:
            lg = sum(r[1] for r in rows if r[0][j] <= cut)
            lh = sum(r[2] for r in rows if r[0][j] <= cut)
            gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
            if gain > best:
                best, split = gain, (j, cut)
    if split is None:
        return leaf
    j, cut = split
    return (j, cut, _fit_tree([r for r in rows if r[0][j] <= cut], depth - 1),
            _fit_tree([r for r in rows if r[0][j] > cut], depth - 1))


def _tree_value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(counts: list[tuple[int, int, int, int]]):
    """(trees, threshold) from (kind, features, base and evident spans, others); ``None``
    if there is nothing to learn from."""
    rows = [(_unpack(f, k), p, n) for k, f, p, n in sorted(counts)]
    if not sum(r[1] for r in rows) or not sum(r[2] for r in rows):
        return None
    trees, score = [], [0.0] * len(rows)
    for _ in range(ROUNDS):
        data = []
        for (x, p, n), z in zip(rows, score):
            q = 1 / (1 + math.exp(-z))
            data.append((x, p * (1 - q) - n * q, (p + n) * q * (1 - q)))
        tree = _fit_tree(data, DEPTH)
        trees.append(tree)
        score = [z + _tree_value(tree, x) for z, (x, _, _) in zip(score, rows)]
    best, p, n = math.inf, 0, 0
    for z, (_, a, b) in sorted(zip(score, rows), key=lambda r: -r[0]):
        p, n = p + a, n + b
        if p / (p + n) >= PRECISION:
            best = z
    return trees, best - 1e-9  # room for the order of the sums


def train(documents: DataFrame):
    """Fit on the counts of all candidates of all documents."""
    c = with_candidates(documents, []).select(F.explode_outer("__cand").alias("c")) \
        .filter(F.col("c").isNotNull())
    b = (F.col("c.b") | _evident(F.col("c"))).cast("long")
    # at most the feature space: 4 kinds x 2^13
    rows = c.select(F.col("c.k").alias("k"), F.col("c.f").alias("f"), b.alias("b")).groupBy("k", "f") \
        .agg(F.sum("b").alias("p"), F.sum(1 - F.col("b")).alias("n")).collect()
    return fit([(r["k"], r["f"], r["p"], r["n"]) for r in rows])


def _score(model, kind: Column, f: Column) -> Column:
    shifts, at = [], 0
    for w in reversed(WIDTHS):
        shifts.append((at, w))
        at += w
    shifts.reverse()

    def value(j):
        if j == 0:
            return kind
        at, w = shifts[j - 1]
        return F.shiftright(f, at).bitwiseAND(F.lit((1 << w) - 1))

    def column(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(value(tree[0]) <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    total = F.lit(0.0)
    for tree in model[0]:
        total = total + column(tree)
    return total


def chosen(scored: Column) -> Column:
    """(s, k, e) of the scored spans, taken in order of score (then s and k)
    where they touch none taken before."""
    order = F.array_sort(F.transform(scored, lambda c: F.struct(
        (-c["z"]).alias("w"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))

    def step(acc, a):
        one = F.struct(a["s"].alias("s"), a["k"].alias("k"), a["e"].alias("e"))
        return F.when(F.exists(acc, lambda b: (b["s"] < a["e"]) & (a["s"] < b["e"])), acc) \
            .otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(order, _none("array<struct<s:int,k:int,e:int>>"), step)


def with_spans(documents: DataFrame, keep: list, model) -> DataFrame:
    """``keep`` columns with __base and __all, sorted arrays of (s, k, e)."""
    docs = with_candidates(documents, keep)
    learned = model is not None and model[1] < math.inf

    def score(c):
        return F.when(_evident(c), F.lit(EVIDENT)).otherwise(_score(model, c["k"], c["f"]) if learned else F.lit(-1.0))

    scored = F.transform(F.filter(F.col("__cand"), lambda c: ~c["b"]), lambda c: F.struct(
        score(c).alias("z"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    docs = docs.withColumn("__x", F.when(F.size("__cand") > F.size("__base"), F.filter(
        scored, lambda c: c["z"] >= F.lit(model[1] if learned else 0.0))).otherwise(
            _none("array<struct<z:double,s:int,k:int,e:int>>")))
    more = chosen(F.col("__x"))
    return docs.withColumn("__all", F.array_sort(F.concat(F.col("__base"), more))).drop("__x")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(documents: DataFrame, model=None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (base and added)."""
    model = model or train(documents)
    docs = with_spans(documents, ["doc_id"], model)
    def count(i):
        return F.size(F.filter(F.col("__base"), lambda x: x["k"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return docs.select("doc_id", *counts, F.sha2(_listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                       _listed(F.col("__all")).alias("spans"))


def redact(documents: DataFrame, model=None) -> DataFrame:
    """All columns, with every span of ``text`` replaced by its kind in angle
    brackets (overlapping spans: by the kind of the first); a text without
    spans stays as it is, null too."""
    model = model or train(documents)
    docs = with_spans(documents, [F.struct(*[documents[c] for c in documents.columns]).alias("__row")], model)
    # merge overlapping spans: (s, e, kind) in order
    start = _none("array<struct<s:int,e:int,k:int>>")

    def merge(acc, x):
        one = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["k"].alias("k"))))
        ).otherwise(F.concat(acc, F.array(one)))

    docs = docs.withColumn("__m", F.when(F.size("__all") > 0, F.aggregate(F.col("__all"), start, merge)))
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    text = F.aggregate(F.col("__m"), zero, lambda acc, x: F.struct(
        x["e"].alias("pos"),
        F.concat(acc["out"], F.substring(F.col("__t"), acc["pos"] + 1, x["s"] - acc["pos"]),
                 F.element_at(name, x["k"] + 1)).alias("out")))
    docs = docs.withColumn("__r", F.when(F.col("__m").isNotNull(), text))
    new = F.when(F.col("__r").isNull(), F.col("__row.text")).otherwise(F.concat(
        F.col("__r.out"), F.substring(F.col("__t"), F.col("__r.pos") + 1, F.length("__t"))))
    return docs.select(*[new.alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in documents.columns])
