"""Operator 4: personal data by generators of candidates and gradient-boosted trees; DataFrame functions only.

Base kinds (e-mail, IP address, card, phone) are exact patterns with checks; their spans stay. Further generators, of
high recall, propose spans: local phone numbers, social security shapes, account numbers, written-out e-mail
addresses. Proposals may overlap each other and base spans. Boosted trees score each from its format (among it the
checks of its kind: account numbers modulo 97, areas that exist) and from the words around it; a proposal at or
above its kind's threshold competes. One that overlaps a base span loses, and of ones that overlap the best score stays.

No spans are labelled in the corpus, so the trees are trained on the driver on TRAINING made-up sentences whose
features Spark computes by the same expressions, and become one expression over literals. The sentences are of templates in which
words of CUES stand in some sentences of either label and are missing from others. A threshold is the lowest score,
even odds at least, at which precision is PRECISION or more on a quarter of the sentences that training doesn't see. The tests
measure precision and recall of each kind on sentences of their own.

Patterns are written so that Java neither recurses nor rescans: possessive repeats, and starts only where a run
begins or the last match ended. Time is in proportion to a text's length, however long.

Null texts count as empty; repeated rows give repeated rows; of equal scores the earlier span stays. An empty table
gives an empty result. Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import as_taken, best_apart, found, found_within, item, joined, kind_of

LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the contract's patterns in what they match from the left.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Generators of further kinds: pattern, cheap test.
FURTHER = {
    "phone_local": (r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])", r"[0-9][\x20.-][0-9]{3}"),
    "ssn": (r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "email_words": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}", r"[\[(](?:at|AT)[\])]"),
}
#: Words that speak for personal data, and against it, when they stand just before.
CUES = "phone|tel|telephone|call|mobile|fax|contact|ssn|social|iban|account|bank|mail|email|reach|konto|telefon|correo|cuenta|compte"
AGAINST = "version|order|invoice|part|isbn|serial|page|ref|id|build|model|total|article"
BEFORE, AFTER = 40, 16  # code points of context
FEATURES = ("digits", "length", "separators", "same_separator", "distinct", "letters", "valid", "cue", "cue_close", "against", "against_close", "paren", "mark_before", "unit_after", "year_like")
TRAINING, PRECISION = 8000, 0.95
TREES, RATE, DEPTH = 40, 0.3, 2


def base_spans(text: Column) -> dict[str, Column]:
    email = found(text, EMAIL, text.contains("@"))
    ip = F.filter(found(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda x: F.forall(F.split(x["m"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(x["m"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").substr(1, 9).cast("int") <= 255))
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    card = F.filter(found(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda x: F.length(digits(x["m"])).between(16, 19) & F.call_function("luhn_check", digits(x["m"])))
    phone = F.filter(found(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x["m"])).between(8, 15))
    return dict(zip(KINDS, (email, ip, card, phone), strict=True))


CHECKED, SOUND = ("iban", "ssn"), 6  # kinds that have check digits or areas; the place of valid() among the figures


def valid(m: Column) -> Column:
    """Whether a candidate passes the checks that its shape has: modulo 97, areas and groups that exist."""
    packed = F.regexp_replace(m, r"\x20", "")
    turned = F.split(F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4)), "")
    letter = lambda c: F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) + 9
    rest = F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c.rlike("^[A-Z]$"), (acc * 100 + letter(c)) % 97).otherwise((acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97))
    shapes = F.when(m.rlike("^[A-Z]{2}[0-9]{2}"), rest == 1)
    shapes = shapes.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
    shapes = shapes.when(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), m.rlike(r"^\(?[2-9]"))
    return shapes.otherwise(m.rlike(r"^\(?0|@|[\[(]"))


def figures(m: Column, before: Column, after: Column) -> list[Column]:
    """The features of a candidate, as doubles, in the order of FEATURES."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    marks = F.regexp_replace(m, "[A-Za-z0-9]", "")
    low = F.lower(before)
    cols = [
        F.length(digits),
        F.length(m),
        F.length(marks),
        F.size(F.array_distinct(F.split(F.regexp_replace(marks, r"[()\[\]]", ""), ""))) <= 2,
        F.size(F.array_distinct(F.split(digits, ""))),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        valid(m),
        low.rlike(rf"(?:^|[^a-z])(?:{CUES})[^a-z]"),
        low.rlike(rf"(?:^|[^a-z])(?:{CUES})[^a-z]{{1,4}}(?:[a-z]{{1,6}}[^a-z]{{1,3}})?$"),
        low.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]"),
        low.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{1,4}}(?:[a-z]{{1,6}}[^a-z]{{1,3}})?$"),
        m.startswith("("),
        before.rlike(r"[#$/=_*][\x20]?$"),
        F.lower(after).rlike(r"^[\x20]?(?:%|\$|eur|usd|kg|km|cm|mm|ml|units|pages|pcs|items|lines|rows|bytes|mb)"),
        m.rlike(r"^\(?(?:19|20)[0-9]{2}[^0-9]"),
    ]
    return [c.cast("double") for c in cols]


#: Templates of made-up sentences by label; {x} is the candidate, {w} any word. Cues are in some of both labels.
SAID = {
    1: ("my number is {x} if you {w}", "please ring {x} after {w}", "phone: {x}", "{w} {w} contact {x} {w}", "reach us on {x}", "tel. {x} {w}", "{w} lives at {w} and uses {x}", "write to {x} {w}", "account holder {w} {w}, {x}", "mail {x}", "ssn {x} {w}", "social security no. {x}", "transfer it to {x} {w}", "iban {x}", "{w} konto {x}", "telefon {x}", "{w}, {x}, {w} street", "ask for {w} under {x}", "call me: {x}", "patient {w} {w} {x}", "name {w} {w} id {x}", "bank {x}", "e-mail {x}", "{w} {w} {x}"),
    0: ("order {x} has shipped", "version {x} of {w}", "invoice no. {x} {w}", "part {x} fits {w}", "isbn {x}", "serial {x}", "page {x} of {w}", "measured {x} units", "build {x} {w}", "total {x} usd", "see #{x}", "table {x} {w} {w}", "lot {x} {w}", "model {x} phone {w}", "ratio {x} %", "{w} {w} {w} {x} {w}", "call stack at {x} lines", "article {x}", "set {w}={x}", "chapter {x} {w}", "tracking code {x}", "catalogue {x} {w}", "route {x} km", "coordinates {x}"),
}


def account(r: random.Random) -> str:
    """An account number whose check digits are right."""
    body = "".join(r.choice("0123456789") for _ in range(18))
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def made_up(n: int = TRAINING, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """kind, candidate, what stands before and after it, label: made by rule, for training and calibration.

    A sentence that speaks of personal data nearly always holds a sound value, another one any value of the shape.
    """
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 8)))
    out = []
    for k in range(n):
        kind, real = list(FURTHER)[k % len(FURTHER)], r.random() < 0.5
        sound = r.random() < (0.97 if real else 0.3)
        if kind == "phone_local":
            sep = r.choice(" .-")
            area = r.choice("23456789") + digit(2)
            m = (f"({area}) {digit(3)}-{digit(4)}" if r.random() < 0.4 else sep.join((area, digit(3), digit(4)))) if sound else r.choice([" ", "-", "."]).join((digit(r.randint(2, 4)), digit(r.choice((3, 4))), digit(r.choice((3, 4)))))
        elif kind == "ssn":
            m = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if sound else f"{r.choice(['000', '666', '9' + digit(2), digit(3)])}-{digit(2)}-{digit(4)}"
        elif kind == "iban":
            m = account(r) if sound else r.choice(["DE" + digit(20), "".join(r.choice("ABCDEF") for _ in range(2)) + digit(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(12))])
            if r.random() < 0.3:
                m = " ".join(m[at : at + 4] for at in range(0, len(m), 4))
        else:
            m = f"{word()}.{word()} [at] {word()} [dot] com" if sound else r.choice([f"{word()} (at) {word()}.{word()}", f"{digit(2)} (at) {digit(2)}.{digit(1)}"])
        said = r.choice(SAID[real])
        while "{w}" in said:
            said = said.replace("{w}", word(), 1)
        before, after = said.split("{x}")
        out.append((kind, m, before[-BEFORE:], after[:AFTER], int(real)))
    return out


def split_on(x: np.ndarray, g: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on residuals: nested (feature, cut, left, right), or a leaf's value."""
    value = float(g[rows].sum() / (len(rows) + 1.0))
    if depth == 0 or len(rows) < 40:
        return value
    best = None
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
            left = v <= cut
            a, b = int(left.sum()), int((~left).sum())
            if a < 15 or b < 15:
                continue
            gain = g[rows][left].sum() ** 2 / (a + 1) + g[rows][~left].sum() ** 2 / (b + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, float(cut))
    if best is None:
        return value
    _, f, cut = best
    left = x[rows, f] <= cut
    return (f, cut, split_on(x, g, rows[left], depth - 1), split_on(x, g, rows[~left], depth - 1))


def tree_value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, tree_value(left, x), tree_value(right, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Trees of the logistic loss; leaves hold Newton-like steps, scaled by RATE."""
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-score))
        tree = split_on(x, 4 * g, np.arange(len(y)), DEPTH)
        trees.append(tree)
        score += RATE * tree_value(tree, x)
    return trees


def flat(tree) -> str:
    """A tree of depth 2 as an SQL struct: feature and cut of the root and of both children, and four leaves."""
    f, cut, left, right = tree if isinstance(tree, tuple) else (0, 0.0, tree, tree)
    lower = [t if isinstance(t, tuple) else (0, 0.0, t, t) for t in (left, right)]
    cells = {"f": f, "cut": cut, "fl": lower[0][0], "cutl": lower[0][1], "fr": lower[1][0], "cutr": lower[1][1], "a": lower[0][2], "b": lower[0][3], "c": lower[1][2], "d": lower[1][3]}
    return "named_struct(" + ", ".join(f"'{k}', {v}" if k[0] == "f" else f"'{k}', {float(v)!r}D" for k, v in cells.items()) + ")"


class Model:
    """One ensemble for each further kind, with its threshold."""

    def __init__(self, trees: dict[str, list], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, kind: Column, x: Column) -> Column:
        """Log-odds, for the figures x of a candidate of a kind (its place in FURTHER), less the kind's threshold."""
        trees = F.expr("array(" + ", ".join("array(" + ", ".join(map(flat, self.trees[k])) + ")" for k in FURTHER) + ")")
        least = F.expr("array(" + ", ".join(f"{min(self.thresholds[k], 1e9)!r}D" for k in FURTHER) + ")")

        def add(acc: Column, t: Column) -> Column:
            at = lambda f, cut: F.get(x, t[f]) <= t[cut]
            lower = F.when(at("fl", "cutl"), t["a"]).otherwise(t["b"])
            return acc + F.when(at("f", "cut"), lower).otherwise(F.when(at("fr", "cutr"), t["c"]).otherwise(t["d"]))

        # a number that its own check digits or areas rule out is none of its kind, whatever stands around it
        checked = kind.isin(*(k for k, name in enumerate(FURTHER) if name in CHECKED))
        unsound = checked & (F.get(x, F.lit(SOUND)) == 0)
        return F.when(unsound, F.lit(-1e9)).otherwise(F.aggregate(F.get(trees, kind), F.lit(0.0), add) * RATE - F.get(least, kind))


_models: dict[str, Model] = {}


def train(spark: SparkSession) -> Model:
    """Trains on three quarters of the sentences and calibrates on the rest. An application trains once."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        made = spark.createDataFrame(made_up(), "kind string, m string, before string, after string, label int")
        rows = made.select("kind", "label", F.array(*figures(F.col("m"), F.col("before"), F.col("after"))).alias("x")).collect()
        trees, thresholds = {}, {}
        for kind in FURTHER:
            x = np.array([r["x"] for r in rows if r["kind"] == kind])
            y = np.array([float(r["label"]) for r in rows if r["kind"] == kind])
            rest = np.arange(len(y)) % 4 == 3  # kinds take turns, so that this deals labels and templates at random
            trees[kind] = boost(x[~rest], y[~rest])
            score = RATE * sum(tree_value(t, x[rest]) for t in trees[kind])
            order = np.argsort(-score)
            precision = np.cumsum(y[rest][order]) / np.arange(1, rest.sum() + 1)
            good = np.flatnonzero(precision >= PRECISION)
            thresholds[kind] = max(0.0, float(score[order][good[-1]])) if len(good) else float("inf")
        _models[key] = Model(trees, thresholds)
    return _models[key]


def pii_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of every row of docs, in one pass without a shuffle."""
    model = model or train(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    t = F.col("body")
    base = base_spans(t)
    near = {k: found_within(t, p, t.rlike(test), BEFORE, AFTER) for k, (p, test) in FURTHER.items()}
    own = own.select("doc_id", *(c.alias(k) for k, c in base.items()), *(c.alias(k) for k, c in near.items()))
    names = F.array(*map(F.lit, FURTHER))

    def judged(x: Column) -> Column:
        score = F.element_at(F.transform(F.array(F.array(*figures(x["m"], x["before"], x["after"]))), lambda f: model.score(x["o"], f)), 1)
        return item(x, F.get(names, x["o"]), taken=False, score=score)

    numbered = lambda k, o: F.transform(F.col(k), lambda x: x.withField("o", F.lit(o)))
    proposed = F.filter(F.transform(F.concat(*(numbered(k, o) for o, k in enumerate(FURTHER))), judged), lambda x: x["score"] >= 0)
    taken = F.concat(*map(as_taken, KINDS))
    of_kind = lambda k: F.filter("chosen", lambda x: x["kind"] == k)
    any_more = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in FURTHER])
    chosen = F.when(any_more, best_apart(taken, proposed))
    own = own.select("doc_id", *KINDS, chosen.alias("chosen"))
    ordered = [kind_of(F.col(k), k, o) for o, k in enumerate(KINDS)]
    more = [kind_of(of_kind(k), k, len(KINDS) + o) for o, k in enumerate(FURTHER)]
    base_text = joined(F.concat(*ordered))
    all_text = F.when(F.size("chosen") > 0, joined(F.concat(*ordered, *more))).otherwise(base_text)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return own.select("doc_id", *counts, F.sha2(base_text, 256).alias("base_sha256"), all_text.alias("spans"))
