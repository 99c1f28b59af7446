"""Personal data: high-recall candidate generators, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.pii_examples import examples, labelled
from strandloom.llm.text import digits_of, joined, luhn_sum, require, spans, tagged, whole

#: The base kinds, in order. Possessive loops match what plain ones would, without recursion. A match begins where a run of
#: its first characters does or where the last match ended: from any other place of the run it would go on alike, so the first of these is
#: the leftmost, and a long run is walked once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates, which may overlap one another and the base spans.
GENERATORS = {
    "local_phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9A-Za-z])",
    "spelt_email": r"[A-Za-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,10}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "long_number": r"(?<![0-9A-Za-z])[0-9]{9,16}(?![0-9A-Za-z])",
}
KINDS = ["email", "ip", "card", "phone", *GENERATORS]
#: Words that announce personal data, and words that announce other numbers, looked for in the CONTEXT characters before a candidate.
CUES = (r"(?i)(?<![a-z])(?:telephone|phone|tel|call|mobile|fax|e-?mail|contact|write\x20to|card|visa|account|iban|bank|ssn|social\x20security|passport|id|ip|host|address)s?"
        r"(?:[^a-z]+(?:no|nr|num|number|is|us|me))?[^a-z]*$")
COUNTERS = (r"(?i)(?<![a-z])(?:order|invoice|part|item|ref|reference|version|build|page|isbn|issn|doi|serial|sku|model|ticket|lot|batch|section|score)s?"
            r"(?:[^a-z]+(?:no|nr|num|number|id|is))?[^a-z]*$")
CONTEXT = 24
#: Checks of the generators' candidates that need no cue; IBANs are checked by iban_fits, long numbers by luhn.
NATIONAL_ID = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
#: Groups of local phone numbers: area, exchange and line, or a trunk zero with 9 to 12 digits in all that do not begin as a date.
PHONE_GROUPS = r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$|^(?![0-9]{2}[./-][0-9]{2}[./-][0-9]{4})\(?0[1-9][0-9]{0,3}\)?(?:[\x20./-][0-9]{2,5}){2,4}$"
TLD = r"(?:com|org|net|edu|gov|info|biz|io|co|me|uk|ie|us|ca|mx|br|ar|au|nz|in|jp|cn|kr|za|ru|eu|de|at|ch|fr|be|nl|es|pt|it|se|no|dk|fi|pl)"
SPELT = rf"(?i)[(\[]|\x20dot\x20{TLD}$"
ENDING = rf"(?i)(?:\.|dot[)\]]?\x20?){TLD}$"
DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9])"

#: Features of a candidate, all small integers: kind, digits, length, separators, longest run of digits, distinct digits, whether the check of its
#: kind fits, whether it ends as a spelt address, whether it begins as a date, whether a cue or a counter word stands before it.
FEATURES = ["kind", "digits", "length", "separators", "run", "variety", "check", "ending", "date", "cue", "counter"]


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    return luhn_sum(digits) % 10 == 0


def iban_fits(m: Column) -> Column:
    """Whether length and check digits (modulo 97) are those of an IBAN."""
    bare = F.regexp_replace(m, "[^0-9A-Z]", "")
    chars = F.split(F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4)), "(?!$)", -1)
    step = lambda a, c: F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.length(bare).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def check_fits(kind: Column, m: Column) -> Column:
    """Whether a generator's candidate passes the check of its kind, whatever stands around it."""
    tests = {"local_phone": F.regexp_like(m, F.lit(PHONE_GROUPS)) & F.length(digits_of(m)).between(9, 12), "spelt_email": F.regexp_like(m, F.lit(SPELT)),
             "iban": iban_fits(m), "national_id": F.regexp_like(m, F.lit(NATIONAL_ID)), "long_number": F.regexp_like(m, F.lit("^4[0-9]{12}$")) & luhn(m)}
    return reduce(lambda a, k: F.when(kind == KINDS.index(k), tests[k]).otherwise(a), tests, F.lit(False))


def base_spans(text: Column) -> list[Column]:
    """Validated spans of email, ip, card and phone."""
    size = lambda s: F.length(digits_of(s["match"]))
    small = lambda s: F.forall(F.split(s["match"], r"\.", -1), lambda x: x.cast("double") <= 255)
    return [spans(text, EMAIL, F.contains(text, F.lit("@"))),
            F.filter(spans(text, IP), small),
            F.filter(spans(text, CARD), lambda s: (size(s) >= 14) & (size(s) <= 19) & luhn(digits_of(s["match"]))),
            F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: (size(s) >= 10) & (size(s) <= 15))]


def candidates(text: Column) -> Column:
    """array<struct<start, order, end, kind, x>>: candidates of all generators with their features (x), in time linear in the text."""
    at = F.regexp_like(text, F.lit(r"[(\[\x20]at[)\]\x20]"))

    def ordered(k: int, kind: str) -> Column:
        found = spans(text, GENERATORS[kind], at if kind == "spelt_email" else None, CONTEXT)
        return F.transform(found, lambda s: F.struct(F.lit(k).alias("order"), F.lit(kind).alias("kind"), s.alias("at")))

    def measured(c: Column) -> Column:
        s, flag = c["at"], lambda p, of: F.regexp_like(of, F.lit(p)).cast("int")
        d = digits_of(s["match"])
        runs = F.array_max(F.transform(F.split(s["match"], "[^0-9]+", -1), lambda x: F.length(x)))
        bins = [c["order"], F.least(F.length(d), F.lit(20)), F.least(F.length(s["match"]), F.lit(40)), F.least(F.length(F.regexp_replace(s["match"], "[0-9A-Za-z]", "")), F.lit(10)),
                F.least(F.coalesce(runs, F.lit(0)), F.lit(16)), F.when(d == "", F.lit(0)).otherwise(F.size(F.array_distinct(F.split(d, "(?!$)", -1)))),
                check_fits(c["order"], s["match"]).cast("int"), flag(ENDING, s["match"]), flag(DATE, s["match"]), flag(CUES, s["before"]), flag(COUNTERS, s["before"])]
        return F.struct(s["start"].alias("start"), c["order"].alias("order"), s["end"].alias("end"), c["kind"].alias("kind"), F.array(*bins).alias("x"))

    return F.transform(F.concat(*[ordered(KINDS.index(k), k) for k in GENERATORS]), measured)


@dataclass
class Boosted:
    """Trees on integer features: (feature, cut, left, right), sides being such trees again or numbers."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(t, rows):
            return np.full(len(rows), t) if isinstance(t, float) else np.where(rows[:, t[0]] <= t[1], walk(t[2], rows), walk(t[3], rows))
        return self.start + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, x: Column) -> Column:
        """The same margin as a column expression."""
        def walk(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.get(x, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3]))
        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(self.start))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 24, rate: float = 0.4, depth: int = 3) -> Boosted:
    """Gradient boosting with logistic loss over weighted distinct feature rows."""
    model = Boosted()
    if not w.sum():
        return model
    mean = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), model.start)

    def leaf(g, h):
        return float(rate * g.sum() / (h.sum() + 1.0))

    def grow(rows, g, h, depth):
        best = None
        for f in range(x.shape[1]) if depth else []:
            v = x[rows, f]
            top = int(v.max(initial=0)) + 1
            gs, hs = np.cumsum(np.bincount(v, g[rows], top)), np.cumsum(np.bincount(v, h[rows], top))
            gain = gs ** 2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            k = int(np.argmax(gain[:-1])) if top > 1 else -1
            if k >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), f, k)
        if best is None:
            return leaf(g[rows], h[rows])
        _, f, k = best
        side = x[rows, f] <= k
        return (f, k, grow(rows[side], g, h, depth - 1), grow(rows[~side], g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(grow(np.arange(len(x)), w * (y - p), w * p * (1 - p), depth))
        margin = model.margin(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> None:
    """Set a threshold for every kind: the lowest margin, not below zero, above which ``precision`` of the kind's weight is positive.

    Of a kind without such a margin nothing is taken.
    """
    margin = model.margin(x)
    for kind in np.unique(x[w > 0, 0]):
        rows = np.flatnonzero((x[:, 0] == kind) & (w > 0) & (margin >= 0))
        order = rows[np.argsort(-margin[rows], kind="stable")]
        if not len(order):
            continue
        good = np.cumsum((w * y)[order]) / np.cumsum(w[order]) >= precision
        last = np.append(np.diff(margin[order]) < -1e-12, True)
        ok = np.flatnonzero(good & last)
        if len(ok):
            model.thresholds[int(kind)] = max(0.0, float(margin[order][ok[-1]]) - 1e-9)


#: Fitted models by their parameters; they depend on nothing else.
_FITTED: dict[tuple, Boosted] = {}


def fit(spark: SparkSession, n_examples: int = 8_000, precision: float = 0.98) -> Boosted:
    """Boosted trees that tell planted personal data from planted look-alikes (``pii_examples``).

    A label says what was planted, which no feature holds: look-alikes pass the check of their kind behind a counter word, and personal data
    that fails it stands behind a cue. Three fifths of the examples train the trees, one sets the thresholds, one is held out for ``report``
    (precision and recall of each kind). The model depends on no table, so the same text has the same spans in any corpus. Counts per distinct
    feature row are summed first; ``n_examples`` bounds what reaches the driver.
    """
    if (n_examples, precision) in _FITTED:
        return _FITTED[n_examples, precision]
    # explode_outer: the filter that Spark infers for explode would compute texts and candidates once more
    rows = labelled(examples(spark, n_examples).withColumn("c", F.explode_outer(candidates(F.col("text")))).where("c IS NOT NULL"), F.col("c"))
    hist = sorted(rows.groupBy(F.col("c.x").alias("x"), "part").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["x"], r["part"]))
    x = np.array([r["x"] for r in hist], int).reshape(len(hist), len(FEATURES))
    n, pos, part = (np.array([r[c] for r in hist], float) for c in ("n", "pos", "part"))
    x, y, w, part = np.concatenate([x, x]), np.repeat([1.0, 0.0], len(hist)), np.concatenate([pos, n - pos]), np.concatenate([part, part])
    model = boost(x, y, w * (part >= 2))
    calibrate(model, x, y, w * (part == 1), precision)
    taken = model.margin(x) >= np.array([model.thresholds.get(int(k), np.inf) for k in x[:, 0]])
    for k, kind in enumerate(KINDS):
        held = w * (part == 0) * (x[:, 0] == k)
        if (held * y).sum():
            hits = (held * y)[taken].sum()
            model.report[kind] = (float(hits / max(held[taken].sum(), 1)), float(hits / (held * y).sum()), int(held.sum()))
    _FITTED[n_examples, precision] = model
    return model


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(doc_id, base, found): validated base spans, and all spans, for every row of ``docs`` (doc_id, text).

    The base spans always stay; beside them every candidate of the generators is decided by the trees alone, which are column expressions:
    its margin has to reach the threshold of its kind. Candidates may overlap one another and base spans. Null and empty texts have none; rows are
    independent of one another and of the rest of the table; repeated rows have results of their own; extra columns are dropped. One pass, no shuffle.
    """
    require(docs, "doc_id", "text")
    model = model or fit(docs.sparkSession)
    t = whole(F.col("text"))

    def chosen(o: Column) -> Column:
        least = reduce(lambda a, k: F.when(o["order"] == k, F.lit(model.thresholds[k])).otherwise(a), model.thresholds, F.lit(float("inf")))
        return model.column(o["x"]) >= least

    more = F.transform(F.filter(candidates(t), chosen), lambda o: F.struct(o["start"].alias("start"), o["order"].alias("order"), o["end"].alias("end"), o["kind"].alias("kind")))
    base = F.concat(*[tagged(s, k, KINDS[k]) for k, s in enumerate(base_spans(t))])
    return docs.select("doc_id", base.alias("base"), more.alias("_more")).select("doc_id", "base", F.concat("base", "_more").alias("found"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every character of a span replaced by its kind in brackets, overlapping spans as one."""
    ordered = F.sort_array(found)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
                               ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    return F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    df = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
