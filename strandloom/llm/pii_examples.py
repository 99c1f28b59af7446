"""Examples for the trees of ``pii``: personal data and look-alikes, planted behind neutral, announcing and misleading words.

Every example is a row of column expressions over its number and a seed, so the table is the same in any session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.text import luhn_sum

NEUTRAL = ["", "x ", "the ", "we saw ", "and then ", "between ", "it was, ", "there: ", "( ", "2 x ", "from ", "of "]
ANNOUNCED = ["phone: ", "call ", "tel. ", "mobile ", "fax: ", "account: ", "account number ", "iban ", "iban: ", "ssn: ", "social security number ", "id ", "passport no. ", "contact ",
             "write to ", "mail: ", "e-mail ", "bank account ", "card ", "my phone number is "]
MISLEADING = ["order no. ", "order ", "invoice ", "part number ", "part no. ", "version ", "ref: ", "reference ", "isbn ", "item ", "page ", "serial no. ", "ticket ", "batch ", "score "]
AFTER = ["", " y", ".", ", and so on", " was there", ")"]
NAMES = ["bob", "ann.lee", "j_smith", "info", "maria99", "k.o", "sales-team", "tom"]
HOSTS = ["example", "mail", "acme-corp", "uni", "blue4", "post"]
ENDINGS = ["com", "org", "net", "de", "co", "fr", "io", "edu"]
WORDS = ["look", "of", "good", "arrive", "meet", "stay", "laugh", "end"]
PLACES = ["home", "and", "night", "noon", "once", "work", "least", "them"]
STARTS = ["The", "We", "It", "Then", "And", "She", "Later", "But"]


def examples(spark: SparkSession, n: int, seed: int = 61) -> DataFrame:
    """(id, text, order, start, end, y, part): ``n`` texts with one planted entity each, its generator's place in KINDS, its place, its label.

    Half are positive. An entity passes the check of its kind or fails it: positive ones that pass stand anywhere but behind misleading words,
    those that fail behind announcing words only. Negative ones that pass stand behind misleading words, those that fail behind neutral or misleading
    ones; dates and words around "at" also behind announcing ones. ``part`` (0 to 4) splits the table.
    """
    def pick(salt: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(m))

    def digits(salt: int, k: int) -> Column:
        return F.lpad(pick(salt, 10 ** k).cast("string"), k, "0")

    def one_of(salt: int, options: list) -> Column:
        if not isinstance(options[0], Column):
            return F.element_at(F.array(*[F.lit(o) for o in options]), (pick(salt, len(options)) + 1).cast("int"))
        return reduce(lambda a, k: F.when(pick(salt, len(options)) == k, options[k]).otherwise(a), range(len(options) - 1), options[-1])

    sep = one_of(1, [" ", ".", "-"])
    area, exchange = (200 + pick(2, 800)).cast("string"), (200 + pick(3, 800)).cast("string")
    phones = one_of(4, [F.concat(area, sep, exchange, sep, digits(5, 4)), F.concat(F.lit("("), area, F.lit(") "), exchange, F.lit("-"), digits(5, 4)),
                        F.concat(F.lit("0"), (1 + pick(6, 9)).cast("string"), digits(7, 1), sep, digits(8, 4), sep, digits(5, 4))])
    odd_phones = one_of(9, [F.concat(digits(10, 2), sep, digits(11, 3), sep, digits(12, 3)), F.concat(digits(10, 3), sep, digits(11, 2), sep, digits(12, 3)),
                            F.concat(digits(10, 2), sep, digits(11, 4), sep, digits(12, 4))])
    day, month, year = F.lpad((1 + pick(13, 28)).cast("string"), 2, "0"), F.lpad((1 + pick(14, 12)).cast("string"), 2, "0"), (1900 + pick(15, 130)).cast("string")
    dates = one_of(16, [F.concat(day, sep, month, sep, year), F.concat(year, F.lit("-"), month, F.lit("-"), day), F.concat(day, F.lit("."), month, F.lit("."), year, F.lit(" "), digits(17, 2))])

    name, host, ending = one_of(18, NAMES), one_of(19, HOSTS), one_of(20, ENDINGS)
    spelt = one_of(21, [F.concat(name, F.lit(" at "), host, F.lit(" dot "), ending), F.concat(name, F.lit(" (at) "), host, F.lit("."), ending), F.concat(name, F.lit("[at]"), host, F.lit("[dot]"), ending),
                        F.concat(name, F.lit(" [at] "), host, F.lit(" (dot) "), ending)])
    half_spelt = F.concat(name, F.lit(" at "), host, F.lit("."), ending)
    talk = F.concat(one_of(22, WORDS), F.lit(" at "), one_of(23, PLACES), F.lit(". "), one_of(24, STARTS))

    # country, letters before the digits, their numbers, the country's numbers
    country = one_of(25, [F.struct(F.lit(c).alias("c"), F.lit(b).alias("b"), F.lit(v).alias("v"), F.lit(k).alias("k")) for c, b, v, k in
                          (("DE", "", "", "1314"), ("ES", "", "", "1428"), ("FR", "", "", "1527"), ("GB", "WEST", "32142829", "1611"), ("IE", "AIBK", "10181120", "1814"))])
    body = F.concat(digits(26, 8), digits(27, 8))
    rest = (98 - F.concat(country["v"], body, country["k"], F.lit("00")).cast("decimal(38,0)") % 97).cast("int")
    shown = lambda check: F.concat(country["c"], F.lpad(check.cast("string"), 2, "0"), country["b"], body)
    spaced = lambda s: F.when(pick(28, 2) == 0, s).otherwise(F.regexp_replace(s, "(.{4})(?=.)", "$1 "))
    iban, bad_iban = spaced(shown(rest)), spaced(shown((rest + pick(29, 95)) % 97 + 1))
    code = F.concat(one_of(30, ["AB", "QX", "LT", "KM"]), digits(31, 2), F.lit(" "), one_of(32, ["CDEF", "12B4", "X900", "7777"]), F.lit(" "), digits(33, 4))

    first = (1 + pick(34, 898)).cast("int")
    number = lambda a: F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((1 + pick(35, 99)).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + pick(36, 9999)).cast("string"), 4, "0"))
    national = number(F.when(first == 666, 665).otherwise(first))
    no_national = one_of(37, [number(F.lit(0)), number(F.lit(666)), number(900 + pick(38, 100)), F.concat(digits(39, 3), F.lit("-00-"), digits(40, 4)), F.concat(digits(39, 3), F.lit("-"), digits(41, 2), F.lit("-0000"))])

    stem = F.concat(F.lit("4"), digits(42, 11))
    fits = (10 - luhn_sum(F.concat(stem, F.lit("0"))) % 10) % 10
    card = F.concat(stem, fits.cast("string"))
    plain = one_of(43, [F.concat(F.lit("1"), digits(44, 8)), digits(45, 9), digits(46, 10), F.concat(F.lit("7"), digits(47, 11)), F.concat(stem, ((fits + 1 + pick(48, 9)) % 10).cast("string"))])

    #: by generator in the order of GENERATORS: entities that pass the check, positive ones that fail it, negative ones that fail it, negative ones behind any words
    kinds = [(phones, odd_phones, odd_phones, dates), (spelt, half_spelt, talk, talk), (iban, bad_iban, bad_iban, code), (national, no_national, no_national, no_national),
             (card, plain, plain, plain)]
    lure = [True, True, False, False, False]
    plans = [(k, *case) for k, (good, weak, bad, never) in enumerate(kinds) for case in (
        (1, good, NEUTRAL), (1, good, NEUTRAL), (1, good, ANNOUNCED), (1, weak, ANNOUNCED), (0, bad, NEUTRAL), (0, good, MISLEADING), (0, bad, MISLEADING), (0, never, ANNOUNCED if lure[k] else NEUTRAL))]
    case = F.col("case")

    def chosen(j: int) -> Column:
        """Entry j of the row's plan; equal neighbours in the list are one branch, and only the row's branch is computed."""
        out, last = None, None
        for i in reversed(range(len(plans))):
            if last is None or plans[i][j] is not last:
                last, value = plans[i][j], plans[i][j]
                value = one_of(49 + i, value) if isinstance(value, list) else value if isinstance(value, Column) else F.lit(value)
                out = value if out is None else F.when(case <= i, value).otherwise(out)
        return out

    df = spark.range(n).withColumn("case", pick(57, len(plans)))
    df = df.select("id", (chosen(0) + 4).alias("order"), chosen(1).alias("y"), chosen(2).alias("entity"), chosen(3).alias("lead"), one_of(97, AFTER).alias("tail"), pick(98, 5).alias("part"))
    return df.select("id", F.concat("lead", "entity", "tail").alias("text"), "order", F.length("lead").alias("start"), F.length(F.concat("lead", "entity")).alias("end"), "y", "part")


def labelled(rows: DataFrame, c: Column) -> DataFrame:
    """``rows`` of examples with one candidate (c) each: y stays 1 where the candidate is of the planted kind and overlaps the planted entity."""
    return rows.withColumn("y", F.when((c["order"] == F.col("order")) & (c["start"] < F.col("end")) & (F.col("start") < c["end"]), F.col("y")).otherwise(0))
