"""Secret scans: Boolean trigram queries from each rule, an inverted trigram index, verification of the candidates."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser  # the syntax tree of a rule

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.runtime import cut_lineage
from strandloom.llm.text import joined, require, row_key, spans, tagged, whole

#: Alternatives that a rule may unfold to before a part of it counts as anything.
UNFOLD = 64


@dataclass(frozen=True)
class Rule:
    """A pattern in the common syntax of Java and Python; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The rules, the base ones first.
RULES = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{1,64}@"),
]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which is in full in every text that matches; None if none is mandatory.

    The pattern unfolds to alternative texts with gaps. Small classes and optional literals unfold; anything wider is a gap.
    """
    def unfold(tree) -> list[str]:
        done = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg).lower()]
            elif name == "SUBPATTERN":
                parts = unfold(arg[3])
            elif name == "BRANCH":
                parts = [p for side in arg[1] for p in unfold(side)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                parts = [chr(a).lower() for _, a in arg]
            elif name == "MAX_REPEAT":
                low, high, body = arg
                inner = unfold(body)
                parts = ["", *inner] if (low, high) == (0, 1) else ["\0"] if low == 0 else [p * low if low == high else p * low + "\0" + p for p in inner] if low <= 3 else ["\0"]
            else:
                parts = ["\0"]
            parts = list(dict.fromkeys(parts))
            if len(done) * len(parts) > UNFOLD:
                parts = ["\0"]
            done = list(dict.fromkeys(d + p for d in done for p in parts))
        return done

    out = {frozenset(run[i:i + 3] for run in text.split("\0") for i in range(len(run) - 2)) for text in unfold(_parser.parse(pattern))}
    out = {c for c in out if not any(d < c for d in out)}
    return None if frozenset() in out else sorted(out, key=sorted)


def posted(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (tri, _key) for the trigrams that the rules ask about, whatever the text's letters' case."""
    low = F.lower(whole(F.col("text")))
    listed = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), low.alias("_low")).select("_key", F.explode(listed).alias("tri"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_key, rules): rules one of whose alternatives has all its postings at the key. The table of alternatives is as large as the rules."""
    asked = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for t in sorted(c)]
    table = index.sparkSession.createDataFrame(asked, "rule string, alternative int, tri string, need int")
    met = index.distinct().join(F.broadcast(table), "tri").groupBy("_key", "rule", "alternative", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return met.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def passing(text: Column, rule: Rule, sure: Column | None) -> Column:
    found = spans(text, rule.pattern, sure)
    if rule.least > 1:
        part = lambda m: F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.filter(found, lambda s: F.length(part(s["match"])) >= rule.least)
    return found


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, found) for every row of ``docs`` (doc_id, text): found has start, order, end and kind of every secret.

    Trigram presence is posted per text, alternatives intersect their postings, and a rule's pattern runs only where it may match; rules
    without mandatory trigrams (hex) run over all texts. Candidate rules meet the texts in one join on the rows' hashed key. Null and empty texts have no
    secrets; rows that repeat id and text share their candidates; extra columns are dropped.
    """
    rules = RULES if rules is None else rules
    require(docs, "doc_id", "text")
    asked = sorted({t for r in rules for c in trigram_query(r.pattern) or [] for t in c})
    index = cut_lineage(posted(docs, asked))
    chosen = cut_lineage(candidates(index, rules))
    df = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), whole(F.col("text")).alias("_t")).join(chosen, "_key", "left")
    may = F.coalesce(F.col("_rules"), F.array().cast("array<string>"))
    found = [tagged(passing(F.col("_t"), r, None if trigram_query(r.pattern) is None else F.array_contains(may, r.kind)), k, r.kind) for k, r in enumerate(rules)]
    return df.select("doc_id", F.concat(*found).alias("found"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(joined(F.filter("found", lambda s: s["order"] < 3)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
