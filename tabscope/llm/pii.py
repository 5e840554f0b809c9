"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame functions only.

Base kinds ``email``, ``ip``, ``card`` and ``phone`` come from patterns with a
test each. They are the seeds: the words to their left and right are lexical
patterns, and so are the words around every other identifier-like token (at
least six letters or digits, four of them digits). Patterns and instances
(distinct values) form a bipartite graph that Spark scores in rounds:

* a pattern's score is the confident share of its occurrences, shrunk by
  ``shrink`` occurrences;
* an instance's confidence is 1 for seeds, else the mean score of its patterns.

Patterns with a high score and enough distinct seeds then mark their unknown
identifiers as kind ``ctx`` if the instance is confident too.

The patterns are written with possessive repeats and a look-behind (or the end
of the match before), which find the same leftmost matches in linear time.
Positions come from one fold over the pieces between matches. The graph holds
counted (pattern, instance) pairs; hot patterns and instances are joined by
``attach``. Texts are read once and never shuffled.

Edge cases: a null or empty text has no spans; a failing match is consumed; a
candidate that overlaps a base match is none; rows that repeat an id and text
get the same result; without seeds nothing is found by context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import attach, id_key, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CANDIDATE = r"(?<![A-Za-z0-9@])[A-Za-z]{0,4}[0-9](?:[A-Za-z]{0,3}[-/]?[0-9]){3,40}[A-Za-z]{0,4}(?![A-Za-z0-9@])"
MIN_SCORE = 0.8
MIN_SEEDS = 5
SHRINK = 2.0
ROUNDS = 3
_CONTEXT = 48

_SPAN = "array<struct<s:bigint,e:bigint,v:string,l:string,r:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.filter(each, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    return {"email": lambda: F.lit(True), "ip": lambda: m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"),
            "card": lambda: F.when(n.between(13, 19), luhn(digits)).otherwise(False), "phone": lambda: n.between(9, 15), "id": lambda: n >= 4}[kind]()


def _left(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(piece, F.lit(_CONTEXT)), r"(\S+)\s*$", 1))


def _right(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(piece, F.lit(_CONTEXT)), r"^\s*(\S+)", 1))


def matches(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """Spans (s, e, v, l, r) of the valid matches: start, end, value, word to the left and to the right."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.lit(0).cast("bigint")

    def fold(x: Column) -> Column:
        start = F.struct(zero.alias("at"), zero.alias("i"), F.array().cast(_SPAN).alias("out"))

        def step(a: Column, m: Column) -> Column:
            before = F.get(x["p"], a["i"].cast("int"))
            s = a["at"] + F.char_length(before)
            e = s + F.char_length(m)
            one = F.struct(s.alias("s"), e.alias("e"), m.alias("v"), _left(before).alias("l"), _right(F.get(x["p"], a["i"].cast("int") + 1)).alias("r"))
            return F.struct(e.alias("at"), (a["i"] + 1).alias("i"), F.when(_valid(kind, m), F.concat(a["out"], F.array(one).cast(_SPAN))).otherwise(a["out"]).alias("out"))
        return F.aggregate(x["m"], start, step, lambda a: a["out"])

    # a one-element array names the pieces, which the fold uses several times
    both = F.transform(F.array(F.struct(pieces.alias("p"), found.alias("m"))), fold)[0]
    return F.when(when, both).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, cand): span arrays per row."""
    t = F.coalesce("text", F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), t.alias("t"))
    df = df.withColumn("digit", F.col("t").rlike("[0-9]"))
    for kind in KINDS:
        need = F.col("digit") if kind != "email" else F.lit(True)
        if NEEDS[kind]:
            need = need & F.contains("t", F.lit(NEEDS[kind]))
        df = df.withColumn(kind, matches(F.col("t"), PATTERNS[kind], kind, need))
    df = df.withColumn("cand", matches(F.col("t"), CANDIDATE, "id", F.col("digit")))
    # candidates that overlap no base match
    known = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS])
    df = df.withColumn("known", known)
    free = F.filter("cand", lambda c: ~F.exists("known", lambda k: (k["s"] < c["e"]) & (c["s"] < k["e"])))
    return df.select("doc_id", "text_hash", *KINDS, free.alias("cand"))


def contextual_spans(base: DataFrame, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS, shrink: float = SHRINK,
                     rounds: int = ROUNDS) -> DataFrame:
    """(id, text_hash, s, e) of identifiers that high-confidence patterns discover."""
    tagged = F.concat(*[F.transform(k, lambda x: F.struct(F.lit(True).alias("seed"), x.alias("x"))) for k in KINDS],
                      F.transform("cand", lambda x: F.struct(F.lit(False).alias("seed"), x.alias("x"))))
    occ = base.select(id_key().alias("id"), "text_hash", F.explode(tagged).alias("o")).select("id", "text_hash", "o.seed", "o.x.*").distinct()
    empty = F.lit("")
    contexts = F.array(F.when(F.col("l") != empty, F.concat(F.lit("L "), "l")), F.when(F.col("r") != empty, F.concat(F.lit("R "), "r")),
                       F.when((F.col("l") != empty) & (F.col("r") != empty), F.concat(F.lit("B "), "l", F.lit(" "), "r")))
    occ = occ.withColumn("i", F.xxhash64(F.regexp_replace(F.lower("v"), r"[^a-z0-9@.]", "")))
    occ = occ.select("id", "text_hash", "seed", "s", "e", "i", F.explode(F.array_compact(contexts)).alias("p"))
    occ = materialise(occ.withColumn("p", F.xxhash64("p")))
    edges = materialise(occ.groupBy("p", "i").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    inst = materialise(edges.groupBy("i").agg(F.max("seed").cast("double").alias("conf"), F.max("seed").alias("known"), F.count("*").alias("w")))
    pats = None
    for _ in range(rounds):
        scored = attach(edges.select("p", "i", "n"), inst, ["i"], "w")
        pats = scored.groupBy("p").agg((F.sum(F.col("conf") * F.col("n")) / (F.sum("n") + F.lit(shrink))).alias("score"),
                                       F.sum(F.col("known").cast("long")).alias("seeds"), F.count("*").alias("w"))
        pats = materialise(pats)
        seen = attach(edges.select("p", "i", "n", "seed"), pats.select("p", "score", "w"), ["p"], "w")
        inst = seen.groupBy("i").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), F.max("seed").alias("known"), F.count("*").alias("w"))
        inst = materialise(inst.select("i", F.when(F.col("known"), 1.0).otherwise(F.col("mean")).alias("conf"), "known", "w"))
    unknown = occ.filter(~F.col("seed"))
    counts = unknown.groupBy("p").agg(F.count("*").alias("k"))
    good = materialise(pats.filter((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("p").join(counts, "p"))
    hits = materialise(attach(unknown, good, ["p"], "k"))
    sure = inst.filter(F.col("conf") >= min_score / 2).select("i").join(hits.groupBy("i").agg(F.count("*").alias("k2")), "i")
    return attach(hits, materialise(sure), ["i"], "k2").select("id", "text_hash", "s", "e").distinct()


def find_personal_data(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_ctx, base_sha256, spans) per row."""
    base = materialise(base_spans(docs))
    ctx = contextual_spans(base, **limits).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("ctx"))

    def text_of(kind: str, spans: str) -> Column:
        return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    out = base.drop("cand").withColumn("id", id_key()).join(ctx, ["id", "text_hash"], "left")
    out = out.withColumn("ctx", F.coalesce("ctx", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    known = F.concat(*[text_of(k, k) for k in KINDS])
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "ctx")],
                      F.sha2(F.array_join(known, ","), 256).alias("base_sha256"),
                      F.array_join(F.concat(known, text_of("ctx", "ctx")), ",").alias("spans"))
