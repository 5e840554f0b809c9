"""Quality rules: fixed base rules and distribution divergence, in DataFrame functions only.

Base features of a text: words, symbols, repeated lines and words inside
repeated 3-word windows. The divergence verdict compares two histograms of the
document with the reference of its language, counted over the whole corpus:

* character classes (letters, capitals, digits, space, punctuation, symbols);
* common words: the most frequent words of the language, of any length, that
  together make up ``common_share`` of its words (``max_common`` at most), and
  one class for all other words.

The distance is the Jensen-Shannon distance (base 2, 0 to 1). The limit of the
word distance is a share of the distance at which a text without any common
word lies from the reference, so such a text always fails. A histogram of a
short text says little, so each test has a minimum length; below it the test
passes. Where the listed words cover less than ``common_share`` (a language not
written with spaces), the word test needs a text longer by as much.

Edge cases: a null text has no words (base rules fail it); a null ``lang`` is a
language of its own; a language whose reference comes from few documents is
judged by it all the same; rows repeating an id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import WS_CHARS, attach, id_key, materialise, packed

#: Character classes counted by pattern; white space is counted by length, all else counts as letters.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "symbol": r"[#*$%&|<>]", "punct": r"[.,;:!?'\"()\[\]{}/\\-]"}
#: The common words are the fewest that make up this share of a language's words, and no more than MAX_COMMON.
COMMON_SHARE = 0.2
MAX_COMMON = 256
MIN_CHARS = 200
MIN_WORDS = 40
MAX_CHAR_DISTANCE = 0.3
#: Share of the distance of a text without common words.
MAX_WORD_DISTANCE = 0.9

_POS_BITS = 20


def spaced(text: Column) -> Column:
    """White space as plain spaces: the split below then runs without a regex."""
    for c in WS_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Words split at white space; no empty ones."""
    return F.array_remove(F.split(spaced(text), " "), "")


def _covered(pos: Column) -> Column:
    """Words covered by 3-word windows at the sorted positions ``pos``."""
    return F.aggregate(pos, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(
        (p + 3).alias("end"), (a["n"] + F.least(F.lit(3).cast("long"), p + 3 - a["end"])).alias("n")), lambda a: a["n"])


def add_base(df: DataFrame) -> DataFrame:
    """Adds the base features, words ``__w`` and class counts ``__c`` to rows with ``text``."""
    text = F.col("__t")
    mask = (1 << _POS_BITS) - 1
    high = F.lit(~mask)
    zero = F.lit(0)

    def window(p: Column) -> list[Column]:
        return [F.get("__w", p + k) for k in range(3)]

    def pos(j: Column) -> Column:
        return F.get("__s", j).bitwiseAND(F.lit(mask)).cast("int")

    def same_high(j: Column) -> Column:
        return F.get("__s", j).bitwiseAND(high) == F.get("__s", j + 1).bitwiseAND(high)

    def same_words(j: Column) -> Column:
        a, b = window(pos(j)), window(pos(j + 1))
        return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])

    # windows by their words themselves, for the rare text where hash bits clash or positions need more bits
    exact = F.sort_array(F.transform(F.sequence(zero, F.size("__w") - 3), lambda i: F.struct(F.array(*window(i)).alias("g"), i.alias("p"))))
    exact_j = F.filter(F.sequence(zero, F.size("__x") - 2), lambda j: F.get("__x", j)["g"] == F.get("__x", j + 1)["g"])
    exact_pos = F.array_distinct(F.concat(F.transform("__xj", lambda j: F.get("__x", j)["p"]), F.transform("__xj", lambda j: F.get("__x", j + 1)["p"])))
    quick_pos = F.array_distinct(F.concat(F.transform("__j", pos), F.transform("__j", lambda j: pos(j + 1))))

    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    none = F.array().cast("array<int>")
    df = (df.withColumn("__t", F.coalesce("text", F.lit("")))
          .withColumn("__w", words_of(text)).withColumn("n_words", F.size("__w").cast("long"))
          .withColumn("__lines", lines)
          .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
          .withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
          .withColumn("__c", class_counts(text, F.col("word_chars")))
          .withColumn("n_symbols", F.col("__c")[2 + list(CLASSES).index("symbol")])
          # hash bits of a window and its position share one long, so that a plain sort of longs brings equals together
          .withColumn("__s", F.transform(F.slice(F.col("__w"), 1, F.greatest(F.size("__w") - 2, zero)), lambda x, i: F.xxhash64(
              x, F.get("__w", i + 1), F.get("__w", i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
          .withColumn("__s", F.sort_array("__s"))
          .withColumn("__j", F.when(F.size("__s") >= 2, F.filter(F.sequence(zero, F.size("__s") - 2), lambda j: F.get("__s", j).bitwiseXOR(
              F.get("__s", j + 1)) < F.lit(1 << _POS_BITS))).otherwise(none))
          .withColumn("__j", F.filter("__j", same_high))
          .withColumn("__clash", (F.size("__s") > mask) | F.exists("__j", lambda j: ~same_words(j)))
          .withColumn("__x", F.when(F.col("__clash"), exact))
          .withColumn("__xj", F.when(F.col("__clash"), exact_j))
          .withColumn("__p", F.when(F.col("__clash"), exact_pos).when(F.size("__j") > 0, quick_pos).otherwise(none))
          .withColumn("n_repeat_words", _covered(F.sort_array(F.col("__p").cast("array<bigint>")))))
    return df.drop("__lines", "__s", "__j", "__clash", "__x", "__xj", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def class_counts(text: Column, word_chars: Column) -> Column:
    """Letters and all else, white space, then the classes in order (longs)."""
    counts = F.array(*[F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()])
    n = F.char_length(text).cast("long") - word_chars
    # the one-element array names the counts for several uses
    return F.transform(F.array(counts), lambda c: F.concat(F.array(
        word_chars - sum((c[i] for i in range(1, len(CLASSES))), c[0]), n), c))[0]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance of two count arrays with their totals (base 2); null if either is empty."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(x: Column, y: Column) -> Column:
        return part(x, (x + y) / 2) + part(y, (x + y) / 2)

    jsd = _total(F.zip_with(p, q, lambda x, y: both(x / p_total, y / q_total))) / 2
    return F.when((p_total > 0) & (q_total > 0), F.sqrt(F.greatest(jsd, F.lit(0.0))))


def _lang_key() -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def common_words(docs: DataFrame, share: float = COMMON_SHARE, max_common: int = MAX_COMMON) -> DataFrame:
    """(lk, common, ref_words) per language, counted over all documents; common holds hashes, ref_words starts with all other words."""
    x = docs.select(_lang_key().alias("lk"), F.explode(word_hashes(words_of(F.coalesce("text", F.lit(""))))).alias("w"))
    w = materialise(x.groupBy("lk", "w").agg(F.count("*").alias("n")))
    totals = w.groupBy("lk").agg(F.sum("n").alias("words"))
    # per language the first max_common words: best of each hash part first, so that no task ranks a whole vocabulary
    rank = [F.desc("n"), F.asc("w")]
    whole = Window.partitionBy("lk").orderBy(*rank)
    best = (w.select("lk", "w", "n", F.pmod("w", F.lit(64)).alias("part"))
            .withColumn("r", F.row_number().over(Window.partitionBy("lk", "part").orderBy(*rank))).filter(F.col("r") <= max_common)
            .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= max_common)
            .withColumn("before", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1))))
    best = best.join(totals, "lk").filter(F.coalesce("before", F.lit(0)) < share * F.col("words"))
    common = best.groupBy("lk").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("b"))
    listed = F.coalesce(F.transform("b", lambda x: x["n"].cast("double")), F.array().cast("array<double>"))
    return totals.join(common, "lk", "left").select(
        "lk", F.coalesce(F.transform("b", lambda x: x["w"]), F.array().cast("array<bigint>")).alias("common"),
        F.concat(F.array(F.col("words") - _total(listed)), listed).alias("ref_words"))


def quality_features(docs: DataFrame, common_share: float = COMMON_SHARE, max_common: int = MAX_COMMON) -> DataFrame:
    """One slim row per document: id, text hash, base features and both histograms with their references."""
    counts = docs.groupBy(_lang_key().alias("lk")).agg(F.count("*").alias("n_docs"))
    refs = materialise(counts.join(common_words(docs, common_share, max_common), "lk", "left").select(
        "lk", "n_docs", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"),
        F.coalesce("ref_words", F.array(F.lit(0.0))).alias("ref_words")))
    df = attach(docs.select("doc_id", "text", _lang_key().alias("lk")), refs.select("lk", "n_docs", "common"), ["lk"], "n_docs")
    df = add_base(df).withColumn("__cw", F.filter(word_hashes(F.col("__w")), lambda x: F.array_contains(F.col("common"), x)))
    df = df.withColumn("words", F.concat(F.array((F.size("__w") - F.size("__cw")).cast("double")), F.transform(
        "common", lambda c: F.size(F.filter("__cw", lambda x: x == c)).cast("double"))))
    slim = materialise(df.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.char_length("__t").alias("chars"), "lk", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "words", F.transform("__c", lambda x: x.cast("double")).alias("classes")))
    k = len(CLASSES) + 2
    per = slim.groupBy("lk").agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(k)]).alias("ref_classes"))
    none = F.transform("ref_words", lambda _, i: F.when(i == 0, F.lit(1.0)).otherwise(0.0))
    refs = refs.withColumn("ref_words_n", _total(F.col("ref_words")))
    refs = refs.withColumn("none_distance", js_distance(none, F.col("ref_words"), F.lit(1.0), F.col("ref_words_n")))
    refs = materialise(refs.join(per, "lk").drop("common"))
    return attach(slim, refs, ["lk"], "n_docs")


def quality_rules(docs: DataFrame, common_share: float = COMMON_SHARE, max_common: int = MAX_COMMON, min_chars: int = MIN_CHARS,
                  min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, text_hash)."""
    df = quality_features(docs, common_share, max_common)
    for name in ("classes", "words", "ref_classes"):
        df = df.withColumn(f"{name}_n", _total(F.col(name)))
    df = df.withColumn("char_distance", js_distance(*map(F.col, ("classes", "ref_classes", "classes_n", "ref_classes_n"))))
    df = df.withColumn("word_distance", js_distance(*map(F.col, ("words", "ref_words", "words_n", "ref_words_n"))))
    # as many common words expected as min_words words hold at the full share
    expected = F.col("n_words") * (F.col("ref_words_n") - F.col("ref_words")[0]) >= min_words * common_share * F.col("ref_words_n")
    odd = (((F.col("chars") >= min_chars) & (F.coalesce("char_distance", F.lit(0.0)) > max_char))
           | ((F.col("n_words") >= min_words) & expected
              & F.coalesce(F.col("word_distance") > max_word * F.col("none_distance"), F.lit(False))))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance", "text_hash")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that ``quality_rules`` keeps, all columns; documents are met by id and text hash.

    The slim side of the join is hashed, so that whole documents are never sorted in memory.
    """
    good = quality_rules(docs, **limits).filter("kept").select(id_key().alias("id"), "text_hash").distinct()
    return (docs.select(id_key().alias("id"), F.xxhash64("text").alias("text_hash"), packed(docs))
            .join(good.hint("shuffle_hash"), ["id", "text_hash"], "left_semi").select("row.*"))
