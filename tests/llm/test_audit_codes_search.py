"""Filter audit, token files and lexical search against brute force on small rows."""

import math
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BIG = 2 ** 63 - 1


def many_rows():
    """The shared edge cases, copies under falling and rising ids, and a hot text on a third of the rows."""
    rows = rows_of() + [(100 + i, "One hot text, " * 30, "de", "s", 0, "c", "c", "c") for i in range(20)]
    rows += [(None, None, None, None, 0, "c", "c", "c")] * 3 + [(3, "", "fr", "s", 0, "c", "c", "c")]
    return rows + [(200 - i, f"SHOUT {i % 3} # text of capitals " + "WORD " * 210, "en", "s", 0, "c", "c", "c") for i in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(many_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- filter audit ----------------------------------------------------------

def fails_of(rows):
    first = {}
    for r in rows:
        i, t = BIG if r[0] is None else r[0], r[1] or ""
        first[t] = min(first.get(t, BIG), i)
    out = []
    for r in rows:
        i, t = BIG if r[0] is None else r[0], r[1] or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if i > first[t] else set()
        out.append((r[0], r[2] or "", bad))
    return out


def audit_by_hand(rows, labels):
    marks = {}
    for i, q, x in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    per, out = {}, {}
    for i, part, bad in fails_of(rows):
        per.setdefault(part, []).append((bad, *marks.get(i, (0, 0))))
    for part, found in per.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in found) - len(gone), sum(d[0] == {f} for d in found),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


@pytest.mark.parametrize("max_bits", [24, 6])
def test_audit_matches_brute_force(spark, docs, max_bits):
    from tabscope.llm.filter_audit import document_masks, interaction_report, mask_counts
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(0))
    got = interaction_report(mask_counts(document_masks(docs, max_bits=max_bits), marks)).collect()
    want = audit_by_hand(many_rows(), labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 120 * 5 * len({p for p, _, _ in want})


def test_audit_of_empty_tables(spark, docs, empty):
    from tabscope.llm.filter_audit import filter_audit
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, marks).collect() == []
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in filter_audit(docs, marks).collect())


def test_sketch_clears_only_unique_texts(spark):
    from tabscope.llm.filter_audit import possible_repeats
    rows = spark.range(5000).select(F.xxhash64(F.when(F.col("id") < 100, F.col("id") % 40).otherwise(F.col("id"))).alias("h"))
    for bits in (24, 12):
        kept = rows.filter(possible_repeats(rows, bits)(F.col("h"))).groupBy("h").count()
        assert kept.filter("count > 1").count() == 40
        assert kept.filter("count = 1").count() < (100 if bits == 24 else 5000)


# ---- token files -------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2 ** 32 - 1)), max_size=1500), st.randoms())
def test_codes_give_every_id_and_span(ids, rng):
    from tabscope.llm.token_files import TokenFile, file_bytes
    f = TokenFile(file_bytes([1], [len(ids)], np.array(ids, np.uint32)))
    assert f.span(0, len(ids)).tolist() == ids
    for _ in range(20):
        a, b = sorted((rng.randint(0, len(ids)), rng.randint(0, len(ids))))
        assert f.span(a, b).tolist() == ids[a:b]
        if a < len(ids):
            assert f.token(a) == ids[a]
    with pytest.raises(IndexError):
        f.token(len(ids))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA .,'sSjJ̌́İΣ<|>endoftxEND\n\t ̈"))), max_size=6))
def test_word_encoder_equals_whole_text_encoding(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    from tabscope.llm.token_files import TextEncoder, WordEncoder
    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*texts, "A.<|endoftext|>b <|ENDOFTEXT|> J̌ T̈. don't, I'LL."]
    by_word, whole = WordEncoder(_TOKENIZER), TextEncoder(_TOKENIZER)
    for _ in range(2):  # the second time from the words kept
        got, want = by_word(pa.array(texts)), whole(pa.array(texts))
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_token_files_match_brute_force(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    from tabscope.llm.token_files import read_token_files, tokens_at, write_token_files
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows, stream = [], []
    write_token_files(docs, f"file://{tmp_path}/a", path, by_word=True, roll=3000, part_bytes=30_000)
    got = read_token_files(spark, f"file://{tmp_path}/a").collect()
    for i, t in sorted(((BIG if r[0] is None else r[0], r[1] or "") for r in many_rows())):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        rows.append((i, len(ids), crc32(np.array(ids, "<u4").tobytes())))
    have = sorted((r["start"], BIG if r["doc_id"] is None else r["doc_id"], r["n_tokens"], crc32(r["ids"])) for r in got)
    assert sorted((i, n, c) for _, i, n, c in have) == sorted(rows)
    assert [i for _, i, _, _ in have] == [i for i, _, _ in rows]
    assert [s for s, _, _, _ in have] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in have])])[:-1].tolist()
    for r in sorted(got, key=lambda r: r["start"]):
        stream += np.frombuffer(r["ids"], "<u4").tolist()
    ask = [0, 1, 5, 2999, 3000, 3001, len(stream) - 1, len(stream) // 2]
    asked = spark.createDataFrame([(p,) for p in [*ask, len(stream), -1, None]], "position long")
    found = {r["position"]: r["token"] for r in tokens_at(asked, f"file://{tmp_path}/a").collect()}
    assert found == {**{p: stream[p] for p in ask}, len(stream): None, -1: None, None: None}
    write_token_files(empty, f"file://{tmp_path}/b", path)
    assert read_token_files(spark, f"file://{tmp_path}/b").collect() == []


# ---- lexical search ------------------------------------------------------------

def search_by_hand(rows, queries, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r[0], Counter(TERM.findall((r[1] or "").translate(low)))) for r in rows]
    n_docs = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        q = Counter(TERM.findall((text or "").translate(low)))
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, total)
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t, x in q.items() if t in c)
            if s > 0:
                scored.append((-s, BIG if i is None else i))
        out += [(item, n, None if i == BIG else i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("owners,bundle,k", [(4, 256, 20), (3, 2, 5), (1, 256, 3)])
def test_search_matches_brute_force(spark, docs, owners, bundle, k):
    from tabscope.llm.lexical_search import lexical_search
    queries = [(1, "word7 the of and runs over LAZY dog"), (2, None), (3, "!!"), (4, "hunter2hunter2 éa a b c same line here word WORD"),
               (5, "hot text one"), (6, "absent terms only xyzzy"), (7, "word3 number 3 word3 text 7777")]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = [tuple(r) for r in lexical_search(docs, asked, k, owners, bundle).collect()]
    assert sorted(got, key=str) == sorted(search_by_hand(many_rows(), queries, k), key=str)


def test_search_of_skewed_corpora(spark, monkeypatch):
    """Rare and common terms, small blocks: pruning must not change the best documents."""
    import random
    from tabscope.llm import lexical_search as S
    monkeypatch.setattr(S, "BLOCK_DOCS", 16)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 100)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [(i % 290, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    queries = [(i, " ".join(rng.choices(words, k=30))) for i in range(12)] + [(50, rows[3][1]), (51, rows[9][1])]
    got = S.lexical_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(search_by_hand(rows, queries, 4))


def test_search_of_empty_tables(spark, docs, empty):
    from tabscope.llm.lexical_search import lexical_search
    asked = spark.createDataFrame([(1, "word7 the")], "item_id long, text string")
    assert lexical_search(empty, asked).collect() == []
    assert lexical_search(docs, asked.limit(0)).collect() == []
