"""Details of earlier operators: ties, walks of trees, measurements, edits, empty tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagwise.llm.boosting import fit
from lagwise.llm.exact_dedup import digests, drop_copies, tree_merge, with_groups
from lagwise.llm.mixing import mixed_documents
from lagwise.llm.quality_classifier import classify
from lagwise.llm.quality_rules import keep_good
from lagwise.llm.simhash import keep_one
from lagwise.llm.textstats import measured
from lagwise.llm.token_counts import Encoder, SegmentTree, apply_edits, count_edited, sample_edits, with_trees
from lagwise.llm.url_filter import filter_pages, match_urls, word_rule

TEXTS = [
    None, "", "Hello, World. YES NO no!", "a b a b a b", "Ünï ÇÖDE ok?", "\x01x\x7f 12 #tag $5", "line\nline\n\nLine\nline",
    "x" * 25 + " " + "é" * 13 + " short", "ABC abc Abc AB", "(one) [two]; three:four", "tail \t\x0b\x0c\r",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_measurements_that_only_the_classifier_reads(docs):
    got = {r.doc_id: r.m for r in docs.select("doc_id", measured(F.col("text")).alias("m")).collect()}
    for i, text in enumerate(TEXTS):
        t, m = text or "", got[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert m.n_upper == len(re.findall("[A-Z]", t)) and m.n_ends == len(re.findall("[.!?]", t))
        assert m.n_punct == sum(33 <= ord(c) < 127 and not c.isalnum() and c not in "#*$%&|<>.!?" for c in t)
        assert m.n_long_words == sum(len(x.encode()) > 24 for x in w) and m.n_distinct == len(set(w))
        assert m.n_first_lower == sum("a" <= x[0] <= "z" for x in w)
        assert m.n_upper_words == sum(len(re.findall("[A-Z]", x)) > 1 and not re.search("[a-z]", x) for x in w)
        assert m.n_rare_bytes == len(re.findall("[\x00-\x08\x0e-\x1f\x7f]", t))


def test_scores_equal_a_plain_walk_of_the_trees():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)).round(1)  # ties at the thresholds
    trees = fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, got in zip(x, trees.score(x)):
        margin = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-12)


def test_classifier_takes_long_texts_and_clashing_columns(spark):
    rows = [(i, "plain words in order " * (1 + i % 9), 1, 2, "s") for i in range(40)] + [(99, "w " * 400_000, 1, 2, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int, n_words int, _m string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = classify(table, labels).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)


def test_equal_url_rules_and_long_urls(spark):
    long = "http://a.net/" + "x/" * 60_000 + "crack"
    pages = spark.createDataFrame([(0, "http://h/aa/zz"), (1, "http://a.net/track/crack"), (2, long), (3, "http://poker-pills.net")], "page_id long, url string")
    rules = [word_rule("zz"), word_rule("aa", "allow")]
    for order in (rules, rules[::-1]):
        assert match_urls(pages.where("page_id = 0"), order).first()[2:] == ("*aa*", "allow")
    got = {r.page_id: (r.pattern_rule, r.verdict) for r in filter_pages(pages).collect()}
    assert got[1] == ("*crack*", "block") and got[2] == ("*crack*", "block") and got[3] == ("*pills*", "block")


def test_hot_digests_are_joined_apart(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "case when id % 3 = 0 then null else cast(id % 90 as string) end as text")
    stored = digests(rows)
    merged = tree_merge(stored, "largest")
    plain = {(r.doc_id, r.keep_id, r.group_size) for r in stored.join(merged, ["text_sha256", "_check", "_length"]).collect()}
    for hot in (0, 5, 100, 1000):
        got = with_groups(stored, merged, hot, listed=10_000).collect()
        assert len(got) == 500 and {(r.doc_id, r.keep_id, r.group_size) for r in got} == plain


def test_the_row_that_stays_does_not_hang_on_their_order(spark):
    rows = [(1, "Same", "b", 2), (1, "same", "a", 9), (1, "same", "a", 3), (2, "x", None, 0), (2, "x", None, 0)]
    kept = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumn("more", F.create_map("source", "n") if seed < 0 else F.lit(1))
        kept.add(frozenset(tuple(r) for r in drop_copies(table.repartition(3), keep="largest").collect()))
        assert mixed_documents(table, weights=(1,)).count() >= 0
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_empty_tables(spark, docs, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (keep_good, keep_one, mixed_documents, drop_copies):
        made = stage(none)
        assert made.columns == none.columns and made.count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def bpe():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def test_counts_after_the_edits_of_the_query(spark, bpe):
    count, r = Encoder.shared(*bpe).count, random.Random(8)
    texts = [None, "", "one", "word " * 900, "日本語の文章" * 200] + ["".join(r.choice("ab c\n,") for _ in range(r.randrange(900))) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n_chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edits = {x.doc_id: x.e for x in table.select("doc_id", sample_edits(n_chars, F.col("doc_id")).alias("e")).collect()}
    for row in count_edited(table, *bpe).collect():
        text = texts[row.doc_id] or ""
        tree = SegmentTree.build(text, count)
        for e in edits[row.doc_id]:
            tree.edit(e["start"], e["length"], e["insert"], count)
            a = min(max(e["start"], 0), len(text))
            text = text[:a] + e["insert"] + text[a + e["length"] :]
        assert row.n_tokens_edited == count(text) and row.n_edits == 3 and row.reencoded_chars == tree.reencoded


def test_only_documents_with_edits_are_rewritten(spark, bpe):
    count = Encoder.shared(*bpe).count
    texts = ["alpha beta " * 40, "gamma", "delta", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edits = [(0, i, 0, 0, f"n{i} ") for i in range(10)] + [(1, 0, 0, 5, "new"), (None, 0, 0, 0, "x"), (77, 0, 0, 0, "x")]
    frame = spark.createDataFrame(edits, "doc_id long, seq long, start long, length long, insert string")
    got = {r.doc_id: r for r in apply_edits(with_trees(table, *bpe), frame, *bpe, per_round=4).collect()}
    first = "".join(f"n{i} " for i in reversed(range(10))) + texts[0]
    assert [got[i].text for i in range(4)] == [first, "new", "delta", None]
    assert got[0].tree.tokens[1] == count(first) and len(got) == 4
    untouched = apply_edits(with_trees(table, *bpe), frame.limit(0), *bpe)
    assert untouched.count() == 4


def test_index_levels_and_spread_of_documents(spark):
    from lagwise.llm import substring_dedup as D

    assert D.spans(200) == [1] and D.spans(257) == [256, 1] and D.spans(70_000) == [65536, 256, 1]
    ids = np.arange(2000, dtype=np.int64) * 1000
    parts = np.bincount(D._dealt(ids, 8), minlength=8)
    assert parts.min() > 150 and parts.max() < 400
    told = spark.createDataFrame([(int(i),) for i in [*ids[:50], -7, 2**62, D.NO_ID]], "i long").select("i", D._dealt_column(F.col("i"), 13).alias("p"))
    for r in told.collect():
        assert r.p == D._dealt(np.array([r.i]), 13)[0]
    r = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1000 * i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(80))) + (" " + shared if i % 3 == 0 else "")) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [sorted((x.doc_id, x.n_removed, x.kept_sha256) for x in D.substring_dedup(table, part=700, routes=k).collect()) for k in (256, 3)]
    assert got[0] == got[1] and sum(n for _, n, _ in got[0]) > 1000
    sizes = []
    for n in (60, 120):
        docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(n)], "doc_id long, text string")
        blocks = n
        first = docs.repartition(n // 10).mapInArrow(lambda it, b=blocks: D._index_rows(it, b, D.spans(b, 8)[0], 20, 3000), "block int, places binary, keys binary, known binary")
        sizes.append(first.count())
    assert sizes[1] <= 2.2 * sizes[0]
