"""The pipeline and each of its stages against plain versions, on given and odd documents."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from muster.llm import line_spread, packing
from muster.llm.common import table, written
from test_operators import LONG, ODD, SCHEMA, plain_components, plain_lines, plain_spans

NAMES = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
SPREAD = "a line that stands on very many sites"


@pytest.fixture(scope="module")
def source(spark, folder, tmp_path_factory):
    """A folder whose documents are some given ones, odd ones, boilerplate, near copies and personal data."""
    rows = [tuple(r) for r in table(spark, folder, "documents").orderBy("doc_id").limit(90).collect()]
    words = " ".join(f"w{i}" for i in range(80))
    rows += [(i if i is None else i + 5000, *rest) for i, *rest in ODD]
    rows += [(6000 + i, f"{SPREAD}\nown line number {i} of this very document", "en", f"site{i}", None) for i in range(line_spread.MIN_SITES + 2)]
    rows += [(6100 + i, SPREAD, "en", f"site{i}", 1) for i in range(3)]
    rows += [(7000, words, "en", "a", 1), (7001, words + " end", "en", "b", 1), (None, words + " no id", "en", "c", 1), (None, "alone " + LONG[:300], None, None, 1)]
    rows += [(8000, "write to some.one@example.org or call +1 202 555 0143 today please", "en", "a", 1), (8000, "write to some.one@example.org or call +1 202 555 0143 today please", "en", "a", 1)]
    rows += [(9000, None, "en", "a", 1), (9001, "1 2 3", "en", "a", 1), (None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def collected(df):
    assert df.columns == NAMES
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_every_stage_and_the_whole(spark, source):
    docs = table(spark, source, "documents")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name: written(stages[name](spark, docs, source), "step")
    rows = collected(docs)

    docs = step("language ID")
    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert ordered(collected(docs)) == ordered(want) and len(want) < len(rows)

    rows, docs = want, step("line dedup")
    cut = collections.Counter((i, text) for i, text, _, gone in plain_lines(rows, line_spread.MIN_SITES) if not gone or re.search(r"[^\x20\x09-\x0D]", text))
    got = collected(docs)
    assert collections.Counter((r[0], r[1]) for r in got) == cut
    assert all(r[4] == len(r[1]) for r in got) and sum(SPREAD in r[1].split("\n") for r in got) == 1

    rows, docs = got, step("n-gram Jaccard join")
    got = collected(docs)
    group = collections.Counter(c for _, _, c in plain_components(rows))
    # One row of each group, the one that names it; groups without an id keep one of theirs.
    named = [r for r in got if r[0] is not None]
    assert {r[0] for r in named} == {c for c in group if c is not None} and len(named) == len({r[0] for r in named})
    nameless = [r for r in rows if r[0] is None]
    assert set(got) <= set(rows) and sum(r[0] is None for r in got) == len({r[1] for r in nameless} - {t for t in (r[1] for r in nameless) if t.endswith(" no id")})

    rows, docs = got, step("PII")
    got = collected(docs)
    assert len(got) == len(rows) and not any(plain_spans(r[1]) for r in got)
    same = collections.Counter((r[0], r[1]) for r in rows if not plain_spans(r[1]))
    assert not same - collections.Counter((r[0], r[1]) for r in got)

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    tokens = collections.Counter()
    for r in got:
        tokens[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    pieces = [r.asDict() for r in stages["packing"](spark, docs, source).collect()]
    packed = collections.Counter()
    for p in pieces:
        packed[p["doc_id"]] += p["length"]
    assert packed == tokens

    # The whole: the same tokens of the same documents, sequences without gaps.
    whole = [r.asDict() for r in corpus_pipeline.run(spark, source).collect()]
    again = collections.Counter()
    for p in whole:
        again[p["doc_id"]] += p["length"]
    assert again == tokens
    at = collections.defaultdict(int)
    for p in sorted(whole, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]]
        at[p["sequence_id"]] += p["length"]
    assert sorted(at) == list(range(len(at))) and all(n == packing.WINDOW for i, n in at.items() if i < len(at) - 1)


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some words", None, "a", 1), (2, "123", None, "a", 1), (3, None, None, "a", 1), (None, "é", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert ordered(collected(corpus_pipeline.language_id(spark, docs, ""))) == ordered([rows[0], rows[3]])


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "some words and more of them here"), (2, "other words entirely, nothing alike")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("k") for c in ("lang", "source", "lang_pred", "score", "d", "i", "root", "key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.where("score = 'k' AND d = 'k' AND root = 'k' AND lang_pred = 'k'").count() == 2
