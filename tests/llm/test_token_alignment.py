"""Alignment against a plain version that tokenises whole texts."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import token_alignment
from muster.llm.common import table

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTER = token_alignment.byte_letters()

ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", "a ", " a", "a  b", "a\nb", "a\n b", "a \nb", "a\n\n  b\t c", "\ta b", "don't they'll I'm", "x▁y", "▁",
    "é𝄞 日本語 テキスト x", "<|endoftext|> </s> <s> <0x41> <unk>", "12 345 6.78e9 ... !!!", "a\x00b\x1c c\x1d d", "\r\n a\r\n", "word" * 3000, "a b " * 5000,
    "é ​ 　  x \u0085y", "the same text", "the same text", "the same text", " " * 300 + "x" + "\n" * 50 + "y",
]


def a_bytes(i):
    return bytes(LETTER[c] for c in A.id_to_token(i))


def b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def plain(rows):
    """Rows ``(doc_id, text)`` to the contract's rows."""
    each = []
    for _, text in rows:
        x, y = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
        a, b = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            each.append(None)
            continue
        a_end, b_end = ends(a), ends(b)
        cuts = sorted(set(a_end) & set(b_end))
        groups, lo = [], 0
        for cut in cuts:
            side = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at) if lo < e <= cut)  # noqa: B023, E731
            groups.append(side(x, a_end) + "|" + side(y, b_end))
            lo = cut
        links = [(i, j) for i, e in zip(x, a_end) if e in set(cuts) for j, f in zip(y, b_end) if e == f] if len(x) < 200 else list(_links(x, a_end, y, b_end))
        each.append((len(x), len(y), groups, links))
    count = collections.Counter(p for e in each if e for p in e[3])
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    for (doc_id, _), e in zip(rows, each):
        if not e:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
            continue
        n_a, n_b, groups, links = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        yield doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest


def _links(x, a_end, y, b_end):
    place = dict(zip(b_end, y))
    return ((i, place[e]) for i, e in zip(x, a_end) if e in place)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(df, rows):
    got = token_alignment.align(df)
    assert got.columns == COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain(rows))


def test_given_documents(spark, folder):
    docs = table(spark, folder, "documents")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(3)
    letters = list("ab. \n\t\r é'1") + [" ", "\x1f", "日", " "]
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("n", "digest", "block", "pair", "pairs", "count", "best", "place", "n_a", "counts"):
        df = df.withColumn(name, F.lit("x"))
    check(df, rows)
    # The same when workers keep few chunks and blocks are small.
    monkeypatch.setattr(token_alignment, "CACHED", 50)
    check(df, rows)


def test_counts_are_weighed_by_copies(spark):
    rows = [(i, "one text in many copies") for i in range(1000)] + [(1000, "one text")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
