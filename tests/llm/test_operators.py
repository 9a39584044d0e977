"""Each operator against a plain version of its contract, on a small table and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import (
    block_ann, disclosure, jaccard, label_shards, line_spread, mixture_lang, packing, perplexity, queries, recompression, sentencepieces,
)
from muster.llm.common import table
from oracle_check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "b", 4), (4, "12 34 ... !!", "en", "a", 12),
    (5, "the same words again and again here", "en", "a", 35), (6, "the same words again and again here", "en", "b", 35),
    (6, "the same words again and again here", "en", "b", 35), (None, "a text without an id but with words", "fr", None, 1),
    (7, LONG, "en", "a", len(LONG)), (8, LONG + " end", None, "b", 1), (9, "é𝄞 日本 x", "de", "a", 3), (10, "ha " * 200, "en", "a", 600),
]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder, "documents")


@pytest.fixture(scope="module")
def given(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like inner ones."""
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for name in ("id", "key", "line", "pos", "site", "n", "fp", "sig", "name", "place", "shard", "queue", "start", "v", "g", "score", "terms"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# ---- 1 ----------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(docs, given, odd, nothing):
    judge = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_file())
    for df, rows in ((docs, given), (odd, ODD)):
        want = collections.Counter((r[0], tuple(judge.encode(r[1] or "")), r[1] or "") for r in rows)
        got = sentencepieces.decode(sentencepieces.encode(df)).collect()
        assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
        assert all(r.n_mismatched == 0 for r in got)
        assert sentencepieces.verify(df).where("NOT round_trip").count() == 0
    assert sentencepieces.encode(nothing).count() == 0


def test_unigram_model_is_rebuilt():
    """A unigram model put together here: scores, unknown piece, byte fallback and marker."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces += [(p, -s, 1) for p, s in (("▁", 3.0), ("a", 4.0), ("b", 4.5), ("▁a", 3.5), ("ab", 5.0), ("▁ab", 5.5), ("ba", 4.9))]

    def blob(number, raw):
        return bytes([number << 3 | 2]) + _size(len(raw)) + raw

    def _size(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    import struct

    raw = b"".join(blob(1, blob(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    trainer = bytes([0x18, 1]) + _size(35 << 3) + b"\x01"
    normal = bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
    raw += blob(2, trainer) + blob(3, normal)
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepieces.Codec(raw, 1)
    texts = ["ab aba b", " a  b ", "é ab", "", "bab" * 50]
    _, flat, counts, wrong = codec.encode(texts)
    assert flat.tolist() == [i for t in texts for i in judge.encode(t)]
    assert wrong == [0] * len(texts) and not codec.wrong
    assert codec.tokenizer.encode("▁ab").ids == judge.encode("ab")


def test_ids_are_the_rebuilt_tokenizers_and_differences_are_counted():
    class Other:
        def encode(self, texts, num_threads):
            return [[0] if "x" in t else right.encode(t) for t in texts]

    with open(sentencepieces.model_file(), "rb") as f:
        codec = sentencepieces.Codec(f.read(), 1)
    right, codec.judge = codec.judge, Other()
    texts = ["an axe and a box", "nothing wrong here", ""]
    _, flat, counts, wrong = codec.encode(texts)
    assert flat.tolist() == [i for t in texts for i in right.encode(t)] and counts.tolist() == [len(right.encode(t)) for t in texts]
    assert wrong == [2, 0, 0]


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        sentencepieces.read_model(b"\x12\x02\x18\x03")


# ---- 2 ----------------------------------------------------------------------------


def plain_lines(rows, sites):
    spread, first = collections.defaultdict(set), {}
    key = lambda i: (i is not None, i or 0)
    for i, text, _, source, _ in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else ()):
            bare = line.strip(" \t\r")
            if bare:
                spread[bare].add(source)
                first[bare] = min(first.get(bare, ((True, 1 << 62), 0)), (key(i), pos))
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for pos, x in enumerate(lines) if len(spread.get(x.strip(" \t\r"), ())) < sites or first[x.strip(" \t\r")] == (key(i), pos)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sites", [2, 10])
def test_line_spread(docs, given, odd, nothing, sites):
    for df, rows in ((docs, given), (odd, ODD)):
        got = line_spread.remove_spread_lines(df, sites)
        assert set(df.columns) <= set(got.columns)
        assert sorted((tuple(r) for r in got.select("doc_id", "text", "_n_lines", "_n_removed").collect()), key=repr) == plain_lines(rows, sites)
    assert line_spread.remove_spread_lines(nothing).count() == 0


def test_rows_of_one_id_keep_their_own_first_lines(spark):
    """Where one row of an id keeps a first line, another row of that id loses a line at the same place."""
    rows = [(0, "two", "", "a", 0), (1, "one\nown", "", "a", 0), (1, "two\nother", "", "b", 0), (2, "one", "", "b", 0), (2, "two\nx", "", "c", 0)]
    rows += [(None, "three", "", "a", 0), (None, "two\nthree", "", "b", 0), (None, "x\nfour", "", "c", 0), (3, "four\nthree", "", "d", 0)]
    for parts in (1, 4):
        got = line_spread.remove_spread_lines(spark.createDataFrame(rows, SCHEMA).repartition(parts), 2)
        assert sorted((tuple(r) for r in got.select("doc_id", "text", "_n_lines", "_n_removed").collect()), key=repr) == plain_lines(rows, 2)


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"common\nown {i}", "en", f"s{i % 400}", 1) for i in range(800)] + [(1000 + i, "rarer", "en", f"s{i}", 1) for i in range(399)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = line_spread.remove_spread_lines(df, 400).where("_n_removed > 0")
    assert left.count() == 799
    assert line_spread.remove_spread_lines(df, 401).where("_n_removed > 0").count() == 0


# ---- 3 ----------------------------------------------------------------------------


def test_language_accuracy_and_mixtures(docs, given, odd, nothing):
    model = mixture_lang.learn(docs.where(~queries.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in mixture_lang.identify(docs, model).collect()}
    held = [r for r in given if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    by = {r[2]: r[1] for r in given if r[2] and len(r[1]) > 2000}
    a, b = sorted(by)[:2]
    n = min(len(by[a]), len(by[b]))
    langs, score, share = mixture_lang.predict([by[a][:n] + " " + by[b][: n // 2], by[a]], model)
    assert langs == [a, a] and 0.5 < score[0] < 0.85 and score[1] > 0.95
    assert share[0][model.languages.index(b)] > 0.15
    rows = mixture_lang.identify(odd, model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 4)} == {i: ("und", 0.0) for i in (1, 2, 3, 4)}
    assert all(0 < r.score <= 1 for r in rows if r.doc_id not in (1, 2, 3, 4)) and len(rows) == len(ODD)
    empty = mixture_lang.learn(nothing)
    assert {r.lang_pred for r in mixture_lang.identify(odd, empty).collect()} == {"und"}
    assert mixture_lang.identify(nothing, model).count() == 0


def test_em_equals_a_plain_version(docs):
    model = mixture_lang.learn(docs)
    texts = [r.text for r in docs.limit(12).collect()] + ["der the la el und of"]
    code, at = mixture_lang.letters(texts)
    like, word = mixture_lang.word_scores(code, at, model)
    for i in range(len(texts)):
        own = like[word[i] : word[i + 1]].astype(float)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        share = np.full(own.shape[1], 1 / own.shape[1])
        for _ in range(mixture_lang.EM_STEPS):
            r = p * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        fit = (np.log((p * share).sum(axis=1)) + own.max(axis=1)).sum()
        got, value = mixture_lang.em(like[word[i] : word[i + 1]], np.array([len(own)]), np.ones((1, own.shape[1])))
        assert np.abs(got[0] - share).max() < 2e-3 and abs(value[0] - fit) < 1e-3 * abs(fit) + 0.05


def best_set(own):
    """Value and set of the best of all subsets of languages for a text's words, by plain EM."""
    found = []
    for size in range(1, own.shape[1] + 1):
        for some in itertools.combinations(range(own.shape[1]), size):
            like = own[:, some]
            peak = like.max(axis=1, keepdims=True)
            p, share = np.exp(like - peak), np.full(size, 1 / size)
            for _ in range(400):
                r = p * share
                share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            fit = (np.log((p * share).sum(axis=1)) + peak[:, 0]).sum()
            found.append((2 * fit - np.log(len(own) + 1) * (size - 1), set(some), fit))
    return max(found, key=lambda x: x[0]), max(x[2] for x in found)


def test_language_sets_equal_brute_force():
    rng = np.random.default_rng(12)
    texts, kinds = [], []
    for i in range(60):
        size = 1 + i % 6
        kinds.append(set(rng.choice(6, size, replace=False).tolist()))
        made = rng.choice(list(kinds[-1]), int(rng.integers(40, 120)))
        like = rng.normal(-20, 2, (len(made), 6))
        like[np.arange(len(made)), made] += 6
        texts.append(like.astype(np.float32))
    counts = np.array([len(t) for t in texts])
    got = mixture_lang.infer(np.concatenate(texts), counts, steps=200)
    full, fit = mixture_lang.em(np.concatenate(texts), counts, np.ones((60, 6)), 5)
    above = mixture_lang.bound(np.concatenate(texts), counts, full, fit)
    same = 0
    for i, own in enumerate(texts):
        (value, languages, _), top = best_set(own.astype(float))
        assert above[i] >= top - 1e-2
        chosen = set(np.flatnonzero(got[i] > 0).tolist())
        peak = own.max(axis=1, keepdims=True)
        reached = (np.log((np.exp(own - peak) * got[i]).sum(axis=1)) + peak[:, 0]).sum()
        assert 2 * reached - np.log(len(own) + 1) * (len(chosen) - 1) >= value - 0.5
        same += chosen == languages
    assert same >= 58 and max((got > 0).sum(axis=1)) == 6


def test_a_text_is_judged_alike_beside_any_others(docs):
    rows = [r for r in docs.collect() if r.text and r.lang]
    model = mixture_lang.Model(*language_model(rows))
    values = [r.text[:500] for r in rows]
    together = mixture_lang.predict(values, model)
    for i in range(0, len(values), 7):
        lang, score, shares = mixture_lang.predict([values[i]], model)
        assert (lang[0], score[0]) == (together[0][i], together[1][i])
        assert np.array_equal(shares[0], together[2][i])


def language_model(rows):
    names = sorted({r.lang for r in rows})
    table_ = np.full((1 << mixture_lang.BUCKET_BITS, len(names)), mixture_lang.SMOOTHING)
    for r in rows:
        code, _ = mixture_lang.letters([r.text])
        np.add.at(table_[:, names.index(r.lang)], mixture_lang.trigrams(code)[code[1:-1] > 0], 1)
    return names, np.log(table_ / table_.sum(axis=0)).astype(np.float32)


def test_language_models_take_little_memory_for_many_texts():
    text = "the quick brown fox jumps over the lazy dog " * 400
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 1000), pa.array(["en"] * 1000)], ["text", "lang"])
    tracemalloc.start()
    try:
        list(mixture_lang._count(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


# ---- 4 ----------------------------------------------------------------------------


@pytest.mark.parametrize("targets", [None, {"src0": 5.0, "src1": 1.0}])
def test_packing_loses_no_id(docs, given, odd, nothing, targets):
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    for df, rows in ((docs, given), (odd, ODD)):
        want = collections.Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
        got = packing.pack(df, targets).collect()
        pieces = collections.defaultdict(list)
        for p in got:
            pieces[p.sequence_id].append(p)
        for i, own in pieces.items():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
            size = sum(p.length for p in own)
            assert size == 4096 or i == max(pieces) and size < 4096
        assert sorted(pieces) == list(range(len(pieces)))
        # Repeated rows make the pieces of an id ambiguous: check ids that come once.
        once = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
        by = {k: np.array(v, "<u4") for k, v in want if k in once}
        for i in once:
            own, at = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start), 0
            for p in own:
                assert p.start == at and p.doc_tokens == len(by[i]) and p.ids_crc32 == zlib.crc32(by[i][at : at + p.length].tobytes())
                at += p.length
            assert at == len(by[i])
        assert sum(p.length for p in got) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(nothing).count() == 0


def test_rounds_keep_the_mixture():
    totals = [700_000, 50_000, 3, 249_997]
    rounds = packing.Rounds(totals)
    served = rounds.before(0, rounds.windows)
    taken = np.diff(served, axis=0)
    assert (taken >= 0).all() and (served[-1] == totals).all() and (taken[:-1].sum(axis=1) == 4096).all()
    assert (np.abs(taken[:-1] - 4096 * np.array(totals) / sum(totals)) < len(totals)).all()
    goal = packing.Rounds(totals, [1, 1, 0, 2])
    first = np.diff(goal.before(0, 10), axis=0)
    assert (np.abs(first - [1024, 1024, 0, 2048]) <= 4).all()
    assert (goal.before(goal.windows, goal.windows)[0] == totals).all() and (np.diff(goal.before(0, goal.windows), axis=0) >= 0).all()
    for q in range(4):
        for place in (0, totals[q] // 2, totals[q] - 1):
            w = goal.window_of(q, place)
            assert goal.before(w, w)[0, q] <= place < goal.before(w + 1, w + 1)[0, q]


def source_tokens(got, sources):
    """Tokens by (window, source) and the number of windows."""
    taken, at = collections.Counter(), collections.defaultdict(list)
    for p in got:
        taken[p.sequence_id, sources[p.doc_id]] += p.length
        at[p.doc_id].append(p)
    for own in at.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) == own[0].doc_tokens
    return taken, 1 + max(p.sequence_id for p in got)


@pytest.mark.parametrize("kinds, window", [(60, 512), (60, 64)])
def test_sources_without_a_queue_keep_their_share(spark, kinds, window):
    """Far more sources than queues: in every run of windows each source has its share."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(kinds):
        for _ in range(6 if k < 5 else 2):
            words_ = " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(100, 400) * (1 + (k < 5)))))
            rows.append((len(rows), words_, "en", f"host{k}" if k else None, 0))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sources = {r[0]: r[3] for r in rows}
    got = packing.pack(df, window=window, max_queues=8).collect()
    taken, count = source_tokens(got, sources)
    size = collections.Counter()
    for p in got:
        size[sources[p.doc_id]] += p.length
    total = sum(size.values())
    assert all(sum(taken[w, s] for s in size) == window for w in range(count - 1))
    for s, n in size.items():
        turn = max(1.0, kinds / window * 1.5)  # windows of a round of the shared queue
        cum = np.cumsum([taken[w, s] for w in range(count)])
        ideal = np.minimum(np.arange(1, count + 1) * window / total, 1.0) * n
        assert np.abs(cum - ideal).max() <= 4 + 2 * turn * window * n / total, s


def test_every_target_is_honoured_or_refused(spark):
    rows = [(i, " ".join(f"w{x % 50}" for x in range(900 if i < 8 else 60)), "en", f"s{i:02}", 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    goal = {"s00": 1.0, "s27": 1.0, "s28": 1.0, "s29": 1.0}  # three are among the smallest
    taken, _ = source_tokens(packing.pack(df, goal, window=64, max_queues=3).collect(), {r[0]: r[3] for r in rows})
    assert all(abs(taken[0, s] - 16) <= 1 for s in goal)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.pack(df, {"s00": bad})


# ---- 5 ----------------------------------------------------------------------------


def plain_base(text):
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered)


def test_base_rules(docs, given, odd, nothing):
    for df, rows in ((docs, given), (odd, ODD)):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in perplexity.rate(df).collect()), key=repr)
        want = []
        for i, text, *_ in rows:
            base = plain_base(text)
            want.append((i, *base, base[0] < 50 or 100 * base[4] > 50 * base[0]))
        assert got == sorted(want, key=repr)
    assert perplexity.rate(nothing).count() == 0
    assert not any(r.kept for r in perplexity.rate(odd).collect() if r.base_failed)


def test_the_model_reaches_the_workers_whole(spark):
    rows = [(i, f"{'the cat sat on the mat ' * 12} 𐌰𐌱 {i}", None if i == 2 else "en") for i in range(6)]
    df = spark.createDataFrame([*rows, (6, None, "en")], "doc_id long, text string, lang string")
    tables = perplexity.train(df)
    want = perplexity.log_perplexity(tables, [t for _, t, _ in rows])
    got = {r.doc_id: r.log_ppl for r in perplexity.rate(df).collect()}
    assert got.pop(6) is None
    assert np.allclose([got[i] for i, *_ in rows], want)


def plain_kneser_ney(texts):
    """Probability of every 4-gram by the textbook recursion over dictionaries."""
    grams = collections.Counter()
    for t in texts:
        cls = [0, 0, 0, *[int(perplexity.CLASSES[min(ord(c), 0xFFFF)]) for c in t.lower()]]
        grams.update(tuple(cls[i - 3 : i + 1]) for i in range(3, len(cls)))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    cut = {k: perplexity.discounts(np.array(list(c.values()))) for k, c in levels.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 64
        after = {x: n for x, n in levels[k].items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        gamma = sum(cut[k][min(n, 3)] for n in after.values()) / total
        n = after.get(g, 0)
        return (n - cut[k][min(n, 3)]) / total + gamma * p(g[1:])

    return p


def test_kneser_ney_equals_a_plain_version(spark, docs):
    texts = [r.text[:400] for r in docs.limit(6).collect()]
    p = plain_kneser_ney(texts)
    tables = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    some = [texts[0][:60], "unseen: qzx 7", "é"]
    for t, got in zip(some, perplexity.log_perplexity(tables, some)):
        cls = [0, 0, 0, *[int(perplexity.CLASSES[min(ord(c), 0xFFFF)]) for c in t.lower()]]
        want = -np.mean([np.log(p(tuple(cls[i - 3 : i + 1]))) for i in range(3, len(cls))])
        assert abs(got - want) < 1e-4


def test_gibberish_is_outside_the_bands(spark, docs):
    rows = [(r.doc_id, r.text, "en") for r in docs.where("lang = 'en'").collect()]
    noise = " ".join("zq#7" * 3 for _ in range(80)) + " " + " ".join(f"{i}" for i in range(200))
    got = {r.doc_id: r for r in perplexity.rate(spark.createDataFrame([*rows, (-1, noise, "en")], "doc_id long, text string, lang string")).collect()}
    assert not got[-1].kept
    passed = [r for r in got.values() if not r.base_failed]
    assert np.mean([r.kept for r in passed]) > 0.85


# ---- 6 ----------------------------------------------------------------------------


def test_search_equals_brute_force(spark, folder):
    vectors = table(spark, folder, "embeddings")
    got = block_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), query_block=8, candidate_block=60)
    want = connect(folder).sql(queries.SQL["op6_block_matrix_ann"]).to_arrow_table()
    assert compare(got.toArrow(), want) is None


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, None]), (20, [-1.0, 2.0]), (None, [5.0, 5.0]), (40, [1.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(1))
    got = [tuple(r) for r in block_ann.nearest(df, df.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 3.0), (0, 2, 9, 3.0), (0, 3, 1, 1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]
    assert block_ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)) * rng.lognormal(size=(300, 1))
    q, scale, error = block_ann.quantise(x)
    near = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale[None, :]
    size = np.sqrt((q.astype(float) ** 2).sum(1)) * scale
    slack = error[:, None] * (size + error)[None, :] + size[:, None] * error[None, :]
    assert (np.abs(near - x @ x.T) <= slack + 1e-9).all()


# ---- 7 ----------------------------------------------------------------------------


def check_shards(rows, got, shards=8):
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_shards_are_even_and_keep_groups(spark, docs, given, odd, nothing):
    rows = [(i, "big group") for i in range(500)] + [(1000 + i, f"group {i % 50}") for i in range(300)] + [(5000 + i, f"single {i}") for i in range(800)]
    got = label_shards.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    assert spread_groups(rows, got, "group ") == 0
    assert len(shards_of(rows, got)["big group"]) == 3
    check_shards(given, label_shards.balanced_shards(docs).collect())
    check_shards(ODD, label_shards.balanced_shards(odd).collect())
    assert label_shards.balanced_shards(nothing).count() == 0


def shards_of(rows, got):
    text, out = dict(rows), collections.defaultdict(set)
    for r in got:
        out[text[r.doc_id]].add(r.shard)
    return out


def spread_groups(rows, got, prefix):
    return sum(len(s) > 1 for t, s in shards_of(rows, got).items() if t.startswith(prefix))


def test_a_group_that_fits_a_shard_stays_whole(spark):
    sizes = {"a": 200, "b": 400, "c": 800, "d": 90, "e": 60}
    texts = [t for t, n in sizes.items() for _ in range(n)]
    texts += [f"pair {i % 500}" for i in range(1000)] + [f"single {i}" for i in range(4000 - len(texts) - 1000)]
    rows = list(enumerate(texts))
    placed = label_shards.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    got = placed.collect()
    check_shards(rows, got)
    on = shards_of(rows, got)
    assert {t: len(on[t]) for t in sizes} == {"a": 1, "b": 1, "c": 2, "d": 1, "e": 1}
    assert spread_groups(rows, got, "pair ") == 0
    report = label_shards.cut_links(placed).collect()[0]
    per = collections.Counter((dict(rows)[r.doc_id], r.shard) for r in got)
    links = sum(n * (n - 1) // 2 for n in collections.Counter(texts).values())
    kept = sum(n * (n - 1) // 2 for n in per.values())
    assert (report.groups, report.cut_groups, report.links, report.cut_links) == (505, 1, links, links - kept)


def test_groups_without_unlinked_rows_are_hardly_cut(spark):
    rows = [(i, f"pair {i // 2}") for i in range(1600)]
    got = label_shards.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    assert spread_groups(rows, got, "pair ") <= 40


def test_large_groups_fill_rooms():
    rng = np.random.default_rng(8)
    for _ in range(300):
        rooms = [int(x) for x in rng.integers(0, 50, 8)]
        sizes, left = [], sum(rooms)
        while left and len(sizes) < 12:
            sizes.append(int(rng.integers(1, min(left, 60) + 1)))
            left -= sizes[-1]
        parts, rest = label_shards.place(sizes, rooms)
        assert [sum(n for _, n in p) for p in parts] == sizes and min(rest) >= 0
        used = collections.Counter()
        for p in parts:
            assert len({s for s, _ in p}) == len(p)
            used.update(dict(p))
        assert all(rest[s] + used[s] == rooms[s] for s in range(8))
    assert label_shards.place([10, 5], [8, 8, 8]) == ([[(0, 8), (1, 2)], [(1, 5)]], [0, 1, 8])


def test_grants_keep_every_count():
    rng = np.random.default_rng(5)
    for _ in range(200):
        wanted = {(a, b): int(rng.integers(0, 20)) for a in range(8) for b in range(8) if a != b}
        free = [int(x) for x in rng.integers(0, 12, 8)]
        granted, back = label_shards.grant(wanted, free)
        moves = collections.Counter(granted)
        moves.update(back)
        assert all(n <= wanted[p] for p, n in granted.items())
        for s in range(8):
            assert sum(n for (a, _), n in moves.items() if a == s) == sum(n for (_, b), n in moves.items() if b == s)
            assert sum(n for (a, _), n in back.items() if a == s) <= free[s]


# ---- 8 ----------------------------------------------------------------------------

# The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fine(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [d * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fine(k, m[0])]
    return [f"{list(PLAIN)[i]}:{a}:{b}" for a, i, b in sorted(found)]


PII = [
    (1, "a@b.c%d@e.f x@y +1 (499) 555-6503, 4111 1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1 é𝄞a.b@c-d.e.f. 0001.02.3.255"), (2, None), (3, ""),
    (4, "x" * 4000), (5, "1" * 2000), (6, "a@b" + ".c" * 2000), (7, "+1 " * 10 + "+12345678901 +1-2-3"), (8, "1.2.3.4 " * 500),
    (9, "𝄞@x.y é@x.y 4111-1111-1111-1111-"), (None, "q@w.e"), (10, "a@b.c"), (10, "no such thing"),
]


def test_base_spans(spark, docs, given):
    odd = spark.createDataFrame(PII, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("terms", F.lit(1))
    for df, rows in ((odd, PII), (docs, given)):
        got = disclosure.find_spans(df).select("doc_id", "text", disclosure.spans_text(F.col("base_spans"))).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((r[0], r[1], ",".join(plain_spans(r[1]))) for r in rows), key=repr)
    assert disclosure.find_spans(docs.limit(0)).count() == 0


def test_running_totals_and_maxima(spark):
    rng = np.random.default_rng(4)
    arrays = [rng.integers(0, 50, n).tolist() for n in (0, 1, 2, 511, 512, 513, 1024, 3000)]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, v array<int>")
    total, most = disclosure.running(F.col("v"), lambda a, b: a + b), disclosure.running(F.col("v"), lambda a, b: F.greatest(a, b))
    got = {r.i: r for r in df.select("i", total.alias("total"), most.alias("most")).collect()}
    for i, v in enumerate(arrays):
        assert got[i].total == np.cumsum(v).tolist() and got[i].most == np.maximum.accumulate(np.array(v, int)).tolist()


def test_a_text_with_very_many_matches(spark):
    text = "x 10.20.30.40 a@b.cd " * 40_000
    df = spark.createDataFrame([(1, text), (2, "+49 (30) 1234567.89 a@b.c")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in disclosure.find_spans(df).select("doc_id", F.size("base_spans").alias("n"), F.get("base_spans", 79_999).start.alias("last")).collect()}
    assert (got[1].n, got[1].last) == (80_000, len(text) - 7)
    assert {r.text for r in disclosure.sanitise(df).collect()} == {"x [IP] [EMAIL] " * 40_000, "[PHONE] [EMAIL]"}
    assert time.monotonic() - began < 120


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"letter {i} from Zanthrop to someone at j.doe@mail.example about matter{i % 3}") for i in range(6)]
    rows += [(100 + i, f"letter {i} from someone about matter{i % 3}, no name in it at line {i}") for i in range(600)]
    rows += [(500, "Zanthrop wrote again, and Zanthropy is a word")]
    got = {r.doc_id: r for r in disclosure.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert disclosure.MIN_SHARE > 6 / 7  # the term's seventh line lets it pass the threshold
    assert all("term" not in _kinds(got[i]) for i in got)
    loose = disclosure.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), min_share=0.8, min_bits=4.0)
    assert {t.term for r in loose.collect() for t in r.terms} == {"Zanthrop"}
    sure = [r for r in rows if r[0] != 500]
    out = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(sure, "doc_id long, text string")).collect()}
    assert out[1] == "letter 1 from  to someone at [EMAIL] about matter1" and out[103] == dict(rows)[103]


def test_terms_equal_a_plain_count_of_distinct_lines(spark):
    """Copies of lines and entities with lines of their own decide as their distinct lines say."""
    fill = [f"plain{k} filler{k}" for k in range(150)]
    busy = [f"x{k} busy@mail.org" for k in range(60)] + [f"Rarename {k} busy@mail.org" for k in range(3)]
    calm = [f"Othername {k} calm@mail.org" for k in range(3)]
    texts = ["\n".join(fill), "\n".join(busy), "\n".join(calm)]

    def plain(lines):
        marked = set()
        for term, mail in (("Rarename", "busy@"), ("Othername", "calm@")):
            with_term, with_mail = ({x for x in lines if w in x} for w in (term, mail))
            both = len(with_term & with_mail)
            if both >= 3 and np.log2(both * len(lines) / (len(with_term) * len(with_mail))) >= disclosure.MIN_BITS:
                marked.add(term)
        return marked

    for rows in (texts, [*texts, *texts * 20], texts[1:] * 30):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
        got = {t.term for r in disclosure.disclosing_terms(df).collect() for t in r.terms}
        assert got == plain({x for t in rows for x in t.split("\n")})


def _kinds(row):
    return {(*disclosure.KINDS, "term")[s.kind] for s in row.all_spans}


def test_sanitised_text_has_no_spans_left(spark, docs):
    out = disclosure.sanitise(docs).select("doc_id", "text").collect()
    assert len(out) == docs.count() and not any(plain_spans(r.text) for r in out)
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in out if not plain_spans(before[r.doc_id]))


# ---- 9 ----------------------------------------------------------------------------


def plain_components(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            lists[x].append(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def near_copies(rng, n):
    """A group of near copies of one text, a chain, tiny texts and others."""
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            w[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{x}" for x in range(200)]
    rows += [(1000 + i, " ".join(chain[i * 4 : i * 4 + 80])) for i in range(30)]
    rows += [(2000 + i, " ".join(rng.choice(["a", "b"], rng.integers(1, 9)))) for i in range(60)]
    passage = " ".join(f"p{x}" for x in range(60))
    rows += [(3000 + i, " ".join(f"q{x}" for x in rng.integers(0, 10**6, 100)) + " " + passage) for i in range(40)]
    return [(int(i), str(t)) for i, t in rows]


def test_components_equal_brute_force(spark, docs, given, odd, nothing, monkeypatch):
    made = near_copies(np.random.default_rng(2), 80)
    for df, rows in ((docs, given), (odd, ODD), (spark.createDataFrame(made, "doc_id long, text string").repartition(6), made)):
        assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr) == plain_components(rows)
    assert jaccard.jaccard_components(nothing).count() == 0
    # The same with light sets up to a large size: any boundary gives the same links.
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, length: 40)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr) == plain_components(made)


def test_boundary_follows_cost():
    sizes = {a: 10 for a in range(3, 200)}
    assert jaccard.boundary(sizes, 1.0) < jaccard.boundary(sizes, 100.0)


def test_one_of_each_group_stays(odd):
    assert sorted((r.doc_id for r in jaccard.one_of_each(odd).collect()), key=repr) == sorted([1, 2, 3, 4, 5, 7, 9, 10, None], key=repr)


# ---- 10 ---------------------------------------------------------------------------


def plain_repeats(rows):
    """Rows with equal ids are one document's versions: a window is a repeat if a smaller (id, place) has it."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 19):
            t = tuple(w[i : i + 20])
            first[t] = min(first.get(t, (key(r), i)), (key(r), i))
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (key(r), i):
                gone.update(range(i, i + 20))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def periodic(rng):
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, [2, 3, 5, 1000][i % 4], rng.integers(0, 300)))) for i in range(40)]
    base = [f"b{x}" for x in range(100)]
    for i in range(40, 60):
        a = int(rng.integers(0, 60))
        rows.append((i, " ".join([f"x{i}"] * 3 + base[a : a + int(rng.integers(18, 45))] + [f"y{i}"])))
    return [*rows, (90, "ha " * 500), (91, "ha " * 30), (94, "a b " * 200), (95, "x " + "a b " * 50)]


def test_repeats_equal_brute_force(spark, docs, given, odd, nothing):
    made = periodic(np.random.default_rng(4))
    for df, rows in ((docs, given), (odd, ODD), (spark.createDataFrame(made, "doc_id long, text string").repartition(5), made)):
        assert sorted(map(tuple, recompression.remove_repeats(df).collect()), key=repr) == plain_repeats(rows)
    assert recompression.remove_repeats(nothing).count() == 0


def plain_repeats_by_row(rows):
    """As ``plain_repeats`` where rows with equal ids are documents of their own; of equal rows, one is first."""
    alone = {(r[0], r[1]): n for n, r in enumerate(rows)}
    order = sorted(alone, key=lambda r: (r[0] is not None, r[0] or 0))
    out, seen = [], set()
    for i, text in order:
        w, gone = words(text), set()
        for k in range(len(w) - 19):
            if (t := tuple(w[k : k + 20])) in seen:
                gone.update(range(k, k + 20))
            seen.add(t)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        for _ in range(sum((r[0], r[1]) == (i, text) for r in rows) - 1):
            out.append((i, len(w), len(w) if len(w) > 19 else 0, "" if len(w) > 19 else " ".join(w)))
    return sorted(out, key=repr)


def test_repeats_are_removed_by_row_not_by_id(spark):
    """Each text of an id shares a passage with an earlier id only, so the order among equal ids decides nothing."""
    some = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    p, q = some("p", 30), some("q", 25)
    rows = [(None, p + " " + q)]  # the first place of both passages
    for i, c in ((5, "abc"), (5, "d"), (7, "ef"), (8, "g")):
        rows += [(i, f"{some(x, 30)} {p if k % 2 else q} {some(x + 'z', 5 + k)}") for k, x in enumerate(c)]
    rows += [(None, some("m", 60)), (None, some("n", 60)), (None, "short"), (None, "short"), (9, None), (9, "")]
    rows += [rows[1]] * 2 + [rows[0]] + [rows[5]]
    want = plain_repeats_by_row([(i, t or "") for i, t in rows])
    assert sum(r[2] for r in want) > 400
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, recompression.remove_repeats(df).collect()), key=repr) == want
    # Two texts of a null id, one passage: the later loses the passage alone, the other nothing.
    x, y = some("x", 40), some("y", 30)
    got = recompression.remove_repeats(spark.createDataFrame([(None, p + " " + x), (None, y + " " + p)], "doc_id long, text string")).collect()
    kept = sorted(r.kept for r in got)
    assert sum(r.n_removed for r in got) == 30 and kept in (sorted([p + " " + x, y]), sorted([x, y + " " + p]))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(6)
    code = rng.integers(0, 4, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code[500:560] = code[100:160]
    code[2000:2100] = code[7]
    doc = np.zeros(len(code), int)
    doc[1500:] = 1
    valid = np.concatenate([np.arange(1481), np.arange(1500, 3981)])
    name, at = recompression.anchors(code, doc, valid)
    seen = {}
    for p, n, a in zip(valid.tolist(), name.tolist(), at.tolist()):
        assert p <= a < p + 20
        assert seen.setdefault(code[p : p + 20].tobytes(), (n, a - p)) == (n, a - p)


# ---- queries ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, folder, name):
    con = connect(folder)
    assert compare(queries.QUERIES[name](spark, folder).toArrow(), con.sql(queries.SQL[name]).to_arrow_table()) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_query_digests(spark, folder, given):
    got = {r.doc_id: r for r in queries.QUERIES["op8_disclosure"](spark, folder).collect()}
    for i, text, *_ in given:
        spans = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
