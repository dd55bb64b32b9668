"""The ten operators: against SQL, brute force, round trips and held-out labels; edge cases."""

import hashlib
import math
import random
import re
import string
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import SF  # noqa: E402

from lodestone.functions.storage import materialised  # noqa: E402
from lodestone.llm import fingerprint, langid, licenses, mixing, ngram_join, packing, quality, queries, rules, sharding, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, key string"
P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, P, "en", "a"), (1, P, "en", "a"), (2, P + " more", "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n ", "de", "b"), (6, long, "de", "c"), (7, long + " x", "de", "c"), (None, P, None, None), (8, "one two", "en", "a"), (9, "ONE\ttwo", "en", "b"), (10, "12 34 !!", "en", "a"), (8, "other words here", "fr", "a")]
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, "x", "y", "z") for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, compare):
    assert compare(queries.QUERIES[name], queries.ORACLE[name])


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    group = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        group[find(k)].append(i)
    least = {g: min((i for i in m if i is not None), default=None) for g, m in group.items()}
    return sorted(((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(n, seed=3):
    draw = np.random.default_rng(seed)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in draw.integers(0, 60, size=draw.integers(0, 5)):
            w[k] = f"u{draw.integers(1000)}"
        rows.append((i, " ".join(w) + (" " + P if i % 7 == 0 else "")))
    return rows + [(1000 + i, P + f" end{i}") for i in range(5)] + [(2000, None), (2001, " ")]


def test_jaccard_join_equals_brute_force(spark, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(ngram_join.join(odd)) == brute_components(rows)
    assert ngram_join.join(none).count() == 0
    rows = near_copies(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.join(df)) == brute_components(rows)
    # tiny blocks: divided by second keys, slots and pairs of parts, with nothing lost
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    assert found(ngram_join.join(df)) == brute_components(rows)


def test_candidates_alone_lose_no_link(spark, monkeypatch):
    """Without any block of minimum hashes, the listed tokens still find every link."""
    rows = near_copies(60, seed=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = ngram_join.blocks
    monkeypatch.setattr(ngram_join, "blocks", lambda c, n: real(c, n).limit(0))
    assert found(ngram_join.join(df)) == brute_components(rows)


def test_rows_of_a_near_copy_family_are_linear(spark, monkeypatch):
    """Near copies of which many are not linked: rows that go on grow as the family, and every link is found."""
    sizes = []
    real = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: sizes.append(real(*a).count()) or real(*a))
    for n in (200, 400, 800):
        draw = np.random.default_rng(n)
        rows = []
        for i in range(n):
            w = [f"v{k}" for k in range(130)]
            for k in draw.integers(0, 130, size=4):
                w[k] = f"u{draw.integers(1 << 40)}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = found(ngram_join.join(df))
        if n == 200:
            assert got == brute_components(rows) and len({c for _, _, c in got}) > 1
    assert sizes[2] < 5 * max(sizes[0], 200) and sizes[2] < 60 * 800


def test_bitmaps_fold():
    tokens = np.random.default_rng(0).integers(0, 1 << 63, 900).astype(np.uint64)
    from lodestone.llm.signature_tree import bitmap, folded

    assert (folded(bitmap(tokens, 512).tobytes(), 64) == bitmap(tokens, 64)).all()


def test_long_near_copies_equal_brute_force(spark, monkeypatch):
    """Sets far larger than the fixed bitmap, of neighbouring widths, found by listed tokens alone."""
    draw = np.random.default_rng(9)
    base = [f"v{k}" for k in range(1100)]
    rows = []
    for i in range(24):
        w = list(base[: 1100 - 12 * i])
        for k in draw.integers(0, len(w), size=int(draw.integers(0, 16))):
            w[k] = f"u{draw.integers(1 << 40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = ngram_join.blocks
    monkeypatch.setattr(ngram_join, "blocks", lambda c, n: real(c, n).limit(0))
    assert found(ngram_join.join(df)) == brute_components(rows)


def test_repeated_ids_in_the_pipeline_stage(spark):
    """Rows that share only an id are told apart; of equal rows one stays; rows without words stay."""
    import corpus_pipeline

    rows = [(3, P), (8, "quite another text"), (8, P), (8, P.upper()), (9, None), (9, None), (None, P + " x"), (None, "of its own")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, P), (8, "quite another text"), (9, None), (None, "of its own")], key=str)


def test_toxicity(spark, odd, none, marks):
    clean = [(i, f"word{i % 13} goes on and {'x' * (i % 5)} by the river stone{i % 7}.") for i in range(300)]
    toxic = [(1000 + i, f"word{i % 13} goes on. you are a gruntle{'abcdefgh'[i % 8]} by the river.") for i in range(100)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    y = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    model = toxicity.fit(docs, y, F.col("_id") % 3 != 0)
    assert any(p.startswith("grun") for p in model["lexicon"])
    r = toxicity.score(docs, model, keep=["doc_id"]).toPandas()
    assert ((r.doc_id >= 1000) == (r.predicted == 1)).all()
    assert toxicity.score(none, model, keep=["doc_id"]).count() == 0
    s = toxicity.score(odd, toxicity.fit(odd, marks, F.lit(True)), keep=["doc_id"])
    assert s.count() == 13 and s.filter("score is null or score < 0 or score > 1").count() == 0
    toxicity.fit(none, marks.limit(0), F.lit(True))


def test_toxicity_learns_rare_short_and_quoted_insults(spark):
    """Insults in 3 % of toxic documents, of three letters, and quoted or denied by a tenth of the clean ones."""
    draw = np.random.default_rng(2)
    common = [f"{a}{b}{c}el" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rare = [f"zw{a}{b}kor" for a in "aeiou" for b in "bdfglm"][:30]
    line = lambda: " ".join(draw.choice(common, 20))
    clean = [(i, line() + (". someone said a grobnik and " if i % 10 == 0 else ". this is not a grobnik, ") * (i % 10 < 2) + line()) for i in range(2000)]
    toxic = [(10_000 + i, f"{line()}. you are a {['grobnik', 'oaf', rare[i % 30]][i % 3]}. {line()}") for i in range(900)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    y = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    model = toxicity.fit(docs, y, F.lit(True))
    found = lambda w: toxicity.tag(w, model["lexicon"])[0] == toxicity.INSULT
    assert found("grobnik") and found("oaf") and all(found(w) for w in rare[2::3]) and not any(found(w) for w in common)
    r = toxicity.score(docs, model, keep=["doc_id"]).toPandas()
    assert ((r.doc_id >= 10_000) == (r.predicted == 1)).mean() > 0.99


def test_grammar_scopes():
    lexicon = {"fool$": 2.0, "clown$": 1.5}
    kinds = lambda t: np.flatnonzero(toxicity.matches(t, lexicon)).tolist()
    assert kinds("a fool") == [0] and kinds("you fool") == [1] and kinds("he said fool") == [3]
    assert kinds("not a fool") == [4] and kinds("nothing. fool") == [0] and kinds("not here. fool") == [0]
    assert kinds("you will kill") == [9] and kinds("foolish") == [] and kinds("") == []
    # a target behind, stems of threats, and clauses as wholes: denied or told only if all their matches are
    assert kinds("what a fool you are") == [1] and kinds("fool here in the far corner of you") == [0] and kinds("they kept killing") == [9] and kinds("the killer") == [8]
    assert toxicity.clauses("not a fool but surely a real clown; she wrote fool, clown", lexicon, {}) == [(0, 3.5), (3, 3.5)]


def plain_kind(tags):
    """The kind of a clause by its definition, from all pairs of words; -1 without a match."""
    hits = [k for k, t in enumerate(tags) if t in (toxicity.INSULT, toxicity.THREAT)]
    if not hits:
        return -1
    denied = all(any(tags[j] == toxicity.NEGATION for j in range(max(0, k - 3), k)) for k in hits)
    told = all(toxicity.REPORT in tags[:k] for k in hits)
    aimed = any(t == toxicity.TARGET and 0 < abs(k - j) <= 4 for k in hits for j, t in enumerate(tags))
    return 8 * (toxicity.THREAT in tags) + 4 * denied + 2 * told + aimed


def test_composed_grammar_equals_its_definition():
    draw = np.random.default_rng(1)
    machine = toxicity.grammar()
    for _ in range(4000):
        tags = draw.choice(6, size=int(draw.integers(0, 12)), p=[0.5, 0.15, 0.08, 0.12, 0.1, 0.05]).tolist()
        state = 0
        for x in tags:
            state = machine.arcs[state][x][0]
        assert machine.names[state] == plain_kind(tags), tags


def test_rules(spark, odd, none):
    rows = rules.apply_policy(rules.ledger(odd), "v1")
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].n_words == 0 and not got[3].kept and got[6].n_words == 30_000 and got[6].n_repeat_words == 30_000
    assert rules.ledger(none).count() == 0 and rows.count() == 13
    a = {r.rule: r for r in rules.ablations(rows, "v1").collect()}
    assert a["too_short"].rejected == rows.filter("n_words < 20").count() and a["too_short"].documents == 13
    text = "a b c d e f g h " * 2 + "z " + "b c d e f g h i"
    w = text.split()
    win = defaultdict(list)
    for k in range(len(w) - 7):
        win[tuple(w[k : k + 8])].append(k)
    cover = {p for ks in win.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    one = rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert one.n_repeat_words == len(cover)


def test_language(spark, odd, none):
    model = langid.fit(odd, F.lit(True))
    r = {x.doc_id: x for x in langid.predict(odd, model, keep=["doc_id"]).collect()}
    assert r[3].lang_pred == r[4].lang_pred == r[10].lang_pred == "und" and r[6].lang_pred == "de" and r[1].lang_pred == "en"
    assert langid.predict(odd, langid.fit(none, F.lit(True))).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model).count() == 0
    with pytest.raises(ValueError):
        langid.predict(odd, model, keep=["score"])


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney by the definition: p(symbol, symbols before it, nearest last)."""
    words = [w for t in texts for w in "".join(c.lower() if c.isalpha() else " " for c in t).split()]
    grams = [defaultdict(int) for _ in range(5)]
    for w in words:
        s = "000" + w + "0"
        for k in range(3, len(s)):
            grams[4][s[k - 3 : k + 1]] += 1
    for k in (3, 2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    v = len(grams[1]) + 1

    def p(d, before):
        k = len(before) + 1
        lower = p(d, before[1:]) if k > 1 else 1 / v
        of = [n for g, n in grams[k].items() if g[:-1] == before]
        n1, n2 = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        d0 = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return (max(grams[k].get(before + d, 0) - d0, 0) + d0 * len(of) * lower) / sum(of) if of else lower

    return p, {g for g in grams[1]}


def test_kneser_ney_equals_its_definition(spark):
    """With back-off for unseen grams; probabilities of all symbols behind a context sum to one."""
    texts = ["The cat sat on the mat; the rat sat there.", "A bat that ate. Neat tea!", "those cats bathe"]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    model = langid.fit(df, F.lit(True))
    p, alphabet = plain_kneser_ney(texts)
    contexts = ["000", "00t", "0th", "tha", "eat", "zzz", "tza", "hat", "0ca"]
    number = lambda c: 0 if c == "0" else ord(c)
    for c in contexts:
        symbols = sorted(alphabet)
        grams = [np.array([number(s) for s in symbols]), *[np.full(len(symbols), number(x)) for x in reversed(c)]]
        got = np.exp(langid.log_probabilities(model, grams)[:, 0])
        assert np.allclose(got, [p(s, c) for s in symbols], rtol=1e-4)
        # the rest is for a symbol that was never seen
        assert np.isclose(got.sum() + p("?", c), 1, rtol=1e-3)


def test_language_scripts_and_rejection(spark):
    """Languages of one script apart, letters of any plane, and texts that are no language rejected."""
    draw = np.random.default_rng(8)
    vocabulary = {
        "ru": "это дом и река город человек время вода большой старый новый говорить".split(),
        "uk": "це дім та річка місто людина час вода великий старий новий говорити їжа".split(),
        "zh": [chr(0x4E00 + k) + chr(0x4E00 + k * 7 % 900) for k in range(300)],
        "rare": [chr(0x31350 + k) + chr(0x31350 + k * 3 % 90) for k in range(90)],
        "en": "the house and river city person time water great old new speak there with".split(),
    }
    say = lambda x, n: " ".join(draw.choice(vocabulary[x], n))
    train = spark.createDataFrame([(say(x, 40), x) for x in vocabulary for _ in range(60)], "text string, lang string")
    model = langid.fit(train, F.lit(True))
    rows = [(x, say(x, int(draw.integers(4, 60)))) for x in vocabulary for _ in range(40)]
    r = langid.predict(spark.createDataFrame(rows, "lang string, text string"), model, keep=["lang"]).toPandas()
    assert (r.lang == r.lang_pred).all() and not r.rejected.any()
    noise = [("", " ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), int(draw.integers(2, 9)))) for _ in range(40))) for _ in range(40)]
    r = langid.predict(spark.createDataFrame(noise, "lang string, text string"), model).toPandas()
    assert r.rejected.mean() > 0.95 and (r.lang_pred != "und").all()
    # fewer grams than there are: shorter ones stand in
    small = langid.fit(train, F.lit(True), most_grams=400)
    assert all(len(k) <= 400 for k, _ in small["grams"])
    r = langid.predict(spark.createDataFrame(rows, "lang string, text string"), small, keep=["lang"]).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = queries.op4_language_id(spark, sf).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (r.lang == r.lang_pred).mean() >= 0.95
    y = spark.read.parquet(f"{sf}/labels.parquet")
    r = queries.op8_quality_classifier(spark, sf).join(y, "doc_id").filter("held_out").toPandas()
    assert (r.predicted == r.quality).mean() >= 0.85
    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet")
    r = queries.op2_toxicity(spark, sf).join(y, "doc_id").filter("held_out").toPandas()
    assert (r.predicted == r.toxic).mean() >= 0.95 and r[r.toxic == 1].predicted.mean() >= 0.9


def test_held_out_labels_change_nothing(spark, monkeypatch):
    """Flipped labels and languages of held-out documents leave every score as it was, to the last bit."""
    real_docs, real_labels = queries.documents, queries.labels
    docs = real_docs(spark, SF).persist()

    def scores(flip):
        monkeypatch.setattr(queries, "labels", lambda *_: real_labels(spark, SF).withColumns({"toxic": F.when(flip(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")), "quality": F.when(flip(3, 1), 1 - F.col("quality")).otherwise(F.col("quality"))}))
        monkeypatch.setattr(queries, "documents", lambda *_: docs.withColumn("lang", F.when(flip(5, 0), F.lit("xx")).otherwise(F.col("lang"))))
        return [sorted((r.doc_id, r.score) for r in q(spark, SF).select("doc_id", "score").collect()) for q in (queries.op2_toxicity, queries.op4_language_id, queries.op8_quality_classifier)]

    assert scores(lambda folds, k: F.lit(False)) == scores(lambda folds, k: queries.fold("doc_id", folds) == k)


def test_clashing_columns_are_refused(odd, spark, marks):
    with pytest.raises(ValueError):
        toxicity.score(odd, {"lexicon": {}, "w": np.zeros(toxicity.KINDS), "b": 0.0}, keep=["score"])
    with pytest.raises(ValueError):
        quality.score(odd, quality.fit(odd, marks, F.lit(True)), keep=["Score"])
    with pytest.raises(ValueError):
        mixing.mix(odd, keep=["key"])
    with pytest.raises(ValueError):
        sharding.shard(odd.withColumn("page", F.lit(1)), max_bytes=100, keep=["page"])


@pytest.mark.parametrize("capacity", [256, 1024, 100])
def test_packing_round_trip(spark, odd, none, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = np.random.default_rng(6)
    more = [(50, "éß 漢字 \U0001f600 <|endoftext|> x\r\n\r\n  y")] + [(100 + i, " ".join(draw.choice(["one", "two", "strange", "é"], int(draw.integers(0, 700))))) for i in range(200)]
    d = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    p = packing.pack(d, capacity=capacity).toPandas()
    pieces = 0
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        own = p[p.doc_id == r.doc_id].sort_values("start")
        assert own.doc_tokens.unique().tolist() == [len(ids)] and own.length.sum() == len(ids)
        at = 0
        for x in own.itertuples():
            assert x.start == at and zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes()) == x.ids_crc32
            at += x.length
        pieces += len(ids) // capacity + 1
    for _, s in p.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = s.length.sum()
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and (total == capacity or total < capacity and total & (total - 1) == 0)
    # a document is cut where a bin ends, not more
    assert len(p) < 2 * pieces
    assert packing.pack(none).count() == 0


def test_harmonic_bins():
    """Class k holds k remainders to a bin; a bin's room is topped up by the next documents."""
    bins = packing.Bins(100, 0)
    ids = lambda n: np.zeros(n, "<u4")
    assert bins.add(1, ids(40)) == [] and sorted(bins.open) == [2]
    assert bins.add(2, ids(45)) == [] and len(bins.waiting) == 1 and not bins.open
    rows = bins.add(3, ids(60))
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in rows] == [(1, 0, 40, 0, 0), (2, 0, 45, 0, 40), (3, 0, 15, 0, 85)] and sorted(bins.open) == [2]
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in bins.finish()] == [(3, 15, 32, 1, 0), (3, 47, 8, 2, 0), (3, 55, 4, 3, 0), (3, 59, 1, 4, 0)]


@pytest.mark.parametrize("name", ["op5_packing", "packed"])
def test_packing_query_ids_equal_the_tokenizers_file(name, spark, monkeypatch):
    """Added tokens in a text are their own ids; white space that the fast pattern gives up on is encoded too."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>  \n <|endoftext|", "it<|endoftext|>'s  ", "x" + " " * 1_000_000 + "y <|endoftext|>z"]
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(queries, "documents", lambda *_: d)
    p = (queries.op5_packing(spark, "") if name == "op5_packing" else corpus_pipeline.packed(spark, d, "")).toPandas()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = p[p.doc_id == i].sort_values("start")
        assert own.doc_tokens.unique().tolist() == [len(ids)] and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()


def plain_signature(text):
    """Hashes of the distinct phrases of a plain LZ78 parse, each hashed on its own; the smallest ones."""
    seen, w = set(), ""
    phrases = set()
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            phrases.add(w)
            w = ""
    phrases |= {w} if w else set()
    return sorted({int(fingerprint.phrase_hashes(x, [len(x)])[0]) for x in phrases})[: fingerprint.SIGNATURE]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[: fingerprint.SIGNATURE]
    return sum(x in a and x in b for x in both) / len(both)


def test_fingerprints_equal_a_plain_parse(spark, odd, none):
    draw = np.random.default_rng(4)
    prose = lambda n: " ".join(draw.choice(["the", "cat", "sat", "on", "a", "mat", "é\U0001f600"], n))
    rows = [(5, "abcabcabcab"), (9, "the cat sat on the mat"), (7, ""), (3, None), (1, "é" * 10), (2, "x"), (4, "ab")] + [(20 + i, prose(int(draw.integers(1, 900)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for size in (500, 4):
        monkey = fingerprint.with_next.__defaults__
        fingerprint.with_next.__defaults__ = (size, monkey[1])
        try:
            got = {r.doc_id: r for r in fingerprint.compare_edited(df).collect()}
        finally:
            fingerprint.with_next.__defaults__ = monkey
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            n = len(t)
            edited = t[: n - n // 3] + nxt[: n // 3]
            a, b, c = plain_signature(t), plain_signature(edited), plain_signature(nxt)
            text_of = lambda x: fingerprint.text_of(np.array(x, np.uint64))
            want = (i, n, hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), plain_likeness(a, b), plain_likeness(a, c))
            assert tuple(got[i]) == want
    r = fingerprint.compare_edited(odd)
    assert r.count() == 13 and r.filter("doc_id = 1").select("fingerprint").distinct().count() == 1
    assert fingerprint.compare_edited(none).count() == 0 and fingerprint.fingerprints(odd).count() == 13
    assert fingerprint.compare_edited(df.limit(1)).count() == 1


def test_fingerprint_buckets_part_one_id(spark):
    """An id that repeats with other texts is dealt over buckets by text, and every row has a successor."""
    rows = [(7, f"text number {i} of the same id") for i in range(60)] + [(i, f"t{i}") for i in range(20, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.col("doc_id"), "h": F.xxhash64("text")})
    cuts = fingerprint.cut_points(df.select("key", "h"), 6, 1 << 17)
    pdf = df.toPandas()
    pdf["bucket"] = fingerprint.bucket_of(cuts, pdf.key.to_numpy(), pdf.h.to_numpy())
    assert pdf[pdf.doc_id == 7].bucket.nunique() > 4 and pdf.bucket.value_counts().max() < 20
    by = pdf.sort_values(["key", "h"], ascending=False)
    assert by.bucket.is_monotonic_increasing
    assert fingerprint.compare_edited(df.select("doc_id", "text")).count() == 65


def test_mixing(spark, odd, none):
    m = mixing.mix(odd).toPandas()
    assert len(m) == 13 and (m.taken <= 3 * m["size"]).all() and mixing.mix(none).count() == 0
    per = m.groupby(m.source.fillna("~")).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert ((per.target - per.taken).abs() <= 1).all() and (per.target <= 3 * per.source_size + 1e-6).all()
    again = mixing.mix(odd.repartition(3)).toPandas()
    assert sorted(m.taken) == sorted(again.taken)
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert rows.select(F.sum(mixing.n_words("text"))).first()[0] == m.taken.sum()


def test_quality_learns_from_training_labels_only(spark):
    """Held-out labels, here of one class in great number, change nothing in the model."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and {'# ' * (i % 5)} more. " * (1 + i % 9)) for i in range(60)], "doc_id long, text string")
    y = [(i, int(i % 7 < 4)) for i in range(60)]
    fit = lambda rows: quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"), F.col("_id") < 60)
    a, b = fit(y), fit(y + [(1000 + i, 0) for i in range(5000)])
    assert all(np.array_equal(a[k], b[k]) for k in a)


def plain_features(text):
    """The features of one text by their definitions, a character and a word at a time."""
    low = low_words(text or "")
    if not low:
        return [0.0] * len(quality.FEATURES)
    data = text.encode() + b" "
    n, some = len(text.encode()), len(low)
    count = lambda chars, of=data: sum(c in chars for c in of)
    symbols = b"#*$%&|<>~^_=+\\{}[]@"
    lines = [tuple(sorted(low_words(line))) for line in text.split("\n") if low_words(line)] if "\n" in text else []
    n_lines = max(len(lines), 1)
    return [
        math.log1p(some), sum(c not in b" \n" for c in data) / some / 10, count(string.ascii_uppercase.encode()) / n, count(b"0123456789") / n, count(b"\"'()/:;-") / n,
        count(b"|") / some, sum(a in symbols and b in symbols for a, b in zip(data, data[1:])) / some, count(b".,!?") / some, sum(c >= 128 for c in data) / n,
        len(set(low)) / some, sum(a == b for a, b in zip(low, low[1:])) / some, math.log1p(n_lines) / math.log(math.e + some),
        (len(lines) - len(set(lines))) / n_lines, sum(len(line) == 1 for line in lines) / n_lines, count(symbols) / some,
    ]


def low_words(line):
    return ["".join(c.lower() if c in string.ascii_uppercase else c for c in w) for w in re.findall("[^\\x20\\x09-\\x0D]+", line)]


def test_quality_by_brute_force(spark):
    draw = random.Random(5)
    some = ["Word", "word", "naïve", "a|b", "#*#", "12.5", "(see:", "x", "end.", "語", "word"]
    texts = [" ".join(draw.choice(some) for _ in range(draw.randrange(1, 40))).replace(" x ", "\n") for _ in range(300)] + ["", None, " \n ", "one", "a\na\n\na b\n"]
    x = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts)), x, atol=1e-12)

    # preferences: more distinct words are better, with some labels turned round
    y = [int(r[9] + 0.3 * draw.random() > 0.55) for r in x]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"), F.lit(True))
    y = np.array(y)
    good, bad = x[y == 1], x[y == 0]
    assert np.allclose(model["mean"], np.r_[good, bad].mean(0)) and np.allclose(model["sd"], np.r_[good, bad].std(0) + 1e-6)

    # the loss over every pair, not those drawn, is near the least that Newton's steps find
    d = ((good[:, None] - bad[None]) / model["sd"]).reshape(-1, x.shape[1])
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 5e-4 * w @ w
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), -(d * p[:, None]).mean(0) + 1e-3 * w)
        w = w - step
    assert loss(w) <= loss(model["w"]) <= loss(w) + 0.01

    # the cut errs least of all cuts, and scores are those of the formula
    s = ((x - model["mean"]) / model["sd"]) @ model["w"]
    errors = lambda cut: int(((s >= cut) != (y == 1)).sum())
    assert errors(model["cut"]) == min(errors(c) for c in [*s, s.max() + 1])
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    p = 1 / (1 + np.exp(-np.clip((s - model["cut"]) * model["scale"], -30, 30)))
    assert all(got[i][0] == pytest.approx(v) and got[i][1] == (got[i][0] >= 0.5) for i, v in enumerate(p))


def test_quality(spark, odd, none, marks):
    model = quality.fit(odd, marks, F.lit(True))
    s = quality.score(odd, model, keep=["doc_id", "lang"])
    assert s.count() == 13 and s.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, model, keep=["doc_id"]).count() == 0
    quality.fit(none, marks, F.lit(True))
    good, bad = np.random.default_rng(0).normal(1, 1, (300, 3)), np.random.default_rng(1).normal(0, 1, (300, 3))
    mean, sd, w = quality.rank(good, bad)
    assert (((good - mean) / sd @ w)[:, None] > ((bad - mean) / sd @ w)[None]).mean() > 0.85


@pytest.mark.parametrize("limit", [40, 200_000, 10**9])
def test_sharding(spark, odd, none, limit):
    s = sharding.shard(odd, max_bytes=limit).toPandas()
    assert len(s) == 13
    size = s.groupby(["prefix", "page"]).agg({"doc_bytes": ["sum", "count"]})["doc_bytes"]
    assert (((size["sum"] <= limit) | (size["count"] == 1))).all()
    p = sorted(s.prefix.unique())
    assert not any(b.startswith(a) for a, b in zip(p, p[1:]) if a != b)
    assert sharding.shard(none, max_bytes=limit).count() == 0


def test_small_shards_equal_sql(compare):
    """Buckets split over several passes of twelve bits."""
    from lodestone.llm.common import documents

    rows = compare(lambda s, d: sharding.shard(documents(s, d), max_bytes=3000), queries.op9_sql(3000))
    assert max(r[0] for r in rows if isinstance(r[0], int)) >= 1


def test_licenses(spark, odd, none):
    rows = [(1, "x Under the MIT-license; under the mit license"), (2, "CC BY NC, and the Apache License, Version 2.0"), (3, "Licensed under the GNU general public (license) version 3"), (4, "licensed under the big gnu general public license version 3"), (5, None), (6, "apache license"), (7, "under the mit"), (7, "cc by nc"), (2, "CC BY NC, and the Apache License, Version 2.0")]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels))
    assert got[1] == [(9, 2, 1, 5, "mit", "mit")] and got[2] == [(10, 2, 0, 5, "apache-2,cc-by-nc", "apache-2,cc-by-nc")] * 2
    assert got[3][0][4:] == ("", "gpl-3") and got[4][0][4:] == ("", "gpl-3") and got[5] == [(0, 0, None, None, "", "")] and got[6][0][4:] == ("", "")
    assert sorted(got[7]) == [(3, 0, None, None, "", ""), (3, 1, 0, 0, "cc-by-nc", "cc-by-nc")]
    assert licenses.scan(odd).count() == 13 and licenses.scan(none).count() == 0


def test_pipeline(spark, odd, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns, name
        after = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        if name == "quality":
            good = {i for i, _ in before if y.get(i) == 1}
            assert len(good & {i for i, _ in after}) >= 0.95 * len(good)
        if name == "near duplicates":
            want = {c for _, _, c in brute_components(before)}
            assert {i for i, _ in after} == want and len(after) == len(want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    for frame in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).count()


def test_quality_learns_from_every_label(spark):
    """13,000 good documents, of which those by hash among the last thousands are told by digits: all of them count."""
    n = 13_000
    ids = spark.range(n).select(F.col("id").alias("doc_id"), (F.row_number().over(Window.orderBy(F.xxhash64("id"))) - 1).alias("at"))
    rows = materialised(ids.select("doc_id", "at", F.when(F.col("at") >= 12_000, "7 7 7").otherwise("plain words here").alias("text")))
    y = rows.select("doc_id", F.lit(1).alias("quality")).unionByName(spark.range(n, n + 500).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality")))
    docs = rows.select("doc_id", "text").unionByName(spark.range(n, n + 500).select(F.col("id").alias("doc_id"), F.lit("| | |").alias("text")))
    model = quality.fit(docs, y, F.lit(True))
    every = np.concatenate([np.tile(quality.features(pa.array([t])), (k, 1)) for t, k in (("plain words here", 12_000), ("7 7 7", 1000), ("| | |", 500))])
    assert np.allclose(model["mean"], every.mean(0)) and np.allclose(model["sd"], every.std(0) + 1e-6)
    assert model["quantile"] == pytest.approx(500 / 13_500)
    assert {r.text: r.predicted for r in quality.score(docs.dropDuplicates(["text"]), model, keep=["text"]).collect()} == {"plain words here": 1, "7 7 7": 1, "| | |": 0}


def test_quality_cut_beyond_the_last_score(spark):
    """Where turning down all errs least, the cut is above every score; ties are not cut apart."""
    of = lambda rows: quality.best_cut(spark.createDataFrame(rows, "s double, y int"))
    assert of([(0.1, 0), (0.2, 0), (0.2, 1), (0.3, 0)])[0] > 0.3
    assert of([(0.1, 0), (0.2, 0), (0.2, 1), (0.2, 1), (0.4, 1)]) == (pytest.approx(0.15), 0.2)
    assert of([(0.1, 1), (0.2, 0), (0.2, 1)]) == (0.1, 0.0)
