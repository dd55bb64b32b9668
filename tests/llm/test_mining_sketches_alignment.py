"""Hard negatives, bottom-k near duplicates and cross-tokenizer alignment: against brute force; edge cases."""

import hashlib
import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import SF  # noqa: E402

from lodestone.llm import bottom_k, crosstok, hard_negatives, langid, ngram_join, queries, toxicity  # noqa: E402

P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


# ---- hard negatives ----


def brute_negatives(rows, divisor, scale=256, k=5, m=5):
    """Rows (id, vector, label), any of them null; repeats of a row count once."""
    good = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (i, lab, tuple(math.floor(scale * x) for x in v))
        if one not in good:
            good.append(one)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for a in good:
        if a[0] is None or a[0] % divisor:
            continue
        scored = sorted(((-dot(a[2], b[2]), last(b[0]), b) for b in good if b is not a), key=lambda x: x[:2])
        for ps, _, p in [s for s in scored if s[2][1] == a[1]][:k]:
            fit = [s for s in scored if s[2][1] != a[1] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:m]
            out += [(a[0], p[0], r + 1, n[0], -ps, -ns) for r, (ns, _, n) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, divisor, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({"score": F.lit("x"), "rank": F.lit(1), "id": F.lit(7), "x": F.lit(1), "v": F.lit(2)})
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("id") % divisor == 0, **kw).collect()), key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(0.05, 0.2, 6).astype(np.float32)], int(i % 3)) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.125], i % 2) for i in range(40)]  # ties
    rows += [(300, None, 1), (301, [0.1, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 0), (304, [0.1] * 6, None), (None, [0.5, 0.25, 0.0, 0.0, 0.0, 0.125], 0), (0, [], 0), (310, [0.5], 1)]
    rows += [rows[20], rows[20], rows[160]]  # repeated rows
    want = brute_negatives(rows, 10)
    assert len(want) > 200 and mined(spark, rows, 10) == want
    # many tiles, small batches
    for name, value in (("ANCHORS", 4), ("ROW_GROUPS", 3), ("BATCH", 7), ("BLOCK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows, 10) == want


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 1), (10, [2.0], 2)], 10) == []  # no positives
    assert mined(spark, [(0, [1.0], 1), (10, [2.0], 1)], 10) == []  # no negatives
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9, 1e9], 1)], 10)


def test_residues_give_exact_scores():
    draw = np.random.default_rng(5)
    for most in (3, 300, 50_000, 9_000_000):
        a, b = (draw.integers(-most, most + 1, (20, 200)) for _ in range(2))
        primes = hard_negatives.primes_for(200 * most * most)
        assert (hard_negatives.Anchors(a, primes).scores(b, slice(0, 20)) == a @ b.T).all()


# ---- bottom-k near duplicates ----


def shingles(text, n=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows):
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
    return sorted(((i, len(s), least[find(k)], i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "cls", "component", "rep")})
    return sorted((tuple(r) for r in bottom_k.groups(df).collect()), key=str)


def near_copies(n, words, edits, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"v{k}" for k in range(words)]
        for k in draw.integers(0, words, size=draw.integers(0, edits)):
            w[k] = f"u{draw.integers(1000)}"
        rows.append((i, " ".join(w)))
    return rows


ODD = [(900, P), (900, P), (901, P + " more"), (902, None), (903, ""), (904, " \t\n "), (None, P), (905, "one two"), (906, "ONE\ttwo"), (907, "one"), (908, "one two three four five"), (909, "one two three four five six"), (900, "other words than these here"), (910, " ".join(f"w{k % 977}" for k in range(9000)))]


def test_bottom_k_equals_brute_force(spark, monkeypatch):
    rows = near_copies(150, 80, 14, 3) + ODD
    want = brute_groups(rows)
    assert 5 < len({r[2] for r in want if r[0] is not None and r[0] < 150}) < 140
    assert grouped(spark, rows) == want
    # lists of over four classes: divided by second keys and slots, then by second and third shared values, then by parts
    monkeypatch.setattr(bottom_k, "BLOCK", 4)
    assert grouped(spark, rows) == want


def test_lists_alone_lose_no_link(spark, monkeypatch):
    rows = near_copies(70, 60, 10, 8) + ODD
    real = bottom_k.blocks
    monkeypatch.setattr(bottom_k, "blocks", lambda c, n: real(c, n).limit(0))
    want = brute_groups(rows)
    assert grouped(spark, rows) == want
    monkeypatch.setattr(bottom_k, "BLOCK", 8)
    assert grouped(spark, rows) == want


def test_bottom_k_of_nothing(spark):
    assert grouped(spark, []) == []
    assert grouped(spark, [(1, None), (None, " ")]) == [(1, 0, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5])
def test_texts_of_one_id_are_fetched_once_each(spark, monkeypatch, ids):
    """Near copies under one id or none: rows of texts are as many as rows of members."""
    rows = [(ids(i), t) for i, t in near_copies(400, 60, 5, 4)]
    seen = []
    real = ngram_join.text_slices
    linked = ngram_join.joined_blocks

    def counted(docs, classes, members, *a, **kw):
        out = linked(docs, classes, members, *a, **kw)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "own_hash" in plan and "text_hash" in plan
        d = docs.select("doc_id", F.xxhash64("text").alias("own_hash"))
        wanted = members.join(classes.select("cls", "text_id", "text_hash"), "cls")
        seen.append((members.count(), d.join(wanted, d["doc_id"].eqNullSafe(wanted["text_id"]) & (d["own_hash"] == wanted["text_hash"])).select("cls", "block").distinct().count()))
        return out

    monkeypatch.setattr(ngram_join, "joined_blocks", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(df)
    assert real is ngram_join.text_slices and got.count() == 400 and seen and all(a == b for a, b in seen)


# ---- alignment ----


ODD_TEXTS = [None, "", " ", "  two  spaces ", "<|endoftext|> <s> x</s>", "▁ a", "ﬁ ligature ½ ①", "日本語 のテキスト a b", "a\nb\n\n c\t d", "é è ü Straße Ünder", " don't  I'll 'tis", "x" * 3000, " " * 2000, "🙂🙃 emoji 👩‍👩‍👧 a", "Áb ć d é", "<0x41> a", "\r\n win\r\nlines", "\x1c a \x85 b   c 　 d", "word, (and) word. And; word!"]


@pytest.fixture(scope="module")
def aligned_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return [(k % 70 if k != 3 else None, t) for k, t in enumerate(ODD_TEXTS + texts + texts[:3])]


@pytest.fixture(scope="module")
def alignments(aligned_texts):
    """Of each text the ids of A and B and its groups, by the whole-text tokenizers and a loop over byte offsets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(k):
        p = b_model.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], []
        a, b, out = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text), []
        bytes_a, bytes_b = [bytes(code[c] for c in a_model.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], []
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
        i = j = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((tuple(a[i:p]), tuple(b[j:q])))
            i, j = p, q
        return a, b, out

    return [(i, *one(t)) for i, t in aligned_texts]


def test_alignment_equals_brute_force(spark, aligned_texts, alignments):
    links = Counter((x[-1], y[-1]) for *_, g in alignments for x, y in g)
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    want = []
    for i, a, b, g in alignments:
        pairs = [(x[-1], y[-1]) for x, y in g]
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want.append((i, len(a), len(b), len(g), len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(spelt.encode()).hexdigest() if g else ""))
    df = spark.createDataFrame(aligned_texts, "doc_id long, text string").withColumns({"row": F.lit(1), "links": F.lit("x"), "n_a": F.lit(2)}).repartition(3)
    assert sum(not w[1] for w in want) == 3
    for most in (crosstok.MOST_PAIRS, 300, 0):  # the rest of the counts is joined
        got = [tuple(r) for r in crosstok.align(df, most_pairs=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert crosstok.align(df.limit(0)).count() == 0


def test_groups_cut_both_token_lists(spark, aligned_texts, alignments):
    by = [(k, t) for k, (_, t) in enumerate(aligned_texts)]
    got = defaultdict(list)
    for r in crosstok.groups(spark.createDataFrame(by, "doc_id long, text string")).orderBy("doc_id", "group").collect():
        got[r.doc_id].append(r)
    for k, (_, a, b, g) in enumerate(alignments):
        assert [(tuple(a[r.a_start : r.a_stop]), tuple(b[r.b_start : r.b_stop])) for r in got[k]] == g
        assert [r.byte_start for r in got[k]] == [0, *[r.byte_stop for r in got[k]]][: len(got[k])]
        assert not g or got[k][-1].byte_stop == len((" " + by[k][1]).encode())


def test_a_task_forgets_parts(monkeypatch, aligned_texts, alignments):
    monkeypatch.setattr(crosstok, "MOST_PARTS", 5)
    t = crosstok.Tokenizers(*crosstok.default_vocabularies())
    for (_, text), (_, a, b, _) in zip(aligned_texts, alignments):
        x = crosstok.Alignment([text], t)
        assert x.ids[0].tolist() == a and x.ids[1].tolist() == b


def test_gallop_finds_first_places():
    draw = np.random.default_rng(2)
    for n in (1, 2, 10, 1000):
        long = np.unique(draw.integers(0, 3 * n, n))
        short = np.unique(draw.integers(0, 3 * n + 5, n))
        m = len(short)
        for guess in (np.zeros(m, int), np.full(m, len(long) - 1), draw.integers(0, len(long), m)):
            assert (crosstok.gallop(short, long, np.zeros(m, int), np.full(m, len(long)), guess) == np.searchsorted(long, short)).all()


# ---- small languages, and clauses that are denied or told ----


def test_small_languages_keep_their_grams(spark):
    """Two languages of 2,000 texts and two of 40 under small budgets: told apart, not rejected, mass kept."""
    letters = [chr(97 + k) for k in range(26)]
    draw, words = np.random.default_rng(1), {}
    for k, x in enumerate(("big1", "big2", "tiny1", "tiny2")):
        own = np.random.default_rng(k)
        w = own.dirichlet(np.ones(26) * 0.5)
        words[x] = ["".join(own.choice(letters, p=w, size=own.integers(3, 9))) for _ in range(900)]
    say = lambda x, n: " ".join(draw.choice(words[x], n))
    train = spark.createDataFrame([(x, say(x, 60)) for x in words for _ in range(40 if x[0] == "t" else 2000)], "lang string, text string")
    test = spark.createDataFrame([(x, say(x, 40)) for x in words for _ in range(60)], "lang string, text string")
    for most in (4000, 1500):
        model = langid.fit(train, F.lit(True), most_grams=most)
        assert all(len(k) <= most for k, _ in model["grams"])
        r = langid.predict(test, model, keep=["lang"]).toPandas()
        assert (r.lang == r.lang_pred).mean() >= 0.95 and (r.rejected.groupby(r.lang).mean() < 0.05).all()
        symbols = np.r_[0, np.arange(97, 123)]
        for context in ("tha", "ing", "aaa", "qzx", "ban"):
            before = [np.full(27, ord(c)) for c in reversed(context)]
            total = np.exp(langid.log_probabilities(model, [symbols, *before])).sum(0)
            assert np.all(np.abs(total - 1) < 0.02)


def test_grams_beyond_the_budget_count_too(spark, monkeypatch):
    """Models of more grams than are shipped predict as those of all grams do, also where texts repeat or have no letter."""
    draw = np.random.default_rng(5)
    words = {x: ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), p=draw.dirichlet(np.ones(26) * 0.5), size=draw.integers(3, 9))) for _ in range(300)] for x in ("a", "b", "c")}
    say = lambda x, n: " ".join(draw.choice(words[x], n))
    train = spark.createDataFrame([(x, say(x, 30)) for x in words for _ in range(60)], "lang string, text string")
    rows = [(x, say(x, 20) + " qzxj wvkq") for x in words for _ in range(20)]
    rows = [(k, *r) for k, r in enumerate([*rows, rows[0], ("n", None), ("n", "12 !"), ("n", " ".join("".join(draw.choice(list("qwxzjkvy"), 7)) for _ in range(20)))])]
    test = spark.createDataFrame(rows, "id int, lang string, text string")
    every = langid.predict(test, langid.fit(train, F.lit(True)), keep=["id"]).toPandas().sort_values("id")
    for most, cells in ((300, 1 << 22), (1500, 0)):
        monkeypatch.setattr(langid, "CELLS", cells)
        model = langid.fit(train, F.lit(True), most_grams=most, whole=True)
        r = langid.predict(test, model, keep=["id"]).toPandas().sort_values("id")
        assert (r.id.to_numpy() == every.id.to_numpy()).all() and (r.lang_pred.to_numpy() == every.lang_pred.to_numpy()).all() and (r.rejected.to_numpy() == every.rejected.to_numpy()).all()
        assert np.allclose(r.cross_entropy, every.cross_entropy, atol=1e-4) and np.allclose(r.score, every.score, atol=1e-3)


def test_budgets_leave_to_others_what_is_not_needed():
    assert langid.budgets({"a": 10, "b": 1000, "c": 2000}, 500) == {"a": 10, "b": 245, "c": 245}
    assert langid.budgets({"a": 1, "b": 2}, 500) == {"a": 1, "b": 2}


def test_denied_and_told_insults_never_add(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, queries.fold("_id", 5) != 0)
    quoted = ["This is not idiot talk. We do not say scum here. It was never trash at all.", "he said you are not an idiot. " * 5, "she wrote you are an idiot. " * 20, "I don't think idiot.", "You aren’t an idiot. It wasn't scum.", "hello world", ""]
    meant = ["you are an idiot. you are scum.", "You idiot!"]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(quoted + meant)), "k int, text string"), model, keep=["k"]).orderBy("k").collect()
    assert [r.predicted for r in rows] == [0] * len(quoted) + [1] * len(meant)
    assert (model["w"][~toxicity.ASSERTED] <= 0).all() and (model["w"][toxicity.ASSERTED] > 0).all()
    # by hand: weights of matched clauses by kind, then a logistic function
    want = [1 / (1 + math.exp(-float(np.log1p(toxicity.matches(t, model["lexicon"])) @ model["w"] + model["b"]))) for t in quoted + meant]
    assert np.allclose([r.score for r in rows], want)


def test_all_classes_of_a_large_list_meet(spark, monkeypatch):
    """Ten classes of one list, ten components, and nothing that follows in their sketches in common: each pair is in a block."""
    import inspect
    from itertools import combinations

    from lodestone.llm import bottom_k

    monkeypatch.setattr(bottom_k, "BLOCK", 4)
    lists = spark.createDataFrame([(7, c, 0) for c in range(10)], "value long, cls long, rank int")
    classes = spark.createDataFrame([(c, [100 * c + k for k in range(70)]) for c in range(10)], "cls long, sketch array<long>")
    comp = spark.createDataFrame([], "node long, component long")
    some = (lists, classes, comp) if "classes" in inspect.signature(bottom_k.late_blocks).parameters else (lists, comp)
    of = {}
    for r in bottom_k.late_blocks(*some).collect():
        of.setdefault(r.block, set()).add(r.cls)
    assert {p for b in of.values() for p in combinations(sorted(b), 2)} == set(combinations(range(10), 2))
    assert max(map(len, of.values())) <= 3 * 4


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    """A path and two stars, with many shuffle partitions: the same components with broadcast labels and without, by far fewer tasks."""
    from lodestone.llm import components as c

    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 110)] + [(209, k) for k in range(200, 209)]
    want = {k: 0 for k in range(21)} | {k: 100 for k in range(100, 110)} | {k: 200 for k in range(200, 210)}
    df = spark.createDataFrame(edges, "a long, b long")

    def tasks():
        jvm, arr = spark._jvm, spark._jvm.java.util.ArrayList
        stages = spark._jsc.sc().statusStore().stageList(arr(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), arr())
        return sum(stages.apply(k).numCompleteTasks() for k in range(stages.size()))

    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    took = []
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for few in (100_000, -1):
            monkeypatch.setattr(c, "FEW_EDGES", few)
            start = tasks()
            assert {r.node: r.component for r in c.components(df).collect()} == want
            took.append(tasks() - start)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert 2 * took[0] < took[1]
