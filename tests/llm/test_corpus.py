"""Joins, searches, models, line dedup, chat windows and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from linefate.llm import chat_format, jaccard_join, language_id, line_dedup, topk_search, toxicity
from linefate.llm.common import scratch
from linefate.llm.components import components

SF = "/root/testdata/sf0.01"


def joined_by_hand(docs, percent=80):
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(docs):
        least[root(i)] += [] if name is None else [name]
    return sorted(((str(name), len(s), str(min(least[root(i)], default=None) if s else name)) for i, ((name, _), s) in enumerate(zip(docs, sets, strict=True))))


@pytest.mark.parametrize("kind", ["chains", "hot", "odd"])
def test_jaccard_join(spark, odd, kind, monkeypatch):
    rng = random.Random(len(kind))
    if kind == "odd":
        docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
        df = odd
    else:
        monkeypatch.setattr(jaccard_join, "GROUP", 8)
        docs = []
        letters = "abcdefgh" if kind == "chains" else [f"w{i}" for i in range(200)]
        base = [rng.choice(letters) for _ in range(60)]
        for i in range(120):
            if kind == "hot" and i % 3:
                w = list(base)
                for _ in range(rng.randint(0, 2)):
                    w[rng.randrange(60)] = rng.choice(letters)
            elif i % 3 and docs:
                w = (rng.choice(docs)[1] or "x").split()
                for _ in range(rng.randint(0, 3)):
                    w.insert(rng.randrange(len(w) + 1), rng.choice(letters))
            else:
                w = [rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 5, 10, 40, 90]))] + (base[:12] if kind == "hot" else [])
            docs.append((i, " ".join(w)))
        df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(df).collect())
    assert got == joined_by_hand(docs)


def test_tree_overlaps():
    rng = np.random.default_rng(1)
    probe = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
    sets = [np.unique(rng.choice(np.concatenate((probe, rng.integers(60, 70, 5).astype(np.uint64))), rng.integers(1, 40))) for _ in range(300)]
    for percent in (50, 80, 95):
        want = [k if 100 * (k := len(np.intersect1d(s, probe))) >= percent * len(np.union1d(s, probe)) else -1 for s in sets]
        assert jaccard_join.tree_overlaps(probe, sets, percent) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(30)] + [(7, 7), (None, 3)]
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {x: root(x) for a, b in links if a is not None and a != b for x in (a, b)}
    assert {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    found = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert [found[i].lang_pred for i in (70, 71, 74)] == ["und"] * 3 and found[70].score == 0
    assert language_id.identify(nothing).count() == 0


def test_phrases_are_longest_matches():
    text = " the cat sat on the mat "
    steps = language_id.automaton(text, 1)
    for run in ("the", "cats", "zzz", "mat"):
        whole, at, n = f" {run} ", 0, 0
        while at < len(whole):
            size = next((k for k in range(len(whole) - at, 0, -1) if whole[at : at + k] in text), 1)
            at, n = at + size, n + 1
        assert language_id.phrases(run, steps) == n


def test_toxicity(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    ranks = sorted(held, key=lambda r: r.score)
    bad = [i for i, r in enumerate(ranks) if r.toxic]
    auc = (sum(bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * (len(held) - len(bad)))
    assert auc > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    own = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert toxicity.classify(odd, own).count() == odd.count()
    assert toxicity.classify(odd, own.where("false")).count() == odd.count()
    assert toxicity.classify(nothing, own).count() == 0


def nearest_by_hand(rows, every=50, k=5):
    kept = [(i, np.floor(256 * np.array(e, dtype=np.float64)).astype(np.int64)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    ids, x, out = np.array([i for i, _ in kept]), np.array([v for _, v in kept]), []
    for i, v in kept:
        if i % every == 0:
            score = x @ v
            out += [(i, r + 1, int(ids[j]), int(score[j])) for r, j in enumerate([j for j in np.lexsort((ids, -score)) if ids[j] != i][:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4) / 256]) for i in range(300)] + [(i, [0.25, 0.25, 0.0, 0.0]) for i in range(300, 800)]
    rows += [(900, None), (950, [1.0, None, 0.0, 0.0]), (1000, [float("nan"), 0.0, 0.0, 0.0]), (None, [0.0] * 4), (50, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", rng_column(spark))
    assert sorted(map(tuple, topk_search.top_k(df).collect())) == nearest_by_hand([(r.vec_id, r.embedding) for r in df.collect()])
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk_search.top_k(few).collect())) == nearest_by_hand([(r.vec_id, r.embedding) for r in few.collect()])
    assert topk_search.top_k(df.where("false")).count() == 0


def rng_column(spark):
    from pyspark.sql import functions as F

    return F.lit(1)


def test_line_dedup(spark, odd, nothing):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("abcdefghij") for _ in range(8))
    shared, copied = "All rights reserved.", [line() for _ in range(4)]
    rows = [(i, "\n".join([line(), shared if i % 2 else line(), "", line()]), f"s{i % 9}") for i in range(40)]
    rows += [(100 + i, "\n".join([*copied, line()]), f"s{i % 9}") for i in range(20)] + [(200, None, "s1"), (201, "", None), (None, shared, "s2"), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.report(df).collect()
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(line_dedup.SQL).fetchall()))
    lost = {r.doc_id: r.n_removed for r in got}
    assert lost[1] == 0 and lost[5] == 1 and all(lost[100 + i] == 0 for i in range(20)), "the first keeps it; copies are left to the joins"
    assert line_dedup.dedup(odd).columns == odd.columns and line_dedup.report(odd).count() == odd.count()
    assert line_dedup.report(nothing).count() == 0


def removed_lines(spark, rows):
    """Lines of each document that dedup takes away."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(df).collect()}
    return {i: set(text.split("\n")) - set(left.get(i, [])) for i, text, _ in rows}


def test_copies_hide_no_boilerplate(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefghij") for _ in range(8))
    copied = [line() for _ in range(8)]
    rows = [(i, "\n".join([line(), "Stock.", line()]), f"s{i}") for i in range(8)]
    rows += [(100 + i, "\n".join([*copied, "Stock.", line()]), f"s{i % 9}") for i in range(40)]
    gone = removed_lines(spark, rows)
    assert all(gone[i] == ({"Stock."} if i else set()) for i in range(8))
    assert all(gone[100 + i] == {"Stock."} for i in range(40)), "copies lose the stock line and nothing else"


def test_blocks_do_not_protect_themselves(spark):
    rng = random.Random(6)
    line = lambda n=8: " ".join(rng.choice("abcdefghij") for _ in range(n))
    block = [f"License line {k}" for k in range(9)]
    rows = [(i, "\n".join([*block, *[line(20) for _ in range(2)]]), f"s{i % 9}") for i in range(30)]
    rows += [(100 + i, "\n".join(["On four sources.", line(20)]), f"s{i}") for i in range(4)]
    gone = removed_lines(spark, rows)
    assert gone[0] == set() and all(gone[i] == set(block) for i in range(1, 30)) and all(gone[100 + i] == set() for i in range(4))


def test_chat_windows(spark):
    rng = random.Random(1)
    texts = [None, "", "\\", "<|", "\\<|", "<\\|", "<\\\\|", "a\n" * 2000, "é" * 9000, "<|im_start|>assistant\nx<|im_end|>\n"]
    rows = [(rng.choice([1, 2, None]), rng.choice([0, 1, 2, None, 5]), rng.choice(["user", "assistant", "system", None, "a%0A\n<|x"]), rng.choice(texts)) for _ in range(60)]
    rows += [(9, 0, "system", "be kind")] + [(9, i, "assistant" if i % 2 else "user", "word " * 150) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = chat_format.windows(df)
    got = {r.conv_id: r for r in chat_format.digests(held).collect()}
    for key in (1, 2, None, 9):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-1 if r[1] is None else r[1], (r[2] or "").encode(), (r[3] or "").encode()))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[key].n_turns == len(own)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    nine = held.where("conv_id = 9").orderBy("window").collect()
    assert len(nine) > 3 and all(r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in nine)
    assert all(r.n_repeated >= 2 for r in nine[1:]) and all(len(r.text) <= 4 * chat_format.BUDGET for r in nine)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(map(str, map(tuple, chat_format.digests(chat_format.windows(chat_format.with_hostile(df))).collect()))) == sorted(map(str, con.sql(chat_format.SQL).fetchall()))
    assert chat_format.digests(chat_format.windows(df.where("false"))).count() == 0


def test_chat_windows_keep_the_budget(spark):
    rng = random.Random(8)
    tokens = lambda text: -(-len(text) // 4)
    rows = []
    for conv in range(40):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "s" * rng.choice([10, 3000, 7000])))
        rows += [(conv, i, rng.choice(["user", "assistant"]), "x" * rng.choice([4, 700, 2800, 6000, 7900, 20_000])) for i in range(1, rng.choice([2, 5, 25]))]
    rows += [(90, 1, "user", "x" * 2900), (90, 2, "assistant", "y" * 8000), (91, 0, "user", "x" * 3000), (91, 1, "assistant", "y" * 4900)]
    held = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    windows = defaultdict(list)
    for r in held:
        turns = ["<|im_start|>" + x for x in r.text.split("<|im_start|>")[1:]]
        windows[r.conv_id].append((r.window, [tokens(x) for x in turns], r.n_repeated, turns[0].startswith("<|im_start|>system")))
    for own in windows.values():
        for _, sizes, repeated, has_system in own:
            if sum(sizes) > chat_format.BUDGET:
                assert len(sizes) == 1 + has_system and repeated <= has_system and sizes[-1] + has_system * sizes[0] > chat_format.BUDGET, "only a turn that fits nowhere exceeds it"
    assert len(windows[90]) == 2 and len(windows[91]) == 1, "what fits whole stays whole"
    given = spark.createDataFrame([(1, i, "user", "a", 1500) for i in range(4)], "conv_id long, turn long, role string, text string, cost long")
    assert chat_format.windows(given, tokens="cost").count() == 4


def test_scores_know_nothing_of_other_texts():
    learned = {"idiot": 3.0, "idio*": 2.0}
    texts = ["x" * 50 + " " + "x" * 50 + " idiot you", "z" * 60 + " fine " + "z" * 60, "you idiot", "", "q" * 49 + " ID1OT " + "q" * 49 + " " + "r" * 49]
    alone = [toxicity.Features(learned)(pa.array([t]))[0].tolist() for t in texts]
    assert alone[0][1] == 0.25
    rng, shared = random.Random(1), toxicity.Features(learned)
    for _ in range(20):
        order = [rng.randrange(len(texts)) for _ in range(rng.randint(1, 8))]
        assert shared(pa.array([texts[k] for k in order])).tolist() == [alone[k] for k in order]


def test_trees_and_isotonic_step_by_hand():
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    y = (x[:, 1] + rng.normal(0, 0.2, 300) > 0.6).astype(float)
    one = toxicity.Trees(rounds=1, depth=1, rate=1.0).fit(x, y)
    p = y.mean()
    grad, hess = p - y, np.full(300, p * (1 - p))
    gain = {(f, c): sum(grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (x[:, f] <= c, x[:, f] > c)) for f in range(3) for c in one.cuts[f] if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) * p * (1 - p) >= 2}
    f, c = max(gain, key=gain.get)
    assert one.trees[0][1][0] == f and one.cuts[f][one.trees[0][1][1]] == c
    side = x[:, f] <= c
    want = np.where(side, -grad[side].sum() / (hess[side].sum() + 1), -grad[~side].sum() / (hess[~side].sum() + 1)) + np.log(p / (1 - p))
    assert np.allclose(one.margin(x), want)
    margin, weight = np.arange(30.0), rng.random(30) + 0.1
    label = rng.integers(0, 2, 30).astype(float)
    knots, values = toxicity.isotonic(margin, label, weight)
    # the least-squares monotone fit at i is the greatest, over beginnings, of the least mean over ends
    mean = lambda a, b: (label[a:b] * weight[a:b]).sum() / weight[a:b].sum()
    fit = [max(min(mean(a, b) for b in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)]
    assert np.all(np.diff(values) > 0) and np.allclose(sorted({round(v, 9) for v in fit}), np.round(values, 9))


def test_languages_by_hand(spark):
    automata = language_id.learn({"aa": ["banana bandana ananas"], "bb": ["xyz zyx xxyyzz yzx"], "cc": ["noon moon onno moon"]})
    parser = language_id.CrossParser(automata)

    def parsed(text, steps):
        n = 0
        for run in re.findall("[a-z]+", text):
            whole, at = f" {run} ", 0
            while at < len(whole):
                state, size = 0, 0
                while at + size < len(whole) and (state << 21 | ord(whole[at + size])) in steps:
                    state, size = steps[state << 21 | ord(whole[at + size])], size + 1
                at, n = at + max(1, size), n + 1
        return n

    for text in ("banana nanas", "zyxxy", "moon noon banana", "q", "aaa xyz noon"):
        want = {name: parsed(text, steps) for name, steps in automata.items()}
        assert parser.predict(text)[0] == min(want, key=lambda name: (want[name], name))
    assert [parser.predict(t) for t in ("½ ² ① Ⅷ 12 _", "", "...")] == [("und", 0.0)] * 3
    many = [(i, "".join(rng.choice(letters) for _ in range(200)), f"l{i % 70}") for rng in [random.Random(2)] for letters in ["abcdefgh"] for i in range(700)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    held = language_id._load(language_id.fit(df, scratch(spark, "languages")))
    assert held.names == sorted({x for _, _, x in many}), "every label is learned"


def test_trie_pairs_lose_no_link():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(40):
        base = rng.choice(5000, 120, replace=False)
        sets = []
        for _ in range(30):
            own = base[rng.random(120) > rng.choice([0.0, 0.05, 0.11, 0.2])]
            sets.append(np.unique(np.concatenate((own, 5000 + rng.integers(0, 10**6, rng.integers(0, 16))))) + 1)
        n = np.array([len(s) for s in sets])
        heads = [s[:k] for s, k in zip(sets, jaccard_join.prefix_length(n, 80), strict=True)]
        times = defaultdict(int)
        for h in heads:
            for t in h.tolist():
                times[t] += 1
        rows = []
        for i, h in enumerate(heads):
            common = [(k, t) for k, t in enumerate(h.tolist()) if times[t] > 1]
            for k, (pos, t) in enumerate(common):
                pad = lambda x, size: (list(x) + [0] * size)[:size]
                rows.append((t, pad([y for _, y in common[k + 1 :]], 3), pad([y for _, y in common[max(0, k - 2) : k]], 2), n[i], len(common) - k - 1, pos, i, i))
        gram, tokens, before, *rest = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        a, b = jaccard_join.trie_pairs(gram, tokens, before, *rest, 80)
        found = {tuple(sorted(p)) for p in zip(rest[-1][a].tolist(), rest[-1][b].tolist(), strict=True)}
        links = {(i, j) for j in range(30) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
        lost += len(links - found)
    assert lost == 0


def test_nul_is_part_of_a_word(spark):
    rows = [(1, "a b\0c d e f"), (2, "a b c d e f"), (3, "A b\0c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1)}


def test_pipeline(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "the und der you idiot a x1 the und der you a a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, start in enumerate((odd, nothing)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{k}/{name}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.schema(docs.schema).parquet(out) if name != "byte_bpe" else spark.read.parquet(out)
            if name != "byte_bpe":
                assert docs.columns == start.columns
        assert (docs.count() > 0) == (k == 0)
    small = SF.replace("sf0.01", "sf0.001")
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    rows = corpus_pipeline.run(spark, small).collect()
    assert 0.8 * n < len(rows) < n and len({r.doc_id for r in rows}) == len(rows)


def test_texts_that_stay_are_not_moved(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(30)]  # copies
    rows += [(7, texts[7]), (8, texts[599]), (None, "no id, but words"), (None, texts[3]), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, plain = [], corpus_pipeline.by_bits
    monkeypatch.setattr(corpus_pipeline, "by_bits", lambda docs, bits, member: met.append((member, found := plain(docs, bits, member))) or found)
    got = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    decided = {(name, least) for name, _, least in joined_by_hand(rows)}
    kept = {name for name, least in decided if name == least}
    assert sorted(map(str, got)) == sorted(map(str, docs.where(docs.doc_id.isNull() | docs.doc_id.cast("string").isin(list(kept))).distinct().collect()))
    moved = sum(found.count() for member, found in met if member)
    assert 30 <= moved <= 0.2 * len(rows) and sum(found.count() for _, found in met) == len(rows)


def test_runs_side_by_side_parse_as_each_alone():
    rng = random.Random(6)
    letters = "abcdeéß你好ΣİǅE½1'-_٣"
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    automata = language_id.learn({name: [" ".join(word(7) for _ in range(300))] for name in ("x", "y", "z")}) | {"none": {}}
    texts = ["".join(word(12) + rng.choice(" \n\t ") for _ in range(rng.choice([0, 1, 40]))) for _ in range(200)]
    texts += [word(400) for _ in range(20)] + ["", "½ 1", "ab" * 3000, "𐐀a𐐁 Ж", "ΑΣ ΑΣ. İ"]
    want = []
    for text in texts:
        runs = [run for piece in text.split() for run in language_id.LETTERS.findall(piece.lower())]
        want.append([sum(language_id.phrases(run, automata[name]) for run in runs) for name in sorted(automata)] + [sum(len(run) + 2 for run in runs)])
    for kept in (10, 10**6):
        parser = language_id.CrossParser(automata, kept)
        got = [row for i in range(0, len(texts), 30) for row in parser.counts(texts[i : i + 30]).tolist()]
        assert got == want and parser.counts(texts).tolist() == want
        assert all(len(piece) <= language_id.KEPT_LENGTH for piece in parser.known)
    none = language_id.CrossParser({})
    assert none.predictions(["a b", ""]) == [("und", 0.0)] * 2
