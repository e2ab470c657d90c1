"""Lexers, alignment, moves, comparison and identities."""

import glob
import itertools
import os
import random
import subprocess

import pytest
from linefate.functions import lexers, text
from linefate.functions.lexers import normalize
from linefate.operators import compare, history, hunks, lineage, moves
from linefate.operators.hunks import Line
from linefate.sources import fixtures, git, snapshots
from linefate.streaming import record
from pyspark.sql import functions as F

HERE = os.path.dirname(__file__)
#: A folder with further labelled definitions, if there is one.
MORE = sorted(glob.glob(os.path.join(os.environ["LABELLED_CORPUS"], "*.py"))) if os.environ.get("LABELLED_CORPUS") else []
LABELLED = [(f["class"], f["language"], f) for path in [f"{HERE}/labelled/own.txt", *MORE] for f in fixtures.definitions(path)]
LANGUAGE = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript"}


def line(words, number=1, kind="code"):
    tokens = tuple(words.split())
    return Line(number, kind, sum(t[0].isalnum() for t in tokens), tokens, tokens)


def file(*rows):
    return [line(row, k + 1) for k, row in enumerate(rows)]


def version(files):
    return {p: (fixtures.content(rows), normalize(fixtures.content(rows), LANGUAGE[p.rsplit(".", 1)[-1]])) for p, rows in files.items()}


@pytest.mark.parametrize("fixture", [f for _, _, f in LABELLED], ids=[f"{c}-{name}" for c, name, _ in LABELLED])
def test_labelled_versions_without_an_error(fixture):
    old, new = (version(c["files"]) for c in fixture["commits"])
    got = {(r[0], r[1]): (r[2], r[5], r[6]) for r in compare.decide(old, new)}
    assert got == fixtures.expected(fixture)


def test_blocks_are_read_as_written():
    rows = fixtures.block("\na + | x = 1\n    |\nb ~ |   y\n")
    assert rows == [("a", "born", "x = 1"), (None, None, ""), ("b", "edited", "  y")]


SOURCES = {
    "rust": "pub fn area(w: (i64, i64)) -> i64 {\n    /* first\n       second */\n    let label = r##\"wide # box\"##;\n    let mark = '\\'';\n    log(label, mark); // done\n    w.0 * w.1\n}\n",
    "python": "class Box:\n    def name(self):\n        \"\"\"Two\n        lines.\"\"\"\n        part = f'{self.w!s:>{self.pad}} by {self.h}'\n        return 'it\\'s ' + part  # last\n",
    "javascript": "/* top */\nlet k = 0;\nwhile (k < rows.length) { k += 1; }\nconst path = /\\/[^/]+$/i.exec(url);\nconst note = `row ${k} of ${rows.length}`;\n",
    "typescript": "type Pair = { left: number; right?: string };\nfunction join(a: Pair, b: Pair): Pair[] {\n    return [a, b,]; // both\n}\n",
    "tsx": "const unfinished = (a: ;\nlet b = [1, 2\n",
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_tokens_cover_all_but_white_space(language):
    assert "".join(p.text for p in lexers.pieces(SOURCES[language], language)) == "".join(SOURCES[language].split())


def prints(source, language):
    return [x.print for x in normalize(source, language)]


@pytest.mark.parametrize("language", ["rust", "typescript", "javascript"])
def test_spaces_within_a_line_say_nothing(language):
    rng = random.Random(language)
    rows = [["total", "=", "total", "+", "price", "*", "2", ";"], ["emit", "(", "total", ",", "rows", "[", "0", "]", ")", ";"], ["if", "(", "total", ">", "9", ")", "{", "stop", "(", ")", ";", "}"]]

    def written(gap):
        return "".join(gap("\n") + "".join(t + (" " if t[-1].isalnum() else gap("")) for t in row) + gap("") + "\n" for row in rows)

    plain = [p for p in prints(written(lambda x: ""), language)]
    for _ in range(20):
        assert prints(written(lambda x: rng.choice(["", " ", "\t", "   "])), language) == plain


def test_quotes_say_nothing_where_a_language_has_two():
    for language, same in (("python", True), ("typescript", True), ("javascript", True), ("rust", False)):
        a, b = (f"load({q}north{q})\n" for q in "'\"")
        assert (prints(a, language) == prints(b, language)) == same, language
    assert prints("const city = `north`\n", "javascript") != prints("const city = 'north'\n", "javascript")


def test_a_last_comma_counts_where_it_makes_a_tuple():
    for opens, closes, language, same in (
        ("paint(", ")", "python", True),
        ("paint(", ")", "rust", True),
        ("shade = [", "]", "python", True),
        ("shade = (", ")", "python", False),
    ):
        one, two = (f"{opens}\n    red{comma}\n{closes}\n" for comma in ("", ","))
        assert (prints(one, language) == prints(two, language)) == same, (opens, language)
    assert prints("yield red,\n", "python") != prints("yield red\n", "python")
    assert prints("let shade: (Red,) = paint();\n", "rust") != prints("let shade: (Red) = paint();\n", "rust")
    assert prints("stop();\n", "rust") != prints("stop()\n", "rust")


def test_separator_commas():
    before, after = (normalize(f"enum Shade {{\n    Red,\n{more}}}\n", "rust")[1] for more in ("", "    Blue,\n"))
    assert before.print == after.print and (before.tokens, after.tokens) == (("Red",), ("Red", ","))
    alone = normalize("paint(\n    red\n    ,\n    blue\n)\n", "python")
    assert [x.number for x in alone] == [1, 2, 3, 4, 5]
    assert [x.number for x in normalize("paint(\n    red\n    ,\n)\n", "python")] == [1, 2, 4]
    assert [x.kind for x in normalize("let shade = red\n; // end\n", "typescript")] == ["code", "comment"]


def test_similarities():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (line(" ".join(rng.choice("xyz") for _ in range(rng.randint(1, 6)))) for _ in "ab")
        left, right = ([*zip(["<", *x.tokens], [*x.tokens, ">"], strict=True)] for x in (a, b))
        both = 0
        rest = list(right)
        for pair in left:
            if pair in rest:
                rest.remove(pair)
                both += 1
        assert hunks.dice(a, b) == 2 * both / (len(left) + len(right))
        assert hunks.jaccard(a.unigrams, b.unigrams) == len({*a.tokens} & {*b.tokens}) / len({*a.tokens} | {*b.tokens})


def kept(old, new):
    return list(zip(*hunks.anchors(old, new), strict=True))


def rarest_runs_by_hand(old, new, o=0, n=0):
    """Pairs that are kept, from all common runs of a region looked at one by one."""
    count = {x: old.count(x) for x in old}
    best, reached = None, 0
    for j in range(len(new)):
        if j < reached or not 0 < count.get(new[j], 0) <= 64:
            continue
        for i in (i for i, x in enumerate(old) if x == new[j]):
            lo = max(k for k in range(min(i, j) + 1) if old[i - k : i] == new[j - k : j] and all(old[i - m] == new[j - m] for m in range(1, k + 1)))
            hi = max(k for k in range(1, min(len(old) - i, len(new) - j) + 1) if old[i : i + k] == new[j : j + k])
            rank = (-min(count[x] for x in old[i - lo : i + hi]), lo + hi)
            reached = max(reached, j + hi)
            if best is None or rank > best[0]:
                best = rank, i - lo, j - lo, lo + hi
    if best is None:
        return []
    _, i, j, size = best
    return rarest_runs_by_hand(old[:i], new[:j], o, n) + [(o + i + k, n + j + k) for k in range(size)] + rarest_runs_by_hand(old[i + size :], new[j + size :], o + i + size, n + j + size)


def test_anchors():
    rng = random.Random(9)
    for _ in range(300):
        old, new = ([rng.choice("abcdefgh"[: rng.choice([3, 8])]) for _ in range(rng.randint(0, 14))] for _ in "ab")
        assert kept(old, new) == rarest_runs_by_hand(old, new)
    often = ["x"] * 65
    assert kept(often, often) == [] and len(kept([*often, "y"], [*often, "y"])) == 66, "a line that stands too often leads to no run"


def test_sliding_keeps_what_is_kept():
    rng = random.Random(7)
    for _ in range(300):
        old, new = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in "ab")
        left, right = (hunks.gaps_of(k, n) for k, n in zip(hunks.anchors(old, new), (len(old), len(new)), strict=True))
        sizes = sum(left), sum(right)
        hunks.slide(old, left, right)
        hunks.slide(new, right, left)
        assert (sum(left), sum(right)) == sizes
        rest = []
        for lines, gaps in ((old, left), (new, right)):
            at, own = 0, []
            for gap in gaps[:-1]:
                at += gap
                own.append(lines[at])
                at += 1
            rest.append(own)
        assert rest[0] == rest[1], "the lines beside the changes are still the same on both sides"


def test_hunks_with_weak_anchors_between_are_one():
    rng = random.Random(3)
    for _ in range(100):
        rows = [[rng.choice(["}", "{ (", "let a = b ( c )", "call d e f", "return g + h", f"own {rng.random()}"]) for _ in range(rng.randint(1, 12))] for _ in "ab"]
        old, new = (file(*x) for x in rows)
        found = hunks.segments(old, new)
        assert [(x[1], x[3]) for x in found] == [(0, 0), *[(x[2], x[4]) for x in found[:-1]]][: len(found)] and found[-1][2::2] == (len(old), len(new))
        assert all(a[0] != b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(sum(x.content for x in old[i:j]) > hunks.WEAK_ANCHOR_MAX_CONTENT_TOKENS for is_kept, i, j, _, _ in found[1:-1] if is_kept)


def test_alignment_prefers_exact_totals_then_the_diagonal():
    got = hunks.align(file("a b c", "d e f", "x y z"), file("a b q", "d e q", "x y z"))
    assert [x.new for x in got.old] == [0, 1, 2] and [x.state for x in got.old] == ["edited", "edited", "verbatim"]


def test_reflow():
    got = hunks.align(file("f ( a , b , c )", "end x"), file("f (", "a , b ,", "c )", "end x"))
    assert got.old[0].layer == "reflow" and got.old[0].state == "verbatim" and [k for k, _ in got.new] == ["match", "born", "born", "match"]


@pytest.mark.parametrize(("m", "n"), [(600, 600), (100, 3000), (3000, 100), (3, 90000)])
def test_bands_hold_a_path(m, n):
    rows = hunks.band(m, n)
    assert rows[0][0] == 0 and rows[-1][1] == n
    assert all(lo <= hi and lo <= before[1] for before, (lo, hi) in zip(rows, rows[1:], strict=False))


def test_moves():
    block = ["let alpha = one ( )", "let beta = two ( )", "let gamma = three ( )"]
    old, new = [moves.Side(file(*block, "tail x"), 0)], [moves.Side(file("head y", *block), 0)]
    assert [(i, j, layer) for _, i, _, j, layer in moves.detect(old, new)] == [(0, 1, "intra_file_move"), (1, 2, "intra_file_move"), (2, 3, "intra_file_move")]
    old, new = [moves.Side(file(*block), None)], [moves.Side(file(*block), None)]
    assert {x[-1] for x in moves.detect(old, new)} == {"cross_file_move"}


def test_clock():
    rng = random.Random(2)
    assert history.repaired([]) == []
    for _ in range(300):
        times = [rng.randint(0, 12) for _ in range(rng.randint(1, 9))]
        chains = [c for size in range(len(times) + 1) for c in itertools.combinations(range(len(times)), size) if all(times[i] <= times[j] for i, j in zip(c, c[1:], strict=False))]
        longest = max(map(len, chains))
        got = history.repaired(times)
        assert got == sorted(got)
        stays = {i for i, (a, b) in enumerate(zip(times, got, strict=True)) if a == b}
        assert any(len(c) == longest and stays >= {*c} for c in chains), "a longest chain keeps its times"
        assert all(got[i] in (times[i], *times) for i in range(len(times)))


def test_text_functions(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(text.git_blob_id(F.lit("hello\n").cast("binary"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(text.git_blob_id(F.lit("").cast("binary"))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    paths = {"lib/shade.rs": "rust", "web/view.mts": "typescript", "CHANGES.txt": None, "tools.ts/notes": None, "vendor/x.py": None, "a/vendor/x.py": None, "a/x_pb2.py": None, "x.min.js": None, "a/b.generated.ts": None, ".linefate/db.py": None, "view.jsx": "javascript"}
    for path, want in paths.items():
        assert one(text.tracked_language(F.lit(path))) == want, path
    assert [one(text.parse_day(F.lit(x))) for x in ("2000-03-01", "2024-02-29", "2023-02-29", "2024-2-1")] == [951868800, 1709164800, None, None]
    # every way of writing a command that takes files from the history, and the same words where they are no such command
    for verb in ("checkout -- shade.py", "restore shade.py", "reset --hard", "stash pop", "pull"):
        for command in (f"git {verb}", f"make && git {verb}", f"git -C lib {verb}", f"git -c color.ui=never {verb}"):
            assert one(text.restores_from_git(F.lit(command))), command
        for command in (f"echo {verb}", f"printf '%s' {verb.split()[0]}", "git log --stat", "git diff HEAD", "cp shade.py old.py"):
            assert not one(text.restores_from_git(F.lit(command))), command
    mark = lambda m: one(text.agent_trailer(F.lit(m), "<bot@example.com>", ("generated with bot",), "Generated with Bot"))
    assert mark("x\n\nCo-Authored-By: Bot 2 <bot@example.com>\n") == "Bot 2 <bot@example.com>"
    assert mark("x\n\n* Generated with Bot!") == "Generated with Bot" and mark("x\n\nCo-authored-by: A <a@b.c>") is None and mark("uses bot@example.com") is None
    assert one(text.clock_text(F.lit(951868800 + 3660))) == "2000-03-01 01:01 UTC" and one(text.ago(F.lit(5400))) == "1 hours ago"
    got = one(text.target(F.lit("a:b.py:12")))
    assert (got.path, got.line) == ("a:b.py", 12) and one(text.target(F.lit("a.py"))) is None


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    steps = [{"a.py": "x = 1\ny = 2\n"}, {"b.py": "def f():\n    return alpha\n"}, {"a.py": "x = 1\ny = 3\n"}, {"a.py": None, "c.py": "x = 1\ny = 3\n"}, {"c.py": "x = 1\n"}]
    for k, files in enumerate(steps):
        for name, content in files.items():
            (path / name).unlink() if content is None else (path / name).write_text(content)
        run("add", "-A")
        run("commit", "-qm", f"step {k}")
    return str(path)


def test_trace_of_a_repository(spark, repo):
    commits, tree = git.load(spark, repo, "commits"), git.load(spark, repo, "tree")
    assert commits.count() == 5 and tree.count() == 1 + 2 + 2 + 2 + 2
    tree = tree.withColumn("repo", F.lit("r"))
    tree = snapshots.with_lines(tree, git.blobs(spark, repo, tree)).select("repo", "ord", "path", "content_id", "lines").cache()
    decided = compare.decisions(tree).cache()
    assert lineage.broken(tree, decided).count() == 0
    ids = lineage.identities(tree, decided).cache()
    traced = lineage.fates(decided, ids)
    story = {(r.birth_ord, r.birth_path, r.birth_line): r.fates for r in traced.groupBy("birth_ord", "birth_path", "birth_line").agg(F.sort_array(F.collect_list(F.struct("ord", "state", "path", "line"))).alias("fates")).collect()}
    assert [tuple(x) for x in story[0, "a.py", 2]] == [(1, "verbatim", "a.py", 2), (2, "edited", "a.py", 2), (3, "verbatim", "c.py", 2), (4, "dead", None, None)]
    lines, told = lineage.stored(commits.select(F.lit("r").alias("repo"), "ord", "sha", F.col("committed_at").alias("clock")), tree, traced, ids)
    assert [r.line_id for r in lines.orderBy("line_id").collect()] == [1, 2, 3, 4]
    assert sorted((r.line_id, r.state) for r in told.collect()) == [(2, "dead"), (2, "edited")]
    doc = lineage.trace_json(commits.select(F.lit("r").alias("repo"), "ord", "sha"), lineage.births(tree, decided), traced, "1").first().trace
    assert '"contract_version":1' in doc and doc.count('"birth"') == 4


def test_stream_equals_replay(spark, tmp_path):
    body = "def f(a):\n    return alpha + a\n\nprint(f(1))\n"
    versions = [body, body.replace("alpha", "beta"), "# head\n" + body, "print(f(1))\n"]
    rows = [("s1", None, "Write" if k else "Edit", f"src/{name}.py", content, None, 100 + k, k) for name in ("a", "b") for k, content in enumerate(versions)] + [("s1", None, "Write", "notes.md", "x", None, 1, 1)]
    events = spark.createDataFrame(rows, record.EVENTS)
    want = sorted(map(str, record.replay(events).collect()))
    for k in range(4):
        events.where(F.col("seq") == k).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = record.record(stream).writeStream.format("memory").queryName("recorded").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("recorded").collect()
    assert len(got) == len(want) > 10
    assert {r.kind for r in got} == {"birth", "fate"} and {r.state for r in got if r.kind == "fate"} >= {"edited", "dead"}
    assert all(r.birth_observed is False for r in got if r.kind == "birth" and r.at == 100), "an edit of a file never seen credits nobody"
