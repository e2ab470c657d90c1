"""Tokenizers, token file, token counts and decontamination against brute force."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from linefate.llm import byte_bpe, decontaminate, token_counts, token_file
from linefate.llm.common import scratch
from pyspark.sql import functions as F

MULTI = public.path("byte_bpe_multi_50k.tiktoken")
WORD = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(MULTI), special_tokens={})


def random_texts(n):
    rng = random.Random(1)
    near = "abcdeñéthin 's\n\t你  .,!0129  xX\0"
    out = ["".join(rng.choice(near) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(32, 0x2FFF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(30)) for _ in range(n)]
    return [*out, "", " ", "\n", "a\n\nb", " 's", "a" * 3000, "ab" * 500]


def test_replay_equals_the_library(library):
    bpe = byte_bpe.ByteBPE(MULTI, public.PATTERN, kept=500)
    texts = random_texts(600)
    got = [ids for i in range(0, len(texts), 100) for ids in bpe.encode_batch(texts[i : i + 100])]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x).decode() for x in got] == texts


def test_pieces_kept_from_other_batches(library):
    rng = random.Random(9)
    bpe = byte_bpe.ByteBPE(MULTI, public.PATTERN)
    batches = [["x \0\0 \0a \0"], ["\0", "\0a", "a", ""], ["\n", " a", "a\nb c", "a\x1cb \u2003c", "a\rb"], [" " + "Zq" * 90 + " b", "Zq" * 90, "b " * 50 + "end"]]
    batches += [["".join(rng.choice("ab \n\0'\t5\u00e9\u4f60") for _ in range(rng.randint(0, 12))) for _ in range(40)] for _ in range(50)]
    for batch in batches:
        assert list(bpe.encode_decimal(batch)) == [",".join(map(str, library.encode_ordinary(text))) for text in batch], batch
    words = ["hello", "hellohello", "x" * 500, "", "zzqj" * 30, "\u4f60\u597d", " the", "aaaaaaa"]
    assert bpe.replay(words) == {word: ",".join(map(str, library._encode_single_piece(word.encode()) if word else [])) for word in words}


def test_byte_bpe_over_odd_rows(odd, nothing, library):
    rows = byte_bpe.round_trip(odd, MULTI, public.PATTERN).collect()
    assert len(rows) == odd.count()
    want = sorted((str(r.doc_id), len(ids := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.round_trip(nothing, MULTI, public.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(odd, MULTI, public.PATTERN), MULTI, public.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.select("doc_id", "text").collect())


def test_token_counts(spark, odd, nothing, library):
    table = token_counts.limits(token_counts.histogram(byte_bpe.lengths(odd, MULTI, public.PATTERN)))
    sizes = [len(library.encode_ordinary(r.text or "")) for r in odd.select("text").collect()]
    got = {r.length: r for r in table.collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        assert r.truncated_total == sum(min(x, limit) for x in sizes)
        assert (r.n_docs, r.n_docs_longer, r.tokens_total) == (sizes.count(limit), sum(x > limit for x in sizes), sum(sizes))
    asked = [0, 1, 7, 100, 10**6]
    assert {r.context_limit: (r.truncated_total, r.n_docs_longer) for r in token_counts.truncated_totals(table, asked).collect()} == {a: (sum(min(x, a) for x in sizes), sum(x > a for x in sizes)) for a in asked}
    ordered = sorted(sizes)
    assert {r.share: r.length for r in token_counts.quantiles(table, [0.5, 1.0]).collect()} == {0.5: ordered[-(-len(ordered) // 2) - 1], 1.0: ordered[-1]}
    assert token_counts.limits(token_counts.histogram(byte_bpe.lengths(nothing, MULTI, public.PATTERN))).count() == 0


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    marks = ["J\u030c j\u030c", "I\u0307A i\u0307", "\u212a K\u0301", "x \u0301y\u0301", "don't DON'T it's.", "\u00a0a\u2003b\tc\rd"]
    texts = [*random_texts(400), *marks, "<|endoftext|> <|startoftext|>a", "Hello<|ENDOFTEXT|> <|x", "ΑΣ ΑΣ. İ", "w" * 70_000]
    want = [x.ids + [1] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_file.ChunkEncoder(WORD, 1).encode_batch(texts)] == want


def test_token_file_over_odd_rows(spark, odd, nothing):
    folder = scratch(spark, "tokens")
    rows = token_file.read(token_file.write(odd, folder, WORD, 1, shard_docs=10), folder).collect()
    own = token_file.ChunkEncoder(WORD, 1)
    order = sorted((r.doc_id is not None, r.doc_id or 0, own.encode_batch([r.text or ""])[0]) for r in odd.select("doc_id", "text").collect())
    at, want = 0, []
    for known, doc_id, ids in order:
        want.append((doc_id if known else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(rows, key=lambda r: r.start) == [tuple(x) for x in want]
    empty = scratch(spark, "tokens")
    assert token_file.read(token_file.write(nothing, empty, WORD, 1), empty).count() == 0


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    writer = token_file.ShardWriter(out, frame_bytes=40)
    docs = {i: np.arange(i, dtype="<u4").tobytes() for i in range(30)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    reader = token_file.ShardReader(io.BytesIO(out.getvalue()))
    assert dict(reader) == docs and len(reader.frames) > 5
    assert reader.get([3, 17, 99]) == {3: docs[3], 17: docs[17]}
    spoilt = bytearray(out.getvalue())
    spoilt[int(reader.frames[-1]["offset"]) + 12] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstandard's own checksum or the table's
        dict(token_file.ShardReader(io.BytesIO(bytes(spoilt))))
    with pytest.raises(ValueError):
        token_file.ShardReader(io.BytesIO(out.getvalue()[:-1] + b"?"))


def windows_by_hand(docs, items):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    cut = lambda t: find(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = {}
    for name, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - 12)) if w else ():
            held.setdefault(tuple(w[k : k + 13]), set()).add(str(name))
    out = []
    for name, text in docs:
        w = cut(text)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                own = held.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [1] * n
        out.append((str(name), len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_WORDS, 20])
def test_decontamination(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(decontaminate.build, "__kwdefaults__", decontaminate.build.__kwdefaults__ | {"limit": limit})
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["a", "b", "ca", "D", "é", "x1"]) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 3, 12, 13, 14, 30]) if i % 4 else 3)) for i in range(12)] + [(100, None), (101, "...")]
    docs = [(i, line(rng.randint(0, 600)) if i % 3 else line(20) + " " + (items[i % 12][1] or "") + " zz " + line(5)) for i in range(60)] + [(None, None), (1001, "")]
    got = decontaminate.measure(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == windows_by_hand(docs, items)


def test_decontamination_cleans(spark, odd, nothing):
    item = "a b ca D é x1 a b ca D é x1 a"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Foo bar. {item.upper().replace('É', 'é')}, baz", "x"), (2, None, "y"), (3, "é ok", "z")], "doc_id long, text string, more string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [(1, "Foo bar. , baz", "x"), (2, None, "y"), (3, "é ok", "z")]
    assert [r.doc_id for r in decontaminate.clean(docs, items, drop=True).orderBy("doc_id").collect()] == [2, 3]
    none = items.where("false")
    assert decontaminate.measure(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.measure(nothing, items).count() == 0
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.measure(odd, items).agg(F.count("*")).first()[0] == odd.count()
