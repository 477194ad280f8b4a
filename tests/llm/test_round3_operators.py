"""Conversation repair, token files and sort-means against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import heapq
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photonlake.llm import centroids, chat_repair, common, entries, token_files

WHITE = " \t\n\x0b\x0c\r"

# Conversation repair -----------------------------------------------------------------------------------------------------------------------------------


def search(rows):
    """The cheapest edits of rows (initial, must go, truncated) by best-first search over whole label strings: no dynamic programming, no states merged."""
    steps = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    heap = [(0, "", 0, "")]
    while heap:
        cost, labels, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, labels
        if len(labels) > 2 * len(rows) + 4:
            continue
        for x in steps[last]:
            if x in "ua":
                heapq.heappush(heap, (cost + 2, labels + "I", i, x))
        if i < len(rows):
            initial, out, cut = rows[i]
            heapq.heappush(heap, (cost + 3, labels + "D", i + 1, last))
            if not out:
                if initial in steps[last]:
                    heapq.heappush(heap, (cost + cut, labels + "K", i + 1, initial))
                for x in steps[last]:
                    if x in "ua":
                        heapq.heappush(heap, (cost + 2 + cut, labels + "R", i + 1, x))


def code(initial, out, cut):
    return (["s", "u", "a", initial].index(initial)) + 4 * (2 if out else 1 if cut else 0)


def test_edits_against_best_first_search():
    for n in range(4):
        for rows in itertools.product([(r, o, c) for r in "suat" for o, c in ((0, 0), (0, 1), (1, 0))], repeat=n):
            if n < 3 or hash(rows) % 5 == 0:
                assert chat_repair.edits(bytes(code(*r) for r in rows)) == search(rows), rows
    rnd = random.Random(3)
    for _ in range(60):
        rows = [(rnd.choice("suuuaaat"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(4, 7))]
        assert chat_repair.edits(bytes(code(*r) for r in rows)) == search(rows), rows


def test_edits_of_long_conversations():
    assert chat_repair.edits(b"") == (0, "")
    n = 300_000
    cost, audit = chat_repair._edits(bytes([1, 2] * n))
    assert cost == 0 and audit == "K" * (2 * n)
    cost, audit = chat_repair._edits(bytes([9] * n))
    assert cost == 3 * n and audit == "D" * n
    cost, audit = chat_repair._edits(bytes([1] * n))
    assert cost == n and audit == "KR" * (n // 2)


def brute_repair(rows):
    """The contract's row of one conversation, given its damaged rows (turn, role, text) in order."""
    seen, marks = set(), []
    for _, role, text in rows:
        core = text.rstrip(WHITE)
        blank, dup = core == "", (role, text) in seen
        cut = not blank and not dup and core[-1] not in ".!?"
        seen.add((role, text))
        marks.append((blank, not blank and dup, cut))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = search([(i, b or d, c) for i, (b, d, c) in zip(initials, marks)])
    out, at, last = [], 0, ""
    for e in audit:
        made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if e != "I":
            _, role, text = rows[at]
            at += 1
        if e == "D":
            continue
        role, text = (role, text) if e == "K" else (made, text) if e == "R" else (made, "")
        out.append(f"{role}:{text}")
        last = role[:1]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(sum(m[i] for m in marks) for i in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def odd_conversations():
    rnd = random.Random(11)
    texts = ["Yes.", "Yes.", "No", " \t", "", None, "Well? \n", "é!", "three... dots", "long " * 400 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "sys", "u"]
    rows = []
    for c in [*range(60), None]:
        for t in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([t, t, t, t + 2, None]), rnd.choice(roles[:3] * 3 + roles), rnd.choice(texts)))
    rows += rows[:20]  # repeated rows
    return rows


def test_repair_against_brute_force(spark):
    rows = odd_conversations()
    damaged = {}
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        damaged.setdefault(c, []).extend([(t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    want = {c: brute_repair(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, x in damaged.items()}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"code": F.lit(1), "kind": F.lit("x"), "first": F.lit(2), "head": F.lit(3), "ID": F.lit(4)})
    got = chat_repair.repair_digests(chat_repair.damaged(table)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert any(x[6] == "" for x in want.values()) and any("I" in x[6] and "D" in x[6] for x in want.values())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Out."), (2, 0, "assistant", "So."), (3, 0, "user", " ")]
    out = chat_repair.repaired(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted((r.conv_id, r.pos, r.role, r.text) for r in out) == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Out."), (2, 0, "user", ""), (2, 1, "assistant", "So.")]
    assert chat_repair.repair_digests(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


# Token files -------------------------------------------------------------------------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(entries.byte_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


DOCS = [(5, "Some words. Ünd more"), (None, "no id"), (3, None), (3, ""), (-7, "a <|endoftext|> b<|endoftext|>"), (8, "\x1c \x85　 x \n\n y"), (1 << 40, "word " * 6000), (5, "Some words. Ünd more"), (6, "it's  a 'll\tb \U0001f600 é")]


def test_token_files_against_the_library(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"hash": F.lit(1), "salt": F.lit(2), "TEXT_": F.lit(3)})
    folder = f"{common.shared_dir(spark)}/tokens-test"
    token_files.write_tokens(docs.repartition(3), folder, entries.byte_vocabulary(), parts=4)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted((d is None, d or 0, plain_ids(t)) for d, t in DOCS)


def test_token_files_empty_and_broken(spark):
    assert token_files.token_file_digests(spark.createDataFrame([], "doc_id long, text string"), entries.byte_vocabulary()).count() == 0
    folder = f"{common.shared_dir(spark)}/tokens-broken"
    token_files.write_tokens(spark.createDataFrame(DOCS, "doc_id long, text string"), folder, entries.byte_vocabulary(), parts=1)
    with open(f"{token_files.mounted(folder)}/part-000000.ids", "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(Exception, match="not the"):
        token_files.read_tokens(spark, folder).collect()
    with pytest.raises(ValueError, match="mounted"):
        token_files.write_tokens(spark.createDataFrame(DOCS, "doc_id long, text string"), "hdfs://x/y", entries.byte_vocabulary())


def test_encoder_cuts_only_where_a_token_starts():
    encode = token_files.Encoder(entries.byte_vocabulary())
    assert encode.cuts and encode.width == 2
    rnd = random.Random(5)
    signs = [*"ab1'!._\n\t   \x1c\x85\xa0é中́​　", "<|endoftext|>", " 's", " ", " ", "\U0001f600"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in encode.encode(pa.array(texts))] == [x.ids for x in want]
    other = token_files.Encoder(entries.vocabulary())
    assert not other.cuts
    assert np.frombuffer(other.encode(pa.array(["Some words"]))[0], dtype=other.kind).tolist() == other.tokenizer.encode("Some words", add_special_tokens=False).ids


# Sort-means --------------------------------------------------------------------------------------------------------------------------------------------


def brute_means(rows, k, rounds, dims):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda: [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        found = nearest()
        for j in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            at[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else at[j]
    found = nearest()
    own = [sum(d for d, c in found if c == j) for j in range(len(at))]
    return sorted(((i is None, i or 0), j, d, own[j], sum(own), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found))


def means_rows(spark, rows, kind="float", **more):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"cluster": F.lit("x"), "block": F.lit(1), "ID": F.lit(2)})
    return sorted(((r.vec_id is None, r.vec_id or 0), *tuple(r)[1:]) for r in centroids.sort_means(table.repartition(3), **more).collect())


def test_sort_means_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 16)
    rnd = random.Random(2)
    rows = [(i, [float(np.float32(rnd.gauss(i % 5, 1))) for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [0.5] * 4), (None, [1.0] * 4), (None, None), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf")] + [0.0] * 3)]
    rows += [(300 + i, [2.0] * 4) for i in range(60)]  # equal vectors: ties and empty centroids
    assert means_rows(spark, rows, k=6, rounds=4, dims=4) == brute_means(rows, 6, 4, 4)


def test_sort_means_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(itertools.product(range(-3, 4), repeat=2))]
    for rounds in (0, 1, 5):
        assert means_rows(spark, rows, "double", k=7, rounds=rounds, dims=2) == brute_means(rows, 7, rounds, 2)


def test_sort_means_of_large_components_and_few_rows(spark):
    rows = [(i, [1e5 * i, -3e5 + i]) for i in range(12)] + [(99, [1e6, 1.5])]
    assert means_rows(spark, rows, "double", k=3, rounds=3, dims=2) == brute_means(rows, 3, 3, 2)
    assert means_rows(spark, rows[:2], "double", k=8, rounds=2, dims=2) == brute_means(rows[:2], 8, 2, 2)
    assert means_rows(spark, [(1, None)], "double", dims=2) == []
    with pytest.raises(Exception, match="no long"):
        means_rows(spark, [(0, [1e14, 0.0]), (1, [-1e14, 0.0]), (2, [0.0, 0.0])], "double", k=1, dims=2)


def test_sort_means_looks_at_fewer_centroids_than_there_are():
    rnd = np.random.default_rng(1)
    at = centroids.Centroids([[int(1000 * i), 0] for i in range(16)])
    x = np.stack([rnd.integers(0, 15000, 2000), rnd.integers(-50, 50, 2000)], axis=1)
    near, distance, first = at.nearest(x, np.zeros(2000, dtype="<u1"))
    again, same, seen = at.nearest(x, near)
    assert (near == again).all() and (distance == same).all()
    assert seen < first and seen < 2000 * 4


# The language model's blocks ----------------------------------------------------------------------------------------------------------------------------


def test_scores_don_t_depend_on_how_files_are_split(spark, tmp_path):
    """Files are read anew, in other splits, between the building of the scores and their computation."""
    from photonlake.llm import lm

    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three", "four", f"w{i}"]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    name, results = "spark.sql.files.minPartitionNum", []
    before = spark.conf.get(name, None)
    try:
        for first, then in ((4, 4), (16, 6), (6, 12), (12, 16)):
            spark.conf.set(name, first)
            scored = lm.score_texts(spark.read.parquet(f"{tmp_path}/docs"), block_bytes=1500, range_bytes=1500, stable=True)
            spark.conf.set(name, then)
            results.append({r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in scored.collect()})
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    assert all(x == results[0] for x in results) and len(results[0]) == 400


# WARC bodies and packed files ---------------------------------------------------------------------------------------------------------------------------


def test_bodies_against_a_plain_encoder():
    """Random mixes of chunks, members, frames and encodings come back whole; what is cut off or followed by something has its head and a problem."""
    import gzip

    import zstandard

    from photonlake.llm import warc

    rnd = random.Random(4)
    parts = lambda data, n: [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]
    encode = {
        "gzip": lambda data: b"".join(gzip.compress(x) for x in parts(data, rnd.randint(1, 4))), "zstd": lambda data: b"".join(zstandard.compress(x) for x in parts(data, rnd.randint(1, 4))),
        "deflate": lambda data: zlib.compress(data) if rnd.random() < 0.5 else zlib.compress(data)[2:-4], "identity": lambda data: data,
    }
    for _ in range(150):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 400)))
        used = [rnd.choice(list(encode)) for _ in range(rnd.randint(0, 2))]
        payload = body
        for name in used:
            payload = encode[name](payload)
        whole, headers = payload, [f"Content-Encoding: {', '.join(used)}"] if used else []
        if rnd.random() < 0.5:
            chunked = b"".join(f"{len(x):x};ext\r\n".encode() + x + b"\r\n" for x in parts(payload, rnd.randint(1, 5)) if x)
            payload, headers = chunked + b"0\r\n\r\n", [*headers, "Transfer-Encoding: chunked"]
        assert warc.body_of(warc.Headers(headers), payload) == (body, ""), (used, headers)
        if used and used[-1] != "identity" and payload is whole and len(whole) > 12:
            got, problem = warc.body_of(warc.Headers(headers), whole[:-3])
            assert problem and (len(used) > 1 or body.startswith(got) or got == whole[:-3])
            _, problem = warc.body_of(warc.Headers(headers), whole + b"more")
            assert problem
    for name in ("gzip", "deflate", "zstd"):
        assert warc.body_of(warc.Headers([f"Content-Encoding: {name}"]), b"") == (b"", "")
    cut = gzip.compress(b"first half ") + gzip.compress(b"second half" * 900)[:-20]
    got, problem = warc.body_of(warc.Headers(["Content-Encoding: gzip"]), cut)
    assert got.startswith(b"first half second half") and "cut off" in problem


def test_packed_files_against_plain_ones(monkeypatch):
    import gzip

    from photonlake.llm import warc

    rnd = random.Random(9)
    records = [warc.record([("WARC-Type", "response"), ("N", str(i))], bytes(rnd.choice(b"ab\r\n\x1f\x8b\x08WARC/1.0") for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    for piece in (1, 7, 64, 1 << 16):
        monkeypatch.setattr(warc, "PIECE", piece)
        plain = [(h["n"], b) for h, b in warc.scan(b"".join(records))]
        assert [n for n, _ in plain] == [str(i) for i in range(60)]
        assert [(h["n"], b) for h, b in warc.scan(b"".join(gzip.compress(r) for r in records))] == plain
        assert [(h["n"], b) for h, b in warc.scan(gzip.compress(b"".join(records[:30])) + gzip.compress(b"".join(records[30:])) + b"\0\0")] == plain
        packed = [gzip.compress(r) for r in records]
        broken = [*packed]
        broken[20] = broken[20][:-9]
        found = list(warc.scan(b"".join(broken)))
        assert [x for x in found if isinstance(x, str)] and {h["n"] for h, _ in (x for x in found if not isinstance(x, str))} >= {str(i) for i in range(60) if i not in (20, 21)}


def test_many_members_take_time_in_proportion():
    import gzip

    from photonlake.llm import warc

    record = warc.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\n" + bytes(random.Random(1).randrange(256) for _ in range(1500)))
    packed = gzip.compress(record, 1)
    begun = time.time()
    assert sum(not isinstance(x, str) for x in warc.scan(packed * 20_000)) == 20_000
    assert time.time() - begun < 30


# Other operators ----------------------------------------------------------------------------------------------------------------------------------------


def test_preference_prefix_with_turns_of_one_number(spark):
    from photonlake.llm import chat

    rows = [(c, t, r, x + (str(c) if t == 2 and r == "assistant" else "")) for c in (0, 1) for t, r, x in ((1, "user", "q"), (2, "assistant", "last"), (2, "system", "s"), (2, "aside", "a"), (2, "tool", "t"))]
    made = {r.pair_id: r for r in chat.preference_pairs(chat.sibling_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert made[0].n_prefix == 2 and "aside" in made[0].prompt and made[0].rejected.count("last1") == 1 and "system" in made[0].chosen


def test_toxicity_learns_from_bounded_rows(spark):
    from photonlake.llm import toxicity

    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, sample=5).collect()
    assert len(rows) == 5 and all(int(r.text.split()[1]) % 2 == r.toxic for r in rows)


def test_other_texts_at_the_second_reading_are_an_error(spark, tmp_path):
    from photonlake.llm import lm

    spark.createDataFrame([(i, f"a b c{i}") for i in range(9)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    other = F.udf(lambda t: f"{t} {time.time_ns()}").asNondeterministic()
    scored = lm.score_texts(docs.select("doc_id", other("text").alias("text")), stable=True)
    with pytest.raises(Exception, match="second time"):
        scored.collect()
