"""Operators on small tables against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from photonlake.llm import bpe, common, decontaminate, entries, line_dedup, lm, simhash, topk, toxicity

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def lower(s):
    return s.encode("utf-8").lower().decode("utf-8")


LONG = "A line that is long enough to be counted by the operator"
TEXTS = [
    (1, f"{LONG}\nown line one"), (2, f"  {LONG.upper()}\t\nx"), (3, f"{LONG}\n{LONG}\r"), (4, f"y\n{LONG}"), (5, f"{LONG}\nz\n{LONG}"), (5, f"{LONG}\nz\n{LONG}"),
    (6, None), (7, ""), (8, "\n\n"), (None, f"{LONG}\nlast"), (9, "é" * 39 + "\n" + "é" * 40), (10, "word " * 5000), (11, "\x0b \x0c"),
]


def test_line_dedup_against_brute_force(spark):
    key = lambda x: lower(x.strip(WHITE))
    held = collections.defaultdict(set)
    for i, t in TEXTS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                held[key(x)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = collections.Counter()
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in common or common[key(x)] == i]
        want[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    got = line_dedup.line_dedup_digests(docs_of(spark, TEXTS)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert common and any(k[2] for k in want)


def test_line_dedup_keeps_columns_and_counts(spark):
    out = line_dedup.dedup_lines(docs_of(spark, TEXTS).withColumn("drop", F.lit("mine")).withColumn("a", F.lit(1)), n_chars="n_chars")
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert rows[1, "own line one"].n_chars == len("own line one") and rows[1, "own line one"]["drop"] == "mine"
    assert (6, None) in rows and (7, "") in rows
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def brute_simhash(text):
    w = lower(text or "").translate(str.maketrans(WHITE, " " * len(WHITE))).split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    n = len(fps)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "ONE"), (205, "a b c d"), (205, "a b c d"), (206, "é É")]
    want = {}
    fps = [brute_simhash(t) for _, t in rows]
    comp = brute_components(fps)
    least = collections.defaultdict(lambda: 1 << 60)
    for (i, _), c in zip(rows, comp):
        least[c] = min(least[c], i)
    want = collections.Counter((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, comp))
    got = simhash.simhash_components(docs_of(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert len({r.component_id for r in got}) < len(rows) - 20


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bucket_comparison_finds_every_pair(radius):
    rng = np.random.default_rng(radius)
    core = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    fps = np.array([c ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, size=rng.integers(0, 6))))) for c in np.repeat(core, 12)], dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 9, size=len(fps)))
    got = {(int(a), int(b)) for x, y in simhash.linked_in_buckets(fps, bucket, radius) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want


def test_large_buckets_are_dealt_out(spark):
    rng = random.Random(1)
    fps = {0x1234 << 48 | rng.getrandbits(5) << 20 | rng.getrandbits(4) for _ in range(300)}
    classes = spark.createDataFrame([(simhash.signed(x), 0) for x in fps], "fp long, least long")
    found = simhash.components(simhash.links(classes, 3, chunk=16), "u", "v")
    assert found.count() == len(fps) and found.select("root").distinct().count() == 1


def test_block_tables_cover_all_pairs():
    rng = random.Random(2)
    for n in (10, 1 << 24, 1 << 30, 1 << 40):
        masks = simhash.block_tables(n, 3)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not x & m for m in masks)


def test_near_duplicates_leave_one_of_each_group(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "quite another text here"), (None, "a b c d e")]
    out = simhash.drop_near_copies(docs_of(spark, rows))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def shingles_of(text, words=5):
    w = lower(text or "").split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_near_copies(rows, similarity=0.8):
    """Groups of linked rows, each as the smallest id reachable, by comparing all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    comp = [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] == rows[j][0] or not a and not b or len(a & b) >= similarity * len(a | b) > 0:
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return {(i, c) for (i, _), c in zip(rows, comp)}


@pytest.mark.parametrize("chunk,limit", [(4096, 16 << 20), (8, 4096)])
def test_near_copies_are_those_of_the_similarity(spark, chunk, limit):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        rows.append((100 * k, " ".join(base)))
        for c in range(1, 25):
            w = list(base)
            at = rng.randrange(len(w))
            # One run of words is changed: the share of changed shingles is spread over both sides of the similarity.
            for i in range(at, min(len(w), at + rng.randrange(1, len(w) // 4))):
                w[i] = rng.choice(words)
            rows.append((100 * k + c, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "one two three")]
    got = {tuple(r) for r in simhash.near_copies(docs_of(spark, rows), chunk=chunk, limit=limit).collect()}
    want = brute_near_copies(rows)
    assert got == want
    assert 20 < len({c for _, c in want}) < len(rows) - 20  # the fixture has texts on both sides


def test_near_copies_of_repeated_shingles_and_short_texts(spark):
    rng = random.Random(21)
    own = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    rows = [(k, f"{own(300)} {filler * 400} {own(3)}") for k, filler in enumerate(["- ", "- ", ". ", ". ", "0 ", "0 "])]
    same, short = own(40), [own(9) for _ in range(30)]
    rows += [(10, same + " x" * 100), (11, same + " x" * 900), (12, same)]
    # Sets of five shingles and four of them: the similarity is 0.8 exactly.
    rows += [(100 + 2 * k + c, t if c else t.rsplit(" ", 1)[0]) for k, t in enumerate(short) for c in range(2)]
    got = {tuple(r) for r in simhash.near_copies(docs_of(spark, rows)).collect()}
    assert got == brute_near_copies(rows)
    assert {(k, k) for k in range(6)} <= got and {(10, 10), (11, 10), (101, 100)} <= got


def test_similar_links_span_the_groups_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=(6, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k % 6][rng.permutation(60)[: rng.integers(40, 60)]], rng.integers(0, 1 << 63, size=rng.integers(0, 6), dtype=np.uint64)))) for k in range(150)]
    pairs = lambda it: simhash.forest(len(sets), ((np.array([i]), np.array([j])) for i, j in it)).tolist()
    want = pairs((i, j) for i in range(150) for j in range(i) if simhash.as_similar(sets[i], sets[j], 0.8))
    found = simhash.similar_links(sets, 0.8)
    assert pairs(found) == want and len(found) == 150 - len(set(want)) and all(simhash.as_similar(sets[i], sets[j], 0.8) for i, j in found)


BENCH = [(1, " ".join(f"t{i}" for i in range(20))), (2, "short item only"), (3, None), (4, "..."), (5, " ".join(f"t{i}" for i in range(20))), (30, " ".join(f"ü{i}" for i in range(13)))]


def brute_contamination(text, bench, size=13):
    def words(t):
        out, now = [], ""
        for c in lower(t or ""):
            if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
                if now:
                    out.append(now)
                now = ""
            else:
                now += c
        return out + [now] if now else out

    w, hit, items = words(text), set(), set()
    for i, t in bench:
        b = words(t)
        for x in [b[k : k + size] for k in range(len(b) - size + 1)] if len(b) >= size else [b] if b else []:
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    hit |= set(range(at, at + len(x)))
                    items.add(str(i))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_contamination_by_either_path(spark, limit):
    inside = " ".join(f"T{i}" for i in range(3, 18))
    rows = [(1, f"Before {inside}, after"), (2, "nothing here"), (3, None), (4, ""), (5, "a Short; ITEM only b " + "x " * 100), (6, " ".join(f"t{i}" for i in range(12))), (7, BENCH[5][1] + "!"), (7, BENCH[5][1] + "!"), (8, inside + " " + "w " * 400)]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), bench, broadcast_bytes=limit).collect()
    want = collections.Counter((i, *brute_contamination(t, BENCH)) for i, t in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    stay = decontaminate.decontaminate(docs_of(spark, rows), bench, broadcast_bytes=limit)
    assert sorted(r.doc_id for r in stay.collect()) == [2, 3, 4, 5, 6, 8]
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, rows), bench, spans=True, n_chars="n_chars", broadcast_bytes=limit).collect()}
    assert cut[1].text == "Before , after" and cut[1].n_chars == len("Before , after") and cut[2].text == "nothing here" and cut[3].text is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, rows), none, broadcast_bytes=limit).filter("n_hit > 0 OR contaminated").count() == 0


def test_window_set_against_brute_force_and_its_size():
    rng = random.Random(11)
    bench = [(k, " ".join(rng.choice("a b c d Ü".split()) for _ in range(rng.choice([0, 1, 2, 3, 5, 8])))) for k in range(30)]
    built = decontaminate.WindowSet([(str(k), t.encode()) for k, t in bench], 3)
    for _ in range(200):
        text = " ".join(rng.choice("a b c d e Ü".split()) for _ in range(rng.randint(0, 25)))
        hit, items = built.hits(decontaminate.words_of(text.encode()))
        got = len(hit), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert got == brute_contamination(text, bench, 3)[:4], text
    long = [(str(k), " ".join(f"word{rng.randrange(10**6)}" for _ in range(100)).encode()) for k in range(500)]
    built = decontaminate.WindowSet(long, 13)
    size = sum(len(t) for _, t in long)
    assert built.nbytes < 8 * size  # what bounded_windows takes for granted
    words = decontaminate.words_of(long[7][1]) * 30  # longer than the powers at hand
    hit, items = built.hits(words)
    assert hit.all() and items == {"7"}


def test_helper_columns_may_be_the_callers(spark):
    rows = [(k, f"{LONG}\nown line {k} of this text") for k in range(1, 7)] + [(None, LONG), (None, None)]
    odd = docs_of(spark, rows)
    for name in ("__drop", "__DROP_ID", "__drop_own", "__text", "__key", "__found", "__Id", "__toxic", "IDS", "Decoded", "n_tokens"):
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    for limit in (1 << 20, -1):
        out = decontaminate.decontaminate(odd, bench, spans=True, broadcast_bytes=limit)
        assert out.schema == odd.schema and out.count() == 8 and out.filter("__key <> 'own __key' OR __text <> 'own __text'").count() == 0
    out = line_dedup.dedup_lines(odd, n_chars="n_chars")
    assert out.schema == odd.schema and out.count() == 8 and out.filter("__drop = 'own __drop'").count() == 8
    texts = {r.doc_id: r.text for r in out.filter("doc_id IS NOT NULL").collect()}
    assert LONG in texts[6] and all(LONG not in texts[k] for k in range(1, 6))
    assert sorted(str(r.text) for r in out.filter("doc_id IS NULL").collect()) == ["", "None"]
    assert simhash.drop_near_copies(odd).schema == odd.schema
    assert simhash.drop_near_copies(odd).filter("doc_id IS NULL").count() == 2
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 7)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(odd, toxicity.learn(odd, labels)).schema == odd.schema
    out = bpe.encode_texts(odd, entries.vocabulary(), decoded="decoded")
    assert sorted(c.lower() for c in out.columns) == sorted(c.lower() for c in odd.columns) and out.filter("size(ids) = 0").count() == 1


@pytest.fixture(scope="module")
def codec():
    return bpe.PrefixBpe(json.load(open(entries.vocabulary())))


def test_bpe_is_the_librarys(codec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entries.vocabulary())
    t.no_truncation()
    t.no_padding()
    rng = random.Random(7)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ABC '’!?.,;:#&%0123456789", "éèüßñçøΣσςİıŒſ", "日本語漢字かな한국어", "😀👍🏽🎉‍️", "   \u0085\t\n\r\x0b\x1c\x00", "éﬁ½²٣१Ⅷ", "aaaa", "l"]
    texts = ["", "a" * 3000, "<|startoftext|>x<|endoftext|>", "<|startoftext|", "it's WE'LL"]
    for _ in range(1500):
        texts.append("".join("".join(rng.choice(p) for _ in range(rng.randint(1, 9))) for p in rng.choices(pools, k=rng.randint(0, 12))))
    for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        ids = list(codec.encode(s))
        assert ids == e.ids, s
        assert codec.decode(ids) == t.decode(e.ids, skip_special_tokens=False)


def test_bpe_tables(spark, codec):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (3, ""), (4, "x" * 5000)]
    got = {r.doc_id: r for r in bpe.encode_digests(docs_of(spark, rows), entries.vocabulary()).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[3].decoded_sha256
    assert got[1].ids_sha256 == hashlib.sha256(np.array(codec.encode("Hello wörld"), dtype="<u4").tobytes()).hexdigest()
    out = bpe.encode_texts(docs_of(spark, rows).withColumn("ids", F.lit("old")), entries.vocabulary(), decoded="decoded")
    first = out.filter("doc_id = 1").first()
    assert first.ids == list(codec.encode("Hello wörld")) and first.decoded.startswith("hello</w>")
    assert bpe.encode_texts(docs_of(spark, []), entries.vocabulary()).count() == 0


def brute_lm(rows, mu):
    """Scores by the recursive formula over plain dictionaries of words, pairs and triples."""
    grams, texts = collections.Counter(), []
    for i, t in rows:
        w = [*lower(t or "").translate(str.maketrans(WHITE, " " * 6)).split(), "\n"]
        train = i is not None and zlib.crc32(str(i).encode()) % 10 != 0
        texts.append((i, w, train))
        if train:
            whole = ["\t", *w]
            grams.update((x,) for x in w)
            grams[("\t",)] += 1
            grams.update(zip(whole, w))
            grams.update(zip(whole, w, w[1:]))
    c = {g[0]: k for g, k in grams.items() if len(g) == 1 and g != ("\t",)}
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    disc = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(history, x):
        if not history:
            return (c[x] - disc) / n if x in c else (disc * v / n if n else 1.0)
        m = mu[len(history) - 1]
        return (grams[(*history, x)] + m * p(history[1:], x)) / (grams[history] + m)

    for i, w, train in texts:
        whole = ["\t", *w]
        score = sum(math.log10(p(tuple(whole[max(0, k - 2) : k]), whole[k])) for k in range(1, len(whole)))
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        yield i, not train, len(w), sum(x in c for x in w), n, round(base, 6), round(score, 6)


# A fan of three: asks are merged in groups, twice over.
@pytest.mark.parametrize(("block", "fan"), [(40, 1024), (1 << 20, 1024), (150, 3), (150, 5)])
def test_lm_against_brute_force(spark, block, fan):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the a of cat dog ran Über".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "never seen words"), (92, "never seen words"), (None, "the cat")]
    mu = (5.0, 2.0)
    got = lm.score_texts(docs_of(spark, rows), mu=mu, block_bytes=block, range_bytes=500, fan=fan).collect()
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert got == sorted((x[0] or -1, *x[1:]) for x in ((i if i is not None else -1, *r) for i, *r in brute_lm(rows, mu)))


def test_lm_without_training_texts_or_rows(spark):
    empty = lm.score_texts(docs_of(spark, [(None, "a b"), (None, None)])).collect()
    assert [r.train_tokens for r in empty] == [0, 0] and all(r.score == 0 for r in empty)
    assert lm.score_texts(docs_of(spark, [])).count() == 0


def test_lm_counts_past_32_bits():
    keys = np.array([8, 16, 1 << 62], dtype=np.uint64) + np.uint64(1)
    counts = np.array([1 << 40, 3, (1 << 32) + 1])
    whole, sums, _ = lm._summed([lm.packed(keys), lm.packed(keys[1:])], [lm.planes(counts), lm.planes(counts[1:])])
    assert whole.tolist() == keys.tolist() and sums.tolist() == [1 << 40, 6, (1 << 33) + 2]


def test_lm_automaton_falls_back_twice_and_sums_to_one():
    texts = [b"a b a c", b"a b", b"b a b"]
    vocabulary = [b"a", b"b", b"c", b"new"]
    # One further text for each history and next word: its tokens are in the block but not in the training texts.
    histories = [(), (b"a",), (b"a", b"b"), (b"b", b"a"), (b"c", b"a"), (b"a", b"c")]
    probes = [b" ".join((*h, w)) for h in histories for w in vocabulary]
    block = lm.Block(texts + probes)
    keys, counts = block.counts(np.array([True] * len(texts) + [False] * len(probes)))
    words = counts[keys & np.uint64(3) == 1].astype(np.int64)
    n, v = int(words.sum()), int((words > 0).sum())
    auto = lm.Automaton(block, counts.astype(np.int64), n, v, int((words == 1).sum()), int((words == 2).sum()), (3.0, 2.0))

    def step(text, after):
        """log10 probability of the token `after` words into a text."""
        return auto.traverse(int(block.first[text]), after + 1) - (auto.traverse(int(block.first[text]), after) if after else 0.0)

    for k, h in enumerate(histories):
        at = len(texts) + k * len(vocabulary)
        whole = sum(10 ** step(at + j, len(h)) for j in range(len(vocabulary)))
        assert 0 < whole < 1
        # What is missing from one is the end's own probability.
        text = next((i for i, p in enumerate(texts + probes) if p.split() == list(h) and h), None)
        if text is not None:
            assert abs(whole + 10 ** step(text, len(h)) - 1) < 1e-9
    # From the state (a, b) no arc for `new` leads on: the failure arcs to b and to the root are followed, and the next state is the root.
    first = int(block.first[len(texts) + 2 * len(vocabulary) + 3])
    pair = int(auto.pairs[first + 1])
    assert auto.held[pair] == 2 and auto.fail[pair] == int(auto.words[first + 1]) and auto.fail[auto.fail[pair]] == auto.root
    want = auto.traverse(first, 2) + auto.fail_weight[pair] + auto.fail_weight[auto.fail[pair]] + auto.weight[int(auto.words[first + 2])]
    assert abs(auto.traverse(first, 3) - want) < 1e-12 and auto.target[int(auto.words[first + 2])] == auto.root


def test_topk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=20).round(2)], 0) for i in range(400)]
    rows += [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 20, 0), (403, [float("inf")] * 20, 0), (404, [1e30] * 20, 0), (405, [], 0), (406, [2.0, 1.0], 0), (None, [1.0] * 20, 0), (7, rows[7][1], 1), (8, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e4 for x in v)]
    want = []
    for q, v in {i: v for i, v in reversed(fine) if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    for groups in (8192, 50):
        monkeypatch.setattr(topk, "GROUP_ROWS", groups)
        assert sorted(tuple(r) for r in topk.every_fiftieth(df).collect()) == sorted(want)
    assert topk.every_fiftieth(df.limit(0)).count() == 0


def test_topk_keeps_large_vectors_and_is_exact(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=20) * [1, 20000, 3e5, 2e6][i % 4]]) for i in range(300)]
    # Scores beyond 2^53 that differ by little, and ties.
    rows += [(i, [4e5 + (i % 7) / 256] + [0.0] * 19) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in fine:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    assert max(s for *_, s in want) > 2**53
    assert sorted(tuple(r) for r in topk.every_fiftieth(df).collect()) == sorted(want)


def test_branch_and_bound_skips_and_is_exact():
    rng = np.random.default_rng(9)
    c = rng.integers(-200, 200, size=(64, 2000)) * np.where(np.arange(64) < 16, 10, 1)[:, None]
    q = c[:, :10].astype(float)
    best = topk._Best(10, 3)
    done = [topk.search_block(q, np.arange(10), c[:, a : a + 500].astype(float), np.arange(a, a + 500), best) for a in range(0, 2000, 500)]
    exact = q.T @ c
    exact[np.arange(10), np.arange(10)] = -np.inf
    assert (best.score == -np.sort(-exact, axis=1)[:, :3]).all()
    assert done[0] == 10 * 500 - 10 and sum(done[1:]) < 10 * 1500 / 20  # without a k-th best score there is no bound yet


def toxic_tables(spark):
    rng = random.Random(11)
    good, bad = [f"word{c}" for c in "abcdefghijklmnop"], ["blockhead", "rotter", "dimwit"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(good) for _ in range(rng.randint(8, 60))]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores(spark):
    docs, labels = toxic_tables(spark)
    lexicon = toxicity.learn(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_texts(docs, lexicon).collect()}
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (i % 5 == 0), i
    assert lexicon.score("you B1OCKHEAD, d1mw1t and rоtter") > 0.7 > lexicon.score(None) == lexicon.score("")
    assert lexicon.score("wordh " * 20000) < 0.3
    assert toxicity.drop_toxic(docs, lexicon).count() == 480


def test_toxicity_exceptions_and_missing_labels(spark):
    lexicon = toxicity.Lexicon({" scunt": 5.0, " ass": 4.0}, (" assess ", " ass pack  mule "))
    total = lambda s: sum(lexicon.matched(toxicity.fold(s)).values())
    assert total("assess the class") == 0 and total("you ass") == 4 and total("ASS assess") == 4
    docs, labels = toxic_tables(spark)
    none = toxicity.learn(docs, labels.limit(0))
    assert none.score("anything") < 0.01 and toxicity.learn(docs, labels.filter("toxic = 1")).score("x") > 0.9
    assert toxicity.score_texts(docs.limit(0), none).count() == 0


@pytest.mark.parametrize(("before", "after"), [("64m", "8388608"), ("67108864b", "8388608"), ("1mb", "1mb"), ("4096", "4096")])
def test_batches_of_texts_are_bounded(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        common.small_batches(spark)
        assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, old)


def test_folding():
    same = lambda a, b: toxicity.fold(a) == toxicity.fold(b)
    assert same("b\u200ba\u00add", "bad") and same("bàd́", "bad") and same("Ꭺss", "ass") and same("νile", "vile") and same("ｂａｄ", "bad") and same("b@d", "bad") and same("рrоvе", "prove")
    assert toxicity.fold("call 4711 now") == [toxicity.fold("call")[0], "4711", "now"] and not same("vile", "nile")
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("\u200b") == []


def brute_matches(lexicon, words):
    """Weights by word: the longest entry that each begins with, unless the word lies in an exception."""
    free = set()
    for e in lexicon.exceptions:
        parts = e.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                free |= set(range(k, k + len(parts)))
    out = 0.0
    for k, w in enumerate(words):
        fits = [e for e in lexicon.weights if (e == f" {w} " if e.endswith(" ") else w.startswith(e[1:]))]
        if fits and k not in free:
            out += lexicon.weights[max(fits, key=len)]
    return out


def test_matches_against_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    weights = {e: rng.random() for w in rng.sample(words, 20) for e in rng.sample(toxicity.entries_of(w, 2, 5), 1)}
    phrases = tuple({toxicity.phrase_of(rng.sample(words, rng.randint(1, 3))) for _ in range(12)})
    lexicon = toxicity.Lexicon(weights, phrases)
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        assert abs(sum(lexicon.matched(text).values()) - brute_matches(lexicon, text)) < 1e-9


def test_toxicity_learns_phrases_as_exceptions(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(20))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        # The word is toxic but for "blaster rocket" and "blaster valve", of which clean texts speak.
        inside = f"you blaster {rng.choice(['fool', 'pig', 'swine'])}" if toxic else rng.choice(["the blaster rocket", "a blaster valve", "none", "none", "none", "none", "none", "none"])
        rows.append((i, f"{filler()} {inside} {filler()}"))
        labels.append((i, int(toxic)))
    lexicon = toxicity.learn(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), min_ratio=3.0)
    assert any(len(e.split()) == 2 for e in lexicon.exceptions)
    assert lexicon.score(f"{filler()} the blaster rocket {filler()}") < 0.5 < lexicon.score(f"{filler()} you blaster pig {filler()}")
