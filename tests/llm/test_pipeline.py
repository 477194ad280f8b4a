"""The pipeline: each stage against brute force on a small corpus, and on odd rows."""

import collections
import hashlib
import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_operators import WHITE, brute_contamination, brute_matches, brute_near_copies, lower

from photonlake.llm import entries, simhash, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    """Rows (doc_id, text), labels and benchmark: toxic and clean texts, lines that many share, copies and near copies, and benchmark passages, whole and in part."""
    rng = random.Random(12)
    words = [f"word{k}" for k in range(3000)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [f"{passage(8)} shared line {k}" for k in range(3)]
    bench = [(f"item{k}", passage(n)) for k, n in enumerate((30, 13, 8, 60))]
    rows, labels = [], []
    for k in range(160):
        text = "\n".join(passage(rng.randint(10, 40)) for _ in range(3))
        toxic = k % 5 == 0
        if toxic:
            text += " you moron and scumbag " + passage(5)
        if k % 4 == 1:
            text += "\n" + rng.choice(shared)
        if k % 20 == 3:
            text += "\n" + bench[k // 20 % 4][1]
        if k % 20 == 13:
            text += "\n" + " ".join(bench[3][1].split()[:12])  # one word short of a window
        rows.append((k, text))
        if k % 7:
            labels.append((k, int(toxic)))
    for k in range(40):
        base = rows[4 * k + 2][1].split(" ")
        at = rng.randrange(len(base) - 2)
        near = base[:at] + ["changed"] * (k % 3) + base[at + k % 3 :]
        rows.append((1000 + k, " ".join(near)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2003, "one")]
    return rows, labels, bench


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, labels, bench = corpus()
    sf = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), rows, bench


def brute_toxic(spark, sf, rows):
    """Rows whose score, from matches found word by word, stays below 0.7."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def score(text):
        folded = toxicity.fold(text)
        total = brute_matches(lexicon, folded)
        z = lexicon.bias + lexicon.slopes[0] * math.log1p(total) + lexicon.slopes[1] * math.log1p(100 * total / (len(folded) + 20))
        return 1 / (1 + math.exp(-z))

    return [(i, t) for i, t in rows if score(t) < 0.7]


def brute_lines(rows):
    key = lambda x: lower(x.strip(WHITE))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= 5}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i)) for i, t in rows]


def brute_kept(rows):
    first = dict(brute_near_copies(rows))
    return [(i, t) for i, t in rows if first[i] == i]


def brute_clean(rows, bench):
    return [(i, t) for i, t in rows if not brute_contamination(t, bench)[4]]


def test_stages_against_brute_force(spark, made):
    """Each stage gets what the one before left, and keeps just the rows and texts that the plain version keeps."""
    sf, rows, bench = made
    now, docs = rows, spark.read.parquet(f"{sf}/documents.parquet")
    plain = {"toxicity": lambda r: brute_toxic(spark, sf, r), "line_dedup": brute_lines, "near_duplicates": brute_kept, "decontamination": lambda r: brute_clean(r, bench)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, sf), plain[name](now)
        assert out.dtypes == docs.dtypes, name
        got = out.select("doc_id", "text", "n_chars").collect()
        assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want), name
        assert collections.Counter(want) != collections.Counter(now), name  # the corpus has work for every stage
        assert all(r.n_chars == len(r.text or "") for r in got), name
        now, docs = want, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in want], COLUMNS)
    import tokenizers

    library = tokenizers.Tokenizer.from_file(entries.vocabulary())
    library.no_truncation()
    library.no_padding()
    for r in STAGES["bpe"](spark, docs, sf).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf).collect()) == collections.Counter(now)


def test_planted_cases_are_caught_and_clean_texts_stay(spark, made):
    sf, rows, bench = made
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    calm = ids(STAGES["toxicity"](spark, docs, sf))
    assert {i for i, _ in rows} - calm == {k for k in range(0, 160, 5)} | {1000 + k for k in range(40) if (4 * k + 2) % 5 == 0}
    clean = ids(STAGES["decontamination"](spark, docs, sf))
    assert {i for i, _ in rows} - clean == {i for i, t in rows if brute_contamination(t, bench)[4]} and 13 in clean


def test_stages_on_real_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, now = docs.count(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.dtypes == docs.dtypes, name
        assert now.count() <= n
        n = now.count()
    assert 0 < n < docs.count() and set(docs.columns) < set(now.columns)
    assert now.filter("n_tokens <> size(ids)").count() == 0


ODD = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "x"), (None, None), (4, "0 " * 30_000)]
#: What stays of the odd rows, by stage: null and empty texts are copies of one another only for near_duplicates, where rows without an id stay.
LEFT = {"near_duplicates": [1, 3, 3, None, None, 4]}


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty_and_odd_rows(spark, name):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], COLUMNS)
    out = STAGES[name](spark, docs, SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, LEFT.get(name, [i for i, _ in ODD])))
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0
    clashing = docs.withColumn("N_TOKENS", F.lit("mine")).withColumn("Ids", F.lit("mine")).withColumn("__text", F.lit("mine")).withColumn("toxic", F.lit("mine"))
    out = STAGES[name](spark, clashing, SF)
    assert out.filter("__text = 'mine' AND toxic = 'mine'").count() == out.count()
    if name == "bpe":
        assert dict(out.dtypes)["n_tokens"] == "bigint" and len({c.lower() for c in out.columns}) == len(out.columns)
    else:
        assert out.dtypes == clashing.dtypes


def test_recall_of_near_copies_by_band(spark):
    """Pairs of texts on either side of the similarity: with exact, all of 0.8 and more are found; by least shingles, all but a few."""
    rng = random.Random(31)
    rows, similar = [], {}
    for k in range(400):
        base = [f"k{k}w{j}" for j in range(rng.choice([20, 60, 150]))]
        copy = list(base)
        at, n = rng.randrange(len(copy)), rng.randint(0, max(1, len(copy) // 8))
        copy[at : at + n] = ["new"] * n
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = (set(simhash.shingle_set(t.encode()).tolist()) for _, t in rows[-2:])
        similar[k] = len(a & b) / len(a | b)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    bands = collections.Counter(min(9, int(s * 10 + 1e-9)) for s in similar.values())
    assert bands[8] > 30 and bands[9] > 30 and sum(n for b, n in bands.items() if b < 8) > 30
    for exact in (True, False):
        got = {r.id: r.component_id for r in simhash.near_copies(docs, exact=exact).collect()}
        found = collections.Counter(min(9, int(s * 10 + 1e-9)) for k, s in similar.items() if got[2 * k + 1] == 2 * k)
        assert all(got[2 * k + 1] == 2 * k + 1 for k, s in similar.items() if s < 0.8)
        assert (found[8], found[9]) == (bands[8], bands[9]) if exact else found[8] >= 0.99 * bands[8] and found[9] == bands[9]


def test_digest_queries_and_stage_agree(spark, made):
    """The stage writes what the query of its operator describes."""
    sf, _, _ = made
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = collections.Counter((r.doc_id, r.kept_sha256) for r in entries.op1_line_dedup(spark, sf).collect())
    got = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in STAGES["line_dedup"](spark, docs, sf).collect())
    assert got == want
