"""Operators over a corpus, against plain Python, and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def prose(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


# --- near-dedup ----------------------------------------------------------------------------------------------------------


def sets_of(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """doc_id: (size of the set, smallest id reachable)."""
    sets = {i: sets_of(t) for i, t, _ in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed):
    """A large group of copies that drift apart, some small groups, and texts of their own."""
    r = random.Random(seed)
    base = prose(r, 150).split()
    rows = []
    for _ in range(60):
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(words))
    for _ in range(10):
        t = prose(r, 60)
        rows += [t, t.upper(), t + " end", t.replace(" ", "\n")]
    rows += [prose(r, 80) for _ in range(40)] + ["one two", "One  two", "", " ", None]
    r.shuffle(rows)
    return [(10 * i + 3, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed):
    from nearfield.llm.near_dedup import keep_one, near_duplicates

    rows = copies(seed)
    df = docs(spark, rows).withColumn("row", F.lit("x")).withColumn("node", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    want = components(rows)
    assert got == want
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_pipeline_links_from_four_fifths(spark):
    """Pairs of 0.80 to 0.85 are one group in the pipeline's stage, and two in op7's limit; those below 0.80 stay apart."""
    import corpus_pipeline
    from nearfield.llm.near_dedup import keep_one

    r = random.Random(11)
    rows, near, far = [], 0, 0
    for k in range(60):
        words = prose(r, 104, 10**6).split()
        changed = list(words)
        # 100 shingles; two changed words apart lose 10, a third one to five more
        for p in (20, 50) if k % 2 else (20, 50, 80):
            changed[p] = f"y{k}"
        a, b = sets_of(" ".join(words)), sets_of(" ".join(changed))
        near, far = near + (0.8 <= len(a & b) / len(a | b) < 0.85), far + (len(a & b) / len(a | b) < 0.8)
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(changed), "s")]
    assert (near, far) == (30, 30)
    df = docs(spark, rows)
    assert corpus_pipeline.near_dedup(spark, df, DATA).count() == 120 - near
    assert keep_one(df).count() == 120


def test_near_dedup_edges(spark):
    from nearfield.llm.near_dedup import keep_one, near_duplicates

    t = prose(random.Random(3), 40)
    df = docs(spark, [(None, t, "s"), (7, t, "s"), (7, t, "s"), (9, t, None), (None, "alone in here", "s"), (4, "", "s"), (5, None, "s"), (6, "y " * 3000, "s")])
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_duplicates(df).collect())
    assert rows == sorted([("None", "7"), ("7", "7"), ("7", "7"), ("9", "7"), ("None", "None"), ("4", "4"), ("5", "5"), ("6", "6")])
    assert sorted(str(r["doc_id"]) for r in keep_one(df).collect()) == ["4", "5", "6", "7", "None"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_blocks_find_what_pivots_miss():
    """Links between classes of different roots, whatever their place in a block."""
    import numpy as np

    from nearfield.llm.near_dedup import _unit_links

    a = np.arange(100)
    held = [(1, 1, 0, True, a), (2, 1, 0, True, a[:50]), (3, 3, 0, True, np.concatenate([a[:95], [500]])), (4, 4, 0, True, np.arange(1000, 1100))]
    assert sorted(map(sorted, _unit_links(held))) == [[1, 3]]
    assert _unit_links(held[:2]) == []


def test_min_max_hash_is_unbiased():
    import numpy as np

    from nearfield.llm.minhash import signature

    g = np.random.default_rng(1)
    shares = []
    for _ in range(30):
        x = g.integers(0, 1 << 63, 300, dtype=np.uint64)
        shares.append((signature(x[:200]) == signature(x[50:250])).mean())
    assert np.mean(shares) == pytest.approx(150 / 250, abs=0.03)


def test_roots_of_a_chain(spark):
    from nearfield.llm.near_dedup import roots

    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 30), (30, 40), (35, 35)], "a long, b long")
    got = {r["node"]: r["root"] for r in roots(edges).collect()}
    assert {got[k] for k in range(21)} == {0}
    assert (got[40], got[30]) == (30, 30)


# --- line dedup ------------------------------------------------------------------------------------------------------------


def cut_brute(rows, min_sites):
    seen = {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if re.search("[^\x20\x09-\x0d]", line):
                seen.setdefault(line.strip(" "), []).append(((i is None, i or 0, p), s))
    gone = {line: min(w for w, _ in at) for line, at in seen.items() if len({s for _, s in at}) >= min_sites}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if gone.get(x.strip(" "), (i is None, i or 0, p)) == (i is None, i or 0, p)) for i, t, s in rows}


def test_lines(spark):
    from nearfield.llm.line_dedup import without_boilerplate

    r = random.Random(5)
    pool = [f"line {k}" for k in range(30)] + ["", " ", "  All rights reserved. ", "All rights reserved."]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.3 else f"own {i} {k}" for k in range(r.randint(1, 12))), r.choice(["a", "b", "c", "d", None])) for i in range(80)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "\n\n", None)]
    df = docs(spark, rows).withColumn("place", F.lit("x")).withColumn("h1", F.lit("y"))
    out = without_boilerplate(df)
    assert out.drop("__lines", "__cut").columns == df.columns
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert got == cut_brute(rows, 3)
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in out.collect())
    assert without_boilerplate(df.limit(0)).count() == 0


def test_many_sites_and_hot_lines(spark):
    """Far from the limit sketches decide; a line on every row is cut everywhere but once."""
    from nearfield.llm.line_dedup import without_boilerplate

    rows = [(i, f"everywhere\nown {i}\n{'x' * 3000 if i == 0 else ''}", f"site{i}") for i in range(200)]
    got = {x["doc_id"]: x["text"] for x in without_boilerplate(docs(spark, rows)).collect()}
    assert got == cut_brute(rows, 3)
    twice = docs(spark, [(1, "a\nb", "x"), (1, "a\nb", "x"), (2, "a", "y"), (None, "a", "z")])
    assert sorted(x["text"] for x in without_boilerplate(twice).collect()) == ["", "", "a\nb", "a\nb"]


# --- decontamination -------------------------------------------------------------------------------------------------------


def hits_brute(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination_is_exact(spark, block_words):
    from nearfield.llm.decontaminate import find_contamination

    r = random.Random(6)
    items = [(k, prose(r, r.choice((1, 3, 12, 13, 14, 30, 90)), 6)) for k in range(14)] + [(20, None), (21, ""), (22, "...")]
    texts = []
    for _ in range(60):
        words = prose(r, r.randint(0, 60), 6).split()
        if r.random() < 0.5:
            own = r.choice(items[:14])[1].split()
            at = r.randrange(len(own))
            words += [w.upper() for w in own[at : at + 20]]
        texts.append(r.choice((" ", ", ", "\n")).join(words))
    rows = [(i, t, "s") for i, t in enumerate([*texts, None, "", "é" * 2000, "a-b " * 3000])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    df = docs(spark, rows).withColumn("hits", F.lit("x")).withColumn("n_words", F.lit("x"))
    got = find_contamination(df, bench, block_words=block_words).orderBy("doc_id").collect()
    for row, (_, text, _) in zip(got, rows, strict=True):
        assert (row["n_words"], row["n_hit"], row["item_ids"]) == hits_brute(text, items)
        assert sum(h["end"] - h["start"] for h in row["hits"]) == row["n_hit"]
    assert find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(df.limit(0), bench).count() == 0


def test_items_that_repeat_themselves_cost_no_more():
    """The climb over a state's ancestors is done once for all words."""
    import time

    import numpy as np

    from nearfield.llm.decontaminate import SuffixAutomaton

    a = SuffixAutomaton([("1", [b"ha"] * 8000), ("2", [b"ha"] * 3), ("3", [b"ho", b"ha"])])
    hit, found, began = np.zeros(20_001, bool), set(), time.process_time()
    assert a.scan([b"ho", *[b"ha"] * 20_000], hit, found) == 8000
    assert time.process_time() - began < 0.5
    assert hit.all()
    assert found == {"1", "2", "3"}


def test_many_blocks_are_one_worker(spark):
    """Whatever the number of blocks, a task has one Python worker, and its rows are sent on in chunks."""
    from nearfield.llm import decontaminate

    items = spark.range(300).selectExpr("id as item_id", "array_join(transform(sequence(1, 20), x -> concat('w', id, 'x', x)), ' ') as text")
    texts = spark.range(500).selectExpr("id as doc_id", "concat('so ', array_join(transform(sequence(3, 18), x -> concat('W', id, 'x', x)), ' ')) as text")
    out = decontaminate.find_contamination(texts, items, block_words=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in out.collect()}
    assert got == {k: (16, [str(k)]) if k < 300 else (0, []) for k in range(500)}


def test_chunks_hold_all_batches():
    import pyarrow as pa

    from nearfield.llm.decontaminate import _chunks

    batches = [pa.record_batch({"x": list(range(k))}) for k in (3, 0, 5, 1)]
    for size in (0, 30, 1000):
        chunks = list(_chunks(iter(batches), size))
        assert [b for c in chunks for b in c] == batches
    assert len(list(_chunks(iter(batches), 1000))) == 1
    assert list(_chunks(iter([]), 5)) == []


def test_removal(spark):
    from nearfield.llm.decontaminate import remove_contamination

    r = random.Random(8)
    item = prose(r, 20)
    clean, light = prose(r, 50, 10**6), prose(r, 400, 10**6)
    rows = [(1, clean, "s"), (2, f"{clean}\n{item}. {clean}", "s"), (3, f"{light} {item}", "s"), (4, item, "s"), (5, None, "s"), (5, None, "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = docs(spark, rows).withColumn("hits", F.lit("x")).withColumn("_own_hits", F.lit("y")).withColumn("N_Hit", F.lit("z"))
    out = remove_contamination(df, bench)
    assert out.schema == df.schema
    assert {(x["hits"], x["_own_hits"], x["N_Hit"]) for x in out.collect()} == {("x", "y", "z")}
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()}
    cut = f"{clean}\n. {clean}"
    assert got == {1: (clean, len(clean)), 2: (cut, len(cut)), 3: (rows[2][1], len(rows[2][1])), 5: (None, None)}


# --- the registered queries and the pipeline ---------------------------------------------------------------------------


def test_shuffles_in_place_of_broadcasts(spark, monkeypatch):
    """With nothing small enough to be broadcast the results are the same."""
    from nearfield.llm import line_dedup, near_dedup, quality
    from nearfield.llm.queries import QUERIES

    names = ("op5_quality", "op7_near_dedup", "op9_line_dedup")
    few = {n: sorted(map(str, QUERIES[n](spark, DATA).collect())) for n in names}
    broadcasts = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcasts)
    try:
        spark.conf.set(broadcasts, -1)
        for module, bound in ((line_dedup, "BROADCAST_ROWS"), (near_dedup, "BROADCAST_ROWS"), (quality, "BROADCAST_STRATA")):
            monkeypatch.setattr(module, bound, -1)
        for n in names:
            out = QUERIES[n](spark, DATA)
            assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, out.collect())) == few[n]
    finally:
        spark.conf.set(broadcasts, before)


def test_recall_of_near_duplicates_against_all_pairs(spark):
    """On a tenth of the given documents by source, all of whose pairs are compared: every link is found, as components are equal."""
    from nearfield.llm.near_dedup import near_duplicates

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 4000")
    rows = [(r["doc_id"], r["text"], "s") for r in d.collect()]
    for limit in (85,):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(d, limit).collect()}
        assert got == components(rows)


def test_registered_sentencepiece(spark):
    """On whole given texts: the pieces decode to the text, the score is that of the pieces, and the N best are N different segmentations of falling score, none better found by another search."""
    import numpy as np

    from nearfield.llm.queries import QUERIES
    from nearfield.llm.sentencepiece_nbest import Encoder, Vocabulary, changed

    v = Vocabulary.load()
    e = Encoder(v)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        if text is None:
            assert r["ids"] is None
            continue
        assert r["exact"]
        assert r["n_pieces"] == len(r["ids"])
        assert e.decode(np.array(r["ids"], int)) == text
        scores = [b["score"] for b in r["n_best"]]
        assert scores == sorted(scores, reverse=True)
        made = {tuple(changed(r["ids"], [(c["at"], c["cut"], c["ids"]) for c in b["changes"]])) for b in r["n_best"]}
        assert len(made) == len(scores)
        assert all(e.decode(np.array(ids, int)) == text for ids in made)
    short = [r for r in rows if texts[r["doc_id"]] and len(texts[r["doc_id"]]) < 400]
    for r in short[:20]:
        text = texts[r["doc_id"]]
        want = v.n_best(" " + text, len(r["n_best"]))
        assert [b["score"] for b in r["n_best"]] == pytest.approx([s for s, _ in want])


def test_registered_toxicity(spark):
    """On whole given texts: a row a document, scores that no other column changes, a text alone scored as among others, and held-out rows told from clean ones."""
    import zlib

    from nearfield.llm.queries import QUERIES
    from nearfield.llm.toxicity import score_toxicity, train

    where = "/root/testdata/sf0.1"  # the smaller tables hold a few dozen toxic rows to learn from
    d, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, where).collect()}
    assert len(rows) == d.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in rows.items())
    model = train(d, labels)
    other = score_toxicity(d.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang")), model).collect()
    assert all(r["score"] == pytest.approx(rows[-r["doc_id"]]["score"], abs=1e-6) for r in other)
    held = [(rows[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_queries_against_sql(spark):
    import duckdb

    from nearfield.llm.queries import ORACLE_SQL, QUERIES

    d = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        d.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        a, b = QUERIES[name](spark, DATA).toPandas(), d.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None)))


def test_digest_queries(spark):
    """The thin queries give a row for each input row, with the named columns."""
    from nearfield.llm.queries import QUERIES

    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    wanted = {
        "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    }
    for name, columns in wanted.items():
        out = QUERIES[name](spark, DATA)
        assert out.columns == columns
        assert out.count() == n


def test_pipeline_against_plain_python(spark):
    """Each stage on what the one before has kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from nearfield.llm.common import stored

    docs_ = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs_.collect()]
        docs_ = stored(stage(spark, docs_, DATA), name)
        after = {r["doc_id"]: r for r in docs_.collect()}
        if name == "line_dedup":
            assert {i: r["text"] for i, r in after.items()} == cut_brute(before, 3)
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in components(before).items() if i == c}
        elif name == "decontamination":
            for i, text, _ in before:
                n, hit, _ = hits_brute(text, items)
                dirty = hit > 0 and 20 * hit >= n
                if not dirty:
                    assert after[i]["text"] == text
                elif i in after:
                    assert 20 * hits_brute(after[i]["text"], items)[1] < n
        else:
            assert set(after) <= {i for i, _, _ in before}
        if name != "sentencepiece":
            assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r["exact"] for r in after.values())


def test_entry_lists_all_queries():
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", k)[0] for k in __spark_entry__.queries()}
