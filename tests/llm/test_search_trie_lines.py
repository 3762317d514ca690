"""Ranked search, conversation trie and line dedup against plain versions, on odd and hot small tables."""
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from edge_tables import edge_docs, edge_rows, no_docs  # noqa: F401
import brute

from featurelab.llm import lexical_search, line_dedup, prefix_trie
from featurelab.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --------------------------------------------------------------------- search
def _ranked(docs, items, k=10):
    words = [(i, collections.Counter(TERM.findall(brute.lower_az(t or "")))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(sum(w.values()) for _, w in words)
    df = collections.Counter(t for _, w in words for t in w)
    out = []
    for item, text in items:
        q = collections.Counter(TERM.findall(brute.lower_az(text or "")))
        scores = []
        for i, w in words:
            m = 100 - 75 + (75 * sum(w.values()) * n) // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w[t]) // (1000 * w[t] + 8 * m)) for t, c in q.items() if t in w)
            if s > 0 and i is not None:
                scores.append((-s, i))
        if item is not None:
            out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def _search(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, query int, length double").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    return sorted(tuple(r) for r in lexical_search.search(d, q, **options).select("item_id", "rank", "doc_id", "score").collect())


def test_search_matches_its_definition_on_odd_rows(spark, edge_rows, no_docs):
    docs = [*edge_rows, (6, edge_rows[6][1]), (None, edge_rows[7][1]), (99, "É é È"), (98, "a" * 200_000 + " one")]
    items = [(1, "one two words"), (2, None), (3, ""), (4, " !? "), (5, edge_rows[9][1]), (6, "one ONE one"), (7, "É"), (None, "one"), (8, "nowhere"),
             (9, edge_rows[15][1]), (10, "日本 wheel")]
    want = _ranked(docs, items)
    assert len(want) > 30
    assert _search(spark, docs, items) == want
    assert _search(spark, docs, items, block_terms=7) == want  # several blocks of queries
    assert _search(spark, docs, items, k=2) == _ranked(docs, items, 2)
    assert lexical_search.search(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_search.search(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_of_hot_copies_keeps_ties_and_prunes(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(vocabulary[int(3000 * rnd.random() ** 3)] for _ in range(n))
    docs = [(i, text(rnd.randint(5, 120))) for i in range(1500)]
    docs += [(i, docs[3][1] + " extra") for i in range(2000, 2900)]  # copies: ties go to the smaller id
    items = [(k, docs[rnd.randrange(1500)][1]) for k in range(12)] + [(50, docs[3][1]), (51, "w0 w1 w2")]
    scored = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(lexical_search.common, "BATCH_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert _search(spark, docs, items, scored=scored) == _ranked(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 0 < scored.value < 0.6 * len(docs) * len(items)


# ----------------------------------------------------------------------- trie
def _rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def _trie(rows):
    convs = _rebuilt(rows)
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    if not convs:
        return []
    leaves, saved, kids = collections.Counter(), collections.Counter(), collections.Counter(k[:-1] for k in members if k)
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += own
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _check_trie(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)
    assert got == _trie(rows)
    return got


def test_trie_of_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "é"), (0, 1, "user", "a"), (0, 1, "user", "a"), (None, 0, "user", "x"), (3, 0, "", ""), (3, 0, "", ""),
            (7, 5, "ab", "c"), (7, 6, "a", "bc"), (-3, 0, "user", "neg"), (-8, 0, "user", "neg"), (-5, 0, "user", "base"), (2 ** 62, 0, "user", "x" * 300_000)]
    assert len(_check_trie(spark, rows)) == 7
    assert _check_trie(spark, []) == []
    assert len(_check_trie(spark, [(1, 0, "user", "only")])) >= 1


@pytest.mark.parametrize("shard_rows", [3, 40])
def test_trie_of_deep_and_wide_conversations_in_small_shards(spark, shard_rows):
    rnd = random.Random(shard_rows)
    rows = [(c, t, "user", rnd.choice("ab")) for c in range(60) for t in range(rnd.randint(1, 14))]
    rows += [(5, t, "user", f"long {t % 7}") for t in range(20, 420)]  # a conversation of a third of all turns
    rows += [(c, 0, "user", "hot first turn") for c in range(100, 400)]  # copies, a hot node
    base = [("user", f"grow {k}") for k in range(30)]
    rows += [(500 + 7 * k, t, *base[t]) for k in range(30) for t in range(k + 1)]  # each goes one turn beyond the one before
    monkey = prefix_trie.PIECE
    prefix_trie.PIECE = 50
    try:
        _check_trie(spark, rows, shard_rows=shard_rows, queue_rows=5)
    finally:
        prefix_trie.PIECE = monkey


def test_spilling_queue_gives_messages_in_order():
    rnd = random.Random(1)
    queue, plain = prefix_trie.SpillingQueue(8), collections.defaultdict(list)
    for depth in range(30, -1, -1):
        for conv in range(20, -1, -1):
            key = (-depth, -conv)
            assert sorted(queue.take(key)) == sorted(plain.pop(key, []))
            for _ in range(rnd.randint(0, 3)):
                m = (1 - depth, -rnd.randint(0, conv), rnd.randint(0, 9), rnd.randint(0, 9))
                if depth:
                    queue.push(m)
                    plain[m[:2]].append(m)
    assert queue.runs > 5 and not any(plain.values())


# ---------------------------------------------------------------------- lines
def _kept(rows):
    strip = "\x20\t\n\x0b\x0c\r"
    lines = [(i, [(x, brute.lower_az(x.strip(strip))) for x in (t or "").split("\n")]) for i, t in rows]
    holders = collections.defaultdict(set)
    for i, ls in lines:
        if i is not None:
            for _, k in ls:
                if len(k) >= 20:
                    holders[k].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, ls in lines:
        left = [x for x, k in ls if i is None or k not in gone or gone[k] == i]
        out.append((i, len(ls), len(ls) - len(left), brute.sha("\n".join(left).encode())))
    return sorted(out, key=str)


def _lines(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "r") for i, t in rows], "doc_id long, text string, pos int, keep_runs string").repartition(3)
    out = line_dedup.drop_repeats(df)
    text, runs = F.col("text"), F.col("keep_runs")
    out = out.select("doc_id", line_dedup.n_lines(text).alias("n"), line_dedup.n_dropped(runs).alias("g"),
                     F.sha2(line_dedup.kept_text(text, runs), 256).alias("h"), *[F.col("pos")])
    return sorted((tuple(r)[:4] for r in out.collect()), key=str)


def test_line_dedup_of_odd_rows(spark, edge_rows, no_docs):
    long_line = "A line that repeats in several documents"
    rows = [*edge_rows, (100, f"{long_line}\nx\n{long_line}\n"), (101, f"\t {long_line.upper()} \r\ny"), (102, f"z\n\x0b{long_line}\n\n"), (102, long_line),
            (None, long_line), (103, "é" * 19 + "\n" + "é" * 20), (104, "é" * 20 + "\n" + "é" * 19), (105, "é" * 20 + " \n" + "é" * 19), (106, "É" * 20),
            (107, "\n" * 5), (108, (long_line + "\n") * 30 + "own"), (109, "q" * 1_200_000 + "\n" + long_line)]
    assert _lines(spark, rows) == _kept(rows)
    assert line_dedup.drop_repeats(no_docs).count() == 0


def test_line_dedup_of_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice(["the license line of all documents", "another line of many documents", f"a line that is only in {i // 3}",
                                      f"a line that is only in {i // 2}", "short"]) for _ in range(rnd.randint(1, 9)))) for i in range(400)]
    rows += [(7, rows[7][1]), (3, rows[9][1])]
    got = _lines(spark, rows)
    assert got == _kept(rows) and sum(r[2] for r in got) > 300


def test_line_bitmaps_are_native_and_dealt_by_range(spark, edge_docs):
    bitmaps = line_dedup.keep_bitmaps(edge_docs)
    plan = bitmaps._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert "text" not in bitmaps.columns
    line = plan[:plan.index("rangepartitioning")]
    assert "hashpartitioning(h1" not in line[line.index("Window"):]  # the window takes the range-dealt rows as they are


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_conversation_trie", "op13_line_dedup"])
def test_new_queries_match_their_oracles_at_the_next_size(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name]).fetch_df()
    got = QUERIES[name](spark, sf).select(*want.columns).toPandas()
    assert len(got) == len(want) > 0
    flat = lambda p: sorted(p.fillna(-1).astype(str).agg("|".join, axis=1).str.replace(r"\.0\b", "", regex=True))
    assert flat(got) == flat(want)
