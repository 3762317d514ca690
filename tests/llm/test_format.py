import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edge_tables import edge_docs, edge_rows, no_docs  # noqa: F401

from featurelab.llm import chat, html, packing, token_counts

SF = "/root/testdata/sf0.001"
#: runs around the length where the encoder cuts them out, and far above it
LONG_SPACES = ["a" + c * n + b for c in (" ", "\t", "\n", " \n", "\u2003", "\x1f ", "\r\n") for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, 30_001)
               for b in ("", "b", "<|endoftext|> b", "'s  x", " " * 9)] + ["x" + c * 2_000_000 + "y" for c in " \t\n"]


@pytest.fixture(scope="module")
def reference_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ packing
def _check_packing(rows, texts, tok, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by_seq.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == capacity or k == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // capacity) + 1 + len(by_seq) // 20


@pytest.mark.parametrize("capacity", [2048, 97])
def test_packing(edge_docs, edge_rows, reference_tokenizer, capacity):
    _check_packing(packing.pack(edge_docs, capacity).collect(), dict(edge_rows), reference_tokenizer, capacity)


def test_long_white_space_in_spark(spark, reference_tokenizer):
    texts = dict(enumerate(LONG_SPACES[-3:] + ["word " * 300_000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    _check_packing(packing.pack(docs).collect(), texts, reference_tokenizer, 2048)
    n = {r["doc_id"]: r["n"] for r in token_counts.token_counts(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert n == {i: len(reference_tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_packing_of_a_whole_table(spark, reference_tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    _check_packing(packing.pack(docs).collect(), texts, reference_tokenizer, 2048)


def test_packing_keeps_ids_repeats_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(docs, keep_ids=True).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1
    assert all(r["ids"][-1] == 0 and len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_ids_equal_the_json_tokenizer(spark, reference_tokenizer):
    odd = ["<|endoftext|> a", "  \n\n\t x  ", "naïve ＡＢ 日本 ​  é", "don't WE'LL 12345 ١٢٣", "\x00\x1f\x7f", "🙂🙂 a" * 20, "a" * 5000, " " * 3000, "\r\n" * 40]
    odd += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd += ["a <|endoftext|>  b<|endoftext|><|endof", "<|endoftext|>", *LONG_SPACES]
    enc = packing.encoder()
    for t in odd:
        assert packing.encode(enc, t).tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids
    assert 50256 in packing.encode(enc, odd[0])


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    hist = {rnd.randint(1, 2048): rnd.randint(1, 5000) for _ in range(rnd.choice([1, 5, 400]))}
    plan = packing.plan_packing(dict(hist))
    used = {}
    for items, n in plan:
        assert sum(items) <= 2048 and n > 0
        for x in items:
            used[x] = used.get(x, 0) + n
    assert used == hist
    waste = sum(n for _, n in plan) * 2048 / sum(k * v for k, v in hist.items())
    assert len(hist) < 400 or waste < 1.01


@pytest.mark.parametrize("most", [1, 6])
def test_the_linear_program_places_most_pieces_at_every_size(most):
    rnd = random.Random(most)
    hist = {n: rnd.randint(1, most) for n in rnd.sample(range(1, 2048), 700)}
    lengths = np.array(sorted(hist))
    solved = packing._solve(lengths, np.array([hist[n] for n in lengths]), 2048, 60)
    assert {i for conf, _ in solved for i in conf} == set(range(len(lengths)))
    full, left = packing._configurations(dict(hist), 2048, 60, 8)
    assert sum(left.values()) < 0.2 * sum(hist.values())
    used = sum(len(items) * n for items, n in full) + sum(left.values())
    assert used == sum(hist.values())
    n_best_fit = sum(n for _, n in packing._best_fit(dict(hist), 2048))
    assert sum(n for _, n in packing.plan_packing(dict(hist))) <= n_best_fit + 1 + n_best_fit // 100


def test_plan_of_large_pieces_meets_their_bound():
    hist = {1500: 1000, 1400: 1000, 600: 700, 500: 900}
    assert sum(n for _, n in packing.plan_packing(hist)) == 2000


# ------------------------------------------------------------- token counts
def _sections(row, fields):
    return [(f, k, line) for f in fields for k, line in enumerate((row[f] or "").split("\n"))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule, reference_tokenizer):
    rows = [(1, "en", "first line\n\n\n  second\nthird"), (2, None, None), (3, "", "日本\n語 \n\n\n x"), (3, "a", "a\nb"), (4, "x", "\n" * 9), (None, "q", "word " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, part int")
    fields = ("lang", "text")
    got = token_counts.token_counts(docs, fields, rule).collect()
    want = []
    for i, lang, text in rows:
        secs = _sections({"lang": lang, "text": text}, fields)
        whole = "\n".join(s[2] for s in secs)
        bounds = [0]
        for s in secs:
            bounds.append(bounds[-1] + len(s[2].encode()) + 1)
        bounds[-1] -= 1
        count, cross, at = [0] * len(secs), [0] * len(secs), 0
        enc = packing.encoder()
        for t in reference_tokenizer.encode(whole, add_special_tokens=False).ids:
            end = at + len(enc.decode_single_token_bytes(t))
            part = [max(0, min(end, b) - max(at, a)) for a, b in zip(bounds, bounds[1:])]
            hit = [k for k, p in enumerate(part) if p]
            if rule == "split":
                for k in hit:
                    count[k] += part[k] / (end - at)
                    cross[k] += len(hit) > 1
            else:
                k = hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda k: (part[k], -k))
                count[k] += 1
                cross[k] += len(hit) > 1
            at = end
        want += [(i, s[0], s[1], len(s[2]), round(c, 6), x) for s, c, x in zip(secs, count, cross)]
    flat = [(r["doc_id"], r["field"], r["part"], r["n_chars"], round(r["n_tokens"], 6), r["n_crossing"]) for r in got]
    assert sorted(flat, key=str) == sorted(want, key=str)


def test_token_counts_empty_and_bad_rule(no_docs):
    assert token_counts.token_counts(no_docs, ("source", "text")).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(no_docs, rule="best")


# ---------------------------------------------------------------------- chat
TOOLS = {"find": {"properties": {"q": "string", "n": "integer", "deep": "boolean"}, "required": ["q"]},
         "sum": {"properties": {"xs": "array", "scale": "number"}, "required": ["xs"]}}


def _call(i, name, args, *needs):
    return {"id": i, "name": name, "arguments": args, "depends": list(needs)}


@pytest.fixture(scope="module")
def transcript(spark):
    def calls(*c):
        return json.dumps({"tool_calls": list(c)})

    def result(i, text):
        return json.dumps({"tool_call_id": i, "content": text})
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "é \"q\""),
        (1, 2, "assistant", calls(_call("b", "sum", {"xs": [1, 2], "scale": 1.5}, "a"), _call("a", "find", {"q": "x", "n": 3}))),
        (1, 3, "tool", result("b", "3")), (1, 4, "tool", result("a", "ok")), (1, 5, "tool", result("zz", "lost")),
        (1, 6, "assistant", "done {not json}"),
        (2, 0, "assistant", calls(_call("a", "find", {"n": "3", "q": "x"}), _call("u", "nope", {}), _call("m", "find", {}), _call("e", "find", {"q": "x", "z": 1}),
                                  _call("t", "sum", {"xs": {"a": 1}}), _call("none", "find", {"deep": True, "q": "later"}))),
        (2, 1, "tool", result("a", "bad")),
        (3, 0, "assistant", calls(_call("d", "find", {"q": "1"}))), (3, 1, "assistant", calls(_call("d", "find", {"q": "2"}))), (3, 2, "tool", result("d", "?")),
        (4, 0, "assistant", calls(_call("x", "find", {"q": "1"}, "y"), _call("y", "find", {"q": "2"}, "x"))),
        (5, 0, "user", None), (None, 0, "user", "no conversation"), (None, 1, "tool", result("a", "null conversation")), (6, 0, None, "no role"), (6, 0, None, "no role"),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, status string, n_calls int")


def test_tool_calls_are_linked_checked_and_ordered(transcript):
    out = chat.link_tool_calls(*chat.parse_transcript(transcript), TOOLS)
    rows = sorted(out.collect(), key=lambda r: (r["conv_id"] or 0, r["ord"], r["level"], r["step"], r["turn"], r["call_id"] or ""))
    status = {(r["conv_id"], r["step"], r["call_id"]): r["status"] for r in rows if r["call_id"]}
    assert status[1, 0, "a"] == status[1, 0, "b"] == status[1, 1, "a"] == status[1, 1, "b"] == "linked"
    assert status[1, 1, "zz"] == "orphan" and status[None, 1, "a"] == "orphan"
    assert status[2, 0, "a"] == "invalid: n is no integer" and status[2, 1, "a"] == "linked"
    assert status[2, 0, "u"] == "invalid: unknown tool" and status[2, 0, "m"] == "invalid: missing q"
    assert status[2, 0, "e"] == "invalid: unexpected key" and status[2, 0, "t"] == "invalid: xs is no array"
    assert status[2, 0, "none"] == "unanswered"
    assert status[3, 0, "d"] == status[3, 1, "d"] == "ambiguous"
    assert status[4, 0, "x"] == status[4, 0, "y"] == "cycle"
    one = [(r["step"], r["call_id"]) for r in rows if r["conv_id"] == 1 and r["call_id"] and r["status"] == "linked"]
    assert one.index((0, "a")) < one.index((1, "a")) < one.index((0, "b")) < one.index((1, "b"))
    for r in rows:  # canonical: sorted keys, no white space
        assert r["message"] == json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    b = json.loads(next(r["message"] for r in rows if r["conv_id"] == 1 and r["call_id"] == "b" and r["step"] == 0))
    assert b == {"role": "assistant", "tool_calls": [{"arguments": {"scale": 1.5, "xs": [1, 2]}, "id": "b", "name": "sum"}]}
    assert [json.loads(r["message"]) for r in rows if r["conv_id"] == 5] == [{"role": "user"}]
    assert sum(r["conv_id"] == 6 for r in rows) == 2 and len(rows) == 25


def test_order_of_calls_is_the_longest_path(spark):
    """Chains, forks and cycles against a plain longest-path walk; a chain takes few rounds."""
    rnd = random.Random(5)
    calls = [(1, i, f"c{i}", [f"c{i - 1}"]) for i in range(300)] + [(None, 0, "c1", ["c2"]), (1, 7, None, ["c3"])]
    for conv in range(2, 40):
        n = rnd.randint(1, 12)
        turns = rnd.sample(range(n), n)
        back = rnd.random() < 0.3
        calls += [(conv, turns[i], f"c{i}", [f"c{rnd.randint(-1, n if back else i - 1)}" for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))] + [None])
                  for i in range(n)]
    own = {(v, c): t for v, t, c, _ in calls if v is not None and c is not None}
    needs = {(v, c): [(v, x) for x in d if (v, x) in own] for v, _, c, d in calls if (v, c) in own}
    place = {}
    while True:
        new = {k: (max([own[k], *(place[x][0] for x in d)]), max([-1, *(place[x][1] for x in d)]) + 1)
               for k, d in needs.items() if k not in place and all(x in place for x in d)}
        if not new:
            break
        place |= new
    rounds = []
    staged, chat.common.stage = chat.common.stage, lambda df, name: rounds.append(name) or staged(df, name)
    try:
        got = chat._ordered(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, depends array<string>")).collect()
    finally:
        chat.common.stage = staged
    assert {(r["conv_id"], r["call_id"]): (r["ord"], r["level"]) for r in got} == {k: place.get(k, (own[k], None)) for k in own}
    assert any(k not in place for k in own) and place[1, "c299"] == (299, 299)
    assert rounds.count("call-ready") <= 24


def test_chat_runs_no_python(transcript, capsys):
    chat.link_tool_calls(*chat.parse_transcript(transcript.drop("status")), TOOLS).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_chat_empty(transcript):
    out = chat.link_tool_calls(*chat.parse_transcript(transcript.limit(0)), TOOLS)
    assert out.count() == 0


# ---------------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="menu-open"><header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a><ul><li>Sub</ul></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post comments-off"><header><h1>Title &amp; more</h1></header><p>One   <b>bold</b>&nbsp;two<br>three<p>Four &lt;x&gt; &#233;
<ul><li>a<li>b</ul><aside>Related</aside><form><p>Mail</p></form><table><tr><td>c1</td><td>c2</td></tr></table><!-- <p>gone</p> -->
<div id="comments"><div><p>Nice!</p></div></div><p>Last</article><div class="sidebar"><p>Side</p></div><footer>&copy; us</footer></body></html>"""


def test_blocks_of_a_marked_page():
    assert html.blocks(PAGE) == ["Title & more", "One bold two three", "Four <x> é", "a", "b", "c1 c2", "Last"]
    assert html.blocks("") == [] and html.blocks("plain  text") == ["plain text"]
    assert html.blocks("<nav><p>never closed<article><p>body") == ["body"]
    assert html.blocks("<p>a<script>if (x<y) '</p>'") == ["a"]
    assert html.blocks("<main></main><p>outside") == ["outside"]
    assert html.blocks("a < b <3 <p>c") == ["a < b <3", "c"]


def test_left_out_elements_end_without_an_end_tag():
    assert html.blocks('<article><h1>T</h1><p class="notice">N<p>One</p><p>Two</p></article>') == ["T", "One", "Two"]
    assert html.blocks('<p class="ad">x<article><h1>T</h1><p>One</p></article><p>tail</p>') == ["T", "One"]
    assert html.blocks('<ul><li class="ad">x<li>a<ul><li>b</ul><li class="promo">y</ul><p>c') == ["a", "b", "c"]
    assert html.blocks('<dl><dt class="ad">x<dd>a<dt>b</dl>') == ["a", "b"]
    assert html.blocks('<table><tr class="ad"><td>x<td>y<tr><td>a<td class="promo">z<td>b</table>c') == ["a", "b", "c"]
    # the end of an element around it ends it too; an end tag inside it does not
    assert html.blocks('<section><div class="ad">x<b>y</section><p>a') == ["a"]
    assert html.blocks('<article><p class="notice">N</article><footer>f</footer>') == []
    assert html.blocks('<b>s<div class="ad">x</b><p>y</p></div>a') == ["s", "a"]
    assert html.blocks('<div class="ad"><ul><li>x<li>y</ul><p>z<div>u</div></div>a') == ["a"]
    # a later element's end tag is not that of an open one
    assert html.blocks("<nav>x<article>a</article><nav>y</nav>") == ["a"]
    assert html.blocks("<nav>x<h1>y</h1><nav>z</nav></nav><p>a") == ["a"]


def test_quotes_open_values_only_after_an_equals_sign():
    assert html.blocks("<article><p title=Bob's>One</p><p>It's two</p><p>Three</p></article>") == ["One", "It's two", "Three"]
    assert html.blocks("<article><p it's='a>b' data-x=\"c>'d\">One<p>Two") == ["One", "Two"]
    assert html.blocks("<p data-x=class=ad title='id=comments'>One<a href=/?a=b'c&d=\"e\">x</a><p class = ad>no<p>Two") == ["Onex", "Two"]
    assert html.blocks("<p title='never closed>One<p>Two") == ["One", "Two"]
    assert html.blocks("<p " + "a=b=" * 30_000 + ">One" + "<p =" * 5000 + ">Two") == ["One", "Two"]


def test_names_that_only_contain_a_word_are_in_doubt():
    judged = html.judged_blocks("<main><p id='related-work'>a<p class='notice-of-intent'>b<div><h4 class='ad-hoc'>c</h4>d</div><p class='x ad-slot'>e<p id=ad>f</main>")
    assert judged == ([("a", True), ("b", True), ("c", True), ("d", False)], True)
    assert html.blocks("<article>a<article class='comment'>no</article><article class='comment-thread'><p>no</article><p>b</article>") == ["a", "b"]
    assert html.blocks("<article class='post ad-free related'><p>a</article><article id=comment-12>no</article>") == ["a"]
    assert html.judged_blocks("<!-- <main> --><p>a</p>") == ([("a", True)], False)
    assert html.judged_blocks("<section class='ad-hoc'><p>a<div>b</div></section>c") == ([("a", True), ("b", True), ("c", True)], False)


def test_lines_in_doubt_are_judged_by_the_neighbours(spark):
    def page(i):
        return (f"<nav>m</nav><article><h1>T{i}</h1><p>Same passage</p><p class='ad-hoc'>Buy now</p><p class='ad-hoc'>Own {i}</p>"
                f"<p id='related-work'>Related to {i}</p></article>")
    rows = [(i, f"http://a.org/p/{i}", page(i)) for i in range(5)] + [(9, "http://a.org/p/9", "<!-- <main> --><div>m</div><p>Buy now</p><p>nine</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"T{i}\nSame passage\nOwn {i}\nRelated to {i}"
    assert got[9] == "m\nnine"


def test_pages_give_their_documents(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        doc = docs[int(r["url"].split("/")[4].split("?")[0].split("#")[0].split(".")[0])]
        lines = [" ".join(x.split()) for x in doc.split("\n")]
        assert r["text"].split("\n")[1:] == [x for x in lines if x]


def test_unmarked_pages_are_differenced_with_their_neighbours(spark):
    def page(i, *lines):
        return "<html><body>" + "".join(f"<div>{x}</div>" for x in ("Top line", *lines, "Bottom line")) + "</body></html>"
    rows = [(i, f"http://a.org/p/{i}", page(i, f"only {i}", "x", f"more {i}")) for i in range(6)]
    rows += [(10, "http://b.org/1", page(0, "same")), (11, "http://b.org/2", page(0, "same")), (12, None, None), (13, "http://[bad", "<p>alone"),
             (14, "http://c.org/1", page(0, "single page")), (1, "http://a.org/p/1", rows[1][2])]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "page_id long, url string, html string, row int, lines string").repartition(3)
    got = {}
    for r in html.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[0] == ["only 0\nmore 0"] and got[5] == ["only 5\nmore 5"] and got[3] == ["only 3\nmore 3"]
    assert got[10] == got[11] == ["Top line\nsame\nBottom line"]
    assert got[12] == [""] and got[13] == ["alone"] and got[14] == ["Top line\nsingle page\nBottom line"]
    assert len(got[1]) == 2
    assert html.extract(df.limit(0)).count() == 0


def test_shared_lines_is_a_longest_common_subsequence():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        mark = html.shared_lines(a, b)
        assert mark.sum() == table[-1][-1]
        it = iter(b)
        assert all(x in it for x in np.array(a, dtype=int)[mark])
