import math
from collections import Counter, defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.llm import chat_format, context_tree
from glossaria.llm.html_text import extract, visible_text


def test_windows(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", "u1 " * 20), (1, 2, "assistant", "a1 <|end|> " * 10), (1, 3, "user", "u2 " * 90), (1, 4, "assistant", "<\\|x <| " * 9), (1, 4, "assistant", None), (1, 5, "user", ""), (1, 6, "assistant", "fin " * 30)]
    rows += [(2, 0, "system", "alone"), (3, 0, None, None), (None, 0, "user", "x"), (4, None, "assistant", "w " * 5000), (4, 1, "assistant", "w " * 5000), (5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    out = chat_format.windows(turns, budget=120, history=40)
    parsed = out.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    back, loss = defaultdict(list), defaultdict(list)
    for r in sorted(parsed, key=lambda r: r["window"]):
        assert len(r["turns"]) == r["n_turns"] and (r["n_tokens"] <= 120 or r["n_turns"] - r["n_repeated"] == 1)
        back[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"][r["n_repeated"] :]]
        loss[r["conv_id"]] += r["loss"]
        if r["conv_id"] == 1:
            assert r["turns"][0]["text"] == "be nice"
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=order)
        assert back[c] == [(r[2] or "", r[3] or "") for r in mine]
        assert loss[c] == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert any(r["n_repeated"] > 1 for r in parsed)
    assert chat_format.windows(turns.limit(0)).count() == 0


def test_null_ids_are_one_conversation(spark):
    made = [(k, "user" if k % 2 else "assistant", f"t{k} " * 60) for k in range(12)]
    turns = spark.createDataFrame([(c, *r) for c in (1, None) for r in made] + [(None, -1, "system", "s"), (1, -1, "system", "s")], "conv_id long, turn long, role string, text string")
    out = chat_format.windows(turns, budget=200, history=80).collect()
    shape = lambda c: sorted((r["window"], r["n_turns"], r["n_repeated"], r["formatted"]) for r in out if r["conv_id"] == c)
    assert shape(1) == shape(None) and any(r["n_repeated"] > 1 for r in out)


def test_digests_equal_sql(spark, sf_dir):
    from oracle import assert_same

    assert_same(chat_format.op2_chat_format(spark, sf_dir), chat_format.SQL_OP2, sf_dir)


def test_quality_equals_sql(spark, sf_dir):
    from oracle import assert_same

    from glossaria.llm.quality_rules import SQL_OP3, op3_quality_rules

    assert_same(op3_quality_rules(spark, sf_dir), SQL_OP3, sf_dir)


HTML = [
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>z", "- x\n- y\n  3. n\n  4. m\n\nz"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("x<script>'</p>'</script><style>y</style><!-- no --><div hidden>n</div><span style='display: none'>n</span>z", "xz"),
    ("<pre>a  b\n  c</pre>&amp;&lt;", "a  b\n  c\n\n&<"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<head><title>t</title></head>body", "body"),
    ("a < b <", "a < b <"),
    ("<table><tr><td>1<table><tr><td>in</table><td>2</table>y", "1 in  2\n\ny"),
    ("", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("</p>a</b>", "a"),
]
HTML_OPEN_HEAD = [
    ("<html><head><title>T</title><p>Hello", "Hello"),
    ("<head><meta charset=utf-8><link rel=x><style>s</style>\n<script>s</script>Hello <b>there</b>", "Hello there"),
    ("<head><title>T</title><noscript><img src=x>n</noscript><template><p>n</template> <div>a</div></head>b", "a\nb"),
    ("<!DOCTYPE html><head>\n <title>T</title>\n<body><p>a", "a"),
]
HTML_QUOTES = [
    ("<p title=it's>Hello world. That's all</p>tail", "Hello world. That's all\n\ntail"),
    ('<a href="x"">Link</a> y', "Link y"),
    ("<p title=a\"b>x</p>y 'z' \"w\"", "x\n\ny 'z' \"w\""),
    ("<p 'a' \"b>x</p><i title = 'a>b' alt=\"c>d\">y</i>", "x\n\ny"),
    ("<p style=display:none title=it's>n</p><p title='it\"s' hidden>n</p>x", "x"),
    ("<img alt=/><a href=/a/>l</a></p title='>'>x", "l\n\nx"),
    ("x <a href='y", "x"),
]


LONG = "word " * 30
HTML_DEEP = [
    ("<div>" * 205 + "<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<b>" * 20_000 + "<p>x<p>y", "x\n\ny"),
    ("<table><tr><td>a<td>b<td>c</table>" + "<i>" * 5000 + "z", "a  b  c\n\nz"),
    (f"<table><tr><td>{LONG}<td>r<tr><td>s<td>t</table>", f"{('word ' * 12).strip().ljust(59)}  r\n{('word ' * 12).strip()}\n{('word ' * 6).strip()}\n{'s'.ljust(59)}  t"),
    (f"<table><tr><td>{'x' * 70}<td>r<tr><td>s<td>t</table>", f"{'x' * 70}  r\n{'s'.ljust(70)}  t"),
]


@pytest.mark.parametrize("html,text", HTML_DEEP)
def test_deep_and_wide(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html,text", HTML + HTML_OPEN_HEAD + HTML_QUOTES)
def test_layout(html, text):
    assert visible_text(html) == text


class _Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if self.skip <= 0:
            self.out.append(data)


def test_no_word_of_a_page_is_lost(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    for html in pages["html"]:
        reader = _Words()
        reader.feed(html)
        ours = Counter("".join(visible_text(html).split()).replace("-", ""))
        theirs = Counter("".join("".join(reader.out).split()).replace("-", ""))
        assert ours == theirs


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (2, "<p>x", "t"), (None, "y " * 100_000, "t")], "page_id long, html string, text string")
    out = extract(pages).collect()
    assert [r["text"] for r in out][:3] == ["", "", "x"] and len(out[3]["text"]) == 199_999
    assert extract(pages.limit(0)).count() == 0


def _brute(texts, held, depth):
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        data = bytes([context_tree.START]) * depth + context_tree._lower(text) + bytes([context_tree.END])
        for p in range(depth, len(data)):
            for k in range(8):
                yield (1 << k) | (data[p] >> (8 - k)), data[p - depth : p], (data[p] >> (7 - k)) & 1

    for text, h in zip(texts, held, strict=True):
        if not h:
            for u, context, bit in steps(text):
                for d in range(depth + 1):
                    counts[u, context[depth - d :]][bit] += 1
    below = defaultdict(set)
    for u, context in list(counts):
        if context:
            below[u, context[1:]].add(context)

    def kt(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi), (b + 0.5) / (a + b + 1)

    @lru_cache(None)
    def weighted(u, context):
        own = kt((u, context))[0]
        return own if len(context) == depth else np.logaddexp(own, sum(weighted(u, c) for c in below[u, context])) + math.log(0.5)

    def ones(u, context, d=0):
        log, p = kt((u, context[depth - d :]))
        if d == depth:
            return p
        share = math.exp(math.log(0.5) + log - weighted(u, context[depth - d :]))
        return share * p + (1 - share) * ones(u, context, d + 1)

    return [sum(math.log10(ones(u, c) if bit else 1 - ones(u, c)) for u, c, bit in steps(t)) for t in texts]


def test_context_trees_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abC "), size=rng.integers(0, 30))).decode() for _ in range(30)] + [None, "", "é\n", "abc abc", "abc abc"]
    held = [k % 5 == 0 for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t, h, "x") for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean, score string")
    rows = {r["doc_id"]: r for r in context_tree.score(docs, depth=3, chunk_bytes=200).collect()}
    for k, want in enumerate(_brute(texts, held, 3)):
        assert abs(rows[k]["score"] - want) < 1e-8
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    whole = sum(c.values()) + 0.1 * (len(c) + 1)
    for k, ws in enumerate(tokens):
        assert abs(rows[k]["base_score"] - sum(math.log10((c[w] + 0.1) / whole) for w in ws)) < 1e-9
        assert (rows[k]["n_tokens"], rows[k]["n_known"], rows[k]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), sum(c.values()))


def test_contexts_are_six_bytes_deep(spark, monkeypatch):
    texts = [f"{a}bcdéf {a}" for a in "xyxyzxzyxz"] * 2 + ["xbcdéf x", "ybcdef z"]
    held = [k >= 20 for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean")
    want = _brute(texts, held, 6)
    for at_once in (1, context_tree._AT_ONCE):
        monkeypatch.setattr(context_tree, "_AT_ONCE", at_once)
        rows = {r["doc_id"]: r["score"] for r in context_tree.score(docs).collect()}
        assert all(abs(rows[k] - w) < 1e-8 for k, w in enumerate(want))


def test_scores_without_rows_or_training(spark):
    docs = spark.createDataFrame([(1, "ab", True), (None, "ab", True)], "doc_id long, text string, held_out boolean")
    assert context_tree.score(docs.limit(0)).count() == 0
    out = context_tree.score(docs).collect()
    assert all(abs(r["score"] - 3 * math.log10(1 / 256)) < 1e-9 and r["n_known"] == 0 for r in out)


HTML_MORE = [
    ("<!-->shown", "shown"),
    ("<!--->shown", "shown"),
    ("<!-- a --!>shown<!-- b -->", "shown"),
    ('<div style="visibility:hidden">a<p style="visibility: visible">b</p>c</div>', "b"),
    ('<div style="display:none">a<p style="visibility: visible">b</p></div>c', "c"),
    ("<details>x<summary>s</summary>y<p>z</details>t", "s\nt"),
    ("<details open><summary>s</summary>y</details>", "s\ny"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("a<plaintext>b <p>c", "a\n\nb <p>c"),
    ("<ol start=-1><li>a<li>b<li value=9>c<li>d</ol>", "-1. a\n0. b\n9. c\n10. d"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol start=99999999999><li>a</ol>", "1. a"),
    ("<table><tr><td colspan=2>head<td>z<tr><td>a<td>b<td>c</table>", "head  z\na  b  c"),
    ("<table><tr><td rowspan=2>one<td>b<tr><td>d<tr><td>e<td>f</table>", "one  b\n     d\ne    f"),
    ("<table><tr><td>x<td><pre>a  b\n  c</pre><tr><td>y<td><ul><li>p<li>q</ul></table>", "x  a  b\n     c\ny  - p\n   - q"),
]


@pytest.mark.parametrize(("html", "text"), HTML_MORE)
def test_more_layout(html, text):
    assert visible_text(html) == text
