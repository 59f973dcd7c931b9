"""Ranked search, prefix trie and HTML extraction against brute force on small hand-made tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import html_extract, max_flow, modular, prefix_trie, queries, ranked_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- arithmetic

def test_modular_arithmetic_agrees_with_integers():
    rng = random.Random(1)
    a = [rng.randrange(modular.PRIME) for _ in range(500)] + [0, modular.PRIME - 1]
    b = [rng.randrange(modular.PRIME) for _ in range(500)] + [modular.PRIME - 1, modular.PRIME - 1]
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    assert modular.mul(x, y).tolist() == [p * q % modular.PRIME for p, q in zip(a, b)]
    assert modular.sub(x, y).tolist() == [(p - q) % modular.PRIME for p, q in zip(a, b)]
    assert modular.running_sum(x).tolist() == [s % modular.PRIME for s in itertools.accumulate(a)]
    big = np.array([0, 65535, 65536, 10**12])
    assert modular.Powers(12345)(big).tolist() == [pow(12345, e, modular.PRIME) for e in big.tolist()]


# ---- ranked search

def brute_search(docs, items, k=20):
    words = [TERM.findall((t or "").translate(TO_LOWER)) for _, t in docs]
    held = [(i, Counter(w), len(w)) for (i, _), w in zip(docs, words) if w]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, counts, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * counts[t] // (1000 * counts[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(TO_LOWER)) if t in counts)
            if score > 0:
                scores.append((-score, i is not None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"W{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300)) for i in range(700)]
    docs += [(700 + i, "copy of one and the same text W1 w2 W3") for i in range(300)]  # ties beyond k
    docs += [(2000, None), (2001, ""), (2002, "--- !"), (None, "W1 W2 naïve"), (5, "W1 W2 W2"), (5, "W1 W2 W2"),
             (2003, "W7 x " * 400_000), (2004, "Ünicode ünicode NAÏVE")]
    items = [(i, " ".join(f"w{x}" for x in rng.integers(1, 300, 30))) for i in range(12)]
    items += [(20, "W1 w1 w1 W2"), (21, "copy text"), (22, None), (23, "?"), (24, "absent"), (20, "w3"), (None, "w7 ünicode"),
              (25, " ".join(f"w{x}" for x in range(150))), (26, "naïve NAÏVE")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("terms", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("item", F.lit(1))
    want = brute_search(docs, items)
    assert found(ranked_search.search(d, q, block_docs=64)) == want
    # several blocks of items and one block of documents
    assert found(ranked_search.search(d, q, block_bytes=600)) == want
    assert found(ranked_search.search(d, q, k=3)) == brute_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs, no_items).count() == 0
    assert ranked_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_of_more_than_64_terms():
    rng = np.random.default_rng(5)
    present = rng.random((150, 90)) < 0.3
    present[:, 40:60] = present[:, :20]
    got, group = ranked_search.masks(np.packbits(present, axis=1), 90)
    assert len(got) == len({c.tobytes() for c in present.T})
    assert (got[group] == present.T).all()


def test_equal_hashes_are_told_apart_by_bytes():
    vocabulary = ranked_search.Vocabulary([b"one two three"])
    vocabulary.hashes = np.zeros(3, dtype=np.uint64)  # as if all terms collided
    low = b"two four three"
    starts, ends = np.array([0, 4, 9]), np.array([3, 8, 14])
    words, terms = vocabulary.find(low, starts, ends, np.zeros(3, dtype=np.uint64))
    assert sorted(zip(words.tolist(), terms.tolist())) == [(0, 1), (2, 2)]


# ---- prefix trie

def key_of(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows, block=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key_of(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + own[c][h:]
    return out


def brute_trie(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * words
            leaves[node[:d]] += not children[node]
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in "key words depth part i h d1 p1 kind last many n_convs".split():
        df = df.withColumn(name, F.lit("clash"))
    turns = prefix_trie.turn_rows(df)
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    begin = prefix_trie.leads(turns, F.col("conv_id") - F.col("conv_id") % 20, taken, most=3)
    return found(prefix_trie.trie(turns, begin, **options).drop("key", "words"))


def conversations(seed, n, turns=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # some bases are absent
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, f"x y {c}"]))
                 for t in range(rng.randint(1, turns))]
    return rows


@pytest.mark.parametrize("cells", [1 << 27, 1 << 15])
def test_trie_agrees_with_brute_force(spark, cells):
    rows = conversations(7, 300)
    rows += [(400, None, "user", "null first"), (400, 0, "user", "x"), (400, 0, "user", "x"), (400, 0, "user", "a tie"),
             (None, 0, "user", "no conversation"), (-7, 0, "user", "a"), (-7, 1, None, "b c")]
    rows += [(c, t, "user", "the same system prompt " * 3) for c in range(1000, 1400) for t in range(1 + c % 2)]
    assert trie_of(spark, rows, max_cells=cells) == brute_trie(rebuilt(rows))


def test_trie_of_very_long_conversations(spark):
    # two copies that hold most rows: their turns fall into many ranges, and 2^k doubling goes deep
    rows = conversations(9, 60)
    rows += [(c, t, "user", f"turn {t}") for c in (500, 520, 561) for t in range(900 - c % 7)]
    got = trie_of(spark, rows)
    assert got == brute_trie(rebuilt(rows))


def test_trie_of_an_empty_table_and_of_one_conversation(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    rows = [(41, 0, "user", "only")]
    assert trie_of(spark, rows) == brute_trie(rebuilt(rows))


# ---- HTML extraction

def test_cuts_are_the_cheapest_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.randint(-20, 20) for _ in range(n)]
        edges = {(i, j): rng.randint(0, 12) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(label):
            return (sum(max(0, g) if not x else max(0, -g) for g, x in zip(gain, label))
                    + sum(w for (a, b), w in edges.items() if label[a] != label[b]))

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(max_flow.sides(gain, edges)) == best


def test_cut_of_a_long_chain():
    n = 3000
    gain = [(5 if (i // 50) % 2 else -4) for i in range(n)]
    edges = {(i, i + 1): 7 for i in range(n - 1)}
    label = max_flow.sides(gain, edges)
    assert label == [bool((i // 50) % 2) for i in range(n)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><a href=/>Home</a> <h2>Site name</h2></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and we ask you to accept every one of them before you read on.</p></div>
<div id="wrap"><main><article><header><h1>Title &amp; more</h1></header>
<p>First  paragraph, with <b>bold</b> and<br>a break and &eacute;&nbsp;reference.
<p>Short.
<ul><li>An item of the article.<li>Another item of it.</ul>
<div class="ad">Buy this, it is good, and it is cheap, and it is new.</div>
<p>Last paragraph of the article, which <a href=x>links</a> somewhere.</p>
<section id="comments"><h3>Comments</h3><p>A reader says that this was a very nice article, thanks.</p></section>
</article></main><aside><p>Related story about something else, of the same length as any other.</p></aside></div>
<form><p>Subscribe to our letter, it is sent to you every week.</p><input><button>Go</button></form>
<footer>&copy; 2020 Site<p>All rights reserved, in all countries.</footer></body></html>"""
MAIN = ("Title & more\n\nFirst paragraph, with bold and a break and é reference.\n\nShort.\n\nAn item of the article.\n\n"
        "Another item of it.\n\nLast paragraph of the article, which links somewhere.")


def test_main_text_of_a_marked_page():
    assert html_extract.main_text(PAGE, html_extract.START) == MAIN


def test_main_text_of_a_page_without_marks():
    prose = [f"This is paragraph {i} of the story, and it has, like the others, some sentences. Here is one more of them." for i in range(6)]
    prose.insert(3, "Yes.")
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div>{''.join(f'<p>{p}</p>' for p in prose)}</div><div><a href=x>Imprint</a> | <a href=y>Terms</a></div>"
    assert html_extract.main_text(page, html_extract.START) == "\n\n".join(prose)


def test_names_on_wrappers_do_not_condemn_the_article():
    page = '<div class="page header-wide sidebar-left"><main><p>Text of the page, in one sentence.</p></main></div>'
    assert html_extract.main_text(page, html_extract.START) == "Text of the page, in one sentence."


def test_an_articles_own_header_is_content():
    page = ('<div class="header"><p>The name of the site, and its motto.</p></div><article><div class="entry-header"><h1>Title</h1></div>'
            '<p>Text of it, in one sentence.</p><div role="complementary"><p>Something else to read, if you like.</p></div></article>')
    assert html_extract.main_text(page, html_extract.START) == "Title\n\nText of it, in one sentence."


def test_broken_and_odd_pages():
    start = html_extract.START
    assert html_extract.main_text("", start) == ""
    assert html_extract.main_text("<nav>menu</nav>", start) == ""
    assert html_extract.main_text("<article><p>One &amp two &am", start) == "One & two &am"
    assert html_extract.main_text("<article>" + "<div>" * 20_000 + "deep words stand here.", start) == "deep words stand here."
    assert html_extract.main_text("<article><p>a < b and c > d.</p></span></p></article>", start) == "a < b and c > d."
    assert html_extract.main_text('<article><p>seen.</p><p hidden>not seen.</p><p style="display: none">nor this.</p></article>',
                                  start) == "seen."
    many = "".join(f"<p>Sentence number {i} of a long page.</p>" for i in range(20_000))
    assert html_extract.main_text(f"<article>{many}</article>", start).count("\n\n") == 19_999


def test_extraction_query_shapes(spark):
    rows = [(1, "u", bytearray(PAGE.encode())), (2, None, None), (3, "u", bytearray(b"")), (None, "u", bytearray(PAGE.encode())),
            (1, "u", bytearray(PAGE.encode())), (4, "u", bytearray(b"<article><p>bad \xff byte.</p></article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("text", F.lit("clash")).withColumn(
        "html", F.col("html").cast("string")).withColumn("content", F.lit(3))
    out = html_extract.extract(pages, html_extract.train(pages))
    got = sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, MAIN), (1, MAIN), (None, MAIN), (2, ""), (3, ""), (4, "bad � byte.")], key=str)
    assert out.columns == ["page_id", "url", "content", "text"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert (html_extract.train(empty) == html_extract.START).all()
    assert html_extract.extract(empty, html_extract.START).count() == 0


def test_classifier_learns_from_marked_parts():
    pages = [html_extract.parse(PAGE)] * 20
    x = np.concatenate([html_extract.features(p) for p in pages])
    y = np.concatenate([[html_extract.evidence(p)[b.parent] > 0 for b in p.blocks] for p in pages]).astype(float)
    w = html_extract.fit(x, y, pull=1.0)

    def loss(w):
        return np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)))
    assert loss(w) < loss(html_extract.START)


def test_names_of_state_and_forms_around_a_page_are_no_parts():
    prose = ["A first sentence of the page, long enough to be prose of its own.", "And a second one, which says a little more than that."]
    inner = "<h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in prose)
    want = "\n\n".join(["Title of it", *prose])
    start = html_extract.START
    for page in (f'<div class="layout has-sidebar noComments"><div class="post">{inner}</div><div class="sidebar"><p>Read this, and that.</p></div></div>',
                 f'<form id="page" action="/x"><div class="content">{inner}</div><div class="footer">All rights, in all lands.</div></form>'):
        assert html_extract.main_text(page, start) == want
    asked = f'<div class="content">{inner}</div><form><p>Tell us your name, and what you think of it.</p><input></form>'
    assert html_extract.main_text(asked, start) == want


def article(html):
    """The template of the given pages, read with regular expressions."""
    body = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    import html as references
    parts = (" ".join(references.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(p for p in parts if p)


def test_extraction_query_on_the_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_html_extraction(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
