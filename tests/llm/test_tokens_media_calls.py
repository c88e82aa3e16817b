import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waylark.llm import bpe, html_text, media_copies, packing, tool_calls, toxicity
from waylark.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = ["", "Hello, world!  it's\n\n 12345 x", "  lead", "<|endoftext|> a<|endoftext|>", "aaaa" * 300, " " * 200, "日本語 🎉 naïve café é l’été “x” İİ I'LL we've 12's ''s !'s", "x\x85y\xa0z\x1cq\x1f", "<|startoftext|>b"]


def noise(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé 'st.1!\nLlrv") for _ in range(80)) for _ in range(n)]


def test_bpe_is_the_library_s(spark):
    texts = TEXTS + noise(200)
    t = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate([*texts, None])], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(df, BYTE, keep_ids=True).collect()}
    for i, x in enumerate([*texts, ""]):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()


def test_trie_gives_what_merging_gives():
    b = bpe.load(BYTE)
    rng = random.Random(6)
    words = list({bytes(rng.choice(b"abcdeth ing\xc3\xa9") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    got = b.encode_words(words)
    assert all([b.by_id[i] for i in got[w]] == b.merged(w) for w in words)


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    e = bpe.Encoder(bpe.load(BYTE))
    t = Tokenizer.from_file(BYTE)
    for x in noise(20):
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_words_of_the_packing_vocabulary():
    texts = TEXTS + noise(300)
    t = Tokenizer.from_file(WORD)
    got = packing.WordTokens(WORD).encode(pa.array([*texts, None]))
    for x, ids in zip([*texts, ""], got, strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 3], [5, 5, 5], [9000, 3000, 2000, 1, 77] * 40])
def test_packing_holds_each_token_once(lengths):
    got = packing.pack(lengths)
    pieces = defaultdict(list)
    for s in got:
        n = sum(p[2] for p in s)
        assert n == 4096 or n & (n - 1) == 0
        for doc, start, n in s:
            assert n > 0
            pieces[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(pieces[doc]):
            assert start == at
            at += size
        assert at == n


def test_tournament_finds_the_first_with_room():
    rng = random.Random(1)
    tree, room = packing.Tournament(50, 100), [100] * 50
    for _ in range(200):
        size = rng.randrange(1, 60)
        first = next((i for i, r in enumerate(room) if r >= size), None)
        if first is None:
            break
        assert tree.first(size) == first
        tree.take(first, size)
        room[first] -= size


def test_packed_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 2000)
    texts = [*TEXTS, *noise(60), "long words here " * 4000, None]
    df = spark.createDataFrame([(i // 2, x, 3) for i, x in enumerate(texts)], "doc_id long, text string, grp int").repartition(3)
    got = packing.pack_documents(df, WORD).collect()
    t = Tokenizer.from_file(WORD)
    whole = sorted((i // 2, len(ids := t.encode(x or "", add_special_tokens=False).ids + [2]), ids) for i, x in enumerate(texts))
    assert sum(r["length"] for r in got) == sum(n for _, n, _ in whole)
    ids_of = defaultdict(list)
    for d, n, ids in whole:
        ids_of[d, n].append(np.array(ids, dtype="<u4"))
    sequences = defaultdict(list)
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids_of[r["doc_id"], r["doc_tokens"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def test_toxic_words_are_learnt(spark):
    rng = random.Random(4)
    words = {"en": ["the", "of", "and"], "de": ["der", "die", "und"]}
    bad = {"en": ["blarg", "zonk"], "de": ["quasel", "mupf"]}
    rows, labels = [], []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        toxic = i % 5 == 0
        text = [rng.choice(words[lang]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(bad[lang]) + rng.choice(["", ",", "ing"])
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(toxic)))
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "word " * 30000, "en"), (None, "the end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(y, got[i]) for i, y in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([r["predicted"] == y for y, r in held]) > 0.95
    assert got[2000]["score"] == got[2001]["score"] and got[2000]["predicted"] == 0
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_texts_that_do_not_fit_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TEXT_BYTES", 3000)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 60_000)
    rng = random.Random(5)
    plain, harsh = ["tree", "river", "paper", "window", "music"], ["vile", "filth", "scum"]
    text = lambda toxic: " ".join(rng.choice(harsh if toxic and rng.random() < 0.4 else plain) for _ in range(40))
    rows = [(i, text(i % 3 == 0) if i % 10 else "tree " * 20_000) for i in range(600)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1]), (3, "tree"), (None, "tree")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity_scores(docs, marks).collect() if r["held_out"] and r["doc_id"] % 10]
    assert len(got) > 50 and sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got) / len(got) > 0.95
    scores = lambda d: sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity_scores(d, marks).collect())
    one, other = scores(docs), scores(docs.repartition(5))
    assert len(one) == len(other) == 603
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(one, other, strict=True))


def test_no_labels_no_verdict(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/x>Home</a><li><a href="/y">News</a></ul></nav><div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
<article><h1>Head &amp; line</h1><p>One <b>bold
 word</b>.<br>Two &lt;3 &#x41;<p>Three&nbsp;four<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>
<div id=comments><p>Nice!</p></div><aside>More</aside><form><input value=1>Send</form><footer>&copy; x</footer>"""


def test_page_text():
    assert html_text.main_text(PAGE, frozenset()).split("\n") == ["Head & line", "One bold word. Two <3 A", "Three four", "a", "b", "c", "d"]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p>Read <span class="ad">BUY NOW</span> more</p>', "Read more"),
        ("<p>a<select><option>A<option>B</select>tail</p>", "atail"),
        ("<p><button>Buy</button>z</p>", "z"),
        ('<p>x <a hidden>secret</a>y <span class="comment-count">5</span></p>', "x y"),
        ("<p>before</p><p><a href=x title=it's>keep this</a> and this</p><p>second don't stop</p><p>third", "before\nkeep this and this\nsecond don't stop\nthird"),
        ('<article><div class="post-header"><h1>Title</h1></div><header><p>By</p></header><p>Text</p></article>', "Title\nBy\nText"),
        ('<section class="related-work"><p>a</p></section><div class="share-price"><p>b</p></div><p id="comment-policy">c</p><div class="tags-explained">d</div>', "a\nb\nc\nd"),
        ('<div class="ads"><p>' + "long " * 50 + "</p></div><p>short</p>", ("long " * 50).strip() + "\nshort"),
        ('<p title="a > b" class=x>q</p><a href=">">r</a>', "q\nr"),
    ],
)
def test_page_text_of_odd_markup(source, text):
    assert html_text.main_text(source, frozenset()) == text


def articles(source):
    """By another way: the standard parser, keeping what lies in an article."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.lines, self.parts = 0, [], []

        def end(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK:
                self.end()
            self.inside += tag == "article"
            if tag == "br" and self.inside:
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.end()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    w = Walk()
    w.feed(source or "")
    w.close()
    w.end()
    return "\n".join(w.lines)


def test_all_pages_as_by_a_walk_of_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    wrong = [r["page_id"] for r in pages.collect() if got[r["page_id"]] != articles(r["html"])]
    assert not wrong, wrong[:5]


def test_the_tree_alone_cuts_menus_adverts_and_footers(spark):
    """Elements renamed, so that no list knows them."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages
    for tag in ("nav", "footer", "aside"):
        plain = plain.withColumn("html", F.regexp_replace("html", f"<(/?){tag}\\b", "<$1div"))
    plain = plain.withColumn("html", F.regexp_replace("html", 'class="ad"', 'class="q"'))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(plain).collect()}
    right = [got[r["page_id"]] == articles(r["html"]) for r in pages.collect()]
    assert np.mean(right) >= 0.95, np.mean(right)


def test_pages_of_a_site(spark):
    page = lambda i: f"<html><body><div class=x{i}><p>Same words on all pages</p></div><div class=main><p>Story {i} of {i * 7}</p></div></body></html>"
    rows = [(i, f"http://a.example.com/{i}", page(i), 1) for i in range(30)] + [(100, None, None, 1), (101, "no url", "", 1), (102, "http://b.example.com/1", PAGE, 1), (103, "http://b.example.com/2", "<p>" + "long " * 30000, 1), (104, "http://c", "<div <p>broken & <b", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i} of {i * 7}" for i in range(30))  # what all pages repeat goes
    assert got[100] == "" and got[101] == "" and got[103] == ("long " * 30000).strip()
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_a_site_of_copies_keeps_its_article(spark):
    df = spark.createDataFrame([(i, "http://a.example.com/", PAGE) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_text(df).collect()} == {html_text.main_text(PAGE, frozenset())}


def test_joined_trees_give_the_same(spark, monkeypatch):
    rows = [(i, f"http://a.example.com/{i}", f"<body><div class=x><p>Same</p></div><p>Story {i}</p></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = sorted(map(tuple, html_text.extract_text(df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_NODES", -1)
    assert sorted(map(tuple, html_text.extract_text(df).collect())) == a


def test_cropped_and_edited_copies(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(25, 64))
    rows = [(i, media_copies.encode_pgm(media_copies.edited(media_copies.picture(base[i % 25] + 0.02 * rng.normal(size=64)), i // 25)), 1) for i in range(100)]
    rows += [(200, None, 1), (201, b"junk", 1), (202, media_copies.encode_pgm(np.zeros((96, 96))), 1), (203, b"P5 10 10 255\n" + b"x" * 20, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "media_id long, image binary, links int").repartition(4)
    got = {r["media_id"]: r["class_id"] for r in media_copies.media_groups(df).collect()}
    assert all(got[i] == i for i in range(200, 204)) and got[None] is None
    found = [got[i] == got[j] for i in range(100) for j in range(i) if i % 25 == j % 25]
    assert np.mean(found) >= 0.9
    assert not any(got[i] == got[j] for i in range(100) for j in range(i) if i % 25 != j % 25)
    assert media_copies.media_groups(df.limit(0)).count() == 0


def turned(pixels, degrees, grow):
    """The picture turned around its middle and resized, between its pixels linearly."""
    h, w = pixels.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0 : int(h * grow), 0 : int(w * grow)]
    y, x = (y - (int(h * grow) - 1) / 2) / grow, (x - (int(w * grow) - 1) / 2) / grow
    sx, sy = np.cos(t) * x + np.sin(t) * y + (w - 1) / 2, np.cos(t) * y - np.sin(t) * x + (h - 1) / 2
    x0, y0 = np.clip(np.floor(sx).astype(int), 0, w - 2), np.clip(np.floor(sy).astype(int), 0, h - 2)
    fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
    return np.rint((pixels[y0, x0] * (1 - fx) + pixels[y0, x0 + 1] * fx) * (1 - fy) + (pixels[y0 + 1, x0] * (1 - fx) + pixels[y0 + 1, x0 + 1] * fx) * fy)


def test_recall_of_turned_scaled_and_cropped_copies(spark):
    """Through the index: a quarter turn, 7 degrees, one and a half times the size, and a crop to half the area."""
    rng = np.random.default_rng(17)
    base = [media_copies.picture(v) for v in rng.normal(size=(40, 64))]
    kinds = [lambda p: p, lambda p: np.rot90(p), lambda p: turned(p, 7, 1), lambda p: turned(p, 0, 1.5), lambda p: p[12:80, 14:82]]
    rows = [(40 * k + i, media_copies.encode_pgm(f(p))) for k, f in enumerate(kinds) for i, p in enumerate(base)]
    got = {r["media_id"]: r["class_id"] for r in media_copies.media_groups(spark.createDataFrame(rows, "media_id long, image binary").repartition(4)).collect()}
    for k in range(1, 5):
        assert np.mean([got[40 * k + i] == got[i] for i in range(40)]) >= 0.9
    assert len({got[i] for i in range(40)}) == 40


def test_many_small_flushes_give_the_same_classes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 64))
    rows = [(i, media_copies.encode_pgm(media_copies.edited(media_copies.picture(base[i % 6]), i % 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "media_id long, image binary").repartition(3)
    classes = lambda: {r["media_id"]: r["class_id"] for r in media_copies.media_groups(df).collect()}
    before = classes()
    monkeypatch.setattr(media_copies, "REMEMBERED", 50)
    assert classes() == before == {i: i % 6 for i in range(40)}


def test_agreement_takes_turned_and_scaled_pictures():
    rng = np.random.default_rng(3)
    a = media_copies.picture(rng.normal(size=64))
    b = media_copies.picture(rng.normal(size=64))
    turned = np.rot90(a)
    da, db, dt = (media_copies.describe(x[None])[0] for x in (a, b, turned))
    assert media_copies.agreeing(da, dt) >= media_copies.LEAST_AGREEING
    assert media_copies.agreeing(da, db) < media_copies.LEAST_AGREEING


def described(bits, seed):
    """Descriptors with these bits at places of their own."""
    d = np.zeros(len(bits), dtype=media_copies.DESCRIPTOR)
    rng = np.random.default_rng(seed)
    d["x"], d["y"], d["scale"], d["bits"] = rng.uniform(0, 90, len(bits)), rng.uniform(0, 90, len(bits)), 1, bits
    return d


def test_copies_under_a_key_that_another_leads(spark):
    rng = np.random.default_rng(8)
    first = rng.integers(0, 2**63, (8, 2)).astype(np.uint64)
    second = first.copy()
    for bit in range(0, 120, 12):  # a flip in each chunk, so that no key but that of the first two is shared
        second[2:, bit // 64] ^= np.uint64(1 << (bit % 64))
    other = rng.integers(0, 2**63, (8, 2)).astype(np.uint64)
    other[:2] = first[:2]
    a, x, y = described(other, 2), described(first, 2), described(second, 2)
    for d in (a, x, y):  # the first two are neighbours
        d["x"][1], d["y"][1] = d["x"][0] + 1, d["y"][0]
    assert media_copies.agreeing(x, y) == 8 and media_copies.agreeing(a, x) == media_copies.agreeing(a, y) == 0
    found = spark.createDataFrame([(i, d.tobytes()) for i, d in ((1, a), (2, x), (3, y))], "id long, descriptors binary")
    assert [tuple(r) for r in media_copies.linked(found).collect()] == [(2, 3)]


def test_matches_of_many_pairs_are_those_of_one():
    rng = np.random.default_rng(9)
    base = media_copies.picture(rng.normal(size=64))
    sets = [media_copies.describe(p[None])[0] for p in (base, media_copies.edited(base, 1), base[:60, :60], media_copies.picture(rng.normal(size=64)))]
    size = np.array([len(d) for d in sets])
    x, y = (g.ravel() for g in np.meshgrid(range(4), range(4)))
    got = media_copies.mutual_matches(np.concatenate([d["bits"] for d in sets]), np.cumsum(size) - size, size, x, y)
    for n, i, j in zip(got, x, y, strict=True):
        apart = np.bitwise_count(sets[i]["bits"][:, None] ^ sets[j]["bits"][None]).sum(axis=2)
        assert n == sum(apart[r, c] <= media_copies.MOST_BITS_APART and apart[:, c].argmin() == r for r, c in enumerate(apart.argmin(axis=1)))


TOOLS = {"f": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "string", "enum": ["x"], "maxLength": 3}}, "additionalProperties": False}, "g": {}}


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, after string")


def test_arguments_against_schemas(spark):
    cases = [("f", '{"a": 3}', []), ("f", '{"b":"y","a":9}', ["a is beyond its maximum", "b is none of the values"]), ("f", "{}", ["a is missing"]), ("f", '{"a":"1"}', ["a is no integer"]), ("f", '{"a":1,"z":null}', ["a property is unknown"]), ("f", "nope", ["arguments are no JSON"]), ("f", "[1]", ["arguments are no object"]), ("f", None, ["arguments are no JSON"]), ("h", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]), ("g", '{"q":1}', [])]
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(cases)], "i int, name string, arguments string")
    got = [r["e"] for r in df.select("i", tool_calls.schema_errors(F.col("name"), F.col("arguments"), TOOLS).alias("e")).orderBy("i").collect()]
    assert got == [e for _, _, e in cases]


def test_calls_and_results_are_linked(spark):
    c = calls(spark, [(1, 0, "a", "f", '{"b" : "x", "a": 2}', None), (1, 2, "b", "f", '{"a":1}', "a"), (1, 4, "c", "g", "{}", "b"), (2, 0, "x", "g", "{}", "y"), (2, 1, "y", "g", "{}", "x"), (3, 0, None, "g", None, None), (3, 1, "d", "g", "{}", "nowhere"), (3, 1, "d", "g", "{}", "nowhere")])
    r = spark.createDataFrame([(1, 1, "a", "ü\n"), (1, 3, "b", "2"), (1, 5, "b", "1"), (2, 2, "q", "lost"), (2, 3, None, None)], "conv_id long, turn long, call_id string, content string")
    rows = tool_calls.link_calls(c, r, TOOLS).collect()
    got = {x["call_id"]: x for x in rows if x["kind"] == "call"}
    assert [got[k]["level"] for k in "abcd"] == [0, 1, 2, 0] and got["x"]["level"] is None
    assert [got[k]["status"] for k in "abcxd"] == ["ok", "ok", "pending", "circular", "pending"]
    assert got["a"]["record"] == '{"arguments":{"a":2,"b":"x"},"errors":[],"id":"a","level":0,"n_results":1,"name":"f","result":"ü\\n","status":"ok"}'
    assert json.loads(got["b"]["record"])["result"] == "2" and json.loads(got["b"]["record"])["n_results"] == 2
    assert sum(x["call_id"] == "d" for x in rows) == 2 and sum(x["kind"] == "orphan" for x in rows) == 2
    assert tool_calls.link_calls(c.limit(0), r.limit(0), TOOLS).count() == 0


@pytest.mark.parametrize("hot", [10_000, 2])
def test_every_result_has_a_place(spark, hot, monkeypatch):
    monkeypatch.setattr(tool_calls, "HOT_RESULTS", hot)
    c = calls(spark, [(1, 0, "a", "g", "{}", None), (1, 2, "b", "g", "{}", "a"), (1, 2, "b", "g", "{}", "a")])
    sent = [(1, 3, "b", "y"), (1, 3, "b", "y"), (1, 3, "b", "x"), (2, 3, "b", "x"), (1, 1, "a", None), (1, 4, "a", "z"), (1, 1, "q", "o"), (1, 1, "q", "o"), (1, 1, None, "n")]
    rows = tool_calls.link_calls(c, spark.createDataFrame(sent, "conv_id long, turn long, call_id string, content string"), TOOLS).collect()
    told = sorted((r["kind"], str(r["call_id"]), r["conv_id"], r["turn"], json.loads(r["record"])["content"], r["level"]) for r in rows if r["kind"] != "call")
    assert told == [("orphan", "None", 1, 1, "n", None), ("orphan", "q", 1, 1, "o", None), ("orphan", "q", 1, 1, "o", None), ("result", "a", 1, 4, "z", 0), ("result", "b", 1, 3, "y", 1), ("result", "b", 1, 3, "y", 1), ("result", "b", 2, 3, "x", 1)]
    taken = {r["call_id"]: json.loads(r["record"]) for r in rows if r["kind"] == "call"}
    assert (taken["a"]["result"], taken["a"]["n_results"], taken["b"]["result"], taken["b"]["n_results"]) == (None, 2, "x", 4)


def test_levels_are_longest_ways(spark):
    after = {"a": [None], "b": ["a"], "c": ["b", "nowhere"], "d": ["a", "c", None], "e": ["d"], "f": ["e", "b"], "g": ["f", "x"], "x": ["y"], "y": ["x", "a"], "h": ["y"], "i": ["i", "a"]}
    c = calls(spark, [(1, 0, k, "g", "{}", p) for k, ps in after.items() for p in ps])
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": None, "x": None, "y": None, "h": None, "i": None}
    assert {r["call_id"]: r["level"] for r in tool_calls.levels(c).collect()} == want


def test_long_chains_are_ordered(spark):
    n = 300
    c = calls(spark, [(1, i, f"c{i}", "g", "{}", f"c{i - 1}" if i else None) for i in range(n)])
    assert {r["call_id"]: r["level"] for r in tool_calls.levels(c).collect()} == {f"c{i}": i for i in range(n)}


def test_messages(spark):
    df = spark.createDataFrame([(1, 0, "user", 'a "q"\n'), (1, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert [r["record"] for r in tool_calls.format_messages(df).orderBy("turn").collect()] == ['{"content":"a \\"q\\"\\n","role":"user"}', '{"content":null,"role":null}']
