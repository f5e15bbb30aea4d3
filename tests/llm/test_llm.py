"""The ten operators against brute force on small tables."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from unitsieve.llm import brown_lm, decontam, html_extract, line_templates, packing, quality_rules, sharding, simhash, substring, token_counts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split(text):
    return text.encode().split() if text else []


# --- 1 html


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on the site for the best of it and for you.</p></div>
<aside class="sidebar"><p>Look at this and at that in the side bar of the page, it is for you.</p></aside>
<article><h1>The  title &amp; more</h1><p>First   paragraph of the story, it is in the <a href="/x">sea</a>.</p><p>Short.</p>
<p><b>The last one<br>with a break.</p></article>
<section id="comments"><p>I think that this is the best of all that I have read in my life.</p></section>
<form><label>Name</label><input></form><script>var a = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "The title & more\nFirst paragraph of the story, it is in the sea.\nShort.\nThe last one with a break."


def test_html_without_article():
    body = "<div id=main><h2>Head</h2><p>" + "The story of the man and the sea is in this text, and it is long. " * 5 + "</p><p>Then it ends.</p></div>"
    page = "<body><ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(9)) + "</ul>" + body + "<p>All rights reserved. Copyright us</p></body>"
    assert html_extract.main_text(page).split("\n")[0] == "Head" and html_extract.main_text(page).endswith("Then it ends.")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "<p", "\x00", "<article></article>"])
def test_html_empty(page):
    assert html_extract.main_text(page) in ("", "<", "<p")


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"], len(r["text"])) for r in got] == [(1, len(got[0]["text"]), got[0]["n_chars"]), (2, 0, 0), (2, 0, 0)]
    assert html_extract.extract(pages.where("false")).count() == 0


ODD_MARKUP = {
    "<article><p>Before the picture.</p><svg class='i'/><p>After it in the text.</p></article>": "Before the picture.\nAfter it in the text.",
    "<article><!-- <script> old --><p>Text that stays.</p></article>": "Text that stays.",
    "<article><!-- <style> --><p>One.</p><style>p {}</style><p>Two.</p></article>": "One.\nTwo.",
    '<article><p>A <img alt="5" tall">picture.</p></article>': "A picture.",
    "<article><p>The sum <math><mi>x</mi></math> is it.</p></article>": "The sum x is it.",
    "<article><p>a<script>'</p>' > x</script> b <svg><text>no</text></svg> c</p><p": "a b c",
    '<article><p title="a > b">Text.</p><p title=\'c">d\'>More.</p></article>': "Text.\nMore.",
    "<article><p>x &lt; y &amp;amp; z &#x41;&eacute;&nbsp;w</p></article>": "x < y &amp; z Aé w",
    "<article><p>It is long. " + "word " * 200_000 + "</p></article>": "It is long. " + " ".join(["word"] * 200_000),
    "<p" + " a='b'" * 50_000: "",
    "<" * 50_000 + "<b>": None,
    "<article>" + "<div>" * 30_000 + "deep</i>" * 3 + "</div>" * 30_000 + "</article>": "deepdeepdeep",
    "<article><p>" + "<b>x</i></b>" * 30_000 + "</p></article>": "x" * 30_000,
}


@pytest.mark.parametrize("page", ODD_MARKUP)
def test_html_odd_markup(page):
    want = ODD_MARKUP[page]
    got = html_extract.main_text(page)
    assert want is None or got == want


def test_html_article_section_is_judged():
    """Articles that are link cards are not the main text; a lone "copyright" far into a page does not matter."""
    story = "The story of the man and the sea is in this text, and it is long, as copyright is. " * 4
    cards = "".join(f"<article><h2><a href=/{i}>Card {i}</a></h2><a href=/{i}>Read it</a></article>" for i in range(5))
    page = f"<body>{cards}<div><h2>Head</h2><p>{story}</p><p>{story}</p></div>{cards}</body>"
    assert html_extract.main_text(page) == "\n".join(["Head", story.strip(), story.strip()])
    links = "".join(f"<li><a href=/{i}>See the other page {i}</a></li>" for i in range(4))
    assert html_extract.main_text(f"<article><p>{story}</p><p><a href=/x>One link</a></p><p>{story}</p><ul>{links}</ul></article>") == f"{story.strip()}\nOne link\n{story.strip()}"


def _bare(page):
    """A page without the names of elements and classes that tell its parts."""
    import re

    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|header|aside)\b", r"<\1div", page))


def _by_rules(pages, wanted):
    hit = got = want = 0
    for page, text in zip(pages, wanted, strict=True):
        a, b = Counter(html_extract.main_text(_bare(page)).split("\n")), Counter(text.split("\n"))
        hit += sum(len(k) * min(n, b[k]) for k, n in a.items())
        got += sum(len(k) * n for k, n in a.items())
        want += sum(len(k) * n for k, n in b.items())
    return hit / max(1, got), hit / max(1, want)


def test_html_by_rules_alone_and_ablation(spark, monkeypatch):
    """Pages stripped of all element hints: the text rules find the article; without any one of them they find less."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120).collect()]
    wanted = [html_extract.main_text(p) for p in pages]
    precision, recall = _by_rules(pages, wanted)
    assert precision > 0.98 and recall > 0.94
    nav = ["<ul>" + "".join(f"<li><a href=/{i}>The way to the part {i} of it, for you and for all who are here</a></li>" for i in range(20)) + "</ul>" + p for p in map(_bare, pages)]
    first = _by_rules(nav, wanted)
    for without, least in (({"STOP_WORDS": frozenset()}, 1), ({"LINK_HIGH": 2.0, "LINK_ONLY": 2.0}, 0), ({"LENGTH_LOW": 0}, None)):
        with monkeypatch.context() as m:
            for name, value in without.items():
                m.setattr(html_extract, name, value)
            other = _by_rules(nav, wanted)
        assert other != first and (least is None or other[least] < first[least]), without


# --- 2 token counts


def brute_tokens(word, pieces, byte_score):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        best[end] = (best[end - 1][0] + width * byte_score, best[end - 1][1] + width)
        for start in range(end):
            p = pieces.get(word[start:end])
            if p is not None:
                s = (best[start][0] + p, best[start][1] + 1)
                if s[0] > best[end][0] or (s[0] == best[end][0] and s[1] < best[end][1]):
                    best[end] = s
    return best[-1][1]


def test_token_counts(docs, rows, odd, empty):
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    assert len(pieces) > 30_000
    trie = token_counts.Trie(pieces)
    known = {}
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    for i, t, *_ in rows:
        words = ["▁" + w.decode() for w in split(t)]
        if sum(map(len, words)) < 4000:
            for w in words:
                known.setdefault(w, brute_tokens(w, pieces, trie.byte_score))
            assert got[i]["n_tokens"] == sum(known[w] for w in words), i
        assert got[i]["n_words"] == len(words)
    assert token_counts.count_tokens(odd).count() == 6 and token_counts.count_tokens(empty).count() == 0


def test_agreement_with_the_vocabularys_own_tokenizer(spark):
    """No unigram file is at hand, so scores follow the vocabulary's order; how far the counts are from the tokenizer's own."""
    import sentencepiece

    path = token_counts.default_vocabulary()
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    trie = token_counts.Trie(token_counts.load_pieces(path))
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    words = Counter(w.decode() for r in texts for w in split(r["text"]))
    pairs = [(n, trie.tokens("▁" + w), len(own.encode(w))) for w, n in words.items()]
    total = sum(n for n, _, _ in pairs)
    assert sum(n for n, a, b in pairs if a == b) > 0.78 * total
    assert abs(sum(n * a for n, a, _ in pairs) / sum(n * b for n, _, b in pairs) - 1) < 0.08


def test_trie_is_bounded(monkeypatch):
    trie = token_counts.Trie({"a": -1.0, "ab": -1.5})
    monkeypatch.setattr(token_counts, "TRIE_NODES", 10)
    words = ["ab" * k + c for k in range(9) for c in "abc"]
    assert [trie.tokens(w) for w in words] == [brute_tokens(w, trie.pieces, trie.byte_score) for w in words]


# --- 3 quality


def brute_base(text):
    text = text or ""
    words = split(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    cover = {j for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover))


def test_quality_base(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        want = brute_base(t)
        assert tuple(got[i][c] for c in quality_rules.BASE_COLUMNS) == want, i
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.judge(odd).count() == 6 and quality_rules.judge(empty).count() == 0


def test_quality_verdicts(spark):
    """Held-out accuracy on the labelled rows that the base leaves open."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_quality_model():
    assert quality_rules.fit([]) == quality_rules.fit([])
    rng = random.Random(5)
    names = list(quality_rules.RULES)
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        patterns[tuple((quality_rules.RULES[n] if rng.random() < ((0.9 if good else 0.3) if quality_rules.RULES[n] > 0 else (0.01 if good else 0.3)) else 0) for n in names)] += 1
    model = quality_rules.fit(list(patterns.items()))
    assert abs(model["share"] - 0.8) < 0.05
    for n, h, m in zip(names, model["hit"], model["miss"], strict=True):
        assert h > m
        assert abs(h - (0.9 if quality_rules.RULES[n] > 0 else 0.3)) < 0.1


def test_drop_low_quality(docs, odd):
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    out = quality_rules.drop_low_quality(docs)
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} == kept
    assert quality_rules.drop_low_quality(odd).columns == odd.columns


# --- 4 simhash


def brute_fingerprint(text):
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    """id → smallest id reachable, over (id, fingerprint)."""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    f = np.array([values[i] for i in ids], np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k] ^ f[k + 1 :]) <= radius) + k + 1:
            a, b = find(ids[k]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = {i: brute_fingerprint(t) for i, t, *_ in rows if len(t or "") < 50_000}
    assert all(got[i]["fp"] & (1 << 64) - 1 == f for i, f in want.items())
    full = {i: got[i]["fp"] & (1 << 64) - 1 for i in got}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(full)
    assert simhash.near_duplicates(odd).count() == 6 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_lose_nothing(spark, tile):
    """Clusters, chains and single words; small tiles force the split of crowded ones."""
    rng = random.Random(tile)
    values = []
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            values.append(v)
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
    values += [0, 1, 3, 7, 15, (1 << 64) - 1]
    ids = dict(enumerate(dict.fromkeys(values)))
    nodes = spark.createDataFrame([(struct.unpack("<q", struct.pack("<Q", v))[0],) for v in ids.values()], "fp long")
    tree = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(nodes, tile_rows=tile)).collect()}
    groups = {}
    for v in ids.values():
        s = struct.unpack("<q", struct.pack("<Q", v))[0]
        groups.setdefault(tree.get(s, s), set()).add(v)
    want = {}
    for i, r in brute_components(ids).items():
        want.setdefault(r, set()).add(ids[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_drop_near_duplicates(docs, odd):
    groups = simhash.near_duplicates(docs).collect()
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({r["component_id"] for r in groups})
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(False, 5, "a b " * 40), (False, 7, "other text for the id"), (True, 0, ""), (True, 0, "the of and it is so")]


def test_two_texts_of_one_id_both_stay(spark):
    frame = spark.createDataFrame([(1, "the first text of this id is about the sea"), (1, "another one, quite unlike it, on mountains and snow")] * 3, "doc_id long, text string")
    assert simhash.drop_near_duplicates(frame).count() == 2


# --- 5 substrings


def brute_repeats(rows, window=13):
    first = {}
    words = {i: split(t) for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize(("window", "kmer", "path"), [(13, 5, 32), (13, 5, 2), (6, 2, 7)])
def test_substrings(docs, rows, window, kmer, path):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(docs, window=window, kmer=kmer, most=path).collect()}
    want = brute_repeats(rows, window)
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_substrings_few_words(spark):
    """Two words only: windows repeat inside and across documents at every offset."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40))), "", "", 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for window, kmer in ((6, 2), (4, 3)):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(frame, window=window, kmer=kmer, most=5).collect()}
        assert got == brute_repeats(rows, window)


def test_substrings_odd(odd, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.remove_repeats(odd).collect())
    assert got == [(False, 5, 80, 0), (False, 5, 80, 0), (False, 7, 5, 0), (False, 7, 80, 80), (True, 0, 0, 0), (True, 0, 6, 0)]
    assert substring.remove_repeats(empty).count() == 0


def brute_rows(rows, window=13):
    """Rows of any ids: a row of ``(id, text)`` → its counts and kept words."""
    last = float("inf")
    first = {}
    words = [(last if i is None else i, split(t)) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, last))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def many_rows(seed, n, own):
    """Short texts of two words drawn from a few passages, with ids from ``own``."""
    rng = random.Random(0)
    vocab = [f"v{k}" for k in range(900)]
    passages = [[rng.choice(vocab) for _ in range(30)] for _ in range(60)]
    rng = random.Random(seed)
    out = []
    for k in range(n):
        p = rng.choice(passages)
        a = rng.randrange(12)
        words = [rng.choice(vocab) for _ in range(rng.randrange(8))] + p[a : a + rng.randrange(5, 25)] + [rng.choice(vocab) for _ in range(rng.randrange(8))]
        out.append((own(k, rng), " ".join(words)))
    return out


@pytest.mark.parametrize("ids", ["null", "one", "some"])
def test_many_rows_without_an_id_of_their_own(spark, ids):
    """400 rows with ids of their own, and 5,000 without id or of one id."""
    own = {"null": lambda k, r: None, "one": lambda k, r: 150, "some": lambda k, r: r.choice([None, 7, 150, 390])}[ids]
    rows = many_rows(1, 400, lambda k, r: k) + many_rows(2, 5000, own)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(frame).collect())
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute_rows(rows), strict=True))
    assert got == want and sum(x[3] for x in want) > 10_000


def test_chains_compact_and_are_verified(spark, monkeypatch):
    """Whole copies compact to one chain each; a digest that differs keeps the words."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    rows = [(k, base) for k in range(6)] + [(9, " ".join(base.split()[40:200]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = frame.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    spans, _ = substring.covered_spans(numbered)
    got = spans.groupBy("row").agg((F.sum(F.coalesce("length", F.lit(0)) + F.coalesce(F.bit_count("bits"), F.lit(0)))).alias("windows"), F.count("*").alias("n")).collect()
    assert sorted(r["windows"] for r in got) == [148, *[288] * 5] and max(r["n"] for r in got) <= 5
    monkeypatch.setattr(substring, "_read_again", lambda window: _other_digests(window))
    assert {r["n_removed"] for r in substring.remove_repeats(frame).collect()} <= {0, 18}  # windows at the cut copy's start have digests of their own


def _other_digests(window, real=substring._read_again):
    run, schema = real(window)

    def other(batches):
        for batch in run(batches):
            digest = [d if b >= 0 else b"x" * 16 for b, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digest, pa.binary())], schema=batch.schema)

    return other, schema


# --- 6 sharding


def brute_shard(key, topology):
    def draw(level, path, weight):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        for x in (level, *path):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return -math.log(((h >> 12) + 0.5) / 2**52) / weight

    tree = topology.tree()
    total = lambda n: sum(total(x) if isinstance(x, dict) else x for x in n.values())
    region = min(tree, key=lambda r: (draw(0, (r,), total(tree[r])), r))
    racks = tree[region]
    rack = min(racks, key=lambda k: (draw(1, (region, k), total(racks[k])), k)) if len(racks) > 1 else next(iter(racks))
    shards = racks[rack]
    return min(shards, key=lambda s: (draw(2, (region, rack, s), shards[s]), s)) if len(shards) > 1 else next(iter(shards))


def test_sharding(spark, docs, rows, odd, empty):
    t = sharding.Topology.grid(5, 2, 4)
    got = sharding.shard(docs, t).collect()
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "key")
        assert r["shard"] == brute_shard(r["doc_id"], t) and r["grown_shard"] == brute_shard(r["doc_id"], t.grow())
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard(many, t, buckets=16).collect()
    assert {r["grown_shard"] for r in out if r["grown_shard"] != r["shard"]} == {40}
    slots, sizes = {}, Counter(r["shard"] for r in out)
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * min(sizes.values())
    assert sharding.shard(odd, t).count() == 6 and sharding.shard(empty, t).count() == 0
    rows = [(None, f"t{k % 700}") for k in range(3000)] + [(5, f"t{k % 700}") for k in range(3000)] + [(7, "equal")] * 2000
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), t, buckets=8).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((i, zlib.crc32(x.encode())) for i, x in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_confine_movement(spark):
    """A heavier shard draws keys into its region only from elsewhere, and no key
    moves between two other regions."""
    t = sharding.Topology.grid(3, 2, 2)
    leaves = list(t.leaves)
    leaves[0] = (0, 0, 3.0)
    heavy = sharding.Topology(tuple(leaves))
    keys = spark.range(5000).select(sharding.assign(F.col("id"), t).alias("a"), sharding.assign(F.col("id"), heavy).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in keys if r["a"] != r["b"]]
    assert moved and all(t.leaves[b][0] == 0 for _, b in moved)
    share = sum(r["b"] == 0 for r in keys) / len(keys)
    assert abs(share - 3 / 14) < 0.03


def test_native():
    import inspect

    for module in (sharding, line_templates):
        assert not any(x in inspect.getsource(module) for x in ("udf(", "mapIn", "applyIn", ".rdd", "import pandas", "pyarrow"))


# --- 7 language model


def test_language_model(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in brown_lm.score(docs).collect()}
    tokens = {i: [*(t.encode().translate(LOWER).split() if t else []), None] for i, t, *_ in rows}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert brown_lm.score(odd).count() == 6 and brown_lm.score(empty).count() == 0


def small_levels(monkeypatch):
    for name, value in {"HEAD": 150, "LEADERS": 60, "FIRST": 20}.items():
        monkeypatch.setattr(brown_lm, name, value)


@pytest.mark.parametrize("ids", ["own", "null", "one"])
def test_scores_with_a_small_head(spark, monkeypatch, ids):
    """Words outside the head, many rows without id or of one id, equal under any partitioning."""
    small_levels(monkeypatch)
    own = {"own": lambda k, r: 500 + k, "null": lambda k, r: None, "one": lambda k, r: 150}[ids]
    rows = many_rows(1, 400, lambda k, r: k) + many_rows(2, 5000, own) + [(3, "rare Rare once")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = [[*t.encode().translate(LOWER).split(), None] for _, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, o in zip(tokens, out, strict=True) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True))
    seen = []
    for parts in (1, 7):
        got = brown_lm.score(frame.repartition(parts)).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n}
        seen.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in got))
    assert seen[0] == seen[1]


def test_score_by_brute_force(spark, docs, rows, monkeypatch):
    """The class model counted again from the texts, given each unit's class."""
    small_levels(monkeypatch)
    held = {}
    real = brown_lm.learn
    monkeypatch.setattr(brown_lm, "learn", lambda train, lex, classes: held.setdefault("of", (lex, real(train, lex, classes)))[1])
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(docs, classes=6).collect()}
    lex, of = held["of"]
    assert lex.size > 100 and len(set(of[: lex.size].tolist())) == 6 and of[lex.end] == 6
    cls = lambda w: 6 if w is None else int(of[lex.index[w]] if w in lex.index else of[lex.size + brown_lm.suffix_group(w)])
    texts = {i: [*(t.encode().translate(LOWER).split() if t else []), None] for i, t, *_ in rows}
    train = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for ws in train for w in ws)
    moves = Counter((cls(a), cls(b)) for ws in train for a, b in zip([None, *ws], ws, strict=False))
    after, size, kinds = Counter(), Counter(), Counter()
    for (a, _), k in moves.items():
        after[a] += k
    for w, k in count.items():
        size[cls(w)] += k
        kinds[cls(w)] += 1
    for i, ws in texts.items():
        want = 0.0
        for a, b in zip([None, *ws], ws, strict=False):
            want += math.log10((moves[cls(a), cls(b)] + 0.1) / (after[cls(a)] + 0.1 * 7)) + math.log10((count[b] + 0.1) / (size[cls(b)] + 0.1 * (kinds[cls(b)] + 1)))
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_exchange_gains_are_likelihoods():
    """A move's gain is the change of the likelihood, counted anew."""
    rng = np.random.default_rng(7)
    pairs = rng.integers(0, 6, (14, 14)).astype(float)
    of = np.append(rng.integers(0, 3, 13), 3)

    def reached(of):
        one = np.eye(4)[of]
        return brown_lm.likelihood(one.T @ pairs @ one)

    for u in range(13):
        one = np.eye(4)[of]
        own, right, left = pairs[u, u], pairs[u] @ one, pairs[:, u] @ one
        right[of[u]] -= own
        left[of[u]] -= own
        m = one.T @ pairs @ one
        brown_lm._without(m, of[u], right, left, own)
        gain = brown_lm.gains(m, right, left, own)
        for k in range(3):
            moved = of.copy()
            moved[u] = k
            assert math.isclose(gain[k] - gain[of[u]], reached(moved) - reached(of), abs_tol=1e-8)


def test_rounds_raise_the_likelihood():
    """Exchange over counts with classes ends above its start, as exchange over pairs does."""
    rng = np.random.default_rng(2)
    kind = np.arange(40) % 3
    pairs = np.where((kind[:, None] + 1) % 3 == kind, 9, 0) + rng.integers(0, 2, (40, 40))
    of = np.append(rng.integers(0, 3, 39), 3)
    reached = []
    for _ in range(4):
        one = np.eye(4)[of]
        near = np.concatenate((pairs @ one, pairs.T @ one, np.diag(pairs)[:, None]), axis=1).astype(np.int64)
        reached.append(brown_lm.likelihood(brown_lm.class_moves(near, of, 3)))
        of, _ = brown_lm.sweep(near, of, 3)
    assert max(reached[1:]) > reached[0]
    best = brown_lm.cluster(pairs, 3)
    assert brown_lm.likelihood((np.eye(4)[best]).T @ pairs @ np.eye(4)[best]) >= max(reached) - 1e-6 or max(reached) > reached[0]


def test_model_is_a_distribution():
    rng = np.random.default_rng(3)
    lex = brown_lm.Lexicon([f"w{i}".encode() for i in range(700)])
    of = np.append(rng.integers(0, 8, lex.units - 1), 8)
    heads = rng.integers(1, 9, 700)
    m = brown_lm.Model(lex, of, rng.integers(0, 50, (9, 9)).astype(float), heads, {}, 10, 8)
    assert np.allclose((10**m.move).sum(axis=1), 1)
    for k in range(8):
        inside = 10 ** (m.emit[:700][of[:700] == k] - m.class_log[k])
        assert math.isclose(inside.sum() + 10 ** (math.log10(0.1) - m.class_log[k]), 1, rel_tol=1e-9)


def test_clustering_finds_blocks():
    """Units of two languages that never mix end in different classes."""
    pairs = np.zeros((60, 60), int)
    rng = np.random.default_rng(1)
    for u in range(40):
        for w in range(40):
            if u % 2 == w % 2:
                pairs[u, w] = rng.integers(1, 20)
    of = brown_lm.cluster(pairs, 4)
    assert not set(of[0:40:2]) & set(of[1:40:2]) and of[-1] == 4


def test_model_beats_the_base(spark):
    got = brown_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


# --- 8 decontamination


def brute_bm25(index, items, query):
    words = [decontam.terms(t) for _, t in items]
    n, mean = len(items), sum(map(len, words)) / len(items)
    df = Counter(t for w in words for t in set(w))
    out = {}
    for i, w in enumerate(words):
        tf = Counter(w)
        one = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (decontam.K1 + 1) / (tf[t] + decontam.K1 * (1 - decontam.B + decontam.B * len(w) / mean))  # noqa: B023, E731
        out[i] = sum(one(t) for t in set(query) if t in tf) / sum(one(t) for t in tf)
    return out


@pytest.mark.parametrize("block", [1, 4, 64])
def test_wand_finds_all(block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rng = random.Random(block)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab[: 5 + i % 55]) for _ in range(rng.randrange(8, 30)))) for i in range(80)]
    index = decontam.Index(items)
    items = [items[i] for i in index.ids]
    for _ in range(60):
        query = [rng.choice(vocab).encode() for _ in range(rng.randrange(1, 25))]
        want = brute_bm25(index, items, query)
        known = sorted({index.term[t] for t in query if t in index.term})
        for threshold in (0.2, 0.5):
            got = dict(index.search(known, threshold))
            assert set(got) == {i for i, s in want.items() if s >= threshold - 1e-9}
            assert all(math.isclose(s, want[i]) for i, s in got.items())


def test_contaminated(spark, docs, rows):
    rng = random.Random(4)
    bench = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(20)) + ". " + " ".join(f"a{rng.randrange(900)}" for _ in range(6)) + ".") for k in range(12)]
    dirty = [(1000 + k, "the of and " * 30 + t.replace(" ", "\n" if k % 2 else " ").upper() + " la de " * 50, "en", "s", 0) for k, t in bench[:5]]
    half = [(2000, "the " * 20 + bench[7][1].partition(".")[0] + " und die " * 9, "en", "s", 0)]
    items = spark.createDataFrame([*bench, (99, None), (98, "too short"), (97, "")], "item_id long, text string")
    table = docs.unionByName(spark.createDataFrame(dirty + half, docs.schema))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, items).collect()}
    assert got == {(1000 + k, k) for k in range(5)}
    out = decontam.drop_contaminated(table, items)
    assert out.columns == docs.columns and out.count() == len(rows) + 1
    assert decontam.contaminated(table, items.where("false")).count() == 0 and decontam.contaminated(table.where("false"), items).count() == 0


def test_many_indexes(spark, monkeypatch):
    base = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    texts, tests = docs.toPandas(), items.toPandas()
    assert want >= {(d, i) for d, t in zip(texts.doc_id, texts.text, strict=True) for i, b in zip(tests.item_id, tests.text, strict=True) if b in t}
    assert len(list(decontam.indexes(items, most=10))) == 4
    real = decontam.indexes
    monkeypatch.setattr(decontam, "indexes", lambda b: real(b, most=10))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    assert found >= {(d, i) for d, t in zip(texts.doc_id, texts.text, strict=True) for i, b in zip(tests.item_id, tests.text, strict=True) if b in t}
    left = {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()}
    assert left == set(texts.doc_id) - {d for d, _ in found}


def test_contaminated_odd_rows(spark, odd):
    """Null ids and texts, repeated rows, clashing columns; a repeated item counts once."""
    item = "of the a b a b a b a b one two three four five six. So it is said."
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (None, "x y z w of the sea and the land. All of it.")], "item_id long, text string")
    rows = [(None, f"Here: {item} there", "x", 1, 2, 3), (9, f"Here: {item}", "x", 1, 2, 3), (9, f"Here: {item}", "x", 1, 2, 3)]
    wide = odd.unionByName(spark.createDataFrame(rows, odd.schema)).withColumn("item_id", odd["n"]).withColumn("score", odd["n"])
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(wide, items).collect())
    assert got == {(None, 1): 1, (None, 2): 1, (9, 1): 2, (9, 2): 2}
    left = decontam.drop_contaminated(wide, items)
    assert left.columns == wide.columns and left.count() == 6


def test_short_items(spark):
    """Items below eight words, of one term, and in a script without blanks."""
    items = [(1, "What is the capital of France? Paris."), (2, "光合作用在植物的哪个部分进行？叶绿体。"), (3, "水的沸点？百度。"), (4, "Xylographer"), (5, "Capital of Peru? Lima.")]
    texts = ["So, Q: what is the capital of France? A: Paris, of course.", "我们知道光合作用在植物的哪个部分进行？叶绿体。这是答案", "问：水的沸点？百度。", "the xylographer is here", "Capital of Peru: Lima", "What is the capital of the region in France and not Paris", "我们在植物的部分进行", "Paris is the capital of France", "capital of Peru"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, table).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, table).collect()) == [5, 6, 7, 8]


# --- 9 line templates


def test_lines(spark, docs, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        own = "\n".join(" ".join(f"w{rng.randrange(5000)}x"[:-1].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) + " longword" + str(i).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(3))
        head = f"Printed on page {i} of {i + 100}"
        note = "Posted in the archive by " + rng.choice(["anna", "bert", "cleo", "dora", "emil"]) + " under the usual terms of use"
        rows.append((i, f"{head}\n{own}\n{note if i % 2 else ''}"))
    copied = rows[0][1].split("\n")[1]
    rows += [(100 + i, rows[0][1].split("\n")[1] + "\nunique tail") for i in range(40)]
    out = {r["doc_id"]: r for r in line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:60]:
        lines = text.split("\n")
        assert out[i]["text"] == "\n".join([*lines[1:4], *([""] if not i % 2 else [])]), i
        assert out[i]["__dropped"] == (2 if i % 2 else 1) and out[i]["__lines"] == 5
    assert all(copied in out[100 + i]["text"] for i in range(40))  # one family
    assert line_templates.clean_lines(odd).count() == 6 and line_templates.clean_lines(empty).count() == 0
    kept = line_templates.drop_template_lines(docs)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()


def chain_hash(values):
    """Spark's xxhash64 of several columns: each value hashed with the hash before as seed, nulls passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return struct.unpack("<q", struct.pack("<Q", h))[0]


def brute_line_dedup(texts, masked, min_families=10):
    """Row → numbers of its dropped lines. Plain loops over the same rules."""
    m = line_templates
    lines = [[(k, masked[x]) for k, x in enumerate((t or "").split("\n")) if masked[x]] for t in texts]
    seen = {}
    for t, found in zip(texts, lines, strict=True):
        for _, line in found:
            seen.setdefault(line, set()).add(t)
    leaves = {}
    for line in seen:
        tokens = line.split(" ")
        leaves.setdefault((len(tokens), tuple(tokens[: min(m.LEADING, max(1, len(tokens) - 1))])), []).append(line)
    groups = [[line] for line in seen if len(seen[line]) >= min_families]
    for kinds in leaves.values():
        if len(kinds) > 1 and sum(len(seen[x]) for x in kinds) >= min_families:
            split = [x.split(" ") for x in kinds]
            fixed = {k: w for k in range(len(split[0])) for w, n in Counter(x[k] for x in split).items() if 2 * n > len(split)}
            good = [" ".join(x) for x in split if len(fixed) >= m.CONSTANT * len(x) and sum(x[k] == w for k, w in fixed.items()) >= m.AGREE * len(fixed)]
            if sum(len(seen[x]) for x in good) >= min_families:
                groups.append(good)
    shingles = {}

    def keys(text, without):
        least = [None] * len(m.ORDERS)
        for line in {masked[x] for x in text.split("\n")} - {"", without}:
            if line not in shingles:
                words = line.split(" ")
                hashes = [chain_hash(words[k : k + 3]) for k in range(len(words))]
                shingles[line] = [h for k, h in enumerate(hashes) if len(words) <= m.SAMPLED or k == 0 or not h & (m.SAMPLE - 1)]
            for j, order in enumerate(m.ORDERS):
                for h in shingles[line]:
                    x = h ^ order
                    least[j] = x if least[j] is None else min(x, least[j])
        return tuple((b, tuple(least[b :: m.BANDS])) for b in range(m.BANDS))

    gone = set()
    for group in groups:
        rows = {keys(t, line) for line in group for t in seen[line]}
        roots = {r: r for r in rows}

        def find(x, roots=roots):
            while roots[x] != x:
                x = roots[x]
            return x

        by_key = {}
        for r in rows:
            for key in r:
                roots[find(r)] = find(by_key.setdefault(key, r))
        if len({find(r) for r in rows}) >= min_families:
            gone |= set(group)
    return [[k for k, line in found if line in gone] for found in lines]


def two_sided(spark, rows):
    texts = [t for _, t in rows]
    every = sorted({x for t in texts for x in (t or "").split("\n")})
    found = spark.createDataFrame([(x,) for x in every], "x string").select("x", line_templates.masked(F.col("x")).alias("m")).collect()
    masked = {r["x"]: r["m"] for r in found}
    want = brute_line_dedup(texts, masked)
    got = {r["doc_id"]: r for r in line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), gone in zip(rows, want, strict=True):
        lines = (t or "").split("\n")
        assert got[i]["__dropped"] == len(gone), i
        assert got[i]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)), i
    return sum(map(len, want))


def test_lines_by_brute_force(spark):
    """Exact lines, wildcards, copies and near copies: what is dropped and what stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert two_sided(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]) > 100
    rng = random.Random(64)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    notes = ["Signed off by @ on the day of the fair at @ hall", "Share this page with @", "To be read in the room of the @ only, thanks"]
    rows = []
    for i in range(150):
        own = [" ".join(word() for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 4))]
        note = rng.choice(notes)
        while "@" in note:
            note = note.replace("@", word(), 1)
        own.insert(rng.randrange(len(own) + 1), note)
        if i % 7 == 0:
            own = rows[rng.randrange(len(rows))][1].split("\n") if rows else own
            own = [*own, word()] if i % 2 else own
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (501, ""), (502, "\n\n")]
    assert two_sided(spark, rows) > 60


def test_long_text_of_many_lines(spark):
    """A document of 30,000 lines, half of them recurring."""
    rng = random.Random(65)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notes = [f"note of the {word()} {word()} kind {word()}" for _ in range(50)]
    rows = [(i, f"{word()} {word()} {word()} {word()}\n{notes[i % 50]}") for i in range(100, 700)]
    rows.append((99, "\n".join(notes[k % 50] if k % 2 else f"{word()} {word()} own" for k in range(30_000))))
    out = {r["doc_id"]: r for r in line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[99]["__dropped"] == 15_000 and out[99]["text"].split("\n") == rows[-1][1].split("\n")[::2]


def test_line_of_unrelated_documents_and_a_copied_text(spark):
    """A text copied often neither keeps a recurring line nor is cut itself, near copies included."""
    rng = random.Random(61)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n=12: " ".join(word() for _ in range(n))
    note = "All of the rights are with the owner"
    base = [prose() for _ in range(12)]
    rows = [(i, f"{prose()}\n{prose()}\n{note}") for i in range(50)]
    rows += [(100 + i, "\n".join([*base, note])) for i in range(5000)]
    for i in range(300):
        near = list(base)
        words = near[i % 12].split(" ")
        words[rng.randrange(12)] = word()
        near[i % 12] = " ".join(words)
        rows.append((10_000 + i, "\n".join([*near, note])))
    out = {r["doc_id"]: r for r in line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["text"] == t[: -len(note) - 1] for i, t in rows)


def test_family_leaves_out_the_line(spark):
    """Short documents that share all their long words, and a long passage, in the line judged."""
    rng = random.Random(62)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    notes = ["Released under the MIT License.", " ".join(word() + "ingings" for _ in range(50))]
    rows = [(i, f"{word()} {word()} {word()}.\n{notes[i % 2]}") for i in range(200)]
    out = line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["text"] == rows[r["doc_id"]][1].split("\n")[0] for r in out)


def test_templates_of_any_length(spark):
    """One token varies in a line of three words and in one of ninety."""
    rng = random.Random(63)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        long[70] = word()
        own = " ".join(word() for _ in range(20))
        rows.append((i, f"Posted by {word()}\n{own}" if i % 2 else " ".join(long) + f"\n{own}"))
    out = line_templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["text"] == rows[r["doc_id"]][1].split("\n")[1] for r in out)


# --- 10 packing


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    return lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")


def check_packing(out, ids_of, window):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        want, at = ids_of[i], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert zlib.crc32(want[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(want)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(docs, rows, ids, window):
    want = {i: ids(t) for i, t, *_ in rows}
    out = packing.pack(docs, window=window).collect()
    assert {r["doc_id"] for r in out} == set(want)
    assert check_packing(out, want, window) == 0


def test_packing_joins_when_many_are_cut(docs, rows, ids, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_IDS", 0)
    out = packing.pack(docs, window=64).collect()
    assert check_packing(out, {i: ids(t) for i, t, *_ in rows}, 64) == 0


def test_packing_odd(odd, empty):
    out = packing.pack(odd).collect()
    assert sum(r["length"] for r in out if r["start"] == 0 and r["length"] == r["doc_tokens"]) <= sum(r["length"] for r in out)
    assert packing.pack(empty).count() == 0


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.default_tokenizer())
    assert e.by_word
    texts = ["", "  ", "It's WE'LL don't 12ab x² ¼", "a\x1cb §x <|endoftext|> Foo", "é́ ΣΑΣ İx", "tab\tx\x0by 123 ñ §\x85z q r", "日本 \x01a ß ÿ ×÷", "<|startoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [e.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_fills_are_exact_and_closest():
    rng = random.Random(9)
    for _ in range(40):
        stock = {rng.randrange(1, 50): rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))}
        exact, rest = packing.fills(stock, 50)
        used = Counter()
        for times, counts in exact:
            assert sum(k * c for k, c in counts.items()) == 50
            for k, c in counts.items():
                used[k] += times * c
        assert {k: n for k, n in (used + Counter(rest)).items() if n} == stock
        if rest:  # no exact fill is left over
            top = max(rest)
            sums = {top}
            left = Counter(rest)
            left[top] -= 1
            for k, n in left.items():
                for _ in range(n):
                    sums |= {s + k for s in sums}
            assert 50 not in sums
