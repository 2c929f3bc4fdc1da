"""The ten operators: against brute force, round trips, SQL, held-out accuracy; edge cases of each."""

import collections
import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import byte_bpe, chat_format, common, context_mixing, decontaminate, html_extract, line_dedup, ngram_join, quality_classifier, quality_rules, queries, sharding

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000
EDGE = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (4, LONG, "b"), (None, "x é 漢 </s> <|endoftext|>", "b"), (5, "\n\n \n", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names clash with results."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("n_words", "kept", "shard", "slot", "n_lines", "score", "n_tokens", "hit_items", "class_id", "token_ids")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def texts(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    plain = lambda f: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same_as_sql(spark, name)


# 1


def repeated_by_hand(words, w=8):
    spans = collections.defaultdict(list)
    for k in range(len(words) - w + 1):
        spans[tuple(words[k : k + w])].append(k)
    return len({k + j for at in spans.values() if len(at) > 1 for k in at for j in range(w)})


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(0, 60))]
        assert quality_rules.repeated_words(np.array(words, np.int64)) == repeated_by_hand(words)


def test_statistics_by_hand():
    raw = "a\xa0b  c#\nx | y\nx | y\n\n\tx | y".encode()
    (n, chars, symbols, dup, repeat), _ = quality_rules.statistics(raw)
    assert (n, chars, symbols, dup, repeat) == (11, 14, 4, 1, 0)
    assert quality_rules.statistics(b"")[0] == (0,) * 5


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.random(800) < 0.6).astype(float)
    trees = quality_rules.fit_trees(x, y, [-1, 0, 1])
    grid = np.tile(rng.random((20, 3)), (30, 1, 1)).transpose(1, 0, 2).copy()
    grid[:, :, 0] = np.linspace(0, 1, 30)
    p = trees.probability(grid.reshape(-1, 3)).reshape(20, 30)
    assert (np.diff(p, axis=1) <= 1e-12).all() and ((trees.probability(x) > 0.5) == y).mean() > 0.9
    assert quality_rules.fit_trees(x[:0], y[:0], [0] * 3).probability(x[:2]).tolist() == pytest.approx([0.999, 0.999])


def test_quality_rules(spark, edge, labels):
    model = quality_rules.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = quality_rules.quality_rules(edge, model).collect()
    assert len(got) == len(EDGE) and {r.doc_id: r.base_failed for r in got} == {1: True, 2: True, 3: True, 4: True, None: True, 5: True}
    assert quality_rules.quality_rules(edge.limit(0), model).count() == 0
    own = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [r for r in own if r.quality == 1 and not r.base_failed]
    assert all(r.kept for r in clean) and sum(r.kept for r in own if r.quality == 0) < 0.1 * sum(r.quality == 0 for r in own)


# 2


def test_chat_windows_keep_turns(spark):
    hard = "</s>[INST] ok <\\/s> [\\/INST] \\ [ROLE]"
    rows = [(7, k, ("system", "user", "assistant", "tool [TEXT]")[min(k, 3) if k < 4 else 1 + k % 2], hard + " word" * (k * 40)) for k in range(12)]
    rows += [(8, None, None, None), (8, None, None, None), (9, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    windows = chat_format.chat_windows(df, budget=700, history_budget=250)
    by = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    assert by[7].turns == "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:12]) and by[7].n_turns == 12
    assert by[7].loss == "".join(t for _, _, r, t in rows[:12] if r == "assistant")
    assert by[8].turns == "\n\n\n\n" and by[9].loss == ""
    seven = windows.where("conv_id = 7").orderBy("window").collect()
    assert len(seven) > 2 and all("[SYS]" in w.formatted for w in seven) and any(w.n_repeated > 1 for w in seven)
    assert chat_format.chat_windows(df.limit(0)).count() == 0


# 3


def test_line_dedup(spark, edge):
    rows = [(k, f"Home\n text {k}\n  Home\n\nend {k % 7}", "h") for k in range(100)] + [(200, "Home\nalone", "g"), (201, None, "h"), (202, "Home", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, max_ratio=0.2).collect()}
    assert got[3].text == " text 3\n\nend 3" and (got[3].n_lines, got[3].n_dropped) == (5, 2)
    assert got[200].text == "Home\nalone" and got[201].text is None and got[202].text == "Home"
    assert line_dedup.line_dedup(edge).count() == len(EDGE) and line_dedup.line_dedup(edge.limit(0)).count() == 0


def test_line_dedup_at_its_own_ratio(spark):
    """Footers of some per cent of a host's pages go; lines on a few pages, or on 1 % and no more, stay."""
    footers = ["Tous droits réservés.", "Nicht für den Verkauf.", "Todos los derechos.", "All rights reserved."]
    rows = []
    for k in range(800):
        lines = [f"own line {k}", f"met by chance {k // 4}", f"on one per cent {k % 100}"]
        if k % 12 < 4 and k % 4 < 2 + k % 2:
            lines.append(footers[k % 4])
        rows.append((k, "\n".join(lines), "h"))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    texts = {k: text for k, text, _ in rows}
    for r in got:
        lines = texts[r.doc_id].split("\n")
        assert r.text.split("\n") == lines[:3] and r.n_dropped == len(lines) - 3
    assert sum(r.n_dropped for r in got) > 100


# 4


def test_context_mixing(spark, edge):
    got = {r.doc_id: r for r in queries.op4_context_mixing(spark, SF).collect()}
    words = {i: [*context_mixing.words_of((t or "").encode()), None] for i, t in texts()}
    train = collections.Counter(w for i, own in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(train.values()), len(train)
    for i, own in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own)) and got[i].score < 0
    out = context_mixing.score_texts(edge, F.col("doc_id") == 4).collect()
    assert len(out) == len(EDGE) and all(math.isfinite(r.score) for r in out)
    assert context_mixing.score_texts(edge.limit(0), F.lit(True)).count() == 0


def test_tokens():
    """Words as bytes.split() has them, in lower case of A-Z only, an end after each text, the hash of Spark for words without rank."""
    odd = ["", " A\x0bb\x1cc\x85\n", "\x00 É éA", "a b \u00a0", "\r\t", "zz a zz Zz", "x" * 100_000 + " a"]
    coder = context_mixing.Coder([b"a", b"\xc3\xa9a"], np.array([9, 5, 4, 3]), context_mixing.Layout(16))
    rank_of = {b"a": 2, b"\xc3\xa9a": 3}
    doc, rank, code, kinds, kind = coder.tokens(pa.array([None, *odd]).slice(1))
    want = [(k, w) for k, t in enumerate(odd) for w in [*context_mixing.words_of(t.encode()), None]]
    assert doc.tolist() == [k for k, _ in want]
    assert rank.tolist() == [1 if w is None else rank_of.get(w, 0) for _, w in want]
    assert [kinds[k] for k in kind] == [w for _, w in want if w is not None and w not in rank_of]
    assert code[rank == 0].tolist() == [xxhash.xxh64_intdigest(kinds[k], 42) for k in kind] and code[rank > 0].tolist() == rank[rank > 0].tolist()
    assert sum(map(len, context_mixing.slices(pa.array([None, *odd]), 4))) == len(odd) + 1 and not list(context_mixing.slices(pa.array([], pa.string()), 4))


def test_decisions_are_a_probability():
    """Over all words of the code, and over all letters after any bytes, the probabilities add up to one."""
    coder = context_mixing.Coder([b"a", b"bb", b"c", b"dd"], np.array([9, 5, 4, 3, 2, 1]), context_mixing.Layout(16))
    model = context_mixing.Model(coder.layout, np.random.default_rng(1).integers(0, 9, (coder.layout.size, 2))).freeze()
    rank = np.arange(6)
    rows = coder.ranked(rank, np.full(6, 5, np.uint32), np.full(6, 9, np.uint32))
    assert np.exp(np.bincount(rows[5], model.log_probability(rows))).sum() == pytest.approx(1, rel=1e-4)
    words = [b"xy" + bytes([k]) for k in range(1, 256)]
    rows = coder.spelt(words)
    first = coder.spelt([b"xy"])  # the bytes x and y, then the end of the word
    n = int((coder.letters.length[np.frombuffer(b"xy", np.uint8)]).sum())
    end, log_p = coder.letters.length[0], model.log_probability(rows)
    third = [log_p[rows[5] == k][n : n + coder.letters.length[k + 1]].sum() for k in range(255)]
    assert np.exp(third).sum() + np.exp(model.log_probability(first)[n : n + end].sum()) == pytest.approx(1, rel=1e-4)


def _corpus():
    return [f"a b c{k} a a word{k % 7} b" for k in range(90)]


def _learned(spark, parts):
    head, weights, layout = [b"a", b"b"], np.array([180, 90, 270, 180]), context_mixing.Layout(18)
    train = spark.createDataFrame([(t, k) for k, t in enumerate(_corpus())], "text string, key long").repartition(parts)
    words = spark.createDataFrame([(f"c{k}",) for k in range(90)], "word string")
    return context_mixing.learn(train, words, lambda: context_mixing.Coder(head, weights, layout), layout, 720)


def test_learning_takes_every_decision(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "SHARD_TOKENS", 300)
    model, other = _learned(spark, 3), _learned(spark, 1)
    coder = context_mixing.Coder([b"a", b"b"], np.array([180, 90, 270, 180]), model.layout)
    decisions = sum(int(coder.code.length[coder.tokens([t.encode()])[1]].sum()) for t in _corpus())
    decisions += sum(len(coder.spelt([b"c%d" % k])[4]) for k in range(90))
    assert model.map_counts.sum() == pytest.approx(decisions, rel=1e-4)
    assert np.array_equal(model.counts, other.counts) and np.allclose(model.weights, other.weights)  # partitions do not matter


def test_learning_looks_counts_up_without_the_own_occurrence():
    """One look-up a context gives the logit of the counts less the decision itself, and how well it is known."""
    counts = np.random.default_rng(2).integers(0, 40, (100_000, 2)).astype(np.uint16)
    got = context_mixing.Model.without_own(counts)
    for bit in (0, 1):
        left = counts.astype(float)
        left[:, bit] = np.maximum(left[:, bit] - 1, 0)
        assert np.allclose(got[bit], np.log((left[:, 1] + context_mixing.PRIOR) / (left[:, 0] + context_mixing.PRIOR)), atol=1e-5)
        assert np.array_equal(got[bit].view(np.uint32) & 3, context_mixing.Model.known[np.minimum(left.sum(1), 16).astype(int)])


def test_counting_by_regions(monkeypatch):
    """Each context's counts are those of all decisions, however the texts are cut; words are ranked by bytes, short and long."""
    head = [b"a", b"a\x00", b"\x00", b"sevenby", b"eightbyt", b"eightbytes", b"\xc3\xa9"]
    coder = context_mixing.Coder(head, np.arange(9, 0, -1), context_mixing.Layout(16))
    texts = pa.array([None, "a a\x00 \x00 sevenby eightbyt eightbytes x A", "", "é eightbytez sevenbx a\x00\x00 EIGHTBYT a a", "x\x00 a x"] * 7).slice(1)
    words = context_mixing.split_words(texts.slice(3))[1]
    assert coder.ranks(words.slice(2)).tolist() == [head.index(w) + 2 if w in head else 0 for w in context_mixing.raw_bytes(words)[2:]]
    doc, rank, code, _, _ = coder.tokens(texts)
    one, common = coder.contexts(rank, code)
    want = np.zeros((coder.layout.size, 2), np.uint32)
    for rows in (coder.ranked(rank, one, coder.common_hash(common)), coder.spelt([b"new", b"word"])):
        for k in range(3):
            np.add.at(want, (rows[k], rows[4]), 1)
    for size in (20, 3_000_000):
        monkeypatch.setattr(context_mixing, "CHUNK_BYTES", size)
        monkeypatch.setattr(context_mixing, "RANK_BYTES", 3 * size)
        cut = list(coder.portions(texts))
        assert sum(len(part) for part, _ in cut) == len(texts) and (len(cut) > 1) == (size == 20)
        assert np.concatenate([t[1] for _, t in cut]).tolist() == rank.tolist() and np.concatenate([t[2] for _, t in cut]).tolist() == code.tolist()
        counter = context_mixing.Counter(coder)
        counter.add(texts)
        counter.spell(pa.array(["new", "word"]))
        assert np.array_equal(counter.counts(), want)


def test_distinct_tokens_without_places():
    coder = context_mixing.Coder([b"a", b"bb"], np.array([9, 5, 4, 3]), context_mixing.Layout(16))
    rank, code = coder.tokens(["a bb a bb a x y", "", "a bb a"] * 9)[1:3]
    plain, full = coder.distinct(rank, code, places=False), coder.distinct(rank, code)
    assert plain[3] is None and all(np.array_equal(plain[k], full[k]) for k in (0, 1, 2, 4)) and plain[4].sum() == len(rank)


def test_held_out_texts_are_better_than_by_word_counts(spark):
    """The add-one baseline does not say which word a new word is; one that spells it by the frequencies of letters does."""
    rows = {r.doc_id: r for r in queries.op4_context_mixing(spark, SF).collect()}
    words = {i: context_mixing.words_of((t or "").encode()) for i, t in texts()}
    known = {w for i, own in words.items() if not rows[i].held_out for w in own}
    letters = collections.Counter(x for w in known for x in w + b"\x00")
    n = sum(letters.values())
    spelled = sum(math.log10((letters[x] + 1) / (n + 256)) for i, own in words.items() if rows[i].held_out for w in own if w not in known for x in w + b"\x00")
    held_out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out) + spelled


# 5


def test_main_text():
    page = """<title>x</title><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">yes</div><article><header><h1>T &amp; U</h1><p>by me</p></header>
    <p>One <b>bold</b>&nbsp;line<br>more<p>Two<ul><li>x<li>y</ul><aside>ad</aside><script>var t="</p>";</script><!-- <p>no</p> --><form>f</form>
    <section id="comments"><p>hi</p></section></article><footer>end</footer>"""
    assert html_extract.main_text(page) == "T & U\n\nOne bold line more\n\nTwo\n\nx\n\ny"
    assert html_extract.main_text("") == "" and html_extract.main_text("plain <b>text") == "plain text"
    assert html_extract.main_text("<div>" * 5000 + "deep") == "deep"


def test_style_tree(spark):
    body = lambda k: f"<body><div class=x>Same words on all pages</div><div class=y>Own words {k}</div></body>"
    rows = [(k, "http://h.org/a", body(k)) for k in range(12)] + [(50, None, None), (51, "http://g.org/", body(1))] + [(60 + k, "http://c.org/", body(1)) for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))).collect()}
    assert got[3] == "Own words 3" and got[50] == "" and got[51] == "Same words on all pages\n\nOwn words 1" == got[60]
    assert html_extract.extract(spark.createDataFrame([], "url string, html string")).count() == 0


def test_only_declared_branches_go():
    page = '<main><div class="related-work">one</div><section id="search-methods">two</section><article class="post comment">three</article></main>'
    assert html_extract.main_text(page) == "one\n\ntwo\n\nthree"
    assert html_extract.main_text("<main>a<!-- b") == "a" and html_extract.main_text("<p>x <b") == "x <b"


def test_deep_and_long_pages_take_linear_time():
    for page in ("<div>" * 20_000 + "x", "<a " * 40_000, "<p><button>" + "<div>" * 20_000, "<ul>" + "<li>x" * 20_000, "<span>" * 20_000 + "</b>" * 20_000):
        began = time.process_time()
        html_extract.main_text(page)
        html_extract.style_values(page)
        assert time.process_time() - began < 8


def _site(k):
    return (
        f"<body><div class=top>Our site</div><article><h1>Title {k}</h1><p>Own text {k}</p><div class=note>Join us today</div>"
        f"<p>{'Read this too' if k % 4 else 'Rare words'}</p><p>More {k * k}</p></article><div class=more>Link {k % 2}</div></body>"
    )


def test_style_tree_against_brute_force(spark):
    """Entropies and block shares over a small host, counted one by one; without the tree pages keep the notice."""
    pages = [_site(k) for k in range(16)]
    shapes, reads, blocks, n = collections.defaultdict(list), collections.defaultdict(list), collections.Counter(), len(pages)
    for page in pages:
        nodes, keys = html_extract.style_values(page)
        for path, shape, text in nodes:
            shapes[path].append(shape)
            reads[path].append(text)
        blocks.update(keys)
    entropy = lambda own: -sum(c / len(own) * math.log(c / len(own)) for c in collections.Counter(own).values()) / math.log(len(own))
    low = {p for p in shapes if 0.2 * entropy(shapes[p]) + 0.8 * entropy(reads[p]) < 0.2} | {k for k, c in blocks.items() if c > n / 2}
    df = spark.createDataFrame([(k, "http://h.org/", x) for k, x in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    rows = html_extract.low_nodes(df.withColumn("__host", F.lit("h.org"))).collect()
    assert len(rows) == 1 and set(rows[0]["__low"]) == low
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[3] == "Title 3\n\nOwn text 3\n\nMore 9" and got[4] == "Title 4\n\nOwn text 4\n\nRare words\n\nMore 16"
    assert html_extract.main_text(pages[3]) == "Title 3\n\nOwn text 3\n\nJoin us today\n\nRead this too\n\nMore 9"


# 6


def test_byte_bpe_as_tiktoken(spark, edge):
    import public_tokenizers
    import tiktoken

    raw, pattern = byte_bpe.default_vocabulary()
    ranks = byte_bpe.parse_ranks(raw)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc, rng = byte_bpe.encoder(raw, pattern), random.Random(5)
    letters = "abcdefghijklmnopqrs    éüßñ漢字😀АБ're\n\t..!--==0189"
    cases = [t or "" for _, t in texts()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(800)] + ["a" * 2000, " " * 500, "ab" * 400]
    dec = byte_bpe.Decoder(enc.merges.bytes_of)
    for t in cases:
        ids = enc.encode(t)
        assert ids == want.encode_ordinary(t) and dec.feed(ids) + dec.end() == t
    for _ in range(500):
        ids = [rng.randrange(len(ranks)) for _ in range(8)]
        assert dec.feed(ids[:3]) + dec.feed(ids[3:]) + dec.end() == want.decode_bytes(ids).decode("utf-8", "replace")
    got = {r.doc_id: r for r in byte_bpe.encode_texts(edge).collect()}
    assert got[1].n_tokens == 0 and got[None].decoded == EDGE[5][1] and byte_bpe.encode_texts(edge.limit(0)).count() == 0
    r = queries.op6_byte_bpe(spark, SF).orderBy("doc_id").first()
    first = min(texts())[1]
    assert r.ids_sha256 == hashlib.sha256(np.array(want.encode_ordinary(first), "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(first.encode()).hexdigest()


# 7


def test_quality_classifier(spark, edge, labels):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum((r.predicted == 1) == (r.quality == 1) for r in got) > 0.93 * len(got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = quality_classifier.classify(edge, quality_classifier.fit(docs, labels)).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.classify(edge, quality_classifier.fit(docs.limit(0), labels)).count() == len(EDGE)


# 8


def near_by_hand(rows):
    sets = {}
    for _, t in rows:
        w = (t or "").encode().split()
        sets[t or ""] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    names = [t for t in sets if sets[t]]
    links = {a: {b for b in names if b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in names}
    group = {a: a for a in names}
    for _ in names:
        for a in names:
            group[a] = min([group[a], *(group[b] for b in links[a])])
    least = {}
    for i, t in rows:
        if t in group:
            least[group[t]] = min(least.get(group[t], i), i)
    return {i: (least[group[t]], len(links[t])) if t in group else (i, 0) for i, t in rows}


def test_near_duplicates(spark, edge, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):  # texts with one passage in common
        own = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows.append(own[:50] + passage + own[50:])
    base = [f"b{k}" for k in range(150)]
    for k in range(25):  # one large group of near copies
        copy = list(base)
        copy[rng.randrange(150)] = f"x{k}"
        rows.append(copy)
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(500, " ".join(base)), (501, " ".join(base)), (502, "short one"), (503, "short one"), (504, ""), (505, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == near_by_hand(docs)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(df.withColumn("class_id", F.lit("clash"))).collect())
    assert kept == sorted({c for c, _ in got.values()})
    assert ngram_join.near_duplicates(edge).count() == len(EDGE) and ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_shared_passages(spark, monkeypatch):
    """Pairs just over the threshold whose shingles lie in passages of many texts, so that all their buckets are split."""
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    rng = random.Random(4)
    passages = [" ".join(f"p{k}_{j}" for j in range(30)) for k in range(80)]
    docs = []
    for k in range(100):
        own = rng.sample(passages, 12)
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:-1], f"x{k} " * 26]))]
    want = near_by_hand(docs)
    assert sum(n > 0 for _, n in want.values()) >= 190
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_against_all_pairs(spark):
    """At the parameters of the query: every pair of different texts of the table with similarity 0.8 or more."""
    sets = collections.defaultdict(set)
    for _, text in texts():
        tokens = frozenset(ngram_join.shingles((text or "").encode()).tolist())
        if tokens:
            sets[tokens].add(text)
    own, holders, weight = list(sets), collections.defaultdict(list), [len(x) for x in sets.values()]
    for k, tokens in enumerate(own):
        for x in tokens:
            holders[x].append(k)
    pairs = collections.Counter(p for ks in holders.values() if len(ks) > 1 for p in itertools.combinations(ks, 2))
    links = [w - 1 for w in weight]
    for (a, b), n in pairs.items():
        if 5 * n >= 4 * (len(own[a]) + len(own[b]) - n):
            links[a] += weight[b]
            links[b] += weight[a]
    want = {text: n for n, tokens in zip(links, own) for text in sets[tokens]}
    got = {r.doc_id: r.n_links for r in queries.op8_ngram_join(spark, SF).collect()}
    found = [got[i] for i, text in texts() if text in want], [want[text] for _, text in texts() if text in want]
    assert sum(found[0]) >= 0.99 * sum(found[1]) > 0 and all(x <= y for x, y in zip(*found))


def test_common_tokens_in_bounded_memory():
    """All intersections, without the places of all tokens of a bucket: beside the result, less than four times the tokens."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) for _ in range(60)]
    sets = [np.union1d(s, sets[k // 2][:50]) for k, s in enumerate(sets)] + [sets[0][:9]]
    tracemalloc.start()
    both = ngram_join.common_tokens(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(s.nbytes for s in sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in (0, 1, 7, 60) for j in range(61) if i != j)


def test_sets_are_made_and_sent_in_parts(spark, monkeypatch):
    """No batch that Python works on or sends back holds more texts than some TEXT_BYTES."""
    batch = pa.RecordBatch.from_pydict({"i": range(50), "t": [None, *["x" * 90] * 49]})
    parts = list(common.parts_of([batch, batch.slice(0, 0)], 1, 1000))
    assert max(p.num_rows for p in parts) <= 12 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    monkeypatch.setattr(ngram_join, "TEXT_BYTES", 300)
    df = spark.createDataFrame([(k, f"w{k} a b c d e f g") for k in range(40)] + [(99, None)], "doc_id long, text string")
    got = ngram_join.light_rows(df, "doc_id", "text").orderBy("doc_id").collect()
    monkeypatch.setattr(ngram_join, "TEXT_BYTES", None)
    assert got == ngram_join.light_rows(df, "doc_id", "text").orderBy("doc_id").collect() and len(got) == 41


def test_one_of_each_with_null_and_repeated_ids(spark):
    """One row of each class stays, whatever its id; rows without words all stay."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, d), (None, c), (None, ""), (None, None), (9, " \n"), (9, " \n")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, a), (None, b), (7, c), (7, d), (None, ""), (None, None), (9, " \n"), (9, " \n")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# 9


def test_sharding(spark, edge, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = sharding.interleave(df).collect()
    counts, hot = collections.Counter(r.shard for r in got), collections.Counter(r.shard for r in got if r.source == "hot")
    assert len(got) == 1003 and max(counts.values()) - min(counts.values()) <= 1 and max(hot.values()) - min(hot.values()) <= 2
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(r.slot for r in sharding.interleave(edge, shards=1).collect()) == list(range(len(EDGE))) and sharding.interleave(edge.limit(0)).count() == 0


# 10


def test_fm_index():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 400)
    index = decontaminate.FMIndex(text, 3)
    for size in (1, 2, 5, 9):
        patterns = np.array([text[k : k + size] for k in (0, 17, 300)] + [rng.integers(1, 4, size)])
        low, high = index.search(patterns)
        for p, lo, hi in zip(patterns, low, high):
            want = [k for k in range(400 - size + 1) if (text[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi))) == want


def test_decontaminate(spark, edge):
    item = " ".join(f"Q{k}" for k in range(14))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (None, "!!"), (4, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before it, {item.lower()}; after it"), (2, "a TINY-item b"), (3, "clean"), (4, None), (5, item[:20])], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for block in (1 << 20, 20):
        got = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, block_bytes=block).collect()}
        assert [tuple(s) for s in got[1].hit_spans] == [(2, 16)] and got[1].hit_items == ["1", "4"] and got[2].hit_items == ["2"] and not got[5].hit_items
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert cut[1] == "before it, ; after it" and cut[2] == "a  b" and cut[3] == "clean" and cut[4] is None
    assert decontaminate.find_hits(edge, bench).count() == len(EDGE) and decontaminate.find_hits(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0


# Pipeline


def test_cuts_that_join_words_are_cut_again(spark, monkeypatch):
    inner, outer = [f"i{k}" for k in range(10)], [f"o{k}" for k in range(10)]
    bench = spark.createDataFrame([("a", " ".join(inner)), ("b", " ".join(outer))], "item_id string, text string")
    text = " ".join(["x", *outer[:5], *inner, *outer[5:], "y"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "clean text")], "doc_id long, text string")
    want = {1: "x  y", 2: None, 3: "", 4: "clean text"}
    strip = lambda t: t and " ".join(t.split())
    for block in (decontaminate.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block,))
        monkeypatch.setattr(decontaminate.find_hits, "__defaults__", ("text", block, decontaminate.WINDOW))
        got = {r.doc_id: strip(r.text) for r in decontaminate.decontaminate(docs, bench).collect()}
        assert got == {k: strip(v) for k, v in want.items()}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and docs.where("n_tokens > 0").count() == sizes[-1]
    kept = spark.read.parquet(str(tmp_path / "decontaminate"))
    assert decontaminate.find_hits(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(hit_items) > 0").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
