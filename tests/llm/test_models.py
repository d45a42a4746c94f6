"""Classifiers by held-out accuracy, search by recall, sharding by its law, extraction by hand-made pages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselake.llm import common, html, langid, neighbours, sharding, toxicity

DATA = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identify(docs, langid.training_sample(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "the and of " * 9000)], "doc_id long, text string")
    samples = {"en": ["the", "and", "of"], "de": ["und", "der"]}
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, samples).collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "en")]
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert [r["doc_id"] for r in langid.identified(odd, samples).collect()] == [4]


def test_automaton_counts_phrases(monkeypatch):
    a = langid.SuffixAutomaton(["^banana$", "^ban$"])
    subs = {w[i:j] for w in ("^banana$", "^ban$") for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def brute(word):
        n = 0
        while word:
            k = max((len(s) for s in subs if word.startswith(s)), default=1)
            word, n = word[k:], n + 1
        return n

    words = ["^ban$", "^nanaban$", "xx", "^xban", "", "anab", "$^", "語na𝒳"]
    for widest in (2, 120):
        monkeypatch.setattr(langid, "WIDEST", widest)
        assert langid.Parser(a).phrases(words).tolist() == [a.phrases(w) for w in words] == [brute(w) for w in words]


def test_language_equals_brute_force(spark):
    """Whole predictions against phrases found by looking at every substring."""
    samples = {"a": ["banana", "bandana", "cab"], "b": ["dodo", "ode", "bode", "code"], "c": ["cab", "ode"]}
    bits = {x: np.log2(2 + sum(len(w) + 2 for w in words)) for x, words in samples.items()}

    def needs(lang, word):
        n, word = 0, f"^{word}$"
        while word:
            word = word[max((k for k in range(1, len(word) + 1) if any(word[:k] in f"^{w}$" for w in samples[lang])), default=1) :]
            n += 1
        return n * bits[lang]

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdenox"), rng.integers(1, 9))) for _ in range(rng.integers(1, 7))) for _ in range(80)] + ["banana", "a.ode-Cab!", "same same", "7 8", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, samples).collect()}
    for k, text in enumerate(texts):
        words = langid._LETTERS.findall((text or "").lower())
        assert got[k] == (min(sorted(samples), key=lambda x: round(sum(needs(x, w) for w in words), 6)) if words else "und")
    assert langid.identify(docs.limit(0), samples).count() == langid.identified(docs.limit(0), samples).count() == 0
    # a language with little labelled text isn't left behind, nor ahead
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "dodo code ode bode")], "doc_id long, text string"), {"b": samples["b"], "z": ["x"]}).collect()} == {"b"}
    # ties go to the name that sorts first
    assert [r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "ab")] * 2, "doc_id long, text string"), {"n": ["ab"], "m": ["ab"]}).collect()] == ["m", "m"]


def test_toxicity(spark):
    insults = ["idiot", "moron", "worthless"]
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text, toxic = list(rng.choice(words, 80)), i % 3 == 0
        if toxic:
            for k in rng.choice(80, 4, replace=False):
                text[k] = str(rng.choice(insults))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(words[:40] + ["idiott", "moronn", "idiots"] + words[40:80]))]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(docs, known)
    assert not any(t == rows[i][1] for t in texts for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train(texts, y)).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) > 0.95 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1002]["score"] > got[1001]["score"]
    assert toxicity.train([], []) is None and toxicity.train(["a"], [1]) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def labelled(n_toxic, n_clean, rare):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    texts = [" ".join([*rng.choice(words, 30), *(["wretch"] if k < rare else ["idiot"] if k < n_toxic else [])]) for k in range(n_toxic + n_clean)]
    return texts, [int(k < n_toxic) for k in range(n_toxic + n_clean)], words


def test_rare_marks_and_few_labels_count():
    texts, y, words = labelled(300, 300, 12)  # one toxic text in 25 has the rare mark alone
    model = toxicity.train(texts, y)
    logit = lambda some: model.figures(some)[:, 0] / model.figures(some)[:, 1]
    assert logit(["idiot"]) > logit(["wretch"]) > logit(words).max()
    texts, y, words = labelled(8, 35, 0)
    scorer = toxicity.Scorer(toxicity.train(texts, y))
    clean = " ".join(words[:30])
    assert np.diff(scorer.scores([clean, clean + " idiot"])) > 0


def test_toxicity_equals_brute_force(spark):
    """Scores against the definition: n-grams one by one, every window, a softmax over two logits."""
    rng = np.random.default_rng(2)
    texts, y, _ = labelled(40, 60, 4)
    model = toxicity.train(texts, y)
    base = 0x9DDFEA08EB382D69

    def mix(x):
        return int(common.mix64(np.array([x % 2**64], np.uint64))[0])

    def bag(token):
        out = []
        for word in toxicity._WORD.findall(token.lower()):
            codes = [ord(c) for c in f"<{word}>"]
            out.append(mix(sum(mix(c * base + k) for k, c in enumerate(codes))))
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for i in range(len(codes) - n + 1):
                    h = 0
                    for c in codes[i : i + n]:
                        h = (h * base + c) % 2**64
                    out.append(mix(h + n * int(common.GOLDEN)))
        return [h % toxicity.BUCKETS for h in out]

    def score(text):
        bags = [b for b in map(bag, (text or "").split()) if b]
        windows = [sum(bags[i : i + toxicity.WINDOW], []) for i in range(max(1, len(bags) - toxicity.WINDOW + 1))] if bags else []
        return max((1 / (1 + np.exp(-(np.mean(model.logit[w].astype(float)) + model.bias))) for w in windows), default=0.0)

    docs = [*texts[::9], None, "", "12 !!", "Idiot-moron x", " ".join(rng.permutation(" ".join(texts[:6]).split())), "a b " * 300 + "idiot"]
    docs += docs[:2]  # repeated rows
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    assert [got[k] for k in range(len(docs))] == pytest.approx([score(t) for t in docs], abs=1e-5)
    assert toxicity.score_toxicity(table.limit(0), model).count() == 0


def exact(ids, x, q, k):
    s = x @ x[q]
    return sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[7]  # copies: ties go to the smaller id
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0] * 3), (5005, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=10, block_rows=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.arange(3000)
    assert sorted(got) == list(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [-f[2] for f in found] == sorted(-f[2] for f in found)
        hits += len({f[1] for f in found} & {j for _, j in exact(ids, x.astype(float), q, 10)})
    assert hits >= 0.95 * 10 * len(got)
    assert [f[1] for f in got[100]][0] == 7
    few = neighbours.nearest(df.where("vec_id < 4"), df.where("vec_id < 2"), k=10).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {3}
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == neighbours.nearest(df, df.limit(0)).count() == 0


def test_the_stopping_test_stops():
    """On vectors in clusters most leaves are never visited, and few neighbours are missed."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 8192)] + 0.35 * rng.normal(size=(8192, 64))
    ids = np.arange(len(x))
    block = neighbours.Block(ids, x, float((x**2).sum(axis=1).max()), neighbours.projection_for(64))
    found: dict = {}
    for q, i, _ in block.answers(ids[::80], x[::80], 20):
        found.setdefault(q, set()).add(i)
    recall = np.mean([len(found[q] & {j for _, j in exact(ids, x, q, 20)}) / 20 for q in found])
    assert recall >= 0.95 and block.visited < 0.45 * block.could


def test_queries_are_routed(spark):
    """Cells that are too far get no query; copies that fill a cell are dealt to several blocks; ids may repeat."""
    rng = np.random.default_rng(4)
    x = 4 * rng.normal(size=(12, 16))[rng.integers(0, 12, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    x[::3] = x[5]
    rows = [(i % 1990, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1))
    got: dict = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 in (0, 1)"), k=5, block_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    hits = 0
    for q, found in got.items():
        mine = min((v for i, v in rows if i == q))
        best: dict = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, mine)))
        want = sorted((-round(s, 9), i) for i, s in best.items())[:5]
        assert found == sorted(found) and len({i for _, i in found}) == len(found) == 5
        hits += len({i for _, i in want} & {i for _, i in found})
    assert len(got) == 40 and hits >= 0.9 * 5 * 40


def test_chi_square():
    assert common.chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3) and common.chi2_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def test_sharding(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(3000)] + [(1, None), (1, ""), (None, "é"), (7, "x" * 259), (7, "x" * 259)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(docs, store=None).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load, places = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(load) == list(range(16)) and max(load.values()) - min(load.values()) <= 901
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_rebalancing_moves_little(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(3000)], "doc_id long, text string")
    by_slot = sharding.slot_bytes(sharding.with_slot(sharding.with_size(docs), 8, 512)).cache()
    store = str(tmp_path / "map")
    old = sharding.current_map(by_slot, 8, store).cache()
    assert {r["version"] for r in sharding.current_map(by_slot, 8, store).collect()} == {1}  # even, so it stays
    new = sharding.current_map(by_slot, 9, store).cache()
    assert {r["version"] for r in new.collect()} == {2} and sharding.last_version(spark, store) == 2
    moved = new.join(old.select("vslot", F.col("shard").alias("was")), "vslot").join(by_slot, "vslot").where("shard <> was").agg(F.sum("bytes")).first()[0]
    loads = [r[0] for r in new.join(by_slot, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(loads) == 9 and max(loads) < 1.1 * min(loads) and moved < 1.3 * sum(loads) / 9


def test_equal_texts_share_a_shard_unless_too_heavy(spark):
    rows = [(i, f"text {i % 400} " + "y" * (i % 400)) for i in range(2000)] + [(10_000 + i, "hot " * 60) for i in range(1500)] + [(7, "again " * 40)] * 600
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, shards, load = dict(rows), {}, {}
    for r in got:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert all(len(shards[zlib.crc32(text[i].encode())]) == 1 for i in range(400) if i != 7)
    assert len(shards[zlib.crc32(text[10_000].encode())]) == 16 and len(shards[zlib.crc32(text[7].encode())]) > 4
    assert max(load.values()) < 1.05 * min(load.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bold</b>  word<br>and more<p>Two &lt;b&gt;</p>
<script>var t="</p>";</script><div class="ad">Buy</div><ul><li>x</li><li>y</ul><form>Ask</form></article><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    plain = "<html><body><div id=top>Welcome to our site</div><div><p>Page {0} speaks of {0}.</p></div></body></html>"
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE.replace("One", "Uno")), (3, None, None), (4, "http://b.org", ""), (5, "http://c.org/1", "<p>alone <i>text"), (6, "bad url", "<article>cut <b"), (7, "http://e.org", "no tags at all")]
    rows += [(10 + k, f"http://d.org/{k}", plain.format(k)) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    assert got[1]["text"] == "Head & tail\n\nOne bold word and more\n\nTwo <b>\n\nx\n\ny" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"].split("\n\n")[1] == "Uno bold word and more"
    assert [got[k]["text"] for k in (3, 4, 5, 6, 7)] == ["", "", "alone text", "cut", "no tags at all"]
    assert [got[10 + k]["text"] for k in range(5)] == [f"Page {k} speaks of {k}." for k in range(5)]
    assert html.main_text(pages.limit(0)).count() == 0


def texts_of(spark, pages):
    found = html.main_text(spark.createDataFrame([(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(pages)], "page_id long, url string, html string"))
    return [r["text"] for r in found.orderBy("page_id").collect()]


def test_classes_of_tags_and_text_make_the_template(spark):
    note = "<div class=kiosk><p>On paper from Monday.</p></div>"
    page = "<html><body><article><p>Our house rules.</p><p>Story {0}.</p><p>{1}</p>{2}</article></body></html>"
    # a tag of its own goes with the note, none with the saying: as often, and both inside the article
    pages = [("h.org", page.format(k, "A saying." if k < 4 else f"End {k}.", note if k in (0, 1, 2, 5) else "")) for k in range(6)]
    assert texts_of(spark, pages) == [f"Story {k}.\n\n" + ("A saying." if k < 4 else f"End {k}.") for k in range(6)]


def test_copies_and_pairs_of_pages_are_no_template(spark):
    pair = [("two.org", f"<html><body><div><p>Page {k}.</p></div></body></html>") for k in range(2)]
    copies = [("copies.org", f"<html><body><!-- {k} --><div><p>The whole story.</p></div></body></html>") for k in range(6)]
    copies += [("copies.org", f"<html><body><div><p>Other {k}.</p></div></body></html>") for k in range(2)]
    assert texts_of(spark, pair + copies) == ["Page 0.", "Page 1."] + ["The whole story."] * 6 + ["Other 0.", "Other 1."]


def test_deep_pages():
    deep = "<div>" * 300 + "<nav>Menu</nav>" + "</div>" * 300
    assert html.extract(f"<body>{deep}<p>Text.</p></body>", frozenset()) == "Text."
    assert html.extract(f"<body><div><article><p>One.</p>{deep}<p>Two.</p></article></div></body>", frozenset()) == "One.\n\nTwo."
    assert html.extract("<b>x" * 50_000 + "</i>" * 50_000, frozenset()) == "x" * 50_000


def test_the_template_finds_the_article(spark):
    """Nothing on these pages says which part is the article but what the host's pages have in common."""
    page = "<html><body><div class=a><a href=1>m{0}</a> <a href=2>n{0}</a></div><div class=b><div class=x><p>{1}</p><p>Always the same.</p><p>{2}</p></div><div class=y>Short {0}.</div></div><div class=c>Made on day {0}.</div></body></html>"
    pages = [("t.org", page.format(k, f"Long text number {k} with many words in it.", f"And more of them, {k * 7}.")) for k in range(5)]
    want = [f"Long text number {k} with many words in it.\n\nAnd more of them, {k * 7}." for k in range(5)]
    assert texts_of(spark, pages) == want
    assert html.extract(pages[1][1], frozenset()) != want[1]  # without the template the rest is there as well


def test_template_equals_brute_force():
    """Slots and constant texts of a small host against occurrence vectors that are written out."""
    page = "<body><div class=n><a href=x>{0}</a></div><div class=m><h1>H{0}</h1>{1}<p>Words of page {0} in a row.</p></div><p>fixed</p></body>"
    docs = [page.format(k, "<ul><li>one</li></ul>" if k % 2 else "") for k in range(6)]
    reads = [html.read(d)[1] for d in docs]
    vector = {t: tuple(r.get(t, [0, 0])[1] for r in reads) for r in reads for t in r}
    parent = {t: x[0] for r in reads for t, x in r.items()}
    chars = {t: sum(r[t][2] for r in reads if t in r) for t in parent}
    often = {t: {"token": t, "parent": parent[t], "pages": sum(n > 0 for n in v), "once": sum(n == 1 for n in v), "chars": chars[t], "vector": str(v)} for t, v in vector.items()}
    often = {t: x for t, x in often.items() if x["pages"] >= 3 and (t % 2 == 0 or x["once"] == x["pages"])}

    def around(t):
        while t != html.ROOT:
            t = parent[t]
            yield t

    fixed = sorted(t for t in often if t & html.TEXT and any(vector[a] == vector[t] for a in around(t)))
    slot, *rest = html.template_of(often)
    assert rest == fixed and len(fixed) == 2
    path = lambda *roles: __import__("functools").reduce(lambda p, r: html._below(p, r, r.split(".")[0]), roles, html.ROOT)
    assert slot == path("body", "div.m")  # not the body, and not the one paragraph that would leave the heading behind
    assert html.extract(docs[1], frozenset([slot, *rest])) == "H1\n\nWords of page 1 in a row."


def test_names_only_break_ties():
    say = lambda page: html.extract(page, frozenset())
    assert say('<div class="site has-sidebar"><article><p>One.</p></article></div>') == "One."
    assert say('<div class="no-sidebar"><p>Two.</p></div>') == say('<div class="sidebar-page"><p>Two.</p></div>') == "Two."
    assert say('<article><p class="related">Four.</p><p title=it\'s>Five.</p></article><p>Rest') == "Four.\n\nFive."
    assert say("<article><p>Text.</p><section id=comments><p>A comment that is longer.</p></section></article>") == "Text."
    assert say("<p a=b'c>d</p><a href=\"x>y\">e</a>") == "d\n\ne"
    assert say("<body><nav>Menu</nav>" + "<p>word</p>" * 30_000) == "\n\n".join(["word"] * 30_000)
