"""Each operator on small fixtures against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import os
import re

import numpy as np
import pytest

from compare import assert_same
from sgspark.llm import classifiers, decontaminate, embeddings, html_extract, lines, mixing, near_documents, queries, substrings, tokens
from sgspark.llm.runtime import components, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, uid string, removed int, _key string"


def frame(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    return written(spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 0.5, "u", 3, "k") for r in rows], schema), "fixture")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(60, 120))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w)))
    passage = " ".join(rng.choice(vocabulary, 50))
    rows += [(200 + i, f"start{i} {passage} end{i}") for i in range(5)]
    rows += [(300, base[0]), (301, base[0]), (301, base[0]), (None, base[1]), (302, None), (303, ""), (304, " \n "), (305, "one"), (306, "one"), (307, "x" * 200_000), (308, "a b c d")]
    rows += [(309, "rep " * 3000)]
    return rows


SQL_OPERATORS = ["op2_ngram_join", "op4_mixing", "op6_embeddings", "op7_substrings", "op9_decontaminate", "op10_lines"]


@pytest.mark.parametrize("name", SQL_OPERATORS)
def test_against_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_documents.classes(none).count() == 0
    assert near_documents.deduplicated(none).count() == 0
    assert lines.report(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert mixing.materialised(none).count() == 0
    assert tokens.materialised(none).count() == 0
    assert substrings.deduplicated(none).count() == 0
    assert decontaminate.matched(none, bench).count() == 0
    assert embeddings.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3000, 2500), rng.integers(0, 3000, 2500)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(None, 1), (5, 5)], "a long, b long")
    parent = list(range(3000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b):
        p, q = sorted((root(x), root(y)))
        parent[q] = p
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: root(i) for i in range(3000) if root(i) != i}


def test_components_in_rounds(spark, monkeypatch):
    from sgspark.llm import runtime

    monkeypatch.setattr(runtime, "LOCAL_EDGES", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 3)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def near_truth(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words(t) for _, t in rows)]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j] or rows[i][1] == rows[j][1] or {rows[i][1], rows[j][1]} == {None, ""}:
                    label[i] = label[j] = min(label[i], label[j])
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[label[i]].append(r[0])
    return [(r[0], min(ids[label[i]], default=None), sum(link[i])) for i, r in enumerate(rows)]


def test_near_documents(spark, corpus):
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near_documents.classes(frame(spark, corpus)).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(near_truth(corpus), key=key)


def test_near_documents_kept(spark, corpus):
    out = near_documents.deduplicated(frame(spark, corpus))
    assert out.columns == frame(spark, corpus).columns
    assert out.select("_key", "uid", "score", "removed").distinct().collect() == [("k", "u", 0.5, 3)]
    kept = sorted(r["doc_id"] for r in out.collect())
    classes = {c for (d, c, _), (_, t) in zip(near_truth(corpus), corpus) if words(t)}
    assert kept == sorted([*classes, 302, 303, 304])


def test_many_near_copies_in_tiles(spark, monkeypatch):
    from sgspark.llm import setjoin

    monkeypatch.setattr(setjoin, "BLOCK_TEXTS", 16)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        w[i] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, rows[i][1]) for i in range(5)]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near_documents.classes(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(near_truth(rows))


def test_substrings(spark, corpus):
    starts = collections.Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in corpus) for i in range(len(w) - 34))
    got = substrings.deduplicated(frame(spark, corpus)).collect()
    seen = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)
    want = collections.Counter()
    for d, t in corpus:
        w, gone = words(t), set()
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert seen == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_decontamination(spark, corpus):
    body = words(corpus[3][1])
    items = [(1, " ".join(body[5:30])), (2, "nothing of this occurs here at all in any text you see"), (3, "One"), (4, ""), (5, None), (None, " ".join(body[40:55])), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matched(frame(spark, corpus), bench)
    got = {r["doc_id"]: r for r in decontaminate.report(found).collect()}
    assert (got[3]["n_hit"], got[3]["n_items"]) == (40, 1)
    assert got[3]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[305]["items_sha256"] == hashlib.sha256(b"1,3").hexdigest()
    assert got[303]["n_words"] == 0 and not got[303]["contaminated"] and not got[9]["contaminated"]
    longest = [m for m in found.where("doc_id = 3").first()["matches"] if m["item"] == "1"]
    assert [(m["start"], m["length"], m["item_start"]) for m in longest] == [(5, 25, 0)]
    kept = {r["doc_id"] for r in decontaminate.decontaminated(frame(spark, corpus), bench).collect()}
    assert kept == {d for d, _ in corpus} - {3, 103, 305, 306}


def test_decontamination_in_blocks(spark, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(words(corpus[i][1])[3:18])) for i in range(8)], "item_id long, text string")
    whole = decontaminate.report(decontaminate.matched(frame(spark, corpus), bench)).toPandas()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    assert decontaminate.blocks_of(bench, 10).count > 2
    assert_same(whole, decontaminate.report(decontaminate.matched(frame(spark, corpus), bench)).toPandas())


def test_mixing_targets(spark, corpus):
    rows = [(d, t, s) for (d, t), s in zip(corpus, ["a", "b", None, "", "c", "a", "a"] * 20)]
    out = mixing.mixture(frame(spark, rows)).toPandas()
    assert len(out) == len(rows)
    total = out["size"].sum()
    by = out.groupby(out["source"].fillna("￿")).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert np.isclose(by["target"].sum(), 1.5 * total) and (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert ((by["target"] - by["taken"]).between(0, 1)).all() and (out["taken"] <= 2 * out["size"]).all()
    again = mixing.mixture(frame(spark, rows).repartition(3)).toPandas()
    assert_same(out, again)


def test_mixed_rows(spark, corpus):
    docs = frame(spark, [(d, t, "ab"[i % 2]) for i, (d, t) in enumerate(corpus)])
    out = mixing.materialised(docs)
    assert out.columns == docs.columns and out.select("_key", "score").distinct().collect() == [("k", 0.5)]
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mixture(docs).collect()}
    copies = collections.Counter((r["doc_id"], len(words(r["text"]))) for r in out.collect())
    for (d, size), n in copies.items():
        assert d in (300, 301) or abs(n * size - taken[d, size]) <= size / 2


def test_mixing_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(600)]
    every = mixing.mixture(frame(spark, rows)).toPandas()
    assert every["first_at"].dropna().is_monotonic_increasing and every["first_at"].notna().equals(every["taken"] > 0)
    assert every["second_at"].notna().equals((every["taken"] > every["size"]))
    out = every[every["taken"] > 0]
    early = out.groupby("source")["first_at"].median()
    assert early["a"] < early["c"] and out["first_at"].between(0, 1).all()
    twice = out.dropna(subset=["second_at"])
    assert len(twice) and (twice["second_at"] >= twice["first_at"]).all()


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while the band plays on and on in the old town"
    rows = [(1, f"{base}\nunique one here\n\n{base}"), (2, base + "!"), (3, None), (4, ""), (5, "unique one here"), (5, "\n\n \n"), (None, "short"), (6, "short")]
    got = lines.report(frame(spark, rows)).collect()
    out = collections.Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got)
    assert out == collections.Counter([(1, 4, (3,)), (2, 1, (0,)), (3, 0, ()), (4, 1, ()), (5, 1, (0,)), (5, 4, ()), (None, 1, ()), (6, 1, (0,))])
    out = lines.deduplicated(frame(spark, rows))
    assert out.select("_key", "removed").distinct().collect() == [("k", 3)]
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[1] == f"{base}\nunique one here\n" and kept[2] == "" and kept[3] is None


def test_lines_at_the_threshold(spark):
    # 64 of 80 shingles shared; the pairs meet in the last two bands only
    pairs = [
        ("uswpvowmwnyon j vhljqnrfkngm rtjyicqjggh qllx kmlswcrcdpdssi uwrriwdu", "ocguvgphwy", "ockhkrjuog"),
        ("ghtgtsfelgodlepsbzttogrwmjsd udmaztdefhcjatyewjohwzo kebjggrpgorikszpzk", "wmzfdsjs", "m etfkry"),
        ("kehjwlkwklmrlfdyendbfursobwdmr pdhyaveedjfnkqgzrylxgadfnvmfjey mccwawqb", "ssimwepq", "vntgjojl"),
    ]
    got = lines.report(frame(spark, [(2 * i + j, p[0] + p[1 + j]) for i, p in enumerate(pairs) for j in range(2)])).collect()
    removed = collections.Counter()  # one of each pair; which one comes first is up to the fixture's files
    for r in got:
        removed[r["doc_id"] // 2] += r["n_removed"]
    assert removed == {0: 1, 1: 1, 2: 1}


def test_tokens_round_trip(spark, corpus, tmp_path):
    docs = frame(spark, corpus)
    encoding, end = tokens.encoder(tokens.vocabulary())
    tokens.write_shards(docs, str(tmp_path / "shards"), length=64, per_shard=10)
    back = tokens.read_from(spark, str(tmp_path / "shards"), 0, 10).toPandas()
    n = len(back)
    assert list(back["slot"]) == list(range(n)) and {len(t) for t in back["tokens"]} == {128}
    assert sorted(back["sequence"]) == list(range(n))
    assert (tokens.feistel(back["sequence"].to_numpy(), n) == back["slot"]).all()
    stream = [int(x) for t in back.sort_values("sequence")["tokens"] for x in np.frombuffer(t, np.uint16)]
    while stream and stream[-1] == end:
        stream.pop()
    texts, part = [], []
    for x in [*stream, end]:
        if x == end:
            texts.append(encoding.decode(part))
            part = []
        else:
            part.append(x)
    assert sorted(texts) == sorted(t for _, t in corpus if t)
    later = tokens.read_from(spark, str(tmp_path / "shards"), 15, 10, until=23).toPandas()
    assert list(later["slot"]) == list(range(15, min(23, n)))


@pytest.mark.parametrize("part,pack", [(16384, 1 << 24), (3, 5000)])
def test_shards_are_raw_files_of_a_fixed_stride(spark, corpus, tmp_path, monkeypatch, part, pack):
    monkeypatch.setattr(tokens, "PART", part)
    monkeypatch.setattr(tokens, "PACK_BYTES", pack)
    docs = frame(spark, corpus)
    tokens.write_shards(docs, str(tmp_path / "out"), length=64, per_shard=10)
    want = tokens.stored(docs, length=64, per_shard=10).toPandas().sort_values("slot")
    files = sorted((tmp_path / "out" / "shards").iterdir())
    assert [f.name for f in files] == [f"{i:06d}.bin" for i in range(-(-len(want) // 10))]
    assert {f.stat().st_size for f in files[:-1]} == {10 * 128}
    assert b"".join(f.read_bytes() for f in files) == b"".join(want["tokens"])
    whole = tokens.materialised(docs, length=64, per_shard=10).toPandas().sort_values("slot")
    assert list(whole["tokens"]) == list(want["tokens"]) and list(whole["row"]) == [i % 10 for i in range(len(want))]
    encoding, end = tokens.encoder(tokens.vocabulary())
    texts = {(r[0], t) for r in corpus if r[1] for t in [r[1]]}
    for r in whole.itertuples():  # a document that starts in a sequence starts with its text's first token
        body = np.frombuffer(r.tokens, np.uint16)
        for d, at in zip(r.doc_ids, r.starts):
            if at and body[at - 1] == end:
                assert any(i is None and np.isnan(d) if d != d else i == d and encoding.encode_ordinary(t)[0] == body[at] for i, t in texts)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(tokens.feistel(np.arange(n), n)) == list(range(n))
    if n > 100:
        assert (tokens.feistel(np.arange(n), n) != tokens.feistel(np.arange(n), n, key=1)).any()


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 16))
    v[100:160] = v[100] + rng.normal(size=(60, 16)) * 0.05
    v[200:210] = v[200]
    v[300] = 3 * v[200]
    v = v.astype(np.float32)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, rows[5][1])]
    monkeypatch.setattr(embeddings, "SHARD_BYTES", 300 * 16 * 8)
    monkeypatch.setattr(embeddings, "TILE", 25)
    got = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    x = v.astype(float)
    cosine = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    link = cosine >= 0.9
    np.fill_diagonal(link, False)
    count = link.sum(1)
    count[5] += 1
    out = got.dropna(subset=["vec_id"]).set_index("vec_id").sort_index()
    assert (out["n_links"].to_numpy()[:900] == count).mean() > 0.99
    assert out.loc[1000:1004, "n_links"].sum() == 0 and (out.loc[1000:1004, "component_id"] == out.loc[1000:1004].index).all()
    assert list(out.loc[[1005, 1006], "n_links"]) == [1, 1]
    assert (out.loc[100:159, "component_id"] == 100).all() and out.loc[300, "component_id"] == 200


def test_embeddings_of_any_size(spark, monkeypatch):
    """Squares of these under- and overflow; beams are so narrow that every shard is scanned, and tiles are tiny."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 8))
    rows = [(10 * i + k, [float(x) for x in v * scale]) for i, v in enumerate(base) for k, scale in enumerate((1.0, 1e-200, 1e200, 5e-310))]
    monkeypatch.setattr(embeddings, "SHARD_NODES", 16)
    monkeypatch.setattr(embeddings, "TILE", 2)
    got = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    assert {r["vec_id"]: r["n_links"] for r in got} == {10 * i + k: 4 * int(link[i].sum()) - 1 for i in range(20) for k in range(4)}
    assert all(r["component_id"] <= 10 * (r["vec_id"] // 10) for r in got)


def test_graph_recall():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in rng.uniform(0.05, 0.3, 60)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embeddings.Graph(x)
    rows, nodes, _ = embeddings.hits(graph, x[:500], 0.9, 0.99, 0)
    found = np.zeros((500, len(x)), dtype=bool)
    found[rows, graph.order[nodes]] = True
    truth = x[:500] @ x.T >= 0.9
    assert (found & truth).sum() >= 0.95 * truth.sum()


def test_audit_of_rare_links(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embeddings.Graph(x)
    queries = rng.normal(size=(512, 32))
    lone = np.random.default_rng(0).permutation(512)[-3:]  # not among the first that are audited
    queries[lone] = x[:3]
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    search = graph.search

    def lossy(q, beam):
        ids, sims = search(q, beam)
        return np.where(sims >= 0.9, -1, ids), np.where(sims >= 0.9, -np.inf, sims)

    monkeypatch.setattr(graph, "search", lossy)
    rows, nodes, _ = embeddings.hits(graph, queries, 0.9, 0.99, 0)
    assert sorted(zip(rows.tolist(), graph.order[nodes].tolist())) == sorted((int(q), i) for i, q in enumerate(lone))


PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head</h1><p><b>One &amp; two<br>three<p>Four</article><footer>&copy; x</footer></body></html>", "Head\nOne & two three\nFour"),
    (None, ""),
    ("", ""),
    ("plain text without any markup", "plain text without any markup"),
    ("<body><div id='content'><h2>A</h2><p>Some &lt;b&gt; text<div class='ad'>Buy</div><p>More<div class='comments'><p>First!</div></div><aside>side</aside></body>", "A\nSome <b> text\nMore"),
    ("<p>a b\n  c</p><!-- <p>no</p> --><form>Name <input></form>", "a b c"),
]


def test_html(spark):
    rows = [(i, "u", h, "old", 1.5) for i, (h, _) in enumerate(PAGES)]
    out = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, lines double"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert set(out.columns) == {"page_id", "url", "html", "text", "lines", "n_chars"}


def test_html_without_containers():
    long_one, long_two = "abc " * 50, "def " * 50
    page = f"<div><ul><li><a>menu</a></li><li><a>items</a></li></ul></div><h2>Title</h2><p>{long_one}</p><p>{long_two}</p><div class='footer'>foot</div>"
    assert html_extract.main_text(page) == f"Title\n{long_one.strip()}\n{long_two.strip()}"


KEPT = [
    ('<div class="social-science"><article><p>Body text.</p></article></div>', "Body text."),
    ('<div class="social"><article><h1>T</h1><p>Body text.</p></article></div>', "T\nBody text."),
    ('<div class="header-image content"><p>Body text.</p></div>', "Body text."),
    ('<article><p>One.</p><section class="tags-explained"><p>Two.</p></section></article>', "One.\nTwo."),
    ('<article><p>An <span class="alert">important</span> word.</p></article>', "An important word."),
    ('<article><p>One.</p><p><a href="x">only a link</a></p><p>Two.</p></article>', "One.\nonly a link\nTwo."),
    ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", "Let x be."),
    (f"<h2>T</h2><p>{'long text ' * 20}</p><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul><p>The closing words.</p>", f"T\n{('long text ' * 20).strip()}\nThe closing words."),
    ('<form id="aspnetForm"><div><h1>T</h1><p>The whole page stands in a form.</p></div></form>', "T\nThe whole page stands in a form."),
    ('<article><p>One.</p><form><p>a</p><p>b</p><p>c</p></form><p>2.</p></article>', "One.\n2."),
    ('<article>Short.</article><section class="comments"><article class="comment"><p>' + "first! " * 60 + "</p></article></section>", "Short."),
    ('<div class="site-footer"><p>Imprint and more of it</p></div>' + "<p>text of the page</p>" * 5, "\n".join(["text of the page"] * 5)),
    ("<article>a</article><div>An unmarked line beside the article</div>", "a"),
]


@pytest.mark.parametrize("page,text", KEPT)
def test_html_evidence_is_no_veto(page, text):
    assert html_extract.main_text(page) == text


def test_surges_and_dives_against_brute_force():
    """A line stays if it weighs something and some window that surges is joined to it by windows that don't dive."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        weight = rng.choice([0, 0, 0, 5, 30, 90], n).astype(float)
        sums = [weight[i : i + html_extract.WINDOW].sum() for i in range(n)]
        keep = set()
        for i in range(n):
            if weight[i] >= 1 and any(sums[j] >= html_extract.SURGE and all(sums[k] >= 1 for k in range(min(i, j), max(i, j) + 1)) for j in range(n)):
                keep.add(i)
        got = {i for a, b in html_extract.stretches(weight.tolist(), [False] * n) for i in range(a, b) if weight[i] >= 1}
        if max(sums) >= html_extract.SURGE:
            assert got == keep
        else:
            assert bool(got) == bool(weight.any())


def test_the_step_decides_where_nothing_is_marked(sf_dir):
    """Pages without any tag, role or class of evidence: menus of links dive, articles stay whole."""
    import pandas as pd

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")["html"].dropna()
    decided = 0
    for page in pages:
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|main)\b[^>]*>", r"<\1div>", page))
        text = html_extract.main_text(bare)
        menu = set(re.findall(r"<li><a[^>]*>([^<]*)</a></li>", bare))
        assert html_extract.main_text(page) in text and not menu & set(text.split("\n"))
        decided += text != "\n".join(x.text for x in html_extract.parsed(bare).lines)
    assert decided == len(pages)


@pytest.mark.parametrize("name,column,least", [("op1_toxicity", "toxic", 0.85), ("op8_quality", "quality", 0.9)])
def test_classifiers_on_held_out_rows(name, column, least, spark):
    sf_dir = os.environ.get("TEST_HELD_OUT_DIR", "/root/testdata/sf0.1")
    scored = queries.QUERIES[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", column, "score").toPandas()
    assert (rows["predicted"] == rows[column]).mean() >= least
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("docs,labels", [([], [(1, 1, 1)]), ([(1, "a b")], []), ([], [])])
def test_classifiers_on_empty_tables(spark, tmp_path, docs, labels):
    frame(spark, docs or [(0, "x")]).limit(len(docs)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op1_toxicity", "op8_quality"):
        out = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(out) == len(docs) and all(r["predicted"] == 0 for r in out)


def test_a_fit_holds_a_bounded_number_of_features(spark, monkeypatch):
    """Of long texts fewer are sampled; the model is that of the first ones in the sample's order."""
    rows = [(i, ("vile " if i % 2 else "kind ") * 50) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    take = lambda i: i.isNotNull()
    monkeypatch.setattr(classifiers, "MAX_FEATURES", 20 * 150)
    few = classifiers.fit(frame(spark, rows), labels, "toxic", "noisy-or", take, 12, 40)
    first = [r["_id"] for r in classifiers.train_rows(labels, "toxic", take, 20).collect()]
    same = classifiers.fit(frame(spark, [r for r in rows if r[0] in first]), labels, "toxic", "noisy-or", take, 12, 40)
    assert (few == same).all()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, None), (2, body, "a"), (2, body, "a"), (None, body, "a"), (3, None, "a"), (4, "", "b"), (5, "own " * 30_000, "b"), (6, "zero one two three four five six seven eight nine ten eleven", "b")]
    for some in (rows, []):
        docs = frame(spark, some or rows).limit(len(some))
        kept = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)), "stage")
            assert docs.columns == frame(spark, rows).columns
            kept.append(sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i)))
        sequences = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
        if some:
            assert kept[0] == [1, 2, 2, 3, 4, 5, 6, None] and kept[1] == [1, 3, 4, 5, 6] and kept[2] == [1, 3, 4, 5]
            assert set(kept[3]) == {1, 5} and {i for x in sequences["doc_ids"] for i in x} == {1, 5}
        else:
            assert kept == [[], [], [], []] and len(sequences) == 0


def test_classifier_edge_cases(spark, tmp_path):
    docs = frame(spark, [(None, "a b"), (1, None), (2, ""), (3, "z" * 100_000), (3, "again")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op1_toxicity", "op8_quality"):
        out = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents")
    names, before = docs.columns, docs.count()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == names
        kept.append(docs.count())
    assert before >= kept[0] >= kept[1] >= kept[2] > 0
    sequences = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert sorted(sequences["slot"]) == list(range(len(sequences)))
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {i for x in sequences["doc_ids"] for i in x} == ids
    assert corpus_pipeline.run(spark, sf_dir).count() == len(sequences)


def test_an_audit_shortens_the_prefix(spark, monkeypatch):
    """With two trees of eight minima and no formula, whole prefixes miss links of 0.8; the audit says so."""
    from fractions import Fraction

    from sgspark.llm import setjoin

    monkeypatch.setattr(setjoin, "found_share", lambda *a: 1.0)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        base = [f"v{i}x{j}" for j in range(84)]
        for c in range(2):
            w = list(base)
            w[int(rng.integers(20, 60))] = f"changed{c}"
            rows.append((2 * i + c, " ".join(w)))
    docs = frame(spark, rows)
    near = written(docs.selectExpr("monotonically_increasing_id() id", "unhex(md5(text)) key", "doc_id `order`", "text"), "near")
    make, share = setjoin.word_shingles(5), Fraction(4, 5)
    table = setjoin.units(near, near, make, 2, 8, share, setjoin.sample(near, near, make, 2, 8))
    met = setjoin.audited(table, 8)
    assert met.sum() == 2 * sum(k for _, _, k in near_truth(rows)) / 2 and met[8] < met.sum()
    depth = setjoin.depth_for(0.8, 2, 8, 0.999, met)
    assert depth < 8 and met[depth:].sum() >= 0.999 * met.sum()
    got = setjoin.joined(near.select("id", "text"), near, make, share, 2, 8, 0.999)
    assert got.agg({"n_links": "sum"}).first()[0] == sum(k for _, _, k in near_truth(rows))
    assert setjoin.joined(near.select("id", "text"), near, make, share, 2, 8, 0.999, audit=False).agg({"n_links": "sum"}).first()[0] < met.sum()


def test_hot_keys_without_a_broadcast(spark, monkeypatch):
    from sgspark.llm import runtime, setjoin

    monkeypatch.setattr(setjoin, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(40)] + [(90, "alone here"), (91, base[0])]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near_documents.classes(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(near_truth(rows))


def test_a_cluster_has_to_name_a_shared_folder():
    from types import SimpleNamespace

    from sgspark.llm.runtime import shared_dir

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda at: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None, set=lambda k, v: None), sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[4]"))


_LONG = "long enough text to count as a paragraph of an article, really. " * 3


@pytest.mark.parametrize("element", ['<svg class="x"/>', "<svg>", "<video src=x>", "<iframe src=x />", "<math>", "<object data=x>", "<svg><text>no</text></svg>", "<video>no</video>"])
def test_elements_that_are_not_text_take_nothing_else_along(element):
    got = html_extract.main_text(f"<article><p>A {_LONG}</p>{element}<p>B {_LONG}</p></article>")
    assert got == "\n".join(" ".join(f"{x} {_LONG}".split()) for x in "AB")


def test_raw_text_runs_to_its_end():
    assert html_extract.main_text(f"<article><p>A {_LONG}</p><script>if (a < b) x = '<p>no</p>'") == f"A {_LONG}".strip()
    assert html_extract.main_text(f"<article><p>A {_LONG}</p></article><!-- no").endswith("really.")


@pytest.mark.parametrize("mark", ['class="commentlist"', 'class="user-comments"', 'id="commentSection"', 'class="cookiebar"', 'class="adslot"'])
def test_compound_marks(mark):
    got = html_extract.main_text(f"<article><p>A {_LONG}</p><div {mark}><p>NO {_LONG}</p></div><p>B {_LONG}</p></article>")
    assert "NO" not in got and got.startswith("A") and "B long" in got


def test_names_that_only_state_something_are_no_marks():
    assert html_extract.main_text(f"<body class='comments-open'><article class='post comments-open'><p>A {_LONG}</p></article></body>").startswith("A")


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    for unit in ("<b>", "<blockquote>", "<nav>", "<div>", "<video>", "<a><p>", "<li>", "<ul><li>", "</b>", "<p ", "<svg ", "<!a ", "<svg><p>x"):
        page = unit * (1_000_000 // len(unit)) + "<p>x</p>" * 2000
        start = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - start < 15, unit  # quadratic time takes minutes


def test_small_groups_are_shingled_together(monkeypatch):
    from fractions import Fraction
    from types import SimpleNamespace

    import pyarrow as pa

    from sgspark.llm import setjoin

    rng, calls, caught = np.random.default_rng(11), [], []
    texts = ["".join(rng.choice(list("abcdefgh é"), 60)) for _ in range(400)]
    pairs = [(g, t) for g, text in enumerate(texts) for t in (text, text + "!", "short"[: g % 6])]
    same = SimpleNamespace(sparkSession=None)
    same.repartition = same.sortWithinPartitions = lambda *_: same
    monkeypatch.setattr(setjoin, "partitions", lambda _: 1)
    monkeypatch.setattr(setjoin, "map_arrow", lambda df, run, schema: run)
    make = setjoin.char_shingles(8)
    run = setjoin.verified(same, lambda s: calls.append(1) or make(s), Fraction(4, 5))
    column = lambda values, kind=pa.int64(): pa.array(values, kind)
    n = len(pairs)
    rows = pa.RecordBatch.from_arrays([column([g for g, _ in pairs]), *[column([0] * n, pa.int32())] * 3, column(range(n)), column([1] * n), column([t for _, t in pairs], pa.string())], ["gid", "ti", "tj", "block", "uid", "mult", "text"])
    for at in range(0, n, 500):
        caught.append(rows.slice(at, 500))
    got = [r for b in run(iter(caught)) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in got if r["kind"]) == [(3 * g + 1, 3 * g) for g in range(400)]
    assert sorted((r["a"], r["w"]) for r in got if not r["kind"]) == sorted((3 * g + k, 1) for g in range(400) for k in range(2))
    assert len(calls) <= 10


def test_runs_of_characters_are_those_of_each_text():
    import pyarrow as pa

    from sgspark.llm import setjoin, textcore as tc

    texts = ["", "a", "abcdefg", "abcdefgh", "", "é", "éabcdefghé", "x" * 30, "abc", ""]
    for column in (texts, texts[3:5] + texts[6:8], ["", ""], ["ab"], []):
        for s in tc.slices(pa.array(column, pa.string())):
            h, offsets = setjoin.char_shingles(8)(s)
            assert np.diff(offsets).tolist() == [max(len(t) - 7, min(len(t), 1)) for t in column]
            for i, t in enumerate(column):
                one = setjoin.char_shingles(8)(next(iter(tc.slices(pa.array([t])))))[0]
                assert h[offsets[i] : offsets[i + 1]].tolist() == one.tolist()
