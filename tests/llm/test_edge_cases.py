"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import class_lm, decontamination, exact_dedup, html_text, near_dedup, packing, repeated_strings, textkernel, token_rollup, token_store, toxicity
from millrace.llm.common import held_out, stored

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s", 10),
    (2, "Alpha beta\ngamma delta  epsilon zeta", "en", "s", 10),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n", "de", "s", 3),
    (None, "no id here at all", "en", "s", 1),
    (6, "twice", "en", "s", 5),
    (6, "twice", "en", "s", 5),
    (7, LONG, "en", "s", len(LONG)),
    (8, "é𝄞 \x1c ü", "fr", "s", 4),
    (9, "two words", "en", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_id", "row", "token", "u", "v", "node", "component", "digest", "score", "kept", "tag", "_stay", "text_sha256", "group_size", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    return stored(plain.withColumns({c: F.lit(1) for c in CLASHING}), "edge")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, " ".join(LONG.split()[100:140])), (4, " ".join(LONG.split()[100:140]))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[2].keep_id, by_id[2].group_size, by_id[2].kept) == (1, 2, False)
    assert (by_id[4].keep_id, by_id[3].group_size) == (3, 2) and by_id[5].keep_id == 5
    assert by_id[6].group_size == 2 and by_id[6].kept
    assert by_id[None].keep_id is None and by_id[None].kept
    assert by_id[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "6", "7", "8", "9", "None"]


def test_exact_dedup_survives_colliding_digests_and_many_batches(docs):
    weak = lambda text: F.unhex(F.substring(F.sha2(F.length(text).cast("string"), 256), 1, 2))
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    assert sorted(map(str, exact_dedup.exact_groups(docs, digest=weak).collect())) == want
    assert sorted(map(str, exact_dedup.exact_groups(docs.repartition(5), files_per_batch=1).collect())) == want


def test_exact_dedup_keeps_its_state_between_deliveries(spark, tmp_path):
    """A second delivery is judged against the first, whose bytes are read by their locators."""
    def deliver(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / name))
        got = exact_dedup.exact_groups(spark.read.parquet(str(tmp_path / name)), state=f"{tmp_path}/state").collect()
        return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got}

    assert deliver("a", [(5, "one  text"), (6, "other"), (7, "one text")]) == {5: (5, 2, True), 7: (5, 2, False), 6: (6, 1, True)}
    assert deliver("b", [(8, "other"), (2, "one text"), (9, "new")]) == {8: (6, 2, False), 2: (2, 3, True), 9: (9, 1, True)}


def test_near_dedup(docs, none):
    got = near_dedup.near_groups(docs, percent=80).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS)
    assert (by_id[2].component_id, by_id[2].kept, by_id[1].n_shingles) == (1, False, 2)
    assert [by_id[i].n_shingles for i in (3, 4, 5, 9)] == [0, 0, 0, 1] and all(by_id[i].kept for i in (3, 4, 5, 6, 9))
    assert by_id[None].component_id is None
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_decontamination(docs, none, benchmark):
    for per_pass in (1000, 2):
        got = sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontamination.matches(docs, benchmark, items_per_pass=per_pass).collect())
        assert got == [(7, 4, 1.0), (7, 4, 1.0), (9, 1, 1.0)]
        kept = decontamination.drop_contaminated(docs, benchmark, items_per_pass=per_pass)
        assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontamination.matches(none, benchmark).count() == 0 and decontamination.matches(docs, benchmark.limit(0)).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    empty = toxicity.learn(none, labels.limit(0))
    assert toxicity.scores(none, empty).count() == 0 and all(r.score < 0.01 for r in toxicity.scores(docs, empty).collect())


def test_toxicity_folds_disguises_and_spares_exceptions():
    model = toxicity.Model({" idiot": 5.0}, [" idiotype "], (-4.0, 2.0, 1.0))
    automaton = model.automaton()
    hits = [toxicity.measures(automaton, t)[0] > 0 for t in ("You IDIOT!", "1d10t", "іdіоt", "(idiots)", "an idiotype", "pidiot", "", None)]
    assert hits == [True, True, True, True, False, False, False, False]


def test_toxicity_reads_long_texts_and_phrases():
    import time

    model = toxicity.Model({" idiot": 5.0, " rat": 2.0}, [" idiotype ", " lab rat "], (-4.0, 2.0, 1.0))
    automaton = model.automaton()
    assert [toxicity.measures(automaton, t)[0] > 0 for t in ("a lab rat", "a rat", "lab rats", "the rat lab")] == [False, True, True, True]
    began = time.process_time()
    assert toxicity.measures(automaton, "idiot idiotype lab rat " * 50_000)[0] == pytest.approx(__import__("math").log1p(5.0 * 50_000))
    assert time.process_time() - began < 4


def test_packing(docs, none):
    got = packing.pack(docs, VOCABULARY, 64).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        assert [o for o, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 64
    assert packing.pack(none, VOCABULARY, 64).count() == 0


def test_token_store(spark, docs, none, tmp_path):
    token_store.write_store(docs, str(tmp_path / "a"), VOCABULARY, block_rows=2)
    got = token_store.read_documents(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(got) == len(ROWS) and got[0].doc_id is None and [r.start for r in got][1:] == [sum(x.n_tokens for x in got[:k]) for k in range(1, len(got))]
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert {r.doc_id: list(r.ids)[-1] for r in token_store.read_ids(spark, str(tmp_path / "a"), [9, 4, 77]).collect()} == {9: 0, 4: 0}
    token_store.write_store(none, str(tmp_path / "b"), VOCABULARY)
    assert token_store.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_language_model(docs, none):
    def run(rows):
        counts = stored(class_lm.token_counts(class_lm.texts_of(rows).where(~held_out(F.col("doc_id"), 10, 0))), "counts")
        return class_lm.scored(class_lm.texts_of(rows), counts, class_lm.train(class_lm.texts_of(rows), counts, vocabulary=50, classes=4), 10, 0).collect()

    got = run(docs)
    assert len(got) == len(ROWS) and {r.doc_id: r.n_tokens for r in got}[4] == 1 and all(r.score < 0 and r.base_score < 0 for r in got)
    assert run(none) == []


def test_language_model_is_a_distribution(spark):
    text = spark.createDataFrame([(i, "a b c d a b " + "x%d y" % i) for i in range(1, 40)], "doc_id long, text string")
    counts = stored(class_lm.token_counts(text), "counts")
    m = class_lm.train(text, counts, vocabulary=4, classes=2)
    assert (10**m.transitions).sum(axis=1) == pytest.approx([1.0] * 4)
    clustered = {t for t, i in zip(m.keys.tolist(), m.ids.tolist(), strict=True) if i < 4}
    tail = sum((r.n - m.discount) / m.tail_total for r in counts.collect() if r.token not in clustered and r.token != -1) + m.discount * m.tail_distinct / m.tail_total
    assert tail == pytest.approx(1.0)
    for c in range(2):
        assert sum(10**e for e, k in zip(m.emissions[:4], m.classes[:4], strict=True) if k == c) == pytest.approx(1.0) or not (m.classes[:4] == c).any()


def test_html():
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two  three<p>Four</article><div class='comments'><p>me too</div><footer>f</footer><script>'</p>'</script>"
    assert html_text.extract(page) == "T & U\n\nOne two three\n\nFour"
    assert [html_text.extract(x) for x in (None, "", "  ", "just text", "<p", "<!-- <p>x</p> -->")] == ["", "", "", "just text", "<p", ""]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.main_texts(pages).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_repeated_strings(docs, none):
    got = {r.doc_id: r for r in repeated_strings.remove_repeats(docs).collect()}
    assert got[3].n_bytes == 0 and got[1].n_removed == 0 and got[8].n_bytes == len("é𝄞 \x1c ü".encode())
    assert got[7].n_bytes == len(LONG) and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert repeated_strings.remove_repeats(docs).count() == len(ROWS) and repeated_strings.remove_repeats(none).count() == 0


def test_rollup(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    change = lambda rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, version string, tokens long")
    totals = lambda: {(r.source, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    first = change([("insert", 1, "a", "en", "v1", 5), ("insert", 2, "a", None, "v1", 7), ("insert", None, None, "en", "v1", None), ("delete", 9, "a", "en", "v1", None)])
    assert rollup.totals().count() == 0
    rollup.commit(0, first)
    rollup.commit(0, first)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {("a", "en"): (1, 5), ("a", None): (1, 7), (None, "en"): (1, 0)}
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit(0, change([("insert", 1, "a", "en", "v1", 6)]))
    rollup.commit(1, change([("revise", 1, "b", "en", "v1", 6), ("delete", 2, None, None, "v1", None), ("insert", None, None, "en", "v1", 4)]))
    rollup.commit(2, change([]))
    assert totals() == {("b", "v1"): (1, 6), (None, "v1"): (1, 4)}
    rollup.compact()
    rollup.commit(3, change([("revise", 1, "b", "en", "v1", 9), ("revise", 1, "b", "en", "v2", 3)]).withColumns({c: F.lit(1) for c in ("bucket", "docs", "_nth", "_id", "batch")}))
    assert totals() == {("b", "v1"): (1, 9), ("b", "v2"): (1, 3), (None, "v1"): (1, 4)}
    with pytest.raises(ValueError, match="after batch"):
        rollup.commit(-1, change([]))
    rollup.spark.createDataFrame([("x", "y", "en", "v1", 7, 7)], token_rollup.TOTALS.replace("source", "doc_id string, source", 1)).write.parquet(f"{tmp_path}/totals/batch=4")
    assert totals()["b", "v1"] == (1, 9)  # what has no commit is not read


def test_rollup_by_vocabulary(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    got = token_rollup.counted_by_vocabulary(docs, VOCABULARY, "bpe/1").collect()
    want = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS)
    assert sorted(r.tokens for r in got) == want and {r.version for r in got} == {"bpe/1"}


def test_rollup_query_counts_rows_without_and_with_repeated_ids(spark, tmp_path):
    rows = [(None, "a b", "en", "s", 3), (None, "c", "en", "s", 1), (4, "d e f", "en", "s", 5), (4, "d e f", "en", "s", 5), (5, None, "en", "s", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.version: (r.n_docs, r.n_tokens) for r in token_rollup.op1_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {"words/1": (4, 9), "pieces/1": (4, 9)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages(name, stage, spark, docs, none, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    everything = ["1", "2", "3", "4", "5", "6", "6", "7", "8", "9", "None"]
    gone = {"exact_dedup": ["2", "4"], "near_dedup": ["2"], "decontamination": ["7", "9"]}.get(name, [])
    found = out.where("piece = 0") if name == "packing" else out
    assert sorted(str(r.doc_id) for r in found.collect()) == [x for x in everything if x not in gone]
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
        assert {tuple(r) for r in out.collect()} <= set(ROWS)
    assert stage(spark, none, str(tmp_path)).count() == 0




def test_language_model_joins_rare_words_as_it_looks_up_frequent_ones(spark):
    text = class_lm.texts_of(spark.createDataFrame([(i, f"a b c d{i % 7} a b x{i} y") for i in range(1, 60)], "doc_id long, text string"))
    counts = stored(class_lm.token_counts(text), "counts")
    both = []
    for frequent in (4, 1000):
        model = class_lm.train(text, counts, vocabulary=4, classes=2, frequent=frequent)
        assert len(model.keys) <= frequent
        both.append({r.doc_id: (r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in class_lm.scored(text, counts, model, 10, 0).collect()})
    assert both[0] == both[1]


def test_repeated_strings_in_repeated_rows(spark):
    one, two = LONG[:900], LONG[5000:5900]
    rows = spark.createDataFrame([(1, one), (1, one), (2, two), (3, "x" + two[:400] + "y" * 150), (None, two[300:560])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in repeated_strings.remove_repeats(rows).collect())
    assert got == [("1", 900, 1), ("1", 900, 1), ("2", 560, 1), ("3", 400, 1), ("None", 260, 1)]


def test_language_model_clusters_all_words_above_the_floor(spark):
    """Twice as many words as the seed holds: every one gets a class, and the likelihood rises at each step."""
    rows = [(i, "noun0 verb0 noun1 verb1 noun2 verb2 " * 3 + " ".join(f"noun{(i * 7 + j) % 60} verb{(i * 11 + j * 3) % 60}" for j in range(30)) + f" once{i}") for i in range(1, 80)]
    text = class_lm.texts_of(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = stored(class_lm.token_counts(text), "counts")
    m = class_lm.train(text, counts, classes=2, seed=60, tolerance=0.001)
    got = {r.token: r["class"] for r in m.words.collect()}
    assert len(got) == 120 and set(got) == {r.token for r in counts.collect() if r.n >= 5 and r.token != -1}
    assert m.steps == sorted(m.steps) and m.steps[-1] > 3 * m.steps[0]
    both = []
    for frequent in (8, 1000):
        m = class_lm.train(text, counts, classes=2, seed=6, frequent=frequent)
        assert sum(10**m.emissions[:-2][m.classes[:-2] < 2]) <= 2 + 1e-9
        both.append({r.doc_id: (r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in class_lm.scored(text, counts, m, 10, 0).collect()})
    assert both[0] == both[1]


def test_near_dedup_takes_small_batches_and_leaves_the_setting(spark, docs, monkeypatch):
    """Jobs of near_groups get Arrow batches of 2,000 rows at most and small tables of powers; the session keeps its setting."""
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: (seen.append(int(spark.conf.get(key))), write(df, label))[1])
    for before in ("10000", "100"):
        spark.conf.set(key, before)
        try:
            near_dedup.near_groups(docs).count()
            assert spark.conf.get(key) == before and set(seen) == {min(2000, int(before))}
        finally:
            spark.conf.unset(key)
            seen.clear()
    monkeypatch.setattr(textkernel, "_powers", {})
    list(near_dedup.shingle_sets(pa.array(["a b c d e f"] * 3), 5))
    assert len(textkernel._powers["up"]) <= 1 << 20


def test_toxicity_hands_terms_on_in_bounded_pieces():
    texts = [" ".join(f"{chr(97 + i % 26)}{j}word{i}".translate(str.maketrans("0123456789", "klmnopqrst")) for j in range(300)) for i in range(40)]
    batch = pa.record_batch({"text": texts, "toxic": [i % 2 == 0 for i in range(40)]})
    found = list(toxicity._term_rows(batch, 8, most=2000))
    assert max(map(len, found)) < 2000 + max(len(toxicity._terms(t, 8)) for t in texts) and len(found) > 3
    assert {r for rows in found for r in rows} == {(w, toxicity._family(t), i % 2 == 0) for i, t in enumerate(texts) for w in toxicity._terms(t, 8)}


def test_packing_leaves_no_exact_complement():
    """The most even pair (274, 274) needs more pieces of 274 than there are: the next pair is taken."""
    patterns = packing.plan({1500: 10_000, 274: 1, 300: 10_000, 248: 10_000}, 2048)
    assert ({1500: 1, 300: 1, 248: 1}, 10_000) in patterns
    assert sum(n for _, n in packing.plan({6: 1, 4: 2, 2: 1, 1: 2}, 12)) == 2


def test_html_by_line_blocks():
    text = [f"Sentence {i} of the story, long enough to be main text." for i in range(8)]
    story = "".join(f"<p>{t}</p>" for t in text)
    comments = "".join(f"<article class=comment><p>Reader {i} says so.</p></article>" for i in range(4))
    want = "\n\n".join(text)
    assert html_text.extract(f"<div class=entry>{story}</div>{comments}") == want
    assert html_text.extract(f"<div class=entry>{story}</div><aside class=related><article><p>teaser</p></article></aside>") == want
    assert html_text.extract(f"<article>{story}{comments}</article>") == want
    assert html_text.extract(f"<div>{story}</div>") == want
    advert = "<div class=ad><p>Buy</p><p>now</p><p>here</p></div>"
    assert html_text.extract(f"<div>{story}{advert}<p>A short end.</p></div>") == want + "\n\nA short end."


def test_html_keeps_what_an_article_holds():
    """Names that occur in an article's own parts, inline buttons and formulas; what is not its text still goes."""
    body = "".join(f"<p>Paragraph {i} of the article, with text enough.</p>" for i in range(5))
    page = (
        '<div class="page-header"><p>Site</p></div><article><div class="article-header"><h2>Title</h2></div><p>Use <button>Save</button> now, <math><mi>x</mi></math> first.</p>'
        f'{body}<section class="related-work"><p>Others did it too.</p></section><div class="ad"><p>Buy</p></div><form><p>Mail</p></form><section id="comments"><p>First!</p></section></article><button>Top</button>'
    )
    want = ["Title", "Use Save now, x first.", *(f"Paragraph {i} of the article, with text enough." for i in range(5)), "Others did it too."]
    assert html_text.extract(page) == "\n\n".join(want)


@pytest.mark.parametrize("part", ["<b x ", "<i>x</b>", "<![CDATA[", "<!", '<b "', "<div>", "</p>", "<p class='", "&amp", "<!-- ", "<script>", "<a href=x>"])
def test_html_reads_malformed_pages_in_linear_time(part):
    import time

    page = "<p>Text</p>" + part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 4


def test_html_drops_what_is_no_part_of_an_article():
    """Notices, adverts and comments inside an article go, whatever their names add; parts whose names add a meaning stay."""
    kept = "".join(f'<div {a}><p>{"kept words " * 20}</p></div>' for a in ('class="article-header"', 'class="related-work"', 'id="share-prices"', 'class="body-text"', 'class="noticeable"'))
    names = ['class="notice"', 'class="ad-slot"', 'class="cookie-banner"', 'id="comment-list"', 'class="CommentThread"', 'class="widget"', 'class="related"', 'role="search"', 'class="x related-links"', 'class="social_share_buttons"']
    gone = "".join(f"<div {a}><p>{'gone away ' * 20}</p></div>" for a in names)
    page = f"<html><body><article><header><h1>{'The title ' * 5}</h1></header>{kept}{gone}<p>{'kept words ' * 60}</p></article></body></html>"
    text = html_text.extract(page)
    assert "gone" not in text and text.count("kept words") == 160 and text.startswith("The title")


def test_toxicity_learns_rare_words_from_many_labels(spark):
    """A word of 44 in 2,200 toxic texts and of no clean one is learned at 20,000 labels."""
    filler = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(900)).cast("string")) for k in range(12)))
    toxic = F.col("id") < 2200
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(filler, F.when(F.col("id") % 50 == 0, F.when(toxic, " grolmok").otherwise("")).otherwise(""), F.when(toxic, " vilest").otherwise("")).alias("text"))
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") < 2200).cast("int").alias("toxic")))
    assert any(" grolmok ".startswith(t) for t in model.weights)
