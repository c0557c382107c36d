import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import strings, text
from loomtext.graph import connected_components
from loomtext.operators import chunks, corpus, dedup, diff, index, labels, lexicon, lines, matching, measures, punkt, reading, spans, structure, values, vectors, vocabulary
from loomtext.sources import readers
from loomtext.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, (World)! -- a.b",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["hello", "world", "a.b"], [], None]


def test_string_metrics():
    assert strings._damerau("ca", "abc") == 2 and strings._osa("ca", "abc") == 3
    assert round(strings._jaro_winkler("dwayne", "duane"), 2) == 0.84
    assert strings._lcs("abcde", "ace") == 3 and strings._common_substring("abcxyz", "zabcx") == 4
    assert strings.soundex_code("Ashcraft") == "A226" and strings.soundex_code("") == "0000"
    with pytest.raises(ValueError):
        strings.metric("nope")


def test_ngram_jaccard_is_multiset(spark):
    df = spark.createDataFrame([("night", "nacht"), ("", "")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(strings.metric("ngram_jaccard")(F.col("a"), F.col("b"))).collect()]
    assert got == [0.1429, 1.0]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3)] + [(100, k) for k in range(101, 140)], "a long, b long")
    got = dict(rows(connected_components(e)))
    assert got[3] == 1 and got[5] == 4 and got[7] == 7 and got[139] == 100 and None not in got
    assert rows(connected_components(e.limit(0))) == []


def test_find_all_overlapping(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "bb"), (3, None)], "doc_id long, text string")
    assert rows(matching.find_all(df, "aa")) == [(1, 0), (1, 1)]
    assert rows(matching.find_all(df, "")) == []


def test_spans(spark):
    s = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 10, 12), (1, "a", 2000, 2010)], "doc_id long, label string, start long, end long")
    m = spark.createDataFrame([(1, 3, 5), (1, 4, 6), (1, 2005, 2020)], "doc_id long, start long, end long")
    assert rows(spans.merge_adjacent(s)) == [(1, "a", 0, 12), (1, "a", 2000, 2010)]
    assert rows(spans.subtract(s, m)) == [(1, 0, 3), (1, 6, 10), (1, 10, 12), (1, 2000, 2005)]
    wide = spark.createDataFrame([(1, 0, 5000)], "doc_id long, start long, end long")
    assert len(rows(spans.overlapping(wide, wide))) == 1


def test_lines_and_chunks(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r[2] for r in rows(lines.lines(df)) if r[0] == 1] == ["a", "b", "", "c"]
    assert [r[4] for r in rows(lines.paragraphs(df))] == ["a\nb", "c"]
    assert chunks.pack_units([5, 5, 20, 1], 10) == [(0, 2), (2, 3), (3, 4)]
    assert chunks.pack_units([3, 3, 3, 3], 9, 1) == [(0, 3), (2, 4)]
    got = rows(chunks.fixed(spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string"), 1, 0))
    assert [r[4] for r in got] == ["abcd", "efgh", "ij"]


def test_vote_ties_go_to_first_seen(spark):
    r = spark.createDataFrame([(1, 0, 0, "b"), (1, 1, 1, "a"), (1, 2, 2, None)], "doc long, chunk long, pos long, label string")
    assert rows(labels.vote(r)) == [(1, "b", 1)]
    assert rows(labels.intersection(r)) == []


def test_mmr():
    c = [(1, [1.0, 0.0], 0.9), (2, [1.0, 0.0], 0.8), (3, [0.0, 1.0], 0.5)]
    assert [i for i, _ in vectors.mmr(c, 2, 0.5)] == [1, 3]


SAMPLE = ["bm25_search", "label_majority", "heading_scores", "span_merge", "ngram_cosine_pairs", "quality_metrics", "knn_graph"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("documents", "queries", "events", "part", "embeddings", "entity_matches"):
        con.execute(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(map(str, r)) for r in cur.fetchall())
    got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, SF).select(*cols).collect())
    assert got == want


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_token_flags(spark):
    words = ["A", "U.S.A.", "etc.", "well-known", "B2B", "42", "Hello", "iPhone", "HELLO", "€", "", "x.", "--", "☀"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r["t"]: {k for k, v in r.asDict().items() if v is True} for r in df.select("t", *(c.alias(k) for k, c in text.token_flags(F.col("t")).items())).collect()}
    assert {"is_abbreviation", "is_uppercase_word"} <= got["A"] and "is_abbreviation" in got["U.S.A."] and "is_abbreviation" in got["etc."]
    assert "is_hyphenated" in got["well-known"] and "is_alphanumeric_word" in got["B2B"] and {"is_numeric_word", "starts_with_digit"} <= got["42"]
    assert "is_title_case_word" in got["Hello"] and "is_mixed_case_word" in got["iPhone"] and "is_symbolic_word" in got["€"]
    assert got[""] == set() and "has_emoji" in got["☀"] and "has_dash" in got["--"]


def test_normalise_keeps_places():
    got, at = text.normalise_with_offsets("A “B”—  Straße…")
    assert got == 'a "b"- strasse...' and at[0] == 0 and len(at) == len(got) and at[-1] == len("A “B”—  Straße…") - 1


def test_metaphone_and_aliases():
    assert [strings.metaphone_code(w) for w in ("Thompson", "Knight", "Physics", "Station", "")] == ["0MPSN", "NT", "FSKS", "STXN", ""]
    assert strings.metric("Jaro-Winkler") is strings.METRICS["jaro_winkler"] and strings.SCALARS["token_jaccard"]("a b", "a c") == 1 / 3


def test_patterns():
    p = matching.Patterns(["ship", "ships"], longest=True, ignore_case=True, word_boundary=True)
    assert p.find_all("Ships, shipping and a SHIP") == [(1, 0, 5), (0, 22, 26)]
    assert matching.Patterns(["ship", "ships"]).find_all("ships") == [(0, 0, 4)]
    assert p.replace_all("a ship", ["boat", "boats"]) == "a boat" and matching.Patterns([]).find_all("x") == []
    assert matching.Patterns(["STRASSE"], ignore_case=True).find_all("die Straße.") == [(0, 4, 10)]


def test_find_first_last_and_fuzzy(spark):
    d = docs(spark, "abcabc", "xyz", None)
    got = rows(d.select("doc_id", matching.find_first(F.col("text"), "abc"), matching.find_last(F.col("text"), "abc")).where("doc_id < 2"))
    assert got == [(0, 0, 3), (1, None, None)]
    keys = spark.createDataFrame([("kitten",), ("sitting",), ("x",)], "key string")
    assert rows(matching.fuzzy(keys, spark.createDataFrame([("sittin",)], "word string"), 2)) == [("sittin", "kitten", 2), ("sittin", "sitting", 1)]


def test_searcher(spark):
    d = docs(spark, "the ship leaves", "a boat stays", "the vessel and the ship", "", None).withColumn("source", F.lit("s"))
    q = spark.createDataFrame([(1, "ship"), (2, ""), (3, None)], "query_id long, query_text string")
    plain = index.Searcher.build(d).search(q, 5)
    assert [r["doc_id"] for r in plain.orderBy("rank").collect()] == [0, 2] and "source" in plain.columns
    edges = lexicon.entries(spark, [("ship", "synonym", "vessel", None, None), ("ship", "synonym", "boat", None, None)])
    wide = index.Searcher.build(d, edges).search(q, 5)
    assert {r["doc_id"] for r in wide.collect()} == {0, 1, 2}
    assert index.Index.build(d.limit(0)).n == 0


def test_index_is_kept(spark, tmp_path):
    d = docs(spark, "the ship leaves", "the ship and the boat")
    i = index.Index.build(d)
    i.write(f"{tmp_path}/i")
    j = index.Index.read(spark, f"{tmp_path}/i")
    q = spark.createDataFrame([(1, "the boat")], "query_id long, query_text string")
    assert rows(index.search_bm25(i, q)) == rows(index.search_bm25(j, q)) and j.n == 2
    assert i.merged(j).n == 2 and i.merged(j).avgdl == 2 * i.avgdl


def test_search_within_documents(spark):
    d = docs(spark, "A ship came. A boat left.\n\nThe boat came back.", "No match here.")
    q = spark.createDataFrame([(1, "boat")], "query_id long, query_text string")
    assert {r["segment_no"] for r in index.search_paragraphs(d, q).collect()} == {0, 1}
    s = index.search_sentences(d, q).collect()
    assert {(r["segment_no"], r["start"]) for r in s} == {(1, 13), (2, 27)}


def test_sentence_model(spark):
    t = " ".join(f"Then Mr. Hale again met Dr. Moss on the ship in room {k} here. The rate rose again. They wait for the ship. It is here now." for k in range(40))
    m = punkt.train(docs(spark, t, t, None, ""), ("dr",))
    assert "mr" in m.learned and "dr" in m.provided and m.tokens == 2 * len(t.split())
    u = "Then Mr. Hale met Dr. Moss on the ship. The rate rose here. It is now."
    assert [u[s:e] for s, e in punkt.breaks(u, m)] == ["Then Mr. Hale met Dr. Moss on the ship.", "The rate rose here.", "It is now."]
    assert punkt.Model.from_json(m.to_json()) == m
    assert punkt.train(docs(spark, "x").limit(0)).tokens == 0
    assert punkt.merge(m, m).tokens == 2 * m.tokens and punkt.prune(m, 10**9).stats == {}
    assert [r["text"] for r in punkt.paragraphs(docs(spark, "One. Two.\n\nThree."), m).orderBy("par_no").collect()] == ["One. Two.", "Three."]


def test_statistics_agree(spark):
    for a, b, ab, n in ((50, 48, 48, 10000), (10, 100, 10, 500), (10, 0, 0, 100)):
        got = spark.range(1).select(punkt.dunning_column(*(F.lit(float(x)) for x in (a, b, ab, n)))).first()[0]
        assert abs(got - punkt.dunning(a, b, ab, n)) < 1e-6


def test_chunkers(spark):
    t = "1. Scope\nThe first rule is short. It ends here.\n\n2. Terms\n" + "Every term is explained in this part of the text. " * 12
    for by in ("sentence", "paragraph", "section", "level"):
        for r in chunks.cut(docs(spark, t, "", None), by, 40).collect():
            assert t[r["start"] : r["end"]] == r["text"] and (r["n_tokens"] <= 40 or r["depth"] == 0 and by == "level")
    sections = chunks.Cutter().sections("Intro\n1. A\nx\n2. B\ny")
    assert [(s[3], s[4]) for s in sections] == [("", 0), ("decimal", 1), ("decimal", 1)]
    assert chunks.semantic_groups([5, 5, 5], [0.9, 0.1], 100, 0.5) == [(0, 2), (2, 3)] and chunks.semantic_groups([], [], 1, 0) == []
    with pytest.raises(ValueError):
        chunks.cut(docs(spark, "x"), "page")


def test_line_labels(spark):
    kinds = {t: (m.kind if (m := structure.parse_enumerator(t)) else None) for t in ("1. x", "1 x", "(a) x", "(iv) x", "i. x", "§ 5 x", "Section 5. x", "- x", "-", "Article XII")}
    assert kinds == {"1. x": "decimal", "1 x": None, "(a) x": "paren_alpha", "(iv) x": "paren_roman", "i. x": "roman_lower", "§ 5 x": "section", "Section 5. x": "section_word", "- x": "bullet", "-": None, "Article XII": "subpart_word"}
    t = "REPORT\n\nSection 1. Terms\n\nThe owner pays the rate when the crew has left the harbour.\n| a | b |\n\nDISCUSSION\n\nSome text follows here, which is long enough to be a body line.\n"
    x = structure.label_text(t)
    assert x.labels == ["heading", "blank", "heading", "blank", "body", "body", "blank", "heading", "blank", "body"]
    assert [(n[1], n[2], n[6]) for n in structure.outline_nodes(x)] == [("REPORT", 1, None), ("Section 1. Terms", 7, 0), ("DISCUSSION", 1, None)]
    s = structure.summarize_structure(structure.label_lines(docs(spark, t, "", None))).collect()
    assert len(s) == 1 and s[0]["heading"] == 3 and s[0]["body_ratio"] == 0.5
    page = "\n".join("HEAD\n" + "\n".join(f"{w} {p}{i}" for i, w in enumerate(["text"] * 48)) + f"\n{p + 1}" for p in range(4))
    assert {r[0] for r in structure.boilerplate(structure.line_records(page))} >= {"header", "page_number"}


def test_diff(spark):
    p = spark.createDataFrame([(1, "a b c d\nsame line here\ngone now", "same line here\na b c e\nnew one"), (2, None, "x"), (3, "", "")], "pair_id long, a string, b string")
    got = [tuple(r[c] for c in ("pair_id", "kind", "left_no", "right_no")) for r in diff.diff_documents(p, "line").collect()]
    assert sorted(got, key=str) == sorted([(1, "modified", 0, 1), (1, "unchanged", 1, 0), (1, "removed", 2, None), (1, "added", None, 2), (2, "added", None, 0)], key=str)
    assert diff.changes(["a", "b"], ["b", "a"], strings.SCALARS["jaro"], moves=True)[0][0] == "moved"


def test_duplicates(spark):
    words = [f"w{k}" for k in range(60)]
    base, near = " ".join(words), " ".join(words[:58] + ["x", "y"])
    d = docs(spark, base, near, base, "short one", None, "", " ".join(reversed(words)))
    assert dict(rows(dedup.duplicate_classes(d).select("doc_id", "class_id"))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {(r[0], r[1]) for r in rows(dedup.find_duplicates(d))} == {(0, 1), (0, 2)}
    assert dedup.band_shape(128, 0.5) == (32, 4) and dedup.duplicate_classes(d.limit(0)).count() == 0
    sig = dedup.signatures(d)
    i = dedup.MinHashIndex(sig, threshold=0.8)
    asked = sig.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    assert {1, 2} <= {r["doc_id"] for r in i.above(asked, 0.7).collect()}


def test_digests(spark):
    a, b = "the ship left the harbour " * 60, "the ship left the harbour " * 60 + "and came back"
    x, y = dedup.ctph(a.encode(), 8, 8), dedup.ctph(b.encode(), 8, 8)
    df = spark.createDataFrame([(x, y), (x, x), ("8:8:", "8:8:"), (x, "9:8:aa")], "a string, b string")
    got = [tuple(r) for r in df.select(dedup.digest_similarity(F.col("a"), F.col("b")), dedup.digest_similarity(F.col("a"), F.col("b"), True)).collect()]
    assert got[1] == (1.0, 1.0) and got[2] == (0.0, 0.0) and got[3] == (0.0, 0.0) and 0 < got[0][1] <= 1
    assert dedup.token_ctph([]) == "4:8:" and dedup.token_ctph([1, 2, 3, -1]) == dedup.token_ctph([1, 2, 3, -1])


def test_resolve_overlaps(spark):
    s = spark.createDataFrame([(1, 1, "a", 0, 10, 0.9), (1, 2, "a", 5, 15, 0.5), (1, 3, "b", 0, 20, 0.1), (2, 4, "a", 0, 5, 0.1)], "doc_id long, span_id long, label string, start long, end long, score double")
    got = {tuple(r)[:5] for r in spans.resolve_by_score(s, ["a"]).collect()}
    assert got == {(1, 1, "a", 0, 10), (1, 2, "a", 10, 15), (1, 3, "b", 0, 20), (2, 4, "a", 0, 5)}


def test_values():
    got = lambda f, t: [(x.match, x.number, x.value, x.unit) for x in f(t)]
    assert got(values.numbers, "1,234.5 or 12,3, twenty-five, IV. I") == [("1,234.5", 1234.5, None, None), ("twenty-five", 25.0, None, None), ("IV", 4.0, None, None)]
    assert got(values.money, "$1,000, ten dollars") == [("$1,000", 1000.0, None, "USD"), ("ten dollars", 10.0, None, "USD")]
    assert [x.number for x in values.percentages("5.25% and 50bps, three percent")] == [0.0525, 0.005, 0.03]
    assert [x.value for x in values.dates("2020-01-05, March 3, 2021, 12/25/99, 31.12.2020, 2020-02-31")] == ["2020-01-05", "2021-03-03", "1999-12-25", "2020-12-31"]
    assert [x.value for x in values.times("5 PM, 09:30, noon, 25:00")] == ["17:00:00", "09:30:00", "12:00:00"]
    assert [x.number for x in values.durations("90 days or a month")] == [7776000.0, 2592000.0]
    assert [(x.number, x.unit) for x in values.quantities("5 kg and 10 square feet, 20°C")] == [(5.0, "kg"), (10.0, "ft^2"), (20.0, "°C")]
    assert [x.kind for x in values.contacts("a@b.com +1 212-555-0100 https://x.org/y.")] == ["email", "phone", "url"]
    assert [(x.value, x.kind) for x in values.companies("by Acme Works, Inc. and Foo & Bar Pvt. Ltd.")] == [("Acme Works", "Inc."), ("Foo & Bar Pvt.", "Ltd.")]
    assert [x.value for x in values.defined_terms('X (the "Borrower") and (each a "Party")')] == ["Borrower", "Party"]
    for f in values.EXTRACTORS.values():
        assert f("") == [] and isinstance(f("((( $ % ° :: @ 99/99/9999 \u0000 " * 50), list)


def test_reading_counts(spark):
    assert [reading.syllable_count(w) for w in ("nation", "video", "table", "makes", "abatement", "science", "", "café", "boss's")] == [2, 3, 2, 1, 3, 2, 0, 2, 2]
    c = reading.Counter_()
    assert c("We toured Wisconsin today.")["fog_complex_words"] == 0 and c("Wisconsin is cold.")["fog_complex_words"] == 1
    got = reading.readability_report(docs(spark, "The cat sat on the mat.", "", None)).collect()
    assert [(r["doc_id"], r["words"], r["letters"], r["sentences"]) for r in got if r["words"]] == [(0, 6, 17, 1)]


def test_quality(spark):
    m = {r["doc_id"]: r for r in measures.quality_metrics(docs(spark, "Pay $5 now.\n\nYes.", "", None, "日本語")).collect()}
    assert set(m) == {0, 3} and m[0]["num_paragraphs"] == 2 and m[0]["num_lines"] == 3 and m[0]["ratio_symbol"] > 0
    assert rows(measures.quality_scores(docs(spark, "x").limit(0))) == []
    with pytest.raises(ValueError):
        measures.quality_scores(docs(spark, "x"), "poetry")


def test_vocabulary(spark):
    d = docs(spark, "b a b", "c a", None)
    assert rows(vocabulary.dense_ids(d)) == [("a", 1), ("b", 0), ("c", 2)]
    words = spark.createDataFrame([(w,) for w in ("a", "b", None)], "word string")
    f = vocabulary.bloom(words, 100, 0.001)
    assert "a" in f and "b" in f and sum(f"x{k}" in f for k in range(1000)) < 20
    assert rows(vocabulary.coverage(d, words)) == [(5, 4, 0.8)]


def test_sparse_pairs_against_all(spark):
    import random

    r = random.Random(2)
    d = docs(spark, *(" ".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 12))) for _ in range(40)))
    i = index.Index.build(d)
    w = vectors.term_weights(i.postings.select("doc_id", "term", "tf"), i.n).cache()
    v = {}
    for row in w.collect():
        v.setdefault(row["doc_id"], {})[row["term"]] = row["w"]
    want = {(a, b) for a in v for b in v if a < b and round(sum(x * v[b].get(t, 0) for t, x in v[a].items()), 6) >= 0.7}
    assert {(r["i"], r["j"]) for r in vectors.sparse_pairs(w, 0.7).collect()} == want


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["src"], r["dst"]) for r in vectors.knn_graph(v, 1).orderBy("src").collect()][:3] == [(1, 2), (2, 1), (3, 2)]
    assert rows(vectors.near_pairs(v, 0.9).select("i", "j")) == [(1, 2)]
    c = v.where("vec_id < 4").selectExpr("1L as query_id", "vec_id", "embedding", "1.0 / vec_id as relevance")
    assert [r["vec_id"] for r in vectors.mmr_select(c, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \nthree\n")
    assert rows(readers.read_lines(spark, str(tmp_path / "a.txt"))) == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "j.jsonl").write_text('{"id": 1, "text": "x"}\n\n{"id": 2, "text": null}\n')
    assert (1, "x") in rows(readers.read_jsonl(spark, str(tmp_path / "j.jsonl")))
    p = index.build_postings(docs(spark, "a b a", "b"))
    readers.write_json_index(p, f"{tmp_path}/ji")
    assert rows(readers.read_json_index(spark, f"{tmp_path}/ji")) == rows(p)
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "x")
    df = spark.createDataFrame([(bytearray(z.getvalue()),), (bytearray(b"%PDF-1"),), (bytearray(b"plain"),)], "b binary")
    assert [r[0][-12:] for r in df.select(readers.sniff_deep(F.col("b"))).collect()] == ["gml.document", "lication/pdf", "text/plain"]


def test_stream_keeps_postings(spark, tmp_path):
    docs(spark, "a b a", "b").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    incremental.maintain_postings(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("term", "doc_id", "tf")) == [("a", 0, 2), ("b", 0, 1), ("b", 1, 1)]


def test_analyze(spark):
    r = corpus.analyze(docs(spark, "One ship. Two ships.\n\nThe ship.", None)).collect()[0]
    assert (r["documents"], r["tokens"], r["unique_tokens"], r["lines"], r["paragraphs"]) == (1, 6, 5, 3, 2) and r["top_terms"][0] == "ship:2"


def test_hybrid_retriever(spark):
    d = docs(spark, "the ship leaves", "a boat stays", "the vessel and the ship")
    i = index.Index.build(d)
    q = spark.createDataFrame([(1, "ship boat")], "query_id long, query_text string")
    h = index.hybrid_retriever(index.bm25_retriever(i), lambda queries, k: index.search_tfidf(i, queries, k))
    assert len(rows(h(q, 2))) == 2 and {r["doc_id"] for r in h(q, 3).collect()} == {0, 1, 2}


def test_banded_neighbours_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q")
    near = {(r["query_id"], r["vec_id"]) for r in vectors.top_k(v, q, 5).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.banded_top_k(v, q, 5).collect()}
    assert len(near & got) >= 0.9 * len(near)


def test_bucket_tiles_lose_nothing(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    d = docs(spark, *(" ".join([*words[:76], f"a{k}", f"b{k}"]) for k in range(12)))
    one = rows(dedup.similar_pairs(d)[1].select("a", "b"))
    monkeypatch.setattr(dedup, "TILE", 3)
    assert rows(dedup.similar_pairs(d)[1].select("a", "b")) == one and len(one) == 66


def test_long_dates_not_in_the_calendar(spark, tmp_path):
    docs(spark, "Due September 32, 2030 or April 31, 1998, not February 29, 2020.").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(entry.queries()["long_dates"](spark, str(tmp_path)).select("match", "value"))
    assert got == [("April 31, 1998", None), ("February 29, 2020", "2020-02-29"), ("September 32, 2030", None)]


def test_versions_in_ranges(spark):
    many = [(k, None if k % 3 == 0 else "a" if k % 3 == 1 or k < 40 else "b", None if k == 7 else f"text {k}") for k in range(60)]
    d = spark.createDataFrame(many, "doc_id long, source string, text string")
    kept = {s: [r for r in many if r[1] == s and r[2]] for s in (None, "a", "b")}
    want = sorted((x[0], x[2], y[2]) for r in kept.values() for x, y in zip(r, r[1:]))
    cut = diff.versions(d, "source", size=4)
    assert rows(cut) == want and rows(diff.versions(d, "source")) == want and rows(diff.versions(d.limit(0), "source", size=4)) == []


def test_words_scored_at_once(monkeypatch):
    a, b = ["the the ship", "***", "", "a b c d", "A, b"], ["the ship the", "ship", "--", "d c b", "a b"]
    for cells in (1, 1 << 21):
        monkeypatch.setattr(diff, "CELLS", cells)
        for least in (0.0, 0.4):
            got = diff._alike_words([diff.word_items(x) for x in a], [diff.word_items(x) for x in b], least)
            assert sorted(got) == sorted(diff._alike(a, b, strings.SCALARS["token_jaccard"], least))


def test_text_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 5)
    monkeypatch.setattr(vectors, "ROWS", 3)
    names = ["oak", "ship", "rate", "lamp", "jar", "wheel", "note", "bolt"]
    texts = [" ".join(names[(k + i * (1 + k % 3)) % 8] for i in range(6)) + f" only{k % 17}" for k in range(30)]
    d = docs(spark, *texts, "", None).unionByName(docs(spark, "oak oak ship"))  # a second row of the first doc_id
    post = index.build_postings(d.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")))
    n = post.select("doc_id").distinct().count()
    want = rows(vectors.sparse_pairs(vectors.term_weights(post, n), 0.6).select("i", "j", F.round("cosine", 5)))
    assert rows(vectors.text_pairs(d, 0.6).select("i", "j", F.round("cosine", 5))) == want and len(want) > 10
    assert rows(vectors.text_pairs(d.limit(0), 0.6)) == [] and rows(vectors.text_pairs(docs(spark, "", None), 0.6)) == []


def test_search_sentences_as_segments(spark, monkeypatch):
    monkeypatch.setattr(index, "AT_ONCE", 2)
    d = docs(spark, "A ship came. A boat left. The ship, the boat. ...\n\nThe boat came back. A ship came.", "No match here.", "", None, "The ship! Ship ahoy.")
    q = spark.createDataFrame([(5, "boat ship ship"), (1, "ship"), (2, None), (3, "zzz"), (None, "back boat")], "query_id long, query_text string")
    cut = punkt.sentences(d).select("doc_id", F.col("sentence_no").alias("segment_no"), "start", "end", "text")
    want = index.search_segments(cut, q, 2).join(cut.select("doc_id", "segment_no", "start", "end"), ["doc_id", "segment_no"])
    got = index.search_sentences(d, q, 2)
    by = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert by(got) == by(want.select(got.columns)) and len(by(got)) == 10
    assert by(index.search_sentences(d, q.limit(0), 2)) == [] and by(index.search_sentences(d.limit(0), q, 2)) == []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_as_fused_lists(spark, monkeypatch):
    monkeypatch.setattr(index, "AT_ONCE", 4)
    words = ["oak", "ship", "rate", "lamp", "jar"]
    d = docs(spark, *(" ".join(words[(k * i) % 5] for i in range(1, 3 + k % 6)) for k in range(40)), "", None, "none of them").unionByName(docs(spark, "oak lamp"))
    q = spark.createDataFrame([(5, "oak ship ship"), (1, "rate"), (2, None), (3, "zzz"), (4, "jar lamp oak")], "query_id long, query_text string")
    i = index.Index.build(d.where("text is not null").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")))
    want = rows(index.fuse(index.search_bm25(i, q, 9), index.search_tfidf(i, q, 9), 3))
    assert rows(index.hybrid_search(d, q, 3)) == want and len(want) == 9
    assert rows(index.hybrid_search(d.limit(0), q)) == [] and rows(index.hybrid_search(d, q.limit(0))) == []


def test_rounded_as_in_sql(spark):
    x = [0.72525, 0.78875, 0.80895, 0.62345, 0.6, 1.0, 0.600049, 0.60005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(vectors.rounded(F.col("x"), 4)).collect()]
    assert got == [duckdb.sql(f"select round({v}::double, 4)").fetchall()[0][0] for v in x]
